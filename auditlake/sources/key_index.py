"""Key index: per data file, or part of a large one, the smallest and largest key and a Bloom filter, so a batch opens only files that may hold its keys."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.session import materialize

#: Bits per key and probes; about one false file in a hundred per key.
BITS_PER_KEY = 10
PROBES = 4
#: Keys in one filter at most; a file with more has several.
PART_KEYS = 1 << 20
#: Keys of a bucket that are still looked up in its filters, and the equal stretches of its key range that are told apart.
PROBED_KEYS = 1 << 15
STRETCHES = 1024
#: Stored rows whose filters, some 2 bytes a row, make a task's share; keys worked on at once.
SHARE_ROWS = 1 << 24
CHUNK = 1 << 13
INDEX = "file string, folder string, month string, buckets array<int>, low long, high long, rows long, bloom binary"


def key_hash(key: str) -> Column:
    return F.xxhash64(F.col(key).cast("long"))


def _places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Probed bits [key, probe] of a filter whose size is a power of two."""
    h = hashes.view(np.uint64) if hashes.dtype == np.int64 else hashes.astype(np.uint64)
    low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return ((low[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(bits - 1)).astype(np.int64)


def bloom(hashes: np.ndarray) -> bytes:
    bits = 64
    while bits < BITS_PER_KEY * len(hashes):
        bits *= 2
    words = np.zeros(bits, bool)
    for i in range(0, len(hashes), CHUNK):
        words[_places(hashes[i : i + CHUNK], bits).ravel()] = True
    return np.packbits(words, bitorder="little").tobytes()


def may_hold(filter_: bytes, hashes: np.ndarray) -> np.ndarray:
    data = np.frombuffer(filter_, np.uint8)
    at = _places(hashes, len(data) * 8)
    return (data[at >> 3] >> (at & 7) & 1).astype(bool).all(axis=1)


def index_files(rows: DataFrame, key: str) -> DataFrame:
    """Rows per file over a scan of written files (key, file, folder, month, bucket): one for up to ``PART_KEYS`` keys of a file that one task reads.

    A file's rows come one after the other, so a task holds the hashes of one part at a time and nothing is shuffled.
    """
    kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = [p.split()[0] for p in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, n, held, buckets, low, high = None, 0, [], set(), None, None

        def part() -> pa.RecordBatch:
            values = [*place, sorted(buckets), low, high, n, bloom(np.concatenate(held))]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for batch in batches:
            if not batch.num_rows:
                continue
            file = batch.column("file")
            turns = np.flatnonzero(pc.not_equal(file.slice(1), file.slice(0, len(file) - 1)).to_numpy(zero_copy_only=False)) + 1
            for i, j in itertools.pairwise([0, *turns.tolist(), len(file)]):
                now = [batch.column(c)[i].as_py() for c in ("file", "folder", "month")]
                if n and (now != place or n >= PART_KEYS):
                    yield part()
                    n, held, buckets, low, high = 0, [], set(), None, None
                some = batch.slice(i, j - i)
                least = pc.min_max(some.column("key")).as_py()
                low, high = (x if y is None else y if x is None else f(x, y) for f, x, y in ((min, low, least["min"]), (max, high, least["max"])))
                buckets.update(b for b in pc.unique(some.column("bucket")).to_pylist() if b is not None)
                place, n = now, n + j - i
                held.append(some.column("hash").to_numpy().copy())
        if n:
            yield part()

    return rows.select(F.col(key).cast("long").alias("key"), key_hash(key).alias("hash"), "file", "folder", "month", "bucket").mapInArrow(run, INDEX)


def candidate_files(index: DataFrame, keys: DataFrame, key: str, bucket: Column, stored: int = 0) -> DataFrame:
    """``(file, folder, month)`` of the files that may hold any of the keys; ``stored`` is about how many rows the index tells of.

    Files are chosen by bucket and by stretches of keys that are asked for. Of a bucket with up to ``PROBED_KEYS`` keys the filters are asked as well;
    more keys than that would find a filter's bits set by chance, whatever the file holds.
    """
    asked = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), key_hash(key).alias("hash"), bucket.alias("bucket")).distinct()
    asked = materialize(asked, "asked-keys")
    reach = asked.groupBy("bucket").agg(F.min("key").alias("_least"), F.max("key").alias("_most"), F.count("*").alias("_asked"))

    def stretch(c: Column) -> Column:
        """Number of the stretch that holds a key; keys outside of the range count as its ends."""
        c = F.greatest(F.least(c, "_most"), "_least")
        c, least, most = (x.cast("decimal(20,0)") for x in (c, F.col("_least"), F.col("_most")))
        return F.floor((c - least) * STRETCHES / (most - least + 1)).cast("int")

    reach = reach.join(
        asked.join(F.broadcast(reach), "bucket").groupBy("bucket").agg(F.array_sort(F.collect_set(stretch(F.col("key")))).alias("_held")), "bucket")
    near = index.withColumn("bucket", F.explode("buckets")).drop("buckets").join(F.broadcast(reach), "bucket")
    near = near.where((F.col("low") <= F.col("_most")) & (F.col("high") >= F.col("_least")))
    first, last = stretch(F.col("low")), stretch(F.col("high"))
    near = near.where(F.exists("_held", lambda s: (s >= first) & (s <= last)))
    few = F.col("_asked") <= PROBED_KEYS

    def probe(files: pa.Table, wanted: pa.Table) -> pa.Table:
        key_, hashes = wanted.column("key").to_numpy(), wanted.column("hash").to_numpy()
        order = np.argsort(key_)
        key_, hashes = key_[order], hashes[order]
        hit = []
        for low, high, filter_ in zip(*(files.column(c).to_pylist() for c in ("low", "high", "bloom")), strict=True):
            i, j = np.searchsorted(key_, low), np.searchsorted(key_, high, side="right")
            hit.append(any(may_hold(filter_, hashes[k : min(k + CHUNK, j)]).any() for k in range(i, j, CHUNK)))
        return files.select(["file", "folder", "month"]).filter(pa.array(hit, pa.bool_()))

    # A bucket's filters are dealt to tasks, each of which gets the bucket's keys.
    shares = 1 + stored // SHARE_ROWS
    share = F.pmod(F.xxhash64("file", "low"), F.lit(shares)).cast("int").alias("share")
    filters = near.where(few).select("bucket", share, "file", "folder", "month", "low", "high", "bloom")
    wanted = asked.join(F.broadcast(reach.where(few).select("bucket")), "bucket", "left_semi")
    wanted = wanted.select("bucket", "key", "hash", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    found = filters.groupBy("bucket", "share").cogroup(wanted.groupBy("bucket", "share")).applyInArrow(probe, "file string, folder string, month string")
    return found.unionByName(near.where(~few).select("file", "folder", "month")).distinct()
