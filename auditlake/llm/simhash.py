"""SimHash near-duplicates: fingerprints, links by bit-sliced comparison, classes.

A document's fingerprint has a bit set if it is set in over half the hashes of its word shingles.
Equal fingerprints are folded first, so copies cost nothing afterwards. Different fingerprints
meet in blocks, and in a block the fingerprints are stored as bit planes: word k of plane b holds
bit b of 64 fingerprints. A query fingerprint is compared with 64 others at once by xor with the
planes; carry-save counters (ones, twos, fours, ...) of a few words add up all 64 distances, and a word of
lanes is abandoned as soon as every distance in it exceeds the radius.

Blocks for ``exact`` links come from the pigeonhole principle: of five parts of a fingerprint, at most
three differ, so two agree in full; each of the ten pairs of parts gives a key. No link is lost. A
key that holds many fingerprints is dealt out by pairs of chunks, so no task gets more than two
chunks of it. A task returns a spanning forest of its links, never all of its pairs: the
classes are the same.

``near_duplicates`` finds documents whose sets of word shingles have a Jaccard similarity of at least
a bound. At 0.8 the fingerprints of such documents differ in about ten bits of 64, for which
parts of a fingerprint are too short to serve as keys; there, blocks come from bands of minima of
shingle hashes. The bit-sliced comparison within a block is the same, with a wider fingerprint and a wider
radius; its forest takes the closest pairs first, and the pairs in it are checked on the whole texts.
Where a pair of a forest fails the check and its texts are not connected otherwise, the block is looked at
again, now with the sets of shingle hashes of its texts beside the fingerprints: the task checks the pairs itself,
closest first, passes over those whose texts are connected by then, and returns only links that join classes. So
no candidate pair is left out, and a block never writes more links than it has texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm import components
from auditlake.llm.common import append_columns, by_name, free_name, utf8
from auditlake.session import materialize

SEED = 42
PARTS = 5
#: Fingerprints of one block that are compared in one task; larger blocks are dealt out in chunks of this many.
CHUNK = 2048
#: Shingle hashes of one chunk where a task checks pairs itself (16 MB).
CHUNK_HASHES = 1 << 21
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(raw: bytes, size: int) -> list[bytes]:
    """Word shingles in order, repeats included; A-Z lower-cased, words parted by ASCII white space.

    Fewer words than ``size`` give the whole sequence, none gives no shingle.
    """
    words = raw.lower().split()
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(size)), strict=False)]


def hashes(items: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x, SEED) for x in items), np.uint64, len(items))


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        bits = np.unpackbits(h[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, name: str = "fingerprint") -> DataFrame:
    """Appends the fingerprint as a long (the 64 bits, signed). Null and empty texts have 0."""

    def score(at, raw):
        data = raw.tobytes()
        values = [majority(hashes(shingles(data[a:b], size))) for a, b in zip(at[:-1], at[1:], strict=True)]
        return [pa.array(np.array(values, np.uint64).view(np.int64))]

    return append_columns(docs, text, [(free_name(docs, name), T.LongType())], score)


def planes_of(words: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (n, w) of uint64: (64 * w, ceil(n / 64)) words, fingerprint i at bit i % 64."""
    n, w = words.shape
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8).reshape(n, 8 * w), axis=1, bitorder="little")
    padded = np.zeros((64 * w, -(-n // 64) * 64), np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def close_pairs(
    words: np.ndarray, starts: np.ndarray, radius: int, at_once: int = 1 << 15
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (i, j, distance), i < j, within groups of consecutive rows that differ in at most ``radius`` bits.

    ``starts`` are the first rows of the groups. The work list holds (query row, word of 64 lanes);
    distances of a word are kept in counters of log2 bits, and words whose lanes all exceed
    the radius leave the list.
    """
    n, w = words.shape
    if n < 2:
        return
    planes = planes_of(words)
    ends = np.append(starts[1:], n)
    last = np.repeat(ends, ends - starts)
    rows = np.arange(n)
    first_word, stop_word = (rows + 1) // 64, -(-last // 64)
    count = np.where(rows + 1 < last, stop_word - first_word, 0)
    done = np.concatenate([[0], np.cumsum(count)])
    levels = int(radius).bit_length()
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(done, done[lo] + at_once, side="right")) - 1)
        c = count[lo:hi]
        q = np.repeat(rows[lo:hi], c)
        lane_word = np.arange(len(q)) - np.repeat(done[lo:hi] - done[lo], c) + np.repeat(first_word[lo:hi], c)
        lo = hi
        if not len(q):
            continue
        base = lane_word * 64
        low = np.clip(q + 1 - base, 0, 63).astype(np.uint64)
        high = np.clip(last[q] - base, 1, 64).astype(np.uint64)
        alive = (FULL << low) & (FULL >> (np.uint64(64) - high))
        counters = [np.zeros(len(q), np.uint64) for _ in range(levels)]
        for b in range(64 * w):
            own = -((words[q, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.int64)
            carry = planes[b, lane_word] ^ own.view(np.uint64)
            for k in range(levels):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            alive &= ~carry  # a distance that no longer fits the counters exceeds the radius
            if b % 8 == 7:
                exceeds = _exceeds(counters, radius)
                alive &= ~exceeds
                stay = alive != 0
                if not stay.all():
                    q, lane_word, alive = q[stay], lane_word[stay], alive[stay]
                    counters = [x[stay] for x in counters]
                    if not len(q):
                        break
        if len(q):
            hit = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            r, lane = np.nonzero(hit)
            distance = sum(((counters[k][r] >> lane.astype(np.uint64)) & np.uint64(1)).astype(np.int64) << k for k in range(levels))
            yield q[r], lane_word[r] * 64 + lane, distance


def _exceeds(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter is larger than the radius, compared from the highest bit down."""
    above = np.zeros_like(counters[0])
    equal = np.full_like(counters[0], FULL)
    for k in reversed(range(len(counters))):
        if radius >> k & 1:
            equal &= counters[k]
        else:
            above |= equal & counters[k]
            equal &= ~counters[k]
    return above


def kruskal(n: int, i: np.ndarray, j: np.ndarray, distance: np.ndarray) -> np.ndarray:
    """Positions of the pairs that make up a minimum spanning forest of ``n`` vertices."""
    label, kept = np.arange(n), []
    for d in np.unique(distance):
        at = np.flatnonzero(distance == d)
        while True:
            a, b = label[i[at]], label[j[at]]
            apart = a != b
            at, a, b = at[apart], a[apart], b[apart]
            if not len(at):
                break
            # Every tree hangs itself below the smallest tree next to it; trees below others follow.
            high, low = np.maximum(a, b), np.minimum(a, b)
            best = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(best, high, low * len(at) + np.arange(len(at)))
            joined = np.flatnonzero(best != np.iinfo(np.int64).max)
            kept.append(at[best[joined] % len(at)])
            target = np.arange(n)
            target[joined] = best[joined] // len(at)
            while (target[target] != target).any():
                target = target[target]
            label = target[label]
    return np.concatenate(kept) if kept else np.empty(0, np.int64)


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges (i, j) of a spanning forest, closest first, and the vertices of dropped pairs.

    The forest has at most n - 1 edges. What was seen so far is cut down whenever it grows, so memory stays bounded.
    The last array tells the vertices of which some pair was dropped.
    """
    held = tuple(np.empty(0, np.int64) for _ in range(3))
    waiting, size = [], 0
    dropped = np.zeros(n, bool)

    def cut():
        i, j, d = (np.concatenate([held[k], *(x[k] for x in waiting)]) for k in range(3))
        keep = kruskal(n, i, j, d)
        dropped[np.delete(i, keep)] = True
        return i[keep], j[keep], d[keep]

    for found in pairs:
        waiting.append(found)
        size += len(found[0])
        if size > 1 << 20:
            held, waiting, size = cut(), [], 0
    i, j, _ = cut()
    return i, j, dropped


def joining_pairs(
    label: np.ndarray, pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], at: np.ndarray, sets: np.ndarray, similarity: float
) -> list[tuple[int, int]]:
    """Pairs of similar rows that join classes of rows with equal ``label``, until all similar pairs are in one class.

    Row r has the sorted set ``sets[at[r] : at[r + 1]]``. Pairs come closest first within each part of ``pairs``; those whose
    rows are in one class by then, or whose sets differ too much in size, are passed over unchecked.
    """
    _, own = np.unique(label, return_inverse=True)
    above = np.arange(own.max() + 1 if len(own) else 0)
    n = np.diff(at)
    joins = []

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    for i, j, distance in pairs:
        order = np.argsort(distance, kind="stable")
        i, j = i[order], j[order]
        fits = np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9
        i, j = i[fits], j[fits]
        while len(i):
            while (above[above] != above).any():
                above = above[above]
            apart = above[own[i]] != above[own[j]]
            i, j = i[apart], j[apart]
            for a, b in zip(i[:4096].tolist(), j[:4096].tolist(), strict=True):
                x, y = top(own[a]), top(own[b])
                if x != y:
                    both = np.concatenate([sets[at[a] : at[a + 1]], sets[at[b] : at[b + 1]]])
                    both.sort(kind="stable")
                    shared = int((both[1:] == both[:-1]).sum())
                    if shared >= similarity * (len(both) - shared) - 1e-9:
                        above[max(x, y)] = min(x, y)
                        joins.append((a, b))
            i, j = i[4096:], j[4096:]
    return joins


LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
GROUP_LINK = T.StructType([T.StructField("group", T.LongType()), *LINK.fields, T.StructField("complete", T.BooleanType())])


def _by_group(groups: DataFrame, columns: list[str], solve: Callable, schema: T.StructType) -> DataFrame:
    """``solve(batch)`` for batches of whole groups, in order of ``group``; it returns an Arrow batch or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []

        def found(parts):
            whole = pa.Table.from_batches(parts).combine_chunks().to_batches() if parts else []
            assert len(whole) <= 1
            results = (solve(x) for x in whole)
            return [x for x in results if x is not None]

        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column("group").to_numpy()
            change = np.flatnonzero(group[1:] != group[:-1]) + 1
            if waiting and waiting[-1].column("group")[-1].as_py() != group[0]:
                change = np.append(0, change)
            large = sum(x.num_rows for x in waiting) + len(group) >= 1 << 13 or sum(x.nbytes for x in waiting) + batch.nbytes >= 1 << 26
            if not len(change) or not large:
                waiting.append(batch)  # at most two chunks of one block, or a small rest
                continue
            cut = int(change[-1])
            yield from found([*waiting, batch.slice(0, cut)])
            waiting = [batch.slice(cut)]
        yield from found(waiting)

    return groups.select(*columns).repartition("group").sortWithinPartitions("group").mapInArrow(run, schema)


def _columns(batch: pa.RecordBatch, word_names: list[str]) -> tuple[np.ndarray, ...]:
    """ids, labels, groups, fingerprints and first rows of the groups."""
    ids, label, group = (batch.column(n).to_numpy() for n in ("id", "label", "group"))
    words = np.stack([batch.column(n).to_numpy().view(np.uint64) for n in word_names], axis=1)
    return ids, label, group, words, np.flatnonzero(np.append(True, group[1:] != group[:-1]))


def _links(groups: DataFrame, word_names: list[str], radius: int) -> DataFrame:
    """Forest links (group, a, b, complete) between rows of a ``group`` that differ in ``label``.

    ``complete`` tells that all such pairs of the group within the radius are listed.
    """

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, label, group, words, starts = _columns(batch, word_names)
        apart = (tuple(x[label[p[0]] != label[p[1]]] for x in p) for p in close_pairs(words, starts, radius))
        i, j, dropped = forest(len(ids), apart)
        if not len(i):
            return None
        complete = ~np.logical_or.reduceat(dropped, starts)[np.searchsorted(starts, i, side="right") - 1]
        a, b = ids[i], ids[j]
        columns = (group[i], np.minimum(a, b), np.maximum(a, b), complete)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=GROUP_LINK.names)

    return _by_group(groups, ["id", "label", "group", *word_names], solve, GROUP_LINK)


def _checked_links(groups: DataFrame, word_names: list[str], radius: int, similarity: float) -> DataFrame:
    """Links (a, b) between rows of a ``group`` whose ``hashes`` are similar, as few as join their classes (``label``)."""

    def solve(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, label, _, words, starts = _columns(batch, word_names)
        lists = batch.column("hashes")
        at = lists.offsets.to_numpy().astype(np.int64)
        sets = lists.values.to_numpy().view(np.uint64)
        joins = joining_pairs(label, close_pairs(words, starts, radius), at, sets, similarity)
        if not joins:
            return None
        a, b = (ids[list(x)] for x in zip(*joins, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=LINK.names)

    return _by_group(groups, ["id", "label", "group", *word_names, "hashes"], solve, LINK)


def deal(blocks: DataFrame, chunk: int = CHUNK, weight: str | None = None, heaviest: int = CHUNK_HASHES) -> DataFrame:
    """Rows with a ``key`` become rows of ``group``: a block of up to ``chunk`` rows is one group, a larger one is
    dealt out to all pairs of its chunks, so every two rows of a block meet in some group. With a column ``weight``,
    chunks also hold about ``heaviest`` of its sum at most."""
    n_chunks = F.ceil(F.count("*") / chunk)
    if weight:
        n_chunks = F.greatest(n_chunks, F.ceil(F.sum(weight) / heaviest))
    large = blocks.groupBy("key").agg(n_chunks.cast("int").alias("n_chunks")).where("n_chunks > 1")
    own = F.pmod(F.xxhash64("id", F.lit(7)), F.col("n_chunks")).cast("int")
    dealt = blocks.join(large, "key", "left").withColumn("own", F.coalesce(own, F.lit(0)))
    other = F.explode(F.when(F.col("n_chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    dealt = dealt.withColumn("other", other)
    return dealt.withColumn("group", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))


def part_keys(fingerprint, parts: int = PARTS):
    """Keys under which two fingerprints of at most ``parts - 2`` differing bits meet: each pair of parts."""
    bounds = [64 * i // parts for i in range(parts + 1)]
    masks = [((1 << bounds[i + 1]) - 1) ^ ((1 << bounds[i]) - 1) for i in range(parts)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return F.array(*(
        F.xxhash64(F.lit(n), fingerprint.bitwiseAND(F.lit(signed(masks[i] | masks[j])).cast("long")))
        for n, (i, j) in enumerate(combinations(range(parts), 2))
    ))


def link_classes(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(id, component) for distinct longs ``id``: classes of fingerprints that links of up to ``radius`` bits connect.

    Only linked fingerprints are listed; the component is the smallest id of the class. All links
    count: ``radius`` is at most 3, which five parts cover.
    """
    if radius > PARTS - 2:
        raise ValueError("the keys cover a radius of at most 3")
    blocks = prints.select("id", F.explode(part_keys(F.col("id"))).alias("key"))
    groups = deal(blocks).withColumns({"w0": F.col("id"), "label": F.col("id")})
    links = _links(groups, ["w0"], radius).select("a", "b").distinct()
    return components.connect(materialize(links, "simhash-links"))


def simhash_classes(docs: DataFrame, radius: int = 3, size: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id that links reach, itself included).

    Rows with a null id are listed with their class; a class of null ids only has a null component.
    Repeated rows are listed as often as they occur. An empty table gives no rows.
    """
    narrow = docs.select(by_name(docs, doc_id).cast("long").alias("doc_id"), by_name(docs, text).cast("string").alias("text"))
    prints = materialize(fingerprints(narrow, size=size).select("doc_id", "fingerprint"), "simhash-prints")
    distinct = prints.groupBy(F.col("fingerprint").alias("id")).agg(F.min("doc_id").alias("first_id"))
    distinct = materialize(distinct, "simhash-distinct")
    classes = link_classes(distinct)
    placed = distinct.join(classes, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lowest = placed.groupBy("component").agg(F.min("first_id").alias("component_id"))
    placed = placed.join(lowest, "component").select(F.col("id").alias("fingerprint"), "component_id")
    placed = materialize(placed, "simhash-classes")
    return prints.join(placed, "fingerprint").select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )


# ---------------------------------------------------------------------------------------------
# Near-duplicates by similarity of shingle sets
# ---------------------------------------------------------------------------------------------

WIDE = 4  # words of 64 bits
BANDS, BAND_ROWS = 14, 3
#: Differing bits of 256 up to which a pair is checked: 38.7 expected at a similarity of 0.8, and 3.7 standard deviations.
WIDE_RADIUS = 60


def sketch(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a set of shingle hashes: a fingerprint of 256 bits (4 words), and a key for each band of minima."""
    multipliers = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
    words = np.array([majority(_mix(h * m)) for m in multipliers], np.uint64)
    seeds = _mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    minima = np.array([_mix(h ^ s).min() for s in seeds], np.uint64).reshape(BANDS, BAND_ROWS)
    keys = np.zeros(BANDS, np.uint64)
    for k in range(BAND_ROWS):
        keys = _mix(keys * np.uint64(0x165667B19E3779F9) + minima[:, k] + np.arange(BANDS, dtype=np.uint64))
    return words, keys


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def near_duplicates(
    docs: DataFrame, similarity: float = 0.8, size: int = 5, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(text_key, component_key, first_id) per distinct text: texts of one component are near-duplicates.

    ``text_key`` is the XXH64 of the text (Spark's ``xxhash64``); ``first_id`` the smallest doc_id
    with that text. Texts without words form one class. See the module's text for the method.
    """
    spark = docs.sparkSession
    narrow = docs.select(
        by_name(docs, doc_id).cast("long").alias("doc_id"), F.coalesce(by_name(docs, text).cast("string"), F.lit("")).alias("text")
    ).withColumn("text_key", F.xxhash64("text"))
    names = [f"w{k}" for k in range(WIDE)]

    def score(at, raw):
        data = raw.tobytes()
        words = np.zeros((len(at) - 1, WIDE), np.uint64)
        sizes, keys = [], []
        for r, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
            h = np.unique(hashes(shingles(data[a:b], size)))
            sizes.append(len(h))
            if len(h):
                words[r], k = sketch(h)
                keys.append(k.view(np.int64))
            else:
                keys.append([0])
        return [*(pa.array(words[:, k].view(np.int64)) for k in range(WIDE)), sizes, keys]

    kinds = [*((n, T.LongType()) for n in names), ("size", T.LongType()), ("keys", T.ArrayType(T.LongType()))]
    sketched = append_columns(narrow.select("doc_id", "text_key", "text"), "text", kinds, score).drop("text")
    prints = materialize(sketched, "near-prints")
    # Copies of a text have one key; its sketch is taken once.
    firsts = prints.groupBy("text_key").agg(F.min("doc_id").alias("first_id"), *(F.first(n).alias(n) for n in [*names, "size"]))
    firsts = materialize(firsts, "near-texts")
    blocks = prints.select(F.col("text_key").alias("id"), F.explode("keys").alias("key")).distinct()
    groups = deal(blocks).select("id", "group").join(firsts.select(F.col("text_key").alias("id"), *names), "id")
    found = materialize(_links(groups.withColumn("label", F.col("id")), names, WIDE_RADIUS), "near-links")
    links = materialize(_similar(found.select("a", "b").distinct(), narrow, similarity, size), "near-checked")
    classes = materialize(components.connect(links), "near-classes")
    opened = materialize(_undecided(found, classes), "near-opened")
    if not opened.isEmpty():
        rest = materialize(groups.join(opened, "group", "left_semi").withColumnRenamed("group", "key"), "near-open-blocks")
        sets = materialize(_hash_sets(rest.select("id").distinct(), narrow, size), "near-sets")
        dealt = deal(rest.join(firsts.select(F.col("text_key").alias("id"), "size"), "id"), weight="size")
        dealt = dealt.select("id", "group", *names).join(classes, "id", "left").withColumn("label", F.coalesce("component", "id"))
        joined = materialize(_checked_links(dealt.join(sets, "id"), names, WIDE_RADIUS, similarity), "near-joined")
        # Classes so far go on as stars.
        classes = materialize(components.connect(joined.union(classes.select("id", "component"))), "near-classes")
    classes = classes.withColumnRenamed("id", "text_key")
    placed = firsts.select("text_key", "first_id").join(classes, "text_key", "left")
    return placed.withColumn("component", F.coalesce("component", "text_key"))


def _hash_sets(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """(id, hashes) for the wanted texts: the sorted set of their shingle hashes."""

    def score(at, raw):
        data = raw.tobytes()
        return [[np.unique(hashes(shingles(data[a:b], size))).view(np.int64) for a, b in zip(at[:-1], at[1:], strict=True)]]

    texts = docs.withColumnRenamed("text_key", "id").join(ids, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    return append_columns(texts, "text", [("hashes", T.ArrayType(T.LongType()))], score).select("id", "hashes")


def _undecided(found: DataFrame, classes: DataFrame) -> DataFrame:
    """Groups that left pairs out and of which a listed pair joins two classes."""
    left_out = found.where(~F.col("complete")).select("group", "a", "b")
    for end in ("a", "b"):
        own = classes.select(F.col("id").alias(end), F.col("component").alias(f"{end}_class"))
        left_out = left_out.join(own, end, "left")
    apart = F.coalesce("a_class", "a") != F.coalesce("b_class", "b")
    return left_out.where(apart).select("group").distinct()


def _similar(links: DataFrame, docs: DataFrame, similarity: float, size: int) -> DataFrame:
    """The links whose texts have a Jaccard similarity of shingle sets of at least the bound."""
    wanted = links.select(F.explode(F.array("a", "b")).alias("text_key")).distinct()
    texts = docs.join(wanted, "text_key", "left_semi").groupBy("text_key").agg(F.min("text").alias("text"))
    texts = materialize(texts, "near-checked-texts")
    left = links.join(texts.select(F.col("text_key").alias("a"), F.col("text").alias("text_a")), "a")
    both = left.join(texts.select(F.col("text_key").alias("b"), F.col("text").alias("text_b")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            (at_a, raw_a), (at_b, raw_b) = utf8(batch.column(2)), utf8(batch.column(3))
            for r in range(batch.num_rows):
                x = set(shingles(raw_a[at_a[r] : at_a[r + 1]].tobytes(), size))
                y = set(shingles(raw_b[at_b[r] : at_b[r + 1]].tobytes(), size))
                shared = len(x & y)
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            kept = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, LINK)
