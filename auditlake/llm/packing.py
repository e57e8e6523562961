"""Packing: documents into sequences of a fixed number of tokens by cutting-stock column generation.

Every document's ids are cut into full sequences and a rest. Only the rests need packing; their
lengths make a histogram of a bounded number of classes (lengths rounded up to a step), which
alone reaches the driver. Over this histogram a linear program chooses how often to use each pattern, a
multiset of classes that fits a sequence. Columns are generated: dual prices of the
restricted program price new patterns in an unbounded knapsack solved by dynamic programming, until none
is worth more than a sequence. The solution is rounded down, what is left over is packed first-fit
decreasing, and the resulting list of (pattern, times) is assigned to the rests by their rank
within the class, which is computed from counts per bucket: no class is ever sorted in one task.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from auditlake.llm.common import SMALL_BATCHES, blocks, by_name, spans, utf8
from auditlake.session import materialize, settings

LENGTH = 2048
STEP = 16
END = 1
#: Rows per rank bucket, about.
BUCKET_ROWS = 4096
#: Bytes of text tokenised together: words that repeat within are tokenised once.
TOKEN_BLOCK = 1 << 22

PIECE = T.StructType([
    T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")
])


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Byte-level BPE over blocks of texts; gives the ids that the vocabulary's own tokenizer gives per text.

    A space before a character other than white space always begins a pre-token, so a text can be cut there and
    its parts encoded on their own. Equal parts of a block are found by hash (and compared byte by
    byte), and each is encoded once.

    Parts are encoded by tiktoken. Added tokens that a text spells, by the tokenizer's file of the same name (.json),
    are cut out first and have their own ids, as in that tokenizer.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        own = Path(path).with_suffix(".json")
        added = json.loads(own.read_text("utf-8")).get("added_tokens", []) if own.exists() else []
        if any(t.get(f) for t in added for f in ("lstrip", "rstrip", "single_word")) or any(t["content"][:1] == " " for t in added):
            raise ValueError("added tokens that take in or need their surroundings are not handled")
        self.added = {t["content"].encode(): t["id"] for t in added}
        longest = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile(b"|".join(map(re.escape, longest))) if longest else None
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)
        random = np.random.default_rng(20)
        self.letters = random.integers(0, 2**64, 256, np.uint64)
        # Bytes that may begin white space, in ASCII or beyond: no cut before them.
        self.blank = np.zeros(256, bool)
        self.blank[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True

    def encode(self, at: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offsets into the ids of every text, all ids) of texts given by offsets and UTF-8 bytes."""
        if not len(raw):
            return np.zeros(len(at), np.int64), np.empty(0, np.uint32)
        space = np.flatnonzero(raw[:-1] == 0x20)
        space = space[~self.blank[raw[space + 1]]]
        head = np.zeros(len(raw), bool)
        head[space] = True
        heads = at[:-1][at[:-1] < at[1:]]
        marks = self._marks(at, raw)
        for a, z in marks:
            # What precedes an added token ends there as at the end of a text: no cut before a last space.
            head[max(a - 1, 0) : z] = False
        for a, z in marks:
            head[a] = True
            head[z : z + 1] = True
        head[heads] = True
        starts = np.flatnonzero(head)
        lengths = np.diff(np.append(starts, len(raw)))
        inside = np.arange(len(raw)) - np.repeat(starts, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
        code = np.add.reduceat(self.letters[raw] * powers[inside], starts)
        _, first, same = np.unique(code, return_index=True, return_inverse=True)
        agree = (lengths[first[same]] == lengths).all()
        if not agree or (raw[np.repeat(starts[first[same]], lengths) + inside] != raw).any():
            first = same = np.arange(len(starts))  # two parts share a hash: encode all of them
        counts, ids = self._parts(raw, starts[first], lengths[first])
        begin = np.cumsum(counts) - counts
        per_part = counts[same]
        flat = ids[spans(begin[same], per_part)]
        total = np.concatenate([[0], np.cumsum(per_part)])
        return total[np.searchsorted(starts, at)], flat

    def _marks(self, at, raw) -> list[tuple[int, int]]:
        """Where the texts spell added tokens."""
        if self.marks is None:
            return []
        data = raw.tobytes()
        return [m.span() for a, z in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for m in self.marks.finditer(data, a, z)]

    def _parts(self, raw, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of every part, and the ids. Parts that begin with the space before a word are encoded in one go."""
        follows = (raw[starts] == 0x20) & (lengths > 1)
        follows &= ~self.blank[raw[np.minimum(starts + 1, len(raw) - 1)]]
        counts = np.zeros(len(starts), np.int64)
        size = lengths[follows]
        joined = raw[spans(starts[follows], size)].tobytes().decode("utf-8")
        ids = self._ids(joined)
        ends = np.cumsum(self.sizes[ids])
        cut = np.searchsorted(ends, np.cumsum(size), side="right")
        counts[follows] = np.diff(np.concatenate([[0], cut]))
        rest = []
        others = np.flatnonzero(~follows)
        for k in others:
            part = raw[starts[k] : starts[k] + lengths[k]].tobytes()
            own = np.array([self.added[part]], np.uint32) if part in self.added else self._ids(part.decode("utf-8"))
            counts[k] = len(own)
            rest.append(own)
        if not rest:
            return counts, ids
        out = np.empty(int(counts.sum()), np.uint32)
        begin = np.cumsum(counts) - counts
        out[spans(begin[follows], counts[follows])] = ids
        out[spans(begin[others], counts[others])] = np.concatenate(rest)
        return counts, out

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.uint32)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: full sequences first, then the rest of the document. Null texts are empty and give one id."""
    narrow = docs.select(by_name(docs, doc_id).cast("long").alias("doc_id"), by_name(docs, text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for whole in batches:
            for batch in blocks(whole, "text", TOKEN_BLOCK):
                encoder = encoder or Encoder(path)
                at, ids = encoder.encode(*utf8(batch.column(1)))
                row, start, size, crc, total = [], [], [], [], []
                for r in range(batch.num_rows):
                    own = np.append(ids[at[r] : at[r + 1]], np.uint32(END)).astype("<u4")
                    for s in range(0, len(own), length):
                        part = own[s : s + length]
                        row.append(r)
                        start.append(s)
                        size.append(len(part))
                        crc.append(zlib.crc32(part.tobytes()))
                        total.append(len(own))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total))],
                    names=PIECE.names,
                )

    return narrow.mapInArrow(run, PIECE)


# ---------------------------------------------------------------------------------------------
# The linear program over the histogram
# ---------------------------------------------------------------------------------------------


def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes that fits ``room`` units: unbounded knapsack by dynamic programming."""
    value, choice = np.zeros(room + 1), np.full(room + 1, -1)
    use = np.flatnonzero(prices > 1e-12)
    size, price = sizes[use], prices[use]
    for r in range(1, room + 1):
        fit = np.searchsorted(size, r, side="right")
        value[r], choice[r] = value[r - 1], -1
        if fit:
            offers = value[r - size[:fit]] + price[:fit]
            k = int(offers.argmax())
            if offers[k] > value[r] + 1e-12:
                value[r], choice[r] = offers[k], k
    counts, r = np.zeros(len(prices), np.int64), room
    while r > 0:
        if choice[r] < 0:
            r -= 1
        else:
            counts[use[choice[r]]] += 1
            r -= int(size[choice[r]])
    return float(value[room]), counts


def plan_patterns(demand: np.ndarray, sizes: np.ndarray, room: int, most_columns: int = 1500) -> list[tuple[np.ndarray, int]]:
    """(pattern, times) that hold exactly the demanded number of pieces of every class.

    ``sizes`` ascend, in units; ``demand`` is positive. The restricted program is solved by the revised simplex
    method, which always holds as many patterns as classes; columns enter by the knapsack's price.
    """
    n = len(sizes)
    if not n:
        return []
    many = np.maximum(room // sizes, 1).astype(float)
    basis, inverse = np.diag(many), np.diag(1 / many)
    amount = demand / many
    for _ in range(most_columns):
        prices = inverse.sum(axis=0)  # every pattern costs one sequence
        worth, pattern = best_pattern(prices, sizes, room)
        if worth <= 1.002:  # the optimum is at least this fraction of the present number of sequences
            break
        column = (inverse * pattern).sum(axis=1)  # sums of products: a few hundred classes need no BLAS
        ratio = np.where(column > 1e-10, amount / np.where(column > 1e-10, column, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        basis[:, leave] = pattern
        pivot = inverse[leave] / column[leave]
        inverse -= column[:, None] * pivot
        inverse[leave] = pivot
        amount = np.maximum((inverse * demand).sum(axis=1), 0)
    plan, left = [], demand.astype(np.int64).copy()
    for k in np.argsort(-amount, kind="stable"):
        pattern = basis[:, k].astype(np.int64)
        used = pattern > 0
        tight = int((pattern * sizes).sum()) >= room - room // 64
        times = min(int(amount[k] + 1e-6), int((left[used] // pattern[used]).min())) if tight else 0
        if times > 0:
            plan.append((pattern, times))
            left -= pattern * times
    rounded = plan + first_fit(left, sizes, room)
    plain = first_fit(demand.astype(np.int64), sizes, room)  # better only for very few pieces
    return min(rounded, plain, key=lambda p: sum(times for _, times in p))


def first_fit(left: np.ndarray, sizes: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns of first fit decreasing for what rounding left over; equal sequences are made together."""
    left, plan = left.copy(), []
    while left.any():
        pattern, free = np.zeros(len(sizes), np.int64), room
        for c in np.flatnonzero(left)[::-1]:
            take = min(int(left[c]), free // int(sizes[c]))
            pattern[c] = take
            free -= take * int(sizes[c])
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((pattern, times))
        left -= pattern * times
    return plan


def slots(plan: list[tuple[np.ndarray, int]], classes: np.ndarray, first_sequence: int) -> list[tuple]:
    """Per class and pattern: the ranks that go to it. (class, from rank, to rank, pieces of the class in the
    pattern, first sequence, slot before it)"""
    rank = np.zeros(len(classes), np.int64)
    out, sequence = [], first_sequence
    for pattern, times in plan:
        before = 0
        for c in np.flatnonzero(pattern):
            many = int(pattern[c])
            out.append((int(classes[c]), int(rank[c]), int(rank[c]) + many * times, many, sequence, before))
            rank[c] += many * times
            before += many
        sequence += times
    return out


def pack(
    docs: DataFrame, path: str | None = None, length: int = LENGTH, step: int = STEP, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Pieces with their sequence and offset: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts make one piece of one id. Repeated rows and null ids are packed like any others. An
    empty table gives no rows. ``length`` must be a multiple of ``step``.
    """
    spark = docs.sparkSession
    with settings(docs.sparkSession, SMALL_BATCHES):
        cut = materialize(pieces(docs, path or vocabulary_path(), length, doc_id, text), "pack-pieces")
    rests = cut.where(F.col("length") < length).withColumn("class", F.ceil(F.col("length") / step).cast("int"))
    histogram = rests.groupBy("class").count().orderBy("class").collect()  # at most length / step rows
    classes = np.array([r[0] for r in histogram], np.int64)
    plan = plan_patterns(np.array([r[1] for r in histogram], np.int64), classes, length // step)
    n_rests = sum(r[1] for r in histogram)
    n_buckets = max(1, n_rests // BUCKET_ROWS)
    # Rank within the class: pieces in earlier buckets, then the place within the bucket.
    bucketed = rests.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_buckets)))
    earlier = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = bucketed.groupBy("class", "bucket").count()
    before = before.select("class", "bucket", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = bucketed.withColumn("place", F.row_number().over(within)).join(before, ["class", "bucket"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("place") - 1)
    # Lookup by class and rank: one list of slots per class, bounded by classes x patterns whatever the input.
    by_class: dict[int, list] = {}
    for c, *rest in slots(plan, classes, 0):
        by_class.setdefault(c, []).append(tuple(rest))
    kind = "class int, slots array<struct<lo: long, hi: long, many: long, first: long, slot: long>>"
    lookup = spark.createDataFrame(sorted(by_class.items()), kind)
    placed = ranked.join(F.broadcast(lookup), "class").withColumn(
        "s", F.filter("slots", lambda s: (s["lo"] <= F.col("rank")) & (F.col("rank") < s["hi"]))[0]
    )
    turn = F.col("rank") - F.col("s.lo")
    placed = placed.select(
        *PIECE.names,
        (F.col("s.first") + F.expr("(rank - s.lo) div s.many")).alias("sequence_id"),
        (F.col("s.slot") + turn % F.col("s.many")).alias("slot"),
    )
    row = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(row), F.lit(0))).drop("slot")
    n_packed = sum(times for _, times in plan)
    full = cut.where(F.col("length") == length)
    return placed.select(*PIECE.names, "sequence_id", "offset").unionByName(numbered(full, n_packed).withColumn("offset", F.lit(0).cast("long")))


def numbered(full: DataFrame, first: int) -> DataFrame:
    """Full sequences numbered from ``first``: counts per bucket, then the place within the bucket."""
    n_buckets = max(1, full.count() // BUCKET_ROWS)
    bucketed = full.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(n_buckets)))
    counts = bucketed.groupBy("bucket").count()
    # Two levels, so that no task adds up all buckets of a large table.
    counts = counts.withColumn("part", F.expr("bucket div 4096"))
    parts = counts.groupBy("part").agg(F.sum("count").alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per 16 million pieces
    parts = parts.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before_part"))
    inner = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("inside", F.coalesce(F.sum("count").over(inner), F.lit(0))).join(parts, "part")
    before = counts.select("bucket", (F.col("inside") + F.col("before_part")).alias("before"))
    within = Window.partitionBy("bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = bucketed.withColumn("place", F.row_number().over(within)).join(before, "bucket")
    return ranked.select(*PIECE.names, (F.col("before") + F.col("place") - 1 + F.lit(first)).cast("long").alias("sequence_id"))
