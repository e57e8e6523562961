"""Cross-tokenizer alignment: which tokens of two vocabularies overlap in the bytes of the same texts.

Both tokenizers encode a space followed by the text. Per batch ``pandas.merge_asof``, keyed by document and byte, finds for every
token's first byte the covering token of the other side, in both directions; the union of both gives each overlapping pair of
token occurrences (a link) once, and equal ends cut the tokens into groups.

A text can be cut before a space that follows another character and precedes a character that isn't white space: neither
tokenizer has a token across such a place (checked for the piece vocabulary when it is loaded). Equal parts are
encoded once per block; all tokens of all texts then go through the join.

A first pass writes one row per document with its links, as one binary of pair codes. The codes are counted
corpus-wide by partial counts per task and a shuffle. The pairs that occur most, at most ``HOT_PAIRS`` of them (chosen by a threshold on the
count, so their number is proven), travel to the tasks that add up every document's links; what is left of a document's links
meets the table of all pairs in a join, in which no key is frequent any more.

Null and empty texts, and texts whose tokens' joined bytes aren't the space and the text, have no tokens: zeros and an empty
digest. Every row gives a row, repeated rows and null ids too. A text's links must fit an Arrow binary (2 GB).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import blocks, by_name, spans, utf8
from auditlake.llm.packing import Encoder, vocabulary_path
from auditlake.session import materialize

#: Pairs whose counts travel to every task: 17 bytes each.
HOT_PAIRS = 1 << 18
#: Bytes of text that are joined together.
ALIGN_BLOCK = 1 << 20
#: Pair codes that a task holds before it hands on their counts.
HELD_CODES = 1 << 21
#: Distinct parts of texts whose tokens a task remembers.
HELD_PARTS = 1 << 18

DOC = T.StructType([
    T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")),
    T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.BinaryType()),
])


class Side:
    """Token ids of parts, and the bytes of every id."""

    def __init__(self, table: list[bytes]):
        self.table = table
        self.sizes = np.array([len(t) for t in table], np.int64)


class ByteSide(Side):
    """Byte-level BPE; strings of added tokens are plain text."""

    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.encoder.added, self.encoder.marks = {}, None
        table = [b""] * len(self.encoder.sizes)
        for token, rank in self.encoder.encoding._mergeable_ranks.items():
            table[rank] = token
        super().__init__(table)

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        cut, ids = self.encoder.encode(at, np.frombuffer(b"".join(parts), np.uint8))
        return np.diff(cut), ids.astype(np.int64)


class PieceSide(Side):
    """Pieces of a model with byte fallback that puts a space before every text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in n.lstrip("▁") for n in names):
            raise ValueError("a piece holds a space inside: texts cannot be cut at words")
        super().__init__([
            bytes([int(n[3:-1], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)
        ])

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = self.model.encode([p[1:].decode("utf-8") for p in parts], num_threads=1)
        counts = np.array([len(x) for x in got], np.int64)
        return counts, np.fromiter((i for x in got for i in x), np.int64, int(counts.sum()))


class Parts:
    """Texts of a block as sequences of distinct parts, each of which begins with a space."""

    def __init__(self):
        random = np.random.default_rng(12)
        self.letters = random.integers(0, 2**64, 256, np.uint64)
        self.blank = np.zeros(256, bool)
        # Bytes that may begin white space: no cut before them.
        self.blank[[*range(0x09, 0x0E), *range(0x1C, 0x21), 0xC2, 0xE1, 0xE2, 0xE3]] = True

    def split(self, at: np.ndarray, raw: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """(distinct parts, part number of every occurrence, occurrences before every text) of non-empty texts."""
        head = np.zeros(len(raw), bool)
        space = np.flatnonzero(raw[1:-1] == 0x20) + 1
        head[space[~self.blank[raw[space + 1]] & (raw[space - 1] != 0x20)]] = True
        head[at[:-1]] = True
        starts = np.flatnonzero(head)
        lengths = np.diff(np.append(starts, len(raw)))
        inside = np.arange(len(raw)) - np.repeat(starts, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
        code = np.add.reduceat(self.letters[raw] * powers[inside], starts)
        _, first, same = np.unique(code, return_index=True, return_inverse=True)
        agree = (lengths[first[same]] == lengths).all()
        data = raw.tobytes()
        if not agree or (raw[np.repeat(starts[first[same]], lengths) + inside] != raw).any():
            every = [data[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]  # two parts share a hash
            number = {p: i for i, p in enumerate(dict.fromkeys(every))}
            return list(number), np.array([number[p] for p in every], np.int64), np.searchsorted(starts, at)
        parts = [data[a : a + n] for a, n in zip(starts[first].tolist(), lengths[first].tolist(), strict=True)]
        return parts, same, np.searchsorted(starts, at)


class Lexicon:
    """Both tokenizations of every part met so far; it starts anew when it holds ``HELD_PARTS`` parts."""

    def __init__(self, left: Side, right: Side):
        self.sides = left, right
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.many = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.flat = [np.empty(0, np.int64), np.empty(0, np.int64)]
        self.sound = np.empty(0, bool)

    def look_up(self, parts: list[bytes]) -> np.ndarray:
        """The number of every part, parts being distinct. Numbers hold until the next call."""
        if len(self.number) >= HELD_PARTS:
            self.clear()
        found = [self.number.get(p, -1) for p in parts]
        numbers = np.array(found, np.int64)
        if new := [p for p, k in zip(parts, found, strict=True) if k < 0]:
            numbers[numbers < 0] = np.arange(len(self.number), len(self.number) + len(new))
            self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
            sound = np.ones(len(new), bool)
            for k, side in enumerate(self.sides):
                many, flat = side.encode(new)
                ends, ids = np.cumsum(many).tolist(), flat.tolist()
                sound &= np.array([b"".join([side.table[i] for i in ids[a:z]]) == p for p, a, z in zip(new, [0, *ends], ends)], bool)
                self.many[k] = np.concatenate([self.many[k], many])
                self.flat[k] = np.concatenate([self.flat[k], flat])
            self.sound = np.concatenate([self.sound, sound])
        return numbers


def covering(own: pd.DataFrame, other: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For every token of ``own`` the token of ``other`` that covers its first byte, and whether both begin there."""
    met = pd.merge_asof(own, other.assign(place=np.arange(len(other)), begin=other["key"]), on="key")
    return met["place"].to_numpy(), (met["begin"] == met["key"]).to_numpy()


def align(doc_a, size_a, doc_b, size_b, n_docs: int):
    """Links and common ends of two tokenizations of the same bytes, given the text and length of every token.

    Tokens are joined on one key of document and byte: the byte's place in the batch, where each document has a stretch of its own.
    Returns (place in A, place in B) of all links, ordered by text, the number of links per text, and per token whether it ends
    a group, for both sides.
    """
    a = pd.DataFrame({"key": np.cumsum(size_a) - size_a})
    b = pd.DataFrame({"key": np.cumsum(size_b) - size_b})
    over_a, even_a = covering(a, b)
    over_b, even_b = covering(b, a)
    inner = np.flatnonzero(~even_b)  # equal starts are in the first direction already
    text = np.concatenate([doc_a, doc_b[inner]])
    order = np.argsort(text, kind="stable")
    x = np.concatenate([np.arange(len(doc_a)), over_b[inner]])[order]
    y = np.concatenate([over_a, inner])[order]
    # A token ends a group if both sides begin a token after it, or nothing follows.
    return x, y, np.bincount(text, minlength=n_docs), np.append(even_a[1:], True), np.append(even_b[1:], True)


def decimal_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to n - 1, left-aligned with room for one more byte, and their number."""
    width = len(str(max(n - 1, 0)))
    digits = np.zeros((n, width + 1), np.uint8)
    size = np.ones(n, np.int64)
    for k in range(1, width):
        size += np.arange(n) >= 10**k
    for k in range(width):
        place = size - 1 - k
        use = place >= 0
        digits[np.arange(n)[use], place[use]] = np.arange(n)[use] // 10**k % 10 + ord("0")
    return digits, size


def spell_groups(ids_a, cut_a, ids_b, cut_b, last_b, digits, size) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ``a1,a2|b1;a3|b2,b3`` over all texts, and where each B token of ``last_b`` (the texts' last) ends in them."""
    group_a, group_b = np.cumsum(cut_a) - cut_a, np.cumsum(cut_b) - cut_b
    spot_a = np.arange(len(ids_a)) + np.searchsorted(group_b, group_a, "left")
    spot_b = np.arange(len(ids_b)) + np.searchsorted(group_a, group_b, "right")
    ids = np.empty(len(ids_a) + len(ids_b), np.int64)
    mark = np.empty(len(ids), np.uint8)
    ids[spot_a], ids[spot_b] = ids_a, ids_b
    mark[spot_a] = np.where(cut_a, ord("|"), ord(","))
    mark[spot_b] = np.where(cut_b, ord(";"), ord(","))
    long = size[ids]
    cells = digits[ids]
    cells[np.arange(len(ids)), long] = mark
    keep = np.arange(cells.shape[1]) <= long[:, None]
    keep[spot_b[last_b], long[spot_b[last_b]]] = False
    ends = np.cumsum(keep.sum(axis=1))
    return cells[keep], ends[spot_b[last_b]]


def pair_code(n_a: int, n_b: int) -> np.dtype:
    return np.dtype("<u4") if n_a * n_b <= 1 << 32 else np.dtype("<u8")


def aligned(docs: DataFrame, path_a: str, path_b: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts, digest of the groups, and the links as pair codes (id in A times the size of B, plus id in B)."""
    narrow = docs.select(by_name(docs, doc_id).cast("long").alias("doc_id"), by_name(docs, text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = None
        for whole in batches:
            for batch in blocks(whole, "text", ALIGN_BLOCK):
                if tools is None:
                    left, right = ByteSide(path_a), PieceSide(path_b)
                    tools = Lexicon(left, right), Parts(), *decimal_table(max(len(left.table), len(right.table)))
                yield align_batch(batch, *tools)

    return narrow.mapInArrow(run, DOC)


def align_batch(batch: pa.RecordBatch, lexicon: Lexicon, parts: Parts, digits, size) -> pa.RecordBatch:
    n = batch.num_rows
    left, right = lexicon.sides
    at, raw = utf8(batch.column(1))
    given = np.flatnonzero(at[1:] > at[:-1])
    counts = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")}
    digest, codes = [""] * n, np.empty(0, pair_code(len(left.table), len(right.table)))
    if len(given):
        spaced = np.insert(raw, at[given], 0x20)
        begin = np.concatenate([at[given], [len(raw)]]) + np.arange(len(given) + 1)
        distinct, part, before = parts.split(begin, spaced)
        text_of = np.repeat(np.arange(len(given)), np.diff(before))
        part = lexicon.look_up(distinct)[part]
        (many_a, many_b), (flat_a, flat_b) = lexicon.many, lexicon.flat
        from_a, from_b = np.cumsum(many_a) - many_a, np.cumsum(many_b) - many_b
        good = np.ones(len(given), bool)
        good[text_of[~lexicon.sound[part]]] = False
        here = good[text_of]
        part, text_of = part[here], text_of[here]
        if len(part):
            ids_a, ids_b = flat_a[spans(from_a[part], many_a[part])], flat_b[spans(from_b[part], many_b[part])]
            doc_a, doc_b = np.repeat(text_of, many_a[part]), np.repeat(text_of, many_b[part])
            x, y, links, cut_a, cut_b = align(doc_a, left.sizes[ids_a], doc_b, right.sizes[ids_b], len(given))
            codes = (ids_a[x] * len(right.table) + ids_b[y]).astype(codes.dtype)
            counts["n_a"][given] = np.bincount(doc_a, minlength=len(given))
            counts["n_b"][given] = np.bincount(doc_b, minlength=len(given))
            counts["n_groups"][given] = np.bincount(doc_a[cut_a], minlength=len(given))
            counts["n_links"][given] = links
            last = np.flatnonzero(np.append(doc_b[1:] != doc_b[:-1], True))
            spelt, ends = spell_groups(ids_a, cut_a, ids_b, cut_b, last, digits, size)
            data = memoryview(spelt.tobytes())
            for k, lo, hi in zip(doc_b[last].tolist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                digest[given[k]] = hashlib.sha256(data[lo:hi]).hexdigest()
    offsets = np.concatenate([[0], np.cumsum(counts["n_links"])]) * codes.itemsize
    links = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(codes)])
    columns = [batch.column(0), *(pa.array(counts[k]) for k in ("n_a", "n_b", "n_groups", "n_links")), pa.array(digest), links.cast(pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=DOC.names)


def count_pairs(links: DataFrame, dtype: np.dtype) -> DataFrame:
    """(code, n) of all links: partial counts per task, then their sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, raw, size = (np.empty(0, np.int64), np.empty(0, np.int64)), [], 0

        def fold() -> tuple[np.ndarray, np.ndarray]:
            """What is held and the raw codes as one sorted list of codes with counts."""
            kinds, n = np.unique(np.concatenate(raw), return_counts=True)
            code, n = np.concatenate([held[0], kinds.astype(np.int64)]), np.concatenate([held[1], n])
            order = np.argsort(code, kind="stable")  # two sorted runs: merged
            code, n = code[order], n[order]
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            return code[first], np.add.reduceat(n, first)

        for batch in batches:
            for cell in batch.column(0):
                codes = np.frombuffer(cell.as_buffer(), dtype)
                raw.append(codes)
                size += len(codes)
                if size >= HELD_CODES:
                    held, raw, size = fold(), [], 0
                    if len(held[0]) >= HELD_CODES:
                        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["code", "n"])
                        held = (np.empty(0, np.int64), np.empty(0, np.int64))
        if size:
            held = fold()
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["code", "n"])

    return links.select("links").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def hot_threshold(pairs: DataFrame, most: int) -> int:
    """The least count from which on at most ``most`` pairs are left; counts are grouped by eighths of a power of two."""
    step = F.floor(8 * F.log2("n")).cast("int")
    rows = pairs.groupBy(step.alias("step")).agg(F.count("*").alias("pairs"), F.min("n").alias("least")).collect()  # some hundred rows
    total, least = 0, max((r["least"] for r in rows), default=0) + (1 << 62)
    for r in sorted(rows, key=lambda r: -r["step"]):
        total += r["pairs"]
        if total > most:
            break
        least = r["least"]
    return least


def add_counts(rows: DataFrame, pairs: DataFrame, dtype: np.dtype, hot_pairs: int) -> DataFrame:
    """Rows (row, links, ...) with ``n_best`` and ``count_sum`` in place of the links; ``pairs`` holds (code, n, best)."""
    least = hot_threshold(pairs, hot_pairs)
    hot = pairs.where(F.col("n") >= least).orderBy("code").toArrow()  # at most hot_pairs rows
    code, n, best = (hot.column(c).to_numpy() for c in ("code", "n", "best"))
    best = best.astype(np.int64)
    narrow = [f for f in rows.schema.fields if f.name != "links"]
    cold = T.ArrayType(T.StructType([T.StructField("code", T.LongType()), T.StructField("times", T.LongType())]))
    schema = T.StructType([*narrow, T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType()), T.StructField("cold", cold)])
    place = [f.name for f in rows.schema.fields].index("links")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops, sums, rest = [], [], []
            for cell in batch.column(place):
                kinds, times = np.unique(np.frombuffer(cell.as_buffer(), dtype), return_counts=True)
                kinds = kinds.astype(np.int64)
                spot = np.minimum(np.searchsorted(code, kinds), max(len(code) - 1, 0))
                known = code[spot] == kinds if len(code) else np.zeros(len(kinds), bool)
                tops.append(int((best[spot[known]] * times[known]).sum()))
                sums.append(int((n[spot[known]] * times[known]).sum()))
                rest.append([{"code": c, "times": t} for c, t in zip(kinds[~known].tolist(), times[~known].tolist(), strict=True)])
            columns = [c for i, c in enumerate(batch.columns) if i != place]
            kind = pa.list_(pa.struct([("code", pa.int64()), ("times", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tops, pa.int64()), pa.array(sums, pa.int64()), pa.array(rest, kind)], names=schema.names)

    met = materialize(rows.mapInArrow(run, schema), "alignment-sums")
    left = met.where(F.size("cold") > 0).select("row", F.explode("cold").alias("c")).select("row", "c.code", "c.times")
    late = left.join(pairs, "code").groupBy("row").agg(
        F.sum(F.col("best").cast("long") * F.col("times")).alias("late_best"), F.sum(F.col("n") * F.col("times")).alias("late_sum"))
    out = met.drop("cold").join(late, "row", "left")
    return out.select(
        *(f.name for f in narrow if f.name != "row"),
        (F.col("n_best") + F.coalesce("late_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("late_sum", F.lit(0))).alias("count_sum"),
    )


def pair_table(counted: DataFrame, n_b: int) -> DataFrame:
    """(code, n, best): every pair with its corpus-wide count and whether no pair of its id in B has a higher one."""
    top = counted.groupBy((F.col("code") % n_b).alias("b")).agg(F.max("n").alias("top"))
    return counted.withColumn("b", F.col("code") % n_b).join(top, "b").select("code", "n", (F.col("n") == F.col("top")).alias("best"))


def align_documents(
    docs: DataFrame, path_a: str | None = None, path_b: str | None = None, hot_pairs: int = HOT_PAIRS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: tokens of both sides, groups, links, how many links are their B id's best, and the sum of the links' counts."""
    path_a, path_b = path_a or vocabulary_path(), path_b or vocabulary_path("piece_bpe_32k.model")
    n_a, n_b = len(ByteSide(path_a).table), len(PieceSide(path_b).table)
    dtype = pair_code(n_a, n_b)
    rows = materialize(aligned(docs, path_a, path_b, doc_id, text).select(F.monotonically_increasing_id().alias("row"), *DOC.names), "alignment-links", compression="zstd")
    counted = materialize(count_pairs(rows, dtype), "alignment-pairs")
    pairs = materialize(pair_table(counted, n_b), "alignment-best")
    return add_counts(rows, pairs, dtype, hot_pairs)
