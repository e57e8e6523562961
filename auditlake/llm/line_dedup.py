"""Line dedup by a deletion-neighbourhood join: exact copies of lines, and lines one word apart.

Lines are compared as sequences of words (A-Z lower-cased, ASCII white space). Of equal lines the earliest stays: the smallest
(document id, hash of the text, line number). Lines of at least ``near_words`` words that differ from an earlier line by one edit
(a word inserted, deleted or replaced) go as well.

Two lines are one edit apart if and only if they share a variant: a line with one word deleted at the same place, or a line
and a longer one with one word deleted. Every line emits its variants as hashed keys; per key and
place of deletion only the earliest line is kept, which partial aggregation does before the shuffle. Every line
joins the earliest line it shares a key with, and the edit distance of such a pair is verified on the words. A key with any
number of lines gives one row per line, never pairs of all.

Variants are as many as the words of the corpus, so lines that cannot have a near copy emit none. Two lines one edit apart share the words
before the middle or those after it. Lines that share neither half with another line are left out first; nothing is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import SMALL_BATCHES, blocks, by_name, free_name, utf8
from auditlake.session import materialize, settings

MIN_WORDS = 4
NEAR_WORDS = 8
#: Order of occurrences: the earliest is the smallest.
_ORDER = ("no_id", "doc_id", "k", "line_no")


def _hash(words: list[bytes], tag: bytes = b"") -> int:
    h = xxhash.xxh64_intdigest(b" ".join(words) + tag)
    return h - (1 << 64) if h >> 63 else h


def half_keys(words: list[bytes]) -> tuple[list[int], list[int]]:
    """Keys of the first and of the last half, for lines as long and for lines one word shorter (tag: the shorter length)."""
    n = len(words)
    first, last = [], []
    for tag in (n, n - 1):
        h, mark = tag // 2, b"\n%d" % tag
        first.append(_hash(words[:h], mark + b"<"))
        last.append(_hash(words[n - (tag - h) :] if tag > h else [], mark + b">"))
    return first, last


def line_rows(docs: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """One row per line of at least ``min_words`` words: its document, number, hash, and keys of its halves (null if short)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                at, raw = utf8(batch.column(2))
                data = raw.tobytes()
                row, number, size, code, keys = [], [], [], [], []
                for r in range(batch.num_rows):
                    for k, line in enumerate(data[at[r] : at[r + 1]].split(b"\n")):
                        words = line.lower().split()
                        if len(words) < min_words:
                            continue
                        row.append(r)
                        number.append(k)
                        size.append(len(words))
                        code.append(_hash(words))
                        if len(words) >= near_words:
                            first, last = half_keys(words)
                            keys.append((*first, *last))
                        else:
                            keys.append((None,) * 4)
                taken = pa.array(row, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(taken), batch.column(1).take(taken), pa.array(number, pa.int32()), pa.array(size, pa.int32()),
                     pa.array(code, pa.int64()), *(pa.array([x[i] for x in keys], pa.int64()) for i in range(4))],
                    names=["doc_id", "k", "line_no", "n_words", "h", "a0", "a1", "z0", "z1"])

    kind = "doc_id long, k long, line_no int, n_words int, h long, a0 long, a1 long, z0 long, z1 long"
    return docs.select("doc_id", "k", "text").mapInArrow(run, kind)


def variants(lines: DataFrame) -> DataFrame:
    """(v, place, h) of the lines (h, text, in_first, in_last): the whole line at place -1, and every deletion of a word in the half
    that may differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text", 1 << 18):
                at, raw = utf8(batch.column(1))
                data = raw.tobytes()
                ids, in_first, in_last = (batch.column(c).to_pylist() for c in (0, 2, 3))
                v, place, h = [], [], []
                for r in range(batch.num_rows):
                    words = data[at[r] : at[r + 1]].lower().split()
                    n = len(words)
                    v.append(_hash(words))
                    place.append(-1)
                    # The first halves agree: the edit lies behind them, or the other way round.
                    lo = 0 if in_last[r] else (n - 1) // 2
                    hi = n if in_first[r] else (n + 1) // 2 + 1
                    hi = min(hi, n)
                    joined = b" ".join(words)
                    starts = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
                    for p in range(lo, hi):
                        rest = joined[: starts[p]] + joined[starts[p + 1] :] if p < n - 1 else joined[: max(starts[p] - 1, 0)]
                        d = xxhash.xxh64_intdigest(rest)
                        v.append(d - (1 << 64) if d >> 63 else d)
                        place.append(p)
                    h.extend([ids[r]] * (1 + max(0, hi - lo)))
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()), pa.array(place, pa.int32()), pa.array(h, pa.int64())], names=["v", "place", "h"])

    return lines.select("h", "text", "in_first", "in_last").mapInArrow(run, "v long, place int, h long")


def one_edit(x: list[bytes], y: list[bytes]) -> bool:
    """Whether two sequences are at most one insertion, deletion or replacement apart."""
    if abs(len(x) - len(y)) > 1:
        return False
    n = min(len(x), len(y))
    a = 0
    while a < n and x[a] == y[a]:
        a += 1
    z = 0
    while z < n - a and x[-1 - z] == y[-1 - z]:
        z += 1
    return max(len(x), len(y)) - a - z <= 1


def documents(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(by_name(docs, doc_id).cast("long").alias("doc_id"), F.coalesce(by_name(docs, text).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("k", F.xxhash64("text"))


def repeated_lines(
    docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, k, line_no, kept_doc_id, kept_line_no, edits) of every line to drop; k is ``xxhash64`` of the text.

    ``kept`` is the earliest equal line, or for edits = 1 the earliest line one edit away (which may itself be one edit from a
    still earlier one). Rows with equal id and text are one document. Lines of fewer than ``min_words`` words
    and null or empty texts have nothing to drop. Null ids come last in the order.
    """
    rows = documents(docs, doc_id, text)
    with settings(docs.sparkSession, SMALL_BATCHES):
        lines = materialize(line_rows(rows, min_words, near_words), "line-rows")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k", "line_no")
    firsts = lines.groupBy("h").agg(
        F.min(order).alias("at"), F.min("n_words").alias("n_words"), *(F.min(c).alias(c) for c in ("a0", "a1", "z0", "z1")))
    firsts = materialize(firsts, "line-firsts")
    near = _near_copies(rows, firsts, near_words)
    # Occurrences against the earliest one and its near copy: one row per different line on the right.
    placed = lines.join(firsts.select("h", "at").join(near, "h", "left"), "h")
    own = placed.withColumn("own", order)
    dropped = own.where((F.col("own") != F.col("at")) | F.col("near").isNotNull())
    kept = F.coalesce("near", "at")
    return dropped.select(
        "doc_id", "k", "line_no", kept["doc_id"].alias("kept_doc_id"), kept["line_no"].alias("kept_line_no"),
        F.when(F.col("near").isNotNull(), 1).otherwise(0).alias("edits"),
    ).distinct()


def _near_copies(rows: DataFrame, firsts: DataFrame, near_words: int) -> DataFrame:
    """(h, near): the earliest occurrence of a line one edit away, for lines whose own earliest occurrence is later."""
    long = firsts.where(F.col("n_words") >= near_words)
    halves = long.select("h", F.explode(F.array(*(
        F.struct(F.col(c).alias("key"), F.lit(c.startswith("a")).alias("front")) for c in ("a0", "a1", "z0", "z1")))).alias("s"))
    halves = halves.select("h", "s.key", "s.front")
    shared = halves.groupBy("key").count().where("count > 1").select("key")
    met = halves.join(shared, "key").groupBy("h").agg(F.max("front").alias("in_first"), F.max(~F.col("front")).alias("in_last"))
    wanted = long.join(met, "h").select("h", "at", "in_first", "in_last")
    # The text of the earliest occurrences; keys name one line of one document, so no key is hot.
    place = lambda d, k, n: F.xxhash64(d, k, n)
    wanted = wanted.withColumn("where", place(F.col("at.doc_id"), F.col("at.k"), F.col("at.line_no")))
    split = rows.select("doc_id", "k", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    split = split.where(F.length("text") >= 2 * near_words - 1).withColumn("where", place(F.col("doc_id"), F.col("k"), F.col("line_no")))
    held = wanted.join(split.select("where", "text"), "where").select("h", "at", "in_first", "in_last", "text")
    held = materialize(held.dropDuplicates(["h"]), "line-near")
    with settings(rows.sparkSession, SMALL_BATCHES):
        keys = materialize(variants(held).join(held.select("h", "at"), "h"), "line-variants")
    # Whose earliest line is wanted: lines with the same deletion, the whole line, or (for a whole line) any deletion.
    entry = F.struct("at", "h")
    by_place = keys.groupBy("v", "place").agg(F.min(entry).alias("low"))
    by_place = materialize(by_place, "line-places")
    by_key = by_place.groupBy("v").agg(
        F.min(F.when(F.col("place") < 0, F.col("low"))).alias("whole"), F.min(F.when(F.col("place") >= 0, F.col("low"))).alias("deleted"))
    best = by_place.join(by_key, "v").withColumn(
        "best", F.when(F.col("place") < 0, F.col("deleted")).otherwise(F.least("low", "whole")))
    best = best.where("best is not null").select("v", "place", "best")
    found = keys.join(best, ["v", "place"]).where(F.col("best.at") < F.col("at"))
    found = materialize(found.groupBy("h").agg(F.min("best").alias("best")), "line-found")
    texts = held.select("h", "text")
    pairs = found.select("h", F.col("best.h").alias("other"), F.col("best.at").alias("near"))
    pairs = pairs.join(texts, "h").join(texts.select(F.col("h").alias("other"), F.col("text").alias("other_text")), "other")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (at_x, raw_x), (at_y, raw_y) = utf8(batch.column(1)), utf8(batch.column(2))
            keep = [
                one_edit(raw_x[at_x[r] : at_x[r + 1]].tobytes().lower().split(), raw_y[at_y[r] : at_y[r + 1]].tobytes().lower().split())
                for r in range(batch.num_rows)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep, pa.bool_()))], names=["h"])

    sure = pairs.select("h", "text", "other_text").mapInArrow(verify, "h long")
    return found.join(sure, "h").select("h", F.col("best.at").alias("near"))


def drop_lines(docs: DataFrame, drops: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without the lines to drop; other columns stay. Documents left without any word go, if lines were dropped from them."""
    place, gone = free_name(docs, "place"), free_name(docs, "gone")
    keyed = docs.withColumn(place, F.xxhash64(by_name(docs, doc_id).cast("long"), F.xxhash64(F.coalesce(by_name(docs, text).cast("string"), F.lit("")))))
    lists = drops.groupBy(F.xxhash64("doc_id", "k").alias(place)).agg(F.collect_list("line_no").alias(gone))
    met = keyed.join(lists, place, "left").select(*(by_name(docs, c) for c in docs.columns), gone)
    column = docs.columns.index(text)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lists = batch.column(column).to_pylist(), batch.column(len(names)).to_pylist()
            keep = np.ones(batch.num_rows, bool)
            for r, numbers in enumerate(lists):
                if numbers:
                    out = set(numbers)
                    texts[r] = "\n".join(x for n, x in enumerate(texts[r].split("\n")) if n not in out)
                    keep[r] = bool(texts[r].strip())
            columns = [pa.array(texts, pa.string()) if c == column else batch.column(c) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(keep))

    return met.mapInArrow(run, docs.schema)
