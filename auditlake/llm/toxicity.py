"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are hashed n-grams of the UTF-8 bytes (A-Z lower-cased, white space as one blank byte each), counted once per
document. A feature's scale is the log ratio of its smoothed document frequencies among toxic and other
training rows; features with a ratio far from zero and a sure difference stay. A logistic regression on the
scaled features gives the score.

The fit uses a bounded sample of labelled rows (``max_rows``, the smallest hashes of the id); scoring reads every byte of every text
in one pass without a shuffle and carries two small tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditlake.llm.common import append_columns, blocks, by_name, free_name, utf8
from auditlake.session import materialize

ORDERS = (4, 5, 6, 7, 8)
BITS = 20
MAX_ROWS = 8000
MAX_FEATURES = 4000
THRESHOLD = 0.3

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32
_FOLD[[9, 10, 11, 12, 13]] = 32


@dataclass(frozen=True)
class Model:
    place: np.ndarray  # feature number + 1 by hash, 0 for none
    weights: np.ndarray  # by feature number
    bias: float


def ngram_codes(raw: np.ndarray, order: int) -> np.ndarray:
    """Hash codes of all byte n-grams of the block; those that cross two texts are sorted out by the caller."""
    n = len(raw) - order + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    word = np.ndarray((n,), "<u8", padded.data, 0, (1,))
    mixed = (word & np.uint64((1 << 8 * order) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(2 * order + 0x165667B19E3779F9 | 1)
    return (mixed >> np.uint64(64 - BITS)).astype(np.uint32)


def hits(at: np.ndarray, raw: np.ndarray, keep: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every n-gram within a text, each pair once; with ``keep`` only of kept codes."""
    raw = np.concatenate([np.insert(_FOLD[raw], at[:-1], 32), np.array([32], np.uint8)])  # a blank before every text
    start = at + np.arange(len(at))
    found = []
    for order in ORDERS:
        code = ngram_codes(raw, order)
        here = np.flatnonzero(keep[code]) if keep is not None else np.arange(len(code))
        row = np.searchsorted(start, here, side="right") - 1
        inside = here + order <= start[row + 1] + 1  # up to the blank that begins the next text
        found.append(row[inside].astype(np.int64) << BITS | code[here[inside]])
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def sample_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled rows, one per id: the smallest hashes of the id among rows to learn from.

    Equal texts count once. Rows with a null label or id are left out.
    """
    marked = labels.where(learn & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    marked = marked.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select(by_name(docs, "doc_id").alias("doc_id"), F.coalesce(by_name(docs, "text"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(marked), "doc_id")  # at most max_rows rows of two numbers
    return materialize(rows.dropDuplicates(["text"]), "labelled-sample")


def logistic(rows, cols, values, y, n_features: int, penalty: float, steps: int = 300, weight: np.ndarray | None = None):
    """Weights and bias of a penalised logistic regression on sparse entries, by Nesterov's accelerated gradient."""
    n = len(y)
    weight = np.ones(n) if weight is None else weight
    norms = np.bincount(rows, values**2, n) + 1
    # A bound on the curvature from the power method on X'X keeps every step a descent.
    v = np.ones(n_features + 1)
    size = 1.0
    for _ in range(20):
        u = np.bincount(rows, values * v[cols], n) + v[-1]
        v = np.append(np.bincount(cols, values * u[rows], n_features), u.sum())
        size = float(np.sqrt((v**2).sum()))
        v /= size
    rate = 1 / (0.25 * weight.max() * min(size, norms.sum()) * 1.05 + penalty)
    w = np.zeros(n_features + 1)
    last, t = w.copy(), 1.0
    for _ in range(steps):
        z = np.bincount(rows, values * w[cols], n) + w[-1]
        g = weight * (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y)
        grad = np.append(np.bincount(cols, values * g[rows], n_features) + penalty * w[:-1], g.sum())
        new = w - rate * grad
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        w = new + (t - 1) / t_next * (new - last)
        last, t = new, t_next
    return last[:-1], float(last[-1])


def fit(sample: DataFrame, max_features: int = MAX_FEATURES, min_ratio: float = 1.0, min_rows: int = 5) -> Model:
    """Trains on rows (text, y). Without both labels the model scores every text by the base rate."""
    spark = sample.sparkSession
    totals = {r[0]: r[1] for r in sample.groupBy("y").count().collect()}
    n1, n0 = totals.get(1, 0), totals.get(0, 0)
    empty = Model(np.zeros(1 << BITS, np.int32), np.zeros(1), float(np.log((n1 + 0.5) / (n0 + 0.5))))
    if not n1 or not n0:
        return empty

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << BITS), np.int64)
        for whole in batches:
            for batch in blocks(whole, "text"):
                y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                row, code = hits(*utf8(batch.column(0)), None)
                for k in (0, 1):
                    counts[k] += np.bincount(code[y[row] == k], minlength=1 << BITS)
        code = np.flatnonzero(counts.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(counts[0][code]), pa.array(counts[1][code])], names=["code", "c0", "c1"])

    kinds = "code long, c0 long, c1 long"
    table = sample.select("text", "y").mapInArrow(frequencies, kinds).groupBy("code").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    p1, p0 = (F.col("c1") + 0.5) / (n1 + 1.0), (F.col("c0") + 0.5) / (n0 + 1.0)
    pooled = (F.col("c0") + F.col("c1") + 1.0) / (n0 + n1 + 2.0)
    sure = (p1 - p0) * (p1 - p0) / (pooled * (1 - pooled) * (1.0 / n1 + 1.0 / n0))
    chosen = (
        table.where(F.col("c0") + F.col("c1") >= min_rows).withColumn("ratio", F.log(p1) - F.log(p0)).withColumn("sure", sure)
        .where((F.abs("ratio") >= min_ratio) & (F.col("sure") >= 12)).orderBy(F.desc("sure"), "code").limit(max_features)
        .select("code", "ratio").collect()
    )  # at most max_features rows
    if not chosen:
        return empty
    codes, ratio = np.array([r[0] for r in chosen]), np.array([r[1] for r in chosen])
    place = np.zeros(1 << BITS, np.int32)
    place[codes] = np.arange(1, len(codes) + 1)
    keep = place > 0

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in blocks(whole, "text"):
                row, code = hits(*utf8(batch.column(0)), keep)
                cut = np.searchsorted(row, np.arange(1, batch.num_rows))
                lists = [x.tolist() for x in np.split(place[code] - 1, cut)]
                yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(lists, pa.list_(pa.int32()))], names=["y", "features"])

    got = sample.select("text", "y").mapInArrow(entries, T.StructType([
        T.StructField("y", T.IntegerType()), T.StructField("features", T.ArrayType(T.IntegerType()))])).collect()
    y = np.array([r[0] for r in got], float)
    cols = np.array([c for r in got for c in r[1]], np.int64)
    rows = np.repeat(np.arange(len(got)), [len(r[1]) for r in got])
    order = np.lexsort((cols, rows))
    cols, rows = cols[order], rows[order]
    weights, bias = logistic(rows, cols, ratio[cols], y, len(codes), penalty=3.0)
    return Model(place, weights * ratio, bias)


def score_texts(docs: DataFrame, model: Model, text: str = "text", name: str = "toxicity") -> DataFrame:
    """Rows with the probability of being toxic appended; null and empty texts are scored by the bias alone."""
    place, keep, weights, bias = model.place, model.place > 0, model.weights, model.bias

    def score(at, raw):
        row, code = hits(at, raw, keep)
        z = bias + np.bincount(row, weights[place[code] - 1], len(at) - 1)
        return [pa.array(1 / (1 + np.exp(-np.clip(z, -35, 35))))]

    return append_columns(docs, text, [(free_name(docs, name), T.DoubleType())], score)


def fold(doc_id: Column, parts: int) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """The model from rows of ``labels`` outside the held-out fold (crc32 of the id mod 4 is 2)."""
    return fit(sample_rows(docs, labels, "toxic", fold(F.col("doc_id"), 4) != 2, max_rows))
