"""Hard-negative mining by a secondary sort: for every anchor its best positives, and for each the negatives in its score window.

Pair scores are packed into keys (anchor, descending score, id). The pairs are dealt by anchor and sorted by
that key within partitions (``repartition`` with ``sortWithinPartitions``, the DataFrame form of
repartitionAndSortWithinPartitions), and an iterator that walks the sorted rows opens a window when it meets a positive and emits
negatives while their scores lie in an open window. It holds one anchor's open windows, never an anchor's rows.

Scores are the inner products of every row with every anchor, taken in blocks: a block of anchors of a fixed number of numbers
(``BLOCK_NUMBERS``, so its size is proven) goes to all tasks, each of which walks its own rows once. Only pairs that
can matter are shuffled, without loss: of its rows, a task keeps per anchor the best ``positives`` of the same label; when the
windows are known from those, a second walk keeps per window its first ``negatives``. The first of all rows
are among the first of each task, so nothing is missed. No row is shuffled, whatever label or vector
most rows share; what is shuffled per anchor depends on the number of tasks only. More anchors than a block make more
walks, one after the other, and all end in one shuffle.

Rows with a null label, a null vector or a null or non-finite component take no part. Vectors of different lengths are compared as if the
shorter ended in zeros. Rows with equal ids are rows of their own: two rows with an anchor's id are two anchors, and each may be the
other's positive. Null ids are never anchors, and come last among equal scores. Further ties (equal scores and ids) go by position. Scores beyond a
long are cut off at its ends; they are otherwise exact, at any size of the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm.common import by_name
from auditlake.session import materialize, scratch_path

POSITIVES = 5
NEGATIVES = 10
#: A negative's score is at least LOW and at most HIGH hundredths of the positive's.
LOW, HIGH = 30, 90
#: Components of the anchors of one walk: 8 bytes each.
BLOCK_NUMBERS = 1 << 21
#: Scores that a task computes together.
SCORES = 1 << 21

_LAST = np.iinfo(np.int64).max
PAIRS = "anchor long, anchor_id long, score long, id long, row long, positive boolean"


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """Every component x as floor(scale * x), x as double; null for vectors with a null or non-finite component."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(sound, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows, filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(x: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Inner products [row of x, anchor], exact."""
    width = min(x.shape[1], anchors.shape[1])  # what is beyond meets zeros
    x, y = x[:, :width], anchors[:, :width]
    most = [max(abs(int(a.max(initial=0))), abs(int(a.min(initial=0)))) for a in (x, y)]
    if most[0] * most[1] * max(width, 1) < 1 << 53:
        return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64)
    exact = x.astype(object) @ y.T.astype(object)
    return np.clip(exact, -_LAST - 1, _LAST).astype(np.int64)


class Best:
    """The first ``most`` pairs of every group (an anchor, or an anchor's window) met so far: by score downwards, then id."""

    def __init__(self, groups: int, most: int):
        self.most = most
        self.least = np.full(groups, np.iinfo(np.int64).min)  # score of a full group's last pair
        self.kept = [np.empty(0, np.int64) for _ in range(4)]  # group, score, id, row

    def take(self, scores: np.ndarray, allowed: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """``scores`` and ``allowed`` are [row, group]."""
        cut = self.least
        if len(rows) > self.most and (cut == np.iinfo(np.int64).min).any():
            low = np.where(allowed, scores, np.iinfo(np.int64).min)
            cut = np.maximum(cut, np.partition(low, len(rows) - self.most, axis=0)[len(rows) - self.most])
        at, group = np.nonzero(allowed & (scores >= cut))
        if not len(at):
            return
        new = [group, scores[at, group], ids[at], rows[at]]
        group, score, key, row = (np.concatenate(x) for x in zip(self.kept, new, strict=True))
        order = np.lexsort((row, key, ~score, group))
        group = group[order]
        first = np.searchsorted(group, group)
        order = order[np.arange(len(group)) - first < self.most]
        self.kept = [np.concatenate(x)[order] for x in zip(self.kept, new, strict=True)]
        size = np.bincount(self.kept[0], minlength=len(self.least))
        full = np.flatnonzero(size >= self.most)
        self.least[full] = self.kept[1][np.cumsum(size)[full] - 1]


class Block:
    """Anchors of one walk."""

    def __init__(self, table: pa.Table, width: int):
        whole = table.combine_chunks()
        self.row, self.id, self.label = (whole.column(c).to_numpy() for c in ("row", "vec_id", "label"))
        self.vectors = matrix(whole.column("vector").combine_chunks(), width)

    def walk(self, batches: Iterator[pa.RecordBatch], see) -> None:
        """Calls ``see(scores, same label, ids, rows)`` for all rows, some at a time."""
        step = max(1, SCORES // max(len(self.row), 1))
        for batch in batches:
            row, key, label = (batch.column(i) for i in range(3))
            key = key.fill_null(_LAST).to_numpy()
            row, label = row.to_numpy(), label.to_numpy()
            for i in range(0, batch.num_rows, step):
                here = slice(i, i + step)
                x = matrix(batch.column(3).slice(i, step), 0)
                see(products(x, self.vectors), label[here, None] == self.label, key[here], row[here])

    def pairs(self, kept: list[np.ndarray], group_size: int, positive: bool) -> pa.RecordBatch:
        group, score, key, row = kept
        anchor = group // group_size
        if group_size > 1:  # a pair may lie in several windows of its anchor
            _, once = np.unique(np.stack([anchor, row]), axis=1, return_index=True)
            anchor, score, key, row = anchor[once], score[once], key[once], row[once]
        columns = [self.row[anchor], self.id[anchor], score, pa.array(key, mask=key == _LAST), row, np.full(len(row), positive)]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=["anchor", "anchor_id", "score", "id", "row", "positive"])


def best_positives(rows: DataFrame, block: Block, positives: int) -> DataFrame:
    """Pairs of every anchor with its first rows of the same label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(block.row), positives)
        block.walk(batches, lambda scores, same, ids, at: best.take(scores, same & (at[:, None] != block.row), ids, at))
        yield block.pairs(best.kept, 1, True)

    order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return rows.mapInArrow(run, PAIRS).withColumn("n", F.row_number().over(order)).where(F.col("n") <= positives).drop("n")


def window_negatives(rows: DataFrame, block: Block, found: pa.Table, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """Pairs of every anchor with rows of other labels: a task's first ones of every window."""
    place = {r: i for i, r in enumerate(block.row.tolist())}
    least = np.full((len(block.row), positives), 1, np.int64)
    most = np.zeros((len(block.row), positives), np.int64)  # no window: 1 to 0
    used = [0] * len(block.row)
    for anchor, score in zip(found.column("anchor").to_pylist(), found.column("score").to_pylist(), strict=True):
        i = place[anchor]
        least[i, used[i]], most[i, used[i]] = -(-low * score // 100), high * score // 100
        used[i] += 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(len(block.row), negatives) for _ in range(positives)]

        def see(scores, same, ids, at):
            for k in range(positives):
                best[k].take(scores, ~same & (scores >= least[:, k]) & (scores <= most[:, k]), ids, at)

        block.walk(batches, see)
        kept = [np.concatenate([b.kept[0] * positives + k if i == 0 else b.kept[i] for k, b in enumerate(best)]) for i in range(4)]
        yield block.pairs(kept, positives, False)

    return rows.mapInArrow(run, PAIRS)


def open_windows(pairs: DataFrame, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The secondary sort and the walk over it."""
    key = [F.col("anchor"), F.desc("score"), F.asc_nulls_last("id"), F.col("row")]
    dealt = pairs.repartition("anchor").sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchor, windows, ties, seen = None, [], [], 0
        for batch in batches:
            out = []
            for at, anchor_id, score, id_, positive in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5)), strict=True):
                if at != anchor:
                    anchor, windows, ties, seen = at, [], [], 0
                if ties and ties[0][0] != score:
                    ties = []
                if positive:
                    if seen < positives:
                        seen += 1
                        window = [score, id_, 0]
                        windows.append(window)
                        # Only a window of score 0 holds its own score: negatives of that score with smaller ids came before.
                        for tie, earlier in ties:
                            if low * score <= 100 * tie <= high * score:
                                window[2] += 1
                                out.append((anchor_id, id_, window[2], earlier, score, tie))
                    continue
                for window in windows:
                    if window[2] < negatives and low * window[0] <= 100 * score <= high * window[0]:
                        window[2] += 1
                        out.append((anchor_id, window[1], window[2], id_, window[0], score))
                if len(ties) < negatives:
                    ties.append((score, id_))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])

    return dealt.mapInArrow(run, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def mine(
    rows: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: str = "label", vector: str = "vector",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block_numbers: int = BLOCK_NUMBERS,
) -> DataFrame:
    """Hard negatives of all anchors. ``rows`` holds ids, integer labels and integer vectors; ``is_anchor`` is a condition on its columns."""
    spark = rows.sparkSession
    sound = by_name(rows, label).isNotNull() & F.coalesce(F.forall(by_name(rows, vector), lambda x: x.isNotNull()), F.lit(False))
    base = materialize(rows.where(sound).select(
        F.monotonically_increasing_id().alias("row"), by_name(rows, vec_id).cast("long").alias("vec_id"), by_name(rows, label).cast("long").alias("label"),
        by_name(rows, vector).cast("array<long>").alias("vector"), (F.coalesce(is_anchor, F.lit(False)) & by_name(rows, vec_id).isNotNull()).alias("is_anchor"),
    ), "negatives-rows")
    columns = base.select("row", "vec_id", "label", "vector")
    anchors = materialize(columns.where(base["is_anchor"]), "negatives-anchors")
    width = anchors.agg(F.coalesce(F.max(F.size("vector")), F.lit(0))).first()[0]
    size, last = max(1, block_numbers // max(width, 1)), -1
    path, number = scratch_path(spark, "negatives-pairs"), 0
    while True:
        table = anchors.where(F.col("row") > last).orderBy("row").limit(size).toArrow()  # at most block_numbers numbers
        if number and not table.num_rows:
            break
        block = Block(table, width)
        found = materialize(best_positives(columns, block, positives), "negatives-positives")
        windows = found.select("anchor", "score").toArrow()  # at most ``positives`` rows an anchor
        away = window_negatives(columns, block, windows, positives, negatives, low, high)
        found.unionByName(away).write.parquet(f"{path}/block={number}")
        number += 1
        if table.num_rows < size:
            break
        last = int(block.row[-1])
    pairs = spark.read.schema(PAIRS).parquet(path)
    return open_windows(pairs, positives, negatives, low, high)
