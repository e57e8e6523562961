"""Nearest dictionary term by edit distance, for dictionaries of any size: a joined index over distinct terms.

Equal terms meet in a join. Of three pieces of a dictionary term, two edits leave one whole and nearly in its place, so only terms with a
piece that an asked term has there can be within two edits. Such terms share a string that both become by deleting up to two letters, so a join on those
strings finds all of them; a match there is exact, ties included. What is left over is far from every term; it meets the dictionary
in cells of a block of the one and a block of the other, where letter counts bound the distance from below. A first walk over all cells computes
the most promising terms of each, a second one those whose bound is within the best distance of the first.

The earliest term (smallest code) wins a tie. Null terms have no nearest one; nor has any term if the dictionary is empty. A repeated
dictionary term counts with its smallest code. Deletions grow with the square of a term's length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.session import materialize

EDITS = 2
BLOCK_TERMS = 50_000
#: Far terms that meet a block of the dictionary in one task.
ASKED_TERMS = 4096
#: Dictionary terms computed together, nearest bounds first: so many at first, then doubling.
STEP, MOST = 64, 1024
_BINS = 64


def deletions(term: Column, edits: int = EDITS) -> Column:
    """Every string that the term becomes by deleting at most so many letters."""

    def shorter(t: Column) -> Column:
        places = F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))

    every = last = F.array(term)
    for _ in range(edits):
        last = F.array_distinct(F.flatten(F.transform(last, shorter)))
        every = F.array_union(every, last)
    return every


def _cut(size: Column, i: int) -> Column:
    """Where the i-th of ``EDITS + 1`` pieces of a term of that length begins."""
    return F.floor(size * i / (EDITS + 1)).cast("int")


def _piece(size: Column, i: int, text: Column) -> Column:
    return F.xxhash64(size, F.lit(i), text)


def own_pieces(term: Column) -> Column:
    """Keys of the pieces of a dictionary term."""
    size = F.length(term)
    return F.array(*[_piece(size, i, F.substring(term, _cut(size, i) + 1, _cut(size, i + 1) - _cut(size, i))) for i in range(EDITS + 1)])


def met_pieces(term: Column) -> Column:
    """Keys of every piece that a dictionary term within the edits may share with this term."""
    keys = []
    for longer in range(-EDITS, EDITS + 1):
        size = F.length(term) + longer
        for i in range(EDITS + 1):
            wide = _cut(size, i + 1) - _cut(size, i)
            for shift in range(-EDITS, EDITS + 1):
                at = _cut(size, i) + shift
                fits = (size >= 0) & (at >= 0) & (at + wide <= F.length(term))
                keys.append(F.when(fits, _piece(size, i, F.substring(term, at + 1, wide))))
    return F.array_distinct(F.array_compact(F.array(*keys)))


def _letters(terms: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points padded with zeros, lengths)."""
    size = np.array([len(t) for t in terms], np.int64)
    out = np.zeros((len(terms), max(1, int(size.max(initial=1)))), np.uint32)
    for i, t in enumerate(terms):
        out[i, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4")
    return out, size


def _bags(letters: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Letter counts in hashed bins."""
    out = np.zeros((len(size), _BINS), np.int16)
    for j in range(letters.shape[1]):
        rows = np.flatnonzero(size > j)
        np.add.at(out, (rows, (letters[rows, j] * np.uint32(2654435761)) >> np.uint32(26)), 1)
    return out


def distances(term: np.ndarray, letters: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Edit distances of one term to many, all rows of the table at once."""
    before = [np.full(len(size), j, np.int32) for j in range(letters.shape[1] + 1)]
    for i, c in enumerate(term, 1):
        now = [np.full(len(size), i, np.int32)]
        for j in range(1, letters.shape[1] + 1):
            now.append(np.minimum(np.minimum(before[j], now[-1]) + 1, before[j - 1] + (letters[:, j - 1] != c)))
        before = now
    return np.stack(before)[size, np.arange(len(size))]


class Block:
    """Dictionary terms with what bounds their distance from below; terms of the same letters share a bound."""

    def __init__(self, terms: list[str], codes: list[int]):
        letters, size = _letters(terms)
        self.bags, of = np.unique(_bags(letters, size), axis=0, return_inverse=True)
        by_bag = np.argsort(of.ravel(), kind="stable")
        self.letters, self.size, self.codes = letters[by_bag], size[by_bag], np.array(codes, np.int64)[by_bag]
        self.ends = np.cumsum(np.bincount(of.ravel(), minlength=len(self.bags)))

    def nearest(self, term: str, best: tuple[int, int] = (1 << 60, -1), first: bool = False) -> tuple[int, int]:
        """(distance, code) of the nearest term of the block if it is better than ``best``, else that; or with ``first`` of the most promising ones."""
        letters, size = _letters([term])
        over = self.bags - _bags(letters, size)
        bound = np.maximum(np.maximum(over, 0).sum(axis=1), np.maximum(-over, 0).sum(axis=1))
        worth = np.flatnonzero(bound <= best[0])
        order = worth[np.argsort(bound[worth], kind="stable")]
        counts = np.diff(self.ends, prepend=0)[order]
        step, done, n = STEP, 0, int(counts.sum())
        ends = np.cumsum(counts)
        while done < n:
            # Places done .. done + step of the terms in the order of their bags.
            at = np.arange(done, min(done + step, n))
            of = np.searchsorted(ends, at, side="right")
            if bound[order[of[0]]] > best[0]:
                break
            part = self.ends[order[of]] - (ends[of] - at)
            wide = int(self.size[part].max(initial=0))
            found = distances(letters[0, : size[0]], self.letters[part, : max(wide, 1)], self.size[part])
            low = found.min()
            best = min(best, (int(low), int(self.codes[part[found == low]].min())))
            if first:
                break
            done, step = done + step, min(2 * step, MOST)
        return best


def _walk(far: DataFrame, terms: DataFrame, blocks: int, parts: int, first: bool) -> DataFrame:
    """``(term, code, distance)`` of far terms that come with their best so far, once per block of the dictionary in which a term is better."""

    def run(asked: pa.Table, known: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and known.num_rows:
            block = Block(known.column("known").to_pylist(), known.column("code").to_pylist())
            for term, distance, code in zip(*(asked.column(c).to_pylist() for c in ("term", "distance", "code")), strict=True):
                best = block.nearest(term, (distance, code), first)
                if best != (distance, code):
                    out.append((term, best[1], best[0]))
        columns = zip(*out, strict=True) if out else ([], [], [])
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["term", "code", "distance"])

    def all_of(n: int, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)

    left = far.select("term", "distance", "code", F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int").alias("part"), all_of(blocks, "block"))
    right = terms.select("known", "code", F.pmod(F.xxhash64("known"), F.lit(blocks)).cast("int").alias("block"), all_of(parts, "part"))
    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part"))
    return met.applyInArrow(run, "term string, code long, distance long")


def _best(found: DataFrame) -> DataFrame:
    return found.groupBy("term").agg(F.min(F.struct("distance", "code")).alias("b")).select("term", "b.code", "b.distance")


def nearest_terms(asked: DataFrame, dictionary: DataFrame, term: str = "term", code: str = "code", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(term, code, distance)`` per distinct term of ``asked``; ``dictionary`` holds terms and their codes."""
    terms = dictionary.where(F.col(term).isNotNull()).groupBy(F.col(term).cast("string").alias("known")).agg(F.min(F.col(code).cast("long")).alias("code"))
    terms = materialize(terms, "dictionary")
    wanted = materialize(asked.where(F.col(term).isNotNull()).select(F.col(term).cast("string").alias("term")).distinct(), "asked-terms")
    equal = wanted.join(terms, wanted["term"] == terms["known"]).select("term", "code", F.lit(0).cast("long").alias("distance"))
    others = wanted.join(terms, wanted["term"] == terms["known"], "left_anti")
    pieces = others.select(F.explode(met_pieces(F.col("term"))).alias("piece")).distinct()
    close = terms.select("known", "code", F.explode(own_pieces(F.col("known"))).alias("piece")).join(pieces, "piece", "left_semi").select("known", "code").distinct()
    left = others.select("term", F.explode(deletions(F.col("term"))).alias("key")).withColumn("key", F.xxhash64("key"))
    right = close.select("known", "code", F.explode(deletions(F.col("known"))).alias("key")).withColumn("key", F.xxhash64("key"))
    distance = F.levenshtein("term", "known", EDITS).cast("long")
    near = left.join(right, "key").select("term", "code", distance.alias("distance")).where(F.col("distance") >= 0)
    found = materialize(equal.unionByName(_best(near)), "near-terms")
    far = materialize(wanted.join(found, "term", "left_anti").select("term", F.lit(1 << 60).alias("distance"), F.lit(-1).cast("long").alias("code")), "far-terms")
    n_far, n_terms = far.count(), terms.count()
    result = found
    if n_far and n_terms:
        blocks = -(-n_terms // block_terms)
        cores = asked.sparkSession.sparkContext.defaultParallelism
        parts = max(-(-n_far // ASKED_TERMS), min(-(-n_far // STEP), -(-2 * cores // blocks)))
        seen = materialize(_best(_walk(far, terms, blocks, parts, True)), "far-seen")
        better = materialize(_walk(seen, terms, blocks, parts, False), "far-better")
        result = found.unionByName(_best(seen.unionByName(better)))
    return result.select("term", "code", F.col("distance").cast("int"))
