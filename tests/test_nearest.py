"""Nearest terms against all pairs."""

import random

import numpy as np
from pyspark.sql import functions as F

from auditlake.operators import nearest


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def some_terms(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdé語") for _ in range(r.choice([0, 1, 2, 3, 5, 8, 13]))) for _ in range(n)]


def test_equal_to_all_pairs(spark):
    terms, asked = some_terms(1, 150), some_terms(2, 120) + ["zzzzzzzzzzzzzzzzzz", "", None, "abc"]
    dictionary = spark.createDataFrame([(t, i) for i, t in enumerate(terms)] + [(None, 9999)], "term string, code int")
    want = {a: min((edit_distance(a, t), i) for i, t in enumerate(terms)) for a in asked if a is not None}
    df = spark.createDataFrame([(a, 1) for a in asked + asked], "term string, known int")
    for size in (nearest.BLOCK_TERMS, 40):
        got = {r.term: (r.distance, r.code) for r in nearest.nearest_terms(df, dictionary, block_terms=size).collect()}
        assert got == want
    assert nearest.nearest_terms(df, dictionary.limit(0)).count() == 0 and nearest.nearest_terms(df.limit(0), dictionary).count() == 0


def test_a_dictionary_of_fifty_thousand_terms(spark):
    r = random.Random(3)
    terms = sorted({"".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(4, 14))) for _ in range(50_200)})[:50_000]
    asked = [terms[7], terms[70][1:], terms[700][:3] + "q" + terms[700][3:], "xyzw" * 4, "aaaaaaa", "ponmlkjihgfedcba" * 2]
    dictionary = spark.createDataFrame(list(zip(terms, range(len(terms)))), "term string, code int")
    got = {x.term: (x.distance, x.code) for x in nearest.nearest_terms(spark.createDataFrame([(a,) for a in asked], "term string"), dictionary).collect()}
    letters, size = nearest._letters(terms)
    for a in asked:
        all_pairs = nearest.distances(np.frombuffer(a.encode("utf-32-le"), "<u4"), letters, size)
        assert got[a] == (all_pairs.min(), all_pairs.argmin())
    assert all(edit_distance(a, terms[c]) == d for a, (d, c) in got.items())


def test_a_piece_of_each_term_within_two_edits_is_met(spark):
    terms = some_terms(4, 200)
    r = random.Random(5)
    pairs = []
    for t in terms:
        a = t
        for _ in range(r.randint(0, 2)):
            i = r.randint(0, len(a))
            a = r.choice([a[:i] + r.choice("abx") + a[i:], a[:i] + a[i + 1 :], a[:i] + r.choice("abx") + a[i + 1 :]])
        pairs.append((a, t))
    df = spark.createDataFrame(pairs, "a string, b string")
    assert df.where(F.arrays_overlap(nearest.met_pieces(F.col("a")), nearest.own_pieces(F.col("b")))).count() == len(pairs)


def test_blocks_without_a_near_term_are_passed_over(spark, monkeypatch):
    """Most of the dictionary is far from the asked terms: the best of another block bounds the search there."""
    names = [f"Customer#{i:09d}" for i in range(3000)]
    block = nearest.Block(names, list(range(3000)))
    computed = []
    real = nearest.distances
    monkeypatch.setattr(nearest, "distances", lambda t, letters, size: computed.append(len(size)) or real(t, letters, size))
    assert block.nearest("gnir egral12", (8, 5)) == (8, 5)
    assert sum(computed) == 0
    assert block.nearest("Customer#00000299", (3, 9)) == (1, 299)
