"""Language mixtures: a plain twin, held-out accuracy, odd input."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from auditlake.llm import language_mix as mix
from auditlake.llm.common import table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def model(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    return mix.train(docs, F.col("doc_id") % 5 != 0)


def plain_words(text):
    data = bytearray(text.encode())
    for i, b in enumerate(data):
        if 65 <= b <= 90:
            data[i] = b + 32
    for i in range(1, len(data)):
        if text.encode()[i - 1] == 0xC3 and 0x80 <= data[i] <= 0x9E and data[i] != 0x97:
            data[i] += 32
    runs = [m.group() for m in re.finditer(rb"[a-z\x80-\xff]+", bytes(data))]
    return [run[i : i + mix.LONGEST] for run in runs for i in range(0, len(run), mix.LONGEST)]


def cell(gram, k):
    word = int.from_bytes(gram, "little") * 0x9E3779B97F4A7C15 % 2**64
    word ^= word >> 31
    word = word * 0xBF58476D1CE4E5B9 % 2**64
    return (word >> 64 - mix.BITS) + (k << mix.BITS)


def grams(word):
    spaced = b" " + word + b" "
    return [cell(spaced[i : i + n], k) for k, n in enumerate(mix.ORDERS) for i in range(len(spaced) - max(n, 3) + 1)]


def plain_fit(p, active, steps=mix.STEPS):
    share = [1 / sum(active) if a else 0.0 for a in active]
    for _ in range(steps):
        total = [0.0] * len(share)
        for row in p:
            whole = sum(s * x for s, x in zip(share, row))
            total = [t + s * x / whole for t, s, x in zip(total, share, row)]
        share = [t / len(p) for t in total]
    return share, sum(math.log(sum(s * x for s, x in zip(share, row))) for row in p)


def plain_mix(text, model):
    logs = [[sum(float(model.logs[k, c]) for c in grams(w)) for k in range(len(model.languages))] for w in plain_words(text)]
    p = [[max(math.exp(x - max(row)), 1e-30) for x in row] for row in logs]
    cost = mix.PENALTY * math.log(max(len(p), 2))
    active = [True] * len(model.languages)
    alone = [sum(math.log(row[k]) for row in p) for k in range(len(active))]
    share, value = plain_fit(p, active)
    if value - max(alone) <= cost:
        best = alone.index(max(alone))
        return [float(k == best) for k in range(len(active))]
    while True:
        weakest = min((s, k) for k, s in enumerate(share) if active[k])[1]
        fewer = [a and k != weakest for k, a in enumerate(active)]
        next_, less = plain_fit(p, fewer)
        if value - less > cost:
            return share
        active, share, value = fewer, next_, less
        if sum(active) == 1:
            return share


def test_shares_equal_a_plain_twin(spark, model):
    docs = [r.text[:700] for r in table(spark, "/root/testdata/sf0.01", "documents").orderBy("doc_id").limit(40).collect() if r.text]
    by_lang = {}
    for r in table(spark, "/root/testdata/sf0.01", "documents").where("length(text) > 600").orderBy("doc_id").limit(200).collect():
        by_lang.setdefault(r.lang, r.text[:600])
    langs = sorted(by_lang)
    mixed = [by_lang[a] + "\n" + by_lang[b] for a in langs for b in langs if a < b] + [" ".join(by_lang.values())]
    texts = docs + mixed + ["a", "ÀÉx Öl", "x" * 100, "the die la " * 30]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: {x.lang: x.share for x in r.languages} for r in mix.predict(df, model).collect()}
    for i, text in enumerate(texts):
        want = plain_mix(text, model)
        assert [got[i].get(k, 0.0) for k in model.languages] == pytest.approx(want, abs=2e-4), text[:80]
    for i, t in enumerate(mixed):
        assert len(got[len(docs) + i]) >= 2


def test_counts_equal_a_plain_count(spark):
    rows = [("aa", "The the  thé!"), ("bb", "the"), ("aa", ""), ("bb", "É" * 30)]
    got = {(r.lang, r.cell): r.n for r in mix.count_ngrams(spark.createDataFrame(rows, "lang string, text string")).collect()}
    want = {}
    for lang, text in rows:
        for w in plain_words(text):
            for c in grams(w):
                want[lang, c] = want.get((lang, c), 0) + 1
    assert got == want


def test_more_languages_than_tables(spark, monkeypatch):
    monkeypatch.setattr(mix, "TABLES", 2)
    rows = [(f"l{i % 7}", "same words here") for i in range(50)]
    got = mix.count_ngrams(spark.createDataFrame(rows, "lang string, text string").coalesce(1)).groupBy("lang").agg(F.sum("n").alias("n")).collect()
    assert len(got) == 7 and sum(r.n for r in got) == 50 * sum(len(grams(w)) for w in (b"same", b"words", b"here"))


def test_held_out_rows(spark):
    got = entry.queries()["op11_language_mix"](spark, "/root/testdata/sf0.01").join(
        table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").collect()
    assert len(held) > 100 and np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert got.count() == table(spark, "/root/testdata/sf0.01", "documents").count()
    assert got.where("not score between 0 and 1 or score is null").count() == 0


def test_odd_rows(spark, model):
    rows = [(1, None), (2, ""), (3, " 12 *** \n"), (4, "\U0001f600。"), (None, "the and of"), (5, "语言"), (6, "x" * 300_000), (7, "the thing and that " * 20_000), (7, "the thing and that " * 20_000)]
    df = spark.createDataFrame([(i, t, "c", 1.0) for i, t in rows], "doc_id long, text string, lang_pred string, Score double")
    out = mix.predict(df, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "Score", "lang_pred_", "score_", "languages"]
    got = [(r.doc_id, r.lang_pred_, r.score_, len(r.languages)) for r in out.collect()]
    assert [g for g in got if g[1] == "und"] == [(i, "und", 0.0, 0) for i in (1, 2, 3, 4)]
    assert [g[1] for g in got if g[0] == 7] == ["en", "en"] and len(got) == 9 and all(0 <= g[2] <= 1 for g in got)


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mix.predict(empty, mix.train(empty, F.lit(True))).count() == 0
    docs = spark.createDataFrame([(1, "text", None, "s", 4), (2, None, "en", "s", 0)], SCHEMA)
    got = mix.predict(docs, mix.train(docs, F.lit(True))).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)] * 2


def test_one_language_learned(spark):
    docs = spark.createDataFrame([(1, "some text", "en", "s", 4)], SCHEMA)
    assert mix.predict(docs, mix.train(docs, F.lit(True))).first().lang_pred == "en"


def test_equal_hashes_do_not_merge_words(monkeypatch):
    monkeypatch.setattr(mix, "_LETTERS", np.zeros(256, np.uint64))
    data, start, length, _ = mix.words_of(np.array([0, 11]), np.frombuffer(b"one two one", np.uint8))
    out, own, same = mix.distinct_words(data, start, length)
    assert same.tolist() == [0, 1, 2] and bytes(out).startswith(b" one two one ")
