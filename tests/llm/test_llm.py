"""The training-data operators against brute force on small tables: nulls, empty texts, ties, clashing columns."""

import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
import oracle
from auditlake.session import materialize
from auditlake.llm import chat, components, decontam, fingerprint, line_dedup, packing, pii, quality, simhash, toxicity, url_filter

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(seed, n=60):
    r = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(r.integers(0, 40)) for i in r.integers(0, len(WORDS), n))


@pytest.fixture(scope="module")
def docs(spark):
    base = sentence(1, 200)
    texts = [base, base, base.replace("alpha", "Alpha", 1), base + " tail", None, "", "one two", "One  two\n", sentence(2), "ä" * 5000 + " ß", sentence(3, 8000)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(None, sentence(4), "en", "s", 0), (8, texts[8], "en", "s", 0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCS)


def fingerprint_of(text):
    words = (text or "").encode().lower().split()
    items = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in items]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_classes(spark, docs, empty):
    got = sorted(tuple(r) for r in simhash.simhash_classes(docs).where("doc_id is not null").collect())
    rows = [(r.doc_id, fingerprint_of(r.text)) for r in docs.where("doc_id is not null").collect()]
    low = {i: i for i, _ in rows}
    for _ in rows:
        for a, x in rows:
            for b, y in rows:
                if (x ^ y).bit_count() <= 3:
                    low[a] = low[b] = min(low[a], low[b])
    assert got == sorted((i, format(f, "016x"), low[i]) for i, f in rows)
    assert simhash.simhash_classes(empty).count() == 0


def test_close_pairs_and_forest():
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 40).astype(np.uint64)
    words = np.array([int(base[r.integers(40)]) ^ sum(1 << int(b) for b in r.integers(0, 64, r.integers(0, 4))) for _ in range(300)], np.uint64)[:, None]
    starts = np.array([0, 2, 130])
    got = {(int(i), int(j), int(d)) for part in simhash.close_pairs(words, starts, 3) for i, j, d in zip(*part)}
    want = set()
    for s, e in zip(starts, [*starts[1:], 300]):
        for i in range(s, e):
            for j in range(i + 1, e):
                d = (int(words[i, 0]) ^ int(words[j, 0])).bit_count()
                if d <= 3:
                    want.add((i, j, d))
    assert got == want
    i, _, _ = simhash.forest(300, simhash.close_pairs(words, starts, 3))
    assert 0 < len(i) < 300


def test_large_blocks_are_dealt_out(spark):
    ids = spark.range(50).select("id", F.lit(1).cast("long").alias("key"))
    dealt = simhash.deal(ids, chunk=8).select("id", "group").collect()
    groups = {}
    for i, g in dealt:
        groups.setdefault(g, set()).add(i)
    met = {(a, b) for g in groups.values() for a in g for b in g}
    assert len(met) == 2500


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 90), (100, 95), (7, 7)], "a long, b long")
    got = {r.id: r.component for r in components.connect(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, 90: 90, 95: 90, 100: 90}


def test_forest_tells_what_it_dropped():
    i, j = np.triu_indices(9, 1)
    a, b, dropped = simhash.forest(9, iter([(i, j, (i * 7 + j) % 5)]))
    assert len(a) == 8 and dropped.any()
    assert not simhash.forest(9, iter([(i[:8], j[:8], i[:8])]))[2].any()


def test_joining_pairs_find_the_classes_of_all_pairs():
    r = np.random.default_rng(3)
    rows = [np.unique(r.choice(40, r.integers(20, 32), replace=False)).astype(np.uint64) for _ in range(120)] + [np.empty(0, np.uint64)] * 2
    at = np.append(0, np.cumsum([len(x) for x in rows]))
    label = np.arange(len(rows)) // 2  # rows that are in one class beforehand
    i, j = np.triu_indices(len(rows), 1)
    joins = simhash.joining_pairs(label, iter([(i[:3000], j[:3000], j[:3000] % 7), (i[3000:], j[3000:], j[3000:] % 5)]), at, np.concatenate(rows), 0.7)
    similar = [(a, b) for a, b in zip(i, j) if len(np.intersect1d(rows[a], rows[b])) >= 0.7 * len(np.union1d(rows[a], rows[b])) - 1e-9]

    def classes(pairs):
        low = [min(np.flatnonzero(label == x)) for x in label]
        for _ in rows:
            for a, b in pairs:
                old, new = max(low[a], low[b]), min(low[a], low[b])
                low = [new if x == old else x for x in low]
        return low

    assert classes(joins) == classes(similar) and 1 < len(set(classes(similar))) < 61
    assert set(joins) <= set(similar) and len(joins) == 61 - len(set(classes(similar)))


def test_heavy_blocks_are_dealt_out(spark):
    ids = spark.range(20).select("id", F.lit(1).cast("long").alias("key"), F.lit(100).alias("n"))
    groups = {}
    for i, g in simhash.deal(ids, weight="n", heaviest=500).select("id", "group").collect():
        groups.setdefault(g, set()).add(i)
    assert len(groups) > 1 and len({(a, b) for g in groups.values() for a in g for b in g}) == 400


def test_near_duplicates_replace_links_that_fail(spark, monkeypatch):
    """Many texts around the bound: classes equal those of all pairs, though closest sketches often fail the check."""
    r = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(70):
        words = list(base)
        for at in r.choice(120, r.integers(1, 5), replace=False):
            words[at] = f"x{r.integers(0, 10**6)}"
        texts.append(" ".join(words))
    sets = [set(simhash.shingles(t.encode(), 5)) for t in texts]
    low = list(range(len(texts)))
    for _ in texts:
        for a, x in enumerate(sets):
            for b, y in enumerate(sets):
                if len(x & y) >= 0.8 * len(x | y):
                    low[a] = low[b] = min(low[a], low[b])
    assert 1 < len(set(low)) < len(low)
    rounds = []
    links = simhash._checked_links
    monkeypatch.setattr(simhash, "_checked_links", lambda *args: rounds.append(1) or links(*args))
    monkeypatch.setattr(simhash, "WIDE_RADIUS", 90)  # one block, no candidate lost to the sketch
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    first = {}
    for row in got:
        first[row.component] = min(first.get(row.component, row.first_id), row.first_id)
    assert [x for _, x in sorted((row.first_id, first[row.component]) for row in got)] == low
    assert rounds


def test_near_duplicates_keep_clean_documents(spark, docs):
    classes = {r.first_id: r.component for r in simhash.near_duplicates(docs).where("first_id is not null").collect()}
    assert classes[0] == classes[2] == classes[3]  # exact copy 1 has the text of 0
    assert len({classes[i] for i in (0, 6, 8, 9, 10)}) == 5


def test_packing_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    rows = packing.pack(docs).collect()
    tokenizer = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    ids = {r.doc_id: tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (len(part), zlib.crc32(part.tobytes()), len(ids[r.doc_id])) == (r.length, r.ids_crc32, r.doc_tokens)
    assert sum(r.length for r in rows) == sum(len(ids[r.doc_id]) for r in docs.collect())
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.LENGTH
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("text", ["a  b\n c", " x", "x ", "", "it's  'll\u00a0go", "a \u2003b", "\n\n a", "tab\tb  ", "x\u0085 y 12 34!?"])
def test_encoder_equals_tokenizer(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    texts = [text, "plain words here", text]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    cut, ids = packing.Encoder(packing.vocabulary_path()).encode(at, np.frombuffer(b"".join(raw), np.uint8))
    for k, t in enumerate(texts):
        assert ids[cut[k] : cut[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


END_OF_TEXT = "<|endoftext|>"


@pytest.mark.parametrize("text", [
    " <|endoftext|> x", END_OF_TEXT, END_OF_TEXT * 2, f"{END_OF_TEXT} {END_OF_TEXT}  {END_OF_TEXT}", f"a b  {END_OF_TEXT}  c", f" foo   {END_OF_TEXT}bar ",
    f"x\n {END_OF_TEXT}\n y", f" {END_OF_TEXT}", f"{END_OF_TEXT} ", "<|endof", "text|> y", f"<|endoftext{END_OF_TEXT}|>", f"é{END_OF_TEXT}é",
])
def test_encoder_gives_added_tokens_their_ids(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    texts = ["some <|endof", text, "text|> plain words", text, " x"]
    raw = [t.encode() for t in texts]
    at = np.cumsum([0, *map(len, raw)])
    cut, ids = packing.Encoder(packing.vocabulary_path()).encode(at, np.frombuffer(b"".join(raw), np.uint8))
    for k, t in enumerate(texts):
        assert ids[cut[k] : cut[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_patterns_meet_demand():
    r = np.random.default_rng(0)
    demand = r.integers(1, 500, 60)
    sizes = np.arange(1, 61)
    plan = packing.plan_patterns(demand, sizes, 64)
    assert (sum(p * t for p, t in plan) == demand).all()
    assert sum(t for _, t in plan) <= 1.03 * (demand * sizes).sum() / 64 + 60


def test_decontamination(spark, empty):
    item = sentence(11, 40)
    bench = spark.createDataFrame([(1, item), (2, "short"), (3, None), (None, item)], "item_id long, text string")
    edited = item.replace("a", "x", 3)
    rows = [(1, sentence(5) + " " + item.upper() + ". é", "", "", 0), (2, "é " + edited, "", "", 0), (3, sentence(6, 300), "", "", 0), (4, None, "", "", 0), (5, "", "", "", 0)]
    table = spark.createDataFrame(rows, DOCS).withColumn("leaks", F.lit(1))
    marked = {r[0]: r[1] for r in decontam.mark_leaks(table, bench).select("doc_id", "leaks_").collect()}
    assert [x.item_id for x in marked[1]] == [1] and marked[1][0].edits == 0
    a, b = marked[1][0].start, marked[1][0].end
    assert rows[0][1][a:b] == item.upper()
    assert [(x.item_id, x.edits, x.start) for x in marked[2]] == [(1, 3, 2)]
    assert not marked[3] and not marked[4] and not marked[5]
    assert decontam.mark_leaks(empty, bench).count() == 0
    assert not decontam.mark_leaks(table, bench.limit(0)).where(F.size("leaks_") > 0).count()


def test_decontamination_of_parts(spark, monkeypatch):
    lines = [sentence(k, 8) for k in range(70, 74)]
    long = sentence(75, 60)
    bench = spark.createDataFrame([(1, "\n".join(lines)), (2, long), (3, lines[3])], "item_id long, text string")
    part = "é " + lines[2].upper() + " é"
    edited = long[30:200].replace("a", "x", 2)
    rows = [(1, part), (2, "new words " + edited + " and more"), (3, "\n".join(lines)), (4, sentence(76, 300)), (5, long[30:70]), (6, "x " + lines[3])]
    table = spark.createDataFrame([(i, t, "", "", 0) for i, t in rows], DOCS)
    for limit in (decontam.MAX_INDEX_BYTES, 2000):  # one block and several
        monkeypatch.setattr(decontam, "MAX_INDEX_BYTES", limit)
        marked = {r.doc_id: sorted(r.leaks) for r in decontam.mark_leaks(table, bench).select("doc_id", "leaks").collect()}
        assert [(x.item_id, x.whole, x.edits) for x in marked[1]] == [(1, False, 0)]
        assert part[marked[1][0].start : marked[1][0].end] == lines[2].upper()
        assert [(x.item_id, x.whole) for x in marked[2]] == [(2, False)] and marked[2][0].end - marked[2][0].start >= decontam.STRETCH
        assert [(x.item_id, x.whole) for x in marked[3]] == [(1, True), (3, True)]
        assert not marked[4] and not marked[5]
        assert [(x.item_id, x.whole) for x in marked[6] if x.whole] == [(3, True)]


def test_pipeline_finds_items_cut_by_line_dedup(spark, tmp_path):
    lines = [sentence(k, 8) for k in range(80, 84)]
    item = "\n".join(lines)
    rows = [(1, "Words before. " + item), (2, "Other words. " + item), (3, sentence(85, 80))]
    table = spark.createDataFrame([(i, t, "", "", len(t)) for i, t in rows], DOCS)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = corpus_pipeline.drop_repeated_lines(spark, table, str(tmp_path))
    assert item not in {r.doc_id: r.text for r in left.collect()}[2]
    assert [r.doc_id for r in corpus_pipeline.drop_leaks(spark, left, str(tmp_path)).collect()] == [3]


def test_line_dedup_against_sql(spark):
    df = entry.queries()["op8_line_dedup"](spark, SF)
    assert oracle.differences(df, oracle.connect(SF), entry.oracle_sql()["op8_line_dedup"]) == []


def test_drop_lines(spark, empty):
    line = sentence(7, 12)
    words = line.split()
    near = " ".join([*words[:5], "new", *words[6:]])
    rows = [(1, line, "", "", 0), (2, "first of its kind\n" + line, "", "", 0), (3, near, "", "", 0), (4, "a\n" + near + " more", "", "", 0), (5, None, "", "", 0), (6, "", "", "", 0)]
    table = spark.createDataFrame(rows, DOCS).withColumn("place", F.lit("x"))
    left = {r.doc_id: r.text for r in line_dedup.drop_lines(table, line_dedup.repeated_lines(table)).collect()}
    assert left == {1: line, 2: "first of its kind", 4: "a", 5: None, 6: ""}
    assert line_dedup.repeated_lines(empty).count() == 0


def test_fingerprints(spark, docs, empty):
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in fingerprint.compare_edits(rows).collect()}
    texts = sorted(((r.doc_id, r.text or "") for r in rows.collect()), reverse=True)
    for k, (i, text) in enumerate(texts):
        following = texts[(k + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == len(text)
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[0].fingerprint == got[1].fingerprint != got[2].fingerprint and got[1].near_next == 1.0
    assert fingerprint.compare_edits(docs).count() == docs.count() and fingerprint.compare_edits(empty).count() == 0
    one = spark.range(1).select(fingerprint.vector(F.lit("a b\nc d e")).alias("x"), fingerprint.vector(F.lit("c d e\na b")).alias("y"), fingerprint.vector(F.lit("a b")).alias("a"), fingerprint.vector(F.lit("c d e")).alias("c"))
    r = one.select("x", "y", "a", fingerprint.combine(F.col("a"), F.col("c")).alias("s"), fingerprint.without(F.col("x"), F.col("c")).alias("d")).first()
    assert r.x == r.y == r.s and r.d == r.a


def test_chat_round_trip(spark):
    nasty = "\\[INST]</s>\\\\ [/INST] <\\s>"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (None, 3, None, None), (2, None, "tool", "x"), (2, None, "tool", "x"), (1, 2, "assistant", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(table)).collect()}
    turns = [("user", nasty), ("assistant", nasty), ("assistant", "")]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    assert got[1].loss_sha256 == hashlib.sha256(nasty.encode()).hexdigest() and got[1].loss_chars == len(nasty)
    assert got[2].n_turns == 2 and got[None].n_turns == 1
    assert not any(c in chat.escape(nasty) for c in chat.CONTROL)
    with pytest.raises(chat.RewritesHistory):
        list(chat.turn_pieces(iter([("user", "a"), ("user", "b")]), chat.Template(lambda t: f"{len(t)}:" + "".join(x for _, x in t) if t else "")))


def test_pii_base_kinds():
    anchors = pii.automaton()
    text = "a@b@c.com x.y@z.org. 1.2.3.4.5.6.7.8 300.1.1.1 c 4111 1111-1111 1111 +1 (555) 010-9999 +12 é@é token = \"abcdefgh12345\" IBAN DE89 3704 0044 0532 0130 00 https://me:pw@host.org/"
    got = pii.spans_of(text, anchors)
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    want = [("email", *m.span()) for m in re.finditer(patterns["email"], text)]
    want += [("ip", *m.span()) for m in re.finditer(patterns["ip"], text) if all(int(p) <= 255 for p in m[0].split("."))]
    assert [s for s in got if s[0] in patterns] == want
    kinds = {k: text[a:b] for k, a, b in got}
    assert kinds["card"] == "4111 1111-1111 1111" and kinds["phone"] == "+1 (555) 010-9999"
    assert kinds["iban"] == "DE89 3704 0044 0532 0130 00" and kinds["secret"] == "abcdefgh12345" and kinds["login"] == "me:pw"


@pytest.mark.parametrize("lead", ["", " of the account holder named in the contract: ", ": XX99 0000 1111 2222 or rather ", ": AB12C, ", " " * 58, ": DE89 3704 0044 0532 0130 01, "])
def test_iban_anywhere_behind_its_cue(lead):
    number = "DE89 3704 0044 0532 0130 00"
    text = f"IBAN {lead}{number} and GB82 WEST 1234 5698 7654 32"
    got = [text[a:b] for k, a, b in pii.spans_of(text, pii.automaton()) if k == "iban"]
    assert got == [number]
    text = "iban DE89370400440532013000 then iban GB82 WEST 1234 5698 7654 32."
    assert [text[a:b] for k, a, b in pii.spans_of(text, pii.automaton()) if k == "iban"] == ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"]


@pytest.mark.parametrize(("name", "label"), [("op9_toxicity", "toxic"), ("op7_quality", "quality")])
def test_classifiers_on_held_out_rows(spark, name, label):
    sf = "/root/testdata/sf0.01"
    scored = entry.queries()[name](spark, sf)
    rows = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hits = sum(r.predicted == r[label] for r in rows) / len(rows)
    base = max(sum(r[label] == v for r in rows) / len(rows) for v in (0, 1))
    assert hits >= max(0.9, base) and scored.count() == 1000


def test_models_without_labels_score_everything(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        got = module.score_texts(docs, module.train(docs, none)).collect()
        assert len(got) == docs.count() and all(0 <= r[-1] <= 1 for r in got)


def test_url_rules(spark):
    urls = {1: "http://A.Net/x?y", 2: "https://www.example.net/en/1", 3: "http://x.example.com/de/a#b", 4: "ftp://b.org/fr/", 5: None, 6: "no scheme",
            7: "http://casino-win.example.com/en/1", 8: "http://blog.thering.example.com/en/1", 9: "http://a.net", 10: "http://badnet/"}
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(urls.items()), "page_id long, url string")).collect()}
    assert [(got[i].rule, got[i].verdict) for i in (1, 2, 3, 4)] == [
        ("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
    assert got[1].host == "a.net" and got[1].path == "/x" and got[5].host == got[6].host == got[5].path == ""
    assert got[7].verdict == "block" and got[8].verdict == "allow" and got[9].rule is None and got[10].rule is None


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns and left.dtypes == docs.dtypes
        assert 0.7 * docs.count() <= left.count() <= docs.count(), name
        docs = materialize(left, "stage")
    assert corpus_pipeline.run(spark, SF).count() >= docs.count()
