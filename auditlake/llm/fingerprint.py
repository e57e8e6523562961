"""Document fingerprints by a homomorphic multiset hash, in SQL functions only.

Every paragraph (line) is hashed to a wide vector, and a text's fingerprint is the sum of its paragraphs' vectors modulo
2**62, lane by lane. The order of paragraphs does not matter, and a paragraph is inserted or deleted
by adding or subtracting its vector (``combine``, ``without``). The lanes of a paragraph's vector are

* 4 hashes of the whole paragraph, which settle equality,
* 21 lanes that hold three counters each: how many of the paragraph's word pairs have a given hash bit set, for 63 bits,
* the number of its word pairs.

The counters make unequal fingerprints comparable: twice a counter less the number of pairs is a
random projection of the text's pair counts, so the cosine of two such vectors estimates that of the pair counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from auditlake.llm.common import by_name
from auditlake.session import materialize

STRONG = 4
COUNTERS = 21
MODULUS_MASK = (1 << 62) - 1
_EVERY_21ST = 1 | 1 << 21 | 1 << 42


def _mask(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MODULUS_MASK))


def _add_hash(k: int):
    return lambda a, p: _mask(a + _mask(F.xxhash64(F.lit(k), p)))


def _add_bits(j: int):
    return lambda a, h: _mask(a + F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_EVERY_21ST)))


def vector(text: Column) -> Column:
    """The fingerprint of a text as an array of ``STRONG + COUNTERS + 1`` longs; null counts as empty.

    An empty text has no paragraph and gives zeros.
    """
    text = F.coalesce(text, F.lit(""))
    paragraphs = F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, "\n"))

    # Words and their successors: shifting the list by one and zipping avoids looking up each successor.
    def zipped(paragraph: Column) -> Column:
        words = F.split(paragraph, " ")
        return F.zip_with(words, F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.xxhash64(a, b))

    hashes = F.flatten(F.transform(paragraphs, zipped))
    strong = [F.aggregate(paragraphs, F.lit(0).cast("long"), _add_hash(k)) for k in range(STRONG)]

    def counts(hs: Column) -> list[Column]:
        return [F.aggregate(hs, F.lit(0).cast("long"), _add_bits(j)) for j in range(COUNTERS)]

    # The list of hashes is bound once, by a lambda over a list that holds it.
    counted = F.transform(F.array(hashes), lambda hs: F.array(*counts(hs), F.size(hs).cast("long")))[0]
    return F.concat(F.array(*strong), counted)


def combine(a: Column, b: Column) -> Column:
    """Fingerprint of all paragraphs of both."""
    return F.zip_with(a, b, lambda x, y: _mask(x + y))


def without(a: Column, b: Column) -> Column:
    """Fingerprint after deletion of the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: _mask(x - y))


def as_text(v: Column) -> Column:
    return F.array_join(F.transform(v, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 for equal fingerprints, else the cosine of the projections (not below 0)."""

    def projection(v: Column) -> Column:
        low = (1 << 21) - 1
        n = v[STRONG + COUNTERS]
        packed = F.slice(v, STRONG + 1, COUNTERS)
        each = F.transform(packed, lambda x: F.array(*(
            (F.shiftright(x, 21 * k).bitwiseAND(F.lit(low)) * 2 - n).cast("double") for k in range(3))))
        return F.flatten(each)

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda s, t: s * t), F.lit(0.0), lambda acc, s: acc + s)

    both = F.transform(F.array(F.struct(projection(a).alias("p"), projection(b).alias("q"))), lambda s: F.struct(
        dot(s["p"], s["q"]).alias("pq"), dot(s["p"], s["p"]).alias("pp"), dot(s["q"], s["q"]).alias("qq")))[0]
    cosine = F.transform(F.array(both), lambda s: F.when(
        (s["pp"] > 0) & (s["qq"] > 0), F.greatest(F.lit(0.0), F.least(F.lit(1.0), s["pq"] / F.sqrt(s["pp"] * s["qq"])))).otherwise(F.lit(0.0)))[0]
    return F.when(a == b, F.lit(1.0)).otherwise(cosine)


def next_documents(keys: DataFrame) -> DataFrame:
    """(doc_id, k, half) with the next row's doc_id and k by descending (doc_id, k); the last one's next is the first.

    Range partitions are numbered and written; the next row is found within each, and the last row of
    a partition takes the first of the following one from a list of one row per partition.
    """
    ranged = keys.repartitionByRange(F.desc_nulls_last("doc_id"), F.desc("k"))
    ranged = materialize(ranged.withColumn("pid", F.spark_partition_id()), "fingerprint-order")
    own = F.struct("doc_id", "k")
    inside = Window.partitionBy("pid").orderBy(F.desc_nulls_last("doc_id"), F.desc("k"))
    firsts = ranged.groupBy("pid").agg(F.max(own).alias("head"))  # one row per partition
    over = Window.orderBy("pid")
    top = F.first("head").over(over.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    firsts = firsts.select("pid", F.coalesce(F.lead("head").over(over), top).alias("following"))
    led = ranged.withColumn("follower", F.lead(own).over(inside)).join(F.broadcast(firsts), "pid")
    led = led.withColumn("n", F.coalesce("follower", "following"))
    return led.select("doc_id", "k", "half", F.col("n.doc_id").alias("next_id"), F.col("n.k").alias("next_k"))


def compare_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half comes from the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Rows with equal id and
    text count as one document and are listed as often as they occur; ties of the id are ordered by the text's hash,
    null ids come last. A single document is its own next one. An empty table gives no rows.
    """
    rows = docs.select(by_name(docs, doc_id).cast("long").alias("doc_id"), F.coalesce(by_name(docs, text).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("k", F.xxhash64("text")).withColumn("n_chars", F.length("text").cast("long"))
    keys = rows.groupBy("doc_id", "k").agg(F.expr("min(n_chars) div 2").alias("half"))
    order = materialize(next_documents(keys), "fingerprint-next")
    # ``i`` stands for a null id too, so that joins need no null-safe comparison.
    stand_in = lambda c: F.coalesce(F.col(c), F.lit(-(1 << 63)))
    wide = rows.select(stand_in("doc_id").alias("i"), "k", "doc_id", "text", "n_chars")
    prints = wide.select("i", "k", vector(F.col("text")).alias("v")).groupBy("i", "k").agg(F.first("v").alias("v"))
    prints = materialize(prints, "fingerprint-vectors")
    order = order.select(stand_in("doc_id").alias("i"), "k", "half", stand_in("next_id").alias("next_i"), "next_k")
    pairs = order.join(prints, ["i", "k"]).join(prints.select(F.col("i").alias("next_i"), F.col("k").alias("next_k"), F.col("v").alias("next_v")), ["next_i", "next_k"])
    pairs = materialize(pairs, "fingerprint-pairs")
    # A document as itself and as another's next one reads the same shuffle of texts by (i, k). For that both ask for the
    # same columns; and copies are counted by a running sum, since a filtered rank would be cut short before the shuffle.
    running = Window.partitionBy("i", "k").orderBy("doc_id", "n_chars").rowsBetween(Window.unboundedPreceding, 0)
    numbered = wide.withColumn("copy", F.sum(F.lit(1)).over(running))
    source = numbered.where(F.col("copy") == 1).join(
        pairs.select(F.col("next_i").alias("i"), F.col("next_k").alias("k"), F.col("i").alias("g_i"), F.col("k").alias("g_k"), "half"), ["i", "k"])
    given = source.select(F.col("g_i").alias("i"), F.col("g_k").alias("k"), "half", F.expr("substring(text, 1, int(half))").alias("given"))
    met = numbered.join(given, ["i", "k"]).join(pairs.select("i", "k", "v", "next_v"), ["i", "k"])
    edited = F.concat(F.expr("substring(text, 1, int(n_chars - half))"), "given")
    met = met.select("doc_id", "n_chars", "v", "next_v", edited.alias("edited"))
    met = met.select("doc_id", "n_chars", "v", "next_v", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), vector(F.col("edited")).alias("edited_v"))
    return met.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("v")).alias("fingerprint"), as_text(F.col("edited_v")).alias("edited_fingerprint"),
        likeness(F.col("v"), F.col("edited_v")).alias("near_edited"), likeness(F.col("v"), F.col("next_v")).alias("near_next"),
    )
