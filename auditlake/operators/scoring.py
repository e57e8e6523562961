"""Dictionary codes and priority scores of extracted report findings, without Python and without a shuffle.

The dictionaries are small fixed lists, so they travel as literals inside the expression:
every report is encoded where it lies, however often a term repeats.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake import dictionaries as D
from auditlake import schema as S
from auditlake.functions.binding import bind, literal_rows, literals

MAX_DICTIONARY = 1000


def _entries(terms: Mapping[str, int]) -> Column:
    if len(terms) > MAX_DICTIONARY:
        raise ValueError(f"dictionary has {len(terms)} terms, more than a literal should hold")
    return literal_rows(("term", "size", "code"), [(t, len(t), i) for i, t in enumerate(terms)])


def exact_code(term: Column, terms: Sequence[str] | Mapping[str, int], case_insensitive: bool = False) -> Column:
    """0-based position of a term in its list, null if absent."""
    names = [t.lower() for t in terms] if case_insensitive else list(terms)
    probe = F.lower(term) if case_insensitive else term
    return F.nullif(F.array_position(literals(names), probe), F.lit(0)).cast("int") - 1


CLOSE = 2


def nearest_code(term: Column, terms: Mapping[str, int]) -> Column:
    """Position of the nearest term by edit distance; the earlier one wins a tie.

    Most misspellings are within two edits. A first round bounded to that distance is cheap and,
    if it finds a term, exact; only what it leaves open is compared without a bound. The
    difference in length bounds the distance from below, which spares most computations.
    """

    def too_long(best: Column, entry: Column) -> Column:
        return F.abs(F.length(term) - entry["size"]) >= best["distance"]

    def pair(distance: Column, code: Column) -> Column:
        return F.struct(distance.alias("distance"), code.alias("code"))

    def closer_within(best: Column, entry: Column) -> Column:
        distance = F.levenshtein(term, entry["term"], CLOSE)  # -1 beyond the bound
        nearer = bind(distance, lambda d: F.when((d >= 0) & (d < best["distance"]), pair(d, entry["code"])))
        return F.when(too_long(best, entry), best).otherwise(F.coalesce(nearer, best))

    def closer(best: Column, entry: Column) -> Column:
        found = pair(F.levenshtein(term, entry["term"]), entry["code"])
        return F.when(too_long(best, entry), best).otherwise(F.least(best, found))

    none = F.lit(-1)
    first = F.aggregate(_entries(terms), pair(F.lit(CLOSE + 1), none), closer_within)["code"]
    second = F.aggregate(_entries(terms), pair(F.lit(2**31 - 1), none), closer)["code"]
    code = bind(first, lambda c: F.when(c >= 0, c).otherwise(second))
    return F.when(term.isNotNull(), code)


def finding_code(term: Column, terms: Mapping[str, int] = D.FINDING_TERMS) -> Column:
    return F.coalesce(exact_code(term, terms), nearest_code(term, terms))


def priority_of(code: Column, terms: Mapping[str, int]) -> Column:
    return F.try_element_at(literals(terms.values()), code + 1)


def encode_findings(extraction: Column, case_insensitive: bool = False) -> Column:
    """Replace terms and attributes by codes. Only findings fall back to the nearest term."""
    findings = F.transform(
        extraction["findings_all"],
        lambda f: F.struct(
            finding_code(f["finding"]).alias("finding"),
            f["location"].alias("location"),
            f["system"].alias("system"),
            exact_code(f["temporal"], D.TEMPORAL_CODES).alias("temporal"),
            exact_code(f["uncertainty"], D.CERTAINTY_CODES).alias("uncertainty"),
        ),
    )
    devices = F.transform(
        extraction["devices_all"],
        lambda d: F.struct(
            exact_code(d["medical_device"], D.DEVICE_TERMS, case_insensitive).alias("medical_device"),
            exact_code(d["placement"], D.PLACEMENT_CODES).alias("placement"),
        ),
    )
    diagnoses = F.transform(
        extraction["diagnoses_all"],
        lambda d: F.struct(
            exact_code(d["diagnosis"], D.DIAGNOSIS_TERMS, case_insensitive).alias("diagnosis"),
            exact_code(d["temporal"], D.TEMPORAL_CODES).alias("temporal"),
        ),
    )
    return F.struct(
        findings.alias("findings_all"), devices.alias("devices_all"), diagnoses.alias("diagnoses_all")
    )


def _clamp(priority: Column) -> Column:
    return F.greatest(F.lit(1), F.least(priority, F.lit(5)))


def _drop_nulls(priorities: Column) -> Column:
    return F.filter(F.coalesce(priorities, F.array().cast("array<int>")), lambda p: p.isNotNull())


def priority_scores(encoded: Column, finding_temporal: bool = False, diagnosis_only_counts: bool = False) -> Column:
    """Priorities per item and per category, and the overall one.

    Uncertain findings and improving or stable diagnoses lose a point, malpositioned devices
    are 5. An empty category counts 1. The overall maximum needs a finding or a device unless
    ``diagnosis_only_counts``.
    """
    new, better, worse, stable = range(4)
    uncertain, malpositioned = 1, 2

    def finding(f: Column) -> Column:
        p = priority_of(f["finding"], D.FINDING_TERMS)
        if finding_temporal:
            p = p + F.when(f["temporal"].isin(new, worse), 1).when(f["temporal"].isin(better, stable), -1).otherwise(0)
        p = p - F.when(f["uncertainty"] == uncertain, 1).otherwise(0)
        return F.when(f["finding"].isNotNull(), _clamp(p))

    def device(d: Column) -> Column:
        p = priority_of(d["medical_device"], D.DEVICE_TERMS)
        return F.when(d["medical_device"].isNotNull(), F.when(d["placement"] == malpositioned, 5).otherwise(p))

    def diagnosis(d: Column) -> Column:
        p = priority_of(d["diagnosis"], D.DIAGNOSIS_TERMS)
        p = p - F.when(d["temporal"].isin(better, stable), 1).otherwise(0)
        return F.when(d["diagnosis"].isNotNull(), _clamp(p))

    items = F.struct(
        _drop_nulls(F.transform(encoded["findings_all"], finding)).alias("found"),
        _drop_nulls(F.transform(encoded["devices_all"], device)).alias("lines"),
        _drop_nulls(F.transform(encoded["diagnoses_all"], diagnosis)).alias("named"),
    )
    return bind(items, lambda i: _overall(i["found"], i["lines"], i["named"], diagnosis_only_counts))


def _overall(found: Column, lines: Column, named: Column, diagnosis_only_counts: bool) -> Column:
    counts = (F.size(found) > 0) | (F.size(lines) > 0)
    if diagnosis_only_counts:
        counts = counts | (F.size(named) > 0)
    one = F.array(F.lit(1))

    def or_one(items: Column) -> Column:
        return F.when(F.size(items) > 0, items).otherwise(one)

    return F.struct(
        or_one(found).alias("findings_priorities"),
        or_one(lines).alias("lines_priorities"),
        or_one(named).alias("diagnoses_priorities"),
        F.array_max(or_one(found)).alias("max_finding_priority"),
        F.array_max(or_one(lines)).alias("max_line_priority"),
        F.array_max(or_one(named)).alias("max_diagnosis_priority"),
        F.when(counts, F.array_max(F.concat(found, lines, named))).otherwise(1).alias("overall_max_priority"),
    )


def semi_algorithmic_grade(df: DataFrame, extraction: str = "extraction", **flags) -> DataFrame:
    """Encode and score an extraction column; adds the score fields and ``semialgo_grade``."""
    staged = df.withColumn("_encoded", encode_findings(F.col(extraction)))
    return (
        staged.withColumn("_score", priority_scores(F.col("_encoded"), **flags))
        .select(*df.columns, F.col("_score.*"), F.col("_score.overall_max_priority").alias("semialgo_grade"))
    )


def dictionary_extraction(text: Column) -> Column:
    """Offline stand-in for a model: every dictionary term contained in the text.

    Native and whole-text; attributes are ``not mentioned``. Case is ignored. The lowered text
    is bound once, since a lambda would lower it again for every term.
    """
    unknown = F.lit("not mentioned")

    def present(lowered: Column, terms: Mapping[str, int]) -> Column:
        names = literal_rows(("term", "low"), [(t, t.lower()) for t in terms])
        return F.transform(F.filter(names, lambda t: F.contains(lowered, t["low"])), lambda t: t["term"])

    def extract(lowered: Column) -> Column:
        return F.struct(
            F.transform(
                present(lowered, D.FINDING_TERMS),
                lambda t: F.struct(
                    t.alias("finding"), F.lit("").alias("location"), F.lit("").alias("system"),
                    unknown.alias("temporal"), unknown.alias("uncertainty"),
                ),
            ).alias("findings_all"),
            F.transform(
                present(lowered, D.DEVICE_TERMS),
                lambda t: F.struct(t.alias("medical_device"), unknown.alias("placement")),
            ).alias("devices_all"),
            F.transform(
                present(lowered, D.DIAGNOSIS_TERMS),
                lambda t: F.struct(t.alias("diagnosis"), unknown.alias("temporal")),
            ).alias("diagnoses_all"),
        )

    return bind(F.lower(text), extract)


def dictionary_findings(text: Column) -> dict[str, Column]:
    """Offline stand-in for detailed findings: 0/1 per finding named in the text."""
    lowered = F.lower(text)
    return {
        ("tb_llm" if f == "tuberculosis" else f"{f}_llm"): F.contains(lowered, F.lit(f.replace("_", " "))).cast("int")
        for f in S.FINDING_FIELDS
    }
