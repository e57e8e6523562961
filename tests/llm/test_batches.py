"""Steps that hand whole texts to Python run with small Arrow batches."""

import pytest

from auditlake.llm import line_dedup, packing

RECORDS = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("module, step, run", [
    (line_dedup, "line-rows", line_dedup.repeated_lines), (packing, "pack-pieces", packing.pack)])
def test_texts_come_in_small_batches(spark, monkeypatch, module, step, run):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e")], "doc_id long, text string")
    seen, real = {}, module.materialize
    monkeypatch.setattr(module, "materialize", lambda df, name, **o: seen.setdefault(name, spark.conf.get(RECORDS)) and real(df, name, **o))
    before = spark.conf.get(RECORDS)
    run(docs)
    assert seen[step] == "1000" and spark.conf.get(RECORDS) == before
