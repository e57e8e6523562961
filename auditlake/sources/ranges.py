"""Large quoted CSV files, read by many tasks.

A line break inside quotes does not end a record, so a reader that starts in the middle of a file cannot know where
records begin. Here the text source cuts files into byte ranges of whole lines, and three steps find the records:

1. every range is walked once for both cases, that it begins outside and that it begins inside quotes: how does it end then,
   and does a record that is open at its end begin in it;
2. those outcomes, one narrow row per range, are combined along each file, so every range's true beginning is known;
3. every range is walked again and cut into records. The pieces of a record that crosses ranges are put together by a
   group of its own; all other records stay where they are.

The records are written once (they are read several times afterwards, and parsing them again costs more than reading Parquet) and
parsed by Spark's CSV expression with the options of the one-task reader.

Quotes are those of RFC 4180: a field is quoted if its first character is a quote, a doubled quote is a quote, and a quote inside a field
that isn't quoted is text. A closing quote that is followed by more text leaves the field to run to the next delimiter or the line's end.
Lines end with LF or CRLF. Null, empty and header-only files give no rows; more cells than the header are cut, missing ones are null.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from auditlake.session import materialize

#: Where a record came from, next to its text.
PLACE = ("file", "block", "row")
BOM = "﻿"

_CLOSE = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
_QUOTED = re.compile(r'(?:^|,)"')

ENDS = "file string, block long, out_open boolean, out_begins boolean, in_open boolean, in_begins boolean, crlf boolean"
RECORDS = "file string, block long, row long, part long, record string"


def leaves_open(line: str, inside: bool) -> bool:
    """Whether quotes are open at the end of a line that begins inside or outside of quotes."""
    at = 0
    while True:
        if not inside:
            start = _QUOTED.search(line, at)
            if start is None:
                return False
            at = start.end()
        close = _CLOSE.match(line, at)
        if close is None:
            return True
        at, inside = line.find(",", close.end()), False
        if at < 0:
            return False


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """((file, first byte), lines) of stretches of one range each; a range may come in several stretches."""
    for batch in batches:
        files, blocks, lines = (batch.column(i) for i in range(3))
        n = batch.num_rows
        if not n:
            continue
        turn = pc.or_(pc.not_equal(files.slice(1), files.slice(0, n - 1)), pc.not_equal(blocks.slice(1), blocks.slice(0, n - 1)))
        starts = [0, *(np.flatnonzero(turn.to_numpy(zero_copy_only=False)) + 1).tolist(), n]
        for i, j in itertools.pairwise(starts):
            yield (files[i].as_py(), blocks[i].as_py()), lines.slice(i, j - i)


def range_ends(lines: DataFrame) -> DataFrame:
    """Per range, for a beginning outside and inside quotes: is a record open at its end, and does that record begin in the range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in ENDS.split(", ")]
        key, now, begins, crlf = None, [], [], False

        def row() -> pa.RecordBatch:
            values = (*key, now[0], begins[0], now[1], begins[1], crlf)
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=names)

        for place, stretch in _stretches(batches):
            if place != key:
                if key:
                    yield row()
                key, now, begins, crlf = place, [False, True], [False, False], place[1] == 0 and stretch[0].as_py().endswith("\r")
            for line in stretch.filter(pc.match_substring(stretch, '"')).to_pylist():  # other lines change nothing
                after = {was: leaves_open(line, was) for was in set(now)}
                begins = [after[was] and (begins[k] or not was) for k, was in enumerate(now)]
                now = [after[was] for was in now]
        if key:
            yield row()

    return lines.mapInArrow(run, ENDS)


def told_ranges(ends: DataFrame) -> DataFrame:
    """(file, block, owner, crlf) of the ranges that begin inside a record, with the range in which that record begins, and of
    first ranges whose file ends its lines with CRLF.

    A range keeps the state, turns it or fixes it. What a range begins with is the value last fixed before it, turned as often as
    the ranges since then turn it.
    """
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    turn = F.when(F.col("out_open") & ~F.col("in_open"), 1).otherwise(0)
    fixed = F.col("out_open") == F.col("in_open")
    told = ends.withColumns({"turns": F.coalesce(F.sum(turn).over(before), F.lit(0)), "turns_through": F.sum(turn).over(through)})
    value = F.coalesce(F.last(F.when(fixed, F.col("out_open")), ignorenulls=True).over(before), F.lit(False))
    since = F.col("turns") - F.coalesce(F.last(F.when(fixed, F.col("turns_through")), ignorenulls=True).over(before), F.lit(0))
    told = told.withColumn("inside", value != (since % 2 == 1))
    owns = F.when(F.col("inside"), F.col("in_open") & F.col("in_begins")).otherwise(F.col("out_open") & F.col("out_begins"))
    told = told.withColumn("owner", F.last(F.when(owns, F.col("block")), ignorenulls=True).over(before))
    return told.where(F.col("inside") | F.col("crlf")).select("file", "block", F.when(F.col("inside"), F.col("owner")).alias("owner"), "crlf")


def cut_records(lines: DataFrame, owners: dict[tuple[str, int], int], crlf: set[str]) -> DataFrame:
    """Records of all ranges: whole ones have no ``part``; pieces carry the range they come from and the place of their record.

    In files that end lines with CRLF, line breaks inside records become LF, as in the one-task reader.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in RECORDS.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
        key, owner, row, held = None, None, 0, []

        def pieces() -> list[tuple]:
            """What is open at the end of a range."""
            if not held:
                return []
            return [(key[0], key[1], row, key[1], "\n".join(held)) if owner is None else (key[0], owner, None, key[1], "\n".join(held))]

        def batch(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        def plain(lines: pa.Array) -> pa.RecordBatch:
            """Lines that all are records, empty ones apart."""
            if key[0] in crlf:
                lines = pc.replace_substring_regex(lines, "\r$", "")
            lines = lines.filter(pc.not_equal(lines, ""))
            n = len(lines)
            place = [pa.repeat(pa.scalar(v, k), n) for v, k in zip(key, kinds[:2], strict=True)]
            return pa.RecordBatch.from_arrays([*place, pa.array(np.arange(row, row + n)), pa.nulls(n, kinds[3]), lines], names=names)

        for place, stretch in _stretches(batches):
            out = []
            if place != key:
                out += pieces()
                key, row, held = place, 0, []
                owner = owners.get(place)
                inside = owner is not None
            if not held and owner is None and not pc.any(pc.match_substring(stretch, '"')).as_py():
                yield batch(out)
                found = plain(stretch)
                row += found.num_rows
                yield found
                continue
            for line in stretch.to_pylist():
                if line.endswith("\r") and place[0] in crlf:
                    line = line[:-1]
                if not held and owner is None and not line:
                    continue
                held.append(line)
                inside = leaves_open(line, inside) if '"' in line else inside
                if not inside:
                    if owner is None:
                        out.append((key[0], key[1], row, None, "\n".join(held)))
                        row += 1
                    else:
                        out += pieces()
                        owner = None
                    held = []
            yield batch(out)
        yield batch(pieces())

    return lines.mapInArrow(run, RECORDS)


def read_records(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, block, row, record) of CSV files, header records included, empty lines left out.

    ``block`` is the range in which a record begins and ``row`` its number there, so both give the order within a file. The driver holds one entry
    per range that begins inside a record and per CRLF file; Spark's own plan holds one per range.
    """
    lines = _lines(spark, paths)
    told = told_ranges(range_ends(lines)).collect()
    owners = {(r["file"], r["block"]): r["owner"] for r in told if r["owner"] is not None}
    cut = materialize(cut_records(lines, owners, {r["file"] for r in told if r["crlf"]}), "csv-records", compression="zstd")
    whole = cut.where(F.col("part").isNull()).drop("part")
    parts = F.array_sort(F.collect_list(F.struct("part", "record")))
    joined = cut.where(F.col("part").isNotNull()).groupBy("file", "block").agg(
        F.max("row").alias("row"), F.concat_ws("\n", F.transform(parts, lambda p: p["record"])).alias("record"))
    return whole.unionByName(joined)


def parse_records(records: DataFrame, header: Sequence[str], **options) -> DataFrame:
    """(file, block, row) and the columns of the header as text. Each file's first record is its header and is left out."""
    names = [f"c{i}" for i in range(len(header))]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    settings = {"quote": '"', "escape": '"', "multiLine": "true", **{k: str(v).lower() for k, v in options.items()}}
    body = records.where((F.col("block") > 0) | (F.col("row") > 0))
    value = F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), settings)
    parsed = body.select(*PLACE, value.alias("v"))
    return parsed.select(*PLACE, *[F.col(f"v.{n}").alias(h) for n, h in zip(names, header, strict=True)])


def _bytes(spark: SparkSession, key: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(f"spark.sql.files.{key}"))


def same_ranges(spark: SparkSession, sizes: Sequence[int]) -> dict[str, str]:
    """Settings under which files of these sizes are cut alike however many of them are read together and whatever executors come or go.

    Spark cuts by the bytes of all files for each core; here that is worked out once.
    """
    cost = _bytes(spark, "openCostInBytes")
    cores = int(spark.conf.get("spark.sql.files.minPartitionNum", None) or spark.sparkContext.defaultParallelism)
    most = min(_bytes(spark, "maxPartitionBytes"), max(cost, sum(n + cost for n in sizes) // cores))
    return {"spark.sql.files.maxPartitionBytes": f"{max(1, most)}b", "spark.sql.files.minPartitionNum": "1"}


def would_cut(spark: SparkSession, paths: Sequence[str]) -> bool:
    """Whether Spark may cut any of the files into ranges: a file at most as long as the cost of opening one never is."""
    least = _bytes(spark, "openCostInBytes")
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        for status in path.getFileSystem(conf).globStatus(path) or []:
            files = path.getFileSystem(conf).listFiles(status.getPath(), True)
            while files.hasNext():
                if files.next().getLen() > least:
                    return True
    return False
