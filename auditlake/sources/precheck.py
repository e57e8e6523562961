"""Pre-check of uploads: what each file is, how many rows and keys it holds, what is wrong with it, and which keys the store knows.

Files are read as they lie, all of them in one distributed pass, so a broken one becomes a row with its error and the others go on.
Files over ``LARGE`` bytes would be too much for one task; they are read by ranges, which tell the same of a file as ``look`` does: kind, rows, keys
and errors don't depend on its size (see ``strict``). Keys are folded over all files before they meet the store, and the store's key index says
which of its files to open.
"""

from __future__ import annotations

import csv
import io
import itertools
import posixpath
import re
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake import schema as S
from auditlake.functions import parsing as P
from auditlake.operators import merges as M
from auditlake.session import materialize, settings
from auditlake.sources import ranges, strict
from auditlake.sources.exports import BOM, kind_of
from auditlake.sources.study_table import StudyTable

#: Bytes of a file that one task reads as a whole.
LARGE = 64 << 20
#: Keys of a file that a task remembers in order not to tell them again, and keys handed on together.
HELD_KEYS = 1 << 16
KEY_BATCH = 1 << 13
#: A file with its content is a batch of its own.
ONE_FILE = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1"}
TOTAL = -1
PARTS = "upload int, file string, kind string, missing string, rows long, error string, raw string"


def _lines(content: bytes | pa.Buffer) -> Iterator[list[str]]:
    text = io.TextIOWrapper(pa.BufferReader(content), encoding="utf-8-sig", newline="")
    return (line for line in csv.reader(text, strict=True) if line)


def _keys(content: bytes | pa.Buffer, at: int) -> Iterator[str]:
    """Keys of a file that is known to be sound; few of them repeat."""
    lines, seen = _lines(content), set()
    next(lines)
    for line in lines:
        if at < len(line) and line[at] not in seen:
            yield line[at]
            if len(seen) == HELD_KEYS:
                seen.clear()
            seen.add(line[at])


def _told(header: list[str]) -> tuple[str, str, int | None]:
    """(kind, missing columns, place of the key) by the header."""
    header = [header[0].lstrip(BOM), *header[1:]]
    kind, missing = kind_of(header)
    return kind, ",".join(missing), next((header.index(c) for c in S.SCORE_KEY_HEADERS if c in header), None)


def look(name: str, content: bytes | pa.Buffer) -> tuple[str, str, int, str | None, Iterable[str]]:
    """(kind, missing columns, rows, error, keys as text) of one file. It is read to its end first, and again for its keys, held line by line."""
    if not name.lower().endswith(".csv"):
        return "error", "", 0, "unsupported file type", []
    try:
        try:
            lines = _lines(content)
            header = next(lines, None)
            rows = sum(1 for _ in lines)
        except (UnicodeDecodeError, csv.Error):
            bytes(content).decode("utf-8")  # tells the place in the file, and comes before errors of CSV
            raise
        if header is None:
            return "error", "", 0, "empty file", []
        kind, missing, at = _told(header)
        return kind, missing, rows, None, [] if at is None else _keys(content, at)
    except UnicodeDecodeError as e:
        return "error", "", 0, f"not UTF-8 at byte {e.start}", []
    except csv.Error as e:
        return "error", "", 0, f"not CSV: {e}", []


def _decoded(path: str) -> str:
    return unquote(urlparse(path).path).rstrip("/")


def _hidden(name: str) -> bool:
    """Files and folders that Spark's readers pass over."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _parts(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """One row per file, and one per distinct key of a file. The driver lists the files; contents are read by tasks."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    roots: dict[str, int] = {}
    empty, large = [], {}  # files by path: one of two uploads is read once
    for i, p in enumerate(paths):
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        root = str(fs.makeQualified(path).toUri().getPath()).rstrip("/")
        roots.setdefault(root, i)
        files = fs.listFiles(path, True)
        while files.hasNext():
            status = files.next()
            file, at = status.getPath().toString(), str(status.getPath().toUri().getPath())
            if any(_hidden(n) for n in at[len(root) :].strip("/").split("/")):
                continue
            error = None if file.lower().endswith(".csv") else "unsupported file type"
            if not status.getLen():  # Spark's readers pass over files without bytes
                empty.append((i, file, "error", "", 0, error or "empty file", None))
            elif status.getLen() > LARGE and error:
                empty.append((i, file, "error", "", 0, error, None))
            elif status.getLen() > LARGE:
                large[at] = (file, status.getLen())

    def upload_of(at: str) -> int:
        while at not in roots and at:
            at = posixpath.dirname(at).rstrip("/")
        return roots[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(strict.FIELD)
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        names = [p.split()[0] for p in PARTS.split(", ")]
        for batch in batches:
            for file, place, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                file = file.as_py()
                kind, missing, rows, error, keys = look(posixpath.basename(file), content.as_buffer())
                upload = upload_of(_decoded(place.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((upload, file, kind, missing, rows, error, None), kinds, strict=True)], names=names)
                for some in itertools.batched(keys, KEY_BATCH):
                    n = len(some)
                    values = [[upload] * n, [file] * n, *[pa.nulls(n, k) for k in kinds[2:6]], some]
                    yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    parts = files.where(F.col("length") <= LARGE).select("path", "_metadata.file_path", "content").mapInArrow(run, PARTS)
    if empty:
        parts = parts.unionByName(spark.createDataFrame(empty, PARTS))
    return parts.unionByName(_large(spark, {at: (upload_of(at), *f) for at, f in large.items()})) if large else parts


def _large(spark: SparkSession, files: dict[str, tuple[int, str, int]]) -> DataFrame:
    """The same of CSV files too large for one task: (upload, name, bytes) by path. The driver holds a narrow row per range and reads the headers."""

    def lines(names: Sequence[str]) -> DataFrame:
        plain = [re.sub(r"([][{}*?\\])", r"\\\1", n) for n in names]  # names, not patterns
        return ranges._lines(spark, plain).withColumn("value", F.col("value").cast("binary"))

    with settings(spark, ranges.same_ranges(spark, [size for _, _, size in files.values()])):
        ends: dict[str, list] = {}
        for r in strict.range_ends(lines([f for _, f, _ in files.values()])).collect():
            ends.setdefault(_decoded(r["file"]), []).append(r)
        told, at, owners, uploads = [], {}, {}, []
        for path, (upload, file, _) in files.items():
            own = ends.get(path, [])
            found = strict.tell(own)
            if found.bad is not None:
                found.error = f"not UTF-8 at byte {found.bad + 3 * strict.has_mark(spark, file)}"
            if found.error:
                told.append((upload, file, "error", "", 0, found.error, None))
                continue
            kind, missing, column = _told(strict.first_record(spark, file))
            told.append((upload, file, kind, missing, found.rows - 1, None, None))
            if column is not None:
                name = own[0]["file"]
                at[name] = column
                owners |= {(name, block): owner for block, owner in found.owners.items()}
                uploads.append((upload, file, name))
        parts = spark.createDataFrame(told, PARTS)
        if not at:
            return parts
        cells = strict.cells(lines([f for _, f, _ in uploads]), at, owners)
    known = F.broadcast(spark.createDataFrame(uploads, "upload int, name string, file string"))  # of the size of the listing
    none = [F.lit(None).cast(k).alias(c) for c, k in (p.split() for p in PARTS.split(", ")) if c not in ("upload", "file", "raw")]
    return parts.unionByName(cells.join(known, "file").select("upload", F.col("name").alias("file"), *none, "raw"))


def precheck(table: StudyTable, paths: Sequence[str]) -> DataFrame:
    """``(upload, kind, missing, files, rows, accessions, new, existing, error)``: a row per upload and one (upload -1) over all.

    An upload is a file or a folder of files. A key in several files counts once per upload and once over all. Of a folder's kinds,
    missing columns and errors the first in name order are shown; rows of broken files don't count.
    """
    parts = _parts(table.spark, paths)
    with settings(table.spark, ONE_FILE):
        parts = materialize(parts, "precheck")
    keys = materialize(
        parts.where(F.col("raw").isNotNull()).select("upload", P.accession(F.col("raw")).alias(M.KEY)).where(F.col(M.KEY).isNotNull()).distinct(), "precheck-keys")
    every = materialize(keys.select(F.lit(TOTAL).alias("upload"), M.KEY).distinct(), "precheck-all-keys")
    known = table.rows_of(every).select(M.KEY, F.lit(True).alias("known"))
    counted = keys.unionByName(every).join(known, M.KEY, "left").groupBy("upload").agg(F.count("*").alias("accessions"), F.count("known").alias("existing"))
    files = parts.where(F.col("raw").isNull()).withColumn("upload", F.explode(F.array("upload", F.lit(TOTAL))))
    told = files.groupBy("upload").agg(
        F.min(F.struct("file", "kind", "missing")).alias("first"), F.count("*").alias("files"), F.sum("rows").alias("rows"),
        F.min(F.when(F.col("error").isNotNull(), F.struct("file", "error"))).alias("wrong"))
    over_all = F.col("upload") == TOTAL
    existing, accessions = (F.coalesce(c, F.lit(0)) for c in ("existing", "accessions"))
    return told.join(counted, "upload", "left").select(
        "upload", F.when(over_all, "all").otherwise(F.col("first.kind")).alias("kind"), F.when(over_all, "").otherwise(F.col("first.missing")).alias("missing"),
        "files", "rows", accessions.alias("accessions"), (accessions - existing).alias("new"), existing.alias("existing"),
        F.when(~over_all, F.col("wrong.error")).alias("error"),
    )
