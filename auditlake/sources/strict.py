"""Large CSV files checked as strictly as small ones, by ranges.

What ``csv.reader(strict=True)`` says of a file in one piece is found here from its byte ranges (see ``ranges``): rows, the first place that
is not UTF-8, a closing quote that no delimiter follows, a quote left open, and the cells of the key column. A range is walked for both
beginnings, outside and inside of quotes; the driver combines one narrow row per range, and a second walk takes the cells out. Lines without quotes and
stray line breaks, most of them, are handled as whole Arrow columns.
"""

from __future__ import annotations

import csv
import io
import itertools
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.session import materialize
from auditlake.sources import ranges

#: The largest field that the csv module can be told to take.
FIELD = (1 << 31) - 1
NO_DELIMITER, NO_END = "not CSV: ',' expected after '\"'", "not CSV: unexpected end of data"

_CLOSE = re.compile(r'[^"]*+(?:""[^"]*+)*+"')
_STOP = re.compile(r"[,\r]")

ENDS = "file string, block long, bytes long, bad long, " + ", ".join(
    f"{was}_open boolean, {was}_begins boolean, {was}_rows long, {was}_broken boolean" for was in ("out", "in"))
CELLS = "file string, owner long, part long, raw string"


def read_line(line: str, inside: bool) -> tuple[bool, list[tuple[int, int]], int, bool]:
    """(quotes are open at the end, records that end in the line, where the open one begins, a closing quote is followed by text).

    A carriage return outside of quotes ends a record, too; empty records are none.
    """
    at = start = 0
    ended, fields = [], inside
    while True:
        if inside or line[at : at + 1] == '"':
            close = _CLOSE.match(line, at if inside else at + 1)
            if close is None:
                return True, ended, start, False
            at, inside, fields = close.end(), False, True
            if line[at : at + 1] not in ("", ",", "\r"):
                return False, ended, start, True
        else:
            stop = _STOP.search(line, at)
            at = len(line) if stop is None else stop.start()
        if line[at : at + 1] == ",":
            at, fields = at + 1, True
            continue
        if fields or at > start:
            ended.append((start, at))
        if at == len(line):
            return False, ended, at, False
        at = start = at + 1
        fields = False


def _special(lines: pa.Array) -> np.ndarray:
    """Lines that must be read by character: with quotes, or with a carriage return before their end."""
    odd = pc.match_substring(lines, '"')
    if pc.any(pc.match_substring(lines, "\r")).as_py():
        odd = pc.or_(odd, pc.match_substring_regex(lines, r"\r."))
    return odd.to_numpy(zero_copy_only=False)


class _Walk:
    """A range walked from one beginning."""

    def __init__(self, inside: bool):
        self.open, self.begins, self.rows, self.broken = inside, False, 0, False

    def go(self, special: Sequence[tuple[int, str]], plain: np.ndarray) -> None:
        """``plain``: rows among the first n lines, the special ones apart."""
        at = 0
        for i, line in special:
            if self.broken:
                return
            self.rows += 0 if self.open else int(plain[i] - plain[at])
            was, at = self.open, i + 1
            self.open, ended, _, self.broken = read_line(line, was)
            self.rows += len(ended)
            self.begins = self.open and (self.begins or not was or bool(ended))
        if not self.open and not self.broken:
            self.rows += int(plain[-1] - plain[at])


def range_ends(lines: DataFrame) -> DataFrame:
    """Per range its bytes, the first that is no UTF-8, and for both beginnings: how it ends, rows that end in it, whether it is broken."""
    names = [p.split()[0] for p in ENDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size, bad, walks = None, 0, None, []

        def row() -> pa.RecordBatch:
            values = [*key, size, bad, *itertools.chain(*((w.open, w.begins, w.rows, w.broken) for w in walks))]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), *[pa.bool_(), pa.bool_(), pa.int64(), pa.bool_()] * 2]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        for place, stretch in ranges._stretches(batches):
            if place != key:
                if key:
                    yield row()
                key, size, bad, walks = place, 0, None, [_Walk(False), _Walk(True)]
            if bad is None:
                try:
                    text = stretch.cast(pa.string())
                except pa.ArrowInvalid:
                    bad = size + _first_bad(stretch)
                else:
                    special = _special(text)
                    at = np.flatnonzero(special)
                    found = list(zip(at.tolist(), text.take(pa.array(at)).to_pylist(), strict=True))
                    blank = pc.is_in(text, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
                    plain = np.concatenate([[0], np.cumsum(~special & ~blank)])
                    for walk in walks:
                        walk.go(found, plain)
            size += (pc.sum(pc.binary_length(stretch)).as_py() or 0) + len(stretch)
        if key:
            yield row()

    return lines.mapInArrow(run, ENDS)


def _first_bad(lines: pa.Array) -> int:
    at = 0
    for line in lines:
        line = line.as_py()
        try:
            line.decode("utf-8")
        except UnicodeDecodeError as e:
            return at + e.start
        at += len(line) + 1
    raise AssertionError("every line is UTF-8")


@dataclass
class Told:
    """What a file's ranges say together; ``owners``: by range that begins inside of a record, the range in which that record begins."""

    rows: int
    error: str | None
    bad: int | None
    owners: dict[int, int]


def tell(ends: Sequence) -> Told:
    """From the rows of one file's ranges. The first byte that is no UTF-8 comes before errors of CSV, wherever it is."""
    inside, owner, rows, size, error, bad, owners = False, None, 0, 0, None, None, {}
    for r in sorted(ends, key=lambda r: r["block"]):
        if r["bad"] is not None:
            bad = size + r["bad"]
            break
        size += r["bytes"]
        if error:
            continue
        was = "in" if inside else "out"
        if inside:
            owners[r["block"]] = owner
        rows += r[f"{was}_rows"]
        if r[f"{was}_broken"]:
            error = NO_DELIMITER
        if r[f"{was}_begins"]:
            owner = r["block"]
        inside = r[f"{was}_open"]
    if bad is None and not error:
        error = NO_END if inside else None if rows else "empty file"
    return Told(rows, error, bad, owners)


def cells(lines: DataFrame, at: Mapping[str, int], owners: Mapping[tuple[str, int], int]) -> DataFrame:
    """``(file, raw)``: the cells of a column, ``at`` by file, of sound files. The header's own is among them."""
    names = [p.split()[0] for p in CELLS.split(", ")]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]

    def of(record: str, column: int) -> list[str]:
        line = next(csv.reader(io.StringIO(record, newline=""), strict=True))
        return line[column : column + 1]

    def batch(file: str, owner: int | None, part: int | None, raw) -> pa.RecordBatch:
        raw = raw if isinstance(raw, pa.Array) else pa.array(raw, pa.string())
        return pa.RecordBatch.from_arrays([pa.array([v] * len(raw), k) for v, k in zip((file, owner, part), kinds)] + [raw], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(FIELD)
        key, inside, owner, held = None, False, None, []

        def piece() -> pa.RecordBatch:
            return batch(key[0], key[1] if owner is None else owner, key[1], ["\n".join(held)])

        for place, stretch in ranges._stretches(batches):
            if place != key:
                if held:
                    yield piece()
                key, held, owner = place, [], owners.get(place)
                inside, column = owner is not None, at[place[0]]
            text, found, done = stretch.cast(pa.string()), [], 0
            special = _special(text)
            outside = np.zeros(len(text), bool)
            where = np.flatnonzero(special)
            for i, line in zip([*where.tolist(), len(text)], [*text.take(pa.array(where)).to_pylist(), None], strict=True):
                if inside:
                    held += text.slice(done, i - done).to_pylist()
                else:
                    outside[done:i] = True
                done = i + 1
                if line is None:
                    continue
                now, ended, begin, _ = read_line(line, inside)
                for first, last in ended:
                    held.append(line[first:last])
                    if inside and owner is not None:
                        yield piece()
                        owner = None
                    else:
                        found += of("\n".join(held), column)
                    inside, held = False, []
                if now:
                    held.append(line[begin:])
                inside = now
            plain = text.filter(pa.array(outside))
            if pc.any(pc.ends_with(plain, "\r")).as_py():
                plain = pc.replace_substring_regex(plain, "\r$", "")
            parts = pc.split_pattern(plain.filter(pc.not_equal(plain, "")), ",", max_splits=column + 1)
            parts = parts.filter(pc.greater(pc.list_value_length(parts), column))
            yield batch(key[0], None, None, pc.unique(pc.list_element(parts, column)))
            yield batch(key[0], None, None, list(dict.fromkeys(found)))
        if held:
            yield piece()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(FIELD)
        for some in batches:
            for file, record in zip(*(some.column(i).to_pylist() for i in range(2)), strict=True):
                raw = of(record, at[file])
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(raw), pa.string()), pa.array(raw, pa.string())], names=["file", "raw"])

    cut = materialize(lines.mapInArrow(run, CELLS), "strict-cells", compression="zstd")
    pieces = F.array_sort(F.collect_list(F.struct("part", "raw")))
    crossing = cut.where(F.col("part").isNotNull()).groupBy("file", "owner").agg(F.concat_ws("\n", F.transform(pieces, lambda p: p["raw"])).alias("record"))
    return cut.where(F.col("part").isNull()).select("file", "raw").unionByName(crossing.select("file", "record").mapInArrow(whole, "file string, raw string"))


class _Stream(io.RawIOBase):
    """A file of any Hadoop store."""

    def __init__(self, spark: SparkSession, path: str):
        path = spark._jvm.org.apache.hadoop.fs.Path(path)
        self._in = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(path)

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        got = self._in.readNBytes(len(buffer))
        buffer[: len(got)] = got
        return len(got)

    def close(self) -> None:
        if not self.closed:
            self._in.close()
        super().close()


def first_record(spark: SparkSession, path: str) -> list[str]:
    """The header of a sound file; the driver reads as far as that goes."""
    csv.field_size_limit(FIELD)
    with io.TextIOWrapper(io.BufferedReader(_Stream(spark, path), 1 << 16), encoding="utf-8-sig", newline="") as text:
        return next(line for line in csv.reader(text, strict=True) if line)


def has_mark(spark: SparkSession, path: str) -> bool:
    """Whether a byte-order mark, which the text source leaves out, begins the file."""
    with _Stream(spark, path) as raw:
        return raw.read(3) == b"\xef\xbb\xbf"
