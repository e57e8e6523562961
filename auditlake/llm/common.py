"""Helpers that the operators share: reading tables, walking Arrow batches, checked sizes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a step looks at together; bounds the memory of numpy temporaries.
BLOCK_BYTES = 1 << 19
#: For steps that hand whole texts to Python: a batch lies in both processes, several times over while it is read.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """The wanted column name, with underscores appended while the input has such a column."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def by_name(df: DataFrame, name: str):
    """A column by its exact name, also if the name holds dots or other special characters."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1, starting at 0) and the UTF-8 bytes of a text column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and len(column) else np.empty(0, np.uint8)
    return at - at[0], raw[at[0] : at[-1]]


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about ``limit`` bytes of text each: whole rows, at least one."""
    at, _ = utf8(batch.column(column))
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def append_columns(
    df: DataFrame, text: str, added: list[tuple[str, T.DataType]], score: Callable, limit: int = BLOCK_BYTES
) -> DataFrame:
    """Rows of ``df`` with columns appended that ``score(offsets, bytes)`` computes per block of texts.

    One pass without a shuffle. ``score`` returns one Arrow array or list per added column.
    """
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in added)])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(t) for _, t in added]
        for whole in batches:
            names = [f"c{i}" for i in range(whole.num_columns)]
            whole = pa.RecordBatch.from_arrays(whole.columns, names=names)  # input names may repeat or clash
            for batch in blocks(whole, names[place], limit):
                values = score(*utf8(batch.column(place)))
                new = [v if isinstance(v, pa.Array) else pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=schema.names)

    return df.mapInArrow(run, schema)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of all elements of the given ranges, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(before - starts, lengths)


def char_starts(raw: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text begin a code point."""
    return (raw & 0xC0) != 0x80
