"""Row-local columns computed in Arrow batches, with every input column passed through."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType


def add_columns(df: DataFrame, fields: str, compute: Callable[[pa.RecordBatch], list[pa.Array]], slice_by: str | None = None) -> DataFrame:
    """``df`` with the columns of ``fields`` (a DDL string) computed per batch; no shuffle.

    A column of ``df`` that has the name of a new one is replaced by it. Batches are cut so that each holds some megabytes
    of the text column ``slice_by``.
    """
    new = StructType.fromDDL(fields)
    keep = [n for n in df.columns if n not in new.names]
    schema = StructType([df.schema[n] for n in keep] + new.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches, slice_by):
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in keep] + compute(batch), names=schema.names)

    return df.mapInArrow(run, schema)


def free_names(df: DataFrame, names: list[str]) -> list[str]:
    """The names, with underscores at the end of those that ``df`` has already (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def append_columns(df: DataFrame, fields: str, compute: Callable[[pa.RecordBatch], list[pa.Array]], drop: tuple[str, ...] = (), slice_by: str | None = None) -> DataFrame:
    """``df`` without ``drop`` and with the columns of ``fields`` behind it, computed per batch; no shuffle.

    All other columns of ``df`` stay as they are; a new name that is taken gets underscores (``free_names``). Batches are
    cut so that each holds some megabytes of the text column ``slice_by``.
    """
    new = StructType.fromDDL(fields)
    keep = [k for k, n in enumerate(df.columns) if n not in drop]
    names = [df.columns[k] for k in keep] + free_names(df.drop(*drop), new.names)
    schema = StructType([df.schema.fields[k] for k in keep] + [StructField(n, f.dataType) for n, f in zip(names[len(keep) :], new.fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _cut(batches, slice_by):
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in keep] + compute(batch), names=names)

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str, null: str | None = "") -> Iterator[str | None]:
    """The values of a text column one by one, NULL as ``null``."""
    for value in batch.column(column):
        text = value.as_py()
        yield null if text is None else text


def spans(column: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """(first row, rows) of pieces of some ``size`` bytes of a text column; a longer text is a piece of its own."""
    bytes_of = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, begin = np.cumsum(bytes_of), 0
    while begin < len(column):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + size, "right")))
        yield begin, end - begin
        begin = end


def _cut(batches: Iterator[pa.RecordBatch], slice_by: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if slice_by is None:
            yield batch
        else:
            yield from (batch.slice(*s) for s in spans(batch.column(slice_by)))
