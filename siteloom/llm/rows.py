"""Per-row work in Arrow batches: new columns beside carried ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Compute = Callable[..., list[list]]


def append_columns(
    df: DataFrame,
    inputs: list[str],
    fields: list[T.StructField],
    compute: Compute,
    carry: list[str] | None = None,
    keep: str | None = None,
) -> DataFrame:
    """``df`` with ``fields`` computed from the columns ``inputs``, a batch at a time.

    ``compute`` gets one list per input and returns one list per field. Only the columns
    ``carry`` go on (None: all); one with the name of a new field gives way to it. With ``keep``,
    rows where that new boolean is not true are left out and no new column is added."""
    new = {f.name for f in fields}
    kept = [c for c in (df.columns if carry is None else carry) if keep or c not in new]
    source = df.select(*dict.fromkeys([*kept, *inputs]))
    types = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(*[batch.column(c).to_pylist() for c in inputs])
            arrays = [pa.array(v, t) for v, t in zip(made, types, strict=True)]
            carried = [batch.column(c) for c in kept]
            if keep:
                chosen = arrays[names.index(keep)]
                yield pa.RecordBatch.from_arrays(carried, names=kept).filter(chosen)
            else:
                yield pa.RecordBatch.from_arrays([*carried, *arrays], names=[*kept, *names])

    out = [source.schema[c] for c in kept] + ([] if keep else fields)
    return source.mapInArrow(run, T.StructType(out))


def long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())
