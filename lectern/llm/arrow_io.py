"""Helpers around mapInArrow: choose the columns that pass through and append computed ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows handed to Python code at a time; bounds what an operator holds besides Spark's own batch.
ROWS = 512


def append_columns(df: DataFrame, source: str, keep: list[str] | None, added: T.StructType,
                   compute: Callable[[], Callable[[pa.Array], list[pa.Array]]]) -> DataFrame:
    """`keep` columns of `df` (None: all) followed by `added`, computed from column `source`.

    `compute` is called once in each task and returns the function applied to slices of
    `source`. Kept columns keep their names; an added one whose name is taken gets
    underscores behind it, so no column of the input is lost or overwritten.
    """
    kept = df.columns if keep is None else keep
    taken = {c.lower() for c in kept}
    fields = [df.schema[c] for c in kept]
    for f in added:
        name = f.name
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        fields.append(T.StructField(name, f.dataType, f.nullable))
    out = T.StructType(fields)
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = compute()
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                arrays = [part.column(i) for i in range(n)] + work(part.column(n))
                yield pa.RecordBatch.from_arrays(arrays, names=out.fieldNames())

    cols = [F.col(f"`{c}`") for c in kept] + [F.col(f"`{source}`").alias("source text")]
    return df.select(*cols).mapInArrow(run, out)
