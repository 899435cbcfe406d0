"""Per-document functions over Arrow batches, with bounded memory whatever the length of a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def map_batches(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], list]], rows: int = 512) -> DataFrame:
    """df through a function from a batch of at most ``rows`` rows to column lists in the order of ``schema``.

    ``make`` runs once a task, on the executor, so that caches and vocabularies are built there and only there.
    """
    kinds = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                columns = call(batch.slice(at, rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return df.mapInArrow(run, kinds)
