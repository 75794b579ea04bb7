"""Rows that fail are put aside with their error, and the run goes on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..sources.checkpoint import checkpointed


def isolated(rows: DataFrame, key: str, step: Callable[[dict], list[tuple]], schema: str, stage: str) -> tuple[DataFrame, DataFrame]:
    """step(row) gives tuples of `schema` or raises. The rows (key, ...) it gave, and those that failed (key, stage, error, message).

    The function runs once a row: what came of it is written to the shared folder and read for both.
    """
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                out = []
                for row in batch.slice(at, 1024).to_pylist():
                    try:
                        out += [(row[key], None, None, *made) for made in step(row)]
                    except Exception as error:  # whatever a row's own data lead to
                        out.append((row[key], type(error).__name__, str(error)[:500], *[None] * width))
                columns = zip(*out, strict=True) if out else [()] * len(target)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, target.types, strict=True)], schema=target)

    spec = rows.sparkSession.createDataFrame([], f"`{key}` {kind}, error string, message string, {schema}").schema
    target, width = to_arrow_schema(spec), len(spec) - 3
    done = checkpointed(rows.mapInArrow(run, spec), stage)
    failed = done.filter("error is not null").select(key, F.lit(stage).alias("stage"), "error", "message")
    return done.filter("error is null").drop("error", "message"), failed
