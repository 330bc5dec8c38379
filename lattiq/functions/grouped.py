"""Work on groups of rows in arrays, many groups in one Python call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattiq.functions.shipping import ship


def by_group(df: DataFrame, key: str, work: Callable[[pa.Table], list | None], schema: pa.Schema, ddl: str, at_least: int = 1) -> DataFrame:
    """The rows that ``work`` makes (a list of columns) of each group's rows.

    Rows are dealt by the key (an integer column) and sorted by it, and groups are cut out of the stream; a group has to fit
    one task, so callers bound it. They are dealt to ``at_least`` so many tasks."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def made(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if parts:
                out = work(pa.Table.from_batches(parts))
                if out is not None and len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

        for batch in batches:
            of = batch.column(names.index(key)).to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.diff(of, prepend=of[:1] - 1)) if len(of) else []
            for lo, hi in zip(starts, [*starts[1:], len(of)]):
                if of[lo] != last:
                    yield from made(held)
                    held, last = [], of[lo]
                held.append(batch.slice(lo, hi - lo))
        yield from made(held)

    ship(df.sparkSession)
    n = max(at_least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, key).sortWithinPartitions(key).mapInArrow(run, ddl)
