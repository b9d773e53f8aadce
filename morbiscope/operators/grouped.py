"""Arrow batches of a sorted partition, recut so that no group is divided."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that hold whole groups of column 0, by which the partition is sorted.

    Each batch holds as many groups as came in one batch, so work on it is vectorised over all of them; only
    the last group of a batch waits for the next one.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(0)
        if keys[0] == keys[-1] and (not held or held[-1].column(0)[-1] == keys[0]):
            held.append(batch)
            continue
        last = keys[-1].as_py()
        lo, hi = 0, batch.num_rows - 1  # the first row of the last group
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if keys[mid].as_py() == last else (mid + 1, hi)
        yield _joined([*held, batch.slice(0, lo)] if lo else held)
        held = [batch.slice(lo)]
    if held:
        yield _joined(held)


def gathered(df: DataFrame, key: str) -> DataFrame:
    """Rows of one ``key`` in one task, sorted by it.

    In ``spark.sql.shuffle.partitions`` parts by number: what follows costs CPU time, and parts that are merged
    because they are few bytes would leave it to one task.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key).sortWithinPartitions(key)
