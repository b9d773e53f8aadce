"""From a source to its all-string tables: probe, acquire, read, stamp, replace one partition."""

from __future__ import annotations

import logging
import sys
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import date, datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morbiscope.operators.checks import require_rows
from morbiscope.plans.runs import RunRecord
from morbiscope.sources.readers import file_column, read_jsonl, with_lineage
from morbiscope.sources.store import TableStore, all_ingested


def setup_logging(folder: str | None = None, level: int = logging.INFO, day: date | None = None) -> logging.Logger:
    """One logger to stdout and, with ``folder``, to a file per day; calling it again adds no second handler."""
    log = logging.getLogger("morbiscope")
    log.setLevel(level)
    for h in list(log.handlers):
        log.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    if folder:
        Path(folder).mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(Path(folder, f"{(day or datetime.now(timezone.utc).date()).isoformat()}.log"), encoding="utf-8"))
    for h in handlers:
        h.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(h)
    return log


def local_path(root: str, *parts: str) -> str:
    """A landing, table or record path below ``root``."""
    return str(Path(root, *parts))


@dataclass(frozen=True)
class Source:
    """A source of one or more tables, each partitioned by its version.

    ``discover`` gives (version, fingerprint) without downloading; ``load`` gives the string frames by table.
    With ``snapshot`` a frame without rows is data: it empties the partition.
    """

    name: str
    tables: tuple[str, ...]
    partition_column: str
    discover: Callable[[], tuple[str, str]]
    load: Callable[[SparkSession, str], Mapping[str, DataFrame]]
    scope: Callable[[DataFrame], DataFrame] | None = None
    snapshot: bool = False


def stores_of(spark: SparkSession, source: Source, root: str) -> dict[str, TableStore]:
    return {t: TableStore(spark, f"{root}/{t}", source.partition_column) for t in source.tables}


def ingest(spark: SparkSession, source: Source, root: str, record: RunRecord, ingested_at: datetime | None = None) -> int | None:
    """Bring the newest version of ``source`` into its tables; a version that all of them have is skipped.

    A version that only some tables got before a crash is loaded again. Each table commits atomically, so a
    failure leaves earlier content readable.
    """
    stores = stores_of(spark, source, root)
    version, fingerprint = source.discover()
    if all_ingested(list(stores.values()), **{source.partition_column: version, "_fingerprint": fingerprint}):
        record.end("skipped", reason=f"{version} is already ingested")
        return None
    stamp = (ingested_at or datetime.now(timezone.utc)).isoformat()
    frames, rows = source.load(spark, version), 0
    for table, store in stores.items():
        df = frames[table]
        if source.scope:
            df = source.scope(df)
        if not source.snapshot:
            require_rows(df, f"{source.name}/{table}")
        file = file_column(df)
        stamped = with_lineage(df, source.name, stamp, source_file=F.lit(f"{source.name}/{version}") if file is None else file).withColumn("_fingerprint", F.lit(fingerprint))
        store.check_compatible(stamped.withColumn(source.partition_column, F.lit(version)).schema, strings_only=True)
        store.replace_partition(stamped, version, strings_only=True)
        rows += store.ingested_rows(**{source.partition_column: version})
    return rows


def rebuild_day(spark: SparkSession, store: TableStore, landing: str, day: str, source: str, ingested_at: datetime) -> int:
    """Replace a day's partition by all landing files of that day; per-record stamps in them are kept."""
    df = with_lineage(read_jsonl(spark, f"{landing}/{day}/*.jsonl"), source, ingested_at.isoformat())
    store.replace_partition(df, day, strings_only=True)
    return store.ingested_rows(**{store.partition_column or "": day})
