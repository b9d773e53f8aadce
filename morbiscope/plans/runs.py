"""Run records, isolated batches, dependency order and inspection."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morbiscope.operators.checks import ContractError
from morbiscope.sources.fetch import file_digest
from morbiscope.sources.store import TableStore


@dataclass
class RunRecord:
    """What one execution read and did; written even if it failed or was skipped."""

    source: str
    run_id: str
    started_at: str
    status: str = "running"
    record_count: int | None = None
    error: str | None = None
    reason: str | None = None
    finished_at: str | None = None
    raw_files: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)

    @classmethod
    def start(cls, source: str, now: datetime | None = None) -> RunRecord:
        now = now or datetime.now(timezone.utc)
        return cls(source, now.strftime("%Y%m%dT%H%M%SZ"), now.isoformat())

    def add_file(self, path: str) -> None:
        p = Path(path)
        if not p.is_file() or not p.stat().st_size:
            raise ContractError(f"{path}: missing or empty")
        self.raw_files.append({"path": str(p), "bytes": p.stat().st_size, "sha256": file_digest(path)})

    def end(self, status: str, *, records: int | None = None, error: BaseException | None = None, reason: str | None = None) -> RunRecord:
        self.status, self.reason, self.finished_at = status, reason, datetime.now(timezone.utc).isoformat()
        self.record_count = records if records is not None else self.record_count
        self.error = f"{type(error).__name__}: {error}" if error else None
        return self

    def write(self, folder: str) -> str:
        target = Path(folder, self.source, f"{self.run_id}.json")
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(json.dumps(asdict(self), ensure_ascii=False))
        return str(target)


def read_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The latest run record of each source."""
    runs = spark.read.json(f"{folder}/*/*.json")
    return runs.groupBy("source").agg(F.max_by(F.struct("run_id", "status", "record_count", "error", "reason"), "run_id").alias("r")).select("source", "r.*")


def run_source(source: str, job: Callable[[RunRecord], int | None], folder: str) -> RunRecord:
    """Run one job; its record is written whatever happens, and a failing write never hides the job's error."""
    record = RunRecord.start(source)
    try:
        records = job(record)
        if record.status == "running":
            record.end("success", records=records)
    except Exception as e:  # noqa: BLE001
        record.end("failed", error=e)
    try:
        record.write(folder)
    except OSError as e:
        record.warnings.append(f"record not written: {e}")
    return record


def run_batch(jobs: Mapping[str, Callable[[RunRecord], int | None]], folder: str, enabled: Sequence[str] | None = None) -> tuple[list[RunRecord], int]:
    """All jobs, each on its own; disabled ones are reported as skipped. Exit code 1 if any failed."""
    records = []
    for name, job in jobs.items():
        if enabled is not None and name not in enabled:
            records.append(RunRecord.start(name).end("skipped", reason="disabled"))
        else:
            records.append(run_source(name, job, folder))
    return records, int(any(r.status == "failed" for r in records))


def in_order(needs: Mapping[str, Sequence[str]], wanted: Sequence[str]) -> list[str]:
    """The wanted jobs and all they need, each after its needs."""
    out: list[str] = []

    def visit(name: str, path: tuple[str, ...]) -> None:
        if name in path:
            raise ContractError(f"circular needs: {' > '.join((*path, name))}")
        if name not in needs:
            raise ContractError(f"unknown job {name}")
        for n in needs[name]:
            visit(n, (*path, name))
        if name not in out:
            out.append(name)

    for name in wanted:
        visit(name, ())
    return out


def inspect(store: TableStore, rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """Rows per partition value, and a head of the table."""
    df = store.read()
    part = store.partition_column
    counts = df.groupBy(part).agg(F.count("*").alias("n_rows")).orderBy(part) if part else df.agg(F.count("*").alias("n_rows"))
    return counts, df.limit(rows)


def load_config(path: str) -> dict[str, dict]:
    """Sources of a YAML registry, each with the ``defaults`` merged in; ``name`` is its key."""
    try:
        import yaml
    except ImportError as e:
        raise ContractError("reading the registry needs PyYAML") from e
    raw = yaml.safe_load(Path(path).read_text())
    if not isinstance(raw, dict) or not isinstance(raw.get("sources"), dict):
        raise ContractError(f"{path}: no sources")
    defaults = raw.get("defaults") or {}
    return {name: {**defaults, **(cfg or {}), "name": name} for name, cfg in raw["sources"].items()}


def enabled_sources(config: Mapping[str, dict]) -> list[str]:
    return [name for name, cfg in config.items() if cfg.get("enabled", True)]
