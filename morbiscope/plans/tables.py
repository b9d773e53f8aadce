"""Typed tables from raw ones: the newest input is typed, checked, accounted for, and only then replaces what was there.

Every job reads its raw table's newest version or snapshot, writes the typed rows once to the shared folder,
counts them, evaluates all checks, and commits one partition (or the whole table) atomically. A check that
fails raises before anything is committed, so the former content stays; a rerun gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morbiscope.operators.checks import ContractError, enforce, require_columns, require_rows, require_schema
from morbiscope.operators.latest import newest
from morbiscope.plans import pipelines as W
from morbiscope.plans.runs import in_order
from morbiscope.runtime import written
from morbiscope.sources.store import TableStore


@dataclass(frozen=True)
class Tables:
    """Raw and typed tables below two folders, and the times a run is stamped with."""

    spark: SparkSession
    raw: str
    typed: str
    as_of: date
    processed_at: datetime

    def raw_rows(self, name: str, partition: str | None = None) -> DataFrame:
        store = TableStore(self.spark, f"{self.raw}/{name}", partition)
        if not store.exists():
            raise ContractError(f"{name}: no raw table")
        return store.read()

    def target(self, name: str, partition: str | None = None) -> TableStore:
        return TableStore(self.spark, f"{self.typed}/{name}", partition)


def _accounted(typed: DataFrame, grain: Sequence[str], label: str, **others) -> dict[str, int]:
    numbers = W.accounting(typed, grain, **others).first().asDict()
    if not numbers["valid_rows"]:
        raise ContractError(f"{label}: no row is valid")
    return numbers


def _series_store(t: Tables, source: str) -> TableStore:
    """The table of all case series; one of an earlier layout is renamed if it holds this source only."""
    store = t.target("series", "_source")
    if store.exists() and "rne_iso_code" in store.read().columns:
        store.rename_column("rne_iso_code", "p_code", only=source)
    if store.exists():
        require_schema(store.read(), W.HISTORY, "series")
    return store


def typed_latest_counts(t: Tables) -> tuple[DataFrame, dict]:
    raw = t.raw_rows("opendengue")
    require_columns(raw, W.COUNTS, "counts")
    release = newest(raw, "release", True, "counts")
    latest = raw.where(F.col("release") == release)
    rows = require_rows(latest, "counts")
    typed = written(W.typed_counts(latest, as_of=t.as_of), "typed-counts")
    numbers = _accounted(typed, W.GRAIN, "counts")
    return typed, {"release": release, "source_rows": rows, "excluded_rows": rows - numbers["typed_rows"], **numbers}


def typed_latest_snapshot(t: Tables) -> tuple[DataFrame, dict]:
    raw = t.raw_rows("who_gho")
    require_columns(raw, W.SNAPSHOT, "snapshot")
    day = newest(raw, "ingestion_date", False, "snapshot")
    latest = raw.where(F.col("ingestion_date") == day)
    rows = require_rows(latest, "snapshot")
    typed = written(W.typed_snapshot(latest, as_of=t.as_of), "typed-snapshot")
    numbers = _accounted(typed, W.SNAPSHOT_KEY, "snapshot", derived_rows=F.col("valid") & F.col("derived"), future_rows=F.col("future"))
    numbers["invalid_rows"] -= numbers["future_rows"]
    return typed, {"snapshot": day, "source_rows": rows, **numbers}


def build_counts(t: Tables) -> dict:
    """The newest release's case counts as one partition of the series table."""
    typed, numbers = typed_latest_counts(t)
    frame, checks = W.best_counts(typed, t.processed_at)
    enforce(*checks)
    _series_store(t, "opendengue").replace_partition(frame, "opendengue")
    return numbers


def build_snapshot(t: Tables) -> dict:
    """The newest snapshot's counts as one partition of the series table."""
    typed, numbers = typed_latest_snapshot(t)
    frame, checks = W.best_snapshot(typed, t.processed_at)
    enforce(*checks)
    _series_store(t, "who_gho").replace_partition(frame, "who_gho")
    return numbers


def build_boundaries(t: Tables) -> dict:
    """Units and countries of the newest boundaries."""
    raw = t.raw_rows("boundaries")
    rows = require_rows(raw, "boundaries")
    frame, checks = W.clean_boundaries(raw, processed_at=t.processed_at)
    frame = written(frame, "boundaries")
    enforce(*checks)
    t.target("boundaries").overwrite(frame)
    units = frame.where("adm_1_name is not null").count()
    return {"source_rows": rows, "unit_rows": units, "country_rows": frame.count() - units}


def build_news(t: Tables) -> dict:
    """The newest fetch of every article and feed."""
    raw = t.raw_rows("news_rss")
    require_rows(raw, "news")
    typed = written(W.typed_news(raw), "typed-news")
    numbers = _accounted(typed, W.NEWS_KEY, "news")
    frame, checks = W.newest_news(typed, t.processed_at)
    enforce(*checks)
    t.target("news").overwrite(frame)
    return numbers


def build_history(t: Tables) -> dict:
    """Non-overlapping periods of both sources with the codes of the boundaries; both sources must be there."""
    boundaries = t.target("boundaries")
    if not boundaries.exists():
        raise ContractError("history: build the boundaries first")
    units, frames, numbers = boundaries.read(), [], {}
    for name, typed, best in (("counts", typed_latest_counts, W.best_counts), ("snapshot", typed_latest_snapshot, W.best_snapshot)):
        rows, _ = typed(t)
        frame, checks = best(rows, t.processed_at)
        frame = written(frame, name)
        known, named = W.check_countries(frame, units, name)
        enforce(*checks, *named)
        numbers |= {f"{name}_{k}": v for k, v in known.first().asDict().items()}
        frames.append(frame)
    rows = frames[0].unionByName(frames[1])
    national = rows.where("s_res = 'Admin0'").groupBy("_source").agg(F.count("*").alias("n"))
    if len(have := {r["_source"]: r["n"] for r in national.collect()}) < 2:  # one row per source
        raise ContractError(f"history: both sources are needed, there is {sorted(have)}")
    chosen, checks = W.build_history(rows)
    chosen = written(chosen, "history")
    mapped, coded = W.map_history(chosen, units)
    mapped = written(mapped, "history-mapped")
    enforce(*checks, *coded)
    t.target("history").overwrite(mapped, replace_schema=True)
    kept = {f"{r['_source']}_{r['s_res'].lower()}_kept": r["n"] for r in chosen.groupBy("_source", "s_res").agg(F.count("*").alias("n")).collect()}
    methods = {f"codes_{r['map_method']}": r["n"] for r in mapped.groupBy("map_method").agg(F.count("*").alias("n")).collect()}
    eligible = rows.where("s_res = 'Admin0' or (s_res = 'Admin1' and _source = 'opendengue')").count()
    history_rows = sum(kept.values())
    return {**numbers, **kept, "skipped_rows": eligible - history_rows, "history_rows": history_rows, **methods}


JOBS: dict[str, Callable[[Tables], dict]] = {"counts": build_counts, "snapshot": build_snapshot, "boundaries": build_boundaries, "news": build_news, "history": build_history}
NEEDS: Mapping[str, Sequence[str]] = {"counts": [], "snapshot": [], "boundaries": [], "news": [], "history": ["boundaries"]}


def run_tables(tables: Tables, wanted: Sequence[str] | None = None) -> dict[str, dict]:
    """The wanted tables, each after those it needs, with their row accounting; the first that fails ends the run."""
    return {name: JOBS[name](tables) for name in in_order(NEEDS, list(wanted or JOBS))}
