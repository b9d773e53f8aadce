import logging
from datetime import date, datetime

import pytest

from morbiscope.operators.checks import ContractError
from morbiscope.plans import ingest as I
from morbiscope.plans.runs import RunRecord, run_source
from morbiscope.sources.fetch import boundary_download
from morbiscope.sources.store import TableStore


def source(spark, state, **kw):
    def load(s, version):
        if state.get("broken"):
            raise OSError("network")
        return {t: s.createDataFrame(state["rows"], "k string, v string") for t in ("a", "b")}

    return I.Source("src", ("a", "b"), "release", lambda: (state["version"], state["sha"]), load, **kw)


def test_versions_skip_replace_and_survive_failures(spark, tmp_path):
    root, state = f"file://{tmp_path}", {"version": "V1", "sha": "x", "rows": [("1", "p"), ("2", None)]}
    run = lambda **kw: run_source("src", lambda r: I.ingest(spark, source(spark, state, **kw), root, r), str(tmp_path / "meta"))
    assert (run().status, run().status) == ("success", "skipped")
    state.update(sha="y", rows=[("1", "q")])  # same release, changed content
    assert run().record_count == 2
    state.update(version="V2", rows=[("9", "z"), ("8", "z")])
    assert run(scope=lambda d: d.where("k = '9'")).record_count == 2
    store = TableStore(spark, f"{root}/a", "release")
    assert store.partition_values() == ["V1", "V2"] and sorted(r.k for r in store.read().collect()) == ["1", "9"]
    state.update(version="V3", broken=True)
    assert run().status == "failed" and store.partition_values() == ["V1", "V2"]
    state.update(broken=False, rows=[])
    assert run().error.startswith("ContractError")
    assert run(snapshot=True).status == "success" and store.partition_values() == ["V1", "V2"]


def test_half_loaded_source_is_loaded_again(spark, tmp_path):
    root, state = f"file://{tmp_path}", {"version": "V1", "sha": "x", "rows": [("1", "p")]}
    src = source(spark, state)
    I.ingest(spark, src, root, RunRecord.start("src"))
    TableStore(spark, f"{root}/b", "release").delete_partition("V1")
    record = RunRecord.start("src")
    assert I.ingest(spark, src, root, record) == 2 and record.status == "running"
    record = RunRecord.start("src")
    assert I.ingest(spark, src, root, record) is None and record.status == "skipped"


def test_day_is_rebuilt_from_all_files(spark, tmp_path):
    day = tmp_path / "landing" / "2026-10-01"
    day.mkdir(parents=True)
    store = TableStore(spark, f"file://{tmp_path}/news", "ingestion_date")
    for n in (1, 2):
        (day / f"f{n}.jsonl").write_text(f'{{"guid": {n}, "_fetched_at": "t{n}"}}\n')
        assert I.rebuild_day(spark, store, str(tmp_path / "landing"), "2026-10-01", "news", datetime(2026, 10, 1)) == n
    assert {r._source_file for r in store.read().collect()} == {"2026-10-01/f1.jsonl", "2026-10-01/f2.jsonl"}


def test_logging_and_boundaries(tmp_path):
    for _ in range(2):
        log = I.setup_logging(str(tmp_path), day=date(2026, 1, 2))
    log.info("hello")
    assert len(log.handlers) == 2 and "hello" in (tmp_path / "2026-01-02.log").read_text()
    logging.getLogger("morbiscope").handlers.clear()
    get = lambda u: (200, {}, b'{"boundaryID": "B-1", "gjDownloadURL": "u"}' if u == "m" else b"{}")
    assert boundary_download(get, "m", str(tmp_path / "g"))[0] == "B-1"
    with pytest.raises(ContractError):
        boundary_download(get, "x", str(tmp_path / "g"))
