import json
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from morbiscope.operators.checks import ContractError
from morbiscope.plans import runs as U
from morbiscope.sources import fetch as A
from morbiscope.sources import readers as R
from morbiscope.sources.store import TableStore, all_ingested


def test_csv_quotes_and_lines(spark, tmp_path):
    p = tmp_path / "landing" / "a.csv"
    p.parent.mkdir()
    p.write_bytes(b'name,n\r\n"ARUNACHAL\r\nPRADESH",1\r\n"say ""hi""",2\r\n#note,3\r\n')
    df = R.read_csv(spark, str(p))
    assert [tuple(r) for r in df.collect()][:2] == [("ARUNACHAL\nPRADESH", "1"), ('say "hi"', "2")] and R.without_comments(df).count() == 2
    out = R.with_lineage(df, "s", "2026", "2026-01-01").first()
    assert out._source_file == "a.csv" and out.ingestion_date == "2026-01-01"


def test_csv_roundtrip_keeps_every_text(spark, tmp_path, rows):
    from morbiscope.plans import catalog

    texts = [None, "", " ", "a\r\nb", "\r", "x\ry\n", "\\N", "\\E", "\\r", "\\\\r\\b\r", 'say "hi", \\"', "  outer \t", "null", "#c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(catalog.csv_roundtrip(spark, str(tmp_path))) == rows(df)


def test_rss(spark, tmp_path):
    p = tmp_path / "f.xml"
    p.write_text('<rss><channel><item><guid>g1</guid><title>T &amp; U</title><source url="https://s">S</source></item><item><title>only</title></item></channel></rss>')
    found = R.read_rss(spark, str(p), feed=F.lit("VN")).collect()
    got = sorted((tuple(v for k, v in r.asDict().items() if k != "raw_payload") for r in found), key=repr)
    assert got == sorted([("g1", "T & U", "", "", "", "S", "https://s", "VN"), ("", "only", "", "", "", "", "", "VN")], key=repr)
    assert {r.raw_payload for r in found} == {'<item><guid>g1</guid><title>T &amp; U</title><source url="https://s">S</source></item>', "<item><title>only</title></item>"}
    p.write_text('\ufeff<?xml version="1.0"?>\n<!-- x --><rss version="2.0"><channel><item id="1"><guid isPermaLink="false"><![CDATA[ a&b ]]></guid><title> padded </title></item></channel></rss>')
    assert R.read_rss(spark, str(p)).select("guid", "title").first() == ("a&b", "padded")
    p.write_text("<rss><channel></channel></rss>")
    assert R.read_rss(spark, str(p)).count() == 0
    q = tmp_path / "h.html"
    q.write_text("<html><body>captcha<item><title>no</title></item></body></html>")
    with pytest.raises(ContractError, match="h.html"):
        R.read_rss(spark, [str(p), str(q)])


def test_odata_and_geojson(spark, tmp_path):
    p = tmp_path / "o.json"
    p.write_text(json.dumps({"@odata.context": "x", "value": [{"A": 1, "B": None}, {"A": 2, "B": "b"}]}))
    assert sorted(tuple(r) for r in R.read_odata(spark, str(p)).fillna("").collect()) == [("1", ""), ("2", "b")]
    with pytest.raises(ContractError, match="cut off"):
        R.read_odata(spark, str(p), row_cap=2)
    assert R.read_odata(spark, str(p), fetched_at="t").first()._fetched_at == "t"
    p.write_text('{"value": []}')
    with pytest.raises(ContractError, match="without rows"):
        R.read_odata(spark, str(p))
    g = tmp_path / "g.json"
    g.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"shapeName": "X", "Case Size": None}, "geometry": {"type": "Point", "coordinates": [1.5, 2]}}]}))
    row = R.read_geojson(spark, str(g), {"name": "shapeName", "iso": "shapeISO"}).first()
    assert row.name == "X" and row.iso is None and json.loads(row.geometry)["coordinates"] == [1.5, 2]
    flat = R.read_geojson_flat(spark, str(g)).first()
    assert flat.case_size == "" and flat.shapename == "X"
    g.write_text(json.dumps({"type": "FeatureCollection", "features": []}))
    with pytest.raises(ContractError):
        R.read_geojson(spark, str(g), {})


def test_zip_union_and_jsonl(spark, tmp_path):
    z = tmp_path / "a.zip"
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("in/spatial.csv", "a\n1\n")
        f.writestr("readme.txt", "")
    assert open(R.unzip_member(str(z), "*.csv", str(tmp_path / "out"))).read() == "a\n1\n"
    with pytest.raises(ContractError):
        R.unzip_member(str(z), "*.geojson", str(tmp_path))
    (tmp_path / "x.jsonl").write_text('{"a": 1, "b": true}\n{"a": "2"}\n')
    df = R.read_jsonl(spark, str(tmp_path / "x.jsonl"))
    assert {f.dataType.simpleString() for f in df.schema} == {"string"} and df.count() == 2
    assert R.union_by_name(df, df.select(F.col("a").alias("c"))).columns == ["a", "b", "c"]


def test_store_contract(spark, tmp_path):
    s = TableStore(spark, f"file://{tmp_path}/t", "day")
    one = spark.createDataFrame([("a", "v1"), ("b", "v1")], "k string, _version string")
    assert s.ingested_rows(_version="v1") == 0
    s.replace_partition(one, "1")
    s.replace_partition(one.limit(1), "2", strings_only=True)
    s.replace_partition(one, "1")  # a rerun changes nothing
    assert s.read().count() == 3 and s.partition_values() == ["1", "2"]
    s.replace_partition(one.withColumn("extra", F.lit("e")), "3")  # the schema grows
    assert s.read().columns == ["k", "_version", "day", "extra"] and s.read(partitions=["1"]).count() == 2
    s.replace_partition(one.limit(0), "1")  # an empty snapshot empties its partition
    assert s.partition_values() == ["2", "3"] and s.read(version=0).count() == 2
    with pytest.raises(ContractError, match="type"):
        s.replace_partition(spark.createDataFrame([(1,)], "k int"), "4")
    with pytest.raises(ContractError, match="strings"):
        s.replace_partition(spark.createDataFrame([(1,)], "z int"), "4", strings_only=True)
    with pytest.raises(ContractError, match="partitioned"):
        TableStore(spark, f"file://{tmp_path}/t", "other").replace_partition(one, "1")
    assert s.ingested_rows(_version="v1") == 3 and s.ingested_rows(nothing="x") == 0 and all_ingested([s], _version="v1")
    s.delete_partition("3")
    s.rename_column("k", "key")
    assert s.read().columns[0] == "key" and s.read().count() == 1
    with pytest.raises(ContractError, match="also holds"):
        s.rename_column("key", "k", only="1")
    typed = TableStore(spark, f"file://{tmp_path}/typed", "day")
    typed.replace_partition(spark.createDataFrame([(1,)], "n int"), "1")
    with pytest.raises(ContractError, match="not strings"):
        typed.replace_partition(one, "2", strings_only=True)
    with pytest.raises(Exception):
        s._publish({}, 0)  # version 1 is taken: a raced commit fails
    u = TableStore(spark, f"file://{tmp_path}/u")
    u.append(one)
    u.append(one)
    assert u.read().count() == 4
    u.overwrite(one.select(F.lit(1).alias("k")), replace_schema=True)
    assert u.read().dtypes == [("k", "int")]


def test_store_roundtrip_keeps_every_event(spark, tmp_path, rows):
    from morbiscope.plans import catalog

    kinds = ["click", "view", "signup", "purchase", "error", "", None]
    events = spark.createDataFrame([(i, k, i / 2) for i, k in enumerate(kinds)], "event_id bigint, event_type string, value double")
    events = events.selectExpr("event_id", "timestamp_ntz'2024-01-02 03:04:05.678' as ts", "event_id as user_id", "event_type", "value", "'{}' as props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    want = events.withColumn("day", F.when(F.col("event_type") == "click", "late").otherwise("2024-01-02"))
    assert rows(catalog.store_roundtrip(spark, str(tmp_path))) == rows(want)


def test_fetch(tmp_path):
    calls, waits = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise ConnectionError if len(calls) == 1 else A.Transient
        return 200, {}, b'{"code": 0, "data": {"url": "u2"}}'

    get = A.with_retries(flaky, sleep=waits.append)
    assert A.get_json(get, "u")["code"] == 0 and waits == [2, 4]
    with pytest.raises(ContractError, match="404"):
        A.with_retries(lambda u: (404, {}, b""))("u")
    with pytest.raises(ContractError, match="rate"):
        A.with_retries(lambda u: (403, {"x-ratelimit-remaining": "0"}, b""))("u")
    with pytest.raises(A.Transient):
        A.with_retries(lambda u: (503, {}, b""), attempts=2, sleep=waits.append)("u")
    assert open(A.signed_download(get, "u", str(tmp_path / "f"))).read().startswith("{")
    p = tmp_path / "b"
    p.write_bytes(b"hello\n")
    assert A.file_digest(str(p), "git") == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert A.newest_release(["V1.9", "V1.10", "x"]) == "V1.10" and A.member_filter("ISO3", ["A", "B'"]) == "ISO3 in ('A','B''')"
    done, failed = A.fetch_each({"a": lambda: "x", "b": lambda: 1 / 0})
    assert done == {"a": "x"} and "b" in failed
    with pytest.raises(ContractError):
        A.fetch_each({"b": lambda: 1 / 0})


class Site(BaseHTTPRequestHandler):
    """Answers by path; ``/flaky`` fails twice, ``/short`` ends early, ``/big`` is long."""

    calls: dict = {}

    def do_GET(self):
        n = self.calls[self.path] = self.calls.get(self.path, 0) + 1
        body = b"x" * 3_000_000 if self.path == "/big" else b'{"success": true, "result": 1}'
        status = 503 if self.path == "/flaky" and n < 3 else 404 if self.path == "/none" else 200
        self.send_response(status)
        self.send_header("Content-Length", str(len(body) + (9 if self.path == "/short" and n < 2 else 0)))
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *args):
        pass


def test_http_client(tmp_path):
    server = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        base, client, waits = f"http://127.0.0.1:{server.server_port}", A.HttpClient(timeout=5), []
        assert A.with_retries(client, sleep=waits.append)(f"{base}/flaky")[0] == 200 and waits == [2, 4]
        with pytest.raises(ContractError, match="404"):
            A.with_retries(client)(f"{base}/none")
        big = A.download(client, f"{base}/big", str(tmp_path / "big"))
        assert len(open(big).read()) == 3_000_000 and max(map(len, client.stream(f"{base}/big", 1 << 16))) <= 1 << 16
        assert A.download(client, f"{base}/short", str(tmp_path / "short"), sleep=waits.append) and Site.calls["/short"] == 2
        with pytest.raises(ContractError):
            A.download(client, f"{base}/none", str(tmp_path / "none"))
        assert sorted(p.name for p in tmp_path.iterdir()) == ["big", "short"]
        assert A.catalogue_package(client, base, "x")["result"] == 1
    finally:
        server.shutdown()
    with pytest.raises(A.Transient):
        client(f"{base}/big")


def test_verified_files(tmp_path):
    body, pages = b"hello\n", {}
    get = lambda url: (200, {"content-type": "application/json"}, pages[url])
    pages |= {"list": json.dumps([{"name": "V1.9", "type": "dir", "url": "old"}, {"name": "V1.10", "type": "dir", "url": "new"}, {"name": "README", "type": "file"}]).encode(), "raw": body}
    pages["new"] = json.dumps([{"name": "Spatial_x.csv", "download_url": "raw", "sha": "ce013625030ba8dba906f756967f9e9ca394464a"}]).encode()
    release, path = A.latest_release_file(get, "list", "spatial", str(tmp_path))
    assert release == "V1.10" and open(path, "rb").read() == body
    pages["raw"] = b"changed"
    assert A.latest_release_file(get, "list", "spatial", str(tmp_path))[1] == path  # what is there and right is kept
    with pytest.raises(ContractError, match="instead of"):
        A.latest_release_file(get, "list", "spatial", str(tmp_path / "again"))
    assert not list((tmp_path / "again").rglob("*.csv*"))
    pages |= {"find": json.dumps({"hits": {"hits": [{"id": 7, "files": [{"key": "a.csv", "checksum": "md5:b1946ac92492d2347c6235b4d2611184"}]}]}}).encode(), "f/7/a.csv": body}
    assert A.latest_record_file(get, "find", "a.csv", "f/{record}/{name}", str(tmp_path))[0] == "7"
    assert A.newest_resource([{"name": "pop_2019"}, {"name": "pop_2021"}])["name"] == "pop_2021"
    for bad in ((200, {}, b""), (500, {}, b"x"), (200, {"content-type": "text/html"}, b"x")):
        with pytest.raises(ContractError):
            A.check_response("u", bad, "json")
    with pytest.raises(ContractError):
        A.check_landing(str(tmp_path / "nothing"))
    assert A.check_landing(str(tmp_path / "7")) == [str(tmp_path / "7" / "a.csv")]


def test_seed_and_zipped_features(spark, tmp_path):
    (tmp_path / "seed.csv").write_text("a,b\n1,x\n")
    rows, version = R.read_seed(spark, str(tmp_path / "seed.csv"), str(tmp_path / "landing"))
    assert len(version) == 12 and rows.first() == ("1", "x") and (tmp_path / "landing" / version / "seed.csv").exists()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as f:
        f.writestr("x_admin1.geojson", json.dumps({"features": [{"properties": {"code": "A"}, "geometry": {"type": "Point", "coordinates": [1, 2]}}]}))
    assert R.read_zipped_geojson(spark, str(tmp_path / "a.zip"), "*admin1.geojson", str(tmp_path / "out"), {"code": "code"}).first().code == "A"


def test_runs(spark, tmp_path):
    p = tmp_path / "raw"
    p.write_text("x")

    def good(record):
        record.add_file(str(p))
        return 5

    records, code = U.run_batch({"a": good, "b": lambda r: 1 / 0, "c": good}, str(tmp_path / "meta"), ["a", "b"])
    assert [r.status for r in records] == ["success", "failed", "skipped"] and code == 1
    got = {r.source: (r.status, r.record_count) for r in U.read_runs(spark, str(tmp_path / "meta")).collect()}
    assert got == {"a": ("success", 5), "b": ("failed", None)}
    assert U.in_order({"x": [], "y": ["x"], "z": ["y"]}, ["z"]) == ["x", "y", "z"]
    with pytest.raises(ContractError, match="circular"):
        U.in_order({"x": ["y"], "y": ["x"]}, ["x"])
    c = tmp_path / "c.yaml"
    c.write_text("defaults: {retries: 3}\nsources: {a: {}, b: {enabled: false, retries: 1}}\n")
    cfg = U.load_config(str(c))
    assert cfg["a"]["retries"] == 3 and U.enabled_sources(cfg) == ["a"]
