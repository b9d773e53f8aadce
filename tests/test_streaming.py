from pyspark.sql import functions as F

from morbiscope.streaming.seen_store import SeenStore, deduplicate_deliveries


def prepare(raw):
    return raw.select("k", F.col("id"), F.col("at"))


def put(spark, folder, name, data):
    spark.createDataFrame(data, "k string, id bigint, at bigint, extra string").coalesce(1).write.mode("append").parquet(folder)


DAY = 86_400_000_000


def run(spark, folder, root, **kw):
    return deduplicate_deliveries(spark, folder, root, prepare, ["k"], **kw)


def test_latest_stays_ties_nulls_and_null_keys(spark, tmp_path):
    src = str(tmp_path / "src")
    put(spark, src, 0, [("a", 1, 5 * DAY, ""), ("a", 2, 9 * DAY, ""), ("a", 3, 9 * DAY, ""), ("b", 4, None, ""), ("b", 5, None, ""), (None, 6, 1, ""), (None, 7, 1, ""), ("", 8, 1, ""), ("c", 9, None, ""), ("c", 10, -5, "")])
    store = run(spark, src, f"file://{tmp_path}/root")
    assert sorted(r[0] for r in store.removed().collect()) == [1, 3, 5, 9]
    assert sorted(tuple(r) for r in store.kept().collect()) == [("", 8), ("a", 2), ("b", 4), ("c", 10)]


def test_many_batches_expiry_and_late_rows_give_the_batch_answer(spark, tmp_path):
    import random

    rng, src = random.Random(3), str(tmp_path / "src")
    data = [(f"k{rng.randrange(40) if rng.random() < 0.7 else 0}", i, rng.choice([None, rng.randrange(200) * DAY // 3]), "") for i in range(400)]
    for n in range(8):
        put(spark, src, n, data[n * 50 : n * 50 + 50])
    store = run(spark, src, f"file://{tmp_path}/root", delay_days=2, max_files=1)
    assert store.last_commit().batch == 7
    best = {}
    for k, i, at, _ in data:
        best[k] = max(best.get(k, (-(2**70), 0)), (-(2**63) if at is None else at, -i))
    stays = {-b[1] for b in best.values()}
    removed = [r[0] for r in store.removed().collect()]
    assert len(removed) == len(set(removed)) and set(removed) == {i for _, i, _, _ in data} - stays


def test_restart_reads_only_new_files_and_replays_are_ignored(spark, tmp_path):
    src, root = str(tmp_path / "src"), f"file://{tmp_path}/root"
    put(spark, src, 0, [("a", 1, DAY, ""), ("b", 2, DAY, "")])
    run(spark, src, root)
    put(spark, src, 1, [("a", 3, 90 * DAY, ""), ("b", 4, 0, "")])
    store = run(spark, src, root, delay_days=1)
    assert sorted(r[0] for r in store.removed().collect()) == [1, 4]
    n = store.last_commit()
    batch = spark.createDataFrame([("a", 99, 99 * DAY)], "k string, id bigint, at bigint")
    store.apply(batch, 0)  # a replay of a published batch
    assert store.last_commit() == n and sorted(r[0] for r in store.removed().collect()) == [1, 4]


def test_unpublished_batch_is_redone(spark, tmp_path):
    root = f"file://{tmp_path}/root"
    batch = spark.createDataFrame([("a", 1, 1), ("a", 2, 2)], "k string, id bigint, at bigint")
    store = SeenStore(spark, root, ["k"], batch.schema, 14)
    batch.write.parquet(f"{root}/batches/000000000/rows")  # what a lost driver left behind
    store.apply(batch, 0)
    assert [r[0] for r in store.removed().collect()] == [1]


def test_empty_table(spark, tmp_path):
    src = str(tmp_path / "src")
    put(spark, src, 0, [])
    store = run(spark, src, f"file://{tmp_path}/root")
    assert store.removed().count() == 0 and store.kept().count() == 0


def test_cost_of_a_batch_does_not_grow_with_history(spark, tmp_path):
    """A stream that never repeats: what a batch reads of the state, in folders, stays bounded, and so does the commit log."""
    root = f"file://{tmp_path}/root"
    ddl = "k string, id bigint, at bigint"
    store = SeenStore(spark, root, ["k"], spark.createDataFrame([], ddl).schema, 1, buckets=4)
    reads, plain = [], store._read
    store._read = lambda folders: (reads.append(len(folders)), plain(folders))[1]
    for n in range(24):
        store.apply(spark.createDataFrame([(f"k{n}", n, n * DAY)], ddl), n)
    store.apply(spark.createDataFrame([("k3", 1000, 0)], ddl), 24)  # seen long ago, expired since
    assert max(reads) <= 9 and len(store._names("commits")) <= 2
    assert [r[0] for r in store.removed().collect()] == [1000]
    assert store.kept().count() == 24
