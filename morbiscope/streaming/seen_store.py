"""Exactly one copy of each message from an at-least-once stream.

A structured stream feeds micro-batches to a keyed store of seen identifiers. For each identifier the
store holds the delivery that is to stay so far. Entries whose event time fell behind the watermark expire
from the hot state into an archive, which late deliveries are looked up in, so expiry never loses a
duplicate. Hot state and archive are cut into buckets by the hash of the identifier; a micro-batch reads and
rewrites only the buckets its identifiers fall into. It writes its output and these buckets into folders of
its own and then publishes both with one renamed commit file, which names the files of every bucket; a
batch that was not published is redone as if it had never begun.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from morbiscope.runtime import fresh_dir

#: A back-fill is cut into at most so many micro-batches, and into at least three where it can be.
BACKFILL_BATCHES, LEAST_BATCHES = 16, 3
#: Least and most buckets of the state (one per input file in between), and archive files of one bucket that are merged into one.
LEAST_BUCKETS, MOST_BUCKETS, ARCHIVE_FILES = 8, 1024, 8

Buckets = dict[str, list[str]]


@dataclass(frozen=True)
class Commit:
    """The state after a batch: bucket number to folders, for the hot state and for the archive."""

    batch: int
    watermark: int | None  # microseconds
    buckets: int
    hot: Buckets = field(default_factory=dict)
    archive: Buckets = field(default_factory=dict)


def _folders(buckets: Buckets, wanted: Sequence[str] | None = None) -> list[str]:
    return sorted({p for b, paths in buckets.items() if wanted is None or b in wanted for p in paths})


class SeenStore:
    """The state, output and commit log of one deduplicated stream below ``root`` (shared storage)."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], schema: StructType, delay_days: float, buckets: int = LEAST_BUCKETS):
        self.spark, self.root, self.keys, self.delay = spark, root.rstrip("/"), list(keys), int(delay_days * 86_400e6)
        by = {f.name: f.dataType.simpleString() for f in schema}
        self.key_ddl = ", ".join(f"`{k}` {by[k]}" for k in self.keys)
        self.state_ddl = f"{self.key_ddl}, best struct<at:bigint,neg:bigint>, seen bigint"
        self.out_ddl = "id bigint"
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        last = self.last_commit()
        self.buckets = last.buckets if last else buckets  # a store keeps the number it began with

    # ---- commit log -------------------------------------------------------------------------------------
    def _names(self, folder: str) -> list[str]:
        path = self._path(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def last_commit(self) -> Commit | None:
        """The newest commit; it names the whole state, so no earlier one is read."""
        names = [n for n in self._names("commits") if n.endswith(".json")]
        if not names:
            return None
        stream = self._fs.open(self._path(f"{self.root}/commits/{names[-1]}"))
        try:
            return Commit(**json.loads(bytes(stream.readAllBytes())))
        finally:
            stream.close()

    def _publish(self, commit: Commit) -> None:
        tmp, final = self._path(f"{self.root}/staging-{commit.batch}.json"), self._path(f"{self.root}/commits/{commit.batch:09d}.json")
        self._fs.mkdirs(self._path(f"{self.root}/commits"))
        stream = self._fs.create(tmp, True)
        stream.write(bytearray(json.dumps(commit.__dict__).encode()))
        stream.close()
        if not self._fs.rename(tmp, final):
            raise OSError(f"commit {commit.batch} is already published")
        for name in self._names("commits")[:-2]:  # superseded; one is kept for readers that have just listed it
            self._fs.delete(self._path(f"{self.root}/commits/{name}"), False)

    # ---- state ------------------------------------------------------------------------------------------
    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets))

    def _read(self, folders: list[str]) -> DataFrame | None:
        return self.spark.read.schema(self.state_ddl).parquet(*folders) if folders else None

    def _write(self, state: DataFrame, folder: str) -> tuple[Buckets, Buckets]:
        """Hot state and archive, one folder per bucket that has rows; ``state`` has the column ``expired``."""
        state.withColumn("bucket", self._bucket()).repartition("bucket").write.mode("overwrite").partitionBy("expired", "bucket").parquet(folder)

        def side(flag: str) -> Buckets:
            names = self._names(f"{folder.removeprefix(self.root + '/')}/expired={flag}")
            return {n.removeprefix("bucket="): [f"{folder}/expired={flag}/{n}"] for n in names if n.startswith("bucket=")}

        return side("false"), side("true")

    # ---- one micro-batch --------------------------------------------------------------------------------
    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """``batch``: keys, ``id`` (bigint, unique), ``at`` (microseconds, null = earliest)."""
        before = self.last_commit() or Commit(-1, None, self.buckets)
        if before.batch >= batch_id:
            return
        here = f"{self.root}/batches/{batch_id:09d}"
        spark, keys = self.spark, self.keys

        # The slim rows of the batch; from here on plans run in the outer session, with adaptive execution.
        batch.select(*keys, "id", "at").write.mode("overwrite").parquet(f"{here}/rows")
        rows = spark.read.schema(f"{self.key_ddl}, id bigint, at bigint").parquet(f"{here}/rows")
        # Latest instant first, then smallest id; map-side combine leaves one row per key and task.
        rank = F.struct(F.coalesce("at", F.lit(-(2**63))).alias("at"), (-F.col("id")).alias("neg"))
        new = rows.groupBy(*keys).agg(F.max(rank).alias("best"))
        top, numbers = rows.agg(F.max("at"), F.collect_set(self._bucket())).first()  # at most all buckets
        touched = sorted(map(str, numbers))

        # What the touched buckets hold: all of the hot state, and of the archive the keys of the batch, unless
        # a bucket's archive has grown to so many files that it is merged on this occasion.
        crowded = [b for b in touched if len(before.archive.get(b, ())) >= ARCHIVE_FILES]
        calm = [b for b in touched if b not in crowded]
        held = [self._read(_folders(before.hot, touched)), self._read(_folders(before.archive, crowded))]
        if (late := self._read(_folders(before.archive, calm))) is not None:
            held.append(late.join(new.select(*keys), keys, "left_semi"))
        prior = None
        for part in held:
            if part is not None:
                prior = part if prior is None else prior.unionByName(part)
        fresh = new.withColumnRenamed("best", "fresh")
        if prior is None:
            merged = fresh.select(*keys, F.lit(None).cast("struct<at:bigint,neg:bigint>").alias("prior"), "fresh")
        else:
            merged = prior.groupBy(*keys).agg(F.max("best").alias("prior")).join(fresh, keys, "full_outer")
        merged = merged.select(*keys, "prior", F.col("fresh").isNotNull().alias("touched"), F.greatest("prior", "fresh").alias("best"))
        merged.write.mode("overwrite").parquet(f"{here}/merged")
        merged = spark.read.schema(f"{self.key_ddl}, prior struct<at:bigint,neg:bigint>, touched boolean, best struct<at:bigint,neg:bigint>").parquet(f"{here}/merged")

        # Output: rows that are not the best of their key, and earlier bests that were displaced.
        best = merged.where("touched").select(*keys, (-F.col("best.neg")).alias("stays"))
        beaten = rows.select(*keys, "id").join(best, keys).where("id <> stays").select("id")
        displaced = merged.where("touched and prior is not null and prior.neg <> best.neg").select((-F.col("prior.neg")).alias("id"))
        out = beaten.unionByName(displaced)

        # Next state: what the watermark has passed goes to the archive.
        mark = max((x for x in (before.watermark, None if top is None else top - self.delay) if x is not None), default=None)
        expired = F.lit(False) if mark is None else F.col("best.at") < mark
        state = merged.select(*keys, "best", F.col("best.at").alias("seen"), expired.alias("expired"))
        with ThreadPoolExecutor(2) as pool:  # output and state are two jobs over the same rows; neither counts before the commit
            written_out = pool.submit(lambda: out.write.mode("overwrite").parquet(f"{here}/out"))
            kept, gone = pool.submit(self._write, state, f"{here}/state").result()
            written_out.result()
        hot = {b: p for b, p in before.hot.items() if b not in touched} | kept
        archive = {b: p for b, p in before.archive.items() if b not in crowded}
        self._publish(Commit(batch_id, mark, self.buckets, hot, archive | {b: [*archive.get(b, []), *p] for b, p in gone.items()}))

    # ---- results ----------------------------------------------------------------------------------------
    def removed(self) -> DataFrame:
        """``id`` of every delivery that must go, over all published batches."""
        last = self.last_commit()
        done = [n for n in self._names("batches") if last and int(n) <= last.batch]
        paths = [f"{self.root}/batches/{n}/out" for n in done]
        return self.spark.read.schema(self.out_ddl).parquet(*paths) if paths else self.spark.createDataFrame([], self.out_ddl)

    def kept(self) -> DataFrame:
        """The keys and ``id`` of the delivery that stays of every message."""
        last = self.last_commit()
        state = self._read(sorted({*_folders(last.hot), *_folders(last.archive)})) if last else None
        if state is None:
            return self.spark.createDataFrame([], f"{self.key_ddl}, id bigint")
        return state.groupBy(*self.keys).agg(F.max("best").alias("best")).select(*self.keys, (-F.col("best.neg")).alias("id"))


def _files(spark: SparkSession, path: str) -> int:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(hadoop_path).getFileCount())


def deduplicate_deliveries(
    spark: SparkSession,
    path: str,
    root: str,
    prepare,
    keys: Sequence[str],
    *,
    delay_days: float = 14,
    max_files: int | None = None,
    buckets: int | None = None,
) -> SeenStore:
    """Stream the parquet table at ``path`` through a ``SeenStore`` at ``root`` until all files are read.

    ``prepare`` turns the raw stream into the columns ``keys``, ``id`` (bigint, unique) and ``at``
    (microseconds of the event time). Of each key the delivery with the latest ``at`` stays, of equal ones
    the smallest ``id``; null ``at`` counts as earliest. The result does not depend on the order in which
    files arrive. Calling it again with the same ``root`` reads only files that came since.

    Defined cases: rows with a null key part are no messages and pass without being stored; repeated rows
    of one id count once; an empty table gives empty results; other columns never reach the state.

    A back-fill of ``n`` files is read in ``BACKFILL_BATCHES`` micro-batches at most and ``LEAST_BATCHES`` at
    least; a table in fewer files is first laid out anew in as many (in its slim columns).

    Scale: per batch one map-side-combined aggregation, one join of the batch's keys with the buckets they
    fall into and one join of the batch's slim rows with their key's best (AQE splits a hot key there). A
    batch of few identifiers reads as many buckets at most, whatever was seen before; there is
    one bucket per file of the back-fill, so one of them is about a file's share of the keys. The archive of a bucket never exceeds ``ARCHIVE_FILES``
    files for long, a commit names all of the state, and superseded commits are deleted.
    """
    files = _files(spark, path)
    if files < LEAST_BATCHES and max_files is None and not spark.read.parquet(path).isEmpty():
        slim = fresh_dir(spark, "landing")
        prepare(spark.read.parquet(path)).repartition(LEAST_BATCHES).write.parquet(slim)
        path, files, prepare = slim, LEAST_BATCHES, lambda landed: landed
    # As a glob, the path may be one file as well as a folder.
    glob = f"{path[:-1]}[{path[-1]}]"
    per_batch = max_files or max(1, files // LEAST_BATCHES if files <= LEAST_BATCHES * BACKFILL_BATCHES else -(-files // BACKFILL_BATCHES))
    raw = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", per_batch).parquet(glob)
    rows = prepare(raw)
    for k in keys:
        rows = rows.where(F.col(k).isNotNull())
    store = SeenStore(spark, root, keys, rows.schema, delay_days, buckets or max(LEAST_BUCKETS, min(MOST_BUCKETS, files)))
    query = (
        rows.writeStream.foreachBatch(store.apply)
        .option("checkpointLocation", f"{root}/stream")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return store
