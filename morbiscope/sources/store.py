"""A partitioned parquet table with atomic commits, versions and idempotent partition replacement.

Layout: immutable data folders ``data/<id>`` and numbered manifests ``log/<n>.json``. A manifest names the
schema, the partition column and the data folder(s) of each partition value; publishing one is a single
create that fails if the number is taken, so a failed or raced write leaves the former version as it was.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from morbiscope.operators.checks import ContractError, matching


class TableStore:
    """One table below ``path`` (any Hadoop file system)."""

    def __init__(self, spark: SparkSession, path: str, partition_column: str | None = None):
        self.spark, self.path, self.partition_column = spark, path.rstrip("/"), partition_column
        self._jpath = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- manifests --------------------------------------------------------------------------------------
    def versions(self) -> list[int]:
        log = self._jpath(f"{self.path}/log")
        if not self._fs.exists(log):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def exists(self) -> bool:
        return bool(self.versions())

    def manifest(self, version: int | None = None) -> dict:
        have = self.versions()
        if not have or (version is not None and version not in have):
            raise ContractError(f"{self.path}: no version {version if version is not None else ''}")
        stream = self._fs.open(self._jpath(f"{self.path}/log/{version if version is not None else have[-1]:09d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, manifest: dict, base: int | None) -> int:
        number = 0 if base is None else base + 1
        stream = self._fs.create(self._jpath(f"{self.path}/log/{number:09d}.json"), False)  # fails if taken
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        return number

    def _write(self, df: DataFrame) -> list[str]:
        if df.isEmpty():
            return []
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return [folder]

    # ---- compatibility ----------------------------------------------------------------------------------
    def check_compatible(self, schema: StructType, strings_only: bool = False) -> None:
        """Before any write: same partition column, same types of shared columns, strings where demanded."""
        if strings_only and (odd := [f.name for f in schema if not isinstance(f.dataType, StringType)]):
            raise ContractError(f"{self.path}: columns {odd} are not strings")
        if not self.exists():
            return
        now = self.manifest()
        if now["partition_column"] != self.partition_column:
            raise ContractError(f"{self.path}: partitioned by {now['partition_column']}, not {self.partition_column}")
        old = {f.name: f.dataType for f in StructType.fromJson(now["schema"])}
        if strings_only and (odd := sorted(n for n, t in old.items() if not isinstance(t, StringType))):
            raise ContractError(f"{self.path}: the table that is there has columns {odd} that are not strings")
        if clash := sorted(f.name for f in schema if f.name in old and old[f.name] != f.dataType):
            raise ContractError(f"{self.path}: columns {clash} change their type")

    def _merged(self, schema: StructType) -> StructType:
        if not self.exists():
            return schema
        old = StructType.fromJson(self.manifest()["schema"])
        return StructType([*old.fields, *[f for f in schema if f.name not in old.names]])

    # ---- writes -----------------------------------------------------------------------------------------
    def _commit(self, schema: StructType, parts: Mapping[str, list[str]], base: int | None) -> int:
        return self._publish({"schema": schema.jsonValue(), "partition_column": self.partition_column, "parts": dict(parts)}, base)

    def _base(self) -> tuple[int | None, dict[str, list[str]]]:
        have = self.versions()
        return (have[-1], dict(self.manifest()["parts"])) if have else (None, {})

    def replace_partition(self, df: DataFrame, value: str, strings_only: bool = False) -> int:
        """Exactly the rows of one partition value; new columns are added, an empty frame empties it."""
        if self.partition_column is None:
            raise ContractError(f"{self.path}: not partitioned")
        df = df.withColumn(self.partition_column, F.lit(value))
        self.check_compatible(df.schema, strings_only)
        base, parts = self._base()
        parts[value] = self._write(df)
        return self._commit(self._merged(df.schema), parts, base)

    def delete_partition(self, value: str) -> int:
        base, parts = self._base()
        if base is None:
            raise ContractError(f"{self.path}: no table")
        parts[value] = []
        return self._commit(StructType.fromJson(self.manifest()["schema"]), parts, base)

    def overwrite(self, df: DataFrame, replace_schema: bool = False) -> int:
        """All rows; a different schema only on demand."""
        if not replace_schema:
            self.check_compatible(df.schema)
        base, _ = self._base()
        return self._commit(df.schema if replace_schema else self._merged(df.schema), {"": self._write(df)}, base)

    def append(self, df: DataFrame) -> int:
        self.check_compatible(df.schema)
        base, parts = self._base()
        parts[""] = [*parts.get("", []), *self._write(df)]
        return self._commit(self._merged(df.schema), parts, base)

    def rename_column(self, old: str, new: str, only: str | None = None) -> int:
        """Rewrites the table under the new name; earlier versions keep the old one.

        With ``only`` the table must hold no other partition value, whose rows the new name might not fit.
        """
        df = self.read()
        if only is not None and (others := [v for v in self.partition_values() if v != only]):
            raise ContractError(f"{self.path}: cannot rename {old} while it also holds {others}")
        if old not in df.columns or new in df.columns:
            raise ContractError(f"{self.path}: cannot rename {old} to {new}")
        renamed = df.withColumnRenamed(old, new)
        if only is None or self.partition_column is None:
            return self.overwrite(renamed, replace_schema=True)
        base, _ = self._base()
        return self._commit(renamed.schema, {only: self._write(renamed)}, base)

    # ---- reads ------------------------------------------------------------------------------------------
    def read(self, version: int | None = None, partitions: list[str] | None = None) -> DataFrame:
        """Rows of the latest or a given version; named partitions are the only folders that are listed."""
        m = self.manifest(version)
        schema = StructType.fromJson(m["schema"])
        folders = [f"{self.path}/{d}" for value, dirs in m["parts"].items() if partitions is None or value in partitions for d in dirs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def partition_values(self) -> list[str]:
        return sorted(v for v, dirs in self.manifest()["parts"].items() if dirs)

    def ingested_rows(self, **equals: object) -> int:
        """Rows with the given version or fingerprint; no table or no such column means none."""
        return matching(self.read(), **equals).count() if self.exists() else 0


def all_ingested(stores: list[TableStore], **equals: object) -> bool:
    """A source of several tables is complete only if each of them has the version."""
    return all(s.ingested_rows(**equals) > 0 for s in stores)
