"""Raw files as tables of strings. Every reader is a Spark scan; only archives are opened on the driver."""

from __future__ import annotations

import json
import shutil
import zipfile
from collections.abc import Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from morbiscope.functions.expressions import below, snake_columns
from morbiscope.functions.normal import trim_all
from morbiscope.operators.checks import ContractError
from morbiscope.sources.fetch import file_digest


def read_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """CSV with a header; every column a string, quoted cells may hold line breaks (read as ``\\n``) and doubled quotes."""
    return spark.read.options(header=True, multiLine=True, escape='"', inferSchema=False).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV that ``read_csv`` gives back whole: cells keep carriage returns, outer blanks, and null apart from empty.

    Cells are escaped before quoting: a backslash is ``\\b``, a carriage return ``\\r``, empty ``\\E``, null ``\\N``; see ``csv_value``.
    """
    cells = [_csv_cell(F.col(f"`{c}`").cast("string")).alias(c) for c in df.columns]
    df.select(*cells).write.options(header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def _csv_cell(c: Column) -> Column:
    kept = F.replace(F.replace(c, F.lit("\\"), F.lit("\\b")), F.lit("\r"), F.lit("\\r"))
    return F.when(c == "", F.lit("\\E")).otherwise(F.coalesce(kept, F.lit("\\N")))


def csv_value(c: Column) -> Column:
    """The text behind a cell of ``write_csv``."""
    return F.when(c == "\\E", F.lit("")).when(c != "\\N", F.replace(F.replace(c, F.lit("\\r"), F.lit("\r")), F.lit("\\b"), F.lit("\\")))


def write_wrapped(lines: DataFrame, path: str, before: str, between: str, after: str) -> None:
    """The one text column of ``lines`` as text files that each begin with ``before``, end with ``after`` and are valid on their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = before
        for batch in batches:
            texts = []
            for text in batch.column(0).to_pylist():
                texts.append(lead + text)
                lead = between
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([(before if lead is before else "") + after], pa.string())], names=["value"])

    lines.mapInArrow(run, "value string").write.text(path)


def write_rss(df: DataFrame, path: str) -> None:
    """RSS files, one per partition, from the columns ``guid, title, description, link, pubDate, source, source_url``."""

    def clean(c: str) -> Column:
        out = F.coalesce(F.col(c), F.lit(""))
        for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):  # a parser reads a bare CR LF as LF
            out = F.replace(out, F.lit(sign), F.lit(entity))
        return out

    parts = [F.concat(F.lit(f"<{n}>"), clean(n), F.lit(f"</{n}>")) for n in ("title", "link", "pubDate", "description")]
    guid = F.concat(F.lit('<guid isPermaLink="false">'), clean("guid"), F.lit("</guid>"))
    source = F.concat(F.lit('<source url="'), F.replace(clean("source_url"), F.lit('"'), F.lit("&quot;")), F.lit('">'), clean("source"), F.lit("</source>"))
    write_wrapped(df.select(F.concat(F.lit("<item>"), guid, *parts, source, F.lit("</item>")).alias("value")), path, '<?xml version="1.0" encoding="UTF-8"?>\n<rss version="2.0"><channel>', "", "</channel></rss>")


def read_jsonl(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """JSON lines (a file, folder or glob) with primitives as strings."""
    return spark.read.option("primitivesAsString", True).json(path)


def read_rss(spark: SparkSession, path: str | Sequence[str], **tags: Column) -> DataFrame:
    """Items of RSS files as flat string columns, trimmed; absent elements are empty strings.

    ``raw_payload`` is the item's own XML. ``tags`` (columns that may read ``_metadata``) are stamped on every
    item, as the feed's country, language and query. A file whose root is not ``rss`` (a captcha page, say) is
    an error that names it; a feed without items is none.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("xml"), F.col("_metadata.file_path").alias("file"), *[c.alias(n) for n, c in tags.items()])
    root = F.regexp_extract("xml", r"(?s)^(?:\ufeff|\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>]*>)*<([A-Za-z_][\w.:-]*)", 1)
    if odd := [r[0] for r in files.where(root != "rss").select("file").limit(5).collect()]:
        raise ContractError(f"no RSS in {odd}")
    items = files.select(F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)(<item(?:\s[^>]*)?>.*?</item>)"), 1)).alias("raw_payload"), *tags)
    element = "guid string, title string, description string, link string, pubDate string, source struct<_VALUE string, _url string>"
    parsed_item = F.from_xml("raw_payload", element, {"mode": "PERMISSIVE", "rowTag": "item"})
    parts = items.select("raw_payload", parsed_item.alias("i"), *tags)
    text = lambda c: F.coalesce(trim_all(c), F.lit(""))
    guid = F.regexp_extract("raw_payload", r"(?s)<guid[^>]*>(.*?)</guid>", 1)  # its attributes make it no plain string
    named = {n: text(F.col(f"i.{n}")) for n in ("title", "description", "link", "pubDate")}
    return parts.select(text(_xml_text(guid)).alias("guid"), *[c.alias(n) for n, c in named.items()], text(F.col("i.source._VALUE")).alias("source"), text(F.col("i.source._url")).alias("source_url"), "raw_payload", *tags)


def _xml_text(inner: Column) -> Column:
    """The text of an element without children: CDATA unwrapped, else the five entities of XML decoded."""
    out = inner
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#13;", "\r"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    cdata = F.regexp_extract(inner, r"(?s)^\s*<!\[CDATA\[(.*?)\]\]>\s*$", 1)
    return F.when(cdata != "", cdata).otherwise(out)


def read_odata(spark: SparkSession, path: str, row_cap: int | None = None, fetched_at: str | None = None) -> DataFrame:
    """Rows of an OData envelope, stamped with ``_fetched_at``.

    An envelope without rows, and a response as long as the server's cap, which may be cut off, are refused.
    """
    envelope = spark.read.options(multiLine=True, primitivesAsString=True).json(path)
    if "value" not in envelope.columns or not hasattr(envelope.schema["value"].dataType, "elementType") or not hasattr(envelope.schema["value"].dataType.elementType, "fields"):
        raise ContractError(f"{path}: an envelope without rows")
    rows = envelope.select(F.explode("value").alias("v")).select("v.*")
    if row_cap is not None and rows.limit(row_cap).count() >= row_cap:
        raise ContractError(f"{path}: {row_cap} rows or more, the response may be cut off")
    return rows.withColumn("_fetched_at", F.lit(fetched_at)) if fetched_at is not None else rows


def _features(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    found = spark.read.options(multiLine=True).json(path)
    if "features" not in found.columns or found.where(F.size("features") > 0).isEmpty():
        raise ContractError(f"{path}: no features")
    return found.select(F.explode("features").alias("f"))


def read_geojson(spark: SparkSession, path: str | Sequence[str], properties: dict[str, str]) -> DataFrame:
    """Features with chosen ``properties`` (column -> property), the geometry and all properties as JSON text."""
    f = _features(spark, path)
    have = set(f.schema["f"].dataType["properties"].dataType.names)
    picked = [(F.col(f"f.properties.`{src}`").cast("string") if src in have else F.lit(None).cast("string")).alias(name) for name, src in properties.items()]
    return f.select(*picked, F.to_json("f.geometry").alias("geometry"), F.to_json("f.properties").alias("properties_raw"))


def read_geojson_flat(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Features with every property as a string column of a safe name; JSON nulls are empty strings."""
    f = _features(spark, path).select(F.from_json(F.to_json("f.properties", {"ignoreNullFields": "false"}), MapType(StringType(), StringType())).alias("p"), F.to_json("f.geometry").alias("geometry"))
    names = [r[0] for r in f.select(F.explode(F.map_keys("p")).alias("k")).distinct().orderBy("k").collect()]  # bounded by the schema
    return f.select(*[F.coalesce(F.col("p")[n], F.lit("")).alias(s) for n, s in zip(names, snake_columns(names))], "geometry")


def unzip_member(archive: str, pattern: str, folder: str) -> str:
    """Path of the one member that matches ``pattern``, extracted through a temporary name."""
    with zipfile.ZipFile(archive) as z:
        names = [n for n in z.namelist() if Path(n).match(pattern)]
        if len(names) != 1:
            raise ContractError(f"{archive}: {len(names)} members match {pattern}")
        target = Path(folder, Path(names[0]).name)
        target.parent.mkdir(parents=True, exist_ok=True)
        part = target.with_suffix(target.suffix + ".part")
        with z.open(names[0]) as src, part.open("wb") as dst:
            shutil.copyfileobj(src, dst)
        part.replace(target)
    return str(target)


def read_zipped_geojson(spark: SparkSession, archive: str, pattern: str, folder: str, properties: dict[str, str]) -> DataFrame:
    """Features of the one member of an archive that matches ``pattern``."""
    return read_geojson(spark, unzip_member(archive, pattern, folder), properties)


def read_seed(spark: SparkSession, seed: str, landing: str) -> tuple[DataFrame, str]:
    """(rows, version) of a CSV kept with the code: it is copied below ``landing`` under its version, 12 digits of its SHA-256."""
    version = file_digest(seed)[:12]
    target = Path(landing, version, Path(seed).name)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    shutil.copyfile(seed, part)
    part.replace(target)
    return read_csv(spark, str(target)), version


def sheet_to_csv(workbook: str, sheet: str, target: str) -> dict[str, str]:
    """One sheet as CSV of text cells with safe headers; returns and stores the header map. Needs openpyxl."""
    try:
        import openpyxl  # noqa: F401
    except ImportError as e:
        raise ContractError("reading workbooks needs openpyxl") from e
    import pandas as pd

    frame = pd.read_excel(workbook, sheet_name=sheet, dtype=str, keep_default_na=False)
    names = dict(zip(map(str, frame.columns), snake_columns(map(str, frame.columns))))
    frame.set_axis(list(names.values()), axis=1).to_csv(target, index=False)
    Path(target).with_suffix(".columns.json").write_text(json.dumps(names, ensure_ascii=False, indent=1))
    return names


def file_column(df: DataFrame) -> Column | None:
    """The path of each row's file below the landing folder, where the frame still is a file scan."""
    try:
        df.select("_metadata.file_path")
    except AnalysisException:
        return None
    return below(F.col("_metadata.file_path"), "landing")


def with_lineage(df: DataFrame, source: str, ingested_at: str, ingestion_date: str | None = None, source_file: Column | None = None) -> DataFrame:
    """``_source``, ``_ingested_at``, ``_source_file`` (below the landing folder) and the partition day."""
    file = source_file if source_file is not None else below(F.col("_metadata.file_path"), "landing")
    out = df.select("*", file.alias("_source_file"), F.lit(source).alias("_source"), F.lit(ingested_at).alias("_ingested_at"))
    return out.withColumn("ingestion_date", F.lit(ingestion_date)) if ingestion_date else out


def without_comments(df: DataFrame) -> DataFrame:
    """Rows whose first column does not begin with ``#`` (annotation rows of tagged spreadsheets)."""
    return df.where(~F.startswith(F.coalesce(F.col(f"`{df.columns[0]}`"), F.lit("")), F.lit("#")))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """All rows; columns that a frame lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
