"""Reading what sources send: JSON arrays, CSV, Markdown with front matter, tables; every landed value is text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_provenance(df: DataFrame, system: str, batch_id: str, correlation_id: str, ingested_at: Column, columns: list[str] | None = None) -> DataFrame:
    """Columns that say where a row came from: the payload as JSON with sorted keys, and its MD5."""
    keys = sorted(columns or df.columns)
    payload = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
    return df.withColumn("src_payload", payload).withColumns({"_src_system": F.lit(system), "_batch_id": F.lit(batch_id), "_correlation_id": F.lit(correlation_id),
        "_ingested_at": ingested_at, "_row_hash": F.md5("src_payload")})


def json_array(spark: SparkSession, path: str, mapping: dict[str, str]) -> DataFrame:
    """A file that holds one JSON array (or a folder of them): the mapped fields as text under their new names, with the file. Fields that are missing are NULL."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in mapping])
    raw = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return raw.select(*(F.col(f"`{k}`").alias(v) for k, v in mapping.items()), F.col("_metadata.file_path").alias("_src_file"))


def json_records(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """Lines of JSON projected by paths ($.a.b) as text; lines that can't be read are kept in _corrupt_record, all fields NULL."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_src_file"))
    parsed = lines.withColumn("_v", F.try_parse_json("value"))
    ok = F.col("_v").isNotNull()
    return parsed.select(*(F.when(ok, F.try_variant_get("_v", p, "string")).alias(n) for n, p in fields.items()), F.when(~ok, F.col("value")).alias("_corrupt_record"), "_src_file")


#: Text that stands for NULL in CSV files.
NULL_IF = ("", "NULL", "null", "N/A", "\\N")


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with a header and optional quotes; blanks around values go, NULL_IF are NULL, ragged rows are tolerated."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE", enforceSchema=True)
    return raw.select(*(F.when(~F.trim(c).isin(*NULL_IF), F.trim(c)).alias(c) for c in columns))


def markdown(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Markdown files with front matter between --- lines: its keys, the body and the file; without front matter all is body."""
    raw = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("source_uri"))
    has = F.col("value").startswith("---")
    parts = F.split("value", "---", 3)
    front = F.when(has, F.element_at(parts, 2))
    field = lambda k: F.nullif(F.trim(F.regexp_extract(front, rf"(?m)^\s*{k}\s*:(.*)$", 1)), F.lit(""))
    return raw.select(*(field(k).alias(k) for k in keys), F.trim(F.regexp_replace(F.when(has, F.element_at(parts, 3)).otherwise(F.col("value")), r"^\s+|\s+$", "")).alias("body"), "source_uri")


def since(df: DataFrame, column: str, mark: str | None) -> DataFrame:
    """Rows from a high-water mark on; all without one."""
    return df if mark is None else df.where(F.col(column) >= mark)


def catalogue(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and columns of a database (without a session's views), or of the current one and the session's views."""
    tables = [t for t in spark.catalog.listTables(database) if not (database and t.isTemporary)]
    rows = [(t.name, c.name, c.dataType, c.nullable) for t in tables for c in spark.catalog.listColumns(f"{database}.{t.name}" if database else t.name)]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string, nullable boolean")
