"""Landed files as rows, and result files (survey S6, S16, S20, S24, S26)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from pitchside.functions.text import last_segment


def read_csv(spark: SparkSession, path: str, schema: StructType, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed rows with their cells as strings). Malformed: a cell that its type can't hold, or a required one that is empty.

    Cells are read as strings and cast here, since the reader's own record of corrupt rows depends on
    which columns a query happens to read. Cells beyond the schema are ignored, lacking ones are null.
    """
    cells = StructType([StructField(f.name, StringType()) for f in schema.fields])
    rows = spark.read.csv(path, schema=cells, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    bad = F.lit(False)
    for f in schema.fields:
        bad = bad | (F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
    for c in required:
        bad = bad | F.col(c).isNull()
    return rows.filter(~bad).select(*[F.col(f.name).cast(f.dataType) for f in schema.fields]), rows.filter(bad)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.json(path, schema=schema)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Whole files: path, post_id, html, sha256 and when they were changed."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.regexp_replace(last_segment(F.col("path")), r"\.html?$", "").alias("post_id"), F.col("content").cast("string").alias("html"), F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"))


def write_csv(rows: DataFrame, path: str, sep: str = ",") -> None:
    """RFC 4180: quotes are doubled. With a tab as separator this is TSV."""
    rows.write.mode("overwrite").csv(path, header=True, sep=sep, quote='"', escape='"')


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def sitemap_entries(pages: DataFrame, base: str) -> DataFrame:
    """One url element for each row of (path, modified); a null date is left out."""
    day = F.date_format("modified", "yyyy-MM-dd")
    place = F.regexp_replace(F.regexp_replace(F.concat(F.lit(base), F.col("path")), "&", "&amp;"), "<", "&lt;")
    return pages.select(F.concat(F.lit("<url><loc>"), place, F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), day, F.lit("</lastmod>")), F.lit("")), F.lit("</url>")).alias("value"))
