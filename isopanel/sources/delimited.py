"""CSV, TSV and id lists as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_delimited(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, sep: str = ",") -> DataFrame:
    """Rows of CSV files, or of others by sep, gz or not; only the columns asked for are parsed, and broken rows are an error."""
    found = spark.read.schema(schema).options(header=True, sep=sep, mode="FAILFAST", escape='"', multiLine=False).csv(path)
    return found.select(*columns) if columns else found


def write_delimited(df: DataFrame, path: str, sep: str = ",", gz: bool = False) -> None:
    """A folder of parts with a header each; Spark commits it whole or not at all."""
    df.write.options(header=True, sep=sep, escape='"', **({"compression": "gzip"} if gz else {})).csv(path)


def plain_or_gz(spark: SparkSession, path: str) -> str:
    """path where it exists, else path.gz."""
    file = spark._jvm.org.apache.hadoop.fs.Path(path)
    return path if file.getFileSystem(spark._jsc.hadoopConfiguration()).exists(file) else f"{path}.gz"


def read_seeds(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All CSV files of a pattern, with the seed that is named in each one's path as seed<n>, seed_<n> or seed=<n>."""
    seed = F.regexp_extract(F.col("_metadata.file_path"), r"seed[_=]?(\d+)", 1)
    rows = spark.read.schema(schema).options(header=True, mode="FAILFAST").csv(path)
    return rows.select(F.when(seed != "", seed.cast("int")).alias("seed"), *rows.columns)


def id_parts(line: Column) -> Column:
    """lineage|date|accession as a struct; a line of fewer parts is an accession."""
    parts = F.split(F.trim(line), r"\|")
    whole = F.size(parts) >= 3
    part = lambda n: F.when(whole, F.trim(F.get(parts, F.lit(n)))).otherwise(F.lit(""))
    return F.struct(part(0).alias("lineage"), part(1).alias("day"), F.when(whole, part(2)).otherwise(F.trim(F.element_at(parts, -1))).alias("accession"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(lineage, day, accession) of the lines of an id list that aren't blank."""
    return spark.read.text(path).where(F.trim("value") != "").select(id_parts(F.col("value")).alias("id")).select("id.*")
