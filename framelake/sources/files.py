"""Readers and writers of manifests, JSON, JSON Lines and feature stores. All go through Spark's file sources, so any store works."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framelake import schema
from framelake.operators.features import require_store


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def require_input(spark: SparkSession, path: str) -> str:
    if not _exists(spark, path):
        raise FileNotFoundError(f"no such input: {path}")
    return path


def _number(column: str, kind: str):
    """A required number: surrounding white space is allowed; anything else that is no number is an error."""
    text = F.trim(column)
    value = F.regexp_replace(text, r"(?<=\d)_(?=\d)", "").try_cast(kind)
    return F.when(value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.lit(f"{column} is no number: "), F.coalesce(text, F.lit("null")))).cast(kind)).alias(column)


def _optional_int(column: str):
    return F.when(F.coalesce(F.trim(column), F.lit("")) != "", _number(column, "int")).alias(column)


def _optional_bool(column: str):
    """Blank is null; true or false in any case; the rest, padded values too, is an error."""
    low = F.lower(column)
    bad = F.raise_error(F.concat(F.lit(f"{column} is neither true nor false: "), column)).cast("boolean")
    return F.when(F.coalesce(F.trim(column), F.lit("")) == "", F.lit(None)).when(low.isin("true", "false"), low == "true").otherwise(bad).alias(column)


def read_manifest(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Videos from a CSV with a header, whose further columns are ignored. strict: a row that breaks an invariant is an error."""
    require_input(spark, path)
    raw = spark.read.option("header", True).option("inferSchema", False).option("multiLine", False).csv(path)
    wanted = T._parse_datatype_string(schema.VIDEO).fieldNames()
    if missing := [c for c in wanted if c not in raw.columns]:
        raise ValueError(f"the manifest lacks {', '.join(missing)}")
    text = {c: F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("video_id", "relative_path", "batch_id", "dataset_version")}
    typed = raw.select(
        text["video_id"], text["relative_path"], text["batch_id"], _number("fps", "double"), _number("total_frames", "bigint"), _number("duration_ms", "bigint"),
        _optional_int("width"), _optional_int("height"), _optional_bool("has_audio"), text["dataset_version"],
    )
    if not strict:
        return schema.with_violations(typed, "video")
    # numbers are read in a filter, so that a bad one is an error whichever columns are used
    read = F.struct(*(typed[c] for c in ("fps", "total_frames", "duration_ms", "width", "height", "has_audio")))
    return schema.require(typed.where(F.xxhash64(read).isNotNull()), "video")


def write_manifest(videos: DataFrame, path: str) -> None:
    """CSV with the stable column order; null is empty, booleans are True and False."""
    names = T._parse_datatype_string(schema.VIDEO).fieldNames()
    out = videos.select(*names).withColumn("has_audio", F.when(F.col("has_audio"), "True").when(~F.col("has_audio"), "False"))
    out.write.mode("overwrite").option("header", True).csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_jsonl(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Rows of one object a line; blank lines are skipped; a line that is no such object is an error."""
    return spark.read.schema(ddl).option("mode", "FAILFAST").json(require_input(spark, path))


def read_json_list(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Rows of a file that holds one array of objects."""
    return spark.read.schema(ddl).option("multiLine", True).option("mode", "FAILFAST").json(require_input(spark, path))


def save_features(features: DataFrame, path: str) -> None:
    """A feature store: Parquet with the vector in its row."""
    require_store(features).write.mode("overwrite").parquet(path)


def load_features(spark: SparkSession, path: str) -> DataFrame:
    return require_store(spark.read.parquet(require_input(spark, path)))
