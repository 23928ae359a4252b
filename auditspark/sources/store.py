"""Key-value JSON files of settings and lists as tables, on any file system that Spark knows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "array<struct<domain:string,reason:string,date:string>>"


def safe_key(key):
    """A file name for a key."""
    return F.regexp_replace(key, "[^a-zA-Z0-9_-]", "_")


#: The folder of values that were written: a row per write, of which the last one of a key counts.
LOG, WRITTEN = "values.parquet", "key string, value string, written_at timestamp"


def _json(value):
    return F.try_parse_json(value).isNotNull()


def read_values(spark: SparkSession, path: str) -> DataFrame:
    """A row per key: its whole text, from what was last written or else from the file of its name.

    ``corrupt`` tells of texts that are no JSON, which count as absent; their keys are free for a new value, and the file
    stays where it is. Call again to see what was written since.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(path)
    files = files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("key"), F.decode("content", "UTF-8").alias("value"))
    try:
        log = spark.read.schema(WRITTEN).parquet(f"{path}/{LOG}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        log = spark.createDataFrame([], WRITTEN)
    last = log.groupBy("key").agg(F.max_by("value", "written_at").alias("value")).where("value is not null")
    return last.unionByName(files.join(log.select("key").distinct(), "key", "left_anti")).select("key", "value", (~_json(F.col("value"))).alias("corrupt"))


def read_entries(values: DataFrame, key: str) -> DataFrame:
    """The rows of a stored list, in order; malformed ones go."""
    rows = values.where((F.col("key") == key) & ~F.col("corrupt")).select(F.posexplode(F.from_json("value", ENTRY)).alias("pos", "e"))
    return rows.select(F.col("pos").cast("long").alias("pos"), "e.domain", "e.reason", F.col("e.date").try_cast("timestamp").alias("date")).where("domain is not null")


def write_value(spark: SparkSession, path: str, key: str, value: str | None) -> None:
    """Sets a key, or takes it away if the value is null. A write adds a file in one commit, so that readers see the value before or after, never a part of one."""
    row = spark.createDataFrame([(key, value)], "key string, value string")
    row.select(safe_key("key").alias("key"), "value", F.current_timestamp().alias("written_at")).coalesce(1).write.mode("append").parquet(f"{path}/{LOG}")


def migrate(legacy: DataFrame, present: DataFrame) -> DataFrame:
    """Values of a legacy store whose keys are not yet present; values that are no strings go."""
    return legacy.where("value is not null").join(present.select("key"), "key", "left_anti")
