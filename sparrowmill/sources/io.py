"""Typed readers, layered tables, fitted parameters and submissions. Everything goes through Spark's own readers and
writers, so any Hadoop path works and no chunk loop is needed."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPE_CODES = {"clicks": 0, "carts": 1, "orders": 2}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the folder that driver and executors share (spark.checkpoint.dir; a local one in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch path and read back, so that lineage ends at the files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that one task sorts or groups, about.
TASK_ROWS = 1_000_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df, of that many rows, dealt by its keys to a task for each TASK_ROWS; as it is while the session's cores hold no more each.

    Left alone, Spark merges a shuffle's partitions to as few as there are cores, or to 64 MB as sent, which is many times that
    when sorted; a number that is asked for stays, so a task's memory doesn't grow with the table.
    """
    tasks = math.ceil(rows / TASK_ROWS)
    return df.repartition(tasks, *keys) if tasks > df.sparkSession.sparkContext.defaultParallelism else df


def mount(spark: SparkSession, store: str, folder: str, target: str, options: dict[str, str] | None = None) -> str:
    """viewfs://store/folder, behind which stands `target`, a folder of any file system that Hadoop knows (s3a, gs, hdfs, file).

    Jobs so name a store and not a bucket. options: further Hadoop settings, such as an endpoint or a provider of credentials.
    """
    settings = spark._jsc.hadoopConfiguration()
    for key, value in (options or {}).items():
        settings.set(key, value)
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    settings.set(f"fs.viewfs.mounttable.{store}.link./{folder}", path.getFileSystem(settings).makeQualified(path).toString())
    return f"viewfs://{store}/{folder}"


def objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime of the objects below a path of any scheme; contents are not read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return found.select("path", "length", "modificationTime")


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header and declared types, pruned to `columns`. Ids declared as strings keep leading zeros."""
    df = spark.read.schema(schema).csv(path, header=True)
    return df.select(*columns) if columns else df


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of sessions with nested events, one row per event: session, aid, ts, type (a code)."""
    df = spark.read.schema("session long, events array<struct<aid:long, ts:long, type:string>>").json(path)
    code = F.create_map(*[F.lit(x) for kv in TYPE_CODES.items() for x in kv])
    flat = df.select("session", F.inline("events"))
    return flat.select("session", "aid", "ts", F.element_at(code, F.col("type")).cast("int").alias("type"))


def read_chunks(source, spark: SparkSession | None = None, schema: str | None = None) -> DataFrame | None:
    """A path becomes a partitioned scan; whole frames and None pass through."""
    return read_csv(spark, source, schema) if isinstance(source, str) else source


def read_days(spark: SparkSession, path: str, start: str, end: str, sample_size: int | None = None) -> DataFrame:
    """A date range of a table partitioned by event_date; the range prunes partitions. sample_size: rows by hash order."""
    df = spark.sql("SELECT * FROM {days} WHERE event_date BETWEEN CAST(:start AS DATE) AND CAST(:end AS DATE)", args={"start": start, "end": end}, days=spark.read.parquet(path))
    return df if sample_size is None else df.orderBy(F.md5(F.to_json(F.struct(*df.columns)))).limit(sample_size)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Metrics and other small records as JSON lines."""
    df.write.mode("overwrite").json(path)


class Layers:
    """Numbered folders of tables: write a step's result, read it back with its lineage cut."""

    NAMES = ("01_raw", "02_intermediate", "03_primary", "04_feature", "05_model_input", "06_models", "07_model_output", "08_reporting")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, layer: int, name: str) -> str:
        return f"{self.root}/{self.NAMES[layer - 1]}/{name}"

    def write(self, df: DataFrame, layer: int, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(layer, name))
        return self.read(layer, name)

    def read(self, layer: int, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(layer, name))


def finished(spark: SparkSession, path: str, by: str) -> set[int]:
    """The numbers n of the folders {path}/{by}=n that a writer has completed, in any file system Spark reads."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{by}=*/_SUCCESS")) if files.exists(root) else []
    return {int(f.getPath().getParent().getName().split("=")[1]) for f in found or []}


def save_params(spark: SparkSession, rows: list[tuple[str, str, str]], path: str) -> None:
    """Fitted parameters (step, column, value) as a table, so that a later run can apply them."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("step", "column", "value")])
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_params(spark: SparkSession, path: str) -> list[tuple[str, str, str]]:
    return sorted(tuple(r) for r in spark.read.parquet(path).collect())


def submission(df: DataFrame, id_col: str, items_col: str) -> DataFrame:
    """id and its items joined by spaces."""
    return df.select(id_col, F.array_join(F.col(items_col).cast("array<string>"), " ").alias("prediction"))
