"""Catalogue helpers: country routing, partition pruning, metadata as tables, views and refreshed tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import civil


def places_of(places: DataFrame, country: str, sample: bool = False) -> DataFrame:
    """One country's places; the country is a partition column where the table is stored."""
    if not re.fullmatch("[a-z]{2}", country):
        raise ValueError(f"no country code: {country!r}")
    chosen = places.where(F.col("country") == country)
    return chosen.where("is_sample") if sample else chosen


def scan_between(df: DataFrame, first: str, last: str, time: str = "record_time", day: str = "record_date") -> DataFrame:
    """Rows of an inclusive window; a day column, if there is one, is bounded too, so that partitions are pruned."""
    out = df.where(civil.between(time, first, last))
    return out.where(F.col(day).between(F.lit(first[:10]).cast("date"), F.lit(last[:10]).cast("date"))) if day in df.columns else out


def latest_partition(spark: SparkSession, path: str, column: str = "record_date") -> str | None:
    """The greatest value of a partition column, from the folder listing alone."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p) if s.isDirectory()]
    values = [n.partition("=")[2] for n in names if n.startswith(f"{column}=")]
    return max((v for v in values if v != "__HIVE_DEFAULT_PARTITION__"), default=None)


def scan_latest(spark: SparkSession, path: str, column: str = "record_date") -> DataFrame:
    """The rows of the latest partition; other partitions are not read."""
    latest = latest_partition(spark, path, column)
    df = spark.read.parquet(path)
    return df.where(F.col(column) == F.lit(latest)) if latest is not None else df.where("false")


def partition_inventory(spark: SparkSession, path: str, table: str, column: str | None = None) -> DataFrame:
    """Per partition rows, bytes and last modification; the bytes add up to those of the files.

    Sizes and times come from the files' metadata columns. A file with rows of
    several partitions counts for each by its share of the file's rows.
    """
    df = spark.read.parquet(path)
    day = F.date_format(column, "yyyyMMdd") if column and dict(df.dtypes)[column] != "string" else F.col(column) if column else F.lit("__UNPARTITIONED__")
    files = df.groupBy(F.coalesce(day, F.lit("__NULL__")).alias("partition_id"), F.col("_metadata.file_path").alias("file")).agg(F.count("*").alias("rows"), F.first("_metadata.file_size").alias("bytes"), F.max("_metadata.file_modification_time").alias("modified"))
    whole = F.sum("rows").over(Window.partitionBy("file"))
    shared = files.withColumn("bytes", F.col("bytes") * F.col("rows") / whole)
    out = shared.groupBy("partition_id").agg(F.sum("rows").alias("total_rows"), F.round(F.sum("bytes")).cast("long").alias("total_logical_bytes"), F.max("modified").alias("last_modified_time"))
    return out.select(F.lit(table).alias("table_name"), "partition_id", "total_rows", "total_logical_bytes", F.col("total_logical_bytes").alias("total_billable_bytes"), "last_modified_time", F.lit("ACTIVE").alias("storage_tier"))


_EVENTS = (
    "Event string, executionId long, description string, physicalPlanDescription string, time long, `Stage IDs` array<long>, `Stage ID` long, Properties map<string,string>, `User` string,"
    " `Task Metrics` struct<`Input Metrics`:struct<`Bytes Read`:long>>, `App ID` string"
)


def job_log(spark: SparkSession, path: str) -> DataFrame:
    """Spark's event logs as a job log: a row per SQL execution, with its text and the bytes its tasks read."""
    e = spark.read.schema(_EVENTS).json(path).withColumn("file", F.col("_metadata.file_path"))
    of = lambda name: e.where(F.col("Event").endswith(name))
    apps = of("SparkListenerApplicationStart").select("file", F.col("User").alias("user_email"), F.col("App ID").alias("app"))
    started = of("SparkListenerSQLExecutionStart").select("file", "executionId", F.col("description").alias("query"), F.timestamp_millis("time").cast("timestamp_ntz").alias("creation_time"), F.col("physicalPlanDescription").alias("plan"))
    jobs = of("SparkListenerJobStart").select("file", F.col("Properties")["spark.sql.execution.id"].try_cast("long").alias("executionId"), F.explode("Stage IDs").alias("stage")).where("executionId is not null").distinct()
    read = of("SparkListenerTaskEnd").groupBy("file", F.col("Stage ID").alias("stage")).agg(F.sum("Task Metrics.Input Metrics.Bytes Read").alias("bytes"))
    processed = jobs.join(read, ["file", "stage"]).groupBy("file", "executionId").agg(F.sum("bytes").alias("bytes"))
    kind = F.when(F.col("plan").rlike("(?i)InsertInto|CreateDataSourceTable|Append|Overwrite"), "INSERT").otherwise("SELECT")
    joined = started.join(processed, ["file", "executionId"], "left").join(apps, "file", "left")
    volume = F.coalesce("bytes", F.lit(0)).cast("long")
    return joined.select(F.concat_ws("_", "app", "executionId").alias("job_id"), "user_email", "creation_time", F.lit("QUERY").alias("job_type"), kind.alias("statement_type"), "query", volume.alias("total_bytes_billed"), volume.alias("total_bytes_processed"))


def registered(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables and views of the session's catalogue, with their kinds and the texts that define views; a row each."""
    rows = []
    for t in spark.catalog.listTables(database):
        view = t.tableType in ("VIEW", "TEMPORARY")
        name = ".".join(f"`{x}`" for x in [*(t.namespace or []), t.name])
        known = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {name}").collect()} if view else {}
        rows.append((t.namespace[-1] if t.namespace else "", t.name, "VIEW" if view else "BASE TABLE", t.description, known.get("View Text")))
    return spark.createDataFrame(rows, "table_schema string, table_name string, table_type string, description string, view_definition string")


def create_dataset(spark: SparkSession, name: str, comment: str = "") -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` COMMENT {_quoted(comment)}")


def drop_dataset(spark: SparkSession, name: str, with_tables: bool = False) -> None:
    """Tables in it are an error unless they are to go too."""
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` {'CASCADE' if with_tables else 'RESTRICT'}")


def create_table(spark: SparkSession, name: str, schema: str, partition_by: str, cluster_by: str, buckets: int = 64) -> None:
    """An empty table with a partition column, its rows bucketed and sorted by the cluster key."""
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet PARTITIONED BY (`{partition_by}`) CLUSTERED BY (`{cluster_by}`) SORTED BY (`{cluster_by}`) INTO {int(buckets)} BUCKETS")


def back_up(spark: SparkSession, tables: list[str], dataset: str, suffix: str = "") -> list[str]:
    """Full copies of tables in another dataset, replaced if they are there; returns their names."""
    names = [f"{dataset}.{t.rpartition('.')[2]}{suffix}" for t in tables]
    for source, copy in zip(tables, names, strict=True):
        spark.table(source).write.mode("overwrite").saveAsTable(copy)
    return names


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_view(spark: SparkSession, name: str, sql: str, columns: dict[str, str], comment: str) -> None:
    """A view with described columns; sql must name its tables in the catalogue."""
    listed = ", ".join(f"`{c}` COMMENT {_quoted(d)}" for c, d in columns.items())
    spark.sql(f"CREATE OR REPLACE VIEW `{name}` ({listed}) COMMENT {_quoted(comment)} AS {sql}")


class Materialized:
    """A table kept as the result of a query, replaced as a whole on refresh."""

    def __init__(self, spark: SparkSession, name: str, build: Callable[[], DataFrame], cluster_by: str, comments: dict[str, str] | None = None, comment: str = ""):
        self.spark, self.name, self.build, self.cluster_by = spark, name, build, cluster_by
        self.comments, self.comment = comments or {}, comment

    def refresh(self) -> DataFrame:
        """Rows of one cluster key lie together, so row groups are skipped by its statistics."""
        df = self.build()
        for c, text in self.comments.items():
            df = df.withMetadata(c, {"comment": text})
        df.repartition(self.cluster_by).sortWithinPartitions(self.cluster_by).write.mode("overwrite").option("comment", self.comment).saveAsTable(self.name)
        return self.spark.table(self.name)


def append_snapshot(current: DataFrame, path: str, as_of=None) -> DataFrame:
    """Appends the current state with its time, in a folder a day; rows of a key lie together."""
    stamped = current.select((F.lit(as_of).cast("timestamp") if as_of is not None else F.current_timestamp()).alias("snapshot_time"), *current.columns)
    dated = stamped.withColumn("snapshot_date", F.to_date("snapshot_time")).sortWithinPartitions(current.columns[0])
    dated.write.mode("append").partitionBy("snapshot_date").parquet(path)
    return current.sparkSession.read.parquet(path)


def drop_old_partitions(spark: SparkSession, path: str, keep_from: str, column: str = "record_date") -> list[str]:
    """Removes the folders of partitions before a value; returns their names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    gone = []
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if s.isDirectory() and name.startswith(f"{column}=") and name.partition("=")[2] < keep_from:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return sorted(gone)


#: Statements that an agent may run: queries only.
_READS = re.compile(r"^\s*(?:\(|SELECT\b|WITH\b|VALUES\b|FROM\b|TABLE\b)", re.I)


#: Functions that run code of the JVM by name.
_REFLECTS = re.compile(r"\b(?:try_reflect|reflect|java_method)\s*\(", re.I)


def read_only_sql(spark: SparkSession, sql: str) -> DataFrame:
    """Runs a query over tables and views of the catalogue.

    Refused are commands, by the first word and by what the parser makes of it;
    files named by their path, which are no part of the catalogue; and functions
    that call any method of the JVM.
    """
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    names = plan.treeString()
    if not _READS.match(sql) or re.search(r"(?m)^\W*(?:Insert|Create|Drop|Alter|Delete|Update|Merge|Truncate|Command|Set|Replace|Append|Overwrite|Load|Cache|Refresh)\w*\b", names):
        raise PermissionError("only queries may run here")
    # A relation is named in the catalogue or by the query itself; `format`.`path` is neither.
    for relation in re.findall(r"UnresolvedRelation \[([^\]]*)\]", names):
        parts = [x.strip() for x in relation.split(",")]
        if len(parts) > 1 and not spark.catalog.tableExists(".".join(f"`{x}`" for x in parts)) or any("/" in x or "\\" in x for x in parts):
            raise PermissionError(f"no table of the catalogue: {relation}")
    df = spark.sql(sql)
    if _REFLECTS.search(sql) or "CallMethodViaReflection" in df._jdf.queryExecution().analyzed().toJSON():
        raise PermissionError("only queries without calls into the JVM may run here")
    return df


def capped(df: DataFrame, limit: int = 100_000) -> tuple[list, bool]:
    """At most so many rows for a screen, and whether there are more."""
    rows = df.limit(limit + 1).collect()
    return rows[:limit], len(rows) > limit


def to_pandas(df: DataFrame, limit: int = 1_000_000):
    """A result for a notebook; more rows than the limit is an error, as they would all go to the driver."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows; aggregate or write them first")
    return df.toPandas()
