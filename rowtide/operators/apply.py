"""What consumers do with change rows: latest state, diffs, cache actions, labels."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rowtide.functions import statements as S
from rowtide.sources import folders


def current(before: str = "before", after: str = "after") -> Column:
    return F.coalesce(F.col(after), F.col(before))


def latest_state(found: DataFrame, key: list[str], order: list[str], keep: Column | None = None) -> DataFrame:
    """The last row of each key that isn't deleted; ``keep``: a condition on that row, such as that it is active.

    One shuffle: the last row of a key is a maximum, so Spark combines rows before it sends them.
    """
    rest = [c for c in found.columns if c not in key]
    last = found.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*key, "__last.*")
    last = last.filter("op <> 'DELETE'")
    return last if keep is None else last.filter(keep)


def changed_columns(before: str = "before", after: str = "after") -> Column:
    """Names of the columns whose values differ; nulls equal each other."""
    both = F.arrays_zip(F.col(before).alias("x"), F.col(after).alias("y"))
    return F.transform(F.filter(both, lambda z: ~z["x"].eqNullSafe(z["y"])), lambda z: z["y"]["name"])


def cache_actions(found: DataFrame, templates: dict[str, str], key: Column) -> DataFrame:
    """(action, cache_key): set on INSERT, invalidate on UPDATE, evict on DELETE; templates: a format for each table."""
    name = F.lit(None).cast("string")
    for table, form in templates.items():
        name = F.when(F.col("table") == table, F.format_string(form, key)).otherwise(name)
    action = F.when(F.col("op") == "INSERT", "set").when(F.col("op") == "UPDATE", "invalidate").otherwise("evict")
    return found.withColumns({"action": action, "cache_key": name}).filter("cache_key is not null")


def counts(found: DataFrame, *by: str) -> DataFrame:
    return found.groupBy(*by, "op").agg(F.count("*").alias("n"))


def _shown(value: Column) -> Column:
    head = F.hex(F.substring(value["b"], 1, 8))
    data = F.when(F.length(value["b"]) > 8, F.concat(head, F.lit("..."))).otherwise(head)
    return F.when(value["kind"] == "NULL", "NULL").when(value["s"].isNotNull(), F.concat(F.lit('"'), value["s"], F.lit('"'))).otherwise(F.coalesce(value["i"].cast("string"), value["d"].cast("string"), data))


def format_event() -> Column:
    """A line such as ``+ db.table id=1, name="x"`` of the row as it is now."""
    values = F.transform(current(), lambda v: F.concat(v["name"], F.lit("="), _shown(v)))
    return F.concat(S.op_label(), F.lit(" "), F.concat_ws(".", "database", "table"), F.lit(" "), F.array_join(values, ", "))


def validate_server(variables: DataFrame) -> DataFrame:
    """(server, variable, wanted, found) for each rule that a server's variables (server, version, name, value) break.

    A required variable that is missing breaks its rule; an optional one doesn't.
    """
    spark = variables.sparkSession
    # Variable, the value that it must have, the one that it mustn't have, on which flavour (null: both), whether it must exist.
    rules = [
        ("log_bin", "ON", None, None, True),
        ("gtid_mode", "ON", None, "mysql", True),
        ("binlog_format", "ROW", None, None, True),
        ("binlog_row_image", "FULL", None, None, True),
        ("binlog_transaction_compression", "OFF", "ON", "mysql", False),
        ("binlog_row_value_options", "not PARTIAL_JSON", "PARTIAL_JSON", "mysql", False),
        ("log_bin_compress", "OFF", "ON", "mariadb", False),
    ]
    table = spark.createDataFrame(rules, "variable string, wanted string, barred string, only string, required boolean")
    servers = variables.groupBy("server").agg(F.max(S.flavor("version")).alias("flavor"))
    asked = servers.join(F.broadcast(table), F.col("only").isNull() | (F.col("only") == F.col("flavor")))
    got = variables.select("server", F.lower("name").alias("variable"), F.upper("value").alias("found"))
    missing = F.col("found").isNull() & F.col("required")
    bad = missing | F.when(F.col("barred").isNull(), F.col("found") != F.col("wanted")).otherwise(F.col("found") == F.col("barred"))
    return asked.join(got, ["server", "variable"], "left").filter(bad).select("server", "variable", "wanted", "found")


def upsert(spark_batch: DataFrame, state_path: str, key: list[str], order: list[str], buckets: int = 64) -> None:
    """For ``foreachBatch``: merge a batch of typed changes into the state at ``state_path``.

    The state holds the last row of each key, deleted ones too (``current_state`` leaves them out), so that an older row
    that comes late changes nothing. It is dealt into ``buckets`` by key, and a batch only rewrites the buckets it touches.
    """
    spark = spark_batch.sparkSession
    bucket = F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")
    rest = [*[c for c in spark_batch.columns if c not in key], "__bucket"]
    newest = lambda rows: rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__last")).select(*key, "__last.*")
    # the batch's own last rows, kept, so that the batch is made once, and only a row a key goes on
    new = folders.staged(newest(spark_batch.withColumn("__bucket", bucket)), "newest")
    touched = [r[0] for r in new.select("__bucket").distinct().collect()]  # at most ``buckets``
    try:
        old = spark.read.schema(new.schema).parquet(state_path).filter(F.col("__bucket").isin(touched))
    except AnalysisException as e:  # no state yet
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        old = new.limit(0)
    last = newest(old.unionByName(new))
    held = folders.new_folder(spark, "merged")
    last.write.parquet(held)
    merged = spark.read.schema(last.schema).parquet(held).repartition("__bucket")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("__bucket").parquet(state_path)


def current_state(spark: SparkSession, state_path: str) -> DataFrame:
    """The rows of the state that aren't deleted."""
    return spark.read.parquet(state_path).filter("op <> 'DELETE'").drop("__bucket")


def observed(events: DataFrame, name: str = "log") -> tuple[DataFrame, Observation | None]:
    """The same events with header, and counts of events, bytes and checksum errors that an action on them fills in.

    Of a stream the counts are each batch's, in its progress under ``name`` (``streaming.progress`` logs them), and the
    second part is none.
    """
    counts = [F.count("*").alias("events"), F.coalesce(F.sum(F.length("raw")), F.lit(0)).alias("bytes"), F.count_if(~F.col("crc_ok")).alias("crc_errors")]
    if events.isStreaming:
        return events.observe(name, *counts), None
    seen = Observation(name)
    return events.observe(seen, *counts), seen
