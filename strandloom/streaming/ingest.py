"""Incremental ingest of records with Structured Streaming.

The state of a stream is one row for each key in the RocksDB state store: partitioned by the hash of the key,
kept on the executors' disks, its changes written to the checkpoint folder.  A trigger
looks up the keys of its own rows only and never reads what has been written, so it costs the same
however long the stream has run.

Statistics are observed inside the same plan, before and behind the state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from strandloom import fixed_values as fv
from strandloom.operators import dedup, validate

#: Triggers of one run whose statistics are kept; ``trigger_stats`` fails beyond instead of leaving some out.
MOST_TRIGGERS = 10_000

SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.numRecentProgressUpdates": str(MOST_TRIGGERS),
}

COUNTS = ("incoming", "valid", "invalid", "known_duplicates", "batch_duplicates", "new_rows")


@contextmanager
def _settings(spark: SparkSession) -> Iterator[None]:
    """A query takes the settings of its start; the session's own come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 100) -> DataFrame:
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def first_of_keys(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The keyed state as rows: keys, ``row`` (the first one of the key's first trigger), ``fresh``, ``n``.

    In update mode a trigger gives the keys among its rows.  ``fresh`` marks those that
    no earlier trigger had: the least and the greatest trigger time of their rows are equal.  Trigger times are in the offset
    log, so a trigger that runs again says the same.  ``n`` counts the rows of a key so far.
    """
    at = F.current_timestamp()
    rest = [c for c in stream.columns if c not in keys]
    return (
        stream.withColumn("_at", at)
        .groupBy(*keys)
        .agg(
            F.min_by(F.struct(*rest), F.struct("_at", *order)).alias("row"),
            F.min("_at").alias("_first"), F.max("_at").alias("_last"), F.count(F.lit(1)).alias("n"),
        )
        .select(*keys, "row", (F.col("_first") == F.col("_last")).alias("fresh"), "n")
    )


def append_new_keys(
    stream: DataFrame, out_path: str, checkpoint: str, keys: list[str], order: list[str],
    watch: Callable[[DataFrame], DataFrame] = lambda kept: kept,
) -> StreamingQuery:
    """Stream into a table keeping the first row, by ``order``, of every key; null keys are equal to each other.

    Each trigger goes to its own folder and overwrites it, so one that is run again leaves one
    copy.  ``watch`` may observe the keyed rows on their way.
    """
    spark = stream.sparkSession
    names = stream.columns
    kept = watch(first_of_keys(stream, keys, order))
    schema = T.StructType([*stream.schema.fields, T.StructField("batch_id", T.LongType())])
    spark.createDataFrame([], schema).write.mode("append").partitionBy("batch_id").parquet(out_path)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where("fresh").select(*[F.col(c) if c in keys else F.col("row")[c].alias(c) for c in names])
        rows.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    with _settings(spark):
        return (
            kept.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start()
        )


def _master_keys(master: DataFrame) -> DataFrame:
    s, t = dedup.record_key(
        F.col(dedup.alias_of(master, fv.SEQUENCE_ALIASES)), F.col(dedup.alias_of(master, fv.TARGET_ALIASES))
    )
    return master.select(s.alias("key_seq"), t.alias("key_target"), F.lit(True).alias("_known")).where(
        "key_seq IS NOT NULL AND key_target IS NOT NULL").distinct()


#: Lines of the statistics: the allowed source types, everything else together, and the total.
SOURCES = (*fv.VOCABULARY["source_type"], "other", "total")


def _of(source: str, column: str | Column) -> Column:
    kind = F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))
    if source == "total":
        return F.lit(True)
    return ~kind.isin(*SOURCES[:-2]) if source == "other" else kind == source


def ingest_records(
    stream: DataFrame, master: DataFrame, out_path: str, checkpoint: str, source: str = "source_type"
) -> StreamingQuery:
    """Validate records, drop what the master or an earlier row has, append the rest.

    ``trigger_stats`` gives the counts of the finished query.
    """
    s, t = dedup.record_key(F.col("aptamer_sequence"), F.col("target_name"))
    checked = validate.validate_record(stream).withColumn("key_seq", s).withColumn("key_target", t)
    marked = checked.join(_master_keys(master), ["key_seq", "key_target"], "left")
    known = F.coalesce("_known", F.lit(False))
    seen = marked.observe("read", *[
        F.count_if(_of(x, source) & test).alias(f"{x}_{name}")
        for x in SOURCES for name, test in (("incoming", F.lit(True)), ("valid", F.col("valid")), ("known", F.col("valid") & known))
    ])
    rows = seen.where(F.col("valid") & ~known).select(*stream.columns, "key_seq", "key_target")

    def watch(kept: DataFrame) -> DataFrame:
        return kept.observe("kept", *[
            F.count_if(F.col("fresh") & _of(x, F.col("row")[source])).alias(f"{x}_new") for x in SOURCES])

    return append_new_keys(rows, out_path, checkpoint, ["key_seq", "key_target"], ["row_id"], watch)


def trigger_stats(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """(batch_id, source_type, incoming, valid, invalid, known_duplicates, batch_duplicates, new_rows) of a finished
    ``ingest_records``: a few numbers for each trigger and source type.

    A known duplicate repeats the master, a batch duplicate an earlier row of the stream; source types that
    are not allowed are ``other``.  Over all triggers the counts are those of ``merge_stats``.
    """
    done = query.recentProgress
    if len(done) >= MOST_TRIGGERS:
        raise RuntimeError(f"statistics of at most {MOST_TRIGGERS - 1} triggers are kept in one run")
    out = []
    for p in done:
        seen = p.observedMetrics
        if "read" not in seen or "kept" not in seen:
            continue
        read, kept = seen["read"].asDict(), seen["kept"].asDict()
        for x in SOURCES:
            n, valid, known, new = read[f"{x}_incoming"], read[f"{x}_valid"], read[f"{x}_known"], kept[f"{x}_new"]
            out.append((p.batchId, x, n, valid, n - valid, known, valid - known - new, new))
    return spark.createDataFrame(out, "batch_id long, source_type string, " + ", ".join(f"{c} long" for c in COUNTS))
