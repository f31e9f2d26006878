"""The change feed and the event log as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmesh.session import Scratch


def file_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A parquet folder or file as a stream, with the schema that it has now."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # as a pattern, which may name a single file; a plain path must be a folder
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def tumbling_counts(events: DataFrame, time: str, keys: list[str], window: str, watermark: str, slide: str | None = None) -> DataFrame:
    """Counts per window and keys; late rows count until the watermark has passed the window's end."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return events.withWatermark(time, watermark).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")


def session_counts(events: DataFrame, time: str, key: str, gap: str, watermark: str) -> DataFrame:
    """Sessions of a key: runs of rows with gaps below ``gap``."""
    s = events.withWatermark(time, watermark).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return s.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def deduplicated(events: DataFrame, time: str, keys: list[str], watermark: str) -> DataFrame:
    """Each key once within the watermark's time."""
    return events.withWatermark(time, watermark).dropDuplicatesWithinWatermark(keys)


def enriched(events: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Stream rows with the attributes of a static table; rows without are kept."""
    return events.join(dimension, key, "left")


class KeyedTable:
    """A table with one row per key that micro-batches are merged into.

    Rows are spread over buckets by their key; a batch rewrites the buckets that it touches and leaves the others as
    they are. Of the rows of a key the one of the latest batch holds, within a batch the last by ``order``. A batch that
    is run again after a failure is known by its number and counts once.
    """

    def __init__(self, spark: SparkSession, key: list[str], order: list[str], buckets: int = 16):
        self.spark, self.key, self.order, self.buckets = spark, key, order, buckets
        self.keep = Scratch(spark, "keyed-table")
        self.paths: dict[int, str] = {}
        self.columns: list[str] = []
        self.schema = None
        self.last = -1

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        self.columns = batch.columns
        new = batch.withColumn("__batch", F.lit(batch_id).cast("long")).withColumn("__bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))
        new = self.keep.write(new)
        self.schema = new.schema
        touched = [r[0] for r in new.select("__bucket").distinct().collect()]  # as many as there are buckets at most
        stored = [self.paths[b] for b in touched if b in self.paths]
        rows = new
        if stored:
            rows = rows.unionByName(self._read(stored))
        rest = [c for c in self.columns if c not in (*self.key, *self.order)]
        s = F.max(F.struct("__batch", *self.order, *rest)).alias("s")
        merged = rows.groupBy(*self.key, "__bucket").agg(s).select(*self.key, "__bucket", "s.*").select(new.columns)
        at = f"{self.keep.path}/generation-{batch_id:06d}"
        merged.repartition("__bucket").write.partitionBy("__bucket").parquet(at)
        self.paths |= {b: f"{at}/__bucket={b}" for b in touched}
        self.keep.drop(new)
        self.last = batch_id

    def _read(self, paths: list[str]) -> DataFrame:
        fields = [f for f in self.schema.fields if f.name != "__bucket"]
        d = self.spark.read.schema(type(self.schema)(fields)).parquet(*paths)
        return d.withColumn("__bucket", F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int"))

    def rows(self) -> DataFrame:
        """The rows as they are now; None before the first batch."""
        return self._read(sorted(self.paths.values())).select(self.columns) if self.paths else None


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Runs a stream over all that is there, then ends it; the checkpoint is in the shared scratch folder."""
    at = Scratch(stream.sparkSession, "stream-checkpoint").path
    q = stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", at).trigger(availableNow=True).start()
    q.awaitTermination()


def failure_markers(events: DataFrame, key: str, failed: str, ok: str) -> DataFrame:
    """Custom state per key: failures since the last success and when they began; emitted whenever they change.

    events: key, kind, ts. Rows of a batch are taken in order of ts. Result: key, attempts, first_seen.
    """
    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first = state.get if state.exists else (0, 0)
        before = (n, first)
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for kind, ts in zip(rows["kind"], rows["ts"]):
            if kind == ok:
                n, first = 0, 0
            elif kind == failed:
                n, first = n + 1, first or int(ts.timestamp() * 1_000_000)
        state.update((n, first))
        if (n, first) != before:
            yield pd.DataFrame({key: [k[0]], "attempts": [n], "first_seen": [pd.Timestamp(first, unit="us") if first else None]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, attempts long, first_seen timestamp", "n long, first long", "update", GroupStateTimeout.NoTimeout)
