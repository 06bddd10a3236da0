"""Sessions over streams, with the same results as over tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..config import EngineConfig
from ..operators.sessions import touch_sessions
from ..sources.tables import cut_lineage


def stream_gap_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(key, start_at, end_at, n_events) of a stream of events (key, ts); a session is given when no late event can join it.

    Spark puts events that are just the gap apart into one session, as the batch form does.
    """
    windows = events.withWatermark("ts", late).groupBy("key", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.max("ts").alias("end_at"))
    return windows.select("key", F.col("w.start").alias("start_at"), "end_at", "n_events")


MEMBERS = "session_id string, memory_id long, activation double"


def stream_touches(touches: DataFrame, state_path: str, each: Callable[[DataFrame, int], None], config: EngineConfig = EngineConfig()) -> DataStreamWriter:
    """Fold a stream of touches (session_id, touch, rank, memory_id), batch by batch; start() the writer it gives.

    ``each`` gets what operators.sessions.touch_sessions gives for the sessions of a batch, and the batch's number. The
    members of all sessions are a table below ``state_path`` per batch, made from that of the batch before, so a batch
    that is run again after a failure gives the same. Touches of a session must come in order over batches and each
    within one batch.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(MEMBERS).parquet(f"{state_path}/{number - 1}") if number else spark.createDataFrame([], MEMBERS)
        rows = batch.withColumn("session_id", F.col("session_id").cast("string"))
        mine = rows.select("session_id").distinct()
        folded = cut_lineage(touch_sessions(rows, before.join(mine, "session_id", "left_semi"), config), "folded")
        after = before.join(mine, "session_id", "left_anti").unionByName(folded.where("kind = 'member'").select("session_id", F.col("a").alias("memory_id"), F.col("value").alias("activation")))
        after.write.mode("overwrite").parquet(f"{state_path}/{number}")
        each(folded, number)

    return touches.writeStream.foreachBatch(step)
