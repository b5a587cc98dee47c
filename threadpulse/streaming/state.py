"""State kept between micro-batches: each post's last snapshot, and the cohort under prediction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.selection import admit

LAST_SCHEMA = "community string, post_id long, snapshot_time timestamp, upvotes double, previous_time timestamp, previous_upvotes double, upvote_delta double, upvote_velocity double"


def with_previous(stream: DataFrame, late: str = "1 day", keep_hours: int = 72) -> DataFrame:
    """Each snapshot row (community, post_id, snapshot_time, upvotes) with the post's snapshot before it, its delta and velocity per hour.

    The state of a post is its last snapshot; it is dropped once the watermark is `keep_hours` past it. Rows that come in a later
    batch than a younger snapshot of their post have no predecessor here (null): the batch form repairs them."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["snapshot_time", "upvotes"], kind="stable").reset_index(drop=True)
        seen = [pd.Timestamp(state.get[0], unit="us"), state.get[1]] if state.exists else [pd.NaT, None]
        late_rows = rows["snapshot_time"] <= seen[0] if state.exists else pd.Series(False, index=rows.index)
        fresh = rows[~late_rows]
        before_t, before_u = fresh["snapshot_time"].shift(1), fresh["upvotes"].shift(1)
        if len(fresh):
            before_t.iloc[0], before_u.iloc[0] = seen[0], seen[1]
            last = fresh.iloc[-1]
            state.update((int(last["snapshot_time"].value // 1000), None if pd.isna(last["upvotes"]) else float(last["upvotes"])))
            due = int(last["snapshot_time"].value // 1_000_000) + keep_hours * 3_600_000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.setTimeoutTimestamp(max(int(seen[0].value // 1_000_000) + keep_hours * 3_600_000, state.getCurrentWatermarkMs() + 1))
        out = rows.assign(previous_time=before_t.reindex(rows.index), previous_upvotes=pd.to_numeric(before_u.reindex(rows.index)))
        out["upvote_delta"] = out["upvotes"] - out["previous_upvotes"]
        hours = (out["snapshot_time"] - pd.to_datetime(out["previous_time"])).dt.total_seconds() / 3600
        out["upvote_velocity"] = out["upvote_delta"].where(hours > 0) / hours.where(hours > 0)
        yield out[["community", "post_id", "snapshot_time", "upvotes", "previous_time", "previous_upvotes", "upvote_delta", "upvote_velocity"]]

    rows = stream.select("community", "post_id", "snapshot_time", F.col("upvotes").cast("double").alias("upvotes")).where("snapshot_time IS NOT NULL").withWatermark("snapshot_time", late)
    return rows.groupBy("community", "post_id").applyInPandasWithState(step, LAST_SCHEMA, "seen_us long, upvotes double", "append", GroupStateTimeout.EventTimeTimeout)


COHORT_SCHEMA = "community string, post_id long, created timestamp, admitted_at timestamp, upvotes double, v long"


def prediction_cohort(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, order: list[Column], limit: int, young_hours: float = 3.0, hold_hours: float = 24.0) -> None:
    """Keeps the cohort of posts under prediction as a table with a version for each micro-batch of (community, post_id, created, seen, upvotes).

    The reference time is the batch's greatest `seen`. Posts admitted less than `hold_hours` before it are carried over (with their new upvotes);
    others of at most `young_hours` are admitted in the given total order while their community has room. A batch that runs again after a
    failure overwrites its own version only. Batches without rows leave no version."""

    def step(batch: DataFrame, number: int) -> None:
        now = batch.agg(F.max("seen").alias("now")).first()["now"]
        if now is None:
            return
        spark = batch.sparkSession
        spark.createDataFrame([], COHORT_SCHEMA).drop("v").write.mode("overwrite").parquet(f"{path}/v=-1")
        older = spark.read.schema(COHORT_SCHEMA).option("basePath", path).parquet(path).where(F.col("v") < number)
        last = older.agg(F.max("v")).first()[0]
        ref = F.lit(now)
        age = lambda c: (F.unix_micros(ref) - F.unix_micros(c)) / 3.6e9
        held = older.where(F.col("v") == (-1 if last is None else last)).drop("v").where(age(F.col("admitted_at")) < hold_hours)
        seen = batch.groupBy("community", "post_id").agg(F.max(F.struct("seen", "created", "upvotes")).alias("x")).select("community", "post_id", "x.created", F.col("x.upvotes").cast("double").alias("upvotes"))
        carried = held.alias("h").join(seen.alias("n"), ["community", "post_id"], "left").select("community", "post_id", "h.created", "h.admitted_at", F.coalesce("n.upvotes", "h.upvotes").alias("upvotes"))
        young = seen.where(age(F.col("created")) <= young_hours)
        fresh = admit(carried, young, "community", "post_id", order, limit).select("community", "post_id", "created", ref.alias("admitted_at"), "upvotes")
        carried.unionByName(fresh).write.mode("overwrite").parquet(f"{path}/v={number}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def cohort(spark: SparkSession, path: str) -> DataFrame:
    """The cohort's latest version."""
    rows = spark.read.schema(COHORT_SCHEMA).option("basePath", path).parquet(path)
    last = rows.agg(F.max("v")).first()[0]
    return rows.where(F.col("v") == last).drop("v")
