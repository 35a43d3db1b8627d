"""Package change events: normalising and debouncing them. Same code for batch and stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stowage.functions import paths

# How long events are collected, and the kinds that matter.
DEBOUNCE = "300 milliseconds"
KINDS = {"create": "Created", "modify": "Changed", "remove": "Deleted"}


def normalise(raw: DataFrame, content_root: str) -> DataFrame:
    """(event_id, ts, file_path, action) to change events; other actions and files drop out."""
    kind = F.lit(None).cast("string")
    for action, name in KINDS.items():
        kind = F.when(F.lower("action") == action, name).otherwise(kind)
    return (
        raw.where(paths.is_package_file(F.col("file_path")))
        .select(
            "event_id", "ts", paths.asset_path_of_file(F.col("file_path"), content_root).alias("asset_path"), kind.alias("kind")
        )
        .where(F.col("kind").isNotNull() & F.col("asset_path").isNotNull())
    )


def debounce(events: DataFrame, length: str = DEBOUNCE) -> DataFrame:
    """One row per path and time window with the last kind seen.

    Windows lie on a fixed grid. On a stream, put a watermark on `ts` first.
    """
    return (
        events.groupBy(F.window("ts", length).alias("w"), "asset_path")
        .agg(
            F.max_by("kind", F.struct("ts", "event_id")).alias("kind"),
            F.count(F.lit(1)).alias("merged"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "asset_path",
            "kind",
            "merged",
        )
    )


# ---------------------------------------------------------------- windows opened by the first event


def _micros(length: str) -> Column:
    zero = F.lit(0).cast("timestamp")
    return F.unix_micros(zero + F.expr(f"INTERVAL {length}")) - F.unix_micros(zero)


def debounce_from_first(events: DataFrame, length: str = DEBOUNCE) -> DataFrame:
    """One row per path and window with the last kind seen; a path's first event opens its window,
    the first event after a window's end opens the next. Batch form.

    Events are cut wherever a path is quiet for a whole window, since a new window starts there
    anyway; only the events of one such burst are looked at together.
    """
    ordered = Window.partitionBy("asset_path").orderBy("ts", "event_id")
    timed = events.select("asset_path", "ts", "event_id", "kind", F.unix_micros("ts").alias("us"), _micros(length).alias("span"))
    quiet = F.col("us") - F.lag("us").over(ordered) >= F.col("span")
    marked = timed.withColumn("cut", F.coalesce(quiet, F.lit(True)).cast("int"))
    bursts = marked.withColumn("burst", F.sum("cut").over(ordered)).groupBy("asset_path", "burst", "span")
    seen = bursts.agg(F.array_sort(F.collect_list(F.struct("us", "event_id", "kind"))).alias("seen"))

    def open_or_join(starts: Column, event: Column) -> Column:
        joins = event["us"] < F.element_at(starts, -1) + F.col("span")
        return F.when(joins, starts).otherwise(F.concat(starts, F.array(event["us"])))

    first = F.array(F.element_at("seen", 1)["us"])
    opened = seen.withColumn("start", F.explode(F.aggregate("seen", first, open_or_join)))
    end = F.col("start") + F.col("span")
    inside = F.filter("seen", lambda e: (e["us"] >= F.col("start")) & (e["us"] < end))
    return opened.select(
        F.timestamp_micros("start").alias("window_start"),
        F.timestamp_micros(end).alias("window_end"),
        "asset_path",
        F.element_at(inside, -1)["kind"].alias("kind"),
        F.size(inside).cast("bigint").alias("merged"),
    )


WINDOWS = "window_start timestamp, window_end timestamp, asset_path string, kind string, merged bigint"
WAITING = "us array<bigint>, ids array<bigint>, kinds array<string>, opened bigint"


def stream_debounce_from_first(events: DataFrame, lateness: str = "1 minute", length_ms: int = 300) -> DataFrame:
    """The same on a stream. A path's events wait in its state until the watermark has passed the
    end of their window, so the order of arrival within `lateness` makes no difference."""
    span = length_ms * 1000

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        us, ids, kinds, opened = state.get if state.exists else ([], [], [], None)
        waiting = list(zip(us, ids, kinds))
        for batch in batches:
            stamps = batch["ts"].astype("datetime64[us]").astype("int64")
            waiting += zip(stamps.tolist(), batch["event_id"].tolist(), batch["kind"].tolist())
        waiting.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        rows = []
        while waiting and waiting[0][0] + span <= passed:
            start = waiting[0][0]
            inside = [e for e in waiting if e[0] < start + span]
            waiting = waiting[len(inside) :]
            rows.append((start, start + span, key[0], inside[-1][2], len(inside)))
        if waiting:
            state.update(([e[0] for e in waiting], [e[1] for e in waiting], [e[2] for e in waiting], waiting[0][0]))
            state.setTimeoutTimestamp(max((waiting[0][0] + span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if rows:
            out = pd.DataFrame(rows, columns=["window_start", "window_end", "asset_path", "kind", "merged"])
            for name in ("window_start", "window_end"):
                out[name] = pd.to_datetime(out[name], unit="us")
            yield out

    return (
        events.withWatermark("ts", lateness)
        .groupBy("asset_path")
        .applyInPandasWithState(run, WINDOWS, WAITING, "append", GroupStateTimeout.EventTimeTimeout)
    )
