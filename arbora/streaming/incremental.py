"""Changed files, affected slices, and the change feed as Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import PropertyGraph
from ..plans.rewrites import frontier_bfs
from ..storage import Workspace


def file_changes(known: DataFrame, now: DataFrame) -> DataFrame:
    """file_path, status of two inventories (file_path, hash): added, changed, deleted, unchanged."""
    a = known.select("file_path", F.col("hash").alias("old"))
    b = now.select("file_path", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "changed").otherwise("unchanged")
    return a.join(b, "file_path", "full_outer").select("file_path", status.alias("status"))


#: The layout of the hash table; another one counts as none.
HASHES_VERSION = 1


def save_hashes(inventory: DataFrame, path: str, commit: str | None = None) -> None:
    """Writes an inventory (file_path, hash) with the version and commit that later runs compare with."""
    inventory.select("file_path", "hash", F.lit(HASHES_VERSION).alias("version"), F.lit(commit).cast("string").alias("commit")).write.mode("overwrite").parquet(path)


def load_hashes(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved inventory (file_path, hash, commit); None where it is missing, unreadable or of another version, which asks for a full run."""
    try:
        held = spark.read.parquet(path)
        if not {"file_path", "hash", "version", "commit"} <= set(held.columns) or held.where(F.col("version") != HASHES_VERSION).limit(1).count():
            return None
    except (AnalysisException, Py4JJavaError):
        return None
    return held.select("file_path", "hash", "commit")


def append_snapshot(metrics: DataFrame, path: str, at: str, **labels: str | None) -> None:
    """Adds one run's metrics (one row) to the snapshots at path, with its ISO time and labels such as branch and commit."""
    metrics.withColumns({"at": F.to_timestamp(F.lit(at)), **{k: F.lit(v).cast("string") for k, v in labels.items()}}).write.mode("append").parquet(path)


def load_snapshots(spark: SparkSession, path: str, since: str | None = None, until: str | None = None, limit: int | None = None) -> DataFrame:
    """Snapshots in [since, until], oldest first; limit keeps the newest ones."""
    s = spark.read.option("mergeSchema", True).parquet(path)
    if since is not None:
        s = s.where(F.col("at") >= F.to_timestamp(F.lit(since)))
    if until is not None:
        s = s.where(F.col("at") <= F.to_timestamp(F.lit(until)))
    return (s if limit is None else s.orderBy(F.desc("at")).limit(limit)).orderBy("at")


def refresh(g: PropertyGraph, changes: DataFrame, rebuild: Callable[[DataFrame], PropertyGraph]) -> PropertyGraph:
    """Drops what changed or deleted files gave, rebuilds from changed and added ones, and adds that."""
    gone = changes.where("status in ('changed', 'deleted')").select("file_path")
    fresh = rebuild(changes.where("status in ('changed', 'added')").select("file_path"))
    base = g.remove_files(gone)
    return PropertyGraph(base.vertices, base.edges).upsert_vertices(fresh.vertices).add_edges(fresh.edges)


def affected_descendants(extends: DataFrame, changed: DataFrame, max_depth: int = 50) -> DataFrame:
    """Classes that inherit, at any distance, from the changed ones (id), these included."""
    e = extends.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return frontier_bfs(e, changed, max_depth, Workspace(changed.sparkSession, "affected")).select("id")


def drop_derived(g: PropertyGraph, labels: tuple[str, ...] = ("Community", "Process")) -> PropertyGraph:
    return g.remove_vertices(g.vertices.where(F.col("label").isin(*labels)).select("id"))


def coalesce_events(events: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The last event of each key (by at, then tie)."""
    return events.groupBy(key).agg(F.max_by(F.struct(*(c for c in events.columns if c != key)), F.struct(at, tie)).alias("e")).select(key, "e.*")


def watch(changes: DataFrame, key: str, at: str, tie: str, apply: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "500 milliseconds", once: bool = False):
    """Starts a stream that hands each micro-batch, coalesced per key, to ``apply``; batches never overlap.

    once handles what is there and stops.
    """
    writer = changes.writeStream.foreachBatch(lambda df, n: apply(coalesce_events(df, key, at, tie), n)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def tumbling_counts(events: DataFrame, at: str, key: str, window: str = "60 seconds", limit: int = 100, late: str | None = None) -> DataFrame:
    """key, start, n, over: requests in fixed windows; works on tables and, with a watermark ``late``, on streams."""
    src = events.withWatermark(at, late) if late else events
    n = src.groupBy(F.window(at, window).alias("w"), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("key", F.col("w.start").alias("start"), "n", (F.col("n") > limit).alias("over"))


def anchored_counts(events: DataFrame, key: str, at: str, seconds: int = 60, limit: int = 100):
    """A stream of (key, at, n, allowed): windows that start at the first event of the key, state kept per key."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, n = state.get if state.exists else (None, 0)
        for part in parts:
            rows = []
            for t in sorted(part[at]):
                now = int(pd.Timestamp(t).value // 1000)
                if start is None or now - start >= seconds * 1_000_000:
                    start, n = now, 0
                n += 1
                rows.append((k[0], t, n, n <= limit))
            yield pd.DataFrame(rows, columns=["key", "at", "n", "allowed"])
        if start is not None:
            state.update((start, n))

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"key {kind}, at timestamp, n long, allowed boolean", "start long, n long", "append", GroupStateTimeout.NoTimeout)
