"""Joins that Catalyst would run as nested loops, rewritten to equi-joins with a residual."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Workspace

#: Pairs in a batch of near_vectors, and rows to a side of a tile.
PAIR_ROWS, TILE_ROWS = 8192, 1024


def interval_join(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, stop: str, bin_size: int = 64, innermost: bool = True) -> DataFrame:
    """Points joined with the intervals of the same keys that contain them.

    The axis is cut into bins; an interval is listed under each bin it touches,
    so the join is an equi-join on (keys, bin) and a hot key spreads over bins.
    innermost keeps the interval with the greatest start (then smallest stop).
    Points without an interval are dropped.
    """
    left = points.withColumn("_pid", F.monotonically_increasing_id()) if innermost else points
    left = left.withColumn("_bin", F.floor(F.col(at) / bin_size))
    right = intervals.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor(F.col(stop) / bin_size))))
    both = left.join(right, [*keys, "_bin"]).where(F.col(at).between(F.col(start), F.col(stop))).drop("_bin")
    if not innermost:
        return both
    w = Window.partitionBy("_pid").orderBy(F.desc(start), F.asc(stop))
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_pid")


def nearest_join(points: DataFrame, marks: DataFrame, keys: list[str], at: str, mark_at: str, mark_id: str) -> DataFrame:
    """points with mark_id of the mark of the same keys whose mark_at is nearest to at, then of the smallest id.

    marks have distinct (keys, mark_at). Where no two places can be compared for nulls the smallest id of the keys
    counts; points without a mark are dropped. Points and marks are sorted together in ranges, which are written
    once; what lies before and after a range comes from one row for each of its keys, so a hot key is no task of its own.
    """
    work = Workspace(points.sparkSession, "nearest")
    rest = [c for c in points.columns if c not in (*keys, at)]
    p = points.select(*keys, F.col(at).alias("_at"), F.struct(F.lit(True).alias("_is"), *rest).alias("_point"), F.lit(None).cast(marks.schema[mark_id].dataType).alias("_id"))
    m = marks.select(*keys, F.col(mark_at).alias("_at"), F.lit(None).cast(p.schema["_point"].dataType).alias("_point"), F.col(mark_id).alias("_id"))
    rows = p.unionByName(m).repartitionByRange(*keys, "_at").withColumn("_p", F.spark_partition_id())
    rows = work.save(rows.withColumn("_mark", F.when(F.col("_point").isNull() & F.col("_at").isNotNull(), F.struct("_at", "_id"))), "ranges")
    own, whole = Window.partitionBy("_p", *keys), Window.partitionBy(*keys)
    marked = F.col("_point").isNull().cast("int")
    seen = rows.withColumn("_before", F.last("_mark", True).over(own.orderBy("_at", F.desc(marked)))).withColumn("_after", F.last("_mark", True).over(own.orderBy(F.desc("_at"), F.desc(marked))))
    ranges = rows.groupBy("_p", *keys).agg(F.min("_mark").alias("_first"), F.max("_mark").alias("_last"), F.min("_id").alias("_least"))
    past = lambda c, *order: F.last(c, True).over(whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    ranges = ranges.select("_p", *keys, past("_last", "_p").alias("_left"), past("_first", F.desc("_p")).alias("_right"), F.min("_least").over(whole).alias("_any")).where("_any is not null")
    found = seen.where("_point is not null").join(ranges, ["_p", *keys]).withColumns({"_before": F.coalesce("_before", "_left"), "_after": F.coalesce("_after", "_right")})
    far = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col("_at") - F.col(f"{c}._at")).alias("d"), F.col(f"{c}._id").alias("id")))
    nearest = F.when(F.col("_at").isNotNull(), F.least(far("_before"), far("_after"))["id"])
    return found.select(*keys, F.col("_at").alias(at), *(F.col("_point")[c].alias(c) for c in rest), F.coalesce(nearest, F.col("_any")).alias(mark_id))


def set_similarity_join(sets: DataFrame, key: str, item: str, least: float, strict: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of keys whose item sets have Jaccard at least ``least``, with it.

    Prefix filter: items are ordered by rarity; two sets this similar share one of
    their rarest size - ceil(least * size) + 1 items. So only prefixes are joined;
    frequent items, which make crowded groups, hardly ever occur in them.
    """
    pairs = sets.select(F.col(key).alias("k"), F.col(item).alias("i")).distinct()
    often = pairs.groupBy("i").agg(F.count(F.lit(1)).alias("f"))
    ranked = pairs.join(often, "i").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("f", "i"))).alias("s"))
    ranked = ranked.select("k", F.transform("s", lambda x: x["i"]).alias("s"), F.size("s").alias("n"))
    reach = F.col("n") - F.ceil(F.col("n") * least).cast("int") + 1
    prefix = ranked.select("k", "n", F.explode(F.slice("s", F.lit(1), F.least(F.col("n"), reach))).alias("i"))
    a, b = prefix.alias("a"), prefix.alias("b")
    near = a.join(b, F.expr("a.i = b.i and a.k < b.k")).where(F.expr(f"least(a.n, b.n) >= {least} * greatest(a.n, b.n)"))
    near = near.select(F.col("a.k").alias("a"), F.col("b.k").alias("b")).distinct()
    full = near.join(ranked.select(F.col("k").alias("a"), F.col("s").alias("sa")), "a").join(ranked.select(F.col("k").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    full = full.select("a", "b", (shared / (F.size("sa") + F.size("sb") - shared)).alias("jaccard"))
    return full.where(F.col("jaccard") > least if strict else F.col("jaccard") >= least)


def frontier_bfs(edges: DataFrame, seeds: DataFrame, max_depth: int, work: Workspace, group: str | None = None) -> DataFrame:
    """(group,) id, depth: the first depth at which each vertex is reached over edges (src, dst).

    seeds has id (and group); a group is a search of its own. Each level is one
    join of the frontier with the edges and one anti-join with what was seen;
    the edges are made once, levels are written to the shared folder, so neither
    is planned again and no lineage grows.
    """
    keys = [group] if group else []
    pairs = work.save(edges.select("src", "dst").where("src is not null and dst is not null").distinct(), "pairs")
    level = work.save(seeds.select(*keys, "id").distinct().withColumn("depth", F.lit(0)), "level-0")
    seen = level
    for depth in range(1, max_depth + 1):
        step = level.join(pairs, level["id"] == pairs["src"]).select(*keys, F.col("dst").alias("id")).distinct()
        level = work.save(step.join(seen.select(*keys, "id"), [*keys, "id"], "left_anti").withColumn("depth", F.lit(depth)), f"level-{depth}")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    work.drop("pairs")
    return seen


def number_rows(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with a column of places from 0 in the given order (which must be total, or equal rows share their places at random).

    Numbered within ranges, then shifted. The numbered ranges are written once and
    read by both steps, so that no second sampling moves their borders.
    """
    work = Workspace(rows.sparkSession, "numbered")
    parts = rows.repartitionByRange(*order).withColumn("_p", F.spark_partition_id())
    local = work.save(parts.withColumn("_k", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1), "ranges")
    sizes = local.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return local.join(F.broadcast(before), "_p").select(*rows.columns, (F.col("_before") + F.col("_k")).alias(name))


def near_vectors(a: DataFrame, b: DataFrame | None, least: float, strict: bool = False, block_rows: int = 4096) -> DataFrame:
    """Pairs of rows of a and b (of unordered rows of a, if b is None) whose ``vector`` columns may have cosine >= least.

    Columns a_* and b_*. Rows are dealt by the hash of ``id`` to blocks of about
    block_rows; every block meets every other in one group of a shuffle, where
    one side is held and the other streamed against it. No pair is left out at
    any size; a few under ``least`` by rounding stay, so the caller computes the
    cosine of the pairs. strict: vectors of unequal lengths have cosine 0,
    otherwise the longer one is cut.
    """
    alone = b is None

    def blocks(df: DataFrame) -> int:
        n = df.count()
        return max(-(-n // block_rows), min(8, -(-n // 256)), 1)

    block = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    ka = blocks(a)
    others = F.sequence(F.lit(0), F.lit(ka - 1))
    names = a.columns
    if alone:
        x = a.withColumn("_m", block(ka)).withColumn("_x", F.explode(others))
        rows = x.select(F.least("_m", "_x").alias("_i"), F.greatest("_m", "_x").alias("_j"), (F.col("_m") > F.col("_x")).cast("int").alias("_s"), *names)
    else:
        kb = blocks(b)
        left = a.withColumn("_i", block(ka)).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(kb - 1)))).withColumn("_s", F.lit(0))
        right = b.withColumn("_j", block(kb)).withColumn("_i", F.explode(others)).withColumn("_s", F.lit(1))
        rows = left.select("_i", "_j", "_s", *names).unionByName(right.select("_i", "_j", "_s", *names))
    rows = rows.repartition("_i", "_j").sortWithinPartitions("_i", "_j", "_s")
    at = 3 + names.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [f"{side}_{c}" for side in "ab" for c in names]

        def pairs(one: pa.RecordBatch, two: pa.RecordBatch, ones: list, twos: list, half: bool) -> Iterator[pa.RecordBatch]:
            for i, j in _near_rows(ones, twos, least, strict, half):
                for lo in range(0, len(i), PAIR_ROWS):
                    p, q = pa.array(i[lo : lo + PAIR_ROWS]), pa.array(j[lo : lo + PAIR_ROWS])
                    yield pa.RecordBatch.from_arrays([c.take(p) for c in one.columns[3:]] + [c.take(q) for c in two.columns[3:]], names=out)

        key, held, whole, units = None, [], None, None
        for batch in batches:
            code = [batch.column(k).to_numpy() for k in range(3)]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in code], axis=0)) + 1 if len(batch) else []
            for lo, hi in zip([0, *cuts], [*cuts, len(batch)]):
                if lo == hi:
                    continue
                part, (i, j, s) = batch.slice(lo, hi - lo), (int(c[lo]) for c in code)
                if key != (i, j):
                    if alone and key and key[0] == key[1] and held:
                        whole = pa.concat_batches(held)
                        units = _units(whole.column(at))
                        yield from pairs(whole, whole, units, units, True)
                    key, held, whole, units = (i, j), [], None, None
                if s == 0:
                    held.append(part)
                elif held:
                    if whole is None:
                        whole = pa.concat_batches(held)
                        units = _units(whole.column(at))
                    yield from pairs(whole, part, units, _units(part.column(at)), False)
        if alone and key and key[0] == key[1] and held:
            whole = pa.concat_batches(held)
            units = _units(whole.column(at))
            yield from pairs(whole, whole, units, units, True)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join(f"`{side}_{c}` {kinds[c]}" for side in "ab" for c in names))


def _units(column: pa.Array) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, their vectors) for each length; a null vector has length 0, a null element is NaN."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    starts = np.cumsum(sizes) - sizes
    values = column.flatten().to_numpy(zero_copy_only=False)
    return [(int(n), r := np.flatnonzero(sizes == n), values[starts[r][:, None] + np.arange(n)]) for n in np.unique(sizes)]


def _unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows of length one; 0 stays, and what double precision doesn't scale is NaN."""
    with np.errstate(all="ignore"):
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        scale = np.where(norm == 0, 1, np.where((norm > 1e-150) & (norm < 1e150), norm, np.nan))
        return (x / scale[:, None]).astype(np.float32)


def _near_rows(ones: list, twos: list, least: float, strict: bool, half: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs that are not surely under least; half: of pairs i < j only. Tiles of TILE_ROWS squared."""
    for n, i, x in ones:
        for m, j, y in twos:
            w = 0 if strict and n != m else min(n, m)
            u, v = _unit_rows(x[:, :w]), _unit_rows(y[:, :w])
            floor = np.float32(least - (w + 8) * 2.0**-22)
            for lo in range(0, len(i), TILE_ROWS):
                for at in range(0, len(j), TILE_ROWS):
                    p, q = i[lo : lo + TILE_ROWS], j[at : at + TILE_ROWS]
                    near = ~(u[lo : lo + TILE_ROWS] @ v[at : at + TILE_ROWS].T < floor)
                    if half:
                        near &= p[:, None] < q
                    r, c = np.nonzero(near)
                    if len(r):
                        yield p[r], q[c]
