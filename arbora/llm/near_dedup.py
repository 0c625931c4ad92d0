"""MinHash near-duplicates: one-permutation hashing, banded buckets, star-shaped candidates.

A document is the set of its distinct five-word shingles. One hash per shingle
fills BINS bins with minima; an empty bin borrows from the first filled bin in a
random order of its own (optimal densification). ROWS neighbouring bins form a
band; documents that agree in a band share a bucket.

Rows with equal sets are one class from the start, named by its smallest id, so
a crowd of copies costs one candidate. Every member of a bucket is paired with
one centre only, a star instead of all pairs; the centre is the member that
meets most others over all its buckets, as the original of a group of copies
does. Pairs are confirmed on full sets.

Where a bucket's members are still in different components, a link between two
of them that both miss the centre may exist. Such buckets chain into families.
A family's full sets are compared exactly, in blocks of bounded size: all
classes outside the family's largest component against all of the family. Each
side has as many blocks as its own size asks for, so a family is copied once for
each block of those outside, not once for each block of itself. No pair becomes a
row unless it is a link, and no link is lost to the star shape.

All tables between the steps lie in the shared folder; nothing about documents
is collected or broadcast by hand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .storage import Workspace

SHINGLE, BINS, ROWS = 5, 128, 4
#: Classes and shingles on each side of a block of a family, on average.
BLOCK_CLASSES, BLOCK_SHINGLES = 768, 500_000
#: A link needs LINK[0] * |intersection| >= LINK[1] * |union|.
LINK = (100, 75)

_EDGES = np.arange(BINS, dtype=B.U64) << B.U64(64 - BINS.bit_length() + 1)
_BORROW = np.argsort(np.argsort(B.stream(BINS * BINS, 21).reshape(BINS, BINS), axis=1), axis=1)
_BAND = (B.stream(BINS, 23) | B.U64(1)).reshape(BINS // ROWS, ROWS)


def shingle_sets(block: B.Block, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Per row the sorted hashes of its distinct shingles; fewer words than width form one shingle."""
    starts, ends, first = B.word_bounds(block)
    hashes = B.word_hashes(block.data, starts, ends, fold=True)
    runs, _ = B.windows(hashes, first, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:
            yield B.windows(hashes[a:b], np.array([0, b - a]), b - a, seed=60 + b - a)[0]
        else:
            yield np.zeros(0, B.U64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """One-permutation minima of a non-empty sorted set, densified."""
    at = np.searchsorted(shingles, _EDGES)
    filled = np.append(at[1:], len(shingles)) > at
    out = shingles[np.minimum(at, len(shingles) - 1)]
    empty = np.flatnonzero(~filled)
    if len(empty):
        given = np.flatnonzero(filled)
        out[empty] = out[given[_BORROW[empty][:, given].argmin(1)]]
    return out


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, set_id (16 bytes that identify the set), bands (array of long; empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.text_blocks(batch.column(0)):
                sizes = np.zeros(len(block), np.int64)
                minima = np.zeros((len(block), BINS), B.U64)
                names = np.zeros((len(block), 2), B.U64)
                for i, s in enumerate(shingle_sets(block)):
                    sizes[i] = len(s)
                    if len(s):
                        minima[i] = signature(s)
                        names[i] = B.mix(s).sum(dtype=B.U64), B.mix(s ^ B.U64(0x5DEECE66D1234567)).sum(dtype=B.U64)
                bands = B.mix((minima.reshape(-1, BINS // ROWS, ROWS) * _BAND).sum(2, dtype=B.U64) + B.stream(BINS // ROWS, 29)).view(np.int64)
                some = bands[sizes > 0].ravel()
                offsets = np.concatenate([[0], np.cumsum((sizes > 0) * (BINS // ROWS))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(block.lo, len(block)),
                        pa.array(sizes),
                        pa.array([n.tobytes() for n in names], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(some)),
                    ],
                    names=["id", "n_shingles", "set_id", "bands"],
                )

    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").alias("id"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_shingles long, set_id binary, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """label, n and shingles (array of long) of rows (text, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.text_blocks(batch.column(0)):
                sets = list(shingle_sets(block))
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))
                sizes = pa.array([len(x) for x in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(block.lo, len(block)), sizes, lists], names=["label", "n", "shingles"])

    return docs.select("text", "label").mapInArrow(run, f"label {docs.schema['label'].dataType.simpleString()}, n long, shingles array<long>")


def components(edges: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, component): the smallest node reachable over edges (a, b), by alternating large and small stars.

    Every node of an edge occurs, but for the component's own smallest one.
    """
    now = work.save(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    mark = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
    before, turn = mark(now), 0
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        turn += 1
        now = work.save(small, f"{name}-{turn}")
        work.drop(f"{name}-{turn - 1}")
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("label").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("label").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").where(LINK[0] * F.least(F.size("sa"), F.size("sb")) >= LINK[1] * F.greatest(F.size("sa"), F.size("sb")))
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", shared.alias("i"), (F.size("sa") + F.size("sb") - shared).alias("u")).where(LINK[0] * F.col("i") >= LINK[1] * F.col("u")).select("a", "b")


def block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links of one block: rows of side 0 against rows of side 1, one for each class and component it reaches.

    Shared shingles are counted over posting lists of side 1, one class of side 0 at a time.
    """
    rows, cols = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1].reset_index(drop=True)
    found: list[tuple] = []
    if len(rows) and len(cols):
        sizes = cols["shingles"].map(len).to_numpy()
        everything = np.concatenate(cols["shingles"].to_list())
        order = np.argsort(everything, kind="stable")
        keys, owner = everything[order], np.repeat(np.arange(len(cols)), sizes)[order]
        homes, labels = cols["component"].to_numpy(), cols["label"].to_numpy()
        for label, home, s in zip(rows["label"], rows["component"], rows["shingles"]):
            lo, hi = np.searchsorted(keys, s), np.searchsorted(keys, s, "right")
            n = hi - lo
            at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            shared = np.bincount(owner[at], minlength=len(cols))
            near = np.flatnonzero((LINK[0] * shared >= LINK[1] * (len(s) + sizes - shared)) & (homes != home))
            found += [(label, labels[near[k]]) for k in np.unique(homes[near], return_index=True)[1]] if len(near) else []
    return pd.DataFrame(found, columns=["a", "b"])


def family_links(members: DataFrame, joined: DataFrame, sets: DataFrame, work: Workspace) -> DataFrame | None:
    """Links between classes that share an unsettled bucket; None if every bucket lies in one component."""
    placed = members.join(joined.withColumnRenamed("node", "label"), "label", "left").select("key", "label", F.coalesce("component", "label").alias("component"))
    unsettled = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.min("label").alias("first")).where("lo <> hi").select("key", "first")
    rest = work.save(placed.join(unsettled, "key").select("label", "component", "first").distinct(), "unsettled")
    if rest.isEmpty():
        return None
    chained = components(rest.select(F.col("label").alias("a"), F.col("first").alias("b")), work, "families").toDF("label", "family")
    classes = rest.select("label", "component").distinct().join(chained, "label", "left").select("label", "component", F.coalesce("family", "label").alias("family"))
    classes = work.save(classes, "families")
    per = classes.join(sets.select("label", "n"), "label").groupBy("family", "component").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"))
    whole = per.groupBy("family").agg(F.sum("k").alias("k"), F.sum("n").alias("n"), F.max(F.struct("k", "n", "component")).alias("main"))
    count = lambda k, n: F.greatest(F.ceil(k / BLOCK_CLASSES), F.ceil(n / BLOCK_SHINGLES), F.lit(1)).cast("int")
    n_rows, n_cols = count(F.col("k") - F.col("main.k"), F.col("n") - F.col("main.n")), count(F.col("k"), F.col("n"))
    sized = classes.join(whole.select("family", F.col("main.component").alias("main"), n_rows.alias("n_rows"), n_cols.alias("n_cols")), "family")
    own = lambda n: F.pmod(F.xxhash64("label"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = sized.join(sets.select("label", "shingles"), "label")
    row = held.where("component <> main").select("family", own("n_rows").alias("i"), every("n_cols").alias("j"), F.lit(0).alias("side"), "label", "component", "shingles")
    col = held.select("family", every("n_rows").alias("i"), own("n_cols").alias("j"), F.lit(1).alias("side"), "label", "component", "shingles")
    kind = sets.schema["label"].dataType.simpleString()
    return row.unionByName(col).groupBy("family", "i", "j").applyInPandas(block_links, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest id reachable), kept (id = component_id).

    Words are split at ASCII white space and A-Z folded. Null and empty texts
    have the empty set and are linked with nothing; so are rows without an id
    (component_id null, kept true). Rows that share an id count as one document.
    Repeated rows each get a row; other columns are ignored.
    """
    work = Workspace(docs.sparkSession, "near")
    signed = work.save(signatures(docs, id_col, text_col), "signatures")
    usable = signed.where("n_shingles > 0 and id is not null")
    classes = work.save(usable.groupBy("set_id").agg(F.min("id").alias("label")), "classes")
    heads = usable.join(classes.withColumnRenamed("label", "id"), ["set_id", "id"], "left_semi")
    entries = heads.select(F.col("id").alias("label"), F.explode("bands").alias("key"))
    crowded = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = work.save(entries.join(crowded, "key").select("key", "label", "n").distinct(), "members")
    met = members.groupBy("label").agg(F.sum("n").alias("met"))
    centres = members.join(met, "label").groupBy("key").agg(F.max_by("label", F.struct("met", "label")).alias("centre"))
    pairs = members.join(centres, "key").where("label <> centre").select(F.col("label").alias("a"), F.col("centre").alias("b")).distinct()
    pairs = work.save(pairs, "pairs")
    # by merge at every size: what is named grows with the documents, so no plan should rest on broadcasting it
    texts = docs.select(F.col(f"`{id_col}`").alias("label"), F.col(f"`{text_col}`").cast("string").alias("text"))
    named = pairs.select(F.col("a").alias("label")).union(pairs.select("b")).distinct()
    sets = work.save(full_sets(texts.join(named.hint("merge"), "label", "left_semi")), "sets")
    links = work.save(confirm(pairs, sets), "links")
    joined = components(links, work, "components")
    more = family_links(members, joined, sets, work)
    if more is not None:
        joined = components(links.unionByName(work.save(more, "more")), work, "joined")
    labels = classes.join(joined.withColumnRenamed("node", "label"), "label", "left").select("set_id", F.coalesce("component", "label").alias("component"))
    marked = signed.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set_id")).alias("set_id")).join(labels, "set_id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    out = work.save(marked.select("id", "n_shingles", component.alias("component_id")), "result")
    work.drop_all_but("result")
    return out.select(F.col("id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns: one document of each group of near-duplicates, repeated rows once.

    Of several rows of a kept id the one with the smallest text stays, then the
    smallest other columns in their order (columns that have no order don't
    count). Rows without an id all stay; null and empty texts are no duplicates.
    """
    kept = near_duplicates(docs, id_col, text_col).where(F.col("kept") & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").alias("k")).distinct()
    names = docs.columns
    flat = docs.toDF(*(f"c{i}" for i in range(len(names))))
    key, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    ordered = [text, *(c for c, kind in flat.dtypes if c not in (key, text) and "map<" not in kind and "variant" not in kind)]
    held = flat.where(F.col(key).isNotNull()).join(kept.hint("merge"), F.col(key) == F.col("k"), "left_semi").groupBy(F.col(key).alias("k"))
    if len(ordered) + 1 == len(names):
        # a row is its own order, so its text is carried once
        one = held.agg(F.min(F.struct(*ordered)).alias("r")).select(*(F.col("k").alias(c) if c == key else F.col(f"r.{c}").alias(c) for c in flat.columns))
    else:
        one = held.agg(F.min_by(F.struct(*flat.columns), F.struct(*ordered)).alias("r")).select("r.*")
    return one.unionByName(flat.where(F.col(key).isNull())).toDF(*names)
