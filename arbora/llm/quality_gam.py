"""Quality classifier: a generalised additive model with pairwise interactions.

Fifteen numbers are read off every whole text in vector passes. Cyclic boosting
fits one shallow tree per feature and round to the current residuals; the trees
of a feature add up to a lookup table over its bins. Then the pairs that explain
the residuals best get tables over coarse bins, fitted the same way. A score is
the sum of the tables' entries.

The model learns from a bounded sample of labelled rows (FIT_ROWS with the
smallest hash of their id); features and scores cover every text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .storage import Workspace

FIT_ROWS = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, PAIRS, RATE, LEAST = 48, 8, 120, 40, 6, 0.15, 8
FEATURES = (
    "log_bytes", "word_length", "long_words", "upper", "digits", "symbols", "marks", "other_punctuation", "non_ascii",
    "ending_marked", "line_words", "dup_lines", "repeated_words", "distinct_words", "distinct_pairs",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _mask(bytes(range(65, 91))), _mask(bytes(range(48, 58)))
_SYMBOLS, _MARKS = _mask(b"#*$%&|<>"), _mask(b"!?")
_PUNCT = _mask(b".,;:'\"()-")
_HIGH = np.arange(256) >= 128


def text_features(block: B.Block) -> np.ndarray:
    """(rows, len(FEATURES)); a text without words gives zeros but for its size."""
    data, offsets = block.data, block.offsets
    starts, ends, first = B.word_bounds(block)
    n_words = np.diff(first)
    words, size = np.maximum(n_words, 1).astype(float), np.diff(offsets)
    solid = B.sums_by_row(~B.SPACE[data], offsets)
    chars = np.maximum(solid, 1).astype(float)
    share = lambda table: B.sums_by_row(table[data], offsets) / chars
    hashes = B.word_hashes(data, starts, ends)
    lengths = ends - starts
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    row = np.repeat(np.arange(len(block)), n_words)
    lines = B.sums_by_row(data == 10, offsets) + 1

    def distinct(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((keys, of))
        k, r = keys[order], of[order]
        fresh = np.ones(len(k), bool)
        fresh[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
        return np.bincount(r[fresh], minlength=len(block))

    pairs, whole = B.windows(hashes, first, 2, seed=5)
    return np.column_stack([
        np.log1p(size),
        solid / words,
        np.bincount(row, lengths > 16, minlength=len(block)) / words,
        share(_UPPER),
        share(_DIGIT),
        share(_SYMBOLS),
        share(_MARKS),
        share(_PUNCT),
        share(_HIGH),
        np.bincount(row, (_SYMBOLS | _MARKS)[last], minlength=len(block)) / words,
        n_words / lines,
        B.repeated_lines(block, starts) / lines,
        B.repeated_window_words(hashes, first) / words,
        distinct(hashes, row) / words,
        distinct(pairs[whole], row[: len(pairs)][whole]) / words,
    ])


def featurize(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and features (array of double) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.text_blocks(batch.column(0)):
                x = text_features(block)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(block.lo, len(block)), lists], names=["id", "features"])

    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").alias("id"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, features array<double>")


class AdditiveModel:
    """Bin edges, one table per feature, and tables for some pairs of features."""

    def __init__(self, edges: list[np.ndarray]):
        self.edges = edges
        self.base = 0.0
        self.tables = [np.zeros(len(e) + 1) for e in edges]
        self.coarse = [e[np.unique(np.linspace(0, len(e) - 1, PAIR_BINS - 1).astype(int))] if len(e) else e for e in edges]
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def bins(self, x: np.ndarray, edges: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for table, b in zip(self.tables, self.bins(x, self.edges)):
            out += table[b]
        if self.pairs:
            coarse = self.bins(x, self.coarse)
            for (i, j), table in self.pairs.items():
                out += table[coarse[i], coarse[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _split(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, int]:
    """The best cut of a run of bins by gain; at least LEAST rows on each side."""
    gl, hl, nl = np.cumsum(g)[:-1], np.cumsum(h)[:-1], np.cumsum(n)[:-1]
    gt, ht, nt = g.sum(), h.sum(), n.sum()
    ok = (nl >= LEAST) & (nt - nl >= LEAST)
    if not ok.any():
        return 0.0, -1
    gain = np.where(ok, gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1), -1.0)
    at = int(np.argmax(gain))
    return float(gain[at]), at + 1


def _shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, leaves: int = 3) -> np.ndarray:
    """A tree over ordered bins, grown best-first; the value of each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        tried = [(*_split(g[a:b], h[a:b], n[a:b]), a, b) for a, b in parts]
        gain, cut, a, b = max(tried, key=lambda t: (t[0], -t[2]))
        if gain <= 1e-6:
            break
        parts.remove((a, b))
        parts += [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Depth two: one cut of the first axis, then one of the second on each side."""
    best = (0.0, np.zeros(g.shape))
    for cut in range(1, g.shape[0]):
        gain, out = -g.sum() ** 2 / (h.sum() + 1), np.zeros(g.shape)
        for side in (slice(0, cut), slice(cut, None)):
            leaf = _shallow_tree(g[side].sum(0), h[side].sum(0), n[side].sum(0), 2)
            out[side] = leaf
            gain += float((2 * leaf * g[side].sum(0) - leaf**2 * h[side].sum(0)).sum())
        if n[:cut].sum() >= LEAST and n[cut:].sum() >= LEAST and gain > best[0]:
            best = gain, out
    return best


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting of logistic loss; rows must be in a fixed order. Without both labels the score is constant."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = AdditiveModel(edges)
    rate = (y.sum() + 1) / (len(y) + 2)
    model.base = float(np.log(rate / (1 - rate)))
    if not 0 < y.sum() < len(y):
        return model
    bins, coarse = model.bins(x, model.edges), model.bins(x, model.coarse)
    f = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            p = 1 / (1 + np.exp(-f))
            k = len(model.tables[j])
            step = RATE * _shallow_tree(np.bincount(b, y - p, k), np.bincount(b, p * (1 - p), k), np.bincount(b, minlength=k))
            model.tables[j] += step
            f += step[b]

    def pair_sums(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        shape = len(model.coarse[i]) + 1, len(model.coarse[j]) + 1
        b = coarse[i] * shape[1] + coarse[j]
        p, k = 1 / (1 + np.exp(-f)), shape[0] * shape[1]
        return np.bincount(b, y - p, k).reshape(shape), np.bincount(b, p * (1 - p), k).reshape(shape), np.bincount(b, minlength=k).reshape(shape), b

    d = x.shape[1]
    gains = sorted(((-_pair_tree(*pair_sums(i, j)[:3])[0], i, j) for i in range(d) for j in range(i + 1, d)))
    chosen = [(i, j) for gain, i, j in gains[:PAIRS] if gain < 0]
    for i, j in chosen:
        model.pairs[i, j] = np.zeros((len(model.coarse[i]) + 1, len(model.coarse[j]) + 1))
    for _ in range(PAIR_ROUNDS):
        for i, j in chosen:
            g, h, n, b = pair_sums(i, j)
            step = RATE * _pair_tree(g, h, n)[1]
            model.pairs[i, j] += step
            f += step.ravel()[b]
    return model


def row_hash(key: Column) -> Column:
    """crc32 of the id as text; null counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def _sample(labels: DataFrame, key: Column, label_col: str, usable: Column | None, fit_rows: int) -> DataFrame:
    """(id, y) of the fit_rows labelled ids with the smallest hash; of several labels for an id the smallest."""
    rows = labels.select(key.alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id is not null and y in (0, 1)")
    if usable is not None:
        rows = rows.where(usable)
    return rows.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(fit_rows)


def train(features: DataFrame, labels: DataFrame, id_col: str, label_col: str, usable: Column | None = None, fit_rows: int = FIT_ROWS) -> AdditiveModel:
    """Fits on at most fit_rows labelled ids: those with the smallest hash.

    The sampled ids and labels are fit_rows rows at most, hence safe to broadcast.
    Of several rows of an id, the smallest features count, so at most fit_rows
    rows reach the driver and the model does not depend on how the table lies.
    """
    rows = _sample(labels, F.col(f"`{id_col}`"), label_col, usable, fit_rows)
    got = features.join(F.broadcast(rows), "id").groupBy("id").agg(F.min("y").alias("y"), F.min("features").alias("features")).toPandas().sort_values("id", kind="stable")
    x = np.array(got.features.tolist(), float).reshape(len(got), len(FEATURES))
    return fit(x, got.y.to_numpy(float))


def _scored(features: DataFrame, model: AdditiveModel) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["id", "score"])

    return features.select("id", "features").mapInArrow(run, f"id {features.schema['id'].dataType.simpleString()}, score double")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", usable: Column | None = None, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per input row: id, score (0 to 1), predicted (1 if score >= 0.5).

    Null texts count as empty; empty texts are scored by their features. Null
    ids are scored, but never learnt from. Repeated rows stay. Without labels of
    both kinds the score is the labels' smoothed share of 1. usable restricts
    the labels learnt from (a condition on the column ``id``).
    """
    work = Workspace(docs.sparkSession, "quality")
    features = work.save(featurize(docs, id_col, text_col), "features")
    model = train(features, labels.withColumnRenamed(label_id, id_col) if label_id != id_col else labels, id_col, label_col, usable, fit_rows)
    out = work.save(_scored(features, model), "scores")
    work.drop_all_but("scores")
    return out.select(F.col("id").alias(id_col), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", usable: Column | None = None, least: float = 0.5, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, all columns, whose score reaches least; no text moves between tasks.

    Null texts count as empty; repeated rows stay or go together; rows without an
    id are judged, but never learnt from; an empty table gives an empty one, and
    without labels of both kinds every score is the labels' smoothed share of 1.
    Only the sampled labelled rows' features are computed for fitting (their ids
    are at most fit_rows, hence broadcast); every row is then scored where it lies.
    """
    key = F.col(f"`{id_col}`")
    rows = _sample(labels, key, label_col, usable, fit_rows)
    some = docs.select(key.alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(rows.select("id")), "id", "left_semi")
    model = train(featurize(some, "id", "text"), labels, id_col, label_col, usable, fit_rows)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.text_blocks(batch.column(at)):
                yield batch.slice(block.lo, len(block)).filter(pa.array(model.score(text_features(block)) >= least))

    flat = docs.toDF(*(f"c{i}" for i in range(len(names))))
    return flat.mapInArrow(run, flat.schema).toDF(*names)
