"""Benchmark decontamination: BM25 over test items, block-max WAND, overlap check.

The inverted index holds the test items; every passage of every training text
is a query. Weights are divided by an item's score for itself, so one threshold
fits all items: a passage is retrieved if it holds at least RETRIEVE of an
item's BM25 weight. Document frequencies, the mean and the greatest length come
from all items, so no score depends on how the index is cut.

Retrieval is exact. As in block-max WAND, a query's posting lists are walked by
cursors in order of their current block; the pivot is the first at which the
lists' maxima add up to the threshold, lists before it skip ahead to the pivot's
block, and the block counts only if the maxima inside it reach the threshold
too. Blocks nest (256 items, 8 items, one item): what passes at one level is
walked again at the next, with the maxima of its block, and at the last level the
sum is the score. All queries of a text block take each step together.

A retrieved pair counts if the word triples of the item's question part and of
its answer part (its last sentence) occur in the passage.

Index shards of bounded size are built in tasks and lie in the shared folder.
One group of shards of bounded size at a time is broadcast and queried by all
texts; the usual test set is one group, hence one pass.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import blocks as B
from .storage import Workspace

RETRIEVE, QUESTION, ANSWER = 0.6, 0.6, 0.6
K1, BM_B = 1.2, 0.75
#: Items in a block, from the widest level to the last one, where a block is an item.
LEVELS = (256, 8, 1)
#: Bytes of test items in one shard of the index, on average; bytes of shards that are broadcast together (one larger shard goes alone).
SHARD_BYTES, GROUP_BYTES = 4 << 20, 64 << 20
#: Bytes of text whose passages are queried together.
QUERY_BYTES = 1 << 19
#: Cursors of passages that are walked together below the widest level.
CURSORS = 1 << 18
#: Least words of a passage.
LEAST_PASSAGE = 64
OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
_SENTENCE = re.compile(r"[^.?!\n]+")


def _tokens(text: str) -> np.ndarray:
    """Hashes of a text's words: letters, digits and all non-ASCII, A-Z folded."""
    raw = np.frombuffer(text.encode(), np.uint8)
    block = B.Block(0, 1, raw, np.array([0, len(raw)], np.int64))
    starts, ends, _ = B.word_bounds(block, OUTSIDE)
    return B.word_hashes(raw, starts, ends, fold=True)


def _grams(tokens: np.ndarray, width: int = 3) -> np.ndarray:
    """Hashes of all runs of three words; of all words as one run if there are fewer."""
    if not len(tokens):
        return tokens
    width = min(width, len(tokens))
    return np.unique(B.windows(tokens, np.array([0, len(tokens)]), width, seed=40 + width)[0])


def split_item(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Question and answer tokens: the last sentence answers; a lone sentence is cut after three quarters."""
    parts = [t for t in map(_tokens, _SENTENCE.findall(text)) if len(t)]
    if len(parts) > 1:
        return np.concatenate(parts[:-1]), parts[-1]
    if not parts:
        return np.zeros(0, B.U64), np.zeros(0, B.U64)
    cut = max(1, len(parts[0]) * 3 // 4)
    return parts[0][:cut], parts[0][cut:]


class Level:
    """Posting lists by block: the block and greatest weight of each entry, by term, then block."""

    def __init__(self, term: np.ndarray, item: np.ndarray, weight: np.ndarray, width: int, n_terms: int, n_items: int):
        self.width, self.blocks = width, max(1, -(-n_items // width))
        self.key, at = np.unique(term * self.blocks + item // width, return_inverse=True)
        self.top = np.zeros(len(self.key))
        np.maximum.at(self.top, at, weight)
        self.block = self.key % self.blocks
        self.first = np.searchsorted(self.key, np.arange(n_terms + 1) * self.blocks)

    def walk(self, query: np.ndarray, term: np.ndarray, pos: np.ndarray, end: np.ndarray, top: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, block, bound) of all blocks whose maxima add up to least.

        Each cursor is an entry range [pos, end) of a term's list and the list's maximum there; cursors are ordered by query.
        """
        found = []
        live = pos < end
        query, term, pos, end, top = query[live], term[live], pos[live].copy(), end[live], top[live]
        while len(query):
            block = self.block[pos]
            order = np.argsort(query * np.int64(self.blocks) + block, kind="stable")
            query, term, pos, end, top, block = query[order], term[order], pos[order], end[order], top[order], block[order]
            first = np.flatnonzero(np.concatenate([[True], query[1:] != query[:-1]]))
            size = np.diff(np.append(first, len(query)))
            run = np.cumsum(top)
            run -= np.repeat(run[first] - top[first], size)
            under = np.add.reduceat((run < least).astype(np.int64), first)
            alive = under < size
            pivot = np.where(alive, block[np.minimum(first + under, len(query) - 1)], -1)
            goal = np.repeat(pivot, size)
            late = np.flatnonzero(block < goal)
            if len(late):
                pos[late] = np.searchsorted(self.key, term[late] * self.blocks + goal[late])
                block[late] = np.where(pos[late] < end[late], self.block[np.minimum(pos[late], len(self.block) - 1)], self.blocks)
            there = block == goal
            bound = np.add.reduceat(np.where(there, self.top[np.minimum(pos, len(self.top) - 1)], 0.0), first)
            good = alive & (bound >= least)
            found.append((query[first[good]], pivot[good], bound[good]))
            pos += there
            live = np.repeat(alive, size) & (pos < end)
            query, term, pos, end, top = query[live], term[live], pos[live], end[live], top[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(map(np.concatenate, zip(*found)))


class Statistics:
    """Of all items with words: their number, mean and greatest length, and document frequencies by sorted term."""

    def __init__(self, n: int, mean: float, longest: int, terms: np.ndarray, df: np.ndarray):
        self.n, self.mean, self.longest, self.terms, self.df = n, mean, longest, terms, df

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        tokens = [t for t in map(_tokens, texts) if len(t)]
        terms, df = np.unique(np.concatenate([np.unique(t) for t in tokens]), return_counts=True) if tokens else (np.zeros(0, B.U64), np.zeros(0, np.int64))
        return cls(len(tokens), float(np.mean([len(t) for t in tokens])) if tokens else 1.0, max(map(len, tokens), default=1), terms, df)


class Index:
    """Inverted index of some items with normalised BM25 weights and block maxima; items lie in order of length."""

    def __init__(self, ids: list, texts: list[str], known: Statistics | None = None):
        known = known or Statistics.of(texts)
        tokens = [_tokens(t) for t in texts]
        some = sorted((i for i, t in enumerate(tokens) if len(t)), key=lambda i: len(tokens[i]))
        self.ids = [ids[i] for i in some]
        tokens = [tokens[i] for i in some]
        sides = [split_item(texts[i]) for i in some]
        self.grams = [(_grams(q), _grams(a)) for q, a in sides]
        self.widths = [(max(1, min(3, len(q))), max(1, min(3, len(a)))) for q, a in sides]
        n = len(tokens)
        self.longest = known.longest
        sizes = np.array([len(t) for t in tokens], float)
        each = [np.unique(t, return_counts=True) for t in tokens]
        self.vocabulary = np.unique(np.concatenate(tokens)) if n else np.zeros(0, B.U64)
        self.term = np.concatenate([np.searchsorted(self.vocabulary, u) for u, _ in each]) if n else np.zeros(0, np.int64)
        self.item = np.repeat(np.arange(n), [len(u) for u, _ in each])
        tf = np.concatenate([c for _, c in each]).astype(float) if n else np.zeros(0)
        df = known.df[np.searchsorted(known.terms, self.vocabulary)].astype(float)
        idf = np.log1p((known.n - df + 0.5) / (df + 0.5))
        weight = idf[self.term] * tf * (K1 + 1) / (tf + (K1 * (1 - BM_B + BM_B * sizes / known.mean))[self.item])
        self.weight = weight / np.bincount(self.item, weight, minlength=n)[self.item]
        self.top = np.zeros(len(df))
        np.maximum.at(self.top, self.term, self.weight)
        self.levels = [Level(self.term, self.item, self.weight, width, len(df), n) for width in LEVELS]

    def retrieve(self, query: np.ndarray, term: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, score) of all pairs that reach least.

        query and term list every query's distinct terms, ordered by query.
        """
        least *= 1 - 1e-9
        wide = self.levels[0]
        owner, block, score = wide.walk(query, term, wide.first[term], wide.first[term + 1], self.top[term], least)
        start = np.searchsorted(query, np.arange(query[-1] + 2 if len(query) else 1))
        for up, level in zip(self.levels, self.levels[1:]):
            parts = []
            sizes = start[owner + 1] - start[owner]
            cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // CURSORS, prepend=-1))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(owner))):
                # every surviving block is a query of its own, with the cursors that have an entry in it
                n = sizes[lo:hi]
                part = np.repeat(np.arange(lo, hi), n)
                t = term[np.repeat(start[owner[lo:hi]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                b = block[part]
                at = np.minimum(np.searchsorted(up.key, t * up.blocks + b), len(up.key) - 1)
                here = up.key[at] == t * up.blocks + b
                part, t, b, at = part[here], t[here], b[here], at[here]
                share = up.width // level.width
                pos = np.searchsorted(level.key, t * level.blocks + b * share)
                end = np.searchsorted(level.key, t * level.blocks + np.minimum((b + 1) * share, level.blocks))
                parts.append(level.walk(part, t, pos, end, up.top[at], least))
            if not parts:
                return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            who, block, score = map(np.concatenate, zip(*parts))
            owner = owner[who]
        return owner, block, score

    def passages(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first and last word of windows so that every run as long as the longest item lies in one."""
        step = max(LEAST_PASSAGE // 2, self.longest)
        n = np.diff(first)
        per_row = np.maximum(1, -(-n // step) - 1) * (n > 0)
        row = np.repeat(np.arange(len(n)), per_row)
        k = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
        lo = first[:-1][row] + k * step
        return row, lo, np.minimum(lo + 2 * step, first[1:][row])

    def hits(self, block: B.Block, least: float = RETRIEVE, question: float = QUESTION, answer: float = ANSWER) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(row, item) to (score, question overlap, answer overlap) of the best passage."""
        out: dict[tuple[int, int], tuple[float, float, float]] = {}
        starts, ends, first = B.word_bounds(block, OUTSIDE)
        if not len(starts) or not self.ids:
            return out
        hashes = B.word_hashes(block.data, starts, ends, fold=True)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == hashes
        row, lo, hi = self.passages(first)
        n = hi - lo
        word = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        query = np.repeat(np.arange(len(lo)), n)
        keep = known[word]
        key = np.unique(query[keep] * len(self.vocabulary) + at[word[keep]])
        q, i, score = self.retrieve(key // len(self.vocabulary), key % len(self.vocabulary), least)
        for passage, item, s in zip(q.tolist(), i.tolist(), score.tolist()):
            text = hashes[lo[passage] : hi[passage]]
            overlaps = []
            for part, width_of in zip(self.grams[item], self.widths[item]):
                if not len(part):
                    overlaps.append(1.0)
                    continue
                own = np.unique(B.windows(text, np.array([0, len(text)]), width_of, seed=40 + width_of)[0])
                overlaps.append(float(np.isin(part, own).mean()))
            if overlaps[0] >= question and overlaps[1] >= answer:
                best = (round(s, 9), *overlaps)
                where = (int(row[passage]), item)
                out[where] = max(out.get(where, best), best)
        return out


def index_groups(items: DataFrame, work: Workspace, id_col: str = "item_id", text_col: str = "text", shard_bytes: int | None = None, group_bytes: int | None = None) -> Iterator[list[bytes]]:
    """Groups of pickled Index shards over the items with words; equal rows count once.

    Statistics of all items and the shards are tables in the shared folder; the driver
    holds one group, of at most group_bytes or one larger shard.
    """

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [_tokens(t.as_py()) for t in batch.column(1)]
            terms = pa.array([np.unique(t).view(np.int64) for t in tokens], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(t) for t in tokens], pa.int64()), terms], names=["id", "text", "n_words", "terms"])

    rows = items.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text")).distinct()
    kind = rows.schema["id"].dataType.simpleString()
    held = work.save(rows.mapInArrow(tokenize, f"id {kind}, text string, n_words long, terms array<bigint>").where("n_words > 0"), "items")
    total = held.agg(F.count(F.lit(1)).alias("n"), F.avg("n_words").alias("mean"), F.max("n_words").alias("longest"), F.sum(F.octet_length("text")).alias("size")).first()
    if not total.n:
        return
    shards = -(-total.size // (shard_bytes or SHARD_BYTES))
    held = held.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(shards)))
    df = held.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    known = held.select(F.col("shard").alias("part"), F.explode("terms").alias("term")).distinct().join(df, "term").select("part", "term", "df")

    def build(rows: pa.Table, terms: pa.Table) -> pa.Table:
        values = terms.column("term").to_numpy().view(B.U64)
        order = np.argsort(values)
        stats = Statistics(total.n, total.mean, total.longest, values[order], terms.column("df").to_numpy()[order])
        pairs = sorted(zip(rows.column("id").to_pylist(), rows.column("text").to_pylist()), key=lambda p: (p[1], str(p[0])))
        blob = pickle.dumps(Index([p[0] for p in pairs], [p[1] for p in pairs], stats), protocol=5)
        return pa.table({"shard": rows.column("shard").slice(0, 1), "size": pa.array([len(blob)], pa.int64()), "blob": pa.array([blob], pa.binary())})

    made = held.select("shard", "id", "text").groupBy("shard").cogroup(known.groupBy("part")).applyInArrow(build, "shard long, size long, blob binary")
    made = work.save(made, "shards")
    work.drop("items")
    group, size = [], 0
    for r in made.select("shard", "size").orderBy("shard").collect():
        if group and size + r.size > (group_bytes or GROUP_BYTES):
            yield [x.blob for x in made.where(F.col("shard").isin(group)).select("blob").collect()]
            group, size = [], 0
        group.append(r.shard)
        size += r.size
    yield [x.blob for x in made.where(F.col("shard").isin(group)).select("blob").collect()]


_opened: dict[str, list[Index]] = {}


def _open(name: str, blobs) -> list[Index]:
    """The group's indexes, unpickled once per worker; an earlier group makes room."""
    if name not in _opened:
        _opened.clear()
        _opened[name] = [pickle.loads(b) for b in blobs.value]
    return _opened[name]


def _passes(docs: DataFrame, items: DataFrame, work: Workspace, item_id: str, item_text: str) -> Iterator[Callable[[], list[Index]]]:
    """For each group of shards what opens it inside a task."""
    for group in index_groups(items, work, item_id, item_text):
        blobs, name = docs.sparkSession.sparkContext.broadcast(group), uuid.uuid4().hex
        yield lambda blobs=blobs, name=name: _open(name, blobs)


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", retrieve: float = RETRIEVE, question: float = QUESTION, answer: float = ANSWER) -> DataFrame:
    """One row per input row and test item it leaks: id, item_id, score, question_overlap, answer_overlap.

    Null and empty texts and items never match; repeated rows of docs repeat
    their hits, repeated rows of items count once; equal scores of passages are
    settled by the overlaps; null ids stay null; other columns are ignored, whatever
    their names; empty tables give no hits.
    """
    work = Workspace(docs.sparkSession, "leaks")
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").alias("k0"))
    kinds = source.schema["k0"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    names = ["k0", "k1", "score", "question_overlap", "answer_overlap"]
    schema = f"k0 {kinds[0]}, k1 {kinds[1]}, score double, question_overlap double, answer_overlap double"
    item_type = to_arrow_type(items.schema[item_id].dataType)

    def search(opened: Callable[[], list[Index]]) -> DataFrame:
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in B.text_blocks(batch.column(0), QUERY_BYTES):
                    hits = [(r, index.ids[i], v) for index in opened() for (r, i), v in sorted(index.hits(block, retrieve, question, answer).items())]
                    if hits:
                        rows = batch.column(1).take(pa.array([block.lo + r for r, _, _ in hits]))
                        yield pa.RecordBatch.from_arrays([rows, pa.array([i for _, i, _ in hits], item_type), *(pa.array([v[k] for _, _, v in hits]) for k in range(3))], names=names)

        return source.mapInArrow(find, schema)

    out, saved = None, 0
    for opened in _passes(docs, items, work, item_id, item_text):
        if out is not None:
            # beyond one group every group's hits are a table, so the driver holds one group at a time
            saved += 1
            out = work.save(out, f"hits-{saved}") if saved == 1 else out
            out = out.unionByName(work.save(search(opened), f"hits-{saved + 1}"))
        else:
            out = search(opened)
    work.drop_all_but(*(t for t in work.tables if t.startswith("hits-")))
    if out is None:
        out = docs.sparkSession.createDataFrame([], schema)
    return out.toDF(id_col, item_id, *names[2:])


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, all columns, without those that leak a test item; no row moves between tasks.

    Rows with null or empty text stay, repeated rows stay or go together. Beyond
    one group of index shards, what each group leaves is written and reread.
    """
    work = Workspace(docs.sparkSession, "clean")
    names = docs.columns
    at = names.index(text_col)
    out = docs.toDF(*(f"c{i}" for i in range(len(names))))
    schema = out.schema

    def sift(rows: DataFrame, opened: Callable[[], list[Index]]) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in B.text_blocks(batch.column(at), QUERY_BYTES):
                    good = np.ones(len(block), bool)
                    for index in opened():
                        good[[r for r, _ in index.hits(block)]] = False
                    yield batch.slice(block.lo, len(block)).filter(pa.array(good))

        return rows.mapInArrow(keep, schema)

    for k, opened in enumerate(_passes(docs, items, work, item_id, item_text)):
        out = sift(work.save(out, f"left-{k}") if k else out, opened)
        if k > 1:
            work.drop(f"left-{k - 1}")
    work.drop_all_but(*(t for t in work.tables if t.startswith("left-")))
    return out.toDF(*names)
