"""Quality rules: counts per document and a hashed n-gram likelihood ratio.

Two passes over whole texts. The first counts hashed word 1- and 2-grams of all
documents (raw) and of the trusted ones (target) into BUCKETS counters, and the
1- and 2-grams of word shapes (which symbols a word bears, and whether it repeats
its neighbour) into SHAPES counters, one a shape; each batch is summed before
anything is shuffled. The second scores every document by the mean log ratio of
its word n-grams plus that of its shape n-grams, each under two multinomials, and
applies a fixed threshold. Invented words share the hashed counters with common
ones, the more the larger the table; shapes share none. The only broadcast is the
table of ratios, whose size does not depend on the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

BUCKETS = 1 << 14
#: Log ratio under which a document is dropped: between the labelled kinds of half the ids of sf0.1.
THRESHOLD = -0.3
_KIND = np.zeros(256, np.int64)
_KIND[list(b"#*$%&|<>")] = range(1, 9)
_SYMBOL = _KIND > 0
#: Shapes of a word: none, or its last byte's kind (0: no symbol) by 1, 2 or more symbols.
_WORD_SHAPES = 1 + 9 * 3
#: Counters of shapes: words, pairs, a word that repeats its neighbour.
SHAPES = _WORD_SHAPES + _WORD_SHAPES**2 + 1


def _rules(block: B.Block) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The counts per row; the hashes and shapes of all words, and the first word of each row."""
    starts, ends, first = B.word_bounds(block)
    hashes = B.word_hashes(block.data, starts, ends)
    heads = (block.data & 0xC0) != 0x80
    counts = {
        "n_words": np.diff(first),
        "word_chars": B.sums_by_row(heads & ~B.SPACE[block.data], block.offsets),
        "n_symbols": B.sums_by_row(_SYMBOL[block.data], block.offsets),
        "n_dup_lines": B.repeated_lines(block, starts),
        "n_repeat_words": B.repeated_window_words(hashes, first),
    }
    symbols = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(_SYMBOL[block.data], out=symbols[1:])
    n = np.minimum(symbols[ends] - symbols[starts], 3)
    shapes = np.where(n > 0, _KIND[block.data[ends - 1]] * 3 + n, 0)
    return counts, hashes, shapes, first


def base_failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])


def trusted_rows(c: dict[str, np.ndarray]) -> np.ndarray:
    """Documents that form the target: long enough, hardly a repeat, few symbols, words of usual length."""
    words = np.maximum(c["n_words"], 1)
    return (c["n_words"] >= 30) & (c["n_dup_lines"] == 0) & (20 * c["n_repeat_words"] <= words) & (50 * c["n_symbols"] <= words) & (c["word_chars"] <= 12 * words)


def _ngrams(hashes: np.ndarray, shapes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every word and every pair of neighbouring words of a row; the counter of its shape, from BUCKETS on."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    pairs, whole = B.windows(hashes, first, 2, seed=5)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    both = np.where(hashes[1:] == hashes[:-1], _WORD_SHAPES**2, shapes[:-1] * _WORD_SHAPES + shapes[1:])[whole]
    bucket = np.concatenate([hashes >> shift, pairs[whole] >> shift]).astype(np.int64)
    return bucket, np.concatenate([shapes, _WORD_SHAPES + both]) + BUCKETS, np.concatenate([row, row[: len(pairs)][whole]])


def ngram_counts(docs: DataFrame, text_col: str = "text", trusted_col: str | None = None) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all documents and over the trusted ones; shapes have the buckets from BUCKETS on."""
    size = BUCKETS + SHAPES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            flags = batch.column(1).to_numpy(zero_copy_only=False) if trusted_col else None
            for block in B.text_blocks(batch.column(0)):
                counts, hashes, shapes, first = _rules(block)
                good = flags[block.lo : block.hi] if trusted_col else trusted_rows(counts)
                bucket, shape, row = _ngrams(hashes, shapes, first)
                inside = good.astype(bool)[row]
                for at in (bucket, shape):
                    raw += np.bincount(at, minlength=size)
                    target += np.bincount(at[inside], minlength=size)
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])

    picked = [F.col(f"`{text_col}`").cast("string").alias("text")]
    if trusted_col:
        picked.append(F.coalesce(F.col(f"`{trusted_col}`").cast("boolean"), F.lit(False)).alias("trusted"))
    return docs.select(*picked).mapInArrow(count, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw), with add-one smoothing, of words and shapes each; at most BUCKETS + SHAPES rows arrive."""
    raw, target = np.ones(BUCKETS + SHAPES), np.ones(BUCKETS + SHAPES)
    for r in counts.toLocalIterator():
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    parts = (slice(0, BUCKETS), slice(BUCKETS, None))
    return np.concatenate([np.log(target[p] / target[p].sum()) - np.log(raw[p] / raw[p].sum()) for p in parts])


def judge_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", trusted_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept.

    Null and empty texts have no words, llr 0 and fail the base rules. Repeated
    rows and null ids are judged like any other; other columns are ignored.
    trusted_col names a boolean column that marks the target; without it the
    target is what trusted_rows() accepts. If nothing is trusted, or the table
    is empty, all ratios come from the smoothing alone.
    """
    table = log_ratios(ngram_counts(docs, text_col, trusted_col))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.text_blocks(batch.column(1)):
                counts, hashes, shapes, first = _rules(block)
                bucket, shape, row = _ngrams(hashes, shapes, first)
                n = np.bincount(row, minlength=len(block))
                llr = np.bincount(row, table[bucket] + table[shape], minlength=len(block)) / np.maximum(n, 1)
                failed = base_failed(counts)
                kept = ~failed & (np.round(llr, 9) >= threshold)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, len(block)), *(pa.array(counts[k], pa.int64()) for k in names), pa.array(failed), pa.array(llr), pa.array(kept)],
                    names=["id", *names, "base_failed", "llr", "kept"],
                )

    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    schema = f"id {kind}, " + ", ".join(f"{k} long" for k in names) + ", base_failed boolean, llr double, kept boolean"
    return source.mapInArrow(score, schema).withColumnRenamed("id", id_col)
