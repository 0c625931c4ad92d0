"""Language ID: a bidirectional gated recurrent network over bytes.

Every byte of a text is labelled: the text is cut into windows of WIDTH bytes, a
forward and a backward GRU run over each, and a linear layer gives the languages'
probabilities at every position. A document's probabilities are the means over
its positions. Training is plain numpy backpropagation through time on windows
from a bounded sample of documents; gates and candidate are piecewise linear, so
labelling needs no transcendental function but the last softmax.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from .storage import Workspace

UNKNOWN = "und"
WIDTH, HIDDEN, STEPS, BATCH, SEED = 48, 8, 700, 192, 5
#: Documents learnt from: per language, and of all languages together (one at least of each); and windows from each.
FIT_DOCS, FIT_TOTAL, FIT_WINDOWS = 400, 20_000, 3
#: Of so many most frequent languages most rows leave before the choice; MARGIN times the documents wanted stay, and SPARE more.
THINNED, MARGIN, SPARE = 1_000, 4, 100
#: Probabilities held at once while windows are labelled.
LABEL_FLOATS = 1 << 21
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


class BiGRU:
    """Parameters: per direction a byte table (256 x 3H), a recurrent matrix (H x 3H); an output layer."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        k, h = len(languages), hidden
        self.languages, self.h = languages, h
        self.p = {
            "table": rng.normal(0, 0.4, (2, 256, 3 * h)).astype(np.float32),
            "back": (rng.normal(0, 1, (2, h, 3 * h)) / np.sqrt(h)).astype(np.float32),
            "out": (rng.normal(0, 1, (2 * h, k)) / np.sqrt(2 * h)).astype(np.float32),
            "bias": np.zeros(k, np.float32),
        }

    def states(self, codes: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States (2, T, B, H) of both directions for codes (T, B); what training needs of each step."""
        t_max, n = codes.shape
        h = self.h
        out = np.zeros((2, t_max, n, h), np.float32)
        tape = [[None] * t_max, [None] * t_max]
        for d in range(2):
            state = np.zeros((n, h), np.float32)
            table, gates, cand = self.p["table"][d], np.ascontiguousarray(self.p["back"][d][:, : 2 * h]), np.ascontiguousarray(self.p["back"][d][:, 2 * h :])
            for t in range(t_max) if d == 0 else range(t_max - 1, -1, -1):
                x = table.take(codes[t], axis=0)
                a = state @ gates
                a += x[:, : 2 * h]
                g = a * np.float32(0.25)
                g += np.float32(0.5)
                np.clip(g, 0, 1, out=g)
                z, r = g[:, :h], g[:, h:]
                rs = r * state
                c = rs @ cand
                c += x[:, 2 * h :]
                m = np.clip(c, -1, 1)
                new = m - state
                new *= z
                new += state
                if keep:
                    tape[d][t] = (state, a, z, r, rs, c, m)
                state = new
                out[d, t] = new
        return out, tape

    def position_probabilities(self, codes: np.ndarray) -> np.ndarray:
        """(T, B, K) probabilities at every position of codes (T, B)."""
        s, _ = self.states(codes)
        h = self.h
        logits = s[0] @ self.p["out"][:h] + s[1] @ self.p["out"][h:] + self.p["bias"]
        logits -= logits.max(-1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(-1, keepdims=True)
        return logits

    def gradients(self, codes: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over all positions and its gradients, by backpropagation through time."""
        h, (t_max, n) = self.h, codes.shape
        s, tape = self.states(codes, keep=True)
        logits = s[0] @ self.p["out"][:h] + s[1] @ self.p["out"][h:] + self.p["bias"]
        logits -= logits.max(-1, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(-1, keepdims=True)
        loss = -float(np.log(np.maximum(prob[:, np.arange(n), labels], 1e-9)).mean())
        d_logit = prob
        d_logit[:, np.arange(n), labels] -= 1
        d_logit /= t_max * n
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        flat = d_logit.reshape(-1, d_logit.shape[-1])
        g["out"][:h], g["out"][h:] = s[0].reshape(-1, h).T @ flat, s[1].reshape(-1, h).T @ flat
        g["bias"] = flat.sum(0)
        for d in range(2):
            back = self.p["back"][d]
            d_out = d_logit @ self.p["out"][d * h : (d + 1) * h].T
            carry = np.zeros((n, h), np.float32)
            for t in range(t_max - 1, -1, -1) if d == 0 else range(t_max):
                state, a, z, r, rs, c, m = tape[d][t]
                dn = d_out[t] + carry
                dc = dn * z * ((c > -1) & (c < 1))
                dz = dn * (m - state)
                drs = dc @ back[:, 2 * h :].T
                da = np.concatenate([dz, drs * state], axis=1) * 0.25 * ((a > -2) & (a < 2))
                carry = dn * (1 - z) + drs * r + da @ back[:, : 2 * h].T
                g["back"][d][:, : 2 * h] += state.T @ da
                g["back"][d][:, 2 * h :] += rs.T @ dc
                np.add.at(g["table"][d], codes[t], np.concatenate([da, dc], axis=1))
        return loss, g


def fit(windows: list[bytes], labels: list[str], seed: int = SEED, steps: int = STEPS) -> BiGRU:
    """Trains on windows of WIDTH bytes (cut or padded) with Adam; every language weighs the same. Order of rows must be fixed."""
    languages = sorted(set(labels))
    model = BiGRU(languages, seed=seed)
    if len(languages) < 2:
        return model
    rng = np.random.default_rng(seed + 1)
    cut = [np.array([np.frombuffer(w[:WIDTH].ljust(WIDTH), np.uint8) for w, y in zip(windows, labels) if y == lang]) for lang in languages]
    mean = {k: np.zeros_like(v) for k, v in model.p.items()}
    square = {k: np.zeros_like(v) for k, v in model.p.items()}
    for step in range(1, steps + 1):
        y = rng.integers(0, len(languages), BATCH)
        codes = np.array([cut[k][rng.integers(0, len(cut[k]))] for k in y]).T
        _, g = model.gradients(np.ascontiguousarray(codes), y)
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, v in model.p.items():
            mean[k] += 0.1 * (g[k] - mean[k])
            square[k] += 0.01 * (g[k] ** 2 - square[k])
            v -= (rate * mean[k] / (1 - 0.9**step) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def document_probabilities(model: BiGRU, block: B.Block) -> np.ndarray:
    """(rows, K): means over all positions of each row; equal shares for empty rows."""
    k, sizes = len(model.languages), np.diff(block.offsets)
    total = np.zeros((len(block), k))
    per_row = -(-sizes // WIDTH)
    row = np.repeat(np.arange(len(block)), per_row)
    inner = np.arange(len(row)) - np.repeat(np.cumsum(per_row) - per_row, per_row)
    start = block.offsets[:-1][row] + inner * WIDTH
    length = np.minimum(WIDTH, block.offsets[1:][row] - start)
    ramp = np.arange(WIDTH)
    at_once = min(8192, max(1, LABEL_FLOATS // (WIDTH * max(k, 1))))
    for lo in range(0, len(row), at_once):
        s, n = start[lo : lo + at_once], length[lo : lo + at_once]
        inside = ramp[:, None] < n
        codes = np.where(inside, block.data[np.minimum(s + ramp[:, None], len(block.data) - 1)], np.uint8(32))
        prob = model.position_probabilities(codes)
        prob *= inside[:, :, None]
        window = prob.sum(0)
        for j in range(k):
            total[:, j] += np.bincount(row[lo : lo + at_once], window[:, j], minlength=len(block))
    return np.where(sizes[:, None] > 0, total / np.maximum(sizes, 1)[:, None], 1 / max(k, 1))


def has_letter(text: bytes) -> bool:
    if _ASCII_LETTER.search(text):
        return True
    return not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace"))


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, usable: Column | None = None, fit_docs: int = FIT_DOCS, fit_total: int = FIT_TOTAL) -> BiGRU:
    """Fits on a bounded sample: of each language the documents with the smallest hash of their id.

    fit_docs of each language are taken, less where the languages would exceed
    fit_total together, but one at least. Rows without id, text, letters or
    language are not learnt from; of several rows of an id in a language the
    smallest windows count. FIT_WINDOWS windows of each document, at places that
    its id's hash picks, reach the driver.
    """
    key = F.col(f"`{id_col}`")
    rows = docs if usable is None else docs.where(usable)
    rows = rows.select(key.cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{lang_col}`").cast("string").alias("lang"))
    rows = rows.where("id is not null and lang is not null").where(F.col("text").rlike(r"\p{L}"))
    work = Workspace(docs.sparkSession, "languages")
    sizes = work.save(rows.groupBy("lang").agg(F.approx_count_distinct("id").alias("size")), "sizes")
    quota = max(1, min(fit_docs, fit_total // max(1, sizes.count())))
    # most rows of a frequent language leave by hash before their windows are cut and moved
    wanted = MARGIN * quota + SPARE
    frequent = sizes.where(F.col("size") > wanted).orderBy(F.desc("size"), "lang").limit(THINNED)
    place = F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53)
    rows = rows.withColumn("place", place).join(F.broadcast(frequent), "lang", "left").where(F.col("size").isNull() | (F.col("place") * F.col("size") < wanted))
    spot = lambda k: F.pmod(F.xxhash64(F.col("id"), k), F.greatest(F.lit(1), F.length("text") - (WIDTH - 1))) + 1
    windows = F.transform(F.sequence(F.lit(1), F.lit(FIT_WINDOWS)), lambda k: F.substring(F.col("text"), spot(k).cast("int"), F.lit(WIDTH)))
    rows = rows.select("id", "place", "lang", windows.alias("windows")).groupBy("lang", "id").agg(F.min("place").alias("place"), F.min("windows").alias("windows"))
    order = Window.partitionBy("lang").orderBy("place", "id")
    got = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= quota).select("lang", "n", "windows").collect()
    work.drop_all_but()
    got.sort(key=lambda r: (r.lang, r.n))
    return fit([w.encode() for r in got for w in r.windows], [r.lang for r in got for _ in r.windows])


def predict_language(docs: DataFrame, model: BiGRU, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (the mean probability of lang_pred).

    Null texts and texts without a letter give ``und`` with score 0, as does a
    model that has learnt no language; equal probabilities go to the language
    that sorts first. Repeated rows and null ids stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in B.text_blocks(batch.column(0)):
                known = np.array([bool(model.languages) and has_letter(block.text(i)) for i in range(len(block))])
                if known.any():
                    prob = np.round(document_probabilities(model, block), 9)
                    best = prob.argmax(1)
                    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                    score = np.where(known, np.clip(prob[np.arange(len(block)), best], 0, 1), 0.0)
                else:
                    names, score = [UNKNOWN] * len(block), np.zeros(len(block))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(block.lo, len(block)), pa.array(names, pa.string()), pa.array(score)], names=["k0", "lang_pred", "score"])

    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").alias("k0"))
    return source.mapInArrow(run, f"k0 {source.schema['k0'].dataType.simpleString()}, lang_pred string, score double").toDF(id_col, "lang_pred", "score")
