"""Secret scans: fixed patterns, and sliding-window entropy over candidate strings.

Patterns run over the UTF-8 bytes of whole texts; positions are turned into
code points only where something was found. Candidates for the entropy test are
long runs of token characters; the window's Shannon entropy is kept up to date
from incremental character counts and compared with the threshold of the run's
character class. Runs that the allow-list explains are suppressed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import text_blocks

#: In the order in which kinds with the same start are listed.
KINDS = ("assign", "access", "hex", "entropy")
_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
_ASSIGN_HINT = (b"passw", b"secret", b"token", b"api")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_RUN = re.compile(rb"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a character over a window, by class of the whole run.
THRESHOLDS = {"hex": 3.0, "base36": 3.6, "base64": 3.9, "letters": 3.7}
_CLOGC = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]
#: Letters whose case is a word's: all capitals, or words joined by capitals, up to 5 of them before the first and after the last.
_CASED = rb"(?:[A-Z]+|[A-Z]{0,5}[a-z]+(?:[A-Z][a-z]+)*[A-Z]{0,5})"
#: Runs that are long for ordinary reasons.
ALLOWED = (
    re.compile(rb"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"),  # UUID
    re.compile(rb"[0-9_+/=-]+"),  # numbers, dates, rules
    re.compile(_CASED + rb"(?:[-_/]" + _CASED + rb")*[-_/=]*[0-9]{0,4}"),  # words, slugs, paths
)


def _char_class(run: bytes) -> str | None:
    """The class whose threshold holds; None for runs with no mix of letters and digits or of cases."""
    digits = any(48 <= c < 58 for c in run)
    upper, lower = any(65 <= c < 91 for c in run), any(97 <= c < 123 for c in run)
    if not digits:
        return "letters" if upper and lower else None
    if not (upper or lower):
        return None
    if all(48 <= c < 58 or 97 <= (c | 32) < 103 for c in run):
        return "hex"
    return "base64" if upper and lower else "base36"


def entropy_spans(run: bytes, threshold: float) -> list[tuple[int, int]]:
    """Unions of all windows whose entropy reaches the threshold."""
    counts = [0] * 256
    total, spans = 0.0, []
    for i, c in enumerate(run):
        total += _CLOGC[counts[c] + 1] - _CLOGC[counts[c]]
        counts[c] += 1
        if i >= WINDOW:
            old = run[i - WINDOW]
            total += _CLOGC[counts[old] - 1] - _CLOGC[counts[old]]
            counts[old] -= 1
        if i >= WINDOW - 1 and math.log2(WINDOW) - total / WINDOW >= threshold - 1e-9:
            if spans and spans[-1][1] >= i + 1 - WINDOW:
                spans[-1][1] = i + 1
            else:
                spans.append([i + 1 - WINDOW, i + 1])
    return [tuple(s) for s in spans]


def uncovered(text: bytes, a: int, b: int, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What the sorted pattern spans leave of [a, b), except words before an assignment: the rest of its key's name."""
    out = []
    for s, k, e in base:
        if s < b and a < e:
            if a < s and not (k == 0 and ALLOWED[2].fullmatch(text, a, s)):
                out.append((a, s))
            a = max(a, e)
    return [*out, (a, b)] if a < b else out


def scan_bytes(text: bytes) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) in bytes, sorted; of an entropy span what no pattern's span covers."""
    found = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINT):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    base = sorted(found)
    for m in _RUN.finditer(text):
        run = m[0]
        if any(a.fullmatch(run) for a in ALLOWED) or (kind := _char_class(run)) is None:
            continue
        for a, b in entropy_spans(run, THRESHOLDS[kind]):
            found += [(s, 3, e) for s, e in uncovered(text, a + m.start(), b + m.start(), base)]
    return sorted(found)


def scan_text(text: bytes) -> list[tuple[int, int, int]]:
    """As scan_bytes, in code points."""
    found = scan_bytes(text)
    if not found or text.isascii():
        return found
    heads = np.zeros(len(text) + 1, np.int64)
    np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80, out=heads[1:])
    return [(int(heads[a]), k, int(heads[b])) for a, k, b in found]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and spans, an array of (kind, start, stop) by start, then kind as in KINDS.

    Positions are code points, stop exclusive. Null and empty texts have no
    spans; repeated rows and null ids stay; other columns are ignored.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                rows = [[{"kind": KINDS[k], "start": a, "stop": b} for a, k, b in scan_text(block.text(i))] for i in range(len(block))]
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(block.lo, len(block)), pa.array(rows, pa.list_(span))], names=["k0", "spans"])

    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), F.col(f"`{id_col}`").alias("k0"))
    return source.mapInArrow(scan, f"k0 {source.schema['k0'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,stop:bigint>>").toDF(id_col, "spans")


def spans_text(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact_secrets(docs: DataFrame, text_col: str = "text", length_col: str | None = None, mask: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs, every span (overlapping ones as one) replaced by the mask.

    length_col, if given, gets the new text's code points. A null text stays null.
    """
    names = docs.columns
    at, size_at = names.index(text_col), names.index(length_col) if length_col else None

    def redact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hidden = mask.encode()
        for batch in batches:
            for block in text_blocks(batch.column(at)):
                part = batch.slice(block.lo, len(block))
                was_null = part.column(at).is_null().to_pylist()
                texts = []
                for i in range(len(block)):
                    text = block.text(i)
                    out, last = [], 0
                    for a, _, b in scan_bytes(text):
                        if a >= last:
                            out += [text[last:a], hidden]
                        last = max(last, b)
                    texts.append(None if was_null[i] else b"".join([*out, text[last:]]).decode())
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                if size_at is not None:
                    columns[size_at] = pa.array([None if t is None else len(t) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    flat = docs.toDF(*(f"c{i}" for i in range(len(names))))
    schema = ", ".join(f"c{i} {'long' if i == size_at else kind}" for i, (_, kind) in enumerate(flat.dtypes))
    return flat.mapInArrow(redact, schema).toDF(*names)
