"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 so that an Aho-Corasick automaton over the
vocabulary finds every token at every position in one pass. A token sequence is
what the merges would give exactly if each pair of neighbours is what the merges
give for the pair's own bytes. So the encoder walks left to right with the
longest match, falls back to shorter tokens where the memoised pair check
fails, and steps back over dead positions, each of which is met once.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces up to so many bytes are remembered, in two generations of at most CACHED each per worker; likewise pairs.
CACHED_BYTES, CACHED, CACHED_PAIRS = 48, 300_000, 300_000
_CLASS = regex.compile(r"\\p\{[A-Z][a-z]?\}|\\[sS]|\\.|\[\^?|\]|[^\\\[\]]+")
_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _merge(word: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The merges carried out one by one; only for the few bytes of a token."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 62), i) for i in range(len(parts) - 1))
        if rank == 1 << 62:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


@lru_cache
def _ranges(kind: str) -> str:
    """The members of a character class below U+10000, as ranges of a bracket expression."""
    spans: list[list[int]] = []
    for c in map(ord, regex.findall(kind, "".join(map(chr, [*range(0xD800), *range(0xE000, 0x10000)])))):
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in spans)


def _spelled_out(pattern: str) -> re.Pattern | None:
    """The pattern for texts below U+10000 with its classes as bitmaps, which the standard engine tests faster; None if it has other escapes."""
    out, inside = [], False
    for part in _CLASS.findall(pattern):
        if part.startswith("\\"):
            if part == "\\S" and not inside:
                part = f"[^{_ranges(r'\s')}]"
            elif part == "\\s" or part.startswith("\\p"):
                part = _ranges(part) if inside else f"[{_ranges(part)}]"
            else:
                return None
        elif part[0] in "[]":
            inside = part[0] == "["
        out.append(part)
    return re.compile("".join(out))


class _Memo(dict):
    """Values by key, made on first use; two generations, so that frequent keys outlive a full one."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        known = self.old.get(key)
        if known is None:
            known = self.make(key)
            if len(key) > CACHED_BYTES:
                return known
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = known
        return known


class ByteBPE:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.sizes = list(map(len, self.bytes_of))
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.find = regex.compile(pattern).findall
        fast = _spelled_out(pattern)
        self.find_plain = fast.findall if fast else self.find
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.prefix = array("i", [-2]) * len(self.bytes_of)
        self.pieces = _Memo(lambda piece: tuple(self.encode_piece(piece.encode())), CACHED)
        self.pairs = _Memo(lambda pair: self.keeps_border(*pair), CACHED_PAIRS)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.borders: tuple[dict[int, list], dict[int, list]] = {}, {}

    def split(self, i: int) -> tuple[int, int]:
        """The two tokens whose merge gives this one; (i, i) for a single byte, (-1, -1) if the merges never give it."""
        known = self.halves.get(i)
        if known is None:
            token, known = self.bytes_of[i], (i, i)
            if len(token) > 1:
                # the merges of lower rank leave two parts, which this token's own merge joins
                left = _merge(token, {t: r for n in range(len(token)) for m in range(n + 1, len(token) + 1) if (t := token[n:m]) != token and (r := self.ranks.get(t)) is not None and r < i})
                known = tuple(map(self.ranks.__getitem__, left)) if len(left) == 2 else (-1, -1)
            self.halves[i] = known
        return known

    def border(self, i: int, side: int) -> list[tuple[int, int]]:
        """The tokens at this token's left (0) or right (1) edge while its merges run, each with the rank that ends it, first one first."""
        known = self.borders[side].get(i)
        if known is None:
            known, ends = [], 1 << 62
            while True:
                known.append((i, ends))
                part = self.split(i)[side]
                if part == i:
                    break
                ends, i = i, part
            known.reverse()
            self.borders[side][known[-1][0]] = known
        return known

    def keeps_border(self, a: int, b: int) -> bool:
        """Whether no merge ever joins the tokens at the border of a and b, replayed by rank.

        Of equal ranks the leftmost goes first: one inside a precedes, one inside b follows the merge across.
        """
        left, right = self.border(a, 1), self.border(b, 0)
        m = n = 0
        ranks, bytes_of, none = self.ranks, self.bytes_of, 1 << 62
        while True:
            (x, x_ends), (y, y_ends) = left[m], right[n]
            across = ranks.get(bytes_of[x] + bytes_of[y], none)
            if across < x_ends and across <= y_ends and across != none:
                return False
            if x_ends == y_ends == none:
                return True
            if x_ends <= y_ends:
                m += 1
            else:
                n += 1

    def shorter(self, i: int) -> int:
        """The longest token that is a proper prefix of this one; -1 if there is none."""
        known = self.prefix[i]
        if known == -2:
            token, known = self.bytes_of[i], -1
            for n in range(len(token) - 1, 0, -1):
                if (j := self.ranks.get(token[:n])) is not None:
                    known = j
                    break
            self.prefix[i] = known
        return known

    def longest(self, piece: bytes) -> list[int]:
        """The longest token at each position; all others there are its prefixes."""
        at = [-1] * len(piece)
        for end, (i, n) in self.automaton.iter(piece.decode("latin-1")):
            at[end + 1 - n] = i
        return at

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        at, size = self.longest(piece), len(piece)
        sizes, pairs, split = self.sizes, self.pairs, self.split
        dead = bytearray(size + 1)
        out: list[int] = []
        pos, token = 0, at[0] if size else -1
        while pos < size:
            while token >= 0:
                end = pos + sizes[token]
                if not dead[end] and split(token)[0] >= 0 and (not out or pairs[out[-1], token]):
                    break
                token = self.shorter(token)
            if token >= 0:
                out.append(token)
                pos = end
                token = at[pos] if pos < size else -1
            elif out:
                dead[pos] = 1
                token = out.pop()
                pos -= sizes[token]
                token = self.shorter(token)
            else:
                raise ValueError("the vocabulary lacks single bytes")
        return out

    def encode(self, text: str) -> list[int]:
        find = self.find_plain if text.isascii() or not _BEYOND.search(text) else self.find
        return list(chain.from_iterable(map(self.pieces.__getitem__, find(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=2)
def load(vocabulary: str = VOCABULARY) -> ByteBPE:
    """The tokenizer of a rank file: a name among the public tokenizers, or a path. One per worker."""
    import public_tokenizers

    path = vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary)
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return ByteBPE(ranks, public_tokenizers.PATTERN)


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per input row: id, the columns in carry, ids (array of int), n_tokens.

    Null texts encode like empty ones, to no ids. Texts are handled whole, one
    at a time; repeated rows stay; other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for lo, hi in _spans(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                ids = [pa.array(bpe.encode(x.as_py() or ""), pa.int32()) for x in part.column(0)]
                sizes = [len(x) for x in ids]
                offsets = [0]
                for n in sizes:
                    offsets.append(offsets[-1] + n)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(ids))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], lists, pa.array(sizes, pa.int64())], names=[*part.schema.names[1:], "ids", "n_tokens"])

    return _run(docs, encode, id_col, text_col, carry, "ids array<int>, n_tokens long")


def digest_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, carry: tuple[str, ...] = ()) -> DataFrame:
    """As encode_documents, but digests instead of ids: n_tokens, ids_sha256, decoded_sha256.

    The ids are decoded again; decoded_sha256 is the digest of the bytes they give.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            for lo, hi in _spans(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                counts, of_ids, of_bytes = [], [], []
                for x in part.column(0):
                    ids = bpe.encode(x.as_py() or "")
                    counts.append(len(ids))
                    of_ids.append(hashlib.sha256(" ".join(map(bpe.text_of.__getitem__, ids)).encode()).hexdigest())
                    of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], names=[*part.schema.names[1:], "n_tokens", "ids_sha256", "decoded_sha256"])

    return _run(docs, digest, id_col, text_col, carry, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per input row: id and text, the exact inverse of encode_documents; null ids give empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for batch in batches:
            texts = [bpe.decode(x.as_py() or ()).decode("utf-8", "replace") for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(texts, pa.string())], names=["k0", "text"])

    source = encoded.select(F.col(f"`{ids_col}`").alias("ids"), F.col(f"`{id_col}`").alias("k0"))
    return source.mapInArrow(decode, f"k0 {source.schema['k0'].dataType.simpleString()}, text string").toDF(id_col, "text")


def _spans(texts: pa.Array) -> Iterator[tuple[int, int]]:
    from .blocks import text_blocks

    for block in text_blocks(texts, 1 << 20):
        yield block.lo, block.hi


def _run(docs: DataFrame, kernel, id_col: str, text_col: str, carry: tuple[str, ...], made: str) -> DataFrame:
    keys = [id_col, *carry]
    source = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)))
    kinds = ", ".join(f"k{i} {source.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keys)))
    return source.mapInArrow(kernel, f"{kinds}, {made}").toDF(*keys, *(x.split()[0] for x in made.split(", ")))
