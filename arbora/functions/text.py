"""Tokenizers, stemming and term functions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stop words of the term index.
STOP_WORDS = (
    "the is at which on a an and or but in with to for of from by as be this that it not are was were been has have had do does did will "
    "would could should may might can shall you he she they we i me my your his her its our their"
).split()


# Stop words of key terms, the words of a task's description.
KEY_STOP_WORDS = (
    "a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would could should may "
    "might shall can need dare it its this that these those i me my we our you your he him his she her they them their what which who whom "
    "where when how not no nor if then else so as than too very just about above after before between into through during here there all each "
    "every both few more most other some such only own same also find where looking trying want get show tell know"
).split()


#: Runs that other characters or white space separate; a lone letter is no word.
_WORD = r"[a-z0-9_-]{2,}"


def plain_tokens(text: Column) -> Column:
    """Lower-case words of a-z 0-9 _ -, two characters or more; repeats stay."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """As plain_tokens, without stop words."""
    return F.filter(plain_tokens(text), lambda w: ~w.isin(*STOP_WORDS))


def token_rows(texts: DataFrame) -> DataFrame:
    """(id, term): the tokens of texts (id, text) as rows; stop words leave as rows, in generated code rather than by a function per word."""
    return texts.select("id", F.explode(plain_tokens(F.col("text"))).alias("term")).where(~F.col("term").isin(*STOP_WORDS))


def key_terms(text: Column) -> Column:
    """Words of letters, digits and underscores, two letters or more, without stop words; repeats stay."""
    return F.filter(F.split(F.lower(text), r"[^a-z0-9_]+"), lambda w: (F.length(w) > 1) & ~w.isin(*KEY_STOP_WORDS))


def query_terms(query: str) -> list[str]:
    """A search string's terms: letters, digits and underscores only, lower case."""
    import re

    return re.findall(r"[a-z0-9_]+", query.lower())


def snippet(text: Column, term: str) -> Column:
    """Wraps every occurrence of the term in <b>."""
    import re

    return F.regexp_replace(text, f"(?i)({re.escape(term)})", "<b>$1</b>")


def string_hash(word: str) -> int:
    """The absolute value of the signed 32-bit hash h = 31 h + code unit."""
    h = 0
    for c in word.encode("utf-16-be").hex(" ", 2).split():
        h = (31 * h + int(c, 16)) & 0xFFFFFFFF
    return abs(h - (1 << 32) if h >= 1 << 31 else h)


def bag_of_words(words: Column, dims: int) -> Column:
    """Hashing vector of an array of words: each adds 1 at its string_hash modulo dims; unit length (zero stays zero).

    In Arrow batches, so that the cost is in the words, not in words times dims.
    """

    def run(batch: pd.Series) -> pd.Series:
        known: dict[str, int] = {}
        out = []
        for row in batch:
            v = np.zeros(dims)
            for w in row if row is not None else ():
                slot = known.get(w)
                if slot is None:
                    slot = known[w] = string_hash(w) % dims
                v[slot] += 1
            out.append(v / (np.sqrt(v @ v) or 1.0))
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, "array<double>")(words)


def node_text(source: Column, label: Column, name: Column) -> Column:
    """What is embedded of a vertex: the first 2,048 characters of its source, else label and name."""
    return F.when(F.length(source) > 0, F.substring(source, 1, 2048)).otherwise(F.concat(label, F.lit(": "), F.coalesce(name, F.lit(""))))


def vocabulary_vector(words: Column, vocabulary: list[str]) -> Column:
    return F.transform(F.array(*(F.lit(v) for v in vocabulary)), lambda v: F.array_contains(words, v).cast("int"))


def _measure(stem: str) -> int:
    kinds = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return sum(a + b == "vc" for a, b in zip(kinds, kinds[1:]))


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _cvc(w: str) -> bool:
    n = len(w)
    return n >= 3 and not _vowel(w, n - 1) and _vowel(w, n - 2) and not _vowel(w, n - 3) and w[-1] not in "wxy"


# Suffix tables of Porter's published algorithm, steps 2 to 4.
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble logi:log".split()
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split()
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()
_LONGEST_FIRST = [sorted((t.split(":") for t in table), key=lambda t: -len(t[0])) for table in (_STEP2, _STEP3)]
_STEP4_LONGEST_FIRST = sorted(_STEP4, key=lambda e: -len(e))


def porter_stem(w: str) -> str:
    """Porter's stemmer for one lower-case word."""
    if len(w) < 3:
        return w
    if w.endswith("sses") or w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end):
                if _has_vowel(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif _measure(w) == 1 and _cvc(w):
                        w += "e"
                break
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for table in _LONGEST_FIRST:
        for end, new in table:
            if w.endswith(end):
                if _measure(w[: -len(end)]) > 0:
                    w = w[: -len(end)] + new
                break
    for end in _STEP4_LONGEST_FIRST:
        if w.endswith(end):
            stem = w[: -len(end)]
            if _measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _cvc(w[:-1]))):
        w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=300_000)
def _known_stem(w: str | None) -> str | None:
    return w if w is None else porter_stem(w)


def _stems(words: pa.Array) -> pa.Array:
    """Each distinct word of a batch is stemmed once, and each worker remembers words over batches."""
    coded = words.dictionary_encode()
    return pa.array([_known_stem(w) for w in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)


def stem(words: Column | str) -> Column:
    """Porter stems, in Arrow batches."""

    def run(batch: pa.Array) -> pa.Array:
        return _stems(batch)

    return F.arrow_udf(run, "string")(words)


def stem_all(words: Column | str) -> Column:
    """Porter stems of arrays of words: as stem, without a row for each word on the way."""

    def run(batch: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), _stems(batch.flatten()), mask=batch.is_null())

    return F.arrow_udf(run, "array<string>")(words)
