"""Postings, BM25, TF-IDF, vectors and rank fusion over a table of texts (id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import cosine
from ..functions.text import query_terms, stem_all, token_rows, tokens
from ..storage import Workspace

K1, B = 1.2, 0.75


def word_rows(texts: DataFrame, stemming: bool = False) -> DataFrame:
    """(id, term, tf 1) of every word; terms of letters, digits and underscores, lower case; stemming by Porter."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z0-9_]+"), F.lit(0))
    return texts.select("id", F.explode(stem_all(words) if stemming else words).alias("term")).withColumn("tf", F.lit(1).cast("bigint"))


def postings(texts: DataFrame, stemming: bool = False) -> DataFrame:
    """(id, term, tf): word_rows, a term of a text once."""
    return word_rows(texts, stemming).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def field_texts(vertices: DataFrame, fields: tuple[str, ...] = ("id", "label", "name", "file_path")) -> DataFrame:
    """One text per named vertex out of its indexed fields."""
    return vertices.where("name is not null and name <> ''").select("id", F.concat_ws(" ", *fields).alias("text"))


def bm25_search(index: DataFrame, query: str, limit: int = 20, stemming: bool = False) -> DataFrame:
    """(id, score), best first: every query term must occur as a prefix of some term; BM25 over the matching postings.

    index: postings, or word_rows for a single search. It is read once, into one written row of length and
    matches a text. An empty query finds nothing.
    """
    terms = query_terms(query)
    spark = index.sparkSession
    if stemming:
        from ..functions.text import porter_stem

        terms = [porter_stem(t) for t in terms]
    if not terms:
        return spark.createDataFrame([], "id string, score double")
    tf = [f"tf{k}" for k in range(len(terms))]
    matched = [F.sum(F.when(F.startswith("term", F.lit(t)), F.col("tf"))).alias(c) for t, c in zip(terms, tf)]
    rows = Workspace(spark, "bm25").save(index.groupBy("id").agg(F.sum("tf").alias("len"), *matched), "texts")
    found = rows.where("id is not null")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).crossJoin(F.broadcast(found.agg(*(F.count(c).alias(f"d{c}") for c in tf))))
    scored = found.dropna(subset=tf).crossJoin(F.broadcast(stats))

    def part(c: str) -> Column:
        idf = F.log(1 + (F.col("n") - F.col(f"d{c}") + 0.5) / (F.col(f"d{c}") + 0.5))
        return idf * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("len") / F.col("mean")))

    return scored.select("id", sum((part(c) for c in tf[1:]), part(tf[0])).alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(limit)


def update_postings(index: DataFrame, texts: DataFrame, removed: DataFrame | None = None, stemming: bool = False) -> DataFrame:
    """The index without the ids of texts and of removed (id), plus the postings of texts: vertices indexed again or dropped."""
    gone = texts.select("id") if removed is None else texts.select("id").unionByName(removed.select("id"))
    return index.join(gone.distinct(), "id", "left_anti").select("id", "term", "tf").unionByName(postings(texts, stemming))


def retrieve_context(vertices: DataFrame, query: str, limit: int = 10, index: DataFrame | None = None) -> DataFrame:
    """(place, id, name, label, file_path, score, line): the best vertices for a question and the numbered line that each adds to a prompt."""
    index = postings(field_texts(vertices)) if index is None else index
    hits = ranked(bm25_search(index, query, limit)).join(vertices.select("id", "name", "label", "file_path"), "id")
    line = F.concat(F.col("place"), F.lit(". **"), "name", F.lit("** ("), "label", F.lit(") in `"), F.coalesce("file_path", F.lit("")), F.lit("` [score: "), F.format_string("%.3f", "score"), F.lit("]"))
    return hits.select("place", "id", "name", "label", "file_path", "score", line.alias("line"))


class TfidfIndex:
    """A saved TF-IDF index of texts (id, text): tables weights (id, term, w, df) and norms (id, norm, 0 becomes 1).

    w = tf * ln(N / (df + 1)), tf a share of the text's tokens. Each table is
    computed once and lies in the shared folder (norms when first asked for),
    weights in order of term, so that a search reads the row groups of its terms only.
    """

    def __init__(self, texts: DataFrame):
        work = Workspace(texts.sparkSession, "tfidf")
        words = token_rows(texts)
        tf = work.save(words.groupBy("id", "term").agg(F.count(F.lit(1)).alias("c")), "counts")
        size = tf.groupBy("id").agg(F.sum("c").alias("len"))
        df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        self.n = texts.count()
        w = (F.col("c") / F.col("len") * F.log(F.lit(float(self.n)) / (F.col("df") + 1))).alias("w")
        self.weights = work.save(tf.join(size, "id").join(df, "term").select("id", "term", w, "df").sortWithinPartitions("term"), "weights")
        work.drop("counts")
        self._work, self._norms = work, None

    @property
    def norms(self) -> DataFrame:
        """(id, norm), made on first use."""
        if self._norms is None:
            length = F.sqrt(F.sum(F.col("w") * F.col("w")))
            self._norms = self._work.save(self.weights.groupBy("id").agg(length.alias("norm")).select("id", F.when(F.col("norm") == 0, 1.0).otherwise(F.col("norm")).alias("norm")), "norms")
        return self._norms

    def search(self, query: str, limit: int = 10) -> DataFrame:
        """(id, score, n_terms) by cosine; query weights use ln((N + 1) / (df + 1)); only scores over 0."""
        spark = self.weights.sparkSession
        counts = {r.term: r.c for r in spark.createDataFrame([(query,)], "text string").select(F.explode(tokens(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("c")).collect()}
        if not counts:
            return self.norms.select("id", F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n_terms")).limit(0)
        asked = spark.createDataFrame(sorted(counts.items()), "term string, c long")
        hit = self.weights.where(F.col("term").isin(*counts)).join(F.broadcast(asked), "term")
        qw = F.col("c") * F.log((F.lit(float(self.n)) + 1) / (F.col("df") + 1))
        hit = hit.select("id", "term", "w", qw.alias("qw"))
        qn = hit.groupBy("term").agg(F.max("qw").alias("qw")).agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("qn"))
        dots = hit.groupBy("id").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"), F.count(F.lit(1)).alias("n_terms"))
        score = dots.join(self.norms, "id").crossJoin(F.broadcast(qn)).select("id", F.coalesce(F.try_divide(F.col("dot"), F.col("norm") * F.col("qn")), F.lit(0.0)).alias("score"), "n_terms")
        return score.where("score > 0").orderBy(F.desc(F.round("score", 9)), "id").limit(limit)


def first_vectors(texts: DataFrame, providers: list[DataFrame], dims: int) -> DataFrame:
    """(id, vector, provider): of each text the vector of the first provider (id, vector) that has one of dims numbers, else zeros (provider -1)."""
    out = texts.select("id")
    fits = []
    for k, p in enumerate(providers):
        out = out.join(p.select("id", F.col("vector").cast("array<double>").alias(f"v{k}")), "id", "left")
        fits.append(F.when(F.size(f"v{k}") == dims, F.struct(F.col(f"v{k}").alias("vector"), F.lit(k).alias("provider"))))
    zero = F.struct(F.array_repeat(F.lit(0.0), dims).alias("vector"), F.lit(-1).alias("provider"))
    return out.select("id", F.coalesce(*fits, zero).alias("p")).select("id", "p.vector", "p.provider")


def vector_search(vectors: DataFrame, query: list[float], limit: int = 10, strict: bool = True) -> DataFrame:
    """(id, score): exact cosine with every vector (id, vector); other lengths are left out if strict."""
    q = F.array(*(F.lit(float(x)) for x in query))
    rows = vectors.where(F.size("vector") == len(query)) if strict else vectors
    return rows.select("id", cosine(F.col("vector"), q).alias("score")).orderBy(F.desc(F.round("score", 9)), "id").limit(limit)


def ranked(rows: DataFrame) -> DataFrame:
    """Adds the place from 1 of a bounded result list (id, score)."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("score", 9)), "id")))


def fuse(first: DataFrame, second: DataFrame, k: int = 60, limit: int = 20) -> DataFrame:
    """Reciprocal rank fusion of two bounded lists: sum of 1 / (k + place)."""
    a = ranked(first).select("id", (1.0 / (k + F.col("place"))).alias("a"))
    b = ranked(second).select("id", (1.0 / (k + F.col("place"))).alias("b"))
    both = a.join(b, "id", "full_outer").select("id", (F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))).alias("score"))
    return both.orderBy(F.desc(F.round("score", 9)), "id").limit(limit)


def boost_by_cohesion(hits: DataFrame, members: DataFrame, cohesion: DataFrame, factor: float = 0.15) -> DataFrame:
    """score * (1 + factor * cohesion of the hit's community)."""
    out = hits.join(members, "id", "left").join(cohesion.select("community", "cohesion"), "community", "left")
    return out.select("id", (F.col("score") * (1 + factor * F.coalesce("cohesion", F.lit(0.0)))).alias("score"))


def boost_by_context(hits: DataFrame, terms: list[str], cap: float = 0.5) -> DataFrame:
    """hits (id, score, name, file_path): +0.1 a term in the name, +0.05 in the path, at most cap, as a factor; greater is better."""
    bonus = F.lit(0.0)
    for t in terms:
        bonus = bonus + F.when(F.contains(F.lower("name"), F.lit(t)), 0.1).otherwise(0.0) + F.when(F.contains(F.lower("file_path"), F.lit(t)), 0.05).otherwise(0.0)
    return hits.withColumn("score", F.col("score") * (1 + F.least(F.lit(cap), bonus)))


def stale_embeddings(texts: DataFrame, stored: DataFrame) -> DataFrame:
    """id, text, hash of texts whose sha1 is not stored (id, hash): these must be embedded again."""
    fresh = texts.where(F.length("text") >= 3).select("id", "text", F.sha1("text").alias("hash"))
    return fresh.join(stored.select("id", "hash"), ["id", "hash"], "left_anti")


def within_budget(messages: DataFrame, budget: int, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """The newest messages of each conversation whose tokens (characters / 4, up) fit the budget together."""
    cost = F.ceil(F.length(text) / 4).cast("bigint")
    w = Window.partitionBy(conv).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return messages.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)
