"""BM25 over three fields as relational tables: postings, lengths, corpus figures.

Inverse document frequencies are ln(N-df+.5)-ln(df+.5); negative ones become a quarter of the
mean over the vocabulary (taken before the change, so possibly negative). Every occurrence of a query term counts.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, functions as F

from ..config import LexicalConfig
from ..session import materialise
from .index import best, spread

EPSILON = 0.25


class Bm25Index:
    """Tables of an index, each made when first asked for: postings (field, term, pos, tf, dl), corpus (field, n, avgdl), terms
    (field, term, df, idf). Texts are cut into tokens once, for the postings; all else is counted from those."""

    def __init__(self, chunks: DataFrame, fields: dict[str, Column], keep=materialise):
        chunks = spread(chunks, "pos")
        per = chunks.select("pos", F.explode(F.array(*[F.struct(F.lit(name).alias("field"), tokens.alias("tokens")) for name, tokens in fields.items()])).alias("f"))
        self._words = per.select("f.field", "pos", F.size("f.tokens").alias("dl"), F.explode("f.tokens").alias("term"))
        self._chunks, self._fields, self._keep = chunks, list(fields), keep

    @cached_property
    def n(self) -> int:
        return self._chunks.count()

    @cached_property
    def postings(self) -> DataFrame:
        return self._keep(self._words.groupBy("field", "pos", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl")), "postings")

    @cached_property
    def corpus(self) -> DataFrame:
        return self._keep(self._lengths(self.postings.groupBy("field").agg(F.sum("tf").alias("tokens"))), "bm25-corpus")

    def _lengths(self, totals: DataFrame) -> DataFrame:
        """A row per field, also where no text has a token; none without texts."""
        every = totals.sparkSession.createDataFrame([(f, self.n) for f in self._fields if self.n], "field string, n long")
        return every.join(totals, "field", "left").withColumn("avgdl", F.coalesce("tokens", F.lit(0)) / F.col("n")).drop("tokens")

    def figures(self) -> DataFrame:
        """(field, n, avgdl, vocabulary) without postings: one count of terms."""
        seen = self._words.groupBy("field", "term").agg(F.count("*").alias("tf")).groupBy("field").agg(F.sum("tf").alias("tokens"), F.count("*").alias("vocabulary"))
        return self._lengths(seen).withColumn("vocabulary", F.coalesce("vocabulary", F.lit(0).cast("long")))

    @cached_property
    def terms(self) -> DataFrame:
        df = self.postings.groupBy("field", "term").agg(F.count("*").alias("df"))
        raw = df.join(F.broadcast(self.corpus), "field").select("field", "term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
        raw = self._keep(raw, "terms")
        mean = raw.groupBy("field").agg(F.avg("raw").alias("mean"))  # a row per field
        return raw.join(F.broadcast(mean), "field").select("field", "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def build(chunks: DataFrame, fields: dict[str, Column], keep=materialise) -> Bm25Index:
    """chunks: pos and whatever ``fields`` (name -> token array) reads. Empty texts count as documents."""
    return Bm25Index(chunks, fields, keep)


def scores(index: Bm25Index, terms: DataFrame, cfg: LexicalConfig = LexicalConfig()) -> DataFrame:
    """terms: (query_id, term), repeats count -> (query_id, pos, score), pairs with a common term only."""
    weights = {"text": cfg.text_weight, "context": cfg.context_weight, "hints": cfg.hints_weight}
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), "field"), F.lit(1.0))
    asked = terms.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = asked.join(index.terms.select("field", "term", "idf"), "term").join(F.broadcast(index.corpus), "field")
    hit = index.postings.join(asked, ["field", "term"])
    tf, norm = F.col("tf").cast("double"), 1 - cfg.b + cfg.b * F.col("dl") / F.col("avgdl")
    part = weight * F.col("qtf") * F.col("idf") * tf * (cfg.k1 + 1) / (tf + cfg.k1 * norm)
    return hit.groupBy("query_id", "pos").agg(F.sum(part).alias("score"))


def top_k(index: Bm25Index, chunks: DataFrame, terms: DataFrame, k: int, cfg: LexicalConfig = LexicalConfig(), digits: int | None = None) -> DataFrame:
    """(query_id, pos, score, rank): ties by position, and chunks without a common term count with 0. The best k scores above 0 are
    cut to k in each task and written, never all scored pairs. A query with fewer of them is scored again on its own,
    with the scores that are not above 0 and the first positions it has no score for."""

    def scored(of: DataFrame) -> DataFrame:
        got = scores(index, of, cfg)
        return got if digits is None else got.withColumn("score", F.round("score", digits))

    order = (F.desc("score"), F.col("pos"))
    top = materialise(best(scored(terms).where("score > 0"), k, ["query_id"], *order), "lexical-best")
    had = top.groupBy("query_id").agg(F.count("*").alias("good"))
    needy = materialise(terms.select("query_id").distinct().join(had, "query_id", "left").where(F.coalesce("good", F.lit(0)) < k).select("query_id"), "lexical-needy")
    if needy.isEmpty():
        return top
    rest = materialise(scored(terms.join(needy, "query_id", "left_semi")), "lexical-rest")
    upto = F.least(F.coalesce("scored", F.lit(0)) + k, F.lit(index.n)) - 1
    counted = needy.join(rest.groupBy("query_id").agg(F.count("*").alias("scored")), "query_id", "left").select("query_id", upto.cast("long").alias("upto"))
    blanks = counted.where("upto >= 0").select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), "upto")).alias("pos")).join(rest.select("query_id", "pos"), ["query_id", "pos"], "left_anti")
    filled = best(rest.unionByName(blanks.withColumn("score", F.lit(0.0))), k, ["query_id"], *order)
    return top.join(needy, "query_id", "left_anti").unionByName(filled)
