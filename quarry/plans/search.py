"""A batch of queries against a store, as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..config import EngineConfig
from ..functions import text
from ..operators import bm25, fusion
from ..operators.semantic import semantic_top_k
from ..session import materialise


@dataclass
class SearchResult:
    candidates: DataFrame
    top: DataFrame
    counts: DataFrame


class Searcher:
    """chunks: the store's columns with pos 0..n-1. The three indexes are made once, at the first search."""

    def __init__(self, chunks: DataFrame, cfg: EngineConfig = EngineConfig(), lemmas=None):
        self.cfg, self.lemmas = cfg, lemmas
        self.chunks = chunks
        self.meta = materialise(fusion.prepared(chunks.select("pos", "geo", "metrics", "years", "time_granularity", "oked"), cfg.profile, lemmas).drop("geo", "metrics"), "chunk-metadata")
        toks = lambda c: text.bag(c, cfg.profile, lemmas)
        self.index = bm25.build(chunks, {"text": toks(F.col("text")), "context": toks(F.col("context")), "hints": toks(text.hints(F.col("metrics"), F.col("geo"), F.col("years")))})

    def search(self, queries: DataFrame) -> SearchResult:
        """queries: query_id, query, embedded_query, geo, metrics, years, time_granularity, oked."""
        r, profile = self.cfg.retrieval, self.cfg.profile
        asked = materialise(fusion.prepared(queries, profile, self.lemmas), "queries")
        terms = asked.select("query_id", F.explode(text.query_terms(F.col("query"), F.col("geo"), F.col("metrics"), profile, self.lemmas)).alias("term"))
        semantic = semantic_top_k(self.chunks, asked, r.semantic_top_k)
        lexical = bm25.top_k(self.index, self.chunks, terms, r.lexical_top_k, self.cfg.lexical, digits=9)
        recall = fusion.metadata_recall(self.meta, asked, r.recall_top_k)
        merged = fusion.with_metadata(fusion.merge(semantic, lexical, recall), self.meta, asked)
        candidates = materialise(fusion.fuse(fusion.normalise(merged), r), "candidates")
        return SearchResult(candidates, fusion.final_top_k(candidates, r.final_top_k), fusion.debug_counts(candidates, asked, r.final_top_k))

    def with_chunks(self, top: DataFrame) -> DataFrame:
        """The few chosen rows meet the wide chunk columns last."""
        return top.join(self.chunks.drop("embedding"), "pos")
