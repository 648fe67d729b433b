"""Candidates of the three recalls, their normalised scores, fusion and the final ranking.

Origins: 0 semantic, 1 lexical only, 2 metadata only; (origin, rank there) breaks ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import RetrievalConfig
from ..functions import metadata
from .index import best, spread

MIN_RANGE = 1e-3


def prepared(df: DataFrame, profile: str, lemmas=None) -> DataFrame:
    """``df`` with geo_tokens and metric_tokens (distinct)."""
    from ..functions.text import bag

    toks = lambda c: F.array_distinct(bag(F.concat_ws(" ", c), profile, lemmas))
    return df.withColumn("geo_tokens", toks(F.col("geo"))).withColumn("metric_tokens", toks(F.col("metrics")))


META = ("geo_tokens", "metric_tokens", "years", "time_granularity", "oked")


def scored_pairs(chunks: DataFrame, queries: DataFrame, scores: dict, block: int = 4096) -> DataFrame:
    """(query_id, pos, scores) of every query and chunk. The batch of queries meets all chunks in blocks of at most
    about ``block`` queries, each broadcast; ``scores`` are named expressions over META and q_META."""
    chunk_cols = spread(chunks.select("pos", *META), "pos")
    asked = queries.select("query_id", *[F.col(c).alias(f"q_{c}") for c in META])
    blocks = max(1, -(-asked.count() // block))
    out = None
    for b in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        hits = chunk_cols.join(F.broadcast(some), F.lit(True)).select("query_id", "pos", *[x.alias(n) for n, x in scores.items()])
        out = hits if out is None else out.unionByName(hits)
    return out


def metadata_recall(chunks: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """(query_id, pos, metadata_score, rank) of the best k positive scores, for queries with metrics; every task
    keeps k of each query."""
    total = F.round(metadata.total_score(metadata.parts()), 9)
    pairs = scored_pairs(chunks, queries.where(F.size("metrics") > 0), {"metadata_score": total}, block)
    ranked = best(pairs, k, ["query_id"], F.desc("metadata_score"), F.col("pos"))
    return ranked.where("metadata_score > 0")  # after the ranking: before it, the score would be computed twice


def merge(semantic: DataFrame, lexical: DataFrame, recall: DataFrame) -> DataFrame:
    """(query_id, pos, semantic_raw, lexical_raw, in_lexical, origin, origin_rank): the union by chunk, scores that are missing 0;
    in_lexical is 1 for chunks of the lexical list."""
    def side(df: DataFrame, origin: int, sem, lex) -> DataFrame:
        return df.select("query_id", "pos", sem.alias("semantic_raw"), lex.alias("lexical_raw"), F.struct(F.lit(origin).alias("origin"), F.col("rank").cast("int").alias("origin_rank")).alias("o"))

    none = F.lit(None).cast("double")
    rows = side(semantic, 0, F.col("score"), none).unionByName(side(lexical, 1, none, F.col("score"))).unionByName(side(recall, 2, none, none))
    got = rows.groupBy("query_id", "pos").agg(F.coalesce(F.max("semantic_raw"), F.lit(0.0)).alias("semantic_raw"), F.coalesce(F.max("lexical_raw"), F.lit(0.0)).alias("lexical_raw"), F.min("o").alias("o"), F.count("lexical_raw").alias("in_lexical"))
    return got.select("query_id", "pos", "semantic_raw", "lexical_raw", "in_lexical", "o.origin", "o.origin_rank")


def with_metadata(candidates: DataFrame, chunks: DataFrame, queries: DataFrame) -> DataFrame:
    c = chunks.select("pos", *META)
    q = queries.select("query_id", *[F.col(x).alias(f"q_{x}") for x in META])
    total = F.round(metadata.total_score(metadata.parts()), 9)
    return candidates.join(c, "pos").join(q, "query_id").select(*candidates.columns, total.alias("metadata_score"))


def normalise(candidates: DataFrame) -> DataFrame:
    """semantic_score and lexical_score by query: min-max over all its candidates if they spread by more than
    0.001, else the mean (semantic) or the logarithms as they are (lexical)."""
    w = Window.partitionBy("query_id")
    lex = F.log1p(F.greatest("lexical_raw", F.lit(0.0)))

    def spread(x):
        low, high = F.min(x).over(w), F.max(x).over(w)
        return (x - low) / (high - low + F.lit(1e-9)), high - low > MIN_RANGE

    sem_scaled, sem_wide = spread(F.col("semantic_raw"))
    lex_scaled, lex_wide = spread(lex)
    return candidates.withColumn("semantic_score", F.when(sem_wide, sem_scaled).otherwise(F.avg("semantic_raw").over(w))).withColumn("lexical_score", F.when(lex_wide, lex_scaled).otherwise(lex))


def fuse(candidates: DataFrame, cfg: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    score = cfg.semantic_weight * F.col("semantic_score") + cfg.lexical_weight * F.col("lexical_score") + cfg.metadata_weight * F.col("metadata_score")
    return candidates.withColumn("hybrid_score", F.round(score, 9))


def final_top_k(candidates: DataFrame, k: int) -> DataFrame:
    return best(candidates, k, ["query_id"], F.desc("hybrid_score"), F.col("origin"), F.col("origin_rank"))


def debug_counts(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """A row per query: lengths of the semantic and the lexical list and of their union with the metadata recall, that union again
    if the query has metrics (else 0), what each later list added, and how many are returned."""
    n = lambda o: F.count_if(F.col("origin") == o)
    got = candidates.groupBy("query_id").agg(
        n(0).alias("semantic_count"), F.sum("in_lexical").alias("lexical_count"), F.count("*").alias("merged_count"), n(1).alias("lexical_added"), n(2).alias("metadata_added")
    )
    all_of = queries.select("query_id", (F.size(F.coalesce("metrics", F.array())) > 0).alias("seeds")).join(got, "query_id", "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in got.columns if c != "query_id"]
    merged = F.coalesce("merged_count", F.lit(0).cast("long"))
    return all_of.select("query_id", *counts, F.when(F.col("seeds"), merged).otherwise(0).alias("metadata_seed_count"), F.least(merged, F.lit(k)).alias("returned"))
