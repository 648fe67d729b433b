"""Registered queries over the test tables.

The tables hold no yearbooks, so chunks are mapped from ``documents``: a document is a page of
its source, its first 256 characters are the context, and metadata are made from
doc_id, lang and the first words (synthetic, the same in SQL). ``benchmark`` items are the questions, and
vec_id joins ``embeddings`` to doc_id and item_id. The token profile is ``unicode``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import EngineConfig
from ..functions import jsonparse as js, metadata, postprocess, text, validate, vectors
from ..operators import bm25, fusion, index, output
from ..operators.classify import classify
from ..operators.enrich import enrich, enrich_queries
from ..operators.semantic import semantic_top_k
from ..operators.spelling import corrections
from ..providers import RuleGenerator
from ..session import materialise
from ..sources import pages as page_source, store
from .build import build_chunks
from .catalog_sql import AS_CYRILLIC, LATIN
from .search import Searcher

CFG = EngineConfig(profile="unicode")
PROFILE = CFG.profile


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents")
    placed = index.with_dense_index(docs.select("source", "doc_id"), "source", "doc_id")
    first = placed.groupBy("source").agg(F.min("pos").alias("first"))
    placed = placed.join(first, "source").select("doc_id", "pos", (F.col("pos") - F.col("first") + 1).cast("int").alias("page"))
    d = F.col("doc_id")
    vec = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return (
        docs.join(placed, "doc_id")
        .join(vec, "doc_id", "left")
        .select(
            "doc_id", "pos", "source", "page", text.chunk_id(F.col("source"), F.col("page"), F.col("pos")).alias("id"), "text", F.substring("text", 1, 256).alias("context"),
            F.array("lang").alias("geo"), F.slice(text.tokens(F.substring("text", 1, 256), PROFILE), 1, 2).alias("metrics"), F.array((2000 + d % 20).cast("int"), (2000 + d % 20 + d % 3).cast("int")).alias("years"),
            F.when(d % 3 == 0, "year").when(d % 3 == 1, "quarter").otherwise("month").alias("time_granularity"), F.concat(F.lpad((d % 30).cast("string"), 2, "0"), F.when(d % 2 == 1, ".1").otherwise("")).alias("oked"), "embedding",
        )
    )


def questions(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("item_id")
    vec = _read(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("embedded_query"))
    return _read(spark, sf, "benchmark").join(vec, "item_id", "left").select(
        i.alias("query_id"), F.col("text").alias("query"), "embedded_query", F.array(F.when(i % 2 == 0, "en").otherwise("fr")).alias("geo"), F.slice(text.tokens(F.col("text"), PROFILE), 1, 2).alias("metrics"),
        F.array((2000 + i % 20).cast("int")).alias("years"), F.when(i % 3 == 0, "year").when(i % 3 == 1, "quarter").otherwise("month").alias("time_granularity"), F.lpad((i % 30).cast("string"), 2, "0").alias("oked"),
    )


def _terms(q: DataFrame) -> DataFrame:
    return q.select("query_id", F.explode(text.query_terms(F.col("query"), F.col("geo"), F.col("metrics"), PROFILE)).alias("term"))


def _index(c: DataFrame) -> bm25.Bm25Index:
    toks = lambda x: text.bag(x, PROFILE)
    return bm25.build(c, {"text": toks(F.col("text")), "context": toks(F.col("context")), "hints": toks(text.hints(F.col("metrics"), F.col("geo"), F.col("years")))})


def page_chunks(spark, sf):
    d = F.col("doc_id")
    frags = _read(spark, sf, "documents").select("source", F.when(d % 11 == 0, "iv").otherwise(d.cast("string")).alias("page_label"), F.lit("7").alias("page_number"), F.lit(None).cast("string").alias("page"), F.posexplode(F.split("text", "\n")).alias("n", "fragment"), "doc_id")
    frags = frags.withColumn("fragment_no", F.col("doc_id") * 1000000 + F.col("n"))
    return page_source.pages(frags).select("source", "page", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").alias("n_chars"))


def chunk_ids(spark, sf):
    return chunks(spark, sf).select("doc_id", "pos", "page", "id", text.stable_id(F.col("id")).alias("stable_id"))


def normalize_tokens(spark, sf):
    return _read(spark, sf, "documents").select("doc_id", text.normalise(F.col("text"), PROFILE).alias("tokens"))


def normalize_tokens_cyrillic(spark, sf):
    """The Cyrillic profile, over the texts with Latin letters replaced: letters without a counterpart fall out."""
    return _read(spark, sf, "documents").select("doc_id", text.normalise(F.translate("text", LATIN, AS_CYRILLIC), "cyrillic").alias("tokens"))


def normalize_chunk_ids(spark, sf):
    odd = F.concat(F.lit("  ID: id:  src "), F.col("source"), F.lit("  \t page "), F.col("doc_id").cast("string"), F.lit(" "))
    return _read(spark, sf, "documents").select("doc_id", text.normalise_id(odd).alias("normal"))


def chunk_classify(spark, sf):
    d = F.col("doc_id")
    head = F.when(d % 7 == 0, F.concat(F.lit("Содержание: "), "text")).when(d % 7 == 1, F.concat(F.lit("Население\nPOPULATION 2020\n"), "text")).when(d % 7 == 2, F.lit(" \n ")).when(d % 7 == 3, F.concat(F.lit("Первый список "), "text")).otherwise(F.col("text"))
    rows = _read(spark, sf, "documents").select("doc_id", (d % 40).cast("int").alias("page"), head.alias("text"))
    return classify(rows, CFG.enrich.skip_first_pages).select("doc_id", "page", "chunk_type")


def chunk_class_counts(spark, sf):
    return chunk_classify(spark, sf).groupBy("chunk_type").agg(F.count("*").alias("n"))


def context_post_process(spark, sf):
    rows = chunks(spark, sf).withColumn("context", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.substring("text", 1, 60)))
    return postprocess.post_process(rows).select("doc_id", "context", F.array_join("metrics", "|").alias("metrics"))


def _records(spark, sf):
    d = F.col("doc_id")
    years = F.when(d % 5 == 0, '"x"').when(d % 5 == 1, '"2020"').otherwise((2000 + d % 20).cast("string"))
    body = F.concat(F.lit('{"context":"'), F.repeat(F.lit("c"), (d % 300).cast("int")), F.lit('","metrics":["молоко","abc",'), F.when(d % 4 == 0, "7").otherwise('"рожь"'), F.lit('],"years":['), years, F.lit(',2021],"time_granularity":"'), F.when(d % 6 == 0, "week").otherwise("year"), F.lit('"}'))
    return _read(spark, sf, "documents").select("doc_id", F.concat(F.lit("id"), (d / 2).cast("long").cast("string")).alias("chunk_id"), d.alias("pos"), F.parse_json(body).alias("data"))


def validate_records(spark, sf):
    return validate.validate(_records(spark, sf)).select(F.col("pos").alias("doc_id"), "is_valid", F.size("errors").alias("n_errors"), F.size("warnings").alias("n_warnings"))


def validate_all(spark, sf):
    return validate.all_valid(validate.validate(_records(spark, sf)))


def normalize_fields(spark, sf):
    r = _records(spark, sf)
    return r.select("doc_id", F.concat_ws("|", js.normalise_metrics(js.strings_field(F.col("data"), "metrics"))).alias("metrics"), F.concat_ws("|", js.normalise_years(js.strings_field(F.col("data"), "years")).cast("array<string>")).alias("years"), F.length(js.normalise_context(js.string_field(F.col("data"), "context"))).alias("context_chars"))


def json_extract_props(spark, sf):
    e = _read(spark, sf, "events").select("event_id", F.concat(F.lit("```json\n"), "props", F.lit("\n```")).alias("raw"))
    return e.select("event_id", js.string_field(js.parse_answer(F.col("raw")), "k").alias("k"))


def json_balanced(spark, sf):
    e = _read(spark, sf, "events").select("event_id", F.concat(F.lit("x "), "props", F.lit(" y {\"k\":2} z")).alias("raw"))
    return e.select("event_id", js.string_field(js.parse_answer(F.col("raw")), "k").alias("k"), js.parse_query_answer(F.col("raw")).isNull().alias("query_answer_empty"))


def l2_normalize(spark, sf):
    v = vectors.l2_normalise(F.col("embedding"))
    return _read(spark, sf, "embeddings").select("vec_id", F.round(vectors.dot(v, v), 6).alias("norm2"), F.round(F.get(v, F.lit(0)), 6).alias("first"))


def semantic_topk(spark, sf):
    return semantic_top_k(chunks(spark, sf), questions(spark, sf), 20).select("query_id", "rank", "pos", F.round("score", 6).alias("score"))


def bm25_idf(spark, sf):
    return _index(chunks(spark, sf)).terms.select("field", "term", "df", F.round("idf", 6).alias("idf"))


def bm25_corpus(spark, sf):
    return _index(chunks(spark, sf)).figures().select("field", "n", F.round("avgdl", 6).alias("avgdl"), "vocabulary")


def bm25_topk(spark, sf):
    c = chunks(spark, sf)
    return bm25.top_k(_index(c), c, _terms(questions(spark, sf)), 20, digits=9).select("query_id", "rank", "pos", F.round("score", 6).alias("score"))


def metadata_scores(spark, sf):
    c, q = fusion.prepared(chunks(spark, sf), PROFILE), fusion.prepared(questions(spark, sf), PROFILE)
    p = metadata.parts()
    return fusion.scored_pairs(c, q, {n: F.round(x, 6) for n, x in p.items()} | {"total": F.round(metadata.total_score(p), 6)})


def metadata_recall(spark, sf):
    c, q = fusion.prepared(chunks(spark, sf), PROFILE), fusion.prepared(questions(spark, sf), PROFILE)
    return fusion.metadata_recall(c, q, CFG.retrieval.recall_top_k).select("query_id", "rank", "pos", F.round("metadata_score", 6).alias("metadata_score"))


def _searcher(spark, sf):
    return Searcher(materialise(chunks(spark, sf), "store"), CFG)  # a store is a table


def _search(spark, sf):
    return _searcher(spark, sf).search(questions(spark, sf))


def hybrid_candidates(spark, sf):
    return _search(spark, sf).candidates.select("query_id", "pos", "origin", *[F.round(c, 6).alias(c) for c in ("semantic_raw", "lexical_raw", "semantic_score", "lexical_score", "metadata_score", "hybrid_score")])


def hybrid_topk(spark, sf):
    return _search(spark, sf).top.select("query_id", "rank", "pos", F.round("hybrid_score", 6).alias("hybrid_score"))


def hybrid_debug_counts(spark, sf):
    return _search(spark, sf).counts


def search_summary(spark, sf):
    s = _searcher(spark, sf)
    return output.summary(s.with_chunks(s.search(questions(spark, sf)).top))


def upsert_by_source(spark, sf):
    """The store holds all documents; src1, src2 and src3 come again, longer by one, and src2 without any row."""
    old = _read(spark, sf, "documents").select("doc_id", "source", F.length("text").alias("n"))
    seen = old.where(F.col("source").isin("src1", "src2", "src3"))
    return store.upsert(old, seen.where("source <> 'src2'").withColumn("n", F.col("n") + 1), seen.select("source"))


def store_integrity(spark, sf):
    return store.integrity(chunks(spark, sf))


def spell_correct(spark, sf):
    """Each distinct word of the questions without its second letter, against the words of the documents."""
    words = _read(spark, sf, "documents").select(F.explode(text.bag(F.col("text"), PROFILE)).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))
    words = materialise(words, "dictionary")  # a dictionary is a table
    asked = _read(spark, sf, "benchmark").select(F.explode(text.bag(F.col("text"), PROFILE)).alias("w")).select(F.concat(F.substring("w", 1, 1), F.expr("substring(w, 3)")).alias("word")).distinct()
    return corrections(asked, words)


def llm_enrich(spark, sf):
    rows = chunks(spark, sf).select("id", "text", "source", "page", "doc_id")
    done, _ = enrich(rows, RuleGenerator(), CFG.enrich, PROFILE)
    return done.select("doc_id", "chunk_type", "context", F.array_join("metrics", "|").alias("metrics"), F.array_join(F.col("years").cast("array<string>"), "|").alias("years"), "time_granularity")


def llm_enrich_queries(spark, sf):
    q = _read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return enrich_queries(q, RuleGenerator(), CFG.enrich).select("query_id", F.array_join("metrics", "|").alias("metrics"), "time_granularity")


def build_knowledge_base(spark, sf):
    """Pages to store rows, end to end: ids, classes, model, parsing, post-processing, vectors."""
    p = chunks(spark, sf).select("source", "page", "text")
    rows, _ = build_chunks(p, EngineConfig(profile="unicode", dimension=64))
    return rows.select("pos", "id", "chunk_type", "context", F.round(vectors.dot(F.col("embedding"), F.col("embedding")), 3).alias("norm2"))


QUERIES = {
    f.__name__: f
    for f in (
        page_chunks, chunk_ids, normalize_tokens, normalize_tokens_cyrillic, normalize_chunk_ids, chunk_classify, chunk_class_counts, context_post_process, validate_records, validate_all, normalize_fields, json_extract_props,
        json_balanced, l2_normalize, semantic_topk, bm25_idf, bm25_corpus, bm25_topk, metadata_scores, metadata_recall, hybrid_candidates, hybrid_topk, hybrid_debug_counts, search_summary, upsert_by_source,
        store_integrity, spell_correct, llm_enrich, llm_enrich_queries, build_knowledge_base,
    )
}
