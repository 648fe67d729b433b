"""The whole way of a question: spelling, its structure, its vector, search. One object over a store."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import EngineConfig
from ..functions import text
from ..functions.vectors import Embed, embed_column, hashing_embedder
from ..operators.enrich import enrich_queries
from ..operators.index import with_dense_index
from ..operators.spelling import correct_queries
from ..providers import Generator, RuleGenerator
from ..session import materialise
from ..sources.pages import Extract, pdf_pages
from ..sources.store import Store
from .build import build_store
from .search import Searcher, SearchResult


class Engine:
    """Build into, and search in, the store at ``path``. Opening checks that the store adds up (ValueError if not).

    dictionary: (word, freq) for spelling. Without one, the words of the stored texts serve, with their counts.
    """

    def __init__(self, spark: SparkSession, path: str, cfg: EngineConfig = EngineConfig(), generator: Generator | None = None, load: Callable[[], Embed] = hashing_embedder, dictionary: DataFrame | None = None, lemmas=None):
        self.spark, self.path, self.cfg, self.load, self.lemmas = spark, path, cfg, load, lemmas
        self.generator, self._given = generator or RuleGenerator(), dictionary

    def build(self, folder: str, extract: Extract = pdf_pages, glob: str = "*.pdf", log_path: str | None = None) -> Store:
        """What was opened before goes: the next question sees the new rows."""
        store = build_store(self.spark, folder, self.path, self.cfg, self.generator, extract, glob, log_path, self.load)
        for made in ("searcher", "dictionary"):
            self.__dict__.pop(made, None)
        return store

    @cached_property
    def searcher(self) -> Searcher:
        chunks = with_dense_index(Store(self.spark, self.path).load().drop("pos"), "source", "page", "id")
        return Searcher(materialise(chunks, "opened"), self.cfg, self.lemmas)

    @cached_property
    def dictionary(self) -> DataFrame:
        if self._given is not None:
            return self._given
        words = self.searcher.chunks.select(F.explode(text.bag(F.col("text"), self.cfg.profile)).alias("word"))
        return materialise(words.groupBy("word").agg(F.count("*").alias("freq")), "dictionary")

    def prepare(self, questions: DataFrame) -> DataFrame:
        """(query_id, query) with misspelt words corrected, the fields of the model's answer and embedded_query. ValueError if a
        question is null or blank."""
        questions = questions.select("query_id", "query")
        if not questions.where(F.coalesce(text.strip(F.col("query")), F.lit("")) == "").isEmpty():
            raise ValueError("a question is blank")
        spelt = materialise(correct_queries(questions, self.dictionary, self.cfg.custom_words), "spelt")
        asked = enrich_queries(spelt, self.generator, self.cfg.enrich)
        return embed_column(asked, "query", "embedded_query", self.cfg.dimension, self.load, batch=self.cfg.embed_batch)

    def search(self, questions: DataFrame) -> SearchResult:
        return self.searcher.search(self.prepare(questions))

    def answer(self, *questions: str) -> DataFrame:
        """The chosen chunks of each question, numbered from 0 in the order given."""
        rows = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")
        return self.searcher.with_chunks(self.search(rows).top)
