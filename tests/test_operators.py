import math
import random
import sys
import time
from collections import Counter

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from quarry.config import EngineConfig, EnrichConfig
from quarry.operators import bm25, fusion, index
from quarry.operators.enrich import enrich, enrich_queries, usable_answer
from quarry.operators.output import output
from quarry.operators.semantic import semantic_top_k
from quarry.operators.spelling import corrections, correct_queries, edits as edits_of
from quarry.plans.build import build_store
from quarry.plans.search import Searcher
from quarry.providers import RuleGenerator
from quarry.sources import store
from quarry.sources.pages import form_feed_pages, fragments, pages, scan_files

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import tests


def index_of(spark, docs):
    df = spark.createDataFrame(list(enumerate(docs)), "pos long, t string").withColumn("w", F.filter(F.split("t", " "), lambda x: x != ""))
    return df, bm25.build(df, {"text": F.col("w")})


def terms(spark, queries):
    return spark.createDataFrame([(q, t) for q, ts in queries.items() for t in ts.split()], "query_id long, term string")


def brute_bm25(docs, query, k1=1.5, b=0.75):
    words = [d.split() for d in docs]
    n, avg = len(docs), sum(map(len, words)) / len(docs)
    df = Counter(w for d in words for w in set(d))
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in idf.items()}
    return [sum(idf.get(q, 0) * d.count(q) * (k1 + 1) / (d.count(q) + k1 * (1 - b + b * len(d) / avg)) for q in query.split()) for d in words]


@pytest.mark.parametrize("docs, query, want", [
    (["население минск 2020", "молоко производство", "население брест", ""], "население минск", [0.641198, 0, 0, 0]),
    (["население минск 2020", "молоко производство", "население брест", ""], "минск минск", [1.282397, 0, 0, 0]),
    (["a b", "a", "a c"], "a b", [0.397985, -0.093929, -0.070662]),
])
def test_bm25_golden(spark, docs, query, want):
    df, ix = index_of(spark, docs)
    got = {r["pos"]: r["score"] for r in bm25.top_k(ix, df, terms(spark, {1: query}), 10).collect()}
    assert [round(got[i], 6) for i in range(len(docs))] == want


def test_bm25_random(spark):
    rnd = random.Random(3)
    docs = [" ".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(0, 12))) for _ in range(40)]
    qs = {i: " ".join(rnd.choice("abcdefghijz") for _ in range(rnd.randint(1, 4))) for i in range(8)}
    df, ix = index_of(spark, docs)
    got = {}
    for r in bm25.top_k(ix, df, terms(spark, qs), 7, digits=9).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["pos"], round(r["score"], 6))
    for i, q in qs.items():
        want = sorted(((round(s, 9), p) for p, s in enumerate(brute_bm25(docs, q))), key=lambda x: (-x[0], x[1]))[:7]
        assert [got[i][k] for k in range(1, 8)] == [(p, round(s, 6)) for s, p in want]


def test_bm25_all_zero_takes_first(spark):
    df, ix = index_of(spark, ["a", "b", "c"])
    assert [r["pos"] for r in bm25.top_k(ix, df, terms(spark, {1: "zzz"}), 2).orderBy("rank").collect()] == [0, 1]
    empty, ix = index_of(spark, ["", ""])
    assert {r["score"] for r in bm25.top_k(ix, empty, terms(spark, {1: "a"}), 2).collect()} == {0.0}


def test_bm25_empty(spark):
    asked = terms(spark, {1: "a"})
    for docs, want, figures in (([], [], []), ([""], [(1, 0, 0.0, 1)], [("text", 1, 0, 0.0)])):
        df = spark.createDataFrame(list(enumerate(docs)), "pos long, t string").withColumn("w", F.filter(F.split("t", " "), lambda x: x != ""))
        ix = bm25.build(df, {"text": F.col("w")})
        assert [tuple(r) for r in bm25.top_k(ix, df, asked, 3).collect()] == want and bm25.top_k(ix, df, asked.limit(0), 3).collect() == []
        assert [tuple(r) for r in ix.figures().select("field", "n", "vocabulary", "avgdl").collect()] == figures


@pytest.mark.parametrize("broadcast", [100, 3])
def test_semantic_both_ways(spark, broadcast):
    import numpy as np

    rnd = np.random.default_rng(1)
    x, q = rnd.normal(size=(60, 5)).astype("float32"), rnd.normal(size=(7, 5)).astype("float32")
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(60, None)], "pos long, embedding array<float>")
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, embedded_query array<float>")
    got = {(r["query_id"], r["rank"]): r["pos"] for r in semantic_top_k(c, d, 4, broadcast_queries=broadcast, block=16).collect()}
    s = (q / np.linalg.norm(q, axis=1, keepdims=True)) @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T
    for i in range(7):
        assert [got[i, r] for r in range(1, 5)] == list(np.argsort(-s[i], kind="stable")[:4])


def test_normalise_and_fuse(spark):
    def scores(sem, lex):
        df = spark.createDataFrame([(1, i, float(a), float(b), 0, i, float(m)) for i, (a, b, m) in enumerate(zip(sem, lex, (0.2, 0.55, 0.3)))], "query_id long, pos long, semantic_raw double, lexical_raw double, origin int, origin_rank int, metadata_score double")
        return fusion.fuse(fusion.normalise(df)).orderBy("pos").collect()

    near = lambda rows, c: [round(r[c], 6) for r in rows]
    assert near(scores((-0.3, -0.1, 0), (0, 0, -2)), "semantic_score") == [0, 0.666667, 1]
    assert near(scores((-0.3, -0.1, 0), (0, 0, -2)), "lexical_score") == [0, 0, 0]
    assert near(scores((0.5, 0.5, 0.5004), (1, 1, 1)), "semantic_score") == [0.500133] * 3
    assert near(scores((0.5, 0.5, 0.5004), (1, 1, 1)), "lexical_score") == [0.693147] * 3
    assert near(scores((0.8, 0.5, 0), (4, 0, 1)), "hybrid_score") == [0.84, 0.45375, 0.167669]


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    rows = index.with_dense_index(df, "k").collect()
    assert all(r["k"] == r["pos"] for r in rows) and len(rows) == 1000


def test_upsert(spark):
    mk = lambda rows: spark.createDataFrame(rows, "source string, v int")
    old, seen = mk([("a", 1), ("b", 2)]), spark.createDataFrame([("a",)], "source string")
    assert store.upsert(old, mk([]), seen).collect() == [("b", 2)]
    once = store.upsert(old, mk([("a", 5)]), seen)
    assert sorted(store.upsert(once, mk([("a", 5)]), seen).collect()) == sorted(once.collect())


def edits(a, b):
    """Fewest edits one after another (insert, delete, replace, swap neighbours); all words one edit away, twice; 3 stands for more."""
    letters = sorted(set(a + b))

    def step(w):
        cut = [(w[:i], w[i:]) for i in range(len(w) + 1)]
        return {x + y[1:] for x, y in cut if y} | {x + y[1] + y[0] + y[2:] for x, y in cut if len(y) > 1} | {x + c + y[1:] for x, y in cut if y for c in letters} | {x + c + y for x, y in cut for c in letters}

    if a == b:
        return 0
    one = step(a)
    return 1 if b in one else 2 if abs(len(a) - len(b)) <= 2 and any(b in step(w) for w in one) else 3


def test_edits(spark):
    rnd = random.Random(5)
    pairs = [("ca", "abc"), ("abcd", "badc"), ("abc", "cab"), ("", "ab"), ("a", ""), ("abcd", "dcba"), ("минск", "минкс")]
    pairs += [("".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6))), "".join(rnd.choice("abc") for _ in range(rnd.randint(0, 6)))) for _ in range(400)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").select("i", edits_of(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()
    assert [3 if r["d"] is None else r["d"] for r in got] == [edits(a, b) for a, b in pairs]


def test_spell_correct_query_uses_every_word(spark, tmp_path):
    """Rare, short and long words are asked and offered: what all pairs of words say."""
    from quarry.plans.catalog import spell_correct

    texts = ["of an it management management internationalisation interpretation", "internationalisation responsibilities ox at a " + "common comet " * 25 + "x" * 300]
    asked = ["a of management internationalisation responsibilities", "common interpretation at unrelatedlongquestionword"]
    for name, rows in (("documents", texts), ("benchmark", asked)):
        spark.createDataFrame([(t,) for t in rows], "text string").write.parquet(f"{tmp_path}/{name}.parquet")
    freq = {w: " ".join(texts).split().count(w) for w in " ".join(texts).split()}
    want = {}
    for w in {x[:1] + x[2:] for x in " ".join(asked).split()}:
        near = sorted((d, -n, c) for c, n in freq.items() if abs(len(c) - len(w)) <= 2 and (d := edits(w, c)) <= 2)
        want[w] = w if w in freq or not near else near[0][2]
    assert {r["word"]: r["correction"] for r in spell_correct(spark, str(tmp_path)).collect()} == want
    assert want["mnagement"] == "management" and want["iternationalisation"] == "internationalisation"


def test_spelling(spark):
    d = spark.createDataFrame([("минск", 9), ("минус", 5), ("население", 3)], "word string, freq long")
    w = spark.createDataFrame([("минкс",), ("насиление",), ("минус",), ("zzzzzz",), ("свой",)], "word string")
    got = {r["word"]: r["correction"] for r in corrections(w, d, custom=("свой",)).collect()}
    assert got == {"минкс": "минск", "насиление": "население", "минус": "минус", "zzzzzz": "zzzzzz", "свой": "свой"}
    asked = spark.createDataFrame([("бгэу",), ("бгээу",)], "word string")
    assert {r["word"]: r["correction"] for r in corrections(asked, d, custom=("бгэу",)).collect()} == {"бгэу": "бгэу", "бгээу": "бгэу"}
    q = spark.createDataFrame([(1, "  насиление  минкс "), (2, ""), (3, None)], "query_id long, query string")
    assert {r["query_id"]: r["query"] for r in correct_queries(q, d).collect()} == {1: "население минск", 2: "", 3: ""}


class Fixed:
    def __init__(self, answer):
        self.answer = answer

    def generate(self, system, prompt):
        if self.answer == "raise":
            raise RuntimeError
        return self.answer

    def reset(self):
        return True


def test_enrich(spark):
    rows = spark.createDataFrame([("a", "Население Минска", "s", 9), ("b", "", "s", 9), ("c", "x", "s", 1)], "id string, text string, source string, page int")
    good = 'Ответ: {"context": "Рожь", "geo": "Минск", "metrics": ["Рожь", "abc"], "years": ["2020", 2021], "time_granularity": "year"}'
    cfg = EnrichConfig(retry_sleep_s=0)
    out, bad = enrich(rows, Fixed(good), cfg)
    r = {x["id"]: x for x in out.collect()}
    assert r["a"]["geo"] == ["Минск"] and r["a"]["metrics"] == ["рожь"] and r["a"]["years"] == [2020, 2021] and r["a"]["context"].startswith("Рожь | население")
    assert r["b"]["chunk_type"] == "skip" and r["b"]["context"] == "нет текста" and r["c"]["context"] == "x" and bad.count() == 0
    for answer, kind in (('{"context": "cut', "parse_failed"), ("raise", "RuntimeError")):
        out, bad = enrich(rows, Fixed(answer), cfg)
        f = bad.collect()
        assert len(f) == 1 and f[0]["error_type"] == kind and f[0]["attempts"] == 2 and f[0]["chunk_id"] == "a"
        assert {x["id"]: x["context"] for x in out.collect()}["a"].startswith("Население Минска")
    q = spark.createDataFrame([(1, "q")], "query_id long, query string")
    assert enrich_queries(q, Fixed("no json")).first()["metrics"] == []
    assert enrich_queries(q, Fixed('{"years":["2020"],"geo":["x"]}')).first()["years"] == [2020]


def test_usable_answer(spark):
    raws = ['```json\n{"a":1}\n```', 'x {"a":1}', '{"a":"}"}', "{}", "[1]", None, '{"a":', "x {} y", "no"]
    got = spark.createDataFrame(list(enumerate(raws)), "i int, raw string").select("i", F.coalesce(usable_answer(F.col("raw")), F.lit(False)).alias("u")).orderBy("i").collect()
    assert [r["u"] for r in got] == [True, True, True, False, False, False, False, False, False]


class Flaky:
    """Fails at the first question for some chunks, as the prompt says, then answers."""

    def __init__(self, folder):
        self.folder = folder

    def generate(self, system, prompt):
        import hashlib
        import os

        mark = os.path.join(self.folder, hashlib.md5(prompt.encode()).hexdigest())
        first = not os.path.exists(mark)
        open(mark, "a").write("x")
        if first and "raise" in prompt:
            raise RuntimeError
        return "cut {" if first and "cut" in prompt else '{"context": "fine"}'

    def reset(self):
        return True


def test_only_failed_rows_are_asked_again(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), t, "s", 9) for i, t in enumerate(["ok one", "please raise", "a cut", "ok two"])], "id string, text string, source string, page int")
    out, bad = enrich(rows, Flaky(str(tmp_path)), EnrichConfig(retry_sleep_s=0, max_retries=3))
    assert [r["context"].split(" |")[0] for r in out.orderBy("id").collect()] == ["fine"] * 4 and bad.count() == 0
    assert sorted(p.stat().st_size for p in tmp_path.iterdir()) == [1, 1, 2, 2]
    empty, bad = enrich(rows.limit(0), Flaky(str(tmp_path)))
    assert empty.count() == 0 and bad.count() == 0


def test_build_search_and_rebuild(spark, tmp_path):
    docs = tmp_path / "in"
    docs.mkdir()
    (docs / "a.txt").write_text("\f".join(["front"] * 5 + ["молоко производство 2020", "население минск 2021"]), encoding="utf-8")
    (docs / "b.txt").write_text("\f".join(["front"] * 5 + ["население брест"]), encoding="utf-8")
    cfg = EngineConfig(dimension=32)
    run = lambda: build_store(spark, str(docs), str(tmp_path / "store"), cfg, RuleGenerator(), form_feed_pages, "*.txt")
    s = run()
    assert s.read().count() == 13
    (docs / "b.txt").write_text("", encoding="utf-8")
    (docs / "c.txt").write_text("one", encoding="utf-8")
    s = run()
    assert {r["source"]: r["count"] for r in s.read().groupBy("source").count().collect()} == {"a.txt": 7, "c.txt": 1}
    assert s.metadata("hashing").first()["chunks"] == 8
    store.check_integrity(s.read())
    chunks = index.with_dense_index(s.read().drop("pos"), "source", "page", "id")
    q = spark.createDataFrame([(1, "население минск", None, ["Минск"], ["население"], [2021], None, None)], "query_id long, query string, embedded_query array<float>, geo array<string>, metrics array<string>, years array<int>, time_granularity string, oked string")
    sr = Searcher(chunks, cfg)
    top = sr.with_chunks(sr.search(q).top).orderBy("rank").collect()
    assert top[0]["text"] == "население минск 2021"
    assert output(sr.with_chunks(sr.search(q).top)).count() == 5
    with pytest.raises(ValueError):
        output(q, "other")
    with pytest.raises(NotImplementedError):
        output(q, "chart")


def test_engine_asks_and_talks(spark, tmp_path):
    from quarry.__main__ import talk
    from quarry.plans.engine import Engine

    docs = tmp_path / "in"
    docs.mkdir()
    (docs / "a.txt").write_text("\f".join(["front"] * 5 + ["молоко производство 2020", "население минск 2021"]), encoding="utf-8")
    engine = Engine(spark, str(tmp_path / "store"), EngineConfig(dimension=32, custom_words=("бгэу",)))
    engine.build(str(docs), form_feed_pages, "*.txt")
    rows = spark.createDataFrame([(1, " насиление   минкс "), (2, "бгэу молоко")], "query_id long, query string")
    asked = {r["query_id"]: r for r in engine.prepare(rows).collect()}
    assert asked[1]["query"] == "население минск" and asked[2]["query"] == "бгэу молоко" and "население" in asked[1]["metrics"] and len(asked[1]["embedded_query"]) == 32
    found = engine.search(rows)
    counts = {r["query_id"]: r for r in found.counts.collect()}[1]
    assert counts["semantic_count"] == 7 and counts["lexical_count"] == 7 and counts["merged_count"] == 7 == counts["metadata_seed_count"] and counts["returned"] == 5
    assert engine.answer("насиление минкс").orderBy("rank").first()["text"] == "население минск 2021"
    said = []
    talk(engine, ["\n", "молоко\n"], said.append)
    assert said[0].startswith("1. a.txt, page 6, ") and sum(x[0] in "123" for x in said) == 3
    for blank in (" ", None):
        with pytest.raises(ValueError):
            engine.prepare(spark.createDataFrame([(1, blank)], "query_id long, query string"))


def test_store_commits(spark, tmp_path):
    """Sources keep their spelling, an upsert without rows deletes, a died writer changes nothing, of two writers both count."""
    from quarry.schema import STORE

    def rows(*keys):
        return spark.createDataFrame([(i, "c", "t", s, 1, [], [], [], None, None, 0, "data", [1.0]) for i, s in keys], STORE)

    seen = lambda *s: spark.createDataFrame([(x,) for x in s], "source string")
    ids = lambda st: sorted((r["id"], r["source"]) for r in st.read().collect())
    st = store.Store(spark, str(tmp_path / "s"))
    assert st.read().count() == 0
    st.upsert(rows(("a", "007"), ("b", "7"), ("c", "2020-01-02")), seen("007", "7", "2020-01-02"))
    st.upsert(rows(("d", "7")), seen("7"))
    assert ids(st) == [("a", "007"), ("c", "2020-01-02"), ("d", "7")]
    (tmp_path / "s" / "commits" / f"{3:012d}").write_text("layer-that-never-came")  # its writer died
    assert len(ids(st)) == 3
    st._next = lambda: 4
    st.upsert(rows(), seen("007"))
    del st._next
    assert ids(st) == [("c", "2020-01-02"), ("d", "7")]
    number, layers = st.current()
    other = st._layer(rows(("e", "8")), seen("8"))  # another writer takes the next number between reading and committing
    assert st._commit(number + 1, [*layers, other]) and not st._commit(number + 1, layers)
    for k in range(store.MAX_LAYERS):
        st.upsert(rows((f"z{k}", "9")), seen("9"))
    assert ids(st) == [("c", "2020-01-02"), ("d", "7"), ("e", "8"), (f"z{k}", "9")] and len(st.current()[1]) < store.MAX_LAYERS
    st.write_metadata("v")
    assert spark.read.json(f"{tmp_path}/s/metadata").first()["chunks"] == 4 and st.load().count() == 4
    with pytest.raises(ValueError):
        st.upsert(rows(("q", "5")).withColumn("embedding", F.lit(None).cast("array<float>")), seen("5"))
        st.load()
    store.export_json(st.read(), str(tmp_path / "out"))
    assert {r["id"] for r in store.load_json(spark, str(tmp_path / "out")).collect()} == {"c", "d", "e", f"z{k}", "q"}


def test_json_store(spark, tmp_path):
    (tmp_path / "data.json").write_text('[{"id":"a","page":"3","text":"t","source":"s","context":"c","years":null,"x":{"y":1}},{"id":"b","page":4,"years":[2020]}]', encoding="utf-8")
    rows = {r["id"]: r for r in store.load_json(spark, str(tmp_path / "data.json")).collect()}
    assert rows["a"]["page"] == 3 and rows["a"]["years"] == [] and rows["a"]["extra"] == {"x": '{"y":1}'} and rows["b"]["years"] == [2020]
    store.append_log(spark.createDataFrame([("e",)], "event string"), str(tmp_path / "log"))
    store.append_log(spark.createDataFrame([("e", 1.0)], "event string, ts double"), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).where("ts is not null").count() == 2


def test_streaming_ingest(spark, tmp_path):
    from quarry.sources.store import Store
    from quarry.streaming.ingest import ingest_stream

    docs = tmp_path / "in"
    docs.mkdir()
    go = lambda: ingest_stream(spark, str(docs), str(tmp_path / "store"), str(tmp_path / "cp"), EngineConfig(dimension=8), None, form_feed_pages, "*.txt").awaitTermination(120)
    (docs / "a.txt").write_text("p1\fp2", encoding="utf-8")
    go()
    time.sleep(1)
    (docs / "b.txt").write_text("p1", encoding="utf-8")
    go()
    assert Store(spark, str(tmp_path / "store")).read().count() == 3


def test_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x \f \fy", encoding="utf-8")
    got = pages(fragments(scan_files(spark, str(tmp_path), "*.txt"), form_feed_pages)).orderBy("page").collect()
    assert [(r["page"], r["text"]) for r in got] == [(1, "x"), (3, "y")]
