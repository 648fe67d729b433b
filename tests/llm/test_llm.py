"""The training-data operators against brute force, on small fixtures with odd rows."""

import collections
import hashlib
import html
import itertools
import math
import os
import random
import re
import struct
import time
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, decontam, html_extract, langid, line_dedup, ngram_lm, packing, queries, simhash, sql, topk, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, p int, word string, fp int"


def docs(spark, rows):
    """rows: (id, text); the other columns have names that the operators use inside."""
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or ""), 0.5, 1, "w", 2) for k, (i, t) in enumerate(rows)], DOCS)


def words(rnd, n, kinds=30):
    return " ".join(f"w{min(rnd.randrange(kinds), rnd.randrange(kinds))}" for _ in range(n))


def odd_rows(seed=0, n=40):
    rnd = random.Random(seed)
    rows = [(i, words(rnd, rnd.randrange(1, 60))) for i in range(n)]
    long = words(rnd, 5000, 400)
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n "), (n + 3, rows[0][1]), (n + 4, "É Ä ß 你好 w1"), (n + 5, long), (n + 6, "ONE one\x0bTwo")]


# --- 1: n-gram model


def tokens(t):
    return (t or "").encode().lower().split() + [b" e"]


def test_lm_against_brute_force(spark):
    rows = odd_rows()
    got = {r["doc_id"]: r for r in ngram_lm.score_held_out(docs(spark, rows)).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    c, bi = collections.Counter(), collections.Counter()
    for i, t in rows:
        if not held[i]:
            w = tokens(t)
            c.update(w)
            bi.update(zip([b" s", *w[:-1]], w))
    n, v = sum(c.values()), len(c)
    cc, before = collections.Counter(bi.values()), collections.Counter(w for _, w in bi)
    big, nc = ngram_lm.discounts([cc[k] for k in (1, 2, 3, 4)]), collections.Counter(before.values())
    small = ngram_lm.discounts([nc[k] for k in (1, 2, 3, 4)])
    tot, kinds = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for (a, _), k in bi.items():
        tot[a] += k
        kinds[a][min(k, 3) - 1] += 1
    gamma = sum(small[min(k, 3) - 1] for k in before.values()) / len(bi)
    low = lambda w: (max(before[w] - small[min(before[w], 3) - 1], 0) / len(bi) if w in before else 0) + gamma / (v + 1)

    def p(a, w):
        if not tot[a]:
            return low(w)
        k = bi[a, w]
        return (max(k - big[min(k, 3) - 1], 0) if k else 0) / tot[a] + sum(x * y for x, y in zip(big, kinds[a])) / tot[a] * low(w)

    assert sum(p(b"w1", w) for w in before) + p(b"w1", b"no such word") == pytest.approx(1)
    assert len(got) == len(rows)
    for i, t in rows:
        w = tokens(t)
        assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (held[i], len(w), sum(c[x] > 0 for x in w), n)
        assert got[i]["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
        assert got[i]["score"] == pytest.approx(sum(math.log10(p(a, x)) for a, x in zip([b" s", *w[:-1]], w)))


def test_lm_spreads_hot_words(spark):
    """One left word in half of all pairs: no shard holds more than a few times its share, and scores stay the same."""
    rnd = random.Random(6)
    rows = docs(spark, [(i, " ".join(f"the x{rnd.randrange(10**6)}" for _ in range(300))) for i in range(60)]).repartition(4)
    model = ngram_lm.train(rows)
    where = model.path.removeprefix("file://")
    sizes = [len(ngram_lm.map_arrays(f"{where}/{f}")["pairs"]) for f in os.listdir(where) if f.startswith("pairs-")]
    assert sum(sizes) == model.bigrams and max(sizes) < 3 * sum(sizes) / (1 << model.bits) and len(model.hot) == 2
    got = sorted(tuple(r) for r in ngram_lm.score(rows, model, "doc_id").collect())
    hot = ngram_lm.hot_words
    try:
        ngram_lm.hot_words = lambda *_: np.zeros(0, dtype=np.uint64)
        plain = ngram_lm.train(rows)
    finally:
        ngram_lm.hot_words = hot
    want = sorted(tuple(r) for r in ngram_lm.score(rows, plain, "doc_id").collect())
    np.testing.assert_allclose(np.array(got), np.array(want), rtol=1e-12)


def test_lm_edges(spark):
    assert ngram_lm.score_held_out(docs(spark, [(1, "a")]).limit(0)).count() == 0
    only = ngram_lm.score(docs(spark, [(1, "a b"), (None, "a")]), ngram_lm.train(docs(spark, [(1, "a")]).limit(0)), "doc_id").collect()
    assert {r["score"] for r in only} == {0.0}  # one word class: everything is unknown
    many = ngram_lm.score_held_out(docs(spark, [(1, "x " * 300)] * 2)).collect()  # counts beyond one byte
    assert len(many) == 2 and many[0] == many[1] and many[0]["score"] > -600


# --- 2: decontamination


def brute_hits(text, items, span=8):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(x.lower() if x.isascii() else x for x in t or ""))
    w, hit, found = split(text), set(), set()
    for name, body in items:
        b = split(body)
        m = min(len(b), span)
        for wins in [{tuple(b[j : j + m]) for j in range(len(b) - m + 1)}] if m else []:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in wins:
                    hit.update(range(i, i + m))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_decontamination_against_brute_force(spark, limit):
    rnd = random.Random(5)
    items = [(i, words(rnd, n, 12)) for i, n in enumerate((1, 3, 5, 7, 8, 9, 30, 30))] + [(20, None), (21, "--"), (None, "w1 w2"), (6, words(rnd, 12, 12)), (9, "a a a a a a a a a a"), (10, "É ß x y z ü 1 2 3")]
    rows = odd_rows(6) + [(100 + i, words(rnd, 20) + " " + b + " " + words(rnd, 20)) for i, (_, b) in enumerate(items) if b] + [(200, "a " * 50), (201, "É,ß;x.Y Z ü 1-2+3"), (202, items[7][1][:-3])]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = {r["doc_id"]: r for r in decontam.report(docs(spark, rows), bench, broadcast_rows=limit).collect()}
    assert len(got) == len(rows)
    for i, t in rows:
        n, hit, found = brute_hits(t, [x for x in items if x[0] is not None])
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["n_items"], got[i]["contaminated"]) == (n, hit, len(found), len(found) >= 2), (i, found)
        assert got[i]["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    kept = {r["doc_id"] for r in decontam.clean(docs(spark, rows), bench).collect()}
    assert kept == {i for i, r in got.items() if not r["contaminated"]}


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert decontam.report(docs(spark, [(1, "a")]).limit(0), bench).count() == 0
    r = decontam.report(docs(spark, [(1, "a b c"), (1, "a b c"), (None, "a b c")]), bench).collect()
    assert sorted((x["doc_id"] or 0, x["n_items"]) for x in r) == [(0, 1), (1, 1), (1, 1)]  # one for each row
    assert decontam.report(docs(spark, [(1, "a b c")]), bench.limit(0)).first()["n_hit"] == 0


# --- 3: SimHash


def test_simhash_against_brute_force(spark):
    from xxhash import xxh64_intdigest

    rnd = random.Random(9)
    base = words(rnd, 200, 400).split()
    near = [(300 + i, " ".join(w if k != i * 3 else "zz" for k, w in enumerate(base))) for i in range(60)]
    rows = odd_rows(9) + near + [(400, near[0][1]), (None, near[1][1]), (None, "only here x y z")]

    def fp(t):
        w = (t or "").encode().lower().split()
        if not w:
            return 0
        sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
        hs = [xxh64_intdigest(s, 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    f = [fp(t) for _, t in rows]
    named = [k for k, (i, _) in enumerate(rows) if i is not None]
    root = {k: k for k in named}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in named:
        for b in named:
            if a < b and (f[a] ^ f[b]).bit_count() <= 3:
                root[find(b)] = find(a)
    groups = collections.defaultdict(list)
    for k in named:
        groups[find(k)].append(rows[k][0])
    want = {rows[k][0]: (f"{f[k]:016x}", min(groups[find(k)])) for k in named}
    for tile in (4096, 5):
        got = simhash.near_duplicates(docs(spark, rows), tile=tile).collect()
        assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
        assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == sorted([str(want[301][1]), "None"])
    assert len({c for _, c in want.values()}) < len(want) - 20
    kept = [r["doc_id"] for r in simhash.keep_one(docs(spark, rows + rows[:3])).collect()]
    assert sorted(x for x in kept if x is not None) == sorted({c for _, c in want.values()}) and kept.count(None) == 2


def test_simhash_many_random_links(spark):
    """Clusters with chains: what the blocks find is what all pairs find."""
    rnd = random.Random(2)
    fps = [rnd.getrandbits(64) for _ in range(40)]
    for _ in range(400):
        x = rnd.choice(fps)
        for _ in range(rnd.randrange(1, 5)):
            x ^= 1 << rnd.randrange(64)
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, rep long")
    root = list(range(len(fps)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for tile in (4096, 8):
        got = {r["v"]: r["root"] for r in simhash.components(simhash.links(df, tile=tile)).collect()}
        assert all(got.get(k, k) == find(k) for k in range(len(fps)))


@pytest.mark.parametrize("tile", [4096, 6])
def test_simhash_with_similarity(spark, tile):
    """Links need few differing bits and similar shingle sets; all pairs say the same."""
    from xxhash import xxh64_intdigest

    rnd = random.Random(4)
    rows = odd_rows(4)
    for c in range(12):
        base = words(rnd, 160, 500).split()
        for v in range(6):
            changed = list(base)
            for _ in range(rnd.randrange(0, 9)):
                changed[rnd.randrange(len(base))] = f"v{rnd.random()}"
            rows.append((1000 + 10 * c + v, " ".join(changed)))
    rows += [(2000, rows[-1][1]), (None, rows[-1][1])]
    fps, sketches, sets = [], [], []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        hs = [xxh64_intdigest(b" ".join(w[i : i + 5]), 42) for i in range(max(1, len(w) - 4))] if w else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
        sketches.append([min((h // 64 for h in hs if h % 64 == b), default=None) for b in range(64)])
        sets.append(set(hs))
    marks = [[None if x is None else x % 255 for x in s] for s in sketches]

    def linked(a, b):
        used = [(x, y) for x, y in zip(marks[a], marks[b]) if x is not None or y is not None]
        return (fps[a] ^ fps[b]).bit_count() <= 6 and (not used or sum(x == y for x, y in used) / len(used) >= 0.8)

    named = [k for k, r in enumerate(rows) if r[0] is not None]
    root = {k: k for k in named}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    cut = 0
    for a in named:
        for b in named:
            if a < b and linked(a, b):
                root[find(b)] = find(a)
            cut += a < b and (fps[a] ^ fps[b]).bit_count() <= 6 and not linked(a, b)
    groups = collections.defaultdict(list)
    for k in named:
        groups[find(k)].append(rows[k][0])
    want = {rows[k][0]: min(groups[find(k)]) for k in named}
    got = simhash.near_duplicates(docs(spark, rows), tile=tile, shingle=5, distance=6, blocks=8, shared=2, similarity=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [want[2000]]
    assert cut and any(len(g) > 1 and len({rows[k][1] for k in named if find(k) == f}) > 1 for f, g in groups.items())
    exact = [len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b])) for a in named for b in named if a < b and (sets[a] or sets[b]) and linked(a, b)]
    assert min(exact, default=1) > 0.6


@pytest.mark.parametrize("tile", [4096, 6])
def test_near_duplicates_by_exact_jaccard(spark, tile):
    """Links are all pairs of real Jaccard similarity 0.8 or more, far bits and estimates below 0.8 included."""
    rnd = random.Random(14)
    rows = odd_rows(4)
    for c in range(30):
        base = [f"w{rnd.randrange(5000)}" for _ in range(rnd.choice([30, 60, 150, 400]))]
        for v in range(5):
            changed = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 40)):
                changed[rnd.randrange(len(base))] = f"v{rnd.random()}"
            rows.append((1000 + 10 * c + v, " ".join(changed)))
    rows += [(5000, "a b c d e f g h i"), (5001, "a b c d e f g h"), (5002, "b c d e f g h i"), (None, "b c d e f g h i")]  # 4 of 5 shared: just 0.8
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    similar = lambda a, b: sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])
    named = [k for k, r in enumerate(rows) if r[0] is not None]
    root, far, misjudged = {k: k for k in named}, 0, 0
    seen = [simhash.fingerprint_and_sketch(t, 5) for _, t in rows]
    sketch = [np.frombuffer(s, dtype=np.uint8) for _, s in seen]

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in named:
        for b in named:
            if a < b and sets[a] and sets[b]:
                far += similar(a, b) and (seen[a][0] ^ seen[b][0]).bit_count() > 6
                misjudged += similar(a, b) != (float(simhash.similarity_of(sketch[a], sketch[b])) >= 0.8)
            if a < b and similar(a, b):
                root[find(b)] = find(a)
    assert far > 5 and misjudged > 5
    groups = collections.defaultdict(list)
    for k in named:
        groups[find(k)].append(rows[k][0])
    want = {rows[k][0]: min(groups[find(k)]) for k in named}
    got = simhash.near_duplicates(docs(spark, rows), tile=tile, shingle=5, jaccard=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert want[5001] == 5000 and [r["component_id"] for r in got if r["doc_id"] is None] == [want[5002]]
    assert {r["doc_id"]: r["fp"] for r in got} == {i: f for (i, _), (f, _) in zip(rows, seen)}


def test_pipeline_decides_near_duplicates_exactly(spark):
    """Estimates on the wrong side of 0.8 delete nothing and keep nothing."""
    import corpus_pipeline as cp

    rnd, rows, want, wrong = random.Random(8), [], set(), collections.Counter()
    while min(wrong[True], wrong[False]) < 5:
        base = [f"w{rnd.random()}" for _ in range(200)]
        other = base[: rnd.randrange(170, 187)] + [f"v{rnd.random()}" for _ in range(15)]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, other))
        similar = 10 * len(a & b) >= 8 * len(a | b)
        s, t = (np.frombuffer(simhash.fingerprint_and_sketch(" ".join(w), 5)[1], dtype=np.uint8) for w in (base, other))
        if (float(simhash.similarity_of(s, t)) >= 0.8) != similar and wrong[similar] < 5:
            wrong[similar] += 1
            rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
            want |= {len(rows) - 2} if similar else {len(rows) - 2, len(rows) - 1}
    assert {r["doc_id"] for r in cp.near_dedup(spark, docs(spark, rows), "").collect()} == want


def test_pipeline_near_duplicates_are_found_by_simhash(spark, monkeypatch):
    """Without the completion, exactly the similar pairs chained by near fingerprints go, those that are not similar stay."""
    import corpus_pipeline as cp
    from quarry.llm import jaccard

    rnd, rows = random.Random(9), []
    for _ in range(150):
        base = [f"w{rnd.random()}" for _ in range(rnd.choice([8, 400]))]
        other = list(base)
        for _ in range(rnd.randrange(1, 4) if len(base) > 8 else 0):
            other[rnd.randrange(len(base))] = f"v{rnd.random()}"
        other = other if len(base) > 8 else [*base, "x"]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(other))]
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, ("a b c d e " * 60).strip()), (len(rows) + 2, ("a b c d e " * 60).strip() + " f" * 5)]
    prints, sets = {}, {}
    for i, t in rows:
        w = t.split()
        prints[i], sets[i] = simhash.fingerprint(t, 5), {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    near = {(a, b) for a in sets for b in sets if a < b and ((prints[a] ^ prints[b]) & (2**64 - 1)).bit_count() <= 6}
    similar = {(a, b) for a in sets for b in sets if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])}
    assert len(near & similar) > 5 and len(similar - near) > 5 and near - similar

    def kept():
        return {r["doc_id"] for r in cp.near_dedup(spark, docs(spark, rows), "").collect()}

    def no_pairs(similarity):
        def of(starts, sizes, sid, n, data):
            return iter(())

        return of

    assert kept() == set(sets) - {b for _, b in similar}
    with monkeypatch.context() as m:
        m.setattr(jaccard, "_candidates", no_pairs)
        assert kept() == set(sets) - {b for _, b in near & similar}
    found = []
    monkeypatch.setattr(simhash, "group_links", lambda *a, links=simhash.group_links, **k: found.append(1) or links(*a, **k))
    assert kept() and found


def test_simhash_blocks():
    assert simhash.blocks_for(10**9, 3) == (5, 2) and simhash.blocks_for(10**6, 6) == (8, 2) and simhash.blocks_for(10**8, 6) == (9, 3)


def test_simhash_edges(spark):
    assert simhash.near_duplicates(docs(spark, [(1, "a")]).limit(0)).count() == 0
    r = simhash.near_duplicates(docs(spark, [(5, None), (3, ""), (4, " ")])).collect()
    assert {(x["fingerprint"], x["component_id"]) for x in r} == {("0" * 16, 3)}


# --- 4: toxicity


def test_toxicity_held_out(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        t = words(rnd, 40).split()
        if bad:
            t[rnd.randrange(40)] = rnd.choice(("Horrid", "vilest", "horridly"))
        rows.append((i, " ".join(t)))
        labels.append((i, int(bad)))
    rows += [(1000, None), (1001, "")]
    lab = spark.createDataFrame(labels + [(None, 1), (2, None), (5000, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score_documents(docs(spark, rows), lab).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [i for i, _ in labels if got[i]["held_out"]]
    assert len(held) > 40 and all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    assert got[1000]["score"] == got[1001]["score"] < 0.5


def test_toxicity_against_brute_force():
    """Ratios and scores from n-gram strings; the weights' loss has no slope, and the penalty is the best of the inner fold."""
    rnd = random.Random(9)
    texts = [words(rnd, 20) + (" vile vilest" if k % 3 == 0 else "") for k in range(30)] + ["", "Ä ß"]
    y = np.array([int(k % 3 == 0) for k in range(30)] + [0, 1])

    def values(t):
        t = f" {t.lower()} "
        n = collections.Counter(t[i : i + o] for o in toxicity.ORDERS for i in range(len(t) - o + 1))
        return {g: math.log1p(1000 * c / len(t)) for g, c in n.items()}

    seen = [values(t) for t in texts]
    df = collections.Counter(g for v in seen for g in v)
    ratio = {g: math.log((1 + sum(v.get(g, 0) for v, b in zip(seen, y) if b)) / (y.sum() + 2)) - math.log((1 + sum(v.get(g, 0) for v, b in zip(seen, y) if not b)) / (len(y) - y.sum() + 2)) for g in df if df[g] > 1}
    for penalty in (1e-2, 1e-4):
        m = toxicity.fit(texts, list(y), penalties=(penalty,))
        assert len(m.features) == sum(r != 0 for r in ratio.values())
        np.testing.assert_allclose(sorted(m.ratios), sorted(ratio.values()), rtol=1e-4, atol=1e-5)
        place = {}
        for g in ratio:  # the padded text " g " holds g at its second place
            places = {o: f for o, (_, f) in zip(toxicity.ORDERS, toxicity.grams([g], 22))}
            place[g] = int(np.searchsorted(m.features, places[len(g)][1]))
            assert m.features[place[g]] == places[len(g)][1] and m.ratios[place[g]] == pytest.approx(ratio[g], rel=1e-4, abs=1e-5)
        x = np.zeros((len(texts), len(m.features)))
        for k, v in enumerate(seen):
            for g, a in v.items():
                if g in ratio:
                    x[k, place[g]] = a * ratio[g]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-15)
        p = 1 / (1 + np.exp(-(x @ m.weights + m.intercept)))
        np.testing.assert_allclose(m.scorer()(texts), p, atol=1e-4)
        assert np.abs(x.T @ (p - y) / len(y) + penalty * m.weights).max() < 1e-2 and abs((p - y).mean()) < 1e-2
    assert toxicity.fit([], []).scorer()([""])[0] < 1e-200 and toxicity.fit(["a"], [1]).scorer()([""])[0] == 1


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score_documents(docs(spark, [(1, "a")]), none).first()["predicted"] == 0
    assert toxicity.score_documents(docs(spark, [(1, "a")]).limit(0), none).count() == 0
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    assert toxicity.score_documents(docs(spark, [(i, "a") for i in range(20)]), ones).first()["predicted"] == 1


# --- 5: chat


def test_chat_round_trip(spark):
    nasty = ["\\", "<", "\\l", "\\\\b<turn user>", "</turn>\n", "plain", "", None, "\\### Assistant: </turn> ok", "g>\\g"]
    rnd = random.Random(7)
    rows = [(c, t, ("user", "assistant", "system", "x<y>\\z", None)[rnd.randrange(5)] if c else ("user", "assistant")[t % 2], rnd.choice(nasty)) for c in range(30) for t in range(rnd.randrange(1, 9))]
    rows += [(50, 0, "user", "a"), (50, 0, "user", "a"), (50, 1, "assistant", "b"), (None, 0, "user", "q")]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "conv_id long, turn long, role string, text string, t int, segments string")
    made = chat.format_conversations(df)
    back = {r["conv_id"]: r for r in made.select("conv_id", "valid", "formatted", "segments", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    digests = {r["conv_id"]: r for r in chat.digest(made).collect()}
    for c in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((x for x in rows if x[0] == c), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == want
        loss = "".join(t for r, t in want if r == "assistant")
        assert digests[c]["n_turns"] == len(want) and digests[c]["loss_chars"] == len(loss) and digests[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert digests[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in want).encode()).hexdigest()
        assert digests[c]["formatted_chars"] == len(back[c]["formatted"])
    assert back[0]["formatted"].count("</turn>\n") == len([r for r in rows if r[0] == 0]) and not back[50]["valid"] and not back[None]["valid"]
    assert chat.format_conversations(df.limit(0)).count() == 0


@pytest.mark.parametrize("opening, closing", [("<|{role}|>", "<|end|>\n"), ("### {role}: ", "\n"), ("[{role}] ", "[/.*+?]"), ("\n{role}>>", "\\E$"), ("{role}:", ";;"), ("b{role}l", "g1"), ("<{role}> <", "</end>"), ("<end{role}|", "d|>")])
def test_any_template_round_trips(spark, opening, closing):
    template = chat.Template(opening=opening, closing=closing)
    rnd, bits = random.Random(opening), ["\\", "\\b", "b", "l", "g", "<", ">", "|", "\n", ":", ";", "[", "a\n### assistant: b", opening.format(role="assistant"), closing, closing[:-1], closing[1:], "user", " "]
    rows = [(c, t, rnd.choice(["user", "assistant", "".join(rnd.choices(bits, k=2))]), "".join(rnd.choices(bits, k=rnd.randrange(6)))) for c in range(40) for t in range(rnd.randrange(1, 5))]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template)
    digests = {r["conv_id"]: r for r in chat.digest(made, template).collect()}
    for r in made.select("conv_id", "formatted", chat.read_back(F.col("formatted"), template).alias("turns")).collect():
        want = [(x[2], x[3]) for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want and r["formatted"].count(closing) >= len(want)
        loss = "".join(t for role, t in want if role == "assistant")
        assert digests[r["conv_id"]]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


@pytest.mark.parametrize("opening, closing", [("<{role}>", ""), ("{role}", "x"), ("no role: ", "x"), ("\n{role}: ", "\n"), ("<{role}/end>", "</end>")])
def test_ambiguous_templates_are_refused(opening, closing):
    with pytest.raises(ValueError):
        chat.Template(opening=opening, closing=closing)


# --- 6: language


def test_forward_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "ba", "▁ab"]
    p = np.array([[0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.1, 0.2], [0.2, 0.1], [0.1, 0.1], [0.2, 0.2]])

    def brute(s, g):
        return 1.0 if not s else sum(p[pieces.index(s[:n]), g] * brute(s[n:], g) for n in range(1, len(s) + 1) if s[:n] in pieces)

    finder = langid.Pieces(pieces)
    for w in ("▁ab", "▁abab", "▁baab", "▁a"):
        got = langid.forward(finder.lattice([w]), langid.padded(p))[-1][0]
        assert got == pytest.approx([brute(w, 0), brute(w, 1)])
    assert langid.forward(finder.lattice(["▁az"]), langid.padded(p))[-1][0][0] == pytest.approx((p[0, 0] * p[2, 0] + p[1, 0]) * langid.UNKNOWN)


def all_segmentations(word, prob):
    """(probability, pieces) of each."""
    if not word:
        yield 1.0, ()
    for k in range(1, len(word) + 1):
        if (q := prob.get(word[:k], 1e-9 if k == 1 else 0)) > 0:
            for r, rest in all_segmentations(word[k:], prob):
                yield q * r, (word[:k], *rest)


def test_long_words_and_pieces_are_whole():
    vocab = langid.vocabulary(queries.piece_vocabulary())
    assert max(map(len, vocab)) > 10
    p = np.full((len(vocab), 1), 1 / len(vocab))
    for word in ("donaudampfschifffahrtsgesellschaft", "internationalisation" * 3, "x" * 70000):
        full = langid.MARK + word
        place, a, log = {x: 1 for x in vocab}, [1.0], 0.0
        top = max(map(len, vocab))
        for j in range(1, len(full) + 1):  # scaled sums in plain Python
            s = sum(a[-k] * (1 / len(vocab) if full[j - k : j] in place else 1e-9 if k == 1 else 0) for k in range(1, min(len(a), top) + 1))
            log, a = log + math.log(s), [x / s for x in a[-top:]] + [1.0]
        got = langid.Scorer(vocab, p, 100).texts([[word]])[0, 0]
        assert got == pytest.approx(log, rel=1e-9)


def test_language_learning_and_posterior_against_brute_force(spark, monkeypatch):
    """One round of EM, scores and labels from enumerated segmentations; long words take the other path to the same numbers."""
    pieces = ["▁", "a", "b", "ab", "▁a", "ba", "bab", "▁ba"]
    texts = {"x": ["abab ba", "aba a"], "y": ["bab b", "bbabc bb"]}
    counts = [collections.Counter(w for t in texts[g] for w in langid.letters(t)) for g in "xy"]
    prob = [dict.fromkeys(pieces, 1 / len(pieces)) for _ in "xy"]
    for _ in range(2):
        for g in (0, 1):
            seen = collections.Counter()
            for w, n in counts[g].items():
                every = list(all_segmentations("▁" + w, prob[g]))
                for q, seg in every:
                    for x in seg:
                        seen[x] += n * q / sum(e[0] for e in every)
            total = sum(seen[x] + 0.05 for x in pieces)
            prob[g] = {x: (seen[x] + 0.05) / total for x in pieces}
    want = np.array([[prob[g][x] for g in (0, 1)] for x in pieces])
    np.testing.assert_allclose(langid.learn(counts, pieces, rounds=2), want, rtol=1e-9)
    monkeypatch.setattr(langid, "LONG", 2)
    np.testing.assert_allclose(langid.learn(counts, pieces, rounds=2), want, rtol=1e-9)
    monkeypatch.undo()
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(["ab abab", "bb c", "", None, "1 2"])], "doc_id long, text string")
    for r in langid.predict(rows, ["x", "y"], pieces, want).collect():
        words_ = langid.letters(r["text"] or "")
        logs = [sum(math.log(sum(q for q, _ in all_segmentations("▁" + w, prob[g]))) for w in words_) for g in (0, 1)]
        if not words_:
            assert (r["lang_pred"], r["score"]) == ("und", 1)
        else:
            assert r["lang_pred"] == "xy"[logs[1] > logs[0]] and r["score"] == pytest.approx(1 / (1 + math.exp(-abs(logs[0] - logs[1]))))


def test_rejected_documents(spark):
    rows = docs(spark, [(1, "the house and the garden"), (2, "12 34"), (3, None)])
    assert {r["doc_id"] for r in langid.keep_identified(rows, queries.piece_vocabulary()).collect()} == {1}
    assert {r["doc_id"] for r in langid.keep_identified(rows.withColumn("lang", F.lit(None).cast("string")), queries.piece_vocabulary()).collect()} == {1}


def test_language_edges(spark):
    vocab = queries.piece_vocabulary()
    rnd = random.Random(1)
    en, de = "the of and that with from they were this which".split(), "der die und nicht werden eine ich auch schon zwischen".split()
    rows = [(i, " ".join(rnd.choice(en if i % 2 else de) for _ in range(15))) for i in range(60)]
    df = docs(spark, rows + [(100, None), (101, "12 ²Ⅷ _!"), (102, "zwischen " * 3000 + "x" * 5000)]).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").when(F.col("doc_id") == 102, None).otherwise("de"))
    got = {r["doc_id"]: r for r in langid.identify(df, vocab).collect()}
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "de") and 0 <= got[i]["score"] <= 1 for i in range(60))
    assert got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and got[102]["lang_pred"] == "de"
    kept = langid.keep_identified(df, vocab)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(60)) | {102}
    assert langid.identify(df.limit(0), vocab).count() == 0
    assert langid.identify(df.withColumn("lang", F.lit(None).cast("string")), vocab).where("lang_pred <> 'und'").count() == 0


# --- 7: HTML


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("just text", "just text"),
    ("<body><nav>menu</nav><article><h1>T&amp;&am</h1><p><b>one<br><p>two &eacute;&#x41; \n  three</p><aside>no</aside><div class='comments'>no</div><p>x<span class=ad>no</span>y</p></article><footer>f</footer>", "T&&am\none\ntwo éA three\nxy"),
    ("<body><header>h</header><div id=content><p>main<script>var a='</p>'</script> text<p>more</div><div class='cookie-notice'>no</div><form>no</form><ul><li>a<li>b</ul>", "main text\nmore\na\nb"),
    ("<main><p>a</p><!-- <p>no</p> --><table><tr><td>c1<td>c2</table>", "a\nc1\nc2"),
    ("<p>unclosed <b>bold<div>next</div>tail", "unclosed bold\nnext\ntail"),
    ("<p>a < b and c</p><p>5 > 3</p>", "a < b and c\n5 > 3"),
    ("<article><header><h1>in</h1></header><p>b</p><footer>no</footer></article>", "in\nb"),
])
def test_main_text(page, want):
    assert html_extract.main_text(page) == want


def test_style_tree_removes_what_repeats(spark):
    rnd = random.Random(3)
    rows = [(i, f"http://A.example/{i}", f"<body><div class=top>Welcome to our site</div><div class=story><p>{words(rnd, 20)}</p></div></body>", 1) for i in range(20)]
    rows += [(100, "http://b.example/1", "<div class=top>Welcome to our site</div><p>x</p>", 1), (101, None, None, 1), (102, "odd url", "<p>y</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, removed int")
    for limit in (100, 0):
        got = {r["page_id"]: r for r in html_extract.extract(df, broadcast_rows=limit).collect()}
        assert all("Welcome" not in got[i]["text"] and got[i]["n_chars"] == len(got[i]["text"]) > 20 for i in range(20))
        assert got[100]["text"] == "Welcome to our site\nx" and got[101]["text"] == "" and got[102]["text"] == "y"
    assert html_extract.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("page, want", [
    ('<div class="content has-sidebar"><p>Real text</p></div>', "Real text"),
    ('<article class="social-policy"><p>a</p><div id="related-work">b</div><table><tr><td class="notice">c</table><button>d</button> <math>x</math></article>', "a\nb\nc\nd x"),
    ('<div class="content with-sidebar"><article>x</article><p>beside</p></div>', "x"),
    ("<div id=comments><article class=comment>no</article></div><p>yes</p>", "yes"),
    ("<form id=aspnet><nav>n</nav><article>x</article></form>", "x"),
    ("<nav><article>no</article></nav><p>yes</p>", "yes"),
])
def test_names_are_no_verdict_on_the_main_text(page, want):
    assert html_extract.main_text(page) == want


def test_html_time_is_linear():
    for piece in ("<div>", '<a href="', "<li>", "<!--", "<script>", "a < b ", "<p class='x y'>t ", "</i><b>", '<a b="x>'):
        seconds = []
        for n in (100_000, 200_000):
            page = piece * (n // len(piece))
            began = time.perf_counter()
            html_extract.main_text(page + "'>")
            seconds.append(time.perf_counter() - began)
        assert seconds[1] < 2 + 4 * seconds[0], piece


def test_importances_and_low_branches_against_brute_force(spark):
    """Entropies of a small site, from the element ways that a strict page has; removing the tree's verdicts brings menus back."""
    rnd = random.Random(17)
    rows = []
    for i in range(60):
        menu = "".join(f"<li><a href=/>{rnd.choice('abcdef')}</a></li>" for _ in range(3))
        story = "".join(f"<p>{'same' if rnd.random() < 0.2 else words(rnd, 5)}</p>" for _ in range(rnd.randrange(1, 4)))
        rows.append((i, f"http://h{i % 2}/", f"<body><ul>{menu}</ul><div class=top>{'hi' if rnd.random() < 0.9 else words(rnd, 2)}</div><div class=story>{story}</div></body>"))
    seen = collections.defaultdict(collections.Counter)  # (host, way, kind) -> values
    for _, url, page in rows:
        host, texts, looks, way = url[7:-1], [], collections.defaultdict(list), []
        for tag, name, text in re.findall(r"<(/?\w+)(?: class=(\w+)| href=/)?>([^<]*)", page):
            if tag[0] == "/":
                way.pop()
                continue
            looks[tuple(x for x in way if x != "a")].append(f"{tag}.{name}" if name else tag)
            way.append(f"{tag}.{name}" if name else tag)
            if text:
                texts.append((tuple(x for x in way if x != "a"), "links" if tag == "a" else text))
        for w, text in texts:
            seen[host, w, 1][text] += 1
        for w in {w for w, _ in texts}:
            seen[host, w, 0][" ".join(f"{k}*{len(list(g))}" for k, g in itertools.groupby(looks[w]))] += 1

    def entropy(c):
        m = sum(c.values())
        return -sum(n / m * math.log(n / m) for n in c.values()) / math.log(m) if m > 1 else 1.0

    want = collections.defaultdict(float)
    for (host, way, _), c in seen.items():
        want[host, way] = max(want[host, way], entropy(c))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.importances(df).collect()
    np.testing.assert_allclose(sorted((r["importance"] for r in got)), sorted(want.values()), atol=1e-9)
    low = html_extract.low_branches(df).count()
    assert low == sum(x <= 0.5 for x in want.values()) > 0
    text = {r["page_id"]: r["text"] for r in html_extract.extract(df).collect()}
    for i, url, page in rows:
        keep = [t for t in re.findall(r"<(p|div class=top)>([^<]*)", page) if want[url[7:-1], ("body", "div.story", "p") if t[0] == "p" else ("body", "div.top")] > 0.5]
        assert text[i] == "\n".join([t for _, t in keep] or [t for t in re.findall(r">([^<]+)", page)])
    tables = queries.read(spark, SF, "pages")
    assert html_extract.low_branches(tables).count() > 0
    ways = {(r["page_id"], r["text"]) for r in html_extract.extract(tables).collect()}
    assert not ways & {(r["page_id"], r["text"]) for r in html_extract.extract(tables, min_importance=-1.0).collect()}
    assert ways == {(r["page_id"], r["text"]) for r in html_extract.extract(tables, broadcast_rows=0).collect()}


def test_repeated_page_keeps_its_text(spark):
    page = "<nav>menu</nav><div class=top>Hello</div><p>one text</p>"
    got = html_extract.extract(spark.createDataFrame([(k, "http://h.example/", page) for k in range(20)], "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"Hello\none text"}


def test_deep_nesting_keeps_its_text(spark):
    deep = "<body>" + "".join(f"<div>open {i}" for i in range(3000))
    got = html_extract.extract(spark.createDataFrame([(k, "http://h.example/", deep) for k in range(9)], "page_id long, url string, html string"), min_seen=10).collect()
    assert {r["text"] for r in got} == {"\n".join(f"open {i}" for i in range(3000))}


def test_articles_of_the_tables(spark):
    """Whole articles, also where a host repeats them: nothing is dropped."""
    for r in html_extract.extract(queries.read(spark, SF, "pages")).join(queries.read(spark, SF, "pages").select("page_id", "html"), "page_id").collect():
        art = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", art)]
        assert r["text"] == "\n".join(b for b in want if b)


# --- 8: lines


def test_lines_against_brute_force(spark):
    rnd = random.Random(8)
    pool = [f"line {i}" for i in range(30)]
    rows = [(i, "\n".join(rnd.choice(pool + ["", "  ", f" own {i} "]) for _ in range(rnd.randrange(1, 12))), f"s{min(rnd.randrange(12), rnd.randrange(12))}") for i in range(80)]
    rows += [(200, None, "s1"), (201, "", "s1"), (202, "line 1\nline 1", None), rows[5]]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, source string, k int, pos int")
    sites, first = collections.defaultdict(set), {}
    for i, t, s in rows:
        for p, line in enumerate(t.split("\n") if t is not None else []):
            if key := line.strip():
                sites[key] |= {s} - {None}
                first[key] = min(first.get(key, (i, p)), (i, p))
    for t_min in (3, 5, 8):
        got = collections.defaultdict(list)
        for r in line_dedup.remove_boilerplate(df, t_min).collect():
            got[r["doc_id"]].append(r)
        assert sum(map(len, got.values())) == len(rows)
        for i, t, _ in rows:
            lines = t.split("\n") if t is not None else []
            gone = [bool(x.strip()) and len(sites[x.strip()]) >= t_min and first[x.strip()] != (i, p) for p, x in enumerate(lines)]
            for r in got[i]:
                assert (r["n_lines"], r["n_removed"]) == (len(lines), sum(gone))
                assert r["text"] == (None if t is None else "\n".join(x for x, g in zip(lines, gone) if not g))
    assert line_dedup.remove_boilerplate(df.limit(0)).count() == 0
    clash = df.withColumns({c: F.lit(7) for c in ("n_lines", "n_removed", "__k", "__removed", "__lines", "line")})
    for a, b in zip(line_dedup.remove_boilerplate(clash).orderBy("doc_id").collect(), line_dedup.remove_boilerplate(df).orderBy("doc_id").collect()):
        assert all(a[c] == b[c] for c in b.asDict()) and a["__k"] == a["__removed"] == a["line"] == 7


# --- 9: top k


def test_topk_against_brute_force(spark):
    rnd = np.random.default_rng(4)
    rows = [(i, (rnd.normal(size=6) / 3).round(1).tolist(), 1) for i in range(300)]
    rows += [(400, None, 1), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (402, [float("nan")] * 6, 1), (403, [float("inf")] * 6, 1), (None, [1.0] * 6, 1), (420, [0.0] * 6, 1), (440, [0.5, 0.5], 1), rows[7], (460, [], 1)]
    rows.append((20, rows[20][1], 1))  # rows of one id are rows of their own
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")
    vec = [(i, [math.floor(64 * float(np.float32(x))) for x in e] + [0] * (6 - len(e))) for i, e, _ in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    for block in (4096, 20):
        got = sorted(tuple(r) for r in topk.top_k(df.withColumn("__query", F.lit(1)).withColumn("rid", F.lit(2)), F.col("vec_id") % 20 == 0, k=20, block=block).collect())
        want = []
        for k, (q, w) in enumerate(vec):
            if q % 20 == 0:
                best = sorted((-sum(a * b for a, b in zip(w, v)), i) for j, (i, v) in enumerate(vec) if j != k)[:20]
                want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
        assert got == sorted(want)
    big = spark.createDataFrame([(20, [1e30, 1.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(big, F.col("vec_id") == 20).collect()] == [(20, 1, 1, 64 * 64)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_stops_early():
    """One dominant row: the walk ends before the lists do."""
    x = np.zeros((1000, 2))
    x[:, 0] = np.arange(1000)
    order, seen = np.argsort(x.T, axis=1, kind="stable"), []

    class Counting(np.ndarray):
        def __matmul__(self, other):
            seen.append(len(self))
            return np.asarray(self) @ other

    best, score = topk.threshold_top(np.array([1.0, 0.0]), x.view(Counting), order, np.take_along_axis(x.T, order, 1), np.arange(1000), -1, 5)
    assert list(best) == [999, 998, 997, 996, 995] and sum(seen) < 100


def test_topk_scores_few_rows_of_clustered_vectors():
    """The bound ends the walk: with a few dimensions that matter, a small share of the rows is scored."""
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(40, 8)) * np.array([900, 600, 300, 3, 2, 2, 1, 1])
    x = np.floor(centres[rnd.integers(40, size=8000)] + rnd.normal(size=(8000, 8)) * np.array([30, 20, 10, 1, 1, 1, 1, 1]))
    order, ids, shares = np.argsort(x.T, axis=1, kind="stable"), np.arange(8000), []
    ranked = np.take_along_axis(x.T, order, 1)
    for k in range(0, 8000, 400):
        best, score, scored = topk.walk(x[k], x, order, ranked, ids, ids == k, 20)
        want = sorted((-v, i) for i, v in enumerate(x @ x[k]) if i != k)[:20]
        assert [(-s, i) for s, i in zip(score, best)] == want
        shares.append(scored / 8000)
    assert np.mean(shares) < 0.5 and min(shares) < 0.1


def best_of(x, ids, queries, k):
    for q in queries:
        scores = x @ x[q]
        yield sorted((-int(v), int(ids[i])) for i, v in enumerate(scores) if i != q)[:k]


@pytest.mark.parametrize("scale", [1, 10**3, 10**6])  # single precision, double, 64-bit integers
def test_topk_bounds_choose_the_way(monkeypatch, scale):
    """Noise is scored by products without a walk; far clusters are skipped or walked; all give what brute force gives, also with ties."""
    rnd, calls, walk = np.random.default_rng(5), [], topk.walk
    monkeypatch.setattr(topk, "walk", lambda *a: calls.append(1) or walk(*a))
    noise = np.floor(rnd.normal(size=(3000, 24)) * 8).astype(np.int64)
    noise[1000:1300] = noise[60]  # copies
    far = rnd.normal(size=(40, 8))[rnd.integers(40, size=3000)] * np.array([900, 600, 300, 3, 2, 2, 1, 1]) + rnd.normal(size=(3000, 8)) * 10
    far[:, :1] += np.where(np.arange(3000)[:, None] < 500, 3000, 0)  # the rows seen first lie ahead
    for x, bounded in ((noise, False), (np.floor(far).astype(np.int64), True)):
        x = x * (10**5 if bounded and scale == 10**6 else scale)
        ids, queries = rnd.permutation(3000) // 2, np.arange(0, 3000, 20)
        search, calls[:] = topk.Search(queries, x[queries], 20), []
        for a, b in ((0, 7), (7, 500), (500, 3000)):
            search.add(np.arange(a, b), ids[a:b], x[a:b])
        got = [sorted((-int(s), int(i)) for s, i in zip(search.score[search.at == j], search.ids[search.at == j])) for j in range(len(queries))]
        assert got == list(best_of(x, ids, queries, 20))
        assert search.skipped + search.walked + search.multiplied == 3 * len(queries) and search.walked == len(calls)
        if scale < 10**6:
            assert (search.walked > 0, search.skipped > 0) == (bounded, bounded)


@pytest.mark.parametrize("parts", [1, 3])
def test_topk_reads_a_candidate_once_for_each_block_of_queries(spark, monkeypatch, parts):
    """No vector is shuffled against the others: only queries are dealt out, and few tasks score many pairs."""
    monkeypatch.setattr(topk, "MOST", 1000 if parts > 1 else topk.MOST)
    rnd = np.random.default_rng(6)
    x = np.floor(rnd.normal(size=(9000, 16)) * 8)
    df = spark.createDataFrame([(i, (r / 64).tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    out = topk.top_k(df, F.col("vec_id") % 20 == 0, k=20, block=512)
    got = collections.defaultdict(list)
    for r in out.collect():
        got[r["query_id"]].append((r["rank"], -r["score"], r["vec_id"]))
    assert len(got) == 450
    for q, want in zip(range(0, 9000, 20), best_of(x, np.arange(9000), range(0, 9000, 20), 20)):
        assert sorted(got[q]) == [(n, s, i) for n, (s, i) in enumerate(want, 1)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" not in plan and "Union" not in plan


# --- 10: packing


def test_packing_against_tokenizer(spark):
    from tokenizers import Tokenizer

    rows = odd_rows(10, 60) + [(500, "a<|endoftext|>b"), (501, "word " * 9000), (None, "x"), (0, "again"), (502, "  \n\n x  y's 12,3 ")]
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = queries.packed(docs(spark, rows).coalesce(2)).collect()
    pieces, seqs = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
        seqs[r["sequence_id"]].append(r)
    for i, t in rows:
        ids, at = slow.encode(t or "", add_special_tokens=False).ids + [1], 0
        for r in sorted(pieces.pop((i, len(ids))), key=lambda r: r["start"]):
            part = ids[at : at + r["length"]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r["length"]
        assert at == len(ids)
    assert not pieces
    steps = collections.defaultdict(int)
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at == s[0]["tier"] and at <= 2048 and at & (at - 1) == 0  # nothing to pad
        steps[s[0]["step_group"], at] += at
    assert all(n <= 16384 for n in steps.values())
    assert queries.packed(docs(spark, [(1, "a")]).limit(0)).count() == 0
    assert packing.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)("ab " * 400_000) == np.array(slow.encode("ab " * 400_000).ids, dtype="<u4").tobytes()


def test_packing_ids(spark):
    r = packing.pack(docs(spark, [(1, "hello there")]), tokenizer=public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).collect()
    assert sum(len(x["ids"]) for x in r) == r[0]["doc_tokens"]


# --- queries and pipeline


def test_oracles(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, text in sql.ORACLES.items():
        cur = con.execute(text)
        cols = [d[0] for d in cur.description]
        want = sorted(tuple(dict(zip(cols, r))[c] for c in sorted(cols)) for r in cur.fetchall())
        df = queries.QUERIES[name](spark, SF)
        assert sorted(df.columns) == sorted(cols)
        assert sorted(tuple(r[c] for c in sorted(cols)) for r in df.collect()) == want, name


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as cp

    table = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    start = queries.read(spark, SF, "documents")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "123 --", "en", "src0", 6), (10**6 + 2, table[0]["text"], "en", "src0", len(table[0]["text"]))], start.schema)
    docs_, kept = start.unionByName(odd), {}
    for name, stage in cp.STAGES[:-1]:
        docs_ = cp.materialise(stage(spark, docs_, SF), name)
        assert docs_.columns == start.columns
        kept[name] = {r["doc_id"]: r for r in docs_.collect()}
    ids = {r["doc_id"] for r in table}
    assert set(kept["language_id"]) == {r["doc_id"] for r in table if any(c.isalpha() for c in r["text"])} | {10**6 + 2}
    assert set(kept["line_dedup"]) == set(kept["language_id"]) and all(r["n_chars"] == len(r["text"]) for r in kept["line_dedup"].values())
    comp = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(list(kept["line_dedup"].values()), start.schema), **cp.NEAR).collect()}
    assert set(kept["simhash_dedup"]) == set(comp.values()) and 10**6 + 2 not in kept["simhash_dedup"]
    items = [(r["item_id"], r["text"]) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
    clean = {i for i, r in kept["simhash_dedup"].items() if not brute_hits(r["text"], items)[2]}
    assert set(kept["decontaminate"]) == clean <= ids and len(clean) < len(kept["simhash_dedup"])
    out = cp.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} <= ids
