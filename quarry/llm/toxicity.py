"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the rates of its character n-grams (lower-cased, a space at both ends, so n-grams that begin words are
features of their own; hashed to ``2**bits`` places): v = log(1 + 1000 * count / characters). On the labelled
sample, r = log((p+1)/(|p|+2)) - log((q+1)/(|q|+2)), p and q the sums of v in toxic and other texts, |p| and |q| those
texts' numbers. A text is the vector of v * r, divided by its length; logistic regression with an L2 penalty weighs
it, until the loss stands still. The penalty is the one of ``penalties`` with the least loss on every fifth text of the
sample, fitted on the others. Features of one sample text only have no weight: they say nothing of other texts.

The sample is bounded: of at most ``max_toxic`` toxic and ``max_other`` other labelled rows, those with the smallest hashed
ids, as many as have ``max_chars`` characters together (toxic ones up to half of that first). One task fits it; the driver
gets the model alone. Every row is scored on its whole text, in one pass without a shuffle; the model sent to the workers
has two numbers per feature.

Defined cases: null and empty texts score the intercept; a document with several labels is
toxic if one says so; null labels, texts and ids are not learned from; without labels of
both kinds the score is the toxic share (0 if there are none); an empty table gives no
rows; equal rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

ORDERS = (3, 4, 5)
PENALTIES = (1e-4, 1e-5, 1e-6)
STEP = 256


def grams(texts: list[str], bits: int, orders: tuple[int, ...] = ORDERS):
    """For each order: (text numbers, feature numbers), repeats included."""
    import numpy as np

    padded = [f" {t.lower()} " for t in texts]
    c = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    doc = np.repeat(np.arange(len(padded)), [len(p) for p in padded])
    h = c.copy()
    for n in range(2, max(orders) + 1):
        if len(c) < n:
            break
        h = h[:-1] * np.uint64(0x100000001B3) + c[n - 1 :]
        if n in orders:
            inside = doc[: len(h)] == doc[n - 1 :]
            x = h[inside] * np.uint64(0x9E3779B97F4A7C15)
            yield doc[: len(h)][inside], ((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


def rates(texts: list[str], bits: int):
    """For each order: (text numbers, feature numbers, log(1 + 1000 * count / characters)), once per feature of a text."""
    import numpy as np

    chars = np.array([len(t) + 2 for t in texts], dtype=np.float64)
    for doc, f in grams(texts, bits):
        once, n = np.unique((doc << bits) | f, return_counts=True)
        doc = once >> bits
        yield doc, once & ((1 << bits) - 1), np.log1p(1000 * n / chars[doc])


@dataclass(frozen=True)
class Model:
    bits: int
    features: object  # sorted feature numbers
    ratios: object
    weights: object
    intercept: float

    def scorer(self):
        import numpy as np

        ratio, weight = np.zeros(1 << self.bits, dtype=np.float32), np.zeros(1 << self.bits, dtype=np.float32)
        ratio[self.features], weight[self.features] = self.ratios, self.weights

        def scores(texts: list[str]):
            z, norm = np.zeros(len(texts)), np.zeros(len(texts))
            for doc, f, v in rates(texts, self.bits):
                x = v * ratio[f]
                z += np.bincount(doc, weights=x * weight[f], minlength=len(texts))
                norm += np.bincount(doc, weights=x * x, minlength=len(texts))
            return 1 / (1 + np.exp(-np.clip(z / np.sqrt(np.maximum(norm, 1e-30)) + self.intercept, -500, 500)))

        return scores


def minimum(f, w, most: int = 200, memory: int = 8, tolerance: float = 1e-6):
    """Where f (value and gradient) is smallest, by L-BFGS, from ``w`` on."""
    import numpy as np

    steps: list[tuple] = []
    value, g = f(w)
    for _ in range(most):
        q, factors = g.copy(), []
        for s, y in reversed(steps):
            factors.append(s @ q / (y @ s))
            q -= factors[-1] * y
        if steps:
            s, y = steps[-1]
            q *= s @ y / (y @ y)
        for (s, y), a in zip(steps, reversed(factors)):
            q += s * (a - y @ q / (y @ s))
        length = 1.0
        while True:
            at = w - length * q
            new, ng = f(at)
            if new <= value - 1e-4 * length * (g @ q) or length < 1e-8:
                break
            length /= 2
        s, y = at - w, ng - g
        if y @ s > 1e-14:
            steps = [*steps[1 - memory :], (s, y)]
        still = abs(value - new) <= tolerance * max(1e-3, abs(new))
        w, value, g = at, new, ng
        if still:
            break
    return w


def fit(texts: list[str], toxic: list[int], bits: int = 22, min_df: int = 2, penalties: tuple[float, ...] = PENALTIES) -> Model:
    import numpy as np

    y = np.array(toxic, dtype=np.float64)
    none = np.empty(0, dtype=np.int64)
    if not 0 < y.sum() < len(y):
        return Model(bits, none, none.astype(np.float32), none.astype(np.float32), 500.0 if len(y) and y.all() else -500.0)
    df, sums, parts = np.zeros(1 << bits, dtype=np.int32), np.zeros((2, 1 << bits), dtype=np.float32), []
    for at in range(0, len(texts), STEP):
        mark = y[at : at + STEP].astype(np.int64)
        for doc, f, v in rates(texts[at : at + STEP], bits):
            df += np.bincount(f, minlength=1 << bits).astype(np.int32)
            for kind in (0, 1):
                of = mark[doc] == kind
                sums[kind] += np.bincount(f[of], weights=v[of], minlength=1 << bits).astype(np.float32)
            parts.append((at, doc.astype(np.int32), f.astype(np.int32), v.astype(np.float32)))
    ratio = (np.log((sums[1] + 1.0) / (y.sum() + 2)) - np.log((sums[0] + 1.0) / (len(y) - y.sum() + 2))).astype(np.float32)
    features = np.flatnonzero((df >= min_df) & (ratio != 0))
    place = np.full(1 << bits, -1, dtype=np.int32)
    place[features] = np.arange(len(features))
    norm, kept = np.zeros(len(y)), []
    while parts:
        at, doc, f, v = parts.pop()
        ok = place[f] >= 0
        x = v[ok] * ratio[f[ok]]
        norm[at : at + STEP] += np.bincount(doc[ok], weights=x.astype(np.float64) ** 2, minlength=STEP)[: len(y) - at]
        doc, starts = np.unique(doc[ok], return_index=True)  # rows are in the order of texts
        kept.append((at + doc, starts, np.diff(np.append(starts, len(x))), place[f[ok]], x))
    del df, sums, place
    norm = np.sqrt(np.maximum(norm, 1e-30)).astype(np.float32)
    for doc, _, sizes, _, x in kept:
        x /= np.repeat(norm[doc], sizes)

    def margins(w):
        z = np.full(len(y), w[-1])
        single = w.astype(np.float32)
        for doc, starts, _, c, x in kept:
            if len(doc):
                z[doc] += np.add.reduceat(x * single[c], starts)
        return z

    def loss(z):
        return np.logaddexp(0, z) - y * z

    def fitted(w, used, penalty, tolerance):
        def f(w):
            z = margins(w)
            e = np.where(used, 1 / (1 + np.exp(-np.clip(z, -50, 50))) - y, 0) / used.sum()
            g = penalty * w
            g[-1] = e.sum()
            for doc, _, sizes, c, x in kept:
                g[:-1] += np.bincount(c, weights=x * np.repeat(e[doc].astype(np.float32), sizes), minlength=len(w) - 1)
            return loss(z)[used].mean() + penalty / 2 * (w[:-1] @ w[:-1]), g

        return minimum(f, w, tolerance=tolerance)

    start = np.append(np.zeros(len(features)), np.log(y.mean() / (1 - y.mean())))
    best = penalties[0]
    inner = np.arange(len(y)) % 5 == 0
    if len(penalties) > 1 and inner.any() and 0 < y[~inner].sum() < (~inner).sum():
        w, least = start, np.inf
        for p in penalties:
            w = fitted(w, ~inner, p, 1e-3)
            if (out := loss(margins(w))[inner].mean()) < least:
                least, best, start = out, p, w
    w = fitted(start, np.ones(len(y), dtype=bool), best, 1e-4)
    return Model(bits, features, ratio[features], w[:-1].astype(np.float32), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_toxic: int = 2500, max_other: int = 5000, max_chars: int = 8_000_000, **params) -> Model:
    """docs: doc_id, text; labels: doc_id, toxic. Only rows that ``learn`` holds for (over doc_id)."""
    spark = docs.sparkSession
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda c, n: marks.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    picked = [tuple(x) for x in first("toxic = 1", max_toxic).union(first("toxic <> 1", max_other)).collect()]
    order = {doc: k for k, (doc, _) in enumerate(picked)}
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text")

    def of(rows):
        return texts.join(F.broadcast(spark.createDataFrame(sorted(rows), "doc_id long, toxic int")), "doc_id")  # bounded

    sample, chars = set(), 0
    sizes = of(picked).groupBy("doc_id", "toxic").agg(F.sum(F.length("text"))).collect() if picked else []
    for bad, most in ((True, max_chars // 2), (False, max_chars)):
        for doc, toxic, n in sorted(sizes, key=lambda r: order[r[0]]):
            if (toxic == 1) == bad and chars + n <= most:
                sample.add((doc, toxic))
                chars += n
    if not sample:
        return fit([], [])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        rows = sorted((doc, text, toxic) for b in batches for doc, text, toxic in zip(*(b.column(i).to_pylist() for i in range(3))))
        m = fit([r[1] for r in rows], [int(r[2] == 1) for r in rows], **params)
        for at in range(0, max(1, len(m.features)), 1 << 16):
            part = slice(at, at + (1 << 16))
            cols = [np.asarray(m.features[part], dtype=np.int32), np.asarray(m.ratios[part], dtype=np.float32), np.asarray(m.weights[part], dtype=np.float32)]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in cols] + [pa.array([m.intercept])], names=["f", "r", "w", "b"])

    import numpy as np

    got = of(sample).select("doc_id", "text", "toxic").repartition(1).mapInArrow(run, "f binary, r binary, w binary, b double").collect()
    columns = zip(*((np.frombuffer(r["f"], np.int32), np.frombuffer(r["r"], np.float32), np.frombuffer(r["w"], np.float32)) for r in got))
    return Model(params.get("bits", 22), *(np.concatenate(c) for c in columns), got[0]["b"])


def score(docs: DataFrame, model: Model, batch_chars: int = 1 << 20) -> DataFrame:
    """doc_id, score, predicted for every row."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        scores = model.scorer()
        for batch in batches:
            texts, at, out = [t or "" for t in batch.column(1).to_pylist()], 0, []
            while at < len(texts):
                end, n = at, 0
                while end < len(texts) and (end == at or n + len(texts[end]) <= batch_chars):
                    n += len(texts[end])
                    end += 1
                out.append(scores(texts[at:end]))
                at = end
            p = np.concatenate(out) if out else np.empty(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double, predicted int")


def _held_out(folds: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    model = train(docs, labels.select("doc_id", "toxic"), ~_held_out(folds))
    return score(docs, model).select("doc_id", _held_out(folds).alias("held_out"), "score", "predicted")
