"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary. A word's probability
is the sum over all its segmentations into pieces (forward algorithm), a text's the
product over its words (maximal runs of letters, lower-cased, with the vocabulary's word
mark in front). Probabilities are learned by expectation-maximisation over the word counts of a bounded
labelled sample: at most ``max_docs`` documents of each language, those with the smallest hashed ids. Letters that
no piece covers have one small probability in all languages. Words are computed in batches of
equal lengths, once per worker while its cache of ``cache`` words holds them; words longer than
``LONG`` letters one by one in logarithms, with the sums of as many letters as the longest piece has in memory.
No word is cut and no piece of letters is left out. Whole texts are scored, in one pass without a shuffle.

Defined cases: null text and text without a letter are ``und`` with score 1; without training
documents every other text is ``und`` with score 0; rows without language or id are not learned
from; equal rows are scored one by one; ties go to the first language by name; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .shared import malloc_trim

UNKNOWN, MARK = 1e-9, "▁"
LONG = 28  # 1e-9 to this power is still a double above 0
SLICE = 1 << 16  # letters of a long word at once
WORD = re.compile(r"[^\W\d_]+")
UND = "und"
PRIME = 0x100000001B3


def letters(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _hash(codes):
    import numpy as np

    h = np.zeros(codes.shape[:-1], dtype=np.uint64)
    for j in range(codes.shape[-1]):
        h = h * np.uint64(PRIME) + codes[..., j]
    return h


def vocabulary(path: str) -> list[str]:
    """The pieces of a sentencepiece model that are made of letters, with or without the mark."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {sp.id_to_piece(i).lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return sorted(p for p in pieces if p and (p == MARK or p.lstrip(MARK).isalpha()) and p.count(MARK) <= 1)


class Pieces:
    """Finds pieces in words by hash."""

    def __init__(self, pieces: list[str]):
        import numpy as np

        codes = lambda p: np.array([[ord(c) for c in p]], dtype=np.uint64)
        h = np.array([int(_hash(codes(p))[0]) for p in pieces], dtype=np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        self.longest = max(map(len, pieces), default=1)

    def lattice(self, words: list[str]):
        """words of one length m (mark included) -> (word, end, length - 1): piece number; -1: none; the
        single letters without a piece are -2."""
        import numpy as np

        m, top = len(words[0]), min(self.longest, len(words[0]))
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), m).astype(np.uint64)
        out = np.full((len(words), m, top), -1, dtype=np.int32)
        h = np.zeros_like(codes)
        for n in range(1, top + 1):
            h = (h[:, :-1] if n > 1 else h) * np.uint64(PRIME) + codes[:, n - 1 :]
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            out[:, n - 1 :, n - 1] = np.where(self.hashes[at] == h, self.order[at], -1 if n > 1 else -2)
        return out


def forward(lattice, p):
    """p: (pieces + 2, languages), the last two rows are those of -2 and -1. Sums over segmentations up to each place."""
    import numpy as np

    words, m, top = lattice.shape
    alpha = np.zeros((m + 1, words, p.shape[1]))
    alpha[0] = 1
    for j in range(1, m + 1):
        for n in range(1, min(j, top) + 1):
            alpha[j] += alpha[j - n] * p[lattice[:, j - 1, n - 1]]
    return alpha


def padded(p):
    """p with rows for letters that no piece covers and for no piece."""
    import numpy as np

    return np.concatenate([p, np.full((1, p.shape[1]), UNKNOWN), np.zeros((1, p.shape[1]))])


def log_forward(finder: Pieces, word: str, logs, every: bool = False):
    """log of the forward sum of one word of any length; with ``every``, of the sums up to each place.
    logs: logarithms of padded probabilities."""
    import numpy as np

    top, langs = finder.longest, logs.shape[1]
    recent, out = [np.zeros(langs)], [np.zeros(langs)]
    for at in range(0, len(word), SLICE):
        start = max(0, at - top + 1)
        ids = finder.lattice([word[start : at + SLICE]])[0]
        for row in ids[at - start :]:
            k = min(len(recent), len(row))
            recent = [np.logaddexp.reduce([a + logs[i] for a, i in zip(recent, row[:k])]), *recent[: top - 1]]
            if every:
                out.append(recent[0])
    return np.array(out) if every else recent[0]


def _expected_long(finder: Pieces, word: str, logs, weight, expected) -> None:
    """Adds to ``expected`` what the pieces of a long word are expected to count, ``weight`` times by language."""
    import numpy as np

    alpha, lattice = log_forward(finder, word, logs, every=True), finder.lattice([word])[0]
    beta = np.full_like(alpha, -np.inf)
    beta[-1] = 0
    for j in range(len(word), 0, -1):
        for k in range(1, min(j, lattice.shape[1]) + 1):
            i = lattice[j - 1, k - 1]
            flow = logs[i] + beta[j]
            beta[j - k] = np.logaddexp(beta[j - k], flow)
            if i >= 0:
                expected[i] += weight * np.exp(alpha[j - k] + flow - alpha[-1])


def by_length(words) -> dict[int, list[str]]:
    out: dict[int, list[str]] = {}
    for w in words:
        out.setdefault(len(w), []).append(w)
    return out


def learn(counts: list[Counter], pieces: list[str], rounds: int = 3, smooth: float = 0.05):
    """Piece probabilities (pieces, languages) from word counts of each language."""
    import numpy as np

    finder, n, langs = Pieces(pieces), len(pieces), len(counts)
    lattices, long = [], []
    for words in by_length(sorted({MARK + w for c in counts for w in c})).values():
        weights = np.array([[c[w[1:]] for c in counts] for w in words], dtype=np.float64)
        if len(words[0]) > LONG:
            long += zip(words, weights)
            continue
        for at in range(0, len(words), 20000):
            lattices.append((finder.lattice(words[at : at + 20000]), weights[at : at + 20000]))
    p = np.full((n, langs), 1 / max(1, n))
    for _ in range(rounds):
        expected = np.zeros((n + 2, langs))
        full = padded(p)
        for lattice, weight in lattices:
            alpha = forward(lattice, full)
            beta = np.zeros_like(alpha)
            words, m, top = lattice.shape
            beta[m] = weight / np.maximum(alpha[m], 1e-300)
            for j in range(m, 0, -1):
                for k in range(1, min(j, top) + 1):
                    ids = lattice[:, j - 1, k - 1]
                    flow = full[ids] * beta[j]
                    beta[j - k] += flow
                    got = alpha[j - k] * flow
                    use = ids >= 0
                    for g in range(langs):
                        expected[:, g] += np.bincount(ids[use], weights=got[use, g], minlength=n + 2)
        with np.errstate(divide="ignore"):
            logs = np.log(full)
        for word, weight in long:
            _expected_long(finder, word, logs, weight, expected)
        p = expected[:n] + smooth
        p /= p.sum(axis=0)
    return p


class Scorer:
    """Log-probabilities of words in each language, kept for up to ``cache`` words."""

    def __init__(self, pieces: list[str], p, cache: int):
        import numpy as np

        self.finder, self.p, self.cache = Pieces(pieces), padded(p), cache
        with np.errstate(divide="ignore"):
            self.log_p = np.log(self.p)
        self.known: dict[str, int] = {}
        self.letters = 0
        self.logs = np.zeros((0, p.shape[1]))

    def add(self, words: set[str]) -> None:
        import numpy as np

        missing = words.difference(self.known)
        if missing and (len(self.known) + len(missing) > self.cache or self.letters > 100 * self.cache):
            self.known, self.letters, self.logs, missing = {}, 0, self.logs[:0], words
        logs = []
        for same in by_length(sorted(missing)).values():
            if len(same[0]) >= LONG:
                logs += [log_forward(self.finder, MARK + w, self.log_p)[None] for w in same]
            else:
                for at in range(0, len(same), 8192):
                    logs.append(np.log(forward(self.finder.lattice([MARK + w for w in same[at : at + 8192]]), self.p)[-1]))
            self.known.update(zip(same, range(len(self.known), len(self.known) + len(same))))
            self.letters += len(same) * len(same[0])
        if logs:
            self.logs = np.concatenate([self.logs, *logs])

    def texts(self, many: list[list[str]]):
        """Summed log-probabilities of each text's words, all languages; the words that are not known are
        computed together."""
        import numpy as np

        total = np.zeros((len(many), self.p.shape[1]))
        at = 0
        while at < len(many):
            words, end, n = set(many[at]), at + 1, len(many[at])
            while end < len(many) and n + len(many[end]) <= 400_000:
                words.update(many[end])
                n, end = n + len(many[end]), end + 1
            if n <= 400_000:
                self.add(words)
                rows = np.fromiter((i for t in many[at:end] for i in map(self.known.__getitem__, t)), dtype=np.int64, count=n)
                sizes = np.array([len(t) for t in many[at:end]])
                some = np.flatnonzero(sizes)
                if len(some):
                    total[at + some] = np.add.reduceat(self.logs[rows], (np.cumsum(sizes) - sizes)[some])
            else:  # one very long text, in parts
                for i in range(0, n, 400_000):
                    part = many[at][i : i + 400_000]
                    self.add(set(part))
                    total[at] += self.logs[np.fromiter(map(self.known.__getitem__, part), dtype=np.int64, count=len(part))].sum(axis=0)
            at = end
        return total


def train(docs: DataFrame, vocab: str, learn_from: Column, max_docs: int = 1000, **params):
    """(languages, pieces, probabilities) from rows that ``learn_from`` holds for (over doc_id)."""
    spark, pieces = docs.sparkSession, vocabulary(vocab)
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & learn_from)
    picked = rows.select("doc_id", "lang", F.pmod(F.xxhash64(F.lit("salt"), "doc_id"), F.lit(256)).alias("salt"))
    for by in (("lang", "salt"), ("lang",)):  # a language with most of the rows is cut down in many tasks first
        first = F.row_number().over(Window.partitionBy(*by).orderBy(F.xxhash64("doc_id"), "doc_id"))
        picked = picked.withColumn("k", first).where(F.col("k") <= max_docs)
    picked = picked.select("doc_id").distinct().collect()
    if not picked:
        return [], pieces, None
    sample = spark.createDataFrame(sorted(tuple(x) for x in picked), "doc_id long")  # bounded: max_docs a language
    counts: dict[str, Counter] = {}
    for r in rows.select("doc_id", "lang", "text").join(F.broadcast(sample), "doc_id").toLocalIterator():
        counts.setdefault(r["lang"], Counter()).update(w for w in letters(r["text"]))
    langs = sorted(counts)
    return langs, pieces, learn([counts[x] for x in langs], pieces, **params)


def predict(docs: DataFrame, langs: list[str], pieces: list[str], p, text_col: str = "text", cache: int = 200_000) -> DataFrame:
    """``docs`` with lang_pred and score (the language's posterior under equal priors) for every row."""
    names = docs.columns
    at_text = names.index(text_col)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        trim = malloc_trim()
        scorer = Scorer(pieces, p, cache) if langs else None

        def words_of(text):
            words = letters(text or "")
            if any(not w.isalpha() for w in words if not w.isascii()):  # the pattern's runs may hold number signs
                words = [x for x in ("".join(c for c in w if c.isalpha()) for w in words) if x]
            return words

        def best(texts):
            many = [words_of(t) for t in texts]
            if not langs:
                return [(UND, 0.0 if w else 1.0) for w in many]
            z = scorer.texts(many)
            k = z.argmax(axis=1)
            p = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
            return [(langs[i], float(q)) if w else (UND, 1.0) for w, i, q in zip(many, k, p)]

        for batch in batches:
            texts, at, got = batch.column(at_text).to_pylist(), 0, []
            while at < len(texts):
                end, n = at, 0
                while end < len(texts) and (end == at or n < 1 << 21):
                    n, end = n + len(texts[end] or ""), end + 1
                got += best(texts[at:end])
                at = end
            trim(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([g[0] for g in got], type=pa.string()), pa.array([g[1] for g in got], type=pa.float64())], names=[*names, "lang_pred", "score"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))


def held_out(folds: int, rest: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == rest, F.lit(False))


def identify(docs: DataFrame, vocab: str, folds: int = 4, rest: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row, learned from the rows not held out."""
    model = train(docs, vocab, ~held_out(folds, rest))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return predict(rows, *model).select("doc_id", held_out(folds, rest).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, vocab: str, min_score: float = 0.5) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, lang, ...) with a letter in which one language has a posterior of at least
    ``min_score``; where no row says its language, all rows with a letter."""
    renamed = docs.select(*[F.col(c).alias(f"__{i}" if c in ("lang_pred", "score") else c) for i, c in enumerate(docs.columns)])
    langs, pieces, p = train(docs, vocab, F.lit(True))
    kept = predict(renamed, langs, pieces, p).where((F.col("lang_pred") != UND) & (F.col("score") >= min_score) if langs else F.col("score") < 1)
    return kept.select(*[F.col(r).alias(c) for r, c in zip(renamed.columns, docs.columns)])
