"""Interpolated modified Kneser-Ney bigram model: counted in Spark, stored as sorted hash
arrays, memory-mapped by the workers that score.

Counting. A task turns its texts into pairs (left word, right word) of 64-bit word hashes,
merges equal pairs in memory and emits one packed block per shard; a shard is a range of
left-word hashes, and there are several shards for each input partition. Pairs of a hot left word (the start mark,
and words that are more than a shard's share of the words of every 32nd text or so; a matter of placement alone, results do not
depend on it) are dealt to all shards by their own hash. The task that gets a
shard merges its blocks and writes the shard's file: sorted pair hashes with counts, sorted
left-word hashes with totals. By right word, it emits the summed counts and the numbers of
distinct left words, and by hot left word the shard's part of its totals, which the second step merges into the word files in
the same way.
Files are written by rename and hold the same bytes on every attempt. The driver gets a
dozen totals. A pair is found by a 64-bit hash: among 10^8 pairs the odds of
any collision are about 1 in 4000.

Scoring. Workers map the files they need, look up words and contexts once per distinct word
of a batch, and pairs shard by shard.

Tokens: bytes are lower-cased A-Z and split at ASCII white space; each text starts after a
start mark and ends with an end token that is counted. P(w|v) = max(c(vw)-D,0)/c(v) +
gamma(v) P(w), P(w) = max(n(w)-d,0)/n + gamma/(V+1), n(w): distinct words before w;
D and d are the modified Kneser-Ney discounts for counts 1, 2 and 3 or more (0.5, 0.75 and 0.9 where
the corpus has no items of count 1, 2 or 3 to tell them from).

Defined cases: null and blank texts have the end token alone; equal rows are counted and
scored one by one; a null id counts as training; without training texts every word has
the same probability; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import struct

from pyspark.sql import Column, DataFrame, functions as F

from .shared import fresh_path, malloc_trim, map_file, materialise, write_file

START, END = b" s", b" e"  # no token holds a space
MIX = 0x9E3779B97F4A7C15
CONTEXT = ("context", "total", "n1", "n2", "n3")


def write_arrays(path: str, **arrays) -> None:
    head = json.dumps({k: [a.dtype.str, len(a)] for k, a in arrays.items()}).encode().ljust(256)
    write_file(path, head + b"".join(a.tobytes() for a in arrays.values()))


def map_arrays(path: str):
    import numpy as np

    m = map_file(path)
    if m is None:
        return None
    out, at = {}, 256
    for k, (kind, n) in json.loads(m[:256]).items():
        out[k] = np.frombuffer(m, dtype=kind, count=n, offset=at)
        at += out[k].nbytes
    return out


def word_hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word)


def pair_hash(left, right):
    """Of arrays of word hashes; the multiplications wrap."""
    import numpy as np

    x = (left * np.uint64(MIX)) ^ (right + (left >> np.uint64(29)))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def discounts(n: list[int]) -> list[float]:
    """For counts 1, 2 and 3+, from the numbers n of items with counts 1, 2, 3 and 4."""
    if min(n[:3]) <= 0:
        return [0.5, 0.75, 0.9]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.05), k - 0.05) for k in (1, 2, 3)]


class Words(dict):
    """Numbers for words, in the order of their first use."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def batches_of_ids(batches, most: int):
    """(number of batch columns, texts) -> for at most about ``most`` tokens: Words, ids with
    a start and an end mark around each text, lengths with both, the kept columns."""
    import numpy as np

    words, ids, lengths, kept, n = Words(), [], [], [], 0

    def take():  # nothing of a chunk stays referenced here while the next one is read
        nonlocal words, ids, lengths, kept, n
        out = words, np.concatenate(ids), np.array(lengths), kept
        words, ids, lengths, kept, n = Words(), [], [], [], 0
        return out

    for b in batches:
        names = [b.column(i).to_pylist() for i in range(b.num_columns - 1)]
        for row, t in enumerate(b.column(b.num_columns - 1)):
            toks = [START, *(t.as_py() or "").encode().lower().split(), END]
            ids.append(np.fromiter(map(words.__getitem__, toks), dtype=np.int32, count=len(toks)))
            lengths.append(len(toks))
            kept.append([c[row] for c in names])
            n += len(toks)
            if n >= most:
                yield take()
    if ids:
        yield take()


def each_chunk(chunks, do):
    """What ``do`` yields for each chunk; a chunk's memory goes back to the system before the next one."""
    trim = malloc_trim()
    while (chunk := next(chunks, None)) is not None:
        out = do(*chunk)
        chunk = None
        yield from out
        out = None
        trim(0)


def hashes(words: Words):
    import numpy as np

    return np.fromiter(map(word_hash, words), dtype=np.uint64, count=len(words))


def pair_shards(left, pair, hot, bits: int):
    """The shard of each pair; hot: sorted hashes of the left words that are spread."""
    import numpy as np

    return (np.where(np.isin(left, hot), pair, left) >> np.uint64(64 - bits)).astype(np.int64)


def _count_pairs(bits: int, hot, most: int = 2_000_000):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def pairs(words, ids, lengths, _):
            h = hashes(words)
            order = np.argsort(h)
            rank = np.empty(len(h), dtype=np.uint64)
            rank[order] = np.arange(len(h), dtype=np.uint64)
            h, r = h[order], rank[ids]
            inside = np.ones(len(ids), dtype=bool)
            inside[np.cumsum(lengths) - 1] = False  # no pair from one text's end to the next one's start
            key, c = np.unique(((r[:-1] << np.uint64(32)) | r[1:])[inside[:-1]], return_counts=True)
            left, right = h[key >> np.uint64(32)], h[key & np.uint64(0xFFFFFFFF)]
            shard = pair_shards(left, pair_hash(left, right), hot, bits)
            order = np.argsort(shard, kind="stable")
            left, right, c, shard = left[order], right[order], c[order], shard[order]
            cuts = np.flatnonzero(np.diff(shard)) + 1
            starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
            for lo in range(0, len(starts), 32):
                some = list(zip(starts[lo : lo + 32], ends[lo : lo + 32]))
                blocks = []
                for s, e in some:
                    first = np.flatnonzero(np.concatenate([[True], left[s + 1 : e] != left[s : e - 1]]))
                    runs = np.diff(np.concatenate([first, [e - s]]))
                    blocks.append(struct.pack("<2q", len(first), e - s) + left[s:e][first].tobytes() + runs.astype("<u4").tobytes() + right[s:e].tobytes() + c[s:e].astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[s]) for s, _ in some], type=pa.int32()), pa.array(blocks, type=pa.binary())], names=["shard", "block"])

        yield from each_chunk(batches_of_ids(batches, most), pairs)

    return run


def _by_shard(batches):
    """Rows (shard, block), sorted by shard -> (shard, its blocks)."""
    shard, blocks = None, []
    for b in batches:
        for s, x in zip(b.column(0).to_pylist(), b.column(1)):
            if s != shard and blocks:
                done, blocks = blocks, []
                yield shard, done
                done = None
            shard = s
            blocks.append(x.as_py())
    if blocks:
        yield shard, blocks


def _merged(key, *values):
    """Sorted distinct keys, the first entry's index of each, and the values' sums."""
    import numpy as np

    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first], order[first], *(np.add.reduceat(v[order], first) for v in values)


def _stats(c):
    return [int((c == k).sum()) for k in (1, 2, 3, 4)] + [len(c), int(c.sum())]


def _merge_pairs(path: str, bits: int, hot):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def merge(shard, blocks):
            lefts, rights, counts = [], [], []
            for x in blocks:
                u, n = struct.unpack_from("<2q", x)
                at = 16 + 8 * u
                lefts.append(np.repeat(np.frombuffer(x, "<u8", u, 16), np.frombuffer(x, "<u4", u, at)))
                rights.append(np.frombuffer(x, "<u8", n, at + 4 * u))
                counts.append(np.frombuffer(x, "<u4", n, at + 4 * u + 8 * n).astype(np.int64))
            left, right = np.concatenate(lefts), np.concatenate(rights)
            pairs, first, c = _merged(pair_hash(left, right), np.concatenate(counts))
            left, right = left[first], right[first]
            context, _, total, n1, n2, n3 = _merged(left, c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64))
            small = np.minimum(c, 255).astype("u1")
            spread, places = np.isin(context, hot), np.flatnonzero(small == 255)
            stats = (context, total, n1.astype("<u4"), n2.astype("<u4"), n3.astype("<u4"))
            write_arrays(f"{path}/pairs-{shard}", pairs=pairs, small=small, places=places, large=c[places], **dict(zip(CONTEXT, (x[~spread] for x in stats))))
            heads = [x[spread] for x in stats]
            head_to = (heads[0] >> np.uint64(64 - bits)).astype(np.int64)
            word, _, count, before = _merged(right, c, np.ones(len(c), dtype=np.int64))
            to = (word >> np.uint64(64 - bits)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(to)) + 1
            bounds = list(zip(np.concatenate([[0], cuts]), np.concatenate([cuts, [len(word)]])))
            out = [(int(to[s]), struct.pack("<2q", e - s, 0) + word[s:e].tobytes() + count[s:e].astype("<i8").tobytes() + before[s:e].astype("<u4").tobytes()) for s, e in bounds]
            for t in np.unique(head_to):  # for the words' shards, this shard's part of what the hot left words have
                of = head_to == t
                out.append((int(t), struct.pack("<2q", 0, of.sum()) + b"".join(x[of].tobytes() for x in heads)))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in out], type=pa.int32()), pa.array([x for _, x in out], type=pa.binary()), pa.array([None] * len(out), type=pa.list_(pa.int64()))], names=["shard", "block", "stats"])
            yield pa.RecordBatch.from_arrays([pa.array([None], type=pa.int32()), pa.array([None], type=pa.binary()), pa.array([_stats(c)], type=pa.list_(pa.int64()))], names=["shard", "block", "stats"])

        yield from each_chunk(_by_shard(batches), merge)

    return run


def _merge_words(path: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def merge(shard, blocks):
            parts, heads = [], []
            for x in blocks:
                n, k = struct.unpack_from("<2q", x)
                parts.append((np.frombuffer(x, "<u8", n, 16), np.frombuffer(x, "<i8", n, 16 + 8 * n), np.frombuffer(x, "<u4", n, 16 + 16 * n).astype(np.int64)))
                heads.append((np.frombuffer(x, "<u8", k, 16 + 20 * n), np.frombuffer(x, "<i8", k, 16 + 20 * n + 8 * k), *(np.frombuffer(x, "<u4", k, 16 + 20 * n + (16 + 4 * j) * k).astype(np.int64) for j in range(3))))
            word, count, before = (np.concatenate(p) for p in zip(*parts))
            word, _, count, before = _merged(word, count, before) if len(word) else (word, None, count, before)
            stats = [np.concatenate(h) for h in zip(*heads)]
            if len(stats[0]):
                context, _, *sums = _merged(*stats)
                stats = [context, *sums]
            write_arrays(f"{path}/words-{shard}", word=word, count=count, before=before, **dict(zip(CONTEXT, stats)))
            yield pa.RecordBatch.from_arrays([pa.array([_stats(before) + [int(count.sum())]], type=pa.list_(pa.int64()))], names=["stats"])

        yield from each_chunk(_by_shard(batches), merge)

    return run


def _sums(df: DataFrame, n: int) -> list[int]:
    row = df.agg(*[F.sum(F.col("stats")[i]).alias(f"s{i}") for i in range(n)]).first()
    return [int(x or 0) for x in row]


class NgramModel:
    """Totals and the files' place. Shards are the top ``bits`` bits of a word's hash, or of a pair's if its left word is ``hot``."""

    def __init__(self, path: str, bits: int, hot, pairs: list[int], words: list[int]):
        self.path, self.bits, self.hot = path, bits, hot
        self.pair_discounts, self.word_discounts = discounts(pairs[:4]), discounts(words[:4])
        self.types, self.bigrams, self.tokens = words[4], words[5], words[6]
        n1, n2, n3 = words[0], words[1], words[4] - words[0] - words[1]
        self.word_gamma = sum(d * n for d, n in zip(self.word_discounts, (n1, n2, n3))) / self.bigrams if self.bigrams else 1.0


def hot_words(texts: DataFrame, shards: int, every: int = 32):
    """Sorted hashes of the start mark and of words that, in the texts of every 32nd hash, are more than one in ``shards``
    tokens: at most ``shards`` of them, from counts of a sample as a range partitioner's bounds are."""
    import numpy as np

    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(every)) == 0)
    counts = some.select(F.explode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    words = [r["w"] for r in counts.where((F.col("n") * shards > total) & (F.col("w") != "")).select("w").collect()]
    return np.array(sorted({word_hash(START), *(word_hash(w.encode("utf-8", "surrogatepass")) for w in words)}), dtype=np.uint64)


def train(docs: DataFrame, text_col: str = "text", shards_per_partition: int = 4) -> NgramModel:
    """Counts every text of ``docs`` and writes the model to the shared folder."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))
    bits = max(4, (shards_per_partition * texts.rdd.getNumPartitions() - 1).bit_length())
    path, hot = fresh_path(spark, "ngrams"), hot_words(texts, 1 << bits)
    rows = "shard int, block binary"
    pairs = texts.mapInArrow(_count_pairs(bits, hot), rows).repartition("shard").sortWithinPartitions("shard")
    merged = materialise(pairs.mapInArrow(_merge_pairs(path, bits, hot), rows + ", stats array<bigint>"), "ngram-words")
    words = merged.where("shard is not null").select("shard", "block").repartition("shard").sortWithinPartitions("shard")
    done = materialise(words.mapInArrow(_merge_words(path), "stats array<bigint>"), "ngram-totals")
    return NgramModel(path, bits, hot, _sums(merged.where("stats is not null"), 6), _sums(done, 7))


class Lookup:
    """The model's arrays, mapped when first needed."""

    def __init__(self, path: str, bits: int):
        self.path, self.bits, self.maps = path, bits, {}

    def shards(self, kind: str, keys, shard=None):
        """(indices into keys, the shard's arrays) for each shard that the keys need; ``shard``: by default, by the keys."""
        import numpy as np

        shard = (keys >> np.uint64(64 - self.bits)).astype(np.int64) if shard is None else shard
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for part in np.split(order, cuts) if len(order) else ():
            name = f"{kind}-{shard[part[0]]}"
            if name not in self.maps:
                self.maps[name] = map_arrays(f"{self.path}/{name}")
            if self.maps[name] is not None:
                yield part, self.maps[name]

    @staticmethod
    def find(keys, among):
        """Indices in ``among``, and which of the keys are there."""
        import numpy as np

        if not len(among):
            return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
        at = np.minimum(np.searchsorted(among, keys), len(among) - 1)
        return at, among[at] == keys


def score(docs: DataFrame, model: NgramModel, *id_cols: str, text_col: str = "text", most: int = 300_000) -> DataFrame:
    """The id columns, n_tokens, n_known, base_score and score (log10 of the text's probability)
    of every row."""
    m = model
    fields = [f for f in docs.schema.fields if f.name in id_cols]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    path, bits, hot = m.path, m.bits, m.hot
    big_d, small_d, gamma0, types, total_pairs, tokens = m.pair_discounts, m.word_discounts, m.word_gamma, m.types, m.bigrams, m.tokens

    def run(batches):
        import numpy as np
        import pyarrow as pa

        look = Lookup(path, bits)

        def less(c, d):
            return np.maximum(c - np.select([c == 1, c == 2, c > 2], d, 0.0), 0.0)

        def scores(words, ids, lengths, kept):
            h = hashes(words)
            count, before = np.zeros(len(h), dtype=np.int64), np.zeros(len(h), dtype=np.int64)
            total, back = np.zeros(len(h)), np.ones(len(h))
            for part, a in look.shards("words", h):
                at, hit = look.find(h[part], a["word"])
                count[part[hit]], before[part[hit]] = a["count"][at[hit]], a["before"][at[hit]]
            for part, a in (x for kind in ("pairs", "words") for x in look.shards(kind, h)):
                at, hit = look.find(h[part], a["context"])
                at, part = at[hit], part[hit]
                total[part] = a["total"][at]
                back[part] = (big_d[0] * a["n1"][at] + big_d[1] * a["n2"][at] + big_d[2] * a["n3"][at]) / a["total"][at]
            word_p = less(before, small_d) / max(total_pairs, 1) + gamma0 / (types + 1)
            inside = np.ones(len(ids), dtype=bool)
            starts = np.cumsum(lengths) - lengths
            inside[starts] = False
            right, left = ids[inside], ids[np.flatnonzero(inside) - 1]
            pair, c = pair_hash(h[left], h[right]), np.zeros(len(left), dtype=np.int64)
            for part, a in look.shards("pairs", pair, pair_shards(h[left], pair, hot, bits)):
                at, hit = look.find(pair[part], a["pairs"])
                at, part = at[hit], part[hit]
                found = a["small"][at].astype(np.int64)
                if (over := np.flatnonzero(found == 255)).size:
                    found[over] = a["large"][np.searchsorted(a["places"], at[over])]
                c[part] = found
            p = less(c, big_d) / np.maximum(total[left], 1) + back[left] * word_p[right]
            n = lengths - 1
            at = np.cumsum(n) - n
            base = np.log10((count[right] + 0.1) / (tokens + 0.1 * (types + 1)))
            columns = [pa.array([k[i] for k in kept]) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n), pa.array(np.add.reduceat((count[right] > 0).astype(np.int64), at)), pa.array(np.add.reduceat(base, at)), pa.array(np.add.reduceat(np.log10(p), at))],
                names=[*(f.name for f in fields), "n_tokens", "n_known", "base_score", "score"],
            )

        yield from each_chunk(batches_of_ids(batches, most), scores)

    picked = docs.select(*[F.col(f.name) for f in fields], F.col(text_col).alias("__text"))
    return picked.mapInArrow(run, f"{schema}, n_tokens long, n_known long, base_score double, score double")


def held_out(id_col: str, folds: int, rest: int = 0) -> Column:
    """Whether the CRC-32 of the id as text leaves ``rest``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == rest, F.lit(False))


def score_held_out(docs: DataFrame, folds: int = 10) -> DataFrame:
    """Trains on the rows that are not held out and scores all rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(rows.where(~held_out("doc_id", folds)))
    return score(rows, model, "doc_id").select(
        "doc_id", held_out("doc_id", folds).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"),
    )
