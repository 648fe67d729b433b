"""Exact top-k by integer inner product with Fagin's threshold algorithm.

Queries are dealt into blocks of about ``block``, one task each, which reads the candidates from the shared folder in blocks of its own
and sorts each once per dimension. A query carries its best k from block to block. No row of a block unseen at some depth of its lists can
score more than the sum of the values at that depth, so per query and block (``Search``):
- its kth result exceeds the sum at the lists' heads: the block is skipped;
- it exceeds the sum at a depth where the lists that matter have brought about a quarter of the rows into sight: they are walked (``walk``), from the end where the query's weight makes values
  largest, those first that lower the bound most; rows are scored at their first sight, until the kth result exceeds the bound;
- otherwise (many dimensions that all matter alike) nearly all rows would come into sight: all such queries' rows are scored by one
  product, and those that reach the kth result are kept.
A walk that meets more than a quarter of the rows in a round is ended by a product, too. All three give the same rows.

A task that has few queries shares the candidates' files with others (``parts``); the best k of each are ranked at the end, ties to the
smaller id. Vectors are never shuffled against each other: a candidate is read once for each block of queries.

Components are floor(scale * x) of the component as double, and sums are exact: in single precision
below 2^24, in double below 2^53, else in 64-bit integers (then without bounds).

Defined cases: vectors that are null or hold null or non-finite components, and rows without an
id, take no part; rows of one id are rows of their own, as candidates and as queries, and a query never finds its own row;
components beyond 64-bit integers count as the nearest of those; vectors of
fewer dimensions count as padded with zeros; fewer
candidates than k give fewer rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from .shared import fresh_path, open_fs

FIRST, MOST, ELEMENTS = 4096, 65536, 1 << 22  # rows of the first and the largest block of candidates; components
TILE = (256, 4096)  # queries and rows of one product
HELD = 1 << 20  # results held before they are ranked
LEAST = 256  # queries worth a task of their own


def quantised(col: str, scale: float) -> Column:
    return F.transform(col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def threshold_top(q, x, order, ranked, ids, own, k: int):
    """walk() without the count; ``own`` is an id or a mask of rows."""
    return walk(q, x, order, ranked, ids, ids == own if isinstance(own, int) else own, k)[:2]


def walk(q, x, order, ranked, ids, own, k: int, least: float = -float("inf")):
    """Indices into ``x`` of the k largest x @ q without the rows of the mask ``own``, ties to the smaller of ``ids``, those
    products, and how many rows were scored; order: per dimension, the rows by ascending value, ranked: those values.
    Rows that score less than ``least`` may be missing."""
    import numpy as np

    n, scored = len(x), 0
    dims = np.flatnonzero(q)
    rising, weight = q[dims] > 0, q[dims]
    seen = own.copy()
    best, score = np.empty(0, dtype=np.int64), np.empty(0, dtype=x.dtype)
    depth, step = np.zeros(len(dims), dtype=np.int64), max(1, n // (20 * max(1, len(dims))))

    def products(at):
        """What each dimension adds to a score at these depths of the lists."""
        return weight * ranked[dims, np.where(rising, n - 1 - at, at)]

    def top(best, score):
        if len(best) > k:
            kth = np.partition(score, len(score) - k)[len(score) - k]
            best, score = best[score >= kth], score[score >= kth]
        keep = np.lexsort((ids[best], -score))[:k]
        return best[keep], score[keep]

    while len(dims) and depth.max() < n:
        here = products(depth)
        gain = here - products(np.minimum(depth + step, n - 1))
        fresh = np.zeros(n, dtype=bool)
        for d in np.flatnonzero(2 * gain >= gain.max()):  # the lists that lower the bound most
            upto = min(n, depth[d] + step)
            fresh[order[dims[d], n - upto : n - depth[d]] if rising[d] else order[dims[d], depth[d] : upto]] = True
            depth[d] = upto
        bound = products(np.minimum(depth, n - 1)).sum()
        fresh &= ~seen
        new = np.flatnonzero(fresh)
        seen |= fresh
        if 4 * len(new) > n:
            every, rest = x @ q, np.flatnonzero(~own)
            return *top(rest, every[rest]), n
        scored += len(new)
        best, score = top(np.concatenate([best, new]), np.concatenate([score, x[new] @ q]))
        if least > bound or len(best) == k and score.min() > bound:
            return best, score, scored
        step = 1 + step * 5 // 4
    rest = np.flatnonzero(~seen)  # only for a query of zeros: every score is 0
    best, score = top(np.concatenate([best, rest]), np.concatenate([score, x[rest] @ q]))
    return best, score, max(scored, len(rest))


def matrix(vectors):
    """Rows of 64-bit integers, padded with zeros, of an Arrow list array."""
    import numpy as np

    flat, size = np.asarray(vectors.flatten()), np.asarray(vectors.value_lengths()).astype(np.int64)
    m = np.zeros((len(size), int(size.max(initial=0))), dtype=np.int64)
    if len(flat) == m.size:
        return flat.reshape(m.shape)
    row = np.repeat(np.arange(len(size)), size)
    m[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return m


class Search:
    """The best k of a block of queries over blocks of candidates; ``skipped``, ``walked`` and ``multiplied`` count pairs of a
    query and a block."""

    def __init__(self, rids, queries, k: int):
        import numpy as np

        self.rids, self.queries, self.k = rids, queries, k
        self.at, self.score, self.ids = (np.zeros(0, dtype=np.int64) for _ in range(3))  # results: query, score, id
        self.kth = np.full(len(rids), np.iinfo(np.int64).min)  # the kth score of each query that has k
        self.last = np.full(len(rids), np.iinfo(np.int64).max)  # and its id
        self.skipped = self.walked = self.multiplied = 0

    def add(self, rids, ids, x) -> None:
        """Takes a block of candidates in."""
        import numpy as np

        if not len(x) or not len(self.queries):
            return
        q = self.queries
        dims = max(q.shape[1], x.shape[1])
        q, x = (np.pad(m, ((0, 0), (0, dims - m.shape[1]))) if m.shape[1] < dims else m for m in (q, x))
        most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(x.astype(np.float64)).max(initial=0)) * dims
        if most >= 2**53:
            return self._multiply(np.arange(len(q)), q, rids, ids, x)
        q, x = (m.astype(np.float32 if most < 2**24 else np.float64) for m in (q, x))
        n = len(x)
        narrow = np.int16 if np.abs(x).max(initial=0) < 2**15 else x.dtype  # 16 bits are sorted by radix
        lists = np.ascontiguousarray(x.T).astype(narrow)
        ranked = np.sort(lists, axis=1)
        up, down = np.maximum(q, 0).astype(np.float64), np.minimum(q, 0).astype(np.float64)

        def bound(depth):
            return up @ ranked[:, n - 1 - depth].astype(np.float64) + down @ ranked[:, depth].astype(np.float64)

        left = self.kth <= bound(0)
        self.skipped += int((~left).sum())
        weight = np.abs(q) * ranked.std(axis=1, dtype=np.float64)
        matter = weight.sum(axis=1) ** 2 / np.maximum((weight**2).sum(axis=1), 1e-300)  # as if so many lists mattered alike
        halvings = np.ceil(np.log2(4 * np.maximum(matter, 1))).astype(np.int64)
        soon = np.zeros(len(q), dtype=bool)
        for h in np.unique(halvings[left]):
            soon |= left & (halvings == h) & (self.kth > bound(n >> h))
        if soon.any():
            order, ranked, found = np.argsort(lists, axis=1, kind="stable"), ranked.astype(x.dtype), []
            for i in np.flatnonzero(soon):
                best, score, _ = walk(q[i], x, order, ranked, ids, rids == self.rids[i], self.k, float(self.kth[i]))
                found.append((np.full(len(best), i), score.astype(np.int64), ids[best]))
            self.walked += len(found)
            self._merge(*(np.concatenate(c) for c in zip(*found)))
        self._multiply(np.flatnonzero(left & ~soon), q, rids, ids, x)

    def _multiply(self, which, q, rids, ids, x) -> None:
        import numpy as np

        self.multiplied += len(which)
        room, marks = np.empty(TILE[0] * TILE[1], dtype=x.dtype), np.empty(TILE[0] * TILE[1], dtype=bool)
        found, held = [], 0
        for s in range(0, len(which), TILE[0]):
            rows = which[s : s + TILE[0]]
            some, own, least, last = q[rows], self.rids[rows], self.kth[rows], self.last[rows]
            for c in range(0, len(x), TILE[1]):
                part = x[c : c + TILE[1]]
                m = len(part)
                scores, reach = (a[: len(rows) * m].reshape(-1, m) for a in (room, marks))
                np.matmul(some, part.T, out=scores)
                if m > self.k and (least == np.iinfo(np.int64).min).any():  # one more than k: the query's own row may be among them
                    least = np.maximum(least, np.partition(scores, m - self.k - 1, axis=1)[:, m - self.k - 1].astype(np.int64))
                np.greater_equal(scores, least.astype(scores.dtype)[:, None], out=reach)
                hit = np.flatnonzero(reach)
                if len(hit):
                    i, j = hit // m, hit % m
                    score = scores.ravel()[hit].astype(np.int64)
                    better = (rids[c + j] != own[i]) & ((score > self.kth[rows[i]]) | (ids[c + j] < last[i]))
                    i, j = i[better], j[better]
                    found.append((rows[i], score[better], ids[c + j]))
                    held += len(i)
                if held > HELD:
                    self._merge(*(np.concatenate(a) for a in zip(*found)))
                    least, last, found, held = np.maximum(least, self.kth[rows]), self.last[rows], [], 0
        if found:
            self._merge(*(np.concatenate(a) for a in zip(*found)))

    def _merge(self, at, score, ids) -> None:
        """Adds results and keeps the best k of each query that has new ones."""
        import numpy as np

        if not len(at):
            return
        new = np.zeros(len(self.kth), dtype=bool)
        new[at] = True
        old = new[self.at]
        at, score, ids = (np.concatenate(c) for c in ((self.at[old], at), (self.score[old], score), (self.ids[old], ids)))
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        last = place == self.k - 1
        self.kth[at[last]], self.last[at[last]] = score[last], ids[last]
        keep = place < self.k
        self.at, self.score, self.ids = (np.concatenate(c) for c in ((self.at[~old], at[keep]), (self.score[~old], score[keep]), (self.ids[~old], ids[keep])))


def _blocks(path: str, part: int, parts: int):
    """(rid, id, matrix) of the candidates in every ``parts``-th row group of the table, in blocks that grow."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq
    from pyarrow import fs as pafs

    fs, p = open_fs(path)
    names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(p)) if f.path.endswith(".parquet"))
    held, rows, target, unit = [], 0, FIRST, 0

    def block():
        t = pa.Table.from_batches(held).combine_chunks()
        return np.asarray(t["rid"]), np.asarray(t["vec_id"]), matrix(t["v"].combine_chunks())

    for name in names:
        with fs.open_input_file(name) as f:
            file = pq.ParquetFile(f)
            groups = [g for g in range(file.num_row_groups) if (unit + g) % parts == part]
            unit += file.num_row_groups
            for b in file.iter_batches(batch_size=FIRST, row_groups=groups, columns=["rid", "vec_id", "v"]) if groups else ():
                if not b.num_rows:
                    continue
                held, rows = [*held, b], rows + b.num_rows
                if rows >= target or rows * len(b.column("v").flatten()) // b.num_rows >= ELEMENTS:
                    yield block()
                    held, rows, target = [], 0, min(4 * target, MOST)
    if rows:
        yield block()


def _search(path: str, k: int, block: int, parts: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        def found(held, part):
            t = pa.Table.from_batches(held)
            rids, names = np.asarray(t["rid"]), np.asarray(t["vec_id"])
            search = Search(rids, matrix(t["v"].combine_chunks()), k)
            for b in _blocks(path, part, parts):
                search.add(*b)
            at = search.at
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (rids[at], names[at], search.ids, search.score)], names=["rid", "query_id", "vec_id", "score"])

        held: dict = {}
        for b in batches:
            for part in np.unique(np.asarray(b.column("part"))):
                mine = b.filter(pa.array(np.asarray(b.column("part")) == part))
                for s in range(0, mine.num_rows, block):
                    if part in held and sum(x.num_rows for x in held[part]) >= block:
                        yield found(held.pop(part), int(part))
                    held.setdefault(part, []).append(mine.slice(s, block))
        for part, some in held.items():
            yield found(some, int(part))

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64, block: int = 16384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that ``is_query`` holds for, its k best others."""
    spark = vectors.sparkSession
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"), quantised(vector_col, scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    path = fresh_path(spark, "vectors")  # a row keeps its number from here on
    rows.write.parquet(path)
    rows = spark.read.schema(rows.schema).parquet(path)
    n, nq = rows.agg(F.count("*"), F.count_if("is_query")).first()
    wide = 2 * spark.sparkContext.defaultParallelism
    tasks = max(1, ceil(nq / block), min(wide, ceil(nq / LEAST)))
    parts = max(1, min(ceil(wide / tasks), n // MOST))
    at = F.pmod(F.xxhash64("rid"), F.lit(tasks)).cast("int")
    queries = rows.where("is_query").select("rid", "vec_id", "v", at.alias("task"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    dealt = queries.repartitionById(tasks * parts, F.col("task") * parts + F.col("part"))
    found = dealt.mapInArrow(_search(path, k, block, parts), "rid long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("rid").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
