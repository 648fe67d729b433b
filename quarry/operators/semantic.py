"""Exact cosine top-k of a batch of queries: matrix products over Arrow batches.

Up to ``broadcast_queries`` queries travel to every task, which keeps its best k of each query as it reads
the chunks: one pass, no shuffle of vectors. Beyond that, queries and chunks are dealt into blocks and each
pair of blocks is one group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.vectors import l2_normalise
from .index import best


def _unit(col: str):
    return l2_normalise(F.col(col))


def _kernel(qids, q, pos, x, k: int, digits: int):
    """(query ids, positions, scores) of each query's best k among x, ties by position."""
    import numpy as np

    s = np.round(q @ x.T, digits)
    out = []
    for i in range(len(q)):
        row = s[i]
        some = np.arange(len(row))
        if len(row) > k:
            least = np.partition(row, len(row) - k)[len(row) - k]
            some = np.flatnonzero(row >= least)
            some = some[np.lexsort((pos[some], -row[some]))[:k]]
        out.append((np.full(len(some), qids[i]), pos[some], row[some]))
    return [np.concatenate(c) for c in zip(*out)]


def _matrix(column):
    import numpy as np

    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def semantic_top_k(chunks: DataFrame, queries: DataFrame, k: int = 20, digits: int = 9, broadcast_queries: int = 2048, block: int = 8192) -> DataFrame:
    """chunks: pos, embedding; queries: query_id, embedded_query -> (query_id, pos, score, rank). Rows without a
    vector take no part; scores are rounded to ``digits`` before ranking."""
    schema = "query_id long, pos long, score double"
    have = chunks.where(F.col("embedding").isNotNull()).select(F.col("pos").cast("long").alias("pos"), _unit("embedding").alias("v"))
    asked = queries.where(F.col("embedded_query").isNotNull()).select(F.col("query_id").cast("long").alias("query_id"), _unit("embedded_query").alias("v"))
    n = asked.count()
    if n <= broadcast_queries:
        rows = asked.collect()
        ids, vectors = [r[0] for r in rows], [list(r[1]) for r in rows]

        def run(batches):
            import numpy as np
            import pyarrow as pa

            qids, q = np.array(ids, dtype=np.int64), np.array(vectors)
            held = None
            for b in batches:
                if not b.num_rows or not len(q):
                    continue
                got = _kernel(qids, q, np.asarray(b.column(0)), _matrix(b.column(1)), k, digits)
                held = got if held is None else [np.concatenate(c) for c in zip(held, got)]
                order = np.lexsort((held[1], -held[2], held[0]))
                held = [c[order] for c in held]
                first = np.searchsorted(held[0], held[0])
                keep = np.arange(len(first)) - first < k
                held = [c[keep] for c in held]
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=["query_id", "pos", "score"])

        found = have.mapInArrow(run, schema)
    else:
        blocks, query_blocks = max(1, -(-have.count() // block)), -(-n // broadcast_queries)

        def dealt(df, key, mine, other, others, is_query):
            at = F.pmod(F.xxhash64(key), F.lit(mine)).cast("int")
            return df.select(F.col(key).alias("key"), "v", F.lit(is_query).alias("is_query"), at.alias("a"), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias("b")).select("key", "v", "is_query", F.col("b" if is_query else "a").alias("cb"), F.col("a" if is_query else "b").alias("qb"))

        def run_group(t):
            import numpy as np
            import pyarrow as pa

            flag = np.asarray(t["is_query"])
            key, v = np.asarray(t["key"]), _matrix(t["v"].combine_chunks())
            cols = _kernel(key[flag], v[flag], key[~flag], v[~flag], k, digits) if flag.any() and not flag.all() else [np.empty(0, np.int64)] * 2 + [np.empty(0)]
            return pa.table([pa.array(c) for c in cols], names=["query_id", "pos", "score"])

        both = dealt(have, "pos", blocks, "qb", query_blocks, False).unionByName(dealt(asked, "query_id", query_blocks, "cb", blocks, True))
        found = both.groupBy("cb", "qb").applyInArrow(run_group, schema)
    return best(found, k, ["query_id"], F.desc("score"), F.col("pos"))
