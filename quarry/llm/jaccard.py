"""All links between texts whose shingle sets have an exact Jaccard similarity of a threshold or more.

SimHash comes first: sets whose fingerprints are chained by pairs within some bits are compared whole, and those that are similar
form groups. Fingerprints tell angles, and similar sets may differ in more bits, so the links between different groups are completed by a
prefix filter: sets of n shingles that are that similar share at least t * n of them, so both hold a common one
among their n - ceil(t * n) + 1 first hashes, in whatever order that is the same for all sets. Here frequent hashes come last
(those in cells of a count table that stand out, counted over the texts of every ``EVERY``-th hash; results do not depend on it),
so that a passage which many texts share makes no list. Every distinct set is listed under those; lists with sets of two or more groups are
cut into tiles, and each pair of tiles is one group of rows. A pair of sets of different groups in a list stays a candidate if its sizes, and
the parities of its hashes in 512 bins, allow the threshold (their differing bits are never more than the sets' differing
shingles). Candidate pairs are then held against parities in as many bins as the sets are large, which 512 bins of a large
set no longer tell. All these tests lose no pair. A list with more than ``DENSE`` candidates a member (many near copies)
yields star edges of its candidates' components instead of pairs. Every similar pair of different groups is then inside one component of what is
left; the sets of a component, read from the texts again, are compared whole in the same tiled groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .shared import materialise

BINS = 512
TILE_BYTES = 16 << 20
SMALL, DENSE = 16, 16
EVERY, CELL_BITS, CHUNKS = 8, 22, 1024
BROADCAST_ROWS = 500_000  # of 32 bytes


def shingle_hashes(text: str | None, shingle: int, seed: int):
    """XXH64 of every word shingle, repeats included, in the order of the text."""
    import numpy as np
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()  # as in simhash
    if not words:
        return np.zeros(0, dtype=np.uint64)
    many = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    return np.frombuffer(b"".join([xxh64_digest(s, seed) for s in map(b" ".join, many)]), dtype=">u8").astype(np.uint64)


def majority(hashes) -> int:
    """SimHash of the hashes: bits set in more than half of them."""
    import numpy as np

    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k : k + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def set_id(hashes) -> int:
    """64-bit identity of a set of (sorted) hashes."""
    from xxhash import xxh64_digest

    return int.from_bytes(xxh64_digest(hashes.tobytes(), 1), "big", signed=True)


def prefix_length(n: int, jaccard: float) -> int:
    import math

    return n and n - math.ceil(jaccard * n - 1e-6) + 1


def parities(hashes, bins: int):
    """Of the numbers of hashes in each bin, as 64-bit words; ``bins`` is a power of two from 64 on."""
    import numpy as np

    odd = np.bincount(((hashes >> np.uint64(16)) & np.uint64(bins - 1)).astype(np.int64), minlength=bins) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def bins_for(n: int) -> int:
    return max(BINS, 1 << (2 * n - 1).bit_length())


def folded(words, size: int):
    """Parities in ``size`` 64-bit words from those in more."""
    while len(words) > size:
        half = len(words) // 2
        words = words[:half] ^ words[half:]
    return words


def allowed(jaccard: float, sizes):
    """How many shingles may differ between sets of together ``sizes``."""
    return (1 - jaccard) / (1 + jaccard) * sizes + 1e-6


def cell(hashes):
    import numpy as np

    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def frequent_cells(docs: DataFrame, shingle: int, seed: int, text_col: str):
    """The cells, sorted, whose counts of hashes stand out: above the median by six times its root and two."""
    import numpy as np

    def count(batches):
        import numpy as np
        import pyarrow as pa

        counts = np.zeros(1 << CELL_BITS, dtype=np.int64)
        for b in batches:
            for t in b.column(0):
                np.add.at(counts, cell(np.unique(shingle_hashes(t.as_py(), shingle, seed))), 1)
        if counts.any():
            parts = np.minimum(counts, 65535).astype("<u2").reshape(CHUNKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS, dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], names=["chunk", "counts"])

    def merge(batches):
        import numpy as np
        import pyarrow as pa

        sums: dict = {}
        for b in batches:  # a task has some chunks; their sums are all it holds
            for k, x in zip(b.column(0).to_pylist(), b.column(1)):
                sums[k] = sums.get(k, 0) + np.frombuffer(x.as_py(), "<u2").astype(np.int64)
        for k, x in sums.items():
            typical = np.median(x)
            found = np.flatnonzero(x > typical + 6 * np.sqrt(typical) + 2) + k * len(x)
            yield pa.RecordBatch.from_arrays([pa.array([found.astype(np.int32).tobytes()], pa.binary())], names=["cells"])

    some = docs.select(F.col(text_col).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(EVERY)) == 0)
    rows = some.mapInArrow(count, "chunk int, counts binary").repartition("chunk").mapInArrow(merge, "cells binary").collect()
    return np.sort(np.concatenate([np.frombuffer(r[0], np.int32) for r in rows] or [np.zeros(0, np.int32)]))


def described(docs: DataFrame, shingle: int, jaccard: float, seed: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, fp, sid, n, sketch, prefix) of every row: fingerprint, identity and size of the set, parities,
    first hashes."""
    frequent = frequent_cells(docs, shingle, seed, text_col)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        last = np.zeros(1 << CELL_BITS, dtype=bool)
        last[frequent] = True
        for b in batches:
            fps, sids, sizes, sketches, prefixes = [], [], [], [], []
            for t in b.column(2):
                every = shingle_hashes(t.as_py(), shingle, seed)
                found = np.unique(every)
                fps.append(majority(every))
                sids.append(set_id(found))
                sizes.append(len(found))
                sketches.append(parities(found, bins_for(len(found))).tobytes())
                late = last[cell(found)]
                prefixes.append(np.concatenate([found[~late], found[late]])[: prefix_length(len(found), jaccard)].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(fps, pa.int64()), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "fp", "sid", "n", "sketch", "prefix"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text")).mapInArrow(
        run, "doc_id long, text_hash long, fp long, sid long, n long, sketch binary, prefix array<long>"
    )


def text_hash(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _small_sketch(classes: DataFrame) -> DataFrame:
    """(sid, n, data): the group, and the parities folded to ``BINS`` bins."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            groups = np.asarray(b.column(3))
            data = [g.tobytes() + folded(np.frombuffer(x, dtype=np.uint64), BINS // 64).tobytes() for g, x in zip(groups, b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], names=["sid", "n", "data"])

    return classes.select("sid", "n", "sketch", "linked").mapInArrow(run, "sid long, n long, data binary")


def _sets(rows: DataFrame, shingle: int, seed: int) -> DataFrame:
    """rows (key, sid, text) -> (key, sid, n, data): the whole set of each text."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out = []
            for key, sid, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                found = np.unique(shingle_hashes(t.as_py(), shingle, seed))
                out.append((key, sid, len(found), found.tobytes()))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["key", "sid", "n", "data"])

    return rows.mapInArrow(run, "key long, sid long, n long, data binary")


def _by_group(of):
    """mapInArrow over rows (key, a, b, sid, n, data) sorted by group: what ``of`` makes of whole groups, (u, v, dense)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def table(cols, data):
            new = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            starts = np.concatenate([[0], new])
            found = [x for x in of(starts, np.diff(np.concatenate([starts, [len(data)]])), cols[3], cols[4], data) if len(x[0])]
            u, v, dense = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool))
            rows = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v), dense.astype(np.int64)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1]), pa.array(rows[:, 2].astype(bool))], names=["u", "v", "dense"])

        held, held_data = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols, data = [np.asarray(batch.column(i)) for i in range(5)], batch.column(5).to_pylist()
            if held is not None:
                cols, data = [np.concatenate(c) for c in zip(held, cols)], held_data + data
            change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0))
            cut = change[-1] + 1 if len(change) else 0  # the last group may go on in the next batch
            if cut:
                yield table([c[:cut] for c in cols], data[:cut])
            held, held_data = [c[cut:] for c in cols], data[cut:]
        if held is not None:
            yield table(held, held_data)

    return run


def _stars(sid, near):
    """Star edges of one group's components; near(i, others): which of them are linked to i."""
    import numpy as np

    u, v, todo = [], [], np.argsort(sid, kind="stable")
    while len(todo) > 1:
        root, frontier, todo = todo[0], [todo[0]], todo[1:]
        while frontier and len(todo):
            found = near(frontier.pop(), todo)
            if found.any():
                u.append(np.full(found.sum(), sid[root]))
                v.append(sid[todo[found]])
                frontier += list(todo[found])
                todo = todo[~found]
    if not u:
        return (np.zeros(0, np.int64),) * 2
    return np.concatenate(u), np.concatenate(v)


def _candidates(jaccard: float):
    """Pairs of equal key, not in one group, whose sizes and parities in ``BINS`` bins allow the threshold; data: the group and the parities."""

    def of(starts, sizes, sid, n, data):
        import numpy as np

        bits = np.frombuffer(b"".join(data), dtype=np.uint64).reshape(len(sid), -1)
        linked, bits = bits[:, 0], bits[:, 1:]

        def fits(i, j):
            out = (np.minimum(n[i], n[j]) >= jaccard * np.maximum(n[i], n[j]) - 1e-6) & (linked[i] != linked[j])
            a, b = np.broadcast_arrays(i, j)
            a, b = a[out], b[out]
            out[out] = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64) <= allowed(jaccard, n[a] + n[b])
            return out

        ends = np.repeat(starts + sizes, sizes)
        at, step = np.flatnonzero(np.repeat(sizes <= SMALL, sizes)), 1
        while len(at := at[at + step < ends[at]]):  # all pairs of the small groups at one distance
            ok = at[fits(at, at + step)]
            yield sid[ok], sid[ok + step], np.zeros(len(ok), dtype=bool)
            step += 1
        for s, m in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
            u, v, found = [], [], 0
            for i in range(s, s + m - 1):
                others = np.arange(i + 1, s + m)
                others = others[fits(i, others)]
                u.append(np.full(len(others), sid[i]))
                v.append(sid[others])
                found += len(others)
                if found > DENSE * m:
                    break
            dense = found > DENSE * m
            if dense:
                u, v = ([x] for x in _stars(sid[s : s + m], lambda i, todo: fits(s + i, s + todo)))
            u, v = np.concatenate(u), np.concatenate(v)
            yield u, v, np.full(len(u), dense)

    return of


def _similar(jaccard: float):
    """Star edges of each group's components of exactly similar sets; data: whole sets."""

    def of(starts, sizes, sid, n, data):
        import numpy as np

        for s, m in zip(starts, sizes):
            if m < 2:
                continue
            own, count = data[s : s + m], n[s : s + m]
            bins = bins_for(int(count.max()))
            bits = np.stack([parities(np.frombuffer(x, dtype=np.uint64), bins) for x in own])
            ends = np.cumsum(count)
            values, ids = np.unique(np.frombuffer(b"".join(own), dtype=np.uint64), return_inverse=True)
            mark = np.zeros(len(values), dtype=bool)

            def near(i, todo):
                out = np.minimum(count[todo], count[i]) >= jaccard * np.maximum(count[todo], count[i]) - 1e-6
                some = todo[out]
                out[out] = np.bitwise_count(bits[some] ^ bits[i]).sum(axis=1, dtype=np.int64) <= allowed(jaccard, count[some] + count[i])
                some = todo[out]
                if len(some):
                    mine = ids[ends[i] - count[i] : ends[i]]
                    mark[mine] = True
                    both = np.array([np.count_nonzero(mark[ids[ends[j] - count[j] : ends[j]]]) for j in some], dtype=np.int64)
                    mark[mine] = False
                    union = count[some] + count[i] - both
                    out[out] = np.where(union == 0, True, both / np.maximum(union, 1) >= jaccard)
                return out

            u, v = _stars(sid[s : s + m], near)
            yield u, v, np.zeros(len(u), dtype=bool)

    return of


def _edges(rows: DataFrame, sizes: DataFrame, of) -> DataFrame:
    """Edges (u, v, dense), u < v, in the groups of equal ``key``; rows (key, sid, n, data), sizes (key, tiles)."""
    mine = F.when(F.col("tiles") > 1, F.pmod(F.xxhash64("sid"), F.col("tiles"))).otherwise(0).cast("int")
    groups = (
        rows.join(sizes, "key")
        .select("key", "sid", "n", "data", mine.alias("t"), F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("o"))
        .select("key", F.least("t", "o").cast("long").alias("a"), F.greatest("t", "o").cast("long").alias("b"), "sid", "n", "data")
    )
    found = groups.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_by_group(of), "u long, v long, dense boolean")
    return found.where("u <> v").distinct()


def _by_sketch(pairs: DataFrame, classes: DataFrame, jaccard: float) -> DataFrame:
    """The pairs (u, v) whose parities in as many bins as the sets are large allow the threshold."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            keep = []
            for n, m, x, y in zip(*(b.column(i).to_pylist() for i in range(2, 6))):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                size = min(len(x), len(y))
                keep.append(int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum(dtype=np.int64)) <= allowed(jaccard, n + m))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one = classes.select(F.col("sid").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    two = classes.select(F.col("sid").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "nu", "nv", "su", "sv").mapInArrow(run, "u long, v long")


def _verified(docs: DataFrame, classes: DataFrame, candidates: DataFrame, shingle: int, jaccard: float, tile: int, seed: int, components, id_col: str, text_col: str, name: str) -> DataFrame:
    """Edges (u, v) whose components are those of the exactly similar pairs inside each component of ``candidates``."""
    chosen = classes.select("sid", "first", "n").join(components(candidates).select(F.col("v").alias("sid"), F.col("root").alias("key")), "sid")
    chosen = materialise(chosen.select("sid", F.col("first.doc_id").alias("first"), F.col("first.text_hash").alias("text_hash"), "n", "key"), name)
    tiles = F.greatest(F.ceil(F.count("*") / F.lit(tile)), F.ceil(F.sum("n") * 8 / F.lit(TILE_BYTES)), F.lit(1)).cast("int")
    sizes = chosen.groupBy("key").agg(tiles.alias("tiles"))
    texts = docs.select(F.col(id_col).cast("long").alias("first"), text_hash(text_col).alias("text_hash"), F.col(text_col).alias("text"))
    wanted = chosen.select("first", "text_hash", "sid", "key")
    texts = texts.join(F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted, ["first", "text_hash"])
    return materialise(_edges(_sets(texts.select("key", "sid", "text"), shingle, seed), sizes, _similar(jaccard)).select("u", "v"), f"{name}-links")


def _same_print(classes: DataFrame, links, tile: int) -> DataFrame:
    """Edges (u, v) between sets of equal or near fingerprints; ``links`` finds those between representatives of fingerprints."""
    prints = materialise(classes.groupBy("fp").agg(F.min("sid").alias("rep")), "prints")
    equal = classes.join(prints, "fp").where("sid <> rep").select(F.col("rep").alias("u"), F.col("sid").alias("v"))
    return links(prints, tile=tile).unionByName(equal)


def labelled(docs: DataFrame, shingle: int, jaccard: float, tile: int, seed: int, components, links, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, fp, sid, component_id, kept) of every row; kept: the (doc_id, text_hash) of the component's smallest
    row. ``components`` labels the vertices of edges (u, v), ``links`` yields edges between near fingerprints (fp, rep)."""
    rows = materialise(described(docs, shingle, jaccard, seed, id_col, text_col), "sets")
    named = rows.where("doc_id is not null")
    first = F.struct("doc_id", "text_hash")
    classes = materialise(named.groupBy("sid").agg(F.min(first).alias("first"), F.max("n").alias("n"), F.min("fp").alias("fp"), F.max("sketch").alias("sketch"), F.first("prefix").alias("prefix")), "classes")
    how = (shingle, jaccard, tile, seed, components, id_col, text_col)

    near = _verified(docs, classes, _same_print(classes, links, tile), *how, "near-prints")
    groups = materialise(components(near).select(F.col("v").alias("sid"), F.col("root").alias("linked")), "groups")
    grouped = classes.join(groups, "sid", "left").withColumn("linked", F.coalesce("linked", "sid"))

    keys = grouped.select(F.explode("prefix").alias("key"), "sid", "linked")
    shared = keys.groupBy("key").agg(F.count("*").alias("members"), F.min("linked").alias("a"), F.max("linked").alias("b")).where("a <> b").select("key", "members")
    lists = materialise(keys.select("key", "sid").join(shared, "key"), "lists")
    sizes = lists.groupBy("key").agg(F.ceil(F.max("members") / F.lit(tile)).cast("int").alias("tiles"))
    listed = lists.select("key", "sid").join(_small_sketch(grouped), "sid").select("key", "sid", "n", "data")
    found = materialise(_edges(listed, sizes, _candidates(jaccard)), "candidates")
    candidates = _by_sketch(found.where("not dense"), classes, jaccard).unionByName(found.where("dense").select("u", "v"))
    edges = near.unionByName(_verified(docs, classes, candidates, *how, "chosen"))

    roots = components(edges).select(F.col("v").alias("sid"), "root")
    rooted = classes.select("sid", "first").join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rooted = materialise(rooted, "rooted")
    labels = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("kept")), "root").select("sid", F.col("kept.doc_id").alias("component_id"), "kept")
    return rows.select("doc_id", "text_hash", "fp", "sid").join(labels, "sid", "left")
