"""SimHash near-duplicates: fingerprints, pigeonhole blocks, components.

Fingerprints that differ in at most ``distance`` bits agree on ``shared`` of ``blocks``
blocks of bits if blocks - distance >= shared (pigeonhole). Every distinct fingerprint is
listed once for each choice of ``shared`` blocks under those blocks' bits; only lists with
two or more entries are looked at, and each candidate pair is verified on all 64 bits.
A list yields star edges (smallest member to each member of its component inside the
list), never all its pairs. A list longer than ``tile`` is split by hash into tiles, and
each pair of tiles is one group, so no task holds more than two tiles of a list. Components over the edges come from hooking and
pointer jumping, one written table a round; copies share a fingerprint and are one vertex.

Few differing bits mean a small angle, not a Jaccard similarity: of pairs at 4 to 7 bits more than
half can be below 0.8. With ``similarity``, the texts of each component are compared once more, by bits and by
64-byte MinHash sketches, in the same tiled groups. With ``jaccard``, each component's shingle sets are compared whole, and
module ``jaccard`` adds the links between sets of that similarity whose fingerprints differ in more bits.

Defined cases: null text and texts without words have fingerprint zero and link like any
other; texts of fewer words than a shingle are one shingle; equal rows give equal output
rows; rows without an id get a fingerprint, and the component of the documents linked to
them, but are no one's link (null if there are only such rows); an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

from pyspark.sql import DataFrame, functions as F

from . import jaccard as exact
from .shared import materialise

SEED = 42
BUCKETS = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of every word shingle, repeats included."""
    return fingerprint_and_sketch(text, shingle, False)[0]


def fingerprint_and_sketch(text: str | None, shingle: int = 3, sketched: bool = True) -> tuple[int, bytes | None]:
    """The fingerprint, and (if ``sketched``) a one-permutation MinHash of the set of shingles: hashes are dealt to
    ``BUCKETS`` buckets, and a byte of each bucket's smallest is kept (0: an empty bucket)."""
    import numpy as np
    from xxhash import xxh64_digest

    words = (text or "").encode().lower().split()  # bytes: only A-Z are lowered, only ASCII white space splits
    if not words:
        return 0, bytes(BUCKETS) if sketched else None
    many = zip(*(words[k:] for k in range(shingle))) if len(words) >= shingle else [words]
    counts, n, digests = np.zeros(64, dtype=np.int64), 0, []
    least = np.full(BUCKETS, 2**64 - 1, dtype=np.uint64)

    def add():
        bits = np.unpackbits(np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 8), axis=1)
        counts.__iadd__(bits.sum(axis=0, dtype=np.int64))
        if sketched:
            found = np.frombuffer(b"".join(digests), dtype=">u8").astype(np.uint64)
            np.minimum.at(least, found % np.uint64(BUCKETS), found // np.uint64(BUCKETS))

    for s in map(b" ".join, many):
        digests.append(xxh64_digest(s, SEED))
        if len(digests) == 1 << 16:
            add()
            n, digests = n + len(digests), []
    if digests:
        add()
        n += len(digests)
    sketch = np.where(least == 2**64 - 1, 0, least % np.uint64(255) + np.uint64(1)).astype(np.uint8)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big", signed=True), sketch.tobytes() if sketched else None


def similarity_of(sketches, one):
    """Estimated Jaccard similarity of each row of ``sketches`` and the row ``one`` (or row by row)."""
    import numpy as np

    used = ((sketches | one) != 0).sum(axis=-1)
    return np.where(used == 0, 1.0, ((sketches == one) & (one != 0)).sum(axis=-1) / np.maximum(used, 1))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text", sketched: bool = False) -> DataFrame:
    """(doc_id, fp, sketch); fp holds the 64 bits as a signed long, sketch is null unless ``sketched``."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [fingerprint_and_sketch(t.as_py(), shingle, sketched) for t in b.column(1)]
            fps, sketches = pa.array([x for x, _ in found], type=pa.int64()), pa.array([x for _, x in found], type=pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), fps, sketches], names=["doc_id", "fp", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long, sketch binary")


def block_masks(blocks: int, shared: int) -> list[int]:
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    masks = [sum(c) for c in combinations(parts, shared)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def blocks_for(n: int, distance: int, most: int = 64) -> tuple[int, int]:
    """(blocks, shared) for ``n`` fingerprints: as few tables as keep a list of random fingerprints at
    ``most`` on average. Any choice finds the same pairs."""
    shared = 2
    while n > most * 2 ** (64 * shared / (distance + shared)) and shared < 6:
        shared += 1
    return distance + shared, shared


def _stars(distance: int, similarity: float | None = None):
    """mapInArrow over rows (key, a, b, fp, rep, sketch) sorted by group: star edges of each group.
    Two rows are linked within ``distance`` bits and, if given, from ``similarity`` on."""

    def components(fp, rep, sketch):
        """Edges (smallest id, id) of the linked components of one group."""
        import numpy as np

        order = np.argsort(rep)
        fp, rep, sketch = fp[order], rep[order], sketch[order] if similarity else None
        todo = np.arange(len(fp))
        while len(todo) > 1:
            root, frontier, todo = todo[0], [todo[0]], todo[1:]
            while frontier and len(todo):
                i = frontier.pop()
                near = np.bitwise_count(fp[todo] ^ fp[i]) <= distance
                if similarity and near.any():
                    near[near] = similarity_of(sketch[todo[near]], sketch[i]) >= similarity
                if near.any():
                    for j in todo[near]:
                        yield rep[root], rep[j]
                    frontier += list(todo[near])
                    todo = todo[~near]

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def linked(fp, starts, sizes, most: int = 512):
            """Whether a group holds a pair within ``distance`` (taken for granted in those over ``most`` rows)."""
            found = sizes > most
            group = np.repeat(np.arange(len(sizes)), sizes)
            ends = np.repeat(starts + sizes, sizes)
            at, step = np.flatnonzero(~found[group]), 1
            while len(at := at[(at + step < ends[at]) & ~found[group[at]]]):
                found[group[at[np.bitwise_count(fp[at] ^ fp[at + step]) <= distance]]] = True
                step += 1
            return found

        def of(cols):
            key, a, b, fp, rep, sketch = cols
            fp = fp.view(np.uint64)  # of a negative number, bitwise_count() takes the absolute value
            new = np.flatnonzero((np.diff(key) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)) + 1
            starts = np.concatenate([[0], new])
            sizes = np.diff(np.concatenate([starts, [len(key)]]))
            some = linked(fp, starts, sizes)
            more = [e for s, n in zip(starts[some], sizes[some]) for e in components(fp[s : s + n], rep[s : s + n], sketch[s : s + n])]
            p, q = (np.array(v, dtype=np.int64) for v in (zip(*more) if more else ([], [])))
            return pa.RecordBatch.from_arrays([pa.array(p), pa.array(q)], names=["u", "v"])

        def columns(batch):
            cols = [np.asarray(batch.column(i)) for i in range(5)]
            sketch = np.frombuffer(b"".join(batch.column(5).to_pylist()), dtype=np.uint8) if similarity else np.zeros(0, np.uint8)
            return [*cols, sketch.reshape(batch.num_rows, -1) if similarity else np.zeros((batch.num_rows, 0), np.uint8)]

        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = columns(batch)
            if held is not None:
                cols = [np.concatenate(c) for c in zip(held, cols)]
            change = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0))
            cut = change[-1] + 1 if len(change) else 0  # the last group may go on in the next batch
            if cut:
                yield of([c[:cut] for c in cols])
            held = [c[cut:] for c in cols]
        if held is not None:
            yield of(held)

    return run


def group_links(keys: DataFrame, distance: int, tile: int, similarity: float | None = None) -> DataFrame:
    """Edges (u, v), u < v, inside the groups of equal ``key``; rows: key, fp, rep, and sketch if ``similarity`` is given."""
    sketch = F.col("sketch") if similarity else F.lit(None).cast("binary")
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / F.lit(tile)).cast("int")
    mine = F.when(tiles > 1, F.pmod(F.xxhash64("fp", "rep"), tiles)).otherwise(0).cast("int")
    groups = (
        keys.join(sizes, "key")
        .select("key", "fp", "rep", sketch.alias("sketch"), mine.alias("t"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("o"))
        .select("key", F.least("t", "o").cast("int").alias("a"), F.greatest("t", "o").cast("int").alias("b"), "fp", "rep", "sketch")
    )
    edges = groups.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b").mapInArrow(_stars(distance, similarity), "u long, v long")
    return edges.where("u <> v").distinct()


def links(classes: DataFrame, distance: int = 3, blocks: int | None = None, shared: int = 2, tile: int = 4096) -> DataFrame:
    """Edges (u, v), u < v, between representatives ``rep`` of distinct fingerprints ``fp``;
    their components are those of all pairs within ``distance``. Without ``blocks``, blocks_for() chooses both numbers."""
    if blocks is None:
        blocks, shared = blocks_for(classes.count(), distance)
    if blocks - distance < shared:
        raise ValueError("that many differing bits can touch too many blocks")
    masks = F.array(*[F.lit(m) for m in block_masks(blocks, shared)])
    keys = classes.select("fp", "rep", F.posexplode(masks).alias("table", "mask")).select(
        F.xxhash64("table", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), "fp", "rep"
    )
    return group_links(keys, distance, tile)


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest vertex that can be reached. Each round hooks a vertex and its
    parent under the smallest grandparent of its neighbours; the sum of parents only falls,
    and when it stays the same the parents are the roots."""
    both = materialise(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    parents = materialise(both.groupBy(F.col("u").alias("v")).agg(F.least(F.min("v"), F.first("u")).alias("f")), "parents")

    def total(p):
        return p.agg(F.sum(F.col("f").cast("decimal(38,0)"))).first()[0]

    last, before = total(parents), None
    while last != before:
        up = parents.select(F.col("v").alias("f"), F.col("f").alias("g"))
        grand = parents.join(up, "f").select("v", "f", "g")
        low = both.join(grand.select("v", "g"), "v").groupBy(F.col("u").alias("v")).agg(F.min("g").alias("m"))
        hooked = parents.join(low, "v").select(F.explode(F.array(F.struct("v", F.col("m").alias("f")), F.struct(F.col("f").alias("v"), F.col("m").alias("f")))).alias("x")).select("x.*")
        parents = materialise(hooked.union(grand.select("v", F.col("g").alias("f"))).groupBy("v").agg(F.min("f").alias("f")), "parents")
        last, before = total(parents), last
    return parents.select("v", F.col("f").alias("root"))


def _labelled(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """``classes`` with component_id, the smallest ``rep`` that edges reach (null without a rep)."""
    roots = components(edges).withColumnRenamed("v", "rep")
    named = classes.where("rep is not null").join(roots, "rep", "left").withColumn("component_id", F.coalesce("root", "rep")).drop("root")
    return named.unionByName(classes.where("rep is null").withColumn("component_id", F.lit(None).cast("long")))


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 3, blocks: int | None = None, shared: int = 2, tile: int = 4096, similarity: float | None = None, jaccard: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) for every row of ``docs``. With ``similarity``, a link
    also needs an estimated Jaccard similarity of the shingle sets of at least that: any two texts
    within ``distance`` are in one component of the fingerprints, so links are looked for again inside each of these.
    With ``jaccard``, links are all pairs of texts of at least that exact Jaccard similarity, those within ``distance`` first."""
    if jaccard:
        near = partial(links, distance=distance, blocks=blocks, shared=shared)
        labels = exact.labelled(docs, shingle, jaccard, tile, SEED, components, near, id_col, text_col)
        return labels.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    prints = materialise(fingerprints(docs, shingle, id_col, text_col, bool(similarity)), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    labels, by = _labelled(classes, links(classes.where("rep is not null"), distance, blocks, shared, tile)).select("fp", "component_id"), ["fp"]
    if similarity:
        texts = prints.groupBy("fp", "sketch").agg(F.min("doc_id").alias("rep"))
        texts = materialise(texts.join(labels.withColumnRenamed("component_id", "key"), "fp"), "sketches")
        edges = group_links(texts.where("rep is not null").select("key", "fp", "rep", "sketch"), distance, tile, similarity)
        labels, by = _labelled(texts.drop("key"), edges).select("fp", "sketch", "component_id"), ["fp", "sketch"]
    return prints.join(labels, by).select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, jaccard: float = 0.8, shingle: int = 5, tile: int = 4096, distance: int = 6) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) but those near-duplicate to a row of a smaller id: candidates by SimHash, checked
    exactly, and the similar pairs beyond ``distance`` bits. Rows, not ids, are kept:
    two texts of one id that are not near-duplicates both stay, and of equal rows one does; rows without an id stay all."""
    labels = exact.labelled(docs, shingle, jaccard, tile, SEED, components, partial(links, distance=distance), "doc_id", "text").where("doc_id is not null")
    rows = labels.groupBy(F.col("doc_id").alias("__id"), "text_hash").agg(F.count("*").alias("__n"), F.bool_or((F.col("kept.doc_id") != F.col("doc_id")) | (F.col("kept.text_hash") != F.col("text_hash"))).alias("__lost"))
    touched = materialise(rows.where("__lost or __n > 1").withColumnRenamed("text_hash", "__hash"), "duplicates")
    names = docs.columns
    numbered = docs.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(names)], F.col("doc_id").cast("long").alias("__row"), exact.text_hash("text").alias("__text"))
    same = (F.col("__row") == F.col("__id")) & (F.col("__text") == F.col("__hash"))
    kept = numbered.join(touched.where("__lost"), same, "left_anti")
    repeated = touched.where("not __lost")
    if not repeated.isEmpty():
        once = kept.join(repeated, same, "left_semi").dropDuplicates(["__row", "__text"])
        kept = kept.join(repeated, same, "left_anti").unionByName(once)
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
