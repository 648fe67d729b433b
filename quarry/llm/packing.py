"""Packing of token streams into training sequences of several lengths.

Each document becomes its token ids and one end id. Whole windows of the longest tier are
cut off first; what remains is routed to the smallest tier that holds it. Tiers are packed
from long to short: a window starts with a document of its own tier, takes the longest
pieces of shorter tiers that fit (best fit), and closes the last gap with a cut piece, so
that its length is the tier's. What is left of a task's last buffer is cut into windows
whose lengths are powers of two. Nothing is padded.

A task packs what it reads and needs no other task's rows: no shuffle. Memory holds one
buffer of ``buffer_tokens`` ids besides one document.

Step groups: windows of one tier are dealt to groups of ``step_tokens`` tokens each, so
every group but a task's last of each tier holds exactly as many tokens.

Defined cases: null text is empty (its end id alone is packed); equal rows are packed one
by one; a null document id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import itertools
import zlib

from pyspark.sql import DataFrame, functions as F

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
END_OF_TEXT = "<|endoftext|>"
CHUNK_CHARS = 1 << 20


class ByteBpe:
    """Ids of a tokenizer file. The ranks file of the same vocabulary, if given, makes the
    same ids several times faster; texts with a special token's string go to the first."""

    def __init__(self, path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.fast = None
        if ranks_path:
            import base64

            import regex
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.pattern = regex.compile(pattern)

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        import numpy as np

        if self.fast is None or END_OF_TEXT in text:
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(text) <= CHUNK_CHARS:
            return np.array(self.fast.encode_ordinary(text), dtype="<u4").tobytes()
        out, words = [], (m[0] for m in self.pattern.finditer(text))
        while part := list(itertools.islice(words, 1 << 17)):  # pieces of the pattern are encoded one by one anyway
            out.append(np.array([i for w in part for i in self.fast.encode_ordinary(w)], dtype="<u4").tobytes())
        return b"".join(out)


class Packer:
    """Packs pieces ``[document, start, length]`` of buffered documents."""

    def __init__(self, tiers: tuple[int, ...], first_id: int, step_tokens: int):
        self.tiers, self.next, self.step_tokens = sorted(tiers), first_id, step_tokens
        self.first, self.made = first_id, dict.fromkeys(self.tiers, 0)
        self.left: list[tuple[int, int, int]] = []  # (length, document, start)

    def emit(self, pieces: list[tuple[int, int, int]], size: int):
        """pieces: (length, document, start); size: the window's length."""
        at, seq = 0, self.next
        self.next += 1
        n = self.made[size] = self.made.get(size, 0) + 1
        group = self.first + ((n - 1) // max(1, self.step_tokens // size)) * 64 + size.bit_length()
        for length, doc, start in pieces:
            yield doc, start, length, seq, at, size, group
            at += length

    def pack(self, docs: list[tuple[int, int]]):
        """docs: (document, tokens). Leaves in self.left what fills no window."""
        longest, pool = self.tiers[-1], self.left
        self.left = []
        for doc, n in docs:
            whole = n - n % longest
            for start in range(0, whole, longest):
                yield from self.emit([(longest, doc, start)], longest)
            if n > whole:
                pool.append((n - whole, doc, whole))
        pool.sort()
        for k in range(len(self.tiers) - 1, -1, -1):
            size, below = self.tiers[k], self.tiers[k - 1] if k else 0
            while pool and pool[-1][0] > below:
                window = [pool.pop()]
                gap = size - window[0][0]
                while gap and pool:
                    i = bisect.bisect_right(pool, (gap, float("inf"), 0))
                    if i:  # the longest piece that fits
                        window.append(pool.pop(i - 1))
                        gap -= window[-1][0]
                    else:  # the shortest piece is longer than the gap: cut it
                        length, doc, start = pool.pop(0)
                        window.append((gap, doc, start))
                        bisect.insort(pool, (length - gap, doc, start + gap))
                        gap = 0
                if gap:
                    self.left += window
                else:
                    yield from self.emit(window, size)

    def finish(self):
        """Windows with lengths of powers of two for all that is left."""
        pieces, self.left = self.left, []
        total = sum(x[0] for x in pieces)
        while total:
            size = min(self.tiers[-1], 1 << (total.bit_length() - 1))
            window, gap = [], size
            while gap:
                length, doc, start = pieces[0]
                cut = min(length, gap)
                window.append((cut, doc, start))
                gap -= cut
                if cut == length:
                    pieces.pop(0)
                else:
                    pieces[0] = (length - cut, doc, start + cut)
            total -= size
            yield from self.emit(window, size)


def pack(docs: DataFrame, *, tokenizer: str, ranks: str | None = None, pattern: str | None = None, end_id: int = 1, tiers: tuple[int, ...] = (256, 512, 1024, 2048), step_tokens: int = 16384, buffer_tokens: int = 1 << 20, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence, the sequence's
    tier and step group; ``with_ids`` adds the ids themselves."""
    schema = SCHEMA + (", ids array<int>" if with_ids else "")

    def run(batches):
        import struct

        import pyarrow as pa
        from pyspark import TaskContext

        kinds = {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
        arrow = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])
        encode = ByteBpe(tokenizer, ranks, pattern)
        packer = Packer(tiers, TaskContext.get().partitionId() << 40, step_tokens)
        end = struct.pack("<I", end_id)
        held: dict[int, tuple] = {}  # document -> (its id, ids)
        fresh, tokens, count = [], 0, 0

        def table(placed):
            rows = []
            for doc, start, length, seq, at, size, group in placed:
                name, ids = held[doc]
                part = ids[4 * start : 4 * (start + length)]
                rows.append((name, start, length, zlib.crc32(part), len(ids) // 4, seq, at, size, group) + ((list(struct.unpack(f"<{length}I", part)),) if with_ids else ()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                held[count] = (name, ids)
                fresh.append((count, len(ids) // 4))
                tokens, count = tokens + len(ids) // 4, count + 1
                if tokens >= buffer_tokens:
                    yield from table(packer.pack(fresh))
                    held = {doc: held[doc] for _, doc, _ in packer.left}
                    fresh, tokens = [], sum(x[0] for x in packer.left)
        yield from table(packer.pack(fresh))
        yield from table(packer.finish())

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
