"""Vector expressions, the seeded projection, and an offline embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, functions as F

Embed = Callable[[list[str]], "object"]  # texts -> array (texts, dimension)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalise(v: Column, eps: float = 0.0) -> Column:
    norm = F.sqrt(dot(v, v)) + F.lit(eps)
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(v.cast("array<double>"))


def projection(name: str, dim_in: int, dim_out: int):
    """Gaussian matrix (out, in), seeded by the model's name, scaled by 1/sqrt(out), in single precision."""
    import numpy as np

    seed = int(hashlib.sha256(name.encode()).hexdigest()[:16], 16)
    return (np.random.default_rng(seed).standard_normal((dim_out, dim_in), dtype=np.float32) / np.sqrt(dim_out)).astype(np.float32)


def hashing_embedder(dim: int = 384) -> Embed:
    """Signed feature hashing of white-space tokens: deterministic and offline, no semantics."""

    def embed(texts: list[str]):
        import zlib

        import numpy as np

        out = np.zeros((len(texts), dim), dtype=np.float32)
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % dim] += 1 if h >> 31 else -1
        return out

    return embed


def embed_column(df: DataFrame, text_col: str, out_col: str, dimension: int, load: Callable[[], Embed] = hashing_embedder, name: str = "hashing-384", batch: int = 32) -> DataFrame:
    """``df`` with unit vectors of ``text_col`` (stripped); blank text has none. ``load`` runs once per worker task."""

    import pandas as pd

    def embed(parts):
        import numpy as np

        model, project = load(), None
        for s in parts:
            out = [None] * len(s)
            rows = [i for i, t in enumerate(s) if t is not None and t.strip()]
            for at in range(0, len(rows), batch):
                some = rows[at : at + batch]
                x = np.asarray(model([s.iloc[i].strip() for i in some]), dtype=np.float32)
                if x.shape[1] != dimension:
                    project = projection(name, x.shape[1], dimension) if project is None else project
                    x = x @ project.T
                x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
                for i, v in zip(some, x):
                    out[i] = v
            yield pd.Series(out)

    embed.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out_col, F.pandas_udf(embed, "array<float>")(F.col(text_col)))
