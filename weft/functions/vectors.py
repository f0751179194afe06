"""Embeddings: hashed character trigrams, and cosine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS, GRAM = 256, 3


def _clean(text: Column) -> Column:
    # a single blank stays as it is, so most words need no replacement
    return F.trim(F.regexp_replace(F.lower(text), r"\s{2,}|[^\S ]", " "))


def _counts(texts: list[str], digest: Callable[[str], bytes], known: dict[int, int], dimensions: int):
    """How many trigrams of each text fall into each bucket, a row for each text. A gram's bucket is the first four bytes of its
    digest, taken once for each gram that a task meets: known has those so far, by the gram's code points in one number."""
    import numpy as np
    import pandas as pd

    out = np.zeros((len(texts), dimensions), dtype=np.int64)
    bucket = lambda g: int.from_bytes(digest(g.encode())[:4], "big") % dimensions
    long = [i for i, t in enumerate(texts) if len(t) >= GRAM]
    for i in {*range(len(texts))}.difference(long):
        out[i, bucket(texts[i])] = 1
    while long:
        some, size = [], 0
        while long and size < 1_000_000:  # characters at once; a text of more is one part
            some.append(long.pop())
            size += len(texts[some[-1]])
        points = np.frombuffer("".join(texts[i] for i in some).encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
        lengths = np.array([len(texts[i]) for i in some])
        owner = np.repeat(np.arange(len(some)), lengths)
        keys = (points[:-2] << 42) | (points[1:-1] << 21) | points[2:]
        whole = owner[:-2] == owner[2:]  # no gram reaches over from one text into the next
        codes, grams = pd.factorize(keys[whole])
        buckets = np.empty(len(grams), dtype=np.int64)
        for j, k in enumerate(grams.tolist()):
            at = known.get(k)
            if at is None:
                at = bucket(chr(k >> 42) + chr(k >> 21 & 0x1FFFFF) + chr(k & 0x1FFFFF))
                if len(known) < 1_000_000:
                    known[k] = at
            buckets[j] = at
        out[some] = np.bincount(owner[:-2][whole] * dimensions + buckets[codes], minlength=len(some) * dimensions).reshape(len(some), dimensions)
    return out


def gram_counts(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """How many of a text's trigrams fall into each bucket by md5, as array<long>; null of a null text."""

    @F.arrow_udf("array<long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import hashlib

        known: dict[int, int] = {}
        for texts in batches:
            rows = _counts(["" if t is None else t for t in texts.to_pylist()], lambda b: hashlib.md5(b).digest(), known, dimensions)
            yield pa.ListArray.from_arrays(pa.array(range(0, rows.size + 1, dimensions), pa.int32()), pa.array(rows.ravel()))

    return F.when(text.isNotNull(), of(_clean(text)))


def gram_sums(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Of gram_counts a struct of longs: n_grams, their sum, n_buckets, how many are not zero, and total, the sum of count times bucket."""

    @F.arrow_udf("n_grams long, n_buckets long, total long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import hashlib

        import numpy as np

        known: dict[int, int] = {}
        for texts in batches:
            rows = _counts(["" if t is None else t for t in texts.to_pylist()], lambda b: hashlib.md5(b).digest(), known, dimensions)
            yield pa.StructArray.from_arrays([pa.array(x) for x in (rows.sum(1), np.count_nonzero(rows, axis=1), rows @ np.arange(dimensions))], ["n_grams", "n_buckets", "total"])

    return F.when(text.isNotNull(), of(_clean(text)))


def trigram_embedding(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """A unit vector of hashed trigram counts (blake2b, 4 bytes), as array<double>."""

    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import hashlib

        import numpy as np

        known: dict[int, int] = {}
        for texts in batches:
            v = _counts([" ".join((t or "").lower().split()) for t in texts.to_pylist()], lambda b: hashlib.blake2b(b, digest_size=4).digest(), known, dimensions).astype(float)
            norm = np.sqrt((v * v).sum(1, keepdims=True))
            v /= np.where(norm > 0, norm, 1.0)
            yield pa.ListArray.from_arrays(pa.array(range(0, v.size + 1, dimensions), pa.int32()), pa.array(v.ravel()))

    return of(text)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(a: Column) -> Column:
    norm = F.sqrt(dot(a, a))
    return F.transform(a, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))
