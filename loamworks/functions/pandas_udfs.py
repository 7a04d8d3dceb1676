"""Text functions that Spark has no built-in for, as vectorised functions over Arrow batches."""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import regex
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Compatibility composition; null stays null."""
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


@F.pandas_udf(T.LongType())
def graphemes(s: pd.Series) -> pd.Series:
    """Number of extended grapheme clusters; 0 for null."""
    cluster = regex.compile(r"\X")
    return s.map(lambda v: 0 if not v else sum(1 for _ in cluster.finditer(v)))


@F.pandas_udf(T.LongType())
def fnv1a(s: pd.Series) -> pd.Series:
    """64-bit FNV-1a of the UTF-8 bytes, as signed numbers; null stays null. A step takes the next byte of all texts that have one, so the work is that of their bytes."""
    texts = [b"" if v is None else v.encode("utf-8", "surrogatepass") for v in s]
    sizes = np.array([len(t) for t in texts], np.int64)
    longest_first = np.argsort(-sizes, kind="stable")
    raw, sorted_sizes = np.frombuffer(b"".join(texts), np.uint8), sizes[longest_first]
    starts = (np.cumsum(sizes) - sizes)[longest_first]
    hashes = np.full(len(texts), 0xCBF29CE484222325, np.uint64)
    n = np.searchsorted(-sorted_sizes, -np.arange(sorted_sizes[0] if len(texts) else 0), "left")  # how many texts are longer than that
    for i, k in enumerate(n.tolist()):
        hashes[:k] = (hashes[:k] ^ raw[starts[:k] + i]) * np.uint64(0x100000001B3)
    out = np.empty(len(texts), np.uint64)
    out[longest_first] = hashes
    return pd.Series(out.view(np.int64), dtype="Int64").mask(s.isna().to_numpy())
