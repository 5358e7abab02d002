"""Hashes: FNV-1a, XXH64 with seed 0, and SHA-256 of canonical JSON."""

from __future__ import annotations

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType, StringType

# Fixed values of FNV-1a (32 bits).
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619


def fnv1a(text: Column) -> Column:
    """``{xxxxxxxx}``: 32-bit FNV-1a of the lower-cased text's UTF-8 bytes."""
    # bytes as characters of the same number
    raw = F.decode(F.encode(F.lower(text), "UTF-8"), "ISO-8859-1")
    bytes_ = F.when(F.length(raw) > 0, F.split(raw, "")).otherwise(F.array().cast("array<string>"))
    h = F.aggregate(bytes_, F.lit(FNV_OFFSET).cast("long"), lambda a, c: (a.bitwiseXOR(F.ascii(c).cast("long")) * FNV_PRIME).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))
    return F.format_string("{%08x}", h)


@pandas_udf(StringType())
def xxh64(text: pd.Series) -> pd.Series:
    """XXH64 of the UTF-8 bytes with seed 0, as 16 hex digits (the built-in function has another seed)."""
    return text.map(lambda t: None if t is None else xxhash.xxh64_hexdigest(t.encode(), seed=0))


@pandas_udf(LongType())
def key_hash(text: pd.Series, bits: pd.Series) -> pd.Series:
    """XXH64 (seed 0) of the lower-cased text, cut to so many bits: keys of binary text tables."""
    return pd.Series([None if t is None else xxhash.xxh64_intdigest(t.lower().encode(), seed=0) & (1 << int(n)) - 1 for t, n in zip(text, bits, strict=True)], dtype="Int64")


def sha_key(*parts: Column) -> Column:
    """SHA-256 of the parts as a compact JSON array: a key made of content."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))), 256)
