"""Names, phones, profile links and the similarity of names."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from .text import trim_all

#: Fixed values.
BUSINESS_IN_NAME = ["inc", "llc", "corp", "ltd", "company", "technologies", "solutions"]
PHONES = [r"^\+?[1-9][0-9]{1,14}$", r"^\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}$", r"^[0-9]{10,15}$"]
PROFILES = [r"(https?://)?(www\.)?(linkedin\.com/in/[a-zA-Z0-9-]+/?)", r"linkedin\.com/pub/[a-zA-Z0-9-]+", r"linkedin\.com/profile/view\?id="]


def norm_phone(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def phone_valid(c: Column) -> Column:
    t = trim_all(F.coalesce(c, F.lit("")))
    ok = F.lit(False)
    for p in PHONES:
        ok = ok | t.rlike(p)
    return ok


def profile_valid(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit(""))).rlike("|".join(PROFILES))


def split_name(c: Column) -> tuple[Column, Column]:
    """(first, last): the first word, and the rest joined by single spaces."""
    a = F.split(trim_all(F.coalesce(c, F.lit(""))), r"(?U)\s+")
    return F.get(a, F.lit(0)), F.array_join(F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), " ")


def person_like(c: Column) -> Column:
    """Whether a text looks like a person's name: two or more alphabetic words, two of them capitalised, no business word, no mail or web part."""
    t = trim_all(F.coalesce(c, F.lit("")))
    low = F.lower(t)
    words = F.split(t, r"(?U)\s+")
    alpha = F.filter(F.transform(words, lambda w: F.regexp_replace(w, "[.,]", "")), lambda w: w.rlike(r"^\p{L}{2,}$"))
    upper = F.filter(alpha, lambda w: w.rlike(r"^\p{Lu}"))
    plain = ~low.rlike(r"@|\.com|http|www") & ~low.rlike("|".join(BUSINESS_IN_NAME))
    return (F.length(t) >= 3) & plain & (F.size(words) >= 2) & (F.size(alpha) >= 2) & (F.size(upper) >= 2)


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel."""
    at: dict[str, int] = {}
    for i, ch in enumerate(a):
        at[ch] = at.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & at.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def lcs_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """lcs_length of many pairs: the same bits, side by side. Texts of over 63 characters, or with a NUL, go one by one."""
    n = len(a)
    out = np.zeros(n, np.int64)
    wide = np.array([len(x) > 63 or len(y) > 63 or "\0" in x or "\0" in y for x, y in zip(a, b, strict=True)], bool)
    for i in np.flatnonzero(wide):
        out[i] = lcs_length(a[i], b[i])
    rest = np.flatnonzero(~wide)
    for k in range(0, len(rest), 4096):
        own = rest[k : k + 4096]
        x, y = (np.array([t[i] for i in own], "U64").view(np.uint32).reshape(len(own), 64) for t in (a, b))
        full = (np.uint64(1) << np.fromiter((len(a[i]) for i in own), np.uint64, len(own))) - np.uint64(1)
        v = full.copy()
        for j in range(max(len(b[i]) for i in own)):
            at = np.flatnonzero(y[:, j])
            same = np.packbits(x[at] == y[at, j, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
            u = v[at] & same
            v[at] = ((v[at] + u) | (v[at] - u)) & full[at]
        out[own] = np.bitwise_count(full).astype(np.int64) - np.bitwise_count(v).astype(np.int64)
    return out


@pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """100 * 2 LCS / (|a| + |b|); two empty texts are alike."""
    total = (a.str.len() + b.str.len()).to_numpy(float)
    return pd.Series(np.where(total > 0, 200.0 * lcs_lengths(list(a), list(b)) / np.maximum(total, 1), 100.0))
