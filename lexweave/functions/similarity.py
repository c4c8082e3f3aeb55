"""String similarity: the gestalt ratio and its upper bounds, and the set-of-bigrams cosine."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(a: str | None, b: str | None) -> float | None:
    """Gestalt ratio of two strings; the order of the arguments matters. Null when either is null."""
    return None if a is None or b is None else SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def gestalt(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` over Arrow batches; equal pairs within a batch are computed once."""
    known: dict[tuple[str, str], float | None] = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in known:
            known[pair] = ratio(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


def may_exceed(a: Column, b: Column, threshold: float) -> Column:
    """False only where the ratio cannot reach ``threshold``.

    The ratio is twice the matched characters over both lengths. They are at most the shorter length, and what is not
    matched bounds the edit distance from above.
    """
    total = F.length(a) + F.length(b)
    return (2 * F.least(F.length(a), F.length(b)) >= threshold * total) & (F.levenshtein(a, b) <= (1 - threshold) * total + 1e-9)


def bigrams(term: Column) -> Column:
    """The set of two-character grams of a term padded by one space on either side."""
    padded = F.concat(F.lit(" "), term, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 1), lambda i: F.substring(padded, i, F.lit(2))))


def signature(grams: Column) -> Column:
    """64 bits, one set for the cell of each gram."""
    return F.aggregate(grams, F.lit(0).cast("long"), lambda a, g: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(g), F.lit(64)).cast("int"))))


def most_shared(a: Column, a_size: Column, b: Column, b_size: Column) -> Column:
    """An upper bound on what two sets share, by their signatures: every bit that the other lacks stands for a gram it lacks."""
    return F.least(a_size - F.bit_count(a.bitwiseAND(F.bitwise_not(b))), b_size - F.bit_count(b.bitwiseAND(F.bitwise_not(a))))
