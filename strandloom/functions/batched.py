"""The overlap functions of sequence over Arrow batches: pairs of equal lengths are laid side by side and compared a place at a time.

Each gives what the expression of its name gives; expressions walk the letters of a row one by one. Of a null and a text, distances are null and overlaps 0.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pairs that are compared at once.
ROWS = 4096


def column_letters(texts: list[str]) -> np.ndarray:
    """A column for each text of one length, a row for each place."""
    plain = all(map(str.isascii, texts))
    joined = "".join(texts).encode("ascii" if plain else "utf-32-le")
    return np.frombuffer(joined, np.uint8 if plain else np.uint32).reshape(len(texts), -1).T.copy() if joined else np.zeros((0, len(texts)), np.uint8)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places at which x and y differ, over the shorter."""
    n = min(len(x), len(y))
    return (x[:n] != y[:n]).sum(0, dtype=np.int16 if n < 1 << 15 else np.int64)


def _batched(a: Column, b: Column, kind: str, give: Callable, missing: object = None) -> Column:
    """give on the letters of pairs of equal lengths; missing where one is null."""

    @F.pandas_udf(kind)
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        out, sizes = [missing] * len(left), {}
        left, right = left.tolist(), right.tolist()
        for i, (p, q) in enumerate(zip(left, right, strict=True)):
            if p is not None and q is not None:
                sizes.setdefault((len(p), len(q)), []).append(i)
        for rows in sizes.values():
            for at in range(0, len(rows), ROWS):
                mine = rows[at : at + ROWS]
                found = give(column_letters([left[i] for i in mine]), column_letters([right[i] for i in mine]))
                for i, value in zip(mine, found, strict=True):
                    out[i] = value
        return pd.Series(out, dtype="Int32" if kind == "int" else "boolean")

    return run(a, b)


def hamming(a: Column, b: Column) -> Column:
    return _batched(a, b, "int", lambda x, y: _apart(x, y).tolist())


def _longest(x: np.ndarray, y: np.ndarray, lengths: range, allowed: int, found: np.ndarray) -> np.ndarray:
    """The last of the lengths, ascending, at which the end of x lies on the start of y within the mismatches allowed, else found."""
    for n in lengths:
        if n <= min(len(x), len(y)):
            found = np.where(_apart(x[len(x) - n :], y[:n]) <= allowed, n, found)
    return found


def find_overlap(left: Column, right: Column, allowed: int) -> Column:
    def give(x: np.ndarray, y: np.ndarray) -> list[int]:
        none = np.zeros(x.shape[1], np.int32)
        short = none
        for n in range(min(2 * allowed - 1, len(x), len(y)), allowed - 1, -1):  # the shortest comes last
            short = np.where(_apart(x[len(x) - n :], y[:n]) <= 1, n, short)
        return np.where(short > 0, short, _longest(x, y, range(2 * allowed, min(len(x), len(y)) + 1), allowed, none)).tolist()

    return _batched(left, right, "int", give, 0)


def longest_overlap(left: Column, right: Column, allowed: int, above: int, most: int) -> Column:
    return _batched(left, right, "int", lambda x, y: _longest(x, y, range(above + 1, most + 1), allowed, np.zeros(x.shape[1], np.int32)).tolist(), 0)


def overlap_mismatches(left: Column, right: Column, overlap: int, most: int) -> Column:
    return _batched(left, right, "int", lambda x, y: np.minimum(_apart(x[max(0, len(x) - overlap) :], y[:overlap]), most).tolist(), most)


def first_match(query: Column, seq: Column, allowed: int) -> Column:
    def give(q: np.ndarray, s: np.ndarray) -> list[int]:
        found = np.full(q.shape[1], -1)
        for i in range(len(s) - len(q), -1, -1):
            found = np.where(_apart(q, s[i : i + len(q)]) <= allowed, i, found)
        return found.tolist()

    return _batched(query, seq, "int", give)


def shares_window(a: Column, b: Column, length: int, allowed: int) -> Column:
    def give(x: np.ndarray, y: np.ndarray) -> list[bool]:
        found = np.zeros(x.shape[1], bool)
        for i in range(len(x) - length):
            for j in range(len(y) - length + 1):
                found |= _apart(x[i : i + length], y[j : j + length]) <= allowed
        return found.tolist()

    return F.when(F.length(a) > length, _batched(a, b, "boolean", give)).otherwise(F.lit(False))


def mismatches_left(query: Column, seq: Column, shift: int, allowed: int, overlap: int = 0) -> Column:
    def give(q: np.ndarray, s: np.ndarray) -> list[int | None]:
        start = max(-shift, 0)
        n = min(len(q), len(s) - shift) - start
        if n < max(1, overlap):
            return [None] * q.shape[1]
        return [x if x >= 0 else None for x in (allowed - _apart(q[start : start + n], s[start + shift : start + shift + n])).tolist()]

    return _batched(query, seq, "int", give)
