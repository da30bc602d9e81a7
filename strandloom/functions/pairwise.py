"""Pairwise alignment where no built-in expression exists: Arrow-batched functions over numpy rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

NEVER = -(10**9)
#: Cells of a matrix of aligned pairs that are held at once, at most, if it is more than one pair.
CELLS = 1 << 21
#: Cells of a row of scores, over all pairs in it.
SCORED = 1 << 14
#: Pairs that go along their diagonals together.
SIDE_BY_SIDE = 1024


def overlap_score(a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -1, least: int | None = None) -> int:
    """Best cell of the alignment matrix with zero borders, linear gaps and no clamp at 0; -1 once least is out of reach.

    A row is one vector step: the run of gaps along it is a running maximum.
    """
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    slope = gap * np.arange(1, len(x) + 1)
    before, best = np.zeros(len(x) + 1, np.int64), 0
    for i, c in enumerate(y, 1):
        here = np.maximum(before[1:] + gap, before[:-1] + np.where(x == c, match, mismatch))
        row = np.maximum(np.maximum.accumulate(here - slope), 0) + slope  # the border before the row is 0
        before = np.concatenate([[0], row])
        best = max(best, int(row.max(initial=0)))
        if least is not None and best + (len(y) + 1 - i) * match < least:
            return -1
    return best


def overlap_score_many(left: list[str | None], right: list[str | None], match: int = 1, mismatch: int = -1, gap: int = -1) -> list[int | None]:
    """overlap_score of each pair, None where one is None; pairs of equal lengths go through their matrices together, a row of all at a time."""
    out: list = [None] * len(left)
    sizes: dict[tuple[int, int], list[tuple[int, bytes, bytes]]] = {}
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        if a is not None and b is not None:
            x, y = a.encode(), b.encode()
            sizes.setdefault((len(x), len(y)), []).append((i, x, y))
    for (n, m), rows in sizes.items():
        step = max(1, SCORED // (n + 1))
        slope = gap * np.arange(1, n + 1, dtype=np.int32)[:, None]
        for at in range(0, len(rows), step):
            mine = rows[at : at + step]
            x, y = (np.frombuffer(b"".join(r[c] for r in mine), np.uint8).reshape(len(mine), -1).T.copy() if k else np.zeros((0, len(mine)), np.uint8) for c, k in ((1, n), (2, m)))
            before, best = np.zeros((n + 1, len(mine)), np.int32), np.zeros(len(mine), np.int32)
            for c in y:
                here = np.maximum(before[1:] + np.int32(gap), before[:-1] + np.where(x == c, np.int32(match), np.int32(mismatch))) - slope
                np.maximum(np.maximum.accumulate(here, axis=0), 0, out=here)  # the border before the row is 0
                before[1:] = here + slope
                np.maximum(best, before.max(axis=0), out=best)
            for r, score in zip(mine, best.tolist(), strict=True):
                out[r[0]] = score
    return out


def similarity_score(a: str, b: str, allowed: int, match: int = 1, mismatch: int = -1, gap: int = -1) -> int:
    """The score if the lengths differ by no more than allowed and it reaches what that many mismatches leave, else 0."""
    apart = abs(len(a) - len(b))
    if apart > allowed:
        return 0
    least = min(len(a), len(b)) * match + allowed * mismatch + apart * gap
    score = overlap_score(a, b, match, mismatch, gap, least)
    return score if score >= least else 0


def similarity_score_many(left: list[str | None], right: list[str | None], allowed: int) -> list[int | None]:
    """similarity_score of each pair, None where one is None; pairs of like length go along their diagonals together.

    An alignment that reaches the score leaves out no more bases than allowed and the difference of lengths, so it stays on so few diagonals.
    """
    out: list = [None if a is None or b is None else 0 for a, b in zip(left, right, strict=True)]
    near = []
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        if a is None or b is None or abs(len(a) - len(b)) > allowed:
            continue
        if a.isascii() and b.isascii():
            near.append((i, a.encode(), b.encode()) if len(a) <= len(b) else (i, b.encode(), a.encode()))
        else:
            out[i] = similarity_score(a, b, allowed)
    near.sort(key=lambda r: len(r[2]))
    low, width = 2 * allowed, 5 * allowed + 1  # diagonals from so many to the left
    at = np.arange(width, dtype=np.int32)[:, None]
    for begin in range(0, len(near), SIDE_BY_SIDE):
        mine = near[begin : begin + SIDE_BY_SIDE]
        n = len(mine[-1][2])
        x = np.full((n, len(mine)), 254, np.uint8)  # what stands outside a text is like nothing
        y = np.full((low + n + width, len(mine)), 255, np.uint8)
        for k, (_, short, long) in enumerate(mine):
            x[: len(short), k] = np.frombuffer(short, np.uint8)
            y[low : low + len(long), k] = np.frombuffer(long, np.uint8)
        row = np.full((width + 1, len(mine)), -(1 << 20), np.int32)  # the last is outside the band
        row[low:width] = 0
        best = np.zeros(len(mine), np.int32)
        for i in range(1, n + 1):
            here = np.maximum(row[:width] + np.where(x[i - 1] == y[i - 1 : i - 1 + width], np.int32(1), np.int32(-1)), row[1:] - 1)
            if i <= low:
                here[low - i] = 0  # the border before the longer text
                here[: low - i] = -(1 << 20)
            row[:width] = np.maximum.accumulate(here + at, axis=0) - at
            np.maximum(best, row[:width].max(axis=0), out=best)
        for (i, short, long), score in zip(mine, best.tolist(), strict=True):
            out[i] = score if score >= len(short) - allowed - (len(long) - len(short)) else 0
    return out


def align(a: str, b: str, mode: str = "global", match: int = 1, mismatch: int = -3, open_: int = 5, extend: int = 2, band: int | None = None) -> tuple[int, int, int, str]:
    """score, start in a, start in b and CIGAR (M, I: only in a, D: only in b) with affine gaps, a gap of n costing open_ + n * extend.

    global aligns both ends; local any parts; extension starts at both starts and ends anywhere. A band leaves out cells further
    from the diagonal.
    """
    return align_many([a], [b], mode, match, mismatch, open_, extend, band)[0]


def align_many(left: list[str], right: list[str], mode: str = "global", match: int = 1, mismatch: int = -3, open_: int = 5, extend: int = 2, band: int | None = None) -> list[tuple[int, int, int, str]]:
    """align of each pair; pairs of equal lengths go through the matrix together, a cell of all at a time, in parts of bounded memory."""
    out: list = [None] * len(left)
    sizes: dict[tuple[int, int], list[int]] = {}
    for i, (a, b) in enumerate(zip(left, right, strict=True)):
        sizes.setdefault((len(a), len(b)), []).append(i)
    for (n, m), rows in sizes.items():
        step = max(1, CELLS // ((n + 1) * (m + 1)))
        for at in range(0, len(rows), step):
            mine = rows[at : at + step]
            h, e, f = _matrices([left[i] for i in mine], [right[i] for i in mine], mode, match, mismatch, open_, extend, band)
            for k, i in enumerate(mine):
                out[i] = _traced(h[..., k], e[..., k], f[..., k], left[i], right[i], mode, match, mismatch, extend)
    return out


def _matrices(left: list[str], right: list[str], mode: str, match: int, mismatch: int, open_: int, extend: int, band: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best scores, those ending in a gap in a (D) and in b (I), of pairs of equal lengths; the last axis is the pair."""
    letters = lambda rows: np.array([[ord(c) for c in s] for s in rows], np.int32).reshape(len(rows), -1).T.copy()
    x, y = letters(left), letters(right)
    n, m = len(x), len(y)
    h = np.full((n + 1, m + 1, len(left)), NEVER, np.int64)
    e, f = h.copy(), h.copy()
    free = mode == "local"
    h[0, 0] = 0
    for j in range(1, m + 1):
        e[0, j] = -open_ - j * extend
        h[0, j] = 0 if free else e[0, j]
    for i in range(1, n + 1):
        f[i, 0] = -open_ - i * extend
        h[i, 0] = 0 if free else f[i, 0]
        lo, hi = (1, m) if band is None else (max(1, i - band), min(m, i + band))
        if lo > hi:
            continue
        cells = slice(lo, hi + 1)
        f[i, cells] = np.maximum(h[i - 1, cells] - open_ - extend, f[i - 1, cells] - extend)
        best = np.maximum(h[i - 1, lo - 1 : hi] + np.where(x[i - 1] == y[lo - 1 : hi], match, mismatch), f[i, cells])
        best = np.maximum(best, 0) if free else best
        for j in range(lo, hi + 1):
            e[i, j] = np.maximum(h[i, j - 1] - open_ - extend, e[i, j - 1] - extend)
            h[i, j] = np.maximum(best[j - lo], e[i, j])
    return h, e, f


def _traced(h: np.ndarray, e: np.ndarray, f: np.ndarray, a: str, b: str, mode: str, match: int, mismatch: int, extend: int) -> tuple[int, int, int, str]:
    n, m, free = len(a), len(b), mode == "local"
    i, j = (n, m) if mode == "global" else np.unravel_index(int(h.argmax()), h.shape)
    score, ops, state = int(h[i, j]), [], "h"
    while i > 0 or j > 0:
        if free and state == "h" and h[i, j] == 0:
            break
        if state == "h":
            if i > 0 and j > 0 and h[i, j] == h[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
                ops.append("M")
                i, j = i - 1, j - 1
            else:
                state = "e" if h[i, j] == e[i, j] else "f"
        elif state == "e":
            ops.append("D")
            state = "e" if j > 1 and e[i, j] == e[i, j - 1] - extend else "h"
            j -= 1
        else:
            ops.append("I")
            state = "f" if i > 1 and f[i, j] == f[i - 1, j] - extend else "h"
            i -= 1
    return score, int(i), int(j), cigar(ops[::-1])


def cigar(ops: list[str]) -> str:
    out, at = "", 0
    while at < len(ops):
        end = at
        while end < len(ops) and ops[end] == ops[at]:
            end += 1
        out += f"{end - at}{ops[at]}"
        at = end
    return out


def parse_cigar(text: str) -> list[tuple[int, str]]:
    out, n = [], ""
    for c in text:
        if c.isdigit():
            n += c
        else:
            out.append((int(n), c))
            n = ""
    return out


def reference_end(pos: int, text: str) -> int:
    """Position after the last base of the reference that the alignment covers."""
    return pos + sum(n for n, op in parse_cigar(text) if op in "MD")


def soft_clip(text: str, trimmed: int, full: int, reverse: bool) -> str:
    """CIGAR of the whole read when only its first trimmed bases were aligned."""
    if trimmed == full:
        return text
    return f"{full - trimmed}S{text}" if reverse else f"{text}{full - trimmed}S"


def tidy_ends(pos: int, text: str) -> tuple[int, str]:
    """Gaps of the reference at the ends go (moving pos at the front), inserted bases there become clipped."""
    parts = parse_cigar(text)
    if parts and parts[0][1] == "D":
        pos, parts = pos + parts[0][0], parts[1:]
    if parts and parts[-1][1] == "D":
        parts = parts[:-1]
    parts = [(n, "S" if op == "I" and i in (0, len(parts) - 1) else op) for i, (n, op) in enumerate(parts)]
    return pos, "".join(f"{n}{op}" for n, op in parts)


def mismatch_string(read: str, ref: str, text: str) -> tuple[str, int]:
    """MD string (runs of matches, reference bases, ^deleted ones) and number of differences; ref starts where the alignment does."""
    out, same, differ, i, j = "", 0, 0, 0, 0
    for n, op in parse_cigar(text):
        if op == "M":
            for _ in range(n):
                if read[i] == ref[j]:
                    same += 1
                else:
                    out += f"{same}{ref[j].upper()}"
                    same, differ = 0, differ + 1
                i, j = i + 1, j + 1
        elif op == "D":
            out += f"{same}^{ref[j : j + n].upper()}"
            same, differ, j = 0, differ + n, j + n
        else:
            differ += n if op == "I" else 0
            i += n
    return f"{out}{same}", differ


def to_colours(seq: str) -> str:
    """Colours 0 to 3 between adjacent bases (exclusive or of their codes), 4 beside an unknown one."""
    code = ["acgt".find(c) for c in seq]
    return "".join("4" if a < 0 or b < 0 else str(a ^ b) for a, b in zip(code, code[1:]))


def from_colours(colours: str, guide: str, quality: list[int] | None = None, change: int = 20) -> str:
    """Bases, one more than colours, that cost least: a colour that is not followed costs its quality, a base unlike the guide's costs change."""
    q = quality or [20] * len(colours)
    cost = [0 if guide[0] == b else change for b in "acgt"]
    back = []
    for i, c in enumerate(colours):
        new, came = [], []
        for b in range(4):
            step = [cost[a] + (0 if c != "4" and a ^ b == int(c) else q[i]) for a in range(4)]
            came.append(min(range(4), key=step.__getitem__))
            new.append(min(step) + (0 if guide[i + 1] == "acgt"[b] else change))
        cost = new
        back.append(came)
    at = min(range(4), key=cost.__getitem__)
    out = [at]
    for came in reversed(back):
        at = came[at]
        out.append(at)
    return "".join("acgt"[b] for b in reversed(out))


def overlap_scores(a: Column, b: Column) -> Column:
    """overlap_score of two columns, in Arrow batches; null for nulls."""

    @F.pandas_udf("int")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(overlap_score_many(list(x), list(y)), dtype="Int32")

    return run(a, b)


def similar(a: Column, b: Column, allowed: int) -> Column:
    """Score of similar sequences, 0 for others; lengths too far apart, and edit distances beyond reach, never get to Python."""

    @F.pandas_udf("int")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(similarity_score_many(list(x), list(y), allowed), dtype="Int32")

    return F.when(F.abs(F.length(a) - F.length(b)) <= allowed, score(a, b)).otherwise(F.lit(0))


def aligned(a: Column, b: Column, mode: str = "global", band: int | None = None) -> Column:
    """Struct of score, a_start, b_start, cigar."""

    @F.pandas_udf("score int, a_start int, b_start int, cigar string")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(align_many(list(x), list(y), mode, band=band), columns=["score", "a_start", "b_start", "cigar"])

    return run(a, b)
