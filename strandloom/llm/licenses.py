"""Licence scan by a positional rare-token index.

The index holds, for every word of the licence templates, the templates and places where it stands. Of a file's licence words
those with the highest inverse document frequency over the corpus are looked up, up to a number per template; a word at
place p of the file that stands at place t of a template tells the start p - t. Postings are intersected by these relative
positions: starts on which enough of a template's words agree, within a drift that leaves room for words added or dropped, are
verified by the template's mandatory key phrases and by the share of its words found in order (a longest common subsequence).
Base phrases are short and exact: all of their rarest words must agree on a start, and they are verified word by word.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trimmed
from .license_texts import BASE_PHRASES, TEMPLATES

#: Words of a file that are looked up for a template, how many of them must agree on a start, places by which starts may drift apart, and
#: the share of a template's words that must stand in order.
ANCHORS, VOTES, DRIFT, SHARE = 8, 4, 8, 0.8
#: Bytes of a text whose words are held at once.
PIECE_BYTES = 1 << 20
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_BLANK = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]")


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]  # the words of each mandatory phrase
    base: bool


def templates(table: list[tuple[str, str, list[str]]] = TEMPLATES) -> list[Template]:
    """The base phrases and the templates of a table of label, text and mandatory phrases."""
    out = [Template(label, tuple(phrase.encode().split()), (), True) for phrase, label in BASE_PHRASES.items()]
    for label, text, keys in table:
        words = tuple(text.encode().translate(_WORD_BYTES).split())
        out.append(Template(label, words, tuple(tuple(k.encode().translate(_WORD_BYTES).split()) for k in keys), False))
    return out


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of the text, a bounded number of bytes at a time, cut between words."""
    at = 0
    while at < len(text) or not at:
        blank = _BLANK.search(text, at + PIECE_BYTES) if len(text) - at > PIECE_BYTES else None
        end = blank.start() if blank else len(text)
        yield text[at:end].translate(_WORD_BYTES).split()
        at = max(end, 1)


@dataclass
class Scan:
    n_words: int = 0
    base: list | None = None  # label, start
    found: dict | None = None  # label: best score


def in_order(template: tuple[bytes, ...], words: list[bytes]) -> int:
    """Length of the longest common subsequence, by one addition of long numbers per word."""
    places: dict[bytes, int] = defaultdict(int)
    for i, w in enumerate(template):
        places[w] |= 1 << i
    full = (1 << len(template)) - 1
    row = full
    for w in words:
        if met := row & places.get(w, 0):
            row = (row + met | row - met) & full
    return len(template) - row.bit_count()


def holds(words: list[bytes], phrase: tuple[bytes, ...]) -> bool:
    n = len(phrase)
    return any(words[i] == phrase[0] and tuple(words[i : i + n]) == phrase for i in range(len(words) - n + 1))


def agreeing(starts: list[tuple[int, bytes]], votes: int, drift: int) -> Iterator[int]:
    """Starts in sorted (start, word) around which so many different words lie within the drift."""
    low, high, inside = 0, 0, Counter()
    for at in sorted({s for s, _ in starts}):
        while high < len(starts) and starts[high][0] <= at + drift:
            inside[starts[high][1]] += 1
            high += 1
        while starts[low][0] < at - drift:
            inside[starts[low][1]] -= 1
            if not inside[starts[low][1]]:
                del inside[starts[low][1]]
            low += 1
        if len(inside) >= votes:
            yield at


class Index:
    """Places of all words in the templates, with the words' inverse document frequency."""

    def __init__(self, frequency: dict[bytes, int], total: int, table: list[tuple[str, str, list[str]]] = TEMPLATES) -> None:
        self.templates = templates(table)
        self.longest = max(len(t.words) for t in self.templates) + 2 * DRIFT
        self.idf = {w: math.log((total + 1) / (frequency.get(w, 0) + 1)) for t in self.templates for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.base: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.needed = []
        for n, t in enumerate(self.templates):
            rare = sorted(set(t.words), key=lambda w: (-self.idf[w], w))
            chosen = rare[:2] if t.base else rare
            for place, word in enumerate(t.words):
                if word in chosen:
                    (self.base if t.base else self.postings)[word].append((n, place))
            self.needed.append(sum(w in chosen for w in t.words) if t.base else min(VOTES, (len(rare) + 1) // 2))
        self.order = sorted(self.postings, key=lambda w: (-self.idf[w], w))
        self.base_words, self.words = frozenset(self.base), frozenset(self.postings)
        self.in_template = [frozenset(t.words) for t in self.templates]

    def _base(self, words: list[bytes], last: int) -> Iterator[tuple[int, int]]:
        votes: Counter = Counter()
        for i, w in enumerate(words):
            if w in self.base_words:
                votes.update((n, i - place) for n, place in self.base[w])
        for (n, start), v in votes.items():
            t = self.templates[n]
            if v >= self.needed[n] and 0 <= start < last and tuple(words[start : start + len(t.words)]) == t.words:
                yield n, start

    def _anchors(self, present: frozenset[bytes]) -> dict[bytes, list[int]]:
        """Of the file's licence words the rarest, up to ANCHORS a template: word and the templates it is looked up for."""
        able = [not t.base and len(present & self.in_template[n]) >= max(self.needed[n], math.ceil(SHARE * len(self.in_template[n]) / 2)) for n, t in enumerate(self.templates)]
        out: dict[bytes, list[int]] = {}
        if any(able):
            taken = [0] * len(self.templates)
            for w in self.order:
                if w in present:
                    for n in {n for n, _ in self.postings[w]}:
                        if able[n] and taken[n] < ANCHORS:
                            taken[n] += 1
                            out.setdefault(w, []).append(n)
        return out

    def score(self, n: int, start: int, words: list[bytes]) -> float:
        """Share of the template's words that stand in order around the start; 0 below SHARE or without a mandatory phrase."""
        t = self.templates[n]
        there = words[max(0, start - DRIFT) : max(0, start + len(t.words) + DRIFT)]
        share = in_order(t.words, there) / len(t.words)
        return share if share >= SHARE and all(holds(there, k) for k in t.keys) else 0.0

    def _templates(self, words: list[bytes]) -> Iterator[tuple[int, float]]:
        anchors = self._anchors(self.words.intersection(words))
        starts: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for i, w in enumerate(words if anchors else ()):
            if w in anchors:
                for n, place in self.postings[w]:
                    if n in anchors[w]:
                        starts[n].append((i - place, w))
        for n, found in starts.items():
            best = 0.0
            for start in agreeing(sorted(found), self.needed[n], DRIFT):
                if best < 1:
                    best = max(best, self.score(n, start, words))
            if best:
                yield n, best

    def scan(self, text: bytes) -> Scan:
        out, carry, offset = Scan(0, [], {}), [], 0
        parts = pieces(text)
        part = next(parts)
        while part is not None:
            after = next(parts, None)
            words = carry + part
            out.n_words += len(part)
            last = len(words) if after is None else max(0, len(words) - self.longest + 1)  # later starts see their words in the next round
            if not self.base_words.isdisjoint(words):
                for n, start in self._base(words, last):
                    out.base.append((self.templates[n].label, offset + start))
                    out.found[self.templates[n].label] = 1.0
            for n, share in self._templates(words):
                label = self.templates[n].label
                out.found[label] = max(out.found.get(label, 0.0), share)
            carry, offset, part = words[last:], offset + last, after
        return out


def word_frequencies(docs: DataFrame, table: list[tuple[str, str, list[str]]] = TEMPLATES) -> tuple[dict[bytes, int], int]:
    """Over all texts of docs: documents that hold each word of the templates, and the number of documents.

    Tasks send counts of the template vocabulary only, whose size is fixed.
    """
    vocabulary = frozenset(w for t in templates(table) for w in t.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                counts[b""] += 1
                counts.update(set().union(*(vocabulary.intersection(p) for p in pieces(text.as_py() or b""))))
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(trimmed(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {bytes(r.word): r.n for r in rows}
    return counts, counts.pop(b"", 0)


def scan_licenses(docs: DataFrame, table: list[tuple[str, str, list[str]]] = TEMPLATES) -> DataFrame:
    """For every row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    Words are runs of ASCII digits, letters (A-Z lowered) and bytes from 128. n_base counts all places of
    base phrases, table has label, text and mandatory phrases of the longer templates, first_word and last_word are their smallest and largest start (null without any);
    base_labels and labels are distinct, sorted and comma-joined (empty without any), labels with those of the longer
    templates; score is the best share of a template's words that stand in order, 1 for a base phrase, 0 without a label. Null
    texts count as empty; repeated rows are scanned each; other columns are ignored; no rows give no rows. Long texts
    are scanned in overlapping parts, so no place is lost.
    """
    frequency, total = word_frequencies(docs, table)
    sent = docs.sparkSession.sparkContext.broadcast((frequency, total, table))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*sent.value)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                s = index.scan(text.as_py() or b"")
                starts = [start for _, start in s.base]
                rows.append((doc_id, s.n_words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for x, _ in s.base})), ",".join(sorted(s.found)), max(s.found.values(), default=0.0)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), schema)
