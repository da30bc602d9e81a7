"""Language identification by a bidirectional gated recurrent network over bytes.

Each byte indexes learned gate inputs; one recurrence runs forwards and one backwards over windows of
the text, a softmax labels every position, and a document's probabilities are the mean over all
its positions. Training is backpropagation through time in numpy on a bounded, balanced sample; prediction
covers whole texts, window by window, many windows at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, materialize, trimmed

HIDDEN, WINDOW, ROWS = 8, 128, 2048
#: The sample: at most so many documents, balanced over languages, and so many windows of so many bytes of each.
SAMPLE_DOCS, SAMPLE_WINDOWS, SAMPLE_BYTES = 3000, 4, 64
STEPS, BATCH, RATE, SEED = 450, 256, 0.02, 11
UNDETERMINED = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


@dataclass
class ByteBiGru:
    """Weights per direction d (f, b): x (3H, 256) gate inputs of a byte, u (3H, H) recurrence; v (C, 2H) and c (C, 1) for labels.

    Gates stand in the order update, reset, candidate.
    """

    labels: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, labels: list[str], hidden: int = HIDDEN) -> ByteBiGru:
        rng = np.random.default_rng(SEED)
        w = {}
        for d in "fb":
            w["x" + d] = rng.normal(0, 0.3, (3 * hidden, 256))
            w["u" + d] = rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden))
        w["v"], w["c"] = rng.normal(0, 0.3, (len(labels), 2 * hidden)), np.zeros((len(labels), 1))
        return cls(labels, {k: v.astype(np.float32) for k, v in w.items()})

    def _forward(self, text: np.ndarray, d: str) -> list[tuple]:
        """States of a training batch text (T, B) in the direction's order, with what the backward pass needs."""
        x, u = self.weights["x" + d], self.weights["u" + d]
        n = u.shape[1]
        h = np.zeros((n, text.shape[1]), np.float32)
        out = []
        for t in range(len(text)) if d == "f" else range(len(text) - 1, -1, -1):
            g, s = x[:, text[t]], u @ h
            gates = _sigmoid(g[: 2 * n] + s[: 2 * n])
            z, r = gates[:n], gates[n:]
            cand = np.tanh(g[2 * n :] + r * s[2 * n :])
            out.append((t, h, z, r, cand, s[2 * n :]))
            h = cand + z * (h - cand)
            out[-1] += (h,)
        return out

    def gradients(self, text: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over positions and its gradients for windows text (T, B) with labels (B,)."""
        w, (steps, b) = self.weights, text.shape
        n = w["uf"].shape[1]
        runs = {d: sorted(self._forward(text, d)) if d == "b" else self._forward(text, d) for d in "fb"}
        runs = {d: {r[0]: r for r in runs[d]} for d in "fb"}
        grads = {k: np.zeros_like(v) for k, v in w.items()}
        into = {d: {} for d in "fb"}
        loss = 0.0
        for t in range(steps):
            h = np.concatenate([runs["f"][t][6], runs["b"][t][6]])
            a = w["v"] @ h + w["c"]
            a -= a.max(0)
            p = np.exp(a)
            p /= p.sum(0)
            loss -= np.log(np.maximum(p[label, np.arange(b)], 1e-12)).mean()
            p[label, np.arange(b)] -= 1
            p /= b * steps
            grads["v"] += p @ h.T
            grads["c"] += p.sum(1, keepdims=True)
            back = w["v"].T @ p
            into["f"][t], into["b"][t] = back[:n], back[n:]
        for d in "fb":
            u, dh = w["u" + d], np.zeros((n, b), np.float32)
            for t in range(steps - 1, -1, -1) if d == "f" else range(steps):
                _, h, z, r, cand, s, _ = runs[d][t]
                dh = dh + into[d][t]
                dc = dh * (1 - z) * (1 - cand * cand)
                da = np.concatenate([dh * (h - cand) * z * (1 - z), dc * s * r * (1 - r), dc])
                ds = np.concatenate([da[: 2 * n], dc * r])
                grads["u" + d] += ds @ h.T
                for gate in range(3 * n):
                    grads["x" + d][gate] += np.bincount(text[t], da[gate], 256)
                dh = dh * z + u.T @ ds
        return loss / steps, grads

    def train(self, windows: np.ndarray, label: np.ndarray, steps: int = STEPS, rate: float = RATE) -> ByteBiGru:
        """Adam over batches of windows (N, T); the rate falls to a tenth."""
        rng = np.random.default_rng(SEED)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        s = {k: np.zeros_like(v) for k, v in self.weights.items()}
        for i in range(1, steps + 1):
            at = rng.integers(0, len(windows), BATCH)
            _, grads = self.gradients(np.ascontiguousarray(windows[at].T), label[at])
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.99 * s[k] + 0.01 * g * g
                self.weights[k] -= (rate * 0.1 ** (i / steps)) * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.99**i)) + 1e-6)
            self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}
        return self

    def _steps(self, text: np.ndarray, active: list[int], d: str) -> Iterator[tuple[int, np.ndarray]]:
        """Position and states (H, active windows) over text (T, B), windows sorted by falling length."""
        x, u = self.weights["x" + d], self.weights["u" + d]
        n = u.shape[1]
        h = np.zeros((n, text.shape[1]), np.float32)
        for t in range(len(text)) if d == "f" else range(len(text) - 1, -1, -1):
            k = active[t]
            now = h[:, :k]
            g, s = np.take(x, text[t, :k], axis=1), u @ now
            g[: 2 * n] += s[: 2 * n]
            gates = _sigmoid(g[: 2 * n])
            s[2 * n :] *= gates[n:]
            cand = g[2 * n :]
            cand += s[2 * n :]
            np.tanh(cand, out=cand)
            now -= cand
            now *= gates[:n]
            now += cand
            yield t, now

    def window_sums(self, windows: list[bytes]) -> np.ndarray:
        """Sum over positions of the label probabilities, (windows, labels)."""
        sizes = np.fromiter(map(len, windows), np.int64, len(windows))
        order = np.argsort(-sizes, kind="stable")
        steps = int(sizes.max(initial=0))
        text = np.zeros((len(windows), steps), np.uint8)
        for row, i in enumerate(order):
            text[row, : sizes[i]] = np.frombuffer(windows[i], np.uint8)
        text = np.ascontiguousarray(text.T)
        active = [int(a) for a in np.searchsorted(-sizes[order], -np.arange(steps), side="left")]
        n = self.weights["uf"].shape[1]
        vf, vb = np.ascontiguousarray(self.weights["v"][:, :n]), np.ascontiguousarray(self.weights["v"][:, n:])
        later = [None] * steps
        for t, h in self._steps(text, active, "b"):
            later[t] = vb @ h
        sums = np.zeros((len(self.labels), len(windows)), np.float32)
        for t, h in self._steps(text, active, "f"):
            a = vf @ h
            a += later[t]
            a += self.weights["c"]
            a -= a.max(0)
            np.exp(a, out=a)
            a /= a.sum(0)
            sums[:, : active[t]] += a
        out = np.empty((len(windows), len(self.labels)))
        out[order] = sums.T
        return out

    def predict(self, texts: list[bytes]) -> list[tuple[str, float]]:
        """Label and mean probability of each text; no letter: undetermined, 0."""
        totals = np.zeros((len(texts), len(self.labels)))
        held: list[bytes] = []
        owner: list[int] = []

        def flush() -> None:
            if held:
                np.add.at(totals, owner, self.window_sums(held))
                held.clear()
                owner.clear()

        known = [has_letter(t) and bool(self.labels) for t in texts]
        for i, t in enumerate(texts):
            if known[i]:
                for at in range(0, len(t), WINDOW):
                    held.append(t[at : at + WINDOW])
                    owner.append(i)
                    if len(held) == ROWS:
                        flush()
        flush()
        out = []
        for i, t in enumerate(texts):
            best = int(totals[i].argmax()) if known[i] else 0
            out.append((self.labels[best], min(1.0, float(totals[i][best] / len(t)))) if known[i] else (UNDETERMINED, 0.0))
        return out


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def share_of_each(sizes: list[int], total: int) -> int | None:
    """The least share with sum(min(size, share)) of total or more; None when all sizes together are less."""
    left, rest = total, sorted(sizes)
    while rest:
        if rest[0] * len(rest) >= left:
            return -(-left // len(rest))
        left -= rest.pop(0)
    return None


def learn(docs: DataFrame, learnable: Column, sample_docs: int = SAMPLE_DOCS, steps: int = STEPS) -> ByteBiGru:
    """A network for the lang values among rows of docs (doc_id, text, lang) where learnable holds.

    The sample has at most sample_docs rows, drawn by a hash of doc_id against the count of the row's language, so that
    languages come out about even; of each, SAMPLE_WINDOWS windows of SAMPLE_BYTES bytes spread over the text.
    """
    rows = docs.where(learnable & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = materialize(rows.groupBy("lang").agg(F.count("*").alias("n")), "languages")
    sizes = {r.lang: r.n for r in counts.collect()}
    labels = sorted(sizes)
    if not labels:
        return ByteBiGru([])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 40)).cast("decimal(20,0)") * F.col("n")
    spread = [F.substring(F.col("text").cast("binary"), (F.octet_length("text") * i / SAMPLE_WINDOWS + 1).cast("int"), F.lit(SAMPLE_BYTES)) for i in range(SAMPLE_WINDOWS)]
    sample = rows.join(F.broadcast(counts), "lang").select("lang", "doc_id", drawn.alias("key"), F.array(*spread).alias("parts"))
    if (most := share_of_each(list(sizes.values()), sample_docs + sample_docs // 4 + 64)) is not None:  # else each task would send its best sample_docs rows
        sample = sample.where(F.col("key") < F.expr(f"{most << 40}BD"))
    sample = sample.orderBy("key", "doc_id", "lang").limit(sample_docs)
    windows, label = [], []
    for r in sorted(sample.collect(), key=lambda r: (r.key, repr(r.doc_id), r.lang, r.parts)):
        for p in r.parts:
            windows.append((bytes(p) * SAMPLE_BYTES)[:SAMPLE_BYTES] if p else b" " * SAMPLE_BYTES)
            label.append(labels.index(r.lang))
    model = ByteBiGru.fresh(labels).train(np.frombuffer(b"".join(windows), np.uint8).reshape(len(windows), SAMPLE_BYTES), np.array(label), steps)
    give_back()
    return model


def with_languages(docs: DataFrame, model: ByteBiGru) -> DataFrame:
    """docs with the columns lang_pred and score; every column passes through as it is."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = sent.value.predict([t.as_py() or b"" for t in part.column(at).cast(pa.binary())])
                more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(trimmed(run), T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def predict_languages(docs: DataFrame, model: ByteBiGru) -> DataFrame:
    """doc_id, lang_pred and score for every row of docs (doc_id, text).

    A null text or one without a letter is undetermined with score 0; repeated rows are predicted each; no rows give no
    rows; only the text is looked at, all of it.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, size = [], [], 0
            for d, t in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                ids.append(d.as_py())
                texts.append(t.as_py() or b"")
                size += len(texts[-1])
                if size >= 1 << 20:
                    yield _predicted(ids, sent.value.predict(texts))
                    ids, texts, size = [], [], 0
            if ids:
                yield _predicted(ids, sent.value.predict(texts))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(trimmed(run), "doc_id long, lang_pred string, score double")


def _predicted(ids: list, found: list[tuple[str, float]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))
