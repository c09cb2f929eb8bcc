"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes of the lower-cased text in both directions, labels every position, and a document's
probabilities are the mean over its letters. It is trained here, in numpy, by backpropagation through time on windows of a bounded
sample of labelled rows. Gates are clipped lines instead of logistic curves: the same cell at a fraction of the cost.

A text is read whole, in segments of CORE bytes with CONTEXT bytes around them to settle the state, many segments at a time; beyond
either end of a text there are zero bytes, in training too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HIDDEN = 10
CORE, CONTEXT = 464, 24
#: Segments computed together; positions of a batch of segments bound the memory.
BATCH = 512
#: Labelled rows learnt from, at most about this many, and the bytes and windows taken of each.
TRAIN_ROWS, TRAIN_CHARS = 6_000, 2_000
STEPS, TRAIN_BATCH, TRAIN_LENGTH, RATE = 700, 128, 72, 0.01
#: Texts without a letter, and null texts.
UNDETERMINED = "und"
LETTER = re.compile(r"[^\W\d_]")
#: Slope of a clipped line beyond its ends when gradients pass, and the most a state's gradient may be at one position.
LEAK, CLIP = 0.01, 0.003

_LETTER_BYTES = np.zeros(256, np.float32)
_LETTER_BYTES[np.r_[97:123, 65:91, 128:256]] = 1


@dataclass
class Direction:
    """One direction's cell: tables of the input's part of gates and candidate by byte, and recurrent weights."""

    gates: np.ndarray  # 256 x 2h: update, reset
    cand: np.ndarray  # 256 x h
    u_gates: np.ndarray  # h x 2h
    u_cand: np.ndarray  # h x h

    def run(self, data: np.ndarray) -> np.ndarray:
        """States after each byte; data is time x batch."""
        steps, batch = data.shape
        h = self.u_cand.shape[0]
        out = np.zeros((steps + 1, batch, h), np.float32)
        for t in range(steps):
            g = self.gates[data[t]]
            g += out[t] @ self.u_gates
            np.clip(g, 0, 1, out=g)
            n = out[t] @ self.u_cand
            n *= g[:, h:]
            n += self.cand[data[t]]
            np.clip(n, -1, 1, out=n)
            np.subtract(out[t], n, out=out[t + 1])
            out[t + 1] *= g[:, :h]
            out[t + 1] += n
        return out[1:]

    def forward(self, data: np.ndarray) -> tuple[np.ndarray, list]:
        steps, batch = data.shape
        h = self.u_cand.shape[0]
        state, kept, out = np.zeros((batch, h), np.float32), [], np.zeros((steps, batch, h), np.float32)
        for t in range(steps):
            a = self.gates[data[t]] + state @ self.u_gates
            g = np.clip(a, 0, 1)
            m = state @ self.u_cand
            c = self.cand[data[t]] + g[:, h:] * m
            n = np.clip(c, -1, 1)
            kept.append((state, a, g, m, c, n))
            state = n + g[:, :h] * (state - n)
            out[t] = state
        return out, kept

    def backward(self, data: np.ndarray, kept: list, d_out: np.ndarray) -> list[np.ndarray]:
        """Gradients of the four arrays, through time."""
        h = self.u_cand.shape[0]
        grads = [np.zeros_like(x) for x in self.arrays()]
        d_state = np.zeros_like(kept[0][0])
        d_gates, d_cand = np.zeros((*data.shape, 2 * h), np.float32), np.zeros((*data.shape, h), np.float32)
        for t in range(len(kept) - 1, -1, -1):
            state, a, g, m, c, n = kept[t]
            d = d_state + d_out[t]
            z, r = g[:, :h], g[:, h:]
            dc = d * (1 - z) * np.where(np.abs(c) < 1, 1, LEAK)
            dg = np.concatenate([d * (state - n), dc * m], axis=1) * np.where((a > 0) & (a < 1), 1, LEAK)
            dm = dc * r
            d_state = np.clip(d * z + dm @ self.u_cand.T + dg @ self.u_gates.T, -CLIP, CLIP)
            grads[2] += state.T @ dg
            grads[3] += state.T @ dm
            d_gates[t], d_cand[t] = dg, dc
        flat = data.ravel()
        for grad, part in ((grads[0], d_gates), (grads[1], d_cand)):
            part = part.reshape(len(flat), -1)
            for k in range(part.shape[1]):
                grad[:, k] = np.bincount(flat, part[:, k], 256)
            grad[0] = 0
        return grads

    def arrays(self) -> list[np.ndarray]:
        return [self.gates, self.cand, self.u_gates, self.u_cand]


@dataclass
class Model:
    langs: list[str]
    ahead: Direction
    back: Direction
    w_ahead: np.ndarray
    w_back: np.ndarray
    bias: np.ndarray

    def position_probabilities(self, data: np.ndarray) -> np.ndarray:
        """time x batch bytes -> time x batch x langs."""
        a, b = self.ahead.run(data), self.back.run(data[::-1])[::-1]
        logits = a @ self.w_ahead
        logits += b @ self.w_back
        logits += self.bias
        logits -= logits.max(axis=2, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=2, keepdims=True)
        return logits

    def documents(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, probability) of each whole text."""
        pooled = np.zeros((len(texts), len(self.langs)))
        segments: list[tuple[int, bytes, int]] = []
        out: list[tuple[str, float]] = []
        for i, text in enumerate(texts):
            body = text.lower().encode("utf-8", "surrogatepass") if text and self.langs and LETTER.search(text) else b""
            padded = bytes(CONTEXT) + body + bytes(CONTEXT)
            for at in range(0, len(body), CORE):
                segments.append((i, padded[at : at + CORE + 2 * CONTEXT], min(CORE, len(body) - at)))
                if len(segments) == 4 * BATCH:
                    self._pool(segments, pooled)
                    segments = []
        self._pool(segments, pooled)
        for row in pooled:
            total = row.sum()
            k = int(row.argmax()) if total else 0
            out.append((self.langs[k], round(float(row[k] / total), 5)) if total else (UNDETERMINED, 0.0))
        return out

    def _pool(self, segments: list[tuple[int, bytes, int]], pooled: np.ndarray) -> None:
        segments = sorted(segments, key=lambda s: len(s[1]))
        for at in range(0, len(segments), BATCH):
            part = segments[at : at + BATCH]
            length = len(part[-1][1])
            data = np.frombuffer(b"".join(s[1].ljust(length, b"\0") for s in part), np.uint8).reshape(len(part), length)
            data = np.ascontiguousarray(data.T)
            p = self.position_probabilities(data)  # time x batch x langs
            weight = _LETTER_BYTES[data]
            weight[:CONTEXT] = 0
            weight[np.arange(length)[:, None] >= CONTEXT + np.array([s[2] for s in part])] = 0
            np.add.at(pooled, [s[0] for s in part], np.einsum("tbk,tb->bk", p, weight))


def _fresh(rng: np.random.Generator, langs: list[str], hidden: int) -> Model:
    def direction() -> Direction:
        gates = rng.normal(0, 0.3, (256, 2 * hidden)) + 0.5
        gates[:, :hidden] += 0.25
        cand = rng.normal(0, 0.5, (256, hidden))
        gates[0], cand[0] = -1e6, 0  # a zero byte resets the state, so that padding of any length is the same
        return Direction(*(x.astype(np.float32) for x in (gates, cand, rng.normal(0, 0.2, (hidden, 2 * hidden)), rng.normal(0, 0.4, (hidden, hidden)))))

    k = len(langs)
    return Model(langs, direction(), direction(), *(rng.normal(0, 0.3, (hidden, k)).astype(np.float32) for _ in range(2)), np.zeros(k, np.float32))


def fit(texts: list[str], labels: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 11) -> Model:
    """Trains on windows of the texts, every language as often as the others. Without texts there is no language to predict."""
    rng, langs = np.random.default_rng(seed), sorted(set(labels))
    model = _fresh(rng, langs, hidden)
    if not langs:
        return model
    bodies: dict[str, list[bytes]] = {}
    for text, label in sorted(zip(texts, labels, strict=True)):
        bodies.setdefault(label, []).append(text.lower().encode("utf-8", "surrogatepass"))
    arrays = [*model.ahead.arrays(), *model.back.arrays(), model.w_ahead, model.w_back, model.bias]
    first, second = [np.zeros_like(x) for x in arrays], [np.zeros_like(x) for x in arrays]
    for step in range(1, steps + 1):
        picks = rng.integers(0, len(langs), TRAIN_BATCH)
        windows = []
        for k in picks:
            own = bodies[langs[k]][int(rng.integers(len(bodies[langs[k]])))]
            at = int(rng.integers(-CONTEXT, max(1, len(own) - TRAIN_LENGTH + CONTEXT)))
            part = bytes(max(0, -at)) + own[max(0, at) : at + TRAIN_LENGTH]
            windows.append(part.ljust(TRAIN_LENGTH, b"\0"))
        data = np.frombuffer(b"".join(windows), np.uint8).reshape(TRAIN_BATCH, TRAIN_LENGTH).T.copy()
        a, kept_a = model.ahead.forward(data)
        b, kept_b = model.back.forward(data[::-1].copy())
        logits = a @ model.w_ahead + b[::-1] @ model.w_back + model.bias
        e = np.exp(logits - logits.max(axis=2, keepdims=True))
        d = e / e.sum(axis=2, keepdims=True)
        d[:, np.arange(TRAIN_BATCH), picks] -= 1
        weight = _LETTER_BYTES[data]
        d *= (weight / max(weight.sum(), 1))[:, :, None]
        grads = model.ahead.backward(data, kept_a, d @ model.w_ahead.T)
        grads += model.back.backward(data[::-1].copy(), kept_b, (d @ model.w_back.T)[::-1])
        grads += [np.einsum("tbh,tbk->hk", a, d), np.einsum("tbh,tbk->hk", b[::-1], d), d.sum(axis=(0, 1))]
        rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        for x, g, m, v in zip(arrays, grads, first, second, strict=True):
            g *= min(1.0, 1.0 / max(norm, 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", holdout_mod: int = 3, holdout: int = 1,
          most: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Fits the network to labelled rows outside the held-out share: about most of them by a hash of id and text, a piece of chars of each."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & (F.crc32(F.col("id").cast("string")) % holdout_mod != holdout))
    n = rows.count()
    if n > most:
        rows = rows.where(F.pmod(F.xxhash64("id", F.length("text")), F.lit(1 << 20)) < int((1 << 20) * most / n))
    start = F.pmod(F.xxhash64("id"), F.greatest(F.length("text") - chars, F.lit(1))).cast("int") + 1
    kept = rows.select(F.substring(F.col("text"), start, F.lit(chars)).alias("piece"), "lang").collect()  # at most about most * chars
    kept = [r for r in kept if LETTER.search(r.piece)]
    return fit([r.piece for r in kept], [r.lang for r in kept])


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", holdout_mod: int = 3, holdout: int = 1) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row: the language of the whole text and its pooled probability.

    Null texts and texts without a letter are und with score 0. Rows are labelled one by one: repeated rows and null ids stay (a null id
    is not held out); an empty table gives an empty result; further columns are not looked at.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = model.documents(part.column(1).to_pylist())
                columns = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "lang_pred", "score"])

    found = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % holdout_mod == holdout, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


#: Documents whose pooled probability is below this are rejected, as are those that are und.
ACCEPT = 0.4


def keep_identified(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """docs without the rows that are und or below accept; all columns, whatever their names, stay, and lang too is as it was. Null texts and
    texts without a letter go; repeated rows and null ids are decided each for itself; an empty table stays empty."""
    fields = docs.schema.names
    at = fields.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                found = model.documents(part.column(at).to_pylist())
                yield part.filter(pa.array([lang != UNDETERMINED and score >= accept for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
