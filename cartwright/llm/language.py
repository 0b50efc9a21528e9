"""Language of texts by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers of ``HIDDEN`` units read a text forwards and backwards, in chunks of ``CHUNK`` bytes; a
softmax over both labels every byte with a language, and the mean of the probabilities over all bytes of a
text is its prediction. Trained in numpy by backpropagation through time on windows of documents with a
known language: of at most ``DOCS_PER_LANGUAGE`` documents per language, chosen by hash, ``STRETCH`` characters.

Edge cases: a null text or one without a letter is ``und`` with score 0, as is every text if no row can be
learnt from. Texts are read whole to predict. A null doc_id is not held out, and not learnt from. Repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

HIDDEN = 8
CHUNK = 192
DOCS_PER_LANGUAGE = 300
#: Characters of a document, from its middle, that the fit may see. Predictions read whole texts.
STRETCH = 4000
#: Chunks that run side by side.
BATCH = 2048


class Gates:
    """One direction: weights of the input bytes (a table), of the state, and of the output."""

    def __init__(self, rng: np.random.Generator, labels: int, hidden: int = HIDDEN) -> None:
        self.hidden = hidden
        self.p = {
            "x": rng.normal(0, 0.5, (256, 3 * hidden)).astype("f4"),
            "u": rng.normal(0, 0.3, (hidden, 3 * hidden)).astype("f4"),
            "o": rng.normal(0, 0.3, (hidden, labels)).astype("f4"),
        }

    def states(self, data: np.ndarray, mask: np.ndarray, keep: bool) -> Iterator[tuple]:
        """Per step of ``data`` (steps, rows): the state, and what training needs. Masked rows stay at 0."""
        hidden, p = self.hidden, self.p
        h = np.zeros((data.shape[1], hidden), "f4")
        two = 2 * hidden
        for t in range(len(data)):
            gates = p["x"].take(data[t], axis=0)
            state = h @ p["u"]
            zr = np.tanh(0.5 * (gates[:, :two] + state[:, :two]))
            zr *= 0.5
            zr += 0.5
            candidate = np.tanh(gates[:, two:] + zr[:, hidden:] * state[:, two:])
            before = h
            h = candidate + zr[:, :hidden] * (before - candidate)
            if mask is not None:
                h *= mask[t][:, None]
            yield (h, zr, candidate, before, state[:, two:]) if keep else (h,)


class Network:
    def __init__(self, labels: list[str], seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.ahead, self.back = Gates(rng, len(labels)), Gates(rng, len(labels))
        self.bias = np.zeros(len(labels), "f4")

    def _logits(self, data: np.ndarray, mask: np.ndarray) -> np.ndarray:
        out = np.empty((*data.shape, len(self.labels)), "f4")
        for t, (h,) in enumerate(self.ahead.states(data, None, False)):
            np.matmul(h, self.ahead.p["o"], out=out[t])
        last = len(data) - 1
        part_mask = None if mask.all() else mask[::-1]
        for t, (h,) in enumerate(self.back.states(data[::-1], part_mask, False)):
            out[last - t] += h @ self.back.p["o"]
        return out + self.bias

    def chunk_sums(self, data: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each chunk of the probabilities; ``data`` is (steps, chunks)."""
        mask = (np.arange(len(data))[:, None] < sizes).astype("f4")
        scores = self._logits(data, mask)
        scores -= scores.max(2, keepdims=True)
        np.exp(scores, out=scores)
        scores *= (mask / scores.sum(2))[:, :, None]
        return scores.sum(0)

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Mean probabilities over all bytes of each text."""
        sizes = np.array([len(x) for x in texts], np.int64)
        parts = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(texts)), parts)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
        starts = (np.cumsum(sizes) - sizes)[owner] + number * CHUNK
        left = np.minimum(CHUNK, sizes[owner] - number * CHUNK)
        whole = np.frombuffer(b"".join(texts) + bytes(CHUNK), np.uint8)
        totals = np.zeros((len(texts), len(self.labels)))
        order = np.argsort(-left, kind="stable")
        for i in range(0, len(order), BATCH):
            now = order[i : i + BATCH]
            steps = int(left[now].max())
            data = whole[starts[now][None, :] + np.arange(steps)[:, None]]
            np.add.at(totals, owner[now], self.chunk_sums(data, left[now]))
        return totals / np.maximum(sizes, 1)[:, None]

    def train(self, texts: list[bytes], labels: np.ndarray, steps: int = 300, rows: int = 128, length: int = 64, seed: int = 5) -> None:
        """Adam on random windows, the same number of every language; every position is labelled."""
        rng = np.random.default_rng(seed)
        params = {("a", k): v for k, v in self.ahead.p.items()} | {("b", k): v for k, v in self.back.p.items()} | {("", "bias"): self.bias}
        m = {k: np.zeros_like(v) for k, v in params.items()}
        s = {k: np.zeros_like(v) for k, v in params.items()}
        of = [np.flatnonzero(labels == k) for k in range(len(self.labels))]
        for step in range(1, steps + 1):
            y = rng.integers(0, len(of), rows)
            data = np.zeros((length, rows), np.uint8)
            mask = np.zeros((length, rows), "f4")
            for j, k in enumerate(y):
                text = texts[of[k][rng.integers(len(of[k]))]]
                at = int(rng.integers(max(1, len(text) - length + 1)))
                part = np.frombuffer(text[at : at + length], np.uint8)
                data[: len(part), j], mask[: len(part), j] = part, 1
            grads = self._gradients(data, mask, y)
            for k, g in grads.items():
                np.clip(g, -1, 1, out=g)
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.001 * (g * g - s[k])
                params[k] -= 0.02 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def _gradients(self, data: np.ndarray, mask: np.ndarray, y: np.ndarray) -> dict:
        scores = self._logits(data, mask)
        scores -= scores.max(2, keepdims=True)
        p = np.exp(scores)
        p /= p.sum(2, keepdims=True)
        p[:, np.arange(len(y)), y] -= 1
        d_out = (p * (mask / mask.sum())[:, :, None]).astype("f4")
        grads = {("", "bias"): d_out.sum((0, 1))}
        for name, gates, flip in (("a", self.ahead, False), ("b", self.back, True)):
            d, x, k = (d_out[::-1], data[::-1], mask[::-1]) if flip else (d_out, data, mask)
            for part, g in self._through_time(gates, x, k, d).items():
                grads[name, part] = g
        return grads

    @staticmethod
    def _through_time(gates: Gates, data: np.ndarray, mask: np.ndarray, d_out: np.ndarray) -> dict:
        n = gates.hidden
        kept = list(gates.states(data, mask, True))
        g = {k: np.zeros_like(v) for k, v in gates.p.items()}
        d_h = np.zeros((data.shape[1], n), "f4")
        for t in range(len(data) - 1, -1, -1):
            h, zr, candidate, before, state = kept[t]
            z, r = zr[:, :n], zr[:, n:]
            g["o"] += h.T @ d_out[t]
            d = (d_h + d_out[t] @ gates.p["o"].T) * mask[t][:, None]
            d_c = d * (1 - z) * (1 - candidate * candidate)
            d_z = d * (before - candidate) * z * (1 - z)
            d_r = d_c * state * r * (1 - r)
            d_x = np.concatenate([d_z, d_r, d_c], 1)
            d_s = np.concatenate([d_z, d_r, d_c * r], 1)
            np.add.at(g["x"], data[t], d_x)
            g["u"] += before.T @ d_s
            d_h = d * z + d_s @ gates.p["u"].T
        return g


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1


def sample(docs: DataFrame, most: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """lang, doc_id and a stretch of the text of at most ``most`` different documents per language.

    The ones with the smallest hashes of id and text are taken. A first cut by hash leaves about twice as many
    per language, so no task ranks more, however many rows or tasks there are; equal rows become one
    before they are ranked.
    """
    usable = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & F.coalesce(~held_out(F.col("doc_id")), F.lit(False)))
    # A stretch from the middle of each document is enough for random windows of 64 bytes.
    begin = F.greatest(F.lit(1), (F.length("text") / 2 - STRETCH / 2).cast("int"))
    marked = usable.select("lang", "doc_id", F.xxhash64("doc_id", "text").alias("h"), F.substring(F.col("text"), begin, F.lit(STRETCH)).alias("part"))
    sizes = marked.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    # One row per language, as many as the network has outputs; where a language has few documents the cut keeps all.
    place = (F.col("h") / 2.0**63 + 1) / 2
    near = marked.join(F.broadcast(sizes), "lang").where(place <= F.lit(2.0 * most + 50) / F.col("n"))
    single = near.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"), F.min("part").alias("part"))
    ranked = single.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    return ranked.where(F.col("n") <= most).select("lang", "doc_id", "part")


def trained(docs: DataFrame) -> Network | None:
    """Fitted on a sample of the rows with text and language that are not held out."""
    rows = sorted((r["lang"], r["doc_id"], r["part"]) for r in sample(docs).collect())
    if not rows:
        return None
    labels = sorted({r[0] for r in rows})
    network = Network(labels)
    number = {x: i for i, x in enumerate(labels)}
    network.train([r[2].encode() for r in rows], np.array([number[r[0]] for r in rows]))
    return network


def languages(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    ship(docs.sparkSession)
    network = network or trained(docs)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                texts = [x or "" for x in batch.column("text").to_pylist()]
                names, scores = ["und"] * len(texts), np.zeros(len(texts))
                rows = [i for i, x in enumerate(texts) if any(c.isalpha() for c in x)] if network else []
                if rows:
                    p = network.texts([texts[i].encode() for i in rows])
                    best = p.argmax(1)
                    for i, b, q in zip(rows, best, p):
                        names[i], scores[i] = network.labels[b], min(1.0, float(q[b]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(predict, f"doc_id {id_type}, lang_pred string, score double")
    return made.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
