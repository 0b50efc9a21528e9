"""Secrets in texts: fixed patterns, and a character convolutional network over every other candidate.

Patterns (``assign``, ``access``, ``hex``) give the base findings. Candidates are all runs of 12 or more
characters of credentials that hold a digit. The network sees a candidate with 24 characters before and 8
after it: embedding, convolution of width 5, maximum over positions, one logistic unit. It is trained by
numpy on labelled findings: candidates of the corpus labelled by the patterns (at most ``MOST_LABELLED`` per
label, chosen by hash) and generated ones of common shapes. A candidate that no pattern matches but that looks like a credential
(``credential_like``) is of unknown label: nothing is learnt from it. On a third that is held back its outputs are calibrated by Platt
scaling, and for candidates after an assignment sign and for others the threshold is the highest
that still finds ``RECALL`` of the known secrets (without such ones in the held-back third, that of all), whatever it costs in
precision. ``held`` has recall and precision there. Candidates above it that touch no base span become spans of kind ``cnn``.

Positions are code points, ends exclusive. Edge cases: a null or empty text has no spans; without labelled rows the
network learns from generated findings alone; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartwright.session import settle

from .common import sha256_hex, ship, texts_of

MOST_LABELLED = 3000
RECALL = 0.95
LEFT, BODY, RIGHT = 24, 48, 8
KINDS = ("assign", "access", "hex", "cnn")

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")

_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
_DIGIT = re.compile(r"[0-9]")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end), sorted. A run that is long enough equals the leftmost match of the
    pattern for runs of any length, so the two last patterns ask for the length at once."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    if not _DIGIT.search(text):
        return []
    return [m.span() for m in _RUN.finditer(text) if _DIGIT.search(m[0])]


def window(text: str, start: int, end: int) -> str:
    """What the network sees: 24 characters before, the candidate (its middle left out beyond 48), 8 after."""
    body = text[start:end]
    if len(body) > BODY:
        body = body[: BODY - 16] + body[-16:]
    return text[max(0, start - LEFT) : start].rjust(LEFT, "\0") + body.ljust(BODY, "\0") + text[end : end + RIGHT].ljust(RIGHT, "\0")


def assigned(shown: str) -> bool:
    return shown[:LEFT].rstrip(" \"'")[-1:] in ("=", ":")


_LEAD = re.compile(r"(?:pwd|pass\w*|secret\w*|token\w*|\w*key|auth\w*|bearer|cred\w*|access|login)\W*(?:\w{1,3}\W+)?$", re.I)
_PIECE = re.compile(r"[A-Za-z0-9+/]{16,}")


def credential_like(shown: str) -> bool:
    """After an assignment sign or a word for credentials, or with 16 letters and digits in a row, two digits at least."""
    if assigned(shown) or _LEAD.search(shown[:LEFT]):
        return True
    return any(sum(map(str.isdigit, x)) > 1 and not x.isdigit() for x in _PIECE.findall(shown[LEFT : LEFT + BODY]))


def _codes(shown: list[str]) -> np.ndarray:
    flat = np.frombuffer("".join(shown).encode("utf-32-le"), "<u4").reshape(len(shown), LEFT + BODY + RIGHT)
    return np.minimum(flat, 127).astype(np.int64)


class Network:
    """Weights and thresholds; ``scores`` gives calibrated probabilities."""

    WIDTH, EMBED, FILTERS = 5, 8, 24

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        inside = np.zeros((LEFT + BODY + RIGHT, 1), "f4")
        inside[LEFT : LEFT + BODY] = 1
        self.inside = inside
        fan = self.WIDTH * (self.EMBED + 1)
        self.p = {
            "e": rng.normal(0, 0.3, (128, self.EMBED)),
            "w": rng.normal(0, (2 / fan) ** 0.5, (fan, self.FILTERS)),
            "b": np.zeros(self.FILTERS),
            "v": rng.normal(0, 0.3, self.FILTERS),
            "c": np.zeros(1),
        }
        self.p = {k: v.astype("f4") for k, v in self.p.items()}
        self.platt = (1.0, 0.0)
        self.threshold = {True: 0.5, False: 0.5}
        self.held: dict[bool, tuple[int, float, float]] = {}

    def _forward(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        n, t = codes.shape
        x = np.concatenate([self.p["e"][codes], np.broadcast_to(self.inside, (n, t, 1))], 2)
        steps = t - self.WIDTH + 1
        columns = np.concatenate([x[:, k : k + steps] for k in range(self.WIDTH)], 2)
        conv = columns @ self.p["w"] + self.p["b"]
        best = conv.argmax(1)
        top = np.maximum(np.take_along_axis(conv, best[:, None], 1)[:, 0], 0)
        return columns, best, top, top @ self.p["v"] + self.p["c"][0]

    def logits(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(codes[i : i + 512])[3] for i in range(0, len(codes), 512)] or [np.zeros(0)])

    def scores(self, codes: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.logits(codes) + b, -40, 40)))

    def _gradients(self, codes: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        columns, best, top, logit = self._forward(codes)
        n = len(codes)
        d = ((1 / (1 + np.exp(-np.clip(logit, -40, 40)))) - labels) / n
        d_top = np.outer(d, self.p["v"]) * (top > 0)
        rows = np.arange(n)[:, None]
        at_best = columns[rows, best]  # row, filter, inputs of the filter at its maximum
        d_w = np.einsum("nf,nfi->if", d_top, at_best)
        d_in = d_top[:, :, None] * self.p["w"].T[None]
        d_e = np.zeros_like(self.p["e"])
        size = self.EMBED + 1
        for k in range(self.WIDTH):
            np.add.at(d_e, codes[rows, best + k], d_in[:, :, k * size : k * size + self.EMBED])
        return {"e": d_e, "w": d_w, "b": d_top.sum(0), "v": top.T @ d, "c": np.array([d.sum()])}

    def train(self, codes: np.ndarray, labels: np.ndarray, epochs: int = 12, seed: int = 7) -> None:
        """Gradient descent with Adam on two thirds; calibration and thresholds on the others."""
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(codes))
        held, fit = order[: len(codes) // 3], order[len(codes) // 3 :]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            rng.shuffle(fit)
            for i in range(0, len(fit), 64):
                part = fit[i : i + 64]
                step += 1
                for k, g in self._gradients(codes[part], labels[part]).items():
                    m[k] += 0.1 * (g - m[k])
                    s[k] += 0.001 * (g * g - s[k])
                    self.p[k] -= (0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype("f4")
        z, y = self.logits(codes[held]).astype(float), labels[held].astype(float)
        a, b = 1.0, 0.0
        for _ in range(300):
            error = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40))) - y
            a, b = a - 0.05 * (error * z).mean() / max(1.0, (z * z).mean()) * 4, b - 0.5 * error.mean()
        self.platt = (a, b)
        after = np.array([assigned("".join(map(chr, row))) for row in codes[held]], bool)
        scores = self.scores(codes[held])
        for kind in (True, False):
            known = np.sort(scores[(after == kind) & (y == 1)])
            known = known if len(known) else np.sort(scores[y == 1])
            if len(known):
                self.threshold[kind] = float(known[int(len(known) * (1 - RECALL))])
            found = (after == kind) & (scores >= self.threshold[kind])
            n, right = int(((after == kind) & (y == 1)).sum()), int((found & (y == 1)).sum())
            self.held[kind] = (n, right / max(1, n), right / max(1, int(found.sum())))


def generated(n: int = 1500, seed: int = 11) -> tuple[list[str], list[int]]:
    """Findings of common shapes and look-alikes, in contexts of plain words."""
    rng = np.random.default_rng(seed)
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def draw(chars: str, size: int) -> str:
        return "".join(chars[i] for i in rng.integers(0, len(chars), size))

    def word() -> str:
        return draw(lower, int(rng.integers(2, 9)))

    shown, labels = [], []
    before = ("pwd=", "auth_key: ", "client_secret -> ", "Bearer ", "credentials ", "key is ", "private key: ", "access ", "")
    while len(shown) < n:
        size = int(rng.integers(16, 41))
        if rng.random() < 0.5:
            value = [draw(digits + lower + upper, size), draw(digits + "abcdef", size), "ghp_" + draw(digits + lower + upper, 36),
                     "sk_live_" + draw(digits + lower + upper, 24), draw(digits + lower + upper + "+/", size) + "=", "AKIA" + draw(digits + upper, 16)][rng.integers(6)]
            lead, label = before[rng.integers(len(before))], 1
        else:
            value = [f"mail{rng.integers(99)}.example.com", f"20{rng.integers(10, 30)}-0{rng.integers(1, 10)}-1{rng.integers(9)}", draw(digits, int(rng.integers(12, 20))),
                     f"{word()}_{rng.integers(3000)}_{word()}.pdf", f"www.{word()}{rng.integers(99)}.org/{word()}", f"{draw(digits, 3)}-{draw(digits, 4)}-{draw(digits, 6)}",
                     f"{word()}-{word()}-{rng.integers(99)}.{rng.integers(9)}", f"{word()}{word()}{word()}{rng.integers(9)}"][rng.integers(8)]
            lead, label = ("", "call ", "see ", "at ", "no. ", "file: ")[rng.integers(6)], 0
        left = " ".join(word() for _ in range(5)) + " " + lead
        spans = candidates(text := f"{left}{value} {word()} {word()}")
        if spans:
            shown.append(window(text, *spans[-1]))
            labels.append(label)
    return shown, labels


def labelled(docs: DataFrame) -> DataFrame:
    """The different candidates of the corpus as window and label, by the base patterns; without those of unknown label."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shown, labels = [], []
            for text in texts_of(batch):
                if spans := candidates(text):
                    base = base_spans(text)
                    for start, end in spans:
                        kinds = {k for s, k, e in base if s < end and start < e}
                        letters = any(c.isalpha() for c in text[start:end])
                        seen = window(text, start, end)
                        if kinds or not credential_like(seen):
                            shown.append(seen)
                            labels.append(int(bool(kinds & {0, 1}) or (2 in kinds and letters)))
            yield pa.RecordBatch.from_arrays([pa.array([x.encode("utf-8", "replace") for x in shown], pa.binary()), pa.array(labels, pa.int32())], names=["shown", "label"])

    return docs.select("text").mapInArrow(read, "shown binary, label int").dropDuplicates(["shown"])


def trained(docs: DataFrame) -> Network:
    ship(docs.sparkSession)
    found = settle(labelled(docs))
    shown, labels = generated()
    for label in (0, 1):
        rows = found.where(F.col("label") == label).orderBy(F.xxhash64("shown"), "shown").limit(MOST_LABELLED).collect()
        shown += [bytes(r["shown"]).decode("utf-8", "replace") for r in rows]
        labels += [label] * len(rows)
    network = Network()
    network.train(_codes(shown), np.array(labels, "f4"))
    return network


def findings(docs: DataFrame, network: Network | None = None) -> DataFrame:
    """doc_id and spans (start, kind as a number in ``KINDS``, end; code points), sorted."""
    ship(docs.sparkSession)
    network = network or trained(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, asked, where = [], [], []
            for row, text in enumerate(texts_of(batch)):
                base = base_spans(text)
                spans.append(base)
                for start, end in candidates(text):
                    if not any(s < end and start < e for s, _, e in base):
                        asked.append(window(text, start, end))
                        where.append((row, start, end))
            if asked:
                scores = network.scores(_codes(asked))
                for (row, start, end), shown, score in zip(where, asked, scores):
                    if score >= network.threshold[assigned(shown)]:
                        spans[row].append((start, 3, end))
            rows = [[{"start": s, "kind": k, "end": e} for s, k, e in sorted(x)] for x in spans]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {id_type}, spans array<struct<start: bigint, kind: int, end: bigint>>")


def digests(found: DataFrame) -> DataFrame:
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")

    base = F.filter("spans", lambda x: x["kind"] < 3)
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        sha256_hex(joined(base)).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count(3).alias("n_cnn"),
    )
