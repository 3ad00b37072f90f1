"""Document quality from a linear-chain conditional random field over lines.

Every line gets features of itself and of the lines before and behind it. The field has two labels, good and bad, a weight for
each feature and one for each pair of neighbouring labels; it is fitted by gradient ascent on the conditional likelihood of
labelled documents, whose lines all carry their document's label. A text's score is the mean of its lines' forward-backward
marginals for good, weighted by the lines' lengths.

Fitting uses a bounded sample: about `sample` labelled documents, chosen by a hash of the id, and of each at most `lines` neighbouring lines, from a place
that the hash tells. Executors make the features; only these numbers come to the driver, at most sample * lines * 45 floats (35 MB) whatever the
texts. Scoring reads whole texts, and needs some fifty bytes a line besides the text.

Defined results: null and empty texts are one empty line; null labels are not learned; without labels every score is 0.5;
repeated rows repeat their result, and repeated labels count each; an empty table gives an empty result; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import crc_mod, raw_texts, weighted_blocks

_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
_SYMBOL, _STRONG, _SOFT = b"#*$%&|<>@^~=_\\{}[]", b"!?", b".,;:'\"()-"
FEATURES = 14


#: Lines whose features are in memory at a time.
CHUNK = 20_000


def _own_features(lines: list[bytes], seen: set[bytes]) -> np.ndarray:
    """(lines, FEATURES) of lines in order; seen: the lines before them."""
    out = []
    for line in lines:
        n, words = len(line), line.split()
        k = len(words)
        share = lambda chars: (n - len(line.translate(None, chars))) / n if n else 0.0  # noqa: E731, B023
        distinct = len(set(words)) / k if k else 1.0
        alone = (line.count(b" | ") + (line[-2:] == b" |")) / k if k else 0.0
        out.append((min(n, 2000) / 500, np.log1p(k), min(n / k, 40) / 10 if k else 0.0, share(_UPPER), share(_LOWER), share(_DIGIT), share(_SYMBOL), share(_STRONG), share(_SOFT), distinct, alone, float(bool(k) and line in seen), float(line[-1:] in (b".", b"!", b"?", b":")), float(k == 0)))
        if k:
            seen.add(line)
    return np.array(out, float).reshape(-1, FEATURES)


def features(lines: list[bytes], chunk: int = CHUNK) -> Iterator[np.ndarray]:
    """Of each line, by chunks of lines: its own features, those of the line before and of the line behind (zeros and a mark at the borders) and a constant."""
    seen: set[bytes] = set()
    before = np.zeros((1, FEATURES))
    own = _own_features(lines[:chunk], seen)
    for at in range(0, len(lines), chunk):
        following = _own_features(lines[at + chunk : at + 2 * chunk], seen)
        n, last = len(own), not len(following)
        behind = np.zeros((1, FEATURES)) if last else following[:1]
        marks = np.zeros((n, 3))
        marks[0, 0], marks[-1, 1], marks[:, 2] = at == 0, last, 1
        yield np.concatenate([own, np.concatenate([before, own[:-1]]), np.concatenate([own[1:], behind]), marks], 1)
        before, own = own[-1:], following


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis)
    return m + np.log(np.exp(a - np.expand_dims(m, axis)).sum(axis))


def forward_backward(unary: np.ndarray, sizes: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals (lines, 2), summed pair marginals (2, 2) and the summed log partition of chains given one after the other.

    All chains take a step together; longer ones go on alone.
    """
    begins = np.cumsum(sizes) - sizes
    alpha, beta = np.zeros((len(unary), 2)), np.zeros((len(unary), 2))
    order = np.argsort(-sizes, kind="stable")
    b, s = begins[order], sizes[order]
    most = int(s[0]) if len(s) else 0
    alive = [int(np.searchsorted(-s, -t, "left")) for t in range(most + 1)]  # chains longer than t
    if most:
        alpha[b] = unary[b]
    for t in range(1, most):
        at = b[: alive[t]] + t
        alpha[at] = unary[at] + _lse(alpha[at - 1][:, :, None] + trans, 1)
    for t in range(most - 2, -1, -1):
        at = b[: alive[t + 1]] + t
        beta[at] = _lse(trans + (unary[at + 1] + beta[at + 1])[:, None, :], 2)
    logz = _lse(alpha[begins + sizes - 1], 1)
    per_line = np.repeat(logz, sizes)
    marginals = np.exp(alpha + beta - per_line[:, None])
    inner = np.ones(len(unary), bool)
    inner[begins + sizes - 1] = False
    at = np.flatnonzero(inner)
    pairs = np.exp(alpha[at][:, :, None] + trans + (unary[at + 1] + beta[at + 1])[:, None, :] - per_line[at][:, None, None]).sum(0)
    return marginals, pairs, float(logz.sum())


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray  # of good over bad
    trans: np.ndarray

    def unary(self, features: np.ndarray) -> np.ndarray:
        good = ((features - self.mean) / self.scale) @ self.weight
        return np.stack([-good / 2, good / 2], 1)


def fit(found: list[np.ndarray], labels: list[int], rounds: int = 120, rate: float = 0.1, penalty: float = 2e-3) -> Field:
    """Adam on the penalised conditional log likelihood per document; found: features of each document's lines."""
    sizes = np.array(list(map(len, found)), np.int64)
    x = np.concatenate(found)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    mean[-1], scale[-1] = 0.0, 1.0
    y = np.repeat(np.array(labels, np.int64), sizes)
    field = Field(mean, scale, np.zeros(x.shape[1]), np.zeros((2, 2)))
    z = (x - mean) / scale
    begins = np.cumsum(sizes) - sizes
    same = np.zeros((2, 2))
    for label in (0, 1):
        same[label, label] = sum(int(n) - 1 for n, l in zip(sizes, labels, strict=True) if l == label)
    m1, m2, theta = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    for k in range(1, rounds + 1):
        field.weight, field.trans = theta[:-4], theta[-4:].reshape(2, 2)
        good = z @ field.weight
        marginals, pairs, _ = forward_backward(np.stack([-good / 2, good / 2], 1), sizes, field.trans)
        grad = np.concatenate([z.T @ (y - marginals[:, 1]), (same - pairs).ravel()]) / len(begins) - penalty * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad**2
        theta = theta + rate * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-8)
    field.weight, field.trans = theta[:-4], theta[-4:].reshape(2, 2)
    return field


def learn(docs: DataFrame, labels: DataFrame, allowed: Column, text: str = "text", key: str = "doc_id", label: str = "quality", sample: int = 3000, lines: int = 64) -> Field | None:
    """Fit on about `sample` labelled documents; the sample of ids is bounded, and so is its broadcast."""
    known = labels.where(allowed & F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
    n = known.count()
    if not n:
        return None
    place = F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1 << 30))
    ids = known.where(place < F.lit(min(1.0, sample / n) * (1 << 30)))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).join(F.broadcast(ids), "k").select("k", "y", F.xxhash64("k", F.lit(12)).alias("h"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in weighted_blocks(batches, "t", 4_000_000):
            out = []
            for h, t in zip(batch.column("h").to_pylist(), raw_texts(batch.column("t")), strict=True):
                own = t.split(b"\n")
                first = h % max(1, len(own) - lines + 1)
                parts, at = [], 0
                for x in features(own):
                    parts.append(x[max(0, first - at) : max(0, first + lines - at)])
                    at += len(x)
                out.append(np.concatenate(parts).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("y"), pa.array(out, pa.binary())], names=["k", "y", "x"])

    kind = docs.schema[key].dataType.simpleString()
    found = sorted(rows.mapInArrow(run, f"k {kind}, y int, x binary").collect(), key=lambda r: (r["k"], r["y"], bytes(r["x"])))
    return fit([np.frombuffer(r["x"], np.float32).reshape(-1, 3 * FEATURES + 3).astype(float) for r in found], [int(r["y"] == 1) for r in found]) if found else None


def quality(docs: DataFrame, field: Field | None, text: str = "text", keys: tuple[str, ...] = ("doc_id",), block_bytes: int = 4_000_000) -> DataFrame:
    """keys, n_lines, score of every row."""
    picked = docs.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in weighted_blocks(batches, "__text", block_bytes):
            sizes, unary, lengths = [], [], []
            for t in raw_texts(batch.column(len(keys))):
                own = t.split(b"\n")
                sizes.append(len(own))
                lengths.append(np.fromiter((len(x) or 1 for x in own), float, len(own)))
                if field is not None:
                    unary += map(field.unary, features(own))
            sizes, lengths = np.array(sizes, np.int64), np.concatenate(lengths)
            scores = np.full(len(sizes), 0.5)
            if field is not None:
                marginals = forward_backward(np.concatenate(unary), sizes, field.trans)[0][:, 1]
                begins = np.cumsum(sizes) - sizes
                scores = np.clip(np.add.reduceat(marginals * lengths, begins) / np.add.reduceat(lengths, begins), 0, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(sizes, pa.int64()), pa.array(scores, pa.float64())], names=[*keys, "n_lines", "score"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return picked.mapInArrow(run, f"{schema}, n_lines bigint, score double")


def op5(docs: DataFrame, labels: DataFrame) -> DataFrame:
    field = learn(docs, labels, crc_mod("doc_id", 4) != 2)
    return quality(docs, field).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_lines")
