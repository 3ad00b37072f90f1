"""Language identification by prediction by partial matching (PPM).

Each language has frozen statistics of bytes in contexts of 0 to ORDER bytes. A byte's code length in a language is found
by descending from the longest context that was seen: a byte seen there costs -log2(c / (C + D)) bits (c its count, C
the context's total, D the number of distinct bytes seen in it); else the escape costs -log2(D / (C + D)) and the next
shorter context is asked, down to 1/256 (method C, no exclusions). A text goes to the language with the least sum over
all of its bytes; its score is that language's share of 2^-length over the languages (a posterior with equal priors).

Statistics come from a bounded sample: of each language about `sample_bytes` bytes of text in the documents that may be
learned from, whole documents chosen by a hash of the id (the least hash is always in). Documents longer than that are learned from only if a language has no
other: then its shortest one is the sample. Scoring reads whole texts.

accepted() also rejects texts that no language codes in `most_bits` bits a byte or less: at 8 that are those that the statistics describe no better than
plain bytes do, such as texts in a script that was not learned, whichever language comes nearest.

Defined results: null texts and texts without a letter get `und` and score 0; with no labelled document every text is
`und`; null languages are not learned; repeated rows repeat their result; ties go to the first language by code point; an empty table gives an
empty result; extra columns are not read, whatever their names (accepted() passes them on).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import crc_mod, raw_texts, weighted_blocks

ORDER = 4
UNDETERMINED = "und"


def _grams(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of each byte with the n - 1 before it (zero bytes before a text's start), and where each text begins; texts must not be empty."""
    pad = b"\0" * (n - 1)
    flat = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.zeros(len(flat), np.uint64)
    for back in range(n):
        code[back:] |= flat[: len(flat) - back].astype(np.uint64) << np.uint64(8 * back)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    keep = np.ones(len(flat), bool)
    for k in range(n - 1):
        keep[begins[:-1] + (n - 1) * np.arange(len(texts)) + k] = False
    return code[keep], begins


@dataclass
class Tree:
    """Context statistics of one language: for each order, sorted codes of context + byte with counts, and of contexts with totals and distinct bytes."""

    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    @staticmethod
    def learn(texts: list[bytes]) -> Tree:
        texts = [t for t in texts if t]
        code = _grams(texts, ORDER + 1)[0] if texts else np.zeros(0, np.uint64)
        grams, contexts = [], []
        for k in range(ORDER + 1):
            own, count = np.unique(code & np.uint64((1 << (8 * (k + 1))) - 1), return_counts=True)
            ctx, at = np.unique(own >> np.uint64(8), return_index=True)
            total = np.add.reduceat(count, at) if len(at) else count
            grams.append((own, count))
            contexts.append((ctx, total, np.diff(np.append(at, len(own)))))
        return Tree(grams, contexts)

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte after the others."""
        cost, open_ = np.zeros(len(code)), np.ones(len(code), bool)
        for k in range(ORDER, -1, -1):
            ctx, total, distinct = self.contexts[k]
            own, count = self.grams[k]
            if not len(own):
                continue
            gram = code & np.uint64((1 << (8 * (k + 1))) - 1)
            at = np.minimum(np.searchsorted(ctx, gram >> np.uint64(8)), len(ctx) - 1)
            seen = open_ & (ctx[at] == gram >> np.uint64(8))
            place = np.minimum(np.searchsorted(own, gram), len(own) - 1)
            hit = seen & (own[place] == gram)
            whole = np.log2(total[at] + distinct[at])
            cost += np.where(hit, whole - np.log2(count[place]), np.where(seen, whole - np.log2(distinct[at]), 0.0))
            open_ &= ~hit
        return cost + np.where(open_, 8.0, 0.0)


def learn(docs: DataFrame, allowed: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_bytes: int = 1_500_000) -> dict[str, Tree]:
    """A tree for each language of the allowed rows. Only the sample comes to the driver: about sample_bytes for a language."""
    h = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30))
    usable = docs.where(allowed & F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(F.col(lang).alias("l"), F.col(text).alias("t"), F.octet_length(text).alias("n"), h.alias("h"))
    fits = F.col("n") <= sample_bytes
    found = usable.groupBy("l").agg(F.sum(F.when(fits, F.col("n"))).alias("all"), F.min(F.when(fits, F.col("h"))).alias("h"), F.min(F.struct("n", "h")).alias("shortest")).collect()
    if not found:
        return {}
    # the least hash is always in, so that a language of a few long documents is learned too
    below = {r["l"]: max(min(1.0, sample_bytes / r["all"]) * (1 << 30), r["h"] + 1.0) for r in found if r["all"]}
    chosen = F.lit(False)
    for r in sorted(found, key=lambda r: r["l"]):
        own = fits & (F.col("h") < below[r["l"]]) if r["l"] in below else (F.col("n") == r["shortest"]["n"]) & (F.col("h") == r["shortest"]["h"])
        chosen |= (F.col("l") == r["l"]) & own
    picked = usable.where(chosen).select("l", "h", "t").collect()
    sizes = [r["l"] for r in found]
    texts: dict[str, list[bytes]] = {k: [] for k in sizes}
    for r in sorted(picked, key=lambda r: (r["l"], r["h"], r["t"])):
        texts[r["l"]].append(r["t"].encode())
    return {k: Tree.learn(v) for k, v in sorted(texts.items()) if any(v)}


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode())) if text else False


def code_lengths(trees: list[Tree], texts: list[bytes]) -> np.ndarray:
    """Bits of each (non-empty) text in each language."""
    code, begins = _grams(texts, ORDER + 1)
    at, distinct = pd.factorize(code)
    return np.stack([np.add.reduceat(tree.bits(distinct)[at], begins[:-1]) for tree in trees], 1)


def identify(docs: DataFrame, trees: dict[str, Tree], text: str = "text", keys: tuple[str, ...] = ("doc_id",), block_bytes: int = 4_000_000) -> DataFrame:
    """keys, lang_pred, score, bits (best code length per byte) for every row. The trees hold at most the sample's contexts and are sent as one broadcast."""
    names, sent = list(trees), docs.sparkSession.sparkContext.broadcast(list(trees.values()))
    picked = docs.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for batch in weighted_blocks(batches, "__text", block_bytes):
            texts = raw_texts(batch.column("__text"))
            judged = [i for i, t in enumerate(texts) if names and has_letter(t)]
            langs, scores, bits = [UNDETERMINED] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
            if judged:
                found = code_lengths(trees, [texts[i] for i in judged])
                best = found.argmin(1)
                least = found.min(1)
                share = 1 / np.exp2(np.maximum(least[:, None] - found, -1000)).sum(1)
                for i, b, s, n in zip(judged, best, share, least, strict=True):
                    langs[i], scores[i], bits[i] = names[b], float(s), float(n) / len(texts[i])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keys))), pa.array(langs), pa.array(scores, pa.float64()), pa.array(bits, pa.float64())], names=[*keys, "lang_pred", "score", "bits"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return picked.mapInArrow(run, f"{schema}, lang_pred string, score double, bits double")


def accepted(docs: DataFrame, trees: dict[str, Tree], text: str = "text", least: float = 0.5, most_bits: float = 8.0, block_bytes: int = 4_000_000) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a letter and a language with a score of `least` or more that codes it in most_bits bits a byte (without any tree: a letter)."""
    names, place, sent = list(trees), docs.columns.index(text), docs.sparkSession.sparkContext.broadcast(list(trees.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = sent.value
        for whole in batches:
            for batch in weighted_blocks(iter([whole]), whole.schema.names[place], block_bytes):
                texts = raw_texts(batch.column(place))
                keep = [has_letter(t) for t in texts]
                if names and any(keep):
                    judged = [i for i, k in enumerate(keep) if k]
                    found = code_lengths(trees, [texts[i] for i in judged])
                    best = found.min(1)
                    share = 1 / np.exp2(np.maximum(best[:, None] - found, -1000)).sum(1)
                    for i, s, n in zip(judged, share, best, strict=True):
                        keep[i] = bool(s >= least and n <= most_bits * len(texts[i]))
                yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op7(docs: DataFrame) -> DataFrame:
    held = crc_mod("doc_id", 5) == 0
    found = identify(docs, learn(docs, ~held))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")
