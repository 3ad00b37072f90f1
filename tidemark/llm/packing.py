"""Vector bin packing of tokenised documents into training sequences.

A sequence has three capacities: tokens, segments (pieces) and loss-bearing tokens. A document is a prompt, which bears no
loss, and the rest, which does; where its texts tell no better, the first PROMPT of its tokens are the prompt. Within a block of documents
pieces are placed by the dot-product heuristic: of the open pieces that fit the current sequence, the one whose demand vector has the
largest inner product with the free-capacity vector goes in. The demand of a document longer than a sequence is that of the longest beginning that an empty
sequence takes. If none fits while tokens are free, the piece of which most fits is cut to fill the gap, so that a sequence that is
full of loss is filled up with prompts; padding is left where there are none, where the segments are used up, and in a block's last sequences. Blocks are independent: memory
is bounded by a block, and a task that is run again after a lost executor gives the same sequences, as their ids derive from the partition and a counter in it.

Defined results: null and empty texts have the end id only; repeated rows are packed each; ties go to the document that stands first in the
weighed window; an empty table gives no sequence; extra columns are not read.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import weighted_blocks


class ByteBpe:
    """Ids of a byte-level BPE vocabulary, as the tokenizers library gives them for the vocabulary's JSON file.

    Its pattern never continues a token from a non-space into a space, so a text whose only blanks are single spaces
    and newlines between words is the concatenation of its space-parted chunks; those are looked up in a bounded
    memory. Other texts are encoded as a whole.
    """

    #: A blank beside a blank, or a blank other than space and newline.
    ODD = re.compile("[" + "".join(map(chr, (9, 11, 12, 13, 28, 29, 30, 31, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]")

    def __init__(self, ranks_file: str, remember: int = 250_000):
        import public_tokenizers
        import tiktoken

        with open(ranks_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.code = "<u2" if self.size <= 65536 else "<u4"
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        code, encode = self.code, self.encode

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                ids = np.array(encode(f" {chunk}"), code).tobytes()
                if len(self) < remember:
                    self[chunk] = ids
                return ids

        self.chunk = Chunks().__getitem__

    def ids(self, text: str) -> np.ndarray:
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] in (" ", "\n") or self.ODD.search(text):
            return np.array(self.encode(text), self.code)
        first, *rest = text.split(" ")
        return np.frombuffer(np.array(self.encode(first), self.code).tobytes() + b"".join(map(self.chunk, rest)), self.code)


_LOADED: dict[str, ByteBpe] = {}


def byte_bpe(name: str) -> ByteBpe:
    """One per Python worker; name: a file name of the public vocabularies, or a path."""
    if name not in _LOADED:
        import public_tokenizers

        _LOADED[name] = ByteBpe(name if "/" in name else public_tokenizers.path(name))
    return _LOADED[name]


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss: int = 896


#: Share of a document's tokens that are its prompt, where no rule is given.
PROMPT = 0.25


def pack(lengths: np.ndarray, loss: np.ndarray, limits: Limits, window: int = 512) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length), for items of `lengths` tokens whose last loss[i] tokens bear loss.

    At most `window` of the longest open pieces and as many of the shortest are weighed at a time; all pieces are placed.
    """
    if min(limits.tokens, limits.segments, limits.loss) <= 0:
        raise ValueError("every limit must be positive")
    out: list[list[tuple[int, int, int]]] = []
    caps = np.array([limits.tokens, limits.segments, limits.loss], float)
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    order = order[lengths[order] > 0]
    low, high = 0, len(order)  # open pieces outside the weighed ones are order[low:high]
    # of the weighed pieces: item, start, tokens left before the loss begins, tokens left that bear loss
    item, start, free_part, loss_part = (np.zeros(0, np.int64) for _ in range(4))

    def refill() -> None:
        nonlocal low, high, item, start, free_part, loss_part
        room = 2 * window - len(item)
        first = min((room + 1) // 2, high - low)
        last = min(room - first, high - low - first)
        new = np.concatenate([order[low : low + first], order[high - last : high]])
        low, high = low + first, high - last
        item, start = np.concatenate([item, new]), np.concatenate([start, np.zeros(len(new), np.int64)])
        free_part, loss_part = np.concatenate([free_part, (lengths - loss)[new]]), np.concatenate([loss_part, loss[new]])

    def demands(f: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the longest beginning that an empty sequence takes."""
        f = np.minimum(f, limits.tokens)
        b = np.minimum(b, np.minimum(limits.tokens - f, limits.loss))
        return np.stack([f + b, np.ones(len(f)), b], 1) / caps

    refill()
    demand = demands(free_part, loss_part)
    while len(item):
        left, seq = [limits.tokens, limits.segments, limits.loss], []
        open_ = free_part + loss_part > 0
        while left[0] and left[1]:
            free = np.array(left) / caps
            fits = open_ & (demand <= free + 1e-9).all(1)
            if fits.any():
                k = int(np.where(fits, demand @ free, -1.0).argmax())
            else:
                f = np.minimum(free_part, left[0])
                takes = np.where(open_, f + np.minimum(loss_part, np.minimum(left[0] - f, left[2])), 0)
                k = int(takes.argmax())
                if takes[k] <= 0:
                    break
            f = min(int(free_part[k]), left[0])
            b = min(int(loss_part[k]), left[0] - f, left[2])
            seq.append((int(item[k]), int(start[k]), f + b))
            left = [left[0] - f - b, left[1] - 1, left[2] - b]
            start[k] += f + b
            free_part[k] -= f
            loss_part[k] -= b
            demand[k] = demands(free_part[k : k + 1], loss_part[k : k + 1])[0]
            open_[k] = free_part[k] + loss_part[k] > 0
        out.append(seq)
        if open_.sum() < (window if low < high else len(item)):
            item, start, free_part, loss_part = (x[open_] for x in (item, start, free_part, loss_part))
            refill()
            demand = demands(free_part, loss_part)
    return out


PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, n_loss bigint"


def pack_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str = "byte_bpe_50k.tiktoken", end_id: int = 0, limits: Limits = Limits(), block_bytes: int = 4_000_000, loss_from: Callable[[str], int] | None = None, prompt: float = PROMPT, keep_ids: bool = False) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset, n_loss (and ids, if kept).

    loss_from gives the code point from which on a text bears loss; without it the first `prompt` of a document's tokens bear none.
    """
    kind = docs.schema[key].dataType.simpleString()
    picked = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, counter = byte_bpe(vocabulary), TaskContext.get().partitionId() << 36
        for batch in weighted_blocks(batches, "__text", block_bytes):
            ids, loss = [], []
            for t in batch.column("__text").to_pylist():
                own = bpe.ids(t).astype("<u4")
                ids.append(np.append(own, np.array([end_id], "<u4")))
                loss.append(len(ids[-1]) - (len(bpe.ids(t[: loss_from(t)])) if loss_from else int(prompt * len(ids[-1]))))
            lengths = np.array([len(x) for x in ids], np.int64)
            rows = []
            for seq in pack(lengths, np.array(loss, np.int64), limits):
                at = 0
                for i, s, n in seq:
                    piece = ids[i][s : s + n]
                    rows.append((i, s, n, zlib.crc32(piece.tobytes()), counter, at, max(0, s + n - max(s, int(lengths[i]) - loss[i])), piece if keep_ids else None))
                    at += n
                counter += 1
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            take = np.array(cols[0], np.int64)
            arrays = [batch.column(0).take(pa.array(take)), *(pa.array(x, pa.int64()) for x in (cols[1], cols[2], cols[3], lengths[take] if rows else (), cols[4], cols[5], cols[6]))]
            names = [key, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "n_loss"]
            if keep_ids:
                arrays.append(pa.array([x.tolist() for x in cols[7]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return picked.mapInArrow(run, f"`{key}` {kind}, {PIECES}" + ", ids array<int>" * keep_ids)


def op3(docs: DataFrame) -> DataFrame:
    return pack_documents(docs)
