"""Quality rules from tokeniser fertility.

A byte-level BPE vocabulary measures characters per token, the share of tokens that are not whole characters, and the
entropy of a text's tokens; a vocabulary of pieces with byte fallback measures characters per piece and the share of
pieces that are fallback bytes. Each language has a band for each measure, and texts outside of a band are rejected;
a language without bands of its own is judged by those of its text's script. Bands hold for texts of SURE tokens or more; below
they widen as the spread of a mean does, by the root of SURE / tokens (the least entropy by the binary logarithm of the tokens, which is
the most that a text can have), so that every text with a token is judged. Besides, base rules count words, symbols, repeated lines and
repeated three-word windows.

The piece vocabulary is applied word by word: no piece has a word mark behind its start, so pieces never span two words.
Its counts for a word are kept in a bounded memory.

Defined results: null and empty texts have no words, no tokens, fail the base rules and are not kept; repeated rows
repeat their result; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import weighted_blocks
from tidemark.llm.packing import byte_bpe

SYMBOLS = "#*$%&|<>"
_SYMBOLS_GONE = str.maketrans("", "", SYMBOLS)


#: Tokens from which on bands are as wide as they are written.
SURE = 100


@dataclass(frozen=True)
class Bands:
    """(least, most) of each measure."""

    chars_per_token: tuple[float, float]
    partial_share: tuple[float, float]
    entropy: tuple[float, float]
    chars_per_piece: tuple[float, float]
    fallback_share: tuple[float, float]

    def outside(self, measured: dict[str, float], tokens: int) -> str | None:
        """The first measure out of its band for a text of so many tokens."""
        wider = max(1.0, SURE / max(tokens, 1)) ** 0.5
        for name, value in measured.items():
            least, most = getattr(self, name)
            if name == "entropy":
                least *= min(1.0, math.log2(max(tokens, 1)) / math.log2(SURE)) / wider**0.5
                most *= wider
            else:
                least, most = least / wider, most * wider
            if not least <= value <= most:
                return name
        return None


#: By language: a little beyond the extremes of texts labelled good, so that clean texts stay.
LANGUAGES = {
    "en": Bands((2.36, 6.5), (0.0, 0.05), (5.4, 16.0), (1.84, 6.5), (0.0, 0.05)),
    "de": Bands((2.19, 6.0), (0.0, 0.12), (5.5, 16.0), (1.95, 6.5), (0.0, 0.05)),
    "es": Bands((1.93, 6.0), (0.0, 0.19), (5.5, 16.0), (1.7, 6.5), (0.0, 0.05)),
    "fr": Bands((1.98, 6.0), (0.0, 0.2), (5.5, 16.0), (1.64, 6.5), (0.0, 0.05)),
}
#: By the first word of the Unicode name of a text's most frequent kind of letter; "" for any other.
SCRIPTS = {
    "LATIN": Bands((1.4, 7.0), (0.0, 0.3), (4.5, 16.0), (1.4, 7.0), (0.0, 0.1)),
    "CJK": Bands((0.4, 3.0), (0.0, 0.9), (4.5, 16.0), (0.3, 3.0), (0.0, 0.7)),
    "": Bands((0.4, 7.0), (0.0, 0.9), (4.5, 16.0), (0.3, 7.0), (0.0, 0.7)),
}


def script(text: str) -> str:
    found = Counter(unicodedata.name(c, "").split(" ", 1)[0] for c in text if c.isalpha())
    return max(sorted(found), key=found.get, default="")


class Pieces(dict):
    """word (UTF-8) -> (pieces, fallback bytes)."""

    def __init__(self, model_file: str, remember: int = 250_000):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.byte = [self.model.IsByte(i) for i in range(self.model.GetPieceSize())]
        self.remember = remember

    def __missing__(self, word: bytes) -> tuple[int, int]:
        ids = self.model.encode(word.decode())
        found = len(ids), sum(map(self.byte.__getitem__, ids))
        if len(self) < self.remember:
            self[word] = found
        return found


def partial_ids(bpe) -> np.ndarray:
    """Which ids of a byte-level vocabulary are not whole characters."""
    out = np.zeros(bpe.size, bool)
    for token, i in bpe.ranks.items():
        try:
            token.decode()
        except UnicodeDecodeError:
            out[i] = True
    return out


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int]:
    """word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    chars = sum(map(len, words)) if text.isascii() else len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = len(text) - len(text.translate(_SYMBOLS_GONE)) if text.isascii() else sum(map(text.count, SYMBOLS))
    dup = 0
    if "\n" in text:
        lines = [x for x in text.encode().split(b"\n") if x.strip()]
        dup = len(lines) - len(set(lines))
    repeated = 0
    if len(words) > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            counts = Counter(windows)
            marked = bytearray(len(words))
            for i, w in enumerate(windows):
                if counts[w] > 1:
                    marked[i] = marked[i + 1] = marked[i + 2] = 1
            repeated = sum(marked)
    return chars, symbols, dup, repeated


OUT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, n_tokens bigint, chars_per_token double, partial_share double, entropy double, n_pieces bigint, chars_per_piece double, fallback_share double, rejected_by string"


def judge(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str | None = "lang", bpe_name: str = "byte_bpe_50k.tiktoken", piece_name: str = "piece_bpe_32k.model", languages: dict[str, Bands] | None = None, scripts: dict[str, Bands] | None = None, block_bytes: int = 4_000_000) -> DataFrame:
    """Base counts, measures and verdict of every row; rejected_by names the first measure out of its band (null: none)."""
    languages, scripts = languages or LANGUAGES, scripts or SCRIPTS
    picked = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("__text"), (F.col(lang).cast("string") if lang else F.lit(None).cast("string")).alias("__lang"))
    kind = docs.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in OUT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        bpe, pieces = byte_bpe(bpe_name), _pieces(piece_name if "/" in piece_name else public_tokenizers.path(piece_name))
        partial = partial_ids(bpe)
        logs = np.log2(np.arange(1, 1 << 16))
        for batch in weighted_blocks(batches, "__text", block_bytes):
            rows = []
            for t, own in zip(batch.column("__text").to_pylist(), batch.column("__lang").to_pylist(), strict=True):
                words = t.encode().split()
                chars, symbols, dup, repeated = base_counts(t, words)
                failed = len(words) < 50 or 100 * repeated > 50 * len(words)
                ids = bpe.ids(t)
                n = len(ids)
                share = per = entropy = per_piece = fallback = 0.0
                n_pieces = 0
                if n:
                    counts = np.sort(ids)
                    counts = np.diff(np.flatnonzero(np.concatenate([[True], counts[1:] != counts[:-1], [True]])))
                    entropy = math.log2(n) - float((counts * np.where(counts < 1 << 16, logs[np.minimum(counts, 65535) - 1], np.log2(counts))).sum()) / n
                    per, share = len(t) / n, float(partial[ids].mean())
                if words:
                    found = list(map(pieces.__getitem__, words))
                    n_pieces = sum(x[0] for x in found)
                    per_piece, fallback = chars / max(n_pieces, 1), sum(x[1] for x in found) / max(n_pieces, 1)
                why = None
                if n:
                    bands = languages.get(own) or scripts.get(script(t)) or scripts[""]
                    measured = {"chars_per_token": per, "partial_share": share, "entropy": entropy, "chars_per_piece": per_piece, "fallback_share": fallback}
                    why = bands.outside(measured, n)
                rows.append((len(words), chars, symbols, dup, repeated, failed, not failed and why is None, n, per, share, entropy, n_pieces, per_piece, fallback, why))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] + [pa.float64()] * 3 + [pa.int64()] + [pa.float64()] * 2 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], x) for k, x in enumerate(kinds))], names=[key, *names])

    return picked.mapInArrow(run, f"`{key}` {kind}, {OUT}")


_LOADED: dict[str, Pieces] = {}


def _pieces(path: str) -> Pieces:
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def op1(docs: DataFrame) -> DataFrame:
    return judge(docs)
