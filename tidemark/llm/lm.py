"""Language-model scores by deleted interpolation.

Tokens are lower-cased words and an end of text. The model is P(w | u v) = l3 f(w | u v) + l2 f(w | v) + l1 f(w) + l0 / (V + 1):
maximum-likelihood estimates of trigrams, bigrams and unigrams, and an even share for any of V + 1 types (one is for what was
never seen). The weights l depend on the frequency bucket of the longest history that was seen: of (u, v), else of v. They come
from expectation maximisation on held-out counts: one in HELD of the training documents, by a hash of the id, is held out,
and estimates from the retained rest are set against its tokens. The final estimates count all training documents; a
bucket that was not learned uses the nearest learned one. Nothing depends on how rows lie in partitions.

Counting is an exchange of packed rows. Documents are read into blocks of bounded size; a block sends, for each of FAN parts
of the range of keys, one row with its sorted distinct keys and their counts. The parts of up to CHUNK blocks meet in one group.
If that is all blocks, the group's sums are the totals; else what it merged is a block of the next round, which is
exchanged by the next bits of the keys in the same way, and the totals come back by the same steps. So rows number FAN a
block and round, rounds grow with the logarithm of the blocks, a group has about CHUNK parts, and an n-gram is one number in
a row a block however often it occurs, so that no key makes a task large. A round more (from CHUNK blocks on, some 1.5 GB of texts) moves what was
merged once more, and takes disk for it.

Words are 64-bit hashes. N-grams are hashes of 16 bits more than the binary logarithm of their number (62 at most), so
that one in some 65,000 meets another by chance; words have exact counts but for chance n^2 / 2^65.

Defined results: null and empty texts have the end token only; repeated rows count each and repeat their result; without
training documents all counts are 0 and only the even share is left; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import crc_mod, raw_texts, scratch, weighted_blocks, written

#: Key of the end of text, also the history of a text's first token.
END = np.uint64(0x9E3779B97F4A7C15)
#: One in so many training documents is held out for the weights.
HELD = 8
#: Bits of the key that a round deals by (a block sends FAN = 2 ** BITS rows), and blocks whose parts meet in one group.
BITS, CHUNK = 8, 512
#: Steps of an octave to which estimates are rounded in the held-out statistics: their number has a bound, whatever the input.
STEPS = 2
NONE = -10_000
ROUNDS = 60
#: Histories of two words have the buckets from here on, those of one word the buckets below.
PAIR = 100
START = np.array([0.3, 0.3, 0.3, 0.1])


def _zip(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _unzip(x, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), kind)


def _zip_tokens(codes: np.ndarray) -> bytes:
    """Numbers of words, by planes of their bytes."""
    return _zip(np.ascontiguousarray(codes.astype(np.uint32).view(np.uint8).reshape(-1, 4).T))


def _unzip_tokens(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unzip(packed, np.uint8).reshape(4, -1).T).reshape(-1).view(np.uint32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def thin(keys: np.ndarray) -> bytes:
    """Sorted distinct keys: their number, and the planes of the bytes of their differences."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    first, gaps = gaps[:1], gaps[1:]
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    planes = np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(keys).to_bytes(4, "little") + bytes([width]) + first.tobytes() + _zip(planes)


def full(packed: bytes) -> np.ndarray:
    n, width = int.from_bytes(packed[:4], "little"), packed[4]
    if not n:
        return np.zeros(0, np.uint64)
    gaps = np.zeros((n, 8), np.uint8)
    gaps[0] = np.frombuffer(packed, np.uint8, 8, 5)
    gaps[1:, :width] = _unzip(packed[13:], np.uint8).reshape(width, n - 1).T
    return np.cumsum(gaps.reshape(-1).view(np.uint64), dtype=np.uint64)


def small(counts: np.ndarray) -> bytes:
    """Counts, most of which fit in a byte."""
    low = _zip(np.minimum(counts, 255).astype(np.uint8))
    return len(low).to_bytes(4, "little") + low + _zip(counts[counts >= 255].astype(np.int64))


def large(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:4], "little")
    out = _unzip(packed[4 : 4 + n], np.uint8).astype(np.int64)
    out[out == 255] = _unzip(packed[4 + n :], np.int64)
    return out


BLOCKS = "block bigint, n bigint, n_train bigint, n_held bigint, ids array<bigint>, sizes array<int>, train array<boolean>, held array<boolean>, tokens binary, words binary"


def blocks(docs: DataFrame, train: Column, text: str, key: str, block_bytes: int) -> DataFrame:
    """Packed blocks of documents: tokens are numbers of the block's distinct words (keys)."""
    train = F.coalesce(train, F.lit(False))
    held = train & (F.pmod(F.xxhash64(F.col(key), F.lit(3)), F.lit(HELD)) == 0)
    picked = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("__text"), train.alias("train"), held.alias("held"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in weighted_blocks(batches, "__text", block_bytes):
            parts = [t.lower().split() for t in raw_texts(batch.column("__text"))]  # of bytes: A-Z only, ASCII white space only
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
            flat = np.empty(int(sizes.sum()), object)
            flat[:] = [w for p in parts for w in (*p, b" ")]  # a word is never a blank
            del parts
            codes, distinct = pd.factorize(flat)
            del flat
            keys = np.fromiter((END if w == b" " else xxhash.xxh3_64_intdigest(w) for w in distinct), np.uint64, len(distinct))
            flags, held_out = (np.array(batch.column(c).to_pylist(), bool) for c in ("train", "held"))
            cells = ((number, pa.int64()), (len(codes), pa.int64()), (int(sizes[flags].sum()), pa.int64()), (int(sizes[held_out].sum()), pa.int64()), (batch.column("id").to_pylist(), pa.list_(pa.int64())), (sizes.tolist(), pa.list_(pa.int32())), (flags.tolist(), pa.list_(pa.bool_())), (held_out.tolist(), pa.list_(pa.bool_())), (_zip_tokens(codes), pa.binary()), (keys.tobytes(), pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in cells], names=[x.split()[0] for x in BLOCKS.split(", ")])
            number += 1

    return picked.mapInArrow(run, BLOCKS)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one: each is a whole block."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


HELD_BLOCKS = "block bigint, sizes array<int>, tokens binary, words binary"


def _held_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the held-out documents only."""
    for row in _rows(batches):
        held, sizes = np.array(row["held"], bool), np.array(row["sizes"], np.int64)
        used, tokens = np.unique(_unzip_tokens(row["tokens"])[np.repeat(held, sizes)], return_inverse=True)
        words = np.frombuffer(row["words"], np.uint64)[used]
        cells = ((row["block"], pa.int64()), (sizes[held].tolist(), pa.list_(pa.int32())), (_zip_tokens(tokens), pa.binary()), (words.tobytes(), pa.binary()))
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in cells], names=[x.split()[0] for x in HELD_BLOCKS.split(", ")])


class Block:
    """The n-grams of a block's documents: distinct sorted keys, and each token's places among them."""

    def __init__(self, row: dict, width: int):
        self.sizes = np.array(row["sizes"], np.int64)
        words, tokens = np.frombuffer(row["words"], np.uint64), _unzip_tokens(row["tokens"])
        order = np.argsort(words)
        self.words = words[order]
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        self.uni, own = place[tokens], words[tokens]
        self.begins = np.cumsum(self.sizes) - self.sizes
        before = np.empty_like(own)
        before[1:] = own[:-1]
        before[self.begins] = END
        pairs = _mix(before * np.uint64(0xD6E8FEB86659FD93) + own)
        self.inner = np.ones(len(own), bool)
        self.inner[self.begins] = False
        second = np.empty_like(own)
        second[1:] = before[:-1]
        triples = _mix(second[self.inner] * np.uint64(0xA0761D6478BD642F) ^ pairs[self.inner])
        self.grams, at = np.unique(np.concatenate([pairs, triples]) >> np.uint64(64 - width), return_inverse=True)
        self.pair, self.triple = at[: len(own)], at[len(own) :]

    def counts(self, which: np.ndarray) -> Counts:
        """Of each word and n-gram, in the documents that which tells."""
        on = np.repeat(which, self.sizes)
        grams = np.bincount(self.pair[on], minlength=len(self.grams)) + np.bincount(self.triple[on[self.inner]], minlength=len(self.grams))
        return np.bincount(self.uni[on], minlength=len(self.words)), grams

    def estimates(self, totals: Counts, tokens: int) -> tuple[np.ndarray, ...]:
        """Of each token: its bucket, trigram, bigram and unigram estimate, and its count."""
        of_word, of_gram = totals
        word, pair = of_word[self.uni], of_gram[self.pair]
        triple, seen_pair, seen = np.zeros(len(word)), np.zeros(len(word)), np.empty(len(word))
        triple[self.inner] = of_gram[self.triple]
        seen[1:], seen_pair[1:] = word[:-1], pair[:-1]
        seen_pair[self.begins] = 0
        seen[self.begins] = of_word[np.searchsorted(self.words, END)]
        log = lambda c: 1 + np.floor(np.log2(np.maximum(c, 1)))
        bucket = np.where(seen_pair > 0, PAIR + log(seen_pair), np.where(seen > 0, log(seen), 0)).astype(np.int64)
        ratio = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=np.broadcast_to(b, a.shape) > 0)
        return bucket, ratio(triple, seen_pair), ratio(pair, seen), ratio(word, tokens), word


# --- the exchange: parts of blocks' keys go out, replies with their totals come back -------------------------------

PARTS = "block bigint, bucket bigint, words binary, grams binary, train_words binary, train_grams binary, held_words binary, held_grams binary"
#: t: totals of the training documents, of each key of the part; k: of the retained ones, of each key that the part holds out.
REPLIES = "block bigint, bucket bigint, n_types bigint, t_words binary, t_grams binary, k_words binary, k_grams binary"
Counts = tuple[np.ndarray, np.ndarray]  # of words and of n-grams


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "binary" else pa.int64()) for c, k in zip(columns, kinds, strict=True)], names=names)


def _split(block: int, path: int, depth: int, keys: Counts, train: Counts, held: Counts, width: int, dealt: int) -> list[tuple]:
    """A row for each part of the keys, by their first dealt * depth bits, of which all before the last `dealt` are `path`."""
    starts = range(path << dealt, path + 1 << dealt)
    edges = [[*np.searchsorted(k, np.array([p << (bits - dealt * depth) for p in starts], np.uint64)).tolist(), len(k)] for k, bits in zip(keys, (64, width), strict=True)]
    out = []
    for n, bucket in enumerate(starts):
        (a, b), (c, d) = edges[0][n : n + 2], edges[1][n : n + 2]
        if a < b or c < d:
            out.append((block, bucket, thin(keys[0][a:b]), thin(keys[1][c:d]), small(train[0][a:b]), small(train[1][c:d]), small(held[0][a:b]), small(held[1][c:d])))
    return out


class Merged:
    """Parts that met in one group: their distinct keys, summed counts, and the places of each part's keys among them."""

    def __init__(self, group: pa.Table):
        self.group = group
        self.keys, self.places, self.held_of, train, held = [], [], [], [], []
        for kind in ("words", "grams"):
            keys = [full(x) for x in group.column(kind).to_pylist()]
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            own = [large(x) for x in group.column(f"held_{kind}").to_pylist()]
            self.keys.append(distinct)
            self.places.append(np.split(place, np.cumsum(list(map(len, keys)))[:-1]))
            self.held_of.append(own)
            train.append(np.bincount(place, np.concatenate([large(x) for x in group.column(f"train_{kind}").to_pylist()]), len(distinct)).astype(np.int64))
            held.append(np.bincount(place, np.concatenate(own), len(distinct)).astype(np.int64))
        self.train, self.held = tuple(train), tuple(held)

    def replies(self, train: Counts, kept: Counts, n_types: int) -> pa.Table:
        out: dict[str, object] = {"block": self.group.column("block"), "bucket": self.group.column("bucket"), "n_types": pa.array([n_types] + [0] * (self.group.num_rows - 1), pa.int64())}
        for name, of in (("t", train), ("k", kept)):
            for k, kind in enumerate(("words", "grams")):
                places = self.places[k] if name == "t" else [p[h > 0] for p, h in zip(self.places[k], self.held_of[k], strict=True)]
                out[f"{name}_{kind}"] = pa.array([small(of[k][p]) for p in places], pa.binary())
        return pa.table(out)


def _sums(group: pa.Table) -> pa.Table:
    """The last round: the group has all parts of its keys."""
    m = Merged(group)
    return m.replies(m.train, tuple(t - h for t, h in zip(m.train, m.held, strict=True)), int((m.train[0] > 0).sum()))


def _next_round(group: pa.Table, depth: int, width: int, dealt: int) -> pa.Table:
    """What a group merged, as the parts of a block of the next round; the group's chunk and bucket are its name."""
    m = Merged(group)
    rows = _split(group.column("chunk")[0].as_py(), group.column("bucket")[0].as_py(), depth + 1, tuple(m.keys), m.train, m.held, width, dealt)
    return pa.Table.from_batches([_batch(rows, PARTS)])


def _back(group: pa.Table, answers: pa.Table) -> pa.Table:
    """Replies to the parts of a group, from those to what it merged."""
    m, rows = Merged(group), sorted(answers.to_pylist(), key=lambda x: x["bucket"])
    joined = {c: np.concatenate([large(x[c]) for x in rows]) for c in ("t_words", "t_grams", "k_words", "k_grams")}
    kept = []
    for k, kind in enumerate(("words", "grams")):
        kept.append(np.zeros(len(m.keys[k]), np.int64))
        kept[k][m.held[k] > 0] = joined[f"k_{kind}"]
    return m.replies((joined["t_words"], joined["t_grams"]), tuple(kept), sum(x["n_types"] for x in rows))


def exchanged(parts: DataFrame, n_blocks: int, width: int, dealt: int = BITS, chunk: int = CHUNK, depth: int = 1) -> DataFrame:
    """A reply to each of the parts."""
    chunks = math.ceil(n_blocks / chunk)
    if chunks <= 1:
        return written(parts.groupBy("bucket").applyInArrow(_sums, REPLIES), "replies")
    with scratch(parts.sparkSession) as tables:
        parts = parts.withColumn("chunk", F.pmod(F.xxhash64("block"), F.lit(chunks)))
        if depth > 1:  # the first ones are made anew from their blocks on the way back, which takes less disk than a table of them
            parts = written(parts, "parts")
        merged = parts.groupBy("bucket", "chunk").applyInArrow(lambda group: _next_round(group, depth, width, dealt), PARTS)
        answers = exchanged(merged, chunks, width, dealt, chunk, depth + 1).withColumn("up", F.shiftright("bucket", dealt))
        replies = written(parts.groupBy("bucket", "chunk").cogroup(answers.groupBy("up", "block")).applyInArrow(_back, REPLIES), "replies")
        tables.last = True
    return replies


def _totals(row: dict, name: str) -> Counts:
    replies = sorted(row["replies"], key=lambda x: x["bucket"])
    return tuple(np.concatenate([large(x[f"{name}_{kind}"]) for x in replies]).astype(float) for kind in ("words", "grams"))


def fit_weights(cells: list[tuple[int, int, int, int, int]], even: float) -> dict[int, np.ndarray]:
    """Weights (trigram, bigram, unigram, even) of each bucket, by expectation maximisation on (bucket, rounded estimates, tokens)."""
    out = {}
    value = lambda q: np.where(q == NONE, 0.0, np.exp2(q / STEPS))
    for bucket in sorted({c[0] for c in cells}):
        own = np.array(sorted(c[1:] for c in cells if c[0] == bucket), float)
        f = np.column_stack([value(own[:, 0]), value(own[:, 1]), value(own[:, 2]), np.full(len(own), even)])
        w = START
        for _ in range(ROUNDS):
            share = f * w
            share *= (own[:, 3] / share.sum(1))[:, None]
            w = share.sum(0) / share.sum()
        w = np.maximum(w, [0, 0, 0, 1e-7])
        out[bucket] = w / w.sum()
    return out


def weight_table(weights: dict[int, np.ndarray]) -> np.ndarray:
    """A row for every bucket: its own weights, or those of the nearest learned bucket of its kind."""
    out = np.zeros((PAIR + 66, 4))
    for first, last, start in ((0, 0, [0, 0, 0.9, 0.1]), (1, PAIR - 1, [0, 0.5, 0.4, 0.1]), (PAIR, PAIR + 65, START)):
        learned = [b for b in weights if first <= b <= last]
        for b in range(first, last + 1):
            out[b] = weights[min(learned, key=lambda x: (abs(x - b), x))] if learned else start
    return out


def score(docs: DataFrame, train: Column, text: str = "text", key: str = "doc_id", block_bytes: int = 3_000_000, dealt: int = BITS, chunk: int = CHUNK) -> DataFrame:
    """id, train, n_tokens, n_known, train_tokens, base_score, score of every row; counts come from the rows that train tells."""
    packed = written(blocks(docs, train, text, key, block_bytes), "blocks")
    n_blocks, tokens, train_tokens, held_tokens = packed.agg(F.count(F.lit(1)), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "n_train", "n_held")]).first()
    width = min(62, math.ceil(math.log2(max(2, 2 * tokens))) + 16)
    kept_tokens = train_tokens - held_tokens

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Block(row, width)
            train, held = (b.counts(np.array(row[c], bool)) for c in ("train", "held"))
            yield _batch(_split(row["block"], 0, 1, (b.words, b.grams), train, held, width, dealt), PARTS)

    replies = exchanged(packed.mapInArrow(ask, PARTS), n_blocks, width, dealt, chunk)
    types = replies.agg(F.coalesce(F.sum("n_types"), F.lit(0))).first()[0]
    even = 1 / (types + 1)

    def answered(some: DataFrame, name: str) -> DataFrame:
        own = replies.groupBy(F.col("block").alias("b")).agg(F.collect_list(F.struct("bucket", f"{name}_words", f"{name}_grams")).alias("replies"))
        return some.join(own, F.col("block") == F.col("b")).drop("b")

    def held_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = lambda f: np.where(f > 0, np.round(STEPS * np.log2(np.maximum(f, 1e-300))), NONE).astype(np.int64)
        for row in _rows(batches):
            bucket, f3, f2, f1, _ = Block(row, width).estimates(_totals(row, "k"), kept_tokens)
            cells, n = np.unique(np.stack([bucket, code(f3), code(f2), code(f1)], 1), axis=0, return_counts=True)
            yield _batch([(*c, k) for c, k in zip(cells.tolist(), n.tolist(), strict=True)], CELLS)

    cells = answered(packed.where(F.col("n_held") > 0).mapInArrow(_held_blocks, HELD_BLOCKS), "k").mapInArrow(held_out, CELLS)
    weights = fit_weights([tuple(r) for r in cells.groupBy("bucket", "f3", "f2", "f1").agg(F.sum("n")).collect()], even)
    table = weight_table(weights) if train_tokens else np.tile([0.0, 0.0, 0.0, 1.0], (PAIR + 66, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = Block(row, width)
            bucket, f3, f2, f1, word = b.estimates(_totals(row, "t"), train_tokens)
            w = table[bucket]
            p = w[:, 0] * f3 + w[:, 1] * f2 + w[:, 2] * f1 + w[:, 3] * even
            total = lambda x: np.add.reduceat(x, b.begins)  # noqa: E731, B023
            base = np.log10(word + 1) - math.log10(train_tokens + types + 1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["ids"], pa.int64()), pa.array(row["train"], pa.bool_()), pa.array(b.sizes, pa.int64()), pa.array(total((word > 0).astype(np.int64)), pa.int64()), pa.array(np.full(len(b.sizes), train_tokens), pa.int64()), pa.array(total(base), pa.float64()), pa.array(total(np.log10(p)), pa.float64())],
                names=["id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return answered(packed, "t").mapInArrow(run, "id bigint, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


CELLS = "bucket bigint, f3 bigint, f2 bigint, f1 bigint, n bigint"


def op9(docs: DataFrame) -> DataFrame:
    found = score(docs, crc_mod("doc_id", 7) != 2)
    return found.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
