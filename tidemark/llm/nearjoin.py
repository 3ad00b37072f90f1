"""Set similarity self-join of documents by chosen paths, and the components of its links.

A document is the set of its distinct word shingles (64-bit hashes). Documents with equal sets are one class, held by its
least id. A class has a sketch of minwise tokens, one for each of SKETCH hash functions. Trees branch classes by chosen
tokens: a node chooses coordinates by hash, and a class goes to the child named by its token there, so that a pair of
similarity s meets in a child with probability s. `trees` * `branches` root branches are independent: a pair at the
threshold 0.85 is missed by 12 with probability 0.15 ** 12, which is the recall that is targeted, about 1 - 1e-10 at the root.

1. Nodes of at most SMALL classes are compared exhaustively by their sketches; a spanning forest of the pairs that agree
   in at least threshold - 5 standard deviations is kept, at most one edge a class. Larger nodes branch again by fresh tokens; what is
   still large at the last level is compared part by part, so nothing is capped.
2. The components of these edges are clusters: classes that might be linked. Every link lies in a cluster.
3. Full sets are brought together once a cluster (in pairs of parts, if a cluster is large), and the links on full sets
   are found by counting intersections from postings. Their components are the result.

A class is named by its least id. If rows share an id but not their set, further classes of that id get names above all ids, and
the classes of one id are linked, so that rows that share an id are one document and keep the links of all their texts.

The filter that spares the making of sets is exact in what it keeps and has a fixed size (4 MB): of many more than ten million ids in clusters
it lets all documents through, and all sets are made a second time; results do not change.

Defined results: null and empty texts have empty sets and are linked with nothing; a text of fewer words than a shingle is
one shingle; null ids take part in no link and have a null component; ties between names go to the lesser digest of the set; an empty table gives an empty
result; extra columns are not read, whatever their names. Ids are below 2 ** 62.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.llm._shared import distinct_name, hot_join, raw_texts, weighted_blocks, written
from tidemark.llm.components import components

SKETCH = 64
#: Nodes up to this size are compared exhaustively.
SMALL = 4096
LEVELS = 4
#: Shingles of a part of a cluster: two parts are in a task's memory at a time.
PART_SHINGLES = 1_000_000
#: Fixed size of the filter that tells which documents' sets are needed: bits, and bits set by an id.
FILTER_BITS, FILTER_HASHES = 1 << 25, 3

_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(1, 1 << 63, SKETCH, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, SKETCH, np.uint64)
_PLACE = _RNG.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of each text; A-Z count as a-z, other letters as they are."""
    parts = [t.lower().split() for t in texts]  # of bytes: lower() changes A-Z only, split() parts at ASCII white space
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    flat = np.empty(int(counts.sum()), object)
    flat[:] = [w for p in parts for w in p]
    codes, distinct = pd.factorize(flat)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[codes] if len(flat) else np.zeros(0, np.uint64)
    out, at = [], 0
    for n in counts:
        own, at = hashes[at : at + n], at + n
        if not n:
            out.append(own)
            continue
        k = min(size, n)
        total = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            total += _mix(own[j : n - k + 1 + j] * _PLACE[j])
        out.append(np.unique(_mix(total)))
    return out


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Minwise tokens of a non-empty set."""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        least = np.minimum(least, ((part[:, None] + _ADD) * _MUL).min(0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def signatures(docs: DataFrame, text: str, key: str, size: int, block_bytes: int = 4_000_000) -> DataFrame:
    """id, n_shingles, set_id (digest of the set; null if empty), sketch."""
    picked = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in weighted_blocks(batches, "__text", block_bytes):
            sets = shingle_sets(raw_texts(batch.column("__text")), size)
            ids = list(map(_digest, sets))
            sketches = pa.array([sketch(s) if len(s) else None for s in sets], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(ids, pa.binary()), sketches], names=["id", "n_shingles", "set_id", "sketch"])

    return picked.mapInArrow(run, "id bigint, n_shingles bigint, set_id binary, sketch array<int>")


def _filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size for (id); only its non-zero words come to the driver."""
    bit = lambda k: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(FILTER_BITS))
    bits = ids.select(F.explode(F.array(*[bit(k) for k in range(FILTER_HASHES)])).alias("b"))
    words = bits.groupBy(F.shiftright("b", 5).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("b", F.lit(32)).cast("int"))).alias("v")).toArrow()
    out = np.zeros(FILTER_BITS // 32, np.uint32)
    out[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return out


def _digest(hashes: np.ndarray) -> bytes | None:
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def _sets(docs: DataFrame, classes: DataFrame, text: str, key: str, size: int, block_bytes: int = 4_000_000) -> DataFrame:
    """rep, set (its sorted hashes as bytes) of each of classes (rep, id, set_id); only documents that the filter of ids lets through are read: all of ids, hardly any other."""
    sent = docs.sparkSession.sparkContext.broadcast(_filter(classes.select("id")))
    bits = [F.pmod(F.xxhash64(F.col("id"), F.lit(k)), F.lit(FILTER_BITS)) for k in range(FILTER_HASHES)]
    picked = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("__text")).where(F.col("id").isNotNull()).withColumn("__bits", F.array(*bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value
        for whole in batches:
            b = whole.column("__bits").flatten().to_numpy().reshape(-1, FILTER_HASHES)
            some = whole.filter(pa.array(((words[b >> 5] >> (b & 31).astype(np.uint32)) & 1).all(1)))
            for batch in weighted_blocks(iter([some]), "__text", block_bytes):
                sets = shingle_sets(raw_texts(batch.column("__text")), size)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_digest, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set_id", "set"])

    # rows that share id and set give one row
    return picked.mapInArrow(run, "id bigint, set_id binary, set binary").join(classes, ["id", "set_id"]).select("rep", "set").dropDuplicates(["rep"])


def forest(sketches: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph that joins sketches agreeing in at least `least` places."""
    edges, left = [], np.arange(len(sketches))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = (sketches[left] == sketches[x]).sum(1) >= least
            edges += [(int(x), int(y)) for y in left[hit]]
            queue += left[hit].tolist()
            left = left[~hit]
    return edges


def linked(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among sets: 100 * intersection >= percent * union, on full sets.

    A set's intersections with all others are counted from postings of its shingles.
    """
    sizes = np.array(list(map(len, sets)), np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(code, kind="stable")
    postings, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(code))])
    begins = np.cumsum(sizes) - sizes
    edges, left = [], np.ones(len(sets), bool)
    for root in range(len(sets)):
        if not left[root]:
            continue
        left[root], queue = False, [root]
        while queue and left.any():
            x = queue.pop()
            own = code[begins[x] : begins[x] + sizes[x]]
            lo, n = starts[own], starts[own + 1] - starts[own]
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            both = np.bincount(postings[at], minlength=len(sets))
            hit = np.flatnonzero(left & (100 * both >= percent * (sizes[x] + sizes - both)))
            edges += [(x, int(y)) for y in hit]
            left[hit] = False
            queue += hit.tolist()
    return edges


def _candidate_edges(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out_a, out_b = [], []
        for members in batch.column("members"):
            ids = members.values.field("rep").to_numpy()
            for x, y in forest(members.values.field("sketch").flatten().to_numpy().reshape(-1, SKETCH), least):
                out_a.append(ids[x])
                out_b.append(ids[y])
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["u", "v"])


def _link_edges(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out_a, out_b = [], []
        for members in batch.column("members"):
            ids = members.values.field("id").to_numpy()
            for x, y in linked([np.frombuffer(m.as_buffer(), np.uint64) for m in members.values.field("set")], percent):
                out_a.append(ids[x])
                out_b.append(ids[y])
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["u", "v"])


def join_components(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80, trees: int = 6, branches: int = 2, links: bool = False) -> DataFrame:
    """id, n_shingles, component_id for every row of docs; component_id is the least id reachable over links.

    With links=True instead confirmed links (u, v) between class representatives that make up the components.
    """
    s = percent / 100
    least = max(1, int(SKETCH * (s - 5 * (s * (1 - s) / SKETCH) ** 0.5)))
    base = written(signatures(docs, text, key, size), "signatures")
    known = base.where(F.col("id").isNotNull() & F.col("set_id").isNotNull())
    least_ids = known.groupBy("set_id").agg(F.min("id").alias("id"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n"))
    nth = F.row_number().over(W.Window.partitionBy("id").orderBy("set_id"))
    above = F.lit(1 << 62) + F.pmod(F.xxhash64("set_id"), F.lit(1 << 61))
    reps = written(least_ids.withColumn("nth", nth).select("set_id", "id", "sketch", "n_shingles", "n", F.when(F.col("nth") == 1, F.col("id")).otherwise(above).alias("rep")), "classes")

    def child(node, j, chosen):
        return F.xxhash64(node, j, F.element_at("sketch", (chosen + 1).cast("int")))

    # roots: coordinates without repetition, so that branches are independent
    coordinate = F.pmod(F.col("j") * 37 + 11, F.lit(SKETCH))
    level = reps.select("rep", "sketch", F.explode(F.sequence(F.lit(0), F.lit(trees * branches - 1))).alias("j")).select("rep", child(F.lit(0), F.col("j"), coordinate).alias("node"))
    edges = []
    for depth in range(LEVELS + 1):
        level = written(level, f"nodes{depth}")
        counts = level.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > 1)
        level = written(hot_join(level, counts, "node", "n", level.count()), f"level{depth}")
        large = level.where(F.col("n") > SMALL)
        last = depth == LEVELS
        groups = level.where(F.col("n") <= SMALL).select("node", "rep", F.lit(0).alias("i"), F.lit(0).alias("j"))
        if last:
            # every two parts of what is still large
            parts = F.ceil(F.col("n") * 2 / SMALL).cast("int")
            groups = groups.unionByName(_pairs_of_parts(large, F.pmod(F.xxhash64("rep"), parts).cast("int"), parts).select("node", "rep", "i", "j"))
        members = groups.join(reps.select("rep", "sketch"), "rep").groupBy("node", "i", "j").agg(F.collect_list(F.struct("rep", "sketch")).alias("members")).select("members")
        edges.append(written(members.mapInArrow(lambda it: _candidate_edges(it, least), "u bigint, v bigint").distinct(), "candidates"))
        if last or large.isEmpty():
            break
        forked = large.join(reps.select("rep", "sketch"), "rep").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(1))))
        level = forked.select("rep", child(F.col("node"), F.col("j"), F.pmod(F.xxhash64("node", "j"), F.lit(SKETCH))).alias("node"))

    # clusters of candidates hold every link; links are found on full sets, cluster by cluster
    clusters = written(components(reduce(DataFrame.union, edges)).join(reps.select("rep", "n_shingles"), F.col("node") == F.col("rep")).select("rep", F.col("component").alias("cluster"), "n_shingles"), "clusters")
    weight = clusters.groupBy("cluster").agg(F.sum("n_shingles").alias("w"), F.count("*").alias("n"))
    parts = F.ceil(F.col("w") / F.lit(PART_SHINGLES)).cast("int")
    spread = _pairs_of_parts(hot_join(clusters, weight, "cluster", "n", clusters.count()), F.pmod(F.xxhash64("rep"), parts).cast("int"), parts)
    sets = written(_sets(docs, reps.join(clusters.select("rep"), "rep", "left_semi").select("rep", "id", "set_id"), text, key, size), "sets")
    members = spread.join(sets, "rep").groupBy("cluster", "i", "j").agg(F.collect_list(F.struct(F.col("rep").alias("id"), "set")).alias("members")).select("members")
    found = written(members.mapInArrow(lambda it: _link_edges(it, percent), "u bigint, v bigint"), "links")
    if links:
        return found.distinct()
    # classes that share an id
    several = known.groupBy("id").agg(F.min("set_id").alias("a"), F.max("set_id").alias("b")).where(F.col("a") != F.col("b")).select("id")
    shared = known.join(several, "id").select("id", "set_id").distinct().join(reps.select("set_id", "rep"), "set_id")
    least_rep = shared.groupBy("id").agg(F.min("rep").alias("v"))
    groups = components(found.union(shared.join(least_rep, "id").select(F.col("rep").alias("u"), "v")))
    of_class = reps.select("set_id", "rep", "n").join(groups, F.col("rep") == F.col("node"), "left").select("set_id", "n", F.coalesce("component", "rep").alias("component_id"))
    in_class = hot_join(known.select("id", "n_shingles", "set_id"), of_class, "set_id", "n", base.count())
    alone = base.where(F.col("id").isNull() | F.col("set_id").isNull()).select("id", "n_shingles", F.col("id").alias("component_id"))
    return in_class.select("id", "n_shingles", "component_id").union(alone)


def _pairs_of_parts(rows: DataFrame, part, parts) -> DataFrame:
    """rows, each once for every pair (i <= j) of parts that its own part is in; one part makes the pair (0, 0) only."""
    other = F.explode(F.sequence(F.lit(0), F.greatest(parts - 1, F.lit(0))))
    return rows.withColumn("p", part).withColumn("o", other).where((F.col("p") != F.col("o")) | (parts <= 1)).withColumn("i", F.least("p", "o")).withColumn("j", F.greatest("p", "o"))


def deduplicated(docs: DataFrame, text: str = "text", key: str = "doc_id", size: int = 5, percent: int = 80) -> DataFrame:
    """docs without the documents that a lesser id stands for; null ids stay."""
    name = distinct_name(docs, "gone_id")
    gone = join_components(docs, text, key, size, percent).where(F.col("id") != F.col("component_id")).select(F.col("id").alias(name)).distinct()
    return docs.join(gone, F.col(key).cast("bigint") == F.col(name), "left_anti")


def op2(docs: DataFrame) -> DataFrame:
    found = join_components(docs, size=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
