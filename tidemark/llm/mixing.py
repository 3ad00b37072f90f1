"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

Targets: sources share total * budget words by weight; a source stops at `most` times its own words and the excess is
shared again by weight (water filling, in closed form over sources sorted by words / weight; one row a source).
Copies: within a source a document is expected r = min(most, theta * chance) times, theta being such that the words of all r copies make
up the source's target. Chances are positive numbers, here by default size / (size + HALF), so that short texts are taken less often; they are
rounded to steps of 1 / STEPS octave, so that theta follows in closed form from the words of each step.
Sampling: floor(r) whole copies are allotted for certain. The rest, with inclusion probability p = r - floor(r), is decided by
Pareto order sampling: documents are ranked by random odds divided by inclusion odds, (u / (1 - u)) / (p / (1 - p)), u being a hash of id
and seed, and the smallest ranks are taken until the source's remaining words are used up; what stands at the cut is taken in part, so that
the size of the sample is fixed in words.

The cut is found by radix selection: ranks are folded into [0, 1), and words are summed per source and digit of that
number, level by level, so that no task holds the documents of a source. Documents of one rank at the cut (one, but for repeated ids) share
what is left by their sizes. What a document gets follows from its own row and its source's row (theta, cut); nothing is joined by id.

Defined results: null text has size 0; null source is a source of its own, last in order; empty documents take 0 words;
repeated rows get the same count each; chances that are null, not positive or beyond 2 ** 16 either way count as the nearest step; an empty
table gives an empty result; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from tidemark.llm._shared import WORD_RE, distinct_name, written

#: Digits of the folded rank: LEVELS times BITS bits.
BITS, LEVELS = 8, 6
#: Steps of an octave of chance, and the steps that there are on either side of 1.
STEPS, SIDE = 64, 1024
#: The size in words at which a document's default chance is a half.
HALF = 64.0


def words(text: str = "text") -> Column:
    """Number of maximal runs of characters other than white space."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD_RE)).cast("bigint")


def by_size(size: Column) -> Column:
    return size / (size + F.lit(HALF))


def targets(sizes: DataFrame, weights: Sequence[float], budget: float, most: float) -> DataFrame:
    """source, source_size, target; sizes: one row (source, source_size) a source. Weights repeat over sources in code-point order, null last."""
    order = W.Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    base = sizes.withColumn("__w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    by_fill = W.Window.orderBy(F.col("source_size") / F.col("__w"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(W.Window.unboundedPreceding, -1)
    whole = W.Window.partitionBy()
    filled = (
        base.withColumn("__all", F.sum("source_size").over(whole) * F.lit(float(budget)))
        .withColumn("__level", (F.col("__all") - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0.0))) / (F.sum("__w").over(whole) - F.coalesce(F.sum("__w").over(before), F.lit(0.0))))
        # sources full at their own level are full; the first that is not sets the level of all that follow
        .withColumn("__full", F.col("source_size") * most <= F.col("__level") * F.col("__w"))
        .withColumn("__l", F.min(F.when(~F.col("__full"), F.struct(F.col("source_size") / F.col("__w"), F.col("source").isNull(), F.col("source"), F.col("__level")))).over(whole)["__level"])
    )
    return filled.select("source", "source_size", F.when(F.col("__full"), F.col("source_size") * F.lit(float(most))).otherwise(F.col("__l") * F.col("__w")).alias("target"))


def _drawn(size: Column, key: Column, source: Column, chance: Callable[[Column], Column], seed: int) -> Column:
    """What the mix needs of a document: id, source, size, level (its step of chance), u."""
    step = F.round(F.log2(F.greatest(chance(size).cast("double"), F.lit(1e-9))) * STEPS).cast("int")
    level = F.coalesce(F.least(F.greatest(step, F.lit(-SIDE)), F.lit(SIDE)), F.lit(-SIDE))
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / F.lit(float(1 << 52))
    return F.struct(key.alias("id"), source.cast("string").alias("source"), size.alias("size"), level.alias("level"), u.alias("u"))


def _copies(level: Column, theta: Column, most: float) -> Column:
    """Expected copies; without theta the source is full."""
    return F.coalesce(F.least(F.lit(float(most)), theta * F.pow(F.lit(2.0), level / F.lit(float(STEPS)))), F.lit(float(most)))


def _rank(u: Column, p: Column) -> Column:
    """odds / (1 + odds) keeps the order of the Pareto ratio and lies in (0, 1)."""
    odds = (u / (1 - u)) / (p / (1 - p))
    return F.least(F.floor(odds / (1 + odds) * F.lit(float(1 << (BITS * LEVELS)))).cast("bigint"), F.lit((1 << (BITS * LEVELS)) - 1))


def _taken(m: Column, g: Column, most: float) -> Column:
    """Words that the mix takes of a document m of a source g."""
    r = _copies(m["level"], g["theta"], most)
    p, rank = r - F.floor(r), _rank(m["u"], r - F.floor(r))
    partly = F.when(rank == g["cut"], F.floor(g["rest"] * m["size"] / F.greatest(g["tied"], F.lit(1)))).otherwise(F.lit(0))
    extra = F.when(p <= 0, F.lit(0)).when(g["cut"].isNull() | (rank < g["cut"]), m["size"]).otherwise(partly)
    return (F.floor(r) * m["size"] + extra).cast("bigint")


def _thetas(steps: DataFrame, goal: DataFrame, most: float) -> DataFrame:
    """goal with theta; steps: source, level, words. Documents of great chance are full first; the first step that is not full tells theta."""
    c = F.pow(F.lit(2.0), F.col("level") / F.lit(float(STEPS)))
    from_top = W.Window.partitionBy("source").orderBy(F.col("level").desc())
    above = from_top.rowsBetween(W.Window.unboundedPreceding, -1)
    below = from_top.rowsBetween(0, W.Window.unboundedFollowing)
    joined = steps.where("words > 0").join(goal.select(F.col("source").alias("s"), "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    own = joined.withColumn("theta", (F.col("target") - F.coalesce(F.sum(F.col("words") * most).over(above), F.lit(0.0))) / F.sum(F.col("words") * c).over(below))
    open_ = own.where(F.col("theta") * c < F.lit(float(most))).groupBy("source").agg(F.max_by("theta", "level").alias("theta"))
    return goal.join(open_.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def _goals(base: DataFrame, weights: Sequence[float], budget: float, most: float) -> DataFrame:
    """source, source_size, target, theta, cut (rank), rest and tied (words left there, and words that stand there): a row a source."""
    steps = written(base.groupBy("source", "level").agg(F.sum("size").alias("words")), "mix-steps")
    goal = targets(steps.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget, most)
    goal = written(_thetas(steps, goal, most), "mix-targets")
    by_source = goal.select(F.col("source").alias("s"), "theta", "target")
    r = _copies(F.col("level"), F.col("theta"), most)
    whole = steps.join(by_source, F.col("source").eqNullSafe(F.col("s"))).groupBy("s").agg(F.greatest(F.max(F.round("target")).cast("bigint") - F.sum(F.floor(r) * F.col("words")), F.lit(0).cast("bigint")).alias("c_left"))
    p = r - F.floor(r)
    ranked = base.join(by_source, F.col("source").eqNullSafe(F.col("s"))).where(p > 0).select("source", "size", _rank(F.col("u"), p).alias("rank"))
    # the digits of each source's cut, and the words still left there
    cut = written(whole.select(F.col("s").alias("c_source"), "c_left", F.lit(0).cast("bigint").alias("c_tied"), F.lit(0).cast("bigint").alias("c_prefix")), "mix-left")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = ranked.join(cut, F.col("source").eqNullSafe(F.col("c_source")) & (F.shiftright("rank", shift + BITS) == F.col("c_prefix")))
        per = inside.groupBy("c_source", "c_prefix", "c_left", F.shiftright("rank", shift).bitwiseAND(F.lit((1 << BITS) - 1)).alias("digit")).agg(F.sum("size").alias("n"))
        upto = per.withColumn("upto", F.sum("n").over(W.Window.partitionBy("c_source").orderBy("digit").rowsBetween(W.Window.unboundedPreceding, 0)))
        # the first digit at which the sum passes what is left; none: all ranks are taken
        met = upto.where(F.col("upto") > F.col("c_left")).groupBy("c_source", "c_prefix").agg(F.min(F.struct("digit", (F.col("c_left") - F.col("upto") + F.col("n")).alias("rest"), "n")).alias("m"))
        cut = written(met.select("c_source", F.col("m.rest").alias("c_left"), F.col("m.n").alias("c_tied"), (F.shiftleft(F.col("c_prefix"), BITS) + F.col("m.digit")).alias("c_prefix")), f"mix-cut{level}")
    found = goal.join(cut, F.col("source").eqNullSafe(F.col("c_source")), "left")
    return written(found.select("source", "source_size", "target", "theta", F.col("c_prefix").alias("cut"), F.col("c_left").alias("rest"), F.col("c_tied").alias("tied")), "mix-goals")


def mix(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, seed: int = 20240229, text: str = "text", key: str = "doc_id", source: str = "source", chance: Callable[[Column], Column] = by_size) -> DataFrame:
    """key, source, size, source_size, target, taken for every row of docs; chance makes a column of positive numbers of that of sizes."""
    base = written(docs.select(_drawn(words(text), F.col(key), F.col(source), chance, seed).alias("m")).select("m.*"), "mix")
    goals = _goals(base, weights, budget, most).select(F.col("source").alias("s"), F.struct("*").alias("g"))
    m = F.struct("size", "level", "u")
    return base.join(goals, F.col("source").eqNullSafe(F.col("s"))).select(F.col("id").alias(key), "source", "size", F.col("g.source_size").alias("source_size"), F.col("g.target").alias("target"), _taken(m, F.col("g"), most).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, most: float = 2.0, seed: int = 20240229, text: str = "text", key: str = "doc_id", source: str = "source", chance: Callable[[Column], Column] = by_size) -> DataFrame:
    """docs as the mix takes them: a row per whole or partial copy, with the columns of docs; rows of which less than half a copy is taken go, empty ones stay once."""
    drawn = _drawn(words(text), F.col(key), F.col(source), chance, seed)
    goals = _goals(written(docs.select(drawn.alias("m")).select("m.*"), "mix"), weights, budget, most)
    m, s, g, n = (distinct_name(docs, x) for x in ("mix_m", "mix_s", "mix_g", "mix_n"))
    joined = docs.withColumn(m, drawn).join(goals.select(F.col("source").alias(s), F.struct("*").alias(g)), F.col(f"{m}.source").eqNullSafe(F.col(s)))
    size = F.col(f"{m}.size")
    copies = F.when(size > 0, F.floor(_taken(F.col(m), F.col(g), most) / size + 0.5)).otherwise(F.lit(1)).cast("int")
    own = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return joined.select(*own, F.explode(F.array_repeat(F.lit(0), copies)).alias(n)).select(*own)


def op4(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
