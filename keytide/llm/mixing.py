"""Mixing sources to target weights by temperature.

A source's target weight is its share of tokens to the power of an exponent between 0 and 1, normalised. The exponent is
bisected: the smallest one at which no source is repeated more than `repeats` times as often as it has tokens or, given `entropy`, the
one at which the weights have that entropy. Without a budget the mix is as large as needed for every row to come at
least once, so it drops nothing; with a budget in tokens, sources above their weight are cut.

Weights are realised by block permutations: each source's rows are dealt into blocks by hash; each pass goes through the blocks, and
through the rows of a block, in a new pseudo-random order; the last pass stops where the source's budget is met, to within one
row. Only sums per source and per block are grouped, so no task holds a whole source; rows aren't shuffled: each row is
joined with its source's plan and its blocks are a function of its key.

A token is a word, [^\\x20\\x09-\\x0D]+. Edge cases: null sources are one source; sources without tokens come once; null and empty
texts have no tokens and come with their blocks; repeated rows are alike and come or go together; an empty table gives an
empty result; other columns are kept by `mixed`, and may have any names but those that begin with "_kt_".
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keytide.llm.shared import saved, table

REPEATS, BLOCK_ROWS, SEED = 2.0, 4096, 17
#: Sources up to which their plans are broadcast (some 100 bytes each); more are joined by shuffle.
MANY_SOURCES = 50_000
STEPS, WAYS = 7, 16


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_kt_source": F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")), "_kt_key": F.xxhash64(F.lit(SEED), "doc_id", "text")})


def _measures(totals: DataFrame):
    """A function of exponents: for each, sums over the sources with tokens that tell entropy and repeats; and all tokens.

    Up to MANY_SOURCES totals come to the driver, once; more are summed by Spark for each step."""
    got = [r.tokens for r in totals.where("tokens > 0").select("tokens").limit(MANY_SOURCES + 1).collect()]
    if len(got) <= MANY_SOURCES:
        share = np.array(sorted(got), float) / max(1, sum(got))

        def near(tries: list[float]) -> list[tuple]:
            return [(float((w := share**a).sum()), float((w * a * np.log(share)).sum()), float((x := share ** (a - 1)).max()), float(x.min())) for a in tries]

        return near, sum(got)
    every = totals.agg(F.sum("tokens")).first()[0]
    p = F.col("tokens") / F.lit(every)

    def far(tries: list[float]) -> list[tuple]:
        sums = [x for a in tries for x in (F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * a * F.log(p)), F.max(F.pow(p, F.lit(a - 1))), F.min(F.pow(p, F.lit(a - 1))))]
        row = totals.where("tokens > 0").agg(*(x.alias(f"x{i}") for i, x in enumerate(sums))).first()
        return [tuple(row[4 * i : 4 * i + 4]) for i in range(len(tries))]

    return far, every


def exponent(totals: DataFrame, repeats: float, entropy: float | None, budget: float | None) -> float:
    """The exponent for totals(tokens), one row for each source. Each step evaluates WAYS exponents at once."""
    low, high = 0.0, 1.0
    measures, every = _measures(totals)
    if not every:
        return 1.0
    for _ in range(STEPS):
        tries = [low + (high - low) * i / WAYS for i in range(WAYS + 1)]
        got = measures(tries)

        def fits(i: int) -> bool:
            z, logs, most, least = got[i]  # noqa: B023
            if entropy is not None:
                return math.log(z) - logs / z <= entropy + 1e-12
            return most * (1 / least if budget is None else budget / every / z) <= repeats + 1e-12

        first = next((i for i in range(WAYS + 1) if fits(i)), WAYS)
        if first == 0:
            return tries[0]
        low, high = tries[first - 1], tries[first]
    return high


def plan(rows: DataFrame, repeats: float, entropy: float | None, budget: float | None) -> tuple[DataFrame, bool]:
    """For rows(_kt_source, _kt_key, tokens): (_kt_source, _kt_weight, _kt_passes, _kt_blocks, _kt_cut_rank, _kt_cut_key), a row for each source; and
    whether these are few enough to be broadcast.

    Passes are whole; in one more, rows come whose block's rank is below the cut's, or equal and their own rank at most the cut's.
    """
    totals = saved(rows.groupBy("_kt_source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("rows")), "mix-sources")
    a = exponent(totals, repeats, entropy, budget)
    sums = totals.agg(F.sum("tokens"), F.count("*")).first()
    every, few = sums[0] or 1, sums[1] <= MANY_SOURCES
    shares = totals.withColumn("p", F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.lit(every), F.lit(a))))
    norm = shares.agg(F.sum("p").alias("z"), F.max(F.col("tokens") / F.col("p")).alias("most")).first()
    shares = shares.withColumn("_kt_weight", F.coalesce(F.col("p") / F.lit(norm["z"] or 1.0), F.lit(0.0)))
    goal = F.col("p") * F.lit(norm["most"] or 0.0) if budget is None else F.col("_kt_weight") * F.lit(float(budget))
    shares = shares.withColumn("times", F.coalesce(goal / F.col("tokens"), F.lit(1.0)))
    whole = F.floor(F.col("times") + 1e-9)
    shares = shares.select(
        "_kt_source", "_kt_weight", whole.alias("_kt_passes"), F.ceil(F.col("rows") / BLOCK_ROWS).alias("_kt_blocks"), (F.greatest(F.lit(0.0), F.col("times") - whole) * F.col("tokens")).alias("rest")
    )
    shares = saved(shares, "mix-plan")
    dealt = with_plan(rows, shares, few).withColumns({"_kt_rank": block_rank(F.col("_kt_passes")), "_kt_own": own_rank(F.col("_kt_passes"))}).where("rest > 0")
    blocks = dealt.groupBy("_kt_source", "rest", "_kt_rank").agg(F.sum("tokens").alias("tokens"))
    through = Window.partitionBy("_kt_source").orderBy("_kt_rank")
    blocks = blocks.withColumn("through", F.sum("tokens").over(through)).withColumn("before", F.col("through") - F.col("tokens"))
    cut = blocks.where("before < rest and through >= rest").select("_kt_source", "_kt_rank", "before")
    at_cut = dealt.join(F.broadcast(cut) if few else cut, ["_kt_source", "_kt_rank"])
    own = Window.partitionBy("_kt_source").orderBy("_kt_own")
    at_cut = at_cut.withColumn("upto", F.sum("tokens").over(own)).where(F.col("before") + F.col("upto") - F.col("tokens") / 2 <= F.col("rest"))
    keys = at_cut.groupBy("_kt_source").agg(F.max("_kt_own").alias("_kt_cut_key"))
    ends = cut.select("_kt_source", F.col("_kt_rank").alias("_kt_cut_rank")).join(keys, "_kt_source", "left")
    return saved(shares.join(ends, "_kt_source", "left").drop("rest"), "mix-plan"), few


def with_plan(rows: DataFrame, shares: DataFrame, few: bool) -> DataFrame:
    rows = rows.join(F.broadcast(shares) if few else shares, "_kt_source")
    return rows.withColumn("_kt_block", F.pmod(F.col("_kt_key"), F.col("_kt_blocks")))


def block_rank(epoch: Column) -> Column:
    return F.xxhash64(F.lit(SEED), F.lit("block"), epoch, "_kt_source", "_kt_block")


def own_rank(epoch: Column) -> Column:
    return F.xxhash64(F.lit(SEED), F.lit("row"), epoch, "_kt_key")


def mixed(docs: DataFrame, repeats: float = REPEATS, entropy: float | None = None, budget: float | None = None) -> DataFrame:
    """A row of docs for each time it comes, with _kt_weight (of its source), _kt_epoch (the pass), _kt_rank (its block's place in the pass)
    and _kt_own (its place in the block)."""
    rows = saved(_keyed(docs).select("_kt_source", "_kt_key", n_tokens(F.col("text")).alias("tokens")), "mix-rows")
    shares, few = plan(rows, repeats, entropy, budget)
    rows = with_plan(_keyed(docs), shares.select("_kt_source", "_kt_weight", "_kt_passes", "_kt_blocks", "_kt_cut_rank", "_kt_cut_key"), few)
    last, own = block_rank(F.col("_kt_passes")), own_rank(F.col("_kt_passes"))
    more = F.coalesce((last < F.col("_kt_cut_rank")) | ((last == F.col("_kt_cut_rank")) & (own <= F.col("_kt_cut_key"))), F.lit(False))
    times = F.col("_kt_passes") + more.cast("long")
    rows = rows.withColumn("_kt_times", times).where("_kt_times > 0")
    rows = rows.withColumn("_kt_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_kt_times") - 1)))
    return rows.withColumns({"_kt_rank": block_rank(F.col("_kt_epoch")), "_kt_own": own_rank(F.col("_kt_epoch"))}).select(
        *docs.columns, "_kt_weight", "_kt_epoch", "_kt_rank", "_kt_own"
    )


def op10_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    rows = mixed(docs).select("doc_id", "source", n_tokens(F.col("text")).alias("n_tokens"), F.col("_kt_weight").alias("weight"), F.col("_kt_epoch").alias("epoch"), F.col("_kt_rank").alias("block"), "_kt_own")
    place = Window.partitionBy("source", "epoch", "block").orderBy("_kt_own", "doc_id")
    return rows.withColumn("place", F.row_number().over(place).cast("long") - 1).drop("_kt_own")
