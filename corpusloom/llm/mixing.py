"""Mixing sources to target weights by repeating documents.

Tokens are totalled per source, weights become targets, and targets become repetition
rates. A document is taken ``floor(rate)`` times and once more where a number drawn from
its id and the seed falls below the fraction, so reruns and retried tasks agree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.text import text_of, word_count
from corpusloom.session import cut

WEIGHTS = (3, 1, 2)
BUDGET_PERCENT = 150
MOST_REPEATS = 2
SEED = 20


@dataclass(frozen=True)
class Mix:
    """``rows``: the input columns with ``__size``; ``targets(__source, __source_size, __target)``."""

    rows: DataFrame
    targets: DataFrame


def unit_draw(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the leading 52 bits of an MD5 over seed and key; 52 bits are exact in a double."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, most: int = MOST_REPEATS) -> DataFrame:
    """``(__source, __source_size, __target)`` from ``sizes(__source, __size)``.

    Sources in code-point order, null last, take the weights in turn. They share
    ``budget_percent`` of all tokens; a target stops at ``most`` times its source's size
    and the excess goes to the others by weight. A source is full exactly when its
    ``most * size / weight`` does not exceed the level at which the budget runs out, so
    the level follows from running sums over sources ordered by that ratio. There is one
    row per source here, summed before any shuffle.
    """
    per_source = sizes.groupBy("__source").agg(F.sum("__size").alias("__source_size"))
    ranked = per_source.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("__source").asc_nulls_last())) - 1)
    weighted = ranked.withColumns({
        "_w": F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")).cast("long"),
        "_cap": F.col("__source_size") * most,
    })
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_weight = F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(before), F.lit(0))
    budget = F.sum("__source_size").over(whole) * F.lit(budget_percent)  # in hundredths
    rest = budget - F.lit(100) * F.coalesce(F.sum("_cap").over(before), F.lit(0))
    # With all smaller ratios full, this source is full too where its share of the rest reaches its cap.
    shared = weighted.withColumns({"_rest": rest, "_open": open_weight})
    shared = shared.withColumn("_full", F.col("_cap") * 100 * F.col("_open") <= F.col("_rest") * F.col("_w"))
    first_open = F.min_by(F.struct("_rest", "_open"), F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), "_rank"))).over(whole)
    level = shared.withColumn("_level", first_open)
    target = F.when(F.col("_full") | F.col("_level").isNull(), F.col("_cap").cast("double")).otherwise(
        F.col("_w") * F.col("_level._rest") / (F.lit(100.0) * F.col("_level._open"))
    )
    return level.select("__source", "__source_size", target.alias("__target"))


def measure(docs: DataFrame, weights=WEIGHTS, budget_percent: int = BUDGET_PERCENT, most: int = MOST_REPEATS) -> Mix:
    rows = docs.withColumn("__size", word_count(text_of()))
    sizes = rows.select(F.col("source").cast("string").alias("__source"), "__size")
    # One row per source: written once, so that reruns of a stage see the same targets.
    return Mix(rows, cut(source_targets(sizes, weights, budget_percent, most), "targets"))


def with_copies(mix: Mix, seed: int = SEED) -> DataFrame:
    """Input rows with ``__size``, ``__source_size``, ``__target`` and ``__copies``.

    Null or empty texts have size 0 and their source's number of copies; a source of size
    0 has rate 0. A null id draws from the empty key. Rows repeated in the input are drawn
    alike. Sources are few, one row each, and the join is left to adaptive planning.
    """
    joined = mix.rows.withColumn("__source", F.col("source").cast("string")).join(
        mix.targets.withColumnRenamed("__source", "__target_source"), F.col("__source").eqNullSafe(F.col("__target_source"))
    )
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    fraction = rate - F.floor(rate)
    copies = F.floor(rate) + (unit_draw(F.col("doc_id"), seed) < fraction).cast("long")
    return joined.withColumn("__copies", copies.cast("long"))


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    taken = with_copies(measure(docs), seed)
    copies = F.explode(F.array_repeat(F.lit(0), F.col("__copies").cast("int")))
    return taken.select(*docs.columns, copies.alias("__copy")).select(*docs.columns)
