"""Held-out scoring of token windows and one-step candidate sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def target_pairs(windows: DataFrame) -> DataFrame:
    """One row per distinct (token, next token) of ``x, y`` windows, with its count."""
    return (
        windows.select(F.explode(F.arrays_zip("x", "y")).alias("p"))
        .groupBy(F.col("p.x").alias("prev"), F.col("p.y").alias("next"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def heldout_ce(train: DataFrame, held_out: DataFrame, vocab_size: int, ignore: int = -1) -> DataFrame:
    """Mean cross-entropy of held-out targets under add-one bigram counts of ``train``.

    Both sides are counted per pair first, so the join sees distinct pairs only.
    """
    seen = target_pairs(train).where(F.col("next") != ignore)
    context = seen.groupBy("prev").agg(F.sum("n").alias("prev_n"))
    wanted = target_pairs(held_out).where(F.col("next") != ignore)
    scored = (
        wanted.withColumnRenamed("n", "k")
        .join(seen, ["prev", "next"], "left")
        .join(context, "prev", "left")
    )
    p = (F.coalesce("n", F.lit(0)) + 1) / (F.coalesce("prev_n", F.lit(0)) + vocab_size)
    return scored.agg(
        F.sum("k").alias("targets"),
        (F.sum(-F.log(p) * F.col("k")) / F.sum("k")).alias("loss"),
    )


def last_seen(events: DataFrame, key: str, item: str, order: list[str], n: int) -> DataFrame:
    """Distinct items among the last ``n`` rows of each key. Spark keeps ``n`` rows per key
    and task before the shuffle, so a hot key moves little."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return events.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).select(key, item).distinct()


def next_distribution(
    scores: DataFrame, seen: DataFrame, key: str, item: str, *,
    top_k: int = 50, temperature: float = 0.8, penalty: float = 1.2,
) -> DataFrame:
    """Probabilities of the next item of each key from ``scores(key, item, score)``.

    Scores of seen items are weakened, all are divided by the temperature, and those
    below the k-th best are out; ties with the k-th stay.
    """
    marked = scores.join(seen.withColumn("_seen", F.lit(True)), [key, item], "left")
    s = F.col("score").cast("double")
    weak = F.when(F.col("_seen").isNull() | F.lit(penalty == 1.0), s).when(s < 0, s * penalty).otherwise(s / penalty)
    scaled = marked.select(key, item, (weak / F.lit(max(temperature, 1e-8))).alias("logit"))
    by_score = Window.partitionBy(key).orderBy(F.col("logit").desc())
    kept = scaled.withColumn("_rank", F.rank().over(by_score))
    if top_k > 0:
        kept = kept.where(F.col("_rank") <= top_k)
    group = Window.partitionBy(key)
    e = F.exp(F.col("logit") - F.max("logit").over(group))
    return kept.withColumn("_e", e).select(key, item, "logit", (F.col("_e") / F.sum("_e").over(group)).alias("p"))


def draw(distribution: DataFrame, key: str, item: str, seed: int = 0) -> DataFrame:
    """One item per key with the given probabilities: the largest ``log p`` plus Gumbel
    noise from a seeded digest, so a repeated task draws the same item."""
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(key).cast("string"), F.col(item).cast("string")))
    bits = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double")
    u = (bits + F.lit(0.5)) / F.lit(2.0**52)
    noisy = F.log("p") - F.log(-F.log(u))
    return distribution.groupBy(key).agg(F.max_by(item, noisy).alias(item))
