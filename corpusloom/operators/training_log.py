"""Rollups over a training log with one row per step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.schedule import cosine_lr
from corpusloom.operators.positions import FANOUT_BITS, id_bucket, running_totals


def closes_interval(step: Column, every: int) -> Column:
    return F.pmod(step + 1, F.lit(every)) == 0


def cadence(log: DataFrame, *every: int) -> DataFrame:
    """Rows on which every given cadence falls."""
    for k in every:
        log = log.where(closes_interval(F.col("step"), k))
    return log


def interval_loss(log: DataFrame, every: int) -> DataFrame:
    """Loss summed over an interval, divided by its nominal length; open intervals are left out."""
    return (
        log.groupBy(F.floor(F.col("step") / every).cast("long").alias("interval"))
        .agg(F.sum("loss").alias("total"), F.max(closes_interval(F.col("step"), every)).alias("closed"))
        .where("closed")
        .select(
            ((F.col("interval") + 1) * every).alias("step"),
            (F.col("total") / every).alias("loss"),
        )
    )


def seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def throughput(log: DataFrame, step_tokens: int, every: int, start_step: int = 0, started: Column | None = None) -> DataFrame:
    """Cumulative tokens and tokens per second since the run ``started``.

    A log has the ends of its steps only. Without ``started`` the clock begins with the
    first of them, so that step's own time is missing. Tokens of steps before a resume
    count as well, so the rate is too high after one.
    """
    begin = log.agg(F.min_by("ts", "step")).scalar() if started is None else started
    tokens = running_totals(
        log, {"before": F.lit(step_tokens).cast("long")}, bucket=id_bucket("step", FANOUT_BITS), order=["step"],
    )
    rows = tokens.where(closes_interval(F.col("step"), every))
    elapsed = seconds(F.col("ts")) - seconds(begin)
    seen = F.col("before") + step_tokens * (start_step + 1)
    return rows.select(
        (F.col("step") + 1).alias("step"),
        seen.alias("tokens_seen"),
        F.when(elapsed > 0, seen / elapsed).otherwise(F.lit(0.0)).alias("tok_per_sec"),
    )


def step_latency(log: DataFrame) -> DataFrame:
    """Milliseconds since the step before. The last row of a bucket is also handed to the
    next bucket, so ``lag`` never needs one window over all steps."""
    width = 1 << FANOUT_BITS
    own = id_bucket("step", FANOUT_BITS)
    homes = F.when(F.pmod("step", F.lit(width)) == width - 1, F.array(own, own + 1)).otherwise(F.array(own))
    rows = log.select("step", "ts", own.alias("own"), F.explode(homes).alias("home"))
    w = Window.partitionBy("home").orderBy("step")
    ms = (F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))) / F.lit(1000.0)
    return rows.withColumn("step_ms", ms).where("own = home").select("step", "step_ms")


def eval_mean(losses: DataFrame, steps: DataFrame) -> DataFrame:
    """Mean held-out loss for each evaluated step, 0 where no batch was read."""
    means = losses.groupBy("step").agg(F.avg("loss").alias("m"))
    return steps.join(means, "step", "left").select("step", F.coalesce("m", F.lit(0.0)).alias("eval_loss"))


def lr_schedule(
    log: DataFrame, max_lr: float, min_lr: float, warmup_steps: int, max_steps: int, tolerance: float = 1e-9
) -> DataFrame:
    """Expected rate of each logged step, and whether a logged ``lr`` deviates from it."""
    out = log.withColumn("expected_lr", cosine_lr(F.col("step"), max_lr, min_lr, warmup_steps, max_steps))
    if "lr" in log.columns:
        out = out.withColumn("deviates", F.abs(F.col("lr") - F.col("expected_lr")) > tolerance)
    return out


def encode_progress(batches: DataFrame, max_tokens: int = 0) -> DataFrame:
    """Running progress of an encoding run from its batch log ``(batch, ts, docs, tokens)``."""
    run = running_totals(
        batches, {"docs_before": F.col("docs"), "tokens_before": F.col("tokens")},
        bucket=id_bucket("batch", FANOUT_BITS), order=["batch"],
    )
    begin = batches.agg(F.min_by("ts", "batch")).scalar()
    done = F.col("tokens_before") + F.col("tokens")
    rate = F.when(F.col("elapsed") > 0, F.col("total_tokens") / F.col("elapsed"))
    out = run.select(
        "batch",
        (F.col("docs_before") + F.col("docs")).alias("total_docs"),
        done.alias("total_tokens"),
        (seconds(F.col("ts")) - seconds(begin)).alias("elapsed"),
    )
    out = out.withColumn("tok_per_sec", rate)
    if max_tokens:
        left = F.lit(max_tokens) - F.col("total_tokens")
        out = out.withColumns({
            "pct": F.col("total_tokens") / F.lit(max_tokens) * 100,
            "eta_seconds": F.when(F.col("tok_per_sec") > 0, left / F.col("tok_per_sec")).otherwise(F.lit(0.0)),
        })
    return out
