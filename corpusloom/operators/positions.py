"""Exact running totals over a global order, without a one-task window.

Rows are grouped in buckets that follow the order (the leading bits of an integer key).
Each bucket is summed, the small table of bucket totals is accumulated (again by
buckets of buckets, and so on), and rows add their own running sum inside the bucket. A
window therefore never sees more than one bucket, whatever the share of one key in the
data and however far apart its ids lie.
Buckets come from the data, not from partition numbers, so a retried task cannot
change a position. How many levels of buckets there are follows from the bucket totals:
few of them, as dense keys give, are accumulated at once, hashed keys take several levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.session import cut

# Bucket sizes as powers of two.
FANOUT_BITS = 16
DOC_BITS = 10
# Bucket totals that one window takes: small rows, whatever the size of the data.
WINDOW_BITS = 20

BUCKET = "_bucket"
BUCKET_BEFORE = "_bucket_before"
BUCKET_TOTAL = "_bucket_total"


def id_bucket(order: Column | str, bits: int = DOC_BITS) -> Column:
    """Bucket of a unique integer key; holds at most ``2 ** bits`` rows."""
    key = F.col(order) if isinstance(order, str) else order
    return F.shiftright(key.cast("long"), bits)


def bucket_levels(totals: DataFrame) -> int:
    """Levels that keep every window over ``totals`` to ``2 ** WINDOW_BITS`` rows at most."""
    lo, hi, n = totals.agg(F.min(BUCKET), F.max(BUCKET), F.count(F.lit(1))).first()
    if n <= 1 << WINDOW_BITS:
        return 1
    return 1 + max(0, -(-((hi - lo).bit_length() + 1 - WINDOW_BITS) // FANOUT_BITS))


def _accumulate(totals: DataFrame, by: list[str], names: list[str], levels: int) -> DataFrame:
    """Exclusive running sums of ``names`` over ``BUCKET`` inside each ``by`` group."""
    if levels <= 1:
        w = Window.partitionBy(*(by or [F.lit(0)])).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
        return totals.select(
            *by, BUCKET, *names,
            *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"{n}_before") for n in names],
        )
    inner = totals.withColumn("_up", F.shiftright(BUCKET, FANOUT_BITS))
    upper = inner.groupBy(*by, F.col("_up").alias(BUCKET)).agg(*[F.sum(n).alias(n) for n in names])
    upper = _accumulate(upper, by, names, levels - 1).select(
        *by, F.col(BUCKET).alias("_up"), *[F.col(f"{n}_before").alias(f"{n}_up") for n in names]
    )
    w = Window.partitionBy(*by, "_up").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    local = inner.select(
        *by, "_up", BUCKET, *names,
        *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(f"{n}_in") for n in names],
    )
    return local.join(upper.hint("shuffle_hash"), [*by, "_up"]).select(
        *by, BUCKET, *names,
        *[(F.col(f"{n}_in") + F.col(f"{n}_up")).alias(f"{n}_before") for n in names],
    )


def running_totals(
    df: DataFrame,
    values: dict[str, Column],
    *,
    bucket: Column,
    order: Sequence[str | Column],
    by: Sequence[str] = (),
    keep_bucket: bool = False,
) -> DataFrame:
    """Add one column per entry of ``values``: the sum over all earlier rows of the group.

    The bucket totals are written once, to see how many there are; rows stay pending.
    ``bucket`` must never decrease along ``order``. With ``keep_bucket`` the bucket id
    stays in the result, with the first value's total before and inside the bucket.
    """
    by = list(by)
    names = list(values)
    parts = {n: f"_v_{n}" for n in names}
    rows = df.withColumns({BUCKET: bucket, **{parts[n]: values[n] for n in names}})
    totals = cut(rows.groupBy(*by, BUCKET).agg(*[F.sum(parts[n]).alias(parts[n]) for n in names]), "totals")
    before = _accumulate(totals, by, list(parts.values()), bucket_levels(totals))
    first = parts[names[0]]
    before = before.select(
        *by, BUCKET,
        *[F.col(f"{parts[n]}_before").alias(f"_b_{n}") for n in names],
        F.col(f"{first}_before").alias(BUCKET_BEFORE),
        F.col(first).alias(BUCKET_TOTAL),
    )
    w = Window.partitionBy(*by, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({n: F.coalesce(F.sum(parts[n]).over(w), F.lit(0)) for n in names})
    # Rows already lie where their bucket is, so only the totals move, and no side is broadcast.
    out = rows.join(before.hint("shuffle_hash"), [*by, BUCKET])
    out = out.withColumns({n: F.col(n) + F.col(f"_b_{n}") for n in names})
    drop = [*parts.values(), *[f"_b_{n}" for n in names]]
    if not keep_bucket:
        drop += [BUCKET, BUCKET_BEFORE, BUCKET_TOTAL]
    return out.drop(*drop)


def row_ranks(
    df: DataFrame,
    name: str = "rank",
    *,
    bucket: Column,
    order: Sequence[str | Column],
    by: Sequence[str] = (),
) -> DataFrame:
    """Zero-based position of each row in its group."""
    return running_totals(df, {name: F.lit(1).cast("long")}, bucket=bucket, order=order, by=by)


def order_value_at(df: DataFrame, order: str, n: int, bits: int = FANOUT_BITS) -> int | None:
    """Largest ``order`` value among the first ``n`` rows, as one scalar.

    Counts per bucket find the boundary bucket and only that bucket is ranked, so a
    following ``order <= value`` filter reaches the scan and reads no later files.
    """
    if n <= 0:
        return None
    counts = cut(df.groupBy(id_bucket(order, bits).alias(BUCKET)).agg(F.count(F.lit(1)).alias("k")), "counts")
    edge = (
        _accumulate(counts, [], ["k"], bucket_levels(counts))
        .where(F.col("k_before") < n)
        .agg(F.max_by(F.struct(BUCKET, "k_before"), BUCKET).alias("e"))
        .first()["e"]
    )
    if edge is None:
        return None
    lo = edge[BUCKET] << bits
    inside = df.where((F.col(order) >= lo) & (F.col(order) < lo + (1 << bits))).select(order)
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    return (
        inside.select(order, F.row_number().over(w).alias("rn"))
        .where(F.col("rn") <= n - edge["k_before"])
        .agg(F.max(order).alias("v"))
        .first()["v"]
    )
