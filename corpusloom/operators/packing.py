"""Documents as one positioned token stream, cut into fixed windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.ids import pack_ids, unpack_ids
from corpusloom.operators.positions import id_bucket, running_totals
from corpusloom.session import ship

_COUNT = "_n_ids"


def token_count(ids: str = "ids") -> Column:
    return F.size(ids).cast("long")


def stream_positions(
    encoded: DataFrame, by: Sequence[str] = (), order: str = "doc_id"
) -> DataFrame:
    """Add ``start``, the position of a document's first token in its stream.

    ``encoded`` is read twice: it should be a stored table, or work that is cheaper than
    storing it. Ids move packed.
    """
    if encoded.schema["ids"].dataType.simpleString() != "array<int>":
        return running_totals(encoded, {"start": token_count()}, bucket=id_bucket(order), order=[order], by=by)
    ship(encoded.sparkSession)
    moved = encoded.withColumns({_COUNT: token_count(), "ids": pack_ids(F.col("ids"))})
    placed = running_totals(moved, {"start": F.col(_COUNT)}, bucket=id_bucket(order), order=[order], by=by)
    return placed.withColumn("ids", unpack_ids(F.col("ids"))).drop(_COUNT)


def total_tokens(encoded: DataFrame) -> int:
    return encoded.agg(F.coalesce(F.sum(token_count()), F.lit(0)).alias("n")).first()["n"]


def _clip(lo: Column, hi: Column) -> Column:
    """The ids of a row between stream positions ``lo`` and ``hi``."""
    return F.slice("ids", (lo - F.col("start") + 1).cast("int"), (hi - lo).cast("int"))


def cut_windows(positioned: DataFrame, seq_len: int, stride: int, by: Sequence[str] = ()) -> DataFrame:
    """Windows of ``seq_len + 1`` tokens every ``stride`` tokens, incomplete ones dropped.

    Optional columns: ``origin`` moves window 0 of a group, ``n_windows`` bounds them.

    A window whose tokens all lie in one row is a plain slice of it. Of the others, which
    span rows, only the pieces are shuffled and put together. No group is larger than one
    window.
    """
    by = list(by)
    size = seq_len + 1
    start, end = F.col("start"), F.col("start") + token_count()
    origin = F.col("origin") if "origin" in positioned.columns else F.lit(0).cast("long")
    rows = positioned.select(
        *by, "start", "ids",
        origin.alias("_o"), end.alias("_end"),
        F.greatest(F.floor((start - origin - size) / stride) + 1, F.lit(0)).cast("long").alias("_first"),
        F.least(
            F.floor((end - 1 - origin) / stride),
            (F.col("n_windows") - 1) if "n_windows" in positioned.columns else F.lit(None).cast("long"),
        ).cast("long").alias("_last"),
    )
    rows = rows.where((F.col("_first") <= F.col("_last")) & (F.size("ids") > 0))
    left = lambda w: F.col("_o") + w * stride
    inside = lambda w: (left(w) >= F.col("start")) & (left(w) + size <= F.col("_end"))

    def cut_out(w: Column) -> Column:
        lo = F.greatest(left(w), "start")
        return F.struct(w.alias("window"), lo.alias("at"), _clip(lo, F.least(left(w) + size, F.col("_end"))).alias("ids"))

    # A row is cut in one go: no window goes through a later step with the whole row beside it.
    numbers = F.sequence("_first", "_last")
    whole = rows.select(*by, F.inline(F.transform(F.filter(numbers, inside), cut_out))).select(*by, "window", F.col("ids").alias("tokens"))
    pieces = rows.select(*by, F.inline(F.transform(F.filter(numbers, lambda w: ~inside(w)), cut_out)))
    pieces = pieces.select(*by, "window", F.struct("at", "ids").alias("piece"))
    spanning = pieces.groupBy(*by, "window").agg(F.flatten(F.sort_array(F.collect_list("piece"))["ids"]).alias("tokens"))
    return whole.unionByName(spanning.where(F.size("tokens") == size))


def pack_overlapping(encoded: DataFrame, seq_len: int, by: Sequence[str] = ("shard",), order: str = "doc_id") -> DataFrame:
    """Windows that share one token with the next, one independent stream per shard."""
    return cut_windows(stream_positions(encoded, by, order), seq_len, seq_len, by)


def chunk_fixed(encoded: DataFrame, seq_len: int, order: str = "doc_id") -> DataFrame:
    """Windows that share nothing, over the whole stream."""
    return cut_windows(stream_positions(encoded, (), order), seq_len, seq_len + 1)


def shift_targets(windows: DataFrame, seq_len: int) -> DataFrame:
    """Inputs ``x`` and targets ``y``, one token later."""
    return windows.select(
        *[c for c in windows.columns if c != "tokens"],
        F.slice("tokens", 1, seq_len).alias("x"),
        F.slice("tokens", 2, seq_len).alias("y"),
    )


def shard_windows(region_len: int, shards: int, seq_len: int) -> int:
    """Windows in each of ``shards`` equal parts of a region."""
    return max(region_len, 0) // shards // (seq_len + 1)


def contiguous_shards(
    positioned: DataFrame, seq_len: int, shards: int, region_start: int, region_end: int
) -> DataFrame:
    """Windows of equal contiguous shards of a region; tails of region and shard are dropped."""
    shard_tokens = max(region_end - region_start, 0) // shards
    n_windows = shard_windows(region_end - region_start, shards, seq_len)
    if n_windows == 0:
        return cut_windows(
            positioned.where(F.lit(False)).withColumn("shard", F.lit(0).cast("long")), seq_len, seq_len + 1, ["shard"]
        )
    end = F.col("start") + token_count()
    first = F.greatest(F.floor((F.col("start") - region_start) / shard_tokens), F.lit(0)).cast("long")
    last = F.least(F.floor((end - 1 - region_start) / shard_tokens), F.lit(shards - 1)).cast("long")
    rows = positioned.where((end > region_start) & (first <= last))
    rows = rows.withColumn("shard", F.explode(F.sequence(first, last)))
    rows = rows.withColumns({
        "origin": F.lit(region_start).cast("long") + F.col("shard") * shard_tokens,
        "n_windows": F.lit(n_windows).cast("long"),
    })
    return cut_windows(rows, seq_len, seq_len + 1, ["shard"])


def split_point(total: int, seq_len: int, batch_size: int, eval_steps: int) -> int:
    """First token of the held-out tail."""
    train_end = total - eval_steps * batch_size * (seq_len + 1)
    if train_end < 0:
        raise ValueError(f"the held-out tail needs more than the {total} tokens there are")
    return train_end


def tail_split(positioned: DataFrame, train_end: int) -> DataFrame:
    """Rows labelled ``train`` or ``eval``; a document across the boundary gives one row each."""
    start, end = F.col("start"), F.col("start") + token_count()
    at = F.lit(train_end).cast("long")
    sides = F.array(
        F.struct(F.lit("train").alias("split"), start.alias("lo"), F.least(end, at).alias("hi")),
        F.struct(F.lit("eval").alias("split"), F.greatest(start, at).alias("lo"), end.alias("hi")),
    )
    rows = positioned.withColumn("_s", F.explode(sides)).where("_s.lo < _s.hi")
    keep = [c for c in positioned.columns if c not in ("start", "ids")]
    return rows.select(
        *keep, F.col("_s.split").alias("split"), F.col("_s.lo").alias("start"),
        _clip(F.col("_s.lo"), F.col("_s.hi")).alias("ids"),
    )
