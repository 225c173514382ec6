"""Near-duplicate documents by b-bit MinHash.

Texts with equal shingle sets become one class first. Minima of ``HASHES`` hash functions
give ``BANDS`` band keys, and of each minimum the low ``BITS`` bits are kept, packed into
a few integers: their agreement, counted by bits and corrected for chance, estimates the
similarity of a candidate pair before its full sets are compared.

A bucket of classes that share a band key is not turned into all pairs. Each class meets
the best hubs of its buckets, those with the fullest buckets; links are confirmed on
full sets, and components are found. Only members that stay outside the main component of
their buckets then meet those of other components, in blocks. A pair inside one component needs no test, so nothing is lost by that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.graph import components
from corpusloom.llm.piece_cache import blocks
from corpusloom.llm.shingles import mix, odd_constants, shingle_sets
from corpusloom.llm.text import row_key, text_of
from corpusloom.session import cut, ship

SIMILAR_PERCENT = 75
#: 32 bands of 4: a pair at the threshold shares no band in 5 of a million cases.
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BITS = 2
#: Estimates from 128 two-bit values stray by 0.046 at the threshold; five such steps
#: below it a candidate is not compared any more.
LEAST_ESTIMATE = 0.52

#: Rows of a block in which outsiders meet members.
BLOCK_ROWS = 512

FACTORS = odd_constants(HASHES, 11)
SHIFTS = odd_constants(HASHES, 12)
BAND_FACTORS = odd_constants(ROWS, 13)
SKETCH = "doc_id long, row long, n_shingles long, set_a long, set_b long, sig array<long>, bands array<long>"


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest hash of each set, which is not empty, under each function."""
    flat = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), HASHES), np.uint64)
    for k in range(HASHES):
        out[:, k] = np.minimum.reduceat(flat * FACTORS[k] + SHIFTS[k], at)
    return out


def signatures(least: np.ndarray) -> np.ndarray:
    """Low bits of the minima, packed into four integers a document."""
    low = mix(least) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    places = np.uint64(BITS) * np.arange(per, dtype=np.uint64)
    return (low.reshape(len(least), HASHES // per, per) << places).sum(axis=2, dtype=np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    mixed = (least.reshape(len(least), BANDS, ROWS) * BAND_FACTORS).sum(axis=2, dtype=np.uint64)
    return mix(mixed + np.arange(BANDS, dtype=np.uint64))


def _lists(values: np.ndarray) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, width, dtype=np.int32)), pa.array(values.view(np.int64).ravel()))


def _sketch_block(keys: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
    sets = shingle_sets(texts)
    sizes = np.array([len(s) for s in sets], np.int64)
    full = np.flatnonzero(sizes)
    sig, bands = np.zeros((len(sets), HASHES * BITS // 64), np.uint64), np.zeros((len(sets), BANDS), np.uint64)
    marks = np.zeros((2, len(sets)), np.uint64)
    if len(full):
        some = [sets[i] for i in full]
        least = minima(some)
        sig[full], bands[full] = signatures(least), band_keys(least)
        flat, at = np.concatenate(some), np.cumsum([0, *map(len, some[:-1])])
        for k in (0, 1):
            marks[k, full] = np.add.reduceat(mix(flat ^ FACTORS[k]), at)
    return pa.RecordBatch.from_arrays(
        [*keys, pa.array(sizes), pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)), _lists(sig), _lists(bands)],
        ["doc_id", "row", "n_shingles", "set_a", "set_b", "sig", "bands"],
    )


def sketches(docs: DataFrame) -> DataFrame:
    """Number of shingles, two fingerprints of the whole set, signature and band keys."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            for a, b in blocks([len(t) for t in texts]):
                yield _sketch_block([batch.column(c).slice(a, b - a) for c in ("doc_id", "row")], texts[a:b])

    return docs.select(F.col("doc_id").cast("long"), row_key().alias("row"), text_of().alias("_text")).mapInArrow(run, SKETCH)


def full_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, shingles)`` of the rows named in ``ids(id, doc_id, row)``; ``id`` may be any number of ours."""

    def run(batches):
        for batch in batches:
            texts = batch.column("_text").cast(pa.binary()).to_pylist()
            for a, b in blocks([len(t) for t in texts]):
                sets = shingle_sets(texts[a:b])
                offsets = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(a, b - a), values], ["id", "shingles"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), text_of().alias("_text"))
    # The same join at every size: both sides are dealt by row, no side is sent to all tasks.
    named = texts.join(ids.select("id", "doc_id", "row").hint("merge"), ["doc_id", "row"])
    return named.select("id", "_text").dropDuplicates(["id"]).mapInArrow(run, "id long, shingles array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from two packed signatures, corrected for agreement by chance."""
    fields = F.lit(0x5555555555555555)
    apart = lambda x, y: F.bit_count((x.bitwiseXOR(y)).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1)).bitwiseAND(fields))
    differ = sum((apart(F.get(a, i), F.get(b, i)) for i in range(HASHES * BITS // 64)), F.lit(0))
    chance = 2.0 ** -BITS
    return (1 - differ / F.lit(float(HASHES)) - chance) / (1 - chance)


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of ``pairs(u, v)`` whose full sets are similar. ``u`` may be a hub."""
    a, b = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s_{x}")) for x in "uv")
    both = pairs.join(b, "v").join(a, "u")
    common = F.size(F.array_intersect("s_u", "s_v"))
    return both.where(100 * common >= SIMILAR_PERCENT * (F.size("s_u") + F.size("s_v") - common)).select("u", "v")


def _likely(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    a, b = (signs.select(F.col("id").alias(x), F.col("sig").alias(f"g_{x}")) for x in "uv")
    return pairs.join(b, "v").join(a, "u").where(estimate(F.col("g_u"), F.col("g_v")) >= LEAST_ESTIMATE).select("u", "v")


def _labelled(rows: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """Adds ``c_name``, the component of column ``name``."""
    labels = found.select(F.col("node").alias(name), F.col("component").alias("_c"))
    return rows.join(labels, name, "left").withColumn(f"c_{name}", F.coalesce("_c", name)).drop("_c")


def _as_labels(links: DataFrame) -> DataFrame:
    return links.select(F.col("v").alias("node"), F.col("u").alias("component"))


def _compare(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links of a block of outsiders with a block of members, one for each component met.

    What an outsider is linked with already is not compared again.
    """
    out: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        column = lambda t, c: t.column(c).combine_chunks()
        ids, labels = column(right, "id").to_numpy(), column(right, "c").to_numpy()
        in_main = column(right, "outside").to_numpy(zero_copy_only=False) == 0
        sets = column(right, "shingles")
        flat, offsets = sets.values.to_numpy(), sets.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(offsets)
        packed = column(right, "sig").flatten().to_numpy().reshape(len(ids), -1)
        fields, chance = np.int64(0x5555555555555555), 2.0**-BITS
        for s, c, sig, mine in zip(*(left.column(n).to_pylist() for n in ("id", "c", "sig")), left.column("shingles")):
            apart = packed ^ np.array(sig, np.int64)
            differ = np.bitwise_count((apart | (apart >> 1)) & fields).sum(axis=1)
            likely = (1 - differ / HASHES - chance) / (1 - chance) >= LEAST_ESTIMATE
            mine, met = np.sort(mine.values.to_numpy()), {c}
            todo = np.flatnonzero(likely & (labels != c) & (in_main | (ids > s)))
            while len(todo):
                part, todo = todo[:64], todo[64:]
                at = np.concatenate([np.arange(offsets[i], offsets[i + 1]) for i in part])
                place = np.minimum(np.searchsorted(mine, flat[at]), len(mine) - 1)
                common = np.add.reduceat(mine[place] == flat[at], np.cumsum(sizes[part]) - sizes[part], dtype=np.int64)
                for i in part[100 * common >= SIMILAR_PERCENT * (len(mine) + sizes[part] - common)]:
                    if int(labels[i]) not in met:
                        met.add(int(labels[i]))
                        out.append((s, int(ids[i])))
                todo = todo[~np.isin(labels[todo], list(met))]
    columns = list(zip(*out)) or [[], []]
    return pa.table({"u": pa.array(columns[0], pa.int64()), "v": pa.array(columns[1], pa.int64())})


def _late_links(rows: DataFrame, signs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between components that share a bucket.

    ``rows(grp, id, c)`` are members of mixed buckets, each under the component that most
    of the bucket is in. Those in other components are the group's outsiders; they meet
    all its members in blocks, as rows of two block numbers, and only links come out.
    """
    sizes = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c") != F.col("grp")).alias("n_outside"))
    blocks_of = lambda n: F.ceil(n / BLOCK_ROWS).cast("int")
    dealt = rows.join(sizes, "grp").select(
        "id", "c", "grp", (F.col("c") != F.col("grp")).alias("outside"), blocks_of(F.col("n")).alias("m_all"),
        F.greatest(blocks_of(F.col("n_outside")), F.lit(1)).alias("s_all"),
    ).join(signs, "id").join(sets, "id")
    dealt = cut(dealt, "dealt")
    number = F.xxhash64("id")
    members = dealt.withColumn("m", F.pmod(number, "m_all").cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.col("s_all") - 1)))
    outsiders = dealt.where("outside").withColumn("s", F.pmod(number, "s_all").cast("int")).withColumn("m", F.explode(F.sequence(F.lit(0), F.col("m_all") - 1)))
    keys, columns = ("grp", "s", "m"), ("grp", "s", "m", "id", "c", "outside", "sig", "shingles")
    left, right = (side.select(*columns).toDF(*columns).groupBy(*keys) for side in (outsiders, members))
    return left.cogroup(right).applyInArrow(_compare, "u long, v long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``.

    Null, empty and blank texts have no shingles and are alone. Every row is a document:
    rows that repeat an id with different texts have links of their own, rows alike in id
    and text are linked with each other. A null id has a null component and is kept. An
    empty table gives no rows. ``row`` tells rows of one id apart.
    """
    marks = cut(sketches(docs), "sketches")
    named = marks.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    kinds = ["set_a", "set_b", "n_shingles"]
    firsts = named.groupBy(*kinds).agg(F.min(F.struct("doc_id", "row")).alias("first")).select(*kinds, "first.*")
    # A class goes by its smallest id; classes that would share one, by a hash of their sets.
    shared_id = F.count(F.lit(1)).over(Window.partitionBy("doc_id")) > 1
    classes = cut(firsts.withColumn("id", F.when(shared_id, F.xxhash64(*kinds)).otherwise(F.col("doc_id"))), "classes")
    reps = named.join(classes, [*kinds, "doc_id", "row"]).dropDuplicates(["id"])
    members = reps.select("id", F.explode("bands").alias("key"))
    shared = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = cut(members.join(shared, "key"), "buckets")
    # A text that others were made from agrees with each of them in more bands than they do
    # among themselves: the fuller a class's buckets, the better a hub it is.
    fullness = buckets.groupBy("id").agg(F.sum("n").alias("fullness"))
    ranked = cut(buckets.select("key", "id").join(fullness, "id"), "ranked")
    best = ranked.groupBy("key").agg(F.max(F.struct("fullness", F.xxhash64("id").alias("h"), "id")).alias("hub"))
    met = cut(ranked.select("key", "id").join(best, "key"), "met")

    signs = cut(reps.select("id", "doc_id", "row", "sig").join(fullness.select("id"), "id", "left_semi"), "signs")
    sets = cut(full_sets(docs, signs), "sets")
    signs = signs.select("id", "sig")

    first = met.groupBy(F.col("id").alias("v")).agg(F.max("hub")["id"].alias("u")).select("u", "v").where("u <> v")
    stars = cut(_confirmed(_likely(first, signs), sets), "links")
    # What hangs on one hub already needs no other hub of that star.
    here = _labelled(met.select(F.col("id").alias("v"), F.col("hub.id").alias("u")).where("u <> v").distinct(), _as_labels(stars), "v")
    apart = _labelled(here, _as_labels(stars), "u").where("c_u <> c_v").select("u", "v")
    found = components(stars.unionByName(cut(_confirmed(_likely(apart, signs), sets), "links")))

    placed = _labelled(met.select("key", F.col("id").alias("v")), found, "v")
    counts = placed.groupBy("key", "c_v").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.max_by("c_v", F.struct("n", "c_v")).alias("grp")).where("parts > 1")
    rows = cut(placed.join(mixed.select("key", "grp"), "key").select("grp", F.col("v").alias("id"), F.col("c_v").alias("c")).distinct(), "members")
    late = cut(_late_links(rows, signs, sets), "links")
    if not late.isEmpty():
        found = components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(late))

    labelled = classes.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_class = labelled.join(least, "component").select(*kinds, "component_id")
    plain = marks.select("doc_id", "row", *kinds)
    joined = plain.join(by_class, kinds, "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNull(), F.lit(None).cast("long")).otherwise(F.coalesce("component_id", "doc_id"))
    )
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return joined.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "row")
