"""How far the sources of a language differ in the terms they use, in exact integers.

A (language, source) group gives each kept term a smoothed share; what two groups differ
by is priced per term and depends only on the two counts. So the terms are turned into
one-hot columns, one for each group and count level, and the product of these columns with
their transpose holds, for all pairs of groups at once, how many terms have each pair of
levels. Products are made in blocks of terms; each cell is priced once per block.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.skew import join_weighted
from corpusloom.llm.text import text_of
from corpusloom.session import cut, ship

UNIT = 1_000_000_000
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
#: Terms and groups of a block, and columns of one product inside it.
BLOCK_TERMS = 8192
BLOCK_GROUPS = 128
PRODUCT_COLUMNS = 1024
#: Entries a task counts before it passes them on.
TASK_ENTRIES = 400_000

#: Letters A-Z become a-z, other bytes below 0x80 except a-z become spaces.
TERM_BYTES = bytes(c if c >= 0x80 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z in lower case."""
    return text.translate(TERM_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: partial sums of occurrences and of documents with the term."""

    def table(counts: dict, found: dict):
        for (lang, source), group in counts.items():
            size = len(group)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size, pa.string()), pa.array([source] * size, pa.string()), pa.array(list(group), pa.binary()),
                    pa.array(list(group.values()), pa.int64()), pa.array([found[lang, source][t] for t in group], pa.int64()),
                ],
                ["lang", "source", "term", "n", "docs"],
            )

    def run(batches):
        counts, found, size = {}, {}, 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("lang", "source")]
            for lang, source, text in zip(*columns, batch.column("_text").cast(pa.binary()).to_pylist()):
                words = terms(text)
                if words:
                    group = counts.setdefault((lang, source), Counter())
                    before = len(group)
                    group.update(words)
                    found.setdefault((lang, source), Counter()).update(set(words))
                    size += len(group) - before
                if size > TASK_ENTRIES:
                    yield from table(counts, found)
                    counts, found, size = {}, {}, 0
        yield from table(counts, found)

    rows = docs.select(*_group_columns(), text_of().alias("_text"))
    return rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))


def _group_columns() -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def kept_terms(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """``(lang, source, term, n, lang_n, leads)`` of terms in enough documents of a language.

    One shuffle by language and term serves the sums per source and those per language;
    ``leads`` is true on one row of each term of a language.
    """
    dealt = term_counts(docs).repartition("lang", "term")
    summed = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    wide = summed.withColumns({
        "lang_n": F.sum("n").over(of_term), "lang_docs": F.sum("docs").over(of_term),
        "leads": F.row_number().over(of_term.orderBy("source")) == 1,
    })
    return wide.where(F.col("lang_docs") >= least_documents).select("lang", "source", "term", "n", "lang_n", "leads")


def share(count: Column, total: Column, kinds: Column) -> Column:
    """``1 + floor(UNIT * (count + 1) / (total + kinds))``; 1 where there are no terms at all."""
    wide = lambda c: c.cast("decimal(19,0)")
    below = wide(total) + wide(kinds)
    return F.when(below > 0, 1 + F.call_function("div", (wide(count) + 1) * F.lit(UNIT).cast("decimal(10,0)"), F.greatest(below, F.lit(1).cast("decimal(20,0)")))).otherwise(F.lit(1)).cast("long")


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, total, entries, kinds, lang_total, sources)`` of every group that occurs."""
    of_lang = Window.partitionBy("lang")
    found = docs.select(*_group_columns()).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("entries"), F.count_if("leads").alias("leads"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    every = found.join(own, ["lang", "source"], "left").select("lang", "source", *map(zero, ("total", "entries", "leads")))
    return every.select(
        "lang", "source", "total", "entries", F.sum("leads").over(of_lang).alias("kinds"),
        F.sum("total").over(of_lang).alias("lang_total"), F.count(F.lit(1)).over(of_lang).alias("sources"),
    )


def level_products(levels: np.ndarray, prices: np.ndarray, totals: np.ndarray) -> None:
    """Add to ``totals[g, h]`` the price of group ``g`` against group ``h`` over all rows.

    ``levels[term, group]`` numbers the one-hot column of a group's count level, ``prices``
    has each column's share. Rows that are alike should be neighbours, so that a product
    has few columns.
    """
    n, width = levels.shape
    owner = np.zeros(len(prices), np.int64)
    owner[levels.ravel()] = np.tile(np.arange(width), n)
    at, step = 0, n
    while at < n:
        columns, local = np.unique(levels[at:at + step], return_inverse=True)
        if len(columns) > PRODUCT_COLUMNS and step > 1:
            step = max(1, step // 2)
            continue
        local = local.reshape(-1, width)
        one_hot = np.zeros((len(local), len(columns)), np.float32)
        one_hot[np.arange(len(local))[:, None], local] = 1
        joint = one_hot.T @ one_hot  # numbers of terms, exact below 2**24
        i, j = np.nonzero(joint)
        p, q = prices[columns[i]], prices[columns[j]]
        np.add.at(totals, (owner[columns[i]], owner[columns[j]]), joint[i, j].astype(np.int64) * ((p - q) ** 2 // q))
        at += len(local)
        step = min(2 * step, n)


def _pair_block(group: pa.Table) -> pa.Table:
    """Priced pairs of a block of terms. A row without a term names a group and its share at count 0."""
    column = lambda c: group.column(c).combine_chunks()
    names = pc.unique(column("source"))
    n_groups = len(names)
    owner = pc.index_in(column("source"), names).to_numpy()
    p, n = column("p").to_numpy(), column("n").to_numpy()
    is_group = pc.is_null(column("term")).to_numpy(zero_copy_only=False)
    at_zero, side = np.zeros(n_groups, np.int64), np.zeros(n_groups, np.int64)
    at_zero[owner[is_group]], side[owner[is_group]] = p[is_group], column("part").to_numpy()[is_group]
    rows = ~is_group
    term = pc.dictionary_encode(column("term").filter(pa.array(rows))).indices.to_numpy()
    n_terms = int(term.max()) + 1 if len(term) else 0
    totals = np.zeros((n_groups, n_groups), np.int64)
    if n_terms:
        owner, p, n = owner[rows], p[rows], n[rows]
        # Columns 0 .. n_groups - 1 are the groups' zero levels, then come all (group, count) that occur.
        found, number = np.unique(np.stack([owner, n], axis=1), axis=0, return_inverse=True)
        prices = np.concatenate([at_zero, np.zeros(len(found), np.int64)])
        prices[n_groups + number.ravel()] = p
        levels = np.tile(np.arange(n_groups), (n_terms, 1))
        levels[term, owner] = n_groups + number.ravel()
        level_products(levels[np.argsort(np.bincount(term, weights=n), kind="stable")], prices, totals)
    lo, hi = (group.column(c)[0].as_py() for c in ("lo", "hi"))
    i, j = np.nonzero(~np.eye(n_groups, dtype=bool) & ((side[:, None] != side) | (lo == hi)))
    return pa.table({
        "lang": pa.array([group.column("lang")[0].as_py()] * len(i), pa.string()), "source": names.take(pa.array(i)), "item": names.take(pa.array(j)),
        "value": totals[i, j], "seen": np.full(len(i), n_terms), "p": at_zero[i], "q": at_zero[j], "kinds": np.full(len(i), group.column("kinds")[0].as_py()),
    })


def pair_values(priced: DataFrame, stats: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` for every ordered pair of sources of a language.

    Work is dealt by blocks of terms and pairs of blocks of groups, so a task holds a
    bounded matrix whatever the numbers of terms and sources; only sums per pair leave it.
    """
    n_blocks = F.greatest(F.ceil(F.col("kinds") / BLOCK_TERMS), F.lit(1)).cast("int")
    n_parts = F.ceil(F.col("sources") / BLOCK_GROUPS).cast("int")
    part = F.pmod(F.xxhash64("source"), n_parts).cast("int").alias("part")
    met = F.explode(F.transform(F.sequence(F.lit(0), n_parts - 1), lambda o: F.struct(F.least("part", o).alias("lo"), F.greatest("part", o).alias("hi")))).alias("met")
    shared = ("lang", "source", "term", "n", "p", "kinds", "sources")
    entries = priced.select(*shared, F.pmod(F.xxhash64("term"), n_blocks).cast("int").alias("block"), part)
    zero = stats.select(
        "lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), share(F.lit(0), F.col("total"), F.col("kinds")).alias("p"),
        "kinds", "sources", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"), part,
    )
    dealt = entries.unionByName(zero).withColumn("met", met).select("lang", "source", "term", "n", "p", "kinds", "block", "part", "met.lo", "met.hi")
    sums = dealt.groupBy("lang", "block", "lo", "hi").applyInArrow(
        _pair_block, "lang string, source string, item string, value long, seen long, p long, q long, kinds long"
    )
    # Terms that no group of a pair of blocks has stand at count 0 on both sides.
    added = sums.groupBy("lang", "source", "item", "p", "q", "kinds").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    return added.select("lang", "source", "item", (F.col("value") + (F.col("kinds") - F.col("seen")) * distance(F.col("p"), F.col("q"))).alias("value"))


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair`` has all other sources of the language, part ``term`` the terms a source
    uses more than its language does, up to ``top_terms``. Null text, lang and source are
    empty strings. Every row of the table is a document, repeated ones too. A group without
    terms has its pairs; a lone source has none. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    kept = cut(kept_terms(docs, least_documents), "kept_terms")
    stats = cut(groups(docs, kept), "groups")
    entries = stats.agg(F.coalesce(F.sum("entries"), F.lit(0))).first()[0]
    of_group = stats.select("lang", "source", "total", "entries", "kinds", "lang_total", "sources")
    priced = cut(
        join_weighted(kept.drop("leads"), of_group, ["lang", "source"], F.col("entries"), entries).select(
            "lang", "source", "term", "n", "kinds", "sources", share(F.col("n"), F.col("total"), F.col("kinds")).alias("p"),
            share(F.col("lang_n"), F.col("lang_total"), F.col("kinds")).alias("q"),
        ),
        "priced",
    )
    rank = lambda: F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(priced, stats).withColumn("rank", rank())
    ahead = priced.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    best = ahead.withColumn("rank", rank()).where(F.col("rank") <= top_terms)
    named = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs, "pair").unionByName(named(best, "term"))
