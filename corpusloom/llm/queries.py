"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.ids import id_width
from corpusloom.llm import bpe, codebooks, licenses, line_dedup, metric_tree, mixing, neardup, oracles, page_template, quality
from corpusloom.llm import records, secret_scan, source_divergence, suffixes
from corpusloom.llm.text import documents
from corpusloom.session import cut, scratch_path

END_ID = 2


def op1_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = cut(metric_tree.quantized(spark.read.parquet(f"{sf_dir}/embeddings.parquet")), "quantized")
    return metric_tree.top_k(vectors, vectors.where(F.pmod("vec_id", F.lit(50)) == 0))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(documents(spark, sf_dir))


def op3_binary_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    root = scratch_path(spark, "records")
    records.write(documents(spark, sf_dir), root, tokenizer, END_ID)
    entries = cut(records.starts(records.index(spark, root)), "starts")
    return records.read(entries, root, id_width(records.vocab_size(tokenizer)))


def op4_secret_randomness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.secret_spans(documents(spark, sf_dir))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secret_scan.spans_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


def op5_minhash_bbit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffixes.without_repeats(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return cleaned.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op7_template_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_template.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir))


def op9_bpe_rank_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.with_copies(mixing.measure(documents(spark, sf_dir)))
    return taken.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"),
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(documents(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = codebooks.fit_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return codebooks.with_label_errors(codes.rows).select(
        "vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", codebooks.codebooks_digest(codes.codebooks).alias("codebooks_sha256"),
    )


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.without_repeated_lines(documents(spark, sf_dir))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_mtree_search": op1_mtree_search,
    "op2_license_scan": op2_license_scan,
    "op3_binary_records": op3_binary_records,
    "op4_secret_randomness": op4_secret_randomness,
    "op5_minhash_bbit": op5_minhash_bbit,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_template_extraction": op7_template_extraction,
    "op8_robust_quality": op8_robust_quality,
    "op9_bpe_rank_array": op9_bpe_rank_array,
    "op10_source_mixing": op10_source_mixing,
    "op11_source_divergence": op11_source_divergence,
    "op12_vector_codes": op12_vector_codes,
    "op13_line_dedup": op13_line_dedup,
}

ORACLES = {
    "op1_mtree_search": """
WITH v AS (
  SELECT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score
FROM scored QUALIFY rank <= 5
""",
    "op10_source_mixing": """
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, 2 * source_size AS cap,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS w
  FROM per_source
), level AS (
  SELECT *, 150 * sum(source_size) OVER () - 100 * coalesce(sum(cap) OVER before, 0) AS rest,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS open_w
  FROM ranked WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), filled AS (
  SELECT *, cap * 100 * open_w <= rest * w AS is_full FROM level
), first_open AS (
  SELECT rest, open_w FROM filled WHERE NOT is_full ORDER BY cap / w, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size,
         CASE WHEN is_full OR NOT EXISTS (FROM first_open) THEN CAST(cap AS DOUBLE)
              ELSE CAST(w * (SELECT rest FROM first_open) AS DOUBLE) / (100.0 * CAST((SELECT open_w FROM first_open) AS DOUBLE)) END AS target
  FROM filled
), rates AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM targets
)
SELECT d.doc_id, d.size, r.source_size, r.target,
       CAST(d.size * (floor(r.rate) + CASE WHEN CAST(CAST('0x' || md5('20:' || coalesce(CAST(d.doc_id AS VARCHAR), ''))[1:13] AS BIGINT) AS DOUBLE)
            / 4503599627370496.0 < r.rate - floor(r.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
""",
    "op11_source_divergence": oracles.SOURCE_DIVERGENCE,
    "op12_vector_codes": oracles.vector_codes(),
    "op13_line_dedup": oracles.LINE_DEDUP,
}
