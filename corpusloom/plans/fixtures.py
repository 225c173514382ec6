"""Inputs of the registered queries: views over whole driver tables, nothing sampled."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.ids import append_id, byte_ids
from corpusloom.operators import rows as row_ops
from corpusloom.operators import vocabulary as voc
from corpusloom.operators.packing import stream_positions
from corpusloom.operators.recurrence import log_decay
from corpusloom.operators.routing import gate_matrix, label_centroids
from corpusloom.session import cut, scratch_path, ship, spread
from corpusloom.sources import corpus

EOT_TEXT = "<|EOT|>"
SEQ_LEN = 64
BATCH = 8
RANKS = 2
WORKERS = 4
SHARDS = RANKS * WORKERS
EVAL_STEPS = 2
SEED = 0
GRAD_ACCUM = 2
RESUME_STEPS = 40
VOCAB_SIZE = 400
BYTE_VOCAB = 259
FILES = 10
FILE_WORKERS = 4
MAX_TOKENS = 1_000_000
LOG_EVERY = 10
PART_TOKENS = 262_144
RUN_STARTED = "2023-12-31 23:59:30"
STREAM_TOKENS = 60_000
STREAM_ROWS = 40
EXPERTS = ["click", "error", "purchase", "signup", "view", "idle"]
LAYERS = 5

_TRAINED: dict[tuple[str, str], voc.Vocabulary] = {}


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.scan(spark, f"{sf}/documents.parquet", "doc_id", "text")


def arriving_docs(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as a stream."""
    return corpus.stream_table(spark, f"{sf}/documents.parquet", docs(spark, sf).schema)


def docs_dirty(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with missing texts, blank texts and special tokens inside texts."""
    text = (
        F.when(F.pmod("doc_id", F.lit(17)) == 0, F.lit(None).cast("string"))
        .when(F.pmod("doc_id", F.lit(13)) == 0, F.lit(" \n  \n"))
        .when(F.pmod("doc_id", F.lit(11)) == 0, F.regexp_replace("text", "^([^ ]* )", "$1" + EOT_TEXT.replace("|", "\\|")))
        .otherwise(F.col("text"))
    )
    return docs(spark, sf).withColumn("text", text)


def docs_files(spark: SparkSession, sf: str) -> DataFrame:
    """Documents dealt to files; ``row`` is the place in the file."""
    d = docs(spark, sf).withColumn("file_rank", F.pmod("doc_id", F.lit(FILES)).cast("int"))
    return d.withColumn("row", F.floor(F.col("doc_id") / FILES).cast("long"))


def corpus_folder(spark: SparkSession, sf: str) -> str:
    """The documents as ten Parquet files in a folder ``sample/10BT``, in file order."""
    root = scratch_path(spark, "corpus")
    (
        docs_files(spark, sf).repartitionById(FILES, F.col("file_rank")).sortWithinPartitions("doc_id")
        .select("doc_id", "text").write.parquet(f"{root}/sample/10BT")
    )
    return root


def with_byte_ids(d: DataFrame) -> DataFrame:
    return d.withColumn("ids", append_id(byte_ids(F.coalesce("text", F.lit(""))), 0)).drop("text")


def byte_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as byte ids, made anew wherever they are read: as a table they would take more than the documents."""
    ship(spark)
    return with_byte_ids(spread(docs(spark, sf)))


def byte_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of the byte encoding, from text lengths alone."""
    return docs(spark, sf).agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("tokens"))


def byte_total(spark: SparkSession, sf: str) -> int:
    return byte_totals(spark, sf).first()["tokens"] or 0


def byte_stream(spark: SparkSession, sf: str) -> DataFrame:
    return stream_positions(byte_docs(spark, sf))


def shard_docs(spark: SparkSession, sf: str) -> DataFrame:
    """Dirty documents dealt to shards by row, blanks dropped afterwards, as byte ids."""
    ship(spark)
    return cut(with_byte_ids(row_ops.drop_blank(row_ops.row_shards(docs_dirty(spark, sf), SHARDS))), "bytes")


def vocabulary(spark: SparkSession, sf: str) -> voc.Vocabulary:
    """Vocabulary learned from all documents, once per application and input folder."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TRAINED:
        ship(spark)
        _TRAINED[key] = voc.train(voc.word_counts(spread(docs(spark, sf))), VOCAB_SIZE)
    return _TRAINED[key]


def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def train_log(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(F.col("event_id").alias("step"), F.col("value").alias("loss"), "ts")


def routing_log(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        F.floor(F.col("event_id") / 100).cast("long").alias("step"),
        F.pmod("user_id", F.lit(4)).cast("int").alias("layer"),
        F.col("event_type").alias("expert"),
    )


def decay_in(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select(
        "user_id", "ts", "event_id", log_decay(F.col("value") / 100).alias("log_a"),
        F.col("value").alias("u"), F.lit(1.0).alias("q"),
    )


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def gate(spark: SparkSession, sf: str):
    return gate_matrix(label_centroids(embeddings(spark, sf)))


