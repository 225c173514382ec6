"""Registered queries: one per operator, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.ids import id_width, ids_text
from corpusloom.functions.text import pieces
from corpusloom.operators import batching, budget, encoding, packing, positions, recurrence, routing, scoring, training_log
from corpusloom.operators import rows as row_ops
from corpusloom.operators import vocabulary as voc
from corpusloom.plans import fixtures as fx
from corpusloom.session import cut, scratch_path, ship, spread
from corpusloom.sources import corpus, feed_store, inventory, token_store, token_stream, vocab_store
from corpusloom.streaming import encode as stream_encoding
from corpusloom.streaming import keyed
from corpusloom.streaming import pack as stream_packing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Rows of a file of an arriving micro-batch.
ARRIVAL_ROWS = 10_000


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def r6(column) -> F.Column:
    return F.round(column, 6)


def as_text(df: DataFrame, *columns: str) -> DataFrame:
    """Id arrays as text, which every engine compares alike."""
    return df.withColumns({c: ids_text(F.col(c)) for c in columns})


# Sources and sinks


@query
def corpus_scan(spark, sf):
    return fx.docs(spark, sf)


@query
def file_select(spark, sf):
    root = fx.corpus_folder(spark, sf)
    return corpus.select_files(spark, root, "sample-10BT").select("file_rank", F.col("row").cast("long").alias("row"), "doc_id")


@query
def corpus_stream(spark, sf):
    path = scratch_path(spark, "stream")
    docs = fx.arriving_docs(spark, sf)
    corpus.drain(docs, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(docs.schema).parquet(f"{path}/out")


@query
def stream_backpressure(spark, sf):
    root, path = fx.corpus_folder(spark, sf), scratch_path(spark, "limited")
    limited = corpus.stream(spark, f"{root}/sample/10BT", fx.docs(spark, sf).schema, max_files=3)

    def keep(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={batch_id}")

    (
        limited.writeStream.foreachBatch(keep).option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True).start().awaitTermination()
    )
    return spark.read.parquet(f"{path}/out").agg(
        F.count(F.lit(1)).alias("docs"), F.countDistinct("batch").alias("micro_batches")
    )


def _store(spark, sf) -> str:
    path = scratch_path(spark, "store")
    token_store.write(fx.byte_stream(spark, sf), path, fx.BYTE_VOCAB, fx.PART_TOKENS)
    return path


@query
def token_sink(spark, sf):
    return token_store.manifest(spark, _store(spark, sf)).select("start", "n_tokens", "bytes")


@query
def token_merge(spark, sf):
    ship(spark)
    dealt = cut(fx.with_byte_ids(row_ops.file_workers(fx.docs_files(spark, sf), fx.FILE_WORKERS)), "dealt")
    root = scratch_path(spark, "workers")
    stores = []
    for worker in range(fx.FILE_WORKERS):
        mine = budget.worker_order(dealt.where(F.col("worker") == worker))
        token_store.write(mine, f"{root}/{worker}", fx.BYTE_VOCAB, fx.PART_TOKENS)
        stores.append(f"{root}/{worker}")
    return token_store.merge(spark, stores, f"{root}/merged").select("worker", "start", "n_tokens", "bytes")


@query
def token_source(spark, sf):
    blocks = token_store.read(spark, _store(spark, sf), fx.BYTE_VOCAB)
    return as_text(packing.cut_windows(blocks, fx.SEQ_LEN, fx.SEQ_LEN + 1), "tokens")


@query
def file_inventory(spark, sf):
    files = inventory.list_files(spark, _store(spark, sf), prefix="tokens-")
    name = F.regexp_extract("path", r"tokens-(\d+)-", 1)
    return files.select(name.cast("long").alias("start"), "length", "size")


@query
def write_mode(spark, sf):
    path = scratch_path(spark, "store")
    stream = fx.byte_stream(spark, sf)
    reports = [
        token_store.write(stream, path, fx.BYTE_VOCAB, fx.PART_TOKENS, force=force).withColumn("attempt", F.lit(i))
        for i, force in enumerate([False, False, True])
    ]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])


@query
def vocab_store_roundtrip(spark, sf):
    path = scratch_path(spark, "vocab")
    vocab_store.save(spark, fx.vocabulary(spark, sf), path)
    back = vocab_store.load(spark, path)
    return vocab_store.special_ids(back.vocab_table(spark))


# Projection, filter, sample, shards


@query
def text_default(spark, sf):
    return row_ops.default_text(fx.docs_dirty(spark, sf))


@query
def blank_filter(spark, sf):
    return row_ops.drop_blank(fx.docs_dirty(spark, sf))


@query
def first_n_sample(spark, sf):
    return row_ops.first_n(fx.docs(spark, sf), num_samples=450, batch_size=100)


@query
def row_round_robin(spark, sf):
    return row_ops.drop_blank(row_ops.row_shards(fx.docs_dirty(spark, sf), fx.SHARDS)).select("doc_id", "row", "shard")


@query
def file_round_robin(spark, sf):
    return row_ops.file_workers(fx.docs_files(spark, sf), fx.FILE_WORKERS).select("doc_id", "worker", "file_rank", "row")


# Tokenizer learning


@query
def pretokenize(spark, sf):
    return fx.docs(spark, sf).select("doc_id", F.posexplode(pieces(F.col("text"))).alias("pos", "piece"))


@query
def word_count(spark, sf):
    return voc.word_counts(spread(fx.docs(spark, sf)))


@query
def alphabet(spark, sf):
    return voc.alphabet(voc.word_counts(fx.docs(spark, sf)))


@query
def pair_count(spark, sf):
    words = cut(voc.word_counts(fx.docs(spark, sf)), "words")
    letters = [r["byte"] for r in voc.alphabet(words).orderBy("code").collect()]
    best = voc.best_pairs(voc.symbol_words(words, letters, 3), 64)
    code = [F.ascii(F.substring("pair", i, 1)) - voc.SYMBOL_BASE for i in (1, 2)]
    return best.select(code[0].alias("left_id"), code[1].alias("right_id"), "cnt")


@query
def bpe_train(spark, sf):
    merges = fx.vocabulary(spark, sf).merge_table(spark)
    return merges.select("rank", F.col("left").alias("left_id"), F.col("right").alias("right_id"), "new_id")


@query
def vocab_assemble(spark, sf):
    return voc.assemble(spark, fx.vocabulary(spark, sf))


# Encode and decode


@query
def encode_docs(spark, sf):
    return as_text(encoding.encode_docs(spread(fx.docs_dirty(spark, sf)), fx.vocabulary(spark, sf)).drop("text"), "ids")


@query
def append_eot(spark, sf):
    return as_text(encoding.encode_docs(spread(fx.docs(spark, sf)), fx.vocabulary(spark, sf), eot=True).drop("text"), "ids")


@query
def decode_ids(spark, sf):
    vocab = fx.vocabulary(spark, sf)
    coded = encoding.encode_docs(spread(fx.docs_dirty(spark, sf)), vocab, eot=True)
    return coded.select("doc_id", encoding.decode_ids(F.col("ids"), vocab).alias("text"))


@query
def encode_stats(spark, sf):
    ship(spark)
    coded = fx.with_byte_ids(row_ops.file_workers(fx.docs_files(spark, sf), fx.FILE_WORKERS))
    return encoding.encode_stats(coded)


@query
def encode_progress(spark, sf):
    batches = fx.events(spark, sf).select(
        F.col("event_id").alias("batch"), "ts", F.lit(2_000).cast("long").alias("docs"),
        F.floor(F.col("value") * 100).cast("long").alias("tokens"),
    )
    out = training_log.encode_progress(batches, max_tokens=fx.MAX_TOKENS)
    return out.withColumns({c: r6(c) for c in ("elapsed", "tok_per_sec", "pct", "eta_seconds")})


@query
def dtype_choice(spark, sf):
    sizes = voc.word_counts(fx.docs(spark, sf)).agg((F.count(F.lit(1)) + 3).alias("vocab_size"))
    return sizes.withColumn("bytes_per_token", F.when(F.col("vocab_size") > 65_536, id_width(65_537)).otherwise(id_width(65_536)))


# Layout, budget, packing, split, shuffle, batches


@query
def global_offsets(spark, sf):
    return fx.byte_stream(spark, sf).select("doc_id", "start", packing.token_count().alias("n"))


@query
def hashed_offsets(spark, sf):
    """Positions along a key that is spread over 60 bits."""
    key = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long")
    sizes = fx.docs(spark, sf).select("doc_id", key.alias("key"), (F.octet_length("text") + 1).cast("long").alias("n"))
    return positions.running_totals(sizes, {"start": F.col("n")}, bucket=positions.id_bucket("key"), order=["key"]).select("doc_id", "start", "n")


@query
def pack_overlap(spark, sf):
    return as_text(packing.pack_overlapping(fx.shard_docs(spark, sf), fx.SEQ_LEN), "tokens")


@query
def chunk_fixed(spark, sf):
    return as_text(packing.chunk_fixed(fx.byte_docs(spark, sf), fx.SEQ_LEN), "tokens")


@query
def shift_targets(spark, sf):
    windows = packing.chunk_fixed(fx.byte_docs(spark, sf), fx.SEQ_LEN)
    return as_text(packing.shift_targets(windows, fx.SEQ_LEN), "x", "y")


@query
def budget_cap(spark, sf):
    ship(spark)
    dealt = row_ops.file_workers(fx.docs_files(spark, sf), fx.FILE_WORKERS)
    coded = budget.encode_in_waves(dealt, fx.with_byte_ids, fx.MAX_TOKENS, fx.FILE_WORKERS, batch_rows=20)
    kept = budget.cap_by_worker(coded, fx.MAX_TOKENS, fx.FILE_WORKERS, batch_rows=20)
    return kept.select("doc_id", "worker", "start", packing.token_count().alias("n"))


@query
def budget_cap_stream(spark, sf):
    ship(spark)
    coded = fx.byte_docs(spark, sf).withColumn("row", F.col("doc_id"))
    return budget.cap_by_stream(coded, fx.MAX_TOKENS, batch_rows=50).select("doc_id", packing.token_count().alias("n"))


def _regions(spark, sf):
    coded = fx.byte_docs(spark, sf)
    total = packing.total_tokens(coded)
    return packing.stream_positions(coded), total, packing.split_point(total, fx.SEQ_LEN, fx.BATCH, fx.EVAL_STEPS)


@query
def contiguous_shards(spark, sf):
    positioned, _, end = _regions(spark, sf)
    return as_text(packing.contiguous_shards(positioned, fx.SEQ_LEN, fx.SHARDS, 0, end), "tokens")


@query
def tail_split(spark, sf):
    positioned, _, end = _regions(spark, sf)
    return packing.tail_split(positioned, end).select("doc_id", "split", "start", packing.token_count().alias("n"))


def _shard_windows(spark, sf) -> int:
    end = packing.split_point(fx.byte_total(spark, sf), fx.SEQ_LEN, fx.BATCH, fx.EVAL_STEPS)
    return packing.shard_windows(end, fx.SHARDS, fx.SEQ_LEN)


def _train_order(spark, sf):
    n = _shard_windows(spark, sf)
    return batching.seeded_shuffle(batching.window_grid(spark, fx.SHARDS, n), n, fx.SEED)


def _eval_windows(spark, sf):
    positioned, total, end = _regions(spark, sf)
    return packing.contiguous_shards(positioned, fx.SEQ_LEN, 1, end, total)


def _train_batches(spark, sf):
    sizes = batching.equal_shards(spark, fx.SHARDS, _shard_windows(spark, sf))
    return batching.batches(_train_order(spark, sf), fx.BATCH, fx.WORKERS, sizes)


def _train_feed(spark, sf):
    """Windows of the training region with their places in the feed."""
    positioned, _, end = _regions(spark, sf)
    n = packing.shard_windows(end, fx.SHARDS, fx.SEQ_LEN)
    windows = packing.contiguous_shards(positioned, fx.SEQ_LEN, fx.SHARDS, 0, end)
    return batching.batches(batching.seeded_shuffle(windows, n, fx.SEED), fx.BATCH, fx.WORKERS, batching.equal_shards(spark, fx.SHARDS, n)), n


@query
def seeded_shuffle(spark, sf):
    return _train_order(spark, sf).select("shard", "window", "place")


@query
def batches(spark, sf):
    return _train_batches(spark, sf).select("rank", "worker", "window", "batch", "slot", "feed")


@query
def eval_take_n(spark, sf):
    placed = _eval_windows(spark, sf).withColumn("place", F.col("window"))
    first = batching.take_batches(batching.batches(placed, fx.BATCH, 1), 1)
    return as_text(first.select("batch", "slot", "tokens"), "tokens")


@query
def epoch_schedule(spark, sf):
    return batching.epoch_schedule(spark, _train_batches(spark, sf), steps=3_000, grad_accum=fx.GRAD_ACCUM, world=fx.RANKS).select(
        "step", "rank", "micro", "epoch", "feed", "worker", "batch"
    )


@query
def budget_report(spark, sf):
    return batching.budget_report(fx.byte_totals(spark, sf), fx.BATCH, fx.GRAD_ACCUM, fx.RANKS, fx.SEQ_LEN, max_steps=20_000)


@query
def training_feed(spark, sf):
    """Windows in the order ranks read them: the stream cut, shuffled, batched and shifted."""
    fed = packing.shift_targets(_train_feed(spark, sf)[0], fx.SEQ_LEN)
    return as_text(fed.select("rank", "feed", "slot", "x", "y"), "x", "y")


@query
def feed_resume(spark, sf):
    """The feed as files, opened in the middle: steps across the end of an epoch."""
    ship(spark)
    (windows, n), path = _train_feed(spark, sf), scratch_path(spark, "feed")
    # The index needs places, not which window each place holds.
    places = batching.window_grid(spark, fx.SHARDS, n).withColumnRenamed("window", "place")
    order = batching.batches(batching.window_at(places, n, fx.SEED), fx.BATCH, fx.WORKERS, batching.equal_shards(spark, fx.SHARDS, n))
    index = feed_store.write(windows, order, path, fx.SEQ_LEN, fx.BYTE_VOCAB, fx.PART_TOKENS)
    batches_of = index.where("rank = 0").count()
    from_step = max(0, batches_of // fx.GRAD_ACCUM - fx.RESUME_STEPS // 2)
    steps = feed_store.read_steps(spark, path, fx.SEQ_LEN, fx.BYTE_VOCAB, from_step, fx.RESUME_STEPS, fx.GRAD_ACCUM)
    return as_text(steps, "tokens")


# Training log and routing log


@query
def interval_loss(spark, sf):
    return training_log.interval_loss(fx.train_log(spark, sf), fx.LOG_EVERY).withColumn("loss", r6("loss"))


@query
def throughput(spark, sf):
    begin = F.lit(fx.RUN_STARTED).cast("timestamp")
    out = training_log.throughput(fx.train_log(spark, sf), fx.BATCH * fx.GRAD_ACCUM * fx.SEQ_LEN, fx.LOG_EVERY, started=begin)
    return out.withColumn("tok_per_sec", r6("tok_per_sec"))


@query
def step_latency(spark, sf):
    return training_log.step_latency(fx.train_log(spark, sf)).withColumn("step_ms", r6("step_ms"))


@query
def eval_mean(spark, sf):
    losses = fx.events(spark, sf).select(F.floor(F.col("event_id") / 4).cast("long").alias("step"), F.col("value").alias("loss"))
    last = losses.agg(F.max("step")).first()[0]
    steps = spark.range(last + 6).withColumnRenamed("id", "step")  # five evaluations after the last batch
    return training_log.eval_mean(losses, steps).withColumn("eval_loss", r6("eval_loss"))


@query
def lr_schedule(spark, sf):
    log = fx.train_log(spark, sf).select("step", F.lit(6e-4).alias("lr"))
    out = training_log.lr_schedule(log, 6e-4, 6e-5, 500, 8_000)
    return out.select("step", F.round("expected_lr", 12).alias("expected_lr"), "deviates")


@query
def cadence_filter(spark, sf):
    return training_log.cadence(fx.train_log(spark, sf), fx.LOG_EVERY, 250).select("step", r6("loss").alias("loss"))


@query
def expert_load(spark, sf):
    out = routing.expert_load(fx.routing_log(spark, sf), fx.LAYERS, fx.EXPERTS)
    return out.withColumns({c: r6(c) for c in ("share", "utilization_std", "max_load_ratio")})


@query
def load_bias(spark, sf):
    counts = fx.routing_log(spark, sf).groupBy("step", "layer", "expert").agg(F.count(F.lit(1)).alias("n"))
    return routing.load_bias(counts, 1, fx.EXPERTS).withColumn("bias", r6("bias"))


# Table operators on model arithmetic


def _routed(spark, sf):
    ship(spark)
    groups, gate = fx.gate(spark, sf)
    return routing.topk_routing(fx.embeddings(spark, sf), groups, gate, [0.1 * (g % 3) for g in groups])


@query
def topk_routing(spark, sf):
    return _routed(spark, sf).select("vec_id", "place", "grp", r6("weight").alias("weight"))


@query
def topk_routing_blocks(spark, sf):
    """The same with a gate that stays a table, in blocks of a few groups."""
    gate = routing.label_centroids(fx.embeddings(spark, sf)).select(F.col("label").alias("grp"), "centroid", (0.1 * (F.col("label") % 3)).alias("bias"))
    routed = routing.topk_routing_blocks(fx.embeddings(spark, sf).select("vec_id", "embedding"), gate, block_groups=4)
    return routed.select("vec_id", "place", "grp", r6("weight").alias("weight"))


@query
def weighted_combine(spark, sf):
    values = fx.embeddings(spark, sf).groupBy(F.col("label").alias("grp")).agg(F.avg("vec_id").alias("value"))
    combined = routing.weighted_combine(_routed(spark, sf), values, F.col("vec_id") * 0.5)
    return combined.withColumn("combined", r6("combined"))


@query
def heldout_ce(spark, sf):
    positioned, total, end = _regions(spark, sf)
    train = packing.contiguous_shards(positioned, fx.SEQ_LEN, 1, 0, end)
    held = packing.contiguous_shards(positioned, fx.SEQ_LEN, 1, end, total)
    train, held = (packing.shift_targets(w, fx.SEQ_LEN) for w in (train, held))
    return scoring.heldout_ce(train, held, fx.BYTE_VOCAB).withColumn("loss", r6("loss"))


def _distribution(spark, sf):
    events = fx.events(spark, sf)
    scores = events.groupBy("user_id", "event_type").agg((F.count(F.lit(1)) - 12).alias("score"))
    seen = scoring.last_seen(events, "user_id", "event_type", ["ts", "event_id"], 3)
    return scoring.next_distribution(scores, seen, "user_id", "event_type", top_k=3)


@query
def candidate_sampling(spark, sf):
    return _distribution(spark, sf).withColumns({"logit": r6("logit"), "p": r6("p")})


@query
def candidate_draw(spark, sf):
    return scoring.draw(_distribution(spark, sf), "user_id", "event_type", fx.SEED)


def _decay_report(df):
    return df.select("user_id", "event_id", r6("h").alias("h"), r6("readout").alias("readout"))


@query
def decayed_state(spark, sf):
    ship(spark)
    return _decay_report(recurrence.decayed_state(fx.decay_in(spark, sf), "user_id", ["ts", "event_id"]))


# Streaming


@query
def stream_encode(spark, sf):
    vocab, path = fx.vocabulary(spark, sf), scratch_path(spark, "encoded")
    docs = fx.arriving_docs(spark, sf)
    stream_encoding.stream_encode(docs, vocab, path, f"{path}/checkpoint")
    return as_text(stream_encoding.encoded(spark, path).select("doc_id", "ids"), "ids")


@query
def stream_encode_capped(spark, sf):
    """All documents arrive in one micro-batch; the budget counts batches of rows inside it."""
    vocab, path = fx.vocabulary(spark, sf), scratch_path(spark, "capped")
    docs = fx.arriving_docs(spark, sf)
    stream_encoding.stream_encode(docs, vocab, path, f"{path}/checkpoint", max_tokens=fx.STREAM_TOKENS, batch_rows=fx.STREAM_ROWS)
    return stream_encoding.encoded(spark, path).select("doc_id", F.size("ids").cast("long").alias("n"))


@query
def stream_sink(spark, sf):
    """Documents stream into a token store in one step, which is then read in windows."""
    ship(spark)
    path = scratch_path(spark, "sink")
    docs = fx.arriving_docs(spark, sf)
    token_stream.write_stream(docs, f"{path}/store", f"{path}/checkpoint", fx.BYTE_VOCAB, order="doc_id", to_ids=fx.with_byte_ids)
    blocks = token_store.read(spark, f"{path}/store", fx.BYTE_VOCAB)
    return as_text(packing.cut_windows(blocks, fx.SEQ_LEN, fx.SEQ_LEN + 1), "tokens")


@query
def stream_source(spark, sf):
    """A token store read as a stream of blocks, cut into windows."""
    path = scratch_path(spark, "source")
    blocks = token_stream.read_stream(spark, _store(spark, sf), fx.BYTE_VOCAB, fx.PART_TOKENS // 4)
    corpus.drain(blocks, f"{path}/blocks", f"{path}/checkpoint")
    return as_text(packing.cut_windows(spark.read.parquet(f"{path}/blocks"), fx.SEQ_LEN, fx.SEQ_LEN + 1), "tokens")


def _ordered_files(spark, df: DataFrame, order: str, n: int) -> tuple[str, int]:
    """Rows as ``n`` arrivals in row order, and how many files an arrival has: they grow with the rows."""
    path = scratch_path(spark, "arrivals")
    rows, top = df.agg(F.count(F.lit(1)), F.max(order)).first()
    files = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // (n * ARRIVAL_ROWS)))
    for i in range(n):
        arriving = df.where(F.floor(F.col(order) * n / (top + 1)) == i)
        arriving.repartitionById(files, F.pmod(order, F.lit(files)).cast("int")).write.mode("append").parquet(path)
    return path, files


@query
def stream_pack(spark, sf):
    ship(spark)
    dirty = fx.docs_dirty(spark, sf)
    (source, files), path = _ordered_files(spark, dirty, "doc_id", 4), scratch_path(spark, "packed")
    arriving = corpus.stream(spark, source, dirty.schema, max_files=files)
    stream_packing.stream_pack(
        arriving, lambda d: fx.with_byte_ids(row_ops.drop_blank(d)), path, f"{path}/checkpoint", fx.SEQ_LEN, fx.SHARDS
    )
    return as_text(stream_packing.packed(spark, path), "tokens")


def _run_keyed(spark, source: DataFrame, build) -> DataFrame:
    path = scratch_path(spark, "keyed")
    arrivals, files = _ordered_files(spark, source, "event_id", 3)
    out = build(corpus.stream(spark, arrivals, source.schema, max_files=files))
    corpus.drain(out, f"{path}/out", f"{path}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{path}/out")


@query
def stream_interval(spark, sf):
    ship(spark)
    log = fx.events(spark, sf).select("event_id", F.col("event_id").alias("step"), F.col("value").alias("loss"))
    path, (arrivals, files) = scratch_path(spark, "intervals"), _ordered_files(spark, log, "event_id", 3)
    keyed.stream_interval(corpus.stream(spark, arrivals, log.schema, max_files=files), fx.LOG_EVERY, f"{path}/out", f"{path}/checkpoint")
    return keyed.intervals(spark, f"{path}/out").withColumn("loss", r6("loss"))


@query
def stream_decayed_state(spark, sf):
    ship(spark)
    rows = fx.decay_in(spark, sf)
    return _decay_report(_run_keyed(spark, rows, lambda s: keyed.stream_decayed_state(s, "user_id", ["ts", "event_id"])))


# Flagship


def training_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to shifted training windows with a learned vocabulary."""
    coded = cut(encoding.encode_docs(spread(fx.docs(spark, sf)), fx.vocabulary(spark, sf), eot=True).drop("text"), "encoded")
    return as_text(packing.shift_targets(packing.chunk_fixed(coded, fx.SEQ_LEN), fx.SEQ_LEN), "x", "y")


QUERIES["training_windows"] = training_windows
