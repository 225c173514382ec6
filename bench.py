"""Time the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import encoding, packing
from corpusloom.operators import vocabulary as voc
from corpusloom.plans import fixtures as fx
from corpusloom.plans.queries import QUERIES
from corpusloom.session import cut, scratch_path, ship, spread
from corpusloom.sources import token_store


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    times: dict[str, float] = {}

    def run(name, make):
        begin = time.perf_counter()
        result = make()
        if hasattr(result, "write"):
            result.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
        return result

    spark.read.parquet(f"{sf}/documents.parquet").count()
    vocab = run("bpe_train", lambda: fx.vocabulary(spark, sf))
    docs = fx.docs(spark, sf)
    encode = lambda: encoding.encode_docs(spread(docs), vocab, eot=True).select("doc_id", "ids")
    run("append_eot_cold", encode)
    run("append_eot", encode)
    coded = run("encode_and_store", lambda: cut(encode(), "encoded"))
    tokens = packing.total_tokens(coded)
    positioned = run("global_offsets", lambda: packing.stream_positions(coded))
    run("token_sink", lambda: token_store.write(positioned, scratch_path(spark, "store"), vocab.size, 1 << 20))
    run("chunk_fixed", lambda: packing.shift_targets(packing.chunk_fixed(coded, fx.SEQ_LEN), fx.SEQ_LEN))
    run("decode_ids", lambda: coded.select(encoding.decode_ids(F.col("ids"), vocab)))
    run("word_count", lambda: voc.word_counts(spread(docs)))
    for name in (
        "corpus_scan", "blank_filter", "first_n_sample", "row_round_robin", "pretokenize", "pair_count",
        "pack_overlap", "contiguous_shards", "seeded_shuffle", "batches", "budget_cap", "heldout_ce",
        "interval_loss", "throughput", "step_latency", "expert_load", "load_bias", "topk_routing",
        "weighted_combine", "candidate_sampling", "decayed_state",
    ):
        run(name, lambda: QUERIES[name](spark, sf))
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf.rsplit("sf", 1)[-1], "tokens": tokens,
        "encode_tokens_per_sec": round(tokens / times["append_eot"]),
        "pack_tokens_per_sec": round(tokens / times["chunk_fixed"]),
    }))


if __name__ == "__main__":
    main()
