"""Secret scans: fixed patterns, and a battery of randomness tests on other tokens.

Positions come from the pieces between matches: a match starts after all earlier gaps and
matches. Tokens are tested against "drawn uniformly from its alphabet" by a chi-squared,
a runs and a serial-correlation test; the three make one p-value. Tokens that the tests
expose as structured are discoveries, and a Benjamini-Hochberg step-up per alphabet and
length class bounds the share of random strings among them. What is left is a secret.
All of it is DataFrame code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.text import let, row_key, text_of
from corpusloom.session import cut

# The base patterns.
KEYWORD = r"(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYWORD + r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

#: Tokens that the battery tests: long enough, letters and digits mixed.
TOKEN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[0-9+/_-]*[A-Za-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])"
# Alphabets by encoding, smallest first.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "hexup": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
#: Share of random strings that may be dismissed, at most, in an alphabet and length class.
FALSE_DISMISSALS = 0.02
#: Bins of -log2(p); the last one is open.
P_BINS = 60
LENGTH_CLASSES = 40


def spans(text: Column, pattern: str, kind: int, keep: Column | None = None, tail: str | None = None, least: int = 0) -> Column:
    """Array of ``(start, end, kind)`` of the leftmost non-overlapping matches of at least
    ``least`` characters, or whose first group of pattern ``tail`` has that many."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def placed(m: Column, g: Column) -> Column:
        seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,kind:int>>").alias("out"))

        def step(acc, pair):
            start = acc["at"] + F.length(pair["g"])
            end = start + F.length(pair["m"])
            size = F.length(F.regexp_extract(pair["m"], tail, 1)) if tail else F.length(pair["m"])
            one = F.array(F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind")))
            return F.struct(end.alias("at"), F.when(size >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

        pairs = F.transform(m, lambda x, i: F.struct(F.get(g, i).alias("g"), x.alias("m")))
        return F.aggregate(pairs, seed, step, lambda acc: acc["out"])

    none = F.array().cast("array<struct<start:int,end:int,kind:int>>")
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(let(gaps, lambda g: placed(m, g))))


def base_spans(text: Column) -> Column:
    # A long run of hexadecimal digits is rare, a short one is in every word, so runs that
    # could pass are found directly: possessive, hence never a part of a longer run.
    long_hex = r"(?<![0-9a-f])[0-9a-f]{16,}+"
    long_access = r"AKIA[A-Z0-9]{14,}+"
    return F.concat(
        spans(text, ASSIGN, 0, tail=ASSIGN, least=12), spans(text, long_access, 1, least=18), spans(text, long_hex, 2, least=16),
    )


def _encoding(token: Column) -> Column:
    return (
        F.when(token.rlike("^[0-9a-f]+$"), "hex").when(token.rlike("^[0-9A-F]+$"), "hexup")
        .when(token.rlike("^[A-Z2-7]+=*$"), "base32").when(token.rlike("^[0-9a-z]+$"), "base36").otherwise("base64")
    )


def _survival_chi2_3(x: Column) -> Column:
    """Upper tail of the chi-squared distribution with three degrees of freedom."""
    u = F.sqrt(x / 2)
    t = 1 / (1 + 0.3275911 * u)
    # The published rational approximation of the error function.
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return (poly + F.sqrt(2 * x / math.pi)) * F.exp(-x / 2)


def randomness(token: Column) -> Column:
    """Struct of encoding, length class and p-value bin of one token."""

    def tested(encoding: Column, body: Column) -> Column:
        alphabet = F.element_at(F.create_map(*[F.lit(v) for kv in ALPHABETS.items() for v in kv]), encoding)
        return let(alphabet, lambda a: let(F.split(body, ""), lambda chars: numbers(encoding, body, a, F.filter(chars, lambda c: c != ""))))

    def numbers(encoding, body, alphabet, chars):
        size = F.length(alphabet).cast("double")
        n = F.size(chars).cast("double")
        squares = F.aggregate(
            F.array_distinct(chars), F.lit(0.0),
            lambda s, c: s + F.pow((n - F.length(F.replace(body, c, F.lit("")))), 2),
        )
        chi = size / n * squares - n
        z_chi = F.greatest((chi - (size - 1)) / F.sqrt(2 * (size - 1) * (n - 1) / n), F.lit(0.0))
        codes = F.transform(chars, lambda c: (F.instr(alphabet, c) - 1).cast("double"))
        return let(F.struct(codes.alias("x"), size.alias("k"), n.alias("n"), z_chi.alias("z")), lambda v: combined(encoding, v))

    def combined(encoding, v):
        x, n, half = v["x"], v["n"], v["k"] / 2
        upper = F.aggregate(x, F.lit(0.0), lambda s, c: s + (c >= half).cast("double"))
        runs = F.aggregate(
            x, F.struct(F.lit(0.0).alias("r"), F.lit(-1).alias("last")),
            lambda s, c: F.struct((s["r"] + (s["last"] != (c >= half).cast("int")).cast("double")).alias("r"), (c >= half).cast("int").alias("last")),
            lambda s: s["r"],
        )
        mean = F.aggregate(x, F.lit(0.0), lambda s, c: s + c) / n
        moments = let(mean, lambda m: F.aggregate(
            x, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("v"), F.lit(None).cast("double").alias("last")),
            lambda s, c: F.struct(
                (s["s"] + F.coalesce((s["last"] - m) * (c - m), F.lit(0.0))).alias("s"), (s["v"] + (c - m) * (c - m)).alias("v"), c.alias("last")
            ),
            lambda s: F.when(s["v"] > 0, s["s"] / s["v"]).otherwise(1.0),
        ))
        pair = 2 * upper * (n - upper)
        spread = F.sqrt(pair * (pair - n) / (n * n * (n - 1)))
        z_runs = F.when(pair > n, (runs - pair / n - 1) / spread).otherwise(F.sqrt(n))
        z_serial = (moments + 1 / n) * F.sqrt(n)
        total = F.pow(v["z"], 2) + F.pow(z_runs, 2) + F.pow(z_serial, 2)
        p = F.greatest(_survival_chi2_3(F.least(total, F.lit(600.0))), F.lit(1e-300))
        return F.struct(
            encoding.alias("encoding"),
            F.least(F.floor(2 * F.log2(n)), F.lit(LENGTH_CLASSES)).cast("int").alias("length_class"),
            F.least(F.floor(-F.log2(F.least(p, F.lit(1.0)))), F.lit(P_BINS)).cast("int").alias("p_bin"),
        )

    return let(_encoding(token), lambda e: let(F.regexp_replace(F.translate(token, "-_", "+/"), "=+$", ""), lambda b: tested(e, b)))


def scanned(docs: DataFrame) -> DataFrame:
    """``doc_id``, base spans, and tokens with their test results; texts are left behind."""

    def outside(base: Column, s: Column) -> Column:
        return ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))

    text = text_of()
    read = F.struct(base_spans(text).alias("base"), spans(text, TOKEN, 3, least=20).alias("tokens"), text.alias("t"))
    tested = let(read, lambda r: F.struct(
        r["base"].alias("base"),
        F.transform(
            F.filter(r["tokens"], lambda s: outside(r["base"], s)),
            lambda s: F.struct(s.alias("span"), randomness(F.substring(r["t"], s["start"] + 1, s["end"] - s["start"])).alias("test")),
        ).alias("tokens"),
    ))
    return docs.select("doc_id", row_key().alias("key"), tested.alias("_r")).select("doc_id", "key", "_r.base", "_r.tokens")


def dismissal_bins(tokens: DataFrame) -> dict[tuple[str, int], int]:
    """Smallest p-value bin that is dismissed, by alphabet and length class.

    Step-up rule: the largest p at which ``p <= q * (tokens at or below p) / tokens``.
    At most alphabets x length classes x bins rows of counts reach the driver.
    """
    counts = (
        tokens.select(F.explode("tokens.test").alias("t")).groupBy("t.encoding", "t.length_class", "t.p_bin").agg(F.count(F.lit(1)).alias("n")).collect()
    )
    classes: dict[tuple[str, int], dict[int, int]] = {}
    for r in counts:
        classes.setdefault((r["encoding"], r["length_class"]), {})[r["p_bin"]] = r["n"]
    out = {}
    for key, bins in classes.items():
        total, seen = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            seen += bins[b]
            if 2.0 ** -b <= FALSE_DISMISSALS * seen / total:
                out[key] = b
    return out


def secret_spans(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``key``, ``base`` and ``spans``, arrays of (start, end, kind).

    Positions are code points, ends exclusive, in order of start, then kind. Null texts
    are empty; repeated rows give repeated rows; an empty table gives an empty result.
    """
    rows = cut(scanned(docs), "spans")
    bins = dismissal_bins(rows)
    limit = F.create_map(*[F.lit(v) for (e, c), b in bins.items() for v in (f"{e}:{c}", b)]) if bins else F.create_map().cast("map<string,int>")
    kept = F.filter("tokens", lambda t: t["test"]["p_bin"] < F.coalesce(
        F.element_at(limit, F.concat_ws(":", t["test"]["encoding"], t["test"]["length_class"].cast("string"))), F.lit(P_BINS + 1)
    ))
    return rows.select(
        "doc_id", "key", F.array_sort("base").alias("base"),
        F.array_sort(F.concat("base", F.transform(kept, lambda t: t["span"]))).alias("spans"),
    )


def spans_text(spans_column: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    ordered = F.array_sort(F.transform(spans_column, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, one), ",")


def redact(text: Column, spans_column: Column, mark: str = "[SECRET]") -> Column:
    """Text with every span, overlapping ones together, replaced by ``mark``."""
    seed = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))
        wider = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(wider)

    return F.aggregate(spans_column, seed, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def without_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every secret replaced; ``n_chars`` follows where the table has it.

    Only rows with a find join, each once however often it is repeated.
    """
    found = secret_spans(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("spans").alias("__spans"))
    found = found.dropDuplicates(["__id", "__key"])
    marked = docs.withColumn("__row", row_key()).join(found, (F.col("__row") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")
    clean = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(redact(F.col("text"), F.col("__spans")))
    out = marked.withColumn("text", clean)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)
