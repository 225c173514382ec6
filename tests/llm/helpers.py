"""Small inputs with everything that may go wrong in a table."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size int, target string, component_id string, "
    "n_words string, kept string, spans string, _source string, ids string, doc string, gram string"
)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def rows(texts, lang="en", source="a"):
    return [(i, t, lang, source, len(t or ""), 1, "x", "y", "z", "k", "s", "o", "i", "d", "g") for i, t in texts]


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA)


def edge_texts():
    long_text = prose(1, 4000)
    return [
        (1, None), (2, ""), (3, " \n\t \x0b"), (4, "one two"), (5, long_text), (6, long_text), (7, long_text + " and more"),
        (9, "x" * 3000), (10, "é ß 日本 \U0001f600 \x00 token"), (11, prose(2, 120)), (11, prose(2, 120)), (12, "a b a b a b a b"), (None, prose(3, 80)), (None, None),
    ]
