"""Text expressions: defaults, blanks, pieces and byte symbols. All run in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the byte-level pre-tokenization pattern published with GPT-2.
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Special tokens, in id order.
DEFAULT_SPECIALS = ("<|EOT|>", "<|PAD|>", "<|BOT|>")

NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"


def text_or_empty(text: Column | str = "text") -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def is_blank(text: Column) -> Column:
    """True where nothing but Unicode white space is left; ``trim`` only knows spaces."""
    return ~text.rlike(NOT_BLANK)


def pieces(text: Column) -> Column:
    """Pieces of a text, in order. ``(?U)`` makes white space mean Unicode white space."""
    return F.regexp_extract_all(text, F.lit("(?U)" + PIECE_PATTERN), F.lit(0))


def special_pattern(specials: tuple[str, ...]) -> str:
    """Alternation of the special tokens, longest first."""
    return "|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True))


def pieces_around_specials(text: Column, specials: tuple[str, ...]) -> Column:
    """Pieces of a text in which each special token is one piece of its own.

    Specials split the text before the pattern applies, so no piece crosses one. Texts
    without a special, nearly all, take the direct path.
    """
    if not specials:
        return pieces(text)
    marks = special_pattern(specials)
    segments = F.regexp_extract_all(text, F.lit(rf"(?s){marks}|.+?(?={marks}|\z)"), F.lit(0))
    split = F.flatten(
        F.transform(segments, lambda s: F.when(s.isin(*specials), F.array(s)).otherwise(pieces(s)))
    )
    present = F.lit(False)
    for s in specials:
        present = present | text.contains(s)
    return F.when(present, split).otherwise(pieces(text))


def byte_chars(text: Column) -> Column:
    """One character U+0000..U+00FF per UTF-8 byte of ``text``."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def printable_byte(b: int) -> str:
    """Printable stand-in of a byte: itself where visible in Latin-1, else from U+0100 on."""
    return chr(b if _visible(b) else 256 + sum(not _visible(x) for x in range(b)))


def _visible(b: int) -> bool:
    return 33 <= b <= 126 or (161 <= b <= 255 and b != 173)
