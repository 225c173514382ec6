"""Main text of web pages by template deduction over the pages of a host.

A page is a sequence of tokens: tags, told apart by their path, and text runs. Tokens
that occur equally often in each page of a host, so that their occurrence vectors agree,
form an equivalence class. Classes that are large, frequent, and in the same order
everywhere belong to the host's template; they nest, and what lies between their tokens
are slots. The text of the slots inside the page's article is its main text. Text that
is itself part of the template, in an article or elsewhere, is not.

Occurrence vectors never meet in one place: a vector is the combination of hashes of
(page, count), built up by partial aggregates, and two tokens with one such fingerprint
and number of pages share a class. Pages are told apart by what they say: copies of a
page weigh together as one, and pages without any token are none.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.session import cut, ship

#: Different pages a host needs before a template is deduced, share of them a class must
#: reach, and tokens it must have. A text run that so many pages repeat at one path is no
#: coincidence, as tags may be; its class may be itself alone.
MIN_PAGES = 8
SUPPORT = 0.8
MIN_CLASS = 3

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea noscript iframe svg template title object".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body head html option td th tr tbody thead tfoot".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("article aside body div footer form header html main nav ol section table ul dl".split())
# Elements, and words of class, id and role, that hold no article text; words
# that only say that a thing is a container; and elements that hold running text.
ASIDE = frozenset("nav footer aside form button select input label dialog menu head".split())
ASIDE_WORD = re.compile(
    r"(?:ads?|advert\w*|banner|breadcrumbs?|cmts?|comments?|consent|cookies?|footer|header|masthead|menu|nav|navbar|navigation|newsletter|"
    r"notice|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|widget)\Z"
)
HOLDER = re.compile(
    r"(?:area|articles?|bar|block|body|box|buttons?|col|column|container|content|form|frame|group|holder|icons?|inner|items?|left|list|links?|"
    r"main|message|module|outer|panel|posts?|right|row|section|slot|thread|top|bottom|unit|wrap|wrapper|zone|\d+)\Z"
)
#: Blocks in a row that hold nothing but links make a menu on a page without an article.
MENU_BLOCKS = 3
# Elements that hold the whole page, and names that tell what a page or post
# has or is filed under, not what the element is.
FRAME = frozenset("html body main".split())
LAYOUT_NAME = re.compile(r"(?:has|with|without|no|category|tag|type|format|status|layout|theme)[_-]")

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|</?[A-Za-z][^>]*(?:>|\Z)", re.S)
NAMED = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def _hash(*parts) -> int:
    raw = "\x00".join(map(str, parts)).encode("utf-8", "surrogatepass")
    return int.from_bytes(blake2b(raw, digest_size=8).digest(), "little", signed=True)


def events(page: str) -> Iterator[tuple[str, str, str]]:
    """``(kind, name or text, attributes)`` with kinds open, close and text."""
    at = 0
    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            yield "text", page[at:], ""
            return
        if m.start() > at:
            yield "text", page[at:m.start()], ""
        at = m.end()
        name = m[2].lower() if m[2] else ""
        if not name:
            continue
        if m[1]:
            yield "close", name, ""
            continue
        yield "open", name, m[3] or ""
        if name in RAW and not _is_whole(m[3] or ""):
            end = re.compile(f"</{re.escape(name)}\\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            yield "close", name, ""


def _is_whole(attrs: str) -> bool:
    """Whether a tag ends itself; a slash at the end of an unquoted value is part of that."""
    return attrs.endswith("/") and (attrs == "/" or attrs[-2] in " \t\n\r\f\"'")


@lru_cache(1 << 14)
def _names_aside(value: str) -> bool:
    """Whether any name in the value of a class, id or role sets its element aside.

    What a compound names is its last word that is no mere container: a ``cookie-notice``
    and a ``share-buttons`` are set aside, a ``notice-period`` or ``share-prices`` is not.
    """
    for name in value.split():
        words = [w for w in re.split(r"[_-]+", name) if w]
        while len(words) > 1 and HOLDER.match(words[-1]):
            words.pop()
        if words and ASIDE_WORD.match(words[-1]) and not LAYOUT_NAME.match(name):
            return True
    return False


@lru_cache(1 << 14)
def _named(attrs: str) -> tuple[tuple[str, str], ...]:
    """Class, id and role of a tag, in order."""
    return tuple((m[1].lower(), (m[2] or m[3] or m[4] or "").lower()) for m in NAMED.finditer(attrs))


@lru_cache(1 << 16)
def _opened(path: int, aside: bool, article: bool, name: str, named: tuple[tuple[str, str], ...]) -> tuple[int, bool, bool]:
    """Token of a tag below ``path``, and whether it is set aside or in an article."""
    labels = " ".join(f"{kind}={value}" for kind, value in named)
    aside = aside or name in ASIDE or name in RAW or (name == "header" and not article)
    aside = aside or (name not in FRAME and any(_names_aside(value) for _, value in named))
    return _hash(path, name, labels), aside, article or name == "article"


@lru_cache(1 << 16)
def _closed(path: int) -> int:
    return _hash(path, "/")


class Walker:
    """Follows the open elements; each has its path hash and whether it is set aside.

    A tag looks back no further than what it closes or the scope it ends at, so a page
    takes time in proportion to its length, however deep it nests.
    """

    def __init__(self):
        self.stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]
        self.held: dict[str, int] = {}

    def _pop_to(self, depth: int) -> None:
        for name, *_ in self.stack[depth:]:
            self.held[name] -= 1
        del self.stack[depth:]

    def _ends(self, closed: tuple[str, ...]) -> None:
        """Close the innermost of the named elements and all in it, unless a scope lies between."""
        if any(self.held.get(n) for n in closed):
            for i in range(len(self.stack) - 1, 0, -1):
                name = self.stack[i][0]
                if name in closed:
                    self._pop_to(i)
                    return
                if name in SCOPE:
                    return

    def open(self, name: str, attrs: str) -> tuple[int, bool]:
        """Token of the tag and whether it starts a block."""
        if name in CLOSES_P and self.held.get("p"):
            self._ends(("p",))
        elif name in SELF_CLOSING:
            self._ends(SELF_CLOSING[name])
        _, path, aside, article = self.stack[-1]
        token, aside, article = _opened(path, aside, article, name, _named(attrs) if attrs else ())
        if name not in VOID and not _is_whole(attrs):
            self.stack.append((name, token, aside, article))
            self.held[name] = self.held.get(name, 0) + 1
        return token, name in BLOCK

    def close(self, name: str) -> tuple[int, bool] | None:
        if not self.held.get(name):
            return None
        i = len(self.stack) - 1
        while self.stack[i][0] != name:
            i -= 1
        token = _closed(self.stack[i][1])
        self._pop_to(i)
        return token, name in BLOCK

    @property
    def linked(self) -> bool:
        return bool(self.held.get("a"))

    @property
    def top(self) -> tuple[str, int, bool, bool]:
        return self.stack[-1]


def tokens(page: str) -> Iterator[tuple[int, str | None, bool, bool, bool, bool]]:
    """``(token, text or None, block edge, set aside, in article, in a link)`` in page order."""
    walk = Walker()
    for kind, name, attrs in events(page):
        if kind == "text":
            text = " ".join(html.unescape(name).split()) if name.strip() else ""
            _, path, aside, article = walk.top
            if text:
                # Text keeps the white space at its ends, which separates it from its neighbours.
                lead, trail = name[:1].isspace() * " ", name[-1:].isspace() * " "
                yield _hash(path, "text", text), lead + text + trail, False, aside, article, walk.linked
            elif name:
                yield 0, " ", False, aside, article, walk.linked
            continue
        found = walk.open(name, attrs) if kind == "open" else walk.close(name)
        if found is not None:
            _, _, aside, article = walk.top
            yield found[0], " " if name == "br" else None, found[1], aside, article, walk.linked


def counts(page: str) -> dict[int, tuple[int, int, bool]]:
    """Per token of a page: how often it occurs, where first, and whether it is text."""
    out: dict[int, tuple[int, int, bool]] = {}
    for i, (token, text, *_) in enumerate(tokens(page)):
        if token:
            n, first, _ = out.get(token, (0, i, False))
            out[token] = (n + 1, first, text is not None)
    return out


def template_tokens(page_tokens: list[int], classes: dict[int, int]) -> set[int]:
    """Those tokens of a page that its host's classes make template.

    ``classes`` gives each token's class, tokens in the order of the host's pages. A class
    counts on a page only if its tokens follow each other there in that order, as often as
    they occur, and if it nests: between its first and last token no earlier class may end.
    """
    order: dict[int, list[int]] = {}
    for token, c in classes.items():
        order.setdefault(c, []).append(token)
    seen: dict[int, list[tuple[int, int]]] = {}
    for i, t in enumerate(page_tokens):
        if t in classes:
            seen.setdefault(classes[t], []).append((i, t))
    spans = []
    for c, places in seen.items():
        wanted = order[c]
        if len(places) % len(wanted) == 0 and [t for _, t in places] == wanted * (len(places) // len(wanted)):
            spans += [(places[k][0], -places[k + len(wanted) - 1][0], c) for k in range(0, len(places), len(wanted))]
    kept, open_, crossing = set(), [], set()
    for first, last, c in sorted(spans):
        while open_ and open_[-1] < first:
            open_.pop()
        if open_ and -last > open_[-1]:
            crossing.add(c)
            continue
        open_.append(-last)
        kept.add(c)
    return {t for t, c in classes.items() if c in kept and c not in crossing}


def main_text(page: str, classes: dict[int, int]) -> str:
    """Blocks of the article's slots in page order, joined by line ends.

    A page without an article element that holds text of its own, neither template nor set
    aside (as teasers and comments are), is taken whole, minus what is set aside and runs
    of blocks that are links and nothing else. Template
    text, which most pages of the host repeat, is left out; all other text is kept.
    """
    parts = list(tokens(page))
    fixed = template_tokens([p[0] for p in parts], classes) if classes else set()
    in_article = any(
        article and not aside and text is not None and text != " " and token not in fixed for token, text, _, aside, article, _ in parts
    )
    blocks: list[tuple[str, bool]] = []
    now: list[str] = []
    plain = False

    def flush() -> None:
        line = " ".join("".join(now).split())
        if line:
            blocks.append((line, not plain))
        now.clear()

    for token, text, edge, aside, article, linked in parts:
        if edge:
            flush()
            plain = False
        if text is not None and not aside and (article or not in_article) and not (text != " " and token in fixed):
            now.append(text)
            plain = plain or (not linked and text != " ")
    flush()
    if in_article:
        return "\n".join(line for line, _ in blocks)
    kept: list[str] = []
    for links_only, run in groupby(blocks, key=lambda b: b[1]):
        run = list(run)
        if not (links_only and len(run) >= MENU_BLOCKS):
            kept += [line for line, _ in run]
    return "\n".join(kept)


def host(url):
    """Host of a URL in lower case; null where there is none."""
    found = F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def host_classes(pages: DataFrame) -> DataFrame:
    """``(host, tokens, classes)``: template tokens of each host in page order."""

    def count(batches):
        for batch in batches:
            rows = []
            for h, p, w, x in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "weight", "_html"))):
                found = counts(x)
                if found:  # token 0 counts the pages that have tokens
                    rows.append((h, p, w, 0, 1, 0, False))
                rows += [(h, p, w, t, n, i, is_text) for t, (n, i, is_text) in found.items()]
            columns = list(zip(*rows)) or [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "page", "weight", "token", "n", "first", "is_text"])

    named = pages.where(F.col("host").isNotNull())
    # Written first, so that the join knows how few pages have copies and moves no page.
    copies = cut(named.groupBy("host", "page").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"), "copies")
    weighed = named.join(copies, ["host", "page"], "left").select("host", "page", (1.0 / F.coalesce("copies", F.lit(1))).alias("weight"), "_html")
    seen = weighed.mapInArrow(count, "host string, page long, weight double, token long, n int, first int, is_text boolean")
    # Halves of a hash add up without overflow, and copies, unlike under exclusive or, stay in.
    mark = F.xxhash64("page", "n")
    vectors = seen.groupBy("host", "token").agg(
        F.round(F.sum("weight")).cast("long").alias("in_pages"), F.sum(mark.bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"),
        F.sum(F.shiftrightunsigned(mark, 32)).alias("high"), F.avg("first").alias("place"), F.max("is_text").alias("is_text"),
    )
    sizes = vectors.where("token = 0").select("host", F.col("in_pages").alias("pages")).where(F.col("pages") >= MIN_PAGES)
    frequent = vectors.where("token <> 0").join(sizes, "host").where(F.col("in_pages") >= SUPPORT * F.col("pages"))
    # From here on a host has no more tokens than a page and a quarter.
    grouped = frequent.groupBy("host", "low", "high", "in_pages").agg(
        F.collect_list(F.struct("place", "token")).alias("members"), F.max("is_text").alias("has_text")
    ).where((F.size("members") >= MIN_CLASS) | F.col("has_text"))
    flat = grouped.select("host", F.explode("members").alias("m"), F.xxhash64("low", "high", "in_pages").alias("class"))
    return flat.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("m.place", "m.token", "class"))).alias("m")).select(
        "host", F.col("m.token").alias("tokens"), F.col("m.class").alias("classes")
    )


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: ``page_id``, ``url``, ``text``, ``n_chars``.

    Null pages are empty and give an empty text. Pages without a host, and hosts with
    fewer than ``MIN_PAGES`` different pages that have tokens, have no template; their
    tags alone decide. Repeated rows give repeated rows; an empty table gives none.
    """
    ship(pages.sparkSession)
    page_key = F.xxhash64(F.col("html").cast("string"))
    rows = pages.select(
        F.col("page_id").cast("long"), "url", host(F.col("url")).alias("host"), page_key.alias("page"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("_html"),
    )
    templates = cut(host_classes(rows), "templates")

    def run(batches):
        for batch in batches:
            texts = [
                main_text(x, dict(zip(t, c)) if t else {})
                for x, t, c in zip(*(batch.column(n).to_pylist() for n in ("_html", "tokens", "classes")))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    joined = rows.drop("page").join(templates, "host", "left").select("page_id", F.col("url").cast("string"), "_html", "tokens", "classes")
    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
