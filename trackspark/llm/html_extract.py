"""HTML extraction by a maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, tags negative, each by a weight that labelled pages give to
its kind; one linear scan finds the contiguous region with the highest sum. Blocks of the region that stand in template
elements (menus, sidebars, adverts, forms, comments ...) are left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pages from which weights are learned, at most. A label is the page's own article or main element.
LABELLED_PAGES = 400
#: Characters from which on a page is no example.
LONG_PAGE = 200_000

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|iframe|object|select|title)\b[^>]*+>.*?(?:</\1\s*+>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)|<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))|([^<]++|<)",
    re.S | re.I,
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_TEMPLATE = frozenset("nav header footer aside form menu dialog button head fieldset".split())
_MARK = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|sidebar|side|aside|ads?|advert\w*|adverts?|promo\w*|sponsor\w*|banner|cookies?|notice|notices|alert|consent|gdpr"
    r"|comments?|replies|respond|disqus|footer|header|masthead|breadcrumbs?|share|sharing|social|related|recommend\w*|subscribe|newsletter|signup|login|popup|modal"
    r"|overlay|pagination|pager|widget|toolbar|search|skip|legal|copyright|contentinfo|complementary|search)(?=$|[\s_\d-])",
    re.I,
)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:[a-z]*comments?(?:list|area|section|thread|box|form)?|discussions?|replies|respond|disqus)(?=$|[\s_\d-])", re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)

#: Names that tell of the page's layout or state, not of what the element is.
_MODIFIER = re.compile(r"(?:has|no|with|without|is|not|hide|show)[-_].*|.*[-_](?:enabled|disabled|on|off|open|closed)", re.I)

#: Elements that are templates but may also wrap a whole page.
_WRAPPING = frozenset(("form", "fieldset"))
#: Marked elements are wrappers of the content where the words outside them are fewer than this part of those in the largest of them.
WRAPPED = 0.05

#: Weights before any labelled page is seen: of a word, a word in a template element, and tags by kind.
PRIOR = {"word": 1.0, "template word": -1.0, "link word": 0.3, "inline": -0.1, "block": -0.3, "container": -1.0, "template": -5.0}


def _marks(attributes: str) -> str:
    return " ".join(y for x in _NAMES.findall(attributes) for y in "".join(x).split() if not _MODIFIER.fullmatch(y)) if "=" in attributes else ""


class _Words:
    """Words of a page, or of its articles: outside template elements, and by the start of the outermost one that only its names (or a form) make one."""

    def __init__(self) -> None:
        self.plain = {True: 0, False: 0}
        self.marked = {True: Counter(), False: Counter()}

    def wrappers(self) -> frozenset[int]:
        """Starts of the elements that must be the content's wrappers, as next to nothing stands outside them: the largest, and those at least half as large."""
        inside = bool(self.plain[True] or self.marked[True])
        most = max(self.marked[inside].values(), default=0)
        if self.plain[inside] >= WRAPPED * most:
            return frozenset()
        return frozenset(at for at, n in self.marked[inside].items() if 2 * n >= most)


def tokens(page: str) -> Iterator[tuple[str, str, bool]]:
    """(kind, text of a text token or the tag's name, whether the tag ends a block). Attributes never count as text.

    An element whose names make it a template is one however long it is, as long as the article (or a page without article) has words
    beside such elements; where it has next to none, they wrap its content and count as plain, and what is marked inside them is seen anew.
    """
    plain: frozenset[int] = frozenset()
    while True:
        words = _Words()
        for _ in _tokens(page, plain, words):
            pass
        found = words.wrappers()
        if found <= plain:
            return _tokens(page, plain)
        plain |= found


def _tokens(page: str, wrappers: frozenset[int] = frozenset(), words: _Words | None = None) -> Iterator[tuple[str, str, bool]]:
    """tokens(), with the elements that start at `wrappers` plain. words: counts where words stand."""
    # of each open element: its name; 0 plain, 1 template, 2 reader comments; start of the outermost template element if that may be a wrapper, else -1; inside an article
    open_: list[tuple[str, int, int, bool]] = []
    for m in _TOKEN.finditer(page):
        text, name = m[5], m[3]
        _, held, via, inside = open_[-1] if open_ else ("", 0, -1, False)
        if text is not None:
            if words is not None:
                n = len(text.split())
                for scope in (True, False) if inside else (False,):
                    if not held:
                        words.plain[scope] += n
                    elif via >= 0 and n:
                        words.marked[scope][via] += n
            linked = not inside and any(x == "a" for x, *_ in open_[-4:])
            yield "template word" if held else "link word" if linked else "word", text, False
        elif name is not None:
            name = name.lower()
            end = name not in _INLINE and name != "br"
            if m[2]:
                at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i][0] == name), None)
                if at is not None:
                    held = max(x for _, x, *_ in open_[at:])
                    del open_[at:]
            elif name not in _VOID:
                marks = _marks(m[4])
                marked = 2 if _COMMENT.search(marks) else 1 if _MARK.search(marks) else 0
                always = name in _TEMPLATE and not (name == "header" and inside and not marks)
                may_wrap = marked < 2 and (not always or name in _WRAPPING)
                own = 0 if name in ("html", "body", "article", "main") or may_wrap and m.start() in wrappers else max(marked, always)
                if name == "p" and open_ and open_[-1][0] == "p":
                    open_.pop()
                    _, held, via, inside = open_[-1] if open_ else ("", 0, -1, False)
                if name in ("article", "main") and marked == 0 and held == 1 or name in ("html", "body"):
                    held = 0  # an unclosed menu ends where the article begins
                if own and not held:
                    via = m.start() if may_wrap else -1
                held = max(held, own)
                open_.append((name, held, via, inside or name in ("article", "main")))
            yield "template" if held else "inline" if not end else "block" if re.fullmatch(r"p|h[1-6]|li|ul|ol|dl|dt|dd|blockquote|pre|t[rdh]|table|tbody|figure|figcaption|hr", name) else "container", name, end


def best_region(page: str, weights: dict[str, float]) -> tuple[list[tuple[str, str, bool]], int, int]:
    """All tokens, and first and last (exclusive) of the region with the highest sum; of equal ones the first and longest."""
    all_ = list(tokens(page))
    best, at, run, start = 0.0, (0, 0), 0.0, 0
    for i, (kind, text, _) in enumerate(all_):
        if run <= 0:
            run, start = 0.0, i
        run += weights[kind] * (len(text.split()) if "word" in kind else 1)
        if run > best or run == best > 0:
            best, at = run, (start, i + 1)
    return all_, *at


def main_text(page: str, weights: dict[str, float] = PRIOR) -> str:
    """Text of the best region without template elements: blocks in page order, one a line, white space runs as one space."""
    all_, first, last = best_region(page, weights)
    blocks: list[list[str]] = [[]]
    for kind, text, end in all_[first:last]:
        if end:
            blocks.append([])
        elif kind in ("word", "link word"):
            blocks[-1].append(text)
        elif text == "br":
            blocks[-1].append(" ")
    joined = (" ".join(html.unescape("".join(x)).split()) for x in blocks if x)
    return "\n".join(x for x in joined if x)


def learn_weights(pages: Iterable[str]) -> dict[str, float]:
    """Log-odds of each kind inside against outside the pages' article or main elements; words stay positive, tags negative."""
    inside, outside = Counter(), Counter()
    for page in pages:
        m = re.search(r"<(article|main)\b[^>]*>", page, re.I)
        if not m:
            continue
        end = page.lower().rfind(f"</{m[1].lower()}")
        for part, into in ((page[: m.start()], outside), (page[m.end() : end if end > 0 else None], inside), (page[end:] if end > 0 else "", outside)):
            for kind, text, _ in _tokens(part):
                into[kind] += len(text.split()) if "word" in kind else 1
    if not inside:
        return dict(PRIOR)
    n, m = sum(inside.values()), sum(outside.values())
    out = {}
    for kind, prior in PRIOR.items():
        odds = math.log((inside[kind] + 1) / (n + 1)) - math.log((outside[kind] + 1) / (m + 1))
        out[kind] = min(max(odds, 0.5 * prior), 3.0) if prior > 0 else max(min(odds, 0.5 * prior), -12.0)
    return out


def _extracted(batches: Iterable[pa.RecordBatch], weights: dict[str, float]) -> Iterator[pa.RecordBatch]:
    for part in common.slices(batches, "html"):
        found = [main_text(x, weights) for x in common.texts(part, "html")]
        yield pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def extract_main_text(pages: DataFrame, labelled_pages: int = LABELLED_PAGES) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars; a row for each row.

    Null, empty and text-free pages give an empty text. Repeated rows stay; other columns are not read. The weights come
    from at most `labelled_pages` pages that mark their own article (those of least hash of page_id and html, so that the choice
    does not depend on the order of tasks; pages of LONG_PAGE characters or more teach nothing), which bounds what the driver
    gets; every page is then read whole, in one pass without a shuffle. Unclosed elements end with the page.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    marked = rows.where(F.col("html").rlike(r"(?i)<(article|main)\b")).where(F.length("html") < LONG_PAGE).withColumn("key", F.xxhash64("page_id", "html"))
    last = marked.select("key").distinct().orderBy("key").limit(labelled_pages).agg(F.max("key")).first()[0]
    sample = marked.where(F.col("key") <= last).select("key", "html").dropDuplicates(["key"]).orderBy("key").collect() if last is not None else []
    weights = learn_weights(r.html for r in sample)
    return rows.mapInArrow(lambda batches: _extracted(batches, weights), "page_id long, url string, text string, n_chars long")


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(common.read(spark, sf_dir, "pages"))
