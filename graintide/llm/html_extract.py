"""Main text of web pages by a maximum-scoring subsequence of words and tags.

A page is read once into a sequence of texts and tags. A word scores by how often words in its surroundings (the block
around it, in a link or not) are main text; a tag costs by how often tags of its kind are not, and a tag that
encloses the main text of labelled pages costs as much as a long passage to step over. One linear scan finds the
contiguous region of the best sum, which is widened to whole blocks and, where it lies in an element that encloses main
text, to the content of that element. Elements that are never main text, by their name
or by words of their class, id and role that were found so, are left out, inside the region too.

Weights come from labelled pages: those with exactly one article element, whose content is the main text, counted in
tasks and summed by feature. At most about `rows` of them are drawn by hash; the `features` most frequent ones make the
model. What few pages show rests on the prior counts below, which count like some pages more.

Defined cases: a null or empty page, or one without any main text, gives an empty text; a page cut off, with tags or
quotes left open, or with comments and scripts that don't end is read as far as it goes; repeated rows and ids give a
row each; an empty table gives no rows; columns beside id, address and html take no part; text isn't cut or capped.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graintide.session import small_batches

# Kinds of elements in HTML.
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Content that is no markup up to the end tag.
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("head script style textarea title xmp iframe noembed noframes noscript template svg math object video audio canvas select button datalist map applet".split())
ASIDE = set("nav aside footer menu dialog form header".split())
# Words of classes, ids and roles by which pages name what is not main text, and reader comments.
NOT_MAIN = set("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside complementary rail widget widgets footer contentinfo masthead topbar toolbar cookie cookies consent gdpr notice notices notification alert disclaimer popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations trending pagination pager paging search skip copyright toc hidden".split())
COMMENTS = set("comment comments commentlist discussion disqus replies respond reactions".split())

TAG = re.compile(r"""<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(!--)|[!?/])""")
LENIENT = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|(!--)|[!?/])")
NAMING = re.compile(r"""\b(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
UNSHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
#: Prior counts (inside, outside) of main text.
PRIOR, PRIOR_WORDS, PRIOR_LINKS = (6.0, 3.0), (4.0, 4.0), (1.0, 8.0)
PRIOR_OF = {"p": (30.0, 2.0), "h1": (10.0, 1.0), "h2": (8.0, 2.0), "h3": (8.0, 2.0), "pre": (20.0, 2.0), "blockquote": (20.0, 2.0), "article": (1.0, 20.0), "main": (1.0, 20.0)}
BORDERS = {"article": (20.0, 0.0), "main": (20.0, 0.0)}
#: Cost of a tag that is always outside, of one that always encloses the main text, and of an element left out.
TAG_COST, BORDER_COST, ASIDE_COST, LEAST = 3.0, 200.0, 0.2, 0.01
#: An attribute's word means no main text from this share outside, in so many pages.
OUTSIDE_SHARE, OUTSIDE_PAGES = 0.98, 20


@dataclass
class Model:
    """Word weights, tag costs and border costs by feature, and words of attributes that mark what is no main text."""

    words: dict[str, float] = field(default_factory=dict)
    tags: dict[str, float] = field(default_factory=dict)
    borders: dict[str, float] = field(default_factory=dict)
    marks: frozenset[str] = frozenset()

    def word(self, key: str) -> float:
        if (found := self.words.get(key)) is None:
            found = self.words[key] = _weight(key, 0, 0)
        return found

    def tag(self, key: str) -> float:
        if (found := self.tags.get(key)) is None:
            found = self.tags[key] = _cost(key, 0, 0)
        return found

    def border(self, name: str) -> float:
        if (found := self.borders.get(name)) is None:
            found = self.borders[name] = _border(name, 0, 0)
        return found


def _weight(key: str, inside: float, outside: float) -> float:
    block, _, link = key.partition("/")
    a, b = PRIOR_LINKS if link else PRIOR_OF.get(block, PRIOR_WORDS)
    return max(0.05, (inside + a) / (inside + outside + a + b))


def _cost(key: str, inside: float, outside: float) -> float:
    a, b = PRIOR_OF.get(key, PRIOR)
    return max(LEAST, TAG_COST * (outside + b) / (inside + outside + a + b))


def _border(name: str, at: float, elsewhere: float) -> float:
    a, b = BORDERS.get(name, (0.0, 20.0))
    return BORDER_COST * (at + a) / (at + elsewhere + a + b)


def events(html: str) -> list[tuple[int, str, str]]:
    """(kind, value, attributes) in order: 0 text, 1 start tag, 2 end tag, 3 content of no markup; names in lower case."""
    out: list[tuple[int, str, str]] = []
    at, last, pattern = 0, html.rfind(">"), TAG
    while (start := html.find("<", at)) >= 0:
        found = pattern.match(html, start)
        if found is None and pattern is TAG and (found := LENIENT.match(html, start)) and found[2]:
            pattern = LENIENT  # a quote stays open: from here on a tag ends at the next bracket
        if found is None:
            if start > last and start + 1 < len(html) and html[start + 1].isalpha():
                out.append((0, html[at:start], ""))
                break  # a tag that the page's end cuts off
            out.append((0, html[at : start + 1], ""))
            at = start + 1
            continue
        if start > at:
            out.append((0, html[at:start], ""))
        if found[4]:
            end = html.find("-->", found.end() - 2)
            at = len(html) if end < 0 else end + 3
        elif not found[2]:
            end = html.find(">", start)
            at = len(html) if end < 0 else end + 1
        else:
            name, at = found[2].lower(), found.end()
            out.append((2 if found[1] else 1, name, found[3]))
            if name in RAW and not found[1]:
                end = RAW_END[name].search(html, at)
                stop = end.start() if end else len(html)
                out.append((3, html[at:stop], ""))
                at = stop
    else:
        if at < len(html):
            out.append((0, html[at:], ""))
    return out


def ends_of(seen: list[tuple[int, str, str]]) -> dict[int, int]:
    """The place of the end tag of each start tag; of one left open, the number of events."""
    ends, opened = {}, {}
    for k, (kind, name, _) in enumerate(seen):
        if kind == 1 and name not in VOID:
            ends[k] = len(seen)
            opened.setdefault(name, []).append(k)
        elif kind == 2 and opened.get(name):
            ends[opened[name].pop()] = k
    return ends


def naming_words(attributes: str) -> set[str]:
    """Words of class, id and role in lower case; `hidden` for what isn't shown."""
    words: set[str] = set()
    for name, *values in NAMING.findall(attributes):
        value, name = "".join(values), name.lower()
        if name == "style":
            words |= {"hidden"} if UNSHOWN.search(value) else set()
        elif name == "aria-hidden":
            words |= {"hidden"} if value.lower() == "true" else set()
        else:
            words |= {w.lower() for w in PARTS.findall(value)}
    return words


class Reader:
    """Walks the events of a page: texts with their surroundings and block, and tags with what they are."""

    def __init__(self, html: str, marks: frozenset[str]):
        self.seen = events(html)
        self.ends = ends_of(self.seen)
        self.marks = NOT_MAIN | COMMENTS | marks
        self.titles, self.articles, self.mains = ([k for k, (kind, n, _) in enumerate(self.seen) if kind == 1 and n == name] for name in ("h1", "article", "main"))

    def _holds(self, places: list[int], k: int) -> bool:
        at = bisect_left(places, k + 1)
        return at < len(places) and places[at] < self.ends.get(k, k)

    def left_out(self, k: int, in_main: bool) -> bool:
        """Whether the element that starts at event k is no main text."""
        _, name, attributes = self.seen[k]
        if name in UNSEEN:
            return name != "head" or self.ends[k] < len(self.seen)
        if name in ("html", "body", "main"):
            return False
        core = self._holds(self.mains, k) or self._holds(self.titles, k)
        unclosed = self.ends.get(k) == len(self.seen)
        if name in ASIDE:
            if name == "header":
                return not (in_main and core) and not self._holds(self.articles, k)
            # a form around the page is none of it, and an element left open isn't taken to hold the article
            return not (core if name == "form" else unclosed and (core or self._holds(self.articles, k)))
        if not attributes:
            return False
        named = naming_words(attributes) & self.marks
        return bool(named) and not core and not (self._holds(self.articles, k) and not named & COMMENTS)

    def walk(self, skip: bool = True) -> Iterator[tuple[str, int, str, int]]:
        """("text", block, surroundings, event), ("tag", start as 1 or end as 2, feature, event), ("out", 0, name, event).

        With skip, elements left out give an "out" and nothing of what they hold."""
        stack: list[str] = []  # open block elements
        opened: Counter = Counter()  # how many of each name are among them
        block, link, core, k = 0, 0, 0, 0
        while k < len(self.seen):
            kind, name, _ = self.seen[k]
            around = stack[-1] if stack else "body"
            if kind == 0:
                yield "text", block, around + "/a" * bool(link), k
            elif kind == 1 and name in UNSEEN and not skip:
                block, k = block + (name in BLOCKS), max(k, min(self.ends.get(k, k), len(self.seen) - 1))
            elif kind == 1:
                if skip and self.left_out(k, core > 0):
                    yield "out", 0, name, k
                    block, k = block + (name in BLOCKS), self.ends.get(k, k)
                elif name in BLOCKS:
                    block += 1
                    if stack and (stack[-1] == "p" or stack[-1] == name == "li"):
                        opened[stack.pop()] -= 1
                    if name not in VOID:
                        stack.append(name)
                        opened[name] += 1
                    core += name in ("article", "main")
                    yield "tag", 1, name, k
                elif name == "br":
                    yield "text", block, around, -1
                else:
                    link += name == "a"
                    yield "tag", 1, f"{around}>{name}", k
            elif kind == 2:
                if name in BLOCKS:
                    block += 1
                    core -= core > 0 and name in ("article", "main")
                    while opened[name] and (top := stack.pop()):
                        opened[top] -= 1
                        if top == name:
                            break
                    yield "tag", 2, name, k
                elif name == "a":
                    link = max(0, link - 1)
            k += 1


def extract(html: str | None, model: Model) -> str:
    """Main text: blocks in page order, joined by newlines."""
    if not html:
        return ""
    reader = Reader(html, model.marks)
    texts: list[tuple[int, str]] = []
    total = best = 0.0
    begin, region = 0, None
    enclosing: list[tuple[str, int]] = []  # open elements that enclose main text, each with its first text
    whole: dict[int, int] = {}  # first and end text of each
    for kind, value, key, k in reader.walk():
        if kind == "text":
            text = " " if k < 0 else unescape(reader.seen[k][1]) if "&" in reader.seen[k][1] else reader.seen[k][1]
            texts.append((value, text))
            if words := len(text.split()):
                total += words * model.word(key)
                if total > best:
                    best, region = total, (begin, len(texts) - 1)
        else:
            border = 0.0 if kind == "out" else model.border(key)
            if border >= BORDER_COST / 2:
                if value == 1:
                    enclosing.append((key, len(texts)))
                elif enclosing and enclosing[-1][0] == key:
                    whole[enclosing.pop()[1]] = len(texts)
            total -= ASIDE_COST if kind == "out" else border + (model.tag(key) if value == 1 else 0.0)
            if total <= 0:
                total, begin = 0.0, len(texts)
    if region is None:
        return ""
    whole |= {start: len(texts) for _, start in enclosing}
    around = [(start, end - 1) for start, end in whole.items() if start <= region[0] and region[1] < end]
    first, last = (texts[k][0] for k in max(around, default=region))
    blocks: dict[int, list[str]] = {}
    for block, text in texts:
        if first <= block <= last:
            blocks.setdefault(block, []).append(text)
    return "\n".join(filter(None, (" ".join("".join(parts).split()) for parts in blocks.values())))


def features(html: str) -> Counter | None:
    """How often each feature is inside, outside or at the border of the main text of a labelled page; None for others."""
    reader = Reader(html, frozenset())
    if len(reader.articles) != 1:
        return None
    start = reader.articles[0]
    end = reader.ends[start]
    found: Counter = Counter()
    for kind, value, key, k in reader.walk(skip=False):
        inside = start < k < end
        if kind == "text" and k >= 0:
            found[f"w:{key}", inside, False] += len(reader.seen[k][1].split())
        elif kind == "tag":
            found[f"b:{key}", k in (start, end), True] += 1
            if value == 1:
                found[f"t:{key}", inside, False] += 1
                for word in naming_words(reader.seen[k][2]):
                    found[f"m:{word}", inside, False] += 1
    return found


def fit(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", rows: int = 5000, features_kept: int = 5000) -> Model:
    """Weights from about `rows` labelled pages drawn by hash; the features_kept most frequent features make the model."""
    small_batches(pages.sparkSession)
    labelled = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).where(F.col("html").ilike("%<article%"))
    known = labelled.count()
    drawn = labelled.where(F.pmod(F.xxhash64("id", "html"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, rows / max(known, 1))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for html in batch.column(0).to_pylist():
                total.update(features(html) or ())
        keys = list(total)
        cols = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["feature", "yes", "n"])

    counts = drawn.select("html").mapInArrow(count, "feature string, yes boolean, n long")
    sums = counts.groupBy("feature").agg(F.sum(F.when(F.col("yes"), F.col("n")).otherwise(0)).alias("yes"), F.sum(F.when(F.col("yes"), 0).otherwise(F.col("n"))).alias("no"))
    model, marks = Model(), set()
    for feature, yes, no in sums.orderBy(F.desc(F.col("yes") + F.col("no")), "feature").limit(features_kept).collect():
        kind, key = feature[0], feature[2:]
        if kind == "w":
            model.words[key] = _weight(key, yes, no)
        elif kind == "t":
            model.tags[key] = _cost(key, yes, no)
        elif kind == "b":
            model.borders[key] = _border(key, yes, no)
        elif no >= OUTSIDE_PAGES and no >= OUTSIDE_SHARE * (yes + no):
            marks.add(key)
    model.marks = frozenset(marks)
    return model


def main_text(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(html, model) for html in batch.column(2).to_pylist()]
            lengths = pa.array([*map(len, texts)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
