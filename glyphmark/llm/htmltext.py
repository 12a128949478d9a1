"""Main text of web pages: the maximum-scoring contiguous run of a page's tokens.

Words score positive and tags negative.  The weights come from labelled pages: pages that
mark their own article (article, main, role=main) label each of their words as inside or
outside; each tag name and class gets the log odds of the words under it, each tag the log
ratio of its rates inside and outside as its cost.  At most about MAX_TRAIN pages are read
for that, picked by a hash of page_id; SEED_PAGES stands for pages labelled beforehand.  One
linear scan (Kadane) finds the best region; menus, notices, forms, comments and the like
inside it are left out by the same weights.  A class speaks only if all its words are known
("cookie-notice", not "notice-board"); ids and the classes of inline elements in an article don't.
Time and memory are linear in the page, however broken it is.

Character references are decoded, white space inside a block becomes one space, blocks are
joined in page order by one \\n.  Null or empty html, and pages without a word, give ''.
Broken markup never fails.  Repeated rows are extracted one by one.  Only `page_id`, `url`
and `html` are read; other columns may have any name.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmark.llm.common import table

MAX_TRAIN, MAX_FEATURES = 2_000, 5_000

#: Names of the HTML standard.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select button canvas audio video noframes noembed xmp".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: Elements and class words of what is no main text, and of what is; each stands for so many labelled words.
SEED_PAGES = {
    False: "tag:nav tag:aside tag:footer tag:form tag:dialog tag:menu is:ad is:ads is:advert is:advertisement is:sponsor is:sponsored is:promo is:cookie is:cookies is:consent is:gdpr is:notice is:banner is:alert is:menu is:nav is:navbar is:navigation is:sidebar is:aside is:widget is:comment is:comments is:feedback is:disqus is:replies is:respond is:related is:recommended is:share is:social is:footer is:breadcrumb is:breadcrumbs is:popup is:modal is:overlay is:newsletter is:subscribe is:signup is:login is:search is:pagination is:toolbar is:masthead is:copyright is:complementary is:contentinfo".split(),
    True: "tag:article tag:main is:article is:main is:content is:post is:entry is:story".split(),
}
#: Words of a class that say nothing by themselves; a class speaks only if all its words are known.
GENERIC = frozenset("area block body box container inner item items list outer page reader readers section site slot text thread top bottom left right user wrap wrapper".split())
SEED_WORDS = 2000
#: What a tag costs where no labelled page tells, and the labelled tags that this stands for.
TAG_COST, LINE_TAG_COST, SEED_TAGS = -0.3, -0.05, 50
LINE_TAGS = frozenset("p b i em strong br span".split())
#: The most that one piece of noise inside an article may cost; it is left out, but doesn't end the article.
NESTED_NOISE = -0.5
_ARTICLE = frozenset(SEED_PAGES[True])
_KNOWN = frozenset(f[3:] for names in SEED_PAGES.values() for f in names if f.startswith("is:"))
_STRUCTURE = frozenset("nav aside footer form dialog menu article main header".split())
_WORD = re.compile(r"[a-z]+")
_NAME = re.compile(r"[a-zA-Z][^\s/><]*")
#: What follows a tag's name: quotes count only after an equals sign; a tag also ends where another begins.  No step is taken back.
_TAIL = re.compile(r"(?>[^<>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+")
#: One attribute: its name and its value in double, single or no quotes.  No step is taken back.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))?)?")
_UNSEEN = re.compile(r"display\s*:\s*none", re.I)


def attributes_of(text: str) -> dict[str, str]:
    """Values by lower-cased name; of a name that comes twice the first counts, as in browsers."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


class Element:
    """An open element: its own features only, and what holds for all that is in it."""

    __slots__ = ("name", "parent", "own", "inside", "hidden", "state", "new")

    def __init__(self, name: str, attributes: str, parent: Element | None):
        own = (f"tag:{name}",)
        within = bool(parent and parent.inside)
        has = attributes_of(attributes) if attributes else {}
        roles = has.get("role", "").lower().split()
        # An id inside an article is an anchor, and an inline element's class there is its looks.
        said = [] if within and name in INLINE else [*has.get("class", "").lower().split(), *roles, *([] if within else has.get("id", "").lower().split())]
        for token in said:
            words = _WORD.findall(token)
            own += (f"class:{token}",)
            if all(w in _KNOWN or w in GENERIC for w in words):
                own += tuple(f"is:{w}" for w in words if w in _KNOWN)
        self.name, self.parent, self.own = name, parent, own
        self.inside = within or "main" in roles or name in ("article", "main")
        unseen = "hidden" in has or has.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(has.get("style", "")))
        self.hidden = unseen or bool(parent and parent.hidden)
        self.state = self.new = None


class Reader:
    """Tokens of a page in one pass; open elements are counted by name, so no step looks at more than the elements it closes."""

    def __init__(self, page: str):
        self.page = page
        self.stack: list[Element] = []
        self.blocks: list[int] = []
        self.open: Counter = Counter()
        self.closed: list[Element] = []

    def _cut(self, k: int) -> None:
        for e in self.stack[k:]:
            self.open[e.name] -= 1
        self.closed += reversed(self.stack[k:])
        del self.stack[k:]
        while self.blocks and self.blocks[-1] >= k:
            self.blocks.pop()

    def _end(self, name: str) -> None:
        if self.open[name] > 0:
            k = len(self.stack) - 1
            while self.stack[k].name != name:
                k -= 1
            self._cut(k)

    def _begin(self, name: str, attributes: str) -> None:
        self.stack.append(Element(name, attributes, self.stack[-1] if self.stack else None))
        self.open[name] += 1
        if name in BLOCK:
            self.blocks.append(len(self.stack) - 1)

    def tokens(self) -> Iterator[tuple[str, str, Element | None]]:
        """('text', raw, element), ('tag', name, element) and ('break', name, element) in page order."""
        page, size, at, begun = self.page, len(self.page), 0, 0
        unclosed: set[str] = set()
        inside = lambda: self.stack[-1] if self.stack else None
        while True:
            lt = page.find("<", at)
            if lt < 0:
                break
            ending = page.startswith("/", lt + 1)
            m = _NAME.match(page, lt + 1 + ending)
            if not m and not page.startswith(("!", "?", "/"), lt + 1):
                at = lt + 1
                continue
            if lt > begun:
                yield "text", page[begun:lt], inside()
            if not m:
                if page.startswith("<!--", lt):
                    ends = [e for e in (page.find("-->", lt + 2), page.find("--!>", lt + 2)) if e >= 0]
                    at = page.index(">", min(ends)) + 1 if ends else size
                else:
                    end = page.find(">", lt)
                    at = end + 1 if end >= 0 else size
                begun = at
                continue
            name, tail = m[0].lower(), _TAIL.match(page, m.end())
            at = tail.end()
            if at >= size:
                begun = size
                break
            at = begun = at + page.startswith(">", at)
            if ending:
                self._end(name)
                yield ("break" if name in BLOCK else "tag"), name, inside()
                continue
            if name in RAW and not tail[0].endswith("/"):
                close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                if close:
                    at = begun = close.end()
                else:
                    unclosed.add(name)
                    if name in ("script", "style", "title", "textarea"):
                        at = begun = size
                continue
            if name in BLOCK and self.blocks:
                near = self.stack[self.blocks[-1]].name
                if near == "p" or near == name == "li":
                    self._cut(self.blocks[-1])
            yield ("break" if name in BLOCK or name == "br" else "tag"), name, inside()
            if name not in VOID:
                self._begin(name, tail[0])
        if begun < size:
            yield "text", page[begun:], inside()
        self._cut(0)


def tokens(page: str) -> Iterator[tuple[str, str, Element | None]]:
    return Reader(page).tokens()


def _n_words(raw: str) -> int:
    return len(raw.split())


def label_counts(page: str) -> tuple[Counter, Counter]:
    """Words under each feature, and tags, inside and outside the article a page marks; nothing for a page without one.

    An element hands its words on to its parent when it closes.  A feature of several open
    elements counts for the outermost of them.
    """
    sides: tuple[Counter, Counter] = (Counter(), Counter())
    held: dict[int, list[int]] = {}
    active: Counter = Counter()
    reader, done, deep = Reader(page), 0, []

    def close(e: Element) -> None:
        words = held.pop(id(e), [0, 0])
        for f in e.new or ():
            active[f] -= 1
            for side, n in zip(sides, words, strict=True):
                side[f] += n
        if e.parent is not None:
            up = held.setdefault(id(e.parent), [0, 0])
            up[0] += words[0]
            up[1] += words[1]

    for kind, raw, element in reader.tokens():
        for e in reader.closed[done:]:
            close(e)
        done = len(reader.closed)
        deep = reader.stack
        for e in reversed(deep):
            if e.new is not None:
                break
            e.new = []
        k = len(deep)
        while k and deep[k - 1].new == [] and deep[k - 1].state is None:
            k -= 1
        for e in deep[k:]:
            e.state = True
            e.new = [f for f in dict.fromkeys(e.own) if not active[f]]
            active.update(e.new)
        if element is None:
            continue
        side = 0 if element.inside else 1
        if kind != "text":
            sides[side][f"cost:{raw}"] += 1
        elif n := _n_words(raw):
            held.setdefault(id(element), [0, 0])[side] += n
            sides[side][""] += n
    for e in reader.closed[done:]:
        close(e)
    return sides if sides[0][""] and sides[1][""] else (Counter(), Counter())


class Weights:
    def __init__(self, inside: dict[str, int], outside: dict[str, int]):
        inside, outside = Counter(inside), Counter(outside)
        n_in, n_out = inside[""], outside[""]
        self.cost: dict[str, float] = {}
        for f in {*inside, *outside}:
            if f.startswith("cost:"):
                name, a, b = f[5:], inside[f], outside[f]
                learnt = min(0.0, max(-1.0, 0.3 * (math.log((a + 1) / (b + 1)) - math.log((n_in + 1) / (n_out + 1))))) - 0.02
                self.cost[name] = (learnt * (a + b) + self._seed_cost(name) * SEED_TAGS) / (a + b + SEED_TAGS)
        for good, names in SEED_PAGES.items():
            for f in names:
                (inside if good else outside)[f] += SEED_WORDS
        base = math.log((n_in + SEED_WORDS) / (n_out + SEED_WORDS))
        self.known: dict[tuple, tuple[float, bool, bool]] = {}
        self.weight = {f: math.log((inside[f] + 20) / (outside[f] + 20)) - (base if inside[f] and outside[f] else 0) for f in {*inside, *outside} if f and not f.startswith("cost:")}

    @staticmethod
    def _seed_cost(name: str) -> float:
        return LINE_TAG_COST if name in LINE_TAGS else TAG_COST

    def tag(self, name: str) -> float:
        return self.cost.get(name, self._seed_cost(name))

    def _state(self, e: Element) -> tuple[float, bool, bool]:
        """The sum of an element's weights and its parents'; the innermost surely outside element decides."""
        todo = [e]
        while todo[-1].state is None and todo[-1].parent is not None:
            todo.append(todo[-1].parent)
        for x in reversed(todo):
            if x.state is None:
                before = x.parent.state if x.parent else (0.0, False, False)
                x.state = self.known.get((before, x.own))
                if x.state is None:
                    x.state = self._step(before, x.own)
                    if len(self.known) < 100_000:
                        self.known[before, x.own] = x.state
        return e.state

    def nested(self, e: Element) -> bool:
        """Whether an element is one of those that hold main text, or in one."""
        return self._state(e)[2]

    def _step(self, before: tuple[float, bool, bool], own: tuple[str, ...]) -> tuple[float, bool, bool]:
        total, inside, nested = before
        for f in own:
            nested = nested or f in _ARTICLE
            w = self.weight.get(f, 0.0)
            if f in ("tag:article", "tag:main"):
                inside = True
            elif f == "tag:header" and not inside:
                w = min(w, -3.0)
            if f[:4] != "tag:" or f[4:] in _STRUCTURE:
                total = min(w, total) if w < -1.5 else total + max(0.0, w)
            elif f == "tag:a" and not inside:
                total = max(-30.0, total - 0.3)
        return min(total, 30.0), inside, nested

    def word(self, e: Element | None) -> float:
        """What a word in an element scores."""
        total = self._state(e)[0] if e else 0.0
        return -min(4.0, 1.0 - total) if total < -1.0 else min(1.0, 0.4 + total)


def extract(page: str | None, weights: Weights) -> str:
    """The best region's blocks; text whose own score is negative is left out of it."""
    if not page:
        return ""
    items = []
    best = run = 0.0
    begun = first = last = 0
    for kind, raw, element in tokens(page):
        if kind == "text":
            score = (-4.0 if element and element.hidden else weights.word(element)) * _n_words(raw)
            if score < NESTED_NOISE and element and weights.nested(element):
                score = NESTED_NOISE
            items.append((kind, raw, score))
        else:
            score = weights.tag(raw)
            items.append((kind, raw, score))
        if run <= 0:
            run, begun = 0.0, len(items) - 1
        run += score
        if run > best:
            best, first, last = run, begun, len(items)
    blocks: list[str] = []
    part: list[str] = []
    for kind, raw, score in items[first:last]:
        if kind == "text":
            if score >= 0:
                part.append(raw)
        elif kind == "break":
            if raw == "br":
                part.append(" ")
            elif part:
                blocks.append("".join(part))
                part = []
    blocks.append("".join(part))
    clean = (" ".join((html.unescape(b) if "&" in b else b).split()) for b in blocks)
    return "\n".join(b for b in clean if b)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    inside: Counter = Counter()
    outside: Counter = Counter()
    for batch in batches:
        for page in batch.column("html").to_pylist():
            a, b = label_counts(page or "")
            inside.update(a)
            outside.update(b)
    names = sorted({*inside, *outside})
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([inside[n] for n in names], pa.int64()), pa.array([outside[n] for n in names], pa.int64())], names=["feature", "inside", "outside"])


def train(pages: DataFrame, max_train: int = MAX_TRAIN) -> Weights:
    share = min(1.0, max_train / max(1, pages.count()))
    sample = pages.where(F.pmod(F.xxhash64(F.col("page_id").cast("long")), F.lit(1_000_000)) < int(share * 1_000_000)).select("html")
    counts = sample.mapInArrow(_count, "feature string, inside long, outside long").groupBy("feature").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    rows = counts.orderBy(F.desc(F.col("i") + F.col("o")), "feature").limit(MAX_FEATURES).collect()
    return Weights({r["feature"]: r["i"] for r in rows if r["i"]}, {r["feature"]: r["o"] for r in rows if r["o"]})


def _extract(weights_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p, weights_bc.value) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, weights: Weights) -> DataFrame:
    """page_id, url, text, n_chars; one row for each row of pages."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(_extract(pages.sparkSession.sparkContext.broadcast(weights)), "page_id long, url string, text string, n_chars long")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, train(pages))
