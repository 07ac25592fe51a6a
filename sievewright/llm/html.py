"""HTML main-text extraction by a minimum cut.

A page is read into text blocks with their containers.  A logistic classifier turns a block's evidence (the
containers above it, link share, length, sentence marks) into the cost of calling it content and of calling it boilerplate: the
capacities to the two terminals.  Neighbours in page order, and blocks that follow one another in one container, are joined by smoothness
edges, the stronger the closer they are in the tree.  A maximum flow gives the labelling of least total cost.

The classifier's weights are learnt from at most ``FIT_PAGES`` pages and ``FIT_BLOCKS`` of their blocks, without labels by hand: blocks in an article or
main element and in no menu, footer, aside or form teach content, blocks in those teach boilerplate, and what is learnt (text weights, and
the odds of the words in class names) serves pages without such elements.  Learning starts from stated weights and words, which hold as
they are where there is nothing to learn from.

Page sizes vary but a page's graph is small: blocks plus two edges each.  Labellings are cached by the graph's whole-number
capacities, as pages of one site repeat them.

Cases.  Null or empty html, or a page without content: empty text, 0 characters.  Unclosed, crossed and unknown tags are read like a lenient browser
would: end tags are optional, an unclosed script or style runs to the end, an unclosed title to the next tag.  Bytes that aren't
UTF-8 count as replacement characters.  Null ids and urls stay null; repeated rows are extracted each.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import html as html_lib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm._util import valid_text

FIT_PAGES, FIT_BLOCKS = 2000, 50_000

#: Element names by role.  Raw elements hold no markup; controls end where a container begins.
RAW = frozenset("script style title textarea".split())
CONTROLS = frozenset("select button option optgroup".split())
CONTAINERS = CONTROLS | frozenset("html body main article section nav header footer aside div form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th blockquote figure figcaption details summary center dialog menu noscript template iframe".split())
BLOCKS = CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 pre hr address legend caption title textarea".split())
#: Words in class, id and role attributes that name boilerplate or content.
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent notice gdpr newsletter subscribe signup login "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar side aside widget header masthead footer foot copyright legal comment comments discussion reply replies "
    "respond disqus share sharing social related recommended popular trending pagination pager tags toolbar popup modal overlay search skip complementary contentinfo alert".split()
)
GOOD_WORDS = frozenset("article content main post entry story body text prose markdown".split())
LAYOUT_WORDS = frozenset("has with without no is hide show".split())
#: What an article element may be instead of the page's own: other words in its names are its topics.
NOT_THE_ARTICLE = frozenset("ad ads advert advertisement sponsor sponsored promo comment comments reply replies related recommended popular trending".split())
GOOD_TAGS = {"article": 3.0, "main": 2.0}
BAD_TAGS = {"nav": 6.0, "footer": 6.0, "aside": 6.0, "header": 4.0, "form": 6.0, "dialog": 6.0, "menu": 6.0, "noscript": 6.0, "template": 6.0, "iframe": 6.0} | dict.fromkeys(CONTROLS, 6.0)
#: Smoothness of neighbours, by what they share.
SAME_PARENT, ADJACENT, SCALE = 0.9, 0.25, 20
#: Attributes that a tag may have before its quotes no longer count.
MOST_QUOTES = 64

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^\"'<>]|\"[^\"<>]*+\"|'[^'<>]*+')*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_STOP = re.compile("[\"'>]")
_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass(frozen=True)
class Weights:
    """Of a block's text (constant, link share, length, sentence mark, heading), and of the words in names where learnt; listed words else."""

    text: tuple[float, ...] = (-1.2, -4.0, 0.45, 0.6, 0.8)
    words: dict[str, float] = field(default_factory=dict)

    def word(self, word: str) -> float:
        return self.words.get(word, prior_of(word))


def prior_of(word: str) -> float:
    return -5.0 if word in BAD_WORDS else 2.5 if word in GOOD_WORDS else 0.0


STATED = Weights()


@dataclass(frozen=True, slots=True)
class Block:
    """A text block: characters in links, the container's number, evidence of the containers by tag and in all, a heading or not, words of the containers' names."""

    text: str
    linked: int
    container: int
    by_tag: float
    evidence: float
    heading: bool
    words: frozenset[str]

    def features(self) -> tuple[float, ...]:
        sentence = self.text[-1] in ".!?…\"'”)"
        return 1.0, self.linked / len(self.text), float(min(6, len(self.text).bit_length() - 2)), float(sentence), float(self.heading)


def name_evidence(tag: str, attrs: str, weights: Weights) -> tuple[float, frozenset[str]]:
    """(evidence, words) of the names in ``attrs``: those that speak of content weigh against one that speaks of boilerplate."""
    good = bad = 0.0
    seen: set[str] = set()
    for found in _NAMES.findall(attrs):
        for name in "".join(found).lower().split():
            words = _WORD.findall(name)
            best = worst = 0.0
            for i, word in enumerate(words):
                # ``has-sidebar`` or ``no-comments`` speaks of a page's layout, not of what is inside.
                if (i and words[i - 1] in LAYOUT_WORDS) or (tag in GOOD_TAGS and word not in NOT_THE_ARTICLE and word in BAD_WORDS):
                    continue
                seen.add(word)
                w = weights.word(word)
                # The first of several words often says what kind of thing the others are: ``tags-politics``.
                worst = min(worst, w if i == len(words) - 1 else 0.8 * w)
                best = max(best, w)
            if worst < 0:
                bad = min(bad, worst)
            else:
                good = max(good, best)
    if _HIDDEN.search(attrs):
        bad = min(bad, -5.0)
    return good + bad, frozenset(seen)


def below(above: float, own: float) -> float:
    """Evidence inside a container: boilerplate inside an article stays so, as a bad container outweighs a good one above it."""
    if own < 0:
        return min(above, 0.0) + own
    return max(above, own) if above >= 0 else above


def tag_end(page: str, at: int) -> int:
    """Place of the tag's ``>`` from ``at`` on, outside quotes; unclosed or endless quotes don't count; -1 if there is none."""
    place = at
    for _ in range(MOST_QUOTES):
        m = _STOP.search(page, place)
        if m is None or m[0] == ">":
            return m.start() if m else -1
        place = page.find(m[0], m.end()) + 1
        if not place:
            break
    return page.find(">", at)


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(text, tag, attributes): text before a tag, the tag's lower-case name with ``/`` before it at an end; comments and raw content left out."""
    at = shown = 0
    last = page.rfind(">")
    # From where on an end is known to be missing: no search is made twice.
    missing: set[str] = set()
    while True:
        start = page.find("<", at)
        if start < 0:
            break
        if page.startswith(("<!--", "<![CDATA["), start):
            close = "-->" if page[start + 2] == "-" else "]]>"
            end = page.find(close, start + 3)
            at = len(page) if end < 0 else end + 3
            yield page[shown:start], "", ""
            shown = at
            continue
        m = _TAG.match(page, start)
        if m:
            end, close, tag, attrs = m.end(), m[1], m[2].lower(), m[3]
        elif start > last:
            at = start + 1
            continue
        elif m := _NAME.match(page, start):
            end = tag_end(page, m.end()) + 1
            close, tag, attrs = m[1], m[2].lower(), page[m.end() : end - 1]
        elif page.startswith(("<!", "<?", "</"), start):
            end, close, tag, attrs = page.find(">", start) + 1, "", "", ""
        else:
            at = start + 1
            continue
        yield page[shown:start], close + tag, attrs
        at = shown = end
        if not close and tag in RAW and tag not in missing:
            found = _ENDS[tag].search(page, end)
            if found:
                at = shown = found.end()
            elif tag in ("script", "style"):
                at = shown = len(page)
            else:
                missing.add(tag)
                at = shown = max(end, page.find("<", end))
    if shown < len(page):
        yield page[shown:], "", ""


#: Elements whose start ends an open one of the same kind, and those that share their parent's number.
REPEATED, SHARED = frozenset(("li", "dt", "dd", "tr", "td", "th", "option")), frozenset(("li", "td", "th", "tr", "dd", "dt"))


def blocks_of(page: str, weights: Weights = STATED) -> list[Block]:
    """The text blocks in page order."""
    out: list[Block] = []
    stack: list[tuple[str, int, float, float, frozenset[str]]] = [("", 0, 0.0, 0.0, frozenset())]  # tag, number, evidence by tag, in all, words
    texts: list[str] = []
    number = link_chars = 0
    in_link = heading = False
    known: dict[tuple[str, str], tuple[float, frozenset[str]]] = {}
    nothing: frozenset[str] = frozenset()

    def flush() -> None:
        nonlocal link_chars
        if texts:
            text = " ".join(html_lib.unescape("".join(texts)).split())
            if text:
                _, n, by_tag, evidence, words = stack[-1]
                out.append(Block(text, min(link_chars, len(text)), n, by_tag, evidence, heading, words))
            texts.clear()
            link_chars = 0

    for part, name, attrs in tokens(page):
        if part:
            texts.append(part)
            if in_link:
                link_chars += len(part)
        tag = name.lstrip("/")
        ends = tag != name
        if tag == "a":
            in_link = not ends
        elif tag == "br":
            texts.append("\n")
        elif tag in BLOCKS:
            flush()
            in_link = False
            heading = not ends and len(tag) == 2 and tag[0] == "h" and tag != "hr"
            if tag not in CONTROLS and not ends:
                while stack[-1][0] in CONTROLS:
                    stack.pop()
            if tag in CONTAINERS and ends:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == tag:
                        del stack[k:]
                        break
            elif tag in CONTAINERS:
                if tag == "body":
                    del stack[1:]  # whatever the head left open
                elif tag in REPEATED and stack[-1][0] == tag:
                    stack.pop()
                number += 1
                own, words = 0.0, nothing
                if attrs and tag not in ("html", "body"):
                    if (tag, attrs) not in known:
                        known[tag, attrs] = name_evidence(tag, attrs, weights)
                    own, words = known[tag, attrs]
                by_tag = GOOD_TAGS.get(tag, 0.0) - BAD_TAGS.get(tag, 0.0)
                top = stack[-1]
                stack.append((tag, top[1] if tag in SHARED else number, below(top[2], by_tag), below(top[3], by_tag + own), top[4] | words if words else top[4]))
    flush()
    return out


def costs(block: Block, weights: Weights = STATED) -> tuple[int, int]:
    """(cost of boilerplate, cost of content), whole numbers: the classifier's log probabilities."""
    z = block.evidence + sum(w * x for w, x in zip(weights.text, block.features(), strict=True))
    z = max(-8.0, min(8.0, z))
    return round(SCALE * math.log1p(math.exp(z))), round(SCALE * math.log1p(math.exp(-z)))


def max_flow_sides(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """True for the nodes on the source's side of a minimum cut; edges (a, b, capacity) hold both ways.

    Dinic's algorithm: a phase numbers the nodes by their distance from those with capacity left from the source, then
    sends flow along all paths that go one number up, never looking at a used-up edge twice.  Phases are as many as there are path
    lengths, and paths are short, as a block's own terminals take most of its flow.
    """
    n = len(source)
    direct = [min(s, t) for s, t in zip(source, sink, strict=True)]
    s, t = [a - d for a, d in zip(source, direct, strict=True)], [a - d for a, d in zip(sink, direct, strict=True)]
    # Half edges by pairs: half edge k and its other half k ^ 1.
    to, room = [0] * (2 * len(edges)), [0] * (2 * len(edges))
    near: list[list[int]] = [[] for _ in range(n)]
    for k, (a, b, c) in enumerate(edges):
        to[2 * k], to[2 * k + 1] = b, a
        room[2 * k] = room[2 * k + 1] = c
        near[a].append(2 * k)
        near[b].append(2 * k + 1)
    while True:
        level = [-1] * n
        todo = [i for i in range(n) if s[i] > 0]
        for i in todo:
            level[i] = 0
        open_ = False
        for i in todo:  # grows while it is read
            open_ |= t[i] > 0
            for k in near[i]:
                j = to[k]
                if room[k] > 0 and level[j] < 0:
                    level[j] = level[i] + 1
                    todo.append(j)
        if not open_:
            return [x >= 0 for x in level]
        at = [0] * n
        for first in range(n):
            path, i = [], first
            while s[first] > 0 and level[first] == 0:
                if t[i] > 0:
                    flow = min(s[first], t[i], *(room[k] for k in path)) if path else min(s[first], t[i])
                    s[first] -= flow
                    t[i] -= flow
                    for k in path:
                        room[k] -= flow
                        room[k ^ 1] += flow
                    # Back to before the first edge that is used up.
                    full = next((x for x, k in enumerate(path) if room[k] == 0), len(path))
                    if full < len(path):
                        i = to[path[full] ^ 1]
                        del path[full:]
                    continue
                while at[i] < len(near[i]):
                    k = near[i][at[i]]
                    if room[k] > 0 and level[to[k]] == level[i] + 1:
                        break
                    at[i] += 1
                if at[i] < len(near[i]):
                    path.append(near[i][at[i]])
                    i = to[path[-1]]
                elif path:
                    i = to[path.pop() ^ 1]
                    at[i] += 1
                else:
                    break


def label(blocks: list[Block], cache: dict | None = None, weights: Weights = STATED) -> list[bool]:
    """True for content."""
    pairs = [costs(b, weights) for b in blocks]
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, round(SCALE * ADJACENT)))
        if b.container in last:
            edges.append((last[b.container], i, round(SCALE * SAME_PARENT)))
        last[b.container] = i
    key = (tuple(pairs), tuple(edges))
    if cache is None or key not in cache:
        sides = max_flow_sides([a for a, _ in pairs], [b for _, b in pairs], edges)
        if cache is None or len(blocks) > 1000:
            return sides
        if len(cache) >= 20_000:
            cache.clear()
        cache[key] = sides
    return cache[key]


def learn(rows: list[tuple[bool, tuple[float, ...], list[str]]], strength: float = 25.0, most: float = 200.0, rounds: int = 12) -> Weights:
    """Weights from (content, text features, words of names): Newton steps for the logistic loss with a normal prior around the stated weights,
    and smoothed odds of the words, where listed words begin with the counts that give their stated weight.

    Blocks in articles and menus differ more than blocks elsewhere do, so all blocks together count as ``most`` against the prior."""
    if not rows:
        return STATED
    rows = sorted(rows)
    y, x = np.array([r[0] for r in rows], dtype=float), np.array([r[1] for r in rows])
    start = w = np.array(STATED.text)
    one = min(1.0, most / len(rows))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = one * x.T @ (p - y) + strength * (w - start)
        w = w - np.linalg.solve(one * (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w)), gradient)
    count: Counter = Counter((word, r[0]) for r in rows for word in r[2])
    words = {}
    for word in sorted({word for word, _ in count}):
        prior = prior_of(word)
        good, bad = 8 * math.exp(max(prior, 0.0)) + count[word, True], 8 * math.exp(max(-prior, 0.0)) + count[word, False]
        words[word] = max(-5.0, min(3.0, math.log(good / bad)))
    return Weights(tuple(float(v) for v in w), words)


def fit(pages: DataFrame) -> Weights:
    """Weights learnt from a bounded sample of ``pages``: those with the smallest hashes of their ids, and of their blocks those with the smallest hashes."""
    few = pages.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(FIT_PAGES).select(F.col("page_id").alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [b for page in batch.column(0) for b in blocks_of(page.as_py() or "") if b.by_tag >= 2 or b.by_tag <= -4]
            cols = [pa.array([b.by_tag > 0 for b in rows], pa.bool_()), pa.array([b.features() for b in rows], pa.list_(pa.float64())), pa.array([sorted(b.words) for b in rows], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, names=["content", "x", "words"])

    blocks = pages.join(F.broadcast(few), F.col("page_id").eqNullSafe(F.col("p")), "left_semi").select(valid_text("html")).mapInArrow(run, "content boolean, x array<double>, words array<string>")
    rows = blocks.orderBy(F.xxhash64("x", "words"), "content").limit(FIT_BLOCKS).collect()
    return learn([(r.content, tuple(r.x), list(r.words)) for r in rows])


def extract(page: str | None, cache: dict | None = None, weights: Weights = STATED) -> str:
    """Content blocks joined by two line feeds."""
    if not page:
        return ""
    blocks = blocks_of(page, weights)
    return "\n\n".join(b.text for b, content in zip(blocks, label(blocks, cache, weights), strict=True) if content)


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """(page_id, url, text) for every page, by ``weights`` or those learnt from the pages."""
    weights = weights or fit(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict = {}
        for batch in batches:
            texts = [extract(x.as_py(), cache, weights) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), valid_text("url"), valid_text("html")).mapInArrow(run, "page_id long, url string, text string")
