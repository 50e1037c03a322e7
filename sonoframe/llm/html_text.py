"""Main text of web pages: a linear-chain conditional random field over the pages' text blocks."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonoframe.llm.common import text_slices, with_fields

#: A tag whose parts are short, as nearly all are; what may begin a comment, a declaration or a tag.
_SHORT = re.compile(r"""<(/?)([a-zA-Z][^\s/>]{0,64}+)(?=[\s/>])((?:[^>"']{1,64}+|"[^"]{0,128}+"|'[^']{0,128}+'){0,8}+)>""")
_OPENING = re.compile(r"<(?:!--|!\[CDATA\[|[!?]|/?[a-zA-Z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_ZEROS = re.compile(r"&#0+(?=[0-9])")
_BEYOND = re.compile(r"&#[0-9]{8,};?")
_HINTS = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")

#: HTML elements without content, with raw content, that may stand in a head, within a paragraph but apart
#: from its text, inside a line (formulas too), and that end an open paragraph or item.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
HEAD = frozenset("html head title base basefont bgsound link meta noframes noscript script style template".split())
EMBEDDED = frozenset("noscript template iframe svg object canvas".split())
INLINE = frozenset(
    (
        "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img "
        "math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover "
        "mmultiscripts mprescripts mtable mtr mlabeledtr mtd maction semantics annotation annotation-xml"
    ).split()
)
SPACED = frozenset("br mtd annotation annotation-xml".split())
#: Where a title ends, or what shows that it isn't closed.
_TITLE_END = re.compile(r"</title\b|<(?:title|/?head|body)\b", re.I)
#: Elements that say by themselves what they hold, and those that stand beside the main text.
NEAR = frozenset("article main header footer nav aside section form body".split())
ASIDE = frozenset("nav aside form footer".split())
SIBLING = {"li": "li", "dt": "dt", "dd": "dd", "tr": "tr", "td": "td", "th": "th", "option": "option"}


@lru_cache(4096)
def described(tag: str, attributes: str) -> tuple[tuple[str, ...], tuple[str, ...], tuple[str, ...]]:
    """Words of an element's class, id and role, its features, and those that it has as the nearest of its kind."""
    words = tuple(w.lower() for x in _HINTS.findall(attributes) for w in _WORD.findall(x)) if attributes else ()
    own = [] if tag in ("html", "body") else ["tag:" + tag]
    near = ["near:" + tag, *("near:" + w for w in words)] if tag in NEAR or words else []
    return words, tuple(dict.fromkeys(own + ["word:" + w for w in words])), tuple(dict.fromkeys(near))


class Place:
    """An open block-level element: what it adds to the features of its ancestors, shared by all that stands in it.

    ``new`` are the tags and words that no ancestor has, ``size`` counts them up
    to the root, ``near`` and ``own`` are features of the innermost elements.
    """

    __slots__ = ("article", "aside", "near", "new", "parent", "size", "tag", "words")

    def __init__(self, parent: Place | None, tag: str, words: tuple[str, ...], new: tuple[str, ...], near: tuple[str, ...]):
        self.tag, self.words, self.parent, self.new = tag, words, parent, new
        self.size = len(new) + (parent.size if parent else 0)
        self.near = near or (parent.near if parent else ())
        self.article = tag == "article" or bool(parent and parent.article)
        self.aside = tag in ASIDE or "comments" in words or "comment" in words or bool(parent and parent.aside)

    @property
    def own(self) -> tuple[str, ...]:
        return ("own:" + self.tag,) if self.tag else ()


class Block:
    """Text between two block-level tags, and where it stands."""

    __slots__ = ("linked", "place", "text")

    def __init__(self, text: str, linked: int, place: Place):
        self.text, self.linked, self.place = text, linked, place

    @property
    def path(self) -> tuple[tuple[str, tuple[str, ...]], ...]:
        """Tag and words of every ancestor, outermost first."""
        out, at = [], self.place
        while at.parent:
            out.append((at.tag, at.words))
            at = at.parent
        return tuple(reversed(out))


class Tags:
    """Comments, declarations and tags of a page, in time linear in its length.

    A tag ends at the first ``>`` outside quotes, or where a quote stays open at
    the first ``>``; without any, its ``<`` is text. Scans that end at an open
    quote remember the quotes that they went through, so none is tried twice.
    """

    def __init__(self, html: str):
        self.html, self.last, self.dead = html, html.rfind(">"), None

    def next(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """Start, end, whether it closes, name and attributes of the next tag; comments and declarations have no name."""
        html = self.html
        at = html.find("<", at)
        if at < 0:
            return None
        if m := _SHORT.match(html, at):
            return at, m.end(), m[1] == "/", m[2].lower(), m[3]
        while m := _OPENING.search(html, at):
            start, kind = m.start(), m[0]
            if kind[1] in "!?":
                mark = {"<!--": "-->", "<![CDATA[": "]]>"}.get(kind, ">")
                end = html.find(mark, m.end())
                return start, len(html) if end < 0 else end + len(mark), False, "", ""
            if start < self.last:
                closing = kind[1] == "/"
                name = _NAME.match(html, m.end() - 1)
                end = self.end_of_tag(name.end())
                return start, end + 1, closing, name[0].lower(), html[name.end() : end]
            at = m.end()
        return None

    def end_of_tag(self, begin: int) -> int:
        html, at, through = self.html, begin, []
        while m := _STOP.search(html, at):
            at = m.start()
            if m[0] == ">":
                return at
            if self.dead and self.dead[at]:
                break
            through.append(at)
            at = html.find(m[0], at + 1) + 1
            if not at:
                break
        self.dead = self.dead or bytearray(len(html))
        for quote in through:
            self.dead[quote] = 1
        return html.find(">", begin)


def decoded(text: str) -> str:
    """Character references decoded, numbers of any length included."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _BEYOND.sub("\N{REPLACEMENT CHARACTER}", _ZEROS.sub("&#", text))
    return unescape(text)


def blocks(html: str) -> list[Block]:
    """The leaf blocks of a page in order, white space squeezed, references decoded, empty ones left out.

    ``place`` tells the ancestors' tags and words of class, id and role. Tags
    that aren't closed close with their parents; a head or title ends where text
    or a tag begins that can't stand in it. Only scripts, styles and the page's
    title are left out. Time and memory are linear in the page's length.
    """
    out: list[Block] = []
    stack: list[tuple[str, Place, int]] = []  # tag, block-level element around what follows and its place on the stack
    parts: list[str] = []
    linked, links, foreign, at = 0, 0, 0, 0
    head = title = -1  # their places on the stack
    root = Place(None, "", (), ("bias",), ())
    opened: Counter[str] = Counter()
    known: set[str] = set()  # features of the open elements
    tags = Tags(html)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, min(linked, len(text)), stack[-1][1] if stack else root))
            parts.clear()
        linked = 0

    def pop(to: int) -> None:
        nonlocal head, title, links, foreign
        for tag, place, _ in stack[to:]:
            opened[tag] -= 1
            links -= tag == "a"
            foreign -= tag in ("svg", "math")
            if tag not in INLINE:
                known.difference_update(place.new)
        head, title = head if head < to else -1, title if title < to else -1
        del stack[to:]

    def leave_head() -> None:
        if head >= 0 or title >= 0:
            pop(min(x for x in (head, title) if x >= 0))

    end = len(html)
    while at < end:
        found = tags.next(at)
        stop = found[0] if found else end
        if stop > at and title < 0:
            if head >= 0 and not html[at:stop].isspace():
                leave_head()
            parts.append(decoded(html[at:stop]))
            linked += (stop - at) if links else 0
        if not found:
            break
        _, at, closing, tag, attributes = found
        if not tag:
            continue
        if not closing and tag in RAW and not attributes.endswith("/"):
            close = re.compile(f"</{tag}\\b", re.I).search(html, at)
            at = html.find(">", close.end()) + 1 if close else 0
            if not at:
                break
            continue
        if tag == "head" if closing else tag not in HEAD:
            leave_head()
        if tag in INLINE:
            if tag in SPACED:
                parts.append(" ")
        else:
            flush()
        if not closing and tag == "title" and not foreign:
            close = _TITLE_END.search(html, at)
            if close and close[0][:3].lower() == "</t":
                at = close.start()
                continue
        if closing:
            if opened[tag]:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag))
        elif tag not in VOID and not (attributes.endswith("/") and (foreign or tag in ("svg", "math"))):
            if tag not in INLINE and tag not in EMBEDDED and stack:  # ends an open paragraph, an item of its own kind, and lines in them
                around = stack[-1][2]
                if around >= 0 and stack[around][0] in ("p", SIBLING.get(tag)):
                    pop(around)
            if tag == "head" and head < 0:
                head = len(stack)
            elif tag == "title" and title < 0 and not foreign:
                title = len(stack)
            if tag in INLINE:
                stack.append((tag, *(stack[-1][1:] if stack else (root, -1))))
            else:
                words, own, near = (described if len(attributes) <= 200 else described.__wrapped__)(tag, attributes)
                new = tuple(x for x in own if x not in known)
                known.update(new)
                stack.append((tag, Place(stack[-1][1] if stack else root, tag, words, new, near), len(stack)))
            opened[tag] += 1
            links += tag == "a"
            foreign += tag in ("svg", "math")
    flush()
    return out


def path_features(place: Place) -> list[str]:
    """Features of where a block stands: ancestor tags, words of their classes and ids, and the innermost of both."""
    out = [*place.near, *place.own]
    while place:
        out += place.new
        place = place.parent
    return sorted(set(out))


def text_features(block: Block, place: int, last: int) -> list[str]:
    text = block.text
    words = text.count(" ") + 1
    share = block.linked / len(text)
    return [
        f"words:{min(words.bit_length(), 7)}",
        "linked:" + ("none" if not block.linked else "some" if share < 0.5 else "most"),
        "ends:" + ("stop" if text[-1] in ".!?…:;\"'”»)" else "open"),
        "sign:" + ("yes" if "©" in text or "@" in text or "|" in text else "no"),
        "place:" + ("first" if not place else "last" if place == last else "inner"),
    ]


#: Words of classes and ids, and tags, that layouts use for main text and for what surrounds it.
MAIN_BOXES = "article main div.content div#content div.post-body div.entry-content section.story div.article-body div#main-text td.body div.text".split()
SIDE_BOXES = (
    "nav div.menu ul.navigation div#nav header div.header div.masthead footer div.footer div#footer aside div.sidebar div#sidebar div.widget "
    "div.ad div.advert div.ads div.banner div.sponsored div.promo div.cookie-notice div.notice div.alert div.consent div.popup form form.search form.newsletter "
    "div.subscribe div.login section.comments div#comments ol.comment-list div.comment div.reader-comments div.replies div.responses div.related div.recommended "
    "div.share div.social div.breadcrumbs div.toolbar div.copyright div.pagination"
).split()


def _opened(box: str) -> tuple[str, str]:
    tag, sign, name = re.match(r"(\w+)([.#]?)(.*)", box).groups()
    return f'<{tag}{" class=" if sign == "." else " id="}"{name}">' if sign else f"<{tag}>", f"</{tag}>"


def layouts(texts: list[str], n: int, seed: int) -> Iterator[tuple[list[Block], list[int]]]:
    """Labelled pages with given texts in many kinds of layout."""
    rng = np.random.default_rng(seed)
    long = [t for t in texts if t.count(" ") >= 5] or ["Some words that make a whole sentence."]
    word = lambda: long[rng.integers(len(long))].split()
    for _ in range(n):
        html, truth = ["<html><body>"], []

        def put(tag: str, text: str, label: int, link: bool = False) -> None:
            text = text.replace("&", "&amp;").replace("<", "&lt;")
            html.append(f'<{tag}>{"<a href=#>" + text + "</a>" if link else text}</{tag}>')  # noqa: B023
            truth.append(label)  # noqa: B023

        def side(box: str) -> None:
            before, after = _opened(box)
            html.append(before)  # noqa: B023
            for _ in range(rng.integers(1, 4)):
                some = word()
                kind = rng.integers(4)
                if kind == 0:
                    put("li", some[0], 0, True)
                elif kind == 1:
                    put("p", " ".join(some), 0)
                elif kind == 2:
                    put("div", " ".join(some[: rng.integers(1, 6)]), 0, rng.random() < 0.5)
                else:
                    put("h3", " ".join(some[:3]), 0)
            html.append(after)  # noqa: B023

        sides = [SIDE_BOXES[i] for i in rng.integers(len(SIDE_BOXES), size=rng.integers(2, 7))]
        split = rng.integers(len(sides) + 1)
        for box in sides[:split]:
            side(box)
        boxes = [_opened(MAIN_BOXES[i]) for i in rng.choice(len(MAIN_BOXES), rng.integers(1, 3), replace=False)]
        html += [b for b, _ in boxes]
        inner = rng.random() < 0.3
        if inner:
            html.append("<header>")
        put("h1", " ".join(word()[:9]), 1)
        if inner:
            html.append("</header>")
        for _ in range(rng.integers(1, 9)):
            kind = rng.integers(8)
            some = word()
            if kind == 0:
                put("h2", " ".join(some[:5]), 1)
            elif kind == 1:
                put("li", " ".join(some[: rng.integers(1, 12)]), 1)
            elif kind == 2:
                put("blockquote", " ".join(some), 1)
            elif kind == 3 and rng.random() < 0.5:
                side(SIDE_BOXES[rng.integers(len(SIDE_BOXES))])
            else:
                put("p", " ".join(some[: rng.integers(1, 4)] if rng.random() < 0.15 else some), 1)
        html += [a for _, a in reversed(boxes)]
        for box in sides[split:]:
            side(box)
        found = blocks("".join(html))
        if len(found) == len(truth):
            yield found, truth


def labelled(found: list[Block]) -> list[int] | None:
    """Labels of a page that marks its article itself, or None."""
    if not any(b.place.article for b in found):
        return None
    return [int(b.place.article and not b.place.aside) for b in found]


class Field:
    """Conditional random field with two labels: 1 for main text.

    ``weights`` gives each feature's scores for both labels, ``move`` the scores
    of neighbouring labels, ``begin`` those of the first.
    """

    def __init__(self, weights: dict[str, tuple[float, float]], move: list[list[float]], begin: list[float]):
        self.weights, self.move, self.begin = weights, move, begin

    def score(self, features: Iterable[str]) -> tuple[float, float]:
        found = [self.weights[x] for x in features if x in self.weights]
        return sum(x for x, _ in found), sum(x for _, x in found)

    def scores(self, found: list[Block]) -> Iterator[tuple[float, float]]:
        """Each block's scores, those of its ancestors summed once for each element."""
        sums: dict[Place, tuple[float, float]] = {}
        whole: dict[Place, tuple[float, float]] = {}
        for i, block in enumerate(found):
            place = block.place
            if place not in whole:
                above = []
                at = place
                while at and at not in sums:
                    above.append(at)
                    at = at.parent
                s0, s1 = sums[at] if at else (0.0, 0.0)
                for at in reversed(above):
                    e0, e1 = self.score(at.new)
                    s0, s1 = sums[at] = s0 + e0, s1 + e1
                e0, e1 = self.score(place.near + place.own)
                whole[place] = s0 + e0, s1 + e1
            e0, e1 = whole[place]
            f0, f1 = self.score(text_features(block, i, len(found) - 1))
            yield e0 + f0, e1 + f1

    def decode(self, found: list[Block]) -> list[int]:
        """The most likely labels of a page's blocks (Viterbi)."""
        if not found:
            return []
        (m00, m01), (m10, m11) = self.move
        back = []
        s0, s1 = self.begin
        for place, (e0, e1) in enumerate(self.scores(found)):
            if place:
                b0, b1 = s1 + m10 > s0 + m00, s1 + m11 > s0 + m01
                back.append((b0, b1))
                s0, s1 = max(s0 + m00, s1 + m10), max(s0 + m01, s1 + m11)
            s0, s1 = s0 + e0, s1 + e1
        label = int(s1 > s0)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]


def likelihood(theta: np.ndarray, used: np.ndarray, owner: np.ndarray, page: np.ndarray, row: np.ndarray, labels: np.ndarray, length: np.ndarray) -> tuple[float, np.ndarray]:
    """The pages' negative log-likelihood, and its gradient by the forward and backward recursions.

    ``theta`` holds two weights a feature, four moves and two beginnings. Block
    ``i`` is row ``row[i]`` of page ``page[i]``; it has the features ``used``
    where ``owner`` is ``i``.
    """
    n, wide = len(theta) - 6, length.max()
    w = theta[:n].reshape(-1, 2)
    scores = np.zeros((len(page), 2))
    np.add.at(scores, owner, w[used])
    emit = np.zeros((len(length), wide, 2))
    emit[page, row] = scores
    gold = np.zeros((len(length), wide), np.int64)
    gold[page, row] = labels
    there = np.arange(wide) < length[:, None]
    move, begin = theta[n : n + 4].reshape(2, 2), theta[n + 4 :]
    forward, backward = np.zeros_like(emit), np.zeros_like(emit)
    forward[:, 0] = emit[:, 0] + begin
    for t in range(1, wide):
        reach = np.logaddexp(forward[:, t - 1, :1] + move[0], forward[:, t - 1, 1:] + move[1])
        forward[:, t] = np.where(there[:, t, None], reach + emit[:, t], forward[:, t - 1])
    for t in range(wide - 2, -1, -1):
        onward = backward[:, t + 1] + emit[:, t + 1]
        reach = np.logaddexp(onward[:, :1] + move[:, 0], onward[:, 1:] + move[:, 1])
        backward[:, t] = np.where(there[:, t + 1, None], reach, 0)
    whole = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
    alone = np.exp(forward + backward - whole[:, None, None])
    grad = np.zeros_like(theta)
    error = alone[page, row] - np.eye(2)[labels]
    np.add.at(grad[:n].reshape(-1, 2), used, error[owner])
    steps = there[:, 1:]
    for a in (0, 1):
        for b in (0, 1):
            pair = np.exp(forward[:, :-1, a] + move[a, b] + emit[:, 1:, b] + backward[:, 1:, b] - whole[:, None])
            true = (gold[:, :-1] == a) & (gold[:, 1:] == b)
            grad[n + 2 * a + b] = ((pair - true) * steps).sum()
    grad[n + 4 :] = alone[:, 0].sum(axis=0) - np.bincount(gold[:, 0], minlength=2)
    chosen = scores[np.arange(len(page)), labels].sum() + begin[gold[:, 0]].sum() + (move[gold[:, :-1], gold[:, 1:]] * steps).sum()
    return whole.sum() - chosen, grad


def fit(pages: list[tuple[list[Block], list[int]]], epochs: int = 12, batch: int = 64, rate: float = 0.05, decay: float = 1e-4, drop: float = 0.3, most: int = 50_000, seed: int = 3) -> Field:
    """Train by stochastic gradient (Adam) on the conditional likelihood.

    ``drop`` is the share of a page's ancestor tags and words that a step leaves
    out, so that no single one is relied on; ``most`` bounds the number of features.
    """
    rng = np.random.default_rng(seed)
    counts: Counter[str] = Counter()
    data = []
    for found, labels in pages:
        if found:
            features = [path_features(b.place) + text_features(b, i, len(found) - 1) for i, b in enumerate(found)]
            counts.update(x for f in features for x in f)
            data.append((features, np.array(labels)))
    index = {x: i for i, (x, _) in enumerate(counts.most_common(most))}
    data = [([np.array([index[x] for x in f if x in index]) for f in features], labels) for features, labels in data]
    droppable = np.array([x.startswith(("tag:", "word:", "near:")) for x in index])
    theta = np.zeros(2 * len(index) + 6)
    first, second, step = np.zeros_like(theta), np.zeros_like(theta), 0
    n = 2 * len(index)
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), batch):
            some = [data[i] for i in order[at : at + batch]]
            length = np.array([len(y) for _, y in some])
            flat = [f for features, _ in some for f in features]
            page = np.repeat(np.arange(len(some)), length)
            row = np.concatenate([np.arange(x) for x in length])
            used = np.concatenate(flat)
            owner = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
            lost = rng.random((len(some), len(index))) < drop  # the same features for all blocks of a page
            keep = ~(droppable[used] & lost[page[owner], used])
            used, owner = used[keep], owner[keep]
            _, grad = likelihood(theta, used, owner, page, row, np.concatenate([y for _, y in some]), length)
            grad = grad / len(some) + decay * theta
            step += 1
            first = 0.9 * first + 0.1 * grad
            second = 0.999 * second + 0.001 * grad * grad
            theta -= rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    w = theta[:n].reshape(-1, 2).tolist()
    return Field({x: tuple(w[i]) for x, i in index.items()}, theta[n : n + 4].reshape(2, 2).tolist(), theta[n + 4 :].tolist())


def training_pages(pages: DataFrame, sample: int = 600, html: str = "html", longest: int = 200_000, features: int = 100_000) -> list[tuple[list[Block], list[int]]]:
    """Labelled pages: up to ``sample`` different pages that mark their article, and twice as many layouts with their texts.

    Pages of more than ``longest`` characters, or whose blocks stand in more
    than ``features`` tags and words of ancestors in all, don't train, which
    bounds what goes to the driver; they are labelled like all others.
    """
    rows = pages.where(F.col(html).isNotNull() & (F.length(html) <= longest)).select(html, F.xxhash64(html).alias("h"))
    least = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]  # hashes travel, pages don't
    rows = rows.where(F.col("h") <= (0 if least is None else least)).dropDuplicates(["h"]).collect()
    rows.sort(key=lambda r: r.h)
    own = [(found, labels) for r in rows if (labels := labelled(found := blocks(r[0]))) and sum(b.place.size for b in found) <= features]
    texts = [b.text for found, _ in own for b in found][:20_000]
    return own + list(layouts(texts, 2 * sample, 11))


def main_text(pages: DataFrame, field: Field | None = None, sample: int = 600, html: str = "html", longest: int = 200_000) -> DataFrame:
    """All columns of ``pages`` with ``text``, the main text, and ``n_chars``, its code points.

    The model (unless given) is fitted on a sample of at most ``sample`` pages
    of at most ``longest`` characters and on labelled layouts, see :func:`training_pages`; it labels the blocks of
    every page, and those of the main text are joined by blank lines.

    Null and empty pages, and pages without main text, have an empty text.
    Columns called ``text`` or ``n_chars`` are replaced, others stay, repeated
    rows too. An empty table gives an empty table.
    """
    if field is None:
        field = fit(training_pages(pages, sample, html, longest))
    sent = pages.sparkSession.sparkContext.broadcast((field.weights, field.move, field.begin))
    pages = pages.drop("text", "n_chars")
    fields = with_fields(pages, "text string, n_chars bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*sent.value)
        for batch in batches:
            for i, j in text_slices(batch.column(html)):
                part = batch.slice(i, j - i)
                texts = []
                for page in part.column(html):
                    found = blocks(page.as_py() or "")
                    texts.append("\n\n".join(b.text for b, main in zip(found, model.decode(found), strict=True) if main))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], fields.names)

    return pages.mapInArrow(run, fields)


def query(spark, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "url", "text", "n_chars")
