"""Main text of web pages by a linear-chain conditional random field (operator 5).

A page is cut into leaf blocks: runs of text between block-level tags, by a
scanner that goes over the page once.  Each block has features of its
ancestors' tags, of words in their class, id and role, and of its text.  A
two-label chain (text, other) is fitted on the driver by conditional likelihood
and decoded with Viterbi on the workers.

The labelled pages are written by `labelled_page`: random sites with menus,
headers, footers, sidebars, notices, adverts, forms and reader comments around
and inside articles of random words, so that every block's label is known.
Sites name their boxes by words that the features know, by words they don't
know, or not at all.  The training set is TRAIN_PAGES such pages, whatever the
corpus holds.

Defined results: a null or empty page, and one without text blocks, gives the
empty string; comments, scripts, styles, elements whose content is no text of
the page (DROPPED), and elements marked hidden or display:none never hold text;
a self-closed one of these is empty, and one that is never closed hides
nothing; unclosed tags end with their parent; a quoted value that is never
closed ends with its tag; repeated rows give equal texts; a null page_id or url
is kept.
"""

from __future__ import annotations

import html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TRAIN_PAGES, EPOCHS, L2 = 700, 250, 0.0001

#: Fixed values of HTML: tags that don't break a line of text, and tags without content.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that close an open tag of the named kinds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements whose content is no text of the page, and HTML tags that can't stand in a drawing or formula.
DROPPED = frozenset("script style title noscript template textarea svg math iframe object canvas audio video select button datalist".split())
BREAKOUT = re.compile(r"<(?:article|blockquote|body|br|center|dd|div|dl|dt|footer|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|ul)[\s/>]", re.I)
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
HIDDEN = re.compile(r"(?:^|[\s\"'])hidden(?=[\s/=]|$)|style\s*=\s*(?:\"[^\"]*|'[^']*|\S*)(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
DIGIT = re.compile(r"\d")
MARK = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

#: Words of class, id and role by what they tell.
KINDS = {
    "menu": "nav menu navigation navbar breadcrumb breadcrumbs tabs toolbar pagination pager skip",
    "top": "header masthead banner topbar logo brand search",
    "foot": "footer bottom copyright legal colophon contentinfo",
    "side": "sidebar aside rail widget related recommended trending popular complementary more recent tags",
    "ad": "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion promoted banner dfp",
    "notice": "notice cookie cookies consent gdpr alert popup modal dialog overlay message warning paywall",
    "form": "form newsletter subscribe signup login register contact field input subscription",
    "talk": "comment comments reply replies discussion disqus respond reader responses",
    "share": "share social sharing facebook twitter follow tools print",
    "main": "article content main post entry story body text page single",
    "by": "byline author meta date dateline published credit caption",
}
KIND_OF: dict[str, list[str]] = {}
for _k, _ws in KINDS.items():
    for _w in _ws.split():
        KIND_OF.setdefault(_w, []).append(_k)
TAGS = "article main section div nav header footer aside form ul ol li p h1 h2 h3 h4 h5 h6 blockquote pre table td th dl dd dt figure figcaption details address fieldset button select body".split()
FEATURES = {
    name: i
    for i, name in enumerate(
        ["bias", "first", "short", "medium", "long", "stop", "comma", "links0", "links1", "links2", "rights", "digits", *[f"in:{t}" for t in TAGS], *[f"leaf:{t}" for t in TAGS], *[f"is:{k}" for k in KINDS], *[f"near:{k}" for k in KINDS], "deep"]
    )
}


#: Words of a short block that tell what it is for.
CUES = {
    "talk": "comment comments reply replies said says wrote commented reader readers",
    "form": "subscribe newsletter email login register password submit",
    "notice": "cookies cookie privacy consent accept",
    "ad": "advertisement sponsored promoted advert",
    "foot": "copyright rights reserved terms imprint",
    "side": "related popular trending recommended",
    "share": "share tweet follow print",
}
CUE_OF = {w: k for k, ws in CUES.items() for w in ws.split()}
FEATURES |= {f"cue:{k}": len(FEATURES) + i for i, k in enumerate(CUES)}


def kinds(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = {k for m in MARK.finditer(attributes) for w in PIECE.findall(m[1] or m[2] or m[3] or "") for k in KIND_OF.get(w.lower(), ())}
    return tuple(sorted(found))


class Page:
    """Goes over a page's tags from left to right; every look ahead is remembered, so the work grows with the page's length."""

    def __init__(self, html_text: str):
        self.html, self.plain = html_text, False
        self.ahead: dict[str, tuple[re.Pattern, int]] = {}

    def next(self, what: str, at: int) -> int:
        """Where the opening or closing tag `what` ('<svg', '</svg') next begins; the page's length if nowhere."""
        pattern, place = self.ahead.get(what) or (re.compile(re.escape(what) + r"(?=[\s/>])", re.I), -1)
        if place < at:
            m = pattern.search(self.html, at)
            place = m.start() if m else len(self.html)
            self.ahead[what] = (pattern, place)
        return place

    def find(self, mark: str, at: int) -> int:
        """The same for a fixed string."""
        place = self.ahead.get(mark, (None, -1))[1]
        if place < at:
            place = self.html.find(mark, at)
            place = len(self.html) if place < 0 else place
            self.ahead[mark] = (None, place)
        return place

    def end_of_tag(self, at: int) -> int:
        """The place of the > that ends the tag whose attributes begin at `at`; quoted values may hold one."""
        size = len(self.html)
        start = at
        while not self.plain:
            stop = self.find(">", at)
            if stop == size:
                break
            mark = min(self.find('"', at), self.find("'", at))
            if mark > stop:
                return stop
            before = self.html[max(start, mark - 8) : mark].rstrip()
            if not before.endswith("="):  # a stray quote
                at = mark + 1
                continue
            shut = self.find(self.html[mark], mark + 1)
            if shut == size:  # never closed: from here on quotes mean nothing
                self.plain = True
                break
            at = shut + 1
        return self.find(">", start)

    def end_of_dropped(self, name: str, at: int) -> int | None:
        """Where the content of a dropped element that begins at `at` ends; None if it is never closed."""
        shut = self.next("</" + name, at)
        if shut == len(self.html):
            return None
        if name not in ("script", "style", "template", "object") and self.next("<" + name, at) < shut:
            return None  # another one begins before
        if name in ("svg", "math") and BREAKOUT.search(self.html, at, shut):
            return None
        return shut


def blocks(page: str) -> list[tuple[str, int, tuple]]:
    """(text, characters of it in links, what its ancestors tell) of each leaf block.

    The last part is (features of all ancestors, tag, its kinds, its parent's kinds, whether it is deep).
    """
    out = []
    # Open elements: (features of it and its ancestors, tag, kinds, parent's kinds, deep)
    top: tuple = (frozenset(), "", (), (), False)
    stack = [top]
    count: dict[str, int] = {}
    known: dict[tuple, frozenset] = {}
    parts: list[str] = []
    linked = links = 0  # characters in links, open links
    hidden: tuple[str, dict[str, int]] | None = None  # tag, how often each tag is open inside
    where = top

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((text, linked, where))
            parts, linked = [], 0

    def add(raw: str) -> None:
        nonlocal linked, where
        text = html.unescape(raw) if "&" in raw else raw
        if not parts:
            if not text.strip():
                return
            where = stack[-1]
        parts.append(text)
        if links:
            linked += len(text)

    def pop() -> None:
        count[stack.pop()[1]] -= 1

    def push(tag: str, own: tuple[str, ...]) -> None:
        above = stack[-1]
        key = (above[0], tag, own)
        if (all_of := known.get(key)) is None:
            all_of = known[key] = above[0] | {FEATURES[n] for n in (f"in:{tag}", *(f"is:{k}" for k in own)) if n in FEATURES}
        stack.append((all_of, tag, own, above[2], len(stack) > 8))
        count[tag] = count.get(tag, 0) + 1

    reader = Page(page)
    at, size = 0, len(page)
    text_from = 0

    def text_until(end: int) -> None:
        if end > text_from and hidden is None:
            add(page[text_from:end])

    while at < size:
        at = page.find("<", at)
        if at < 0:
            break
        if page.startswith("<!--", at):
            text_until(at)
            shut = reader.find("-->", at + 4) if not page.startswith("<!-->", at) else at + 2
            at = shut + 3 if shut < size else min(size, reader.find(">", at) + 1)
            text_from = at
            continue
        if page.startswith(("<!", "<?"), at):
            text_until(at)
            at = text_from = min(size, reader.find(">", at) + 1)
            continue
        closing = page.startswith("</", at)
        m = NAME.match(page, at + 1 + closing)
        if not m:
            if closing:  # a comment by the rules of HTML
                text_until(at)
                at = text_from = min(size, reader.find(">", at) + 1)
            else:
                at += 1
            continue
        stop = reader.end_of_tag(m.end())
        if stop >= size:  # no tag any more
            break
        text_until(at)
        tag, attributes = m[0].lower(), page[m.end() : stop]
        at = text_from = stop + 1
        if hidden is not None:
            name, inside = hidden
            if closing:
                if inside.get(tag):
                    inside[tag] -= 1
                    if tag == name and not inside[tag]:
                        hidden = None
                    continue
                if not count.get(tag):
                    continue
                hidden = None  # its parent ends
            elif tag not in INLINE and (name == "p" or name == tag == "li"):
                hidden = None  # ended by the tag that follows
            else:
                if tag in DROPPED and not attributes.endswith("/") and (shut := reader.end_of_dropped(tag, at)) is not None:
                    at = text_from = shut
                elif tag not in VOID and tag not in DROPPED and not attributes.endswith("/"):
                    inside[tag] = inside.get(tag, 0) + 1
                continue
        if tag in DROPPED:
            if not closing and not attributes.endswith("/") and (shut := reader.end_of_dropped(tag, at)) is not None:
                at = text_from = shut
            continue
        if not closing and tag not in VOID and not attributes.endswith("/") and attributes and HIDDEN.search(attributes):
            if tag not in INLINE:
                flush()
            hidden = (tag, {tag: 1})
            continue
        if tag in INLINE:
            if tag == "a":
                links = max(0, links - 1) if closing else 1
            elif tag == "br":
                add(" ")
            continue
        flush()
        if closing:
            if count.get(tag):
                while stack[-1][1] != tag:
                    pop()
                pop()
                links = 0
            continue
        if stack[-1][1] == "p":
            pop()
        for other in CLOSES.get(tag, ()):
            if stack[-1][1] == other:
                pop()
        if tag not in VOID and not attributes.endswith("/"):
            push(tag, kinds(attributes))
    text_until(size)
    flush()
    return out


def features(found: list) -> list[list[int]]:
    """Numbers of the features that hold for each block."""
    out, f = [], FEATURES
    cache: dict[tuple, list[int]] = {}
    for k, (text, linked, path) in enumerate(found):
        if (base := cache.get(path)) is None:
            above, tag, own, parents, deep = path
            names = [f"leaf:{tag}", *(f"near:{x}" for x in own + parents), *["deep"] * deep]
            base = cache[path] = sorted(above | {f[n] for n in names if n in f})
        words = text.count(" ") + 1
        share = linked / len(text)
        one = [f["bias"], f["short" if words < 6 else "medium" if words < 20 else "long"], f["links0" if share < 0.05 else "links1" if share < 0.5 else "links2"], *base]
        if k == 0:
            one.append(f["first"])
        if text[-1] in ".!?\"'”»":
            one.append(f["stop"])
        if "," in text:
            one.append(f["comma"])
        if "©" in text:
            one.append(f["rights"])
        if DIGIT.search(text):
            one.append(f["digits"])
        if words < 20:
            one += sorted({f["cue:" + CUE_OF[w]] for x in text.lower().split() if (w := x.strip(".,:;!?()")) in CUE_OF})
        out.append(one)
    return out


class Chain:
    """Emission weights of label `text` against `other`, and transition weights [from][to]."""

    def __init__(self, weights: list[float], moves: list[list[float]]):
        self.weights, self.moves = weights, moves

    def decode(self, rows: list[list[int]]) -> list[bool]:
        """Viterbi: the most probable labels."""
        if not rows:
            return []
        w, ((oo, ot), (to, tt)) = self.weights, self.moves
        score_o, score_t, back = 0.0, sum([w[i] for i in rows[0]]), []
        for row in rows[1:]:
            e = sum([w[i] for i in row])
            from_o, from_t = score_o + oo >= score_t + to, score_o + ot >= score_t + tt
            back.append((from_o, from_t))
            score_o, score_t = (score_o + oo if from_o else score_t + to), (score_o + ot if from_t else score_t + tt) + e
        label = [score_t > score_o]
        for from_o, from_t in reversed(back):
            label.append(not (from_t if label[-1] else from_o))
        return label[::-1]

    @classmethod
    def fit(cls, pages: list[tuple[list[list[int]], list[bool]]], epochs: int = EPOCHS) -> Chain:
        """Maximum conditional likelihood (forward-backward, Adam) with an L2 penalty."""
        n, most, size = len(pages), max(len(r) for r, _ in pages), len(FEATURES)
        x = np.zeros((n, most, size), np.float32)
        y, mask = np.zeros((n, most), int), np.zeros((n, most), bool)
        for k, (rows, labels) in enumerate(pages):
            for j, (row, label) in enumerate(zip(rows, labels, strict=True)):
                x[k, j, row] = 1
                y[k, j], mask[k, j] = label, True
        w, t = np.zeros(size), np.zeros((2, 2))
        pair = mask[:, 1:]
        seen = np.stack([[((y[:, :-1] == a) & (y[:, 1:] == b) & pair).sum() for b in (0, 1)] for a in (0, 1)])
        x = x.reshape(-1, size)
        own = x.T @ (y * mask).ravel().astype(np.float32)
        total = mask.sum()
        state = [np.zeros(size), np.zeros(size), np.zeros((2, 2)), np.zeros((2, 2))]
        for step in range(1, epochs + 1):
            e = np.zeros((n, most, 2))
            e[:, :, 1] = (x @ w.astype(np.float32)).reshape(n, most)
            fwd, bwd = np.zeros((n, most, 2)), np.zeros((n, most, 2))
            fwd[:, 0] = e[:, 0]
            for j in range(1, most):
                fwd[:, j] = np.where(mask[:, j, None], np.logaddexp(fwd[:, j - 1, 0, None] + t[0], fwd[:, j - 1, 1, None] + t[1]) + e[:, j], fwd[:, j - 1])
            for j in range(most - 2, -1, -1):
                nxt = bwd[:, j + 1] + e[:, j + 1]
                bwd[:, j] = np.where(mask[:, j + 1, None], np.logaddexp(t[:, 0] + nxt[:, 0, None], t[:, 1] + nxt[:, 1, None]), bwd[:, j + 1])
            z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
            p = np.exp(fwd + bwd - z[:, None, None])[:, :, 1] * mask
            both = np.exp(fwd[:, :-1, :, None] + t + (e + bwd)[:, 1:, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
            gw = (own - x.T @ p.ravel().astype(np.float32)) / total - L2 * w
            gt = (seen - both.sum((0, 1))) / total - L2 * t
            for q, g, i in ((w, gw, 0), (t, gt, 2)):
                state[i] = 0.9 * state[i] + 0.1 * g
                state[i + 1] = 0.99 * state[i + 1] + 0.01 * g * g
                q += 0.1 * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 1] / (1 - 0.99**step)) + 1e-9)
        return cls(w.tolist(), t.tolist())


def labelled_page(rng: random.Random, names: str | None = None) -> tuple[str, list[bool]]:
    """A random page and the label of each of its leaf blocks (True: main text).

    names: boxes have `known` names, `other` names or `no` names; by default a site is of any kind.
    """
    names = names or rng.choice(["known", "known", "known", "other", "no"])
    out: list[str] = []
    labels: list[bool] = []
    letters = "aeioubcdfghlmnprst"

    def words(least: int, most: int) -> str:
        got = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(least, most))]
        return " ".join(w + rng.choice(["", "", "", "", ","]) for w in got).capitalize().rstrip(",")

    def block(tag: str, text: str, label: bool, attributes: str = "") -> None:
        labels.append(label)
        out.append(f"<{tag}{attributes}>{text}" + (f"</{tag}>" if tag != "p" or rng.random() < 0.8 else ""))

    def named(kind: str, plain: float = 0.25) -> str:
        if names == "no" or rng.random() < plain:
            return ""
        name = rng.choice(KINDS[kind].split()) if names == "known" else "".join(rng.choice(letters) for _ in range(rng.randint(2, 7)))
        name = rng.choice([name, f"site-{name}", f"{name}-box", f"{name} wide", f"my{name.capitalize()}"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"'

    def cued(kind: str, text: str) -> str:
        """Sites say what a box is for, and must where no name tells it."""
        if rng.random() < (0.4 if names == "known" else 0.9):
            w = text.split(" ")
            w[rng.randrange(len(w))] = rng.choice(CUES[kind].split()).capitalize()
            return " ".join(w)
        return text

    def link(text: str) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{text}</a>'

    def menu() -> None:
        tag = rng.choice(["nav", "nav", "div", "ul"])
        out.append(f"<{tag}{named('menu', 0.5 if tag == 'nav' else 0)}>" + ("<ul>" if tag != "ul" else ""))
        for _ in range(rng.randint(2, 8)):
            block("li", link(words(1, 3)), False)
        out.append(("</ul>" if tag != "ul" else "") + f"</{tag}>")

    def boxed(kind: str, tags: list[str], plain: float, make) -> None:
        tag = rng.choice(tags)
        out.append(f"<{tag}{named(kind, plain if tag not in ('div', 'section') else 0)}>")
        make()
        out.append(f"</{tag}>")

    def lines(least: int = 1, most: int = 3, short: bool = False):
        def make() -> None:
            for _ in range(rng.randint(least, most)):
                text = words(1, 6) if short or rng.random() < 0.3 else words(6, 30) + "."
                block(rng.choice(["p", "p", "div", "span-less"]).replace("span-less", "h4"), link(text) if rng.random() < 0.3 else text, False)

        return make

    def lone(kind: str, tag: str = "div") -> None:
        text = cued(kind, words(3, 14)) if kind in CUES else words(3, 14)
        block(tag, (text + ".") if rng.random() < 0.7 else link(text), False, named(kind, 0))

    def foot() -> None:
        boxed("foot", ["footer", "footer", "div"], 0.6, lambda: block("p", f"&copy; {rng.randint(1999, 2030)} {words(1, 8)}", False) if rng.random() < 0.6 else lines()())

    def form() -> None:
        out.append(f"<form{named('form', 0.4)}>")
        for _ in range(rng.randint(1, 3)):
            block("p", cued("form", words(1, 10)), False)
        out.append("<input name='q'>" + f"<button>{words(1, 2)}</button>" * (rng.random() < 0.5) + "</form>")

    def talk() -> None:
        def make() -> None:
            block("h3", cued("talk", words(1, 3)), False)
            for _ in range(rng.randint(1, 4)):
                if rng.random() < 0.3:
                    block("p", cued("talk", words(1, 3)) + f" {rng.randint(1, 28)}.", False)
                block(rng.choice(["p", "div"]), words(4, 45) + ".", False, named("talk", 0.5))

        boxed("talk", ["section", "div", "ol"], 0, make)

    def side() -> None:
        boxed("side", ["aside", "aside", "div"], 0.4, lambda: (block("h4", cued("side", words(1, 4)), False), lines(1, 4)()))

    def extras() -> None:
        if rng.random() < 0.7:
            rng.choice([lambda: lone("ad"), lambda: boxed("ad", ["div", "aside"], 0, lines(1, 2)), form, talk, lambda: lone("share"), lambda: lone("notice"), side])()

    def article() -> None:
        bare = rng.random() < 0.45
        tag = rng.choice(["article", "article", "main", "div", "section"])
        out.append(f"<{tag}{named('main', 0 if tag in ('div', 'section') else 0.7)}>" if not bare else "<article>")
        top = rng.random() < 0.15
        out.append("<header>" * top)
        if rng.random() < 0.9:
            block("h1", words(2, 12) + rng.choice(["", "", ".", "?"]), True)
        out.append("</header>" * top)
        for _ in range(rng.randint(2, 14)):
            r = rng.random()
            if r < 0.62:
                text = words(8, 120) + "."
                if rng.random() < 0.15:
                    text = text[:10] + link(words(1, 3)) + text[10:]
                block("p", text, True)
            elif r < 0.72:
                block("p", f"<b>{words(1, 10)}{rng.choice(['', '.'])}{rng.choice(['<br>', '</b>'])}", True)
            elif r < 0.8:
                block(rng.choice(["h2", "h3"]), words(1, 8), True)
            elif r < 0.86:
                block("p", words(1, 6) + rng.choice(["", "."]), True)
            elif r < 0.91:
                out.append("<ul>")
                for _ in range(rng.randint(2, 5)):
                    block("li", words(2, 25), True)
                out.append("</ul>")
            elif r < 0.95:
                out.append("<blockquote>")
                block("p", words(5, 40) + ".", True)
                out.append("</blockquote>")
            elif r < 0.97:
                block("pre", words(3, 30), True)
            elif not bare:
                extras()
        if not bare and rng.random() < 0.5:
            extras()
        out.append("</article>" if bare else f"</{tag}>")

    out.append("<!DOCTYPE html><html><head><title>" + words(2, 8) + "</title><style>p{}</style></head><body>")
    if rng.random() < 0.5:
        boxed("top", ["header", "header", "div"], 0.5, lambda: (block(rng.choice(["p", "div", "h1"]), words(1, 5), False), menu() if rng.random() < 0.5 else None))
    if rng.random() < 0.8:
        menu()
    for _ in range(rng.randint(0, 2)):
        extras()
    article()
    for _ in range(rng.randint(0, 2)):
        extras()
    if rng.random() < 0.85:
        foot()
    out.append("</body></html>" * (rng.random() < 0.9))
    return "".join(out), labels


def train(pages: int = TRAIN_PAGES, seed: int = 11) -> Chain:
    rng = random.Random(seed)
    data = []
    for _ in range(pages):
        page, labels = labelled_page(rng)
        data.append((features(blocks(page)), labels))
    return Chain.fit(data)


def main_text(page: str, chain: Chain) -> str:
    found = blocks(page)
    return "\n".join(b[0] for b, keep in zip(found, chain.decode(features(found)), strict=True) if keep)


def extract(pages: DataFrame, chain: Chain | None = None) -> DataFrame:
    """page_id, url, text, n_chars, per row of pages."""
    common.reach_workers(pages.sparkSession)
    p = common.pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    model = chain or train()
    weights, moves = model.weights, model.moves  # a few hundred numbers

    def run(batches):
        chain = Chain(weights, moves)
        for batch in batches:
            for part in common.chunks(batch, "html"):
                got = [main_text(h, chain) for h in common.texts_of(part, "html")]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(got, pa.string()), pa.array(list(map(len, got)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return p.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
