"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text between the borders of block
elements, with white space made one blank and character references decoded.
Each block has features of its ancestor tags, of the words of their class, id
and role names, and of its text; the chain has a state for boilerplate and one
for main text.  Viterbi decoding labels the blocks, and the main ones make the
text.  Scripts, styles, comments and other unseen elements are no blocks.

The field is trained here, by gradient ascent on the exact conditional
likelihood, on labelled pages: by default on pages that are drawn by rule from
the layouts below.  Its weights, a few thousand numbers, travel to the tasks;
a page is read and decoded where it lies.

A page is read once from left to right, in time in proportion to its length,
whatever it holds: a block points to its element, an element to the one around
it, and the score of an element's marks is reckoned once.

Defined results: null, empty and text-free pages give an empty text; unclosed
and stray tags, a '>' inside a quoted attribute, and tags inside scripts are
read as browsers do as far as text goes; a script, style or other element of
plain text without its end tag hides the rest of the page, as in browsers, but
one that holds markup (an open select or video) hides nothing; comments and
tags that the page's end cuts off are no text; repeated rows give the same text;
an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Kinds of elements.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var wbr".split()
)
UNSEEN = set("noscript template svg object canvas audio video math select".split())
HEAD = set("html base basefont bgsound link meta title noscript style script template".split())  # these leave the head open
TEXT_RAW = set("script style textarea title".split())  # '/>' does not close them
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in (*TEXT_RAW, "iframe", "noembed", "noframes", "xmp")}  # what they hold is no markup
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
DEPTH = 512  # elements nested deeper give their text, but no marks
NAMES = 32  # words of an element's names that become marks
_BARRIER = {"table", "ul", "ol", "dl", "div", "article", "section", "body", "nav", "aside"}

# A tag's attributes and its '>', which may stand inside a quoted value; possessive, so that no text is read twice.
_REST = re.compile(r"""((?:[^>=]++|=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+)?+)*+)(>?)""")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*+")
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_BLANK = re.compile(r"\s+")
_ZEROS, _HUGE = re.compile(r"&#0+(?=[0-9])"), re.compile(r"&#[0-9]{8,};?")


class Path:
    """An open element: its tag, the marks that it adds to those of the elements around it, and the one around it."""

    __slots__ = ("above", "marks", "tag", "within")

    def __init__(self, above: Path | None, tag: str, marks: tuple[str, ...]):
        self.above, self.tag, self.marks = above, tag, marks
        self.within: bool = (above is not None and above.within) or "article" in marks or "main" in marks

    def all_marks(self) -> list[str]:
        found, path = [], self
        while path is not None:
            found[:0] = path.marks
            path = path.above
        return found


Block = tuple[Path | None, str, int]  # the element around a text; the text; characters inside links


def plain(text: str) -> str:
    """Character references decoded (numbers beyond Unicode, of any length, as U+FFFD), white space made one blank."""
    if "&" in text:
        text = html.unescape(_HUGE.sub("\ufffd", _ZEROS.sub("&#", text)))
    return _BLANK.sub(" ", text).strip()


def tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether an end tag, attributes) of each tag, and with no name of what else is no text, read once from left to right."""
    never: set[str] = set()  # what does not come any more
    at, size = 0, len(page)

    def after(end: re.Pattern | str, start: int) -> int:
        """Where the next `end` begins; -1 if there is none, which is looked for once."""
        key = end if isinstance(end, str) else end.pattern
        if key in never:
            return -1
        found = page.find(end, start) if isinstance(end, str) else (m.start() if (m := end.search(page, start)) else -1)
        if found < 0:
            never.add(key)
        return found

    while (start := page.find("<", at)) >= 0:
        kind = page[start + 1 : start + 2]
        if kind == "!" and page.startswith("--", start + 2):
            short = next((n for n in ("<!-->", "<!--->") if page.startswith(n, start)), "")
            found = start + len(short) if short else after("-->", start + 4)
            at = size if found < 0 else found if short else found + 3
            yield start, at, "", False, ""
            continue
        closing = kind == "/"
        name = _NAME.match(page, start + 1 + closing)
        if name is None:
            at = start + 1
            if kind in ("!", "?", "/"):
                at = after(">", start) + 1 or size
                yield start, at, "", False, ""
            continue
        rest = _REST.match(page, name.end())
        tag, at = name[0].lower(), rest.end()
        if not rest[2]:  # a tag that the page's end cuts off is no text
            yield start, size, "", False, ""
            return
        if tag in RAW and not closing and not (rest[1].endswith("/") and tag not in TEXT_RAW):
            end = after(RAW[tag], at)
            at = _REST.match(page, end + 2 + len(tag)).end() if end >= 0 else size  # what is never closed goes on to the end
            yield start, at, "", False, ""
            continue
        yield start, at, tag, closing, rest[1]


def leaf_blocks(page: str) -> list[Block]:
    """The text blocks of a page in order."""
    stack: list[tuple[str, Path, bool]] = []  # block elements: tag, path, whether unseen
    opened: Counter[str] = Counter()  # tags of the stack
    marked: set[str] = set()  # marks of the stack
    deep: list[str] = []  # elements below DEPTH, as tags alone
    hidden = 0  # unseen elements of the stack
    last_end: dict[str, int] = {}
    lower = ""
    head = begun = False  # inside the head; whether the body has begun
    links = 0
    blocks: list[Block] = []
    parts: list[str] = []
    linked = at = 0

    def end() -> None:
        nonlocal linked
        text = plain("".join(parts)) if parts else ""
        parts.clear()
        if text:
            blocks.append((stack[-1][1] if stack else None, text, linked))
        linked = 0

    def pop_to(names: set[str], barrier: set[str]) -> None:
        nonlocal hidden
        if not any(opened[n] for n in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                end()
                for tag, path, unseen in stack[i:]:
                    opened[tag] -= 1
                    hidden -= unseen
                    marked.difference_update(path.marks)
                del stack[i:]
                deep.clear()
                return
            if stack[i][0] in barrier:
                return

    for start, stop, tag, closing, attributes in tags(page):
        if start > at and not hidden:
            text = page[at:start]
            if not head or text.strip():
                head, begun = False, begun or bool(text.strip())
                parts.append(text)
            if links:
                linked += len(text)
        at = stop
        if not tag:
            continue
        if tag == "head":
            end()
            head, begun = not closing and not begun, begun or closing
            continue
        if tag not in HEAD and not closing or tag in ("body", "html", "br") and closing:
            head, begun = False, True
        if head:
            continue
        if tag == "a":
            links = int(not closing)
        elif tag in INLINE or tag in ("body", "html"):
            pass
        elif tag == "br":
            parts.append(" ")
        elif tag in VOID:
            end()
        elif closing:
            if deep and tag in deep:
                end()
                del deep[len(deep) - 1 - deep[::-1].index(tag) :]
            else:
                pop_to(HEADINGS if tag in HEADINGS else {tag}, _BARRIER if tag == "p" or tag in HEADINGS else {"template"} - {tag})
            end()
        else:
            unseen = tag in UNSEEN
            if unseen:
                if tag not in last_end:
                    lower = lower or page.lower()
                    last_end[tag] = lower.rfind("</" + tag)
                if attributes.endswith("/") or last_end[tag] < at:  # closed at once, or never: it hides nothing
                    end()
                    continue
            if tag in CLOSES_P:
                pop_to({"p"}, _BARRIER)
            if tag in SIBLINGS:
                pop_to(SIBLINGS[tag], _BARRIER - SIBLINGS[tag])
            end()
            if len(stack) >= DEPTH and not unseen:
                deep = [*deep[-DEPTH:], tag]
                continue
            names = " ".join(x[0] or x[1] or x[2] for x in _NAMES.findall(attributes)).lower()
            own = dict.fromkeys([tag, *("." + w for w in _WORD.findall(names)[:NAMES])])
            new = tuple(m for m in own if m not in marked)
            marked.update(new)
            stack.append((tag, Path(stack[-1][1] if stack else None, tag, new), unseen))
            opened[tag] += 1
            hidden += unseen
    if at < len(page) and not hidden:
        parts.append(page[at:])
    end()
    return blocks


def path_features(path: Path | None) -> list[str]:
    """Of the ancestors alone."""
    found = ["in:" + m for m in path.all_marks()] + ["own:" + path.tag] if path else []
    if path is None or not path.within:
        found.append("outside")
    return found


def text_features(block: Block, before: Block | None) -> list[str]:
    path, text, linked = block
    words = text.count(" ") + 1
    found = [f"words:{min(words.bit_length(), 7)}", f"links:{min(4, 4 * linked // len(text))}"]
    if text[-1] in ".!?:;\"'”»…":
        found.append("stop")
    if words > 3 and text.count(",") * 12 >= words:
        found.append("commas")
    if "©" in text or "All rights" in text:
        found.append("copyright")
    if "|" in text or "·" in text:
        found.append("bars")
    if before is None:
        found.append("first")
    elif before[0] is path or (before[0] and path and before[0].above is path.above and (before[0].tag, before[0].marks) == (path.tag, path.marks)):
        found.append("like before")
    return found


def features(block: Block, before: Block | None) -> list[str]:
    return path_features(block[0]) + text_features(block, before)


class Field:
    """Weights of the features for the main state, and of the steps between states."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, steps: np.ndarray):
        self.index, self.weights, self.steps = index, weights, steps
        self.known = {f: float(weights[i]) for f, i in index.items()}

    def scores(self, blocks: list[Block]) -> list[float]:
        get, before, found = self.known.get, None, []
        of_path: dict[Path | None, float] = {None: 0.0}  # of the marks down to it

        def marks(path: Path | None) -> float:
            down = []
            while path not in of_path:
                down.append(path)
                path = path.above
            for p in reversed(down):
                of_path[p] = of_path[p.above] + sum(get("in:" + m, 0.0) for m in p.marks)
                path = p
            return of_path[path]

        for b in blocks:
            own = get("own:" + b[0].tag, 0.0) if b[0] else 0.0
            outside = 0.0 if b[0] and b[0].within else get("outside", 0.0)
            found.append(marks(b[0]) + own + outside + sum(get(f, 0.0) for f in text_features(b, before)))
            before = b
        return found

    def decode(self, blocks: list[Block]) -> list[bool]:
        """The likeliest states, by Viterbi."""
        (s00, s01), (s10, s11) = self.steps.tolist()
        best0 = best1 = 0.0
        back: list[tuple[int, int]] = []
        for i, score in enumerate(self.scores(blocks)):
            if i == 0:
                best0, best1 = 0.0, score
                continue
            from0 = (best0 + s00, 0) if best0 + s00 >= best1 + s10 else (best1 + s10, 1)
            from1 = (best1 + s11, 1) if best1 + s11 >= best0 + s01 else (best0 + s01, 0)
            best0, best1 = from0[0], from1[0] + score
            back.append((from0[1], from1[1]))
        if not blocks:
            return []
        state = int(best1 > best0)
        states = [state]
        for choice in reversed(back):
            state = choice[state]
            states.append(state)
        return [s == 1 for s in reversed(states)]

    def extract(self, page: str) -> str:
        blocks = leaf_blocks(page)
        return "\n\n".join(b[1] for b, main in zip(blocks, self.decode(blocks), strict=True) if main)


def _expected(score: list[float], steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chance of the main state at each block, and the expected number of each step, by scaled forward and backward sums."""
    (t00, t01), (t10, t11) = np.exp(steps).tolist()
    main = [math.exp(min(30.0, max(-30.0, s))) for s in score]
    total = 1 + main[0]
    ahead = [(1 / total, main[0] / total)]
    for m in main[1:]:
        a, b = ahead[-1]
        a, b = a * t00 + b * t10, (a * t01 + b * t11) * m
        ahead.append((a / (a + b), b / (a + b)))
    p, pair = np.empty(len(score)), np.zeros((2, 2))
    back0 = back1 = 1.0
    p[-1] = ahead[-1][1]
    for i in range(len(score) - 2, -1, -1):
        a, b = ahead[i]
        m = main[i + 1]
        each = (a * t00 * back0, a * t01 * m * back1, b * t10 * back0, b * t11 * m * back1)
        total = sum(each)
        pair += np.array(each).reshape(2, 2) / total
        back0, back1 = (t00 * back0 + t01 * m * back1), (t10 * back0 + t11 * m * back1)
        back0, back1 = back0 / (back0 + back1), back1 / (back0 + back1)
        p[i] = b * back1 / (a * back0 + b * back1)
    return p, pair


def train(pages: list[tuple[list[Block], list[bool]]], rounds: int = 25, rate: float = 0.3, ridge: float = 1e-3, seed: int = 1) -> Field:
    """By stochastic gradients of the conditional log-likelihood, from forward and backward sums."""
    index: dict[str, int] = {}
    rows = []
    for blocks, truth in pages:
        if blocks:
            feats = [features(b, blocks[i - 1] if i else None) for i, b in enumerate(blocks)]
            rows.append(([np.array([index.setdefault(f, len(index)) for f in fs]) for fs in feats], np.array(truth, int)))
    weights, steps = np.zeros(len(index)), np.zeros((2, 2))
    order = random.Random(seed)
    for done in range(rounds):
        order.shuffle(rows)
        speed = rate / (1 + done / 5)
        for feats, truth in rows:
            score = [float(weights[f].sum()) for f in feats]
            p, pair = _expected(score, steps)
            for f, g in zip(feats, speed * (truth - p), strict=True):
                weights[f] += g
            seen = np.zeros((2, 2))
            np.add.at(seen, (truth[:-1], truth[1:]), 1)
            steps += speed * (seen - pair) / max(1, len(feats) - 1)
        weights *= 1 - ridge
    return Field(index, weights, steps)


# Names that sites give to parts of a page.
BOILER = {
    "nav": ["nav", "menu", "navbar", "breadcrumb", "toc", "navigation", "topbar"], "header": ["header", "masthead", "banner", "branding", "site-header"],
    "footer": ["footer", "site-footer", "copyright", "colophon", "legal"], "aside": ["sidebar", "widget", "related", "aside", "recommended", "popular", "trending"],
    "notice": ["notice", "cookie", "consent", "gdpr", "alert", "popup", "modal", "overlay"], "ad": ["ad", "ads", "advert", "sponsor", "sponsored", "promo", "promoted", "banner-ad"],
    "form": ["form", "search", "subscribe", "newsletter", "login", "signup"], "comments": ["comments", "comment", "discussion", "replies", "respond", "disqus"],
    "share": ["share", "social", "tags", "meta", "byline", "pagination", "pager"],
}
MARK = "\ue000"  # of main text in drawn pages
MAIN_NAMES = ["content", "post", "entry", "article", "story", "text", "post-content", "article-body", "main", "introduction", "chapter", "body"]
MAIN_HEADS = ["title", "headline", "entry-header", "post-title", "article-header"]
_SYLLABLES = "an be co de er fi ga ho in ju ka le mo ne or pa qui re su ti un va we ya zu st th ou ing".split()


def drawn_page(rng: random.Random) -> list[tuple[str, bool]]:
    """A page as pieces of markup, each telling whether its text is main text."""

    def words(n: int) -> str:
        found = ["".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]
        return " ".join(w + ("," if rng.random() < 0.08 else ".") * (rng.random() < 0.15) for w in found).capitalize()

    def sentence(low: int, high: int) -> str:
        return words(rng.randint(low, high)) + rng.choice([".", ".", ".", "!", "?", ""])

    def name(kind: str) -> str:
        return rng.choice([f' class="{n}"', f' id="{n}"', f' class="{n} {rng.choice(BOILER[kind])}"']) if (n := rng.choice(BOILER[kind])) else ""

    def links(n: int) -> str:
        wrap = rng.choice([("<ul>", "<li>", "</li>", "</ul>"), ("", "", " | ", ""), ("<ul>", "<li>", "", "</ul>"), ("", "<span>", "</span>", "")])
        return wrap[0] + "".join(f'{wrap[1]}<a href="/{words(1)}">{words(rng.randint(1, 3))}</a>{wrap[2]}' for _ in range(n)) + wrap[3]

    def boiler(kind: str) -> str:
        tag = kind if kind in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.6 else rng.choice(["div", "div", "section"])
        attr = name(kind) if tag == "div" or tag == "section" or rng.random() < 0.4 else ""
        if kind == "nav":
            body = links(rng.randint(2, 8))
        elif kind == "header":
            body = rng.choice(["", f"<h1>{words(2)}</h1>", f"<h2>{words(2)}</h2>", f"<h3>{words(2)}</h3>", f"<div>{words(2)}</div>"]) + rng.choice(["", f"<p>{words(5)}</p>", links(3)])
        elif kind == "footer":
            body = rng.choice(["&copy; ", "© 2020 ", "", "Copyright "]) + rng.choice([f"{words(1)}.example.com &middot; {sentence(4, 18)}", words(4), f"<p>{sentence(5, 20)}</p>", links(4)])
        elif kind == "aside":
            body = rng.choice([f"<h3>{words(2)}</h3>", ""]) + rng.choice([links(rng.randint(2, 6)), f"<p>{sentence(5, 25)}</p>"])
        elif kind == "form":
            body = f"<label>{words(2)}</label><input name=q>" + rng.choice([f"<button>{words(1)}</button>", f"<p>{sentence(4, 10)}</p><button>{words(2)}</button>"])
        elif kind == "comments":
            body = rng.choice([f"<h3>{words(2)}</h3>", ""]) + "".join(
                rng.choice(["<p>{}</p>", '<div class="comment"><b>{}</b><p>{}</p></div>', "<li>{}</li>"]).replace("{}", sentence(4, 40)) for _ in range(rng.randint(1, 4))
            )
        elif kind == "share":
            body = rng.choice([links(rng.randint(1, 4)), words(rng.randint(1, 6))])
        else:  # notices and adverts
            body = rng.choice(["{}", "<p>{}</p>", "<span>{}</span>", "{} <a href=#>OK</a>"]).replace("{}", sentence(3, 25))
        return f"<{tag}{attr}>{body}</{tag}>"

    def own_name(known: list[str]) -> str:
        """A name of the site's own, one that many sites use, or none."""
        n = rng.choice(["", words(1).lower().strip(".,"), rng.choice(known)])
        return rng.choice([f' class="{n}"', f' id="{n}"', f' class="{n} {words(1).lower().strip(".,")}"']) if n else ""

    def main(title: str) -> list[str]:
        found = [rng.choice([f"<h1>{title}</h1>", f"<h1>{title}</h1>", f"<h2>{title}</h2>", ""])]
        if found[0] and rng.random() < 0.25:
            found[0] = f"<header{own_name(MAIN_HEADS)}>{found[0]}{rng.choice(['', f'<p>{sentence(3, 20)}</p>'])}</header>"
        for _ in range(rng.randint(1, 14)):
            kind = rng.random()
            text = sentence(1, 90) if rng.random() < 0.8 else sentence(1, 6)
            if kind < 0.6:
                found.append(f"<p>{text}</p>")
            elif kind < 0.72:
                found.append(f"<p><b>{text}<br>")
            elif kind < 0.8:
                found.append(f"<h{rng.randint(2, 4)}>{words(rng.randint(1, 6))}</h{rng.randint(2, 4)}>")
            elif kind < 0.86:
                found.append("<ul>" + "".join(f"<li>{sentence(1, 15)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.9:
                found.append(f"<blockquote>{text}</blockquote>")
            elif kind < 0.93:
                found.append("<table>" + "".join(f"<tr><td>{words(1)}</td><td>{words(2)}</td></tr>" for _ in range(2)) + "</table>")
            elif kind < 0.96:
                found.append(f"<pre>{text}</pre>")
            else:
                found.append(f'<p>{sentence(5, 30)} <a href="/x">{words(2)}</a> {sentence(2, 20)}</p>')
        return found

    pieces: list[tuple[str, bool]] = []
    title = words(rng.randint(1, 12))
    pieces.append((f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>", False))
    before = rng.sample(["nav", "header", "ad", "notice", "form", "aside", "share"], rng.randint(0, 4))
    if "nav" not in before and rng.random() < 0.6:
        before.insert(0, "nav")
    pieces += [(boiler(k), False) for k in before]
    wraps = [rng.choice(["article", "article", "article", "main", "div", "div", "section"]), *rng.choices(["div", "div", "section"], k=rng.choice([0, 0, 0, 1, 1, 2]))]
    rng.shuffle(wraps)
    pieces += [(f"<{w}{own_name(MAIN_NAMES)}>", False) for w in wraps]
    body = main(title)
    if rng.random() < 0.2:  # parts of the text in sections
        cuts = sorted(rng.sample(range(1, len(body) + 1), rng.randint(1, min(3, len(body)))))
        body = ["".join(body[i:j]) for i, j in zip([0, *cuts], [*cuts, len(body)], strict=True)]
        body = [f"<section{own_name(MAIN_NAMES)}>{x}</section>" if i else x for i, x in enumerate(body) if x or not i]
    inner = rng.choice(["", "", *BOILER]) if rng.random() < 0.5 else ""
    at = rng.randint(1, len(body))
    pieces += [(x, True) for x in body[:at]]
    if inner and inner != "header":
        pieces.append((boiler(inner), False))
    pieces += [(x, True) for x in body[at:]]
    pieces.append(("".join(f"</{w}>" for w in reversed(wraps)), False))
    after = rng.sample(["aside", "comments", "form", "ad", "share", "notice", "nav"], rng.randint(0, 3))
    if rng.random() < 0.8:
        after.append("footer")
    pieces += [(boiler(k), False) for k in after]
    pieces.append(("</body></html>", False))
    return pieces


def labelled_page(pieces: list[tuple[str, bool]]) -> tuple[str, list[Block], list[bool]]:
    """The page and its blocks with their labels, told by a mark that is put before main text."""
    marked = "".join(re.sub(r">(?=[^<\s])", ">" + MARK, x) if main else x for x, main in pieces)
    blocks, truth = [], []
    for path, text, linked in leaf_blocks(marked):
        blocks.append((path, text.replace(MARK, ""), linked))
        truth.append(MARK in text)
    return "".join(x for x, _ in pieces), blocks, truth


@functools.cache
def default_field(n: int = 500, seed: int = 11) -> Field:
    """Trained once a process on n drawn pages."""
    rng = random.Random(seed)
    return train([labelled_page(drawn_page(rng))[1:] for _ in range(n)])


def extractor(field: Field) -> Callable:
    @F.arrow_udf(T.StringType())
    def extract(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in pages:
            yield pa.array((field.extract(p.as_py() or "") for p in batch), pa.string(), size=len(batch))

    return extract


def extract_text(pages: DataFrame, field: Field, carry: Iterable[str] = ("page_id", "url")) -> DataFrame:
    """Every row (its carried columns) with the main text of its html and its length in code points."""
    carry = [c for c in carry if c not in ("text", "n_chars")]
    rows = pages.select(F.struct(F.lit(0).alias("_"), *carry).alias("row"), extractor(field)("html").alias("text"))
    return rows.select(*[F.col("row")[c].alias(c) for c in carry], "text", F.length("text").cast("long").alias("n_chars"))
