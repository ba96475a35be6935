"""Main-text extraction by a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into its leaf blocks, runs of text between block-level tags, each with the tags it lies in and
their class and id words. The field labels each block as part of the article or not from those, from the text's own
shape and its neighbours', and from the part of the page's text that its boxes hold; Viterbi decodes a page as a whole.
The weights are learned here from labelled pages: layouts of several families with marked blocks, filled with words
drawn by rule, so that no text of the tables is an input of training.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoal.llm.common import ship, slices

#: HTML's void elements, elements whose content isn't text, and inline elements, which don't end a block.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = set("script style noscript template svg head title iframe object canvas audio video select option textarea button".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mi mn mo mrow msup msub q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SECTIONS = set("article main section aside header footer nav".split())
#: Elements that make boxes of the page, by which its text is shared out.
BOXES = set("body main article section aside header footer nav div td form".split())
#: Fixed values, HTML's rules for end tags that may be left out: what may be in a head, what ends an open paragraph, and
#: what an open paragraph isn't looked for beyond.
HEADED = set("base basefont bgsound head html link meta noframes noscript script style template title".split())
ENDS_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section table ul".split())
P_SCOPE = set("applet button caption html marquee object table td template th".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: A block also ends where these start again without an end tag.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)|[^<]+|<", re.S)
#: An attribute's name and, after an equals sign, its value, with or without quotes.
PAIR = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.S)
INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)
WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
SPACE = re.compile(r"\s+")
RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe")}
#: Which mark stands for an attribute's words, and how many boxes around a block are looked at.
MARKED, AROUND = ("class", "id", "role"), 3


class Block:
    __slots__ = ("text", "tags", "marks", "near", "boxes", "links")

    def __init__(self, text: str, tags: frozenset, marks: frozenset, near: tuple[str, ...], boxes: tuple[int, ...], links: int):
        self.text, self.tags, self.marks, self.near, self.boxes, self.links = text, tags, marks, near, boxes, links


def attributes(src: str, pos: int) -> tuple[list[tuple[str, str]], bool, int]:
    """Names and values from after a tag's name on, whether the tag closes itself, and the place behind it.

    Quotes count only behind an equals sign. A quoted value that holds the end of this tag and the start of another, and
    behind whose closing quote neither space nor the tag's end comes, has lost its own closing quote: that one is another
    tag's, and the value ends with this tag. A tag that doesn't end is the rest of the page.
    """
    out = []
    while True:
        while pos < len(src) and (src[pos] == "/" or src[pos].isspace()):
            pos += 1
        if pos >= len(src) or src[pos] == ">":
            return out, pos < len(src) and src[pos - 1] == "/", pos + 1
        m = PAIR.match(src, pos)
        value, end = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "", m.end()
        if m[4] is None and end < len(src) and src[end] not in " \t\n\r\f>" and src[end : end + 2] != "/>" and ">" in value and "<" in value[value.index(">") :]:
            value = value[: value.index(">")]
            end = src.index(">", m.end(1))
        elif m[4] and m[4][0] in "\"'":
            value = value[1:]
        out.append((m[1].lower(), html.unescape(value) if "&" in value else value))
        pos = end


def is_hidden(name: str, attrs: list[tuple[str, str]]) -> bool:
    return name in HIDDEN or any(k == "hidden" or k == "aria-hidden" and v.strip().lower() == "true" or k == "style" and INVISIBLE.search(v) for k, v in attrs)


def blocks(page: str | None) -> list[Block]:
    """The page's leaf blocks in order: white space folded, references decoded, hidden elements left out."""
    out: list[Block] = []
    none: frozenset = frozenset()
    # Open elements: name, hidden, and of these and all around them the tags, marks, nearest tags and boxes.
    stack: list[tuple[str, bool, frozenset, frozenset, tuple[str, ...], tuple[int, ...]]] = []
    open_now: Counter = Counter()
    parts: list[str] = []
    links = dark = made = 0  # characters in links, open hidden elements, boxes so far

    def flush() -> None:
        nonlocal links
        text = SPACE.sub(" ", "".join(parts)).strip()
        if text:
            _, _, tags, marks, near, boxes = stack[-1] if stack else ("", False, none, none, (), ())
            out.append(Block(text, tags, marks, near, boxes, min(links, len(text))))
        parts.clear()
        links = 0

    def close(at: int) -> None:
        nonlocal dark
        if any(e[0] not in INLINE for e in stack[at:]):
            flush()
        for e in stack[at:]:
            dark -= e[1]
            open_now[e[0]] -= 1
        del stack[at:]

    def close_last(names: set[str], beyond: set[str]) -> None:
        """Closes the innermost open element of these names, if none of the others is inside it."""
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in names:
                close(at)
                return
            if stack[at][0] in beyond:
                return

    src, pos = page or "", 0
    while pos < len(src):
        m = TOKEN.match(src, pos)
        pos = m.end()
        name = m[2]
        if name is None:
            got = m[0]
            if got[0] == "<" and len(got) > 1 and not got.startswith("<![CDATA["):
                continue
            if dark and stack[-1][0] == "head" and not got.isspace():
                close_last({"head"}, set())  # text isn't in a head
            if not dark:
                text = html.unescape(got if not got.startswith("<![CDATA[") else got[9:].removesuffix("]]>"))
                parts.append(text)
                if open_now["a"]:
                    links += len(text.strip())
            continue
        name = name.lower()
        attrs, ends, pos = attributes(src, pos)
        if pos > len(src):  # the tag doesn't end
            break
        if m[1]:
            if open_now[name]:
                at = len(stack) - 1
                while stack[at][0] != name:
                    at -= 1
                close(at)
            continue
        if open_now["head"] and name not in HEADED:
            close_last({"head"}, {"template"})
        if open_now["p"] and name in ENDS_P:
            close_last({"p"}, P_SCOPE)
        if name in HEADINGS and stack and stack[-1][0] in HEADINGS:
            close(len(stack) - 1)
        if name in VOID:
            if name not in INLINE and name not in ("img", "input"):
                flush()
            continue
        marks = [w.lower() for k, v in attrs if k in MARKED for w in WORDS.findall(v)]
        if not marks and name in SECTIONS:
            marks.append(f"bare:{name}")
        if name in IMPLIED:
            close_last(IMPLIED[name], {"table", "ul", "ol", "dl", "div", "article", "section", "body"})
        if name not in INLINE:
            flush()
        if ends and name not in INLINE | {"p", "div"}:
            continue
        _, _, tags, above, near, boxes = stack[-1] if stack else ("", False, none, none, (), ())
        if name not in INLINE and name not in ("html", "body"):  # those tell nothing
            tags, near = tags if name in tags else tags | {name}, (*near[-2:], name)
        if name in BOXES:
            made += 1
            boxes = (*boxes[1 - AROUND :], made)
        hidden = is_hidden(name, attrs)
        stack.append((name, hidden, tags, above.union(marks) if any(w not in above for w in marks) else above, near, boxes))
        open_now[name] += 1
        dark += hidden
        if name in RAW:
            end = RAW[name].search(src, pos)
            pos = end.start() if end else len(src)
    flush()
    return out


def linked(b: Block) -> str:
    share = b.links / max(1, len(b.text))
    return "none" if share == 0 else "some" if share < 0.3 else "many" if share < 0.8 else "all"


def features(page: list[Block]) -> list[list[str]]:
    """Per block: the tags it lies in and their parents, class and id words, the shape of its text and its neighbours',
    and the part of the page's plain text in each of the boxes around it."""
    out = []
    seen: dict[tuple, list[str]] = {}
    plain = [len(b.text) - b.links for b in page]
    held: Counter = Counter()
    for b, n in zip(page, plain, strict=True):
        for box in b.boxes:
            held[box] += n
    total = max(1, sum(plain))
    size = [min(6, len(b.text).bit_length() // 2) for b in page]
    way = [linked(b) for b in page]
    for i, b in enumerate(page):
        above = seen.get((b.tags, b.marks, b.near))
        if above is None:
            above = ["bias"] + [f"in:{t}" for t in sorted(b.tags)] + [f"mark:{w}" for w in sorted(b.marks)]
            if b.near:
                above.append(f"tag:{b.near[-1]}")
                above += [f"path:{x}>{y}" for x, y in zip(b.near, b.near[1:], strict=False)]
            seen[b.tags, b.marks, b.near] = above
        f = list(above)
        f += [f"len:{size[i]}", f"links:{way[i]}", "words:" + str(min(5, b.text.count(" ").bit_length()))]
        if b.text[-1] in ".!?\"'”»…:;。！？":
            f.append("ends")
        if len(b.text) < 200 and ("©" in b.text[:24] or "(c)" in b.text[:24]):  # a notice begins so; prose may hold the sign
            f.append("copyright")
        for j, box in enumerate(reversed(b.boxes)):
            share = held[box] / total
            f.append(f"box{j}:" + ("0" if share < 0.05 else "1" if share < 0.2 else "2" if share < 0.5 else "3"))
        own = f"{way[i]}{size[i]}"
        f += [f"before:{way[i - 1]}{size[i - 1]}", f"pair:{way[i - 1]}>{own}"] if i else ["first", f"first:{own}"]
        f += [f"after:{way[i + 1]}{size[i + 1]}", f"pair:{own}<{way[i + 1]}"] if i + 1 < len(page) else ["last", f"last:{own}"]
        out.append(f)
    return out


class Crf:
    """Two labels, a weight for each feature and label, and for each transition."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves

    def scores(self, fs: list[list[str]]) -> np.ndarray:
        index = self.index
        known = [[index[x] for x in f if x in index] for f in fs]
        rows = self.weights[np.array([k for ks in known for k in ks], int)]
        out = np.zeros((len(fs), 2))
        np.add.at(out, np.repeat(np.arange(len(fs)), [len(ks) for ks in known]), rows)
        return out

    def decode(self, fs: list[list[str]]) -> list[int]:
        """Viterbi: the best labels of the whole page."""
        if not fs:
            return []
        s = self.scores(fs)
        best, back = s[0], []
        for row in s[1:]:
            way = best[:, None] + self.moves
            back.append(way.argmax(axis=0))
            best = way.max(axis=0) + row
        labels = [int(best.argmax())]
        for b in reversed(back):
            labels.append(int(b[labels[-1]]))
        return labels[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], epochs: int = 10, rate: float = 0.3, l2: float = 1e-4, seed: int = 7) -> Crf:
    """Stochastic gradient ascent on the log-likelihood: forward and backward sums give the expected features. The weights
    are the means of those after each epoch of the second half."""
    index: dict[str, int] = {}
    for fs, _ in pages:
        for f in fs:
            for x in f:
                index.setdefault(x, len(index))
    w, moves = np.zeros((len(index), 2)), np.zeros((2, 2))
    flat = [(np.array([index[x] for f in fs for x in f], int), np.repeat(np.arange(len(fs)), [len(f) for f in fs]), np.array(y)) for fs, y in pages if fs]
    rng = random.Random(seed)
    mean_w, mean_moves, half = np.zeros_like(w), np.zeros_like(moves), epochs - epochs // 2
    for epoch in range(epochs):
        rng.shuffle(flat)
        step = rate / (1 + epoch)
        for at, of, y in flat:
            n = len(y)
            s = np.zeros((n, 2))
            np.add.at(s, of, w[at])
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = s[0]
            for i in range(1, n):
                fwd[i] = s[i] + np.logaddexp(fwd[i - 1][0] + moves[0], fwd[i - 1][1] + moves[1])
            for i in range(n - 2, -1, -1):
                ahead = moves + s[i + 1] + bwd[i + 1]
                bwd[i] = np.logaddexp(ahead[:, 0], ahead[:, 1])
            total = np.logaddexp(*fwd[-1])
            diff = -np.exp(fwd + bwd - total)
            diff[np.arange(n), y] += 1
            np.add.at(w, at, step * (diff[of] - l2 * w[at]))
            if n > 1:
                pair = np.exp(fwd[:-1, :, None] + moves + (s[1:] + bwd[1:])[:, None, :] - total).sum(axis=0)
                seen = np.zeros((2, 2))
                np.add.at(seen, (y[:-1], y[1:]), 1)
                moves += 0.1 * step * (seen - pair - l2 * moves)
        if epoch >= epochs - half:
            mean_w += w / half
            mean_moves += moves / half
    return Crf(index, mean_w, mean_moves)


# Labelled pages. Layouts are given as nested parts; a part that starts with "+" is article text, with "-" is not.

#: Families of layouts: a telling article, <main> alone, no box at all, boxes whose names tell nothing, table cells.
FAMILIES = ("article", "main", "bare", "nameless", "cells")
#: Words that class names of each kind of part are made of, as pages have them.
NAMES = {
    "menu": "nav menu navigation navbar topnav".split(),
    "side": "sidebar side aside widget rail related".split(),
    "foot": "footer foot bottom colophon".split(),
    "ad": "ad ads advert advertisement banner promo sponsor sponsored".split(),
    "note": "cookie notice consent alert gdpr message popup modal newsletter".split(),
    "talk": "comments comment discussion replies responses disqus".split(),
    "head": "header masthead head top branding".split(),
    "body": "article content main post entry story body text".split(),
    "misc": "share social breadcrumb breadcrumbs pagination tags byline".split(),
}
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe qui ra se ti vo wa xi yo za en er th ing on est".split()
SIGNS = "!#$%*+=~^@_|"


def _word(rng: random.Random, most: int = 4) -> str:
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, most)))


def _phrase(rng: random.Random, low: int, high: int) -> str:
    words = [_word(rng) for _ in range(rng.randint(low, high))]
    for i in range(len(words)):
        if rng.random() < 0.1:
            words[i] += rng.choice(",.")
    style = rng.random()
    if style < 0.06:
        words = [w.upper() + rng.choice(("", "!", "!!")) for w in words]
    elif style < 0.12:
        words = [w + rng.choice(SIGNS) * rng.randint(1, 3) for w in words]
    text = " ".join(words)
    return text[:1].upper() + text[1:] + rng.choice((".", ".", ".", "", "!", "?"))


class Page:
    """Draws one page of a family; class names tell what they are for, unless ``told`` is false."""

    def __init__(self, rng: random.Random, family: str):
        self.rng, self.family = rng, family
        self.told = family != "nameless" and rng.random() < 0.75
        self.semantic = family not in ("nameless", "cells")

    def mark(self, kind: str) -> str:
        rng = self.rng
        name = rng.choice(NAMES[kind]) if self.told else _word(rng, 2) + str(rng.randint(1, 99)) * (rng.random() < 0.5)
        if rng.random() < 0.3:
            name += rng.choice(("-", "_")) + rng.choice(("box", "wrap", "wrapper", "area", "list", "block", "container", "inner", str(rng.randint(1, 9))))
        return f' {rng.choice(("class", "class", "id"))}="{name}"'

    def wrap(self, element: str | None, kind: str, inner: str) -> str:
        """The element itself, a div or section with a class or id, or both."""
        rng = self.rng
        if element and self.semantic and rng.random() < 0.6:
            return f"<{element}{self.mark(kind) if rng.random() < 0.5 else ''}>{inner}</{element}>"
        tag = rng.choice(("div", "div", "section" if self.semantic else "div", "aside" if element == "aside" and self.semantic else "div"))
        return f"<{tag}{self.mark(kind)}>{inner}</{tag}>"

    def links(self) -> str:
        rng = self.rng
        items = [f'<a href="/{i}">-{_phrase(rng, 1, 3)}</a>' for i in range(rng.randint(2, 9))]
        kind = rng.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return "".join(f"<div>{x}</div>" for x in items) if kind < 0.8 else " | ".join(items)

    def paragraphs(self) -> str:
        rng, out = self.rng, []
        for _ in range(rng.randint(1, 8)):
            kind = rng.random()
            text = "+" + (_phrase(rng, 1, 4) if rng.random() < 0.2 else _phrase(rng, 8, 80))
            if rng.random() < 0.05:
                text = text[: len(text) // 2] + " \u00a9 " + text[len(text) // 2 :]
            if kind < 0.03 and self.family in ("article", "main"):
                out.append(f"<p><a href='/s'>{text}</a></p>")
            elif kind < 0.6:
                out.append(rng.choice((f"<p>{text}</p>", f"<p>{text}", f"<p><b>{text}</b></p>", f"<p><b>{text}<br>", f"<p>{text} <a href='/x'>ti vo</a> ne.</p>")))
            elif kind < 0.7:
                out.append(f"<h2>+{_phrase(rng, 1, 6)}</h2>")
            elif kind < 0.8:
                out.append("<ul>" + "".join(f"<li>+{_phrase(rng, 2, 15)}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
            elif kind < 0.87:
                out.append(f"<blockquote><p>{text}</p></blockquote>")
            elif kind < 0.93 and self.family != "cells":
                out.append("<table>" + "".join(f"<tr><td>+{_phrase(rng, 1, 4)}</td><td>+{_phrase(rng, 1, 4)}</td></tr>" for _ in range(rng.randint(1, 4))) + "</table>")
            else:
                out.append(f"<div>{text}</div>")
        return "".join(out)

    def note(self) -> str:
        """A part that isn't the article's."""
        rng, kind = self.rng, self.rng.randrange(5)
        if kind == 0:
            return self.wrap(None, "ad", rng.choice(("-", "<p>-", "<a href='/b'>-")) + _phrase(rng, 3, 40 if self.told else 10))
        if kind == 1:
            return self.wrap(None, "note", f"<p>-{_phrase(rng, 4, 30 if self.told else 10)}</p><button>ok</button>")
        if kind == 2:
            return f"<form>{rng.choice(('<label>', '<p>', ''))}-{_phrase(rng, 1, 8)}<input name='q'></form>"
        if kind == 3:
            return self.wrap(None, "misc", f"-{_phrase(rng, 1, 6)}")
        return self.wrap("aside", "side", f"<h3>-{_phrase(rng, 1, 4)}</h3>{self.links()}" + (f"<p>-{_phrase(rng, 3, 30)}</p>" if self.told or self.semantic else ""))

    def notes(self, most: int) -> str:
        return "".join(self.note() for _ in range(self.rng.randint(0, most)))

    def talk(self) -> str:
        rng = self.rng
        forms = ("<div class='comment'><p>-{}</p></div>", "<li><p>-{}</p></li>", "<article class='comment'><p>-{}</p></article>")
        head = f"<h{rng.randint(2, 4)}>-{_phrase(rng, 1, 3)}" if rng.random() < 0.5 else ""
        head += f"</{head[1:3]}>" if head else ""
        by = rng.choice(("", "", "<b>-{}</b>", "<div class='author'>-{}</div>", "<p>-{}</p>"))
        return self.wrap("section", "talk", head + "".join(by.format(_phrase(rng, 1, 2)) + rng.choice(forms).format(_phrase(rng, 3, 40)) for _ in range(rng.randint(1, 4))))

    def drawn(self) -> str:
        rng, family = self.rng, self.family
        title = f"<h1>+{_phrase(rng, 1, 12)}</h1>" if rng.random() < 0.8 else ""
        inner = title + self.paragraphs() + (self.note() + self.paragraphs() if rng.random() < 0.3 else "")
        if rng.random() < 0.2:  # one block, or a short one below the title
            inner = (title if rng.random() < 0.6 else "") + rng.choice(("<p>+", "<p><b>+", "<div>+", "+")) + _phrase(rng, 1, rng.choice((8, 60)))
        if family == "article":
            body = self.wrap("article", "body", inner)
            body = self.wrap("main", "body", body) if rng.random() < 0.3 else body
        elif family == "main":
            body = f"<main{self.mark('body') if rng.random() < 0.3 else ''}>{inner}</main>"
        elif family == "bare":
            body = inner
        else:
            body = f"<div{self.mark('body')}>{inner}</div>"
        menu = self.wrap("nav", "menu", self.links())
        top = self.wrap("header", "head", rng.choice((f"<h1>-{_phrase(rng, 1, 4)}</h1>", f"<p>-{_phrase(rng, 1, 8)}</p>", f"<a href='/'>-{_phrase(rng, 1, 3)}</a>")) + (menu if rng.random() < 0.5 else ""))
        foot = self.wrap("footer", "foot", rng.choice(("", "<p>")) + rng.choice(("-&copy; ", "-")) + _phrase(rng, 2, 25 if self.told or self.semantic else 8)) if rng.random() < 0.8 else ""
        talk = self.talk() if self.told and rng.random() < 0.4 else ""
        if talk and family in ("article", "main") and rng.random() < 0.3:
            body, talk = body[: body.rindex("</")] + talk + body[body.rindex("</") :], ""
        if family == "cells":
            cells = [f"<td>{self.links()}</td>", f"<td>{body}</td>", f"<td>{self.note()}</td>"]
            body = "<table><tr>" + "".join(cells[rng.randint(0, 1) : rng.randint(2, 3)]) + "</tr></table>"
        if rng.random() < 0.15:  # nothing but the article
            return rng.choice((body, f"<html><head><title>t</title></head><body>{body}</body></html>"))
        if rng.random() < 0.25:  # nothing before it
            return f"<html><body>{body}{talk}{self.notes(2)}{foot}</body></html>"
        head = (top if rng.random() < 0.6 else "") + (menu if rng.random() < 0.7 else "")
        if family == "bare":
            return f"<html><head><title>t</title></head><body>{head}{body}{talk}{foot}</body></html>"
        return f"<!DOCTYPE html><html><head><title>t</title></head><body>{self.notes(1)}{head}{self.notes(2)}{body}{talk}{self.notes(2)}{foot}</body></html>"


def labelled(n: int, seed: int, families: tuple[str, ...] = FAMILIES) -> list[tuple[list[list[str]], list[int], list[int]]]:
    """Features, labels and lengths of the blocks of ``n`` pages of each family."""
    rng, out = random.Random(seed), []
    for i in range(n * len(families)):
        page = blocks(Page(rng, families[i % len(families)]).drawn())
        labels = [int(b.text[0] == "+") for b in page]
        for b in page:
            b.text = b.text.replace("+", "").replace("-", "").strip() or "x"
        out.append((features(page), labels, [len(b.text) for b in page]))
    return out


#: How many labelled pages of each family train the field: the documented bound of the classifier's sample.
TRAIN_PAGES, SEED = 300, 20240301


def trained(n: int = TRAIN_PAGES, seed: int = SEED, families: tuple[str, ...] = FAMILIES) -> Crf:
    return fit([(fs, y) for fs, y, _ in labelled(n, seed, families)])


def measured(crf: Crf, n: int, seed: int, families: tuple[str, ...]) -> tuple[float, float]:
    """Precision and recall of the article's characters over newly drawn pages."""
    both = found = there = 0
    for fs, y, size in labelled(n, seed, families):
        for got, want, k in zip(crf.decode(fs), y, size, strict=True):
            both, found, there = both + k * (got and want), found + k * got, there + k * want
    return both / max(1, found), both / max(1, there)


def main_text(crf: Crf, page: str | None) -> str:
    found = blocks(page)
    return " ".join(b.text for b, y in zip(found, crf.decode(features(found)), strict=True) if y)


def extract(pages: DataFrame, crf: Crf | None = None, page_id: str = "page_id", url: str = "url", body: str = "html") -> DataFrame:
    """page_id, url, text, n_chars for every row.

    Null and empty html, and pages without an article block, give the empty text. Repeated rows are treated alike,
    and so are very long pages, which are taken whole, one at a time in a task; an empty table gives no rows; other
    columns, whatever their names, are not read.
    """
    model = ship(pages.sparkSession).sparkContext.broadcast(crf or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "html"):
                texts = [main_text(model.value, p) for p in part["html"].to_pylist()]
                yield pa.record_batch([part["page_id"], part["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(body).alias("html"))
    kinds = [f.dataType.simpleString() for f in rows.schema]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
