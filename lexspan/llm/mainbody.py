"""Problem 3: the main body of web pages, by composite text density.

A tolerant parser builds the DOM (unclosed and misnested tags keep what follows inside them, as a
browser does). For every node the composite text density weighs characters per tag by the share
of link characters and link tags. The sum of the densities of its children tells how much of a
node's text stands side by side in dense children; the node with the largest sum, held against
the least density on its path to the body, is the core of the page.

The subtree with the largest sum is the core, taken among the nodes that hold the page's title line or
begin right below it (any node, where no line repeats the title). Only lines of the core are main body, and
of those only the stretch around its dense lines, dense being what reaches the threshold of the path. What belongs to the text
but stands outside or is sparse (title, docket, cited cases, signature) is added at the stretch's edges:
sparse lines only, without a break.

An exact check then trims what was selected: side elements, links, counters, menus, advertisements, notices.

Lines are numbered from 1 and split at line feeds. Defined results: null and empty pages, pages
without a body and pages whose core has too little running text have no lines. A page's rows
depend on its html alone, so repeated rows repeat its lines.
"""

from __future__ import annotations

import html as _html
import math
import re

from pyspark.sql import DataFrame

from .arrowmap import arrow_map

#: What a page without a line repeating its title must have to count as a text, in sentences and characters.
LEAST_SENTENCES, LEAST_CHARS = 3, 250
#: How many lines (title, docket and the like) may stand above the first dense line.
EDGE_LINES = 3

_TAG = re.compile(r"<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']++|\"[^\"\n]*+\"|'[^'\n]*+')*+)>|<(/?)([a-zA-Z][\w:-]*)([^<>]*+)>")
#: Elements whose content is no text, with what ends them.
_RAW = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript", "template", "svg")}
_DECLARATION = re.compile(r"<!\[?[A-Za-z][^<>]*+>")
_TITLE = re.compile(r"<title\b[^<>]*+>", re.I)
_TITLE_END = re.compile(r"</title\s*>|</head", re.I)
_BODY = re.compile(r"<body\b[^<>]*+>", re.I)
_VOID = frozenset("br hr img input meta link col area base wbr source embed param".split())
#: Opening one of these ends an open paragraph.
_BLOCK = frozenset("p div table ul ol dl pre blockquote h1 h2 h3 h4 h5 h6 form header footer section article aside nav main hr center fieldset".split())
_ENDS = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_SIDE_TAGS = frozenset("aside footer nav small label button select textarea".split())
_PASSING = frozenset("table tbody thead tr ul ol dl".split())
_INLINE = frozenset("a b strong font span em i u center h1 h2 h3 p".split())
_SPACE = re.compile(r"\s+")

#: Words by which page remains give themselves away, whatever their place. Seen after entities are decoded and case is folded.
_SIGN = re.compile(r"(?:ã‚)?[âβв]?\W?©\s|\W*\(c\)\s*\d{4}\b", re.I)
_FOOTER = re.compile(
    r"all rights reserved|δικαιώματα διατηρούνται|hakları saklıdır|provided for information|not legal advice|no liability for|παρέχεται για ενημέρωση|νομική συμβουλή|δεν φέρει ευθύνη|bilgi amaçlıdır|hukuki görüş|sorumluluk kabul"
    r"|^\W*(?:last updated|updated on|τελευταία ενημέρωση|son güncelleme|visits|page views|επισκέψεις|ziyaret(?:ler|çi)?)\W*[:\d]"
    r"|^(?:terms|privacy|sitemap|όροι χρήσης|απόρρητο|χάρτης ιστοτόπου|koşullar|gizlilik|site haritası)\s*[|·]"
)
_ASIDE = re.compile(
    r"^(?:advertisement|sponsored|διαφήμιση|reklam|back to top|top of page|επιστροφή στην κορυφή|başa dön|sayfa başına dön|yukarı dön|print|share|save|εκτύπωση|κοινοποίηση|paylaş|yazdır)\W*$"
    r"|^(?:share|κοινοποίηση|paylaş|print|εκτύπωση|yazdır|save|kaydet)(?:\s*[·|/,•-]\s*[\w ]{2,20})+$"
    r"|^(?:read also|see also|διαβάστε επίσης|δείτε επίσης|ayrıca okuyun|bunu da okuyun|ayrıca bakınız|okuyun)\W*:"
)
_STOP = re.compile(r"[.!?;;؟।][»”\")]?\s|[。！？]")
_BETWEEN = re.compile(r"\s[|·•>/]\s")
_LETTER = re.compile(r"[^\W\d_]")
_SIDE_HEAD = re.compile(r"^(?:see also|δείτε επίσης|ayrıca bakınız|popular|δημοφιλ|popüler|related|σχετικ|ilgili|tags|ετικέτες|etiketler|subscribe|εγγραφή|newsletter|bülten)")
_CITED = re.compile(r"\S\s+(?:v|vs|ν|κ|к|-|–)\.?\s+\S.*\d+\s*/\s*\d{4}")


def _tokens(html: str, at: int):
    """(start, end, name, whether it closes, attributes) of tags from ``at``; comments and raw elements have no name.

    Linear in any input: what has no end (a comment, a script) is looked for once.
    """
    absent: set[str] = set()
    while (at := html.find("<", at)) >= 0:
        if html.startswith("<!--", at) and "--" not in absent:
            end = html.find("-->", at + 4)
            if end >= 0:
                yield at, end + 3, None, False, ""
                at = end + 3
                continue
            absent.add("--")
        m = _TAG.match(html, at)
        if m:
            closes, name, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            name = name.lower()
            if not closes and name in _RAW and name not in absent:
                end = _RAW[name].search(html, m.end())
                if end:
                    yield at, end.end(), None, False, ""
                    at = end.end()
                    continue
                absent.add(name)
            yield at, m.end(), name, bool(closes), attrs
            at = m.end()
        elif m := _DECLARATION.match(html, at):
            yield at, m.end(), None, False, ""
            at = m.end()
        else:
            at += 1


class _Page:
    """Nodes in document order; a line's text runs with the node each stands in."""

    def __init__(self, html: str):
        body = _BODY.search(html)
        at = body.end() if body else 0
        title = _TITLE.search(html)
        ended = _TITLE_END.search(html, title.end()) if title else None
        self.title = _clean(html[title.end() : ended.start()]) if ended else ""
        self.parent, self.tag, self.attrs, self.close = [-1], ["body"], [""], [None]
        self.chars, self.links, self.tags, self.link_tags = [0], [0], [0], [0]
        self.closed = {0}  # nodes with an end tag of their own
        self.runs: list[tuple[int, int, bool, str]] = []  # line, node, in a link, text
        stack, link, line, seen = [0], 0, 1 + html.count("\n", 0, at), at
        if not body:  # without a body tag the head must not count
            at = seen = ended.end() if ended else 0
            line = 1 + html.count("\n", 0, at)
        opened: dict[str, int] = {}
        for start, stop, name, closes, attrs in _tokens(html, at):
            if start > seen:
                line = self._text(html[seen:start], line, stack[-1], link > 0)
            seen = stop
            if name is None:
                line += html.count("\n", start, stop)
                continue
            if closes:
                while opened.get(name):
                    node = stack.pop()
                    self.close[node] = line
                    opened[self.tag[node]] -= 1
                    link -= self.tag[node] == "a"
                    if self.tag[node] == name:
                        self.closed.add(node)
                        break
            elif name in _VOID:
                self.tags[stack[-1]] += 1
                if name == "hr":
                    self.runs.append((line, stack[-1], False, ""))
            elif name not in ("html", "head", "body"):
                ends = _ENDS.get(name, ("p",) if name in _BLOCK else ())
                while ends and len(stack) > 1 and self.tag[stack[-1]] in ends or name in _ENDS and len(stack) > 1 and self.tag[stack[-1]] == "p":
                    opened[self.tag[stack[-1]]] -= 1
                    self.close[stack.pop()] = line
                node = len(self.tag)
                self.parent.append(stack[-1])
                self.tag.append(name)
                self.attrs.append(attrs)
                self.close.append(None)
                self.chars.append(0)
                self.links.append(0)
                self.tags.append(0)
                self.link_tags.append(0)
                stack.append(node)
                opened[name] = opened.get(name, 0) + 1
                link += name == "a"
            line += html.count("\n", start, stop)
        if seen < len(html):
            self._text(html[seen:], line, stack[-1], link > 0)

    def _text(self, text: str, line: int, node: int, link: bool) -> int:
        if not text or text.isspace():
            return line + text.count("\n")
        for part in text.split("\n"):
            if part and not part.isspace() and (part := _clean(part)):
                self.runs.append((line, node, link, part))
                self.chars[node] += len(part)
                if link:
                    self.links[node] += len(part)
            line += 1
        return line - 1

    def density(self) -> tuple[list[float], list[float]]:
        """Composite text density of each node, and the sum of its children's."""
        n, parent = len(self.tag), self.parent
        chars, links, tags, link_tags = self.chars, self.links, self.tags, self.link_tags
        for i in range(n - 1, 0, -1):
            p = parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (self.tag[i] == "a")
        share = links[0] / chars[0] if chars[0] else 0.0
        holds = {p for i, p in enumerate(parent) if i and self.tag[i] != "a"}
        bearer = list(range(n))  # what was never closed has no extent of its own: its children count for the node around
        ctd, total = [0.0] * n, [0.0] * n
        for i in range(n):
            ctd[i] = _composite(chars[i], tags[i] or 1, links[i], link_tags[i], share)
            if i:
                if i in holds and i not in self.closed:
                    bearer[i] = bearer[parent[i]]
                else:
                    total[bearer[parent[i]]] += ctd[i]
        for _, node, link, text in self.runs:  # text beside elements counts as a child without a tag
            if node in holds:
                total[bearer[node]] += _composite(len(text), 1, len(text) * link, link, share)
        return ctd, total

    def finish(self) -> None:
        """Nodes are numbered in document order: a node's descendants are those up to its last one."""
        n = len(self.tag)
        self.last = list(range(n))
        for i in range(n - 1, 0, -1):
            if self.last[i] > self.last[self.parent[i]]:
                self.last[self.parent[i]] = self.last[i]
        self.side = [-1] * n  # the nearest node around that is no part of a body
        for i in range(1, n):
            self.side[i] = i if self.tag[i] in _SIDE_TAGS else self.side[self.parent[i]]

        blocks = [0] * n
        for i in range(1, n):
            blocks[self.parent[i]] += self.tag[i] not in _INLINE or self.tag[i] in _BLOCK
        #: nodes with several blocks side by side; tables, lists and what was never closed only pass text on
        self.container = [i == 0 or i in self.closed and blocks[i] > 1 and self.tag[i] not in _PASSING for i in range(n)]

    def within(self, node: int) -> list[int]:
        """The node and those around it, up to the container whose blocks they are."""
        out = [node]
        while not self.container[node]:
            node = self.parent[node]
            out.append(node)
        return out

    def inside(self, node: int, region: int) -> bool:
        return region <= node <= self.last[region]

    def above(self, node: int) -> list[int]:
        out = [node]
        while node:
            node = self.parent[node]
            out.append(node)
        return out


def _clean(text: str) -> str:
    if "&" in text:
        text = _html.unescape(text)
    return _SPACE.sub(" ", text).strip()


def _composite(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, weighed by how little of them are links; ``share`` is that of link characters in the page."""
    if not chars:
        return 0.0
    base = math.log(chars / ((chars - link_chars) or 1) * link_chars + share * chars + math.e)
    return chars / tags * math.log(max(chars / (link_chars or 1) * tags / (link_tags or 1), 1.0)) / math.log(max(base, 1.0001))


def _figures(text: str) -> str:
    return re.sub(r"[^\d/]", "", text)


def core(page: _Page, allowed: set[int] | None = None) -> tuple[int, float, list[float]]:
    """The node with the largest density sum (of those allowed), the threshold of its path to the body, and all densities.

    A node without an end tag has no extent of its own and is no core.
    """
    ctd, total = page.density()
    best = max(sorted(page.closed if allowed is None else page.closed & allowed) or [0], key=total.__getitem__)
    blocks = [ctd[i] for i, p in enumerate(page.parent) if p == best and ctd[i]]
    # in pages without links a node of many tags weighs more than any block in it: its blocks' mean bounds the threshold
    threshold = min([ctd[i] for i in page.above(best)] + ([sum(blocks) / len(blocks)] if blocks else []))
    return best, threshold, ctd


def _title_line(page: _Page, lines: dict, texts: dict[int, str]) -> int | None:
    """The line repeating the page's title, else (damaged titles) one with the same figures, else a main heading."""
    for no, text in texts.items():
        if text == page.title:
            return no
    figures = _figures(page.title)
    if len(figures) >= 5:
        for no, text in texts.items():
            if _figures(text) == figures and len(page.title) <= 2 * len(text) <= 4 * len(page.title) and not _linked(lines[no]):
                return no
    for no in texts:
        node = lines[no][0][0]
        if page.tag[node] in ("h1", "h2") and page.close[node] == no and not _linked(lines[no]) and page.side[node] < 0:
            return no
    return None


def _linked(runs: list) -> bool:
    return any(link for _, link, _ in runs)


def body_lines(html: str | None) -> list[int]:
    if not html or html.isspace():
        return []
    page = _Page(html)
    if not any(page.chars):
        return []
    page.finish()
    lines: dict[int, list[tuple[int, bool, str]]] = {}
    for line, node, link, text in page.runs:
        if text:
            lines.setdefault(line, []).append((node, link, text))
    texts = {no: " ".join(t for _, _, t in runs) for no, runs in lines.items()}
    order = sorted(lines)
    place = {no: i for i, no in enumerate(order)}

    title = _title_line(page, lines, texts)
    if title is None:
        allowed = {node for no in order if not _linked(lines[no]) for node in page.within(lines[no][0][0])}
    else:
        allowed = set(page.within(lines[title][0][0]))
        end = min((c for node in allowed if (c := page.close[node]) is not None and c > title), default=10**9)
        for no in order[place[title] + 1 : place[title] + 1 + EDGE_LINES]:
            # a node begins here if it does not hold the line before
            if no > end or page.side[lines[no][0][0]] >= 0:
                break
            before = set(page.above(lines[order[place[no] - 1]][-1][0]))
            allowed.update(node for node in page.within(lines[no][0][0]) if node not in before)
    best, threshold, density = core(page, allowed)

    # lines of the core that are dense, and the stretch around them within the container they share with the title
    dense = [no for no in order if best in page.within(lines[no][0][0]) and density[lines[no][0][0]] >= threshold and not _linked(lines[no]) and (title is None or no >= title)]
    if title is None:
        dense = [no for no in dense if len(texts[no]) > 40 and not _cut(page, lines, texts, order, place, no)]
        if len(_STOP.findall(" ".join(texts[no] for no in dense) + " ")) < LEAST_SENTENCES or sum(len(texts[no]) for no in dense) < LEAST_CHARS:
            return []
    if not dense:
        return []
    first = next((no for no in dense if no != title), dense[0])
    start, outside = first, 0
    near = {page.within(best)[-1], page.within(page.parent[best] if best else 0)[-1]}
    typical = sum(density[lines[no][0][0]] for no in dense if no != title) / max(1, len(dense) - (title in dense))
    for no in order[: place[first]][::-1]:
        node = lines[no][0][0]
        if start == title or _linked(lines[no]) and no != title or _menu(texts[no]) or _cut(page, lines, texts, order, place, no):
            break
        if not page.inside(node, best):
            outside += 1
            if outside > EDGE_LINES or page.within(node)[-1] not in near or no != title and density[node] >= typical:
                break
        start = no
    # the container that the first dense lines share
    second = next((no for no in dense if no > max(first, start)), first) if start == first else first
    around = set(page.above(lines[second][0][0]))
    holder = next(node for node in page.above(lines[start][0][0]) if node in around and page.tag[node] not in _INLINE)
    if second == start and holder:
        holder = page.parent[holder]
    end = min((c for node in page.above(holder) if (c := page.close[node]) is not None), default=10**9) if holder else 10**9

    out: list[int] = []
    for no in order[place[start] :]:
        node, runs, text = lines[no][0][0], lines[no], texts[no]
        if no > end or no != start and not page.inside(node, holder):
            break
        if no > first:
            if not page.inside(node, best) and density[node] >= typical:
                break  # dense, but not of the core
            if _cut(page, lines, texts, order, place, no):
                break
        if no == start or not _passed_over(page, lines[no], text):
            out.append(no)
    # a rule below the signature ends the body; nothing but the title is no body
    rules = sorted({no for no, node, _, text in page.runs if not text and page.tag[node] != "pre"})
    for rule in rules:
        if out and rule > out[0] and any(no < rule for no in out[1:]):
            out = [no for no in out if no <= rule]
            break
    return out if len(out) > 1 or out and title is None else []


def _folded(text: str) -> str:
    return text.lower().replace("i̇", "i")


def _menu(text: str) -> bool:
    """Short words between separators."""
    parts = _BETWEEN.split(text)
    return len(parts) > 2 and all(len(part.split()) <= 3 for part in parts)


def _cut(page: _Page, lines: dict, texts: dict, order: list[int], place: dict, no: int) -> bool:
    """Whether nothing of the body follows: a side element, a menu, a rights notice, a heading over links."""
    node, text = lines[no][0][0], texts[no]
    if page.side[node] >= 0 or _SIGN.match(text) or text.count(" | ") >= 2 or _FOOTER.search(_folded(text)):
        return True
    if page.tag[node] in ("h3", "h4", "h5", "h6"):
        return _SIDE_HEAD.match(_folded(text)) is not None or _side_list(page, lines, order[place[no] + 1 : place[no] + 2])
    return False


def _passed_over(page: _Page, runs: list, text: str) -> bool:
    """Lines that may stand within the body and don't belong to it: links but citations, page counters, calls to share or read."""
    node = runs[0][0]
    if all(link for _, link, _ in runs) and (page.tag[page.parent[node]] not in ("p", "div", "blockquote", "body") or not _CITED.search(text)):
        return True
    if "«" in text and "»" in text and len(_LETTER.findall(text)) <= 4:
        return True
    return _menu(text) or _ASIDE.search(_folded(text)) is not None or "teaser" in page.attrs[node]


def _side_list(page: _Page, lines: dict, following: list[int]) -> bool:
    """A heading before list items that are links, or before teasers."""
    return any(page.tag[page.parent[n]] == "li" and link or "teaser" in page.attrs[n] for no in following for n, link, _ in lines[no])


def main_body(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, line_no) of the lines of the main body; one pass over two columns."""
    kind = pages.schema[id_col].dataType.simpleString()

    def factory():
        def chunk(cols):
            ids, nos = [], []
            for i, h in zip(*cols):
                found = body_lines(h)
                ids += [i] * len(found)
                nos += found
            return ids, nos

        return chunk

    return arrow_map(pages, [id_col, html_col], f"{id_col} {kind}, line_no int", factory)


def main_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, body) with the text of the main body, null where there is none."""
    kind = pages.schema[id_col].dataType.simpleString()

    def one(h):
        lines = (h or "").split("\n")
        return "\n".join(_clean(re.sub(r"<[^>]*>", "", lines[n - 1])) for n in body_lines(h)) or None

    return arrow_map(pages, [id_col, html_col], f"{id_col} {kind}, body string", lambda: lambda cols: (cols[0], [one(h) for h in cols[1]]))
