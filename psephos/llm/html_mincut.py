"""HTML extraction by minimum cut.

A page's text blocks are the nodes of a graph. A linear classifier gives each
its log-odds of being content, which become its capacity from the source (for
content) or to the sink (for boilerplate). Neighbouring blocks, and blocks near
in the DOM, are tied by smoothness edges. The blocks on the source's side of
the minimum cut, found by max-flow, are the main text.
"""

from __future__ import annotations

import html
import re
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements by their part in a page.
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = set("head noscript template svg math object select button datalist canvas audio video map".split())
BOILERPLATE = set("nav footer aside form menu dialog header".split())
MAIN = set("article main".split())
#: Words of class, id and role that mark boilerplate or content.
BAD = re.compile(
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|share|sharing|social|related|recommend\w*|sidebar|side-?bar|aside|comments?|commentlist|disqus|repl(?:y|ies)|respond|discussion|menu|nav|navbar|navigation|breadcrumbs?|footer|header|masthead|login|signup|sign-up|search|pagination|pager|toolbar|widgets?|copyright|legal|disclaimer|contentinfo|complementary|tags?)"
)
#: Hints under which article elements are items of a list, not the main text.
ITEMS = re.compile(r"(?:comments?|commentlist|disqus|repl(?:y|ies)|respond|discussion|related|recommend\w*)")
#: First parts of classes that name a state or subject of the page (has-sidebar, tag-science).
ABOUT = set("has no not with without is tag tags category".split())
GOOD = re.compile(r"(?<![a-z])(?:article|articlebody|main|content|post|entry|story|text|body)(?![a-z])")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: An attribute's name and value; a quote opens a value only right after the sign.
_VALUE = r"""=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>))"""
_ATTRIBUTE = re.compile(rf"""([^\s=>/]++)\s*+({_VALUE})?""")
_TAG = re.compile(rf"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|{_VALUE})*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)

#: The classifier: log-odds of content.
BIAS, IN_MAIN, HINT_GOOD, HINT_BAD, HINT_PART, IN_BOILERPLATE = 0.5, 3.0, 2.0, -6.0, -4.0, -9.0
BY_TAG = {"p": 1.0, "h1": 0.8, "h2": 0.8, "h3": 0.6, "h4": 0.6, "pre": 0.8, "blockquote": 0.8, "li": -0.5, "legend": -1.0, "option": -4.0}
PER_WORD, MOST_WORDS, LINKED, SENTENCE, RIGHTS = 0.04, 50, -4.0, 0.5, -2.0
#: Smoothness: neighbours; and more for the same parent; blocks two apart with the same parent.
NEXT, SIBLING, SECOND = 0.4, 0.8, 0.3


def hint(words: str) -> tuple[float, bool]:
    """Weight of the boilerplate words in class, id and role, and whether they mark a list of items.

    A word counts as a whole class, less as a part of one, and not at all in
    names like has-x, no-x and tag-x.
    """
    worst, items = 0.0, False
    for name in words.split():
        parts = re.split(r"[^a-z]+", name)
        if BAD.fullmatch(name):
            worst = HINT_BAD
        elif parts[0] not in ABOUT and any(map(BAD.fullmatch, parts)):
            worst = min(worst, HINT_PART)
        else:
            continue
        items = items or any(map(ITEMS.fullmatch, parts))
    return worst, items


def marks(attributes: str) -> tuple[str, bool]:
    """(class, id and role words, whether hidden) of a tag's attributes."""
    words, hidden = [], False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value[1:].strip()
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        if name in ("class", "id", "role", "itemprop"):
            words.append(value.lower())
        elif name == "hidden":
            hidden = hidden or value.lower() != "false"
        elif name == "aria-hidden":
            hidden = hidden or value.strip().lower() == "true"
        elif name == "style":
            hidden = hidden or bool(UNSEEN.search(value))
    return " ".join(words), hidden


def blocks(page: str) -> list[tuple[str, float, int]]:
    """(text, log-odds, parent) of each block of the page with text, in order."""
    out: list[tuple[str, float, int]] = []
    # an open element: tag, number, best hint, worst hint, hidden, worst that an article or main inside keeps
    stack: list[tuple[str, int, float, float, bool, float]] = [("", 0, 0.0, 0.0, False, 0.0)]
    text: list[str] = []
    linked, number, at, link_depth = 0, 0, 0, 0

    def flush():
        nonlocal text, linked
        if text:
            raw = "".join(text)
            whole = " ".join(html.unescape(raw).split())
            if whole and not stack[-1][4]:
                holder = next((e for e in reversed(stack) if e[0] in BLOCK), stack[0])
                k = stack.index(holder)
                parent = stack[k - 1][1] if holder[0] in BY_TAG and k else holder[1]
                n = whole.count(" ") + 1
                score = BIAS + BY_TAG.get(holder[0], 0.0) + PER_WORD * min(n, MOST_WORDS) + stack[-1][2] + stack[-1][3]
                score += LINKED * min(1.0, linked / len(whole)) + SENTENCE * (whole[-1] in ".!?…:;\"'”") + RIGHTS * ("©" in whole)
                out.append((whole, score, parent))
        text, linked = [], 0

    for m in _TAG.finditer(page):
        if m.start() < at:
            continue  # within raw text
        if m.start() > at:
            text.append(page[at : m.start()])
            if link_depth:
                linked += m.start() - at
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue  # a comment or declaration
        attributes = m[3] or m[6] or ""
        if m[1] or m[4]:
            if tag in BLOCK:
                flush()
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if k:
                del stack[k:]
            if tag == "a":
                link_depth = max(0, link_depth - 1)
            elif tag in BLOCK:
                link_depth = 0
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?![a-z0-9])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag == "br":
            text.append(" ")
        if tag in VOID:
            if tag in BLOCK:
                flush()
            continue
        if tag in BLOCK:
            flush()
            link_depth = 0
            if tag == "body":
                stack[:] = [e for e in stack if e[0] != "head"]
            closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p" or stack[i][0] in closes:
                    del stack[i:]
                    break
                if stack[i][0] in BLOCK:
                    break
        elif tag == "a":
            link_depth += 1
        if attributes.rstrip().endswith("/") and tag not in BLOCK:
            continue
        _, _, good, bad, hidden, kept = stack[-1]
        if tag in MAIN:
            bad = kept  # a container's hint does not veto it
        if attributes:
            words, unseen = marks(attributes)
            if words and tag not in ("html", "body"):
                if GOOD.search(words):
                    good = max(good, HINT_GOOD)
                worst, items = hint(words)
                if tag not in MAIN:
                    bad = min(bad, worst)
                if items and (tag not in MAIN or worst == HINT_BAD):
                    bad = kept = min(kept, IN_BOILERPLATE)
            hidden = hidden or unseen
        if tag in MAIN:
            good = max(good, IN_MAIN)
        if tag in BOILERPLATE:
            bad = kept = min(kept, IN_BOILERPLATE)
        number += 1
        stack.append((tag, number, good, bad, hidden or tag in HIDDEN, kept))
    text.append(page[at:])
    flush()
    return out


def edges(parents: list[int]) -> list[tuple[int, int, float]]:
    """Smoothness edges (i, j, capacity either way)."""
    n = len(parents)
    out = [(i, i + 1, NEXT + SIBLING * (parents[i] == parents[i + 1])) for i in range(n - 1)]
    return out + [(i, i + 2, SECOND) for i in range(n - 2) if parents[i] == parents[i + 2]]


def source_side(gain: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes stay with the source in the minimum cut.

    ``gain`` > 0 is a node's capacity from the source, < 0 that to the sink.
    Dinic's max-flow: breadth-first levels, then blocking flows along them. A
    node that either side would fit equally stays with the source only if flow
    still reaches it.
    """
    n = len(gain)
    if not ties or min(gain) >= 0 or max(gain) <= 0:
        return [g > 0 for g in gain]
    to, cap, adj = [], [], [[] for _ in range(n)]
    for i, j, c in ties:
        adj[i].append(len(to))
        to.append(j)
        cap.append(c)
        adj[j].append(len(to))
        to.append(i)
        cap.append(c)
    excess = [max(0.0, g) for g in gain]
    room = [max(0.0, -g) for g in gain]
    tiny = 1e-9
    while True:
        level = [0 if x > tiny else -1 for x in excess]
        queue = deque(i for i in range(n) if level[i] == 0)
        reached = False
        while queue:
            i = queue.popleft()
            reached = reached or room[i] > tiny
            for e in adj[i]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[i] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        arc = [0] * n
        for s in range(n):
            while excess[s] > tiny:
                path, i = [], s
                while room[i] <= tiny:
                    while arc[i] < len(adj[i]):
                        e = adj[i][arc[i]]
                        if cap[e] > tiny and level[to[e]] == level[i] + 1:
                            break
                        arc[i] += 1
                    if arc[i] < len(adj[i]):
                        path.append(adj[i][arc[i]])
                        i = to[path[-1]]
                    elif path:
                        i = to[path.pop() ^ 1]
                        arc[i] += 1
                    else:
                        break
                else:
                    flow = min([excess[s], room[i], *(cap[e] for e in path)])
                    excess[s] -= flow
                    room[i] -= flow
                    for e in path:
                        cap[e] -= flow
                        cap[e ^ 1] += flow
                    continue
                break


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    if not found:
        return ""
    keep = source_side([s for _, s, _ in found], edges([p for _, _, p in found]))
    return " ".join(t for (t, _, _), k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text, n_chars`` per row of ``pages``.

    ``text`` is the main text, blocks joined by one space, white space inside a
    block made one space, character references decoded; empty if there is none,
    or the html is null or empty. Nothing is cut off, whatever a page's length.
    Repeated rows give a row each; other columns are not read.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    own = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("__html"))
    kinds = [own.schema[i].dataType.simpleString() for i in range(2)]
    return own.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars bigint")
