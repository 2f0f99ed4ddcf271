"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block; what stands in elements that
never hold the article (menus, forms, scripts and the like, told by element or
role, or by a class or id unless the element turns out to wrap the content)
weighs nothing. The weights (characters outside links, and a bonus in an article
or main element that is mostly unlinked text) are summed over sliding windows of
lines; the text starts where the sums surge and ends where they dive, and the
lines between are kept.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window, and the characters of a window at which the text surges.
WINDOW, SURGE = 3, 80

# Elements by role.
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
_SKIPPED = {"nav", "footer", "aside", "form", "button", "select", "svg", "canvas", "object", "audio", "video", "dialog", "menu", "head", "math", "map"}
_INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time",
    "tt", "u", "var", "wbr", "br",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_ARTICLE = {"article", "main"}
_CLOSES_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_INSERTS = (
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|newsletter|subscribe|signup|popup|modal|overlay|"
    r"comments?|comment-list|respond|disqus|reply|replies|related|recommend\w*|share|sharing|social|login)"
)
_PARTS = (
    r"(?:banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|side-bar|aside|widget|footer|foot|masthead|site-header|header|topbar|toolbar|"
    r"pagination|pager|skip|search)"
)
_INSERT_NAMES, _PART_NAMES = (re.compile(rf"(?:^|[\s_-]){x}(?:$|[\s_-])") for x in (_INSERTS, _PARTS))
#: In an article a name counts only as a whole, with words for kinds of boxes around it: "share-buttons", not "share-price".
_BOX = r"box|block|list|container|wrapper|wrap|section|widget|buttons?|bar|links?|area|form|slot|unit|message|items?|panel|inner|content|icons?|header|title"
_IN_ARTICLE_INSERT, _IN_ARTICLE_PART = (re.compile(rf"(?:^|\s)(?:(?:post|article|entry|page|site|user|reader|blog|main|inline)[_-])?{x}(?:[_-](?:{_BOX}|{_INSERTS}))*(?:$|\s)") for x in (_INSERTS, _PARTS))
_OWN_INSERT = re.compile(rf"(?:^|\s){_INSERTS}(?:$|\s)")
#: Names that tell what a page has or lacks, not what the element is.
_SAYS = re.compile(r"(?<!\S)(?:\S*[_-])?(?:no|has|with|without)[_-]\S*|\S*[_-](?:free|open|closed|enabled|disabled)(?!\S)")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu", "menubar"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WHITE = re.compile(r"\s+")


@dataclass
class Line:
    text: str
    linked: int  # characters in links, white space apart
    boiler: bool  # by element or role
    article: int  # number of the innermost article or main, 0 outside
    name: int  # the innermost element around it that is named like boilerplate, -1 if none


@dataclass
class Named:
    insert: bool  # named like an advertisement, a notice or comments, not like a part of the layout
    article: int  # the innermost article around it, or itself; 0 outside
    before: int  # articles up to it, itself included
    parent: int  # the next named element around it, -1 if none
    main: bool = False  # holds a main element


def lines_of(page: str) -> tuple[list[Line], list[Named]]:
    """The blocks of a page in order, markup stripped and references decoded, and the elements named like boilerplate."""
    out: list[Line] = []
    named: list[Named] = []
    articles = 0
    buffer: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, int, int]] = []  # element, boilerplate, article, named element
    places: dict[str, list[int]] = {}  # of each element's name on the stack
    outside = (False, 0, -1)
    boiler, article, inside = outside
    links = 0

    def last(name: str) -> int:
        held = places.get(name)
        return held[-1] if held else -1

    def cut(depth: int) -> None:
        nonlocal boiler, article, inside
        while len(stack) > depth:
            places[stack.pop()[0]].pop()
        boiler, article, inside = stack[-1][1:] if stack else outside

    def close() -> None:
        nonlocal buffer, linked
        text = _WHITE.sub(" ", entities.unescape("".join(buffer))).strip()
        if text:
            out.append(Line(text, linked, boiler, article, inside))
        buffer, linked = [], 0

    def add(text: str) -> None:
        nonlocal linked
        buffer.append(text)
        if links:
            linked += len(_WHITE.sub("", text))

    at, n = 0, len(page)
    while at < n:
        token = _TOKEN.search(page, at)
        if token is None:
            add(page[at:])
            break
        if token.start() > at:
            add(page[at : token.start()])
        at = token.end()
        if token[3] is not None and page[at - 1] != ">":  # a quote that never ends: the tag ends at the next bracket
            at = page.find(">", at) + 1 or n
        if token[1] is not None:
            add(token[1])
            continue
        name = token[3]
        if name is None:
            continue
        name = name.lower()
        if token[2]:
            if name == "a":
                links = max(0, links - 1)
            depth = last(name)
            if name == "p" and depth < 0:
                close()
            if depth >= 0:
                if name not in _INLINE:
                    close()
                cut(depth)
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>|\Z", re.I).search(page, at)
            at = end.end()
            if name not in _INLINE:
                close()
            continue
        if name == "br":
            add(" ")
            continue
        if name not in _INLINE:
            close()
            if name in _CLOSES_P and last("p") >= 0:
                cut(last("p"))
                links = 0
            if name == "li" and last("li") > max(last("ul"), last("ol")):
                cut(last("li"))
        if name in _VOID or token[4].rstrip().endswith("/"):
            continue
        if name == "a":
            links += 1
        strong, weak = _boiler_names(name, token[4], article > 0)
        boiler = boiler or name in _SKIPPED or (name == "header" and not article) or strong
        if name in _ARTICLE and not boiler:
            articles += 1
            article = articles
            k = inside if name == "main" and not weak else -1
            while k >= 0 and not named[k].main:
                named[k].main, k = True, named[k].parent
        if weak and not boiler:
            named.append(Named(weak == "insert", article, articles, inside))
            inside = len(named) - 1
        places.setdefault(name, []).append(len(stack))
        stack.append((name, boiler, article, inside))
    close()
    return out, named


def _boiler_names(name: str, attributes: str, inside_article: bool) -> tuple[bool, str]:
    """Whether an element is boilerplate by role or hidden; and "insert", "part" or nothing by class and id."""
    weak = ""
    if not attributes or name in ("body", "html"):
        return False, weak
    article = name in _ARTICLE
    for kind, *values in _ATTRIBUTE.findall(attributes):
        value = next((v for v in values if v), "").lower()
        kind = kind.lower()
        if kind == "role" and value in _ROLES:
            return True, weak
        if not article and (kind == "hidden" or (kind == "aria-hidden" and value == "true")):
            return True, weak
        if kind in ("class", "id"):
            if article:  # posts carry the names of their categories and tags: whole names only
                weak = weak or ("insert" if _OWN_INSERT.search(value) else "")
                continue
            value = _SAYS.sub(" ", value)
            insert, part = (_IN_ARTICLE_INSERT, _IN_ARTICLE_PART) if inside_article else (_INSERT_NAMES, _PART_NAMES)
            if insert.search(value):
                weak = "insert"
            elif part.search(value):
                weak = weak or "part"
    return False, weak


def _unlinked(line: Line) -> int:
    return max(0, len(line.text.replace(" ", "")) - line.linked)


def _content(lines: list[Line], named: list[Named], surge: int) -> list[Line]:
    """The lines outside boilerplate. A name is ignored where its element wraps the content.

    That is where it holds a main element, or the most of the text, characters of
    its articles counted twice, or articles that outweigh the text under no name
    while no other article stands there. An advertisement, a notice or comments
    must hold the only articles and the most of the text, or all of it. Where no
    part does and little else is left, names of parts of the layout are ignored.
    """
    lines = [x for x in lines if not x.boiler]
    if not named:
        return lines
    inserted: list[bool] = []  # whether an element is an insert or in one
    for e in named:
        inserted.append(e.insert or (e.parent >= 0 and inserted[e.parent]))
    rest = sum(_unlinked(x) for x in lines if x.name < 0)
    total = sum(_unlinked(x) for x in lines if x.name < 0 or not inserted[x.name])
    bare = any(x.article for x in lines if x.name < 0)
    # Characters in each named element, outside those in it that stay boilerplate: in no article that begins in it, and in one.
    plain, marked = [0] * len(named), [0] * len(named)
    for x in lines:
        if x.name >= 0:
            (marked if x.article > named[x.name].before else plain)[x.name] += _unlinked(x)
    ignored = [False] * len(named)
    for k in range(len(named) - 1, -1, -1):  # inner elements first
        e, text = named[k], plain[k] + marked[k]
        others = total if inserted[k] else total - text
        most, sole = text + marked[k] > others, marked[k] > 0 and not bare
        if e.insert:
            ignored[k] = most and (sole or (others == 0 and text >= surge))
        else:
            ignored[k] = (most and (marked[k] > 0 or text >= surge)) or (sole and text + marked[k] > rest)
        ignored[k] = ignored[k] or (e.main and text > 0)
        if ignored[k] and e.parent >= 0:
            marked[e.parent] += marked[k]
            (marked if e.article > named[e.parent].before else plain)[e.parent] += plain[k]
    for k, e in enumerate(named):  # outer elements first
        ignored[k] = ignored[k] and (e.parent < 0 or ignored[e.parent])
    if rest < surge <= total - rest and not bare and not any(ignored):
        ignored = [not x for x in inserted]
    return [x for x in lines if x.name < 0 or ignored[x.name]]


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The kept lines of a page, joined by line feeds; empty for null, empty and textless pages."""
    lines = _content(*lines_of(page or ""), surge)
    own = [_unlinked(x) for x in lines]
    balance: dict[int, int] = {}  # unlinked less linked characters of each article
    for x, w in zip(lines, own, strict=True):
        if x.article:
            balance[x.article] = balance.get(x.article, 0) + w - x.linked
    marked = [balance.get(x.article, 0) > 0 for x in lines]
    bonus = -(-surge // window)  # a window of lines in an article surges
    weights = [w + bonus if m else w for w, m in zip(own, marked, strict=True)]
    # Windows end where an article begins or ends: neither side lifts the other.
    sums = []
    for k in range(len(lines)):
        end = next((j for j in range(k, min(k + window, len(lines))) if marked[j] != marked[k]), k + window)
        sums.append(sum(weights[k:end]))
    kept: list[str] = []
    k = 0
    while k < len(lines):
        if sums[k] < surge or not weights[k]:
            k += 1
            continue
        start = k  # surge: the window that opens here is full of text
        while k < len(lines) and weights[k] and marked[k] == marked[start]:
            k += 1  # dive: a line without text of its own
        kept.extend(x.text for x in lines[start:k])
    if not kept:
        kept = [x.text for x, w in zip(lines, weights, strict=True) if w]
    return "\n".join(kept)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """A row per page: id, url, text, n_chars (code points).

    Null and empty pages give an empty text. Whole pages are read, nothing is
    capped; the work grows with a page's length however deep it is nested. Nulls and repeats in id and url pass through; an empty table gives
    an empty result; other columns are not read. No shuffle.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, window, surge) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["_id", "_url", "text", "n_chars"])

    source = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    return source.mapInArrow(work, "_id long, _url string, text string, n_chars long").withColumnsRenamed({"_id": id_col, "_url": url_col})
