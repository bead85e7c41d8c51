"""Main text of web pages by tree scoring."""

from __future__ import annotations

import heapq
import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bound_batches

#: Elements whose text belongs to the block around them.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are read up to their end tag without looking at markup.
RAW = frozenset("script style textarea title iframe xmp noembed noframes".split())
#: Elements that are never main text.
STRIP = frozenset(
    "nav footer aside form script style noscript template iframe object svg canvas button select option textarea head title menu dialog audio video xmp noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of a class or an id that mark what is not main text.
HINTS = frozenset(
    "ad ads advert adverts advertisement adsense banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies disqus disclaimer footer gdpr header masthead "
    "menu menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup promo promoted promotion related "
    "reply replies respond share sharing sidebar sidenav signup social sponsor sponsored subscribe subscription taboola toolbar topbar widget widgets".split()
)
#: Words that say nothing of their own beside a hint: `comment-list` is a list of comments, but `related-work` is not a related box.
PLAIN = frozenset(
    "area articles aside b bar block body bottom box boxes btn button close col column container content cont element entries fixed float form global head holder icon icons inline inner item items js "
    "l large left link links list lists main mobile module more nav outer page panel post posts primary r right row secondary section site slot small sm md lg static stories sticky text title tools top "
    "ul unit us wrap wrapper zone".split()
)
#: Hints that what readers wrote is below, which may be longer than the article.
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
#: What a mark means: nothing, weighed by what the page has besides, the same but for readers' comments, or never main text.
NONE, SOFT, COMMENTS, HARD = 0, 1, 2, 3
#: Elements that are marked by their name alone, but may hold the article if their tag isn't closed or wraps the page.
BOXES = frozenset("nav footer aside form menu noscript".split())
#: A start tag of the first kind ends an open element of the second.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

START = re.compile(r"<(?:(?P<comment>!--)|[!?]|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*))")
COMMENT_END = re.compile("--!?>")
QUOTE_OR_END = re.compile("[>\"']")
ATTR = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?|"[^"]*"|'[^']*'""")
#: Elements that hold a block of text of their container.
LEAVES = frozenset("p li pre blockquote td dd dt h1 h2 h3 h4 h5 h6".split())
NOT_WORD = re.compile(r"[^a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Page:
    """The tree of a page: per element its name, parent and whether it looks like no main text; and its blocks of text."""

    names: list[str] = field(default_factory=lambda: ["#root"])
    parents: list[int] = field(default_factory=lambda: [0])
    marks: list[int] = field(default_factory=lambda: [NONE])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def hinted(value: str) -> int:
    """The mark of a class or an id: one of its names is a hint, alone or with plain words, as in `footer`, `adSlot3` or `comment-list`."""
    out = NONE
    for name in value.split():
        words = {x.rstrip("0123456789") for x in NOT_WORD.split(CAMEL.sub("-", name).lower())} - {""}
        if not HINTS.isdisjoint(words) and words <= HINTS | PLAIN:
            out = max(out, SOFT if READERS.isdisjoint(words) else COMMENTS)
    return out


def mark(name: str, attrs: str) -> int:
    """HARD for elements that are never main text and what is hidden, SOFT for boxes, hints and roles."""
    if name in STRIP:
        return SOFT if name in BOXES else HARD
    out, seen = NONE, set()
    for key, a, b, c in ATTR.findall(attrs) if attrs and name not in ("html", "body") else ():
        key, value = key.lower(), a or b or c
        if not key or key in seen:
            continue  # of an attribute's values the first counts
        seen.add(key)
        if key in ("class", "id"):
            out = max(out, hinted(value))
        elif key == "role" and value.lower() in ROLES:
            out = max(out, SOFT)
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and "display:none" in value.replace(" ", "").lower():
            out = HARD
    return out


def tag_end(source: str, at: int) -> int:
    """Behind the > that ends a tag whose attributes start at `at`; a > in quotes doesn't, unless a quote isn't closed."""
    place = at
    while found := QUOTE_OR_END.search(source, place):
        if found[0] == ">":
            return found.end()
        place = source.find(found[0], found.end()) + 1
        if not place:
            return source.find(">", at) + 1 or len(source)
    return len(source)


def parse(source: str) -> Page:
    """Reads the page once; time is in proportion to its length, however deep it nests."""
    page, stack = Page(), [0]
    places: dict[str, list[int]] = defaultdict(list)  # of each name the depths of its open elements
    text: list[str] = []
    linked, link_from = 0, 0  # characters of the block's text within links; the depth at which the open link began, or 0

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join("".join(text).split())
            if words:
                page.blocks.append((stack[-1], words, min(linked, len(words))))
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal link_from
        flush()
        for node in stack[depth:]:
            places[page.names[node]].pop()
        del stack[depth:]
        if link_from > depth:
            link_from = 0

    def last(name: str) -> int:
        return places[name][-1] if places[name] else 0

    def add(piece: str) -> None:
        nonlocal linked
        piece = html.unescape(piece)  # a reference doesn't go beyond a tag
        text.append(piece)
        if link_from:
            linked += len(piece)

    at = 0
    while found := START.search(source, at):
        if found.start() > at:
            add(source[at : found.start()])
        if found["comment"]:
            end = COMMENT_END.search(source, found.end())
            at = end.end() if end else len(source)
            continue
        if not found["name"]:
            at = source.find(">", found.end()) + 1 or len(source)
            continue
        at = tag_end(source, found.end())
        name = found["name"].lower()
        if found["end"]:
            if name == "a":
                link_from = 0
            elif name not in INLINE:
                depth = last(name)
                if depth and not (name == "p" and depth < len(stack) - 1 or name == "li" and depth < max(last("ul"), last("ol"))):
                    close(depth)
            continue
        if name == "br":
            add(" ")
        elif name == "a":
            link_from = link_from or len(stack)
        elif name not in INLINE:
            flush()
            top = page.names[stack[-1]]
            if name in CLOSES:
                for depth in range(len(stack) - 1, 0, -1):
                    if page.names[stack[depth]] in CLOSES[name]:
                        close(depth)
                    elif page.names[stack[depth]] not in ("p", "tr", "td", "th"):
                        break
            elif top == "p" or top in HEADINGS and name in HEADINGS:
                close(len(stack) - 1)  # a block ends an open paragraph
            if name in VOID:
                continue
            page.names.append(name)
            page.parents.append(stack[-1])
            page.marks.append(max(mark(name, source[found.end() : at].removesuffix(">")), SOFT if name == "header" and not (places["article"] or places["main"]) else NONE))
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}", re.I).search(source, at)
                at = end.start() if end else len(source)
            places[name].append(len(stack))
            stack.append(len(page.names) - 1)
    if at < len(source):
        add(source[at:])
    flush()
    return page


def summed_up(values: list[float], parents: list[int], share: float) -> list[float]:
    """Each element's own value and `share` of its children's."""
    out = list(values)
    for i in range(len(out) - 1, 0, -1):
        out[parents[i]] += share * out[i]
    return out


def stripped(page: Page) -> list[bool]:
    """Of each element whether it, or one around it, is left out.

    A softly marked element is weighed against the page: it stays out if the text outside of all marked
    ones is at least a quarter of its own; comments stay out if there is a paragraph, an article or a main element outside. Otherwise it holds the page, not a part beside it: if
    it has such an element itself the mark falls, largest elements first, and the marked ones in it are weighed in turn. Text counts without links.
    """
    names, parents, marks = page.names, page.parents, list(page.marks)
    n = len(names)
    hard = [False] * n
    for i in range(1, n):
        hard[i] = hard[parents[i]] or marks[i] == HARD
    text, prose = [0.0] * n, [0.0] * n
    for node, words, linked in page.blocks:
        if not hard[node]:
            text[node] += len(words) - linked
            prose[node] += names[node] == "p"
    for i in range(1, n):
        prose[i] += names[i] in ("article", "main")
    text, prose = summed_up(text, parents, 1), summed_up(prose, parents, 1)
    above, below = [0] * n, defaultdict(list)  # the marked element around each, and the marked ones right below
    for i in range(1, n):
        above[i] = parents[i] if marks[parents[i]] in (SOFT, COMMENTS) else above[parents[i]]
        if marks[i] in (SOFT, COMMENTS):
            below[above[i]].append(i)
    outside, paragraphs = (x[0] - sum(x[i] for i in below[0]) for x in (text, prose))
    heap = [(-text[i], i) for i in below[0]]
    heapq.heapify(heap)
    while heap:
        size, i = heapq.heappop(heap)
        if outside >= -size / 4:
            break
        if prose[i] > 0 and not (marks[i] == COMMENTS and paragraphs > 0):
            marks[i] = NONE
            outside += text[i] - sum(text[k] for k in below[i])
            paragraphs += prose[i] - sum(prose[k] for k in below[i])
            for k in below[i]:
                heapq.heappush(heap, (-text[k], k))
    out = [False] * n
    for i in range(1, n):
        out[i] = out[parents[i]] or marks[i] != NONE
    return out


def main_text(source: str | None) -> str:
    """The blocks of the best container and of its siblings that score like it, in page order, joined by spaces.

    A block gives its parent points for its length and commas, less by the part of it
    that is links, the grandparent half of them and those above ever less. What stripped() leaves out
    gets and keeps nothing. If the best container lies in an article or in the main element, that is the container;
    lists and boxes in it that are links for the most part are left.
    """
    page = parse(source or "")
    names, parents = page.names, page.parents
    n = len(names)
    gone = stripped(page)
    blocks = [x for x in page.blocks if not gone[x[0]]]
    points, size, links, count = [0.0] * n, [0] * n, [0] * n, [0] * n
    for node, text, linked in blocks:
        up = parents[node] if names[node] in LEAVES else node
        points[up] += (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text)) * (0.2 if names[node] in HEADINGS else 1)
        size[node] += len(text)
        links[node] += linked
        count[node] += 1
    points[0] = 0.0
    score = summed_up(points, parents, 0.5)
    size, links, count = (summed_up(x, parents, 1) for x in (size, links, count))
    score = [0.0] + [score[i] * (1 - links[i] / size[i]) if size[i] else 0.0 for i in range(1, n)]
    best = max(range(n), key=lambda i: (score[i], -i))
    if not score[best]:
        kept = {0}
    else:
        up = best
        chain = [up]
        while up := parents[up]:
            chain.append(up)
        home = next((i for i in chain if names[i] == "article"), None) or next((i for i in chain if names[i] == "main"), None)
        best = home or best
        top = max(score[best], max((score[i] for i in chain), default=0.0))
        kept = {best}
        if names[best] not in ("main", "body", "html"):
            kept |= {i for i in range(1, n) if parents[i] == parents[best] and score[i] >= max(2.0, 0.2 * top) and (names[i] == names[best] or not home)}
            if not home:  # loose paragraphs beside the best container
                for node, text, linked in blocks:
                    if names[node] == "p" and parents[node] == parents[best] and (len(text) > 80 and linked < 0.25 * len(text) or not linked and re.search(r"[.!?]( |$)", text)):
                        kept.add(node)
    inside = [i in kept for i in range(n)]
    for i in range(1, n):
        lists = names[i] not in LEAVES and count[i] > 1 and links[i] > 0.6 * size[i]
        inside[i] = inside[i] or inside[parents[i]] and not lists
    return " ".join(text for node, text, _ in blocks if inside[node])


def extract(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Per row of pages: the columns in keep, text string and n_chars long (its code points).

    The whole page is read, however long. Null and empty pages and pages without
    main text give an empty text. Markup that is broken off or not closed is read
    as browsers do, roughly. Rows are independent: repeated rows each give
    their text; no rows give no rows. Other columns, and such named text or n_chars, are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(batch.num_columns - 1)]
            made = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=[*batch.schema.names[:-1], "text", "n_chars"])

    bound_batches(pages.sparkSession)
    rows = pages.select(*[F.col(f"`{x}`") for x in keep or [] if x not in ("text", "n_chars")], F.col(html_col).alias("_html"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]] + ["text string", "n_chars long"])
    return rows.mapInArrow(run, schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])
