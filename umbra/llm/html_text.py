"""HTML extraction: score the tree's containers by their paragraphs and keep the best one and its siblings."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from umbra.llm.common import python_ready, table

TAG = re.compile(r"""</?([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
NAME = re.compile(r"[a-z]+|[0-9]+")
#: Their content is text for the browser, never markup.
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that start and end blocks of text.
BLOCK = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre "
    "figure figcaption address header footer nav aside form fieldset legend details summary center hr menu dialog hgroup search".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of the key ends where one of the values begins.
ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot", "thead"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
#: What bounds the search for such an open element.
SCOPE = frozenset("ul ol dl table body html article section main div td th".split())
#: Elements that never hold the main text.
OUT_TAGS = frozenset(
    "head nav header footer aside menu button select option input label dialog search svg math canvas object audio video map "
    "fieldset legend script style noscript template iframe textarea title".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words in a class or id that speak against an element: alone, as the last word of a name, or as the first before a word for its shape.
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion banner banners nav navbar "
    "navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars sidenav aside footer foot header masthead topbar toolbar cookie "
    "cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay newsletter subscribe "
    "subscription signup login share sharing social socials related recommended recommendations pagination pager comment comments disqus "
    "respond reply replies widget widgets skip form search tags outbrain taboola".split()
)
#: Words that speak against an element wherever they stand in a name.
OUT_ANYWHERE = frozenset("ad ads advert advertisement comment comments disqus sidebar cookie cookies breadcrumb breadcrumbs newsletter sponsored".split())
#: Readers' words are left out however much they write.
READERS = frozenset("comment comments disqus respond reply replies".split())
SHAPES = frozenset(
    "area bar block box button buttons col collapse column container content float grid group holder icons inner item items left link links list mobile outer panel primary "
    "region right row secondary section slot stack strip thread toggle top bottom unit widget widgets wrap wrapper zone text title".split()
)
#: Names that begin like this tell a state or a topic, and so do those that end like that.
ABOUT = frozenset("has with no without is category cat tag topic format type status js".split())
STATES = frozenset("open closed enabled disabled off on count none".split())
FREE, DOUBTFUL, DOOMED = range(3)


def _verdict(tag: str, attributes: str) -> tuple[bool, int]:
    """Whether an element can't hold main text by its nature, and what its names say of it."""
    if tag in OUT_TAGS:
        return True, FREE
    doubt = DOUBTFUL if tag == "form" else FREE
    if not attributes or tag in ("html", "body"):
        return False, doubt
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True, doubt
        if name == "role" and value in OUT_ROLES:
            return True, doubt
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, doubt
        if name in ("class", "id"):
            for each in value.split():
                words = NAME.findall(each)
                while len(words) > 1 and words[-1].isdigit():
                    words.pop()
                if not words or len(words) > 1 and (words[0] in ABOUT or words[-1] in STATES):
                    continue
                if words[-1] in READERS or words[0] in READERS:
                    return False, DOOMED
                if words[-1] in OUT_WORDS or words[0] in OUT_WORDS and words[1] in SHAPES or any(w in OUT_ANYWHERE for w in words):
                    doubt = DOUBTFUL
    return False, doubt


class _Page:
    """Elements by number: parent, tag, whether it is left out, what its names say; blocks of text in page order."""

    def __init__(self) -> None:
        self.parent, self.tag, self.out, self.doubt = [-1], ["#"], [False], {}
        self.blocks: list[list] = []  # element, text, characters in links
        self.piece: list[str] = []
        self.linked = 0

    def flush(self, at: int) -> None:
        if self.piece:
            text = " ".join(entities.unescape("".join(self.piece)).split())
            if text and not self.out[at]:
                self.blocks.append([at, text, min(self.linked, len(text))])
            self.piece, self.linked = [], 0


def _parse(source: str) -> _Page:
    page = _Page()
    stack = [0]  # open elements
    block = [0]  # open block elements
    links = 0
    at, end = 0, len(source)
    no_comment_end = False

    def close(upto: int) -> None:
        """Close open elements down to the stack's length ``upto``; inline ones among them too."""
        nonlocal links
        while len(stack) > upto:
            gone = stack.pop()
            tag = page.tag[gone]
            if tag == "a":
                links -= 1
            if gone == block[-1]:
                page.flush(gone)
                block.pop()

    while at < end:
        lt = source.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            text = source[at:lt]
            if not page.out[stack[-1]]:
                page.piece.append(text)
                if links:
                    page.linked += len(text.strip())
        if lt == end:
            break
        if source.startswith("<!--", lt):
            stop = -1 if no_comment_end else source.find("-->", lt + 4)
            if stop < 0:  # an open comment hides the rest
                break
            at = stop + 3
            continue
        if source.startswith(("<!", "<?"), lt):
            stop = source.find(">", lt)
            at = end if stop < 0 else stop + 1
            continue
        found = TAG.match(source, lt) or LOOSE_TAG.match(source, lt)
        if not found:
            if lt + 1 < end and (source[lt + 1].isalpha() or source[lt + 1] == "/") and source.find(">", lt) < 0:
                break  # a tag cut off at the end of the page
            if not page.out[stack[-1]]:
                page.piece.append("<")
            at = lt + 1
            continue
        at = found.end()
        tag = found[1].lower()
        if source[lt + 1] == "/":
            if tag == "br":
                page.piece.append(" ")
                continue
            if tag in BLOCK and tag != "p" or tag not in BLOCK:
                for i in range(len(stack) - 1, 0, -1):
                    name = page.tag[stack[i]]
                    if name == tag:
                        close(i)
                        break
                    if tag not in BLOCK and name in BLOCK:  # inline ends don't reach over blocks
                        if tag == "a" and links:
                            for j in range(i, 0, -1):
                                if page.tag[stack[j]] == "a":
                                    page.tag[stack[j]] = "a-ended"
                                    links -= 1
                                    break
                        break
            else:
                for i in range(len(stack) - 1, 0, -1):
                    name = page.tag[stack[i]]
                    if name == "p":
                        close(i)
                        break
                    if name in SCOPE:
                        break
                page.flush(block[-1])
            continue
        if tag == "br":
            page.piece.append(" ")
            continue
        if tag in BLOCK:
            page.flush(block[-1])
            for i in range(len(stack) - 1, 0, -1):  # a paragraph ends where a block begins
                name = page.tag[stack[i]]
                if name == "p":
                    close(i)
                    break
                if name in BLOCK:
                    break
            for i in range(len(stack) - 1, 0, -1):
                name = page.tag[stack[i]]
                if tag in ENDS.get(name, ()):
                    close(i)
                    break
                if name in SCOPE and not (tag in ("tr", "tbody", "tfoot", "thead") and name in ("td", "th")):
                    break
        if tag in VOID:
            continue
        self_closed = found[2].endswith("/") and tag not in BLOCK
        number = len(page.tag)
        parent = stack[-1]
        page.parent.append(parent)
        page.tag.append(tag)
        left_out, doubt = (True, FREE) if page.out[parent] else _verdict(tag, found[2])
        if doubt:
            page.doubt[number] = doubt
        if left_out and tag == "header" and not page.out[parent] and any(page.tag[x] in ("article", "main") for x in stack):
            left_out = False  # an article's own header: only its headings are kept
        page.out.append(left_out)
        if tag in RAW:
            close_at = _find_end(source, tag, at)
            at = end if close_at < 0 else (source.find(">", close_at) + 1 or end)
            continue
        if self_closed:
            continue
        stack.append(number)
        if tag in BLOCK:
            block.append(number)
        elif tag == "a":
            links += 1
    close(1)
    page.flush(0)
    return page


_ENDS: dict[str, re.Pattern] = {}


def _find_end(source: str, tag: str, at: int) -> int:
    pattern = _ENDS.get(tag) or _ENDS.setdefault(tag, re.compile(f"</{re.escape(tag)}", re.IGNORECASE))
    found = pattern.search(source, at)
    return found.start() if found else -1


def _points(tag: str, text: str, linked: int) -> float:
    """What a paragraph is worth: one, one for each comma, and up to three for its length."""
    return 0.0 if tag in HEADINGS else 1 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)


def _ancestors(parent: list[int], at: int) -> Iterator[int]:
    while at >= 0:
        yield at
        at = parent[at]


def _dropped(page: _Page, blocks: list[tuple]) -> set[int]:
    """The elements that are left out for their names.

    Names are only hints: an article or main element stays, and so does an element that holds over half
    of the page's points (links discounted) while no article or main element outside it has a quarter as
    many. What readers write goes in any case.
    """
    parent, tags = page.parent, page.tag
    points: dict[int, float] = {}
    for at, text, linked in blocks:
        worth = _points(tags[at], text, linked) * (1 - linked / len(text))
        for up in _ancestors(parent, at):
            points[up] = points.get(up, 0.0) + worth
    homes = [k for k in points if tags[k] in ("article", "main") and page.doubt.get(k) != DOOMED]
    gone: set[int] = set()
    for k, doubt in page.doubt.items():  # parents come before children
        own = points.get(k, 0.0)
        if doubt == DOUBTFUL:
            if tags[k] in ("article", "main"):
                continue
            above = set(_ancestors(parent, k))
            outside = max((points[h] - own * (h in above) for h in homes if k not in _ancestors(parent, h)), default=0.0)
            if own > points[0] / 2 and outside < own / 4:
                continue
        gone.add(k)
    return gone


def extract(source: str | None) -> str:
    """The main text of one page: its blocks in page order, joined by line feeds; empty if there is none."""
    if not source:
        return ""
    page = _parse(source)
    parent, tags = page.parent, page.tag
    readable = []
    for at, text, linked in page.blocks:
        if tags[at] in HEADINGS or not any(tags[up] == "header" for up in _ancestors(parent, at)):
            readable.append((at, text, linked))
    blocks = readable
    if page.doubt and readable:
        gone = _dropped(page, readable)
        # where the names would leave nothing they are wrong
        blocks = [b for b in readable if gone.isdisjoint(_ancestors(parent, b[0]))] or readable
    if not blocks:
        return ""
    score: dict[int, float] = {}
    chars: dict[int, int] = {}
    links: dict[int, int] = {}
    for at, text, linked in blocks:
        points = _points(tags[at], text, linked)
        holder = at if tags[at] not in ("p", "pre", "blockquote", "li", "td", "th", "dd", "dt", "figcaption") and tags[at] not in HEADINGS else max(parent[at], 0)
        share, up = 1.0, holder
        depth = 0
        while up >= 0:
            score[up] = score.get(up, 0.0) + points * share
            depth += 1
            share = 0.5 if depth == 1 else share * 2 / 3
            up = parent[up]
        up = at
        while up >= 0:
            chars[up] = chars.get(up, 0) + len(text)
            links[up] = links.get(up, 0) + linked
            up = parent[up]
    final = {k: v * (1 - links.get(k, 0) / chars[k]) for k, v in score.items() if chars.get(k)}
    bonus = {k: v * (1.5 if tags[k] in ("article", "main") else 1.0) for k, v in final.items()}
    best = max(bonus, key=lambda k: (bonus[k], -k))
    up = parent[best]
    while up > 0:  # sections of one article belong together
        if tags[up] in ("article", "main"):
            best = up
            break
        up = parent[up]
    kept = {best}
    if parent[best] >= 0 and tags[best] not in ("html", "body", "#", "main"):
        least = max(min(10.0, 0.5 * final[best]), 0.2 * final[best])
        home = parent[best]
        for k in {_child_under(parent, at, home) for at, _, _ in blocks} - {best, None}:
            dense = links.get(k, 0) / chars[k]
            if tags[k] in HEADINGS and k < best and dense < 0.5:
                kept.add(k)
            elif final.get(k, 0.0) >= least and dense < 0.3:
                kept.add(k)
            elif tags[k] == "p" and (chars[k] > 80 and dense < 0.25 or chars[k] <= 80 and not links.get(k, 0) and _ends_sentence(blocks, k)):
                kept.add(k)
    if tags[best] in ("html", "body", "#"):
        kept = {best}
    lines = []
    for at, text, linked in blocks:
        up = at
        while up >= 0 and up not in kept:
            up = parent[up]
        if up < 0:
            continue
        if linked and _is_menu(parent, tags, chars, links, at, up):
            continue
        lines.append(text)
    return "\n".join(lines)


def _child_under(parent: list[int], at: int, home: int) -> int | None:
    while at >= 0:
        if parent[at] == home:
            return at
        at = parent[at]
    return None


def _ends_sentence(blocks: list[tuple], at: int) -> bool:
    return any(k == at and text[-1] in ".!?" for k, text, _ in blocks)


def _is_menu(parent: list[int], tags: list[str], chars: dict, links: dict, at: int, top: int) -> bool:
    """Whether a block stands in a list that is mostly links."""
    while at != top and at > 0:
        if tags[at] in ("ul", "ol", "dl", "table") and links.get(at, 0) > 0.6 * chars.get(at, 1):
            return True
        at = parent[at]
    return False


def extract_pages(pages: DataFrame) -> DataFrame:
    """Main text of each page: page_id, url, text and n_chars (code points).

    Elements and roles that hold menus, headers, footers, sidebars, notices, adverts, scripts or styles
    are left out with all they contain, and so are elements whose class or id names such a thing, unless
    they hold most of the page (see ``_dropped``). Every remaining paragraph passes one point, one for
    each comma and one for each 100 characters (three at most) to its container, half to the next and
    less beyond; points are discounted by link density. The best container and those siblings that look
    like text are kept, whole and in page order.

    Defined cases: null, empty or textless html gives an empty text; unclosed and stray tags, open
    comments and pages cut short are read as browsers do; repeated rows stay repeated; other columns
    of the input are ignored.
    """
    python_ready(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [extract(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    types = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {types['page_id']}, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
