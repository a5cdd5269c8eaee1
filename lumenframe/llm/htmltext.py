"""Main text of web pages by two passes of block rules: decide by density and length, then let neighbours decide the rest."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import map_arrow

#: Elements that begin and end a block of text, and those of them that are parts of a text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
#: Elements without content, and elements whose content is no text.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd address center figure figcaption details summary table thead tbody tfoot tr caption hr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "object", "canvas", "math", "title")
#: Of these, the ones that hold all the rest of a page if they aren't closed.
RAW = frozenset("script style textarea title".split())
#: Elements that are never part of an article, and words in class, id and role that say the same.
BOILER_TAGS = frozenset("nav footer aside form button select menu dialog head".split())
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices gdpr popup modal overlay"
    " newsletter subscribe subscription share sharing social sidebar widget related recommended recommendations teaser menu nav navbar navigation breadcrumb breadcrumbs"
    " pagination pager footer header masthead topbar toolbar comment comments reply replies disqus discussion respond login signup register search copyright legal"
    " contentinfo complementary alert hidden skip".split()
)
#: Of these, names of reader comments, sidebars, notices, adverts and newsletters. What they hold is no article.
FINAL_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent notice notices gdpr popup newsletter subscribe subscription"
    " sidebar comment comments reply replies disqus discussion respond breadcrumb breadcrumbs pagination pager login signup register".split()
)
#: Parts of a class that name the state of an element around something, not what the element is.
STATE_WORDS = frozenset("has no not with without is overflow hide show visually until if js on off".split())
#: Frequent function words of the languages that pages are in.
STOP = frozenset(
    "the of and to in a is that it was for on with as by at this are be or from an not have has he she they which"
    " der die das und ist nicht von zu den mit im des auf für ein eine dem es sich auch an als er sie wie bei oder einer in"
    " le la les de des et un une est en que qui dans pour pas sur par au du il elle se ce plus avec ne sont ou"
    " el los las y del se no por con para su lo al como más pero sus una es".split()
)
#: Characters of a long and of a medium block; shares of stop words of running text and of likely text; share of linked text in a menu.
LONG, MEDIUM = 140, 60
STOP_HIGH, STOP_LOW = 0.2, 0.08
LINKED = 0.4
#: Share of linked letters at which even an article's block is a list of links; white space counts as unlinked.
LINKED_MAIN = 0.7

#: A comment, a declaration or a tag. Attributes may hold quoted ">"; a tag with an unclosed quote ends at its first ">".
#: No alternative gives back what it has taken, so pages take linear time.
_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^<>]*>|(/?)([a-zA-Z][^\s/<>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPLIT = re.compile(r"[^a-z]+")
_HEADING = re.compile(r"h[1-6]")


@dataclass
class Block:
    """A block's text and what the rules look at; ``heading`` is 1 to 6 or 0; ``label`` is True for text, False for the rest, None if undecided."""

    text: str
    linked: int
    boiler: bool
    main: bool
    heading: int
    soft: int = -1
    art: int = -1
    box: int = -1
    label: bool | None = None


def _attributes(attrs: str) -> dict[str, str]:
    """Attributes by lower-case name; of equal names the first counts."""
    found: dict[str, str] = {}
    for m in _ATTR.finditer(attrs):
        found.setdefault(m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "").lower())
    return found


def _named(token: str, words: frozenset[str]) -> bool:
    """Whether a class, id or role is or has one of ``words``, but for states such as has-sidebar; ``hidden`` as the whole of it only."""
    parts = set(_SPLIT.split(token))
    return token in words or STATE_WORDS.isdisjoint(parts) and not (words - {"hidden"}).isdisjoint(parts)


def _boiler(tag: str, attrs: str, in_main: bool) -> str:
    """``hard`` if the element is boilerplate for certain, ``final`` or ``weak`` if only its class, id or role says so, else empty."""
    if tag in BOILER_TAGS or tag == "header" and not in_main:
        return "hard"
    if not attrs or tag in ("html", "body", "main"):
        return ""
    has = _attributes(attrs)
    if "hidden" in has or has.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", has.get("style", "")):
        return "hard"
    names = [t for k in ("class", "id", "role") if k in has for t in has[k].split()]
    return "final" if any(_named(t, FINAL_WORDS) for t in names) else "weak" if any(_named(t, BOILER_WORDS) for t in names) else ""


def _running(block: Block) -> bool:
    """Whether a block is text of some length with few links, wherever it stands."""
    return len(block.text) >= MEDIUM and block.linked <= LINKED * len(block.text)


def _chain(at: int, up: list[int]) -> list[int]:
    out = []
    while at >= 0:
        out.append(at)
        at = up[at]
    return out


def _settle(blocks: list[Block], softs: list[tuple[int, bool]], arts: list[tuple[int, int, bool]]) -> None:
    """Makes blocks in soft elements boilerplate, by what the elements are; how much text they hold doesn't count.

    ``softs`` has the enclosing soft element of each, and whether its name is final; ``arts`` that of each article or
    main element: the enclosing one, its soft element, and whether it is an article. A soft element is no boilerplate
    if it wraps the article: an article or main element with a heading of the first level, or with any text where no
    running text is outside of soft elements. Without such a text in place, that is where all running text is in soft
    elements, those around the first one that a heading leads are opened, else those around the first one; names that
    are final are opened for that only if nothing but links is outside of them.
    """
    if not softs:
        return
    up, above = [a for a, _ in softs], [a for a, _, _ in arts]
    plain = [b for b in blocks if not b.boiler]
    prose = lambda b: b.linked <= LINKED * len(b.text)
    has = [[False, False, False] for _ in arts]  # text that is no list of links, such text outside of soft elements, a first heading
    for b in plain:
        if b.art >= 0:
            has[b.art] = [x or y for x, y in zip(has[b.art], (prose(b), b.soft < 0, b.heading == 1), strict=True)]
    for i in range(len(arts) - 1, -1, -1):
        if above[i] >= 0:
            has[above[i]] = [x or y for x, y in zip(has[above[i]], has[i], strict=True)]
    none_free = not any(b.soft < 0 and _running(b) for b in plain)
    own = [i for i, (_, soft, _) in enumerate(arts) if has[i][0] and has[i][1] and soft < 0]
    wrapped = [i for i, (_, soft, _) in enumerate(arts) if has[i][0] and soft >= 0 and (has[i][2] or none_free)]
    chosen = {i for i in own or wrapped if arts[i][2]} or {*own} or {*wrapped}
    opened: set[int] = set()
    if chosen and not own:
        chosen = {min((i for i in chosen if has[i][2]), default=min(chosen))}
        opened.update(_chain(arts[min(chosen)][1], up))
    inside = [False] * len(arts)
    for i, a in enumerate(above):
        inside[i] = i in chosen or a >= 0 and inside[a]
    final = [False] * len(softs)  # an element or one around it that isn't opened has a final name
    for i, (a, named) in enumerate(softs):
        final[i] = i not in opened and (named or a >= 0 and final[a])
    place = [b for b in plain if not chosen or b.art >= 0 and inside[b.art]]
    shown = [b for b in place if b.soft < 0 or b.soft in opened]
    if not any(map(_running, shown)):
        bare = not any(map(prose, shown))
        hidden = [(final[b.soft], not led, i) for i, (b, led) in enumerate(zip(place, _led(place), strict=True)) if _running(b) and (bare or not final[b.soft])]
        if hidden:
            opened.update(_chain(place[min(hidden)[2]].soft, up))
    for b in blocks:
        b.boiler = b.boiler or b.soft >= 0 and b.soft not in opened


def _led(blocks: list[Block]) -> list[bool]:
    """Whether the block before each is a heading or one that a heading leads, within one soft element."""
    out: list[bool] = []
    for i, b in enumerate(blocks):
        out.append(i > 0 and blocks[i - 1].soft == b.soft and (blocks[i - 1].heading > 0 or out[-1]))
    return out


def blocks_of(page: str) -> list[Block]:
    """The page's non-empty blocks in order. Broken markup is read as browsers do: what isn't a tag is text."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int, int, int]] = []  # tag, boiler for certain, main, soft element, article, element that holds the text's parts
    softs: list[tuple[int, bool]] = []
    arts: list[tuple[int, int, bool]] = []
    opened: Counter = Counter()
    unclosed: set[str] = set()
    parts: list[tuple[str, bool]] = []
    heading = links = at = boxes = 0

    def end_block() -> None:
        nonlocal heading
        text = " ".join("".join(p for p, _ in parts).split())
        if text:
            boiler, main, soft, art, box = stack[-1][1:] if stack else (False, False, -1, -1, -1)
            out.append(Block(text, sum(len("".join(p.split())) for p, linked in parts if linked), boiler, main, heading, soft, art, box))
        parts.clear()
        heading = 0

    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at:
            parts.append((html.unescape(page[at : m.start()]), links > 0))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in NO_TEXT:
            if not closing and not attrs.endswith("/") and tag not in unclosed:
                close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
                if close is not None:
                    at = close.end()
                elif tag in RAW:
                    at = len(page)
                else:
                    unclosed.add(tag)
            continue
        if tag == "a":
            links = max(0, links - 1) if closing else links + 1
            continue
        if tag in ("br", "td", "th"):
            parts.append((" ", links > 0))
        if tag in BLOCKS:
            end_block()
            links = links if closing else 0
        if tag in VOID:
            continue
        if closing:
            if opened[tag] and tag not in BLOCKS:
                end_block()  # the end of an inline advert or the like
            while opened[tag] and stack:
                last = stack.pop()[0]
                opened[last] -= 1
                if last == tag:
                    break
            continue
        if stack and tag in BLOCKS and stack[-1][0] == "p":
            opened["p"] -= 1
            stack.pop()
        boiler, main, soft, art, box = stack[-1][1:] if stack else (False, False, -1, -1, -1)
        kind = "" if boiler else _boiler(tag, attrs, main)
        boiler = boiler or kind == "hard"
        if tag in BLOCKS or opened[tag] or kind:
            if (boiler or kind) and tag not in BLOCKS:
                end_block()
            if kind in ("final", "weak"):
                softs.append((soft, kind == "final"))
                soft = len(softs) - 1
            if tag in ("article", "main") and not boiler:
                arts.append((art, soft, tag == "article"))
                art = len(arts) - 1
            if tag in BLOCKS - TEXT_TAGS or kind:
                boxes += 1
                box = boxes
            stack.append((tag, boiler, not boiler and (main or tag in ("article", "main")), soft, art, box))
            opened[tag] += 1
        heading = heading or (int(tag[1]) if _HEADING.fullmatch(tag) else 0)
    if at < len(page):
        parts.append((html.unescape(page[at:]), links > 0))
    end_block()
    _settle(out, softs, arts)
    return out


def _runs(block: Block) -> bool:
    """Long text with few links: running text in whatever language, unless its place says otherwise."""
    return not block.boiler and len(block.text) >= LONG and block.linked <= LINKED * len(block.text) / 2


def decide(block: Block, has_main: bool) -> bool | None:
    """First pass: what a block's place, length, links and stop words say about it alone.

    Inside an article the same rules hold with other limits: fewer stop words and more links make it text.
    """
    if block.boiler or has_main and not block.main:
        return False
    n = len(block.text)
    if not block.main and n < LONG and block.text.startswith("©"):
        return False
    if block.linked > (LINKED_MAIN if block.main else LINKED) * n:
        return False
    words = block.text.lower().split()
    stop = sum(w.strip(".,;:!?\"'()") in STOP for w in words) / len(words)
    if n >= LONG and (stop >= STOP_HIGH or block.main and stop >= STOP_LOW):
        return True
    if n >= MEDIUM and stop >= STOP_HIGH and block.linked <= LINKED * n / 2:
        return True
    if n >= LONG and stop < STOP_LOW and not _runs(block) or not block.main and block.linked and n < MEDIUM:
        return False
    return None


def _holds_article(blocks: list[Block]) -> bool:
    """Whether article and main elements hold the page's article: not if a text that a first-level heading leads is outside of them and none inside.

    An article with running text and without a heading of its own counts if the heading outside leads nothing but it.
    """
    seen = [b for b in blocks if not b.boiler]
    inside = [b for b in seen if b.main]
    outside = any(a.heading == 1 and not a.main and not b.main and _running(b) for a, b in zip(seen, seen[1:], strict=False))
    return bool(inside) and not (outside and not any(b.heading == 1 for b in inside))


def _nearest(blocks: list[Block]) -> list[tuple[tuple[int, bool] | None, tuple[int, bool] | None]]:
    """For each block the nearest decided ones before and after it, as (steps, label).

    Blocks of the same element are nearest. Without one there, those of the page count, but none behind a heading: what
    comes before a heading doesn't belong to what it leads.
    """
    def pass_over(order: list[int], barred: bool) -> list[tuple[int, bool] | None]:
        found: list[tuple[int, bool] | None] = [None] * len(blocks)
        last, by_box = None, {}
        for i in order:
            b = blocks[i]
            found[i] = (by_box.get(b.box), last)
            if b.label is not None:
                last = by_box[b.box] = (i, b.label)
            if barred and b.heading:
                last = None
        return found

    n, out = len(blocks), []
    for i, (p, q) in enumerate(zip(pass_over(list(range(n)), False), pass_over(list(range(n - 1, -1, -1)), True), strict=True)):
        own = p[0] or q[0]
        out.append(tuple(x and (abs(x[0] - i), x[1]) for x in ((p[0], q[0]) if own else (p[1], q[1]))))
    return out


def _before_title(blocks: list[Block]) -> list[Block]:
    """Blocks before a page's only first-level heading and outside of its element, if that element holds the text that it leads."""
    titles = [i for i, b in enumerate(blocks) if b.heading == 1 and not b.boiler]
    if len(titles) != 1:
        return []
    title = blocks[titles[0]]
    leads = title.box >= 0 and any(b.box == title.box and not b.boiler and not b.heading and _running(b) for b in blocks[titles[0] :])
    return [b for b in blocks[: titles[0]] if b.box != title.box] if leads else []


def main_text(page: str | None) -> str:
    """The article's blocks, one a line.

    An article begins with its heading: what stands before the only first-level heading, in another element, is no text.
    Second pass: an undecided block takes the label of the nearest decided block before or after it, of those in the
    same element if there is one; the nearer one counts if they differ, the better one if they are equally near, and a
    heading goes with what follows. Inside an article or main element only its own blocks are neighbours, and without a
    decided one the blocks outside boilerplate are text. Undecided long text with few links, as in a language without
    known stop words, is text if a decided neighbour is or if the page has no decided text at all; if there is no such
    text either, what a heading leads is.
    """
    blocks = blocks_of(page or "")
    has_main = _holds_article(blocks)
    for b in blocks:
        b.main = b.main and has_main
        b.label = decide(b, has_main)
    for b in _before_title(blocks):
        b.label = False
    seen = [b for b in blocks if not b.boiler and (b.main or not has_main)] if has_main else blocks
    if not any(b.label for b in seen):
        long = [b for b in seen if b.label is None and _runs(b)]
        for b in long or [b for b, led in zip(seen, _led(seen), strict=True) if led and b.label is None]:
            b.label = True
    for b, (p, q) in zip(seen, _nearest(seen), strict=True):
        if b.label is None:
            if p is None and q is None:
                b.label = not b.boiler
            elif p is None or q is None:
                b.label = (p or q)[1]
            elif _runs(b):
                b.label = p[1] or q[1]
            elif b.heading:
                b.label = q[1]
            else:
                b.label = max((-p[0], p[1]), (-q[0], q[1]))[1]
    return "\n".join(b.text for b in blocks if b.label)


def extract(df: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), page: str = "html") -> DataFrame:
    """``keep`` columns, text (the main text of the whole page, empty if none) and n_chars (its code points).

    Null and empty pages give the empty text. Pages are taken one by one; repeated rows give repeated rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"k{i}" for i in range(len(keep))]
        for b in batches:
            texts = [main_text(x) for x in b["h"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[n] for n in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    read = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keep)), F.col(page).alias("h"))
    types = dict(read.dtypes)
    schema = "".join(f"k{i} {types[f'k{i}']}, " for i in range(len(keep))) + "text string, n_chars long"
    return map_arrow(read, run, schema).select(*(F.col(f"k{i}").alias(k) for i, k in enumerate(keep)), "text", "n_chars")
