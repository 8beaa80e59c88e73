"""Main text of web pages by template deduction over the pages of a host."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, mix, small, trimmed

#: Pages of a host that share a token at least, for it to be of the template.
MIN_SUPPORT = 3
#: Tokens of equal occurrence vectors that make a valid class at least.
MIN_CLASS = 2
#: Share of a slot's text tokens that are of the template, from which the slot is.
TEMPLATE_SHARE = 0.5
#: Share of a host's pages that hold a block at least, for the block itself to be of the template: a quote stays.
HOST_SHARE = 0.5
#: Tokens whose counts a task holds before it sends them.
HELD_TOKENS = 200_000

# Elements by role.
RAW = frozenset("script style textarea title xmp noscript iframe noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary nav header footer aside form fieldset legend hgroup center dialog menu select option hr".split())
ENDS_P = BLOCKS - {"html", "body"}
SKIPPED = frozenset("nav footer aside form head script style title noscript iframe template textarea button select option dialog menu svg object canvas audio video map".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
SKIPPED_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist cookie cookies consent disqus footer foot gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription tags toolbar topbar widget widgets".split())
#: Names of comments: these go wherever they stand, a nested article too.
COMMENT_NAMES = frozenset("comment comments commentlist disqus replies reply".split())
#: Names that an article's own parts have as well: within one, and on headings and paragraphs, they only vote.
VOTING_NAMES = frozenset("banner consent foot footer header login masthead notice notices promo promoted promotion respond search social tags".split())
#: First words of names that say what a part has, lacks or is beside.
MODIFIERS = frozenset("has hide hides is no not show shows with without".split())
#: Last words of names that say no more than that a part is one.
CONTAINERS = frozenset("area bar block body bottom box container content form group inner item items left links list main outer panel right section thread top wrap wrapper".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p blockquote pre".split())
MAIN = frozenset(("article", "main"))
ROOTS = frozenset(("html", "body"))

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_NAMES = re.compile(r"\b(class|id|role|hidden|aria-hidden)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


def _named(token: str) -> str | None:
    """The skipped name that a whole class token or id stands for: itself, its last word, or its first before words for containers."""
    words = [w for w in _SPLIT.split(token) if w]
    if not words or words[0] in MODIFIERS:
        return None
    if words[-1] in SKIPPED_NAMES:
        return words[-1]
    rest = [w for w in words[1:] if not w.isdigit()]
    return words[0] if words[0] in SKIPPED_NAMES and all(w in CONTAINERS for w in rest) else None


def _attributes(text: str) -> tuple[str, bool, frozenset[str]]:
    """Class, id and role as a sorted key, whether role or hiding rule out main text, and the skipped names among classes and id."""
    if not text or text.isspace():
        return "", False, frozenset()
    key, skip, names = [], False, set()
    for name, value in _NAMES.findall(text):
        name, value = name.lower(), value.strip("\"'").lower()
        words = [w for w in _SPLIT.split(value) if w]
        if name in ("class", "id"):
            key.append(f"{name}={' '.join(re.sub(r'[0-9]+', '0', w) for w in words)}")
            names.update(n for n in map(_named, value.split()) if n)
        elif name == "role":
            skip |= not SKIPPED_ROLES.isdisjoint(words)
        elif name == "hidden":
            skip = True
        elif value == "true":
            skip = True
    return ";".join(key), skip, frozenset(names)


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _bit(k: int) -> int:
    """A signed 64-bit integer with bit k set."""
    return 1 << k if k < 63 else -(1 << 63)


class Element:
    """An open element: its place in the page's skeleton, and what is known of it."""

    __slots__ = ("hint", "inside", "name", "path", "skip", "slot")

    def __init__(self, name: str, above: Element | None, key: str, skip: bool, slots: dict[str, int], names: frozenset[str] = frozenset()) -> None:
        self.name = name
        self.path = f"{above.path if above else ''}/{name}{'[' + key + ']' if key else ''}"
        self.inside = bool(above and above.inside) or name in MAIN
        within = bool(above and above.inside)
        votes = names and (within or name in HEADINGS)
        by_name = not VOTING_NAMES.issuperset(names) if votes else bool(names)
        own = skip or name in SKIPPED or by_name or (name == "header" and not within)
        exempt = name in ("html", "body") or (name in MAIN and COMMENT_NAMES.isdisjoint(names))
        self.skip = (above.skip if above else False) or (own and not exempt)
        self.hint = bool(votes) or (above.hint if above else False)
        if self.path not in slots:
            slots[self.path] = _hash(self.path)
        self.slot = slots[self.path]


_SLOTS: dict[str, int] = {}
#: 31 bits, so that sums over 2^32 pages fit a long.
_MARK = (1 << 31) - 1
_ROOT = Element("html", None, "", False, _SLOTS)


def blocks_of(page: str) -> Iterator[tuple[Element, str, tuple[int, ...]]]:
    """(element, text, slots above) of each block with text, in page order.

    A block ends where a block element begins or ends. A paragraph ends before another
    block; an end tag closes down to its element if that is open, and inline end tags
    close no block. What is open at the end of the page is closed.
    """
    if len(_SLOTS) > 100_000:
        _SLOTS.clear()
    stack: list[Element] = []
    text: list[str] = []
    at, size = 0, len(page)

    def flush() -> Iterator[tuple[Element, str, tuple[int, ...]]]:
        if text:
            found = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if found and stack:
                k = len(stack) - 1
                while k and stack[k].name not in BLOCKS:
                    k -= 1
                yield stack[k], found, tuple(e.slot for e in stack[: k + 1])

    stack.append(Element("html", None, "", False, _SLOTS))
    while at < size:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            if not stack[-1].skip or stack[-1].name not in RAW:
                text.append(page[at : m.start()])
        at = m.end()
        closed, opened = m[1], m[2]
        if closed:
            name = closed.lower()
            if name in VOID:
                if name == "br":
                    text.append(" ")
                continue
            k = len(stack) - 1
            inline = name not in BLOCKS
            while k and stack[k].name != name and not (inline and stack[k].name in BLOCKS):
                k -= 1
            if k and stack[k].name == name:
                if any(e.name in BLOCKS or e.skip != stack[k - 1].skip for e in stack[k:]):
                    yield from flush()
                del stack[k:]
        elif opened:
            name = opened.lower()
            key, skip, names = _attributes(m[3])
            if name in VOID:
                if name in BLOCKS:
                    yield from flush()
                elif name == "br":
                    text.append(" ")
                continue
            if name in ("html",):
                continue
            if name in BLOCKS or name in SKIPPED or skip or names:
                yield from flush()
                if name in ENDS_P:
                    closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(name, ()) + ("p",)
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k].name in closes:
                            del stack[k:]
                            break
                        if stack[k].name in BLOCKS and stack[k].name not in ("p", "li", "dt", "dd", "td", "th", "tr", "option"):
                            break
            if m[3].rstrip().endswith("/") and name not in BLOCKS and name not in RAW:
                continue
            element = Element(name, stack[-1], key, skip, _SLOTS, names)
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|$)", re.I).search(page, at)
                at = end.end() if end else size
                continue
            stack.append(element)
    yield from flush()


def _host(url) -> object:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)", 1))


def tokens(pages: DataFrame) -> DataFrame:
    """(host, slot, token, pages, occurrences, vector, also_vector, seen, also_seen) of the tokens of all pages, summed per task.

    A token is a text block at its slot, or an element. ``vector`` and ``also_vector`` sum,
    over its pages, two hashes of the page with the number of occurrences there: tokens of
    equal occurrence vectors have equal sums. ``seen`` and ``also_seen`` have a bit set for each
    content of its pages, by two hashes: copies of a page set the same, so there are at
    least as many different pages as bits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list[int]] = {}

        def send() -> pa.RecordBatch:
            keys, sums = list(held), list(held.values())
            held.clear()
            columns = [*(list(c) for c in zip(*keys, strict=True)), *(list(c) for c in zip(*sums, strict=True))] if keys else [[]] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["host", "slot", "token", "pages", "occurrences", "vector", "also_vector", "seen", "also_seen"])

        for batch in batches:
            for host, page, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count: dict[tuple[int, int], int] = {}
                for element, block, slots in blocks_of(text or ""):
                    count[element.slot, _hash(block)] = count.get((element.slot, _hash(block)), 0) + 1
                    for s in slots:
                        count[s, 0] = count.get((s, 0), 0) + 1
                if count:
                    places, blocks = (np.array(c, np.int64).view(np.uint64) for c in zip(*count, strict=True))
                    content = int(mix(mix(places) + blocks * np.uint64(0x9E3779B97F4A7C15) + np.fromiter(count.values(), np.uint64, len(count))).sum())
                    seen, also = (_bit(content >> k & 63) for k in (0, 32))
                    marks = mix(np.fromiter(count.values(), np.uint64, len(count)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(page & 0xFFFFFFFFFFFFFFFF)).view(np.int64).tolist()
                    for ((slot, token), n), mark in zip(count.items(), marks, strict=True):
                        if (sums := held.get((host, slot, token))) is None:
                            held[host, slot, token] = [1, n, mark >> 33 & _MARK, mark & _MARK, seen, also]
                        else:
                            sums[0] += 1
                            sums[1] += n
                            sums[2] += mark >> 33 & _MARK
                            sums[3] += mark & _MARK
                            sums[4] |= seen
                            sums[5] |= also
                if len(held) > HELD_TOKENS:
                    yield send()
        yield send()

    got = pages.select(F.xxhash64("host").alias("host"), F.xxhash64("page_id", "url", F.length("html")).alias("page"), "html").mapInArrow(trimmed(run), "host long, slot long, token long, pages long, occurrences long, vector long, also_vector long, seen long, also_seen long")
    return got.groupBy("host", "slot", "token").agg(F.sum("pages").alias("pages"), F.sum("occurrences").alias("occurrences"), F.sum("vector").alias("vector"), F.sum("also_vector").alias("also_vector"), F.bit_or("seen").alias("seen"), F.bit_or("also_seen").alias("also_seen"))


def template_slots(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, slot, token, sure) of what belongs to a host's template: whole slots have token 0, the others are single blocks.

    Tokens of a host with equal occurrence vectors form a class; it is valid with
    MIN_CLASS tokens or more on MIN_SUPPORT different pages or more. A slot whose text
    tokens, each as often as it occurs, are to TEMPLATE_SHARE in valid classes is of the
    template. So is a block of a valid class that stands on HOST_SHARE of the host's pages;
    another block of a valid class is not ``sure``, and only goes where its element's name
    says so too.
    """
    counted = scratch.put(tokens(pages), "tokens")
    often = counted.filter((F.col("pages") >= MIN_SUPPORT) & (F.greatest(F.bit_count("seen"), F.bit_count("also_seen")) >= MIN_SUPPORT))
    valid = often.groupBy("host", "vector", "also_vector").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= MIN_CLASS).select("host", "vector", "also_vector")
    fixed = often.filter("token <> 0").join(valid, ["host", "vector", "also_vector"], "left_semi")
    total = counted.filter("token <> 0").groupBy("host", "slot").agg(F.sum("occurrences").alias("total"))
    filled = fixed.groupBy("host", "slot").agg(F.sum("occurrences").alias("fixed")).join(total, ["host", "slot"]).filter(F.col("fixed") >= TEMPLATE_SHARE * F.col("total"))
    whole = counted.filter((F.col("slot") == _ROOT.slot) & (F.col("token") == 0)).select("host", F.col("pages").alias("all_pages"))
    single = fixed.join(whole, "host").select("host", "slot", "token", (F.col("pages") >= HOST_SHARE * F.col("all_pages")).alias("sure"))
    return filled.select("host", "slot", F.lit(0).cast("long").alias("token"), F.lit(True).alias("sure")).union(single)


def main_text(page: str, slots: set[int], blocks: set[int] | None = None, unsure: set[int] = frozenset()) -> str:
    """Blocks outside the template and outside parts that aren't main text.

    ``slots`` are the template's, ``blocks`` its single blocks (slot and token by
    exclusive or). In an article or a main element, and right in html or body, only a
    block itself can be of the template; ``unsure`` ones are where a name votes for it.
    Without ``blocks`` the page stands alone, with
    no host to deduce from: then an article or a main element, if there is one, is all.
    """
    found = [(e, text) for e, text, _ in blocks_of(page) if not e.skip]
    if blocks is None:
        inside = [x for x in found if x[0].inside]
        return "\n\n".join(text for e, text in inside or found if e.inside or e.slot not in slots)
    return "\n\n".join(text for e, text in found if not (e.slot in slots and not e.inside and e.name not in ROOTS) and (not (blocks or (e.hint and unsure)) or ((key := e.slot ^ _hash(text)) not in blocks and not (e.hint and key in unsure))))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page.

    Each host's template is deduced from all its pages (``template_slots``); what varies
    is kept, unless its element is a menu, a footer, a form, comments or the like by name
    (whole class tokens; VOTING_NAMES within an article only add to the evidence).
    Text beside an article is judged like any other, and a notice that a host repeats
    within its articles goes; what less than HOST_SHARE of its pages repeat stays there,
    since pages may quote each other. White space in a block becomes one space, blocks are
    joined by two newlines. Null or empty html gives an empty text; a null url has the
    empty host; repeated rows are taken each; other columns are ignored; an empty table
    gives no rows. Pages are parsed where they lie: only counts of tokens are shuffled,
    and pages only if the template slots of all hosts are too many to broadcast.
    """
    bound_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")).withColumn("host", _host(F.col("url")))
    scratch = Scratch(pages.sparkSession)
    slots = scratch.put(template_slots(rows, scratch), "slots")
    by_host = slots.groupBy("host").agg(F.collect_set(F.when(F.col("token") == 0, F.col("slot"))).alias("slots"), *(F.collect_set(F.when((F.col("token") != 0) & (F.col("sure") == sure), F.col("slot").bitwiseXOR(F.col("token")))).alias(name) for name, sure in (("blocks", True), ("unsure", False)))).withColumnRenamed("host", "_host")
    # Written first, so that sets of a host are gathered once and their bytes are known.
    by_host = scratch.keep(by_host, "by_host")
    joined = rows.join(small(by_host, 8 * (F.size("slots") + F.size("blocks") + F.size("unsure"))), F.xxhash64("host") == F.col("_host"), "left").select("page_id", "url", "html", "slots", "blocks", "unsure")
    scratch.close()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, *(set(x or ()) for x in known)) for page, *known in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(trimmed(run), "page_id long, url string, text string, n_chars long")
