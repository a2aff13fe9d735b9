"""HTML main text by equivalence classes of template tokens.

1. Every page is read as a sequence of tokens: each start tag (its path from the root, names with class
   and id) and each text block (its path and text).  Tasks sum, per (host, token), the page count, the
   occurrences and an occurrence-vector digest: the sum over pages of hash(page) * occurrences.
2. Tokens of a host with the same digest occur equally often on the same pages: an equivalence class.  A
   class is valid if it occurs once on each of its pages, these are half of the host's pages and (for text)
   three at least, and it has two members, or one below a path of a valid class.  The members are the
   host's template.
3. Furniture (navigation, headers, footers, asides, forms, adverts, notices, comments by element, class, id
   or role of any element) is dropped, and text of the template is taken off.  A page of which more than
   half would go that way is a copy of others rather than a filled template: it keeps its text.
4. A page's main slot is the deepest template path on it that leaves out none of its remaining text; a page
   without one gives its outermost article and main elements, or else its body.

Hosts meet only as sums of tokens, so no task holds a host's pages; a template has at most twice the
tokens of the host's mean page.

Defined results: null or empty html gives an empty text; unclosed and stray tags are tolerated;
repeated rows are separate pages with the same result; a null url is a host of its own; null ids pass
through; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxgrid.llm.common import stored
from rxgrid.llm.urls import parts

#: Elements, and words in class, id or role, that mark page furniture (fixed values).
FURNITURE = frozenset("nav header footer aside form menu dialog button select".split())
MARKS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright footer "
    "header menu modal nav navbar navigation newsletter notice notices popup promo related share sidebar social sponsored subscribe widget".split()
)
UNSEEN = frozenset("script style noscript template iframe svg head title textarea".split())
CONTAINERS = frozenset("html body main article section div nav header footer aside form menu dialog".split())
BLOCKS = CONTAINERS | frozenset(
    "address blockquote br caption center dd details dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr li ol p pre summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose marks are not read: page, article and headings are content whatever they are called.
UNMARKED = frozenset("html body main article h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that starts ends an open one of these, unless an element of the second set stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_MARK = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Digests are sums modulo this prime.
_PRIME = 2**61 - 1
_SPACE = re.compile(r"\s+")
_PARTS = re.compile(r"[^a-z]+")


def _label(name: str, attributes: str) -> tuple[str, bool]:
    """An element's name with class and id, and whether it is page furniture."""
    marks, furniture = "", name in FURNITURE
    if attributes:
        for m in _MARK.finditer(attributes):
            value = (m[2] or m[3] or m[4] or "").strip().lower()
            if m[1].lower() != "role":
                marks += ("." if m[1].lower() == "class" else "#") + value
            furniture = furniture or name not in UNMARKED and bool(MARKS.intersection(_PARTS.split(value)))
    return name + marks, furniture


def events(page: str) -> Iterator[tuple[str, str, bool]]:
    """A page as (kind, value, furniture): 'open' path / 'close' path of block elements, 'inline' path, 'break', and 'text' outside unseen elements."""
    stack: list[tuple[str, str, bool]] = []  # element, path, furniture at or above it

    def popped(down_to: int) -> Iterator[tuple[str, str, bool]]:
        while len(stack) > down_to:
            name, path, hidden = stack.pop()
            if name in BLOCKS:
                yield "close", path, hidden

    def open_at(names, bounds=frozenset()) -> int | None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in names:
                return k
            if stack[k][0] in bounds:
                return None
        return None

    at = 0
    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        hidden = bool(stack) and stack[-1][2]
        if text and not text.isspace():
            yield "text", text, hidden
        elif text:
            yield "text", " ", hidden
        if not m:
            return
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        closing = bool(m[1])
        if name in UNSEEN and not closing:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at) if not m[3].endswith("/") else None
            at = end.end() if end else (at if name == "head" or m[3].endswith("/") else len(page))
            continue
        if name in BLOCKS:
            yield "break", "", hidden
        if closing:
            # an inline or list element's end tag does not reach beyond the container around it
            k = open_at({name}, frozenset() if name in CONTAINERS else CONTAINERS)
            if k is not None:
                yield from popped(k)
            continue
        if name in BLOCKS and name != "br" and (k := open_at({"p"}, CONTAINERS | {"table"})) is not None:
            yield from popped(k)
        if name in ENDS and (k := open_at(*ENDS[name])) is not None:
            yield from popped(k)
        label, furniture = _label(name, m[3])
        path = f"{stack[-1][1]}/{label}" if stack else label
        furniture = furniture or bool(stack) and stack[-1][2]
        if name in VOID or m[3].endswith("/"):
            yield "inline", path, furniture
        else:
            stack.append((name, path, furniture))
            yield "open" if name in BLOCKS else "inline", path, furniture


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """A page outside furniture as (kind, path, text): 'open', 'close', 'inline', and 'block' with its text."""
    open_: list[str] = []
    own: list[str] = []
    for kind, value, hidden in events(page):
        if kind == "text":
            if not hidden:
                own.append(value)
            continue
        if kind != "inline" and own:
            text = _SPACE.sub(" ", entities.unescape("".join(own))).strip()
            own.clear()
            if text:
                yield "block", open_[-1] if open_ else "", text
        if kind == "open":
            open_.append(value)
        elif kind == "close":
            open_.pop()
        if kind != "break" and not hidden:
            yield kind, value, ""
    text = _SPACE.sub(" ", entities.unescape("".join(own))).strip()
    if text:
        yield "block", open_[-1] if open_ else "", text


def token_hash(path: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{path}\0{text}".encode("utf-8", "replace")) - 2**63


def main_text(page: str, template: frozenset[int], single: frozenset[int]) -> tuple[str, str | None]:
    """The page's main text and slot, given its host's template: tokens of valid classes and of possible one-member classes."""
    blocks: list[tuple[str, tuple[str, ...], bool]] = []  # text, paths around it, of the template
    open_: list[str] = []
    seen: dict[str, bool] = {}

    def valid(path: str, text: str) -> bool:
        key = token_hash(path, text)
        if key in template:
            return True
        around = path if text else path.rpartition("/")[0]
        return key in single and any(token_hash(p, "") in template for p in _prefixes(around))

    for kind, path, text in tokens(page):
        if kind == "open":
            open_.append(path)
            if path not in seen:
                seen[path] = valid(path, "")
        elif kind == "close":
            while open_ and open_.pop() != path:
                pass
        elif kind == "block":
            blocks.append((text, tuple(open_), bool(template) and valid(path, text)))
    if 2 * sum(len(t) for t, _, fixed in blocks if fixed) > sum(len(t) for t, *_ in blocks):
        blocks = [(t, around, False) for t, around, _ in blocks]
    blocks = [(t, around) for t, around, fixed in blocks if not fixed]
    slot = [p for p in (blocks[0][1] if blocks else ()) if seen[p] and all(p in around for _, around in blocks)]
    if slot:
        return " ".join(t for t, _ in blocks), slot[-1]
    own = [p for p in seen if re.match(r"(article|main)\b", p.rpartition("/")[2])]
    inside = [t for t, around in blocks if any(p in around for p in own)]
    return " ".join(inside if own else [t for t, _ in blocks]), None


def _prefixes(path: str) -> Iterator[str]:
    """A path and the paths above it."""
    while path:
        yield path
        path = path.rpartition("/")[0]


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[tuple[str, int, bool], list] = {}

    def flush() -> pa.RecordBatch:
        rows = [(h, t, x, *n) for (h, t, x), n in sums.items()]
        types = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64()]
        cols = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["host", "token", "is_text", "pages", "occurrences", "digest"]
        )

    for batch in batches:
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            key = xxhash.xxh64_intdigest((page or "").encode()) % _PRIME
            own: dict[tuple[str, str], int] = {}
            for kind, path, text in tokens(page or ""):
                if kind != "close":
                    own[path, text] = own.get((path, text), 0) + 1
            for (path, text), n in own.items():
                total = sums.setdefault((host, token_hash(path, text), bool(text)), [0, 0, 0])
                total[0] += 1
                total[1] += n
                total[2] = (total[2] + key * n) % _PRIME
            if len(sums) > 100_000:
                yield flush()
                sums.clear()
    yield flush()


def templates(pages: DataFrame) -> DataFrame:
    """(host, template, single): each host's tokens of valid classes, and those of one-member classes to be met below one, from pages(host, html)."""
    parts_ = pages.select("host", "html").mapInArrow(
        _token_batches, "host string, token long, is_text boolean, pages long, occurrences long, digest long"
    )
    digest = F.pmod(F.sum(F.col("digest").cast("decimal(38,0)")), F.lit(_PRIME).cast("decimal(38,0)")).cast("long")
    size = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    found = parts_.groupBy("host", "token", "is_text").agg(
        F.sum("pages").alias("pages"), F.sum("occurrences").alias("occurrences"), digest.alias("digest")
    )
    found = found.filter("occurrences = pages AND (NOT is_text OR pages >= 3)").join(size, "host").filter("2 * pages >= host_pages")
    found = stored(found.select("host", "token", "pages", "digest"), "html-tokens")
    classes = found.groupBy("host", "pages", "digest").agg(F.collect_list("token").alias("members"))
    member = F.flatten(F.collect_list(F.when(F.size("members") >= 2, F.col("members"))))
    single = F.flatten(F.collect_list(F.when(F.size("members") == 1, F.col("members"))))
    return classes.groupBy("host").agg(member.alias("template"), single.alias("single"))


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages, template, single = (batch.column(k).to_pylist() for k in (2, 3, 4))
        texts = [main_text(p or "", frozenset(t or ()), frozenset(x or ())) for p, t, x in zip(pages, template, single, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), pa.array([t for t, _ in texts], pa.string()),
                pa.array([len(t) for t, _ in texts], pa.int64()), pa.array([m for _, m in texts], pa.string()),
            ],
            names=["page_id", "url", "text", "n_chars", "main_slot"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, main_slot) for every row of pages(page_id, url, html)."""
    src = parts(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")))
    found = stored(templates(src), "html-templates")
    return src.join(found, "host", "left").select("page_id", "url", "html", "template", "single").mapInArrow(
        _text_batches, "page_id long, url string, text string, n_chars long, main_slot string"
    )
