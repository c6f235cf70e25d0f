"""Main text of web pages by template deduction over the pages of a host.

1. A page is a sequence of tokens: its elements, each with the path it stands in, and its text
   blocks. Tokens with equal occurrence vectors over the pages of a host form an equivalence class;
   vectors are compared by hashes summed over pages, so no host is ever gathered in a task. A class
   is valid if it holds elements (each of which is two tokens, its begin and end) and occurs in pages of many different contents
   and in a hundredth of the pages. A host may thus have several layouts, each with classes of its own.
2. Valid classes nest: a class lies in the gap of another where that one's elements are around it.
   Together they are the template. Texts in a class are part of it; all other text fills slots, the
   gaps after each element of the template.
3. What fills the slots is summed up over the pages: for each slot its text, linked text and kinds of
   content, for each element what share of a page's own text it holds.
4. The main text of a page is what fills the slots inside its main element: of the template's elements
   that occur once a page the innermost that holds most of the own text. Slots of linked or of hardly
   ever changing text are left out, as are elements inside the main one that HTML itself sets apart
   (nav, aside, forms, scripts, ...); names in class and id decide only on elements inside the main one
   that hold little text.

Hosts without valid classes take the template of all pages together, found from the same counts; a
page that this does not know either is judged by its own elements. Templates have some thousand
elements at most, as each is in a hundredth of the pages.

Defined cases: null html has an empty text; an empty table gives no rows; broken markup is read as
far as it goes; pages of any length are read whole, one at a time; copies of one page make no
template; pages with equal ids are read one by one, repeated rows count as pages; other columns are
not looked at.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.llm.shared import chunks, written
from quillstream.llm.url_filter import host_and_path

#: Kinds of content (of 64 by a hash) that a class of a template has to be seen with, and the share of the pages it is in.
CONTENTS, SUPPORT = 8, 0.01
#: Share of the own text that the main element holds at least; an article or main element needs less.
MAIN, MARKED = 0.8, 0.5
#: Shares of the own text up to which an element is left out for a name: one that has the name among others, and one that is just named so.
NAMED = (0.5, MAIN)

#: Elements that end a block, that hold nothing, and whose content is never main text.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes".split())
DROPPED = frozenset("aside audio button canvas datalist dialog footer form head iframe map menu nav noscript object script select style svg template textarea title video".split())
#: Words in class, id and role that name something other than main text.
NAMES = frozenset(
    "ad ads adsense advert advertisement advertising adverts alert announcement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies dialog discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommendations recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toast toolbar widget widgets".split()
)
#: Elements that can be the main one: blocks that hold blocks.
CONTAINERS = BLOCKS - frozenset("p h1 h2 h3 h4 h5 h6 li dd dt pre blockquote address caption figcaption hr legend option title".split())
#: Words that may stand before such a name in a class or id.
PLACES = frozenset("site page main left right top bottom post article user reader social cookie global primary secondary inline floating sticky".split())
#: Elements that a start tag of the same name closes.
SIBLINGS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*+"|'[^']*+'|[^'">])*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""", re.I)
_HIDDEN = re.compile(r"""(?:\s|^)hidden(?=[\s=/]|\Z)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile("[a-z]+")


HOST_OF_ALL = 0


@dataclass
class Page:
    """Elements (parent, name, path, set apart by HTML, named like boilerplate: 1 among others, 2 just so) and blocks (element, template slot's left neighbour, text, linked characters)."""

    elements: list[tuple[int, str, str, bool, int]] = field(default_factory=list)
    blocks: list[tuple[int, int, str, int]] = field(default_factory=list)

    def around(self, k: int) -> Iterator[int]:
        while k >= 0:
            yield k
            k = self.elements[k][0]


def _names_boilerplate(value: str) -> int:
    """2 if a class, id or role is such a name, 1 if it begins with one or with a place and one, else 0."""
    out = 0
    for name in value.split():
        words = _WORD.findall(name)
        if name in NAMES:
            return 2
        if words and (words[0] in NAMES or len(words) > 1 and words[0] in PLACES and words[1] in NAMES):
            out = 1
    return out


def _attributes(raw: str) -> tuple[str, str, bool, int]:
    """(class words as a path part, role, hidden, whether a name says that this is not main text)."""
    if not raw.strip(" /"):
        return "", "", False, 0
    classes, role, named = "", "", 0
    for m in _NAMED.finditer(raw):
        value = (m[2] or m[3] or m[4] or "").lower()
        named = max(named, _names_boilerplate(value))
        if m[1].lower() == "class":
            classes = "." + value
        elif m[1].lower() == "role":
            role = value
    return classes, role, bool(_HIDDEN.search(raw)), named


def parsed(page: str | None) -> Page:
    page = page or ""
    out = Page()
    open_: list[tuple[str, int]] = []  # name, element
    text: list[str] = []
    linked = muted = 0
    last = -1  # the element begun or ended last

    def end_block() -> None:
        nonlocal linked
        if text:
            t = " ".join(entities.unescape("".join(text)).split())
            text.clear()
            if t:
                k = open_[-1][1] if open_ else -1
                while k >= 0 and out.elements[k][1] not in BLOCKS and out.elements[k][0] >= 0:
                    k = out.elements[k][0]
                out.blocks.append((k, last, t, min(linked, len(t))))
        linked = 0

    def close(k: int) -> None:
        nonlocal muted, last
        if any(name in BLOCKS for name, _ in open_[k:]):
            end_block()
            last = open_[k][1]
        muted -= sum(name in DROPPED and name not in BLOCKS for name, _ in open_[k:])
        del open_[k:]

    def add(t: str) -> None:
        nonlocal linked
        if not muted:
            text.append(t)
            if any(name == "a" for name, _ in open_):
                linked += len(t)

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    close(k)
                    break
            else:
                if name in BLOCKS:
                    end_block()
            continue
        raw = m[3] if m[3] is not None else m[6] or ""
        if name in SIBLINGS:
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] in SIBLINGS[name]:
                    close(k)
                    break
                if open_[k][0] in BLOCKS and open_[k][0] not in ("tbody", "thead"):
                    break
        elif name in BLOCKS and open_ and open_[-1][0] == "p":
            close(len(open_) - 1)
        if name in BLOCKS:
            end_block()
        if name == "br":
            add(" ")
        if name in VOID or raw.endswith("/") and name not in BLOCKS:
            continue
        classes, role, hidden, named = _attributes(raw)
        parent = open_[-1][1] if open_ else -1
        path = f"{out.elements[parent][2] if parent >= 0 else ''}/{'main' if role == 'main' else 'article' if 'articlebody' in raw.lower() else name}{classes}"
        apart = (hidden or name in DROPPED) and name not in ("html", "body")
        out.elements.append((parent, name, path, apart, 0 if name in ("html", "body") else named))
        if name in RAW:
            stop = re.compile(f"</{re.escape(name)}(?=[\\s/>]|\\Z)", re.I).search(page, at)
            at = stop.start() if stop else n
        open_.append((name, len(out.elements) - 1))
        muted += name in DROPPED and name not in BLOCKS
        if name in BLOCKS:
            last = len(out.elements) - 1
    end_block()
    return out


def _hash(*parts: str) -> int:
    h = xxhash.xxh64_intdigest("\x1f".join(parts))
    return h - (1 << 64) if h >> 63 else h


def _content(page: Page) -> int:
    return _hash(*(t for k, _, t, _ in page.blocks if not any(page.elements[e][3] for e in page.around(k)))) & 63


def _bit(k: int) -> int:
    return 1 << k if k < 63 else -(1 << 63)


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(names.split())
    kinds = [pa.bool_() if n.startswith("is_") else pa.int64() for n in names.split()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names.split())


TOKENS = "host_key token is_text is_once pages v1 v2 contents"
FILLS = "host_key token is_slot pages chars linked own contents of_pages"


def _ddl(names: str) -> str:
    return ", ".join(f"{n} {'boolean' if n.startswith('is_') else 'bigint'}" for n in names.split())


def _token_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The tokens of a batch, summed up by host: in how many pages, their vectors' sums, whether at most once in each."""
    out: dict[tuple[int, int, bool], list] = {}
    for host, key, page in zip(batch.column("host_key").to_pylist(), batch.column("page_key").to_pylist(), batch.column("html").to_pylist(), strict=True):
        p = parsed(page)
        bit = _bit(_content(p))
        counted: dict[tuple[int, bool], int] = {(0, False): 1}
        paths: dict[str, int] = {}
        for _, _, path, _, _ in p.elements:
            paths[path] = paths.get(path, 0) + 1
        counted |= {(_hash("tag", path), False): n for path, n in paths.items()}
        for k, _, t, _ in p.blocks:
            token = _hash("text", p.elements[k][2] if k >= 0 else "", t), True
            counted[token] = counted.get(token, 0) + 1
        by_count: dict[int, int] = {}
        for (token, is_text), n in counted.items():
            v = by_count.get(n)
            if v is None:
                v = by_count[n] = xxhash.xxh64_intdigest(f"{key} {n}")
            row = out.setdefault((host, token, is_text), [True, 0, 0, 0, 0])
            row[0] = row[0] and n == 1
            row[1] += 1
            row[2] += v & 0x7FFFFFFF
            row[3] += v >> 33
            row[4] |= bit
    return _batch([(*k, *v) for k, v in out.items()], TOKENS)


def _keyed(pages: DataFrame) -> DataFrame:
    host, _ = host_and_path(F.col("url").cast("string"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.withColumn("host_key", F.xxhash64(host)).withColumn("page_key", F.xxhash64("page_id", "url"))


def templates(pages: DataFrame, *, support: float = SUPPORT, contents: int = CONTENTS) -> DataFrame:
    """Valid classes: host_key, v1 and v2 (the vector), pages, elements (token, is_once) and texts; host_key HOST_OF_ALL stands for all pages."""
    rows = _keyed(pages).select("host_key", "page_key", "html").mapInArrow(lambda it: (_token_rows(b) for b in chunks(it, "html")), _ddl(TOKENS))
    sums = [F.min("is_once").alias("is_once"), *(F.sum(c).alias(c) for c in ("pages", "v1", "v2")), F.expr("bit_or(contents)").alias("contents")]
    own = written(rows.groupBy("host_key", "token", "is_text").agg(*sums))
    # vectors add up, so those over all pages are sums of those over hosts
    every = own.where("not is_text").groupBy("token").agg(*sums).select(F.lit(HOST_OF_ALL).cast("long").alias("host_key"), "token", F.lit(False).alias("is_text"), "is_once", "pages", "v1", "v2", "contents")
    tokens = own.union(every).where(F.expr(f"bit_count(contents) >= {contents}"))
    is_element = "not is_text and token <> 0"
    c = tokens.groupBy("host_key", "v1", "v2").agg(F.max("pages").alias("pages"), F.count_if(F.expr(is_element)).alias("n"))
    whole = own.where("token = 0 and not is_text").select("host_key", F.col("pages").alias("of_pages"))
    whole = whole.union(whole.agg(F.lit(HOST_OF_ALL).cast("long").alias("host_key"), F.sum("of_pages").alias("of_pages")))
    c = c.where("n > 0").join(whole, "host_key").where(F.col("pages") >= F.col("of_pages") * support)
    # only texts whose vector is that of elements are gathered: no more of them than blocks in a page
    held = tokens.where("token <> 0").join(c.select("host_key", "v1", "v2"), ["host_key", "v1", "v2"])
    return held.groupBy("host_key", "v1", "v2").agg(
        F.max("pages").alias("pages"),
        F.expr("collect_list(struct(token, is_once)) filter (where not is_text)").alias("elements"),
        F.expr("collect_list(token) filter (where is_text)").alias("texts"),
    )


@dataclass
class Template:
    """What is known of a host: its elements (once a page or not), its texts, and later slots to leave out and shares of text."""

    elements: dict[int, bool]
    texts: set[int]
    left_out: set[int] = field(default_factory=set)
    shares: dict[int, float] = field(default_factory=dict)


class Filled:
    """A page laid over a template: tokens of its elements, its slots, and its own text."""

    def __init__(self, page: Page, template: Template):
        self.page, self.template = page, template
        self.tokens = [_hash("tag", e[2]) for e in page.elements]
        seen: dict[int, int] = {}
        for t in self.tokens:
            seen[t] = seen.get(t, 0) + 1
        self.seen = seen
        self.apart = []
        for parent, _, _, apart, _ in page.elements:
            self.apart.append(apart or parent >= 0 and self.apart[parent])
        self.own = []  # (block, slot, characters that are no links)
        for b, (k, last, t, linked) in enumerate(page.blocks):
            if not (template.texts and _hash("text", page.elements[k][2] if k >= 0 else "", t) in template.texts):
                self.own.append((b, self.slot(k, last), len(t) - linked))

    def known(self, k: int) -> int:
        """The innermost element of the template at or around `k`, by token; 0 for none."""
        return next((self.tokens[e] for e in self.page.around(k) if self.tokens[e] in self.template.elements), 0)

    def slot(self, k: int, last: int) -> int:
        around, before = self.known(k), self.known(last)
        return _hash("slot", str(around), str(before))

    def held(self) -> tuple[dict[int, int], int]:
        """Own characters inside each element, and in all, without what HTML sets apart and, if anything is left, what is just named boilerplate."""
        inside: dict[int, int] = {}
        total = 0
        kept = [(self.page.blocks[b][0], chars) for b, _, chars in self.own]
        kept = [(k, chars) for k, chars in kept if not (k >= 0 and self.apart[k])]
        plain = [(k, chars) for k, chars in kept if not any(self.page.elements[e][4] == 2 for e in self.page.around(k))]
        for k, chars in plain if any(chars for _, chars in plain) else kept:
            total += chars
            for e in self.page.around(k):
                inside[e] = inside.get(e, 0) + chars
        return inside, total

    def text(self) -> str:
        page, template = self.page, self.template
        inside, total = self.held()

        def share(e: int) -> float:
            known = template.shares.get(self.tokens[e])
            return known if known is not None else inside.get(e, 0) / total if total else 0.0

        def depth(e: int) -> int:
            return sum(1 for _ in page.around(e))

        def once(e: int) -> bool:
            return self.seen[self.tokens[e]] == 1 and template.elements.get(self.tokens[e], True)

        main, marked = -1, -1
        for e in range(len(page.elements)):
            if not once(e):
                continue
            s = share(e)
            if s >= MARKED and page.elements[e][2].rpartition("/")[2].partition(".")[0] in ("article", "main"):
                marked = e if marked < 0 or depth(e) > depth(marked) else marked
            if s >= MAIN and page.elements[e][1] in CONTAINERS:
                main = e if main < 0 or depth(e) > depth(main) else main
        if marked >= 0:
            main = marked
        elif main >= 0:
            # a heading beside the main element belongs to it
            headed = {parent for parent, name, *_ in page.elements if name in ("h1", "h2")}
            parent = page.elements[main][0]
            if parent in headed and page.elements[parent][1] not in ("html", "body") and not any(x[1] in ("h1", "h2") and main in page.around(k) for k, x in enumerate(page.elements)):
                main = parent
        whole = main < 0 or page.elements[main][1] in ("html", "body")
        kept = []
        for b, slot, _ in self.own:
            k, _, t, _ = page.blocks[b]
            if slot in template.left_out:
                continue
            for e in page.around(k):
                if e == main:
                    kept.append(t)
                    break
                _, name, _, apart, named = page.elements[e]
                if apart or name == "header" and whole or named and share(e) < NAMED[named - 1]:
                    break
            else:
                if main < 0:
                    kept.append(t)
        return "\n".join(kept)


def _templates_of(batch: pa.RecordBatch) -> Iterator[tuple[int, str | None, Template]]:
    """(key of the template, html, template) of each row; rows of one template that follow each other share it."""
    before, made = None, None
    for key, html_, elements, texts, slots, shares in zip(*(batch.column(c).to_pylist() for c in ("key", "html", "elements", "texts", "slots", "shares")), strict=True):
        if made is None or key != before:
            made = Template({e["token"]: e["is_once"] for e in elements or ()}, set(texts or ()), set(slots or ()), {s["token"]: s["share"] for s in shares or ()})
            before = key
        yield key, html_, made


def _fill_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """What fills the slots and elements of the templates in a batch, summed up by template."""
    out: dict[tuple[int, int, bool], list[int]] = {}

    def count(key: tuple[int, int, bool], chars: int, linked: int, own: int, content: int, of_page: int) -> None:
        row = out.setdefault(key, [0] * 6)
        row[0] += 1
        row[1] += chars
        row[2] += linked
        row[3] += own
        row[4] |= content
        row[5] |= of_page

    for key, html_, template in _templates_of(batch):
        if not template.elements:
            continue
        f = Filled(parsed(html_), template)
        inside, total = f.held()
        page = _bit(_content(f.page))
        slots: dict[int, list] = {}
        for b, slot, chars in f.own:
            own = slots.setdefault(slot, [0, 0, []])
            t = f.page.blocks[b][2]
            own[0] += len(t)
            own[1] += len(t) - chars
            own[2].append(t)
        for slot, (chars, linked, texts) in slots.items():
            count((key, slot, True), chars, linked, 0, _bit(_hash(*texts) & 63), page)
        elements: dict[int, int] = {}
        for e, t in enumerate(f.tokens):
            if template.elements.get(t):
                elements[t] = inside.get(e, 0)
        for t, chars in elements.items():
            count((key, t, False), chars, 0, total, 0, page)
    return _batch([(*k, *v) for k, v in out.items()], FILLS)


def _laid_over(pages: DataFrame, known: DataFrame) -> DataFrame:
    """page_id, url, html and the template of each page: its host's, or that of all pages."""
    of = known.select(F.col("host_key").alias("own_key")).where(F.col("own_key") != HOST_OF_ALL)
    p = _keyed(pages).join(of, F.col("host_key") == F.col("own_key"), "left")
    p = p.select("page_id", "url", "html", F.coalesce("own_key", F.lit(HOST_OF_ALL).cast("long")).alias("key"))
    return p.join(known, F.col("key") == F.col("host_key"), "left").select("page_id", "url", "html", "key", "elements", "texts", "slots", "shares")


def learned(pages: DataFrame, *, support: float = SUPPORT, contents: int = CONTENTS) -> DataFrame:
    """A template for each host_key: elements, texts, slots to leave out, and shares of own text by element."""
    t = templates(pages, support=support, contents=contents).groupBy("host_key").agg(F.flatten(F.collect_list("elements")).alias("elements"), F.flatten(F.collect_list("texts")).alias("texts"))
    t = written(t)
    none = t.withColumns({"slots": F.expr("cast(null as array<bigint>)"), "shares": F.expr("cast(null as array<struct<token:bigint,share:double>>)")})
    rows = _laid_over(pages, none).mapInArrow(lambda it: (_fill_rows(b) for b in chunks(it, "html")), _ddl(FILLS))
    f = rows.groupBy("host_key", "token", "is_slot").agg(*(F.sum(c).alias(c) for c in ("pages", "chars", "linked", "own")), *(F.expr(f"bit_or({c})").alias(c) for c in ("contents", "of_pages")))
    # rare slots and elements are judged page by page
    f = f.where(F.expr(f"bit_count(of_pages) >= {contents}"))
    boring = f"2 * linked > chars or {contents} * bit_count(contents) <= bit_count(of_pages)"
    f = f.where(f"not is_slot or {boring}").groupBy("host_key").agg(
        F.expr("collect_list(token) filter (where is_slot)").alias("slots"), F.expr("collect_list(struct(token, if(own > 0, chars / own, 0D) as share)) filter (where not is_slot)").alias("shares")
    )
    return written(t.join(f, "host_key", "left"))


def own_text(page: str | None, template: Template | None = None) -> str:
    """The main text of one page, by a template or by its own elements."""
    return Filled(parsed(page), template or Template({}, set())).text()


def extract(pages: DataFrame, **options: float) -> DataFrame:
    """page_id, url and text of each page."""

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(it, "html"):
            texts = [own_text(html_, template) for _, html_, template in _templates_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return _laid_over(pages, learned(pages, **options)).mapInArrow(read, "page_id bigint, url string, text string")
