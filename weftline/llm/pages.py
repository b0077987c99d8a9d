"""Main text of web pages: site template removal by counted subtree hashes.

Each page is parsed into a light element tree whose subtrees are hashed bottom-up, twice: with their texts, and by shape alone (tags,
classes, ids, roles, repeats of a child once), as menus and footers may carry words of their own on each page. Spark counts, for every host,
in how many pages with different main text a subtree occurs; those found in at least ``MIN_PAGES`` such pages and in a share of the host's pages
(``MIN_SHARE``, or ``ROOT`` times the square root of their number where that is less) are template.

A page's core is its article, else its main element, else the smallest element that holds half of its text. A second pass drops
subtrees whose text recurs, subtrees outside the core whose shape recurs, lists of links anywhere whose shape recurs, and
elements that are boilerplate by tag, role, or a class or id that consists of nothing but words for it. Inside an article only containers count as
template by text: paragraphs, headings and quotes stay, however often a site repeats them. Of a header inside an article the headings stay.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import saved, small

MIN_PAGES, MIN_SHARE, ROOT, LINKS = 5, 0.3, 10, 0.5

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|noscript|template|textarea|title|iframe|svg|xmp|noembed|noframes"
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body head html legend optgroup option tbody td tfoot th thead tr".split())
#: A start tag ends an open element of these names, up to the nearest of the stops.
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
#: Containers, which may be template inside an article too; elements that may be template elsewhere.
CONTAINERS = frozenset("aside details div dl figure footer form header nav ol section table ul".split())
COUNTED = CONTAINERS | frozenset("blockquote h1 h2 h3 h4 h5 h6 li p pre span".split())
BOILERPLATE_TAGS = frozenset("aside audio button canvas datalist dialog embed footer form head header input label menu nav object option select textarea video".split())
BOILERPLATE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
BOILERPLATE_WORDS = frozenset("ad ads adsense advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr header menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promotion related share sharing sidebar signup social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split())

TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|(?P<text>[^<]+|<)", re.I | re.S)
#: One attribute after another, so that a value is never read as a name.
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
READ_ATTRIBUTES = frozenset("class id role hidden aria-hidden".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Page:
    """Elements in page order (a parent comes before its children), and the texts and block borders between."""

    def __init__(self, source: str):
        self.tags, self.parents = ["#"], [-1]
        self.labels: list[dict] = [{}]
        self.parts: list[list] = [[]]  # of each element: texts, and numbers of child elements
        self.events: list[tuple[int, str | None]] = []  # (element, text), or (element, None) at a block's border
        stack, tags = [0], self.tags
        for m in TOKEN.finditer(source):
            if (text := m["text"]) is not None:
                self.events.append((stack[-1], text))
                self.parts[stack[-1]].append(text)
                continue
            if not (tag := m["tag"]):
                continue
            tag = tag.lower()
            if m["end"]:
                self._close(stack, {tag}, set())
                continue
            if tag in CLOSES_P:
                self._close(stack, {"p"}, {"td", "th", "div", "article", "section", "blockquote", "li", "button", "table"})
            if tag in IMPLIED:
                self._close(stack, *IMPLIED[tag])
            if tag in VOID:
                self.events.append((stack[-1], None if tag == "hr" else " "))
                continue
            number = len(tags)
            tags.append(tag)
            found: dict = {}
            for k, a, b, c in ATTRIBUTE.findall(m["attrs"]) if m["attrs"] else ():
                if (k := k.lower()) in READ_ATTRIBUTES:
                    found.setdefault(k, a or b or c)  # the first of a name counts
            self.labels.append(found)
            self.parents.append(stack[-1])
            self.parts.append([])
            self.parts[stack[-1]].append(number)
            stack.append(number)
            if tag in BLOCK:
                self.events.append((number, None))

    def _close(self, stack: list[int], names: set, stops: set) -> None:
        """Ends the nearest open element of these names, and all inside it; none that lies beyond a stop."""
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tags[stack[k]]
            if tag in names:
                for number in stack[k:]:
                    if self.tags[number] in BLOCK:
                        self.events.append((self.parents[number], None))
                del stack[k:]
                return
            if tag in stops:
                return

    def boilerplate(self, i: int) -> bool:
        if self.tags[i] in BOILERPLATE_TAGS:
            return True
        if not (found := self.labels[i]) or self.tags[i] in {"html", "body"}:
            return False
        if "hidden" in found or found.get("aria-hidden") == "true" or found.get("role") in BOILERPLATE_ROLES:
            return True
        names = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
        return any((words := WORDS.findall(x)) and BOILERPLATE_WORDS.issuperset(words) for x in names)

    def measure(self) -> None:
        """Of each element's subtree: exact and shape (hashes), size and linked (characters of text, and of those in links)."""
        from xxhash import xxh64_intdigest

        n = len(self.tags)
        self.exact, self.shape, self.size, self.linked = [0] * n, [0] * n, [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            body, kinds, size, linked = [], [], 0, 0
            for x in self.parts[i]:
                if isinstance(x, str):
                    body.append(x)
                    size += len(x.strip())
                else:
                    body.append(f"\x01{self.exact[x]:x}")
                    size += self.size[x]
                    linked += self.linked[x]
                    if not kinds or kinds[-1] != self.shape[x]:
                        kinds.append(self.shape[x])
            label = f"{self.tags[i]} {sorted(self.labels[i].items()) if self.labels[i] else ''}\x00"
            joined = SPACE.sub(" ", "\x00".join(body))
            self.exact[i] = xxh64_intdigest(f"{label}{joined}".encode("utf-8", "surrogatepass")) - (1 << 63)
            self.shape[i] = xxh64_intdigest(f"{label}{kinds}".encode("utf-8", "surrogatepass"), 1) - (1 << 63)
            self.size[i], self.linked[i] = size, size if self.tags[i] == "a" else linked

    def regions(self, articles: bool = True) -> tuple[list[bool], list[bool], bool]:
        """Of each element: whether it is in the main region, and whether it is boilerplate or inside such; whether there is an article or
        main element. articles: without them, the body is the main region."""
        tags, n = self.tags, len(self.tags)
        inside, soft, skipped = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            up = self.parents[i]
            inside[i] = inside[up] or tags[up] == "article"
            if tags[i] == "header" and inside[i] and not skipped[up]:
                soft[i] = skipped[i] = True  # an article's own header: its headings stay
            elif soft[up]:
                skipped[i] = soft[i] = tags[i] not in HEADINGS
            else:
                skipped[i] = skipped[up] or self.boilerplate(i)
        kinds = [lambda i: tags[i] == "article", lambda i: tags[i] == "main" or self.labels[i].get("role") == "main", lambda i: tags[i] == "body", lambda i: i == 0]
        for k, own in enumerate(kinds):
            if k < 2 and not articles:
                continue
            main = [False] * n
            for i in range(n):
                main[i] = (i > 0 and main[self.parents[i]]) or (own(i) and not skipped[i])
            if any(main):
                break
        return main, skipped, k < 2

    def outside(self, main: list[bool], article: bool) -> list[bool]:
        """Of each element: whether it is neither in the page's core nor around it. Needs measure()."""
        n, up = len(self.tags), self.parents
        core = list(main)
        if not article:
            least = n - 1
            while least and 2 * self.size[least] < self.size[0]:
                least -= 1  # a later element holding half of the text is the smallest: only its ancestors hold as much
            core = [False] * n
            core[least] = True
            for i in range(least + 1, n):
                core[i] = core[up[i]]
        around = list(core)
        for i in range(n - 1, 0, -1):
            around[up[i]] |= around[i]
        return [not a and not c for a, c in zip(around, core, strict=True)]

    def keys(self, main: list[bool], article: bool) -> set[int]:
        """The hashes by which the page's subtrees are counted. Needs measure()."""
        out = {h for tag, h in zip(self.tags, self.exact, strict=True) if tag in COUNTED}
        outside = self.outside(main, article)
        out.update(self.shape[i] for i, tag in enumerate(self.tags) if tag in COUNTED and self.size[i] and (outside[i] or self._links(i)))
        return out

    def _links(self, i: int) -> bool:
        return self.tags[i] in CONTAINERS and self.linked[i] > 0 and self.linked[i] >= LINKS * self.size[i]

    def text(self, template: frozenset | set = frozenset(), articles: bool = True) -> str:
        main, skipped, article = self.regions(articles)
        if template:
            self.measure()
            outside, gone = self.outside(main, article), [False] * len(main)
            for i in range(1, len(main)):
                fit = CONTAINERS if article and main[i] else COUNTED
                known = self.tags[i] in fit and self.exact[i] in template or self.tags[i] in COUNTED and self.shape[i] in template and (outside[i] or self._links(i))
                gone[i] = known or gone[self.parents[i]]
                skipped[i] = skipped[i] or gone[i]
        blocks, held = [], []

        def flush() -> None:
            if held:
                block = SPACE.sub(" ", html.unescape("".join(held))).strip()
                if block:
                    blocks.append(block)
                held.clear()

        for i, text in self.events:
            if text is None:
                flush()
            elif main[i] and not skipped[i]:
                held.append(text)
        flush()
        return "\n".join(blocks)


def host_of(url):
    """The host of a URL, lower-cased; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def template(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """host, subtrees: the hashes of each host's template. A host has few: each lies in min_share of its pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in small(batches):
            rows = set()
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = Page(source)
                page.measure()
                region = page.regions()
                main = xxh64_intdigest(page.text().encode("utf-8", "surrogatepass")) - (1 << 63)
                rows.update((host, main, h) for h in page.keys(region[0], region[2]))
                rows.add((host, main, 0))
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["host", "main", "subtree"])

    rows = pages.select(host_of("url").alias("host"), F.coalesce("html", F.lit("")).alias("html")).mapInArrow(run, "host string, main long, subtree long")
    counts = saved(rows.distinct().groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages), "subtrees")
    totals = counts.where("subtree = 0").select("host", F.col("n").alias("pages"))
    needed = F.least(min_share * F.col("pages"), ROOT * F.sqrt("pages"))
    # both are written, so that the joins by host are ones whose crowded hosts Spark can split
    often = saved(counts.where("subtree <> 0").join(totals, "host").where(F.col("n") >= needed).select("host", "subtree"), "recurring")
    return saved(often.groupBy("host").agg(F.collect_list("subtree").alias("subtrees")), "template")


def main_texts(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html).

    Null html counts as empty and gives an empty text; a null url or one without a host shares the empty host; unclosed and
    stray tags, truncated pages and deep nesting parse; repeated rows count once towards a template and are extracted each; an
    empty table gives no rows; other columns are ignored.
    """

    @F.arrow_udf("string")
    def extract(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sources, subtrees in parts:
            yield pa.array([Page(a).text(set(b or ())) for a, b in zip(sources.to_pylist(), subtrees.to_pylist(), strict=True)], pa.string())

    found = template(pages, min_pages, min_share)
    rows = pages.select("page_id", "url", host_of("url").alias("host"), F.coalesce("html", F.lit("")).alias("html")).join(found, "host", "left")
    text = rows.withColumn("text", extract("html", "subtrees"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
