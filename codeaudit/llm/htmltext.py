"""HTML extraction: template deduction by equivalence classes of tokens.

A page is a sequence of tokens: its elements by path (names with class and id), and its text
blocks by path and text. Over the pages of a host each token has an occurrence vector (how often
it stands in which page); tokens with equal vectors are an equivalence class. The vector is
summed up as page count, total and an order-free hash of (page, count) pairs, so it grows with
no group and merges like any sum. Pages of a host with identical html count once.

Elements that stand in at least half of a host's pages (and three), the same number of times in
each, are the frame that bounds the slots. Fixed wording is the text blocks of accepted
classes: those that cover all of the host's pages, have `LEAST_MEMBERS` tokens or more, and nest
below the outermost element of the class that stands once in every page. A text that only some pages
repeat is never wording, so copies of an article under other bylines keep it. The frame bounds
slots. A slot's text is what varies in it. The main slot of a host is the innermost template
element under which most varying text stands, other than a single paragraph, heading, list or
table; if it lies in an article or main element, it is all of that element. Extraction keeps, in page order, the blocks in the
host's main slot (in all of the page without a template): those of an article or main element
where there is one, else those that are not fixed wording; never blocks in menus, headers, footers, sidebars, notices, adverts,
forms or reader comments, as named by elements, roles, classes and ids (`Page` says when names do not count).

Defined cases: null and empty html give the empty text; markup that ends within a tag ends
before it; hosts with fewer than three pages have no template; repeated rows have equal texts; an
article's own text is never taken for wording, however many pages repeat it.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from codeaudit.llm.urlfilter import host_of
from codeaudit.storage import materialize

LEAST_PAGES = 3
LEAST_MEMBERS = 3
BROADCAST_HOSTS = 100_000

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*$|([^<]+|<)""", re.S)
_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)(?=[\s=/>]|$)""", re.I)

VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
ASIDE = set("head nav footer aside form noscript template button select option dialog menu svg object canvas audio video math".split())
MAIN = {"article", "main"}
#: Elements that hold part of an article's text, never the article.
PARTS = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure figcaption table thead tbody tr td th address details summary span".split())
DEPTH, LABEL = 64, 80  # levels of a path, and characters of a level, that are spelled out
#: A name that starts or ends so is about an element's neighbours or state.
WITH = set("with without has no is show hide".split())
STATES = set("enabled disabled active inactive open closed visible".split())
#: Words of classes, ids and roles of what is not the article.
OUTSIDE = set(
    "ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus footer "
    "gdpr login menu modal nav navbar navigation navi newsletter notice notices notification pager pagination popup promo promoted promotion recommended "
    "related remarks replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget".split())


class Page:
    """The text blocks of a page in order: (path, text, whether outside, number of its article or 0).

    Some elements are outside whatever they hold (`ASIDE`, headers, hidden ones). Names and forms only say so
    until the page says otherwise: if every first heading of the page stands below such elements, those that
    hold one and a paragraph are not outside, nor are those that hold a main element; and if nothing
    else is left, none is.
    """

    def __init__(self, page: str | None, elements: Counter | None = None):
        self.blocks: list[tuple[str, str, bool, int]] = []
        self.articles, self.free_heading = 0, False
        self._found: list[tuple[str, str, bool, int, tuple[int, ...]]] = []
        self._holds: list[set[str]] = []  # of each element that its name puts outside
        self._read(page or "", elements)
        headed = self.free_heading or any(not f[2] and not f[4] and f[0].rsplit("/", 1)[-1].split(".")[0] == "h1" for f in self._found)
        spared = {k for k, holds in enumerate(self._holds) if "main" in holds or (not headed and {"h1", "p"} <= holds)}
        named = lambda f: any(k not in spared for k in f[4])
        bare = all(f[2] or named(f) for f in self._found)
        self.blocks = [(path, text, hard or (not bare and named((path, text, hard, at, by))), at) for path, text, hard, at, by in self._found]

    def _read(self, page: str, elements: Counter | None) -> None:
        # Name, path, outside, number of the article, names that say outside, and the depth.
        stack: list[tuple[str, str, bool, int, tuple[int, ...]]] = [("", "", False, 0, ())]
        held: list[str] = []

        def end_block() -> None:
            text = " ".join(html.unescape("".join(held)).split())
            held.clear()
            if text:
                self._found.append((stack[-1][1], text, *stack[-1][2:]))

        at = 0
        while at < len(page):
            m = _TOKEN.match(page, at)
            at = m.end()
            if m[4] is not None:
                held.append(m[4])
                continue
            if m[2] is None:
                continue
            name = m[2].lower()
            if name in INLINE and not (name == "span" and m[3]):
                if name == "br":
                    held.append(" ")
                continue
            if m[1]:
                if any(e[0] == name for e in reversed(stack)):
                    end_block()
                    while stack.pop()[0] != name:
                        pass
                elif name not in INLINE:
                    end_block()
                continue
            if name != "span":
                end_block()
            if name in RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|$)[^>]*>?", re.I).search(page, at)
                at = close.end() if close else len(page)
                continue
            if name in VOID or m[3].endswith("/"):
                continue
            label, named, hidden = name, False, False
            inner = name in PARTS and stack[-1][3] > 0
            for a in _ATTRIBUTE.finditer(m[3]):
                value = a[2] or a[3] or a[4] or ""
                if not a[1]:
                    hidden = True
                    continue
                named = named or names_outside(value, inner)
                hidden = hidden or "hidden" in value.lower().split()
                label += f".{value.lower().replace('/', '|')}" if a[1].lower() != "role" else ""
            if name == "span" and not named and not hidden:
                stack.append((name, *stack[-1][1:]))
                continue
            end_block()
            # An open paragraph or item ends where a block or the next item starts.
            while stack[-1][0] in ("p", "span") or name == stack[-1][0] == "li":
                stack.pop()
            _, above, hard, article, by = stack[-1]
            hard = hard or hidden or (name in ASIDE and name != "form") or (name == "header" and not article)
            if name in ("h1", "p", "main"):
                for k in by:
                    self._holds[k].add(name)
                self.free_heading = self.free_heading or (name == "h1" and not by and not hard and not article)
            if name == "form" or (named and name not in ("html", "body") and name not in MAIN):
                by = (*by, len(self._holds)) if len(by) < DEPTH else by
                self._holds.append({name})
            if name in MAIN and not hard and not by and not article:
                self.articles += 1
                article = self.articles
            stack.append((name, below(above, label), hard, article, by))
            if elements is not None:
                elements[stack[-1][1]] += 1
        end_block()


def names_outside(value: str, whole: bool) -> bool:
    """Whether a class, id or role is of what is not the article; of parts of an article only by a `whole` name."""
    for name in value.split():
        if name.lower() in OUTSIDE:
            return True
        words = re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())
        if not whole and OUTSIDE.intersection(words) and words[0] not in WITH and words[-1] not in STATES:
            return True
    return False


def below(path: str, label: str) -> str:
    """The path of an element. From `DEPTH` levels on, and for long names, a hash stands for what would make it long:
    such elements are told apart, as children of their ancestor at that level."""
    if len(label) > LABEL:
        label = f"{label.split('.')[0]}.{_hash(label):x}"
    if path.count("/") < DEPTH:
        return f"{path}/{label}"
    return f"{path.rsplit('/', 1)[0]}/{label.split('.')[0]}.{_hash(f'{path}/{label}'):x}"


def blocks_of(page: str | None, elements: Counter | None = None) -> list[tuple[str, str, bool, int]]:
    """(path, text, whether outside, number of its article or 0) of every text block, in page order.

    `elements` counts the block elements by path.
    """
    return Page(page, elements).blocks


def _hash(text: str) -> int:
    data = text.encode("utf-8", "surrogatepass")
    return (zlib.crc32(data) << 31) ^ zlib.crc32(data, 0x5EED)


def whole_article(path: str | None) -> str | None:
    """The outermost article or main element that holds the path, else the path."""
    labels = (path or "").split("/")
    at = next((k for k, label in enumerate(labels) if label.split(".")[0] in MAIN), None)
    return path if at is None else "/".join(labels[: at + 1])


def main_text(page: str | None, main: str | None = None, wording: set[int] = frozenset()) -> str:
    """The text of a page under its host's template."""
    read = Page(page)
    found = [b for b in read.blocks if not b[2]]
    main = whole_article(main)
    slot = [b for b in found if main is None or (b[0] + "/").startswith(main + "/")] or found
    if read.free_heading and read.articles > 1:
        # The story has the first heading and stands beside the articles, which are teasers of others.
        slot = [b for b in found if not b[3]]
    else:
        article = [b[1] for b in slot if b[3]] or [b[1] for b in found if b[3]]
        if article:
            return "\n".join(article)
    free = [b[1] for b in slot if _hash(f"{b[0]}\n{b[1]}") not in wording]
    return "\n".join(free or [b[1] for b in slot])


def _tokens(pages: DataFrame) -> DataFrame:
    """`(host, page, token, path, chars, n)`; chars is null for elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for host, key, page in zip(*(batch.column(c).to_pylist() for c in ("host", "page", "html"))):
                elements: Counter = Counter()
                seen: dict[int, list] = {}
                for path, text, _, _ in blocks_of(page, elements):
                    seen.setdefault(_hash(f"{path}\n{text}"), [path, len(text), 0])[2] += 1
                seen |= {_hash(path): [path, None, n] for path, n in elements.items()}
                for token, (path, chars, n) in seen.items():
                    for column, value in zip(rows, (host, key, token, path, chars, n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.string()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.string()),
                 pa.array(rows[4], pa.int64()), pa.array(rows[5], pa.int64())], ["host", "page", "token", "path", "chars", "n"])

    return pages.mapInArrow(run, "host string, page long, token long, path string, chars long, n long")


def templates(pages: DataFrame) -> DataFrame:
    """`(host, main, wording)`: the main slot's path and the hashes of fixed wording, for `pages(url, html)`."""
    keyed = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page"), "html").dropDuplicates(["host", "page"])
    # Vectors are summed up per task before the shuffle, so a host of any size is spread.
    vectors = _tokens(keyed).groupBy("host", "token").agg(
        F.first("path").alias("path"), F.max("chars").alias("chars"), F.count("*").alias("pages"),
        F.min("n").alias("least"), F.max("n").alias("most"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"))
    vectors = materialize(vectors, "html-vectors")
    sizes = pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("page")).distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    ranked = vectors.join(sizes, "host").where(F.col("host_pages") >= LEAST_PAGES)
    fixed = (F.col("least") == F.col("most")) & (2 * F.col("pages") >= F.col("host_pages")) & (F.col("pages") >= LEAST_PAGES)
    whole = ranked.where(fixed & (F.col("pages") == F.col("host_pages")))
    root = whole.where("chars IS NULL AND most = 1").groupBy("host").agg(F.min_by("path", F.struct(F.length("path"), "path")).alias("root"))
    nested = whole.join(root, "host").where(F.startswith(F.concat("path", F.lit("/")), F.concat("root", F.lit("/"))))
    # Every page holds each member, so a class has no more members than a page has tokens.
    classes = nested.groupBy("host", "most", "vector").agg(F.collect_list(F.struct("token", "chars")).alias("members"))
    member = classes.where(F.size("members") >= LEAST_MEMBERS).select("host", F.explode("members").alias("m")).select("host", "m.*")
    words = materialize(member.where("chars IS NOT NULL").select("host", "token"), "html-wording")
    wording = words.groupBy("host").agg(F.sort_array(F.collect_list("token")).alias("wording"))
    last = F.split_part(F.element_at(F.split("path", "/"), -1), F.lit("."), F.lit(1))
    elements = ranked.where(fixed & F.col("chars").isNull() & ~last.isin(*PARTS)).select("host", F.col("path").alias("element"))
    varying = ranked.where("chars IS NOT NULL").join(words, ["host", "token"], "left_anti").select("host", "path", (F.col("chars") * F.col("pages")).alias("mass"))
    varying = varying.groupBy("host", "path").agg(F.sum("mass").alias("mass"))
    under = varying.join(elements, "host").where(F.startswith(F.concat("path", F.lit("/")), F.concat("element", F.lit("/"))))
    total = varying.groupBy("host").agg(F.sum("mass").alias("all_mass"))
    main = under.groupBy("host", "element").agg(F.sum("mass").alias("mass")).join(total, "host").where("2 * mass >= all_mass").groupBy("host").agg(
        F.max_by("element", F.struct(F.length("element"), "element")).alias("main"))
    return main.join(wording, "host", "full").select("host", "main", F.coalesce("wording", F.array().cast("array<long>")).alias("wording"))


def extract(pages: DataFrame) -> DataFrame:
    """`(page_id, url, text, n_chars)` of every page."""
    template = materialize(templates(pages), "html-templates")
    if template.count() <= BROADCAST_HOSTS:
        template = F.broadcast(template)
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host")).join(template, "host", "left")
    kinds = dict(pages.select("page_id").dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, set[int]] = {}
        for batch in batches:
            out = []
            for host, page, main, wording in zip(*(batch.column(c) for c in ("host", "html", "main", "wording"))):
                host = host.as_py()
                if host not in sets:
                    sets = sets if len(sets) < 1000 else {}
                    sets[host] = set(wording.as_py() or ())
                out.append(main_text(page.as_py(), main.as_py(), sets[host]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return rows.select("page_id", "url", "html", "host", "main", "wording").mapInArrow(
        run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
