"""Main text of web pages by consensus host paths.

A page is read into blocks of text, each under a stack of containers, which have generalised tag-class paths (digits become
'#'). Containers that are menus, headers, footers, notices, adverts, forms or comments by tag, role or class are set
aside; in an article only those whose class says nothing else. What the names don't say the host's pages do: a path outside
articles whose text hardly differs between different pages of its host is set aside too. Then, if articles or mains hold
most of the other text, the deepest container with all of theirs gets the page's vote for its path, or else the deepest
with all of the page's; no vote goes inside an article or to a list, table or quote. Both are counted per host in Spark;
pages are read again with the paths that won on their host, most votes first. A page keeps its own best container if it
has none of them or they hold less of its text.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.plans.lineage import cut

#: The share of a page's text that articles and mains must hold for the rest of it not to be main text.
MOST = 0.6
#: A path wins on a host with this share of its votes.
WINS = 0.05
#: Different pages with a path from which its texts are compared, and different texts, as a share of them, up to which it is set aside.
PAGES, DIFFERENT = 4, 0.3
#: Paths of all hosts up to which they are broadcast; parts that a host's pages are dealt out in beyond that.
PATHS, SALTS = 100_000, 64

# Tags by role, and words of class names, ids and roles that mark what isn't main text.
CONTAINERS = frozenset("article main section div nav header footer aside form ul ol dl table figure blockquote details dialog fieldset menu center".split())
PARTS = frozenset("ul ol dl table figure blockquote details".split())
NAMED = ("article", "main")
BLOCKS = CONTAINERS | frozenset("body p h1 h2 h3 h4 h5 h6 br hr li dt dd tr td th caption thead tbody tfoot pre address figcaption summary option html head title legend".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
RAW = frozenset("script style noscript template textarea iframe svg title".split())
SILENT = RAW | frozenset("select button object canvas audio video map datalist".split())
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion banner cookie cookies consent
    gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup login sidebar sidebars side
    widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pager pagination footer foot footnav copyright share sharing
    social related recommended recommendations comment comments commentlist disqus replies reply respond discussion reader responses
    complementary contentinfo search hidden""".split()
)
NEUTRAL = frozenset("area articles bar block body box button buttons container content form inner items line link links list main outer panel post posts row section slot text title top unit wrap wrapper".split())
HEADS = frozenset("header masthead topbar banner head".split())
COMMENTS = frozenset("comment comments reply replies respond responses disqus discussion".split())

_SPECIAL, _TAG = re.compile(r"[>\"']"), re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
_ENDS = {t: re.compile(rf"</{t}\s*>" if t in RAW else rf"<(/?){t}(?=[\s/>])", re.I) for t in SILENT}
_ATTR = re.compile(r"""(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"[^\s.#/]+")


def markup(source: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, tag, whether it ends one, attributes) of each piece of markup; tag is '' for comments and the like.

    A silent element is one piece, if it ends; one that has no end tag, or another of its kind before that, is its tag
    only (script and style go to the end of the page). Each place is looked at a bounded number of times, whatever a page
    leaves open: what was found not to end is kept.
    """
    special = [m.start() for m in _SPECIAL.finditer(source)]
    last = {q: source.rfind(q) for q in "\"'"}
    dead: set[int] = set()  # quotes from which no end of a tag is reached
    endless: set[str] = set()

    def closed(at: int) -> int:
        """The place of the '>' that ends a tag, where quotes hide it; if they are left open, the next one; -1 without any."""
        i, passed = bisect_left(special, at), []
        while i < len(special):
            p = special[i]
            if source[p] == ">":
                return p
            passed.append(p)
            if p in dead or last[source[p]] == p:
                break
            i = bisect_left(special, source.find(source[p], p + 1) + 1)
        dead.update(passed)
        return source.find(">", at)

    def silenced(tag: str, at: int) -> int:
        """Where a silent element ends whose tag ends at `at`."""
        end = None if tag in endless else _ENDS[tag].search(source, at)
        if end is None:
            endless.add(tag)
            return len(source) if tag in ("script", "style") else at
        if tag in RAW:
            return end.end()
        return source.find(">", end.end()) + 1 or len(source) if end[1] else at

    at = source.find("<")
    while at >= 0:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            end = len(source) if end < 0 else end + 3
            yield at, end, "", False, ""
        elif m := _TAG.match(source, at):
            stop = closed(m.end())
            if stop < 0:  # no tag ends any more
                return
            end, tag, attrs = stop + 1, m[2].lower(), source[m.end() : stop]
            if tag in SILENT:
                if not m[1] and not (tag == "svg" and attrs.endswith("/")):
                    end = silenced(tag, end)
                tag = "hr"  # sets what stands around it apart
            yield at, end, tag, bool(m[1]), attrs
        elif source.startswith(("<!", "<?", "</"), at):
            end = source.find(">", at) + 1
            if not end:
                return
            yield at, end, "", False, ""
        else:
            end = at + 1
        at = source.find("<", end)


def attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): (m[2] or "").strip("\"'") for m in _ATTR.finditer(text)} if text.strip() else {}


def set_aside(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Whether a container isn't main text, by its tag, role, class and id."""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    if tag in ASIDE:
        return True
    said = {w.lower() for k in ("class", "id", "role") if k in attrs for w in _WORDS.findall(attrs[k])}
    if tag in ("main", "article"):
        return tag == "article" and bool(said & COMMENTS)
    if tag == "header" or said & HEADS:
        return not in_article
    if in_article:  # an article may be about sharing or notices: all words of a name must say that it isn't its text
        names = [[w.lower() for w in _WORDS.findall(x)] for k in ("class", "id", "role") for x in _NAME.findall(attrs.get(k, ""))]
        return any(set(n) & MARKS and set(n) <= MARKS | NEUTRAL for n in names)
    return bool(said & MARKS)


def path_of(parent: int, name: str) -> int:
    """The 63 bits that stand for a path: its parent's and the container's generalised name."""
    return xxhash.xxh64_intdigest(name, seed=parent) >> 1


class Page:
    """Blocks of a page: (text, container), where containers are indices into paths, parents and tags; named: in an article or main."""

    def __init__(self, source: str, static: frozenset[int] = frozenset()):
        self.paths, self.parents, self.tags, self.named, self.blocks = [0], [-1], [""], [False], []
        stack = [("", 0, False)]  # tag, container, set aside
        opened: Counter[str] = Counter()
        piece: list[str] = []
        def end() -> None:
            if piece:
                text = " ".join(html.unescape("".join(piece)).split())
                piece.clear()
                if text and not stack[-1][2]:
                    self.blocks.append((text, stack[-1][1]))

        at = 0
        for start, stop, tag, ends, said in markup(source):
            if start > at:
                piece.append(source[at:start])
            at = stop
            if tag not in BLOCKS:
                continue
            end()
            if tag not in CONTAINERS:
                continue
            if ends:
                if opened[tag]:
                    while (last := stack.pop()[0]) != tag:
                        opened[last] -= 1
                    opened[tag] -= 1
            else:
                attrs = attributes(said)
                _, parent, aside = stack[-1]
                names = sorted({_DIGITS.sub("#", x) for k in ("class", "id") for x in _NAME.findall(attrs.get(k, ""))})
                self.paths.append(path_of(self.paths[parent], ".".join([tag, *names])))
                self.parents.append(parent)
                self.tags.append(tag)
                self.named.append(self.named[parent] or tag in NAMED)
                opened[tag] += 1
                away = aside or set_aside(tag, attrs, self.named[parent]) or self.paths[-1] in static and not self.named[-1]
                stack.append((tag, len(self.paths) - 1, away))
        piece.append(source[at:])
        end()

    def summed(self, of) -> list[int]:
        """For each container the sum of what `of` gives for the texts of its blocks, those of containers in it included."""
        total = [0] * len(self.paths)
        for text, at in self.blocks:
            total[at] += of(text)
        for k in range(len(total) - 1, 0, -1):
            total[self.parents[k]] += total[k]
        return total

    def texts(self) -> Iterator[tuple[int, int, int]]:
        """(path, text, page) of each container outside articles that has text: its path, and hashes of its text and of the page's."""
        total = self.summed(lambda text: xxhash.xxh64_intdigest(text) >> 8)
        for k in range(1, len(total)):
            if total[k] and not self.named[k]:
                yield self.paths[k], total[k] & (1 << 63) - 1, total[0] & (1 << 63) - 1

    def best(self) -> tuple[int, bool]:
        """The deepest container with all text of articles and mains, and True, if they hold most of what isn't set aside; or else that with all text, and False."""
        whole = sum(len(text) for text, _ in self.blocks)
        inside = sum(len(text) for text, at in self.blocks if self.named[at])
        only = inside > 0 and inside >= MOST * whole
        size = [0] * len(self.paths)
        for text, at in self.blocks:
            if self.named[at] or not only:
                size[at] += len(text)
        for k in range(len(size) - 1, 0, -1):
            size[self.parents[k]] += size[k]
        found = 0
        for k in range(1, len(size)):
            if size[k] == size[0] and self.parents[k] == found and not self.named[found] and self.tags[k] not in PARTS:
                found = k
        return found, only

    def under(self, path: int) -> tuple[str, bool]:
        """The text under a path, and whether an article or main has it."""
        of, named = [False] * len(self.paths), False
        for k in range(1, len(of)):
            of[k] = self.paths[k] == path or of[self.parents[k]]
            named = named or self.paths[k] == path and self.tags[k] in NAMED
        return " ".join(t for t, at in self.blocks if of[at]), named

    def text(self, wanted: list[int]) -> str:
        """The text under the first wanted path that the page has, or else under its own best container.

        A path that holds less than the best container is passed over, unless it is an article's or main's and the best isn't.
        """
        found, only = self.best()
        best = self.under(self.paths[found])[0] if found else " ".join(t for t, _ in self.blocks)
        have = set(self.paths)
        for path in wanted:
            if path in have:
                text, named = self.under(path)
                if text and (len(text) >= len(best) or not only and named):
                    return text
        return best


def host(url):
    """The lower-case host of a url column; '' for a null or a url without one."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def static_paths(pages: DataFrame) -> DataFrame:
    """(host, static): the paths of pages (host, html) outside articles whose text hardly differs between different pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *x) for h, source in zip(batch.column(0).to_pylist(), batch.column(1)) for x in Page(source.as_py() or "").texts()]
            columns = [pa.array([r[k] for r in rows], pa.int64() if k else pa.string()) for k in range(4)]
            yield pa.RecordBatch.from_arrays(columns, names=["host", "path", "text", "page"])

    found = pages.mapInArrow(run, "host string, path long, text long, page long")
    counted = found.groupBy("host", "path").agg(F.approx_count_distinct("text").alias("texts"), F.approx_count_distinct("page").alias("of"))
    return counted.where((F.col("of") >= PAGES) & (F.col("texts") <= DIFFERENT * F.col("of"))).groupBy("host").agg(F.collect_list("path").alias("static"))


def votes(pages: DataFrame) -> DataFrame:
    """(host, paths): the winning paths of each host of pages (host, html, static), most votes first. A page without text has no vote."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = [], []
            for h, source, static in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                page = Page(source.as_py() or "", frozenset(static.as_py() or ()))
                if page.blocks and (best := page.best()[0]):
                    hosts.append(h)
                    paths.append(page.paths[best])
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(paths, pa.int64())], names=["host", "path"])

    counted = pages.mapInArrow(run, "host string, path long").groupBy("host", "path").agg(F.count("*").alias("n"))
    total = counted.groupBy("host").agg(F.sum("n").alias("total"))
    winners = counted.join(total, "host").where(F.col("n") >= WINS * F.col("total"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("k"), "path")))
    return winners.groupBy("host").agg(ranked.alias("ranked")).select("host", F.col("ranked.path").alias("paths"))


def _with(pages: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """pages with a column of the table of their host: few paths are broadcast, and for many, salts spread the pages of a large host."""
    table = cut(table)
    if (table.agg(F.sum(F.size(column))).first()[0] or 0) <= PATHS:
        return pages.join(F.broadcast(table), "host", "left")
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages (page_id, url, html).

    A null or empty html, or one without main text, has the text ''. A null url, or one without a host, is of the host ''.
    Repeated rows are read each for itself, but equal pages count as one where texts of a host are compared; of paths with
    as many votes the one with the smaller hash is first. Pages of any length and depth are read whole; an empty table
    gives an empty one, and other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [Page(s.as_py() or "", frozenset(x.as_py() or ())).text(w.as_py() or []) for s, x, w in zip(batch.column(2), batch.column(3), batch.column(4))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    known = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    known = _with(known, static_paths(known.select("host", "html")), "static")
    known = _with(known, votes(known.select("host", "html", "static")), "paths")
    return known.select("page_id", "url", "html", "static", "paths").mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
