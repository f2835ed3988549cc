"""Main text of web pages by consensus paths of a host.

Each page is scanned into containers; a container's score is its running text, that of inner containers counting a
little less with each level, link text not at all. The best container of a page is written as a generalised path of
tags and classes (digits become #), and the pages of a host vote on paths in Spark. Every page is then read again with
its host's winning path; where a page lacks that path, its own best container stands in. Menus, headers, footers,
sidebars, notices, adverts, forms, comments, scripts and styles are left out by tag, role or class.

Defined edge cases: null and empty pages give the empty text; pages without tags give their own text; truncated tags,
comments and character references at the end are markup; urls that are null or have no host share one host; repeated
rows are extracted alike; time and memory grow with a page's length alone, however deep it is nested; columns that
clash with a result column are replaced.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^>"'])*+)(?:>|\Z)"""
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"""(?i)(?:^|[\s/"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)|'([^']*)|([^\s"'>]+)))?""")
_RAW = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "select", "object", "canvas")}
#: Fixed values of HTML: elements that have no end tag, that are blocks, and that hold no part of an article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul br".split())
CONTAINER = set("article main section div td body blockquote center table".split())
LEFT_OUT = set("nav header footer aside form button dialog menu head label input".split())
#: Words in classes, ids and roles that mark what is not the article.
MARKS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent gdpr notice notices banner alert comment comments respond reply replies disqus share sharing social related recommended newsletter subscribe subscription signup popup modal widget toolbar pagination contentinfo complementary search".split())
KEPT_ALWAYS = {"html", "body", "article", "main"}
_SPLIT = re.compile(r"[\s_-]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_CLOSES_P = BLOCK - {"br"}
_WALLS = CONTAINER | LEFT_OUT
DECAY, BONUS = 0.9, 1.5
FIELDS = [T.StructField("path", T.StringType()), T.StructField("score", T.DoubleType())]


def _describe(tag: str, attrs: str) -> tuple[str, bool]:
    """Generalised name of an element, and whether it is left out."""
    out, names, marked = tag in LEFT_OUT, [], False
    if attrs and not attrs.isspace():
        for m in _ATTR.finditer(attrs):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
                marked = True
                continue
            words = {w for w in _SPLIT.split(_CAMEL.sub(" ", value).lower()) if w}
            if key != "aria-hidden" and words & MARKS:
                marked = True
            if key == "class":
                names += sorted(value.split())[:3]
    return re.sub(r"\d+", "#", ".".join([tag, *names])).replace(">", "#"), out or (marked and tag not in KEPT_ALWAYS)


class Page:
    """Containers (name, parent, kind of path) and text events (container, text, in a link; None: a break).

    Paths are interned as (path of the parent, name), so deep nesting takes memory in proportion to the page; open
    elements are found by their tag's own list of places, so time is in proportion too."""

    def __init__(self, source: str):
        self.names, self.parents, self.tags, self.kinds = [""], [-1], ["html"], [0]
        self.interned: dict[tuple[int, str], int] = {}
        self.events: list[tuple[int, str | None, bool]] = []
        stack: list[tuple[str, int, int, bool]] = []  # tag, container, links open, left out
        places: dict[str, list[int]] = {}  # places in the stack, by tag
        walls: list[int] = []  # places of elements that an open paragraph does not reach beyond
        node, links, out = 0, 0, False
        pos, n = 0, len(source)
        match = _TOKEN.match

        def close(k: int) -> tuple[int, int, bool]:
            """Pop all from place k on."""
            _, *before = stack[k]
            for tag, *_ in reversed(stack[k:]):
                places[tag].pop()
                if tag in _WALLS:
                    walls.pop()
            del stack[k:]
            return tuple(before)

        while pos < n:
            m = match(source, pos)
            pos = m.end()
            text = m["text"]
            if text is not None:
                if not out:
                    self.events.append((node, text, links > 0))
                continue
            tag = m["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if m["end"]:
                if places.get(tag):
                    node, links, out = close(places[tag][-1])
                if tag in BLOCK:
                    self.events.append((node, None, False))
                continue
            if tag in _RAW:
                e = _RAW[tag].search(source, pos)
                pos = e.end() if e else n
                continue
            if tag in BLOCK:
                self.events.append((node, None, False))
            if tag in _CLOSES_P and places.get("p") and places["p"][-1] > (walls[-1] if walls else -1):
                # A block ends an open paragraph and what is still open inside it.
                node, links, out = close(places["p"][-1])
            if tag in VOID:
                continue
            if tag in _WALLS:
                walls.append(len(stack))
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, node, links, out))
            name, drop = _describe(tag, m["attrs"])
            if not out and not drop and tag in CONTAINER:
                self.kinds.append(self.interned.setdefault((self.kinds[node], name), len(self.interned) + 1))
                self.names.append(name)
                self.parents.append(node)
                self.tags.append(tag)
                node = len(self.names) - 1
            out = out or drop
            links += tag == "a"

    def best(self) -> tuple[int, float]:
        score = [0.0] * len(self.names)
        for node, text, link in self.events:
            if text and not link:
                score[node] += len(text) - text.count(" ") if not text.isspace() else 0
        for i in range(len(score) - 1, 0, -1):
            score[self.parents[i]] += DECAY * score[i]
        value = [s * (BONUS if t in ("article", "main") else 1.0) for s, t in zip(score, self.tags, strict=True)]
        k = max(range(len(value)), key=lambda i: (value[i], -i))
        return k, value[k]

    def path(self, i: int) -> str:
        """The generalised path of a container."""
        names = []
        while i > 0:
            names.append(self.names[i])
            i = self.parents[i]
        return "".join(f">{x}" for x in reversed(names))

    def _within(self, path: str) -> list[bool]:
        """Which containers have the path or are inside one that has it."""
        kind = 0
        for name in path.split(">")[1:]:
            kind = self.interned.get((kind, name), -1)
        inside = [kind == 0]
        for own, parent in zip(self.kinds[1:], self.parents[1:], strict=True):
            inside.append(own == kind or inside[parent])
        return inside

    def text(self, path: str | None) -> str:
        """Text of the containers with that path, else of the page's best container."""
        inside = self._within(path) if path is not None else []
        if not any(inside) or not any(t and not t.isspace() and inside[n] for n, t, _ in self.events):
            k = self.best()[0]
            inside = [i == k for i in range(len(self.names))]
            for i in range(k + 1, len(inside)):
                inside[i] = inside[self.parents[i]]
        parts = [" " if t is None else html.unescape(t) for n, t, _ in self.events if inside[n]]
        return " ".join("".join(parts).split())


def extract(pages: DataFrame, *, html_col: str = "html", url_col: str = "url") -> DataFrame:
    """pages with host, path (the host's winner) and text."""
    host = F.coalesce(F.nullif(F.lower(F.regexp_extract(F.col(url_col), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit("")), F.lit(""))

    def vote():
        def f(batch: pa.RecordBatch) -> list:
            found = []
            for source in batch.column(0).to_pylist():
                page = Page(source or "")
                k, score = page.best()
                found.append((page.path(k), score))
            return list(map(list, zip(*found, strict=True))) if found else [[], []]

        return f

    votes = common.append_columns(pages.select(html_col, host.alias("host")), vote, FIELDS).where("score > 0").select("host", "path", "score")
    tally = votes.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"))
    winner = tally.groupBy("host").agg(F.max_by("path", F.struct("n", "score", "path")).alias("path"))

    def read():
        def f(batch: pa.RecordBatch) -> list:
            return [[Page(s).text(p) if s else "" for s, p in zip(batch.column(html_col).to_pylist(), batch.column("path").to_pylist(), strict=True)]]

        return f

    df = pages.drop("host", "path", "text").withColumn("host", host).join(common.materialise(winner), "host", "left")
    return common.append_columns(df, read, [T.StructField("text", T.StringType())])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract(common.read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
