"""Main text of web pages by the consensus of a host's pages.

Each page is read once into blocks of text and their containers. Containers are scored by the text
that stands in them, links taken off; the best one's path, its tags and classes from the body down with
numbers taken out, is the page's vote. Votes are counted per host by Spark, and every page of the host is then read
with the winning path; a page without such a container, or with no text in it, is read with its own best one.

The path only says where the main text is. The container there gives way to the outermost article or main around it,
or without one to the containers below the body that add text to it rather than links; if all that holds less than
half of the page's text, links taken off, the nearest container around the page's best one that holds more is read as well.

A block is text between two block-level tags: character references are decoded, white space becomes one
space, and empty blocks go. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
comments are left out by tag, role, class or id.

Null html is empty and gives an empty text. Pages without a host vote together. Broken markup is closed as browsers do it: an
end tag closes what was opened since. Repeated rows are pages of their own. An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushmark.llm.common import binary

_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|[!?/][^>]*>)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_RAW = {name: re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
_LEFT_OUT = frozenset("head script style noscript template nav footer aside form button select option textarea iframe svg object canvas dialog menu title xmp audio video".split())
_BLOCKS = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table caption thead tbody tfoot tr td th figure figcaption address details summary hr header center fieldset hgroup".split()) | _LEFT_OUT
_CONTAINERS = frozenset("body article main section div center".split())
_VOID = frozenset({"hr"})
_CLOSES_P = _BLOCKS - {"body", "html", "head"}
#: Siblings that end each other when the end tag is left out.
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Parts of names that mark what isn't the article.
_BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|sponsor(?:ed)?|promo(?:tion)?s?|banner|nav(?:bar|igation)?|menu|breadcrumbs?|sidebar|side-bar|footer|masthead|site-header|page-header|"
    r"comments?|comment-list|disqus|replies|respond|cookies?|consent|notices?|alerts?|popup|modal|newsletter|subscribe|signup|share|sharing|social|related|recommended|widget|toolbar|pagination|pager|skip-link)(?:$|[\s_-])",
    re.IGNORECASE,
)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_ARTICLE = re.compile(r"article|content|post|entry|story|main|text", re.IGNORECASE)


class Page:
    """Nodes (tag, path, parent, whether left out, bonus) and blocks (node, text, length without links)."""

    def __init__(self, source: str):
        self.nodes: list[tuple[str, str, int, bool, float]] = [("", "", -1, False, 1.0)]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        stack, at, n = [0], 0, len(source)
        held: list[str] = []
        linked, in_link = 0, False

        def flush() -> None:
            nonlocal linked, in_link
            if held:
                if not self.nodes[stack[-1]][3]:
                    text = " ".join(entities.unescape("".join(held)).split())
                    if text:
                        self.blocks.append((stack[-1], text, max(len(text) - linked, 0)))
                held.clear()
            linked, in_link = 0, False

        def text(piece: str) -> None:
            nonlocal linked
            held.append(piece)
            if in_link:
                linked += len(piece)

        while at < n:
            m = _TAG.search(source, at)
            if m is None:
                text(source[at:])
                break
            if m.start() > at:
                text(source[at : m.start()])
            at = m.end()
            close, name, rest = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not name:
                continue
            name = name.lower()
            if name == "a":
                in_link = not close
                continue
            if name == "br":
                held.append(" ")
                continue
            if name not in _BLOCKS:
                continue
            flush()
            if close:
                depth = next((k for k in range(len(stack) - 1, 0, -1) if self.nodes[stack[k]][0] == name), 0)
                if depth:
                    del stack[depth:]
                continue
            if name in _CLOSES_P and self.nodes[stack[-1]][0] == "p":
                stack.pop()
            if name in _SIBLINGS:
                same, within = _SIBLINGS[name]
                for k in range(len(stack) - 1, 0, -1):
                    if self.nodes[stack[k]][0] in within:
                        break
                    if self.nodes[stack[k]][0] in same:
                        del stack[k:]
                        break
            if name in _VOID:
                continue
            parent = stack[-1]
            self._open(name, rest, parent)
            if rest.endswith("/") and name in ("script", "iframe"):
                continue
            if name in _RAW:
                end = _RAW[name].search(source, at)
                at = end.end() if end else n
                continue
            stack.append(len(self.nodes) - 1)
        flush()

    def _open(self, name: str, rest: str, parent: int) -> None:
        _, above, _, left_out, _ = self.nodes[parent]
        classes = ids = role = ""
        if "=" in rest:
            for a in _ATTRIBUTE.finditer(rest):
                value = a[2] or a[3] or a[4] or ""
                kind = a[1].lower()
                if kind == "class":
                    classes = value
                elif kind == "id":
                    ids = value
                elif kind == "role":
                    role = value.lower()
                elif value.lower() == "true":
                    left_out = True
        within = above.startswith(("article", "main")) or "/article" in above or "/main" in above
        left_out = left_out or name in _LEFT_OUT or role in _ROLES or (name == "header" and not within)
        if not left_out and name not in ("html", "body", "main"):
            left_out = bool(classes and _BOILERPLATE.search(classes)) or bool(ids and _BOILERPLATE.search(ids))
        general = ".".join([name, *sorted({re.sub(r"\d+", "", c) for c in classes.lower().split()} - {""})])
        path = f"{above}/{general}" if above else general
        bonus = 1.25 if name in ("article", "main") or _ARTICLE.search(f"{classes} {ids}") else 1.0
        self.nodes.append((name, path, parent, left_out, bonus))

    def best(self) -> int:
        """The container with the highest score, the first of equals; 0, the page itself, if there is none."""
        scores: dict[int, float] = {}
        for node, text, free in self.blocks:
            tag = self.nodes[node][0]
            if len(text) < 25 and tag not in ("p", "h1", "h2", "h3", "li", "pre", "blockquote"):
                continue
            share = float(free)
            while node > 0 and share >= 1:
                tag, _, parent, _, bonus = self.nodes[node]
                if tag in _CONTAINERS:
                    scores[node] = scores.get(node, 0.0) + share * bonus
                    share /= 2
                node = parent
        return min(scores, key=lambda k: (-scores[k], k)) if scores else 0

    def below(self, roots: set[int]) -> list[tuple[int, str, int]]:
        """Blocks below the containers, in page order."""
        inside: dict[int, bool] = {}

        def belongs(node: int) -> bool:
            seen = []
            while node not in inside and node not in roots and node > 0:
                seen.append(node)
                node = self.nodes[node][2]
            found = node in roots or inside.get(node, False)
            for k in seen:
                inside[k] = found
            return found

        return [block for block in self.blocks if belongs(block[0])]

    def whole(self, roots: set[int]) -> list[tuple[int, str, int]]:
        """Blocks of the whole text of which the containers are a part."""
        free, every = [0] * len(self.nodes), [0] * len(self.nodes)
        for node, text, own in self.blocks:
            free[node] += own
            every[node] += len(text)
        for k in range(len(self.nodes) - 1, 0, -1):
            free[self.nodes[k][2]] += free[k]
            every[self.nodes[k][2]] += every[k]

        def widened(k: int) -> int:
            wide, marked, node, prose = k, 0, k, True
            while node > 0:
                tag = self.nodes[node][0]
                if tag in ("article", "main"):
                    marked = node
                prose = prose and tag != "body" and 2 * (free[node] - free[wide]) >= every[node] - every[wide]
                if prose and tag in _CONTAINERS:
                    wide = node
                node = self.nodes[node][2]
            return marked or wide

        wide = {widened(k) for k in roots}
        found = self.below(wide)
        if 2 * sum(own for _, _, own in found) < free[0]:
            k = self.best()
            while k and 2 * free[k] < free[0]:
                k = self.nodes[k][2]
            found = self.below(wide | {widened(k)})
        return found

    def text(self, roots: set[int]) -> str:
        return "\n".join(text for _, text, _ in self.whole(roots))

    def vote(self) -> str:
        return self.nodes[self.best()][1]

    def extract(self, path: str | None) -> str:
        roots = {k for k, node in enumerate(self.nodes) if k and node[1] == path and not node[3]}
        return (self.text(roots) if roots else "") or self.text({self.best()})


def _texts(column: pa.Array) -> Iterator[str]:
    for value in binary(column):
        yield value.as_py().decode("utf-8", "replace")


def host(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, pages: how many pages of a host have their best container at a path."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array([Page(t).vote() for t in _texts(batch.column("html"))], pa.string())], ["host", "path"])

    found = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(work, "host string, path string")
    return found.where("path != ''").groupBy("host", "path").agg(F.count("*").alias("pages"))


def consensus(counted: DataFrame) -> DataFrame:
    """The path of each host with most votes; of equals, the first by name."""
    best = counted.groupBy("host").agg(F.min(F.struct((-F.col("pages")).alias("less"), "path")).alias("best"))
    return best.select("host", F.col("best.path").alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars.

    Winning paths are first given to page ids, which are small rows, and then to the pages by their ids: a host with a third of
    all pages doesn't bring its pages together.
    """
    given = pages.select("page_id", "url", "html", host(F.col("url")).alias("host"))
    paths = given.select("page_id", "host").distinct().join(consensus(votes(pages)), "host").select(F.col("page_id").alias("id"), F.col("host").alias("of"), "path")
    paired = given.join(paths, given["page_id"].eqNullSafe(paths["id"]) & (given["host"] == paths["of"]), "left").select("page_id", "url", "html", "path")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(t).extract(p.as_py()) for t, p in zip(_texts(batch.column("html")), batch.column("path"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return paired.mapInArrow(work, f"page_id {kind}, url string, text string, n_chars long")
