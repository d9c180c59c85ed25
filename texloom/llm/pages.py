"""Main text of web pages by consensus of a host's pages.

Every page scores its containers by the paragraphs they hold, votes for the generalised tag-class
paths of the best of them, and Spark sums the votes per host. The path that wins on a host is
then used to extract all its pages again; a page without that path falls back on its own
best container.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from texloom.llm.common import frugal, stage

#: A tag after its "<": slash, name, attributes up to ">" or the next "<". Quotes count after "=" only, and only if
#: closed. No part gives back what it took, so a page is read in one pass whatever it holds.
TAG = re.compile(r"(/?)([A-Za-z][^\s/<>]*+)((?:[^<>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>?")
CLASSES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.IGNORECASE)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")

#: What stands up to the end tag is text of the page's source, not markup.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
#: Elements whose text is not the page's; those that are never closed count for nothing.
MUTE = frozenset("noscript template iframe svg math select object audio video canvas button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "html head body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address hr details summary center dialog menu".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre td th figcaption summary".split())
CONTAINERS = frozenset("article main section div td body center".split())
#: An opening tag on the left ends an open element on the right if none of its barriers lies between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
}
NOT_TEXT_TAGS = frozenset("nav footer aside form menu dialog head".split())
NOT_TEXT_NAMES = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert advertisement adverts sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal "
    "newsletter subscribe signup share sharing social related recommended comment comments commentlist reply replies respond disqus form login search pagination pager toolbar widget masthead contentinfo complementary skip".split()
)
HEADINGS = frozenset(("h1", "h2"))
#: What an opening block ends if IMPLIED says nothing else.
ENDS_P = (("p",), ("td", "th", "div", "article", "section", "main", "blockquote", "li", "dd", "body", "aside", "footer", "header", "nav", "form"))
#: Inside a muted element a block ends nothing outside it.
MUTE_BARRIERS = tuple(sorted(MUTE))


def tags_of(source: str) -> list[tuple[int, int, bool, str, str]]:
    """Comments, declarations, raw elements (name "") and tags: start, end, closing, name, attributes. Linear in the page."""
    out: list[tuple[int, int, bool, str, str]] = []
    endless: set[str] = set()
    at = source.find("<")
    while at >= 0:
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            out.append((at, end + 3 if end >= 0 else len(source), False, "", ""))
        elif source.startswith(("<!", "<?"), at):
            end = source.find(">", at)
            out.append((at, end + 1 if end >= 0 else len(source), False, "", ""))
        elif m := TAG.match(source, at + 1):
            name, end = m[2].lower(), m.end()
            if name in RAW and not m[1]:
                # An element without an end tag is only a tag; that there is none is found out once.
                found = None if name in endless else re.compile(rf"</{name}\s*+>?", re.IGNORECASE).search(source, end)
                if found:
                    end = found.end()
                elif name in ("script", "style"):
                    end = len(source)
                else:
                    endless.add(name)
                out.append((at, end, False, "", ""))
            else:
                out.append((at, end, bool(m[1]), name, m[3]))
        else:
            at = source.find("<", at + 1)
            continue
        at = source.find("<", out[-1][1])
    return out


def never_closed(tags: list[tuple[int, int, bool, str, str]]) -> set[int]:
    """Places of opening tags of MUTE that are self-closed or have no end tag of their own."""
    lost: set[int] = set()
    opened: dict[str, list[int]] = {}
    for at, _, closing, name, attributes in tags:
        if name not in MUTE:
            continue
        if closing:
            if opened.get(name):
                opened[name].pop()
        elif attributes.endswith("/"):
            lost.add(at)
        else:
            opened.setdefault(name, []).append(at)
    return lost.union(*opened.values())


class Page:
    """Elements of a page in order, and its blocks of text: (element, text, characters in links)."""

    def __init__(self, source: str) -> None:
        self.tags, self.parents, self.parts, self.bad = [""], [-1], [""], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._read(source)

    def _read(self, source: str) -> None:
        tags, parents = self.tags, self.parents
        stack, blocks, text, links = [0], [0], [], 0
        depths: dict[str, list[int]] = {}  # where in the stack elements of a name are open
        in_link = muted = 0

        def flush() -> None:
            nonlocal text, links
            if text:
                words = html.unescape("".join(text)).split()
                if words:
                    self.blocks.append((blocks[-1], " ".join(words), links))
            text, links = [], 0

        def close(depth: int) -> None:
            nonlocal in_link, muted
            while len(stack) > depth:
                e = stack.pop()
                name = tags[e]
                depths[name].pop()
                in_link -= name == "a"
                muted -= name in MUTE
                if name in BLOCKS:
                    blocks.pop()

        def innermost(names: tuple[str, ...]) -> int:
            return max((depths[x][-1] for x in names if depths.get(x)), default=0)

        found = tags_of(source)
        ignored = never_closed(found)
        at = 0
        for start, end, closing, name, attributes in [*found, (len(source), len(source), False, "", "")]:
            if start > at and not muted:
                text.append(source[at:start])
                if in_link:
                    links += start - at
            at = end
            if not name or start in ignored:
                continue
            if closing:
                d = innermost((name,))
                if name in BLOCKS:
                    if d or name == "p":
                        flush()
                        close(d or len(stack))
                elif d and stack[d] > blocks[-1]:  # an inline end tag closes nothing outside its block
                    close(d)
                continue
            if name in VOID:
                if name == "br" or name == "hr":
                    text.append(" ")
                    if name == "hr":
                        flush()
                continue
            if name in BLOCKS:
                flush()
                ends, barriers = IMPLIED.get(name, ENDS_P)
                d = innermost(ends)
                if d > innermost(barriers + MUTE_BARRIERS):
                    close(d)
            e = len(tags)
            tags.append(name)
            parents.append(stack[-1])
            names = [x for three in CLASSES.findall(attributes) for y in three if y for x in y.split()] if attributes else []
            general = sorted({re.sub(r"[0-9]+", "#", x).replace(">", "") for x in names if not re.fullmatch(r"[0-9a-fA-F_-]{8,}", x)})
            self.parts.append(".".join([name, *general]))
            words = {w.lower() for x in names for w in NAME_PART.findall(x)} if names else set()
            self.bad.append(name in NOT_TEXT_TAGS or (name not in ("html", "body", "main", "article") and not words.isdisjoint(NOT_TEXT_NAMES)) or bool(attributes and HIDDEN.search(attributes)))
            if attributes.rstrip().endswith("/") and name not in BLOCKS:
                continue
            depths.setdefault(name, []).append(len(stack))
            stack.append(e)
            in_link += name == "a"
            muted += name in MUTE
            if name in BLOCKS:
                blocks.append(e)
        flush()
        self._settle()

    def _settle(self) -> None:
        """Scores of containers; an element is off if it or one above it is bad or a header without a heading."""
        n = len(self.tags)
        held, headed = [0] * n, [False] * n
        for e, t, _ in self.blocks:
            held[e] += len(t)
        for e in range(n - 1, 0, -1):
            held[self.parents[e]] += held[e]
            headed[self.parents[e]] |= headed[e] or self.tags[e] in HEADINGS
        total = max(1, held[0])
        self.off, self.score = [False] * n, [0.0] * n
        inside = [False] * n
        for e in range(1, n):
            p, tag = self.parents[e], self.tags[e]
            # A name says little about an element that holds nearly the whole page.
            bad = self.bad[e] and (tag in NOT_TEXT_TAGS or held[e] < 0.8 * total)
            if tag == "header":
                bad = not (inside[p] and headed[e])
            self.off[e] = self.off[p] or bad
            inside[e] = inside[p] or tag in ("article", "main")
        # The nearest container at or above each element.
        holder = [0] * n
        for e in range(1, n):
            holder[e] = e if self.tags[e] in CONTAINERS else holder[self.parents[e]]
        for e, t, links in self.blocks:
            if self.off[e]:
                continue
            worth = max(0, len(t) - 2 * links) + 25.0 * (self.tags[e] in PARAGRAPHS)
            if self.tags[e] not in PARAGRAPHS:
                worth *= 0.7
            c, share = holder[e], 1.0
            while c > 0 and share > 0.2:
                self.score[c] += worth * share * (1.2 if self.tags[c] in ("article", "main") else 1.0)
                share *= 0.6
                c = holder[self.parents[c]]

    def path(self, e: int) -> str:
        parts = []
        while e > 0:
            parts.append(self.parts[e])
            e = self.parents[e]
        return ">".join(reversed(parts))

    def votes(self, most: int = 3) -> list[tuple[str, float]]:
        """Paths of the page's best containers (three votes a page) and their scores against the best; a page without containers has no vote."""
        ranked = sorted((e for e in range(1, len(self.tags)) if self.score[e] > 0), key=lambda e: (-self.score[e], e))[:most]
        return [(self.path(e), self.score[e] / self.score[ranked[0]]) for e in ranked]

    def text(self, path: str | None) -> str:
        """Blocks under the elements of a path; else under the page's best container; else all that are not off."""
        roots: set[int] = set()
        if path:
            wanted = path.split(">")
            # How many parts of the path end at an element; -1 off the path.
            level = [0] * len(self.tags)
            for e in range(1, len(self.tags)):
                up = level[self.parents[e]]
                level[e] = up + 1 if 0 <= up < len(wanted) and self.parts[e] == wanted[up] else -1
                if level[e] == len(wanted) and not self.off[e]:
                    roots.add(e)
        if not roots:
            ranked = [e for e in range(1, len(self.tags)) if self.score[e] > 0]
            roots = {max(ranked, key=lambda e: (self.score[e], -e))} if ranked else {0}
        under = [False] * len(self.tags)
        under[0] = 0 in roots
        for e in range(1, len(self.tags)):
            under[e] = under[self.parents[e]] or e in roots
        return " ".join(t for e, t, _ in self.blocks if under[e] and not self.off[e])


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


def consensus(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The winning path of each host and its number of pages: __host, __path, __pages.

    Votes are summed before they are shuffled; ties go to the shorter path, then to the first by code point.
    """

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str], list[float]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array([v[0] for v in sums.values()], pa.float64()), pa.array([int(v[1]) for v in sums.values()], pa.int64())],
                names=["__host", "__path", "votes", "pages"],
            )

        for batch in batches:
            for url, source in zip(batch.column(0), batch.column(1), strict=True):
                for rank, (path, v) in enumerate(Page(source.as_py() or "").votes()):
                    held = sums.setdefault((host_of(url.as_py()), path), [0.0, 0])
                    held[0] += v
                    held[1] += rank == 0
            if len(sums) > 20_000:
                yield out()
                sums.clear()
        if sums:
            yield out()

    votes = pages.select(F.col(url_col).cast("string"), F.col(html_col).cast("string")).mapInArrow(frugal(vote), "__host string, __path string, votes double, pages long")
    votes = votes.groupBy("__host", "__path").agg(F.round(F.sum("votes"), 6).alias("v"), F.sum("pages").alias("pages"))
    return votes.groupBy("__host").agg(F.min_by("__path", F.struct(-F.col("v"), F.length("__path"), F.col("__path"))).alias("__path"), F.sum("pages").alias("__pages"))


#: Longest path that is broadcast; with MOST_HOSTS it bounds the broadcast (50 MB at most).
MOST_PATH, MOST_HOSTS = 1000, 50_000


def with_paths(rows: DataFrame, winners: DataFrame, most_hosts: int = MOST_HOSTS) -> DataFrame:
    """Rows (with host) and their host's __path. Paths of the ``most_hosts`` hosts with the most pages are broadcast; if
    there are more hosts, their rows, few for each host, meet their paths by a shuffle."""
    short = F.length("__path") <= MOST_PATH
    if winners.where(short).count() <= most_hosts and not winners.where(~short).head(1):
        return rows.join(F.broadcast(winners.drop("__pages")), F.col("host") == F.col("__host"), "left").drop("__host")
    hot = stage(winners.where(short).orderBy(F.desc("__pages"), "__host").limit(most_hosts).drop("__pages"), "hot_hosts")
    first = rows.join(F.broadcast(hot), F.col("host") == F.col("__host"), "left")
    cold = winners.join(F.broadcast(hot.select("__host")), "__host", "left_anti").drop("__pages")
    return first.where(F.col("__host").isNotNull()).drop("__host").unionByName(first.where(F.col("__host").isNull()).drop("__host", "__path").join(cold, F.col("host") == F.col("__host"), "left").drop("__host"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_broadcast: int = MOST_HOSTS) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars.

    Null html gives an empty text; a null or odd url belongs to the host named by the empty string. Repeated
    rows are pages of their own; other columns are not read, whatever their names. An empty table gives no rows.
    """
    winners = stage(consensus(pages, url_col, html_col), "host_paths")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), HOST.pattern, 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")).withColumn("host", host)
    rows = with_paths(rows, winners, most_broadcast).select("page_id", "url", "html", "__path")

    @F.pandas_udf("string")
    def main_text(source: pd.Series, path: pd.Series) -> pd.Series:
        return pd.Series([Page(s).text(p if isinstance(p, str) else None) if isinstance(s, str) else "" for s, p in zip(source, path, strict=True)], dtype=object)

    return rows.select("page_id", "url", main_text("html", "__path").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
