"""Main text of web pages by consensus paths of their hosts."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import Workspace, map_rows, table

MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|</?[a-zA-Z][^>]*(?:>|\Z)",
    re.S,
)
ATTR = re.compile(r"([a-zA-Z_:][\w:.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z_:][\w:.-]*)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
#: Elements that hold text apart from what stands around them.
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul option".split()
)
CONTAINER = frozenset("html body article main section div td center".split())
#: Elements whose content is never read.
SKIPPED = frozenset("head script style noscript template svg iframe button select textarea canvas object math audio video xmp title".split())
#: Elements that stand around a main text; header does so outside article and main.
AROUND = frozenset("nav footer aside dialog menu".split())
#: Words of class names and ids for what is not the article, and for what may be: a section of prose is called so too.
SURE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promotion promotions cookie cookies consent gdpr notice notices alert newsletter subscribe subscription sidebar sidebars menu menus nav navbar navigation breadcrumb breadcrumbs comment comments disqus respond replies footer masthead popup modal login signup pagination pager banner".split()
)
UNSURE = frozenset("related recommended share sharing social header discussion reply search overlay widget widgets skip toolbar".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: What closes an open paragraph, list item and so on when it begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: How a container is marked: not at all, as perhaps or surely around the article by its names, by being a form, or by its element.
PLAIN, MAYBE, NAMED, FORM, TAGGED = range(5)
#: Characters of prose below which a container with an unsure name is taken for a label, and left outside one that wraps the page.
LABEL, OUTSIDE = 80, 40


@dataclass
class Page:
    """Text blocks in page order and the containers that hold them, each after the one around it.

    A block has pieces (text, container), characters in links, and its container. ``keys`` are hashes of containers' generalised paths.
    """

    blocks: list[tuple[list[tuple[str, int]], int, int]] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [-1])
    keys: list[int] = field(default_factory=lambda: [0])
    names: list[str] = field(default_factory=lambda: [""])
    marks: list[int] = field(default_factory=lambda: [PLAIN])
    headed: set[int] = field(default_factory=set)  # containers that a first-level heading stands in

    def sums(self, values: list[float]) -> list[float]:
        """Values of containers with all those inside them."""
        out = list(values)
        for k in range(len(out) - 1, 0, -1):
            out[self.parents[k]] += out[k]
        return out


def hidden(attrs: dict[str, str]) -> bool:
    return "hidden" in attrs or re.search(r"display\s*:\s*none", attrs.get("style", "")) is not None


def marked(name: str, attrs: dict[str, str], inside: bool) -> int:
    """How an element is marked; ``inside`` tells whether it is in an article or main element."""
    if name in AROUND or name == "header" and not inside:
        return TAGGED
    if name in ("html", "body", "main", "article"):
        return PLAIN
    out = FORM if name == "form" else PLAIN
    if attrs.get("role", "").lower() in ROLES:
        out = NAMED
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        pieces = [x for x in re.split(r"[^a-z]+", token) if x]
        if pieces and pieces[0] not in ("no", "has", "with", "without", "is"):
            ends = {pieces[0], pieces[-1]}
            if ends & SURE:
                out = max(out, NAMED)
            elif ends & UNSURE and not (inside and "header" in ends):
                out = max(out, MAYBE)
    return out


def parse(source: str) -> Page:
    """All visible text outside skipped elements. Tolerates unclosed, misnested and cut off markup; memory grows with the text's length only."""
    page = Page()
    stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # name, container, skipped, in an article or main
    opened: Counter[str] = Counter()
    text: list[tuple[str, int]] = []
    linked = in_link = 0
    at = 0

    def flush() -> None:
        nonlocal linked
        if text:
            if len({k for _, k in text}) == 1:
                joined = " ".join("".join(x for x, _ in text).split())
                if joined:
                    page.blocks.append(([(joined, text[0][1])], min(linked, len(joined)), text[0][1]))
            elif any(x.strip() for x, _ in text):
                page.blocks.append((list(text), linked, min(k for _, k in text)))
            text.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not stack[-1][2]:
            said = html.unescape(raw)
            text.append((said, stack[-1][1]))
            if in_link:
                linked += len(" ".join(said.split()))

    def pop_to(k: int) -> None:
        if any(x[0] in BLOCK for x in stack[k:]):
            flush()
        for x in stack[k:]:
            opened[x[0]] -= 1
        del stack[k:]

    while at < len(source):
        m = MARKUP.search(source, at)
        if not m:
            say(source[at:])
            break
        say(source[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if m["end"]:
            if name == "a":
                in_link = 0
            if opened[name]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        if name in BLOCK or not any(x[0] in BLOCK for x in stack[k:]):
                            pop_to(k)
                        break
            continue
        if name == "br":
            say(" ")
            continue
        attrs = {(a[0] or a[4]).lower(): html.unescape(a[1] or a[2] or a[3]) for a in ATTR.findall(m["attrs"])} if m["attrs"] else {}
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
            if name in SKIPPED:
                at = close.end() if close else len(source)
                continue
        if name in BLOCK or name == "body":
            flush()
        if name == "body":  # the head may never have been closed
            stack[:] = [x for x in stack if x[0] in ("", "html")]
            opened = Counter(x[0] for x in stack)
        if name in BLOCK and opened["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if name in CLOSES and any(opened[x] for x in CLOSES[name]):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in CLOSES[name]:
                    pop_to(k)
                    break
                if stack[k][0] in SCOPE[name]:
                    break
        if name in VOID or (m["attrs"] or "").endswith("/") and name not in BLOCK:
            continue
        if name == "a":
            in_link = 1
        _, box, skipped, inside = stack[-1]
        skipped = skipped or name in SKIPPED or bool(attrs) and hidden(attrs)
        if not skipped:
            mark = marked(name, attrs, inside) if attrs or name in AROUND or name in ("header", "form") else PLAIN
            if name in CONTAINER or mark:
                kinds = ".".join(sorted({re.sub(r"\d+", "#", c) for c in attrs.get("class", "").lower().split()}))
                page.parents.append(box)
                # Elements that may be left out of the markup are none of the path.
                page.keys.append(page.keys[box] if name in ("html", "body") else xxhash.xxh3_64_intdigest(f"{page.keys[box]}/{name}.{kinds}") >> 1)
                page.names.append(name)
                page.marks.append(mark)
                box = len(page.parents) - 1
            if name == "h1":
                page.headed.add(box)
        stack.append((name, box, skipped, inside or name in ("article", "main")))
        opened[name] += 1
    flush()
    return page


class Reading:
    """What of one page counts, by its own marks and by what its host's pages say of them (path -> votes to drop, less those to keep)."""

    def __init__(self, page: Page, host: dict[int, float]):
        self.page = page
        size = len(page.parents)
        own, links, good = [0.0] * size, [0.0] * size, [0.0] * size
        for pieces, linked, k in page.blocks:
            length = sum(len(x) for x, _ in pieces)
            own[k] += length
            links[k] += min(linked, length)
            good[k] += max(0, length - linked)
        self.total, self.links = page.sums(own), page.sums(links)
        tagged = [False] * size
        for k in range(1, size):
            tagged[k] = tagged[page.parents[k]] or page.marks[k] == TAGGED
        prose = page.sums([0.0 if t else x for x, t in zip(good, tagged, strict=True)])
        bodies = [float(not t and n in ("article", "main")) for n, t in zip(page.names, tagged, strict=True)]
        heads = page.sums([float(k in page.headed) for k in range(size)])
        mains = page.sums(bodies)
        self.dropped = [False] * size
        #: Path -> whether this page drops it: what it tells its host.
        self.says: dict[int, int] = {}
        for k in range(1, size):
            mark = page.marks[k]
            if self.dropped[page.parents[k]] or mark == TAGGED:
                self.dropped[k] = True
                continue
            if mark == PLAIN:
                continue
            rest = prose[0] - prose[k]
            wraps = mains[0] == mains[k] and (bool(mains[k] or heads[k]) and prose[k] >= 4 * rest or rest < OUTSIDE and prose[k] >= 2 * OUTSIDE)
            drop = not wraps and (mark != MAYBE or 2 * self.links[k] >= self.total[k] or self.total[k] < LABEL)
            if mark == FORM and not wraps:
                drop = True
            key = page.keys[k]
            self.says[key] = self.says.get(key, 0) + (1 if drop else -1)
            if host.get(key):
                drop = host[key] > 0
            self.dropped[k] = drop
        keep = [not x for x in self.dropped]
        self.good = [x if y else 0.0 for x, y in zip(good, keep, strict=True)]
        self.inner_good = page.sums(self.good)
        self.inner = page.sums([x if y else 0.0 for x, y in zip(own, keep, strict=True)])

    def best(self) -> int:
        """The container of the article by the page alone; -1 without text.

        The seed is the container with the most prose of its own, where half of what a container has passes to the one around
        it. From there up: to the outermost article around it; else to the highest container that adds mostly prose,
        as far as main, and to the whole body only if a third of its prose is outside.
        """
        page = self.page
        score = [0.0] * len(self.good)
        for k, worth in enumerate(self.good):
            at = k
            while at >= 0 and worth >= 0.5:
                score[at] += worth
                worth, at = worth / 2, page.parents[at]
        if not any(score):
            return max((k for k in range(len(score)) if self.inner[k]), default=-1)
        seed = max(range(len(score)), key=lambda k: score[k])
        article, up = -1, seed
        while up >= 0:
            article = up if page.names[up] == "article" else article
            up = page.parents[up]
        if article >= 0:
            return article
        out, up = seed, seed
        while page.names[up] != "main" and page.parents[up] >= 0:
            up = page.parents[up]
            added, more = self.inner[up] - self.inner[out], self.inner_good[up] - self.inner_good[out]
            if 2 * more < added:
                break
            if page.names[up] in ("", "html", "body") and 3 * more < self.inner_good[up]:
                break
            if added:
                out = up
        return out

    def text(self, winners: list[int]) -> str:
        """Blocks of the containers of the first winning path that holds a tenth of the prose of the page's own best one; else of that one."""
        page, best = self.page, self.best()
        if best < 0:
            return ""
        chosen = {best}
        for key in winners:
            same = {k for k, x in enumerate(page.keys) if x == key and not self.dropped[k]}
            if same and 10 * sum(self.inner_good[k] for k in same) >= self.inner_good[best]:
                chosen = same
                break
        inside = [False] * len(page.parents)
        for k, parent in enumerate(page.parents):
            inside[k] = k in chosen or parent >= 0 and inside[parent]
        out = []
        for pieces, _, k in page.blocks:
            if inside[k]:
                said = "".join(x for x, at in pieces if not self.dropped[at])
                if joined := " ".join(said.split()):
                    out.append(joined)
        return "\n".join(out)


def ballot(page: Page) -> tuple[int | None, dict[int, int]]:
    """A page's vote: the path of its article's container, and for each path with a mark whether to drop it (1) or not (-1)."""
    read = Reading(page, {})
    best = read.best()
    return (page.keys[best] if best >= 0 else None), {k: (x > 0) - (x < 0) for k, x in read.says.items() if x}


def main_text(page: Page, winners: list[int], host: dict[int, float]) -> str:
    return Reading(page, host).text(winners)


def _vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        votes: dict[tuple[str, str, int], float] = {}
        for host, source in zip(batch["host"], batch["html"], strict=True):
            best, says = ballot(parse(source))
            if best is not None:
                votes[host, "main", best] = votes.get((host, "main", best), 0.0) + 1
            for key, x in says.items():
                votes[host, "drop", key] = votes.get((host, "drop", key), 0.0) + x
        yield pd.DataFrame([(*k, x) for k, x in votes.items()], columns=["host", "kind", "path", "votes"])


def _extract(sources: list[str], winners: list[list[int] | None], paths: list[list[int] | None], votes: list[list[float] | None]) -> tuple[list[str]]:
    return ([main_text(parse(x), w or [], dict(zip(p or [], v or [], strict=True))) for x, w, p, v in zip(sources, winners, paths, votes, strict=True)],)


def extract_main_text(pages: DataFrame, least_share: float = 0.1) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every row of ``pages`` (page_id, url, html).

    Each page scores its containers and votes for the generalised path (elements and classes, digits alike) of the one that
    holds its article, and on each path whose names mark it as something around an article: drop it, or keep it where it
    wraps the page or is prose. Spark adds the votes up by host. Every page is then read again: marked containers go as its host's
    votes say, and of the host's paths with ``least_share`` of the votes, ten at most, the first that the page has is its text.
    Without votes the page decides alone. Ties go to the smaller path hash, and of containers to the first in the page.

    Null html gives the empty text, pages with a null url form a host of their own, repeated rows vote and stay, an
    empty table gives no rows, and other columns are not read. Very long and very deep pages are read whole. The votes are summed
    before they are shuffled; the winners are joined to the pages by host: as a broadcast while Spark finds them small
    enough, beyond that by a shuffle of the pages, where adaptive execution splits hosts with many.
    """
    work = Workspace(pages.sparkSession, "html")
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[^:/?#]*:?//([^/?#]*)", 1)), F.lit(""))
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    votes = rows.select("host", "html").mapInPandas(_vote, "host string, kind string, path long, votes double").groupBy("host", "kind", "path").agg(F.sum("votes").alias("votes"))
    votes = work.write(votes, "votes")
    total = votes.filter("kind = 'main'").groupBy("host").agg(F.sum("votes").alias("total"))
    # A path that few pages of a host have can't decide for it, so what is kept of a host stays small.
    strong = votes.join(total, "host").filter(F.abs("votes") >= least_share * F.col("total"))
    sorted_by = lambda kind: F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct((-F.col("votes")).alias("less"), "path"))))
    won = strong.groupBy("host").agg(sorted_by("main").alias("main"), sorted_by("drop").alias("drop"))
    won = work.write(won.select("host", F.col("main.path").alias("winners"), F.col("drop.path").alias("paths"), F.transform("drop.less", lambda x: -x).alias("of")), "won")
    work.drop("votes")
    return map_rows(rows.join(won, "host", "left"), ["page_id", "url"], ["html", "winners", "paths", "of"], "text string", _extract)


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``extract_main_text`` over all pages, and each text's code points."""
    out = extract_main_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
