"""Main text of web pages by consensus host paths.

Every page is scanned once for its containers (article, main, div and so on),
each with a generalised path of tags and classes.  A container scores by the text
of its blocks, less with distance, less for link text.  Pages vote, weighted by
relative score, for the paths of their host; the votes are added up in Spark.
Every page is then extracted from the containers at its host's winning path, or
at its own best path where it has none or too little there, or where its own best
container encloses the voted one, has more text and is not noisier.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments are left out wherever they stand, by tag, role and class.  What looks
like one of these but is wrapped around the main text is kept, decided after the scan
(``Page._settle``).

Null and empty pages, and pages without text, give an empty text.  A page without
a host has a vote of its own.  Rows are extracted one by one: repeated rows give
repeated results.  Markup may be cut off anywhere.
A '<' that opens no tag is text.  A head ends where its content does; other elements left
out that lack their end tag end with their parent.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, named
from .hosts import host_of

#: Winning paths up to this many rows are broadcast (some 100 bytes each); more are joined by host.
BROADCAST_ROWS = 50_000

#: Attributes: a quote counts only after '='.  Possessive, so that a failed match is not tried again in other ways.
_ATTRS = r"""(?>[^<>"'=]+|=\s*"[^"]*"|=\s*'[^']*'|["'=])*+"""
#: Comments, start tags, end tags, declarations, and markup cut off by the end of the page.  Any other '<' is text.
_TAG = re.compile(
    rf"""<!--(?:-?>|.*?(?:--!?>|\Z))|<([a-zA-Z][^\s/<>]*)({_ATTRS})>|</([a-zA-Z][^\s/<>]*)(?:[^<>]*>|\s*(?=<))|<[!?][^>]*>|<[a-zA-Z/!?](?:[^<>"']|"[^"]*"|'[^']*')*+(?:"[^">]*|'[^'>]*)?\Z""",
    re.S,
)
_ATTR = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")

CONTAINERS = frozenset("html body main article section div td center".split())
BLOCKS = CONTAINERS | frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr th blockquote pre figure figcaption hr address details summary header footer nav aside form fieldset".split()
)
#: Elements that hold text only, and elements whose markup is passed over whole.
TEXT_ONLY = frozenset("script style title textarea iframe".split())
RAW = TEXT_ONLY | frozenset("noscript template svg annotation annotation-xml object head select".split())
#: What a head may hold; anything else ends it, with or without its end tag.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
VOID = frozenset("br img hr meta link input area base col embed source track wbr".split())
NOISE_TAGS = frozenset("nav header footer aside form menu button dialog".split()) | RAW
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adv advert advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notification pagination popup promo promotion recommended related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Noise words that also occur in the classes of layouts; the other words name what they stand on.
LAYOUT_WORDS = frozenset("banner breadcrumb breadcrumbs footer form header login masthead menu modal nav navbar navigation pagination promo share sharing sidebar signup social toolbar widget".split())
#: Words of classes that say what else a page has, and of classes that hold the content.
FLAG_WORDS = frozenset("has with without no not is open closed".split())
CONTENT_WORDS = frozenset("article body col column container content entry layout main page post site story text wrap wrapper".split())
#: Noise words that are part of other terms (a share price, social security), and the words that may stand beside them.
TERM_WORDS = frozenset("share social form".split())
PART_WORDS = frozenset("area bar block bottom box btn button buttons contact count counts fixed float floating group icon icons inline inner item items left like link links list media network networks on outer panel post right row section site sticky tool tools top us wrap wrapper".split())
#: Characters of a path; of a longer one the rest is a digest.
PATH_CHARS = 300
KEEP_TAGS = frozenset("html body main article".split())
#: How sure an element is left out: by part of a class or as a form, by the name of a layout part, by another name, by tag or role, always.
WEAK, LAYOUT, NAMED, TAG, DROP = range(1, 6)
#: Plain characters of a block of running text.
RUNNING = 100
#: A container around the voted one is noisier if its share of link text is higher by more than this.
LINK_SHARE = 0.1
CLOSES = {"li": "li", "dt": "dd", "dd": "dt", "td": "td", "th": "th", "tr": "tr"}


def _class_noise(names: list[str]) -> int:
    """WEAK, LAYOUT, NAMED or 0 for classes and ids."""
    found, content = set(), False
    for name in names:
        words = [w.lower() for w in _PART.findall(name)]
        if FLAG_WORDS.intersection(words):
            continue
        holds = not CONTENT_WORDS.isdisjoint(words)
        hit = NOISE_WORDS.intersection(words)
        if hit and hit <= TERM_WORDS and not all(w in NOISE_WORDS or w in PART_WORDS or w in CONTENT_WORDS for w in words):
            continue
        if hit - LAYOUT_WORDS:
            return NAMED
        if hit:
            found.add(LAYOUT if words[0] in hit and not holds else WEAK)
        else:
            content = content or holds
    return 0 if not found else WEAK if content else max(found)


def _noisy(tag: str, raw: str) -> tuple[int, str]:
    """How an element is left out, 0 if it is not, and its generalised classes."""
    by_tag = 0 if tag not in NOISE_TAGS else DROP if tag in RAW else WEAK if tag == "form" else TAG
    if not raw or "=" not in raw and "hidden" not in raw:
        return by_tag, ""
    attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}
    names, role = attrs.get("class", "").split(), attrs.get("role", "").lower()
    if attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "") or re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", _ATTR.sub(" ", raw)) is not None:
        by_tag = DROP
    elif role in NOISE_ROLES:
        by_tag = max(by_tag, WEAK if role == "form" else TAG)
    if tag == "article":
        # a comment may be an article; any other noise word there is a theme's flag
        by_name = NAMED if {w.lower() for w in _PART.findall(f"{' '.join(names)} {attrs.get('id', '')}")} & {"comment", "reply"} else 0
    else:
        by_name = _class_noise(names + attrs.get("id", "").split()) if tag not in KEEP_TAGS else 0
    return max(by_tag, by_name), ".".join(sorted({re.sub(r"\d+", "0", c) for c in names}))


def _below(path: str, part: str) -> str:
    """The path of a part below a path, of bounded length: deep markup must not cost the square of its depth."""
    whole = f"{path}/{part}"
    if len(whole) <= PATH_CHARS:
        return whole
    return f"{whole[:PATH_CHARS]}~{hashlib.blake2b(whole.encode('utf-8', 'surrogatepass'), digest_size=12).hexdigest()}"


class _Ends:
    """Where the elements of RAW end: after their end tag, or None without one."""

    def __init__(self, html: str):
        self.html = html
        self.known: dict[str, dict[int, int]] = {}

    def after(self, tag: str, at: int) -> int | None:
        """For the element whose start tag ends at a place."""
        if tag not in self.known:
            self.known[tag], opened = {}, []
            for m in re.finditer(rf"<(/?){re.escape(tag)}(?![^\s/>])({_ATTRS})>", self.html, re.I):
                if m[1]:
                    # text has no elements inside: an end tag ends all that wait for one
                    for k in opened if tag in TEXT_ONLY else opened[-1:]:
                        self.known[tag][k] = m.end()
                    opened = [] if tag in TEXT_ONLY else opened[:-1]
                elif not m[2].endswith("/"):
                    opened.append(m.end())
        return self.known[tag].get(at)


class Page:
    """Blocks of text, each with the containers around it, innermost last."""

    def __init__(self, html: str):
        self.paths: list[str] = [""]  # of container k
        self.tags: list[str] = [""]
        self.parents: list[int] = [-1]
        self.blocks: list[tuple[int, str, int]] = []  # container, text, link characters
        # elements that may be left out, outer ones first; 0 is the page
        self.kinds: list[int] = [0]
        self.around: list[int] = [0]
        self.holds_main: list[bool] = [False]
        self.holds_article: list[bool] = [False]
        self.owners: list[int] = []  # of each block, the innermost of these
        self._scan(html)
        if len(self.kinds) > 1:
            self._settle()

    def _scan(self, html: str) -> None:
        stack: list[tuple[str, int, int, bool]] = []  # tag, container and owner before, without text
        container, owner, noise, links, at = 0, 0, 0, 0, 0
        text: list[str] = []
        linked = 0
        open_tags: Counter[str] = Counter()

        def flush() -> None:
            nonlocal text, linked
            if text:
                whole = _SPACE.sub(" ", unescape("".join(text))).strip()
                if whole:
                    self.blocks.append((container, whole, min(linked, len(whole))))
                    self.owners.append(owner)
            text, linked = [], 0

        def pop(depth: int) -> None:
            nonlocal container, owner, noise
            while len(stack) > depth:
                tag, container, owner, out = stack.pop()
                open_tags[tag] -= 1
                noise -= out

        def end_head() -> None:
            """The head is over, with what is open in it."""
            for k in range(len(stack) if open_tags["head"] else 0):
                if stack[k][0] == "head":
                    pop(k)
                    break

        ends, end = _Ends(html), len(html)
        while at < end:
            m = _TAG.search(html, at)
            stop = m.start() if m else end
            if stop > at and noise and stack[-1][0] == "head" and not html[at:stop].isspace():
                end_head()
            if stop > at and not noise:
                text.append(html[at:stop])
                if links:
                    linked += stop - at
            if not m:
                break
            at = m.end()
            if m[1]:
                tag, raw = m[1].lower(), m[2]
                block = tag in BLOCKS
                if noise and tag not in HEAD and (tag == "body" or stack[-1][0] in RAW):
                    end_head()
                if block:
                    flush()
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == "p" or stack[k][0] == CLOSES.get(tag):
                            pop(k)
                            break
                        if stack[k][0] in CONTAINERS or stack[k][0] in ("ul", "ol", "dl", "table", "tr"):
                            break
                elif tag == "br":
                    text.append(" ")
                out, classes = _noisy(tag, raw)
                if tag in VOID or raw.endswith("/"):
                    continue
                if tag in RAW and tag != "head":
                    if (after := ends.after(tag, at)) is not None:
                        at = after
                        continue
                    if tag == "title":
                        at = k if (k := html.find("<", at)) >= 0 else end
                        continue
                if tag == "a":
                    links += 1
                if block or out:
                    if out:
                        flush()
                    stack.append((tag, container, owner, out == DROP))
                    open_tags[tag] += 1
                    noise += out == DROP
                    if out:
                        self.kinds.append(out)
                        self.around.append(owner)
                        self.holds_main.append(False)
                        self.holds_article.append(False)
                        owner = len(self.kinds) - 1
                    elif not noise and tag in ("main", "article"):
                        self._mark(self.holds_main if tag == "main" else self.holds_article, owner)
                    if tag in CONTAINERS:
                        self.paths.append(_below(self.paths[container], f"{tag}{'.' + classes if classes else ''}"))
                        self.tags.append(tag)
                        self.parents.append(container)
                        container = len(self.paths) - 1
            elif m[3]:
                tag = m[3].lower()
                if tag == "a":
                    links = max(0, links - 1)
                if tag in BLOCKS:
                    flush()
                for k in range(len(stack) - 1 if open_tags[tag] else -1, -1, -1):
                    if stack[k][0] == tag:
                        flush()
                        pop(k)
                        break
                    if tag not in BLOCKS and tag != "head" and stack[k][0] in CONTAINERS:
                        break
        flush()

    def _mark(self, holds: list[bool], owner: int) -> None:
        """Note a main or article element; an article counts for parts of classes around it and the next element around these."""
        while not holds[owner]:
            holds[owner] = True
            if holds is self.holds_article and self.kinds[owner] > WEAK or not self.around[owner]:
                break
            owner = self.around[owner]

    def _settle(self) -> None:
        """Leave out blocks, except in elements that the main text is wrapped in.

        Kept are elements around a main element; those around an article with much of the text;
        those noisy by part of a class, and forms, with most of the text; and, on a page without
        other text, a layout part with running text.  Text inside another element left out
        does not count for the one around it.
        """
        n = len(self.kinds)
        own, running = [0] * n, [False] * n
        for (_, text, linked), e in zip(self.blocks, self.owners):
            own[e] += len(text) - linked
            running[e] = running[e] or len(text) - linked >= RUNNING
        keep = [k == 0 or k < DROP and main for k, main in zip(self.kinds, self.holds_main)]
        sizes = own.copy()
        for e in range(n - 1, 0, -1):
            if self.kinds[e] == WEAK or keep[e]:
                sizes[self.around[e]] += sizes[e]
                running[self.around[e]] = running[self.around[e]] or running[e]
        seen = keep.copy()

        def show() -> int:
            """Plain text in the elements kept."""
            for e in range(1, n):
                seen[e] = keep[e] and seen[self.around[e]]
            return sum(size for size, s in zip(own, seen) if s)

        shown = show()
        order = sorted((e for e in range(1, n) if not keep[e] and self.kinds[e] < DROP and sizes[e]), key=lambda e: (-sizes[e], e))
        for kinds in ((WEAK,), (LAYOUT,), (NAMED, TAG)):
            for e in order:
                if self.kinds[e] in kinds and self.holds_article[e] and seen[self.around[e]]:
                    outside = self.holds_article[0]
                    # so many times the text kept otherwise
                    least = (1 if outside else 0.5) if self.kinds[e] == WEAK else 1 if self.kinds[e] == LAYOUT else 4
                    if sizes[e] > least * shown and (self.kinds[e] < NAMED or not outside):
                        keep[e] = True
                        shown = show()
        weak = [e for e in order if self.kinds[e] == WEAK and not keep[e]]
        total = shown + sum(sizes[e] for e in weak if seen[self.around[e]])
        for e in weak:
            if 2 * sizes[e] > total and seen[self.around[e]]:
                keep[e] = True
                shown = show()
        if not shown:
            for e in order:
                if self.kinds[e] == LAYOUT and running[e] and seen[self.around[e]]:
                    keep[e] = True
                    # parts of classes inside it that hold most of its text
                    for k in range(e + 1, n):
                        keep[k] = keep[k] or self.kinds[k] == WEAK and keep[self.around[k]] and self.around[k] >= e and 2 * sizes[k] > sizes[e]
                    show()
                    break
        # of a header and the like, kept for a main or article element in it, only that element
        held = [tag in ("main", "article") for tag in self.tags]
        for k in range(1, len(held)):
            held[k] = held[k] or held[self.parents[k]]
        self.blocks = [b for b, e in zip(self.blocks, self.owners) if seen[e] and (self.kinds[e] != TAG or held[b[0]])]

    def totals(self) -> tuple[list[float], list[int]]:
        """Score and plain text length of each container."""
        score, size = [0.0] * len(self.paths), [0] * len(self.paths)
        for container, text, linked in self.blocks:
            score[container] += len(text) - linked
            size[container] += len(text) - linked
        # a container stands before those inside it
        for k in range(len(self.paths) - 1, 0, -1):
            score[self.parents[k]] += 0.75 * score[k]
            size[self.parents[k]] += size[k]
        for k, tag in enumerate(self.tags):
            score[k] *= {"article": 2.0, "main": 1.5, "": 0.1, "html": 0.3}.get(tag, 1.0)
        return score, size

    def best(self, score: list[float], size: list[int]) -> int:
        """The container of the highest score, or one around it with clearly more text."""
        k = max(range(len(score)), key=lambda c: (score[c], -c))
        while (up := self.parents[k]) > 0 and self.tags[up] not in ("body", "html") and size[up] > 1.15 * size[k]:
            k = up
        return k

    def votes(self) -> list[tuple[str, float]]:
        """Paths with their share of the best score."""
        if not self.blocks:
            return []
        score, size = self.totals()
        best = self.best(score, size)
        top = max(score[best], 1e-9)
        found: dict[str, float] = {self.paths[best]: 1.0}
        for path, s in zip(self.paths, score):
            if s >= 0.5 * top:
                found[path] = max(found.get(path, 0.0), min(1.0, s / top) * 0.9)
        return list(found.items())

    def _holds_more(self, best: int, chosen: set[int]) -> bool:
        """Whether a container encloses all the chosen ones and has more text, with no more links in it."""
        if not chosen or best in chosen:
            return False
        inside, within = [k in chosen for k in range(len(self.paths))], [k == best for k in range(len(self.paths))]
        for k in range(1, len(inside)):
            inside[k] = inside[k] or inside[self.parents[k]]
            within[k] = within[k] or within[self.parents[k]]
        if not all(within[k] for k in chosen):
            return False
        some, whole = ([sum(n) for n in zip(*((len(text), linked) for c, text, linked in self.blocks if part[c]))] or [0, 0] for part in (inside, within))
        return whole[0] > some[0] and whole[1] * max(some[0], 1) <= (some[1] + LINK_SHARE * some[0]) * whole[0]

    def text(self, path: str | None) -> str:
        """The blocks inside the containers at a path, or at the page's own best."""
        if not self.blocks:
            return ""
        score, size = self.totals()
        best = self.best(score, size)
        chosen = {k for k, p in enumerate(self.paths) if p == path} if path is not None else set()
        if 2 * sum(size[k] for k in chosen) < size[best] or self._holds_more(best, chosen):
            chosen = {k for k, p in enumerate(self.paths) if p == self.paths[best]}
        inside = [k in chosen for k in range(len(self.paths))]
        for k in range(1, len(inside)):
            inside[k] = inside[k] or inside[self.parents[k]]
        return "\n\n".join(text for container, text, _ in self.blocks if inside[container])


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """host, path: the winning path of each host."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        hosts, paths, weights = [], [], []
        for host, markup in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if markup and host is not None:
                for path, weight in Page(markup).votes():
                    hosts.append(host), paths.append(path), weights.append(int(1000 * weight))
        yield {"host": hosts, "path": paths, "weight": weights}

    votes = map_batches(pages.select(host_of(named(url)).alias("host"), named(html).alias("html")), run, "host string, path string, weight long")
    summed = votes.groupBy("host", "path").agg(F.sum("weight").alias("weight"))
    order = Window.partitionBy("host").orderBy(F.desc("weight"), "path")
    return summed.withColumn("place", F.row_number().over(order)).where("place = 1").select("host", "path")


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text, n_chars and the path voted for the page's host."""
    from .common import cut

    kind = pages.schema[key].dataType.simpleString()
    winners = cut(host_paths(pages, url, html))
    side = winners.withColumnRenamed("host", "winner_host")
    if winners.count() <= BROADCAST_ROWS:
        side = F.broadcast(side)
    rows = pages.select(named(key).alias("key"), named(url).alias("url"), named(html).alias("html"), host_of(named(url)).alias("host"))
    joined = rows.join(side, F.col("host") == F.col("winner_host"), "left").select("key", "url", "html", "path")

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        texts = [Page(m).text(p) if m else "" for m, p in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
        yield {"key": batch.column("key"), "url": batch.column("url"), "text": texts, "n_chars": [len(t) for t in texts], "path": batch.column("path")}

    return map_batches(joined, run, f"key {kind}, url string, text string, n_chars long, path string").withColumnRenamed("key", key)
