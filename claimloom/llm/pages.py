"""Main text of web pages by equivalence-class template deduction.

Pages of one host come from one template.  Every page is read as tokens: its
containers (tag path with classes) and its text blocks (path and text).  A
token's occurrence vector says how often it stands on each page of the host;
tokens with equal vectors form an equivalence class.  A class is valid if it has
several tokens and covers most of the host's pages.  Valid classes nest by their
container paths and make up the host's template; what the template does not
explain are slots, and the slots inside the template's main container are the
page's text.

Vectors are never built.  Per (host, token) only counts and an order-free hash
of the (page, count) pairs are aggregated, so a host with a third of all pages
costs a map-side combine like any other, and no host is ever gathered in a task.

What a container is for is told by its tag, role and class words: an article or
main container holds the text, menus, headers, footers, sidebars, notices,
adverts, forms and comments do not.  Pages without an article take their host's
main container, the template container with the most varying text, and without
one every block outside of those.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.session import scratch_path

CONTAINERS = frozenset("html body div section article main header footer nav aside form fieldset dialog details figure table ul ol dl menu address center".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr td th caption thead tbody tfoot blockquote pre hr figcaption summary legend option optgroup".split())
#: Content that is never text of the page; skipped up to the closing tag.  One that is not closed in its container hides nothing.
RAW = frozenset("script style noscript template svg iframe object textarea select button title canvas audio video map".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
TEXT_TAGS, TEXT_ROLES = frozenset({"article", "main"}), frozenset({"main", "article"})
AROUND_TAGS = frozenset("head nav footer aside form dialog menu".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of class and id names that mark what stands around a text.
AROUND_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification popup modal overlay "
    "newsletter subscribe subscription signup login nav navbar navigation menu menus breadcrumb breadcrumbs sidebar masthead topbar toolbar footer social share "
    "sharing related recommended recommendations comment comments commentlist disqus respond reply replies widget widgets pagination pager search searchbox copyright disclaimer banner"
).split())
#: Words that may stand beside them in such a name inside an article; with any other word the name says what the text is about.
PLACE_WORDS = frozenset((
    "area article articles bar block blocks body box btn button buttons container content entry footer form group header icons inner inline item items js label left link links list "
    "main more outer panel posts post right row section sidebar site slot stories text thread title top bottom unit user wrap wrapper"
).split())
#: Those of them that tell even of an article that it is no text of the page.
COMMENT_WORDS = frozenset("comment comments commentlist disqus respond reply replies".split())
#: A valid class has so many tokens and covers this share of a host's pages; a host has so many pages at least.
CLASS_TOKENS, COVER, HOST_PAGES = 2, 0.6, 3
#: Constant text inside an article is template only on every page of a host of at least so many pages.
SURE_PAGES = 8

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<[/!?A-Za-z][^>]*\Z|([^<]+|<)""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([A-Za-z_:][-A-Za-z0-9_:.]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[A-Za-z]+")
_STRUCTURE = re.compile(rf"</?(?:{'|'.join(sorted(CONTAINERS | BLOCKS))})(?![A-Za-z0-9:-])", re.IGNORECASE)


@dataclass(slots=True)
class Container:
    name: str
    #: Depth and a hash of the names and classes from the root down, of one size at every depth.
    path: str
    parent: int
    around: bool
    by_word: bool
    text: bool
    comments: bool = False
    #: Some container above or this one is the article, as far as the page was read.
    in_text: bool = False


@dataclass
class Page:
    containers: list[Container] = field(default_factory=list)
    #: (container, text, characters inside links)
    blocks: list[tuple[int, str, int]] = field(default_factory=list)

    #: For each container, whether it or one above is around the text, or holds it.
    arounds: list[bool] = field(default_factory=list)
    articles: list[bool] = field(default_factory=list)

    def inside(self, wanted) -> list[bool]:
        """For each container, whether ``wanted`` holds for it or one above; parents come before what they hold."""
        found: list[bool] = []
        for c in self.containers:
            found.append(wanted(c) or (c.parent >= 0 and found[c.parent]))
        return found

    def chars_inside(self, counted=lambda at: True) -> list[int]:
        """For each container the characters outside links of the blocks in it."""
        chars = [0] * len(self.containers)
        for i, text, linked in self.blocks:
            if counted(i):
                chars[i] += len(text) - linked
        for i in range(len(chars) - 1, 0, -1):
            chars[self.containers[i].parent] += chars[i]
        return chars

    def around(self, at: int) -> bool:
        return self.arounds[at]

    def article(self, at: int) -> bool:
        return self.articles[at]


def _step(above: str, name: str) -> str:
    return f"{int(above[:8]) + 1:08d}{hashlib.blake2b(f'{above} {name}'.encode('utf-8', 'surrogatepass'), digest_size=8).hexdigest()}"


class _Closing:
    """Where an element of RAW ends; null if its container ends first.  Every place of the page is searched a bounded number of times."""

    def __init__(self, source: str):
        self.source, self.next, self.open_until = source, {}, {}

    def _find(self, what: str, at: int) -> tuple[int, int] | None:
        known = self.next.get(what, (-1, -1))
        if known is not None and known[0] < at:
            m = re.compile(f"{what}[^>]*>", re.IGNORECASE).search(self.source, at)
            known = self.next[what] = m.span() if m else None
        return known

    def end(self, name: str, at: int, holder: str) -> int | None:
        close = self._find(rf"</{name}(?![A-Za-z0-9:-])", at)
        if close is None:
            return None
        if name in ("script", "style") or not holder:
            return close[1]
        first, until = self.open_until.get(name, (None, 0))
        if first == close[0] and at < until:
            return None
        depth = 0
        for m in re.compile(rf"<(/?){re.escape(holder)}(?![A-Za-z0-9:-])", re.IGNORECASE).finditer(self.source, at, close[0]):
            depth += -1 if m[1] else 1
            if depth < 0:
                self.open_until[name] = close[0], m.start()
                return None
        return close[1]

    def self_closed(self, name: str, at: int) -> bool:
        """A script written as an empty element: the next one starts before anything closes."""
        close, again = self._find(rf"</{name}(?![A-Za-z0-9:-])", at), self._find(rf"<{name}(?![A-Za-z0-9:-])", at)
        return close is None or (again is not None and again[0] < close[0])


def _named_around(value: str, whole: bool) -> bool:
    """Whether a class or id tells that its element stands around a text; ``whole``: by a complete name, not one word in it."""
    if not whole:
        return any(w.lower() in AROUND_WORDS for w in _WORD.findall(value))
    for name in value.split():
        words = {w.lower() for w in _WORD.findall(name)}
        if words & AROUND_WORDS and words <= AROUND_WORDS | PLACE_WORDS:
            return True
    return False


def read(source: str) -> Page:
    """Containers and text blocks of one page; never fails on broken markup."""
    page = Page([Container("", "00000000", -1, False, False, False)])
    stack, buffer, linked, in_link = [0], [], 0, False
    at, end, ends, opened = 0, len(source), _Closing(source), Counter()

    def leave(depth: int) -> None:
        for i in stack[depth:]:
            opened[page.containers[i].name] -= 1
        del stack[depth:]

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(buffer)).split())
        if text:
            page.blocks.append((stack[-1], text, min(linked, len(text))))
        buffer.clear()
        linked = 0

    while at < end:
        m = _TOKEN.match(source, at)
        at = m.end()
        cdata, closing, name, attributes, text = m.groups()
        if text is not None or cdata is not None:
            piece = text if text is not None else cdata
            buffer.append(piece)
            linked += len(piece) if in_link else 0
            continue
        if name is None:  # a comment, a declaration, or a tag that the page's end cuts off
            continue
        name = name.lower()
        if name == "a":
            in_link = not closing
        if name == "br":
            buffer.append(" ")
        if not closing and name in RAW:
            empty = attributes.endswith("/") and (name not in ("script", "style") or ends.self_closed(name, at))
            after = None if empty else ends.end(name, at, page.containers[stack[-1]].name)
            if after is not None:
                at = after
            elif not empty and name in ("script", "style"):
                follows = _STRUCTURE.search(source, at)
                at = follows.start() if follows else end
            continue
        if closing:
            if name in CONTAINERS or name in BLOCKS or name == "head":
                flush()
            if opened[name]:
                flush()
                leave(next(d for d in range(len(stack) - 1, 0, -1) if page.containers[stack[d]].name == name))
            continue
        if name in BLOCKS or name in CONTAINERS or name == "head":
            flush()
            # A paragraph that was opened as a container ends where the next block begins.
            if page.containers[stack[-1]].name in ("p", "li", "dt", "dd", "td", "th", "tr") and (name in CONTAINERS or name == page.containers[stack[-1]].name):
                leave(len(stack) - 1)
        if name == "body" and len(stack) > 1 and page.containers[stack[-1]].name == "head":
            leave(len(stack) - 1)
        if name in VOID:
            continue
        words, role, label, named = set(), "", "", False
        above = page.containers[stack[-1]]
        if "=" in attributes:
            for key, a, b, c in _ATTRIBUTE.findall(attributes):
                key, value = key.lower(), a or b or c
                if key in ("class", "id"):
                    label += f".{re.sub('[0-9]+', '0', value)}"
                    words.update(w.lower() for w in _WORD.findall(value))
                    named = named or _named_around(value, above.in_text)
                elif key == "role":
                    role = value.strip().lower()
                elif key == "itemprop" and value.strip().lower() == "articlebody":
                    role = "article"
        holds = name in TEXT_TAGS or role in TEXT_ROLES
        comments = named and bool(words & COMMENT_WORDS) and name not in ("html", "body")
        # Class words do not overrule an article or main container, unless they are those of comments.
        by_word = named and name not in ("html", "body") and (comments or not holds)
        by_kind = name in AROUND_TAGS or role in AROUND_ROLES or (name == "header" and not above.in_text)
        around = by_kind or by_word
        if name in CONTAINERS or name == "head" or ((around or holds) and not attributes.endswith("/")):
            if name not in CONTAINERS and name not in BLOCKS and name != "head":
                flush()
            holds = holds and not around
            page.containers.append(Container(name, _step(above.path, name + label), stack[-1], around, by_word and not by_kind, holds, comments, holds or above.in_text))
            stack.append(len(page.containers) - 1)
            opened[name] += 1
    flush()
    _settle(page)
    page.arounds, page.articles = page.inside(lambda c: c.around), page.inside(lambda c: c.text)
    return page


def _settle(page: Page) -> None:
    """What only the whole page tells of its containers."""
    def in_comments(c: Container) -> bool:
        return c.parent >= 0 and commented[c.parent]

    commented = page.inside(lambda c: c.comments)
    if not any(c.text and not in_comments(c) for c in page.containers):
        # Without an article, a container that holds most of the page's text is not around it, whatever its name.
        hidden = page.inside(lambda c: c.around and not c.by_word)
        chars = page.chars_inside(lambda i: not hidden[i])
        holding = [c.text for c in page.containers]
        for i in range(len(holding) - 1, 0, -1):
            holding[page.containers[i].parent] |= holding[i]
        for i, c in enumerate(page.containers):
            if c.by_word and 2 * chars[i] > chars[0] and (not c.comments or holding[i]):
                c.around = c.comments = False
        commented = page.inside(lambda c: c.comments)
    for c in page.containers:
        c.text = c.text and not in_comments(c)
    # A wrapper named after its sidebar is no sidebar: what holds an article is not around it.
    inner = [False] * len(page.containers)
    for i in range(len(inner) - 1, 0, -1):
        c = page.containers[i]
        inner[c.parent] |= c.text or inner[i]
    for i, c in enumerate(page.containers):
        if inner[i] and c.by_word:
            c.around = False


def host_of(url: Column) -> Column:
    """Lower-case host name; null if the address has none."""
    found = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#\s]+)", 1))
    return F.when(F.length(found) > 0, found)


def block_token(path: str, text: str) -> int:
    """64-bit name of a text block at its place."""
    return int.from_bytes(hashlib.blake2b(f"{path} {text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _tokens(pages: DataFrame) -> DataFrame:
    """(host, page, kind, path, token, n, chars): what stands on each page, counted per page.

    Kind 0 is the page itself, 1 a container (named by its path), 2 a text block
    (named by a hash).  ``chars`` of a container are those outside links.  A page
    is named by its article's text, without an article by all its text; of
    several pages of a host with the same text one is kept, for copies say
    nothing about the template.
    """
    names = ["host", "page", "kinds", "paths", "tokens", "ns", "chars"]
    types = [pa.string(), pa.int64(), *[pa.list_(x) for x in (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64())]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for host, source in zip(*[c.to_pylist() for c in batch.columns]):
                page = read(source or "")
                counts: dict[tuple[int, str, int], list[int]] = {(0, "", 0): [1, 0]}
                for i, c in enumerate(page.containers[1:], 1):
                    if not page.around(i):
                        counts.setdefault((1, c.path, 0), [0, 0])[0] += 1
                every, article = [], []
                for i, chars in enumerate(page.chars_inside(lambda at: not page.around(at))):
                    if i and not page.around(i):
                        counts[(1, page.containers[i].path, 0)][1] += chars
                for i, text, _ in page.blocks:
                    if page.around(i):
                        continue
                    every.append(text)
                    if page.article(i):
                        article.append(text)
                    counts.setdefault((2, "", block_token(page.containers[i].path, text)), [0, 0])[0] += 1
                listed = sorted(counts.items())
                found = (host, block_token("", "\n".join(article or every)), [k[0] for k, _ in listed], [k[1] for k, _ in listed], [k[2] for k, _ in listed], [v[0] for _, v in listed], [v[1] for _, v in listed])
                for column, value in zip(rows, found):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types)], names=names)

    read_pages = pages.select("host", "html").where("host IS NOT NULL").mapInArrow(
        run, "host string, page long, kinds array<int>, paths array<string>, tokens array<long>, ns array<long>, chars array<long>")
    # The smallest of the copies, so that the choice does not depend on the order of the rows.
    distinct = read_pages.groupBy("host", "page").agg(F.min(F.struct("kinds", "paths", "tokens", "ns", "chars")).alias("of"))
    return distinct.select("host", "page", F.explode(F.arrays_zip("of.kinds", "of.paths", "of.tokens", "of.ns", "of.chars")).alias("x")).select(
        "host", "page", F.col("x.kinds").alias("kind"), F.col("x.paths").alias("path"), F.col("x.tokens").alias("token"), F.col("x.ns").alias("n"), F.col("x.chars").alias("chars"))


def _vector(*columns: str) -> Column:
    """Order-free hash of the rows of a group: sums of two halves of their hashes, so that repeats add up and do not cancel."""
    h = F.xxhash64(*columns)
    # Each half has 32 bits, so the sums stay exact for up to 2**31 rows.
    return F.xxhash64(F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned(h, 32)))


def templates(pages: DataFrame) -> DataFrame:
    """(host, main, fixed): per host the path of its main container and its template's text tokens.

    Input columns: host, html.
    """
    stats = _tokens(pages).groupBy("host", "kind", "path", "token").agg(
        F.count("*").alias("support"), F.sum("chars").alias("chars"), F.max("n").alias("most"), _vector("page", "n").alias("vector"))
    folder = scratch_path(pages.sparkSession, "templates")
    stats.write.parquet(f"{folder}/stats")
    stats = pages.sparkSession.read.parquet(f"{folder}/stats")
    # The page token stands once on every page: its support is the number of pages, its vector the one of tokens that do the same.
    hosts = stats.where("kind = 0").select("host", F.col("support").alias("pages"), F.col("vector").alias("page_vector")).where(F.col("pages") >= HOST_PAGES)
    classes = stats.groupBy("host", "vector").agg(F.count("*").alias("class_tokens"))
    valid = stats.join(classes, ["host", "vector"]).join(hosts, "host").where(
        (F.col("class_tokens") >= CLASS_TOKENS) & (F.col("support") >= COVER * F.col("pages")))
    # Nesting: the deepest container that holds nearly all text the outermost does; inner classes refine outer ones.
    containers = valid.where("kind = 1 AND most = 1")
    best = containers.groupBy("host").agg(F.max("chars").alias("all_chars"))
    main = containers.join(best, "host").where("chars >= 0.8 * all_chars AND chars > 0").groupBy("host").agg(F.max("path").alias("main"))
    # Template tokens of a host cover COVER of its pages each, so there are at most 1 / COVER times as many as on an average page.
    fixed = valid.where("kind = 2").groupBy("host").agg(
        F.collect_set("token").alias("fixed"), F.collect_set(F.when((F.col("vector") == F.col("page_vector")) & (F.col("support") == F.col("pages")) & (F.col("pages") >= SURE_PAGES), F.col("token"))).alias("sure"))
    every = hosts.select("host").join(main, "host", "left").join(fixed, "host", "left")
    every.write.parquet(f"{folder}/templates")
    return pages.sparkSession.read.parquet(f"{folder}/templates")


def main_blocks(source: str, main: str | None, fixed: frozenset = frozenset(), sure: frozenset = frozenset()) -> list[str]:
    """The text blocks of one page that are its main text, in page order.

    An article's blocks, but for constant text that is sure to be template; else
    those of the host's main container; else all blocks outside of menus and the
    like - in both cases without the template's text.  An article or main container
    of which the template would leave nothing keeps its text.
    """
    page = read(source or "")
    kept = [(i, text) for i, text, _ in page.blocks if not page.around(i)]
    chosen = [(i, text) for i, text in kept if page.article(i)]
    if chosen:
        known = sure
    else:
        known = fixed
        if main:
            in_main = page.inside(lambda c: c.path == main)
            chosen = [(i, text) for i, text in kept if in_main[i]]
    left = [text for i, text in chosen or kept if not known or block_token(page.containers[i].path, text) not in known]
    return left or [text for _, text in chosen]


def extract(pages: DataFrame, page: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page row.

    A null or empty page has the empty text.  An element that is not closed inside
    its container hides nothing; nested markup of any depth takes memory and time in
    proportion to the page.  Constant text of an article is only left out on hosts
    of at least SURE_PAGES different pages.  A null or unreadable address has no
    host and so no template.  Repeated rows are extracted each; other columns are
    ignored, whatever their names.
    """
    slim = pages.select(F.col(page).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(source).cast("string").alias("html"))
    hosted = slim.withColumn("host", host_of(F.col("url")))
    known = templates(hosted).withColumnRenamed("host", "template_host")
    rows = hosted.join(known, hosted["host"] == known["template_host"], "left").select("page_id", "url", "html", "main", "fixed", "sure")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, fixed, sure = None, frozenset(), frozenset()
        for batch in batches:
            texts = []
            for body, main, some, every in zip(*[c.to_pylist() for c in batch.columns[2:]]):
                if (some, every) != last:
                    last, fixed, sure = (some, every), frozenset(some or ()), frozenset(every or ())
                texts.append("\n".join(main_blocks(body, main, fixed, sure)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(np.array([len(t) for t in texts], dtype=np.int64))],
                                             names=["page_id", "url", "text", "n_chars"])

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
