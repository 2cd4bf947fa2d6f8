"""Operator 2: main text of web pages by nearest-URL page differencing.

Each page becomes lines (its text blocks in order).  Pages are ordered by host
and path; a page's partner is the neighbour of its host with the longer common
path.  The two pages' lines are aligned by longest common subsequence, and
lines both pages share -- the site's own text -- are deleted.

Differencing alone is wrong twice on pages with articles: menus and adverts
that differ from page to page stay, and articles that repeat (copies, common
passages) vanish.  So lines carry a zone read from the markup: lines inside
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments always go, and lines the page declares as its article (or main
part) are kept even if shared; what is shared goes from all the rest, which is
the text of pages that declare no article.

Pages are paired through one total order, so a host with a third of all pages
is spread over range partitions; every page is a partner of two others at most.

A partner that shares more than half the text of a page without an article may
be a near copy (a print view, a revision), and a copy tells nothing.  Such a
page is aligned with pages of its host further off, 1, 2, 4 ... places to both
sides, until one shares less, whose lines count then.  Where none does, only
lines shared with all of them go, if they are ``MANY`` pages at least or the
lines are three quarters of the text at most.

Edge cases: null or empty html, and pages with nothing but boilerplate, give
empty text; a host with one page, or with copies of one page only, deletes
nothing; a null url is a host of its own;
repeated rows are pages like any other; unclosed and misnested markup ends
where its parent ends.
"""
from __future__ import annotations

import hashlib
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credlake.llm.common import ordered_index, saved

# ---- fixed values: elements and names that mark what a block is ----
RAW = {"script", "style", "template", "noscript", "svg", "iframe", "object", "canvas", "math"}
BOILER = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "textarea", "input", "label", "fieldset"}
BOILER_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu",
                "menubar", "toolbar", "status"}
BOILER_NAMES = {"ad", "ads", "adbox", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
                "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar",
                "notice", "notices", "cookie", "cookies", "consent", "gdpr", "banner", "popup", "modal", "overlay", "alert",
                "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related",
                "recommended", "recommendations", "comment", "comments", "reply", "replies", "respond", "disqus", "widget",
                "pagination", "pager", "toolbar", "copyright", "skip", "hidden"}
#: names that begin so tell a wrapper's state, not what it is
STATE_WORDS = {"has", "no", "with", "without", "is", "js"}
BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "caption", "tr", "thead",
          "tbody", "tfoot", "section", "article", "main", "blockquote", "pre", "figure", "figcaption", "address", "hr", "body",
          "html", "details", "summary", "center", "hgroup"} | BOILER
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
#: a start tag on the left ends an open element on the right
ENDS = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"},
        "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
# ---- end of fixed values ----
BOILER_ZONE, OTHER_ZONE, MAIN_ZONE, ARTICLE_ZONE = 0, 1, 2, 3


def _names_boilerplate(name: str) -> bool:
    """A class or id that is, or has as a part, a name of boilerplate ("no-sidebar" has not)."""
    parts = name.split("-")
    return parts[0] not in STATE_WORDS and any(p in BOILER_NAMES for p in parts)


class _Lines(HTMLParser):
    """Collects (text, zone) of the text blocks of one page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []  # element, the zone it sets
        self.lines: list[tuple[str, int]] = []
        self.words: list[str] = []
        self.raw = 0

    def zone(self) -> int:
        zones = [z for _, z in self.open if z is not None]
        if BOILER_ZONE in zones:
            return BOILER_ZONE
        return max(zones, default=OTHER_ZONE)

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            self.lines.append((text, self.zone()))
        self.words = []

    def _set_by(self, tag: str, attrs: dict[str, str]) -> int | None:
        role = attrs.get("role", "").lower()
        inside = any(z in (MAIN_ZONE, ARTICLE_ZONE) for _, z in self.open)
        if tag in BOILER and not (tag in ("header", "label") and inside) or role in BOILER_ROLES:
            return BOILER_ZONE
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", ""):
            return BOILER_ZONE
        if tag not in ("html", "body"):
            names = (attrs.get("class", "") + " " + attrs.get("id", "")).lower().replace("_", "-").split()
            if tag not in ("article", "main") and any(_names_boilerplate(n) for n in names):
                return BOILER_ZONE
        if tag == "article" or role == "article" or attrs.get("itemprop", "") == "articleBody":
            return ARTICLE_ZONE
        return MAIN_ZONE if tag == "main" or role == "main" else None

    def _close(self, at: int) -> None:
        self.flush()
        for tag, _ in self.open[at:]:
            self.raw -= tag in RAW
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
            if tag != "head" and any(t == "head" for t, _ in self.open):
                self._close(next(k for k, (t, _) in enumerate(self.open) if t == "head"))
            ended = ENDS.get(tag, {"p"} if tag in BLOCKS else set())
        else:
            ended = ENDS.get(tag, set())
            if tag in ("br", "td", "th", "option"):
                self.words.append(" ")
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in ended:
                self._close(k)
                break
            if self.open[k][0] in BLOCKS and self.open[k][0] != "p":
                break
        if tag in VOID:
            return
        self.open.append((tag, self._set_by(tag, {k: v or "" for k, v in attrs})))
        self.raw += tag in RAW

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                if tag in BLOCKS or tag in RAW or self.open[k][1] is not None:
                    self._close(k)
                else:
                    del self.open[k]
                return

    def handle_data(self, data: str) -> None:
        if not self.raw:
            self.words.append(data)


def page_lines(html: str | None) -> list[tuple[str, int]]:
    """Text blocks of a page in order, white space made one, and their zones."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return parser.lines


def shared_lines(mine: list[int], theirs: list[int]) -> list[bool]:
    """Which of ``mine`` lie on a longest common subsequence with ``theirs``.

    Bit-parallel: one big integer per line of ``mine``, one bit per line of ``theirs``.
    """
    n, lead = min(len(mine), len(theirs)), 0
    while lead < n and mine[lead] == theirs[lead]:
        lead += 1
    tail = 0
    while tail < n - lead and mine[-1 - tail] == theirs[-1 - tail]:
        tail += 1
    a, b = mine[lead:len(mine) - tail], theirs[lead:len(theirs) - tail]
    out = [True] * lead + [False] * len(a) + [True] * tail
    places: dict[int, int] = {}
    for j, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << j
    full, row, rows = (1 << len(b)) - 1, (1 << len(b)) - 1, []
    for x in a:  # a zero bit j in a row: the common subsequence grows at line j
        hit = row & places.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    j = len(b)
    for i in range(len(a) - 1, -1, -1):
        above = rows[i - 1] if i else full
        low = (1 << j) - 1
        here, up = j - (rows[i] & low).bit_count(), j - (above & low).bit_count()
        if here > up:  # line i is needed for the first j lines: find its match
            out[lead + i] = True
            match = places[a[i]] & low
            while match:
                j = match.bit_length() - 1
                if j - (above & (1 << j) - 1).bit_count() == here - 1:
                    break
                match &= (1 << j) - 1
    return out


def _line_hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


MANY = 3  # pages that must agree where each shares most of a page's text


def _open_chars(lines: list[tuple[str, int]]) -> list[int] | None:
    """Characters of the lines that sharing decides about; None if an article is declared."""
    if max((z for _, z in lines), default=OTHER_ZONE) > OTHER_ZONE:
        return None
    return [len(t) if z == OTHER_ZONE else 0 for t, z in lines]


def _hash_lines(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            lines = [page_lines(h) for h in part.column("html").to_pylist()]
            hashes = [[_line_hash(t) for t, _ in page] for page in lines]
            yield pa.RecordBatch.from_arrays(
                [part.column("row_id"), part.column("url"), pa.array(hashes, pa.list_(pa.int64())),
                 pa.array([_open_chars(page) for page in lines], pa.list_(pa.int32()))], ["row_id", "url", "hashes", "chars"])


def _align(batches):
    """Places of each page's lines on the longest common subsequence with its
    partner's, and whether they are most of the text that sharing decides about."""
    for batch in batches:
        places, copies = [], []
        for mine, theirs, chars in zip(*(batch.column(c).to_pylist() for c in ("hashes", "other", "chars"))):
            common = shared_lines(mine, theirs) if mine != theirs else [chars is not None] * len(mine)
            places.append([k for k, c in enumerate(common) if c])
            copies.append(chars is not None and 2 * sum(chars[k] for k in places[-1]) > sum(chars))
        yield pa.RecordBatch.from_arrays(
            [batch.column("row_id"), pa.array(places, pa.list_(pa.int32())), pa.array(copies, pa.bool_())], ["row_id", "shared", "copy"])


def _without_shared(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            text, deleted = [], []
            for html, shared in zip(part.column("html").to_pylist(), part.column("shared").to_pylist()):
                lines, gone = page_lines(html), set(shared or ())
                best = max((z for _, z in lines), default=OTHER_ZONE)
                kept = [t for k, (t, z) in enumerate(lines) if z == best > BOILER_ZONE and not (z == OTHER_ZONE and k in gone)]
                text.append("\n\n".join(kept))
                deleted.append(len(lines) - len(kept))
            shared = pa.array([len(x or ()) for x in part.column("shared").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(text, pa.string()), shared, pa.array(deleted, pa.int64())],
                ["page_id", "url", "text", "n_shared", "n_deleted"])


def placed_pages(pages: DataFrame) -> DataFrame:
    """row_id, host, path and the place ``at`` by host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    address = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(address, "^([^/?#]*)", 1))
    path = F.regexp_extract(address, "^[^/?#]*([^?#]*)", 1)
    keys = pages.select("row_id", host.alias("host"), path.alias("path"))
    return ordered_index(keys, [F.col("host"), F.col("path"), F.col("row_id")], "page-order", "at")


def nearest_pages(placed: DataFrame) -> DataFrame:
    """(row_id, partner): the neighbour of the host with the longer common path."""
    def beside(step: int, name: str) -> DataFrame:
        return placed.select((F.col("at") + step).alias("at"), F.struct("row_id", "host", "path").alias(name))

    def common(other: str):
        mine, theirs = F.split("path", ""), F.split(F.col(f"{other}.path"), "")
        first = F.array_position(F.zip_with(mine, theirs, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
        return F.when(F.col(f"{other}.host") == F.col("host"), F.when(first == 0, F.length("path")).otherwise(first - 1))

    near = (placed.join(beside(1, "before"), "at", "left").join(beside(-1, "after"), "at", "left")
            .withColumn("b", common("before")).withColumn("a", common("after")))
    return near.select("row_id", F.when(F.col("a").isNull() | (F.col("b") >= F.col("a")), F.when(F.col("b").isNotNull(), F.col("before.row_id")))
                       .otherwise(F.col("after.row_id")).alias("partner")).filter("partner is not null")


def _past_copies(copies: DataFrame, placed: DataFrame, hashed: DataFrame) -> DataFrame:
    """(row_id, shared) of pages whose nearest page may be a copy, by pages further off."""
    spots = placed.select("row_id", "at", "host")
    state = saved(copies.join(spots, "row_id").select(
        "row_id", "at", "host", F.lit(None).cast("array<int>").alias("gone"), F.lit(0).alias("n")), "page-copies")
    theirs = hashed.select(F.col("row_id").alias("partner"), F.col("hashes").alias("other"))
    others = spots.select(F.col("at").alias("there"), F.col("host").alias("host_there"), F.col("row_id").alias("partner"))
    settled, step = state.limit(0).select("row_id", F.col("gone").alias("shared")), 1
    while not state.isEmpty():
        sides = state.select("row_id", "host", F.explode(F.array(F.col("at") - step, F.col("at") + step)).alias("there"))
        asked = sides.join(others, "there").filter("host = host_there").select("row_id", "partner")
        told = saved(asked.join(theirs, "partner").join(hashed.select("row_id", "hashes", "chars"), "row_id")
                     .select("row_id", "hashes", "other", "chars")
                     .mapInArrow(_align, "row_id long, shared array<int>, copy boolean"), "page-further")
        if told.isEmpty():
            break
        best = told.groupBy("row_id").agg(F.min(F.when(~F.col("copy"), F.col("shared"))).alias("shared"),
                                          F.min("shared").alias("one"), F.max("shared").alias("two"), F.count(F.lit(1)).alias("more"))
        joined = saved(state.join(best, "row_id", "left"), "page-judged")
        settled = settled.union(joined.filter("shared is not null").select("row_id", "shared"))
        both = F.array_intersect("one", "two")
        state = joined.filter("shared is null").select(
            "row_id", "at", "host", F.when(F.col("one").isNull(), F.col("gone")).when(F.col("gone").isNull(), both)
            .otherwise(F.array_intersect("gone", both)).alias("gone"), (F.col("n") + F.coalesce("more", F.lit(0))).cast("int").alias("n"))
        step *= 2
    total = lambda numbers: F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)
    gone = F.transform("gone", lambda k: F.get("chars", k))
    few = 4 * total(gone) <= 3 * total(F.col("chars"))
    agreed = (F.col("n") >= MANY) & (F.size("gone") < F.size("chars"))
    return settled.union(state.join(hashed.select("row_id", "chars"), "row_id").filter(agreed | few)
                         .select("row_id", F.col("gone").alias("shared")))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_shared, n_deleted of every row of ``pages``.

    Alignment works on line hashes; the pages themselves are moved once, to meet
    the places of their shared lines, and parsed again there.  Rows are known by
    a hash of all they hold, so equal rows share one alignment.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html")).withColumn("row_id", F.xxhash64("page_id", "url", "html"))
    hashed = saved(rows.select("row_id", "url", "html").mapInArrow(
        _hash_lines, "row_id long, url string, hashes array<long>, chars array<int>").dropDuplicates(["row_id"]), "page-lines")
    placed = placed_pages(hashed.select("row_id", "url"))
    mine, theirs = hashed.select("row_id", "hashes", "chars"), hashed.select(F.col("row_id").alias("partner"), F.col("hashes").alias("other"))
    tried = saved(nearest_pages(placed).join(theirs, "partner").join(mine, "row_id").select("row_id", "hashes", "other", "chars")
                  .mapInArrow(_align, "row_id long, shared array<int>, copy boolean").filter(F.size("shared") > 0), "page-aligned")
    shared = tried.filter("not copy").select("row_id", "shared")
    copies = tried.filter("copy").select("row_id")
    if not copies.isEmpty():
        shared = shared.union(_past_copies(copies, placed, hashed))
    done = (rows.join(shared, "row_id", "left").select("page_id", "url", "html", "shared")
            .mapInArrow(_without_shared, "page_id long, url string, text string, n_shared long, n_deleted long"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_shared", "n_deleted")
