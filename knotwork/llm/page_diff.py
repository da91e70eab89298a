"""Main text of web pages by nearest-URL page differencing.

A page becomes lines, one for each block, without what its tags, roles, classes and ids name as menus, headers, footers, side bars, notices, adverts, forms, scripts, styles or reader comments. What is left still holds the site's own lines, which the page next to it has as well. So pages are ordered by host and URL path, each page is paired with the nearer of its two neighbours on the host, the lines of both are aligned by longest common subsequence, and the shared lines are deleted. Equal pages of a host are one page here.

Two pages that share VERSION of their text or more may be versions of one: then only those lines are the site's own that the further neighbour has too. Lines inside an article element are compared like all others but stay: articles repeat each other's short lines, quotes and passages, and what the element holds is theirs.
"""

from __future__ import annotations

import hashlib
import re
from html.parser import HTMLParser
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from knotwork.llm.bpe import slices
from knotwork.llm.common import stored, table
from knotwork.llm.neighbours import with_neighbours

#: Text of these elements is never shown or is no article text.
DROPPED = frozenset("nav footer aside form script style noscript template iframe svg canvas object embed button select textarea option dialog menu head title audio video math map datalist".split())
#: These start and end a line.
BLOCKS = frozenset("address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: One of these words in a class or id marks what is no article text.
NOISE = frozenset(
    "nav navbar navigation menu sidebar aside ad ads advert adverts advertisement advertising adsense banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login promo promotion "
    "sponsor sponsored share sharing social related recommended breadcrumb breadcrumbs comment comments disqus respond reply replies footer search pagination pager pagenav widget toolbar masthead topbar skip hidden copyright disclaimer".split()
)
#: Outside an article also these.
NOISE_OUTSIDE = NOISE | {"header", "heading", "head", "top", "bottom", "site", "logo"}
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar status toolbar".split())
#: In the name of an article these say that a noise word is about it: has-sidebar, comments-open.
ABOUT = frozenset("has have with without no not is open closed format category tag".split())
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")
_CLOSES_P = BLOCKS - {"tbody", "td", "tfoot", "th", "thead", "tr", "caption", "html", "body"}
#: Pages that share this part of the text may be versions of one page: the further neighbour decides.
VERSION = 0.5
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Rows of bits that `common` keeps at once, in bits.
ROWS = 1 << 26


def _noise(name: str) -> bool:
    """Whether an article's class or id names noise, and not that the article has some or none."""
    words = {w.lower() for w in _WORDS.findall(name)}
    return bool(words & NOISE) and not words & ABOUT


class _Lines(HTMLParser):
    """Collects lines as (whether they are inside an article, text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # tag, dropped, inside an article
        self.parts: list[str] = []
        self.lines: list[tuple[bool, str]] = []

    def _state(self) -> tuple[bool, bool]:
        return (self.open[-1][1], self.open[-1][2]) if self.open else (False, False)

    def _end_line(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.lines.append((self._state()[1], text))
            self.parts = []

    def _pop(self, i: int) -> None:
        self._end_line()
        del self.open[i:]

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in BLOCKS:
            self._end_line()
        elif tag in ("br", "img", "wbr"):
            if tag == "br":
                self.parts.append(" ")
            return
        if tag in VOID:
            return
        if tag in _CLOSES_P:
            # A block ends an open paragraph, and a list item an open one, but not beyond their containers.
            for i in range(len(self.open) - 1, -1, -1):
                t = self.open[i][0]
                if t == "p" or (t == tag and tag in ("li", "dt", "dd")):
                    self._pop(i)
                    break
                if t in BLOCKS or t in DROPPED:
                    break
        dropped, inside = self._state()
        if not dropped and tag not in ("html", "body"):
            dropped, inside = self._judged(tag, dict(attrs), inside)
            if dropped:
                self._end_line()
        self.open.append((tag, dropped, inside))

    @staticmethod
    def _judged(tag: str, attrs: dict, inside: bool) -> tuple[bool, bool]:
        """Whether an element is no article text, and whether what is in it is inside an article."""
        if tag in DROPPED or (tag == "header" and not inside):
            return True, inside
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
            return True, inside
        role = (attrs.get("role") or "").lower()
        if role in ROLES:
            return True, inside
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        if tag == "article" or role == "article":
            return any(_noise(n) for n in names.split()), True
        # A heading inside an article is its own, whatever it is about.
        if names.strip() and tag != "main" and not (inside and tag in _HEADINGS):
            return bool({w.lower() for w in _WORDS.findall(names)} & (NOISE if inside else NOISE_OUTSIDE)), inside
        return False, inside

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.parts.append(" ")
            return
        if tag in BLOCKS:
            self._end_line()
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if any(x[1] for x in self.open[i:]) or tag in BLOCKS or tag in DROPPED:
                    self._pop(i)
                else:
                    del self.open[i]
                return
            # An end tag of a phrase doesn't reach beyond the block it stands in.
            if tag not in BLOCKS and tag not in DROPPED and self.open[i][0] in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        if not self._state()[0]:
            self.parts.append(data)


def page_lines(html: str) -> list[tuple[bool, str]]:
    """All lines that may be text, and whether each is inside an article element."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._end_line()
    return parser.lines


def _rows(a: list, where: dict, full: int, keep: bool) -> tuple[int, list[int]]:
    """Crochemore's rows: after some lines of a, a zero bit j says that line j of b adds one to the common length."""
    v, rows = full, []
    for x in a:
        if keep:
            rows.append(v)
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return v, rows


def _bits(b: list) -> dict:
    where: dict[str, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    return where


def _zeros(v: int, n: int) -> list[int]:
    """How many of the lowest j bits are zero, for j from 0 to n."""
    out, k = [0], 0
    for bit in reversed(bin(v | 1 << n)[3:]):
        k += bit == "0"
        out.append(k)
    return out


def common(a: list[str], b: list[str]) -> list[int]:
    """The places in a of one longest common subsequence of a and b.

    Common ends are cut off, the rest is worked out with one bit for each line of b and read back from the rows. Where these would take more than ROWS bits, a is cut in two, and b where both parts' common lengths add up to the most (Hirschberg), so memory grows with the lines and not with their square."""
    lo, n, m = 0, len(a), len(b)
    while lo < n and lo < m and a[lo] == b[lo]:
        lo += 1
    while n > lo and m > lo and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    found = [*range(lo), *range(n, len(a))]
    there, here = {*b[lo:m]}, {*a[lo:n]}
    kept = [i for i in range(lo, n) if a[i] in there]  # others match nothing
    right = [x for x in b[lo:m] if x in here]
    if not kept:
        return sorted(found)
    left, full = [a[i] for i in kept], (1 << len(right)) - 1
    if len(left) > 1 and len(left) * len(right) > ROWS:
        half = len(left) // 2
        head = _zeros(_rows(left[:half], _bits(right), full, False)[0], len(right))
        tail = _zeros(_rows(left[: half - 1 : -1], _bits(right[::-1]), full, False)[0], len(right))[::-1]
        cut = max(range(len(right) + 1), key=lambda j: head[j] + tail[j])
        found += [kept[i] for i in common(left[:half], right[:cut])] + [kept[half + i] for i in common(left[half:], right[cut:])]
        return sorted(found)
    v, rows = _rows(left, _bits(right), full, True)
    j = len(right) - 1
    for k in range(len(left) - 1, -1, -1):
        after = rows[k + 1] if k + 1 < len(rows) else v
        while j >= 0 and after >> j & 1:
            j -= 1
        if j < 0:
            break
        if rows[k] >> j & 1:  # it wasn't there before line k: line k matches it
            found.append(kept[k])
            j -= 1
    return sorted(found)


def shared_places(lines: list[str], other: list[str], further: list[str] | None) -> list[int]:
    """The places of the lines to delete. A line is + (inside an article) or -, a hash of 16 digits, and its length.

    Lines are the site's that the nearer page has as well, inside an article or not; where these are VERSION of the text or more, those that the further page has too. What is inside an article here stays."""
    text = lambda xs: [x[1:] for x in xs]
    size = lambda places: sum(int(lines[i][17:]) for i in places)
    near = common(text(lines), text(other))
    if further is not None and size(near) >= VERSION * size(range(len(lines))):
        near = sorted({*near} & {*common(text(lines), text(further))})
    return [i for i in near if lines[i][0] == "-"]


def url_key(url: str | None) -> tuple[str, str]:
    """Host and path by which pages are ordered: no scheme, query, fragment, closing slash or .html. No host where the url names none."""
    try:
        u = urlsplit((url or "").strip())
        host, path = (u.netloc or "").lower(), u.path
    except ValueError:
        host, path = "", url or ""
    return host, re.sub(r"(?:/|\.html?|\.php)+$", "", path)


def nearer(path: str, before: str, after: str) -> bool:
    """Whether the page before is at least as near by its path: the longer common start, then the more alike number."""

    def start(x: str) -> tuple[int, int]:
        k = next((i for i, (c, d) in enumerate(zip(path, x)) if c != d), min(len(path), len(x)))
        return k, -abs(len(path) - len(x))

    return start(before) >= start(after)


_SIGNS = pa.schema([("host", pa.string()), ("path", pa.string()), ("page", pa.string()), ("signs", pa.string())])
_GONE = pa.schema([("host", pa.string()), ("page", pa.string()), ("gone", pa.list_(pa.int32()))])
_LINES = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("host", pa.string()), ("page", pa.string()), ("lines", pa.list_(pa.string()))])


def sign(protected: bool, line: str) -> str:
    """What stands for a line where pages are compared: whether it is inside an article, then a hash of 64 bits and its length."""
    return f"{'+' if protected else '-'}{hashlib.blake2b(line.encode('utf-8', 'replace'), digest_size=8).hexdigest()}{len(line)}"


def _gone(befores: list[dict | None], rows: list[dict], afters: list[dict | None]) -> list[dict]:
    """The places of the lines to delete, of those pages that have any."""
    out = []
    for a, b, c in zip(befores, rows, afters):
        a, c = (x if x and x["host"] == b["host"] else None for x in (a, c))
        other, further = (a, c) if a and (not c or nearer(b["path"], a["path"], c["path"])) else (c, a)
        if not other or not b["host"] or "-" not in b["signs"]:
            continue
        lines_of = lambda x: [s for s in x["signs"].split("\n") if s]
        if gone := shared_places(lines_of(b), lines_of(other), further and lines_of(further)):
            out.append({"host": b["host"], "page": b["page"], "gone": gone})
    return out


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page (page_id, url, html).

    Null html is empty and has the empty text; pages whose url names no host are compared with none; repeated rows give repeated results; an empty table an empty one. The whole html is read; other columns are not looked at. Only hashes of lines are dealt, by ranges of host and path, so one large host spreads over many tasks; equal pages of a host are dealt once. The pages are read again for the text."""

    def read(batches):
        for batch in batches:
            for part in slices(batch, 2, 1 << 22):
                for page, url, html in zip(*(part.column(i).to_pylist() for i in range(3))):
                    lines = page_lines(html)
                    signs = "\n".join(sign(*x) for x in lines)
                    yield page, url, url_key(url), hashlib.blake2b(signs.encode(), digest_size=16).hexdigest(), signs, lines
                yield None

    def batched(rows, schema):
        held = []
        for row in rows:
            if row is not None:
                held.append(row)
            elif held:
                yield pa.RecordBatch.from_pylist(held, schema=schema)
                held = []

    def signs_of(batches):
        yield from batched((r and {"host": r[2][0], "path": r[2][1], "page": r[3], "signs": r[4]} for r in read(batches)), _SIGNS)

    def lines_of(batches):
        yield from batched((r and {"page_id": r[0], "url": r[1], "host": r[2][0], "page": r[3], "lines": [t for _, t in r[5]]} for r in read(batches)), _LINES)

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    signs = source.mapInArrow(signs_of, "host string, path string, page string, signs string")
    distinct = stored(signs.groupBy("host", "page").agg(F.min("path").alias("path"), F.any_value("signs").alias("signs")), "signs")
    order = [F.col("host").asc(), F.col("path").asc(), F.col("page").asc()]
    gone = with_neighbours(distinct, order, "signs", _gone, _GONE, "host string, page string, gone array<int>")
    lines = source.mapInArrow(lines_of, "page_id long, url string, host string, page string, lines array<string>")
    kept = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.array_contains("gone", i)))
    texts = lines.join(gone, ["host", "page"], "left").select("page_id", "url", F.array_join(kept, "\n").alias("text"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op9_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))
