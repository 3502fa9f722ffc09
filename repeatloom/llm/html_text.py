"""Main text of web pages by differencing with the pages of nearest URL on the host.

Pages are ordered by host, URL path, URL and id; a page's partners are the nearest page
before and after it on its host whose lines differ from its own. Text lines (blocks) of a
page are aligned with those of each partner by longest common subsequence; a shared line
is template and is deleted - unless it stands inside the page's article, where equal
lines are quotations or repeated passages, not template. Differencing alone keeps what
varies from page to page and has no partner on hosts of one page, so elements that
declare themselves as other than the article (menus, headers, footers, asides, forms,
scripts, adverts, notices, comments) go as well.

Partners do not depend on how rows are dealt: a first pass over keys (URL, id and a digest
of the lines) fixes the bounds of the ranges and finds, for each bound, the pages on its
other side that differ; these few pages are sent to both ranges in the second pass.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table

#: Fixed values of HTML: elements without content, that break a line, whose content is
#: not text, and that are never the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript ol option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
RAW = frozenset("script style template noscript iframe svg textarea title xmp noembed noframes math object".split())
OTHER = frozenset("nav footer aside form menu button select dialog head search fieldset".split())
OUTER_OTHER = frozenset(["header"])
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog alert".split())
#: Words of class and id values.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments respond replies disqus widget pagination pager copyright skip".split())
_NAME = re.compile(r"/?[A-Za-z][A-Za-z0-9:-]*")
#: Text or a tag; quoted values may hold ">". Possessive: no part is tried again.
_TOKEN = re.compile(r"""[^<]++|<(/?[A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")
_ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}
#: Raw elements that, left open, run to the page's end; of others the tag alone is passed over.
TO_END = frozenset("script style iframe textarea title xmp noembed noframes".split())
_PART = re.compile(r"[^a-z0-9]+")
CLOSES_P = BLOCK - {"button", "body", "html", "head", "option"}
#: Elements whose class says how a text is set, not what it is, where they are in an article.
SET_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 hgroup header blockquote pre dd figcaption article main".split())
#: Elements that end one of their own that is open, and those that keep it open.
ENDS_OWN = frozenset("li td th tr dd dt option".split())
HOLDS = frozenset("ul ol table dl select tr tbody thead menu".split())
#: Bits of an alignment table that are held at once.
TABLE_BITS = 1 << 28
#: Open elements that an end tag or an implied end looks through.
DEPTH = 512


def _is_other(tag: str, attributes: str, inside: bool) -> bool:
    if tag in OTHER or (tag in OUTER_OTHER and not inside):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    named: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(attributes):
        named.setdefault(m[1].lower(), (m[2] or m[3] or m[4] or "").lower())
    if named.get("role", "").strip() in ROLES:
        return True
    if tag not in SET_TEXT or not inside:
        for name in ("class", "id"):
            words = {w for w in _PART.split(named.get(name, "")) if w}
            if words & MARKS and not words & {"article", "content", "main", "post", "body", "entry"} - ({"post"} if "comment" in words else set()):
                return True
            if words & {"comment", "comments", "advert", "sidebar"}:
                return True
    return named.get("hidden", "false").strip() != "false" or named.get("aria-hidden", "").strip() == "true" or bool(_NO_DISPLAY.search(named.get("style", "")))


class _Markup:
    """Cuts a page into text and tags, in time linear in its length."""

    def __init__(self, page: str):
        self.page = page
        self.quotes = True  # until one is found open at the page's end
        self.missing: set[str] = set()  # strings that do not occur any further

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def tag(self, at: int) -> tuple[int, str, str]:
        """After the tag at ``at`` that ends at the next ">", its name and attributes; -1 if it is none."""
        m = _NAME.match(self.page, at + 1)
        end = self.find(">", m.end()) if m else -1
        return (end + 1, m[0], self.page[m.end() : end]) if end >= 0 else (-1, "", "")

    def end_of(self, tag: str, at: int) -> int:
        """After the end tag of the raw element ``tag``, or -1."""
        if f"</{tag}" in self.missing:
            return -1
        m = _ENDS[tag].search(self.page, at)
        if not m:
            self.missing.add(f"</{tag}")
            return -1
        return self.find(">", m.end()) + 1 or len(self.page)

    def declaration(self, at: int) -> tuple[int, str]:
        """After the comment, declaration or CDATA section at ``at``, and its text."""
        page = self.page
        if page.startswith("<!--", at):
            if page.startswith((">", "->"), at + 4):
                return page.index(">", at) + 1, ""
            ends = [(k, len(e)) for e in ("-->", "--!>") if (k := self.find(e, at + 4)) >= 0]
            return (sum(min(ends)) if ends else len(page)), ""
        if page.startswith("<![CDATA[", at) and (end := self.find("]]>", at)) >= 0:
            return end + 3, html.escape(page[at + 9 : end], quote=False)
        return self.find(">", at) + 1 or len(page), ""

    def tokens(self) -> Iterator[tuple[str, str | None, str]]:
        """(text, None, "") or (attributes, tag, "/" for an end tag); raw elements are passed over."""
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            m = _TOKEN.match(page, at) if self.quotes or page[at] != "<" else None
            if m:
                at = m.end()
                tag, attributes = m[1], m[2]
                if tag is None:
                    yield m[0], None, ""
                    continue
            elif page.startswith(("<!", "<?"), at):
                at, text = self.declaration(at)
                if text:
                    yield text, None, ""
                continue
            else:
                self.quotes = self.quotes and not _NAME.match(page, at + 1)
                end, tag, attributes = self.tag(at)
                if end < 0:
                    yield "<", None, ""
                    at += 1
                    continue
                at = end
            tag = tag.lower()
            if tag[0] == "/":
                yield attributes, tag[1:], "/"
                continue
            yield attributes, tag, ""
            if tag in RAW and not attributes.rstrip().endswith("/"):
                end = self.end_of(tag, at)
                at = end if end >= 0 else size if tag in TO_END else at


def blocks_of(page: str) -> tuple[list[str], list[bool], list[bool]]:
    """Lines of a page in order; whether each is inside an article, and inside another
    declared part."""
    lines: list[str] = []
    inside_: list[bool] = []
    other_: list[bool] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, in an article, in another part
    open_: Counter = Counter()  # tags of the stack
    text: list[str] = []
    article = other = False

    def end_line() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                lines.append(line)
                inside_.append(article)
                other_.append(other)

    def close(k: int) -> None:
        nonlocal article, other
        for t in stack[k:]:
            open_[t[0]] -= 1
        del stack[k:]
        article, other = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    def close_open(tag: str, ends: frozenset | set) -> None:
        """Close the innermost ``tag``, unless one of ``ends`` is inside it."""
        if open_[tag] > 0:
            for k in range(len(stack) - 1, max(-1, len(stack) - 1 - DEPTH), -1):
                if stack[k][0] == tag:
                    return close(k)
                if stack[k][0] in ends:
                    return

    for piece, tag, ended in _Markup(page).tokens():
        if tag is None:
            text.append(piece)
            continue
        if tag in BLOCK:
            end_line()
        if ended:
            close_open(tag, frozenset() if tag in BLOCK else BLOCK)  # an inline end tag closes no block
            continue
        if tag == "br":
            text.append(" ")
        if tag in RAW or tag in VOID:
            continue
        if tag in CLOSES_P:
            close_open("p", BLOCK)
        if tag in ENDS_OWN:
            close_open(tag, HOLDS - {tag})
        hidden = other or _is_other(tag, piece, article)
        if tag in BLOCK or hidden != other or open_[tag] > 0:  # other inline elements change nothing
            other = hidden
            article = article or (tag in ("article", "main") and not other)
            stack.append((tag, article, other))
            open_[tag] += 1
    end_line()
    return lines, inside_, other_


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Indices of ``a`` in a longest common subsequence with ``b`` (bit-parallel)."""
    found: set[int] = set()
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        found.add(start)
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        found.add(len(a) - 1 - end)
        end += 1
    both = set(a[start : len(a) - end]) & set(b[start : len(b) - end])
    at = [k for k in range(start, len(a) - end) if a[k] in both]
    rest = [x for x in b[start : len(b) - end] if x in both]
    if not at or not rest:
        return found
    numbers = {x: k for k, x in enumerate(dict.fromkeys(rest))}
    found |= {at[k] for k in _aligned([numbers[a[k]] for k in at], [numbers[x] for x in rest])}
    return found


def _rows(a: list[int], b: list[int], every: bool) -> list[int]:
    """Bit vectors of the alignment of ``a`` with each prefix of ``b`` (or the last one): a
    zero bit where the length of the common subsequence grows."""
    masks: dict[int, int] = {}
    for k, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    v, rows = full, []
    for x in b:
        u = v & masks.get(x, 0)
        v = ((v + u) | (v - u)) & full
        if every:
            rows.append(v)
    return rows if every else [v]


def _lengths(row: int, n: int) -> np.ndarray:
    """Lengths for prefixes of 0 to n."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def _aligned(a: list[int], b: list[int]) -> list[int]:
    """Indices of ``a`` in a longest common subsequence; memory is bounded by TABLE_BITS."""
    if not a or not b:
        return []
    if len(a) * len(b) > TABLE_BITS and len(b) > 1:
        half = len(b) // 2
        front = _lengths(_rows(a, b[:half], False)[0], len(a))
        back = _lengths(_rows(a[::-1], b[:half - 1 : -1], False)[0], len(a))[::-1]
        k = int((front + back).argmax())
        return _aligned(a[:k], b[:half]) + [k + i for i in _aligned(a[k:], b[half:])]
    rows, found = _rows(a, b, True), []
    row, col = len(b), len(a)
    while row and col:
        bit = 1 << (col - 1)
        if rows[row - 1] & bit:
            col -= 1
        else:
            row -= 1
            if not (row and not rows[row - 1] & bit):
                col -= 1
                found.append(col)
    return found[::-1]


def main_text(page: tuple, neighbours: list[tuple]) -> str:
    lines, inside, other = page
    shared: set[int] = set()
    for n in neighbours:
        shared |= common_lines(lines, n[0])
    return "\n".join(x for k, x in enumerate(lines) if not other[k] and (inside[k] or k not in shared))


def _key(host: str, path: str, url: str, page_id: int | None, digest: bytes) -> bytes:
    """Orders pages by host, path, URL, id (null first) and digest of the lines."""
    text = "\0".join(x.replace("\0", "\1") for x in (host, path, url))
    number = b"\0" * 9 if page_id is None else b"\1" + (page_id + 2**63).to_bytes(8, "big")
    return text.encode("utf-8", "surrogatepass") + b"\0" + number + digest


def _page(key: bytes) -> tuple[bytes, bytes]:
    """Host, and digest of the lines: pages that agree in both are copies."""
    return key[: key.index(0)], key[-16:]


def _packed(blocks: tuple) -> bytes:
    """Blocks as lines that begin with their flags."""
    return "\n".join(f"{i + 2 * o}{x}" for x, i, o in zip(*blocks)).encode("utf-8", "surrogatepass")


def _unpacked(data: bytes) -> tuple:
    lines = data.decode("utf-8", "surrogatepass").split("\n") if data else []
    return [x[1:] for x in lines], [x[0] in "13" for x in lines], [x[0] in "23" for x in lines]


def _keyed(batch: pa.RecordBatch) -> Iterator[tuple[bytes, bytes, object, object]]:
    """(key, packed blocks, page_id, url) of rows (page_id, url, html, host, path)."""
    for page_id, url, page, host, path in zip(*batch.columns):
        blocks = _packed(blocks_of(page.as_py() or ""))
        yield _key(host.as_py(), path.as_py(), url.as_py() or "", page_id.as_py(), xxhash.xxh3_128_digest(blocks)), blocks, page_id, url


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pydict({"key": pa.array([k for k, *_ in _keyed(batch)], pa.binary())})


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a range of sorted keys: the first, the first that is no copy of it, the last that
    is no copy of the last, and the last."""
    first = second = last = other = None
    for batch in batches:
        for key in batch.column(0).to_pylist():
            if first is None:
                first = key
            elif second is None and _page(key) != _page(first):
                second = key
            if last is not None and _page(last) != _page(key):
                other = last
            last = key
    if first is not None:
        yield pa.RecordBatch.from_pydict({"ends": pa.array([[first, second, other, last]], pa.list_(pa.binary()))})


def _partners(ends: list[list[bytes | None]]) -> dict[bytes, list[int]]:
    """Keys of pages beyond a range's bounds that its pages are aligned with, and the ranges."""
    out: dict[bytes, list[int]] = {}
    for k, (first, _, _, last) in enumerate(ends):
        for own, others, near, far in ((first, range(k - 1, -1, -1), 3, 2), (last, range(k + 1, len(ends)), 0, 1)):
            found = None
            for q in others:
                found = ends[q][near] if _page(ends[q][near]) != _page(own) else ends[q][far]
                if found is not None:
                    break
            if found is not None and _page(found)[0] == _page(own)[0]:
                out.setdefault(found, []).append(k)
    return out


def _dealt(bounds: list[bytes], partners: dict[bytes, list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, sent = zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            rows = []
            for key, blocks, page_id, url in _keyed(batch):
                data = pack.compress(blocks)
                rows.append((bisect.bisect_right(bounds, key), key, data, page_id.as_py(), url.as_py(), True))
                if key in partners and key not in sent:
                    sent.add(key)
                    rows += [(k, key, data, None, None, False) for k in partners[key]]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, kinds)], names=["part", "key", "blocks", "page_id", "url", "own"])

    return run


#: Characters of text that an output batch holds, about.
BATCH_CHARS = 4_000_000


def _differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, blocks, page_id, url, own) of a range, sorted. Of a run of copies only ids and URLs are held."""
    unpack = zstandard.ZstdDecompressor()
    before = run = None  # ((host, digest), blocks, rows)

    def out(rows: list, text: str) -> Iterator[pa.RecordBatch]:
        step = max(1, BATCH_CHARS // (len(text) + 1))
        for k in range(0, len(rows), step):
            ids, urls = zip(*rows[k : k + step])
            yield pa.RecordBatch.from_pydict({"page_id": pa.array(ids, pa.int64()), "url": pa.array(urls, pa.string()), "text": pa.array([text] * len(ids), pa.string()), "n_chars": pa.array([len(text)] * len(ids), pa.int64())})

    def done(after) -> Iterator[pa.RecordBatch]:
        if run and run[2]:
            yield from out(run[2], main_text(run[1], [x[1] for x in (before, after) if x and x[0][0] == run[0][0]]))

    for batch in batches:
        for key, blocks, page_id, url, own in zip(*(c.to_pylist() for c in batch.columns)):
            page = _page(key)
            if run is None or page != run[0]:
                new = (page, _unpacked(unpack.decompress(blocks)), [])
                yield from done(new)
                before, run = run, new
            if own:
                run[2].append((page_id, url))
    yield from done(None)


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), a row per row of ``pages``; text is the article.

    pages: ``page_id``, ``url``, ``html``; other columns are not read. A null or empty
    html has the empty text. Pages whose url is null or has no host are hosts without a
    name together. A page alone on its host is judged by its elements. Copies - repeated
    rows, or one page under several URLs that follow each other - are no partners of each
    other and have the same text. An empty table gives no rows. The result does not
    depend on the number of partitions.
    """
    spark = pages.sparkSession
    url = F.coalesce(F.col("url"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host.alias("host"), path.alias("path"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = cut(rows.mapInArrow(_keys, "key binary"), "keys").repartitionByRange(parts, "key").sortWithinPartitions("key")
    # four keys a range
    ends = sorted(([bytes(k) if k is not None else None for k in r["ends"]] for r in keys.mapInArrow(_ends, "ends array<binary>").collect()), key=lambda e: e[0])
    dealt = rows.mapInArrow(_dealt([e[0] for e in ends[1:]], _partners(ends)), "part int, key binary, blocks binary, page_id long, url string, own boolean")
    ranges = dealt.repartitionById(max(1, len(ends)), "part").sortWithinPartitions("key").drop("part")
    return ranges.mapInArrow(_differenced, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
