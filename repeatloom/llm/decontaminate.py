"""Benchmark decontamination with one Aho-Corasick automaton.

Every benchmark item is normalised to words; its windows of ``window`` consecutive
words (an item of fewer words is one window) become patterns of a single automaton.
Words are coded as characters - one or, beyond ``SYMBOLS`` benchmark words, two a word,
NUL for every other word - so that a document is scanned once over its word sequence, and each hit maps
back to word positions and from there to offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held, table, trimmed

WINDOW = 8
#: Benchmark text (bytes) that one automaton holds; more text is scanned in further passes.
SLICE_BYTES = 32_000_000
#: ASCII letters, digits and everything beyond ASCII; on UTF-8 bytes the same as on code points.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower())


#: Code points that are characters of their own, without NUL.
SYMBOLS = 0x110000 - 0x800 - 1


def _symbol(i: int, width: int) -> str:
    """The code of word number ``i``: ``width`` characters, none of them NUL."""
    out = ""
    for _ in range(width):
        i, k = divmod(i, SYMBOLS)
        out += chr(k + 1 if k + 1 < 0xD800 else k + 0x801)
    return out


class _Codes(dict):
    def __init__(self, words: list[bytes]):
        self.width = 1 if len(words) <= SYMBOLS else 2
        self.none = "\0" * self.width
        super().__init__((w, _symbol(i, self.width)) for i, w in enumerate(words))

    def __missing__(self, word: bytes) -> str:
        return self.none


class Automaton:
    """The windows of some items, ready to scan texts."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        texts = [(item_id, words_of(text)) for item_id, text in items]
        self.codes = _Codes(list(dict.fromkeys(w for _, words in texts for w in words)))
        width = self.codes.width
        found: dict[str, tuple[int, set[str]]] = {}
        for item_id, words in texts:
            coded = "".join(self.codes[w] for w in words)
            for k in range(max(1, len(words) - window + 1)) if words else ():
                key = coded[k * width : (k + window) * width]
                found.setdefault(key, (len(key) // width, set()))[1].add(item_id)
        self.automaton = ahocorasick.Automaton()
        for key, value in found.items():
            self.automaton.add_word(key, value)
        self.automaton.make_automaton()
        self.empty = not found

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Merged intervals [from, to) of hit words, and the items with an occurring window."""
        intervals: list[list[int]] = []
        items: set[str] = set()
        if self.empty or not words:
            return intervals, items
        width = self.codes.width
        for last, (length, ids) in self.automaton.iter("".join(map(self.codes.__getitem__, words))):
            end, inside = divmod(last, width)
            if inside != width - 1:
                continue  # across the codes of two words
            start = end - length + 1
            items |= ids
            while intervals and intervals[-1][0] >= start:
                intervals.pop()
            if intervals and start <= intervals[-1][1]:
                intervals[-1][1] = end + 1
            else:
                intervals.append([start, end + 1])
        return intervals, items


def _merge(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, end in sorted([*a, *b]):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out


def spans_of(text: str, intervals: list[list[int]]) -> list[tuple[int, int]]:
    """Offsets [start, end) in code points of the original text, one per interval of words."""
    if not intervals:
        return []
    raw = text.encode("utf-8", "surrogatepass").lower()
    at = [m.span() for m in WORD.finditer(raw)]
    out, seen, chars = [], 0, 0
    for a, b in intervals:
        ends = []
        for byte in (at[a][0], at[b - 1][1]):
            chars += len(raw[seen:byte].decode("utf-8", "surrogatepass"))
            seen = byte
            ends.append(chars)
        out.append((ends[0], ends[1]))
    return out


_HITS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scanner(items: list[tuple[str, str]], window: int):
    key = hashlib.sha256(repr((window, items)).encode("utf-8", "surrogatepass")).hexdigest()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held(("automaton", key), lambda: Automaton(items, window))
        for batch in batches:
            texts = batch.column("text").to_pylist()
            before = batch.column("_hits").to_pylist(), batch.column("_items").to_pylist()
            n_words, hits, ids, spans = [], [], [], []
            for text, old, old_ids in zip(texts, *before):
                words = words_of(text or "")
                intervals, items_ = automaton.scan(words)
                if old:
                    intervals = _merge(intervals, [[h["first"], h["last"]] for h in old])
                n_words.append(len(words))
                hits.append([{"first": a, "last": b} for a, b in intervals])
                ids.append(sorted(items_ | set(old_ids or ())))
                spans.append([{"start": a, "end": b} for a, b in spans_of(text or "", intervals)])
            new = {
                "_hits": pa.array(hits, _HITS),
                "_items": pa.array(ids, pa.list_(pa.string())),
                "n_words": pa.array(n_words, pa.int64()),
                "spans": pa.array(spans, _SPANS),
            }
            columns = {n: new.get(n, batch.column(i)) for i, n in enumerate(batch.schema.names)}
            yield pa.RecordBatch.from_pydict(columns)

    return scan


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per row of ``docs``: the ``keep`` columns and what of the benchmark occurs in it.

    docs: ``text`` and the columns ``keep``; benchmark: ``item_id``, ``text``. Adds
    ``n_words``, ``n_hit`` (words inside any window), ``items`` (sorted strings),
    ``n_items`` and ``spans`` (code-point offsets of the hit passages).

    A null or empty text has no words and no hits. Items without words, or with a null
    id or text, give no windows. Repeated rows are each scanned. An empty benchmark
    yields rows without hits; extra columns are not read. The benchmark reaches the
    workers in slices of at most ``slice_bytes`` of text, one automaton at a time.
    """
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    total = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // slice_bytes))
    spare = [c for c in keep if c != "text"]
    df = docs.select(
        *spare,
        "text",
        F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("_hits"),
        F.expr("cast(array() as array<string>)").alias("_items"),
        F.lit(0).cast("long").alias("n_words"),
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)").alias("spans"),
    )
    for k in range(n):
        part = items if n == 1 else items.where(F.expr(f"pmod(xxhash64(item_id), {n}) = {k}"))
        rows = sorted((r["item_id"], r["text"]) for r in part.collect())  # at most about slice_bytes
        schema = df.schema if "text" in keep or k < n - 1 else df.drop("text").schema
        scanned = df.mapInArrow(trimmed(_pruned(_scanner(rows, window), schema.names)), schema)
        df = scanned if k == n - 1 else cut(scanned, "decontaminate")
    return df.select(
        *keep,
        "n_words",
        F.expr("aggregate(_hits, 0L, (a, h) -> a + h.last - h.first)").alias("n_hit"),
        F.col("_items").alias("items"),
        F.size("_items").cast("long").alias("n_items"),
        "spans",
    )


def _pruned(kernel, names: list[str]):
    def run(batches):
        for batch in kernel(batches):
            yield batch.select(names)

    return run


def cut_passages(found: DataFrame) -> DataFrame:
    """Replace ``text`` by the text without ``spans`` (sorted and disjoint).

    A text without spans, empty or null, stays as it is; one that is all spans becomes
    empty; repeated rows are cut each; other columns are kept.
    """
    rest = F.expr(
        "concat_ws('', transform(sequence(0, size(spans)), k -> substring(text, "
        "cast(if(k = 0, 0, spans[greatest(k - 1, 0)].end) + 1 as int), "
        "cast(if(k = size(spans), length(text), spans[least(k, size(spans) - 1)].start) - if(k = 0, 0, spans[greatest(k - 1, 0)].end) as int))))"
    )
    return found.withColumn("text", F.when(F.size("spans") > 0, rest).otherwise(F.col("text")))


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_items") >= 2).alias("contaminated"),
    )


_WORDS_SQL = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP10_SQL = f"""
with items as (
  select cast(item_id as varchar) as item_id, {_WORDS_SQL} as w from benchmark
  where item_id is not null and text is not null
), windows as (
  select item_id, unnest(list_transform(range(1, greatest(1, len(w) - 7) + 1), lambda k: array_to_string(w[k : k + 7], ' '))) as win
  from items where len(w) > 0
), pats as (
  select win, len(string_split(win, ' ')) as n, list(distinct item_id) as ids from windows group by win
), docs as (
  select row_number() over () as rid, doc_id, {_WORDS_SQL.replace('text', "coalesce(text, '')")} as w from documents
), lens as (select distinct n from pats),
cand as (
  select rid, n, unnest(range(1, len(w) - n + 2)) as k, w from docs, lens where len(w) >= n
), hit as (
  select c.rid, c.k, c.n, p.ids from cand c join pats p on p.n = c.n and p.win = array_to_string(c.w[c.k : c.k + c.n - 1], ' ')
), words as (
  select rid, count(distinct pos) as n_hit from (select rid, unnest(range(k, k + n)) as pos from hit) group by rid
), ids as (
  select rid, list_sort(list(distinct id)) as items from (select rid, unnest(ids) as id from hit) group by rid
)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(h.n_hit, 0) as bigint) as n_hit,
       cast(coalesce(len(i.items), 0) as bigint) as n_items,
       sha256(coalesce(array_to_string(i.items, ','), '')) as items_sha256,
       coalesce(len(i.items), 0) >= 2 as contaminated
from docs d left join words h using (rid) left join ids i using (rid)
"""
