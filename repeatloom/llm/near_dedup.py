"""Near-duplicate documents by min-max hashing, confirmed on full shingle sets.

Every permutation gives two signature values, the least and the greatest hash of the
document's shingles, so 80 permutations fill 32 bands of 5 values; at a similarity of
0.8 a pair shares no band with a probability of 3e-6.

1. Documents with equal shingle sets become one node.
2. Each band bucket has a leader. Members are compared with it on full sets, and
   the links found join nodes into components: one large group of close copies costs
   as many comparisons as it has members.
3. Buckets that still hold several components are compared inside, in blocks of about
   ``SIGNED`` members. A pair is taken up in the first band that it shares, if it lies
   across components and its signatures agree well enough. What is compared are names and
   signatures. Buckets of up to ``SMALL`` members emit their pairs; of larger ones the
   members of such pairs meet again with their texts (``BLOCK_BYTES`` a block, about) and
   are confirmed there in blocks of ``BLOCK``, which emits one link for each merge instead of all pairs.

So every pair that shares a band is either in one component already or compared.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held, perhaps_among, table, trimmed
from .graph import connected_components

BANDS, ROWS = 32, 5
PERMUTATIONS = BANDS * ROWS // 2
SMALL, BLOCK = 64, 256
#: Members of a block that is compared by signatures alone, without texts.
SIGNED = 4096
#: Bytes of text in a block, about; very long texts make smaller blocks.
BLOCK_BYTES = 16_000_000
#: Share of equal signature values below which a pair is not confirmed: six standard
#: deviations under a similarity of 0.8.
AGREE = 0.61
PERCENT = 80

_RNG = np.random.Generator(np.random.PCG64(20240229))
_MUL = (_RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1))[:, None]
_ADD = _RNG.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32)[:, None]
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    x = (x ^ (x >> np.uint64(28))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The distinct shingles of ``width`` words, as sorted 64-bit hashes.

    A-Z are lower-cased; words are runs of other than white space; fewer words than
    ``width`` are one shingle; no words, no shingles.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - width + 1
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = _mix(total + h[k : k + n] * _ODD[k % 8] + np.uint64(k))
    return np.unique(total)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least values under all permutations, then the greatest."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 2**32 - 1, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for k in range(0, len(x), 16384):
        m = x[None, k : k + 16384] * _MUL + _ADD
        np.minimum(low, m.min(1), out=low)
        np.maximum(high, m.max(1), out=high)
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray) -> np.ndarray:
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in sig.reshape(BANDS, ROWS).T.astype(np.uint64):
        out = _mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + column)
    return out.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("near_dedup", dict)  # other operators' caches go
        for batch in batches:
            n, digests, keys, sigs = [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), width)
                n.append(len(s))
                sig = signature(s)
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(band_keys(sig))
                sigs.append((sig & np.uint32(255)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "n_shingles": pa.array(n, pa.int64()), "node": pa.array(digests, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64())), "sig": pa.array(sigs, pa.binary())})

    return run


def _unpacked(data: bytes) -> str:
    return zstandard.ZstdDecompressor().decompress(data).decode("utf-8", "surrogatepass")


def _texts(width: int):
    """Recompute nodes of (id, text); each node of an id once a partition. Texts travel compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, nodes, texts, sizes = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                s = shingle_set(text, width)
                d = xxhash.xxh3_128_digest(s.tobytes())
                if len(s) and (d, i) not in seen:
                    seen.add((d, i))
                    data = text.encode("utf-8", "surrogatepass")
                    ids.append(i)
                    nodes.append(d)
                    texts.append(pack.compress(data))
                    sizes.append(len(data))
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "node": pa.array(nodes, pa.binary()), "text": pa.array(texts, pa.binary()), "bytes": pa.array(sizes, pa.int64())})

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def of(node: bytes, text: bytes) -> np.ndarray:
            if node not in kept:
                kept[node] = shingle_set(_unpacked(text), width)
                if len(kept) > 16:
                    kept.popitem(last=False)
            return kept[node]

        for batch in batches:
            a, b, ta, tb = (batch.column(k).to_pylist() for k in range(4))
            good = [k for k in range(len(a)) if alike(of(a[k], ta[k]), of(b[k], tb[k]), percent)]
            yield pa.RecordBatch.from_pydict({"a": pa.array([a[k] for k in good], pa.binary()), "b": pa.array([b[k] for k in good], pa.binary())})

    return run


def _groups(batches: Iterator[pa.RecordBatch], n_key: int) -> Iterator[list[tuple]]:
    """Rows of equal keys (the first ``n_key`` columns) of sorted batches, a list a group."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:n_key] != key:
                if rows:
                    yield rows
                key, rows = row[:n_key], []
            rows.append(row)
    if rows:
        yield rows


def _across(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs to confirm in a group of (bucket, lo, hi, block, node, root, bands, sig, ...).

    bands: the upper halves of a node's bucket names, by which the first shared band is told.
    """
    bucket, lo, hi = rows[0][:3]
    sig = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(len(rows), -1)
    keys = np.array([r[6] for r in rows], np.int32)
    roots = {r: k for k, r in enumerate({r[5]: 0 for r in rows})}
    root = np.array([roots[r[5]] for r in rows])
    block = np.array([r[3] for r in rows])
    out = []
    for i in range(len(rows) - 1):
        j = np.arange(i + 1, len(rows))
        j = j[root[j] != root[i]]
        if lo != hi:
            j = j[block[j] != block[i]]
        if len(j):
            j = j[(sig[j] == sig[i]).sum(1) >= AGREE * sig.shape[1]]
        if len(j):
            same = keys[j] == keys[i]
            j = j[keys[i][same.argmax(1)] == bucket >> 32]
        if len(j):
            out.append((np.full(len(j), i), j))
    if not out:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _groups(batches, 3):
        i, j = _across(rows)
        yield pa.RecordBatch.from_pydict({x: pa.array([rows[k][n] for k in at], pa.binary()) for x, at, n in (("a", i, 4), ("b", j, 4), ("ra", i, 5), ("rb", j, 5))})


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of a bucket that are in any pair to confirm."""
    for rows in _groups(batches, 3):
        at = np.unique(np.concatenate(_across(rows))).tolist()
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([rows[k][0] for k in at], pa.int64()), "node": pa.array([rows[k][4] for k in at], pa.binary())})


def _merges(width: int, percent: int):
    """Links across components of large buckets, confirmed here; one for each merge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 3):
            up: dict[bytes, bytes] = {}

            def find(x: bytes) -> bytes:
                while x in up:
                    x = up[x]
                return x

            sets: dict[int, np.ndarray] = {}
            out = []
            for i, j in zip(*(x.tolist() for x in _across(rows))):
                a, b = find(rows[i][5]), find(rows[j][5])
                if a == b:
                    continue
                for k in (i, j):
                    if k not in sets:
                        sets[k] = shingle_set(_unpacked(rows[k][8]), width)
                if alike(sets[i], sets[j], percent):
                    up[max(a, b)] = min(a, b)
                    out.append((rows[i][5], rows[j][5]))
            yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.binary()), "b": pa.array([x[1] for x in out], pa.binary())})

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = PERCENT, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept), one row per row of ``docs``.

    Documents are linked at ``100 * intersection >= percent * union`` of their sets of
    ``width``-word shingles; component_id is the smallest id reachable; kept marks it.

    Null, empty and blank texts have no shingles and link with nothing. Texts of fewer
    than ``width`` words are one shingle. Repeated rows are linked as equal sets; an
    id on several rows keeps a row for each, and a null id counts as larger than all
    others. An empty table gives no rows; columns but id and text are not read.
    """
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    sketches = cut(docs.mapInArrow(trimmed(_sketch(width)), "id long, n_shingles long, node binary, keys array<bigint>, sig binary"), "sketches")
    nodes = cut(sketches.where("n_shingles > 0").groupBy("node").agg(F.min("id").alias("id"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "nodes")

    # 2. members of buckets, and links to their leaders
    buckets = nodes.select("node", F.explode("keys").alias("bucket"))
    leaders = buckets.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1")
    members = cut(buckets.join(leaders, "bucket"), "members")
    involved = cut(members.select("node").distinct().join(nodes.select("node", "id"), "node"), "involved")
    # (what is wanted in error, as other copies of a node, is left out by node and id)
    wanted = perhaps_among(docs, "id", involved.select("id"), "wanted").where("wanted")
    texts = wanted.select("id", "text").mapInArrow(trimmed(_texts(width)), "id long, node binary, text binary, bytes long")
    named = involved.select(F.col("node").alias("named"), F.col("id").alias("by"))
    texts = cut(texts.join(named, (F.col("node") == F.col("named")) & F.col("id").eqNullSafe(F.col("by")), "left_semi").drop("id"), "texts")

    def confirmed(pairs: DataFrame) -> DataFrame:
        # merged at every size: texts are never sent to all tasks
        ta, tb = (texts.select(F.col("node").alias(k), F.col("text").alias(f"t{k}")).hint("merge") for k in "ab")
        x = pairs.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb")
        return x.mapInArrow(trimmed(_confirm(width, percent)), "a binary, b binary")

    star = members.where("node != leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    first = cut(connected_components(confirmed(star)), "components")

    # 3. what lies across components inside a bucket
    # (leaders have been compared with all)
    rooted = members.where("n > 2 and node != leader").join(first, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("root"), "n")
    rooted = cut(rooted, "rooted")
    mixed = rooted.groupBy("bucket").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("bucket")
    halves = nodes.select("node", F.transform("keys", lambda k: F.shiftright(k, 32).cast("int")).alias("bands"), "sig")
    open_ = rooted.join(mixed, "bucket", "left_semi").join(halves.hint("merge"), "node")
    group = ["bucket", "lo", "hi"]
    columns = [*group, "block", "node", "root", "bands", "sig"]
    small = open_.where(f"n <= {SMALL}").select("bucket", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("block"), *columns[4:])
    pairs = small.repartition(*group).sortWithinPartitions(*group).mapInArrow(trimmed(_candidates), "a binary, b binary, ra binary, rb binary").distinct()
    pairs = cut(pairs, "pairs")
    links = confirmed(pairs.select("a", "b")).join(pairs, ["a", "b"]).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    big = open_.where(f"n > {SMALL}")

    def blocked(members: DataFrame, blocks) -> DataFrame:
        """Every pair of a bucket's blocks as a group of rows."""
        dealt = members.withColumn("blocks", blocks).withColumn("block", F.expr("cast(pmod(xxhash64(node, bucket), blocks) as int)"))
        dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, cast(blocks - 1 as int))")))
        return dealt.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})

    every = blocked(big, F.ceil(F.col("n") / SIGNED)).select(*columns)
    paired = cut(every.repartition(*group).sortWithinPartitions(*group).mapInArrow(trimmed(_paired), "bucket long, node binary").distinct(), "paired")
    rest = big.join(paired, ["bucket", "node"], "left_semi")
    weights = paired.join(texts.select("node", "bytes"), "node").groupBy("bucket").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("left"))
    rest = rest.join(weights, "bucket")
    large = blocked(rest, F.greatest(F.ceil(F.col("left") / BLOCK), F.ceil(F.col("bytes") / BLOCK_BYTES))).join(texts.select("node", "text").hint("merge"), "node").select(*columns, "text")
    merges = large.repartition(*group).sortWithinPartitions(*group).mapInArrow(trimmed(_merges(width, percent)), "a binary, b binary")
    second = connected_components(links.unionByName(merges))

    # components of all nodes
    again = second.toDF("root", "last")
    roots = first.join(again, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    roots = roots.unionByName(second.join(first.select("node"), "node", "left_anti"))
    placed = nodes.select("node", "id").join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    components = placed.join(least, "root").select("node", "component_id")
    some = sketches.where("n_shingles > 0").select("id", "n_shingles", "node").join(components, "node").select("id", "n_shingles", "component_id")
    none = sketches.where("n_shingles = 0").select("id", "n_shingles", F.col("id").alias("component_id"))
    return some.unionByName(none).select(F.col("id").alias(id_column), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4)


OP2_SQL = """
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w
  from documents
), sets as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k : k + 3], ' '))) end as s
  from words
), shingles as (select doc_id, len(s) as n, unnest(s) as g from sets),
common as (
  select a.doc_id as x, b.doc_id as y from shingles a join shingles b on a.g = b.g and a.doc_id < b.doc_id
  group by a.doc_id, b.doc_id, a.n, b.n
  having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), links as (select x, y from common union all select y, x from common),
reach(x, y) as (
  select x, y from links union select r.x, l.y from reach r join links l on r.y = l.x
), least as (select x, min(y) as y from reach group by x)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, least(s.doc_id, coalesce(l.y, s.doc_id)) as component_id,
       s.doc_id = least(s.doc_id, coalesce(l.y, s.doc_id)) as kept
from sets s left join least l on s.doc_id = l.x
"""
