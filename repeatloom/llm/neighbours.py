"""Approximate nearest neighbours by cross-polytope hashing.

A hash rotates a unit vector pseudo-randomly (random signs and a fast Hadamard
transform, three times) and takes the nearest signed axis. A table's code joins
``HASHES`` of them. A query probes, in each table, the ``PROBES`` codes of largest
summed coordinates; all vectors in the probed buckets are compared exactly.

Probes cover a fixed number of a table's buckets, whose number grows with the square of
the rotated width. So vectors wider than ``WIDEST``, of which they would cover too little,
are one bucket that all queries look into. All others are hashed, however few they are; a
query whose probes led to at most ``BLOCK`` comparisons, or to fewer entries than are asked
for, is then compared with all entries of its length. No rule looks at the table's size.

Equal vectors are one entry that carries its smallest ids, so copies cost nothing.
The buckets that share a table and a first axis are a group. A task walks its groups one
by one and holds the queries of one only. Groups of more than ``SPLIT`` entries are cut
into blocks, whose queries go to all of them, and more than ``ASKED`` queries of a group
into blocks, whose entries go to all of them, so that no task's memory grows with either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, table

TABLES, HASHES, PROBES = 20, 2, 160
#: Axes a hash that probe codes are made from.
AXES = 16
NEAREST, QUERY_STEP = 5, 50
#: Comparisons, over all tables, up to which a query is compared with all entries of its length.
BLOCK = 64
WIDEST = 64
#: Entries and queries of a group that are held by one task.
SPLIT, ASKED = 65_536, 16_384
#: Bits of a bucket's name below its group.
LOW = 26
#: The bucket, within a length, of all its entries.
ALL = (1 << 44) - 1
_SEED = 97
#: Pairs compared at once, and rows gathered before they are.
_PAIRS, CHUNK_ROWS = 100_000, 100_000


def _hadamard(x: np.ndarray) -> np.ndarray:
    h = 1
    while h < x.shape[1]:
        y = x.reshape(len(x), -1, 2, h)
        x = np.concatenate([y[:, :, :1] + y[:, :, 1:], y[:, :, :1] - y[:, :, 1:]], 2).reshape(len(x), -1)
        h *= 2
    return x / np.sqrt(x.shape[1])


class Hashes:
    """The rotations of all tables for vectors of one length."""

    def __init__(self, dimension: int, tables: int = TABLES, hashes: int = HASHES, seed: int = _SEED):
        self.width = 1 << max(1, (dimension - 1).bit_length())
        self.tables, self.hashes = tables, hashes
        if (2 * self.width) ** (hashes - 1) > 1 << LOW or tables * 2 * self.width >= 1 << (44 - LOW):
            raise ValueError("too many hashes or tables for this length")
        self.signs = np.random.Generator(np.random.PCG64([seed, dimension])).choice([-1.0, 1.0], (tables, hashes, 3, self.width))

    def _rotated(self, x: np.ndarray, t: int, h: int) -> np.ndarray:
        y = np.zeros((len(x), self.width))
        y[:, : x.shape[1]] = x
        for s in self.signs[t, h]:
            y = _hadamard(y * s)
        return np.concatenate([y, -y], 1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, tables): the bucket of each vector in each table."""
        out = np.zeros((len(x), self.tables), np.int64)
        for t in range(self.tables):
            code = np.zeros(len(x), np.int64)
            for h in range(self.hashes):
                code = code * (2 * self.width) + self._rotated(x, t, h).argmax(1)
            out[:, t] = self._named(code, t)
        return out

    def _named(self, code: np.ndarray, t: int) -> np.ndarray:
        """Buckets' names: the table and the first axis, then the other axes in the low bits."""
        others = (2 * self.width) ** (self.hashes - 1)
        return (t * 2 * self.width + code // others << LOW) + code % others

    def probes(self, x: np.ndarray, probes: int = PROBES, axes: int = AXES) -> np.ndarray:
        """(rows, tables * probes): the buckets that each query looks into."""
        out = []
        for t in range(self.tables):
            code, value = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1))
            for h in range(self.hashes):
                r = self._rotated(x, t, h)
                top = np.argsort(-r, axis=1, kind="stable")[:, : min(axes, r.shape[1]) if self.hashes > 1 else probes]
                code = (code[:, :, None] * (2 * self.width) + top[:, None, :]).reshape(len(x), -1)
                value = (value[:, :, None] + np.take_along_axis(r, top, 1)[:, None, :]).reshape(len(x), -1)
                best = np.argsort(-value, axis=1, kind="stable")[:, :probes]
                code, value = np.take_along_axis(code, best, 1), np.take_along_axis(value, best, 1)
            out.append(self._named(code, t))
        return np.concatenate(out, 1)


def _matrix(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """A column of packed vectors as one flat array, and where each begins in it."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    size = np.dtype(kind).itemsize
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data and len(column) and offsets[-1] > offsets[0] else np.zeros(0, kind)
    return flat, (offsets - offsets[0]) // size


def _packed(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [(np.asarray(v, kind) + np.zeros(1, kind)).tobytes() for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"vec_id": batch.column(0), "digest": pa.array([xxhash.xxh3_128_digest(d) for d in data], pa.binary()), "vector": pa.array(data, pa.binary())})

    return run


def _bucketed(kind: str, tables: int, hashes: int, probes: int, whole: frozenset[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Hashes] = {}
        for batch in batches:
            flat, at = _matrix(batch.column(1), kind)
            length = np.diff(at)
            out: list = [None] * len(length)
            for n in np.unique(length).tolist():
                rows = np.flatnonzero(length == n)
                if n in whole:
                    for k in rows.tolist():
                        out[k] = [(n << 44) + ALL]
                    continue
                x = flat[at[rows][:, None] + np.arange(n)].astype(float)
                x /= np.abs(x).max(1, keepdims=True)  # against overflow
                x /= np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                h = made.setdefault(n, Hashes(n, tables, hashes))
                codes = (h.probes(x, probes) if probes else h.codes(x)) + (n << 44)
                for k, row in zip(rows.tolist(), codes):
                    out[k] = row
            yield pa.RecordBatch.from_pydict({"entry": batch.column(0), "vector": batch.column(1), "codes": pa.array(out, pa.list_(pa.int64()))})

    return run


def _cosines(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of rows, in double precision; scaled by a power of two only where squares would overflow or vanish."""
    def scaled(v):
        top = np.abs(v).max(1)
        power = np.where((top > 1e100) | (top < 1e-100), -np.frexp(top)[1], 0)
        return np.ldexp(v, power[:, None]) if power.any() else v

    y, x = scaled(y), scaled(x)
    return np.einsum("ij,ij->i", y, x) / (np.sqrt(np.einsum("ij,ij->i", y, y)) * np.sqrt(np.einsum("ij,ij->i", x, x)))


def _best(q: np.ndarray, c: np.ndarray, s: np.ndarray, nearest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's nearest entries; entries are named by their smallest ids, so ties go to the smaller."""
    order = np.lexsort((c, -s, q))
    q, c, s = q[order], c[order], s[order]
    new = np.r_[True, (q[1:] != q[:-1]) | (c[1:] != c[:-1])][: len(q)]
    q, c, s = q[new], c[new], s[new]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][: len(q)])
    keep = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)])) < nearest
    return q[keep], c[keep], s[keep]


def _compared(rows: pa.Table, names: np.ndarray, matrix: np.ndarray, nearest: int) -> tuple[list[tuple], np.ndarray, np.ndarray]:
    """Rows (bucket, entry, vector or null for a query) of whole buckets: each query's best of its
    buckets, and for each probe that met entries its query and how many they were."""
    bucket, entry = rows.column(0).to_numpy(), rows.column(1).to_numpy()
    column = rows.column(2).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat, at = _matrix(column, matrix.dtype.str)
    is_query = np.asarray(column.is_null())
    have, ask = np.flatnonzero(~is_query), np.flatnonzero(is_query)
    lo, hi = np.searchsorted(bucket[have], bucket[ask], "left"), np.searchsorted(bucket[have], bucket[ask], "right")
    live = hi > lo
    ask, lo, hi = ask[live], lo[live], hi[live]
    total, parts, start, n = np.cumsum(hi - lo), [], 0, matrix.shape[1]
    while start < len(ask):
        end = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + _PAIRS, "right")))
        size = hi[start:end] - lo[start:end]
        row = np.repeat(ask[start:end], size)
        c = have[np.repeat(lo[start:end], size) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)]
        y = matrix[np.searchsorted(names, entry[row])].astype(float)
        x = flat[at[c][:, None] + np.arange(n)].astype(float)
        parts.append(_best(entry[row], entry[c], _cosines(y, x), nearest))
        start = end
    return parts, entry[ask], hi - lo


def _search(kind: str, nearest: int):
    """Rows (piece, bucket, kind, entry, vector), sorted: of a piece of a group first the
    vectors of its queries (bucket -1), then by bucket the entries (kind 0) and the queries
    that probe it (1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, told, asked = None, [], None
        waiting: list[pa.RecordBatch] = []
        held = 0

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            """Compare the whole buckets that wait."""
            nonlocal asked, waiting, held
            if not waiting:
                return
            t = pa.Table.from_batches(waiting).combine_chunks()
            bucket, end = t.column(0).to_numpy(), held
            if not last:
                change = np.flatnonzero(bucket[1:] != bucket[:-1])
                end = int(change[-1]) + 1 if len(change) else 0
            if end and told:
                if asked is None:
                    rows = pa.Table.from_batches(told).combine_chunks()
                    names = rows.column(1).to_numpy()
                    flat, _ = _matrix(rows.column(2).combine_chunks(), kind)
                    order = np.argsort(names, kind="stable")
                    asked = names[order], flat.reshape(len(names), -1)[order]
                parts, probing, met = _compared(t.slice(0, end), *asked, nearest)
                if parts:
                    q, c, s = _best(*(np.concatenate(x) for x in zip(*parts)), nearest)
                    name, at = np.unique(probing, return_inverse=True)
                    seen = np.zeros(len(q), np.int64)
                    seen[np.searchsorted(q, name)] = np.bincount(at, met)  # on a query's first row
                    yield pa.RecordBatch.from_pydict({"query": pa.array(q, pa.int64()), "entry": pa.array(c, pa.int64()), "score": pa.array(s, pa.float64()), "seen": pa.array(seen)})
            waiting, held = t.slice(end).to_batches(), held - end

        for batch in batches:
            pieces, buckets = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero((pieces[1:] != pieces[:-1]) | ((buckets[1:] < 0) != (buckets[:-1] < 0))) + 1).tolist(), len(pieces)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if pieces[a] != piece:
                    yield from out(True)
                    piece, told, asked = pieces[a], [], None
                rows = batch.slice(a, b - a).select([1, 3, 4])
                if buckets[a] < 0:
                    told.append(rows)
                else:
                    waiting.append(rows)
                    held += b - a
                    if held >= CHUNK_ROWS:
                        yield from out(False)
        yield from out(True)

    return run


def _looked_up(index: DataFrame, looked: DataFrame, kind: str, nearest: int) -> DataFrame:
    """(query, entry, score, seen): each query's best ``nearest`` + 1 entries, or more, of the buckets
    in its codes; the sum of ``seen`` over a query's rows is the number of its comparisons."""
    group = F.shiftright("bucket", LOW).alias("group")
    groups = F.explode(F.array_distinct(F.transform("codes", lambda c: F.shiftright(c, LOW)))).alias("group")
    held = index.select(F.explode("codes").alias("bucket"), "entry", "vector").select(group, "*")
    told = looked.select(groups, "entry", "vector")
    probed = looked.select(F.explode("codes").alias("bucket"), "entry").select(group, "*")

    def crowded(rows: DataFrame, most: int, name: str) -> DataFrame:
        """(group, name, n): in how many blocks the larger groups are cut."""
        sizes = rows.groupBy("group").count().where(F.col("count") > most)
        return sizes.select("group", F.lit(name).alias("name"), F.ceil(F.col("count") / most).cast("int").alias("n"))

    sizes = cut(crowded(index.select(groups), SPLIT, "blocks").unionByName(crowded(looked.select(groups), ASKED, "parts")), "crowded")
    if sizes.isEmpty():
        cut_up = lambda df: df.withColumns({"blocks": F.lit(1), "parts": F.lit(1)})
    else:
        wide = sizes.groupBy("group").pivot("name", ["blocks", "parts"]).agg(F.first("n"))
        cut_up = lambda df: df.join(wide, "group", "left").fillna(1, ["blocks", "parts"])
    own = lambda n: F.pmod(F.xxhash64("entry", F.lit(3)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = F.lit(None).cast("binary")

    def rows(df: DataFrame, of_queries: bool, bucket, kind_: int, vector) -> DataFrame:
        df = cut_up(df).withColumn("block", every("blocks") if of_queries else own("blocks"))
        df = df.withColumn("asked", own("parts") if of_queries else every("parts"))
        return df.select(F.xxhash64("group", "block", "asked").alias("piece"), "group", "block", "asked", bucket.alias("bucket"), F.lit(kind_).alias("kind"), "entry", vector.alias("vector"))

    both = rows(held, False, F.col("bucket"), 0, F.col("vector")).unionByName(rows(told, True, F.lit(-1).cast("long"), -1, F.col("vector"))).unionByName(rows(probed, True, F.col("bucket"), 1, none))
    n = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.repartitionById(n, F.pmod("piece", F.lit(n)).cast("int")).sortWithinPartitions("piece", "group", "block", "asked", "bucket", "kind")
    name = F.xxhash64("piece", "group", "block", "asked").alias("piece")
    return both.select(name, "bucket", "kind", "entry", "vector").mapInArrow(_search(kind, nearest + 1), "query long, entry long, score double, seen long").groupBy("query", "entry").agg(F.max("score").alias("score"), F.sum("seen").alias("seen"))


def nearest_neighbours(vectors: DataFrame, queries: DataFrame, nearest: int = NEAREST, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``nearest`` rows of largest cosine found.

    vectors and queries hold an id and an array of numbers; a query's own id is no
    candidate. Ties go to the smaller id. Null ids, and vectors that are null, empty,
    zero or hold null or non-finite components, take no part, nor do candidates of another
    length than the query's. A repeated row is one entry; an id with several vectors
    stands for one of them, the same in every run. A query without candidates has no
    rows, one with fewer than ``nearest`` has all of them. Other columns are not read.
    """
    types = [df.schema[vector_column].dataType.elementType.simpleString() for df in (vectors, queries)]
    kind, element = ("<f4", "float") if set(types) == {"float"} else ("<f8", "double")
    finite = f"size({vector_column}) > 0 and forall({vector_column}, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists({vector_column}, x -> x != 0)"

    def packed(df: DataFrame, name: str) -> DataFrame:
        valid = df.where(f"{id_column} is not null and {vector_column} is not null").where(finite)
        rows = valid.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast(f"array<{element}>").alias("v")).mapInArrow(_packed(kind), "vec_id long, digest binary, vector binary")
        return cut(rows.groupBy("vec_id").agg(F.min(F.struct("digest", "vector")).alias("r")).select("vec_id", "r.digest", "r.vector"), name)

    def entries(rows: DataFrame) -> DataFrame:
        return rows.groupBy("digest").agg(F.min("vec_id").alias("entry"), F.first("vector").alias("vector"))

    rows, asked_rows = packed(vectors, "vectors"), packed(queries, "asked")
    length = (F.length("vector") / np.dtype(kind).itemsize).cast("long").alias("length")
    lengths = [r["length"] for r in rows.select(length).distinct().collect()]
    whole = frozenset(n for n in lengths if n > WIDEST)
    schema = "entry long, vector binary, codes array<bigint>"
    index = cut(entries(rows).select("entry", "vector").mapInArrow(_bucketed(kind, tables, hashes, 0, whole), schema), "index")
    looked = cut(entries(asked_rows).select("entry", "vector").mapInArrow(_bucketed(kind, tables, hashes, probes, whole), schema), "looked")
    found = _looked_up(index, looked, kind, nearest)
    hashed = [n for n in lengths if n not in whole]
    if hashed:
        found = cut(found, "found")
        counts = found.groupBy(F.col("query").alias("entry")).agg(F.count("*").alias("n"), F.sum("seen").alias("seen"))
        every = F.array(F.shiftleft(length, 44) + F.lit(ALL)).alias("codes")
        few = looked.where(length.isin(hashed)).join(counts, "entry", "left").where((F.coalesce("n", F.lit(0)) <= nearest) | (F.coalesce("seen", F.lit(0)) <= BLOCK))
        few = cut(few.select("entry", "vector", every), "few")
        if not few.isEmpty():
            again = index.select("entry", "vector", every, length).join(few.select(length).distinct(), "length", "left_semi").drop("length")
            found = found.unionByName(_looked_up(again, few, kind, nearest)).groupBy("query", "entry").agg(F.max("score").alias("score"))
    first_of = Window.partitionBy("query").orderBy(F.desc("score"), "entry")
    found = found.withColumn("n", F.row_number().over(first_of)).where(F.col("n") <= nearest + 1)

    def ids_of(rows: DataFrame, most: int | None) -> DataFrame:
        """(entry, vec_id): the smallest ids of equal vectors."""
        same = Window.partitionBy("digest").orderBy("vec_id")
        ranked = rows.select("digest", "vec_id").withColumn("n", F.row_number().over(same))
        return (ranked.where(F.col("n") <= most) if most else ranked).select("digest", "vec_id")

    named = rows.groupBy("digest").agg(F.min("vec_id").alias("entry")).join(ids_of(rows, nearest + 1), "digest").select("entry", "vec_id")
    of_ids = found.select("query", "entry", "score").join(named, "entry")
    asks = asked_rows.groupBy("digest").agg(F.min("vec_id").alias("query")).join(asked_rows.select("digest", F.col("vec_id").alias("query_id")), "digest").select("query", "query_id")
    pairs = asks.join(of_ids, "query").where("query_id != vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op3_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_neighbours(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))
