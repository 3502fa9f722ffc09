"""Training-order materialisation of token sequences as fixed-stride binary shards.

1. Every document is encoded once; its ids and an end id go, compressed, to a staging file
   of its task. What moves from here on are rows of a few numbers a document.
2. Documents are ordered by id and digest of the text - an order of the data, which no
   split of the input changes - and a prefix sum of their lengths gives each its place in
   one stream of ids. Sequence k is the ids k * ``LENGTH`` to (k + 1) * ``LENGTH`` of the
   stream; only the last is padded.
3. A keyed Feistel network permutes the sequence numbers; results outside the range walk
   the cycle until they are inside. The result is the sequence's slot in training order.
4. Pieces of documents go to their slots by range: each partition holds consecutive whole
   shards. Each shard is one file of records of equal length in slot order, written under
   a temporary name and then renamed, so a task that is run again leaves the same file,
   and a reader resumes at any slot by seeking.

The key and the slot numbers alone say what comes next: nothing is kept between runs.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, new_path, table
from .tokens import encoder, vocabulary

LENGTH, END_ID, PAD_ID = 2048, 1, 0
#: Slots of a shard.
SHARD_SLOTS = 4096
ROUNDS, KEY = 6, 0x5EED
def feistel(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of range(n), at the places ``index``."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.Generator(np.random.PCG64(key)).integers(1, 2**63, rounds, dtype=np.uint64) | np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            f = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) ^ k
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return left << np.uint64(half) | right

    x = once(np.asarray(index, np.uint64))
    while (out := np.flatnonzero(x >= np.uint64(n))).size:
        x[out] = once(x[out])
    return x.astype(np.int64)


def record_type(vocabulary_size: int) -> str:
    return "<u2" if vocabulary_size <= 65536 else "<u4"


def write_shards(docs: DataFrame, target: str | None = None, tokenizer: str | None = None, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, key: int = KEY) -> DataFrame:
    """Write all shards when evaluated; one row per piece of a document, read back from them.

    Columns: doc_id, start (ids of its document before it), length, slot, offset (in the
    record), shard, ids_crc32 (of the piece's ids as read from the file, little-endian
    unsigned 32-bit), sequences (in all). docs: ``doc_id`` and ``text``. target: a
    folder that executors share, as a URI; by default a new one in the session's.

    A null or empty text is its end id alone; a null ``doc_id`` stays null; repeated rows
    are written each. An empty table writes nothing and gives no rows. Other columns
    are not read.
    """
    spark: SparkSession = docs.sparkSession
    path, target = tokenizer or vocabulary(), target or new_path(spark, "shards")
    staging = new_path(spark, "staged-ids")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    staged = cut(docs.mapInArrow(_stage(path, staging), STAGED), "staged")
    order = staged.repartitionByRange(F.col("doc_id").asc_nulls_first(), "digest").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "digest")
    placed = cut(order.select(F.spark_partition_id().alias("part"), "file", "at", "size", "doc_id", "n").mapInArrow(_prefix_sums, PLACED), "placed")
    first, ids = {}, 0
    for row in sorted(placed.groupBy("part").agg(F.max(F.col("start") + F.col("n"))).collect()):  # two numbers a partition
        first[row[0]] = ids
        ids += row[1]
    sequences = -(-ids // length)
    shards = max(1, -(-sequences // shard_slots))
    parts = min(shards, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    by_file = placed.repartition("file").sortWithinPartitions("file", "at")
    pieces = by_file.mapInArrow(_pieces(staging, first, sequences, length, key), PIECES)
    part = (F.expr(f"slot div {shard_slots}") * parts / shards).cast("int")
    ranges = pieces.repartitionById(parts, part).sortWithinPartitions("slot", "offset")
    return ranges.mapInArrow(_write(path, target, sequences, length, shard_slots), "doc_id long, start long, length long, slot long, offset long, shard long, ids_crc32 long, sequences long")


STAGED = "file string, at long, size int, doc_id long, n long, digest binary"
PLACED = "part int, file string, at long, size int, doc_id long, n long, start long"
PIECES = "slot long, offset int, doc_id long, start long, ids binary"


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])


def _stage(path: str, staging: str):
    """Encode, and write a staging file; its name is the attempt's own, and the rows name it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, end, pack = encoder(path), np.asarray([END_ID], "<u4").tobytes(), zstandard.ZstdCompressor(level=3)
        kind = record_type(known.tokenizer.get_vocab_size())
        fs, base = pyarrow.fs.FileSystem.from_uri(staging)
        fs.create_dir(base, recursive=True)
        name, at, stream = uuid.uuid4().hex, 0, None
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                ids = known.encode(text) + end
                data = pack.compress(np.frombuffer(ids, "<u4").astype(kind).tobytes())
                stream = stream or fs.open_output_stream(f"{base}/{name}")
                stream.write(data)
                rows.append((at, len(data), len(ids) // 4, xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass"))))
                at += len(data)
            starts, sizes, n, digests = zip(*rows) if rows else ([],) * 4
            yield _batch(STAGED, [[name] * len(rows), starts, sizes, batch.column(0), n, digests])
        if stream:
            stream.close()

    return run


def _prefix_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``start``: the ids before each row in its partition."""
    total = 0
    for batch in batches:
        n = batch.column("n").to_numpy()
        start = total + np.cumsum(n) - n
        total += int(n.sum())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(start)], names=[*batch.schema.names, "start"])


def _pieces(staging: str, first: dict[int, int], sequences: int, length: int, key: int):
    """Read staged documents, cut them at the bounds of sequences and give each piece its slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, unpack = zstandard.ZstdCompressor(level=3), zstandard.ZstdDecompressor()
        fs, base = pyarrow.fs.FileSystem.from_uri(staging)
        name, stream = None, None

        def out(rows: list) -> pa.RecordBatch:
            sequence, offsets, docs, starts, data = zip(*rows) if rows else ([],) * 5
            slots = feistel(np.array(sequence, np.int64), sequences, key) if rows else []
            return _batch(PIECES, [slots, offsets, docs, starts, data])

        for batch in batches:
            rows, held = [], 0
            for part, file, at, size, doc_id, n, start in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    if stream:
                        stream.close()
                    name, stream = file, fs.open_input_file(f"{base}/{file}")
                data = unpack.decompress(stream.read_at(size, at))
                place, width = first[part] + start, len(data) // n
                if place // length == (place + n - 1) // length:
                    rows.append((place // length, place % length, doc_id, 0, pack.compress(data)))
                else:
                    cuts = [0, *range(length - place % length, n, length), n]
                    rows += [((place + a) // length, (place + a) % length, doc_id, a, pack.compress(data[a * width : b * width])) for a, b in zip(cuts, cuts[1:])]
                held += size
                if held > 8_000_000:
                    yield out(rows)
                    rows, held = [], 0
            yield out(rows)
        if stream:
            stream.close()

    return run


def _write(path: str, target: str, sequences: int, length: int, shard_slots: int):
    """Write shards from pieces sorted by slot and offset, and read the pieces back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(record_type(encoder(path).tokenizer.get_vocab_size()))
        pad, unpack = np.asarray([PAD_ID], kind).tobytes(), zstandard.ZstdDecompressor()
        fs, base = pyarrow.fs.FileSystem.from_uri(target)
        fs.create_dir(base, recursive=True)
        shard, stream, temporary, told = None, None, "", []
        at = 0  # ids of the shard so far

        def close() -> Iterator[pa.RecordBatch]:
            """Publish the shard and read its pieces back."""
            if shard is None:
                return
            stream.write(pad * (-at % length))
            stream.close()
            name = f"{base}/shard-{shard:06d}.bin"
            fs.move(temporary, name)
            with fs.open_input_stream(name) as f:
                read = 0
                for k in range(0, len(told), 4096):
                    rows = []
                    for place, n, doc_id, start in told[k : k + 4096]:
                        f.read((place - read) * kind.itemsize)
                        read = place + n
                        ids = np.frombuffer(f.read(n * kind.itemsize), kind).astype("<u4")
                        rows.append((doc_id, start, n, shard * shard_slots + place // length, place % length, shard, zlib.crc32(ids.tobytes()), sequences))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "slot", "offset", "shard", "ids_crc32", "sequences"])

        for batch in batches:
            for slot, offset, doc_id, start, data in zip(*(c.to_pylist() for c in batch.columns)):
                if slot // shard_slots != shard:
                    yield from close()
                    shard, told, at = slot // shard_slots, [], 0
                    temporary = f"{base}/.shard-{shard:06d}-{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(temporary)
                place = (slot - shard * shard_slots) * length + offset
                gap = place - at  # only the end of the last sequence, wherever its slot is
                if gap and (offset or not 0 < gap < length):
                    raise RuntimeError(f"ids {at} to {place} of shard {shard} are missing")
                data = unpack.decompress(data)
                stream.write(pad * gap + data)
                told.append((place, len(data) // kind.itemsize, doc_id, start))
                at = place + len(data) // kind.itemsize
        yield from close()

    return run


def read_slots(target: str, start: int, count: int, length: int = LENGTH, shard_slots: int = SHARD_SLOTS, kind: str = "<u2") -> np.ndarray:
    """Records of ``count`` slots from ``start`` on, by seeking: what a resumed run reads."""
    fs, base = pyarrow.fs.FileSystem.from_uri(target)
    size, out = length * np.dtype(kind).itemsize, []
    while count > 0:
        shard, at = divmod(start, shard_slots)
        n = min(count, shard_slots - at)
        with fs.open_input_file(f"{base}/shard-{shard:06d}.bin") as f:
            out.append(np.frombuffer(f.read_at(n * size, at * size), kind).reshape(-1, length))
        start, count = start + n, count - n
    return np.concatenate(out)


def op8_token_shards(spark, sf_dir: str) -> DataFrame:
    return write_shards(table(spark, sf_dir, "documents"))
