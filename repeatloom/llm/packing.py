"""Hierarchical multi-length packing of documents into context windows.

A document's tokens are its ids and an end id. Whole windows of the longest tier leave
a document directly; the rest is routed to the smallest tier (256, 512, 1024 or 2048
tokens) that holds it. Each tier is packed around its own documents, longest first; a
window's gap is filled by the longest waiting piece that fits, which comes from the
shorter tiers, and only where none fits is a piece cut. What remains at the end of an
input partition goes into windows of falling powers of two, so no window has padding.
Windows are dealt to step groups of exactly ``STEP_TOKENS`` tokens: sizes are powers of two,
so the largest windows of a partition fill whole groups, among which they are dealt to the
least loaded. What a partition has over is filled up with what others have over, from a
table of a few counts a partition; only the very last group may be smaller.

The ids stay in the partition that read the text: packing moves no ids.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, table, trimmed
from .tokens import encoder, vocabulary

TIERS = (2048, 1024, 512, 256)
#: Tokens gathered before a partition's next windows are formed.
CHUNK_TOKENS = 2_000_000
#: Tokens of a step group, a multiple of the longest tier.
STEP_TOKENS = 65_536
END_ID = 1
#: Bits of a sequence's or group's number within its partition, and the first of the groups across partitions.
PART_BITS, ACROSS = 36, 1 << 60

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context long, step_group long"


class Packer:
    """Packs the documents of one partition; holds ``CHUNK_TOKENS`` and a document at most."""

    def __init__(self, first_sequence: int, tiers=TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.waiting: list[list[tuple]] = [[] for _ in range(tiers[0])]  # by length
        self.mask, self.tokens = 0, 0
        self.next_sequence = self.next_step = first_sequence
        self.windows: list[tuple[int, list[tuple]]] = []
        if step_tokens % tiers[0]:
            raise ValueError("a step group must be a multiple of the longest tier")

    def add(self, doc_id, ids: bytes) -> None:
        n, top, start = len(ids) // 4, self.tiers[0], 0
        while n - start >= top:
            self.windows.append((top, [(doc_id, start, top, ids[4 * start : 4 * (start + top)], n)]))
            start += top
        if n > start:
            self._put((doc_id, start, n - start, ids[4 * start :], n))

    def _put(self, piece: tuple) -> None:
        self.waiting[piece[2]].append(piece)
        self.mask |= 1 << piece[2]
        self.tokens += piece[2]

    def _take(self, length: int) -> tuple:
        piece = self.waiting[length].pop()
        if not self.waiting[length]:
            self.mask ^= 1 << length
        self.tokens -= length
        return piece

    def _fill(self, size: int) -> None:
        gap, pieces = size, []
        while gap:
            fits = self.mask & ((1 << (gap + 1)) - 1)
            if fits:
                piece = self._take(fits.bit_length() - 1)
            else:
                longer = self.mask >> (gap + 1)
                doc_id, start, n, ids, total = self._take(gap + (longer & -longer).bit_length())
                self._put((doc_id, start + gap, n - gap, ids[4 * gap :], total))
                piece = (doc_id, start, gap, ids[: 4 * gap], total)
            pieces.append(piece)
            gap -= piece[2]
        self.windows.append((size, pieces))

    def pack(self, last: bool) -> list[tuple[int, int | None, int | None, int, list[tuple]]]:
        """The windows of whole step groups: (sequence, step group, None, size, pieces).

        The others wait; in the end they come as (sequence, None, number among those of
        its size, size, pieces).
        """
        for size in self.tiers:
            least = size // 2 if size > self.tiers[-1] else 0
            while self.tokens >= size and self.mask >> (least + 1):
                self._fill(size)
        size = self.tiers[0]
        while last and self.tokens:
            while size > self.tokens:
                size //= 2
            self._fill(size)
        self.windows.sort(key=lambda w: -w[0])
        ends = np.cumsum([w[0] for w in self.windows])
        steps = int(ends[-1]) // self.step_tokens if len(ends) else 0
        n = int(np.searchsorted(ends, steps * self.step_tokens)) + 1 if steps else 0
        loads = [(0, self.next_step + k) for k in range(steps)]
        out = []
        for size, pieces in self.windows[:n]:
            load, step = heapq.heappop(loads)
            heapq.heappush(loads, (load + size, step))
            out.append((self.next_sequence, step, None, size, pieces))
            self.next_sequence += 1
        self.next_step += steps
        self.windows = self.windows[n:]
        if last:
            seen: dict[int, int] = {}
            for size, pieces in self.windows:
                out.append((self.next_sequence, None, seen.get(size, 0), size, pieces))
                seen[size] = seen.get(size, 0) + 1
                self.next_sequence += 1
            self.windows = []
        return out


def _batch(windows: list, with_ids: bool) -> pa.RecordBatch:
    rows = [(*piece, sequence, step, size, offset, number) for sequence, step, number, size, pieces in windows for piece, offset in zip(pieces, np.cumsum([0] + [p[2] for p in pieces]).tolist())]
    cols = list(zip(*rows)) if rows else [[]] * 10
    long = lambda x: pa.array(x, pa.int64())
    data = {
        "doc_id": long(cols[0]),
        "start": long(cols[1]),
        "length": long(cols[2]),
        "ids_crc32": long([zlib.crc32(x) for x in cols[3]]),
        "doc_tokens": long(cols[4]),
        "sequence_id": long(cols[5]),
        "offset": long(cols[8]),
        "context": long(cols[7]),
        "step_group": long(cols[6]),
        "number": long(cols[9]),
    }
    if with_ids:
        data["ids"] = pa.array(cols[3], pa.binary())
    return pa.RecordBatch.from_pydict(data)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, tiers: tuple[int, ...] = TIERS, with_ids: bool = False, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """One row per piece of a document in a window.

    docs: ``doc_id`` and ``text``, other columns are not read. tokenizer: path of a
    vocabulary file of the tokenizers library. tiers: window sizes, powers of two,
    falling. with_ids adds ``ids``, little-endian unsigned 32-bit.

    A null or empty text is the end id alone; a null ``doc_id`` stays null; repeated
    rows are packed each. An empty table gives no rows. ``context`` is the window's
    size and ``step_group`` the optimiser step that it is dealt to: all steps but one have
    ``STEP_TOKENS`` tokens.
    """
    path = tokenizer or vocabulary()
    end = np.asarray([END_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, encode = Packer(TaskContext.get().partitionId() << PART_BITS, tiers), encoder(path).encode
        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = encode(text.as_py() or "") + end
                packer.add(doc_id.as_py(), ids)
                held += len(ids) // 4
                if held >= chunk_tokens:
                    yield _batch(packer.pack(False), with_ids)
                    held = packer.tokens
        yield _batch(packer.pack(True), with_ids)

    schema = PIECES + ", number long" + (", ids binary" if with_ids else "")
    pieces = cut(docs.select("doc_id", "text").mapInArrow(trimmed(run), schema), "pieces")
    part = F.shiftright("sequence_id", PART_BITS)
    over = pieces.where("step_group is null and offset = 0").groupBy(part.alias("part"), "context").count().collect()  # a few counts a partition
    done = pieces.where("step_group is not null").drop("number")
    if not over:
        return done
    starts, at = [], 0
    for r in sorted(over, key=lambda r: (-r["context"], r["part"])):
        starts.append((r["part"], r["context"], at))
        at += r["context"] * r["count"]
    begins = docs.sparkSession.createDataFrame(starts, "part long, context long, begins long")
    rest = pieces.where("step_group is null").withColumn("part", part).join(begins, ["part", "context"])
    rest = rest.withColumn("step_group", F.expr(f"{ACROSS}L + (begins + number * context) div {STEP_TOKENS}"))
    return done.unionByName(rest.select(done.columns))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
