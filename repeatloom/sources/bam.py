"""Alignment files as a Spark data source: ``spark.read.format("bam").load(path)``.

A BAM file is BGZF: gzip members of at most 64 kB, addressed by virtual offsets. With a
``.bai`` index the file is cut into partitions at the offsets of its linear index, and
contig and interval filters prune partitions; without one it is one partition. Records
are decoded in the task that reads them. CRAM is refused: convert it to BAM or Parquet.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..schema import READS

# Codes of the format.
BASES = "=ACMGRSVTWYHKDBN"
MAGIC, INDEX_MAGIC, CRAM_MAGIC = b"BAM\1", b"BAI\1", b"CRAM"
_SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_INTS = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
#: Compressed bytes of a partition, about.
SPLIT_BYTES = 32_000_000


class Blocks:
    """Reads decompressed bytes of a BGZF file from a virtual offset on."""

    def __init__(self, path: str, start: int = 0):
        self.file = open(path, "rb")  # noqa: SIM115
        self.block, within = start >> 16, start & 0xFFFF
        self.next, self.data, self.at = self.block, b"", 0
        if self._load():
            self.at = within

    def _load(self) -> bool:
        self.block = self.next
        self.file.seek(self.block)
        head = self.file.read(12)
        if len(head) < 12:
            self.data, self.at = b"", 0
            return False
        extra = self.file.read(struct.unpack("<H", head[10:12])[0])
        size, k = None, 0
        while k + 4 <= len(extra):
            (n,) = struct.unpack("<H", extra[k + 2 : k + 4])
            if extra[k : k + 2] == b"BC":
                size = struct.unpack("<H", extra[k + 4 : k + 6])[0] + 1
            k += 4 + n
        if size is None:
            raise ValueError("not a BGZF block")
        body = self.file.read(size - 12 - len(extra))
        self.data, self.at = zlib.decompress(body[:-8], -15), 0
        self.next = self.block + size
        return True

    @property
    def offset(self) -> int:
        if self.at >= len(self.data):
            return self.next << 16
        return self.block << 16 | self.at

    def read(self, n: int) -> bytes:
        parts = []
        while n:
            if self.at >= len(self.data) and not self._load():
                break
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            n -= len(part)
            parts.append(part)
        return b"".join(parts)


def header(path: str) -> tuple[str, list[tuple[str, int]], int]:
    """Header text, contigs with lengths, and the offset of the first record."""
    with open(path, "rb") as f:
        if f.read(4) == CRAM_MAGIC:
            raise ValueError(f"{path}: CRAM is not decoded here; convert it to BAM or Parquet")
    b = Blocks(path)
    if b.read(4) != MAGIC:
        raise ValueError(f"{path}: not a BAM file")
    text = b.read(struct.unpack("<i", b.read(4))[0]).rstrip(b"\0").decode()
    found = []
    for _ in range(struct.unpack("<i", b.read(4))[0]):
        name = b.read(struct.unpack("<i", b.read(4))[0]).rstrip(b"\0").decode()
        found.append((name, struct.unpack("<i", b.read(4))[0]))
    return text, found, b.offset


def sample_name(path: str) -> str:
    """SM of the first read group, else the file's stem."""
    for line in header(path)[0].split("\n"):
        if line.startswith("@RG"):
            for part in line.split("\t"):
                if part.startswith("SM:"):
                    return part[3:]
    return os.path.basename(path).split(".")[0]


def find_index(path: str) -> str | None:
    return next((p for p in (f"{path}.bai", f"{os.path.splitext(path)[0]}.bai") if os.path.exists(p)), None)


def linear_index(path: str) -> list[tuple[list[int], int, int]]:
    """For each contig: virtual offsets of its 16 kb windows, its first and its last offset."""
    data = open(path, "rb").read()  # noqa: SIM115
    if data[:4] != INDEX_MAGIC:
        raise ValueError(f"{path}: not a BAI index")
    out, at = [], 8
    for _ in range(struct.unpack_from("<i", data, 4)[0]):
        (bins,) = struct.unpack_from("<i", data, at)
        at += 4
        first, last = 1 << 63, 0
        for _ in range(bins):
            number, chunks = struct.unpack_from("<Ii", data, at)
            at += 8
            for k in range(chunks):
                a, b = struct.unpack_from("<QQ", data, at + 16 * k)
                if number != 37450:  # the metadata bin holds no chunks
                    first, last = min(first, a), max(last, b)
            at += 16 * chunks
        (n,) = struct.unpack_from("<i", data, at)
        out.append((list(struct.unpack_from(f"<{n}Q", data, at + 4)), first, last))
        at += 4 + 8 * n
    return out


def tags(data: bytes) -> dict:
    """Tag values: numbers, strings, lists of numbers; with its type, as tag -> (type, value)."""
    out, at = {}, 0
    while at + 3 <= len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in _INTS:
            (value,) = struct.unpack_from(_INTS[kind], data, at)
            at += _SIZES[kind]
        elif kind in "ZH":
            end = data.index(0, at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            value = list(struct.unpack_from(f"<{n}{_INTS[sub][1]}", data, at + 5))
            kind, at = f"B{sub}", at + 5 + n * _SIZES[sub]
        else:
            break
        out.setdefault(name, (kind, value))
    return out


def haplotype(found: dict) -> int:
    """The haplotype tag as an integer, 0 where it is none."""
    try:
        return int(str(found["HP"][1]).strip()) if not isinstance(found["HP"][1], float) else int(found["HP"][1])
    except (KeyError, ValueError):
        return 0


def decode(data: bytes, contigs: list[str], order: int) -> tuple:
    """A record as a row of ``schema.READS``."""
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq = struct.unpack_from("<iiBBHHHi", data)
    at = 32
    name = data[at : at + l_name - 1].decode()
    at += l_name
    cigar = [(x & 15, x >> 4) for x in struct.unpack_from(f"<{n_cigar}I", data, at)]
    at += 4 * n_cigar
    packed = data[at : at + (l_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq] if l_seq else None
    found = tags(data[at + len(packed) + l_seq :])
    if len(cigar) == 2 and cigar[0] == (4, l_seq) and cigar[1][0] == 3 and "CG" in found:
        cigar = [(x & 15, x >> 4) for x in found["CG"][1]]  # a CIGAR too long for its field
    mm = found.get("MM") or found.get("Mm")
    ml = found.get("ML") or found.get("Ml")
    mm_text = mm[1] if mm and mm[0] == "Z" else None
    if ml and ml[0] != "BC":
        mm_text = None  # likelihoods of another type: the tag is refused
    mn = found.get("MN")
    return (order, name, flag, contigs[ref] if ref >= 0 else None, pos, mapq, cigar, seq, haplotype(found), mm_text, ml[1] if ml and ml[0] == "BC" else None, mn[1] if mn else None)


@dataclass
class Part(InputPartition):
    start: int
    end: int | None
    number: int


class Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes
        self.contig: str | None = None
        self.before: int | None = None  # records start before this position

    def pushFilters(self, filters):
        """Contig and upper position filters prune partitions; Spark still applies all filters."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("contig",):
                self.contig = f.value
            elif isinstance(f, (LessThan, LessThanOrEqual)) and f.attribute == ("pos",):
                self.before = f.value + isinstance(f, LessThanOrEqual)
            yield f

    def partitions(self):
        _, contigs, first = header(self.path)
        index = find_index(self.path)
        if index is None:
            return [Part(first, None, 0)]
        names, cuts = [c for c, _ in contigs], []
        for name, (windows, a, b) in zip(names, linear_index(index)):
            if b == 0 or (self.contig is not None and name != self.contig):
                continue
            last = b
            marks = sorted({a, *[w for k, w in enumerate(windows) if w and (self.before is None or k << 14 < self.before)]})
            if self.before is not None:
                later = [w for k, w in enumerate(windows) if w and k << 14 >= self.before and w > marks[-1]]
                last = min([b, *later])
            start = marks[0]
            for m in marks[1:]:
                if (m >> 16) - (start >> 16) >= self.split_bytes:
                    cuts.append((start, m))
                    start = m
            cuts.append((start, last))
        if self.contig is None:
            end = max((c[1] for c in cuts), default=first)
            cuts.append((end, None))  # records without a place
        return [Part(a, b, k) for k, (a, b) in enumerate(cuts)]

    def read(self, partition: Part) -> Iterator[tuple]:
        contigs = [c for c, _ in header(self.path)[1]]
        blocks = Blocks(self.path, partition.start)
        n = partition.number << 40
        while partition.end is None or blocks.offset < partition.end:
            size = blocks.read(4)
            if len(size) < 4:
                return
            yield decode(blocks.read(struct.unpack("<i", size)[0]), contigs, n)
            n += 1


class BamSource(DataSource):
    """Options: path, splitBytes. Paths are local or mounted on all executors."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> StructType:
        header(self.options["path"])  # sniff: refuse what is no BAM
        return READS

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


def register(spark) -> None:
    spark.dataSource.register(BamSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def contigs(spark, path: str):
    return spark.createDataFrame(header(path)[1], "contig string, length long")


