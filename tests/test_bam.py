"""A small BAM file and its index, written here, read through the data source."""

import struct
import zlib

import pytest
from synthetic import CONTIG, END, SIZE, START, reads

from repeatloom.sources import bam


def block(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(row, long_cigar=False):
    _, name, flag, contig, pos, mapq, cigar, seq, hp, mm, ml, _ = row
    words = [n << 4 | op for op, n in cigar]
    tags = b"HPC" + bytes([hp]) + b"XAZnote\0" + b"XBBs" + struct.pack("<i2h", 2, -1, 5)
    if mm:
        tags += b"MMZ" + mm.encode() + b"\0" + b"MLBC" + struct.pack("<i", len(ml)) + bytes(ml)
    if long_cigar:
        tags += b"CGBI" + struct.pack("<i", len(words)) + struct.pack(f"<{len(words)}I", *words)
        words = [len(seq) << 4 | 4, sum(n for op, n in cigar if op == 0) << 4 | 3]
    codes = [bam.BASES.index(c) for c in seq] + [0]
    packed = bytes(codes[k] << 4 | codes[k + 1] for k in range(0, len(seq), 2))
    ref = -1 if contig is None else 0
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, mapq, 0, len(words), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + struct.pack(f"<{len(words)}I", *words) + packed + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rows = sorted(reads(), key=lambda r: r[4])
    path = tmp_path_factory.mktemp("bam") / "s.bam"
    text = b"@HD\tVN:1.6\n@RG\tID:a\tSM:SYNTH\n"
    head = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<ii", 1, 5) + CONTIG.encode() + b"\0" + struct.pack("<i", SIZE)
    out, windows, offsets = block(head), {}, []
    for k, row in enumerate(rows):  # a block a record
        offsets.append(len(out) << 16)
        windows.setdefault(row[4] >> 14, len(out) << 16)
        out += block(record(row, long_cigar=k == 3))
    end = len(out) << 16
    out += block(record((0, "lost", 4, None, -1, 0, [], "ACGT", 0, None, None, None)))
    path.write_bytes(out + block(b""))
    n = 1 + max(windows)
    index = b"BAI\1" + struct.pack("<i", 1) + struct.pack("<iIiQQ", 1, 4681, 1, offsets[0], end) + struct.pack("<i", n) + struct.pack(f"<{n}Q", *[windows.get(k, 0) for k in range(n)])
    (path.parent / "s.bam.bai").write_bytes(index)
    return path, rows


def test_reads_come_back(spark, files):
    path, rows = files
    bam.register(spark)
    assert bam.sample_name(str(path)) == "SYNTH" and bam.header(str(path))[1] == [(CONTIG, SIZE)]
    got = spark.read.format("bam").load(str(path)).orderBy("ord").collect()
    assert [r.name for r in got] == [r[1] for r in rows] + ["lost"] and got[-1].contig is None
    for g, r in zip(got, rows):
        assert (g.flag, g.pos, g.mapq, g.seq, g.hp, g.mm) == (r[2], r[4], r[5], r[7], r[8], r[9])
        assert [(c.op, c.len) for c in g.cigar] == r[6] and (g.ml or None) == (r[10] or None)
    some = spark.read.format("bam").load(str(path)).where(f"contig = '{CONTIG}' and pos < {END}").collect()
    assert len(some) == sum(r[4] < END for r in rows) and START > 0


def test_without_index_and_refusals(spark, files, tmp_path):
    path, rows = files
    bam.register(spark)
    lone = tmp_path / "lone.bam"
    lone.write_bytes(path.read_bytes())
    assert spark.read.format("bam").load(str(lone)).count() == len(rows) + 1
    (tmp_path / "x.cram").write_bytes(b"CRAM" + b"\0" * 40)
    with pytest.raises(ValueError, match="CRAM"):
        bam.header(str(tmp_path / "x.cram"))
    with pytest.raises(Exception):
        spark.read.format("bam").load(str(tmp_path / "x.cram")).count()


def test_tags():
    assert bam.haplotype({"HP": ("Z", " 2 ")}) == 2 and bam.haplotype({"HP": ("f", 1.0)}) == 1 and bam.haplotype({"HP": ("Z", "x")}) == 0 and bam.haplotype({}) == 0
    assert bam.tags(b"XAA!" + b"XBi" + struct.pack("<i", -7)) == {"XA": ("A", "!"), "XB": ("i", -7)}
