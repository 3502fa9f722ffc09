"""A made-up locus: a five-base motif on a contig of its own, with reads of two alleles, reads
that enter the tract from the right, and reads split over it."""

import random

MATCH, INSERT, CLIP = 0, 1, 4
CONTIG, SIZE, LOCUS = "ctgA", 5400, "TOY_MOTIF"
MOTIF, COPIES = "CGATT", 9
START = 2600
END = START + len(MOTIF) * COPIES
#: Units of the alleles with the number of their reads, of right partial reads, and of split ones.
SHORT, LONG, TAIL, SPLIT = (14, 12), (37, 7), (52, 4), (61, 2)
BEFORE, AFTER, LEAD = 300, 350, 20

_RANDOM = random.Random(4711)


def _bases(n):
    return "".join(_RANDOM.choice("ACGT") for _ in range(n))


# the bases beside the tract do not continue the motif
REF = _bases(START - 3) + "ACA" + MOTIF * COPIES + "AAG" + _bases(SIZE - END - 3)
BEGIN, REST = REF[START - BEFORE : START], REF[END : END + AFTER]


def record(name, pos, cigar, seq, flag=0, mapq=50, hp=0, mm=None, ml=None):
    return [name, flag, CONTIG, pos, mapq, cigar, seq, hp, mm, ml, None]


def through(name, units, hp, likelihood, reverse):
    """A read over the whole tract; its extra units are inserted ``LEAD`` bases into it."""
    seq = BEGIN + MOTIF * units + REST
    sites = seq.count("G" if reverse else "C")
    cigar = [(MATCH, BEFORE + LEAD), (INSERT, len(MOTIF) * (units - COPIES)), (MATCH, END - START - LEAD + AFTER)]
    return record(name, START - BEFORE, cigar, seq, 16 * reverse, hp=hp, mm="C+m" + ",0" * sites + ";", ml=[likelihood] * sites)


def reads():
    """Rows of the reads schema, numbered in order."""
    rows = [through(f"long-{k}", LONG[0], 2, 3, k % 2 == 1) for k in range(LONG[1])]
    rows += [through(f"short-{k}", SHORT[0], 1, 252, k > 7) for k in range(SHORT[1])]
    for k in range(TAIL[1]):
        inside = MOTIF * TAIL[0]
        rows.append(record(f"tail-{k}", END, [(CLIP, len(inside)), (MATCH, AFTER)], inside + REST))
    for k in range(SPLIT[1]):
        inside = MOTIF * SPLIT[0]
        whole = BEGIN + inside + REST
        rows.append(record(f"split-{k}", START - BEFORE, [(MATCH, BEFORE), (CLIP, len(inside) + AFTER)], whole))
        rows.append(record(f"split-{k}", END, [(CLIP, BEFORE + len(inside)), (MATCH, AFTER)], whole, flag=2048))
    whole = REF[START - BEFORE : END + AFTER]
    rows.append(record("doubtful", START - BEFORE, [(MATCH, len(whole))], whole, mapq=3))
    rows.append(record("second-choice", START - BEFORE, [(MATCH, len(whole))], whole, flag=256))
    rows.append(record("elsewhere", 4000, [(MATCH, 700)], REF[4000:4700]))
    return [(k, *row) for k, row in enumerate(rows)]


def locus(name, gene, contig, strand, unit, start, stop, reference, **more):
    lists = {f"{k}_motif_reference_orientation": more.pop(k, []) for k in ("pathogenic", "benign", "unknown")}
    return {"id": name, "gene": gene, "chrom": contig, "gene_strand": strand, "motif_len": unit, "start_hg38": start, "stop_hg38": stop, "reference_motif_reference_orientation": [reference]} | lists | more


CATALOG = [
    locus(LOCUS, "TOY1", CONTIG, "+", 5, START, END, MOTIF, pathogenic=[MOTIF], disease="none", mechanism="GoF", interruption_reference_orientation=["CGGTT", "CGTT"], inheritance=["AD"], ref_copies=9.0,
          benign_min=4, benign_max=20, intermediate_min=21, intermediate_max=50, pathogenic_min=51, pathogenic_max=400),
    locus("NO_READS", "TOY2", "ctgB", "-", 6, 40, 100, "TTAGGC", pathogenic=["TTAGGG"], pathogenic_min=25),
    locus("NO_MOTIF", "TOY3", "ctgB", "-", 6, 40, 100, "TTAGG"),
]
