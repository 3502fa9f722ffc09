"""Secret scans: fixed patterns, and automata inferred from the credentials they label.

1. Every whole text is scanned for three kinds of credential. The pass gathers a bounded
   sample of the labelled values, and counts the pairs of characters of all other tokens.
2. A kind's values form a prefix tree whose steps are character classes, or a character
   itself where most values share it. States whose futures agree by a Hoeffding bound are
   merged (ALERGIA), which leaves a probabilistic automaton of the kind's format.
3. A second pass scores every candidate by the logarithm of its likelihood under the best
   automaton over that under the corpus's pairs of characters. A token outside labelled
   spans is added as ``format`` if this exceeds the odds of an ordinary token in the
   corpus and, a character, what nearly all labelled values held out from learning reach.

The fixed spans are never dropped or changed by the method.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held, table

KINDS = ("assign", "access", "hex", "format")
#: Fixed patterns of the three labelled kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
#: Candidates have the least length of a labelled value.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")

#: Labelled values a kind that are learnt from at most, and the longest of them: the
#: sample is the values of smallest hash. Every ``HELD``-th of them sets the threshold.
LEARN_VALUES, LEARN_LONGEST, HELD = 400, 256, 5
#: Confidence of the merge test; a state that fewer values reach is not merged.
ALPHA, MERGE_LEAST = 0.05, 4
#: Share and number of values at a state above which a character is a step of its own.
LITERAL_SHARE, LITERAL_LEAST = 0.5, 8
#: Share of the held-out values that may score below the threshold.
MISSED = 0.01
#: Tokens whose scores a worker holds.
CACHE_TOKENS = 200_000

SPANS = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("score", pa.float64())]))
_SPANS_SQL = "array<struct<kind:int,start:bigint,end:bigint,value:string,score:double>>"

#: Classes of a run of letters and digits, and their sizes.
SIZE = {"digit": 10, "hex": 16, "HEX": 16, "lower": 26, "upper": 26, "lower+digit": 36, "upper+digit": 36, "letter": 52, "alnum": 62}
_PARTS = re.compile(r"[A-Za-z0-9]+|[^A-Za-z0-9]")


def class_of(part: str) -> str:
    """The narrowest class of a run of ASCII letters and digits; any other character is its own class."""
    if not part.isalnum():
        return part
    if part.isdigit():
        return "digit"
    if not part.strip("0123456789abcdef"):
        return "hex"
    if not part.strip("0123456789ABCDEF"):
        return "HEX"
    case = "lower" if part.islower() else "upper" if part.isupper() else ""
    if part.isalpha():
        return case or "letter"
    return f"{case}+digit" if case else "alnum"


def shape(token: str) -> list[tuple[str, str]]:
    """(class, character) of each character; the class is that of its run."""
    return [(name, c) for part in _PARTS.findall(token) for name in (class_of(part),) for c in part]


def scan_text(text: str) -> list[tuple]:
    """Labelled spans (kind, start, end, value) of a text by start."""
    spans = [(0, *m.span(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    spans += [(1, *m.span(), m.group()) for m in ACCESS.finditer(text) if len(m.group()) >= ACCESS_LEAST]
    spans += [(2, *m.span(), m.group()) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], s[0]))


def candidates(text: str, spans: list[tuple]) -> Iterator[tuple[int, int, str]]:
    """Tokens (start, end, value) that no labelled span overlaps; both are walked in order once."""
    walls: list[list[int]] = []
    for _, start, end, *_ in spans:
        if walls and start < walls[-1][1]:
            walls[-1][1] = max(walls[-1][1], end)
        else:
            walls.append([start, end])
    k = 0
    for m in CANDIDATE.finditer(text):
        while k < len(walls) and walls[k][1] <= m.start():
            k += 1
        if k == len(walls) or m.end() <= walls[k][0]:
            yield m.start(), m.end(), m.group()


class Automaton:
    """Probabilistic automaton merged from a prefix tree of strings."""

    def __init__(self, words: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = []
        self.count: list[dict[str, int]] = []
        self.ends: list[int] = []
        self.total: list[int] = []
        self._grow([shape(w) for w in words])
        self._bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _grow(self, words: list[list[tuple[str, str]]]) -> None:
        """The prefix tree. A step is a class, or "=" and a character that is common at its state."""
        todo = [(None, "", words, 0)]
        for parent, step, here, depth in todo:  # grows while it is walked
            state = len(self.next)
            if parent is not None:
                self.next[parent][step] = state
            on = [w for w in here if len(w) > depth]
            common = {c for c, n in Counter(w[depth][1] for w in on).items() if n >= max(LITERAL_LEAST, LITERAL_SHARE * len(here))}
            steps: dict[str, list] = defaultdict(list)
            for w in on:
                name, c = w[depth]
                steps["=" + c if c in common or name == c else name].append(w)
            self.next.append({})
            self.count.append(defaultdict(int, {x: len(ws) for x, ws in steps.items()}))
            self.ends.append(len(here) - len(on))
            self.total.append(len(here))
            todo += [(state, x, ws, depth + 1) for x, ws in sorted(steps.items())]

    def _differ(self, f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self._bound * (n1**-0.5 + n2**-0.5)

    def _compatible(self, a: int, b: int) -> bool:
        stack, seen = [(a, b)], set()
        while stack:
            a, b = stack.pop()
            if (a, b) in seen or a == b:
                continue
            seen.add((a, b))
            if self._differ(self.ends[a], self.total[a], self.ends[b], self.total[b]):
                return False
            for c in {*self.next[a], *self.next[b]}:
                if self._differ(self.count[a][c], self.total[a], self.count[b][c], self.total[b]):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    stack.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to the state ``a``."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.ends[a] += self.ends[b]
            self.total[a] += self.total[b]
            for c, n in self.count[b].items():
                self.count[a][c] += n
            for c, child in self.next[b].items():
                if c in self.next[a]:
                    stack.append((self.next[a][c], child))
                else:
                    self.next[a][c] = child

    def _merge_all(self) -> None:
        kept = [0]
        border = deque((0, c) for c in sorted(self.next[0]))
        while border:
            parent, c = border.popleft()
            state = self.next[parent][c]
            if state in kept:
                continue
            for other in kept if self.total[state] >= MERGE_LEAST else ():
                if self.total[other] >= MERGE_LEAST and self._compatible(other, state):
                    self.next[parent][c] = other
                    before = {x: set(self.next[x]) for x in kept}
                    self._fold(other, state)
                    border.extend((x, d) for x in kept for d in sorted(set(self.next[x]) - before[x]))
                    break
            else:
                kept.append(state)
                border.extend((state, d) for d in sorted(self.next[state]))
        self.states = kept

    def score(self, word: list[tuple[str, str]], least: float = -math.inf) -> float:
        """Natural logarithm of the likelihood of a shaped word; unseen steps cost a small share.

        A likelihood below ``least`` need not be walked to its end: it only falls.
        """
        at, total = 0, 0.0
        for name, c in word:
            step, size = "=" + c, 1
            if name != c and step not in self.next[at]:
                step, size = name, SIZE[name]
            total += math.log((self.count[at].get(step, 0) + 0.01) / (self.total[at] + 1) / size)
            if total < least:
                return -math.inf
            at = self.next[at].get(step, at)
        return total + math.log((self.ends[at] + 0.01) / (self.total[at] + 1))


def pair_counts(tokens: list[str]) -> np.ndarray:
    """Counts of successive characters, [before, after]; 0 stands for a token's ends."""
    data = np.frombuffer(("\0" + "\0".join(tokens) + "\0").encode(), np.uint8) if tokens else np.zeros(1, np.uint8)
    return np.bincount(data[:-1].astype(np.int64) * 128 + data[1:], minlength=128 * 128)


class Formats:
    """Scores tokens by format: an automaton a kind against the corpus's pairs of characters."""

    def __init__(self, labelled: list[tuple[int, str]], pairs: np.ndarray, n_labelled: int):
        by: dict[int, list[str]] = defaultdict(list)
        held_out: list[str] = []
        for kind, value in sorted(labelled):
            if xxhash.xxh64_intdigest(value.encode()) % HELD:
                by[kind].append(value)
            else:
                held_out.append(value)
        self.automata = [Automaton(words) for _, words in sorted(by.items())]
        n = pairs.reshape(128, 128).astype(float)
        # 67 characters, each seen half a time more
        self.pairs = np.log((n + 0.5) / (n.sum(1, keepdims=True) + 0.5 * 67)).tolist()
        self.odds = math.log((n[0].sum() + 1) / (n_labelled + 1))
        reached = sorted(self.ratio(v) / len(v) for v in held_out) if self.automata else []
        self.least = reached[int(MISSED * len(reached))] if reached else 0.0

    def ratio(self, token: str, least: float = -math.inf) -> float:
        """Logarithm of the likelihood as a credential over that as an ordinary token; below
        ``least`` minus infinity may stand for it."""
        word = shape(token)
        data = b"\0" + token.encode() + b"\0"
        ordinary = sum([self.pairs[a][b] for a, b in zip(data, data[1:])])
        return max([a.score(word, least + ordinary) for a in self.automata]) - ordinary

    def is_credential(self, token: str, ratio: float) -> bool:
        return ratio > self.odds and ratio >= self.least * len(token)


class _Scores(dict):
    """Ratios by token where they are not negative, up to a bound."""

    def __init__(self, formats: Formats):
        super().__init__()
        self.formats = formats

    def __missing__(self, token: str) -> float:
        if len(self) >= CACHE_TOKENS:
            self.clear()
        found = self[token] = self.formats.ratio(token, 0.0)
        return found


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, value, pair, n): labelled values with their number, and once a task the pairs of other tokens."""
    pairs = np.zeros(128 * 128, np.int64)

    def out(kinds, values, pair, n) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.int32()), "value": pa.array(values, pa.string()), "pair": pa.array(pair, pa.int32()), "n": pa.array(n, pa.int64())})

    for batch in batches:
        labelled: Counter = Counter()
        for text in batch.column(0):
            text = text.as_py() or ""
            spans = scan_text(text)
            labelled.update((s[0], s[3]) for s in spans)
            tokens = [t[2] for t in candidates(text, spans)] if spans else CANDIDATE.findall(text)
            if tokens:
                pairs += pair_counts(tokens)
        yield out([k for k, _ in labelled], [v for _, v in labelled], [None] * len(labelled), list(labelled.values()))
    seen = np.flatnonzero(pairs)
    yield out([None] * len(seen), [None] * len(seen), seen, pairs[seen])


def _scorer(labelled: list[tuple[int, str]], pairs: np.ndarray, n_labelled: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = "formats", xxhash.xxh3_128_hexdigest(repr((labelled, n_labelled)).encode() + pairs.tobytes())
        scores = held(key, lambda: _Scores(Formats(labelled, pairs, n_labelled)))
        formats, row = scores.formats, lambda s: dict(zip(("kind", "start", "end", "value", "score"), s))
        score = formats.ratio if formats.automata else (lambda v: None)
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                found = scan_text(text)
                base.append([row((*s, score(s[3]))) for s in found])
                more = []
                if formats.automata:
                    for start, end, value in candidates(text, found):
                        r = scores[value]
                        if r > 0 and formats.is_credential(value, r):
                            more.append(row((3, start, end, value, r)))
                spans.append(sorted(base[-1] + more, key=lambda s: (s["start"], s["kind"])) if more else base[-1])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "base": pa.array(base, SPANS), "spans": pa.array(spans, SPANS)})

    return run


def learn(docs: DataFrame, learn_values: int = LEARN_VALUES) -> tuple[list[tuple[int, str]], np.ndarray, int]:
    """(labelled sample, pair counts, labelled values in all) of the texts of ``docs``."""
    seen = cut(docs.select("text").mapInArrow(_learn, "kind int, value string, pair int, n long"), "labelled")
    values = seen.where(f"kind is not null and length(value) <= {LEARN_LONGEST}").select("kind", "value").distinct()
    labelled = [(r["kind"], r["value"]) for k in range(3) for r in values.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(learn_values).collect()]
    pairs = np.zeros(128 * 128, np.int64)
    for r in seen.where("pair is not null").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # at most 128 * 128
        pairs[r["pair"]] = r["n"]
    return labelled, pairs, seen.where("kind is not null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def find_secrets(docs: DataFrame, learn_values: int = LEARN_VALUES) -> DataFrame:
    """(doc_id, base, spans): labelled spans, and all spans, each (kind, start, end, value, score).

    kind is an index of ``KINDS``; offsets are code points, the end excluded; score is the
    logarithm of the likelihood ratio of the value's format (null where nothing is
    learnt). docs: ``doc_id`` and ``text``; other columns are not read. A null text is
    empty; empty texts have no spans; repeated rows are scanned each, in order and in
    time linear in the text. Without labelled values (an empty table, or none found)
    nothing is added. Automata are learnt from at most ``learn_values`` distinct values a
    kind; pairs of characters and odds are counted over all texts.
    """
    return docs.select("doc_id", "text").mapInArrow(_scorer(*learn(docs, learn_values)), f"doc_id long, base {_SPANS_SQL}, spans {_SPANS_SQL}")


def _joined(column: str):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.col(column), lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])))


def op4_secret_scans(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(_joined("base").cast("binary"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def base_digest(spans: list[tuple]) -> str:
    """The digest of labelled spans, for comparison."""
    return hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b, *_ in spans).encode()).hexdigest()
