"""Toxicity: gradient-boosted trees over dense features, calibrated isotonically.

The lexicon is a short fixed list joined by words and stems that labelled toxic texts
hold more often than others; it is learnt on one part of a bounded sample of labelled
rows, the trees on a second and the calibration on a third, so none flatters another.
Only the text enters a score. Whole texts are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held, table, trimmed

#: Labelled rows that are learnt from at most, those of smallest hash of their ids.
LEARN_ROWS = 12_000
#: Lexicon entries that are learnt at most, and in how many toxic texts each must be.
LEXICON, LEAST_TEXTS, LEAST_WEIGHT = 4000, 3, 1.5
FOLDS = 5
#: Tokens whose properties a worker holds.
CACHE_TOKENS = 150_000
#: Longer tokens are not held.
CACHE_LENGTH = 64

#: Common insults and words of the second person.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown fool imbecile jerk pig vermin filth".split()
YOU = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tuyo vosotros".split()
_PLAIN = str.maketrans("0134578@$!|+", "oieastbasiit")
#: Possessive, and tried only where a run begins, so that a long run inside a token is read once.
_EDGE = re.compile(r"^[^\w@$]++|(?<![^\w@$!])[^\w@$!]++$")
_RUN = re.compile(r"(.)\1\1", re.S)
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
NEAR = 5

FEATURES = ("fixed", "fixed_rate", "learnt", "learnt_rate", "strongest", "distinct", "hidden", "near_you", "you_rate", "capitals", "shouted", "exclaims", "questions", "stops", "mixed", "runs", "words")


def word_keys(word: str) -> list[str]:
    """A word and its stems, as lexicon keys."""
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


class Tokens(dict):
    """What a token says, by token: packed so that a text becomes one array."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.fixed, self.you = lexicon, set(INSULTS), set(YOU)

    def __missing__(self, token: str) -> int:
        if len(self) > CACHE_TOKENS:
            self.clear()
        core = _EDGE.sub("", token)
        word = core.rstrip("!").lower()
        plain = word.translate(_PLAIN)
        for joint in ".-_*":
            plain = plain.replace(joint, "")
        fixed = word in self.fixed or plain in self.fixed
        weight = max([0.0, *(self.lexicon.get(k, 0.0) for k in word_keys(word))])
        hidden = plain != word and (plain in self.fixed or any(k in self.lexicon for k in word_keys(plain)[:1]))
        mixed = bool(core) and not core.isalpha() and any(map(str.isalpha, core)) and any(c.isdigit() or c in "@$*" for c in core)
        flags = fixed | hidden << 1 | (word in self.you) << 2 | (len(word) > 2 and core.isupper()) << 3 | mixed << 4
        found = flags | int(min(weight, 12) * 1000) << 8
        if len(token) <= CACHE_LENGTH:
            self[token] = found
        return found


def features(text: str, tokens: Tokens) -> list[float]:
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    x = np.fromiter(map(tokens.__getitem__, words), np.int64, len(words))
    weight = x >> 8
    hit = (weight > 0) | (x & 3 > 0)
    at, near = np.flatnonzero(hit), 0
    you = np.flatnonzero(x & 4)
    if len(at) and len(you):
        k = np.searchsorted(you, at)
        gap = np.minimum(np.abs(you[np.minimum(k, len(you) - 1)] - at), np.abs(you[np.maximum(k - 1, 0)] - at))
        near = int((gap <= NEAR).sum())
    fixed, learnt = int((x & 1).sum()), float(weight.sum()) / 1000
    return [
        fixed, fixed / n, learnt, learnt / n, float(weight.max(initial=0)) / 1000, len({words[k] for k in at.tolist()}), int((x & 2 > 0).sum()), near, len(you) / n,
        len(_UPPER.findall(text)) / chars, int((x & 8 > 0).sum()) / n, text.count("!") / chars, text.count("?") / chars, (text.count(".") + text.count(",")) / chars,
        int((x & 16 > 0).sum()) / n, len(_RUN.findall(text)) / chars, float(np.log(n)),
    ]


class Trees:
    """Boosted regression trees on binned features, logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: int = 8):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        b = self._bins(x)
        mean = (y.sum() + 0.5) / (len(y) + 1)
        self.base, self.rate = float(np.log(mean / (1 - mean))), rate
        self.trees: list[list[tuple]] = []
        margin = np.full(len(y), self.base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            tree: list[tuple] = []
            out = np.zeros(len(y))
            self._grow(tree, b, y - p, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), depth, least, out)
            self.trees.append(tree)
            margin += rate * out

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1) if len(x) else np.zeros(x.shape, int)

    def _grow(self, tree, b, g, h, rows, depth, least, out) -> int:
        at = len(tree)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        value = float(np.clip(total_g / (total_h + 1), -4, 4))
        tree.append((-1, 0, value, 0, 0))
        best = (1e-6, -1, 0)
        if depth and len(rows) >= 2 * least:
            for f in range(b.shape[1]):
                n = len(self.edges[f]) + 1
                sg, sh, c = (np.bincount(b[rows, f], w, n)[:-1].cumsum() for w in (g[rows], h[rows], None))
                gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
                gain[(c < least) | (len(rows) - c < least)] = 0
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), f, int(gain.argmax()))
        if best[1] < 0:
            out[rows] = value
            return at
        left = b[rows, best[1]] <= best[2]
        a = self._grow(tree, b, g, h, rows[left], depth - 1, least, out)
        c = self._grow(tree, b, g, h, rows[~left], depth - 1, least, out)
        tree[at] = (best[1], best[2], value, a, c)
        return at

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self._bins(x), np.full(len(x), self.base)
        for tree in self.trees:
            feature, cut_, value, left, right = (np.array(c) for c in zip(*tree))
            node = np.zeros(len(x), int)
            for _ in range(8):
                f = feature[node]
                if (f < 0).all():
                    break
                down = np.where(b[np.arange(len(x)), np.maximum(f, 0)] <= cut_[node], left[node], right[node])
                node = np.where(f < 0, node, down)
            out += self.rate * value[node]
        return out


def isotonic(margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the calibration: pooled adjacent violators, each pool shrunk by one row of
    the mean, flat inside a pool and linear between pools. Equal margins are one pool."""
    pools: list[list[float]] = []  # sum, rows, least margin, greatest
    at, inverse = np.unique(margin, return_inverse=True)
    for m, v, n in zip(at, np.bincount(inverse, y, len(at)), np.bincount(inverse, minlength=len(at))):
        pools.append([v, n, m, m])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    mean = float(y.mean()) if len(y) else 0.0
    x = [v for p in pools for v in p[2:]]
    p = [(q[0] + mean) / (q[1] + 1) for q in pools for _ in (0, 1)]
    return np.array(x), np.maximum.accumulate(np.array(p)) if p else np.array([])


class Model:
    """Lexicon, trees and calibration; without labels of both kinds, the labels' share."""

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, calibrate: np.ndarray):
        self.lexicon, self.share = lexicon, float(y.sum()) / (len(y) + 1)
        fit = ~calibrate
        self.trees = None
        if 0 < y[fit].sum() < fit.sum():
            self.trees = Trees(x[fit], y[fit])
            both = 0 < y[calibrate].sum() < calibrate.sum()
            use = calibrate if both else fit
            self.knots = isotonic(self.trees.margin(x[use]), y[use])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.share)
        m = self.trees.margin(x)
        # the margin breaks ties inside a pool without moving it across 0.5 by more than 1e-4
        return np.clip(np.interp(m, *self.knots) + 1e-4 * (1 / (1 + np.exp(-m)) - 0.5), 0, 1)


def _keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic, keys = [], []
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            words = {_EDGE.sub("", w).lower() for w in (text.as_py() or "").split()}
            found = {k for w in words if w.isalpha() for k in word_keys(w)}
            keys += found
            toxic += [label] * len(found)
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.string()), "toxic": pa.array(toxic, pa.int64())})


def _tokens(lexicon: dict[str, float]) -> Tokens:
    return held(("tokens", hash(tuple(sorted(lexicon.items())))), lambda: Tokens(lexicon))


def _measure(lexicon: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(lexicon)
        for batch in batches:
            x = [features(text.as_py() or "", tokens) for text in batch.column(0)]
            yield pa.RecordBatch.from_pydict({"toxic": batch.column(1), "part": batch.column(2), "x": pa.array(x, pa.list_(pa.float64()))})

    return run


def fit(docs: DataFrame, labels: DataFrame, learn_rows: int = LEARN_ROWS) -> Model:
    """Learn from at most ``learn_rows`` labelled rows outside the held-out fold.

    labels: ``doc_id``, ``toxic``. Rows with nulls are left out; of repeated labels any
    counts; documents of an id that occurs twice each count.
    """
    name = F.col("doc_id").cast("string")
    known = labels.where("doc_id is not null and toxic is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("long").alias("toxic"))
    known = known.where(F.crc32(name) % FOLDS != 0).orderBy(F.xxhash64("doc_id", F.lit(11)), "toxic").limit(learn_rows)  # a bounded table
    part = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(10)).cast("long")
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic", part.alias("part"))
    rows = cut(rows, "labelled")
    n = {r["toxic"]: r["count"] for r in rows.where("part < 5").groupBy("toxic").count().collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    counts = rows.where("part < 5").select("text", "toxic").mapInArrow(trimmed(_keys_of), "key string, toxic long").groupBy("key").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") >= LEAST_TEXTS)
    weight = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1)) - F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    found = counts.select("key", weight.alias("w")).where(F.col("w") >= LEAST_WEIGHT).orderBy(F.desc("w"), "key").limit(LEXICON).collect() if n0 and n1 else []
    lexicon = {r["key"]: round(r["w"], 6) for r in found}
    measured = rows.where("part >= 5").mapInArrow(trimmed(_measure(lexicon)), "toxic long, part long, x array<double>").collect()  # at most learn_rows short rows
    measured.sort(key=lambda r: (r["part"], r["toxic"], r["x"]))
    x = np.array([r["x"] for r in measured], float).reshape(len(measured), len(FEATURES))
    return Model(lexicon, x, np.array([r["toxic"] for r in measured], float), np.array([r["part"] >= 8 for r in measured], bool))


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns of each row with ``score`` and ``predicted``.

    A null text is empty, and empty ones are scored; repeated rows are scored each; equal
    texts have equal scores; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by LEXICON and the trees
    text = "text" if "text" in keep else "_text"  # one copy travels
    schema = docs.select(*keep).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        tokens = _tokens(known.lexicon)
        for batch in batches:
            x = np.array([features(t.as_py() or "", tokens) for t in batch.column(text)], float).reshape(batch.num_rows, len(FEATURES))
            s = known.score(x)
            columns = {c: batch.column(c) for c in keep}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(s), "predicted": pa.array((s >= 0.5).astype(np.int32))})

    sent_once = docs.select(*keep) if text == "text" else docs.select(*keep, F.col("text").alias(text))
    return sent_once.mapInArrow(trimmed(run), schema)


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), learn_rows: int = LEARN_ROWS) -> DataFrame:
    """Learn from the labelled rows and score every row of ``docs``.

    Empty and null texts are scored as texts without words; rows repeat as they came; an
    empty table gives no rows; without labels of both kinds every score is the labels'
    share. Columns but ``keep``, ``doc_id`` and ``text`` are not read.
    """
    return score(docs, fit(docs, labels, learn_rows), keep)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0).alias("held_out"), "score", "predicted")
