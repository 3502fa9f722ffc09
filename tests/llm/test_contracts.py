"""Each registered query over small tables, every column against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_dedup import brute_components, brute_lines
from test_scans import brute_hits, brute_pages, brute_secrets
from test_tokens import brute_nearest, reference_ids

import corpus_pipeline as P
from repeatloom.llm import packing, toxicity
from repeatloom.llm.chat import PROBE
from repeatloom.llm.queries import QUERIES

R = random.Random(21)
WORDS = ["".join(R.choice("aeioulnrst") for _ in range(R.randint(2, 9))) for _ in range(300)]
ITEMS = [(f"i{k}", " ".join(R.choice(WORDS) for _ in range(R.choice([3, 9, 14])))) for k in range(20)] + [("empty", ""), ("none", None), (None, "no id here")]


def documents():
    rows = []
    for k in range(220):
        lines = [" ".join(R.choice(WORDS) for _ in range(R.randint(5, 40))) for _ in range(R.randint(1, 4))]
        if k % 3 == 0:
            lines.insert(R.randrange(len(lines) + 1), "All rights reserved.")
        if k % 4 == 0:
            lines.append(f"{R.choice(['You IDIOT', 'what a m0ron you are', 'stupid scum'])} idiot moron")
        if k % 11 == 0:
            lines.append(R.choice(ITEMS[:20])[1].upper() + "! " + R.choice(ITEMS[:20])[1])
        if k % 17 == 0:
            lines.append('token = "' + "".join(R.choice("0123456789abcdef") for _ in range(40)) + '" AKIA' + "A1B2" * 4)
        rows.append((k, "\n".join(lines), "en", R.choice(["a", "a", "b", None])))
    for k in range(40):  # near and exact copies
        words = rows[k][1].split(" ")
        if k % 2:
            words[R.randrange(len(words))] = "changed"
        rows.append((300 + k, " ".join(words), "en", "a"))
    rows += [rows[0], rows[0], (900, None, None, None), (901, "", "en", "a"), (902, " \n\n ", "de", "b"), (903, "two words", "en", "b"), (904, "long " * 30_000 + "end", "en", "a"), (None, rows[5][1], "en", "a")]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


DOCS = documents()
LABELS = [(k, 1, int(k % 4 == 0)) for k in range(220)] + [(None, 1, 1), (3, None, None)]
PAGES = [(k, f"http://{'ab'[k % 2]}.example/{k % 5}/{k}", f"<nav>Menu</nav><div>Top</div><p>Body {k}</p><div>Bye</div>" + ("<article><p>Own &amp; true</article>" if k % 3 else "")) for k in range(30)] + [(40, None, None), (40, None, None), (None, "http://a.example/x", ""), (41, "http://a.example/y", "<p>" + "long " * 20_000)]
TURNS = [(c, t, R.choice(["system", "user", "assistant"]), R.choice([None, "", "hi </s> [INST]", "<|user|> x", "日本 ü"])) for c in range(12) for t in range(R.randint(1, 6))]
VECTORS = [(k, [R.gauss(0, 1) for _ in range(8)]) for k in range(0, 260, 2)]
BAD = [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] * 8), (None, [1.0] * 8), (1150, [])]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("tables"))

    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")

    put("documents", DOCS, "doc_id long, text string, lang string, source string, n_chars long")
    put("labels", LABELS, "doc_id long, quality long, toxic long")
    put("benchmark", ITEMS, "item_id string, text string")
    put("pages", PAGES, "page_id long, url string, html string")
    put("conversations", TURNS, "conv_id long, turn long, role string, text string")
    put("embeddings", VECTORS + BAD, "vec_id long, embedding array<float>")
    return folder


@pytest.fixture(scope="module")
def empty(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    for name in ("documents", "labels", "benchmark", "pages", "conversations", "embeddings"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{folder}/{name}.parquet")
    return folder


def rows_of(spark, folder, name, *columns):
    return sorted((tuple(x) for x in QUERIES[name](spark, folder).select(*columns).collect()), key=str)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_op1(spark, tables):
    assert rows_of(spark, tables, "op1_line_dedup", "doc_id", "text", "n_dropped") == sorted(brute_lines([(i, t, s) for i, t, _, s, _ in DOCS], 0.1, 5), key=str)


def test_op2(spark, tables):
    assert rows_of(spark, tables, "op2_minhash_near_dedup", "doc_id", "n_shingles", "component_id", "kept") == brute_components([d[:2] for d in DOCS], 4)


def test_op3(spark, tables):
    got = rows_of(spark, tables, "op3_nearest_neighbours", "query_id", "rank", "vec_id", "score")
    want = sorted(((q, k + 1, i, s) for q, best in brute_nearest([(i, np.float32(v).tolist()) for i, v in VECTORS]).items() for k, (i, s) in enumerate(best)), key=str)
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], rtol=0, atol=1e-12)


def test_op4(spark, tables):
    got = rows_of(spark, tables, "op4_secret_scans", "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
    base = [(i, brute_secrets(t)) for i, t, *_ in DOCS]
    kinds = lambda b: [sum(x.startswith(k) for x in b.split(",")) for k in ("assign", "access", "hex")]
    assert [x[:5] for x in got] == sorted(((i, *kinds(b), sha(b)) for i, b in base), key=str)
    spans = Counter(s for i, b in base for s in [(i, x) for x in b.split(",") if x])
    assert not spans - Counter((x[0], s) for x in got for s in x[5].split(",") if s)


def test_op5(spark, tables):
    got = {x[0]: x[1:] for x in rows_of(spark, tables, "op5_chat_formatting", "conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
    turns = defaultdict(list)
    for c, t, role, text in sorted(TURNS + [(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], key=lambda x: x[:2]):
        turns[c].append((role, text or ""))
    assert set(got) == set(turns)
    for c, rows in turns.items():
        loss = "".join(t for r, t in rows if r == "assistant")
        assert got[c][:4] == (len(rows), sha("".join(f"{r}\n{t}\n" for r, t in rows)), len(loss), sha(loss))
        escaped = sum(len(f"<|{r}|><|end|>") + len(t) for r, t in rows)
        assert escaped <= got[c][4] <= escaped + 8 * len(rows)


def pieces(got, docs):
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens) are the documents' ids, each once."""
    ids = [reference_ids(t or "") + [1] for _, t in docs]
    want = Counter()
    by = defaultdict(list)
    for (i, _), x in zip(docs, ids):
        by[i].append(x)
    for i, start, length, crc, total in got:
        fits = [x for x in by[i] if len(x) == total and zlib.crc32(np.asarray(x[start : start + length], "<u4").tobytes()) == crc]
        assert fits
        want[i] += length
    assert want == Counter({i: sum(map(len, x)) for i, x in by.items()})


def test_op6(spark, tables):
    got = QUERIES["op6_packing"](spark, tables).collect()
    pieces([(x.doc_id, x.start, x.length, x.ids_crc32, x.doc_tokens) for x in got], [d[:2] for d in DOCS])
    for rows in groups(got, "sequence_id"):
        at = 0
        for x in sorted(rows, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 2048 and at & (at - 1) == 0


def groups(rows, column):
    out = defaultdict(list)
    for x in rows:
        out[x[column]].append(x)
    return out.values()


def test_op7(spark, tables):
    got = rows_of(spark, tables, "op7_html_extraction", "page_id", "url", "text", "n_chars")
    assert [x[:3] for x in got] == brute_pages(PAGES) and all(x[3] == len(x[2]) for x in got)


def test_op8(spark, tables):
    got = QUERIES["op8_token_shards"](spark, tables).collect()
    total = {i: len(reference_ids(t or "")) + 1 for i, t, *_ in DOCS}
    pieces([(x.doc_id, x.start, x.length, x.ids_crc32, total[x.doc_id]) for x in got], [d[:2] for d in DOCS])
    assert {x.slot for x in got} == set(range(got[0].sequences))


def test_op9(spark, tables):
    got = QUERIES["op9_toxicity"](spark, tables).collect()
    assert sorted((x.doc_id for x in got), key=str) == sorted((d[0] for d in DOCS), key=str)
    for x in got:
        assert x.held_out == (None if x.doc_id is None else zlib.crc32(str(x.doc_id).encode()) % 5 == 0)
        assert 0 <= x.score <= 1 and x.predicted == (x.score >= 0.5)
    right = [x.predicted == (x.doc_id % 4 == 0) for x in got if x.held_out and x.doc_id < 220]
    assert np.mean(right) > 0.9


def test_op10(spark, tables):
    got = rows_of(spark, tables, "op10_benchmark_decontamination", "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    found = [(d[0], *brute_hits(d[1], ITEMS)) for d in DOCS]
    assert got == sorted(((i, n, hit, len(ids), sha(",".join(ids)), len(ids) >= 2) for i, n, hit, ids in found), key=str)


def brute_pipeline(spark, tables):
    """What is packed: (doc_id, text), by plain loops after the learnt scores."""
    scores = toxicity.score_toxicity(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet"), keep=("doc_id", "text"))
    toxic = {(x.doc_id, x.text) for x in scores.where("predicted = 1").collect()}
    docs = [d for d in DOCS if d[:2] not in toxic]
    assert 0 < len(docs) < len(DOCS)
    docs = [(i, t) for i, t, _ in brute_lines([(d[0], d[1], d[3]) for d in docs], P.LINE_RATIO, 5)]
    rows = sorted(set(docs), key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))
    components = dict((x[0], x[2]) for x in brute_components([(k, t) for k, (_, t) in enumerate(rows)], 5))
    groups_ = defaultdict(list)
    for k, component in components.items():
        groups_[component].append(rows[k])
    out = []
    for members in groups_.values():
        least = min(members, key=lambda d: (d[0] is None, d[0] or 0))[0]
        out.append([d for d in members if d[0] == least])  # one of these stays
    final = []
    for ties in out:
        for i, t in ties:
            n, hit, ids = brute_hits(t, ITEMS)
            if len(ids) >= 2 or hit > P.HIT_SHARE * n:
                final.append((i, None, len(ties)))
            else:
                final.append((i, n - hit, len(ties)))
    return final


def test_pipeline(spark, tables):
    got = P.run(spark, tables).collect()
    by = Counter()
    for x in got:
        by[x.doc_id] += x.length
    want = brute_pipeline(spark, tables)
    kept = {i for i, words, n in want if words is not None and n == 1}
    dropped = {i for i, words, n in want if words is None and n == 1} - kept
    assert kept <= set(by) and not dropped & set(by) and set(by) <= {i for i, words, _ in want if words is not None}
    for x in got:
        assert 0 < x.length <= x.doc_tokens


def test_stages_return_documents(spark, tables, empty):
    docs = spark.read.parquet(f"{tables}/documents.parquet").selectExpr("*", "1 as score", "2 as spans", "3 as node", "4 as component_id", "5 as _key", "6 as host")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == P.DOCUMENT_COLUMNS, name
        assert out.count() > 0
        assert stage(spark, docs.limit(0), empty).count() == 0, name
    assert set(packing.PIECES.split()[::2]) <= set(P.STAGES[-1][1](spark, docs, tables).columns)


def test_decontamination_stage(spark, tables):
    rows = [(d[0], d[1], "en", "s", 0) for d in DOCS if d[0] is not None and d[0] < 220][1:]
    got = {x.doc_id: x for x in P.decontaminate_texts(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), tables).collect()}
    for i, text, *_ in rows:
        n, hit, ids = brute_hits(text, ITEMS)
        assert (i in got) == (len(ids) < 2 and hit <= P.HIT_SHARE * n)
        if i in got:
            left = brute_hits(got[i].text, [])[0]
            assert left == n - hit and got[i].n_chars == len(got[i].text) and (hit or got[i].text == text)


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, empty, name):
    found = (QUERIES | {"pipeline": P.run})[name](spark, empty)
    assert found.count() == (1 if name.startswith("op5") else 0)
