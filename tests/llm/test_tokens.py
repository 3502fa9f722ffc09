"""Chat, packing, shards and neighbour search."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from repeatloom.llm import chat as C
from repeatloom.llm import materialise as M
from repeatloom.llm import neighbours as A
from repeatloom.llm import packing as P
from repeatloom.llm.tokens import encoder, vocabulary

TEXTS = ["It's the 'TEST' don''t  x", "<|endoftext|> a<|b", "ÀÉ ŒœŸÿ ſ ŉ ª²¼ 12.5% — “q” … €5 \xa0x\xady", "Σας ΟΔΟΣ İstanbul 日本 é", "''s 'll'd_x __ a_b \x1f c​d", "", "  \n", "a" * 300, "x y " * 4000]


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary()).encode(text, add_special_tokens=False).ids


def test_cached_ids_equal_the_tokenizers():
    encode = encoder(vocabulary()).encode
    for text in TEXTS + [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}" for c in [*range(32, 0x180), *range(0x2010, 0x2060)]]:
        assert np.frombuffer(encode(text), "<u4").tolist() == reference_ids(text), text


def rows_of(texts):
    return [(k, t) for k, t in enumerate(texts)] + [(None, "null id"), (900, None), (900, None)]


def test_packing(spark):
    r = random.Random(1)
    texts = TEXTS + [" ".join(r.choice(["tension", "of", "reader", "x1"]) for _ in range(r.choice([1, 30, 200, 900, 3000]))) for _ in range(120)]
    rows = rows_of(texts)
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, start int").repartition(3)
    got = [x.asDict() for x in P.pack_documents(df, with_ids=True, chunk_tokens=20_000).collect()]
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for x in got:
        ids = np.frombuffer(bytes(x["ids"]), "<u4")
        assert len(ids) == x["length"] > 0 and zlib.crc32(bytes(x["ids"])) == x["ids_crc32"]
        by_doc[x["doc_id"]].append((x["start"], ids.tolist(), x["doc_tokens"]))
        by_seq[x["sequence_id"]].append(x)
    for i, text in rows:
        if i == 900:
            continue
        pieces = sorted(by_doc[i])
        want = reference_ids(text) + [1]
        assert [p[0] for p in pieces] == np.cumsum([0] + [len(p[1]) for p in pieces])[:-1].tolist()
        assert sum((p[1] for p in pieces), []) == want and pieces[0][2] == len(want)
    assert by_doc[900] == [(0, [1], 1)] * 2
    for pieces in by_seq.values():
        pieces.sort(key=lambda x: x["offset"])
        size = sum(x["length"] for x in pieces)
        assert [x["offset"] for x in pieces] == np.cumsum([0] + [x["length"] for x in pieces])[:-1].tolist()
        assert size <= 2048 and size & (size - 1) == 0 and size == pieces[0]["context"]  # no padding at all
    assert P.pack_documents(df.limit(0)).count() == 0


def test_step_groups_are_balanced():
    packer, loads, over = P.Packer(0, step_tokens=8192), defaultdict(int), 0
    for k in range(400):
        packer.add(k, b"\1\0\0\0" * (50 + 37 * k % 1500))
        if k % 90 == 0 or k == 399:
            for _, step, _, size, _ in packer.pack(k == 399):
                loads[step] += size
    over = loads.pop(None, 0)
    assert len(loads) > 5 and set(loads.values()) == {8192} and over < 8192


def test_step_groups_are_balanced_across_partitions(spark):
    rows = [(k, "x " * (k % 700)) for k in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    windows = P.pack_documents(df).select("sequence_id", "context", "step_group").distinct()
    loads = sorted(r[1] for r in windows.groupBy("step_group").sum("context").collect())
    total = sum(k % 700 + 1 for k in range(900))
    assert loads == [x for x in [total % P.STEP_TOKENS] if x] + [P.STEP_TOKENS] * (total // P.STEP_TOKENS)


CONTROLS = ["</s>", "[INST]", "[/INST]", "<|user|>", "<\\|end|>", "<\\\\|end|>", "[\\INST]", "<s>", "\\", "<|", "plain ü", "<</s>>"]


def test_escape_is_reversible_and_hides_controls():
    r = random.Random(2)
    for _ in range(500):
        text = "".join(r.choice(CONTROLS) for _ in range(r.randint(0, 8)))
        escaped = C.escape(text)
        assert C.unescape(escaped) == text
        assert not any(c in escaped for c in ("</s>", "[INST]", "[/INST]", "<|user|>", "<|end|>", "<s>"))


def test_chat_round_trip(spark):
    r = random.Random(3)
    turns = []
    for conv in range(30):
        for t in range(r.randint(1, 9)):
            turns.append((conv, t, r.choice(["system", "user", "assistant", "critic", None]), r.choice([None, "", "日本 " * 50, *CONTROLS, "assistant\nuser"])))
    turns += [(31, 0, "assistant", "same"), (31, 0, "assistant", "same"), (32, None, "user", "x"), (None, 1, "assistant", "y" * 20_000)]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, ids int").repartition(5)
    assembled = C.assemble(C.format_turns(df))
    got = {x.conv_id: x for x in C.digests(assembled).collect()}
    groups = defaultdict(list)
    for conv, t, role, text in turns:
        key = hashlib.sha256(f"{role}\n{text}".encode()).hexdigest()[:16]
        groups[conv].append((t is not None, t or 0, key, role or "", text or ""))
    assert set(got) == set(groups)
    for conv, rows in groups.items():
        rows.sort()
        whole = "".join(f"{x[3]}\n{x[4]}\n" for x in rows)
        loss = "".join(x[4] for x in rows if x[3] == "assistant")
        x = got[conv]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == (len(rows), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for conv in range(3):  # offsets are prefix sums
        rows = sorted((x for x in assembled.collect() if x.conv_id == conv), key=lambda x: x.offset)
        assert [x.offset for x in rows] == np.cumsum([0] + [len(x.ids) for x in rows])[:-1].tolist()
        assert all(len(x.loss_mask) == len(x.ids) for x in rows)
    assert C.digests(C.assemble(C.format_turns(df.limit(0)))).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_feistel_is_a_permutation(n):
    assert sorted(M.feistel(np.arange(n), n).tolist()) == list(range(n))
    assert n < 64 or M.feistel(np.arange(n), n).tolist() != M.feistel(np.arange(n), n, key=9).tolist()


def test_shards_round_trip(spark, tmp_path):
    rows = rows_of(TEXTS * 3)
    df = spark.createDataFrame([(*x, 1) for x in rows], "doc_id long, text string, slot int").repartition(3)
    target = f"file://{tmp_path}/out"
    got = M.write_shards(df, target=target, length=64, shard_slots=50).collect()
    total = got[0].sequences
    assert {x.slot for x in got} == set(range(total)) and len(list((tmp_path / "out").glob("shard-*.bin"))) == -(-total // 50)
    assert not list((tmp_path / "out").glob(".shard-*"))
    ids = defaultdict(list)
    for x in got:
        record = M.read_slots(target, x.slot, 1, 64, 50)[0]
        part = record[x.offset : x.offset + x.length].astype("<u4")
        assert zlib.crc32(part.tobytes()) == x.ids_crc32
        ids[x.doc_id].append((x.start, part.tolist()))
    for i, text in rows:
        if i is not None and i != 900:
            assert sum((p for _, p in sorted(ids[i])), []) == reference_ids(text) + [1]
    assert M.read_slots(target, 10, total - 10, 64, 50).shape == (total - 10, 64)
    assert M.write_shards(df.limit(0)).count() == 0


def test_training_order_does_not_depend_on_splits(spark, tmp_path):
    rows = rows_of(TEXTS * 3 + [f"document {k} " * (k % 50) for k in range(200)])
    random.Random(3).shuffle(rows)
    made = []
    for n, order in ((3, rows), (7, rows[::-1])):
        df = spark.createDataFrame(order, "doc_id long, text string").repartition(n)
        got = sorted(tuple(x) for x in M.write_shards(df, target=f"file://{tmp_path}/{n}", length=32, shard_slots=40).drop("doc_id").collect())
        made.append((got, {f.name: f.read_bytes() for f in (tmp_path / str(n)).glob("shard-*")}))
    assert made[0] == made[1] and len(made[0][1]) > 3
    stream = [x for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)) for x in reference_ids(t or "") + [1]]
    total = -(-len(stream) // 32)
    order = M.feistel(np.arange(total), total)
    records = M.read_slots(f"file://{tmp_path}/3", 0, total, 32, 40)
    want = np.array(stream + [0] * (total * 32 - len(stream))).reshape(total, 32)
    assert (records[order] == want).all()  # brute force


def brute_nearest(vectors, k=5):
    x = np.array([v for _, v in vectors], float)
    ids = np.array([i for i, _ in vectors])
    n = np.sqrt((x * x).sum(1))
    out = {}
    for q in np.flatnonzero(ids % 50 == 0):
        s = x @ x[q] / (n * n[q])
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]][:k]
        out[ids[q]] = [(ids[j], s[j]) for j in order]
    return out


def test_neighbours(spark):
    r = np.random.default_rng(4)
    centres = r.normal(size=(12, 24))
    vectors = [(k, (centres[k % 12] + 0.3 * r.normal(size=24)).astype(np.float32).tolist()) for k in range(1500)]
    vectors += [(2000 + k, vectors[0][1]) for k in range(40)]  # copies of a query
    bad = [(3000, None), (3050, []), (3100, [0.0] * 24), (3150, [float("nan")] * 24), (3200, [float("inf")] + [1.0] * 23), (None, [1.0] * 24), (3250, [1.0, 2.0]), (3300, [None] + [1.0] * 23)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors + bad + [vectors[7]]], "vec_id long, embedding array<float>, score int")
    got = defaultdict(list)
    for x in A.nearest_neighbours(df, df.where("vec_id % 50 = 0")).collect():
        got[x.query_id].append((x["rank"], x.vec_id, x.score))
    want = brute_nearest(vectors)
    found = 0
    for q, best in want.items():
        rows = sorted(got[q])
        assert [x[0] for x in rows] == [1, 2, 3, 4, 5] and q not in [x[1] for x in rows]
        keys = [(-x[2], x[1]) for x in rows]
        assert keys == sorted(keys)
        found += len({x[1] for x in rows} & {b[0] for b in best})
        lookup = dict(vectors)
        for _, i, s in rows:
            a, b = np.array(lookup[q], float), np.array(lookup[i], float)
            assert abs(s - a @ b / np.sqrt((a @ a) * (b @ b))) < 1e-12
    assert set(got) == set(want) and found / (5 * len(want)) >= 0.9
    assert [x[1] for x in sorted(got[0])] == [2000, 2001, 2002, 2003, 2004]
    assert A.nearest_neighbours(df.limit(0), df).count() == 0


def test_neighbours_in_blocks(spark, monkeypatch):
    """Buckets beyond a block's size, and chunks, change nothing."""
    r = np.random.default_rng(5)
    vectors = [(k, (np.ones(16) + 0.01 * r.normal(size=16)).tolist()) for k in range(300)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    monkeypatch.setattr(A, "BLOCK", 32)
    monkeypatch.setattr(A, "SPLIT", 20)
    monkeypatch.setattr(A, "ASKED", 2)
    monkeypatch.setattr(A, "CHUNK_ROWS", 50)
    monkeypatch.setattr(A, "_PAIRS", 70)
    got = sorted(tuple(x) for x in A.nearest_neighbours(df, df.where("vec_id % 50 = 0")).collect())
    want = sorted((q, k + 1, i, s) for q, best in brute_nearest(vectors).items() for k, (i, s) in enumerate(best))
    assert len(got) == len(want) and sum(g[:3] == w[:3] for g, w in zip(got, want)) >= 0.9 * len(want)


@pytest.mark.parametrize("rows, dimension, block", [(6, 64, 4096), (20, 64, 4096), (300, 256, 32), (40, 64, 8)])
def test_neighbours_of_few_or_long_vectors(spark, monkeypatch, rows, dimension, block):
    """All candidates, where there are few of them or probes would cover too few buckets."""
    r = np.random.default_rng(6)
    vectors = [(50 * k if k < 8 else 50 * k + 1, r.normal(size=dimension).tolist()) for k in range(rows)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    monkeypatch.setattr(A, "BLOCK", block)
    got = sorted((x.query_id, x["rank"], x.vec_id) for x in A.nearest_neighbours(df, df.where("vec_id % 50 = 0"), probes=1 if block == 8 else A.PROBES).collect())
    want = sorted((q, k + 1, i) for q, best in brute_nearest(vectors).items() for k, (i, _) in enumerate(best))
    if block == 8:  # hashed: only those that find too few are compared with all
        assert [x[:2] for x in got] == [x[:2] for x in want]
    else:
        assert got == want


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1e200, 1e200])], "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in A.nearest_neighbours(df, df.where("vec_id = 0")).collect())
    assert [(x[0], x[1], x[2]) for x in got] == [(0, 1, 1), (0, 2, 2)] and got[0][3] == pytest.approx(2**-0.5)


@pytest.mark.parametrize("block", [150, 800])
def test_neighbours_do_not_depend_on_the_tables_size(spark, monkeypatch, block):
    """What a query's own probes led to decides, on either side of the bound: few comparisons are made up for."""
    r = np.random.default_rng(8)
    vectors = [(k, r.normal(size=64).tolist()) for k in range(200)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    monkeypatch.setattr(A, "BLOCK", block)
    got = sorted((x.query_id, x["rank"], x.vec_id) for x in A.nearest_neighbours(df, df.where("vec_id % 50 = 0"), probes=32).collect())
    assert got == sorted((q, k + 1, i) for q, best in brute_nearest(vectors).items() for k, (i, _) in enumerate(best))
