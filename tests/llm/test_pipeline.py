"""Stages of the corpus pipeline."""

import subprocess
import sys
from pathlib import Path

import numpy as np

import corpus_pipeline as P
from repeatloom.llm import common
from repeatloom.llm import toxicity as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_lines_on_a_fiftieth_of_the_pages_go(spark):
    rows = [(k, f"own {k}" + ("\nAll rights reserved." if k % 50 == 0 else "") + ("\nfour times" if k % 75 == 1 else ""), "en", "a", 0) for k in range(300)]
    got = {x.doc_id: (x.text, x.n_chars) for x in P.drop_lines(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert got[50] == ("own 50", 6) and got[76] == ("own 76\nfour times", 17) and len(got) == 300


def test_one_row_of_each_group_stays(spark):
    long = [" ".join(f"{w}{k}" for k in range(60)) for w in "abcd"]
    rows = [(5, long[0]), (5, long[0]), (3, long[0]), (3, long[1]), (2, long[1]), (7, long[2]), (7, long[2]), (None, long[2]), (None, long[3]), (9, ""), (9, ""), (10, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCS)
    got = sorted(((x.doc_id, x.text) for x in P.keep_one(spark, df, "").collect()), key=str)
    assert got == sorted([(3, long[0]), (2, long[1]), (7, long[2]), (None, long[3]), (9, ""), (10, "")], key=str)


def shuffled(spark):
    """Bytes that all stages so far have written for others."""
    sc, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_texts_that_stay_are_not_shuffled_beyond_a_broadcast(spark, tmp_path):
    r = np.random.default_rng(3)
    texts = [" ".join(r.bytes(6).hex() for _ in range(4000)) for _ in range(200)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate([*texts, texts[0], texts[1] + " end", ""])] + [(5, texts[5], "en", "s", 0)]
    spark.createDataFrame(rows, DOCS).repartition(4).write.parquet(str(tmp_path / "docs"))
    # small tables are not sent to all tasks, as if they were beyond the limit of that
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled(spark)
        got = P.keep_one(spark, spark.read.parquet(str(tmp_path / "docs")), "").select("doc_id", "text", "n_chars").collect()
        moved = shuffled(spark) - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sorted((x.doc_id, x.text) for x in got) == sorted([*enumerate(texts), (202, "")])
    assert [x.n_chars for x in got if x.doc_id == 5] == [0]  # of rows that tie, the one of the least columns
    assert moved < 0.5 * sum(map(len, texts)) / 2, moved  # hexadecimal digits are half a byte each


def test_a_filter_misses_no_key(spark, monkeypatch):
    keys = spark.createDataFrame([(k * k - 50,) for k in range(3000)] + [(None,)], "k long")
    df = spark.createDataFrame([(k, "x") for k in range(-100, 40_000)] + [(None, "y")], "id long, _slot string")
    among = {k * k - 50 for k in range(3000)} | {None}
    for most in (2**30, 2**15):
        monkeypatch.setattr(common, "MOST_FILTER_BITS", most)
        got = {x.id: x.flag for x in common.perhaps_among(df, "id", keys, "flag").collect()}
        assert len(got) == 40_101 and all(got[k] for k in among & set(got))
        assert sum(got.values()) < 40_101 * (0.06 if most > 2**15 else 0.15)
    assert not any(x.flag for x in common.perhaps_among(df, "id", keys.limit(0), "flag").collect())


def test_rejecting_toxic_documents_sends_each_text_once(spark, capsys):
    df = spark.createDataFrame([(k, f"text {k}", "en", "a", 6) for k in range(4)], DOCS)
    model = T.Model({}, np.zeros((0, len(T.FEATURES))), np.zeros(0), np.zeros(0, bool))
    scored = T.score(df, model, keep=tuple(P.DOCUMENT_COLUMNS))
    assert sorted((x.doc_id, x.text, x.score) for x in scored.collect()) == [(k, f"text {k}", 0.0) for k in range(4)]
    scored.explain()
    assert "_text" not in capsys.readouterr().out


def test_a_task_gives_back_what_it_freed():
    code = """
import pyarrow as pa
from repeatloom.llm import common
rss = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096 / 1e6
kept = []
def kernel(batches):
    for batch in batches:
        made = [bytes(1000) for _ in range(150_000)]
        kept.extend(made[::100])  # scattered, so that the allocator alone cannot shrink
        yield batch
batch = pa.RecordBatch.from_pydict({"text": ["x" * 1000] * 2000})
before = rss()
assert sum(b.num_rows for b in common.trimmed(kernel)(iter([batch, batch]))) == 4000
assert rss() - before < 60, rss() - before
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(P.__file__).parent)
