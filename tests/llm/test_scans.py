"""Decontamination, secrets, HTML and toxicity."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from repeatloom.llm import decontaminate as D
from repeatloom.llm import html_text as H
from repeatloom.llm import secrets as S
from repeatloom.llm import toxicity as T


def brute_hits(text, items, n=8):
    pat = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    words = pat.findall(low(text or ""))
    hit, ids = set(), set()
    for i, t in items:
        w = pat.findall(low(t or ""))
        for k in range(max(1, len(w) - n + 1)) if w and i is not None else ():
            win = w[k : k + n]
            for a in range(len(words) - len(win) + 1):
                if words[a : a + len(win)] == win:
                    hit |= set(range(a, a + len(win)))
                    ids.add(str(i))
    return len(words), len(hit), sorted(ids)


@pytest.mark.parametrize("slice_bytes", [10**9, 200])
def test_decontamination(spark, slice_bytes):
    r = random.Random(2)
    vocabulary = [f"{a}{b}é" for a in "abc" for b in "xyz"] + ["Zu", "7"]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(3, 30)))) for k in range(25)] + [(90, ""), (91, None), (None, "zu zu"), (92, "???")]
    docs = []
    for k in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        for _ in range(r.randint(0, 2)):
            words[r.randint(0, len(words)) :][:0] = []
            at = r.randint(0, len(words))
            words[at:at] = re.findall(r"\S+", r.choice(items[:25])[1])
        docs.append((k, ", ".join(words).upper() if k % 3 == 0 else "-".join(words)))
    docs += [(100, None), (100, None), (101, ""), (None, items[3][1])]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, items int")
    got = D.find_contamination(df, spark.createDataFrame(items, "item_id long, text string"), keep=("doc_id", "text"), slice_bytes=slice_bytes).collect()
    key = lambda x: str(x)
    assert sorted(((x.doc_id, x.text, x.n_words, x.n_hit, x["items"]) for x in got), key=key) == sorted(((i, t, *brute_hits(t, items)) for i, t in docs), key=key)
    for x in got:
        inside = "".join(x.text[s.start : s.end] + " " for s in x.spans) if x.text else ""
        assert len(D.words_of(inside)) == x.n_hit
    assert D.find_contamination(df, spark.createDataFrame([], "item_id long, text string")).agg({"n_hit": "sum"}).first()[0] == 0
    assert D.find_contamination(df.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontamination_beyond_one_character_a_word(monkeypatch):
    monkeypatch.setattr(D, "SYMBOLS", 4)
    r = random.Random(12)
    vocabulary = [f"w{k}" for k in range(14)]
    items = [(str(k), " ".join(r.choice(vocabulary) for _ in range(r.randint(1, 12)))) for k in range(40)]
    a = D.Automaton(items, 3)
    assert a.codes.width == 2 and len(set(a.codes.values())) == len(a.codes)
    for _ in range(200):
        text = " ".join(r.choice([*vocabulary, "other"]) for _ in range(r.randint(0, 40)))
        hits, ids = a.scan(D.words_of(text))
        n, hit, want = brute_hits(text, items, 3)
        assert (sum(y - x for x, y in hits), sorted(ids)) == (hit, want)


def test_cut_passages(spark):
    item = "one two three four five six seven eight nine"
    rows = [(1, f"Ünd before, {item.upper()}! after"), (2, "clean text"), (3, item), (4, None)]
    found = D.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"), keep=("doc_id", "text"))
    assert {x.doc_id: x.text for x in D.cut_passages(found).collect()} == {1: "Ünd before, ! after", 2: "clean text", 3: "", 4: None}


def brute_secrets(text):
    out = []
    for kind, pattern, ok in (
        ("assign", r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[1]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    ):
        out += [(m.start(), ["assign", "access", "hex"].index(kind), kind, m.end()) for m in re.finditer(pattern, text or "") if ok(m)]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(out))


def secret(r, kind):
    hexa = "".join(r.choice("0123456789abcdef") for _ in range(40))
    return {"assign": f"password={hexa[:18]}", "token": f'Token = "{hexa}', "access": "AKIA" + "".join(r.choice("ABCDEFGHIJ0123456789") for _ in range(16)), "hex": hexa}[kind]


def test_secrets(spark):
    r = random.Random(3)
    prose = [" ".join(r.choice(["the", "internationalisation", "of", "thoroughly", "règlement", "straightforwardness"]) for _ in range(60)) for _ in range(150)]
    rows = [(k, f"ü {p} {secret(r, r.choice(['assign', 'token', 'access', 'hex']))} {p}") for k, p in enumerate(prose)]
    bare = "".join(r.choice("0123456789abcdef") for _ in range(28))
    rows += [(900, None), (901, ""), (901, ""), (902, "token: secret: abcdefghij"), (903, "password=short"), (904, "AKIA12"), (905, "see " + bare + " there"), (906, "x" * 200_000 + " apiKEY:'" + "Z9" * 10), (None, "a" * 31)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as base", "2 as tokens")
    found = {(x.doc_id): x for x in S.find_secrets(df).select("doc_id", S._joined("base").alias("base"), S._joined("spans").alias("spans")).collect()}
    for i, text in rows:
        assert found[i].base == brute_secrets(text), text
        assert set(filter(None, found[i].base.split(","))) <= set(found[i].spans.split(","))
    assert found[905].spans == f"format:4:{4 + len(bare)}"  # a credential's format without its context
    assert sum("format" in found[k].spans for k in range(150)) == 0
    assert {s.score > 0 for x in S.find_secrets(df).collect() for s in x.base if len(s.value) > 17} == {True}
    assert S.find_secrets(df.limit(0)).count() == 0
    assert S.base_digest([]) == hashlib.sha256(b"").hexdigest()


def test_automaton_learns_a_format():
    r = random.Random(4)
    word = lambda n: "key-" + "".join(r.choice("0123456789abcdef") for _ in range(n))
    a = S.Automaton([word(r.randint(8, 12)) for _ in range(300)])
    assert 12 <= len(a.states) <= 40  # four literal steps, and the lengths told apart
    score = lambda w: a.score(S.shape(w))
    assert score(word(10)) > score("internationally") + 5 and score(word(10)) > score(word(10)[1:]) + 5
    assert score(word(12)) > score(word(13)) + 5 and score(word(8)) > score(word(7)) + 3
    total = sum(np.exp(score("key-" + "a" * n)) * 16**n for n in range(0, 14))
    assert 0.9 < total < 1.01  # probabilities of all words of the format sum to one


def test_automaton_merges_what_agrees():
    r = random.Random(5)
    a = S.Automaton(["x" * (4 + int(r.expovariate(0.2))) for _ in range(400)])  # any length goes on alike
    assert len(a.states) < 12
    tree = S.Automaton(["x" * (4 + int(r.expovariate(0.2))) for _ in range(400)], alpha=1.9999)
    assert len(tree.states) > len(a.states)


def test_held_out_credentials_without_context():
    r = random.Random(6)
    made = [secret(r, "hex") for _ in range(300)] + ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)) for _ in range(300)]
    words = ["".join(r.choice(["tion", "er", "and", "schl", "ung", "ment", "re"]) for _ in range(r.randint(3, 8))) for _ in range(4000)] + [str(r.randint(10**15, 10**16)) for _ in range(50)] + [f"555-{r.randint(1000, 9999)}" for _ in range(50)]
    f = S.Formats([(2 if x[0] != "A" else 1, x) for x in made[:200] + made[300:500]], S.pair_counts(words), 400)
    held_out = made[200:300] + made[500:]
    assert np.mean([f.is_credential(x, f.ratio(x)) for x in held_out]) >= 0.9
    assert not any(f.is_credential(x, f.ratio(x)) for x in words)


@pytest.mark.parametrize("text", [("a" * 40 + " ") * 50_000, "token = " * 300_000, "x" * 3_000_000, "password" + " " * 2_000_000, "AKIA" * 500_000, "word.word " * 300_000])
def test_secret_scan_time_is_linear(text):
    began = time.perf_counter()
    spans = S.scan_text(text)
    for _ in S.candidates(text, spans):
        pass
    assert time.perf_counter() - began < 5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title {k}</h1><p>First&nbsp;&amp; <b>bold</b>{k}<br>line<p>Second
   para {k}</p><ul><li>one<li>two</ul><aside>Related</aside><div class="comments"><p>Nice!</p></div></article>
<form><input name=q><button>Go</button></form><div id="sidebar">Links</div><footer>&copy; Site</footer></body></html>"""


def test_html_article(spark):
    rows = [(k, f"http://a.example/en/{k}.html?x={k}", PAGE.format(k=k)) for k in range(8)] + [(90, "http://b.example/", None), (91, None, ""), (91, None, ""), (92, "no host", "<p>alone")]
    got = {x.page_id: x for x in H.extract_text(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")).collect()}
    for k in range(8):
        assert got[k].text == f"Title {k}\nFirst & bold{k} line\nSecond para {k}\none\ntwo" and got[k].n_chars == len(got[k].text)
    assert got[90].text == "" and got[91].text == "" and got[92].text == "alone"
    assert H.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def longest(a, b):
    """Indices of ``a`` in a longest common subsequence, by the table."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    found, i, j = set(), len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            found.add(i)
        elif n[i - 1][j] >= n[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return found


def brute_pages(rows):
    """Texts of pages whose lines are distinct (so that the subsequence is unique)."""
    def key(r):
        host, path = re.match(r"(?:http://([^/?#]*))?([^?#]*)", r[1] or "").groups()
        return host or "", path, r[1] or "", r[0] is not None, r[0] or 0, H.blocks_of(r[2] or "")

    order, out = sorted(rows, key=key), []
    for k, r in enumerate(order):
        host, *_, (lines, inside, other) = key(r)
        shared = set()
        for others in (order[k - 1 :: -1] if k else [], order[k + 1 :]):
            near = next((x for x in others if key(x)[0] != host or key(x)[-1] != key(r)[-1]), None)
            if near and key(near)[0] == host:
                shared |= longest(lines, key(near)[-1][0])
        out.append((r[0], r[1], "\n".join(x for i, x in enumerate(lines) if not other[i] and (inside[i] or i not in shared))))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_html_difference_equals_brute_force(spark, parts):
    r = random.Random(9)
    rows = []
    for k in range(120):
        template = ["<div>Menu</div>", "<div>Sign up now</div>", f"<p>Body {k}</p>", f"<article><p>Quote</p><p>Own {k}</p></article>", f"<p>More {k}</p>", "<nav>Go</nav>", "<p>Bye</p>"]
        rows.append((k, f"http://{r.choice('abbbbb')}.example/{r.randint(0, 30)}/{k % 7}?k={k}", "".join(x for x in template if r.random() < 0.8)))
    rows += [rows[5]] * 40 + [(500 + k, rows[7][1] + "#x", rows[7][2]) for k in range(9)] + [(900, None, "<p>no url"), (None, None, "<p>no url<p>nor id"), (901, "http://alone.example/", "<p>Alone"), (902, "http://b.example/", None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = sorted(((x.page_id, x.url, x.text) for x in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == brute_pages(rows)


@pytest.mark.parametrize("page", ["<a " * 200_000, "<a '" * 200_000 + ">", "<a \"'>" * 200_000, "</script " * 200_000, "<script>" + "</script " * 200_000, "<![CDATA[" * 100_000, "<!--" * 100_000, "<!x" * 100_000, "<b>" * 100_000 + "<p>" * 100_000 + "</i>" * 100_000, "<li><div>" * 60_000, "&amp" * 100_000, "x < y " * 200_000])
def test_html_time_is_linear(page):
    began = time.perf_counter()
    H.blocks_of(page)
    assert time.perf_counter() - began < 5


def test_html_text_elements_of_an_article_keep_their_class():
    page = "<article><h2 class='section-header'>Part</h2><p class=notice>Mind</p><div class=notice>Cookies</div><p>5 < 6 <b>and</b> <![CDATA[a<b]]></p></article>"
    lines, inside, other = H.blocks_of(page)
    assert [x for x, o in zip(lines, other) if not o] == ["Part", "Mind", "5 < 6 and a<b"] and all(inside)


def test_common_lines_of_long_pages(monkeypatch):
    r = random.Random(10)
    a, b = ([r.choice("abcdefgh") for _ in range(r.randint(80, 120))] for _ in range(2))
    whole = H.common_lines(a, b)
    monkeypatch.setattr(H, "TABLE_BITS", 50)
    parts = H.common_lines(a, b)
    assert len(parts) == len(whole) == len(longest(a, b))
    it = iter(b)
    assert all(any(a[k] == y for y in it) for k in sorted(parts))


def test_html_difference_beside_an_article():
    page = "<body><div>Menu</div><div id=content><p>Body {k}</p></div><article>Teaser {k}<p>Quote</p></article><p>Continued {k}</p><nav>Go {k}</nav><div>Bye</div></body>"
    before, now, after = (H.blocks_of(page.format(k=k)) for k in range(3))
    assert H.main_text(now, [before, after]) == "Body 1\nTeaser 1\nQuote\nContinued 1"


@pytest.mark.parametrize("before", ["<script>for(var i=0;i<n;i++){f(i)}</script>", "<script>a='<!--'</script>", "<style>/* <!-- */ p::before{content:'<b'}</STYLE >", "<title>a <b</title>", "<svg><path d='M0'></svg>", "<object>", "<!-->"])
def test_html_raw_elements_end_at_their_tag(before):
    lines, inside, other = H.blocks_of(f"<body>{before}<article><p>Whole text</p></article></body>")
    assert (lines, inside, other) == (["Whole text"], [True], [False])


@pytest.mark.parametrize("attributes, other", [('style="overflow:hidden"', False), ('class="x-hidden-print"', False), ('data-href="/hidden-gems"', False), ("data-id=menu", False), ('title="a hidden b"', False), ("hidden=false", False), ("hidden", True), ('HIDDEN=""', True), ("aria-hidden='true'", True), ('aria-hidden="false"', False), ('style="color:red; display : none"', True), ('data-style="display:none"', False), ("role=alert", True), ('id="comments"', True)])
def test_html_hidden_is_an_attribute(attributes, other):
    assert H.blocks_of(f"<article {attributes}><p>Text</p></article>")[1:] == ([not other], [other])


def test_common_lines_are_a_longest_subsequence():
    r = random.Random(6)
    for _ in range(200):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        found = sorted(H.common_lines(a, b))
        assert len(found) == table[-1][-1]
        it = iter(b)
        assert all(any(a[k] == y for y in it) for k in found)


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(7)
    words = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(500)]
    docs, labels = [], []
    for k in range(900):
        text = [r.choice(words) for _ in range(r.randint(20, 80))]
        bad = k % 4 == 0
        for _ in range(3 if bad else 0):
            text.insert(r.randrange(len(text)), r.choice(["idiot", "Zugrufel", "zugrufler", "M0RON!"]))
        docs.append((k, " ".join(text)))
        labels.append((k, int(bad)))
    docs += [(5000, None), (5001, ""), (5002, "word " * 50_000), (5001, "")]
    docs_df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    labels_df = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    scored = T.score_toxicity(docs_df, labels_df).collect()
    assert len(scored) == len(docs) and all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in scored)
    held = [x for x in scored if x.doc_id < 900 and __import__("zlib").crc32(str(x.doc_id).encode()) % 5 == 0]
    assert np.mean([x.predicted == (x.doc_id % 4 == 0) for x in held]) > 0.95
    none = T.score_toxicity(docs_df, labels_df.limit(0)).collect()
    assert {x.score for x in none} == {0.0}
    assert T.score_toxicity(docs_df.limit(0), labels_df).count() == 0


@pytest.mark.parametrize("text", ["a" + "." * 2_000_000 + "b", "!" * 2_000_000, "a.b" * 700_000, "..a.." * 400_000, "x " * 500_000])
def test_toxicity_time_is_linear(text):
    began = time.perf_counter()
    T.features(text, T.Tokens({}))
    assert time.perf_counter() - began < 6


def test_edges_of_tokens():
    r = random.Random(13)
    for _ in range(2000):
        token = "".join(r.choice("ab.@!$-é") for _ in range(r.randint(0, 8)))
        assert T._EDGE.sub("", token) == re.sub(r"^[^\w@$]+|[^\w@$!]+$", "", token)


def brute_tree(x, g, h, rows, depth, least):
    """The best splits by trying every threshold between values."""
    total = g[rows].sum() / (h[rows].sum() + 1)
    best = (1e-6, None)
    if depth and len(rows) >= 2 * least:
        for f in range(x.shape[1]):
            for t in np.unique(x[rows, f])[:-1]:
                a, b = rows[x[rows, f] <= t], rows[x[rows, f] > t]
                if min(len(a), len(b)) >= least:
                    gain = sum(g[k].sum() ** 2 / (h[k].sum() + 1) for k in (a, b)) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                    if gain > best[0] + 1e-12:
                        best = (gain, (a, b))
    if best[1] is None:
        out = np.zeros(len(g))
        out[rows] = np.clip(total, -4, 4)
        return out
    return sum(brute_tree(x, g, h, k, depth - 1, least) for k in best[1])


def test_boosted_trees_equal_brute_force():
    r = np.random.default_rng(14)
    x = r.integers(0, 12, (200, 4)).astype(float)  # fewer values than bins: every threshold is one
    y = (x[:, 0] + x[:, 1] * (x[:, 2] > 5) + r.normal(size=200) > 9).astype(float)
    made = T.Trees(x, y, trees=6, depth=3, rate=0.3, bins=400, least=5)
    margin = np.full(200, made.base)
    for _ in range(6):
        p = 1 / (1 + np.exp(-margin))
        margin += 0.3 * brute_tree(x, y - p, np.maximum(p * (1 - p), 1e-6), np.arange(200), 3, 5)
    assert np.allclose(made.margin(x), margin)


def test_isotonic_equals_least_squares():
    """The pools have the means that max-min formulas give."""
    r = np.random.default_rng(15)
    m = np.sort(r.choice(np.arange(40), 25, replace=False)).astype(float)
    y = (r.random(25) < m / 40).astype(float)
    knots, p = T.isotonic(m, y)
    mean = y.mean()
    for k in range(25):
        fitted = max(min(y[i : j + 1].mean() for j in range(k, 25)) for i in range(k + 1))
        n = sum(np.isclose(fitted, max(min(y[i : j + 1].mean() for j in range(q, 25)) for i in range(q + 1))) for q in range(25))
        assert np.isclose(np.interp(m[k], knots, p), (fitted * n + mean) / (n + 1))


def test_isotonic_is_monotone():
    r = np.random.default_rng(8)
    m = r.normal(size=300)
    x, p = T.isotonic(m, (r.random(300) < 1 / (1 + np.exp(-2 * m))).astype(float))
    assert (np.diff(p) >= 0).all() and (np.diff(x) >= 0).all() and p.min() >= 0 and p.max() <= 1
