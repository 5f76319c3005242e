import hashlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from leafspring.llm import decontaminate, htmltext, licenses, neardup, quality, rnnlm, substring
from leafspring.llm.common import components, lower_az, words_of
from leafspring.llm.queries import ORACLE_SQL


def brute_components(texts, k, num, den):
    sets = {}
    for i, t in texts.items():
        w = words_of(lower_az(t or ""))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    index = defaultdict(set)
    for i in sorted(sets):
        shared = defaultdict(int)
        for s in sets[i]:
            for j in index[s]:
                shared[j] += 1
            index[s].add(i)
        for j, n in shared.items():
            if den * n >= num * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 85, 100), (5, 4, 5)])
def test_near_duplicates_against_brute_force(spark, texts, k, num, den):
    rng = np.random.default_rng(5)
    made = dict(list(texts.items())[:60])
    base = [f"w{x}" for x in rng.integers(0, 4000, 160)]
    for c in range(60):  # a chain and a cloud of near copies
        words = list(base)
        for p in rng.integers(0, 160, c // 6):
            words[p] = f"n{rng.integers(10**6)}"
        made[10_000 + c] = " ".join(words)
    made |= {20_000: "a b", 20_001: "A b", 20_002: "a", 20_003: ""}
    df = spark.createDataFrame(list(made.items()), "doc_id long, text string")
    got = neardup.near_duplicates(df, shingle=k, similarity=(num, den)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(made, k, num, den)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.kept for r in rows)
    assert neardup.near_duplicates(none).count() == 0
    left = neardup.drop_near_duplicates(odd)
    assert left.columns == odd.columns and left.count() == odd.count()


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**63, 1500, dtype=np.uint64)
    a, b = x[:1000], x[500:]
    s = neardup.sketch([a, b, x, x[:1]])
    assert (np.maximum(s[0], s[1]) == s[2]).all()
    up, down = (s[0] > s[1]).sum(), (s[0] < s[1]).sum()
    assert abs(neardup.joint_similarity([up], [down], [1000], [1000])[0] - 1 / 3) < 0.09


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 7), (200, 201), (5, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[100] == 1 and got[201] == 200 and len(got) == 43


def brute_passages(texts, n=13):
    words = {i: words_of(t or "") for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k : k + n]), i)
    out = {}
    for i, w in words.items():
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        left = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), left)
    return out


@pytest.mark.parametrize("batches", [1, 3])
def test_substrings_against_brute_force(docs, texts, batches):
    want = brute_passages(texts)
    got = substring.passage_digest(docs, batches=batches).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in want.items()}
    if batches == 1:
        left = {r.doc_id: r.text for r in substring.remove_repeated_passages(docs).collect()}
        assert left == {i: want[i][2] if want[i][1] else texts[i] for i in texts}


def test_substrings_odd_rows(spark, odd, none):
    rows = substring.passage_digest(odd).collect()
    assert len(rows) == odd.count()
    assert all(not r.n_removed for r in rows)
    long = {i: " ".join(f"w{j}" for j in range(a, b)) for i, (a, b) in {1: (0, 30), 2: (5, 25), 3: (20, 60), 4: (0, 30)}.items()}
    df = spark.createDataFrame([*long.items(), (3, "other text"), (None, long[1])], "doc_id long, text string")
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring.passage_digest(df).collect()}
    assert got == {(1, 30): 0, (2, 20): 20, (3, 40): 0, (4, 30): 30, (3, 2): 0, (None, 30): 0}
    assert substring.passage_digest(none).count() == 0
    assert substring.remove_repeated_passages(odd).columns == odd.columns


def test_index_compacts_to_the_same(spark, docs):
    index = substring.FingerprintIndex(spark, 13, most_runs=2)
    rows = docs.select("doc_id", "text")
    for k in range(4):
        index.add(rows.where(f"doc_id % 4 = {k}"))
        assert len(index.runs) <= 2
    got = {tuple(r) for r in index.merged().collect()}
    p = substring.postings(rows, 13)
    assert got == {(r.anchor, r[1], r[2]) for r in p.groupBy("anchor").agg({"doc_id": "min"}).join(p.groupBy("anchor").agg({"doc_id": "max"}), "anchor").collect()}
    index.close()


def test_later_batches_are_held_against_the_index(spark, docs, texts):
    """Three batches, each with the index of those before: as if all were one. The
    index is written down and opened again on the way."""
    want = brute_passages(texts)
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    index, at = substring.FingerprintIndex(spark, 13, most_runs=2), [0, 90, 130, len(rows)]
    for k in range(3):
        old, new = spark.createDataFrame(rows[: at[k]], "doc_id long, text string"), spark.createDataFrame(rows[at[k] : at[k + 1]], "doc_id long, text string")
        got = substring.passage_digest(new, index=index, history=old, batches=1).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {r.doc_id: (want[r.doc_id][0], want[r.doc_id][1], hashlib.sha256(want[r.doc_id][2].encode()).hexdigest()) for r in new.collect()}
        index = substring.FingerprintIndex.reopen(spark, index.manifest())
        assert len(index.runs) <= 2
    # whatever stands in the history counts as before, even with a larger id
    late = spark.createDataFrame([(-1, rows[5].text)], "doc_id long, text string")
    n, _, _ = want[rows[5].doc_id]
    assert [(r.n_words, r.n_removed) for r in substring.passage_digest(late, index=index, history=docs, batches=1).collect()] == [(n, n)]
    index.close()
    assert index.runs == {}


def test_the_query_compacts(spark, docs, monkeypatch):
    tables = lambda: {t.name for t in spark.catalog.listTables() if t.name.startswith("leafspring_run")}
    seen, before = [], tables()
    closed = substring.FingerprintIndex.close
    monkeypatch.setattr(substring.FingerprintIndex, "close", lambda self: (seen.append(self.compactions), closed(self)))
    substring.passage_digest(docs)
    assert seen == [1]
    assert tables() == before


def test_hashes_alone_decide_nothing(monkeypatch):
    """Where all windows had one hash, the words would still tell them apart."""
    words = [b"a", b"b", b"a", b"b", b"c", b"a", b"b"]
    assert substring._same_windows(words, np.zeros(6, np.uint64), np.array([0]), 2).tolist() == [0, 2, 5]


def test_contamination_survives_substitutions(spark, odd, none):
    rng = np.random.default_rng(2)
    items = [(i, " ".join(f"q{x}" for x in rng.integers(0, 900, 40))) for i in range(30)]
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "one")], "item_id long, text string")
    filler = lambda n: [f"z{x}" for x in rng.integers(0, 900, n)]
    rows, dirty = [], set()
    for i, t in items:
        words = t.split()
        for p in range(3, 40, 8):  # every eighth word is another
            words[p] = "swap"
        rows.append((i, " ".join([*filler(30), *words, *filler(30)])))
        dirty.add((i, i))
        rows.append((1000 + i, " ".join(filler(100))))
        rows.append((2000 + i, " ".join([*filler(30), *t.split()[:8], *filler(30)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chars in (16 << 20, 2000):
        got = decontaminate.contamination(df, bench, block_chars=chars).collect()
        assert {(r.doc_id, r.item_id) for r in got} == dirty
    assert {r.doc_id for r in decontaminate.clean_documents(df, bench, block_chars=2000).collect()} == {i for i, _ in rows if i >= 1000}
    assert decontaminate.contamination(odd, bench).count() == 0
    assert decontaminate.clean_documents(odd, bench).count() == odd.count()
    assert decontaminate.contamination(none, bench).count() == decontaminate.contamination(df, bench.where("false")).count() == 0


def brute_overlaps(doc, item, least=13, drop=4):
    """The best overlap of two token lists, from every seed on every diagonal."""
    def reach(same):
        score = best = end = 0
        for i, x in enumerate(same):
            score += 1 if x else -1
            if score > best:
                best, end = score, i + 1
            if best - score >= drop:
                break
        return end

    masks = decontaminate.MASKS if len(item) >= 8 else ("1" * len(item),) if len(item) > 1 else ()
    best = None
    for d in range(1 - len(item), len(doc)):
        a, z = max(0, d), min(len(doc), d + len(item))
        same = [doc[i] == item[i - d] for i in range(a, z)]
        hits = [(i, len(m)) for m in masks for i in range(len(same) - len(m) + 1) if all(same[i + k] for k, c in enumerate(m) if c == "1")]
        for i, width in hits:
            lo, hi = i - reach(same[:i][::-1]), i + width + reach(same[i + width :])
            matched, span = sum(same[lo:hi]), hi - lo
            if matched >= min(least, len(item)) and 5 * matched >= 4 * span:
                best = max(best or (0,), (matched, -span, -(a + lo), d, len(hits)))
    return best and (best[4], best[0], -best[1], -best[2], -best[2] - best[1])


def test_contamination_against_brute_force(spark):
    rng = np.random.default_rng(8)
    items = [[f"w{x}" for x in rng.integers(0, v, n)] for v, n in [(3, 30), (9, 40), (400, 25), (400, 60), (400, 12), (400, 8), (400, 7), (400, 6), (400, 3), (2, 5), (50, 14)]]
    items += [["ha"] * 40, ["a", "b"] * 15, [*items[3][10:40], *items[3][10:40]]]
    docs = []
    for i in range(70):
        words = [f"w{x}" for x in rng.integers(0, (3, 9, 400)[i % 3], 60)]
        part = list(items[i % len(items)])
        for p in rng.integers(0, len(part), rng.integers(0, 1 + len(part) // 6)):
            part[p] = "zz"
        at = int(rng.integers(0, 60))
        docs.append([*words[:at], *part[int(rng.integers(0, 3)) :], *words[at:]])
    docs += [items[4], ["x", *items[5]], ["ha"] * 90, ["ha", *["ha"] * 30, "b"], ["b", *["a", "b"] * 30], items[13] * 2, items[7], items[8] * 3]
    want = {(d, k): b for d, x in enumerate(docs) for k, y in enumerate(items) if (b := brute_overlaps(x, y))}
    assert len({k for _, k in want}) == len(items) and len(want) > 60
    df = spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(y)) for k, y in enumerate(items)] * 2, "item_id long, text string")
    for chars in (1 << 20, 300):
        rows = decontaminate.contamination(df, bench, block_chars=chars).collect()
        assert {(r.doc_id, r.item_id): tuple(r)[2:] for r in rows} == want and len(rows) == len(want)


def test_repeated_words_cost_no_product():
    """Hits of one word, repeated in the item and the text, are not all listed."""
    index = decontaminate.SeedIndex([(1, "ha " * 4000), (2, "ho hi " * 2000)])
    runs = index._runs(np.array([index.vocab["ha"]] * 4000))
    assert sum(map(len, runs.values())) < 5 * 8000
    assert index.matches("ha " * 4000, 13, 4)[0][2:] == (4000, 4000, 0, 4000)
    assert index.matches("hi ho " * 2000, 13, 4)[0][2:] == (3999, 3999, 0, 3999)


def test_contamination_finds_substituted_items(spark, sf):
    """Of the table's items, with every tenth token another, all are found."""
    rng = np.random.default_rng(6)
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    rows = []
    for r in bench.collect():
        words = r.text.split()
        for p in range(int(rng.integers(0, 10)), len(words), 10):
            words[p] = "swapped"
        rows.append((r.item_id, "before it " * 9 + " ".join(words) + " after it" * 9))
    got = decontaminate.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert {r.doc_id for r in got if r.doc_id == r.item_id} == {r[0] for r in rows}


def test_contamination_finds_every_whole_passage(spark, docs, texts, sf):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    norm = lambda t: " ".join(decontaminate.TOKEN.findall(t.lower()))
    items = {r.item_id: norm(r.text) for r in bench.collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in items.items() if f" {x} " in f" {norm(t)} "}
    assert whole <= {(r.doc_id, r.item_id) for r in decontaminate.contamination(docs, bench).collect()}


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 3 <> 0"))
    assert (np.diff(model.thetas) > 0).all()
    test = {r.doc_id: (r.quality, r.toxic) for r in labels.where("doc_id % 3 = 0").collect()}
    got = {r.doc_id: r for r in quality.score_documents(docs, model).collect() if r.doc_id in test}
    right = sum(got[i].kept == (q == 1 and t == 0) for i, (q, t) in test.items())
    assert right >= 0.9 * len(test)


def test_quality_scores_by_their_definition(spark, docs, texts, sf):
    """Scores from the weights, token by token; the fit is an optimum of the
    penalised likelihood written out plainly."""
    from math import exp, log

    model = quality.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    weight = dict(zip(model.buckets.tolist(), model.weights.tolist()))
    for r in quality.score_documents(docs, model).collect():
        z = sum(weight.get(quality.bucket(t), 0.0) for t in quality.tokens_of(texts[r.doc_id]))
        tails = [1 / (1 + exp(t - z)) for t in model.thetas]
        assert r.expected_grade == pytest.approx(sum(tails)) and r.p_good == pytest.approx(tails[-1]) and r.kept == (tails[-1] >= 0.5)
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(300)]
    grades = np.array([min(2, int((x < 14).sum() // 2 + rng.integers(0, 2)) // 2) for x in rows])
    fit = quality.fit_ordinal(rows, grades, 3, l1=1e-3, steps=4000)

    def loss(w, theta):
        total = 0.0
        for x, g in zip(rows, grades):
            z = sum(w.get(int(b), 0.0) for b in x)
            p = [1.0, *(1 / (1 + exp(t - z)) for t in theta), 0.0]
            total -= log(p[g] - p[g + 1])
        return total / len(rows) + 1e-3 * sum(map(abs, w.values()))

    w, theta = dict(zip(fit.buckets.tolist(), fit.weights.tolist())), fit.thetas.tolist()
    best = loss(w, theta)
    for b in range(40):
        for step in (-0.05, 0.05):
            assert loss(w | {b: w.get(b, 0.0) + step}, theta) > best - 2e-4
    for k in range(2):
        for step in (-0.05, 0.05):
            assert loss(w, [t + step * (i == k) for i, t in enumerate(theta)]) > best - 2e-4


def test_quality_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, None, 0), (None, 1, 1), (4, 0, 0), (77, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    got = quality.score_documents(odd, model)
    assert got.columns == [c for c in odd.columns if c != "kept"] + ["expected_grade", "p_good", "kept"]
    assert got.count() == odd.count() and got.where("p_good is null or kept is null").count() == 0
    empty = quality.train(none, labels)
    assert quality.score_documents(none, empty).count() == 0
    assert quality.score_documents(odd, empty).count() == odd.count()


PAGES = {
    "a": ("<html><body><nav><a href=x>Home</a></nav><div class=ad>Buy now</div><article><h1>The  title</h1><p>One &amp; two<b>three</b>.<p>Four\n five, six and seven.</article><footer>&copy; me</footer>", "The title One & twothree. Four five, six and seven."),
    "b": ("<body><div class='header'><h2>My site</h2></div><div id='content'><p>First paragraph of the text, quite long, goes on here.</p><form><label>Mail</label><input></form><p>Second paragraph of the text; it ends.</p></div><div class='comments'><p>I liked it</p></div><script>var t='</p>';</script></body>", "First paragraph of the text, quite long, goes on here. Second paragraph of the text; it ends."),
}


def test_html_examples(spark):
    rows = [(i, k, PAGES[k][0], 1) for i, k in enumerate(PAGES)] + [(7, None, None, 1), (8, "u", "", 1), (9, "u", "<", 1), (9, "u", "<", 1), (10, "u", "<div " * 3000, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = htmltext.extract_main_text(df).collect()
    assert [r.text for r in got[:2]] == [PAGES[k][1] for k in PAGES]
    assert [r.text for r in got[2:4]] == ["", ""] and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert htmltext.extract_main_text(df.where("false")).count() == 0


A = "The text stands here, long enough. It goes on."


@pytest.mark.parametrize(("source", "text"), [
    (f"<html><head><title>t</title><article><p>{A}</p><p>More.</p></article>", f"{A} More."),  # no </head>, no <body>
    (f"<title>t</title><meta charset=x><p>{A}</p>", A),
    (f"<body>{A}<br>Second line.</body>", f"{A} Second line."),
    (A, A),
    (f"<div class=nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></div>{A}<p>{A}<div class=footer>copyright</div>", f"{A} {A}"),
    (f"<body><svg class=icon/><article><p>{A}</p></article>", A),
    (f"<body><svg><article><p>{A}</p></article>", A),
    (f"<body><math/><article><p>{A}</p></article>", A),
    (f"<body><iframe src=x><article><p>{A}</p></article>", A),
    (f"<body><noscript><article><p>{A}</p></article>", A),
    (f"<body><template><article><p>{A}</p></article>", A),
    (f"<article><p>{A} <math><mi>x</mi><mo>=</mo><mn>1</mn></math>, so.</p><noscript>Seen without scripts.</noscript><svg><title>no</title><text>Label</text></svg><xmp><b></xmp></article>", f"{A} x=1, so. Seen without scripts. Label <b>"),
    (f"<article><p>{A}</p></article><script>var t = '<p>x</p>'", A),  # unclosed: to the end
    (f"<article><p>{A}</p><style>p {{</style><p>{A}</p></body></html><p>{A}</p></article>", f"{A} {A} {A}"),
    ("<nav><ul><li><a href=1>Home</a><li><a href=2>News</a></ul></nav><footer>&copy; me</footer>", ""),
    ("<body><form><label>Mail</label><input></form><script>x", ""),
])
def test_html_with_tags_left_out(source, text):
    assert htmltext.main_texts([source], htmltext.trained()) == [text]


def test_html_on_held_out_pages():
    model, rng, good = htmltext.trained(), np.random.default_rng(99), 0
    for _ in range(100):
        page, label = htmltext.truth(htmltext.sample_page(rng))
        found = page.decode(model.log_proba(page.features()))
        for i in range(1, len(found)):  # no contradiction between a node and its parent
            assert found[i] >= found[page.parent[i]]
        good += page.text(found) == page.text(label)
    assert good >= 94


def test_html_on_articles(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    for r in htmltext.extract_main_text(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner))).split())


def same_as_duckdb(rows, sql, sf):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    want = sorted(map(tuple, rel.project(", ".join(names)).fetchall()))
    assert sorted(tuple(r[n] for n in names) for r in rows.collect()) == want
    return len(want)


def test_licenses_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert same_as_duckdb(licenses.scan_licenses(docs), ORACLE_SQL["op10_licenses"], sf) > 20


def test_substrings_against_sql(docs, sf):
    assert same_as_duckdb(substring.passage_digest(docs), ORACLE_SQL["op8_substrings"], sf) == docs.count()


def test_near_duplicates_against_sql(docs, sf):
    assert same_as_duckdb(neardup.near_duplicates(docs), ORACLE_SQL["op9_near_duplicates"], sf) == docs.count()


def test_licenses_find_templates(spark, odd, none):
    pad = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor"
    rows = [(i, f"{pad} {pad} {t.upper()} {pad}", n) for i, (n, t) in enumerate(licenses.notices().items())]
    got = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    names = [r[2] for r in rows]
    assert {(r.doc_id, names[r.doc_id]) for r in got if r.found == r.total and r.license == names[r.doc_id]} == {(i, n) for i, n in enumerate(names)}
    assert licenses.scan_licenses(odd).count() == licenses.scan_licenses(none).count() == 0


def test_language_model_against_its_definition(spark, docs, texts):
    got = {r.doc_id: r for r in rnnlm.score_documents(docs, known_types=300).collect()}
    tokens = {i: rnnlm.tokens_of(t) for i, t in texts.items()}
    from collections import Counter
    from math import log10

    c = Counter(t for i, x in tokens.items() if not rnnlm.held_out(i) for t in x)
    n, v = sum(c.values()), len(c)
    for i, x in tokens.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (rnnlm.held_out(i), len(x), sum(t in c for t in x), n)
        assert r.base_score == pytest.approx(sum(log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in x), rel=1e-9)
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_language_model_gradients_and_states():
    vocab = rnnlm.Vocabulary([b"w%d" % i for i in range(200)], {b"w%d" % i: 300 - i for i in range(200)}, 10**5, 900, np.full(rnnlm.TAIL_CLASSES, 50.0), np.full(rnnlm.TAIL_CLASSES, 9.0))
    p = {k: v.astype(np.float64) for k, v in rnnlm.initial(vocab).items()}
    rng = np.random.default_rng(0)
    goal = rng.choice([*range(200), *range(rnnlm.HEAD, rnnlm.INPUTS - 1)], (6, 4))
    ids = np.concatenate([np.full((1, 4), rnnlm.INPUTS - 1), goal[:-1]])
    mask, h = np.ones((6, 4)), np.zeros((4, rnnlm.STATE))

    def loss(q):
        before, last = rnnlm.recur(q, ids, h)
        states = np.concatenate([before[1:], last[None]]).reshape(-1, rnnlm.STATE)
        return -rnnlm.token_logs(q, states, goal.ravel()).mean()

    g, _ = rnnlm.gradients(p, ids, goal, mask, h)
    for k in p:
        flat = np.argsort(-abs(g[k]).ravel())[:3]
        for at in flat:
            q = {n: x.copy() for n, x in p.items()}
            q[k].ravel()[at] += 1e-2
            up = loss(q)
            q[k].ravel()[at] -= 2e-2
            assert (up - loss(q)) / 2e-2 == pytest.approx(g[k].ravel()[at], rel=0.08, abs=2e-4)
    p32 = rnnlm.initial(vocab)
    seqs = [rng.integers(0, 200, n) for n in (1, 31, 32, 33, 100)]
    together = rnnlm.score_local(p32, seqs)
    assert together == pytest.approx([rnnlm.score_local(p32, [s])[0] for s in seqs], rel=1e-4)
    # a distribution: over all classes and, in each, over its words and one unknown
    state = np.zeros((rnnlm.INPUTS - 1, rnnlm.STATE), np.float32)
    every = np.arange(rnnlm.INPUTS - 1)
    assert np.exp(rnnlm.token_logs(p32, state, every)).sum() == pytest.approx(1, rel=1e-4)


def test_language_model_learns_from_whole_documents(spark):
    words = [b"w%d" % i for i in range(200)]
    vocab = rnnlm.Vocabulary(words, {w: 300 - i for i, w in enumerate(words)}, 10**5, 900, np.full(rnnlm.TAIL_CLASSES, 50.0), np.full(rnnlm.TAIL_CLASSES, 9.0))
    rng = np.random.default_rng(4)
    docs = [(i, b" ".join(rng.choice(words, n)).decode()) for i, n in enumerate((900, 700, 40, 1500, 300, 5, 1100))]
    rows = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    index = rnnlm._Tokens(vocab)
    runs = [index(rnnlm.tokens_of(t))[1] for i, t in docs if not rnnlm.held_out(i)]
    assert sum(map(len, runs)) > 2000
    want = rnnlm.train_local(rnnlm.initial(vocab), runs, least_steps=1)
    got = rnnlm.train(rows, vocab, rounds=1, least_steps=1)
    for k in want:
        assert got[k] == pytest.approx(want[k], abs=1e-3)


def test_language_model_reads_texts_twice(spark, docs):
    read = spark.sparkContext.accumulator(0)

    def tap(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    some = docs.select("doc_id", "text").limit(60).localCheckpoint()
    seen = some.mapInArrow(tap, some.schema)
    assert rnnlm.score_documents(seen, least_steps=1).count() == 60
    # once to count tokens, once for the ids that both rounds and the scores use
    assert read.value == 2 * 60


def test_language_model_encodes_whole_texts(spark):
    texts = {0: "The  cat\tthe CAT ", 1: None, 2: " \n ", 3: "\x85a\u00a0b \x1c rare-\u00e9\u00df \u4e2d rare-\u00e9\u00df", 4: "word " * 5000 + "end", 5: ""}
    words = [rnnlm.END, b"the", b"cat", b"word"]
    n = np.full(rnnlm.TAIL_CLASSES, 50.0)
    vocab = rnnlm.Vocabulary(words, {w: 9 - i for i, w in enumerate(words)} | {b"end": 2}, 1000, 90, n, n)
    index, mass = rnnlm._Tokens(vocab), np.log10(50 + 0.5 * 51)
    got = rnnlm.encoded(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2), vocab).collect()
    assert len({r.row for r in got}) == len(got) == len(texts)
    for r in got:
        tokens = rnnlm.tokens_of(texts[r.doc_id])
        codes, ids, rare = index(tokens)
        assert np.frombuffer(bytes(r.ids), "<i2").tolist() == ids.tolist()
        assert (r.held_out, r.n_tokens, r.n_known) == (rnnlm.held_out(r.doc_id), len(tokens), len(tokens) - len(rare))
        assert sorted(t.token for t in r.tail for _ in range(t.tf)) == sorted(t.decode() for t in rare)
        assert r.base == pytest.approx(sum(np.log10(vocab.counts[t] + 0.5) for t in tokens if t in vocab.counts), rel=1e-12)
        assert r.own == pytest.approx(sum((np.log10(2.5) if c >= 0 else 0) - mass for c, i in zip(codes, ids, strict=True) if i >= rnnlm.HEAD), rel=1e-12)


def test_language_model_far_logits():
    x = np.array([[900.0, 890.0], [-900.0, -899.0], [1.0, 2.0]], np.float32)
    want = x - np.log(np.exp(x - x.max(1, keepdims=True)).sum(1, keepdims=True)) - x.max(1, keepdims=True)
    e, total, own, at = rnnlm._exps(x.copy(), np.array([1, 0, 1]))
    assert at - np.log(total) == pytest.approx(want.ravel()[own], abs=1e-4) and np.isfinite(e).all()


def test_language_model_odd_rows(odd, none):
    rows = rnnlm.score_documents(odd).collect()
    assert len(rows) == odd.count()
    assert all(r.n_tokens >= 1 and np.isfinite(r.score) and np.isfinite(r.base_score) for r in rows)
    assert rnnlm.score_documents(none).count() == 0
