"""Small cases of the unit table, pages, translation, HTML, files and the pipeline."""

import json

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from leafspring.functions import text as T
from leafspring.operators import document as D, layout as L, render as R, translation as X
from leafspring.plans import pipeline
from leafspring.sources import cache, files, names
from leafspring.streaming import each_batch

ITEM = "doc_id int, ord int, type string, page_idx int, text string, text_level int, img_path string, image_caption array<string>, list_items array<string>"


def items(spark, *rows, doc=1):
    """rows: (type, page_idx, text, more)."""
    full = [(doc, i, kind, page, text, more.get("level"), more.get("img"), more.get("captions"), more.get("entries")) for i, (kind, page, text, more) in enumerate(rows)]
    return spark.createDataFrame(full, ITEM)


PAPER = [
    ("text", 0, "On γ rays", {}), ("text", 0, "A. Writer", {}), ("text", 0, "Some Place", {}), ("text", 0, "ABSTRACT", {"level": 2}), ("text", 0, "We set t = 1. It is so.", {}),
    ("header", 0, "gone", {}), ("text", 0, "1.\u00a0Scale of β", {"level": 1}), ("text", 0, "First one. Second one.", {}), ("list", 0, None, {"entries": ["An entry. With a stop", " ", "K=2"]}),
    ("text", 1, "Third one.", {}), ("image", 1, None, {"img": "a.png", "captions": ["Fig.\u00a01: A plot. Of α.", "* ours"]}), ("image", 1, None, {"img": "b.png"}),
    ("equation", 1, "$$x \\tag{3}$$", {"img": "c.png"}), ("equation", 1, "y", {}), ("code", 1, "a\nb", {}), ("image", 1, None, {"captions": ["Fig. 9: lost"]}),
    ("text", 2, "References", {"level": 1}), ("text", 2, "Somebody, A. Book.", {}),
]
TAGS = [
    ("P1-TITLE", "title", "On $\\gamma$ rays"), ("P1-AUTHORS", "authors", "A. Writer"), ("P1-AFFIL", "affil", "Some Place"), ("P1-S1-abstract-S1", "body_sentence", "ABSTRACT"),
    ("P1-S2-abstract-S2", "body_sentence", "We set $t = 1$."), ("P1-S3-abstract-S3", "body_sentence", "It is so."), ("P1-HEADING-1.scale", "heading", "1.\u00a0Scale of $\\beta$"),
    ("P1-S4-1.scale-S1", "body_sentence", "First one."), ("P1-S5-1.scale-S2", "body_sentence", "Second one."), ("P1-S6-1.scale-S3", "body_sentence", "An entry. With a stop"), ("P1-S7-1.scale-S4", "body_sentence", "$K=2$"),
    ("P2-S1-1.scale-S5", "body_sentence", "Third one."), ("P2-FIG1", "figure_image", ""), ("P2-FIG1-CAPTION-S1", "caption_sentence", "Fig.\u00a01: A plot."), ("P2-FIG1-CAPTION-S2", "caption_sentence", "Of $\\alpha$. * ours"),
    ("P2-FIG-UNLABELED1", "figure_image", ""), ("P2-EQ3", "equation_image", ""), ("P2-EQ3-LATEX", "equation_latex", "$$x \\tag{3}$$"), ("P2-EQ-UNLABELED2-LATEX", "equation_latex", "$$y$$"),
    ("P2-UNKNOWN-code-1", "unknown", "a\nb"), ("P2-UNKNOWN-image-1", "unknown", "Fig. 9: lost"), ("P3-HEADING-u1.references", "heading", "References"), ("P3-S1-u1.references-S1", "body_sentence", "Somebody, A. Book."),
]


def in_order(units):
    return units.orderBy("doc_id", "ord", "pos").collect()


def test_unit_table(spark):
    got = in_order(L.units(items(spark, *PAPER)))
    assert [(r.tag, r.kind, r.en_text) for r in got] == TAGS
    assert {r.tag: r.image_path for r in got if r.image_path} == {"P2-FIG1": "images/fig_p2_1.png", "P2-FIG-UNLABELED1": "images/fig_p2_unlabeled1.png", "P2-EQ3": "images/eq_p2_3.png"}
    assert {r.tag: r.reason for r in got if r.reason} == {"P2-UNKNOWN-code-1": "unknown type", "P2-UNKNOWN-image-1": "no image"}
    assert {r.page for r in L.units(items(spark, *PAPER), page_offset=4).collect()} == {5, 6, 7}


def test_one_shuffle(spark):
    """All windows of units and of prepare() work on one exchange by document."""
    d = X.prepare(L.units(items(spark, *PAPER)))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "Join" not in plan


def test_odd_items(spark):
    rows = [("text", None, None, {}), (None, None, "odd", {}), ("text", 0, " ", {"level": 2}), ("list", 0, None, {}), ("equation", 0, "$$ $$", {}), ("table", 0, None, {"img": "t.png", "captions": [None, ""]})]
    got = in_order(L.units(items(spark, *rows)))
    assert [(r.tag, r.kind) for r in got] == [("P1-UNKNOWN-None-1", "unknown"), ("P1-TABLE-UNLABELED1", "figure_image")]
    assert L.units(items(spark, *rows).where("false")).count() == 0
    again = [("text", 0, "1. One", {"level": 1}), ("text", 0, "A. B", {}), ("text", 0, "1. One", {"level": 1}), ("text", 0, "C.", {})]
    assert [r.tag for r in in_order(L.units(items(spark, *again), page_offset=1))][1::2] == ["P2-S1-1.one-S1", "P2-S2-1.one-S1"]


def test_hyphens_come_back(spark):
    lexicon = spark.createDataFrame([(w,) for w in ("data", "efficient", "well", "localized", "methods")], "word string")
    d = L.units(items(spark, ("text", 0, "T", {}), ("text", 0, "A", {}), ("text", 0, "F", {}), ("text", 0, "dataefficient methods", {"level": 1}), ("text", 0, "A welllocalized one, $welllocalized$, Welllocalized.", {}), ("list", 0, None, {"entries": ["dataefficient"]})), lexicon=lexicon)
    assert [(r.tag, r.en_text) for r in in_order(d)][3:] == [
        ("P1-HEADING-u1.data", "data-efficient methods"), ("P1-S1-u1.data-S1", "A well-localized one, $welllocalized$, Welllocalized."), ("P1-S2-u1.data-S2", "data-efficient"),
    ]
    words = spark.createDataFrame([("Data",), ("a",), ("",), ("junk",)], "word string")
    assert {r.word: r.known for r in D.known_words(words, lexicon).collect()} == {"Data": True, "a": True, "": False, "junk": False}


def test_pages_and_back(spark):
    units = L.units(items(spark, *PAPER))
    pages = {r.page: r.body for r in R.page_markdown(units, 1, 4).collect()}
    assert pages[2].startswith("[P2-S1-1.scale-S5] Third one.\n![P2-FIG1](images/fig_p2_1.png) [P2-FIG1]\n\n[P2-FIG1-CAPTION-S1] ") and "[P2-EQ3-LATEX] $$x \\tag{3}$$\n\n![" not in pages[2]
    assert pages[4] == "\n" and pages[2].endswith("[P2-UNKNOWN-code-1] a\nb\n[P2-UNKNOWN-image-1] Fig. 9: lost\n")
    back = in_order(R.parse_tagged(R.page_lines(R.page_markdown(units, 1, 4))))
    assert [(r.tag, r.kind, r.en_text) for r in back] == [(t, k, x.replace("\n", " ")) for t, k, x in TAGS]
    assert [r.image_path for r in back] == [r.image_path for r in in_order(units)]
    two = {r.page: (r.en, r.ja) for r in R.bilingual_pages(X.translate(units, backend=lambda t, c: F.concat(F.lit("訳"), t))).collect()}
    assert sorted(two) == [1, 2, 3] and two[3][1] == "[P3-HEADING-u1.references] References\n[P3-S1-u1.references-S1] Somebody, A. Book.\n" and "[P1-AUTHORS] A. Writer" in two[1][1] and "[P1-S3-abstract-S3] 訳It is so." in two[1][1]


def test_parser(spark):
    lines = ["lost", "[P1-TITLE] One", "", "  goes on ", "[note] lost", "[P1-ODD] two  blanks kept ", "![P1-EQ1](a) [P1-EQ1]", "![P1-FIG1](b) [P1-FIG1]", "after", "![X](b) [X]", "[P1-S1-a-S1]"]
    d = spark.createDataFrame([(1, 1, i, x) for i, x in enumerate(lines)] + [(1, 2, 0, "no unit on this page")], "doc_id int, page int, ord int, line string")
    assert [(r.tag, r.kind, r.en_text, r.image_path) for r in in_order(R.parse_tagged(d))] == [
        ("P1-TITLE", "title", "One goes on", None), ("P1-ODD", "unknown", "two  blanks kept ", None), ("P1-EQ1", "equation_image", "", "a"), ("P1-FIG1", "figure_image", "after", "b"), ("P1-S1-a-S1", "body_sentence", "", None),
    ]


def test_prepare(spark):
    d = {r.tag: r for r in X.prepare(L.units(items(spark, *PAPER, ("text", 2, "$a \\textless b$", {})))).collect()}
    assert [t for t in d if not d[t].translatable] == ["P1-AUTHORS", "P1-AFFIL", "P2-FIG1", "P2-FIG-UNLABELED1", "P2-EQ3", "P2-EQ3-LATEX", "P2-EQ-UNLABELED2-LATEX", "P2-UNKNOWN-code-1", "P2-UNKNOWN-image-1", "P3-HEADING-u1.references", "P3-S1-u1.references-S1", "P3-S2-u1.references-S2"]
    head = "On $\\gamma$ rays\nABSTRACT We set $t = 1$. It is so."
    assert d["P1-TITLE"].context == head and d["P1-S4-1.scale-S1"].context == head + "\n\nWe set __MATH0__.\nIt is so.\n1.\u00a0Scale of __MATH0__"
    assert d["P1-S2-abstract-S2"].protected == "We set __MATH0__." and d["P1-S2-abstract-S2"].math_spans == ["$t = 1$"]
    assert d["P3-S2-u1.references-S2"].ja_text == d["P3-S2-u1.references-S2"].en_text == "$a < b$" and d["P1-AUTHORS"].context is None


def test_translator(spark):
    units = L.units(items(spark, *PAPER))

    def upper(rows):
        assert list(rows.columns) == ["doc_id", "ord", "pos", "text", "context"]
        return [t.replace("one", "ONE") for t in rows["text"]]

    got = {r.tag: r.ja_text for r in X.translate(units, upper).collect()}
    assert len(got) == len(TAGS) and got["P2-S1-1.scale-S5"] == "Third ONE." and got["P1-S2-abstract-S2"] == "We set $t = 1$." and got["P1-AUTHORS"] == "A. Writer"
    for bad in (lambda rows: list(rows["text"])[1:], lambda rows: [None] * len(rows)):
        with pytest.raises(PythonException, match="TranslationError"):
            X.translate(units, bad).collect()


def test_repairs_and_leaks(spark):
    rows = [("a", "of z and P($A$, $B$)", "値zのP($A$, $B$)", True), ("b", "z", "値zの$K$\u3000>\u30001", False), ("c", "$K$ > 1", "$K$\u3000>\u30001とqq", True)]
    d = X.repair_math(spark.createDataFrame(rows, "tag string, en_text string, ja_text string, translatable boolean").withColumn("doc_id", F.lit(1)))
    got = {r.tag: (r.en_text, r.ja_text) for r in d.collect()}
    assert got == {"a": ("of $z$ and $P(A, B)$", "値$z$の$P(A, B)$"), "b": ("z", "値zの$K$\u3000>\u30001"), "c": ("$K$ > 1", "$K\u3000>\u30001$とqq")}
    assert tuple(X.repair_counts(d).first()) == (1, 1, 1)
    known = spark.createDataFrame([("zz",)], "token string")
    assert [tuple(r) for r in X.unknown_leaks(d, known).collect()] == [(1, "c", "qq")]


def test_html(spark):
    d = X.translate(L.units(items(spark, *PAPER)), backend=lambda t, c: F.concat(F.lit("<"), t))
    png = spark.createDataFrame([(1, "images/fig_p2_1.png", bytearray(b"\x89PNG" * 40))], "doc_id int, image_path string, content binary")
    b = R.blocks(R.embed_images(d, png))
    kinds = [(r.block_kind, r.level, r.role, len(r.sentences)) for r in b.orderBy("block_id").collect()]
    assert kinds == [("title", None, None, 1), ("meta", None, "authors", 1), ("meta", None, "affil", 1), ("paragraph", None, None, 3), ("heading", 2, None, 1), ("paragraph", None, None, 4), ("paragraph", None, None, 1), ("figure", None, None, 1), ("paragraph", None, None, 2), ("figure", None, None, 1), ("equation", None, None, 1), ("equation", None, None, 1), ("paragraph", None, None, 1), ("paragraph", None, None, 1), ("heading", 2, None, 1), ("paragraph", None, None, 1)]
    ja = [r.html for r in R.block_html(b, "ja").orderBy("block_id").collect()]
    assert ja[0] == "<h1>&lt;On $\\gamma$ rays</h1>" and ja[1] == '<div class="byline">A. Writer</div>' and ja[5].count("<p>&lt;") == 4 and ja[4].startswith("<h2>") and ja[10] == '<div class="formula">$$x \\tag{3}$$</div>'
    assert ja[7].startswith('<figure><img src="data:image/png;base64,iVBOR4lQ') and "\n" not in ja[7] and ja[9] == '<figure><img src="images/fig_p2_unlabeled1.png" alt="P2-FIG-UNLABELED1"></figure>'
    pair = [r.html for r in R.bilingual_html(b).orderBy("block_id").collect()]
    assert len(pair) == len(ja) and pair[0] == '<table class="pair level-1"><tr><td lang="en"><strong>On $\\gamma$ rays</strong></td><td lang="ja"><strong>&lt;On $\\gamma$ rays</strong></td></tr></table>' and pair[5].count("<tr>") == 4 and pair[1] == ja[1]
    whole = R.document_html(R.block_html(b, "en"), "en", "Title").first().html
    assert whole.startswith('<!DOCTYPE html>\n<html lang="en">') and "<title>Title</title>" in whole and whole.index("First one.") < whole.index("Third one.")


def test_blanks_of_all_kinds(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(T.caption_number(F.lit("Fig.\u00a01:"))) == 1 and one(T.heading_number(F.lit("1.\u00a0INTRO"))) == "1" and one(T.caption_kind(F.lit("Table\u30002\u3000:"))) == "table"
    assert one(T.comparisons(F.lit("$a$\u3000>\u30001")))[0].new == "$a\u3000>\u30001$" and one(T.function_calls(F.lit("f($x$,\u3000y)")))[0].new == "$f(x,\u3000y)$"
    assert one(T.split_sentences(F.lit("See Fig.\u00a03. Then\u3000go.  éfig. 3 x. É no. A. B.\u2003C"))) == ["See Fig.\u00a03.", "Then\u3000go.  éfig. 3 x. É no. A. B.\u2003C"]
    assert one(T.wrap_greek(F.lit("αΑ $γ$ β"))) == "$\\alphaΑ$ $γ$ $\\beta$"


def test_files(spark, tmp_path):
    good = [{"type": "text", "page_idx": 0, "text": "A b."}, {"type": "image", "img_path": "x", "image_caption": ["Fig. 1: c."]}]
    for name, body in (("one_content_list.json", json.dumps(good)), ("two_content_list.json", "{broken"), ("three_content_list.json", "[]")):
        (tmp_path / name).write_text(body)
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "one_content_list.json").write_text("[]")
    got = files.read_items(spark, [f"file://{tmp_path}", f"file://{tmp_path}/z"]).orderBy("doc_id", "ord").collect()
    assert [(r.doc_id, r.ord, r.type, r.error) for r in got] == [("one", 0, "text", None), ("one", 1, "image", None), ("two", 0, "unreadable", "not an array of items")] and got[2].text == "{broken"
    files.write_items(files.read_items(spark, f"file://{tmp_path}/one_content_list.json").drop("error"), f"file://{tmp_path}/items")
    back = json.loads(spark.read.parquet(f"file://{tmp_path}/items").first().value)
    assert back == good
    pages = spark.createDataFrame([(7, p, f"[P{p}-S1-a-S{p}] p{p}.\n") for p in (2, 10, 100)] + [(8, 1, "\n")], "doc_id int, page int, body string")
    done = sorted(tuple(r) for r in files.write_markdown(pages, f"file://{tmp_path}/md").collect())
    assert [d[0] for d in done] == ["7/page_02_en.md", "7/page_100_en.md", "7/page_10_en.md", "8/page_01_en.md"] and (tmp_path / "md" / "7" / "page_02_en.md").read_text() == "[P2-S1-a-S2] p2.\n"
    assert [(r.doc_id, r.tag) for r in in_order(files.read_units(spark, f"file://{tmp_path}/md/*/page_*_en.md"))] == [("7", f"P{p}-S1-a-S{p}") for p in (2, 10, 100)]
    with pytest.raises(FileNotFoundError):
        files.read_units(spark, f"file://{tmp_path}/md/8/page_*_en.md")


def test_names_and_cache(spark, monkeypatch):
    assert names.run_id("a") == "a" and names.run_id("a", 1, 3) == "a_p1_3" and names.run_id("a", 1, 3, "label5") == "a_label5"
    assert names.output_dir("a", "p1", "T") == "output/manual_a_p1_T" and names.cache_dir("/c/", "a") == "/c/a/layout_cache" and names.cache_dir("/c", "a", "vlm-engine") == "/c/a/layout_cache_vlm-engine" and names.snapshot_dir("/c", "a", "T") == "/c/a/snapshots_T"
    with pytest.raises(ValueError):
        cache.check_backend("other")
    kinds = "doc_sha256 string, extractor_version string, start_page int, end_page int, backend string, schema_version int"
    entries = spark.createDataFrame([("h", "1", None, None, None, 1), ("h", "1", 1, 2, "pipeline", 1), ("h", "2", None, None, "pipeline", 1), ("h", "1", None, None, "vlm-engine", 1), ("h", "1", None, None, "pipeline", 0)], kinds)
    assert [r.backend for r in cache.valid_entries(entries, doc_sha256="h", extractor_version="1").collect()] == [None]
    assert cache.valid_entries(entries, doc_sha256="h", extractor_version="1", backend="vlm-engine").count() == 1
    assert files.setting(spark, "no.such", "x") == "x"
    monkeypatch.setenv("LEAFSPRING_CACHE_DISABLE", "1")
    assert cache.cached(spark, "/nowhere", "k", lambda: spark.range(2)).count() == 2


def test_pipeline(spark, tmp_path):
    said = []
    out = pipeline.run(items(spark, *PAPER), first=1, last=2, snapshots=f"file://{tmp_path}", say=said.append)
    assert {r.page for r in out["pages"].collect()} == {1, 2} and out["repairs"].count() == 1 and len(said) == 4
    assert (tmp_path / "structured" / "_SUCCESS").exists() and (tmp_path / "pages" / "_SUCCESS").exists()
    assert [r.tag for r in in_order(out["repaired"])] == [t for t, _, _ in TAGS if not t.startswith("P3")]
    for name in ("html_en", "html_ja", "html_pair"):
        assert "First one." in out[name].first().html
    with pytest.raises(ValueError):
        pipeline.run(items(spark, *PAPER), first=3, last=2)
    assert pipeline.run(items(spark, *PAPER))["blocks"].count() == 16


def test_stream(spark, tmp_path):
    for k in (1, 2):
        items(spark, *PAPER, doc=k).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(ITEM).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in/*")
    for _ in range(2):  # run again: nothing new
        each_batch(stream, L.units, f"{tmp_path}/out", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(tuple, got.groupBy("doc_id").count().collect())) == [(1, len(TAGS)), (2, len(TAGS))]
