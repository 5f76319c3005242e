"""Small cases of layout items, ranges, letters and the cache."""

import pytest
from pyspark.errors import SparkRuntimeException

from leafspring.operators import layout as L, ranges as R, translation as X
from leafspring.plans.queries import QUERIES, units
from leafspring.sources.cache import cached, fingerprint

ITEM = "doc_id int, ord int, type string, page_idx int, text string, img_path string, image_caption array<string>, list_items array<string>"


def figures(spark, *captions):
    rows = [(1, i, "image", 0, None, f"{i}.png", c, None) for i, c in enumerate(captions)]
    got = L.elements(spark.createDataFrame(rows, ITEM)).orderBy("ord").collect()
    return [(r.number, r.labeled, r.sentences) for r in got]


def test_back_fill(spark):
    assert figures(spark, None, ["Fig. 8: A.", "Fig. 9: B."]) == [(8, True, ["Fig. 8: A."]), (9, True, ["Fig. 9: B."])]


def test_back_fill_stops_at_a_label(spark):
    assert [r[:2] for r in figures(spark, ["Fig. 7: A."], ["Fig. 8: B.", "Fig. 9: C."])] == [(7, True), (8, True)]


def test_caption_goes_on(spark):
    assert figures(spark, ["note", "Fig. 1: A.", "* own", "Table 2: B."]) == [(1, True, ["Fig. 1: A. * own"])]


def test_other_items(spark):
    rows = [
        (1, 0, "equation", None, "$$ $$", None, None, None), (1, 1, "equation", 0, "$$x \\tag{4}$$", None, None, None), (1, 2, "equation", 0, "y", None, None, None),
        (1, 3, "image", 0, None, None, ["Fig. 1: A."], None), (1, 4, None, 0, "odd", None, None, None), (1, 5, "header", 0, "gone", None, None, None),
        (1, 6, "list", 0, None, None, None, ["A. B.", " ", None]), (1, 7, "list", 0, None, None, None, []), (1, 8, "image", 0, None, "p", [], None),
    ]
    got = L.elements(spark.createDataFrame(rows, ITEM), page_offset=2).orderBy("ord").collect()
    assert [(r.ord, r.element, r.number, r.text) for r in got] == [
        (1, "equation", 4, "x \\tag{4}"), (2, "equation", 1, "y"), (3, "unknown", None, "Fig. 1: A."), (4, "unknown", None, "odd"), (6, "list", None, None), (8, "figure", 2, None),
    ]
    assert got[4].sentences == ["A. B."] and {r.page for r in got} == {3}


def letters(spark, en, ja):
    r = X.repair_math(spark.createDataFrame([(en, ja)], "en_text string, ja_text string")).first()
    return r.en_text, r.ja_text


def test_letters(spark):
    assert letters(spark, "of z here", "値zの") == ("of $z$ here", "値$z$の")
    assert letters(spark, "of z", "値(zの") == ("of $z$", "値($z$の")
    assert letters(spark, "(i) and i", "値(i)の") == ("(i) and i", "値(i)の")
    assert letters(spark, "$z$ only", "値zの") == ("$z$ only", "値zの")
    assert letters(spark, "K > 5", "値K と") == ("$K$ > 5", "値$K$ と")
    assert letters(spark, None, "値z") == (None, "値z")
    assert letters(spark, "x and y, w", "値xとyとxとw") == ("$x$ and $y$, $w$", "値$x$と$y$と$x$と$w$")
    assert letters(spark, "5$ x of y", "値5$ xのy") == ("5$ x of $y$", "値5$ xの$y$")  # "$ x" is no candidate of one letter


def test_ranges(spark):
    docs = spark.createDataFrame([(1,)], "doc_id int")
    toc = spark.createDataFrame([(1, i, 1, "t", p, 12) for i, p in enumerate((1, 4, 9))], "doc_id int, toc_ord int, level int, title string, page int, page_count int")
    labels = spark.createDataFrame([(1, 3, "3"), (1, 4, "5"), (1, 1, "Cover")], "doc_id int, page int, label string")
    get = lambda **k: tuple(R.resolve_ranges(docs, page_labels=labels, **k).first())[1:]
    chapters = lambda spec: tuple(R.resolve_ranges(docs, toc=toc, chapters=spec).first())[1:]
    assert get(first_label="3", last=9) == (3, 9) and get(first_label="COV", chapters="1") == (1, None) and get() == (None, None)
    assert chapters("2") == (4, 8) and chapters("1-3") == (1, 12) and chapters("1,2") == (1, 8)
    with pytest.raises(ValueError):
        get(first=1, first_label="3")
    with pytest.raises(SparkRuntimeException):
        chapters("4")
    with pytest.raises(SparkRuntimeException):
        get(last_label="cove")
    with pytest.raises(ValueError):
        R.check_range(2, 1, 5)
    assert R.range_name(first=66, last=71) == "p66-71" and R.range_name(chapters="1,2") == "chapter1_2" and R.range_name() == "full"


def test_cache(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.range(3)

    assert fingerprint(a=1) == fingerprint(a=1, backend=None) == fingerprint(backend="pipeline", a=1) != fingerprint(a=2)
    for key in ("a", "a", "b"):
        assert cached(spark, f"file://{tmp_path}", key, make).count() == 3
    assert len(made) == 2


def test_every_page_is_written_and_read(spark, tmp_path):
    """Documents of 12, 1 and 11 pages; the last one's last page holds a header alone."""
    rows = [(i, "\n".join(f"Line {k} says it. It goes on." for k in range(n))) for i, n in ((0, 60), (1, 3), (3, 51))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pages = {(r.doc_id, r.page): r.body for r in QUERIES["page_markdown"](spark, str(tmp_path)).collect()}
    assert sorted(pages) == [(i, p) for i, n in ((0, 12), (1, 1), (3, 11)) for p in range(1, n + 1)]
    assert "Line 59 says it." in pages[0, 12] and pages[3, 11] == "\n"
    want = sorted((r.doc_id, r.page, r.tag, r.en_text) for r in units(spark, str(tmp_path)).collect())
    got = sorted((r.doc_id, r.page, r.tag, r.en_text) for r in QUERIES["parse_tagged"](spark, str(tmp_path)).collect())
    assert got == want and max(r[1] for r in got) == 12
