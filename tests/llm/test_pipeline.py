import hashlib

import corpus_pipeline
import numpy as np
import __spark_entry__
from conftest import ODD
from test_packing_and_tokens import BYTE, check_packing, library
from test_text_operators import brute_components, brute_passages

from leafspring.llm import decontaminate, quality
from leafspring.llm.queries import table


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    rows = {r.doc_id: r.text for r in docs.collect()}
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "decontamination", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, sf)
    assert good.columns == docs.columns
    model = quality.train(docs, table(spark, sf, "labels")).scorer()
    assert {r.doc_id for r in good.collect()} == {i for i, t in rows.items() if model(t)[1] >= 0.5}
    one = stages["near_duplicates"](spark, docs, sf)
    assert {r.doc_id for r in one.collect()} == {i for i, (_, c) in brute_components(rows, 5, 4, 5).items() if i == c}
    cut = stages["substrings"](spark, docs, sf)
    want = brute_passages(rows)
    assert {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in cut.collect()} == {i: hashlib.sha256((want[i][2] if want[i][1] else t).encode()).hexdigest() for i, t in rows.items()}
    index = decontaminate.SeedIndex([(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()])
    clean = stages["decontamination"](spark, docs, sf)
    assert {r.doc_id for r in clean.collect()} == {i for i, t in rows.items() if not index.matches(t, 13, 4)}


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100


CLASHING = "doc_id long, text string, kept double, p_good string, expected_grade int, _id string, _gone int, _by string, _sha string, leafspring_id int, leafspring_gone int, start long, item_id string"


def odd_tables(spark, folder, rows):
    docs = spark.createDataFrame([(i, t, 7.5, "p", k, "i", 1, "b", "s", 2, 3, 4, "x") for k, (i, t) in enumerate(rows)], CLASHING)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (5, 0, 1), (6, 0, 0), (None, 1, 1), (77, 1, 0), (12, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, " ".join(f"b{k}" for k in range(20))), (None, "x y z")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and columns that clash: each stage
    gives back rows of documents as they were."""
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [*ODD, (12, passage), (13, f"{passage} and more"), (14, " ".join(f"b{k}" for k in range(20)))]
    docs = odd_tables(spark, tmp_path, rows)
    whole = sorted(map(repr, docs.collect()))
    stages, seen = dict(corpus_pipeline.STAGES), {}
    for name in ("quality", "near_duplicates", "substrings", "decontamination"):
        out = stages[name](spark, docs, str(tmp_path))
        assert out.schema == docs.schema, name
        seen[name] = out.collect()
        assert name == "substrings" or set(map(repr, seen[name])) <= set(whole)
        assert stages[name](spark, docs.where("false"), str(tmp_path)).count() == 0
    assert len(seen["near_duplicates"]) == len(rows) - 1 and len(seen["decontamination"]) == len(rows) - 1  # 13 is a copy of 12; 14 leaks
    assert {r.doc_id: r.text for r in seen["substrings"]}[13] == "and more"
    assert [r[2:] for r in sorted(seen["substrings"], key=lambda r: r.expected_grade)] == [r[2:] for r in sorted(docs.collect(), key=lambda r: r.expected_grade)]
    assert corpus_pipeline.run(spark, str(tmp_path)).where("doc_id = 14").count() == 0


def test_run_on_empty_tables(spark, tmp_path):
    odd_tables(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_against_brute_force(spark, sf):
    """All stages one after the other, in plain Python, against run()."""
    rows = {r.doc_id: r.text for r in table(spark, sf, "documents").collect()}
    model = quality.train(table(spark, sf, "documents"), table(spark, sf, "labels")).scorer()
    rows = {i: t for i, t in rows.items() if model(t)[1] >= 0.5}
    rows = {i: rows[i] for i, (_, c) in brute_components(rows, 5, 4, 5).items() if i == c}
    cut = brute_passages(rows)
    rows = {i: cut[i][2] if cut[i][1] else t for i, t in rows.items()}
    index = decontaminate.SeedIndex([(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()])
    rows = {i: t for i, t in rows.items() if not index.matches(t, 13, 4)}
    ids = library(BYTE)
    assert check_packing(corpus_pipeline.run(spark, sf).collect(), {i: np.array([*ids(t), 0], "<u4") for i, t in rows.items()}) > 0


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and sum(n.startswith("op") for n in names) == 10
    assert set(__spark_entry__.oracle_sql()) <= set(names)
