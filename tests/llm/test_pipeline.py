"""The pipeline's stages against plain versions of them, each on its own input."""

import random

import pytest

import corpus_pipeline
from loomgraph.llm import queries
from tests.llm.test_llm_operators import DOCS, odd_rows, plain_components, plain_lines, prose

NAMES = [f.name for f in DOCS.fields]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    d = tmp_path_factory.mktemp("sf")
    shared = "a line that stands in many documents of this table"
    items = [(k, prose(5000 + k, 30)) for k in range(3)]
    rows = []
    for k in range(60):
        text = prose(k, r.randint(20, 120))
        if k % 5 == 0:
            text += "\n" + shared
        if k % 9 == 0:
            text += " " + items[k % 3][1]
        rows.append((k, text, ("en", "de")[k % 2], "abc"[k % 3], len(text)))
    rows += [(100 + k, rows[k][1] + " tail", "en", "a", 1) for k in range(1, 12)]
    rows += [(200, None, "en", "a", 0), (201, "12 34 --", "en", "a", 8), (202, "", "en", "b", 0)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), items


def plain(rows):
    return sorted((str(r["doc_id"]), r["text"]) for r in rows)


def test_each_stage_does_as_the_plain_one(spark, folder):
    d, items = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        out = stage(spark, docs, d)
        if name == "mix":
            assert out.columns == [*NAMES, "size", "target", "copies"]
            break
        assert out.columns == NAMES
        rows = out.collect()
        if name == "language":
            assert sorted({r[0] for r in before} - {r["doc_id"] for r in rows}) == [200, 201, 202]
        elif name == "lines":
            assert plain(rows) == [x[:2] for x in plain_lines(before)] and all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "near copies":
            whole = plain_components(before, 5, 80)
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, c in whole.items() if i == c)
        elif name == "benchmark":
            leaked = {r[0] for r in before if any(t in r[1] for _, t in items)}
            assert leaked and {r["doc_id"] for r in rows} == {r[0] for r in before} - leaked
        seen.append(name)
        docs = spark.createDataFrame([tuple(r) for r in rows], DOCS)
    kept = out.collect()
    assert seen == ["language", "lines", "near copies", "benchmark"] and all(1 <= r["copies"] <= 3 for r in kept)
    again = corpus_pipeline.run(spark, d).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in again) == sorted((r["doc_id"], r["copies"]) for r in kept)


def test_stages_take_odd_and_no_rows(spark, folder):
    d, _ = folder
    for rows in (odd_rows(), []):
        docs = spark.createDataFrame(rows, DOCS)
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, d).count() <= 3 * max(len(rows), 1)


def test_near_copies_go_by_their_own_texts(spark):
    a, b = prose(71, 60), prose(72, 60)
    rows = [(3, b, "en", "a", 1), (7, a, "en", "a", 1), (7, b, "en", "a", 1), (9, a, "en", "a", 1), (None, a, "en", "a", 1)]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((str(r["doc_id"]), r["text"] == a) for r in out) == [("3", False), ("7", True), ("None", True)]


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
