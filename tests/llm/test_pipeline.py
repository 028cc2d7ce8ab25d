"""The pipeline's stages on planted rows, each against a plain version of its rule."""

import random

import pytest
from pyspark.sql import functions as F
from test_operators import brute_groups, brute_lines, family, lm_path, toxic_rows

import corpus_pipeline as P
from weft.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Calm and toxic documents, a line that many share, near copies, nulls and empty texts."""
    rng = random.Random(8)
    rows = toxic_rows()
    docs = [(i, t + ("\nShared line" if i % 5 == 0 else ""), g, rng.choice("aab"), len(t)) for i, t, g, _ in rows]
    copies = [(1000 + i, t, "en", "b", len(t)) for i, t in enumerate(family(30, 4))]
    edges = [(2000, None, "en", "a", None), (2001, "", None, None, 0), (2002, "Shared line", "de", "a", 11)]
    at = tmp_path_factory.mktemp("data")
    spark.createDataFrame(docs + copies + edges, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, y) for i, _, _, y in rows], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.fixture(scope="module")
def states(spark, folder):
    """The documents before each stage, and the last result."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for _, stage in P.STAGES:
        docs = stage(spark, out[-1] if out else docs, folder)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
    return [spark.read.parquet(f"{folder}/documents.parquet"), *out]


def test_all_but_the_last_keep_the_columns(states):
    assert all(s.columns == states[0].columns for s in states[:5]) and [n for n, _ in P.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]


def test_toxic_documents_go_and_clean_ones_stay(spark, folder, states):
    toxic = {r.doc_id for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    before, after = ({r.doc_id for r in s.collect()} for s in states[:2])
    assert len((before - after) ^ toxic) <= 0.03 * len(toxic) and {2000, 2001} <= after


def test_common_lines_go(states):
    before, after = states[1].collect(), {r.doc_id: r.text for r in states[2].collect()}
    want = brute_lines([r.text for r in before], 10)
    assert sum(d for _, d, _ in want) > 20 and not any("Shared line" in (t or "") for i, t in after.items() if i != 2002)
    assert set(after) == {r.doc_id for r in before} and after[2000] is None and after[2002] == "Shared line"  # nothing else would be left of it


def test_one_of_each_group_stays(states):
    data = [(r.doc_id, r.text) for r in states[2].collect()]
    want = sorted(d for d, _, c in brute_groups(data, 5, 80) if d == c)
    assert sorted(r.doc_id for r in states[3].collect()) == want and len(want) < len(data)


def test_the_mix_takes_documents_as_often_as_its_words(states):
    times = {r.doc_id: r.n for r in states[4].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    for r in mixing.mix(states[3]).collect():
        assert times.get(r.doc_id, 0) == (1 if r["size"] == 0 else int(r.taken / r["size"] + 0.5))


def test_texts_are_encoded_as_the_library_does(states):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(lm_path())
    texts = {r.doc_id: r.text or "" for r in states[4].collect()}
    found = states[5].collect()
    assert len(found) == states[4].count() and all(list(r.ids) == lib.encode(texts[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids) for r in found)


def test_run_is_all_stages(spark, folder, states):
    key = lambda df: sorted((r.doc_id, list(r.ids)) for r in df.collect())
    assert key(P.run(spark, folder)) == key(states[5])


def test_one_of_each_group_of_copies_reaches_the_mix(spark):
    texts = ["A first line of it\nand a second one"] * 12 + ["A first LINE of it  \nand a second one\n"] * 3 + ["One line that is all there is"] * 11 + [f"Shared line\nown line {k}" for k in range(10)]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], SCHEMA)
    lines = P.drop_lines(spark, docs, "")
    found = {r.doc_id: r.text for r in lines.collect()}
    assert found == {i: t.removeprefix("Shared line\n") for i, t in enumerate(texts)}
    kept = {r.text for r in P.drop_near_duplicates(spark, lines, "").collect()}
    assert {texts[0], texts[15]} <= kept and len(kept) == 12


@pytest.mark.parametrize("empty", ["documents", "labels"])
def test_empty_tables_pass_through(spark, tmp_path, empty):
    docs = [(i, f"A text of some words, number {i}", "en", "a", 20) for i in range(6)] if empty == "labels" else []
    marks = [(i, i % 2) for i in range(6)] if empty == "documents" else []
    spark.createDataFrame(docs, SCHEMA).withColumns({"score": F.lit("clash"), "taken": F.lit(None).cast("map<string,int>"), "ids": F.lit(1)}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert {r.doc_id for r in P.run(spark, str(tmp_path)).collect()} <= {d[0] for d in docs}
    if empty == "labels":
        assert {r.doc_id for r in P.drop_toxic(spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).collect()} == set(range(6))
