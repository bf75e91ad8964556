"""The pipeline's stages: what goes, what stays, and the columns."""

from __future__ import annotations

import base64
import re

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_operators import PLAIN, brute_components

from quillspark.llm import mixing, pii, queries, toxicity

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, FOLDER).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_columns_stay(spark, stages):
    columns = spark.read.parquet(f"{FOLDER}/documents.parquet").columns
    assert [after.columns == columns for _, _, after in stages] == [True] * 4 + [False]


def test_toxic_documents_go(spark, stages):
    """Against a score added up in plain Python from the trained table."""
    _, before, after = stages[0]
    model = toxicity.fit(before, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    kept = set()
    for r in before.collect():
        values = [max(parts) for word in set((r.text or "").lower().split()) if (parts := [np.mean(model.rows[toxicity.bag(part)]) for part in toxicity.parts_of(word)])]
        if model.bias + (max(values) + np.mean(values) if values else 0) < 0:
            kept.add(r.doc_id)
    assert kept == {r.doc_id for r in after.collect()}


def test_one_of_each_group_stays(stages):
    """Against components over all pairs of sets."""
    _, before, after = stages[1]
    docs = sorted((r.doc_id, r.text) for r in before.collect())
    _, parent = brute_components([text for _, text in docs])
    kept = {docs[k][0] for k in range(len(docs)) if parent[k] == k}
    assert kept == {r.doc_id for r in after.collect()} and len(kept) < len(docs)


def test_no_personal_data_stays(stages):
    _, before, after = stages[2]
    assert before.count() == after.count()
    assert pii.find(after).where("n_email + n_card + n_phone + n_ip > 0").count() == 0
    old = {r.doc_id: r.text for r in before.collect()}
    for r in after.collect():
        assert ("[EMAIL]" in r.text) == (re.search(PLAIN["email"], old[r.doc_id]) is not None) or "[EMAIL]" in old[r.doc_id]


def test_mix_takes_what_sql_says(spark, stages):
    _, before, after = stages[3]
    con = duckdb.connect()
    con.register("documents", before.toPandas())
    taken = {r[0]: r[4] // r[1] for r in con.execute(mixing.ORACLE).fetchall() if r[1] and r[4]}
    assert taken == {r.doc_id: r.n for r in after.where("text rlike '[^ \\t\\n\\r]'").groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}


def test_encoding_equals_tiktoken(stages):
    _, before, after = stages[4]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(queries.VOCABULARY), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(r.token_ids == encoding.encode_ordinary(texts[r.doc_id]) for r in after.collect())


ROWS = [(1, "same words here in a row now", "en", "a", 5), (1, "same words here in a row now", "en", "a", 5), (5, "same words here in a row now", "en", None, 5), (5, "quite another text with its own words", None, "b", 1), (None, None, None, None, None), (7, "", "en", "a", 0), (7, "", "en", "a", 0), (8, "long " * 40_000 + "end", "en", "b", 9)]


@pytest.mark.parametrize("stage", range(5))
def test_odd_rows(spark, stage):
    """Nulls, empties, repeats, a long text, clashing columns, and an empty table."""
    name, run = corpus_pipeline.STAGES[stage]
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    more = ["row", "score", "toxicity_score", "number", "mix_source", "mix_copies", "pii_row", "spans", "component_id", "kept", "size", "class"]
    clash = docs.selectExpr("*", *(f"'own' as {c}" for c in more))
    found = run(spark, clash, FOLDER)
    if stage < 4:
        assert found.columns == clash.columns and all(r[c] == "own" for r in found.collect() for c in more)
    kept = sorted((r.doc_id or 0, len(r.text or "") if stage < 4 else 0) for r in found.collect())
    if stage in (0, 2):
        assert [k for k, _ in kept] == [0, 1, 1, 5, 5, 7, 7, 8]
    if stage == 1:
        assert kept == [(0, 0), (1, 28), (5, 37), (7, 0), (7, 0), (8, 200_003)]
    if stage == 4:
        assert len(kept) == len(ROWS)
    assert run(spark, docs.where("false"), FOLDER).count() == 0


def test_run_equals_the_stages(spark, stages):
    last = stages[4][2].select("doc_id", "ids_sha256")
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).select("doc_id", "ids_sha256").collect())) == sorted(map(tuple, last.collect()))
