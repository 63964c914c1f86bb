"""The pipeline's stages on a small table."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    from test_operators import words

    rng, top = random.Random(9), str(tmp_path_factory.mktemp("sf"))
    base = words(rng, 200)
    near = base.split()
    near[50] = "changed"
    passage = words(rng, 60)
    texts = [base, base.replace(" ", "  "), " ".join(near), f"{words(rng, 50)} {passage} {words(rng, 50)}", f"{words(rng, 50)} {passage} {words(rng, 50)}"]
    texts += [words(rng, 100) for _ in range(200)] + ["".join(f"{w}$$$ " for w in words(rng, 80).split()) for _ in range(200)] + [None]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i < 205), 0) for i in range(3, 405)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    return top


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
        kept[k] = {r.doc_id: r.asDict() for r in docs.collect()}
    assert {0, 1, 2, 3, 4} <= set(kept[0]) and len([i for i in kept[0] if 205 <= i < 405]) < 10 and len([i for i in kept[0] if i < 205]) > 195
    assert 0 in kept[1] and 1 not in kept[1] and 2 in kept[1]
    assert 0 in kept[2] and 2 not in kept[2]
    assert kept[3][3]["text"] == kept[2][3]["text"] and len(kept[3][4]["text"]) < len(kept[2][4]["text"]) - 300
    assert kept[3][4]["n_chars"] == len(kept[3][4]["text"])
    assert set(kept[4]) == set(kept[3])
    assert corpus_pipeline.run(spark, folder).count() == docs.count()
