"""Each stage of the pipeline against what it must do to its own input."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

MODEL = corpus_pipeline.MODEL


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: f"w{rng.randint(0, 2000)}"
    passage = " ".join(word() for _ in range(60))
    rows = []
    for i in range(240):
        words = [word() for _ in range(80)]
        if i % 8 == 1:
            words[5], words[50] = "vile", "nasty"
        text = " ".join(words)
        if i % 30 == 2:
            text += "\n" + passage
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
    rows += [(240, rows[10][1], "en", "s0", 1), (241, rows[11][1] + " extra", "en", "s1", 1), (242, None, None, None, None), (243, "", "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 8 == 1)) for i in range(240) if i % 3], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path), passage


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no model file")
def test_stages(spark, tables, tmp_path):
    sf_dir, passage = tables
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == docs.columns and out.schema == docs.schema
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        kept.append({r["doc_id"]: r for r in docs.collect()})
    toxic, lines, near, mixed, coded = kept
    assert not [i for i in toxic if i < 240 and i % 8 == 1] and len(toxic) == 244 - 30
    assert sum(passage in (r["text"] or "") for r in lines.values()) == 1
    assert 240 not in lines  # nothing of an exact copy is left
    assert set(near) == set(lines) - {241}
    assert all(r["n_chars"] == len(r["text"]) for r in mixed.values())
    assert set(mixed) <= set(near) and set(coded) == set(mixed)
    assert all(r["parity"] and r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in coded.values())
    assert corpus_pipeline.run(spark, sf_dir).agg(F.sum("n_tokens")).first()[0] == docs.agg(F.sum("n_tokens")).first()[0]
