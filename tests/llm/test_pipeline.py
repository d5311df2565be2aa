"""The pipeline's stages against plain versions over a small corpus, and their columns."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from sectionlake.llm import toxicity
from tests.conftest import SMALL
from tests.llm.test_against_plain import brute_classes


def test_stages(spark, tmp_path):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "packing"]
    source = spark.read.parquet(f"{SMALL}/documents.parquet")
    docs, kept = source, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == source.columns and docs.dtypes == source.dtypes
        kept.append({r["doc_id"]: r.asDict() for r in docs.collect()})
    texts = {r["doc_id"]: r["text"] or "" for r in source.collect()}
    model = toxicity.train(source, spark.read.parquet(f"{SMALL}/labels.parquet"))
    clean = {k for k, t in texts.items() if model.probability([t])[0] < toxicity.THRESHOLD}
    assert set(kept[0]) == clean
    assert set(kept[1]) == clean
    assert all(r["n_chars"] == len(r["text"]) for r in kept[1].values() if r["text"] != texts[r["doc_id"]])
    lines = {k: r["text"] or "" for k, r in kept[1].items()}
    assert set(kept[2]) == {k for k, c in brute_classes(lines).items() if k == c}
    assert set(kept[3]) == set(kept[2])
    run = {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert run == {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in docs.collect()}


def test_empty_documents(spark, tmp_path):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").where(F.lit(False))
    docs = empty
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() == 0


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    """Null and repeated keys, null, empty and long texts, and extra columns with names that operators use themselves."""
    long = " ".join(f"word{i % 997} tail" for i in range(30_000))
    texts = [(1, "one two three four five six"), (1, "one two three four five six"), (1, "another text of the same key"), (2, None), (3, ""), (None, "no key here at all"), (None, None), (4, long), (5, "\n\n\t  \n"), (7, "one two three four five six")]
    names = ("_id", "_text", "_key", "_row", "_class", "_low", "_gone", "kept", "n_lines", "score", "piece", "length")
    rows = spark.createDataFrame(texts, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))
    docs = rows.select("*", *[F.lit(f"own {c}").alias(c) for c in names if c != "n_lines"])
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert name == "packing" or out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        if name != "packing":
            assert all(r[c] == f"own {c}" for r in seen[name] for c in names if c != "n_lines")
    assert len(seen["toxicity"]) == len(seen["line_dedup"]) == 10
    kept = sorted(((r["doc_id"], r["text"]) for r in seen["near_dedup"]), key=str)
    assert kept == sorted(((k, t) for k, t in [texts[0], *texts[2:9]]), key=str)
    assert sorted(str(r["doc_id"]) for r in seen["packing"] if r["piece"] == 0) == sorted(str(k) for k, _ in kept)
