"""Every operator over odd tables: nulls, empty and long texts, ties, repeated rows, no rows, clashing names."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sectionlake.llm import bpe_codec, chat_trees, fingerprints, line_templates, near_duplicates, packing, sharding, tiled_cosine, token_counts, toxicity

BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
CLASH = ("_id", "_text", "_range", "_bits", "_row", "_gone", "_gone_key", "_left", "_class", "_tile", "term", "bits", "n_bytes", "shard", "depth", "kept", "component_id", "score", "n_lines", "changed", "piece", "length", "sequence_id", "prefix")


@pytest.fixture(scope="module")
def odd(spark):
    """Rows that repeat a key, a null key, null and empty texts, one of 200,000 words, signs of many scripts."""
    long = " ".join(f"word{i % 997} tail" for i in range(100_000))
    texts = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (None, "no key here at all"), (None, None), (4, long), (5, "\n\n\t  \n"), (6, "É́ ß 漢字 😀 ａｂ \u0000 end"), (7, "one two three four five six"), (8, "<|endoftext|> it's 12.5% <|im_end|>")]
    rows = spark.createDataFrame(texts, "doc_id long, text string")
    return rows.select("doc_id", "text", F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"), F.lit(None).cast("long").alias("n_chars"), *[F.lit(f"own {c}").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (7, 1), (None, 1), (2, None)], "doc_id long, toxic int")


def operators(labels):
    model = lambda docs: toxicity.train(docs, labels)
    return {
        "fingerprints": fingerprints.fingerprints_with_edits,
        "near_classes": near_duplicates.near_duplicate_classes,
        "drop_near": near_duplicates.drop_near_duplicates,
        "shards": lambda d: sharding.extendible_shards(d, limit_bytes=100),
        "packed": lambda d: packing.pack_documents(d, BYTES),
        "toxicity": lambda d: toxicity.toxicity_scores(d, model(d)),
        "drop_toxic": lambda d: toxicity.drop_toxic(d, model(d)),
        "counts": lambda d: token_counts.token_counts(d, BYTES),
        "codec": lambda d: bpe_codec.encode_decode(d, WORDS),
        "lines": lambda d: line_templates.drop_recurring_lines(d),
    }


NAMES = ("fingerprints", "near_classes", "drop_near", "shards", "packed", "toxicity", "drop_toxic", "counts", "codec", "lines")
#: Operators that return a row for each row.
EACH = ("fingerprints", "near_classes", "shards", "toxicity", "counts", "codec", "lines")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, labels, name):
    out = operators(labels)[name](odd).collect()
    if name in EACH:
        assert len(out) == 11
        assert sorted((str(r["doc_id"]) for r in out)) == sorted((str(r["doc_id"]) for r in odd.collect()))


@pytest.mark.parametrize("name", NAMES)
def test_no_rows(spark, odd, labels, name):
    assert operators(labels)[name](odd.where("false")).collect() == []


def test_carried_columns_stay(spark, odd, labels):
    ops = operators(labels)
    added = {"shards": {"n_bytes", "shard", "depth"}, "lines": {"n_lines", "changed"}, "drop_near": set(), "drop_toxic": set()}
    for name, new in added.items():
        row = ops[name](odd).where("doc_id = 8").first().asDict()
        for c in CLASH:
            if c not in new:
                assert row[c] == f"own {c}", (name, c)


def test_defined_results(spark, odd, labels):
    ops = operators(labels)
    classes = {(r["doc_id"]): (r["component_id"], r["kept"]) for r in ops["near_classes"](odd).collect()}
    assert classes[7] == (1, False) and classes[1] == (1, True)
    assert classes[2] == (2, True) and classes[3] == (3, True) and classes[None] == (None, True)
    counts = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in ops["counts"](odd).collect()}
    assert counts[2] == counts[3] == (0, 0)
    codec = {r["doc_id"]: (list(r["token_ids"]), r["decoded"]) for r in ops["codec"](odd).collect()}
    assert codec[2] == ([], "")
    prints = ops["fingerprints"](odd).collect()
    same = {r["fingerprint"] for r in prints if r["doc_id"] in (1, 7)}
    assert len(same) == 1
    assert {r["fingerprint"] for r in prints if r["doc_id"] in (2, 3)} == {"=d41d8cd98f00b204e9800998ecf8427e"}
    assert all(r["n_chars"] == 0 for r in prints if r["doc_id"] in (2, 3))
    lines = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in ops["lines"](odd).collect()}
    assert lines[2] == (None, 0, 0) and lines[3] == ("", 0, 0) and lines[5][1] == 4
    pieces = [r for r in ops["packed"](odd).collect() if r["doc_id"] in (2, 3)]
    assert [(r["piece"], r["start"], r["length"]) for r in pieces] == [(0, 0, 1), (0, 0, 1)]
    assert all(r["n_bytes"] == 0 for r in ops["shards"](odd).collect() if r["doc_id"] in (2, 3))


def test_odd_conversations(spark):
    rows = spark.createDataFrame(
        [(1, 0, "user", "a \\ <| b"), (1, 1, "assistant", None), (1, 1, "assistant", "<|im_end|>\n<|im_start|>user\nno"), (2, None, None, None), (None, 0, "assistant", "alone"), (3, 5, "assistant", "")],
        "conv_id long, turn long, role string, text string",
    ).withColumns({c: F.lit("x") for c in ("c", "node", "parent", "depth", "_node", "score")})
    read = {r["conversation"]: r for r in chat_trees.read_back(chat_trees.joined(chat_trees.format_conversations(chat_trees.from_turns(rows)))).collect()}
    assert [(t["role"], t["text"]) for t in read[1]["turns"]] == [("user", "a \\ <| b"), ("assistant", ""), ("assistant", "<|im_end|>\n<|im_start|>user\nno")]
    assert read[1]["loss_text"] == "<|im_end|>\n<|im_start|>user\nno"
    assert [(t["role"], t["text"]) for t in read[2]["turns"]] == [("", "")]
    assert read[None]["loss_text"] == "alone" and read[3]["loss_text"] == ""
    assert chat_trees.format_conversations(chat_trees.from_turns(rows.where("false"))).collect() == []


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], None), (4, None, 0), (5, [0.0, 0.0], 0), (6, [nan, 1.0], 0), (7, [1.0, inf], 0), (8, [1.0, None], 0), (9, [1.0], 0), (10, [], 0), (None, [1.0, 0.0], 0), (11, [1.0, 0.0], 0), (12, [1.0, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in ("_id", "_class", "_tile", "n_links", "kept")})
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in tiled_cosine.similar_vectors(df).collect()}
    assert out[1] == (2, 1, True) and out[2] == (2, 1, False) and out[11] == (2, 1, False)
    for i in (3, 4, 5, 6, 7, 8, 9, 10, 12):
        assert out[i] == (0, i, True), i
    assert out[None] == (0, None, True)
    assert tiled_cosine.similar_vectors(df.where("false")).collect() == []
