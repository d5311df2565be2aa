"""The pipeline's line stage: passages across unrelated texts go wherever they stand, lines of near copies stay."""

from __future__ import annotations

import random

import corpus_pipeline

PASSAGE = "all rights are kept by the makers of this text and by nobody else in the world"


def fresh(rng: random.Random, words: int = 12) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(words))


def stage(spark, texts: dict[int, str]) -> dict[int, str]:
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r["doc_id"]: r["text"] for r in corpus_pipeline.drop_lines(spark, docs, "").collect()}


def test_lines_at_edges_and_between_blank_lines(spark):
    rng = random.Random(5)
    own = {i: [fresh(rng), fresh(rng), fresh(rng)] for i in range(12)}
    texts = {i: "\n".join([a, "", PASSAGE, "", b, c, "Licensed under the terms of the common book"]) for i, (a, b, c) in own.items()}
    assert stage(spark, texts) == {i: "\n".join([a, "", "", b, c]) for i, (a, b, c) in own.items()}


def test_blocks_of_several_lines(spark):
    rng = random.Random(6)
    block = [PASSAGE, fresh(rng), fresh(rng)]
    own = {i: [fresh(rng, 30), fresh(rng, 30), fresh(rng, 30)] for i in range(12)}
    texts = {i: "\n".join([a, *block, b, c]) for i, (a, b, c) in own.items()}
    assert stage(spark, texts) == {i: "\n".join(lines) for i, lines in own.items()}


def test_near_copies_neither_save_a_passage_nor_lose_their_own_lines(spark):
    rng = random.Random(7)
    base = [fresh(rng, 60) for _ in range(6)]
    copies = {i: [*base[:5], f"{base[5]} {fresh(rng, 1)}"] for i in range(60)}
    others = {100 + i: [fresh(rng, 30) for _ in range(6)] for i in range(10)}
    texts = {i: "\n".join([*lines[:3], PASSAGE, *lines[3:]]) for i, lines in (copies | others).items()}
    assert stage(spark, texts) == {i: "\n".join(lines) for i, lines in (copies | others).items()}
