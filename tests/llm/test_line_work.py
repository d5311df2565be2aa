"""What a line and a word cost in the line operator: both go through generated code, with the same sketches as the plain rule's."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from sectionlake.llm import line_templates as lt

BINS, SHINGLE = lt.BINS, lt.SHINGLE


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def docs_of(spark, texts: list[str | None]):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def texts_of(docs):
    return docs.groupBy(F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text")).agg(F.min("doc_id").alias("_key"))


def test_no_step_a_line_is_interpreted(spark):
    lines = lt._template_lines(docs_of(spark, ["a b c\nd 1 e"]), "doc_id", "text", 3)
    assert "lambda" not in plan(lines)
    # Texts are split and hashed below the explode, so that a text's hash isn't made again for each line.
    steps = plan(lines).split("Generate")
    assert "xxhash64(coalesce(text" not in steps[0] and "xxhash64(coalesce(text" in steps[1]


def test_no_step_a_shingle_is_interpreted(spark):
    docs = docs_of(spark, ["a b c d e f", "g h"])
    found = plan(lt._sketches(docs, "doc_id", "text", texts_of(docs)))
    assert not [line for line in found.splitlines() if "lambda" in line and ("_words" in line or "xxhash64" in line)]


def test_sketches_are_those_of_the_plain_rule(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 9)))
    texts = [" ".join(word() for _ in range(n)) for n in (0, 1, 2, 4, 5, 6, 9, 40, 150, 700)]
    texts += ["a  b\n\nc\td \x0b e\r\n f", " a b ", "\n", texts[7].replace(" ", "\n"), texts[8], None]
    docs = docs_of(spark, texts).union(docs_of(spark, texts[:9]))  # rows that repeat key and text
    shingles = []
    for text in {t or "" for t in texts}:
        words = re.split("[ \t\r\f\x0b\n]+", text)
        shingles += [(text, words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))]
    hashes: dict[int, list[int]] = {}
    for r in spark.createDataFrame(shingles, "text string, words array<string>").select(F.xxhash64("text").alias("t"), F.xxhash64("words").alias("s")).collect():
        hashes.setdefault(r["t"], []).append(r["s"])
    bounds = [(j - BINS // 2) * 2**64 // BINS for j in range(BINS)]
    plain = {t: [min([h for h in own if h >= b], default=min(own)) for b in bounds] for t, own in hashes.items()}
    rows = lt._sketches(docs, "doc_id", "text", texts_of(docs)).collect()
    assert len(rows) == len(plain)
    assert {r["_text"]: list(r["_sketch"]) for r in rows} == plain


def test_leaves_are_those_of_all_tokens(spark):
    lines = ["a b c d e", "a b", "a", " a b c", "a  b c d", "a b c ", "a\tb c\x0bd", "\t", "  ", "", "x1 b c d", "9", "é ü ö ä", "a b\r", "<*> b c d"]
    docs = docs_of(spark, ["\n".join(lines)])
    for leading in (0, 1, 3):
        found = {r["_pos"]: (r["_leaf"], r["_line"]) for r in lt._template_lines(docs, "doc_id", "text", leading).collect()}
        plain = {}
        for i, line in enumerate(lines):
            line = re.sub("[^ \t\r\f\x0b]*[0-9][^ \t\r\f\x0b]*", lt.WILD, line)
            if tokens := [t for t in re.split("[ \t\r\f\x0b]+", line) if t]:
                plain[i] = (len(tokens), tokens[:leading], line)
        rows = [(i, *x) for i, x in plain.items()]
        told = spark.createDataFrame(rows, "i int, n int, head array<string>, line string").select("i", F.xxhash64("n", "head").alias("leaf"), "line").collect()
        assert found == {r["i"]: (r["leaf"], r["line"]) for r in told}
