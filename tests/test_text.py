"""Text expressions against plain Python and SQLite's own full-text search."""

from __future__ import annotations

import random
import re
import sqlite3
import unicodedata

import pytest
from pyspark.sql import functions as F

from sectionlake.functions import text
from sectionlake.operators import lexical

TEXTS = ["", "--no-cache flag. Use tx-4419, 3.12!", "_a_ __b -c- ...", "naïve Ésope über œuvre", "a\nb\r\nc\x0bd\x1ee f\n", "  spaced out \t x ", "tool.uv.sources -.-x-.- (-a-(-b", "Ünï-cödé_9 ٣ Ⅷ ²", "x" * 50 + "-"]


def column(spark, make, texts=TEXTS):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", make(F.col("t")).alias("x")).collect()
    return [r["x"] for r in sorted(rows)]


def test_normalise_and_query_tokens(spark):
    lead, trail = re.compile(r"(?<![\w.\-])[-_.]+(?=\w)"), re.compile(r"(?<=\w)[-_.]+(?![\w.\-])")
    assert column(spark, text.normalise) == [trail.sub("", lead.sub("", t)) for t in TEXTS]
    assert column(spark, text.query_tokens) == [lexical.words_of(t) for t in TEXTS]
    assert lexical.words_of("--No-Cache 3.12. the THE") == ["no-cache", "3.12", "the", "the"]


def test_lines_strip_collapse(spark):
    assert column(spark, text.lines) == [t.splitlines() for t in TEXTS]
    assert column(spark, text.strip) == [t.strip() for t in TEXTS]
    assert column(spark, text.collapse) == [" ".join(t.split()) for t in TEXTS]


def test_fold(spark):
    every = "".join(map(chr, range(0xC0, 0x250)))
    got = column(spark, lambda c: text.fold(F.lower(c)), [every])[0]
    assert got.startswith("aaaaaa") and "é" not in got and "ł" in got
    assert all(unicodedata.normalize("NFD", c)[0] == c for c in got if c.islower())


@pytest.mark.parametrize("glob", ["*", "a/*", "a/?.md", "[ab]/x*", "[^a]*", "[!a]*", "*.md", "a.b", "x[", "[]a]*", "[a-c]?"])
def test_globs_match_as_sqlite_does(spark, glob):
    paths = ["a", "a/x.md", "a/b/x.md", "b/xy", "axb", "a.b", "x[", "!a", "]q", "A/x.md", "ca"]
    con = sqlite3.connect(":memory:")
    want = [bool(con.execute("SELECT ? GLOB ?", (p, glob)).fetchone()[0]) for p in paths]
    assert column(spark, lambda c: c.rlike(text.glob_pattern(glob)), paths) == want


def test_path_filters(spark):
    paths = ["docs/a.md", "docs", "docs2/a.md", "Docs/a.md"]
    assert column(spark, lambda c: text.path_filter(c, ["docs/"]), paths) == [True, False, False, False]
    assert column(spark, lambda c: text.path_filter(c, ["docs"]), paths) == [True, True, False, False]
    assert column(spark, lambda c: text.prefix_filter(c, "DOCS"), paths) == [True] * 4
    assert text.path_filter(F.lit("x"), []) is None
    with pytest.raises(text.FilterError):
        text.path_filter(F.lit("x"), [""])


def full_text(sections):
    """SQLite's index over normalised headings and texts."""
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(id UNINDEXED, h, t, tokenize=\"unicode61 remove_diacritics 2 tokenchars '-_.'\")")
    lead, trail = re.compile(r"(?<![\w.\-])[-_.]+(?=\w)"), re.compile(r"(?<=\w)[-_.]+(?![\w.\-])")
    norm = lambda t: trail.sub("", lead.sub("", t))
    con.executemany("INSERT INTO f VALUES (?, ?, ?)", [(i, norm(h), norm(t)) for i, h, t in sections])
    return con


def fts_search(con, query, limit):
    tokens = lexical.words_of(query)
    quoted = ['"' + t + '"' for t in tokens]
    passes = ([f'"{" ".join(tokens)}"', " AND ".join(quoted)] if len(tokens) > 1 else []) + [" OR ".join(quoted)]
    out: dict = {}
    for q in passes:
        for i, score in con.execute("SELECT id, -bm25(f, 0.0, 2.0, 1.0) AS s FROM f WHERE f MATCH ? ORDER BY bm25(f, 0.0, 2.0, 1.0), id LIMIT ?", (q, limit)):
            if len(out) < limit:
                out.setdefault(i, round(score, 6))
    return list(out.items())


def test_search_ranks_as_sqlite_does(spark):
    rng = random.Random(11)
    words = ["refund", "window", "tx-4419", "é", "the", "no-cache", "3.12", "-", "policy", "---", "Über", "a_b", "rare"]
    pick = lambda n: " ".join(rng.choices(words[:-1], weights=range(12, 0, -1), k=n))
    rows = [(f"d{i}.md#0", f"d{i}.md", pick(rng.randint(1, 4)), pick(rng.randint(1, 60))) for i in range(120)]
    rows[7] = ("d7.md#0", "d7.md", "rare heading", pick(20))
    sections = spark.createDataFrame(rows, "id string, path string, heading_path string, text string")
    postings = lexical.postings_of(sections).cache()
    n, tokens = lexical.corpus_size(sections)
    con = full_text([(i, h, t) for i, _, h, t in rows])
    for query in ("refund window", "TX-4419", "the the policy", "rare", "über é", "no-cache 3.12 a_b", "nothing here", "policy -- refund"):
        got = [(r["id"], round(r["score"], 6)) for r in lexical.top(lexical.ranked(postings, n, tokens / n, lexical.words_of(query)), 15).collect()]
        want = fts_search(con, query, 15)
        assert [i for i, _ in got] == [i for i, _ in want], query
        assert all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got, want)), query
    postings.unpersist()


def test_snippets():
    body = "# Refund window\n\nCustomers may ask for a refund. " + "filler words go on " * 20 + "The refund window is 30 days here."
    out = lexical.snippet(body, ["refund", "window"])
    assert "**Refund** **window**" in out and out.endswith("…") and not out.startswith("…")
    assert len(re.findall(r"[\w.\-]+", out)) == lexical.WINDOW_TOKENS
    late = lexical.snippet("filler words go on " * 20 + "the odd-one out.", ["odd-one"])
    assert late.startswith("…") and late.endswith("**odd-one** out.")
    assert lexical.snippet("nothing to mark", ["x"]) == "nothing to mark" and lexical.snippet("", ["x"]) == ""
