"""Stored queries and searches over tables that other sizes bring: missing turns, exact ties, repeated rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sectionlake.functions import scoring
from sectionlake.operators import lexical
from sectionlake.plans.engine import QueryError
from sectionlake.plans.ingest import import_sections
from sectionlake.queries import lexical as searches
from sectionlake.queries import stored
from tests.conftest import SMALL, check_against_sql


@pytest.fixture(scope="module")
def short(spark, tmp_path_factory):
    """conversations whose third one has two turns."""
    at = tmp_path_factory.mktemp("short")
    rows = spark.read.parquet(f"{SMALL}/conversations.parquet").where((F.col("conv_id") != 3) | (F.col("turn") < 2))
    rows.coalesce(1).write.parquet(f"{at}/conversations.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["store_read", "store_neighbours"])
def test_a_turn_that_is_missing_gives_no_rows(spark, short, name):
    check_against_sql(spark, stored.QUERIES[name], stored.ORACLE_SQL[name], short)
    with pytest.raises(QueryError):
        stored.stored(spark, short, "turns").read(stored.ASKED)


def test_sums_of_a_batch_do_not_depend_on_order(spark):
    parts = [1e9] + [0.1] * 1000
    total = lambda rows: spark.createDataFrame([(x,) for x in rows], "x double").coalesce(1).agg(scoring.exact_sum(F.col("x")), F.sum("x")).first()
    up, down = total(parts), total(parts[::-1])
    assert up[0] == down[0] and up[1] != down[1] and abs(up[0] - up[1]) < 1e-9 * up[0]


@pytest.fixture(scope="module")
def few(spark):
    rows = [("a#0", "a", "a a a", "A b a a b"), ("b#0", "b", "", "b a x"), ("c#0", "c", "", ""), ("d#0", "d", "x", "no a.b here")]
    return spark.createDataFrame(rows, "id string, path string, heading_path string, text string")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_grouped_within_rows(few):
    found = {(r["id"], r["term"]): (r["length"], r["heading_at"], r["text_at"]) for r in lexical.postings_of(few).collect()}
    assert found[("a#0", "a")] == (8, [0, 1, 2], [0, 2, 3]) and found[("a#0", "b")] == (8, [], [1, 4]) and found[("d#0", "a.b")] == (4, [], [1])
    assert len(found) == 9 and "Exchange" not in plan(lexical.postings_of(few)) and "Aggregate" not in plan(lexical.postings_of(few))


def test_search_without_a_store_ranks_as_postings_do(few):
    n, tokens = lexical.corpus_size(few)
    for words in (["a", "a"], ["b", "a"], ["x"], ["a.b", "here"], ["zzz", "a"]):
        want = lexical.ranked(lexical.postings_of(few), n, tokens / n, words)
        assert sorted(map(tuple, lexical.search_sections(few, words).collect())) == sorted(map(tuple, want.collect()))
        assert "Exchange" not in plan(lexical.scanned(few, words))


@pytest.mark.parametrize("name", ["postings", "term_stats"])
def test_rows_that_repeat_an_id(spark, tmp_path, name):
    rows = spark.read.parquet(f"{SMALL}/documents.parquet").where("doc_id < 20")
    rows.unionByName(rows.where("doc_id % 3 = 0")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    check_against_sql(spark, searches.QUERIES[name], searches.ORACLE_SQL[name], str(tmp_path))


def test_term_stats_shuffle_terms_alone(few):
    assert {r["term"]: (r["df"], r["occurrences"]) for r in lexical.term_stats(few).collect()} == {"a": (2, 4), "b": (2, 3), "x": (1, 1), "no": (1, 1), "a.b": (1, 1), "here": (1, 1)}
    assert plan(lexical.term_stats(few)).count("Exchange") == 1


def test_import_keeps_counts(spark, few, tmp_path):
    rows = few.select("path", F.lit(0).alias("ordinal"), "heading_path", F.lit("prose").alias("kind"), "text")
    snapshot = import_sections(spark, rows, str(tmp_path / "s"))
    assert (snapshot.n_sections, snapshot.manifest["tokens"]) == lexical.corpus_size(few)
    assert {r["term"]: r["df"] for r in snapshot.table("terms").collect()} == {"a": 2, "b": 2, "x": 2, "no": 1, "a.b": 1, "here": 1}
    assert sorted(map(str, snapshot.table("postings").collect())) == sorted(map(str, lexical.postings_of(few).collect()))
