"""Near-duplicate dedup where keys repeat, shingles repeat, and many rows share one text."""

from __future__ import annotations

from sectionlake.llm import near_duplicates
from sectionlake.llm.common import components, spread_join


def text(sign: str, words: int = 50) -> str:
    return " ".join(f"{sign}{i}" for i in range(words))


def test_rows_that_repeat_a_key_lose_no_other_text(spark):
    rows = [(1, text("a")), (2, text("a")), (2, text("b")), (3, text("c")), (3, text("c")), (None, text("a")), (4, ""), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(((r["doc_id"], r["text"]) for r in near_duplicates.drop_near_duplicates(docs).collect()), key=str)
    assert kept == sorted([(1, text("a")), (2, text("b")), (3, text("c")), (None, text("a")), (4, ""), (4, "")], key=str)


def test_counts_of_shingles_weigh(spark):
    """One of the texts repeats a part ten times: the sets of shingles are alike, the weighted ones aren't."""
    base, part = text("w", 200), text("p", 30)
    docs = spark.createDataFrame([(1, f"{base} {part}"), (2, f"{base} {' '.join([part] * 10)}"), (3, f"{base} {part} more")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates.near_duplicate_classes(docs).collect()} == {1: 1, 2: 2, 3: 1}


def test_a_hot_key_is_dealt_over_tasks_and_loses_nothing(spark):
    rows = spark.range(5000).selectExpr("if(id < 2000, 0, id) AS k", "id AS v").cache()
    groups = rows.groupBy("k").count().selectExpr("k", "count AS n", "k * 2 AS twice")
    got = spread_join(rows, groups, "k", "n", 5000, ["v"])
    assert sorted((r["k"], r["v"], r["twice"]) for r in got.collect()) == [(0 if i < 2000 else i, i, 0 if i < 2000 else 2 * i) for i in range(5000)]
    assert spread_join(rows, groups.where("k = 0"), "k", "n", 5000, ["v"], "left_semi").count() == 2000


def test_components_of_a_hub(spark):
    found = components(spark.range(1, 3000).selectExpr("id AS a", "0L AS b")).collect()
    assert len(found) == 3000 and {r["component"] for r in found} == {0}
