"""Reply trees with branches, scores and broken links; shards that split."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sectionlake.llm import chat_trees, sharding
from tests.conftest import SMALL


def best(spark, rows, scored=True):
    nodes = spark.createDataFrame(rows, "conversation long, node long, parent long, role string, text string, score double")
    nodes = nodes if scored else nodes.drop("score")
    read = chat_trees.read_back(chat_trees.joined(chat_trees.format_conversations(nodes)))
    return {r["conversation"]: [t["text"] for t in r["turns"]] for r in read.collect()}


def test_branches_are_ranked_by_mean_score_then_length_then_node(spark):
    rows = [
        # 1: the deeper branch has the better mean; 2: equal means, the longer one; 3: equal in both, the lower node.
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 1.0), (1, 3, 1, "assistant", "good", 5.0), (1, 4, 3, "user", "more", 4.0), (1, 5, 3, "user", "less", -9.0),
        (2, 1, None, "user", "q", 1.0), (2, 2, 1, "assistant", "short", 1.0), (2, 3, 1, "assistant", "long", 1.0), (2, 4, 3, "user", "end", 1.0),
        (3, 7, None, "user", "q", None), (3, 9, 7, "assistant", "late", None), (3, 8, 7, "assistant", "early", None),
        # 4: a parent that isn't there makes a root; the better root's path is taken.
        (4, 1, None, "user", "low", 0.0), (4, 5, 99, "assistant", "orphan", 3.0), (4, 6, 5, "user", "child", 3.0),
    ]
    assert best(spark, rows) == {1: ["q", "good", "more"], 2: ["q", "long", "end"], 3: ["q", "early"], 4: ["orphan", "child"]}
    assert best(spark, [r for r in rows if r[0] == 2], scored=False) == {2: ["q", "long", "end"]}


def test_a_deep_tree_with_side_branches(spark):
    chain = [(1, i, i - 1 if i else None, "user" if i % 2 == 0 else "assistant", f"m{i}", 1.0) for i in range(70)]
    side = [(1, 1000 + i, i, "user", "side", 0.5) for i in range(0, 69, 3)]
    assert best(spark, chain + side) == {1: [f"m{i}" for i in range(70)]}


def test_repeated_nodes_and_cycles_raise(spark):
    with pytest.raises(ValueError, match="several nodes"):
        best(spark, [(1, 1, None, "user", "a", 0.0), (1, 2, 1, "user", "b", 0.0), (1, 2, 1, "user", "c", 0.0)])
    nodes = spark.createDataFrame([(1, 1, 2), (1, 2, 1)], "conversation long, node long, parent long")
    with pytest.raises(ValueError, match="cycle"):
        chat_trees.best_paths(nodes, most_steps=4)


def test_shards_split_until_they_fit(spark):
    limit = 32 << 10
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = sharding.extendible_shards(docs, limit_bytes=limit).collect()
    shards: dict[str, list] = {}
    for r in rows:
        shards.setdefault(r["shard"], []).append(r)
    assert len(rows) == docs.count() and len(shards) > 8
    for name, own in shards.items():
        assert sum(r["n_bytes"] for r in own) == own[0]["shard_bytes"] and own[0]["depth"] == len(name)
        assert own[0]["shard_bytes"] <= limit or len(own) == 1
        assert not any(other != name and other.startswith(name) for other in shards)
    # Only oversized buckets split: a shard and what lies beside it were too large together.
    sizes = {name: own[0]["shard_bytes"] for name, own in shards.items()}
    for name in shards:
        if name:
            assert sum(b for other, b in sizes.items() if other.startswith(name[:-1])) > limit
    total = {r["doc_id"]: len((r["text"] or "").encode()) for r in docs.select("doc_id", F.col("text")).collect()}
    assert {r["doc_id"]: r["n_bytes"] for r in rows} == total
