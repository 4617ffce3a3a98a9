"""Fitted trees as tables: saved, read back, scored without a fit, the same as a plain walk."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import trees


def walk(nodes, values, depth):
    total = 0.0
    for tree in {n[0] for n in nodes}:
        own = {n[1]: n for n in nodes if n[0] == tree}
        at = own[0]
        while at[2] >= 0:
            at = own[at[4] if values[at[2]] <= at[3] else at[5]]
        total += at[7] * at[6]
    return total


def test_saved_trees_score_like_a_plain_walk(spark, tmp_path):
    rng = random.Random(1)
    columns = [("a", None), ("b", None), ("kind", "x"), ("kind", "y")]
    nodes = []
    for tree in range(7):
        for node in range(7):
            inner = node < 3
            nodes.append((
                tree, node, rng.randrange(4) if inner else -1, rng.choice([0.5, 0.0, -1.0]) if inner else None,
                2 * node + 1 if inner else -1, 2 * node + 2 if inner else -1, rng.uniform(-1, 1), 1.0 - tree / 10,
            ))
    model = trees.TreeModel(trees.feature_table(spark, columns), spark.createDataFrame(nodes, trees.NODES).orderBy(F.rand(3)))
    model.save(str(tmp_path))
    rows = [(i, rng.choice([None, -2.0, 0.0, 0.5, 3.0]), rng.randint(-2, 2), rng.choice(["x", "y", "new", None]), "clash") for i in range(60)]
    df = spark.createDataFrame(rows, "i int, a double, b int, kind string, margin string").drop("margin")
    found = trees.score(df, trees.load_model(spark, str(tmp_path)), 2).collect()
    assert len(found) == 60
    for r in found:
        values = [r["a"] or 0.0, r["b"], float(r["kind"] == "x"), float(r["kind"] == "y")]
        assert r["margin"] == pytest.approx(walk(nodes, values, 2), abs=1e-12)
    plan = trees.score(df, model, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    chance = spark.range(1).select(trees.probability(F.lit(0.3))).first()[0]
    assert chance == pytest.approx(1 / (1 + math.exp(-0.6)))


def test_trees_are_constants_of_the_expression(spark):
    """A row must not carry the trees, nor build its feature list again at every node."""
    features = trees.feature_table(spark, [("a", None), ("kind", "it's")])
    nodes = [(0, 0, 0, 0.5, 1, 2, 0.0, 1.0), (0, 1, 1, 0.5, 3, 4, 7.0, 1.0), (0, 2, -1, None, -1, -1, 1e-05, 1.0),
             (0, 3, -1, None, -1, -1, 3.0, 1.0), (0, 4, -1, None, -1, -1, -4.0, 1.0)]
    model = trees.TreeModel(features, spark.createDataFrame(nodes, trees.NODES))
    df = spark.createDataFrame([(None, "it's"), (0.0, None), (2.0, "it's"), (float("nan"), "x")], "a double, kind string")
    scored = trees.score(df, model, 2)
    assert [r["margin"] for r in scored.collect()] == [-4.0, 3.0, 1e-05, 1e-05]
    assert [r["margin"] for r in trees.score(df, model, 1).collect()] == [7.0, 7.0, 1e-05, 1e-05]
    assert trees.score(df, trees.TreeModel(features, model.nodes.limit(0)), 2).agg(F.sum("margin")).first()[0] == 0.0
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    assert "Subquery" not in plan and "scalar" not in plan and "nodes[" not in plan
