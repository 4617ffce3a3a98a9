"""Fitted boosted trees as a table: saved, read back and scored by expressions, without the library that fitted them.

`features` has a row per place of the feature list: position, column and, for an indicator, the category. `nodes` has a row
per node: tree, node, feature (-1 for a leaf), threshold, below and above (the node to go to), value and the tree's weight.
Both are as small as the parameters say: rounds times nodes of a tree, whatever the data.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.session import pin, scratch_folder

FEATURES = "position int, column string, category string"
NODES = "tree int, node int, feature int, threshold double, below int, above int, value double, weight double"


@dataclass(frozen=True)
class TreeModel:
    features: DataFrame
    nodes: DataFrame

    def save(self, folder: str) -> None:
        self.features.coalesce(1).write.mode("overwrite").parquet(f"{folder}/features")
        self.nodes.coalesce(1).write.mode("overwrite").parquet(f"{folder}/nodes")


def load_model(spark: SparkSession, folder: str) -> TreeModel:
    return TreeModel(spark.read.schema(FEATURES).parquet(f"{folder}/features"), spark.read.schema(NODES).parquet(f"{folder}/nodes"))


def feature_table(spark: SparkSession, columns: list[tuple[str, str | None]]) -> DataFrame:
    return spark.createDataFrame([(i, c, category) for i, (c, category) in enumerate(columns)], FEATURES)


def fitted_nodes(spark: SparkSession, model) -> DataFrame:
    """The nodes of a boosted model of Spark's library, from the form in which it saves itself.

    A split of an indicator into its two values becomes a threshold between them.
    """
    folder = scratch_folder(spark, "trees")
    model.write().save(folder)
    data = spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*")
    weights = spark.read.parquet(f"{folder}/treesMetadata").select(F.col("_1").alias("treeID"), F.col("_3").alias("weight"))
    sides, kinds = F.col("split.leftCategoriesOrThreshold"), F.col("split.numCategories")
    many = F.when(kinds > 2, F.raise_error(F.lit("a split of more than two categories"))).otherwise(F.lit(0)).cast("int")
    swapped = (kinds >= 0) & F.array_contains(sides, 1.0)
    inner = F.col("leftChild") >= 0
    return pin(
        data.join(weights, "treeID").select(
            F.col("treeID").alias("tree"), F.col("id").alias("node"),
            (F.when(inner, F.col("split.featureIndex")).otherwise(-1) + many).alias("feature"),
            F.when(inner, F.when(kinds >= 0, 0.5).otherwise(F.get(sides, F.lit(0)))).alias("threshold"),
            F.when(swapped, F.col("rightChild")).otherwise(F.col("leftChild")).alias("below"),
            F.when(swapped, F.col("leftChild")).otherwise(F.col("rightChild")).alias("above"),
            F.col("prediction").alias("value"), "weight",
        )
    )


def feature_values(features: DataFrame) -> dict[int, str]:
    """The SQL expression of each place of the feature list; nulls count as 0, an unknown category sets no indicator."""
    def one(r) -> str:
        column = "`" + r["column"].replace("`", "``") + "`"
        if r["category"] is None:
            return f"coalesce(CAST({column} AS DOUBLE), 0D)"
        category = r["category"].replace("\\", "\\\\").replace("'", "\\'")
        return f"coalesce(CAST({column} = '{category}' AS DOUBLE), 0D)"

    return {r["position"]: one(r) for r in features.collect()}


def _number(x: float | None) -> str:
    if x is None:
        return "CAST(NULL AS DOUBLE)"
    return f"{x!r}D" if math.isfinite(x) else f"CAST('{x}' AS DOUBLE)"


def _leaf(nodes: dict, at: int, values: dict[int, str], steps: int) -> str:
    """The value of the leaf that a row falls into, as nested conditions; after `steps` steps down the walk ends."""
    here = nodes[at]
    if here["feature"] < 0 or not steps:
        return _number(here["value"])
    below, above = (_leaf(nodes, here[side], values, steps - 1) for side in ("below", "above"))
    return f"CASE WHEN {values[here['feature']]} <= {_number(here['threshold'])} THEN {below} ELSE {above} END"


def margin(model: TreeModel, depth: int) -> Column:
    """Weighted sum of the leaves that a row falls into; a walk takes `depth` steps down.

    The trees are constants of the expression: a row costs `depth` comparisons a tree. They are added in their order.
    """
    values, trees = feature_values(model.features), {}
    for r in model.nodes.collect():
        trees.setdefault(r["tree"], {})[r["node"]] = r
    parts = []
    for _, nodes in sorted(trees.items()):
        weight = max(r["weight"] for r in nodes.values())
        parts.append(F.expr(f"{_number(weight)} * {_leaf(nodes, min(nodes), values, depth)}"))
    return F.aggregate(F.array(*parts), F.lit(0.0), lambda total, part: total + part) if parts else F.lit(0.0)


def score(rows: DataFrame, model: TreeModel, depth: int, into: str = "margin") -> DataFrame:
    """Add the margin of each row."""
    return rows.withColumn(into, margin(model, depth))


def probability(margin_: Column) -> Column:
    """Chance of class 1 under the logistic loss of boosted trees."""
    return 1 / (1 + F.exp(-2 * margin_))
