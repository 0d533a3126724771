"""Random forests: fitting, folds, export as a node table, and scoring of a given forest by a column."""

from __future__ import annotations

from collections import defaultdict

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Node = tuple[int, int, int, float, int, int, float]


def fit(rows: DataFrame, trees: int = 100, seed: int = 0) -> RandomForestClassificationModel:
    """A forest of rows (x array<double>, y 0/1)."""
    vectors = rows.select(array_to_vector("x").alias("features"), F.col("y").alias("label"))
    return RandomForestClassifier(numTrees=trees, seed=seed, maxDepth=6).fit(vectors)


def score_with_model(model: RandomForestClassificationModel, rows: DataFrame) -> DataFrame:
    """rows without x, with the forest's score of class 1."""
    scored = model.transform(rows.withColumn("features", array_to_vector("x")))
    return scored.select(*[c for c in rows.columns if c != "x"], F.round(F.get(vector_to_array("probability"), F.lit(1)), 6).alias("score"))


def out_of_fold(rows: DataFrame, trees: int = 100, folds: int = 5) -> DataFrame:
    """rows (pos, x, y) with scores of forests that were fitted without the row's fold, pos modulo folds."""
    out = None
    for k in range(folds):
        inside = F.pmod(F.col("pos"), F.lit(folds)) == k
        part = score_with_model(fit(rows.where(~inside), trees), rows.where(inside))
        out = part if out is None else out.unionByName(part)
    return out


def export(spark: SparkSession, model: RandomForestClassificationModel) -> DataFrame:
    """tree, node, feature, threshold, left, right, value: leaves have feature -2 and the share of class 1."""
    nodes: list[Node] = []
    for t, tree in enumerate(model.trees):
        todo, count = [(tree._call_java("rootNode"), 0)], 1
        while todo:
            node, at = todo.pop()
            if node.subtreeDepth() == 0:
                shares = node.impurityStats().stats()
                nodes.append((t, at, -2, 0.0, 0, 0, shares[1] / sum(shares)))
            else:
                split = node.split()
                nodes.append((t, at, split.featureIndex(), split.threshold(), count, count + 1, 0.0))
                todo += [(node.leftChild(), count), (node.rightChild(), count + 1)]
                count += 2
    return spark.createDataFrame(nodes, "tree int, node int, feature int, threshold double, left int, right int, value double")


def _by_tree(nodes: list[Node]) -> dict[int, dict[int, Node]]:
    trees: dict[int, dict[int, Node]] = defaultdict(dict)
    for n in nodes:
        trees[n[0]][n[1]] = n
    return trees


def score_column(nodes: list[Node], x: Column) -> Column:
    """The mean leaf value over the trees, as nested conditions; left where the feature is at most the threshold."""
    trees = _by_tree(nodes)

    def walk(tree: dict[int, Node], at: int) -> Column:
        _, _, feature, threshold, left, right, value = tree[at]
        if feature == -2:
            return F.lit(value)
        return F.when(F.get(x, F.lit(feature)) <= threshold, walk(tree, left)).otherwise(walk(tree, right))

    return sum((walk(t, 0) for t in trees.values()), F.lit(0.0)) / len(trees)


def score_sql(nodes: list[Node], x: list[str]) -> str:
    """score_column as SQL over the given expressions."""

    def walk(tree: dict[int, Node], at: int) -> str:
        _, _, feature, threshold, left, right, value = tree[at]
        return str(value) if feature == -2 else f"CASE WHEN {x[feature]} <= {threshold} THEN {walk(tree, left)} ELSE {walk(tree, right)} END"

    trees = _by_tree(nodes)
    return f"(0.0 + {' + '.join(walk(t, 0) for t in trees.values())}) / {len(trees)}"


def leaf_columns(nodes: list[Node], x: Column) -> Column:
    """For each tree, in order, the number of the leaf that the features end in."""

    def walk(tree: dict[int, Node], at: int) -> Column:
        _, _, feature, threshold, left, right, _ = tree[at]
        return F.lit(at) if feature == -2 else F.when(F.get(x, F.lit(feature)) <= threshold, walk(tree, left)).otherwise(walk(tree, right))

    return F.array(*[walk(t, 0) for _, t in sorted(_by_tree(nodes).items())])
