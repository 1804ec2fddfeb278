"""Quality classifier: a sparse ensemble of rules that trees propose and a lasso weighs.

A text is described by statistics, all of them Spark column expressions. Small trees over the
statistics propose rules (every path from a root to a node is a conjunction of bounds); an L1
logistic regression over the rules' truth values keeps few of them; the kept rules are compiled into
one Spark column expression, which scores every row in the scan's own stage, without Python.

The fit uses at most TRAIN_ROWS labelled rows, chosen by hash. Labels, language, source and id are no
inputs. Defined results: a null text scores as an empty one; with no usable labels every score is 0.5;
with one class only, the score is that class's smoothed share; repeated rows score alike, and of a repeated id each labelled text may teach;
very long texts are taken whole, in time in proportion to their length; an empty table gives no rows; columns named score or predicted
are replaced, all others kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, hashed_low, held_out, without

#: Labelled rows that the fit uses at most.
TRAIN_ROWS = 6000
TREES, DEPTH, LEAST_LEAF = 24, 4, 12
LASSO = 0.002
#: Share of the training rows that a rule must hold for, and must not hold for.
LEAST_SUPPORT = 0.004

#: (name, low, high) for each statistic that a rule bounds: low < value <= high.
Rule = tuple[tuple[str, float, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """The statistics of a text. Each pattern is one character class, so its cost is in proportion to the text."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    words = F.split(F.trim(F.regexp_replace(t, r"[\n\t\r]", " ")), " +")
    lines = F.split(t, "\n")

    def share(pattern: str) -> Column:
        return F.regexp_count(t, F.lit(pattern)) / chars

    return {
        "chars": F.length(t).cast("double"),
        "words": F.size(words).cast("double"),
        "word_length": chars / F.size(words),
        "distinct_words": F.size(F.array_distinct(words)) / F.size(words),
        "richness": F.log(F.size(F.array_distinct(words)) + 1) / F.log(F.size(words) + 1),
        "line_length": chars / F.size(lines),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "upper": share("[A-Z]"),
        "digits": share("[0-9]"),
        "symbols": share(r"[#$%&*+/<=>@\\^_`{|}~\[\]]"),
        "marks": share("[!?]"),
        "stops": share("[.,;:]"),
        "spaces": share(r"\s"),
    }


@dataclass(frozen=True)
class Model:
    """Rules with their weights, and the intercept."""

    rules: tuple[tuple[Rule, float], ...]
    intercept: float

    def margin(self, columns: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(holds(rule, columns), F.lit(weight)).otherwise(F.lit(0.0))
        return total

    def score(self, columns: dict[str, Column]) -> Column:
        return 1.0 / (1.0 + F.exp(-F.greatest(F.least(self.margin(columns), F.lit(500.0)), F.lit(-500.0))))


def holds(rule: Rule, columns: dict[str, Column]) -> Column:
    """A rule as a column expression."""
    out = F.lit(True)
    for name, low, high in rule:
        if low > -math.inf:
            out = out & (columns[name] > F.lit(low))
        if high < math.inf:
            out = out & (columns[name] <= F.lit(high))
    return out


def tree_rules(tree, names: list[str]) -> set[Rule]:
    """The conjunctions of all paths from the root of a fitted tree to a node below it."""
    found: set[Rule] = set()
    todo = [(tree._java_obj.rootNode(), {})]
    while todo:
        node, bounds = todo.pop()
        if bounds:
            found.add(tuple((n, *bounds[n]) for n in names if n in bounds))
        if node.getClass().getSimpleName() == "InternalNode":
            name, at = names[node.split().featureIndex()], float(node.split().threshold())
            low, high = bounds.get(name, (-math.inf, math.inf))
            todo.append((node.leftChild(), {**bounds, name: (low, min(high, at))}))
            todo.append((node.rightChild(), {**bounds, name: (max(low, at), high)}))
    return found


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """Statistics and label of at most ``rows`` labelled texts that are not held out. The ids are chosen first, so only their texts are kept."""
    usable = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("label"))
    low = usable.where(hashed_low(["__id"], 11, 4.0 * rows / max(usable.count(), 1)))  # so few that choosing the lowest costs the same at any size
    chosen = low.orderBy(F.xxhash64("__id", F.lit(11)), "__id", "label").limit(rows)
    source = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("__text"))
    joined = source.join(F.broadcast(chosen), "__id")
    return joined.select(*[c.alias(n) for n, c in statistics(F.col("__text")).items()], "label")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """Trees and lasso by Spark ML over the bounded sample."""
    # the sample is dealt out after it is made, so that all tasks read for it, then gathered in a few partitions, as the fits pass over them
    # many times; sorted, so that the trees do not depend on the order of arrival
    data = training_rows(docs, labels, id_col, text_col, label_col, rows)
    data = checkpoint(data.repartition("chars", "words", "upper").coalesce(4).sortWithinPartitions(*data.columns))
    total, ones = data.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, total):
        return Model((), math.log((ones + 1) / (total - ones + 1)))
    names = [c for c in data.columns if c != "label"]
    seen = data.select(array_to_vector(F.array(*names)).alias("features"), "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_LEAF, featureSubsetStrategy="onethird", subsamplingRate=0.7, seed=17).fit(seen)
    rules = sorted(set().union(*(tree_rules(t, names) for t in forest.trees)))
    columns = {n: F.col(n) for n in names}
    held = data.agg(*[F.sum(holds(r, columns).cast("long")).alias(str(i)) for i, r in enumerate(rules)]).first() if rules else []
    rules = [r for r, n in zip(rules, held, strict=True) if LEAST_SUPPORT * total <= n <= (1 - LEAST_SUPPORT) * total]
    if not rules:
        return Model((), math.log((ones + 1) / (total - ones + 1)))
    truth = checkpoint(data.select(array_to_vector(F.array(*[holds(r, columns).cast("double") for r in rules])).alias("features"), "label"))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=80, standardization=False).fit(truth)
    weights = lasso.coefficients.toArray().tolist()
    return Model(tuple((r, w) for r, w in zip(rules, weights, strict=True) if w), float(lasso.intercept))


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` and score (0 to 1) and predicted (1 if score >= 0.5); columns of these names are replaced."""
    stats = statistics(F.col(f"`{text_col}`").cast("string"))
    document = F.struct(*[F.col(f"`{c}`") for c in without(docs, "score", "predicted").columns])
    described = docs.select(document.alias("document"), *[c.alias(n) for n, c in stats.items()])
    # a row each: what is asked of the score is not pushed below, where every rule would take its statistics again
    described = described.select("document", F.explode(F.array(F.struct(*stats))).alias("stats"))
    scored = described.withColumn("score", model.score({n: F.col(f"stats.{n}") for n in stats}))
    return scored.select("document.*", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
