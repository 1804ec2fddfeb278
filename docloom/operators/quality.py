"""Benchmarks, metrics and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import nfkc

GATE_TOLERANCE = 1e-12
MISSING = "MISSING"


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where there is nothing to divide by."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def _scores(out: DataFrame) -> DataFrame:
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def binary_metrics(pairs: DataFrame, expected: Column, observed: Column, *keys: str) -> DataFrame:
    n = lambda e, o: F.count_if((expected == e) & (observed == o))
    return _scores(pairs.groupBy(*keys).agg(n(True, True).alias("tp"), n(False, True).alias("fp"), n(True, False).alias("fn"), n(False, False).alias("tn")))


def set_metrics(pairs: DataFrame, expected: Column, observed: Column, *keys: str) -> DataFrame:
    """Micro-averaged over sets: what is in both, and in one only."""
    size = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
    return _scores(pairs.groupBy(*keys).agg(size(F.array_intersect(expected, observed)).alias("tp"), size(F.array_except(observed, expected)).alias("fp"), size(F.array_except(expected, observed)).alias("fn")))


def ranking_metrics(queries: DataFrame, hits: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """Over all queries: share with a relevant document in the best k, and mean reciprocal rank of the first one. hits: query_id, doc_id, rank; expected: query_id, doc_id."""
    first = hits.join(expected, ["query_id", "doc_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    rows = queries.select("query_id").join(first, "query_id", "left")
    return rows.agg(F.count("*").alias("queries"), F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias("recall_at_k"), F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"))


def exact_hit_rate(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """Of queries with a hint, the share whose first hit is exact."""
    hinted = queries.where("hinted").join(hits.where("rank = 1").select("query_id", "exact_hit"), "query_id", "left")
    return hinted.agg(F.count("*").alias("queries"), F.avg(F.when(F.col("exact_hit"), 1.0).otherwise(0.0)).alias("exact_hit_rate"))


def pass_rates(assertions: DataFrame) -> DataFrame:
    """Of (task_type, case_id, assertion_id, passed): pass rates of assertions and cases, and the number of task families."""
    cases = assertions.groupBy("task_type", "case_id").agg(F.bool_and("passed").alias("case_passed"), F.count("*").alias("n"), F.count_if("passed").alias("ok"))
    return cases.agg(F.avg(F.col("case_passed").cast("double")).alias("case_pass_rate"), (F.sum("ok") / F.sum("n")).alias("assertion_pass_rate"), F.count_distinct("task_type").alias("task_families"))


def gate_passed(operator: Column, value: Column, threshold: Column) -> Column:
    return F.when(operator == "GTE", value >= threshold).when(operator == "LTE", value <= threshold).when(operator == "EQ", F.abs(value - threshold) <= GATE_TOLERANCE)


def evaluate_gates(gates: DataFrame, metrics: DataFrame) -> DataFrame:
    """Every gate with its metric's value; a missing metric fails."""
    rows = gates.join(metrics.select("metric_key", "value"), "metric_key", "left")
    out = rows.withColumn("passed", F.coalesce(gate_passed(F.col("operator"), F.col("value"), F.col("threshold")), F.lit(False)))
    return out.withColumn("reason", F.when(F.col("value").isNull(), "METRIC_MISSING").when(F.col("passed"), "PASS").otherwise("THRESHOLD_NOT_MET"))


def pointer_path(pointer: Column, indexes: bool = True) -> Column:
    """A JSON pointer as a JSON path: ~1 is a slash, ~0 a tilde; digits are an index, or a key if there are to be no indexes."""
    steps = F.slice(F.split(pointer, "/"), 2, 1 << 20)
    name = lambda s: F.regexp_replace(F.regexp_replace(s, "~1", "/"), "~0", "~")
    quoted = lambda s: F.when(F.contains(s, F.lit("'")), F.concat(F.lit('["'), s, F.lit('"]'))).otherwise(F.concat(F.lit("['"), s, F.lit("']")))
    index = lambda s: s.rlike("^[0-9]{1,9}$") & F.lit(indexes)
    return F.concat(F.lit("$"), F.array_join(F.transform(steps, lambda s: F.when(index(s), F.concat(F.lit("["), s, F.lit("]"))).otherwise(quoted(name(s)))), ""))


def resolve_pointer(document: Column | str, pointer: Column | str) -> Column:
    """The JSON text at a pointer, keys in order and without blanks; null where it leads nowhere or the document is no JSON (a JSON null is the text null).

    Steps of digits are indexes, or else keys; a key that holds both kinds of quotes is not found."""
    document, pointer = (F.col(c) if isinstance(c, str) else c for c in (document, pointer))
    sound = F.when(~pointer.rlike(r"""'[^/]*"|"[^/]*'"""), pointer)
    at = lambda indexes: F.call_function("to_json", F.call_function("try_variant_get", F.try_parse_json(document), pointer_path(sound, indexes), F.lit("variant")))
    return F.coalesce(at(True), at(False))


# How an observed value may be compared, and the reason of a match.
MODES = ("EXACT", "ONE_OF", "SET_EQUALS", "SET_CONTAINS", "NUMERIC_WITHIN", "NORMALIZED_TEXT_EQUALS")
MATCH = "MATCH"


def compare(rows: DataFrame) -> DataFrame:
    """Assertions (comparison, expected and observed as JSON text, tolerance) with passed and reason."""
    c = F.col
    number = lambda x: F.when(~x.isin("true", "false"), x.try_cast("double"))
    items = lambda x: F.array_sort(F.array_distinct(F.from_json(x, "array<string>")))
    is_array, is_text = lambda x: F.substring(x, 1, 1) == "[", lambda x: F.substring(x, 1, 1) == '"'
    text = lambda x: F.get_json_object(F.concat(F.lit('{"v":'), x, F.lit("}")), "$.v")
    e, o = c("expected"), c("observed")
    equal = lambda a, b: (a == b) | F.coalesce(number(a) == number(b), F.lit(False))
    arrays = is_array(e) & is_array(o)
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))
    reason = F.when(o.isNull(), "OBSERVED_POINTER_MISSING")
    mode = lambda m, cond: (c("comparison") == m) & cond
    reason = (
        reason.when(mode("EXACT", ~equal(e, o)), "EXACT_MISMATCH")
        .when(mode("ONE_OF", ~F.exists(F.from_json(e, "array<string>"), lambda x: (x == text(o)) | (x == o))), "NOT_IN_ALLOWED_ALTERNATIVES")
        .when(c("comparison").isin("SET_EQUALS", "SET_CONTAINS") & ~arrays, "SET_COMPARISON_REQUIRES_ARRAYS")
        .when(mode("SET_EQUALS", items(e) != items(o)), "SET_MISMATCH")
        .when(mode("SET_CONTAINS", F.size(F.array_except(items(e), items(o))) > 0), "EXPECTED_SET_NOT_CONTAINED")
        .when(mode("NUMERIC_WITHIN", number(e).isNull() | number(o).isNull()), "NUMERIC_COMPARISON_REQUIRES_NUMBERS")
        .when(mode("NUMERIC_WITHIN", ~(finite(number(e)) & finite(number(o)))), "NUMERIC_COMPARISON_REQUIRES_FINITE_VALUES")
        .when(mode("NUMERIC_WITHIN", F.abs(number(e) - number(o)) > F.coalesce(c("tolerance"), F.lit(0.0))), "OUTSIDE_TOLERANCE")
        .when(mode("NORMALIZED_TEXT_EQUALS", ~(is_text(e) & is_text(o))), "TEXT_COMPARISON_REQUIRES_STRINGS")
        .when(mode("NORMALIZED_TEXT_EQUALS", nfkc(text(e)) != nfkc(text(o))), "NORMALIZED_TEXT_MISMATCH")
    )
    reason = reason.when(c("comparison").isin(*MODES), MATCH).otherwise("UNSUPPORTED_COMPARISON_MODE")
    return rows.withColumn("reason", reason).withColumn("passed", F.col("reason") == MATCH)


def evaluate_benchmark(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """Cases (case_id, task_type, expectations) against observations (case_id, observed as JSON): a row for each assertion; a case without an observation fails."""
    rows = cases.select("case_id", "task_type", F.explode("expectations").alias("x")).select("case_id", "task_type", "x.*")
    rows = rows.join(observations.select("case_id", F.col("observed").alias("document")), "case_id", "left")
    missing = F.col("document").isNull()
    out = compare(rows.withColumn("observed", resolve_pointer("document", "pointer")))
    return out.withColumn("reason", F.when(missing, "MISSING_OBSERVATION").otherwise(F.col("reason"))).withColumn("passed", F.col("passed") & ~missing).drop("document")


def unused_observations(cases: DataFrame, observations: DataFrame) -> DataFrame:
    return observations.join(cases.select("case_id"), "case_id", "left_anti")


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("times")).where("times > 1")


def first_of_each(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")
