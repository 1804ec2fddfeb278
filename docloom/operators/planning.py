"""Review plans: topics, keyed merges, chunk packing, budgets, coverage, neighbouring clauses."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import checkpoint

PRIORITY = {"LOW": 0, "MEDIUM": 1, "HIGH": 2, "CRITICAL": 3}
CHUNK_CHARS, CHUNK_ITEMS, DIRECT_CHARS, MOST_CHUNKS = 18_000, 24, 60_000, 255
FACTS, FACT_CHARS, RELATED, FALLBACK = 64, 12_000, 16, 8


# The keyword topics of contract clauses, with the query that each is looked up by.
TOPICS = (
    ("格式条款", r"格式条款|免责|免除.{0,12}责任|减轻.{0,12}责任|限制.{0,12}权利|排除.{0,12}权利", "格式条款 提示说明义务 免除减轻责任 限制排除主要权利"),
    ("违约金", r"违约金", "违约金 过分高于损失 调整"),
    ("定金", r"定金", "定金 主合同标的额 百分之二十"),
    ("合同生效", r"合同生效|生效日期|批准|审批", "合同生效 批准手续"),
    ("合同履行", r"全面履行|履行义务|通知|协助|保密", "合同全面履行 诚信 通知 协助 保密"),
    ("违约责任", r"违约责任|不履行|补救措施|赔偿损失", "不履行合同义务 继续履行 补救措施 赔偿损失"),
    ("合同形式", r"书面形式|电子邮件|数据电文|传真|电报", "合同书面形式 数据电文 电子邮件"),
    ("合同成立", r"合同成立|标的和数量", "合同成立 当事人名称 标的 数量"),
)


def topic_table(spark: SparkSession) -> DataFrame:
    """(topic, pattern, query) of the fixed topics."""
    return spark.createDataFrame(list(TOPICS), "topic string, pattern string, query string")


def topics(texts: DataFrame, patterns: DataFrame, text_col: str = "text") -> DataFrame:
    """The texts with each topic (topic, pattern) whose pattern they hold; patterns are configuration and are broadcast."""
    return texts.join(F.broadcast(patterns.select("topic", "pattern")), F.expr(f"{text_col} rlike pattern"))


def ordered_unique(values: Column, sequence: Column) -> Column:
    """Of array values met in an order: their elements, first seen first, each once."""
    return F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(sequence.alias("s"), values.alias("v")))), lambda x: x["v"])))


def merge_plan(issues: DataFrame, keys: list[str], lists: list[str], topic: str = "topic", sequence: str = "seq", priority: str = "priority_rank") -> DataFrame:
    """One issue for each topic key: the first spelling, the greatest priority, and the ordered unions of the list columns."""
    rows = issues.withColumn("topic_key", X.topic_key(F.col(topic)))
    merged = rows.groupBy(*keys, "topic_key").agg(
        F.min_by(topic, sequence).alias("topic"), F.max(priority).alias("priority_rank"), F.count("*").alias("merged"), *[ordered_unique(F.col(c), F.col(sequence)).alias(c) for c in lists]
    )
    return merged.withColumn("issue_id", X.stable_id("plan-", F.col("topic_key")))


class _Packer:
    """An open chunk that takes items: closed before an item that would overflow it, and when it is full."""

    def __init__(self, most_chars: int, most_items: int, chars: int = 0, items: int = 0, chunk: int = 1) -> None:
        self.most_chars, self.most_items, self.chars, self.items, self.chunk = most_chars, most_items, chars, items, chunk

    def add(self, size: int) -> int:
        """The chunk that an item goes to."""
        if self.items and (self.chars + size > self.most_chars or self.items >= self.most_items or self.chars >= self.most_chars):
            self.chars, self.items, self.chunk = 0, 0, self.chunk + 1
        self.chars, self.items = self.chars + size, self.items + 1
        return self.chunk


def _ends(sizes: np.ndarray, most_chars: int, most_items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a chunk that begins at each of the rows: chunks, characters and items of the last one when the rows end, and how many chunks are begun."""
    n = len(sizes)
    chunks, chars, items = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    total = np.concatenate(([0], np.cumsum(sizes)))
    for i in range(n - 1, -1, -1):
        stop = min(int(np.searchsorted(total, total[i] + most_chars, side="right")) - 1, i + most_items, n)
        stop = max(stop, i + 1)
        full = int(np.searchsorted(total, total[i] + most_chars, side="left"))  # rows after which the chunk is full
        stop = min(stop, max(full, i + 1))
        if stop >= n:
            chunks[i], chars[i], items[i] = 1, total[n] - total[i], n - i
        else:
            chunks[i], chars[i], items[i] = chunks[stop] + 1, chars[stop], items[stop]
    return chunks, chars, items, total


def packed_chunks(items: DataFrame, keys: list[str], order: str, size: str, most_chars: int = CHUNK_CHARS, most_items: int = CHUNK_ITEMS) -> DataFrame:
    """Chunk number of each item: in order, a chunk is closed before an item that would overflow it, and when it is full. Null and negative sizes count as 0.

    Where a chunk begins depends on all before it, yet no group is brought into one task: rows are dealt by ranges of (group, order). Every
    range tells how its first group would end for each row that a chunk may begin at (most_items + 1 at most); following these from range to range
    - a few numbers for each - gives the chunk that is open where a range begins, and the ranges are numbered from there."""
    kind = items.schema[size].dataType.simpleString()
    source = items.select(*keys, order, size, F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("__group"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("__size"))
    ranged = checkpoint(source.repartitionByRange("__group", order).sortWithinPartitions("__group", order))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[tuple[str, list[np.ndarray]]] = []
        for batch in batches:
            names, sizes = batch.column("__group").to_numpy(zero_copy_only=False), batch.column("__size").to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if groups and b > a and groups[-1][0] == names[a]:
                    groups[-1][1].append(sizes[a:b])
                elif b > a:
                    groups[1:] = [(names[a], [sizes[a:b]])]  # the first group and the last one are what matters
        out = []
        for which, (name, parts) in enumerate(groups):
            sizes = np.concatenate(parts)
            chunks, chars, count, _ = _ends(sizes, most_chars, most_items)
            head = slice(0, most_items + 1 if which == 0 else 1)
            out.append((TaskContext.get().partitionId(), which, name, len(sizes), sizes[head].tolist(), chunks[head].tolist(), chars[head].tolist(), count[head].tolist()))
        yield pa.RecordBatch.from_pylist([dict(zip(_TOLD.names, r, strict=True)) for r in out], schema=_TOLD)

    ends = ranged.mapInArrow(told, "part int, which int, name string, rows long, sizes array<long>, chunks array<long>, chars array<long>, items array<long>").collect()  # two rows a partition at most
    opened, state = {}, (None, 0, 0, 1)
    for r in sorted(ends, key=lambda r: (r["part"], r["which"])):
        name, chars, count, chunk = state if state[0] == r["name"] else (r["name"], 0, 0, 1)
        if r["which"] == 0:
            opened[r["part"]] = (name, chars, count, chunk)
        packer = _Packer(most_chars, most_items, chars, count, chunk)
        begins = next((i for i, s in enumerate(r["sizes"]) if packer.add(s) != chunk), None) if count else 0
        if begins is None:  # the open chunk takes all rows of the range
            state = (name, packer.chars, packer.items, chunk)
        else:
            state = (name, r["chars"][begins], r["items"][begins], chunk + (1 if count else 0) + r["chunks"][begins] - 1)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, *before = opened.get(TaskContext.get().partitionId(), (None, 0, 0, 1))
        packer = _Packer(most_chars, most_items, *before)
        for batch in batches:
            out = []
            for group, s in zip(batch.column("__group").to_pylist(), batch.column("__size").to_pylist(), strict=True):
                if group != name:
                    name, packer = group, _Packer(most_chars, most_items)
                out.append(packer.add(s))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(out, pa.int32())], names=[*batch.schema.names[:-2], "chunk"])

    fields = [ranged.schema[c] for c in (*keys, order)]
    return ranged.mapInArrow(number, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{size}` {kind}", "chunk int"]))


def packing_problems(chunks: DataFrame, keys: list[str], size: str, most: int = DIRECT_CHARS, most_chunks: int = MOST_CHUNKS) -> DataFrame:
    """Of packed items: groups (keys, problem) with an item that is too large by itself, or with too many chunks; a plan over them is an error."""
    out = chunks.groupBy(*keys).agg(F.max(size).alias("largest"), F.max("chunk").alias("chunks"))
    found = F.array_compact(F.array(F.when(F.col("largest") > most, F.lit("OBJECT_TOO_LARGE")), F.when(F.col("chunks") > most_chunks, F.lit("TOO_MANY_CHUNKS"))))
    return out.select(*keys, F.explode(found).alias("problem"))


_TOLD = pa.schema([("part", pa.int32()), ("which", pa.int32()), ("name", pa.string()), ("rows", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("sizes", "chunks", "chars", "items")]])


def prefix_budget(facts: DataFrame, keys: list[str], order: list[str], cost: Column, most: int = FACTS, most_chars: int = FACT_CHARS) -> DataFrame:
    """The facts in order until the budget is met; the first that overflows ends it."""
    before = Window.partitionBy(*keys).orderBy(*order)
    rows = facts.withColumn("running_cost", F.sum(cost).over(before.rowsBetween(Window.unboundedPreceding, 0))).withColumn("position", F.row_number().over(before))
    return rows.where((F.col("running_cost") <= most_chars) & (F.col("position") <= most))


# States of an object under an audit plan, and the chunk of a plan that was made at once.
WITH_ISSUE, NO_ISSUE, DIRECT_CHUNK = "REVIEWED_WITH_ISSUE", "REVIEWED_NO_SPECIFIC_ISSUE", "direct-0001"


def coverage(objects: DataFrame, issues: DataFrame, *keys: str, chunks: DataFrame | None = None) -> DataFrame:
    """Every object (keys, object_id) with the issues (keys, issue_id, object_ids) that name it and the chunks (keys, chunk_id, object_ids) that it was read in; without chunks the plan was made at once."""
    listed = lambda rows, name: rows.select(*keys, name, F.explode("object_ids").alias("object_id")).groupBy(*keys, "object_id").agg(F.array_sort(F.collect_set(name)).alias(f"{name}s"))
    out = objects.join(listed(issues, "issue_id"), [*keys, "object_id"], "left")
    out = out.withColumn("chunk_ids", F.array(F.lit(DIRECT_CHUNK))) if chunks is None else out.join(listed(chunks, "chunk_id"), [*keys, "object_id"], "left")
    none = F.expr("cast(array() as array<string>)")
    return out.withColumn("state", F.when(F.col("issue_ids").isNull(), NO_ISSUE).otherwise(WITH_ISSUE)).withColumns({c: F.coalesce(F.col(c).cast("array<string>"), none) for c in ("issue_ids", "chunk_ids")})


def coverage_summary(covered: DataFrame, *keys: str) -> DataFrame:
    """Of covered objects: how many there are, with an issue and without, and whether each was read in a chunk."""
    return covered.groupBy(*keys).agg(
        F.count("*").alias("canonical_object_count"),
        F.count_if(F.col("state") == WITH_ISSUE).alias("reviewed_with_issue_count"),
        F.count_if(F.col("state") == NO_ISSUE).alias("reviewed_no_specific_issue_count"),
        F.bool_and(F.size("chunk_ids") > 0).alias("coverage_complete"),
    )


def neighbours(clauses: DataFrame, *keys: str, order: str = "clause_number") -> DataFrame:
    """Previous and next clause of each."""
    w = Window.partitionBy(*keys).orderBy(order)
    return clauses.withColumn("previous_id", F.lag("clause_id").over(w)).withColumn("next_id", F.lead("clause_id").over(w))


def related(targets: DataFrame, clauses: DataFrame, references: DataFrame, most: int = RELATED) -> DataFrame:
    """Clauses related to an issue's targets (job_id, issue_id, clause_id): previous, next, parent, children, then resolved references; each once, no target, ``most`` at most (a limit of the feature)."""
    near = neighbours(clauses, "job_id")
    at = targets.join(near, ["job_id", "clause_id"])
    pick = lambda df, col, kind: df.select("job_id", "issue_id", F.col(col).alias("related_id"), F.col("clause_number").alias("n"), F.lit(kind).alias("kind"))
    children = targets.join(near.select("job_id", F.col("clause_id").alias("child"), F.col("parent_clause_id").alias("clause_id"), "clause_number"), ["job_id", "clause_id"])
    refs = targets.join(references.select("job_id", "clause_id", "resolved_target_id", F.col("reference_order").alias("clause_number")), ["job_id", "clause_id"])
    rows = pick(at, "previous_id", 0).unionAll(pick(at, "next_id", 1)).unionAll(pick(at, "parent_clause_id", 2)).unionAll(pick(children, "child", 3)).unionAll(pick(refs, "resolved_target_id", 4))
    rows = rows.where("related_id is not null").groupBy("job_id", "issue_id", "related_id").agg(F.min(F.struct("n", "kind")).alias("first"))
    rows = rows.join(targets.select("job_id", "issue_id", F.col("clause_id").alias("related_id")), ["job_id", "issue_id", "related_id"], "left_anti")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("job_id", "issue_id").orderBy("first", "related_id"))).where(F.col("rank") <= most).drop("first")


def fallback_targets(issues: DataFrame, clauses: DataFrame, most: int = FALLBACK) -> DataFrame:
    """Clauses that share most grams with an issue of the same job (job_id, issue_id, text; job_id, clause_id, text): an equi-join on (job, gram), counted."""
    grams = lambda df, key: df.select("job_id", key, F.explode(X.gram_set(F.col("text"))).alias("gram"))
    shared = grams(issues, "issue_id").join(grams(clauses, "clause_id"), ["job_id", "gram"]).groupBy("job_id", "issue_id", "clause_id").agg(F.count("*").alias("overlap"))
    return shared.withColumn("rank", F.row_number().over(Window.partitionBy("job_id", "issue_id").orderBy(F.desc("overlap"), "clause_id"))).where(F.col("rank") <= most)


def within_budget(sizes: DataFrame, keys: list[str], size: str, most: int) -> DataFrame:
    """Totals with what they exceed: budgets fail, they never truncate."""
    out = sizes.groupBy(*keys).agg(F.sum(size).alias("total"))
    return out.withColumn("state", F.when(F.col("total") > most, "OVER_BUDGET").otherwise("WITHIN_BUDGET"))


def preview_limit(items: Column, budget: int = 36_000, least: int = 24, most: int = 180) -> Column:
    return F.least(F.lit(most), F.greatest(F.lit(least), F.floor(F.lit(budget) / items))).cast("int")


def cleaned_drafts(drafts: DataFrame, keys: list[str], text: str, order: str, most_chars: int) -> DataFrame:
    """Drafts with a blank or too long text told as errors, and repeated ones (white space and case apart) dropped after the first."""
    key = F.lower(X.collapsed(F.col(text)))
    rank = F.row_number().over(Window.partitionBy(*keys, "__key").orderBy(order))
    rows = drafts.withColumn("__key", key).withColumn("__rank", rank).where("__rank = 1")
    return rows.withColumn("error", F.when(F.col("__key") == "", "BLANK").when(F.length(text) > most_chars, "TOO_LONG")).drop("__key", "__rank")
