"""The smaller steps around reviews: baseline topics, hints, drafts, links, progress, queues, bounded tools."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import corpus

# Topics of every contract (topic, what to ask, what to search for), and those of each type.
GENERAL_TOPICS = [
    ("合同主体与授权", "当事人身份、签约主体及授权安排是否明确且前后一致？", "合同 当事人 签约主体 授权"),
    ("交易标的与范围", "交易标的、数量、范围或服务边界是否足够明确？", "合同 标的 数量 服务范围 明确"),
    ("价款与结算", "价款、支付触发条件、期限、税费和结算安排是否明确且相互一致？", "合同 价款 支付 结算 税费"),
    ("履行与交付", "履行时间、地点、方式、交付义务及协作义务是否明确？", "合同 履行 交付 时间 地点 协作"),
    ("质量与验收", "质量标准、验收主体、程序、期限及不合格处理是否明确？", "合同 质量标准 验收 检验 不合格"),
    ("期限与生效", "合同期限、生效条件、续展和关键日期安排是否清楚？", "合同 期限 生效 条件 续展"),
    ("违约责任", "主要违约情形、责任承担、损失赔偿和违约金安排是否完整且协调？", "合同 违约责任 赔偿损失 违约金"),
    ("变更解除与终止", "变更、解除、终止的触发条件、程序及后果是否明确？", "合同 变更 解除 终止 后果"),
    ("不可抗力与风险事件", "不可抗力及其他风险事件的通知、减损和后果分配是否明确？", "合同 不可抗力 通知 减损 风险分配"),
    ("保密知识产权与数据", "保密、知识产权、成果归属和数据处理安排是否与交易相匹配？", "合同 保密 知识产权 成果归属 数据"),
    ("争议解决", "适用法律、管辖、仲裁或争议解决条款是否明确且相互一致？", "合同 争议解决 管辖 仲裁"),
    ("通知附件与文件优先级", "通知方式、附件引用、文件组成及冲突时的优先顺序是否明确？", "合同 通知 附件 文件优先顺序"),
]
TYPE_TOPICS = {
    "PURCHASE": [("所有权与风险转移", "标的物所有权及毁损灭失风险何时转移？", "买卖合同 所有权 风险转移"), ("质保与售后", "质量保证期、维修更换及售后责任是否明确？", "买卖合同 质量保证 维修 更换")],
    "SERVICE": [("服务标准与SLA", "服务成果、服务标准、响应时限或SLA是否可验证？", "服务合同 服务标准 SLA 履行"), ("人员与分包", "关键人员、更换人员、转委托或分包限制是否明确？", "服务合同 转委托 分包 人员")],
    "LEASE": [
        ("租赁物权属与用途", "租赁物权属、交付状态、约定用途及限制是否明确？", "租赁合同 租赁物 权属 用途"),
        ("押金维修与返还", "押金、维修责任、费用承担和返还条件是否明确？", "租赁合同 押金 维修 返还"),
        ("转租与提前退租", "转租限制及提前解除、退租后果是否明确？", "租赁合同 转租 解除 返还"),
    ],
    "EMPLOYMENT": [
        ("岗位工时与工作地点", "岗位职责、工作地点、工时及调整机制是否明确？", "劳动合同 工作内容 工作地点 工作时间"),
        ("薪酬福利与试用期", "工资、奖金、福利、试用期及支付条件是否明确？", "劳动合同 工资 试用期 福利"),
        ("解除离职与限制义务", "解除、离职、保密、竞业限制及经济补偿安排是否需要重点审查？", "劳动合同 解除 竞业限制 经济补偿"),
    ],
    "CONSTRUCTION": [
        ("工程范围与工期", "工程范围、开竣工、工期顺延及关键节点是否明确？", "建设工程 工程范围 工期 顺延"),
        ("工程价款与变更签证", "计价方式、进度款、结算、设计变更和签证机制是否明确？", "建设工程 价款 结算 变更 签证"),
        ("质量验收与保修", "质量标准、竣工验收、缺陷责任和保修安排是否完整？", "建设工程 质量 验收 保修"),
        ("安全与分包", "安全责任、分包转包和现场管理责任是否明确？", "建设工程 安全 分包 转包"),
    ],
    "TECHNOLOGY": [("技术成果与知识产权", "背景知识产权、开发成果、许可范围和第三方权利风险是否明确？", "技术合同 技术成果 知识产权 许可"), ("技术交付与验收", "技术指标、里程碑、测试验收及缺陷修复标准是否明确？", "技术合同 技术指标 交付 验收")],
    "LOAN": [("本金利息与还款", "本金、利率、计息、还款计划及提前还款安排是否明确？", "借款合同 本金 利率 还款"), ("担保与加速到期", "担保、违约事件及提前到期机制是否明确？", "借款合同 担保 违约 提前到期")],
    "EQUITY": [
        ("交易标的与交割", "股权范围、价格、支付、先决条件和交割步骤是否明确？", "股权转让 交易价款 先决条件 交割"),
        ("陈述保证与赔偿", "陈述保证、披露、赔偿和责任限制机制是否完整？", "股权交易 陈述保证 赔偿 责任限制"),
        ("治理与权利限制", "表决、分红、优先权、转让限制或退出安排是否需要审查？", "股权协议 公司治理 转让限制 退出"),
    ],
}
TOOLS = ("inspect_contract_evidence", "get_clause_context", "inspect_legal_evidence", "retrieve_more_legal", "resolve_contract_reference", "request_ocr_retry")
MOST_CYCLES = 2
PROGRESS = (10, 25, 38, 48, 58, 68, 82, 92, 100)


def baseline(spark: SparkSession, contracts: DataFrame) -> DataFrame:
    """The topics to review of each contract (job_id, contract_type): the general ones, then its type's; the list is configuration and is broadcast."""
    rows = [(None, i, *t) for i, t in enumerate(GENERAL_TOPICS)] + [(k, len(GENERAL_TOPICS) + i, *t) for k, ts in TYPE_TOPICS.items() for i, t in enumerate(ts)]
    topics = spark.createDataFrame(rows, "type string, seq int, topic string, question string, query string")
    return contracts.join(F.broadcast(topics), F.col("type").isNull() | (F.col("type") == F.col("contract_type"))).drop("type")


def hash_embedding(text: Column, dimension: int = 32) -> Column:
    """A test embedding: signed counts of hashed character pairs, of length one; no model stands behind it."""
    flat = X.topic_key(text)
    pairs = F.when(F.length(flat) > 1, F.regexp_extract_all(flat, F.lit("(?s)(?=(..))"), F.lit(1))).otherwise(F.array(flat))
    hashed = F.transform(pairs, lambda g: F.sha2(g, 256))
    spot = lambda h: F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dimension
    sign = lambda h: F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.aggregate(hashed, F.lit(0.0), lambda s, h: s + F.when(spot(h) == i, sign(h)).otherwise(0.0)))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def embedded(rows: DataFrame, encode: Callable[[list[str]], list[list[float]]], provider: str, model: str, keep: list[str], text_col: str = "text") -> DataFrame:
    """Vectors by a provider that is handed in, with its name, model and dimension; a provider is called by the batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = encode([t or "" for t in batch.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(vectors, pa.list_(pa.float32()))], names=[*keep, "vector"])

    kinds = ", ".join(f"{k} {t}" for k, t in rows.select(*keep).dtypes)
    out = rows.select(*keep, text_col).mapInArrow(run, f"{kinds}, vector array<float>")
    return out.withColumns({"provider": F.lit(provider), "model": F.lit(model), "dimension": F.size("vector")})


def usable_vectors(vectors: DataFrame, provider: str, model: str, dimension: int) -> DataFrame:
    """Stored vectors that a query's provider may be compared with."""
    return vectors.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("dimension") == dimension))


def rule_hints(results: DataFrame) -> DataFrame:
    """Rule results that a plan has to look at."""
    return results.where(F.col("state").isin("FAIL", "REVIEW"))


def restricted_hints(hints: DataFrame, chunk_objects: Column, keep_global: bool) -> DataFrame:
    """Hints cut down to a chunk's objects; of those left with none, only global ones stay (and only where asked)."""
    out = hints.withColumn("had", F.size("object_ids")).withColumn("object_ids", F.filter("object_ids", lambda x: F.array_contains(chunk_objects, x)))
    return out.where((F.size("object_ids") > 0) | (F.lit(keep_global) & (F.col("had") == 0))).drop("had")


def draft_summary(drafts: DataFrame, *keys: str) -> DataFrame:
    """Topics of local drafts (topic, priority_rank, seq, object_ids): first spelling, greatest priority, occurrences, objects in order of first sight."""
    from .planning import ordered_unique

    rows = drafts.withColumn("topic_key", X.topic_key(F.col("topic")))
    out = rows.groupBy(*keys, "topic_key").agg(F.min_by("topic", "seq").alias("topic"), F.max("priority_rank").alias("priority_rank"), F.count("*").alias("occurrences"), ordered_unique(F.col("object_ids"), F.col("seq")).alias("object_ids"))
    return out.withColumn("fact_id", X.stable_id("local-topic-", F.col("topic_key"), 12))


def classification_summary(drafts: DataFrame, *keys: str) -> DataFrame:
    return drafts.groupBy(*keys, F.concat_ws("/", "contract_type", "confidence").alias("classification")).agg(F.count("*").alias("local_pass_count"))


def combined_hash(passes: DataFrame, *keys: str) -> DataFrame:
    """The digest of the passes' response hashes, a line each, in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("pass_number", "response_hash"))), lambda p: p["response_hash"])
    return passes.groupBy(*keys).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("combined_hash"))


def uppercase_amounts(found: DataFrame, jobs: DataFrame) -> DataFrame:
    """Amounts in words ask for review; jobs without one are no case. found: matches of kind RMB_WORDS with job_id."""
    seen = found.where("kind = 'RMB_WORDS'").groupBy("job_id").agg(F.array_sort(F.collect_list("value")).alias("observed"))
    out = jobs.join(seen, "job_id", "left")
    return out.withColumn("state", F.when(F.col("observed").isNull(), "NOT_APPLICABLE").otherwise("REVIEW")).withColumn("reason_code", F.when(F.col("observed").isNull(), "NO_UPPERCASE_RMB_TEXT").otherwise("UPPERCASE_RMB_PARSER_NOT_ENABLED"))


def validate_secondary(outputs: DataFrame) -> DataFrame:
    """Second reviews checked against the primary results (primary_state, primary_conclusion, support_state, targets): rejected, or with the coverage lowered."""
    c = F.col
    has_c, has_l = F.size("contract_ids") > 0, F.size("legal_ids") > 0
    affirms = c("assessment").isin("SUPPORTED", "PARTIALLY_SUPPORTED")
    reject = (
        F.when(c("issue_id") != c("primary_issue_id"), "ISSUE_MISMATCH")
        .when((F.size(F.array_except("contract_ids", "allowed_contract")) > 0) | (F.size(F.array_except("legal_ids", "allowed_legal")) > 0), "UNKNOWN_EVIDENCE")
        .when(affirms & (~has_c | (c("primary_conclusion") & ~has_l)), "SUPPORT_WITHOUT_EVIDENCE")
        .when((c("coverage_assessment") == "POSSIBLE_OMISSION") & (~has_c | (F.coalesce("omission_title", F.lit("")) == "") | (F.coalesce("omission_reasoning", F.lit("")) == "")), "OMISSION_NOT_STATED")
        .when((c("assessment") == "SUPPORTED") & (c("primary_state") == "NO_MATERIAL_RISK_FOUND") & ~(has_c & has_l & (c("support_state") == "EVIDENCE_FOUND")), "NO_RISK_NOT_SHOWN")
    )
    no_target = (c("targets") == 0) & c("coverage_assessment").isin("COVERED", "COVERED_BUT_QUESTIONABLE")
    limited = ~no_target & c("support_state").isin("NO_MATCH_IN_LOCAL_CORPUS", "VERSION_REVIEW_REQUIRED") & (c("coverage_assessment") == "COVERED")
    out = outputs.withColumn("rejected", reject).withColumn("final_coverage", F.when(no_target | limited, "INSUFFICIENT_EVIDENCE").otherwise(c("coverage_assessment")))
    return out.withColumn("added_reasons", F.array_compact(F.array(F.when(no_target, F.lit("NO_TARGET_CONTRACT_EVIDENCE")), F.when(limited, F.lit("LEGAL_EVIDENCE_LIMITS_COVERAGE_CONFIDENCE")))))


def inspected_evidence(cited: DataFrame, articles: DataFrame, versions: DataFrame) -> DataFrame:
    """Cited articles (action_id, position, legal_evidence_id, as_of): found and applicable, or why not; an action is rejected from its first bad citation on."""
    rows = cited.join(articles.select("legal_evidence_id", "authority_id", F.col("version_id").alias("own_version")), "legal_evidence_id", "left")
    asked = rows.where("authority_id is not null").select("authority_id", "as_of").distinct()
    known = corpus.resolve_versions(asked, versions, ["authority_id", "as_of"]).select("authority_id", "as_of", "version_id")
    rows = rows.join(known, ["authority_id", "as_of"], "left")
    verdict = F.when(F.col("authority_id").isNull(), "NOT_FOUND").when(F.coalesce(F.col("version_id") != F.col("own_version"), F.lit(True)), "NOT_APPLICABLE").otherwise("OK")
    rows = rows.withColumn("verdict", verdict)
    bad = F.max(F.when(F.col("verdict") != "OK", 1).otherwise(0)).over(Window.partitionBy("action_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("returned", bad == 0)


def run_tools(actions: DataFrame, tools: dict[str, Callable[[DataFrame], DataFrame]], cycle: int) -> DataFrame:
    """Requested actions (action_id, tool, ...) by the tools that are handed in (rows to (action_id, output_ids)); unknown tools are rejected, missing ones unavailable."""
    if cycle >= MOST_CYCLES:
        raise ValueError(f"at most {MOST_CYCLES} cycles are allowed")
    done = None
    for name, tool in tools.items():
        part = tool(actions.where(F.col("tool") == name)).select("action_id", F.array_sort(F.array_distinct("output_ids")).alias("output_ids"))
        done = part if done is None else done.unionByName(part)
    known = F.col("tool").isin(*TOOLS)
    out = actions if done is None else actions.join(done, "action_id", "left")
    outputs = F.col("output_ids") if done is not None else F.lit(None)
    return out.withColumn("state", F.when(~known, "REJECTED").when(~F.col("tool").isin(*(tools or [""])), "UNAVAILABLE").when(outputs.isNull(), "FAILED").otherwise("COMPLETED"))


def links(headers: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """Pairwise checks of a job's artifacts by one row of fingerprints a job: (link, left column, right column)."""
    checks = F.array(*[F.struct(F.lit(n).alias("link"), F.when(F.col(a).isNull() | F.col(b).isNull(), "MISSING").when(F.col(a) == F.col(b), "READY").otherwise("MISMATCH").alias("state")) for n, a, b in pairs])
    return headers.select("job_id", F.explode(checks).alias("c")).select("job_id", "c.link", "c.state")


def structure_summary(jobs: DataFrame, clauses: DataFrame, mentions: DataFrame) -> DataFrame:
    """Counts of a contract's parts. mentions: job_id, type, resolution_state."""
    n = clauses.groupBy("job_id").agg(F.count("*").alias("clauses"))
    kinds = ("PARTY", "DATE", "MONEY", "PERCENT", "IDENTIFIER", "REFERENCE")
    m = mentions.groupBy("job_id").agg(*[F.count_if(F.col("type") == k).alias(k.lower()) for k in kinds], F.count_if((F.col("type") == "REFERENCE") & (F.col("resolution_state") != "RESOLVED")).alias("unresolved_references"))
    return jobs.join(n, "job_id", "left").join(m, "job_id", "left").na.fill(0)


def progress(stages: DataFrame) -> DataFrame:
    """Of (job_id, position, complete): the progress reached up to each stage, never falling."""
    done = F.when(F.col("complete"), F.element_at(F.array(*map(F.lit, PROGRESS)), F.col("position").cast("int"))).otherwise(0)
    return stages.withColumn("progress", F.max(done).over(Window.partitionBy("job_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)))


def latest_useful_batch(batches: DataFrame) -> DataFrame:
    """The last registered batch that has a job."""
    return batches.where(F.size("job_ids") > 0).agg(F.max_by("batch_id", F.struct("registered_at", "batch_id")).alias("batch_id"))


def filtered_queue(rows: DataFrame, least_severity: str | None = None, attention_only: bool = False, state: str | None = None, search: str = "", columns: tuple[str, ...] = ("title",)) -> DataFrame:
    """A review queue as a reader asks for it."""
    from .review import SEVERITY, rank_of

    if least_severity:
        rows = rows.where(rank_of(F.col("severity")) >= SEVERITY[least_severity])
    if attention_only:
        rows = rows.where("needs_attention")
    if state:
        rows = rows.where(F.col("overall_state") == state)
    return rows.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(search.lower()))) if search else rows


def migration_snapshot(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files (job_id, path, content) against what a migration stored of them (job_id, path, sha256)."""
    rows = stored.join(files.select("job_id", "path", F.sha2("content", 256).alias("now")), ["job_id", "path"], "left")
    return rows.withColumn("state", F.when(F.col("now").isNull(), "MISSING").when(F.col("now") == F.col("sha256"), "INTACT").otherwise("TAMPERED"))


def token_usage(calls: DataFrame, *keys: str) -> DataFrame:
    """Sums of known token counts; unknown where none is known."""
    return calls.groupBy(*keys).agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
