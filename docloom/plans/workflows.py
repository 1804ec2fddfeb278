"""Queries on imports, recognised pages, citations, validators, job states and planning steps, made from the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import artifacts, batch, corpus, extraction, ingest, planning, quality, retrieval, review, rules, workflow
from ..sources import validation
from .reviews import _pick, _pick_sql
from .tables import spread, table

TOP = 5


def _k() -> Column:
    return F.col("k")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr("o_custkey as job_id", "o_orderkey as k", "o_orderstatus as s")


def _nothing() -> Column:
    return F.expr("cast(array() as array<string>)")


def _some(*pairs):
    """The ids whose condition holds, as an array."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def weighted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT2: BM25 over four fields of weights 4, 6, 2 and 1: source, language, beginning and text of a document."""
    queries = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", F.concat(F.lit("src"), F.col("item_id") % 20), F.substring("text", 1, 20)).alias("query"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), F.concat("lang", F.lit(" src1")).alias("token"), F.substring("text", 1, 60).alias("heading"), "text")
    hits = retrieval.lexical(queries, spread(docs), retrieval.FIELD_WEIGHTS, TOP)
    return hits.select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


FIELDS_SQL = f"""
with q as (select item_id as query_id, lower(regexp_replace('src' || item_id % 20 || ' ' || substr("text", 1, 20), '[^0-9A-Za-z\\x{{4e00}}-\\x{{9fff}}]+', '', 'g')) as q from benchmark),
qall as (select query_id, i, substr(q, i, 3) as gram from (select query_id, q, unnest(range(1, greatest(length(q) - 1, 1))) as i from q where length(q) >= 3)),
qfirst as (select query_id, gram, min(i) as i from qall group by query_id, gram),
qg as (select query_id, gram from (select *, row_number() over (partition by query_id order by i) as r from qfirst) where r <= 32),
fields as (select doc_id, 4.0 as w, coalesce(source, '') as t from documents union all select doc_id, 6.0, coalesce(lang || ' src1', '') from documents union all select doc_id, 2.0, coalesce(substr("text", 1, 60), '') from documents union all select doc_id, 1.0, coalesce("text", '') from documents),
chars as (select doc_id, w, string_split(lower(t), '') as c from fields where length(t) >= 3),
dall as (select doc_id, w, c[i] || c[i + 1] || c[i + 2] as gram from (select doc_id, w, c, unnest(range(1, greatest(len(c) - 1, 1))) as i from chars where len(c) >= 3)),
found as (select doc_id, gram, cast(sum(w) as double) as f from dall where gram in (select gram from qg) group by doc_id, gram),
size as (select doc_id, sum(greatest(length(t) - 2, 0)) as d from fields group by doc_id),
stats as (select count(*) as n, avg(d) as m from size),
idf as (select gram, greatest(1e-6, ln((n - count(*) + 0.5) / (count(*) + 0.5))) as w from found, stats group by gram, n),
scores as (select qg.query_id, found.doc_id, -sum(idf.w * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / m))) as score
    from qg join idf on qg.gram = idf.gram join found on found.gram = qg.gram join size on size.doc_id = found.doc_id, stats group by qg.query_id, found.doc_id),
r as (select *, row_number() over (partition by query_id order by round(score, 9), doc_id) as rank from scores)
select query_id, doc_id, rank, round(score, 4) as score from r where rank <= {TOP}
"""


def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC11, JN4: nations as records to import, some of which are stored, with the same content or another."""
    nations = table(spark, sf_dir, "nation").selectExpr("concat('a', n_regionkey) as authority_id", "concat('v', n_nationkey) as version_id", "n_nationkey as k", "concat('title ', n_regionkey) as identity", "sha2(n_name, 256) as source_sha256", "upper(n_name) as articles")
    regions = table(spark, sf_dir, "region").selectExpr("concat('a', r_regionkey) as authority_id", "if(r_regionkey = 3, 'another title', concat('title ', r_regionkey)) as identity")
    stored = nations.where("k % 3 = 0").select("authority_id", "version_id", F.when(_k() % 2 == 0, F.col("source_sha256")).otherwise("old").alias("source_sha256"), F.when(_k() % 4 == 0, "old").otherwise(F.col("articles")).alias("articles"))
    return corpus.import_plan(nations, regions, stored).select("authority_id", "version_id", "outcome", F.array_join("conflicts", ",").alias("conflicts"))


IMPORT_SQL = """with c as (select n_regionkey as r, n_nationkey as k, list_filter([case when n_regionkey = 3 then 'AUTHORITY_IDENTITY_CONFLICT' end, case when n_nationkey % 6 = 3 then 'SOURCE_VERSION_IDENTITY_CONFLICT' end,
    case when n_nationkey % 12 = 0 then 'ARTICLE_IDENTITY_CONFLICT' end], lambda x: x is not null) as codes from nation)
select 'a' || r as authority_id, 'v' || k as version_id, case when len(codes) > 0 then 'CONFLICT' when k % 3 = 0 then 'NO_CHANGE' else 'NEW' end as outcome, array_to_string(codes, ',') as conflicts from c"""


def record_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SC9: records written from orders, some with a wrong id, status, date, order of dates, count or source, held against the closed schema."""
    k = "o_orderkey"
    record = f"""to_json(named_struct('authority', if({k} % 19 = 0, null, named_struct('authority_id', concat('law-', if({k} % 7 = 0, 'A', 'a'), {k}), 'title', if({k} % 23 = 0, '', 'title'), 'authority_type', 'LAW', 'issuing_body', 'body')),
        'version_id', concat('v', {k}), 'status', if({k} % 5 = 0, 'ACTIVE', 'EFFECTIVE'), 'effective_date', if({k} % 11 = 0, 'soon', date_format(o_orderdate, 'yyyy-MM-dd')),
        'end_date_exclusive', if({k} % 3 = 0, date_format(date_add(cast(o_orderdate as date), if({k} % 2 = 0, 30, 0)), 'yyyy-MM-dd'), null), 'coverage_type', 'FULL_TEXT',
        'source_refs', if({k} % 13 = 0, array(), array(named_struct('name', 'n', 'url', if({k} % 17 = 0, 'file:x', 'https://example.org/x'), 'role', 'TEXT'))), 'snapshot_path', 'p', 'expected_source_sha256', sha2(cast({k} as string), 256),
        'expected_article_count', {k} % 4, 'inclusion_reason', 'r'))"""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record_id"), F.expr(record).alias("record"))
    return validation.validated(rows).select("record_id", "valid", F.array_join("violations", ",").alias("violations"))


RECORD_SQL = """with o as (select o_orderkey as k from orders),
v as (select k, list_filter([case when k % 19 = 0 then 'authority:missing' end, case when k % 19 <> 0 and k % 7 = 0 then 'authority.authority_id:string_pattern_mismatch' end, case when k % 19 <> 0 and k % 23 = 0 then 'authority.title:string_too_short' end,
    case when k % 5 = 0 then 'status:enum' end, case when k % 11 = 0 then 'effective_date:date_parsing' end, case when k % 13 = 0 then 'source_refs:too_short' end, case when k % 4 = 0 then 'expected_article_count:greater_than_equal' end,
    case when k % 13 <> 0 and k % 17 = 0 then 'source_refs.0.url:string_pattern_mismatch' end, case when k % 3 = 0 and k % 2 = 1 and k % 11 <> 0 then 'end_date_exclusive:value_error' end], lambda x: x is not null) as found from o)
select k as record_id, len(found) = 0 as valid, array_to_string(found, ',') as violations from v"""


def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1: counts of a corpus of regions, nations and suppliers."""
    versions = table(spark, sf_dir, "nation").selectExpr("if(n_nationkey % 3 = 0, 'REPEALED', 'EFFECTIVE') as status", "if(n_nationkey % 4 = 0, 'CURATED_EXCERPT', 'FULL_TEXT') as coverage_type")
    return corpus.summary(table(spark, sf_dir, "region"), versions, table(spark, sf_dir, "supplier"))


SUMMARY_SQL = """select (select count(*) from region) as authority_count, count(*) as version_count, count(*) filter (n_nationkey % 3 <> 0) as effective_version_count, count(*) filter (n_nationkey % 4 = 0) as excerpt_version_count,
    (select count(*) from supplier) as article_count from nation"""


def ocr_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG6, PF5: lines of orders as recognised pages: what became of each job, and its pages of low confidence."""
    state = F.when(F.col("l_orderkey") % 5 == 0, "OCR_FAILED").when(F.col("l_linenumber") % 3 == 0, "OCR_FAILED").when(F.col("l_returnflag") == "R", "OCR_NO_TEXT").when(F.col("l_linestatus") == "F", "NATIVE_RETAINED").when(F.col("l_quantity") < 34, "OCR_LOW_CONFIDENCE").otherwise("OCR_COMPLETE")
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job_id"), state.alias("state"), F.when(F.col("l_quantity") < 40, F.col("l_quantity") / 40).alias("mean_confidence"))
    low = pages.groupBy("job_id").agg(F.count_if(ingest.low_confidence(F.col("mean_confidence"))).alias("low_pages"))
    return ingest.ocr_summary(pages).withColumn("mean_confidence", F.round("mean_confidence", 6)).join(low, "job_id")


OCR_SQL = """with p as (select l_orderkey as job_id, case when l_orderkey % 5 = 0 or l_linenumber % 3 = 0 then 'f' when l_returnflag = 'R' then 't' when l_linestatus = 'F' then 'n' when l_quantity < 34 then 'l' else 'c' end as s, case when l_quantity < 40 then l_quantity / 40 end as c from lineitem),
g as (select job_id, count(*) as pages, count(*) filter (s = 'n') as native_pages, count(*) filter (s <> 'n') as attempted_pages, count(*) filter (s in ('l', 'c')) as complete_pages, count(*) filter (s = 'l') as low_confidence_pages,
    count(*) filter (s = 'f') as failed_pages, count(*) filter (s = 't') as no_text_pages, round(avg(c), 6) as mean_confidence, count(*) filter (c is null or c < 0.85) as low_pages from p group by 1)
select *, case when failed_pages = pages then 'failed' when failed_pages > 0 or no_text_pages > 0 then 'partial' else 'complete' end as status from g"""


def exact_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT3, JN5, JN6, EX18: questions that name a law and an article, as of a date, resolved to the article of the version in force."""
    orders = table(spark, sf_dir, "orders")
    asked = orders.select(F.col("o_orderkey").alias("query_id"), F.concat(F.lit("《customer"), F.lpad(F.col("o_custkey").cast("string"), 6, "0"), F.lit("法》第"), (F.col("o_orderkey") % 4 + 1).cast("string"), F.lit("条怎么说")).alias("query"), F.date_add(F.col("o_orderdate").cast("date"), 100).alias("as_of"))
    names = orders.select(F.col("o_custkey").alias("authority_id")).distinct().select("authority_id", F.concat(F.lit("customer"), F.lpad(F.col("authority_id").cast("string"), 6, "0"), F.lit("法")).alias("title"))
    known = retrieval.recognized_authority(asked, names)
    from .tables import intervals

    versions = intervals(spark, sf_dir)
    requests = asked.join(known.hint("merge"), "query_id").select("query_id", "authority_id", "as_of", retrieval.article_ordinal(F.col("query")).alias("ordinal"))
    resolved = corpus.resolve_versions(requests.select("query_id", "authority_id", "as_of"), versions, ["query_id", "authority_id"])
    articles = versions.select("authority_id", "version_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(3).cast("long"))).alias("article_ordinal")).withColumn("legal_evidence_id", F.concat_ws("-", "version_id", "article_ordinal"))
    return retrieval.exact(requests.drop("as_of"), resolved, articles).select("query_id", "doc_id", "channel", "rank")


CITATIONS_SQL = """with v as (select o_custkey as a, o_orderkey as v, cast(o_orderdate as date) as s, cast(lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as date) as e from orders),
q as (select o_custkey as a, o_orderkey as query_id, cast(o_orderdate as date) + 100 as d, o_orderkey % 4 + 1 as n from orders),
r as (select q.query_id, n, min(v.v) as v from q join v on q.a = v.a and v.s <= q.d and (v.e is null or q.d < v.e) group by q.query_id, n having count(*) = 1)
select query_id, v || '-' || n as doc_id, 'EXACT' as channel, 1 as rank from r where n <= 3"""


def benchmark_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG13, JN11: suppliers' parts as cases of assertions on JSON documents: pass rates of assertions, cases and task families."""
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey as k", "p_size", "p_brand")
    check = lambda name, pointer, comparison, expected, tolerance="cast(null as double)": f"named_struct('assertion_id', '{name}', 'pointer', '{pointer}', 'comparison', '{comparison}', 'expected', {expected}, 'tolerance', {tolerance})"
    expectations = F.expr(f"array({check('size', '/a/size', 'NUMERIC_WITHIN', "'25'", 'double(20)')}, {check('brand', '/brand', 'EXACT', "to_json(p_brand_json)")}, {check('tags', '/tags', 'SET_CONTAINS', "'[1]'")})".replace("to_json(p_brand_json)", "concat('\"', p_brand, '\"')"))
    cases = parts.select(_k().alias("case_id"), _pick(_k(), "OCR", "DETERMINISTIC_RULE", "LEGAL_RETRIEVAL").alias("task_type"), expectations.alias("expectations"))
    documents = parts.where("k % 11 <> 0").select(_k().alias("case_id"), F.to_json(F.expr("named_struct('a', named_struct('size', p_size), 'brand', if(k % 5 = 0, 'none', p_brand), 'tags', array(k % 2, 2))")).alias("observed"))
    out = quality.pass_rates(quality.evaluate_benchmark(cases, documents))
    return out.select(F.round("case_pass_rate", 6).alias("case_pass_rate"), F.round("assertion_pass_rate", 6).alias("assertion_pass_rate"), "task_families")


PASS_SQL = """with t as (select p_partkey as k, p_partkey % 11 <> 0 and abs(p_size - 25) <= 20 as a, p_partkey % 11 <> 0 and p_partkey % 5 <> 0 as b, p_partkey % 11 <> 0 and p_partkey % 2 = 1 as c from part)
select round(avg(cast(a and b and c as double)), 6) as case_pass_rate, round(avg((cast(a as double) + cast(b as double) + cast(c as double)) / 3), 6) as assertion_pass_rate, cast(3 as bigint) as task_families from t"""


def validated_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN21, FN22: both reviewers' outputs checked against what they were given."""
    rows = _orders(spark, sf_dir).select(
        _k().alias("issue_id"), _pick(_k(), "SUPPORTED_FINDING", "NO_MATERIAL_RISK_FOUND", "REVIEW_REQUIRED").alias("state"), _some(("c1", _k() % 5 != 0), ("c9", _k() % 23 == 0)).alias("contract_ids"), _some(("l1", _k() % 7 != 0), ("l9", _k() % 29 == 0)).alias("legal_ids"), (_k() % 2 == 0).alias("legal_conclusion"),
        _pick(F.floor(_k() / 2), "EVIDENCE_FOUND", "EVIDENCE_FOUND_WITH_LIMITATIONS", "NO_MATCH_IN_LOCAL_CORPUS", "VERSION_REVIEW_REQUIRED", "EVIDENCE_FOUND").alias("support_state"), F.array(F.lit("c1")).alias("allowed_contract"), F.array(F.lit("l1")).alias("allowed_legal"), (_k() % 13 == 0).alias("any_uncertain"), (_k() % 17).alias("targets"),
    )
    rows = rows.withColumn("sufficiency", review.evidence_sufficiency(F.col("targets"), F.col("any_uncertain"), F.col("support_state")))
    out = review.validate_primary(rows).withColumnRenamed("added_reasons", "primary_reasons").withColumnRenamed("rejected", "primary_rejected")
    k = F.col("issue_id")
    second = out.withColumns({"primary_issue_id": k, "assessment": _pick(F.floor(k / 3), "SUPPORTED", "DISAGREED", "PARTIALLY_SUPPORTED"), "coverage_assessment": _pick(k, "COVERED", "COVERED_BUT_QUESTIONABLE", "POSSIBLE_OMISSION", "INSUFFICIENT_EVIDENCE"), "primary_state": F.col("final_state"), "primary_conclusion": F.col("final_conclusion"), "omission_title": F.when(k % 8 != 2, F.lit("t")), "omission_reasoning": F.lit("r")})
    out = workflow.validate_secondary(second)
    return out.select("issue_id", "sufficiency", "primary_rejected", "final_state", "final_conclusion", F.array_join("primary_reasons", ",").alias("primary_reasons"), "rejected", "final_coverage", F.array_join("added_reasons", ",").alias("added_reasons"))


VALIDATED_SQL = f"""
with b as (select o_orderkey as k, {_pick_sql("o_orderkey", "SUPPORTED_FINDING", "NO_MATERIAL_RISK_FOUND", "REVIEW_REQUIRED")} as s, o_orderkey % 5 <> 0 or o_orderkey % 23 = 0 as c, o_orderkey % 7 <> 0 or o_orderkey % 29 = 0 as l, o_orderkey % 23 = 0 as xc, o_orderkey % 29 = 0 as xl, o_orderkey % 2 = 0 as con,
    {_pick_sql("(o_orderkey // 2)", "EVIDENCE_FOUND", "EVIDENCE_FOUND_WITH_LIMITATIONS", "NO_MATCH_IN_LOCAL_CORPUS", "VERSION_REVIEW_REQUIRED", "EVIDENCE_FOUND")} as sup, o_orderkey % 13 = 0 as unc, o_orderkey % 17 as n,
    {_pick_sql("(o_orderkey // 3)", "SUPPORTED", "DISAGREED", "PARTIALLY_SUPPORTED")} as a, {_pick_sql("o_orderkey", "COVERED", "COVERED_BUT_QUESTIONABLE", "POSSIBLE_OMISSION", "INSUFFICIENT_EVIDENCE")} as cov from orders),
f as (select *, case when n = 0 then 'CONTRACT_EVIDENCE_INSUFFICIENT' when unc then 'SOURCE_UNCERTAIN' when sup = 'VERSION_REVIEW_REQUIRED' then 'LEGAL_VERSION_UNCERTAIN' when sup = 'NO_MATCH_IN_LOCAL_CORPUS' then 'INSUFFICIENT_LEGAL_CORPUS' when sup = 'EVIDENCE_FOUND_WITH_LIMITATIONS' then 'PARTIAL_LEGAL_CORPUS' else 'SUFFICIENT' end as sufficiency,
    case when xc then 'UNKNOWN_CONTRACT_EVIDENCE' when xl then 'UNKNOWN_LEGAL_EVIDENCE' when s = 'SUPPORTED_FINDING' and not c then 'SUPPORTED_WITHOUT_EVIDENCE' when con and (s = 'REVIEW_REQUIRED' or not l or sup in ('NO_MATCH_IN_LOCAL_CORPUS', 'VERSION_REVIEW_REQUIRED')) then 'CONCLUSION_NOT_ALLOWED'
        when s = 'NO_MATERIAL_RISK_FOUND' and not (c and l and con) then 'NO_RISK_WITHOUT_EVIDENCE' end as rej from b),
g as (select *, case when rej is not null then null when s = 'NO_MATERIAL_RISK_FOUND' and (sup <> 'EVIDENCE_FOUND' or unc) then 'NO_MATERIAL_RISK_NOT_ALLOWED_WITH_INCOMPLETE_EVIDENCE'
    when s = 'SUPPORTED_FINDING' and (sufficiency = 'SOURCE_UNCERTAIN' or sup = 'VERSION_REVIEW_REQUIRED') then 'SUPPORTED_FINDING_REQUIRES_REVIEW_DUE_TO_EVIDENCE_STATE' when s = 'SUPPORTED_FINDING' and con and sup = 'EVIDENCE_FOUND_WITH_LIMITATIONS' then 'PARTIAL_LEGAL_CORPUS' end as why from f),
h as (select *, coalesce(why, '') not in ('', 'PARTIAL_LEGAL_CORPUS') as down from g),
i as (select *, case when rej is null then case when down then 'REVIEW_REQUIRED' else s end end as final_state, rej is null and not down and con as final_conclusion from h)
select k as issue_id, sufficiency, rej as primary_rejected, final_state, final_conclusion, coalesce(why, '') as primary_reasons,
    case when xc or xl then 'UNKNOWN_EVIDENCE' when a in ('SUPPORTED', 'PARTIALLY_SUPPORTED') and (not c or (final_conclusion and not l)) then 'SUPPORT_WITHOUT_EVIDENCE' when cov = 'POSSIBLE_OMISSION' and (not c or k % 8 = 2) then 'OMISSION_NOT_STATED'
        when a = 'SUPPORTED' and final_state = 'NO_MATERIAL_RISK_FOUND' and not (c and l and sup = 'EVIDENCE_FOUND') then 'NO_RISK_NOT_SHOWN' end as rejected,
    case when n = 0 and cov in ('COVERED', 'COVERED_BUT_QUESTIONABLE') or n <> 0 and sup in ('NO_MATCH_IN_LOCAL_CORPUS', 'VERSION_REVIEW_REQUIRED') and cov = 'COVERED' then 'INSUFFICIENT_EVIDENCE' else cov end as final_coverage,
    case when n = 0 and cov in ('COVERED', 'COVERED_BUT_QUESTIONABLE') then 'NO_TARGET_CONTRACT_EVIDENCE' when sup in ('NO_MATCH_IN_LOCAL_CORPUS', 'VERSION_REVIEW_REQUIRED') and cov = 'COVERED' then 'LEGAL_EVIDENCE_LIMITS_COVERAGE_CONFIDENCE' else '' end as added_reasons from i
"""


def job_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN29, SM3-SM5, RM20: architecture, status after a restart and gate of jobs."""
    new, old = "ISSUE_PRIMARY_AUDIT", "PRIMARY_AUDIT"
    rows = _orders(spark, sf_dir).select(_k().alias("job_id"), _some((new, _k() % 3 == 0), (old, _k() % 7 == 0)).alias("stages"), _some((new, _k() % 5 == 0), (old, _k() % 4 == 0)).alias("files"), (_k() % 11 == 0).alias("record"), (_k() % 2 == 0).alias("ok"), _pick(_k(), "RUNNING", "COMPLETE", "CANCEL_REQUESTED", "FAILED").alias("status"), _pick(_k(), "AUTO", "REQUIRE_APPROVAL", "LOCAL_ONLY").alias("mode"))
    return rows.select("job_id", artifacts.architecture(F.col("stages"), F.col("files"), F.col("record"), F.col("ok")).alias("architecture"), artifacts.reconciled(F.col("status")).alias("after_restart"), artifacts.migratable(F.col("status")).alias("migratable"), artifacts.provider_gate(F.col("status") == "CANCEL_REQUESTED", F.col("mode"), F.col("ok")).alias("gate"))


ARCHITECTURE_SQL = f"""
with b as (select o_orderkey as k, o_orderkey % 3 = 0 as n, o_orderkey % 7 = 0 as o, o_orderkey % 5 = 0 as fn, o_orderkey % 4 = 0 as fo, o_orderkey % 11 = 0 as r, o_orderkey % 2 = 0 as ok, {_pick_sql("o_orderkey", "RUNNING", "COMPLETE", "CANCEL_REQUESTED", "FAILED")} as s, {_pick_sql("o_orderkey", "AUTO", "REQUIRE_APPROVAL", "LOCAL_ONLY")} as m from orders)
select k as job_id, case when n and o or r and not ok or r and o then 'CONFLICT' when r or n then 'ISSUE_V1' when o then 'LEGACY_RC2' when fn and fo then 'CONFLICT' when fn then 'ISSUE_V1' when fo then 'LEGACY_RC2' else 'ISSUE_V1' end as architecture,
    case s when 'CANCEL_REQUESTED' then 'CANCELLED' when 'RUNNING' then 'FAILED' else s end as after_restart, s = 'FAILED' as migratable, case when s = 'CANCEL_REQUESTED' then 'CANCEL' when m = 'LOCAL_ONLY' or (m = 'REQUIRE_APPROVAL' and not ok) then 'PAUSE' else 'ALLOWED' end as gate from b
"""


def retrieval_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FN23: the state of a retrieval by what was recognised, resolved and found."""
    k = F.col("o_orderkey")
    state = retrieval.retrieval_state(k % 3 == 0, _pick(k, "RESOLVED", "AMBIGUOUS", "NO_APPLICABLE_VERSION", "RESOLVED", "RESOLVED"), k % 7 == 0, k % 2 == 0, k % 4 == 0, k % 11 != 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"))


RETRIEVAL_SQL = f"""with b as (select o_orderkey as k, {_pick_sql("o_orderkey", "RESOLVED", "AMBIGUOUS", "NO_APPLICABLE_VERSION", "RESOLVED", "RESOLVED")} as r from orders)
select k as o_orderkey, case when k % 3 = 0 and r = 'AMBIGUOUS' then 'VERSION_AMBIGUOUS' when k % 3 = 0 and r = 'NO_APPLICABLE_VERSION' then r when k % 7 = 0 then 'INSUFFICIENT_CORPUS' when k % 4 = 0 then 'PARTIAL_COVERAGE' when k % 2 = 0 then 'OK'
    when k % 3 <> 0 and k % 11 = 0 then 'INDEX_NOT_READY' else 'INSUFFICIENT_CORPUS' end as state from b"""


def decision_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG22, WN5: events as decisions on a customer's orders; what is resolved on the report of today, outstanding or stale."""
    log = table(spark, sf_dir, "events").selectExpr("user_id % 1000 + 1 as job_id", "event_id % 15000 + 1 as target_id", "ts", "event_id", "event_type as state", "concat('f', event_id % 2) as report_fingerprint")
    latest = review.latest_revision(log, ["job_id", "target_id"], ["ts", "event_id"]).select("job_id", "target_id", "state", "report_fingerprint")
    every = _orders(spark, sf_dir).select((F.col("job_id") % 1000 + 1).alias("job_id"), F.col("k").alias("target_id"))
    reports = every.select("job_id").distinct().withColumn("fingerprint", F.concat(F.lit("f"), F.col("job_id") % 2))
    return review.closure(every, latest, reports)


CLOSURE_SQL = """with r as (select o_custkey % 1000 + 1 as job_id, o_orderkey as t from orders),
l as (select * from (select user_id % 1000 + 1 as job_id, event_id % 15000 + 1 as t, event_id % 2 as f, row_number() over (partition by user_id % 1000 + 1, event_id % 15000 + 1 order by ts desc, event_id desc) as n from events) where n = 1)
select r.job_id, count(*) as required, count(*) filter (l.f = r.job_id % 2) as resolved, count(*) filter (l.f is null or l.f <> r.job_id % 2) as outstanding, count(*) filter (l.f <> r.job_id % 2) as stale_latest from r left join l on l.job_id = r.job_id and l.t = r.t group by r.job_id"""


def plan_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RM12, RM13, RM15: a language's texts as drafts and items: drafts that repeat or are too long, budgets and previews."""
    docs = table(spark, sf_dir, "documents").select("lang", "source", "doc_id", "n_chars", F.substring("text", 1, 12).alias("head"))
    drafts = planning.cleaned_drafts(docs, ["lang"], "head", "doc_id", 11).groupBy("lang").agg(F.count("*").alias("drafts"), F.count_if(F.col("error") == "TOO_LONG").alias("too_long"))
    budget = planning.within_budget(docs, ["lang"], "n_chars", 400_000)
    items = docs.groupBy("lang").agg(planning.preview_limit(F.count("*")).alias("preview"))
    return drafts.join(budget, "lang").join(items, "lang")


LIMITS_SQL = r"""
with d as (select lang, doc_id, n_chars, substr("text", 1, 12) as head from documents where lang is not null),
k as (select *, lower(regexp_replace(regexp_replace(head, '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', ' ', 'g'), '^ | $', '', 'g')) as key from d),
r as (select *, row_number() over (partition by lang, key order by doc_id) as n from k),
drafts as (select lang, count(*) as drafts, count(*) filter (key <> '' and length(head) > 11) as too_long from r where n = 1 group by lang)
select drafts.lang, drafts, too_long, t.total, case when t.total > 400000 then 'OVER_BUDGET' else 'WITHIN_BUDGET' end as state, t.preview
from drafts join (select lang, sum(n_chars) as total, cast(least(180, greatest(24, floor(36000 / count(*)))) as integer) as preview from d group by lang) t on t.lang = drafts.lang
"""


def severity_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG8: severities of a customer's supported findings."""
    rows = _orders(spark, sf_dir).select("job_id", _pick(_k(), "SUPPORTED_FINDING", "NO_FINDING").alias("state"), F.when(_k() % 9 != 0, _pick(F.floor(_k() / 2), "INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")).alias("severity"))
    return batch.severity_histogram(rows, "job_id")


HISTOGRAM_SQL = f"""with r as (select o_custkey as job_id, {_pick_sql("(o_orderkey // 2)", "INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")} as s from orders where o_orderkey % 2 = 0 and o_orderkey % 9 <> 0)
select job_id, {", ".join(f"count(*) filter (s = '{s}') as {s.lower()}" for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"))} from r group by job_id"""


def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN11, AG20: an order's lines as stages of a job: progress reached, and tokens used where they are known."""
    lines = table(spark, sf_dir, "lineitem").dropDuplicates(["l_orderkey", "l_linenumber"]).select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("position"), (F.col("l_linenumber") % 3 != 2).alias("complete"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") * 10).alias("input_tokens"), F.lit(None).cast("int").alias("output_tokens"))
    reached = workflow.progress(lines).groupBy("job_id").agg(F.max("progress").alias("progress"))
    return reached.join(workflow.token_usage(lines, "job_id"), "job_id")


PROGRESS_SQL = f"""with l as (select distinct l_orderkey as job_id, l_linenumber as p from lineitem)
select job_id, max(case when p % 3 <> 2 then [{", ".join(map(str, workflow.PROGRESS))}][p] else 0 end) as progress, cast(sum(case when p % 2 = 0 then p * 10 end) as bigint) as input_tokens, cast(null as bigint) as output_tokens from l group by job_id"""


def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EX14, EX15: lines with cells, and warnings of jobs without text or title, with mentions that are not resolved, or with uncertain recognised lines."""
    orders = _orders(spark, sf_dir).select(_k().alias("job_id"), "k")
    lines = orders.select("job_id", F.when(_k() % 4 == 0, F.lit("a\tb\t")).when(_k() % 4 == 1, F.lit("\t\tx")).otherwise("plain").alias("unit_text"))
    cells = extraction.table_candidates(lines).groupBy("job_id").agg(F.max("cells").alias("cells"))
    mentions = orders.where("k % 3 = 0").select("job_id", _pick(_k(), "PARTY", "DATE", "REFERENCE").alias("type"), F.concat(F.lit("m-"), _k().cast("string")).alias("mention_id"), _pick(F.floor(_k() / 3), "RESOLVED", "UNRESOLVED").alias("resolution_state"))
    units = orders.where("k % 5 <> 0").select("job_id", F.lit(1).alias("page_number"), F.lit(1).alias("unit_order"), _pick(_k(), "OCR", "NATIVE_TEXT").alias("source_method"), F.when(_k() % 3 == 0, 0.84).when(_k() % 3 == 1, 0.85).alias("confidence"))
    told = extraction.warnings(orders.select("job_id"), units, orders.where("k % 7 <> 0").select("job_id"), mentions)
    return told.select("job_id", "warning_id", "code", "subject").join(cells, "job_id", "left")


TABLE_SQL = f"""with o as (select o_orderkey as k from orders),
w as (select k, 1 as n, 'NO_TEXT_EVIDENCE' as code, '' as subject from o where k % 5 = 0 union all select k, 2, 'TITLE_UNRESOLVED', '' from o where k % 7 = 0
    union all select k, 3, {_pick_sql("k", "PARTY_NAME_UNRESOLVED", "INVALID_DATE", "REFERENCE_UNRESOLVED")}, 'm-' || k from o where k % 3 = 0 and (k // 3) % 2 = 1
    union all select k, 6, 'LOW_CONFIDENCE_OCR_SOURCE', 'p000001-u000001' from o where k % 5 <> 0 and {_pick_sql("k", "OCR", "NATIVE_TEXT")} = 'OCR' and k % 3 <> 1)
select k as job_id, 'warning-000' || row_number() over (partition by k order by n, subject) as warning_id, code, subject, case when k % 4 = 0 then 2 end as cells from w"""


def fallback_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TK5, ST6: of a conversation's turns the ones that share most grams with its first turn."""
    turns = table(spark, sf_dir, "conversations").where("text is not null")
    issues = turns.where("turn = 0").select(F.col("conv_id").alias("job_id"), F.lit("first").alias("issue_id"), "text")
    clauses = turns.where("turn > 0").select(F.col("conv_id").alias("job_id"), F.col("turn").alias("clause_id"), "text")
    return planning.fallback_targets(issues, clauses).select("job_id", "clause_id", "overlap", "rank")


FALLBACK_SQL = r"""with t as (select conv_id, turn, regexp_replace(lower("text"), '[\s\x0b\x1c-\x1f\x{85}\p{Z}]+', '', 'g') as f from conversations where "text" is not null),
g as (select conv_id, turn, unnest(case when length(f) > 2 then list_distinct(list_transform(range(1, length(f) - 1), lambda i: substr(f, i, 3))) when length(f) > 0 then [f] else [] end) as gram from t),
s as (select b.conv_id as job_id, b.turn as clause_id, count(*) as overlap from g a join g b on a.conv_id = b.conv_id and a.gram = b.gram and a.turn = 0 and b.turn > 0 group by 1, 2),
r as (select *, row_number() over (partition by job_id order by overlap desc, clause_id) as rank from s)
select * from r where rank <= 8"""


def rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG5, FN26: results of rules counted by job after poor sources have turned them into reviews."""
    rows = _orders(spark, sf_dir).select("job_id", _pick(_k(), "PASS", "FAIL", "REVIEW", "NOT_APPLICABLE").alias("state"), (_k() % 6 == 0).alias("low_confidence"), _nothing().alias("review_reasons"), F.lit(None).cast("string").alias("severity"))
    done = rules.finalized(rows)
    errors = done.groupBy("job_id").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
    return rules.counts(done, "job_id").join(errors, "job_id")


COUNTS_SQL = f"""with r as (select o_custkey as job_id, {_pick_sql("o_orderkey", "PASS", "FAIL", "REVIEW", "NOT_APPLICABLE")} as s, o_orderkey % 6 = 0 as low from orders), f as (select job_id, case when low and s in ('PASS', 'FAIL') then 'REVIEW' else s end as s from r)
select job_id, {", ".join(f"count(*) filter (s = '{s}') as {s.lower()}" for s in ("PASS", "FAIL", "REVIEW", "NOT_APPLICABLE"))}, count(*) as total, count(*) filter (s = 'FAIL') as errors, count(*) filter (s = 'REVIEW') as warnings from f group by job_id"""


QUERIES = {
    "weighted_fields": (weighted_fields, FIELDS_SQL),
    "import_outcomes": (import_outcomes, IMPORT_SQL),
    "record_validation": (record_validation, RECORD_SQL),
    "corpus_summary": (corpus_summary, SUMMARY_SQL),
    "ocr_jobs": (ocr_jobs, OCR_SQL),
    "exact_citations": (exact_citations, CITATIONS_SQL),
    "benchmark_pass_rates": (benchmark_pass_rates, PASS_SQL),
    "validated_reviews": (validated_reviews, VALIDATED_SQL),
    "job_architecture": (job_architecture, ARCHITECTURE_SQL),
    "retrieval_states": (retrieval_states, RETRIEVAL_SQL),
    "plan_limits": (plan_limits, LIMITS_SQL),
    "decision_closure": (decision_closure, CLOSURE_SQL),
    "severity_histogram": (severity_histogram, HISTOGRAM_SQL),
    "job_progress": (job_progress, PROGRESS_SQL),
    "table_lines": (table_lines, TABLE_SQL),
    "fallback_targets": (fallback_targets, FALLBACK_SQL),
    "rule_counts": (rule_counts, COUNTS_SQL),
}
