"""Retrieval queries over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, gram_index, quality, retrieval
from ..session import checkpoint, shared_folder
from .tables import intervals, spread, table

TOP = 5


def _queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _index(spark: SparkSession, sf_dir: str) -> gram_index.Index:
    """The documents' stored index. It is published in the shared folder once for a path and read by all searches of a session, unless the documents have changed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_folder(spark)}/indexes/{spark.sparkContext.applicationId}-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    try:
        return gram_index.published(spark, path, docs)
    except (FileNotFoundError, ValueError):  # none yet, or of other documents
        gram_index.publish(spread(docs), ["text"], path)
        return gram_index.published(spark, path)


def _channels(spark: SparkSession, sf_dir: str, k: int = TOP) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.channels(_queries(spark, sf_dir), docs, retrieval.over_fetch(k), _index(spark, sf_dir))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT1, RT2, TK1, SC13: the best documents of each benchmark item by trigram BM25, by all grams of the item."""
    hits, _ = gram_index.search(_index(spark, sf_dir), _queries(spark, sf_dir), TOP, {"text": 1.0})
    return hits.select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


GRAMS_SQL = """
stripped as (select item_id as query_id, lower(regexp_replace("text", '[^0-9A-Za-z\\x{4e00}-\\x{9fff}]+', '', 'g')) as q from benchmark),
qall as (select query_id, i, substr(q, i, 3) as gram from (select query_id, q, unnest(range(1, greatest(length(q) - 1, 1))) as i from stripped where length(q) >= 3)),
qfirst as (select query_id, gram, min(i) as i from qall group by query_id, gram),
qg as (select query_id, gram from (select *, row_number() over (partition by query_id order by i) as r from qfirst) where r <= 32),
chars as (select doc_id, string_split(lower("text"), '') as c from documents),
dall as (select doc_id, c[i] || c[i + 1] || c[i + 2] as gram from (select doc_id, c, unnest(range(1, greatest(len(c) - 1, 1))) as i from chars where len(c) >= 3)),
found as (select doc_id, gram, cast(count(*) as double) as f from dall where gram in (select gram from qg) group by doc_id, gram),
stats as (select count(*) as n, avg(greatest(length("text") - 2, 0)) as m from documents),
idf as (select gram, greatest(1e-6, ln((n - count(*) + 0.5) / (count(*) + 0.5))) as w from found, stats group by gram, n),
size as (select doc_id, greatest(length("text") - 2, 0) as d from documents),
scores as (
    select qg.query_id, found.doc_id, -sum(w * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / m))) as score
    from qg join idf on qg.gram = idf.gram join found on found.gram = qg.gram join size on size.doc_id = found.doc_id, stats group by qg.query_id, found.doc_id),
lexical as (select *, row_number() over (partition by query_id order by round(score, 9), doc_id) as rank from scores)
"""
EXACT_SQL = """
holds as (select b.item_id as query_id, d.doc_id from benchmark b join documents d on contains(d."text", b."text")),
exact as (select *, row_number() over (partition by query_id order by doc_id) as rank from holds)
"""
FUSED_SQL = """
channels as (
    select query_id, doc_id, 'LEXICAL' as channel, 1.5 as w, rank from lexical where rank <= 30
    union all select query_id, doc_id, 'EXACT', 4.0, rank from exact where rank <= 30),
fused as (select query_id, doc_id, sum(w / (60 + rank)) as fused_score, bool_or(channel = 'EXACT') as exact_hit from channels group by query_id, doc_id),
final as (select *, row_number() over (partition by query_id order by exact_hit desc, round(fused_score, 9) desc, doc_id) as final_rank from fused)
"""
#: As above, with all grams of a query.
WHOLE_GRAMS_SQL = GRAMS_SQL.replace(" where r <= 32", "")
BM25_SQL = f"with {WHOLE_GRAMS_SQL} select query_id, doc_id, rank, round(score, 4) as score from lexical where rank <= {TOP}"


def fused(spark: SparkSession, sf_dir: str, k: int = TOP) -> DataFrame:
    return retrieval.top(retrieval.fuse(*_channels(spark, sf_dir, k)), k)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT3, RT5, TK3: exact and lexical channels fused."""
    return fused(spark, sf_dir).select("query_id", "doc_id", "final_rank", "exact_hit", F.round("fused_score", 8).alias("fused_score"))


RRF_SQL = f"with {GRAMS_SQL}, {EXACT_SQL}, {FUSED_SQL} select query_id, doc_id, final_rank, exact_hit, round(fused_score, 8) as fused_score from final where final_rank <= {TOP}"


def as_of_filtered_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PF8, RT6: fused hits whose version applies as of the query's date. A document stands for an article of customer (doc_id mod 100) at the version of its order number."""
    versions = intervals(spark, sf_dir)
    counted = versions.withColumn("nth", F.row_number().over(_by_authority()))
    hits = fused(spark, sf_dir, 30).withColumn("authority_id", F.col("doc_id") % 100 + 1).withColumn("nth", F.floor(F.col("doc_id") / 100) % 10 + 1)
    hits = hits.join(counted.select("authority_id", "nth", "version_id"), ["authority_id", "nth"])
    requests = _queries(spark, sf_dir).select("query_id", F.expr("date_add(date'1992-06-30', cast(query_id % 7 as int) * 365)").alias("as_of"))
    return retrieval.applicable(hits, requests, versions).select("query_id", "doc_id", "authority_id", "version_id")


def _by_authority():
    from pyspark.sql import Window

    return Window.partitionBy("authority_id").orderBy("effective_date", "version_id")


INTERVALS_SQL = """
versions as (
    select o_custkey as authority_id, o_orderkey as version_id, cast(o_orderdate as date) as effective_date,
           cast(lead(o_orderdate) over (partition by o_custkey order by o_orderdate, o_orderkey) as date) as end_date from orders),
counted as (select *, row_number() over (partition by authority_id order by effective_date, version_id) as nth from versions)
"""
AS_OF_SQL = f"""
with {GRAMS_SQL}, {EXACT_SQL}, {FUSED_SQL}, {INTERVALS_SQL},
hits as (select f.query_id, f.doc_id, c.authority_id, c.version_id, cast(date '1992-06-30' + cast((f.query_id % 7) * 365 as integer) as date) as as_of
    from final f join counted c on c.authority_id = f.doc_id % 100 + 1 and c.nth = (f.doc_id // 100) % 10 + 1 where f.final_rank <= 30),
asked as (select distinct query_id, authority_id, as_of from hits),
resolved as (
    select a.query_id, a.authority_id, min(v.version_id) as version_id from asked a join versions v
    on a.authority_id = v.authority_id and v.effective_date <= a.as_of and (v.end_date is null or a.as_of < v.end_date)
    group by a.query_id, a.authority_id having count(*) = 1)
select h.query_id, h.doc_id, h.authority_id, h.version_id from hits h join resolved r on h.query_id = r.query_id and h.authority_id = r.authority_id and h.version_id = r.version_id
"""


def semantic_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT4, TK2, FN13: the vectors nearest to every hundredth one, by brute force against all."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    asked = vectors.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    return retrieval.semantic(asked, vectors, TOP + 1).where("query_id <> doc_id").select("query_id", "doc_id", F.round("score", 5).alias("score"))


SEMANTIC_SQL = f"""
with v as (select vec_id, embedding::double[] as e from embeddings),
s as (select q.vec_id as query_id, d.vec_id as doc_id, list_cosine_similarity(q.e, d.e) as score from v q join v d on q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id) as rank from s)
select query_id, doc_id, round(score, 5) as score from r where rank <= {TOP + 1} and query_id <> doc_id
"""


def query_support_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG18, AG19: benchmark items in issues of four: their hits made one, and what they come to."""
    hits = fused(spark, sf_dir).withColumn("issue", F.floor(F.col("query_id") / 4)).select("issue", "doc_id", (F.col("query_id") % 4).alias("query_index"), F.col("final_rank").alias("rank"), "exact_hit", "fused_score")
    merged = retrieval.deduplicated(hits, "issue").groupBy("issue").agg(F.count("*").alias("hits"), F.min("best_rank").alias("best_rank"), F.count_if("exact_hit").alias("exact_hits"))
    asked = _queries(spark, sf_dir).withColumn("issue", F.floor(F.col("query_id") / 4)).join(hits.select(F.col("issue").alias("i"), "query_index", "exact_hit").groupBy("i", "query_index").agg(F.bool_or("exact_hit").alias("e")), (F.col("issue") == F.col("i")) & (F.col("query_id") % 4 == F.col("query_index")), "left")
    states = asked.groupBy("issue").agg(F.collect_list(F.when(F.coalesce("e", F.lit(False)), "OK").otherwise("PARTIAL_COVERAGE")).alias("states"))
    out = states.join(merged, "issue", "left").na.fill(0, ["hits", "exact_hits"])
    return out.select("issue", "hits", "best_rank", "exact_hits", retrieval.support_state(F.col("states"), F.col("hits")).alias("support_state"))


SUPPORT_SQL = f"""
with {GRAMS_SQL}, {EXACT_SQL}, {FUSED_SQL},
top as (select *, query_id // 4 as issue from final where final_rank <= {TOP}),
best as (select issue, doc_id, min(final_rank) as best_rank from top group by issue, doc_id),
one as (select b.issue, b.doc_id, b.best_rank, bool_or(t.exact_hit) as exact_hit from best b join top t on t.issue = b.issue and t.doc_id = b.doc_id and t.final_rank = b.best_rank group by 1, 2, 3),
sums as (select issue, count(*) as hits, min(best_rank) as best_rank, count(*) filter (exact_hit) as exact_hits from one group by issue),
runs as (select b.item_id // 4 as issue, coalesce((select bool_or(exact_hit) from top t where t.query_id = b.item_id), false) as ok from benchmark b),
states as (select issue, bool_and(ok) as all_ok from runs group by issue)
select s.issue, coalesce(hits, 0) as hits, best_rank, coalesce(exact_hits, 0) as exact_hits,
    case when coalesce(hits, 0) > 0 and all_ok then 'EVIDENCE_FOUND' when coalesce(hits, 0) > 0 then 'EVIDENCE_FOUND_WITH_LIMITATIONS' else 'NO_MATCH_IN_LOCAL_CORPUS' end as support_state
from states s left join sums using (issue)
"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as requests: two of three cite a law and an article, some name their evidence."""
    k = F.col("item_id")
    law = F.concat(F.lit("《customer"), F.lpad((k % 100 + 1).cast("string"), 6, "0"), F.lit("法》第"), F.when(k % 3 == 1, 1).otherwise(9).cast("string"), F.lit("条 "))
    hint = F.when(k % 11 == 0, F.lit(-1)).when(k % 5 == 0, k * 7).cast("long")
    return table(spark, sf_dir, "benchmark").select(k.alias("query_id"), F.when(k % 3 == 0, F.col("text")).otherwise(F.concat(law, "text")).alias("query"), F.expr("date_add(date'1992-06-30', cast(item_id % 7 as int) * 365)").alias("as_of"), hint.alias("evidence_id_hint"))


def _run(spark: SparkSession, sf_dir: str) -> retrieval.Run:
    versions = intervals(spark, sf_dir)
    counted = versions.withColumn("nth", F.row_number().over(_by_authority()))
    places = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 100 + 1).alias("authority_id"), (F.floor(F.col("doc_id") / 100) % 10 + 1).alias("nth"), (F.floor(F.col("doc_id") / 1000) + 1).alias("article_ordinal"))
    articles = places.join(counted.select("authority_id", "nth", "version_id"), ["authority_id", "nth"]).drop("nth")
    authorities = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("authority_id"), F.concat(F.lit("customer"), F.lpad(F.col("c_custkey").cast("string"), 6, "0"), F.lit("法")).alias("title"))
    covered = versions.withColumn("coverage_type", F.when(F.col("version_id") % 4 == 0, "CURATED_EXCERPT").otherwise("FULL_TEXT"))
    return retrieval.run(_requests(spark, sf_dir), articles, covered, authorities, _index(spark, sf_dir), TOP)


def retrieval_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT3, RT6-RT8, RM11: a whole retrieval with citations, hints, channels, versions as of a date, states and warnings."""
    made = _run(spark, sf_dir)
    listed = made.candidates.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "doc_id", "version_id", "exact_hit"))), lambda c: F.concat_ws(":", c["doc_id"], c["version_id"], c["exact_hit"].cast("string"))), ",").alias("candidates"))
    notes = made.resolutions.groupBy("query_id").agg(F.count("*").alias("authorities"), F.count_if(F.col("state") == "RESOLVED").alias("resolved"))
    out = made.queries.join(listed, "query_id", "left").join(notes, "query_id", "left").na.fill(0, ["authorities", "resolved"])
    return out.select("query_id", "state", F.array_join("channels_executed", ",").alias("channels"), F.array_join("warnings", ",").alias("warnings"), F.coalesce("candidates", F.lit("")).alias("candidates"), "authorities", "resolved")


RUN_CTES = f"""
asked as (select item_id as query_id, case when item_id % 3 = 0 then "text" else '《customer' || lpad(cast(item_id % 100 + 1 as varchar), 6, '0') || '法》第' || case when item_id % 3 = 1 then 1 else 9 end || '条 ' || "text" end as query,
    cast(date '1992-06-30' + cast((item_id % 7) * 365 as integer) as date) as as_of, case when item_id % 3 <> 0 then (select c_custkey from customer where c_custkey = item_id % 100 + 1) end as authority_id,
    case when item_id % 3 = 1 then 1 else 9 end as ord, case when item_id % 11 = 0 then -1 when item_id % 5 = 0 then item_id * 7 end as hint from benchmark),
{GRAMS_SQL.replace("item_id as query_id, lower", "query_id, lower").replace('"text", \'[^0-9', 'query, \'[^0-9').replace("as q from benchmark", "as q from asked")}, {INTERVALS_SQL},
art as (select d.doc_id, c.authority_id, c.version_id, d.doc_id // 1000 + 1 as ord from documents d join counted c on c.authority_id = d.doc_id % 100 + 1 and c.nth = (d.doc_id // 100) % 10 + 1),
lex as (select l.query_id, l.doc_id, l.rank, a.authority_id, a.version_id from lexical l left join art a on a.doc_id = l.doc_id where l.rank <= 30),
hints as (select q.query_id, q.hint, a.doc_id, a.authority_id, a.version_id from asked q left join art a on a.doc_id = q.hint where q.hint is not null),
looked as (select query_id, authority_id from asked where authority_id is not null union select query_id, authority_id from lex where authority_id is not null union select query_id, authority_id from hints where authority_id is not null),
counts as (select l.query_id, l.authority_id, count(v.version_id) as hits, min(v.version_id) as version_id from looked l join asked q on q.query_id = l.query_id left join versions v
    on v.authority_id = l.authority_id and v.effective_date <= q.as_of and (v.end_date is null or q.as_of < v.end_date) group by 1, 2),
valid as (select * from counts where hits = 1),
cite as (select q.query_id, a.doc_id from asked q join valid v on v.query_id = q.query_id and v.authority_id = q.authority_id left join art a on a.authority_id = v.authority_id and a.version_id = v.version_id and a.ord = q.ord),
exacts as (select query_id, doc_id, row_number() over (partition by query_id order by min(nth), doc_id) as rank from (
    select h.query_id, h.doc_id, 1 as nth from hints h join valid v on v.query_id = h.query_id and v.authority_id = h.authority_id and v.version_id = h.version_id union all select query_id, doc_id, 2 from cite where doc_id is not null) group by 1, 2),
rows_ as (select query_id, doc_id, 'LEXICAL' as channel, 1.5 as w, rank from lex union all select query_id, doc_id, 'EXACT', 4.0, rank from exacts),
fused as (select r.query_id, r.doc_id, a.authority_id, a.version_id, sum(w / (60 + rank)) as f, bool_or(channel = 'EXACT') as e from rows_ r join art a on a.doc_id = r.doc_id
    join valid v on v.query_id = r.query_id and v.authority_id = a.authority_id and v.version_id = a.version_id group by 1, 2, 3, 4),
best as (select * from (select *, row_number() over (partition by query_id order by e desc, round(f, 9) desc, doc_id) as n from fused) where n <= {TOP}),
told as (select q.query_id, q.authority_id is not null as known, c.hits, coalesce((select bool_or(authority_id is null) from hints h where h.query_id = q.query_id), false) as no_evidence, coalesce((select bool_or(doc_id is null) from cite c where c.query_id = q.query_id), false) as no_article,
    exists (select 1 from best b where b.query_id = q.query_id) as any_, exists (select 1 from exacts e where e.query_id = q.query_id) as cites,
    (select string_agg(distinct 'INDEX_REFERENCES_MISSING_EVIDENCE:' || doc_id, ',' order by 'INDEX_REFERENCES_MISSING_EVIDENCE:' || doc_id) from lex l where l.query_id = q.query_id and l.authority_id is null) as missing
    from asked q left join counts c on c.query_id = q.query_id and c.authority_id = q.authority_id),
states as (select query_id, case when known and hits > 1 then 'VERSION_AMBIGUOUS' when known and hits = 0 then 'NO_APPLICABLE_VERSION' when no_evidence or no_article then 'INSUFFICIENT_CORPUS' when any_ then 'PARTIAL_COVERAGE' else 'INSUFFICIENT_CORPUS' end as state,
    case when cites then 'EXACT,LEXICAL' else 'LEXICAL' end as channels, concat_ws(',', case when no_evidence then 'EVIDENCE_ID_UNKNOWN' end, case when no_article then 'ARTICLE_NOT_IN_STORED_VERSION' end, missing, 'CURATED_EXCERPT_CORPUS') as warnings from told)
"""
RUN_SQL = f"""
with {RUN_CTES}
select s.*, coalesce((select string_agg(doc_id || ':' || version_id || ':' || case when e then 'true' else 'false' end, ',' order by n) from best b where b.query_id = s.query_id), '') as candidates,
    (select count(*) from looked l where l.query_id = s.query_id) as authorities, (select count(*) from valid v where v.query_id = s.query_id) as resolved from states s
"""


def issue_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RT8, AG18, AG19: issues of four requests each: their evidence made one, what it supports, and their warnings in order."""
    issues = _requests(spark, sf_dir).select(F.floor(F.col("query_id") / 4).alias("issue_id"), (F.col("query_id") % 4 + 1).cast("int").alias("query_index"), "query_id")
    out = retrieval.issue_packages(issues, _run(spark, sf_dir))
    short = lambda w: F.regexp_replace(w, ":[0-9]+$", "")
    return out.select("issue_id", F.array_join("legal_evidence", ",").alias("legal_evidence"), "support_state", F.array_join(F.array_distinct(F.transform("warnings", short)), ",").alias("warnings"))


ISSUE_RUN_SQL = f"""
with {RUN_CTES},
hit as (select b.query_id // 4 as issue_id, b.doc_id, min(b.n) as r, min_by(b.e, b.n * 10 + case when b.e then 0 else 1 end) as e from best b group by 1, 2),
one as (select h.issue_id, h.doc_id, h.r, h.e, min_by(b.f, b.n * 1000 + (case when b.e then 0 else 100 end) + b.query_id % 4) as f from hit h join best b on b.query_id // 4 = h.issue_id and b.doc_id = h.doc_id group by 1, 2, 3, 4),
listed as (select issue_id, count(*) as hits, string_agg(cast(doc_id as varchar), ',' order by r, not e, -f, doc_id) as legal_evidence from one group by 1),
split as (select query_id // 4 as issue_id, query_id % 4 as q, unnest(string_split(warnings, ',')) as w, generate_subscripts(string_split(warnings, ','), 1) as i from states),
firsts as (select issue_id, 'query ' || (q + 1) || ': ' || regexp_replace(w, ':[0-9]+$', '') as w, min(q * 10000 + i) as i from split group by 1, 2),
said as (select issue_id, string_agg(w, ',' order by i) as warnings from firsts group by 1),
of_issue as (select query_id // 4 as issue_id, bool_and(state = 'OK') as good, bool_or(state in ('NO_APPLICABLE_VERSION', 'VERSION_AMBIGUOUS')) as limited from states group by 1),
decided as (select o.issue_id, coalesce(l.legal_evidence, '') as legal_evidence, case when coalesce(hits, 0) > 0 and good then 'EVIDENCE_FOUND' when coalesce(hits, 0) > 0 then 'EVIDENCE_FOUND_WITH_LIMITATIONS' when limited then 'VERSION_REVIEW_REQUIRED' else 'NO_MATCH_IN_LOCAL_CORPUS' end as support_state
    from of_issue o left join listed l on l.issue_id = o.issue_id)
select d.*, concat_ws(',', s.warnings, case support_state when 'NO_MATCH_IN_LOCAL_CORPUS' then 'NO_LEGAL_EVIDENCE_MATCHED' when 'VERSION_REVIEW_REQUIRED' then 'VERSION_RESOLUTION_REQUIRES_REVIEW' end) as warnings from decided d join said s on s.issue_id = d.issue_id
"""


def ranking_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG12: recall and mean reciprocal rank of the lexical search, against all documents that hold the item, however far down the first of them is."""
    queries, index = _queries(spark, sf_dir), _index(spark, sf_dir)
    _, held = gram_index.search(index, queries, TOP, {"text": 1.0}, table(spark, sf_dir, "documents").select("doc_id", "text"))
    gold = checkpoint(held)  # read three times
    asked = queries.join(gold.select("query_id").distinct(), "query_id", "left_semi")
    out = quality.ranking_metrics(asked, gram_index.first_ranks(index, asked, gold, {"text": 1.0}), gold, TOP)
    return out.select("queries", F.round("recall_at_k", 6).alias("recall_at_k"), F.round("mrr", 6).alias("mrr"))


RANKING_SQL = f"""
with {WHOLE_GRAMS_SQL}, {EXACT_SQL},
firsts as (select g.query_id, min(l.rank) as first_rank from exact g left join lexical l on l.query_id = g.query_id and l.doc_id = g.doc_id group by g.query_id)
select count(*) as queries, round(avg(case when first_rank <= {TOP} then 1.0 else 0.0 end), 6) as recall_at_k, round(avg(coalesce(1.0 / first_rank, 0.0)), 6) as mrr from firsts
"""


def version_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN2: the version of every customer as of six dates."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("authority_id"))
    dates = F.explode(F.array(*[F.lit(f"{y}-03-15").cast("date") for y in (1992, 1993, 1994, 1996, 1998, 2001)]))
    out = corpus.resolve_versions(customers.select("authority_id", dates.alias("as_of")), intervals(spark, sf_dir), ["authority_id", "as_of"])
    return out.select("authority_id", F.col("as_of").cast("string").alias("as_of"), "hits", "state", "version_id")


VERSION_SQL = f"""
with {INTERVALS_SQL},
asked as (select c_custkey as authority_id, unnest([date '1992-03-15', date '1993-03-15', date '1994-03-15', date '1996-03-15', date '1998-03-15', date '2001-03-15']) as as_of from customer),
hits as (select a.authority_id, a.as_of, count(v.version_id) as hits, min(v.version_id) as version_id from asked a left join versions v
    on a.authority_id = v.authority_id and v.effective_date <= a.as_of and (v.end_date is null or a.as_of < v.end_date) group by 1, 2)
select authority_id, cast(as_of as varchar) as as_of, hits, case when hits = 0 then 'NO_APPLICABLE_VERSION' when hits > 1 then 'AMBIGUOUS' else 'RESOLVED' end as state,
    case when hits = 1 then version_id end as version_id from hits
"""


def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3: orders of a customer within 60 days of each other, as versions that overlap."""
    orders = table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("date")
    rows = orders.select(F.col("o_custkey").alias("authority_id"), F.col("o_orderkey").alias("version_id"), start.alias("effective_date"), F.date_add(start, 60).alias("end_date_exclusive"))
    return corpus.overlapping(rows)


OVERLAP_SQL = """
with v as (select o_custkey as authority_id, o_orderkey as version_id, cast(o_orderdate as date) as s, cast(o_orderdate as date) + 60 as e from orders)
select a.authority_id, a.version_id as version_a, b.version_id as version_b from v a join v b on a.authority_id = b.authority_id and a.version_id < b.version_id and a.s < b.e and b.s < a.e
"""

QUERIES = {
    "bm25_topk": (bm25_topk, BM25_SQL),
    "rrf_fusion": (rrf_fusion, RRF_SQL),
    "as_of_filtered_retrieval": (as_of_filtered_retrieval, AS_OF_SQL),
    "semantic_topk": (semantic_topk, SEMANTIC_SQL),
    "query_support_state": (query_support_state, SUPPORT_SQL),
    "retrieval_run": (retrieval_run, RUN_SQL),
    "issue_retrieval": (issue_retrieval, ISSUE_RUN_SQL),
    "ranking_metrics": (ranking_metrics, RANKING_SQL),
    "version_resolution": (version_resolution, VERSION_SQL),
    "interval_overlap": (interval_overlap, OVERLAP_SQL),
}
