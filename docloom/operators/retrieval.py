"""Hybrid retrieval for many queries at once: exact, trigram BM25 and vector channels, fused by weighted reciprocal ranks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import checkpoint
from . import corpus, gram_index

# Fusion constant, channel weights, field weights.
RRF_K = 60
CHANNEL_WEIGHTS = {"EXACT": 4.0, "LEXICAL": 1.5, "SEMANTIC": 1.0}
FIELD_WEIGHTS = {"title": 4.0, "token": 6.0, "heading": 2.0, "text": 1.0}
#: Grams that a query is scored by in the channels of the reference's retrieval, the first ones; a search of its own takes all (gram_index.search).
QUERY_GRAMS = 32
#: Query vectors that are sent to the tasks at once, and cells of the matrix of their cosines with some rows.
BLOCK_QUERIES, CELLS = 4096, 1 << 21


def over_fetch(k: int) -> int:
    return max(6 * k, 30)


def lexical(queries: DataFrame, docs: DataFrame, fields: dict[str, float], k: int, most: int | None = QUERY_GRAMS) -> DataFrame:
    """The lexical channel of queries (query_id, query) over documents (doc_id and the fields) that have no stored index: trigram BM25, best k of each query."""
    hits, _ = gram_index.search(gram_index.index_for(docs, list(fields), queries, most), queries, k, fields, most=most)
    return _channel(hits, "LEXICAL")


def channels(queries: DataFrame, docs: DataFrame, k: int, index: gram_index.Index | None = None, fields: dict[str, float] | None = None, text_col: str = "text", most: int | None = QUERY_GRAMS) -> tuple[DataFrame, DataFrame]:
    """The lexical and the exact channel (documents whose text holds the query as it is) from one scan of an index, stored or made for this search."""
    fields = fields or {text_col: 1.0}
    hits, exact_hits = gram_index.search(index or gram_index.index_for(docs, list(fields), queries, most), queries, k, fields, docs, text_col, most)
    return _channel(hits, "LEXICAL"), ranked(exact_hits.withColumn("score", F.lit(1.0)), "EXACT", k, descending=True)


def _channel(hits: DataFrame, name: str) -> DataFrame:
    return hits.select("query_id", "doc_id", F.lit(name).alias("channel"), "rank", "score")


def ranked(scores: DataFrame, channel: str, k: int, descending: bool = False, digits: int = 9) -> DataFrame:
    """(query_id, doc_id, channel, rank, score) of the best k; ties go to the lesser id."""
    order = F.round("score", digits)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order.desc() if descending else order, "doc_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "doc_id", F.lit(channel).alias("channel"), "rank", order.alias("score"))


def semantic(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Cosine of every query vector with all vectors (query_id, vector; doc_id, vector): the best k, ties to the lesser id.

    The queries are a stated set; they go in blocks of BLOCK_QUERIES, each sent to all tasks, which hold their rows against the block as one
    matrix and keep the best k of each query; the shuffle gets k rows for each query and batch at most. Null vectors and vectors of another length match nothing."""
    width = F.size("vector")
    asked = queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("vector"), width.alias("w"))
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-asked.count() // BLOCK_QUERIES)))))
    out, kind = None, queries.schema["query_id"].dataType.simpleString()
    doc = vectors.schema["doc_id"].dataType.simpleString()
    source = vectors.where("vector is not null").select("doc_id", F.col("vector").cast("array<double>").alias("vector"))
    for block in sorted(r["block"] for r in numbered.select("block").distinct().collect()):
        rows = numbered.where(F.col("block") == block).select("query_id", "vector").collect()  # about BLOCK_QUERIES rows
        best = source.mapInArrow(_nearest([r[0] for r in rows], [r[1] for r in rows], k), f"query_id {kind}, doc_id {doc}, score double")
        out = best if out is None else out.unionAll(best)
    if out is None:
        out = source.join(asked.limit(0)).select("query_id", "doc_id", F.lit(0.0).alias("score"))
    return ranked(out, "SEMANTIC", k, descending=True)


def _nearest(ids: list, asked: list[list[float]], k: int):
    """The k best rows of every query, more where they tie to nine digits; some rows at a time (CELLS), each held against the best that the task has found so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_width: dict[int, list[int]] = {}
        for i, v in enumerate(asked):
            by_width.setdefault(len(v), []).append(i)
        matrices = {width: np.array([asked[i] for i in queries]) for width, queries in by_width.items()}
        best = {width: np.full((len(queries), k), -np.inf) for width, queries in by_width.items()}  # the k best cosines so far
        for batch in batches:
            lists = batch.column("vector")
            lengths, flat = np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(zero_copy_only=False)
            begins = np.concatenate(([0], np.cumsum(lengths)))[:-1]
            for width, queries in by_width.items():
                every, step, q = np.flatnonzero(lengths == width), max(1, CELLS // len(queries)), matrices[width]
                for rows in (every[a : a + step] for a in range(0, len(every), step)):
                    x = flat[begins[rows][:, None] + np.arange(width)]
                    norms = np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1))
                    cosine = np.divide(q @ x.T, norms, out=np.zeros(norms.shape), where=norms != 0)
                    rounded = np.round(cosine, 9)
                    top = np.concatenate((best[width], np.partition(rounded, -min(k, len(rows)), axis=1)[:, -min(k, len(rows)) :]), axis=1)
                    best[width] = np.partition(top, -k, axis=1)[:, -k:]
                    at, row = np.nonzero(rounded >= best[width].min(axis=1)[:, None] - 2e-9)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([ids[queries[i]] for i in at]), batch.column("doc_id").take(pa.array(rows[row])), pa.array(cosine[at, row])], names=["query_id", "doc_id", "score"])

    return run


def fuse(*channels: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(query_id, doc_id, fused_score, exact_hit, channels): sum of weight / (60 + rank)."""
    weights = weights or CHANNEL_WEIGHTS
    rows = channels[0]
    for more in channels[1:]:
        rows = rows.unionByName(more)
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("channel")]
    return rows.groupBy("query_id", "doc_id").agg(
        F.sum(weight / (RRF_K + F.col("rank"))).alias("fused_score"), F.bool_or(F.col("channel") == "EXACT").alias("exact_hit"), F.array_sort(F.collect_list(F.struct("channel", "rank"))).alias("channels")
    )


def top(fused: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """Exact hits first, then by fused score, then by id; the best k of each query."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("exact_hit"), F.round("fused_score", digits).desc(), "doc_id"))
    return fused.withColumn("final_rank", rank).where(F.col("final_rank") <= k)


def applicable(hits: DataFrame, requests: DataFrame, versions: DataFrame) -> DataFrame:
    """Hits (query_id, authority_id, version_id, ...) whose version is the one that applies as of the query's date; the filter comes after the ranking."""
    asked = hits.join(requests.select("query_id", "as_of"), "query_id").select("query_id", "authority_id", "as_of").distinct()
    known = corpus.resolve_versions(asked, versions, ["query_id", "authority_id"]).where("state = 'RESOLVED'").select("query_id", "authority_id", "version_id")
    return hits.join(known, ["query_id", "authority_id", "version_id"], "left_semi")


def recognized_authority(queries: DataFrame, authorities: DataFrame) -> DataFrame:
    """(query_id, authority_id) where exactly one authority's title (three characters or more) is in the query.

    A query holds a title if a window of the title's length is the title, so windows and titles meet by equality: a query has a row for each of its
    characters and each length that titles have, however many titles are alike in part. The lengths are looked up in the driver, a number each."""
    titles = authorities.select("authority_id", X.title_key(F.col("title")).alias("key")).where(F.length("key") >= 3).distinct()
    lengths = sorted(r[0] for r in titles.select(F.length("key")).distinct().collect())
    key = X.title_key(F.col("query"))
    windows = F.array_distinct(F.flatten(F.array(*[F.regexp_extract_all(key, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1)) for n in lengths])) if lengths else F.expr("cast(array() as array<string>)"))
    asked = queries.select("query_id", F.explode(windows).alias("key"))
    hits = asked.join(titles.hint("merge"), "key")  # a table's size on disk tells nothing of its windows: neither side may be sent whole to all tasks
    return hits.groupBy("query_id").agg(F.count("*").alias("n"), F.min("authority_id").alias("authority_id")).where("n = 1").drop("n")


def article_ordinal(query: Column, hint: Column | None = None) -> Column:
    """The article's number in a hint, else in the query."""
    number = lambda c: X.positive_numeral(F.regexp_extract(c, r"第([零〇一二三四五六七八九十百千万两\d]+)条", 1))
    return F.coalesce(number(hint), number(query)) if hint is not None else number(query)


def exact(requests: DataFrame, resolved: DataFrame, articles: DataFrame) -> DataFrame:
    """Citations: (query_id, authority_id, ordinal) to the article of the resolved version."""
    at = requests.join(resolved.where("state = 'RESOLVED'").select("query_id", "authority_id", "version_id").hint("merge"), ["query_id", "authority_id"])
    hit = at.join(articles.hint("merge"), (at["authority_id"] == articles["authority_id"]) & (at["version_id"] == articles["version_id"]) & (at["ordinal"] == articles["article_ordinal"]))
    return hit.select("query_id", articles["legal_evidence_id"].alias("doc_id"), F.lit("EXACT").alias("channel"), F.lit(1).alias("rank"), F.lit(1.0).alias("score"))


def retrieval_state(recognized: Column, resolution: Column, explicit_missing: Column, has_candidates: Column, has_excerpts: Column, index_ready: Column) -> Column:
    """The state of a retrieval; the first row of the decision table that fits."""
    with_authority = (
        F.when(resolution == "AMBIGUOUS", "VERSION_AMBIGUOUS").when(resolution == "NO_APPLICABLE_VERSION", "NO_APPLICABLE_VERSION").when(explicit_missing, "INSUFFICIENT_CORPUS")
    ).when(has_candidates & has_excerpts, "PARTIAL_COVERAGE").when(has_candidates, "OK").otherwise("INSUFFICIENT_CORPUS")
    without = F.when(explicit_missing, "INSUFFICIENT_CORPUS").when(~has_candidates & ~index_ready, "INDEX_NOT_READY").when(has_candidates & has_excerpts, "PARTIAL_COVERAGE").when(has_candidates, "OK").otherwise("INSUFFICIENT_CORPUS")
    return F.when(recognized, with_authority).otherwise(without)


# Codes of what a retrieval warns of, in the order in which they are told; the fourth names the evidence.
UNKNOWN_EVIDENCE, ARTICLE_NOT_STORED, INDEX_NOT_READY, MISSING_EVIDENCE, EXCERPTS = "EVIDENCE_ID_UNKNOWN", "ARTICLE_NOT_IN_STORED_VERSION", "INDEX_NOT_READY", "INDEX_REFERENCES_MISSING_EVIDENCE", "CURATED_EXCERPT_CORPUS"
NO_MATCH, VERSION_REVIEW = "NO_LEGAL_EVIDENCE_MATCHED", "VERSION_RESOLUTION_REQUIRES_REVIEW"


@dataclass(frozen=True)
class Run:
    """What a retrieval gives: candidates (query_id, final_rank, doc_id, authority_id, version_id, fused_score, exact_hit, channels), queries (query_id, state, channels_executed,
    warnings in order, each once) and resolutions (query_id, authority_id, state, version_id, candidates) of all authorities that were looked at."""

    candidates: DataFrame
    queries: DataFrame
    resolutions: DataFrame


def run(requests: DataFrame, articles: DataFrame, versions: DataFrame, authorities: DataFrame, index: gram_index.Index | None, k: int = 5, weights: dict[str, float] | None = None) -> Run:
    """Retrieval for all requests at once, from citations and an index, as of each request's date.

    requests: query_id, query, as_of, and evidence_id_hint if there are any; articles: doc_id, authority_id, version_id, article_ordinal; versions: authority_id, version_id,
    effective_date, end_date_exclusive, coverage_type; authorities: authority_id, title. Every authority that a request cites, or that a hit is of, is resolved once
    for it; only then are hits of other versions left out and the best k taken. Without an index citations are answered alone."""
    if "evidence_id_hint" not in requests.columns:
        requests = requests.withColumn("evidence_id_hint", F.lit(None).cast(articles.schema["doc_id"].dataType))
    known = recognized_authority(requests, authorities)
    asked = checkpoint(requests.join(known, "query_id", "left").withColumn("ordinal", article_ordinal(F.col("query"))))  # read by every step below
    if index is not None:
        hits, _ = gram_index.search(index, requests.select("query_id", "query"), over_fetch(k), weights or {f: 1.0 for f in index.fields}, most=QUERY_GRAMS)
        lexical_hits = checkpoint(_channel(hits, "LEXICAL"))
    else:
        lexical_hits = asked.limit(0).select("query_id", F.col("evidence_id_hint").alias("doc_id"), F.lit("LEXICAL").alias("channel"), F.lit(1).alias("rank"), F.lit(0.0).alias("score"))
    at = articles.select("doc_id", "authority_id", "version_id")
    placed = lexical_hits.select("query_id", "doc_id").join(at, "doc_id", "left")
    hints = asked.where("evidence_id_hint is not null").select("query_id", F.col("evidence_id_hint").alias("doc_id")).join(at, "doc_id", "left")
    cited = asked.where("authority_id is not null and ordinal is not null").select("query_id", "authority_id", "ordinal")
    looked_at = cited.select("query_id", "authority_id").unionByName(placed.select("query_id", "authority_id")).unionByName(hints.select("query_id", "authority_id")).where("authority_id is not null").distinct()
    resolved = checkpoint(corpus.resolve_versions(looked_at.join(asked.select("query_id", "as_of"), "query_id"), versions, ["query_id", "authority_id"]))
    valid = resolved.where("state = 'RESOLVED'").select("query_id", "authority_id", "version_id")
    found = cited.join(valid, ["query_id", "authority_id"]).join(articles.select("authority_id", "version_id", F.col("article_ordinal").alias("ordinal"), "doc_id"), ["authority_id", "version_id", "ordinal"], "left")
    exact_hits = hints.join(valid, ["query_id", "authority_id", "version_id"]).select("query_id", "doc_id", F.lit(1).alias("nth")).unionByName(found.where("doc_id is not null").select("query_id", "doc_id", F.lit(2).alias("nth")))
    exact_hits = exact_hits.groupBy("query_id", "doc_id").agg(F.min("nth").alias("nth"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("nth", "doc_id"))
    exact_channel = checkpoint(exact_hits.select("query_id", "doc_id", F.lit("EXACT").alias("channel"), rank.alias("rank"), F.lit(1.0).alias("score")))
    fused = fuse(lexical_hits, exact_channel).join(at, "doc_id").join(valid, ["query_id", "authority_id", "version_id"], "left_semi")
    candidates = checkpoint(top(fused, k).select("query_id", "final_rank", "doc_id", "authority_id", "version_id", "fused_score", "exact_hit", "channels"))
    missing = placed.where("authority_id is null").groupBy("query_id").agg(F.array_sort(F.collect_set(F.concat_ws(":", F.lit(MISSING_EVIDENCE), "doc_id"))).alias("missing"))
    flag = lambda rows, name: rows.select("query_id").distinct().withColumn(name, F.lit(True))
    rows = asked.select("query_id", "authority_id").join(resolved.select("query_id", "authority_id", F.col("state").alias("resolution")), ["query_id", "authority_id"], "left")
    for part in (flag(hints.where("authority_id is null"), "no_evidence"), flag(found.where("doc_id is null"), "no_article"), flag(candidates, "any"), flag(exact_channel, "cites"), missing):
        rows = rows.join(part, "query_id", "left")
    excerpts = versions.agg(F.coalesce(F.bool_or(F.col("coverage_type") == "CURATED_EXCERPT"), F.lit(False)).alias("excerpts"))  # one row
    rows = rows.join(F.broadcast(excerpts)).na.fill(False, ["no_evidence", "no_article", "any", "cites"])
    c, ready = F.col, F.lit(index is not None)
    said = F.array(F.when(c("no_evidence"), UNKNOWN_EVIDENCE), F.when(c("no_article"), ARTICLE_NOT_STORED), F.when(~ready & ~c("cites"), INDEX_NOT_READY))
    told = F.array_compact(F.concat(said, F.coalesce("missing", F.expr("cast(array() as array<string>)")), F.array(F.when(c("excerpts"), EXCERPTS))))
    state = retrieval_state(c("authority_id").isNotNull(), c("resolution"), c("no_evidence") | c("no_article"), c("any"), c("excerpts"), ready)
    executed = F.array_compact(F.array(F.when(c("cites"), "EXACT"), F.when(ready, "LEXICAL")))
    return Run(candidates, rows.select("query_id", state.alias("state"), executed.alias("channels_executed"), told.alias("warnings")), resolved)


def issue_packages(issues: DataFrame, result: Run) -> DataFrame:
    """Of issues (issue_id, query_index, query_id): legal evidence (each document once, with the queries that met it), what the evidence supports, and the warnings of its queries in order, each once."""
    runs = issues.join(result.queries, "query_id")
    hits = issues.join(result.candidates, "query_id").select("issue_id", "query_index", "doc_id", F.col("final_rank").alias("rank"), "exact_hit", "fused_score")
    each = deduplicated(hits, "issue_id")
    best = F.array_sort(F.collect_list(F.struct("best_rank", ~F.col("exact_hit"), (-F.col("fused_score")).alias("by"), "doc_id")))
    evidence = each.groupBy("issue_id").agg(F.transform(best, lambda b: b["doc_id"]).alias("legal_evidence"))
    said = F.array_sort(F.collect_list(F.struct("query_index", "warnings")))
    named = F.flatten(F.transform(said, lambda q: F.transform(q["warnings"], lambda w: F.format_string("query %d: %s", q["query_index"], w))))
    out = runs.groupBy("issue_id").agg(F.collect_list("state").alias("states"), F.array_distinct(named).alias("of_queries")).join(evidence, "issue_id", "left")
    hit_count = F.coalesce(F.size("legal_evidence"), F.lit(0))
    out = out.withColumn("support_state", support_state(F.col("states"), hit_count))
    last = F.when(F.col("support_state") == "NO_MATCH_IN_LOCAL_CORPUS", NO_MATCH).when(F.col("support_state") == "VERSION_REVIEW_REQUIRED", VERSION_REVIEW)
    none = F.coalesce("legal_evidence", F.expr("array()").cast(evidence.schema["legal_evidence"].dataType))
    return out.select("issue_id", none.alias("legal_evidence"), "support_state", F.array_compact(F.concat("of_queries", F.array(last))).alias("warnings"))


def deduplicated(hits: DataFrame, *keys: str) -> DataFrame:
    """Hits of several queries of one issue (keys, doc_id, query_index, rank, exact_hit, fused_score): the best of each document and the queries that met it."""
    best = F.struct("rank", ~F.col("exact_hit"), "query_index")
    return hits.groupBy(*keys, "doc_id").agg(
        F.min("rank").alias("best_rank"), F.min_by("exact_hit", best).alias("exact_hit"), F.min_by("fused_score", best).alias("fused_score"), F.array_sort(F.collect_list("query_index")).alias("query_indexes")
    )


def support_state(states: Column, hits: Column) -> Column:
    """What an issue's retrievals (their states as an array) and number of hits come to."""
    limited = F.exists(states, lambda s: s.isin("NO_APPLICABLE_VERSION", "VERSION_AMBIGUOUS"))
    return (
        F.when((hits > 0) & F.forall(states, lambda s: s == "OK"), "EVIDENCE_FOUND").when(hits > 0, "EVIDENCE_FOUND_WITH_LIMITATIONS").when(limited, "VERSION_REVIEW_REQUIRED").otherwise("NO_MATCH_IN_LOCAL_CORPUS")
    )


def index_state(stored: Column, current: Column) -> Column:
    """Whether an index was built from the corpus as it is now."""
    return F.when(stored.isNull(), "MISSING").when(stored == current, "READY").otherwise("STALE")
