"""Versioned source corpora: resolution as of a date, overlaps, validation of imports, catalogue, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scan

# Hosts that count as official sources.
OFFICIAL_HOSTS = "flk.npc.gov.cn www.npc.gov.cn npc.gov.cn www.court.gov.cn court.gov.cn gongbao.court.gov.cn cicc.court.gov.cn www.gov.cn gov.cn www.cac.gov.cn cac.gov.cn".split()
OPEN_END = "9999-12-31"


def applies(as_of: Column, start: Column, end: Column) -> Column:
    """Half-open validity; no end is open."""
    return (start <= as_of) & (end.isNull() | (as_of < end))


class _Open:
    """The rule of the resolution scan: a state is the versions that are open (effective date, id, how often); an effect is what it opens and closes."""

    def start(self) -> dict[tuple, int]:
        return {}

    def effect(self, effect, rows: list[tuple]):
        effect = effect or {}
        for _, kind, *key in rows:
            if kind != ASKED:
                key = tuple(key)
                effect[key] = effect.get(key, 0) + (1 if kind == STARTS else -1)
        return effect

    def after(self, state, effect):
        counts = {k: state.get(k, 0) + effect.get(k, 0) for k in state.keys() | effect.keys()}
        return {k: n for k, n in counts.items() if n}

    def run(self, state, rows: list[tuple]):
        out = []
        for at, kind, *key in rows:
            if kind == ASKED:
                out.append(([v for (_, v), n in sorted(state.items()) for _ in range(n)] if at is not None else [],))
                continue
            key = tuple(key)
            state[key] = state.get(key, 0) + (1 if kind == STARTS else -1)
            if not state[key]:
                del state[key]
            out.append(None)
        return state, out


#: Order of what happens on one day: a version that ends is closed, one that starts is open, then comes who asks.
ENDS, STARTS, ASKED = 0, 1, 2


def resolve_versions(requests: DataFrame, versions: DataFrame, request_keys: list[str], partitions: int | None = None) -> DataFrame:
    """Per request (authority_id, as_of): hits, candidates, state and version.

    Requests and the days on which versions begin and end are put in one order and scanned by ranges of (authority, day), with the open versions
    carried from task to task: nothing is joined on the authority, and an authority with any share of the rows is spread over many tasks."""
    day = versions.schema["effective_date"].dataType
    version = ("effective_date", F.col("version_id").cast("string").alias("version_id"))
    valid = versions.where(F.col("effective_date").isNotNull() & F.col("authority_id").isNotNull() & (F.col("end_date_exclusive").isNull() | (F.col("effective_date") < F.col("end_date_exclusive"))))
    asked = requests.select("authority_id", F.col("as_of").cast(day).alias("at"), F.struct(*request_keys).alias("request"))
    # dealt first, and in no fewer parts than are set: few rows repeat, so a task that looks for repeats holds all its rows, of a whole file or of what is merged for it
    asked = asked.repartition(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), *asked.columns).distinct()
    nothing = F.lit(None).cast(asked.schema["request"].dataType).alias("request")
    change = lambda at, kind: F.struct(F.col(at).cast(day).alias("at"), F.lit(kind).alias("kind"))
    both = valid.withColumn("__change", F.explode(F.array(change("effective_date", STARTS), change("end_date_exclusive", ENDS))))
    events = both.where("__change.at is not null").select("authority_id", "__change.at", "__change.kind", *version, nothing)
    events = events.unionByName(asked.withColumns({"kind": F.lit(ASKED), "effective_date": F.lit(None).cast(day), "version_id": F.lit(None).cast("string")}))
    found = scan.carried_scan(events, ["authority_id"], ["at", "kind"], ["at", "kind", "effective_date", "version_id"], ["request"], "candidates array<string>", _Open(), partitions)
    out = found.select("request.*", F.size("candidates").cast("long").alias("hits"), F.col("candidates").cast(T.ArrayType(versions.schema["version_id"].dataType)).alias("candidates"))
    out = out.withColumn("state", F.when(F.col("hits") == 0, "NO_APPLICABLE_VERSION").when(F.col("hits") > 1, "AMBIGUOUS").otherwise("RESOLVED"))
    return out.withColumn("version_id", F.when(F.col("hits") == 1, F.try_element_at("candidates", F.lit(1))))


def unknown_authorities(requests: DataFrame, authorities: DataFrame) -> DataFrame:
    """Requests for an authority that does not exist: an error, not a missing version."""
    return requests.join(authorities.select("authority_id"), "authority_id", "left_anti")


def overlapping(versions: DataFrame, order: Column | None = None) -> DataFrame:
    """Pairs of versions of an authority whose intervals overlap, each pair once.

    Intervals sorted by start overlap a later one only if some earlier end reaches beyond its start, so
    rows that none overlaps are left out by one window before the join."""
    end = F.coalesce(F.col("end_date_exclusive").cast("date"), F.lit(OPEN_END).cast("date"))
    rows = versions.select("authority_id", "version_id", F.col("effective_date").alias("s"), end.alias("e")).where("s < e")
    by_start = Window.partitionBy("authority_id").orderBy("s", "version_id")
    earlier = F.max("e").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    later = F.min("s").over(by_start.rowsBetween(1, Window.unboundedFollowing))
    live = rows.withColumn("b", earlier).withColumn("n", later).where("b > s or n < e").drop("b", "n")
    a, b = live.alias("a"), live.alias("b")
    both = (F.col("a.authority_id") == F.col("b.authority_id")) & (F.col("a.version_id") < F.col("b.version_id")) & (F.col("a.s") < F.col("b.e")) & (F.col("b.s") < F.col("a.e"))
    return a.join(b, both).select("a.authority_id", F.col("a.version_id").alias("version_a"), F.col("b.version_id").alias("version_b"))


def official(source_refs: Column) -> Column:
    """Every reference names an official host (there is one at least)."""
    return (F.size(source_refs) > 0) & F.forall(source_refs, lambda r: F.lower(F.regexp_extract(r["url"], r"^[a-zA-Z]+://([^/:?#]+)", 1)).isin(OFFICIAL_HOSTS))


def validate_records(records: DataFrame, parsed: DataFrame, allow_non_official: bool = False) -> DataFrame:
    """Issues of each record (authority_id, version_id, source_refs, snapshot_text, expected_source_sha256, expected_article_count), critical ones and others.

    parsed: (authority_id, version_id, article_token, problem) of the snapshot's articles."""
    from ..functions.text import snapshot

    seen = parsed.groupBy("authority_id", "version_id").agg(F.count("*").alias("articles"), F.count_if(F.col("problem") == "DUPLICATE_TOKEN").alias("twice"), F.count_if(F.col("problem") == "EMPTY_ARTICLE").alias("empty"))
    rows = records.join(seen, ["authority_id", "version_id"], "left").na.fill(0, ["articles", "twice", "empty"])
    issue = lambda cond, code, critical=True: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(critical).alias("critical")))
    issues = F.array(
        issue(~official(F.col("source_refs")), "UNRECOGNIZED_SOURCE_HOST", not allow_non_official),
        issue(F.col("snapshot_text").isNull(), "SNAPSHOT_READ_FAILED"),
        issue(F.sha2(snapshot(F.col("snapshot_text")), 256) != F.col("expected_source_sha256"), "SOURCE_HASH_MISMATCH"),
        issue(F.col("empty") > 0, "ARTICLE_PARSE_FAILED"),
        issue(F.col("twice") > 0, "DUPLICATE_ARTICLE_TOKEN"),
        issue(F.col("articles") != F.col("expected_article_count"), "ARTICLE_COUNT_MISMATCH"),
    )
    out = rows.withColumn("issues", F.array_compact(issues))
    return out.withColumn("accepted", ~F.exists("issues", lambda i: i["critical"]))


# Codes of what an import may not overwrite.
AUTHORITY_CONFLICT, VERSION_CONFLICT, ARTICLE_CONFLICT = "AUTHORITY_IDENTITY_CONFLICT", "SOURCE_VERSION_IDENTITY_CONFLICT", "ARTICLE_IDENTITY_CONFLICT"


def import_plan(records: DataFrame, stored_authorities: DataFrame, stored_versions: DataFrame) -> DataFrame:
    """Per accepted record (authority_id, version_id, identity, source_sha256, articles): NEW, NO_CHANGE or CONFLICT, with the codes of its conflicts.

    identity: a string of the authority's fields; articles: a digest of its articles' tokens and hashes. A stored version with another source
    is a conflict of versions; only one with the same source is held against its articles."""
    rows = records.join(stored_authorities.select("authority_id", F.col("identity").alias("old_identity")), "authority_id", "left")
    old = stored_versions.select("authority_id", "version_id", F.col("source_sha256").alias("old_source"), F.col("articles").alias("old_articles"))
    rows = rows.join(old, ["authority_id", "version_id"], "left")
    same_source = F.col("old_source") == F.col("source_sha256")
    codes = F.array_compact(
        F.array(
            F.when(F.col("old_identity") != F.col("identity"), F.lit(AUTHORITY_CONFLICT)),
            F.when(~same_source, F.lit(VERSION_CONFLICT)),
            F.when(same_source & ~F.col("old_articles").eqNullSafe(F.col("articles")), F.lit(ARTICLE_CONFLICT)),
        )
    )
    out = rows.withColumn("conflicts", codes)
    return out.withColumn("outcome", F.when(F.size("conflicts") > 0, "CONFLICT").when(F.col("old_source").isNotNull(), "NO_CHANGE").otherwise("NEW"))


def summary(authorities: DataFrame, versions: DataFrame, articles: DataFrame) -> DataFrame:
    """One row of counts; each side is aggregated to one row before they are put together."""
    v = versions.agg(F.count("*").alias("version_count"), F.count_if(F.col("status") == "EFFECTIVE").alias("effective_version_count"), F.count_if(F.col("coverage_type") == "CURATED_EXCERPT").alias("excerpt_version_count"))
    parts = [authorities.agg(F.count("*").alias("authority_count")), v, articles.agg(F.count("*").alias("article_count"))]
    out = parts[0].withColumn("one", F.lit(1))
    for part in parts[1:]:
        out = out.join(part.withColumn("one", F.lit(1)), "one")
    return out.drop("one")


def catalogue(authorities: DataFrame, versions: DataFrame, articles: DataFrame) -> DataFrame:
    """Per authority its versions in order with their numbers of articles."""
    sizes = articles.groupBy("authority_id", "version_id").agg(F.count("*").alias("articles"))
    rows = versions.join(sizes, ["authority_id", "version_id"], "left").na.fill(0, ["articles"])
    listed = rows.groupBy("authority_id").agg(F.array_sort(F.collect_list(F.struct("effective_date", "version_id", "status", "articles"))).alias("versions"))
    return authorities.join(listed, "authority_id", "left")


def fingerprint(rows: DataFrame, order: str, *parts: str) -> DataFrame:
    """sha256 of the rows, a line each ("a:b:c"), in the order of one column; for tables of catalogue size, as the result is one hash of one text."""
    line = F.concat_ws(":", *[F.col(p).cast("string") for p in parts])
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return rows.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("fingerprint"))


def evidence(articles: DataFrame, versions: DataFrame, authorities: DataFrame) -> DataFrame:
    """Articles with their version and authority."""
    return articles.join(versions, ["authority_id", "version_id"]).join(authorities, "authority_id")
