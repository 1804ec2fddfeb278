"""The queries of the training-data operators, each over the whole of its table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, html_density, language_id, multi_index, ngram_join, packing, pfair_mixing, preference, rule_ensemble, secret_scan, square_runs, stratified_search
from .common import held_out

#: A vocabulary file of the public_tokenizers package; any rank file of a byte-level BPE will do.
RANK_FILE = "byte_bpe_50k.tiktoken"
#: The tokenizer file of the same vocabulary.
TOKENIZER_FILE = "byte_bpe_50k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The byte-level BPE operator with its production vocabulary and pattern."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN, keep=keep)


def op1_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = rule_ensemble.fit(docs, _table(spark, sf_dir, "labels"))
    return rule_ensemble.score(docs.select("doc_id", "text"), model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audio.encode(_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, length(payload) - 63, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.length("pcm").cast("long").alias("pcm_bytes"),
        F.sha2("pcm", 256).alias("pcm_sha256"),
        "feature",
    )


def op3_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = preference.format_pairs(preference.neighbouring_pairs(_table(spark, sf_dir, "conversations")))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.select("pair_id", "common_turns", "prompt", "chosen", spans("chosen_mask").alias("chosen_mask"), "rejected", spans("rejected_mask").alias("rejected_mask"))


OP3_SQL = """
with turns as (
    select conv_id // 2 as pair_id, conv_id % 2 as side, coalesce(role, '') as role, coalesce("text", '') as body,
           row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce("text", '')) as k
    from conversations where conv_id is not null),
sizes as (select pair_id, side, count(*) as n from turns group by pair_id, side),
least as (select pair_id, case when count(*) = 2 then min(n) else 0 end as n from sizes group by pair_id),
unlike as (
    select a.pair_id, min(a.k) as k from turns a join turns b on a.pair_id = b.pair_id and a.k = b.k and a.side = 0 and b.side = 1
    where a.role <> b.role or a.body <> b.body group by a.pair_id),
common as (select l.pair_id, cast(coalesce(u.k - 1, l.n) as integer) as common_turns from least l left join unlike u on u.pair_id = l.pair_id),
parts as (
    select t.*, t.k <= c.common_turns as shared, '<|' || role || '|>' || chr(10) || body || '<|end|>' || chr(10) as full_text
    from turns t join common c on c.pair_id = t.pair_id),
placed as (
    select *, coalesce(sum(length(full_text)) over (partition by pair_id, side order by k rows between unbounded preceding and 1 preceding), 0) as before_all
    from parts where not shared),
spans as (
    select *, cast(before_all + length(role) + 5 as bigint) as span_start, cast(before_all + length(full_text) as bigint) as span_end from placed)
select c.pair_id, c.common_turns,
    coalesce((select string_agg(full_text, '' order by k) from parts p where p.pair_id = c.pair_id and p.side = 0 and p.shared), '') as prompt,
    coalesce((select string_agg(full_text, '' order by k) from parts p where p.pair_id = c.pair_id and p.side = 0 and not p.shared), '') as chosen,
    coalesce((select string_agg(span_start || '-' || span_end, ',' order by k) from spans s where s.pair_id = c.pair_id and s.side = 0 and role = 'assistant'), '') as chosen_mask,
    coalesce((select string_agg(full_text, '' order by k) from parts p where p.pair_id = c.pair_id and p.side = 1 and not p.shared), '') as rejected,
    coalesce((select string_agg(span_start || '-' || span_end, ',' order by k) from spans s where s.pair_id = c.pair_id and s.side = 1 and role = 'assistant'), '') as rejected_mask
from common c
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op5_html_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_pages(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings that the forest keeps; a secret itself is told by its digest only."""
    forest = secret_scan.fit(secret_scan.labelled_findings(spark))
    found = secret_scan.scan(_table(spark, sf_dir, "documents"), forest).where("is_secret")
    return found.select("doc_id", "start", "end", "pattern", "name", F.sha2("value", 256).alias("value_sha256"), "score")


def op7_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.link(_table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_join.join(_table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)
    return out.select("doc_id", "n_shingles", "component_id")


def op10_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source")
    return pfair_mixing.mix(docs).select("doc_id", "source", "block", "slot", "place", "release", "deadline")


def op11_stratified_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


OP11_SQL = """
with words as (
    select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from documents),
asked as (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark),
sizes as (select doc_id, count(*) as n from words group by doc_id),
whole as (select count(*) as docs, cast(sum(n) as bigint) as len from sizes),
normed as (select doc_id, 75 + (25 * n * docs) // len as m from sizes, whole),
held as (select doc_id, term, count(*) as tf from words where term in (select term from asked) group by doc_id, term),
weights as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from held, whole group by term, docs),
times as (select item_id, term, count(*) as k from asked group by item_id, term),
scored as (
    select t.item_id, h.doc_id, cast(sum(t.k * w.w * ((1000000000 * h.tf) // (1000 * h.tf + 12 * d.m))) as bigint) as score
    from times t join held h on h.term = t.term join weights w on w.term = t.term join normed d on d.doc_id = h.doc_id
    group by t.item_id, h.doc_id),
ranked as (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""


def op12_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    import public_tokenizers

    out = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER_FILE), public_tokenizers.path(RANK_FILE))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op13_square_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = square_runs.runs_of(square_runs.with_planted_runs(_table(spark, sf_dir, "documents")))
    n_runs = F.size("runs").cast("long").alias("n_runs")
    return found.select("doc_id", n_runs, "start", "length", "period", "exponent_milli", "runs_sha256", F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_rule_ensemble,
        op2_media_columns,
        op3_preference,
        op4_language_id,
        op5_html_density,
        op6_secret_scan,
        op7_multi_index,
        op8_byte_bpe,
        op9_ngram_join,
        op10_pfair_mixing,
        op11_stratified_search,
        op12_nnls_packing,
        op13_square_runs,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_preference": OP3_SQL, "op11_stratified_search": OP11_SQL}
