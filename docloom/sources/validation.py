"""Closed validation of JSON records: every field of a schema held against its type, pattern, length, choices and least value, in one scan and by column expressions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A field by its path in the record. kind: string, date, integer, array or object."""

    path: str
    kind: str = "string"
    required: bool = True
    pattern: str | None = None
    least_length: int = 0
    choices: tuple[str, ...] = ()
    least: int | None = None


# Choices and patterns of corpus records.
AUTHORITY_TYPES = ("LAW", "ADMINISTRATIVE_REGULATION", "JUDICIAL_INTERPRETATION")
STATUSES = ("NOT_YET_EFFECTIVE", "EFFECTIVE", "SUPERSEDED", "AMENDED", "REPEALED", "UNKNOWN")
COVERAGES = ("FULL_TEXT", "CURATED_EXCERPT")
ROLES = ("PRIMARY", "TEXT", "METADATA", "CROSS_CHECK")
PARSERS = ("chinese-articles-v1",)
AUTHORITY_ID, VERSION_ID, SHA256 = r"^[a-z0-9][a-z0-9._-]{2,127}$", r"^[a-z0-9][a-z0-9._-]{1,127}$", r"^[a-f0-9]{64}$"
RECORD = (
    Field("authority", "object"),
    Field("authority.authority_id", pattern=AUTHORITY_ID),
    Field("authority.title", least_length=1),
    Field("authority.authority_type", choices=AUTHORITY_TYPES),
    Field("authority.issuing_body", least_length=1),
    Field("authority.document_number", required=False),
    Field("version_id", pattern=VERSION_ID),
    Field("status", choices=STATUSES),
    Field("publication_date", "date", required=False),
    Field("effective_date", "date"),
    Field("end_date_exclusive", "date", required=False),
    Field("repeal_date", "date", required=False),
    Field("supersedes_version_id", required=False),
    Field("superseded_by_version_id", required=False),
    Field("coverage_type", choices=COVERAGES),
    Field("source_refs", "array", least_length=1),
    Field("snapshot_path", least_length=1),
    Field("expected_source_sha256", pattern=SHA256),
    Field("expected_article_count", "integer", least=1),
    Field("parser", required=False, choices=PARSERS),
    Field("inclusion_reason", least_length=1),
    Field("verified_on", "date", required=False),
)
#: What the items of source_refs hold.
SOURCE_REF = (Field("name"), Field("url", pattern=r"^https?://[^/?#\s]+"), Field("role", choices=ROLES))
#: (later, earlier, may be equal): what a record's dates must keep to.
DATE_ORDER = (("end_date_exclusive", "effective_date", False), ("repeal_date", "effective_date", True))

_KINDS = {"string": "STRING", "date": "STRING", "array": "ARRAY", "object": "OBJECT"}


def _variant_path(path: str) -> str:
    return "$" + "".join(f".{p}" for p in path.split("."))


def _get(variant: Column, path: str, kind: str) -> Column:
    return F.call_function("try_variant_get", variant, F.lit(_variant_path(path)), F.lit(kind))


def _read(variant: Column, fields: tuple[Field, ...]) -> Column:
    """struct(kinds, texts, sizes) of a record's fields, each looked up once: kind of value (null: absent), value as text, and length of an array."""
    kinds = F.array(*[F.call_function("schema_of_variant", _get(variant, f.path, "variant")) for f in fields])
    sizes = F.array(*[F.size(_get(variant, f.path, "array<variant>")) if f.kind == "array" else F.lit(None).cast("int") for f in fields])
    return F.struct(kinds.alias("kinds"), F.array(*[_get(variant, f.path, "string") for f in fields]).alias("texts"), sizes.alias("sizes"))


def issue(seen: Column, fields: tuple[Field, ...], at: int) -> Column:
    """The code of what is wrong with the field at a place, or null. A field that a parent lacks is not told again."""
    field, here, text = fields[at], seen["kinds"][at], seen["texts"][at]
    absent, empty = here.isNull(), here == "VOID"
    out = F.when(absent, F.lit("missing") if field.required else F.lit(None))
    if not field.required:
        out = out.when(empty, F.lit(None))
    # a whole number may be written as text or with an empty fraction
    sound = text.rlike(r"^[+-]?\d+(\.0+)?$") if field.kind == "integer" else F.startswith(here, F.lit(_KINDS[field.kind]))
    out = out.when(~F.coalesce(sound, F.lit(False)), f"{field.kind}_type")
    if field.kind == "date":
        out = out.when(text.try_cast("date").isNull() | ~text.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date_parsing")
    if field.choices:
        out = out.when(~text.isin(*field.choices), "enum")
    if field.pattern:
        out = out.when(~text.rlike(field.pattern), "string_pattern_mismatch")
    if field.least_length and field.kind == "array":
        out = out.when(seen["sizes"][at] < field.least_length, "too_short")
    elif field.least_length:
        out = out.when(F.length(text) < field.least_length, "string_too_short")
    if field.least is not None:
        out = out.when(text.try_cast("decimal(38,9)") < field.least, "greater_than_equal")
    if "." in field.path:
        parent = seen["kinds"][[f.path for f in fields].index(field.path.rpartition(".")[0])]
        return F.when(F.startswith(F.coalesce(parent, F.lit("")), F.lit("OBJECT")), out)
    return out


def _told(path: str, code: Column) -> Column:
    return F.when(code.isNotNull(), F.concat_ws(":", F.lit(path), code))


def validated(records: DataFrame, record_col: str = "record") -> DataFrame:
    """The rows with violations and valid; an invalid record (JSON text) is told with all that is wrong with it, as path:code in the schema's order, and nothing is dropped. A text that
    is no JSON object is malformed. A manifest with one of them is rejected as a whole.

    A record is parsed once and each field looked up once; the codes are made from what was seen."""
    parsed = records.withColumn("__variant", F.try_parse_json(F.col(record_col)))
    variant, seen = F.col("__variant"), F.col("__seen")
    refs = F.coalesce(_get(variant, "source_refs", "array<variant>"), F.expr("cast(array() as array<variant>)"))
    read = parsed.withColumns({"__seen": _read(variant, RECORD), "__refs": F.transform(refs, lambda r: _read(r, SOURCE_REF)), "__whole": F.coalesce(F.startswith(F.call_function("schema_of_variant", variant), F.lit("OBJECT")), F.lit(False))})
    fields = [_told(f.path, issue(seen, RECORD, i)) for i, f in enumerate(RECORD)]
    of_ref = lambda ref, i: F.transform(F.array_compact(F.array(*[_told(f.path, issue(ref, SOURCE_REF, k)) for k, f in enumerate(SOURCE_REF)])), lambda c: F.concat(F.lit("source_refs."), i.cast("string"), F.lit("."), c))
    items = F.flatten(F.transform("__refs", of_ref))
    day = lambda path: seen["texts"][[f.path for f in RECORD].index(path)].try_cast("date")
    order = [_told(later, F.when((day(later) < day(earlier)) | F.lit(not equal) & (day(later) == day(earlier)), F.lit("value_error"))) for later, earlier, equal in DATE_ORDER]
    found = F.concat(F.array_compact(F.array(*fields)), items, F.array_compact(F.array(*order)))
    out = read.withColumn("violations", F.when(F.col("__whole"), found).otherwise(F.array(F.lit("malformed")))).drop("__variant", "__seen", "__refs", "__whole")
    return out.withColumn("valid", F.size("violations") == 0)
