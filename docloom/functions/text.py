"""Text functions as column expressions: normal forms, keys, trigrams, digests."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str methods know it.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"


def strip(text: Column) -> Column:
    """Without white space at either end (not only the ASCII blank)."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def normalized(text: Column) -> Column:
    """Page text: line ends as LF, no white space before a line's end, none around the whole."""
    lines = F.regexp_replace(text, r"\r\n?", "\n")
    return strip(F.regexp_replace(lines, r"[^\S\n]+(?=\n|$)", ""))


def snapshot(text: Column) -> Column:
    """Stored source text: no byte order mark, line ends as LF, one LF at the end."""
    return F.concat(strip(F.regexp_replace(F.regexp_replace(text, "^﻿", ""), r"\r\n?", "\n")), F.lit("\n"))


def collapsed(text: Column) -> Column:
    return strip(F.regexp_replace(text, f"{SPACE}+", " "))


def preview(text: Column, limit: int) -> Column:
    """White space collapsed, cut to ``limit`` code points with an ellipsis for the last."""
    flat = collapsed(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, limit - 1), f"{SPACE}+$", ""), F.lit("…")))


def snippet(text: Column, limit: int = 260) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)


def topic_key(text: Column) -> Column:
    """Lower case without any white space: topics with the same key are the same topic."""
    return F.regexp_replace(F.lower(text), f"{SPACE}+", "")


def party_key(name: Column) -> Column:
    return F.regexp_replace(name, f"{SPACE}+", "")


def title_key(title: Column) -> Column:
    """Only ASCII letters, digits and CJK characters, without the state's name at the front."""
    return F.regexp_replace(F.regexp_replace(title, r"[^0-9A-Za-z\x{4e00}-\x{9fff}]", ""), "^中华人民共和国", "")


def join_present(*parts: Column) -> Column:
    """The parts that are not blank, a line each."""
    return F.concat_ws("\n", *[F.when(strip(p) != "", p) for p in parts])


def trigrams(text: Column) -> Column:
    """All lower-cased windows of three code points, in order; linear in the text (a look-ahead at each code point, not a substring for each)."""
    return F.regexp_extract_all(F.lower(text), F.lit("(?s)(?=(...))."), F.lit(1))


def packed_trigram(gram: Column) -> Column:
    """A trigram as one number: three code points of 21 bits."""
    at = lambda k: F.ascii(F.substring(gram, k, 1)).cast("long")
    return F.shiftleft(at(1), 42).bitwiseOR(F.shiftleft(at(2), 21)).bitwiseOR(at(3))


def query_trigrams(text: Column, most: int | None = None) -> Column:
    """A query's distinct trigrams in order, all or the first ``most``; empty for queries under three characters once stripped to letters, digits and CJK."""
    grams = F.array_distinct(trigrams(F.regexp_replace(text, r"[^0-9A-Za-z\x{4e00}-\x{9fff}]+", "")))
    return grams if most is None else F.slice(grams, 1, most)


def gram_set(text: Column) -> Column:
    """Distinct trigrams of the text without white space; a text of one or two characters is its own gram."""
    flat = topic_key(text)
    return F.when(F.length(flat) > 2, F.array_distinct(trigrams(flat))).when(F.length(flat) > 0, F.array(flat)).otherwise(F.expr("cast(array() as array<string>)"))


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """What is made of a value that is used several times, but made once."""
    return F.element_at(F.transform(F.array(value), make), 1)


def totals_before(sizes: Column, block: int = 128) -> Column:
    """For each of an array's numbers (long) the sum of those before it. Totals are appended within blocks, then over blocks: one long list would be copied at every step."""
    start = lambda: F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("before"))
    step = lambda s, size: F.struct((s["at"] + size).alias("at"), F.concat(s["before"], F.array(s["at"])).alias("before"))
    cut = lambda all_: F.transform(F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(block)), lambda at: F.aggregate(F.slice(all_, at, block), start(), step))
    joined = lambda parts: F.zip_with(parts, F.aggregate(parts, start(), lambda s, p: step(s, p["at"]))["before"], lambda p, at: F.transform(p["before"], lambda b: b + at))
    return once(sizes, lambda all_: F.flatten(once(cut(all_), joined)))


def stable_id(prefix: str, text: Column, size: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(text, 256), 1, size))


def compact_decimal(value: Column) -> Column:
    """A decimal as text without trailing zeros or exponent."""
    text = value.cast("decimal(38,6)").cast("string")
    return F.when(F.instr(text, ".") > 0, F.regexp_replace(text, r"\.?0+$", "")).otherwise(text)


def canonical_json(record: Column) -> Column:
    """A struct as JSON with its nulls kept; declare the fields in alphabetical order."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; 0 if a norm is 0, null for vectors of different length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) == F.size(b), F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms))


def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).split()))


def nfkc(text: Column) -> Column:
    """Compatibility composition and collapsed white space; Spark has no normaliser of its own."""
    return F.pandas_udf(_nfkc, T.StringType())(text)


# Numerals.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
UNITS = {"十": 10, "百": 100, "千": 1000}


def chinese_number(text: str | None) -> int | None:
    """A numeral such as 百二十三, 一万零五 or the digit string 二〇二一; ASCII digits as they are; None if it is none.

    A unit without a digit before it counts once (十二 is 12, 万 is 10,000)."""
    if not text:
        return None
    if text.isascii() and text.isdigit():
        return int(text)
    if not set(text) <= DIGITS.keys() | UNITS.keys() | {"万"}:
        return None
    if set(text) <= DIGITS.keys():
        return int("".join(str(DIGITS[c]) for c in text))
    total = 0
    for place, group in enumerate(reversed(text.split("万"))):
        steps = re.findall("([^十百千]?)([十百千]?)", re.sub("[零〇](?=.)", "", group))
        value = sum(DIGITS.get(digit, 1 if unit else 0) * UNITS.get(unit, 1) for digit, unit in steps)
        total += (value or (1 if place else 0)) * 10_000**place
    return total


def contract_number(text: str | None) -> int | None:
    """As ``chinese_number``, without ASCII digits: the numerals of contract headings and amounts."""
    return None if text and text.isascii() else chinese_number(text)


def numeral(text: Column) -> Column:
    """The value of a numeral as ``chinese_number`` has it; null if the text is none, or its value no long."""
    words, figures = "".join(DIGITS), "".join(map(str, DIGITS.values()))
    big = lambda n: F.lit(n).cast("decimal(38,0)")
    unit = F.create_map(*[F.lit(x) for kv in (UNITS | {"": 1}).items() for x in kv])
    myriads = F.array(*[F.lit(str(10_000**k)).cast("decimal(38,0)") for k in range(6)])

    def step(total: Column, s: Column) -> Column:
        digit = F.when(s["digit"] != "", F.translate(s["digit"], words, figures).cast("int")).otherwise(F.when(s["unit"] != "", 1).otherwise(0))
        return total + digit * unit[s["unit"]]

    def group(part: Column, place: Column) -> Column:
        bare = F.regexp_replace(part, "[零〇](?=.)", "")
        steps = F.arrays_zip(*[F.regexp_extract_all(bare, F.lit("([^十百千]?)([十百千]?)"), F.lit(k)).alias(n) for k, n in ((1, "digit"), (2, "unit"))])
        value = F.aggregate(steps, F.lit(0), step)
        value = F.when((value == 0) & (place > 0), 1).otherwise(value)
        return F.when(value == 0, big(0)).otherwise(F.try_multiply(value.cast("decimal(10,0)"), F.try_element_at(myriads, place + 1)))  # null beyond what a long holds

    parts = F.transform(F.reverse(F.split(text, "万", -1)), group)
    sum_ = F.aggregate(parts, big(0), lambda s, p: (s + p).cast("decimal(38,0)"))
    known = F.when(text.rlike(r"\A[0-9]+\z"), text.try_cast("long")).when(text.rlike(rf"\A[{words}]+\z"), F.translate(text, words, figures).try_cast("long"))
    return known.when(text.rlike(rf"\A[{words}{''.join(UNITS)}万]+\z"), sum_.try_cast("long"))


def positive_numeral(text: Column) -> Column:
    """The numeral of an article's number: zero is none."""
    value = numeral(text)
    return F.when(value > 0, value)
