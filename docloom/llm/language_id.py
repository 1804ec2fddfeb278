"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-cased whole text are hashed into BUCKETS. Document frequencies
are counted over all rows that may teach, in one pass that sums per task before it shuffles. The
weights are fitted by follow-the-regularised-leader with an L1 and an L2 penalty, on at most
PER_LANGUAGE rows of each language (TRAIN_ROWS, and MOST_ENTRIES counts, in all) chosen by hash; a fifth of these only
calibrates the temperature of the softmax. Language, source and id are no inputs of a prediction.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if
no row may teach; with one language, all texts with a letter are of it with score 1; equal texts have
equal results; of languages that are equally likely the first by name is told; very long texts are taken whole; ids that repeat teach once
for each row; further columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hashed_low, held_out, map_texts, slices

BUCKETS = 1 << 14
PER_LANGUAGE, TRAIN_ROWS, MOST_LANGUAGES = 600, 12_000, 1000
#: Nonzero n-gram counts of the sample, in all: 8 bytes each where they are gathered.
MOST_ENTRIES = 24_000_000
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 2e-3, 1e-4
UNKNOWN = "und"
#: Texts whose n-grams are counted together.
ROWS = 96
SLICE = 1 << 20
#: Multipliers of the n-gram hash, by position.
ODD = tuple(np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def gram_counts(texts: list[str]) -> np.ndarray:
    """(texts, BUCKETS) counts of the hashed n-grams; none spans two texts."""
    codes = np.frombuffer("\0".join([*texts, ""]).lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    row = np.cumsum(codes == 0)
    row -= codes == 0
    if len(row) and row[-1] >= len(texts):  # texts with NUL characters of their own: count them one by one
        return np.concatenate([gram_counts([t.replace("\0", " ")]) for t in texts])
    total = np.zeros(len(texts) * BUCKETS, np.int64)
    hashed = np.zeros(len(codes), np.uint32)
    inside = codes != 0
    for n in range(3):
        if n:
            hashed, inside, row = hashed[:-1], inside[:-1] & (codes[n:] != 0), row[:-1]
        hashed = (hashed ^ codes[n:]) * ODD[n]
        hashed ^= hashed >> np.uint32(15)
        bucket = (hashed * ODD[2] >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64)
        total += np.bincount((row * BUCKETS + bucket)[inside], minlength=len(total))
    return total.reshape(len(texts), BUCKETS)


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for part in slices(batches, column, SLICE):
        for a in range(0, part.num_rows, ROWS):
            rows = part.slice(a, ROWS)
            yield rows, [t or "" for t in rows.column(column).to_pylist()]


@dataclass(frozen=True)
class Model:
    """Languages, inverse document frequencies, weights (the last row is the intercept) and temperature."""

    languages: tuple[str, ...]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        z = np.zeros((len(texts), len(self.languages)))
        for i, counts in enumerate(gram_counts(texts)):
            at = np.flatnonzero(counts)
            x = counts[at] * self.idf[at]
            z[i] = x @ self.weights[at] / max(np.sqrt(x @ x), 1e-12)
        z = (z + self.weights[-1]) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        known = [any(map(str.isalpha, t)) for t in texts]
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], [float(x[b]) if k else 0.0 for x, b, k in zip(p, best, known, strict=True)]


def document_frequencies(rows: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many of the texts each bucket occurs, and the number of texts; BUCKETS + 1 numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = np.zeros(BUCKETS, np.int64), 0
        for _, texts in _texts(batches, "__text"):
            found += (gram_counts(texts) > 0).sum(axis=0)
            n += len(texts)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([*at, BUCKETS], pa.int64()), pa.array([*found[at], n], pa.int64())], names=["bucket", "n"])

    counted = rows.select(F.col(f"`{text_col}`").cast("string").alias("__text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BUCKETS + 1, np.int64)
    for r in counted:
        found[r["bucket"]] = r["n"]
    return found[:-1], int(found[-1])


def sample(rows: DataFrame, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, counts) of the bounded sample, in an order fixed by hash."""
    order = F.xxhash64(id_col, F.lit(5))
    sizes = rows.groupBy(lang_col).agg(F.count("*").alias("__n")).limit(MOST_LANGUAGES + 1)
    if (languages := sizes.count()) > MOST_LANGUAGES:
        raise ValueError(f"{languages} languages or more; {MOST_LANGUAGES} at most")
    low = rows.select(id_col, lang_col).join(F.broadcast(sizes), lang_col).where(hashed_low([id_col], 5, 4.0 * PER_LANGUAGE / F.col("__n")))
    ranked = low.select(id_col, lang_col).withColumn("rank", F.row_number().over(Window.partitionBy(lang_col).orderBy(order, id_col))).where(F.col("rank") <= PER_LANGUAGE)
    chosen = ranked.orderBy("rank", lang_col).limit(TRAIN_ROWS).select(F.col(id_col).alias("__id")).distinct()
    texts = rows.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), F.col(f"`{text_col}`").cast("string").alias("__text")).join(F.broadcast(chosen), "__id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, strings in _texts(batches, "__text"):
            counts = gram_counts(strings)
            at = [np.flatnonzero(c) for c in counts]
            packed = [pa.array([a.astype("<i4").tobytes() for a in at], pa.binary()), pa.array([c[a].astype("<i4").tobytes() for a, c in zip(at, counts, strict=True)], pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("__id"), part.column("__lang"), *packed], names=["id", "lang", "at", "n"])

    id_type = texts.schema["__id"].dataType.simpleString()
    vectors = texts.mapInArrow(run, f"id {id_type}, lang string, at binary, n binary")
    before = Window.partitionBy("lang").orderBy(F.xxhash64("id", F.lit(5)), "id", "at")  # about PER_LANGUAGE rows
    entries = F.sum(F.length("at") / 4).over(before.rowsBetween(Window.unboundedPreceding, 0))
    vectors = vectors.withColumn("entries", entries).where(F.col("entries") <= MOST_ENTRIES / max(languages, 1)).drop("entries")
    got = vectors.orderBy(F.xxhash64("id", F.lit(9)), "id", "lang", "at").limit(2 * TRAIN_ROWS).collect()
    return [(r["lang"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["n"], "<i4").astype(np.float64)) for r in got]


def follow_the_leader(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: int) -> np.ndarray:
    """FTRL-proximal weights of a multinomial logistic regression with an elastic net; rows are (class, features, values)."""
    z, n = np.zeros((BUCKETS + 1, languages)), np.zeros((BUCKETS + 1, languages))

    def weights(at):
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1, 0) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for label, at, x in rows:
            w = weights(at)
            margin = x @ w
            p = np.exp(margin - margin.max())
            p /= p.sum()
            p[label] -= 1
            g = x[:, None] * p
            root = np.sqrt(n[at])
            n[at] += g * g
            z[at] += g - (np.sqrt(n[at]) - root) / ALPHA * w
    return weights(np.arange(BUCKETS + 1))


def temperature(margins: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood on rows that the weights have not seen, between 0.05 and 20."""
    best = (np.inf, 1.0)
    for t in np.exp(np.linspace(np.log(0.05), np.log(20), 121)):
        z = margins / t
        z = z - z.max(axis=1, keepdims=True)
        loss = (np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]).mean()
        best = min(best, (float(loss), float(t)))
    return best[1]


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model, from rows with an id, a language and a text that are not held out; None if there are none."""
    rows = docs.where(~held_out(id_col) & F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    seen = sample(rows, id_col, text_col, lang_col)
    if not seen:
        return None
    found, total = document_frequencies(rows, text_col)
    idf = np.log((1 + total) / (1 + found)) + 1
    languages = tuple(sorted({lang for lang, _, _ in seen}))
    rows = []
    for lang, at, n in seen:
        x = n * idf[at]
        x = x / max(np.sqrt(x @ x), 1e-12)
        rows.append((languages.index(lang), np.append(at, BUCKETS), np.append(x, 1.0)))
    kept = [r for i, r in enumerate(rows) if i % 5] or rows
    aside = rows[::5] if len(kept) < len(rows) else []
    weights = follow_the_leader(kept, len(languages))
    if not aside or len(languages) == 1:
        return Model(languages, idf, weights, 1.0)
    margins = np.array([x @ weights[at] for _, at, x in aside])
    return Model(languages, idf, weights, temperature(margins, np.array([label for label, _, _ in aside])))


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and lang_pred and score; one narrow stage over whole texts."""

    def work(texts: pa.Array) -> list[pa.Array]:
        strings = [t or "" for t in texts.to_pylist()]
        langs, scores = [UNKNOWN] * len(strings), [0.0] * len(strings)
        if model is not None:
            for a in range(0, len(strings), ROWS):
                langs[a : a + ROWS], scores[a : a + ROWS] = model.predict(strings[a : a + ROWS])
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64())]

    return map_texts(docs, text_col, list(keep), [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], work, limit=SLICE)
