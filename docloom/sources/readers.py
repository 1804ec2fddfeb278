"""Reading uploads, snapshots, manifests, datasets; writing tables so that a failed write leaves the old one."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 500 * 1024 * 1024
# Accepted file types with how their content begins.
MAGIC = {".pdf": "25504446", ".png": "89504E470D0A1A0A", ".jpg": "FFD8FF", ".jpeg": "FFD8FF"}

CORPUS_RECORD = (
    "authority struct<authority_id:string,title:string,authority_type:string,issuing_body:string,document_number:string,jurisdiction:string>, version_id string, status string, "
    "publication_date date, effective_date date, end_date_exclusive date, repeal_date date, supersedes_version_id string, superseded_by_version_id string, coverage_type string, coverage_note string, "
    "source_refs array<struct<name:string,url:string,role:string>>, snapshot_path string, expected_source_sha256 string, expected_article_count int, parser string, inclusion_reason string, verified_on date, verification_note string"
)


def uploads(spark: SparkSession, folder: str) -> DataFrame:
    """Files of a folder with their acceptance. Spark's reader leaves out files without a byte, so these have no row."""
    return accepted(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder))


def accepted(files: DataFrame) -> DataFrame:
    """Files (path, length, content) with extension, verdict (by extension, size and beginning), kind and hash; the content stays in the row."""
    extension = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    magic = F.create_map(*[F.lit(x) for kv in MAGIC.items() for x in kv])[extension]
    verdict = (
        F.when(magic.isNull(), "UNSUPPORTED_TYPE").when(F.col("length") == 0, "EMPTY_FILE").when(F.col("length") > MOST_BYTES, "TOO_LARGE").when(~F.startswith(F.hex(F.substring("content", 1, 8)), magic), "CONTENT_MISMATCH").otherwise("ACCEPTED")
    )
    kind = F.when(extension == ".pdf", "pdf").otherwise("image")
    return files.withColumns({"extension": extension, "verdict": verdict, "document_kind": kind, "sha256": F.sha2("content", 256)})


def image_pages(files: DataFrame) -> DataFrame:
    """The one page of each image, which always needs OCR."""
    return files.where("document_kind = 'image'").select("path", F.lit(1).alias("page_number"), F.lit("").alias("text"), F.lit("OCR_REQUIRED").alias("route"))


def pdf_pages(files: DataFrame, read_pages: Callable[[bytes], list[str | None]]) -> DataFrame:
    """A row for each page of each PDF, by a reader that is handed in (bytes to page texts; None where a page fails, which then needs OCR)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                texts = read_pages(content)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(texts)), pa.array(range(1, len(texts) + 1), pa.int32()), pa.array(texts, pa.string())], names=["path", "page_number", "text"])

    return files.where("document_kind = 'pdf'").select("path", "content").mapInArrow(run, "path string, page_number int, text string")


def recognized(pages: DataFrame, recognize: Callable[[bytes], tuple[list[str], list[float], list[list[list[int]]]]], parallel: int = 8) -> DataFrame:
    """Texts, scores and polygons of page images (job_id, page_number, image) by a recogniser that is handed in, ``parallel`` calls at a time at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [recognize(i) for i in batch.column("image").to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.list_(pa.string())), pa.array([f[1] for f in found], pa.list_(pa.float64())), pa.array([f[2] for f in found], pa.list_(pa.list_(pa.list_(pa.int32()))))]
            yield pa.RecordBatch.from_arrays([batch.column("job_id"), batch.column("page_number"), *columns], names=["job_id", "page_number", "texts", "scores", "polygons"])

    return pages.repartition(parallel).select("job_id", F.col("page_number").cast("int"), "image").mapInArrow(run, "job_id string, page_number int, texts array<string>, scores array<double>, polygons array<array<array<int>>>")


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts with their paths."""
    return spark.read.text(folder, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("snapshot_text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Corpus records of a manifest, by a closed schema."""
    record = ", ".join(f"{n.strip()}: {t}" for n, t in (part.strip().split(" ", 1) for part in re.split(r", (?=\w+ )", CORPUS_RECORD)))
    return spark.read.json(path, schema=f"records array<struct<{record}>>", multiLine=True).select(F.explode("records").alias("r")).select("r.*")


def dataset(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark cases; expected values stay JSON text."""
    x = "array<struct<assertion_id:string,pointer:string,comparison:string,expected:string,tolerance:double>>"
    cases = f"dataset_id string, dataset_version string, cases array<struct<case_id:string,case_version:string,fixture_id:string,task_type:string,title:string,tags:array<string>,expectations:{x}>>"
    return spark.read.json(path, schema=cases, multiLine=True).select("dataset_id", "dataset_version", F.explode("cases").alias("c")).select("dataset_id", "dataset_version", "c.*")


def gates(spark: SparkSession, path: str) -> DataFrame:
    gate = "gates array<struct<gate_id:string,metric_key:string,operator:string,threshold:double,rationale:string>>"
    return spark.read.json(path, schema=gate, multiLine=True).select(F.explode("gates").alias("g")).select("g.*")


def residue(spark: SparkSession, folder: str) -> DataFrame:
    """Temporary files that were left behind, at any depth."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tmp").load(folder).select("path", "length", "modificationTime")


def publish(rows: DataFrame, path: str) -> str:
    """Write a table as a new version beside the ones there are, then point to it in one step; returns the version's folder."""
    return publish_folder(rows.sparkSession, path, rows.write.parquet)


def publish_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> str:
    """Let ``write`` fill a new folder beside the versions there are, with as many tables as it likes, then point to it in one step; returns the folder.

    The pointer is a small file that is renamed over the old one, so a reader finds the old version or the new one, never none, and a failed
    write changes nothing. The version before stays, for readers that are still at it; older ones are removed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    fs = jvm.org.apache.hadoop.fs
    files = fs.Path(path).getFileSystem(conf)
    before = _version(spark, path)
    version = f"v-{uuid.uuid4().hex}"
    write(f"{path}/{version}")
    staged, pointer = fs.Path(f"{path}/_pointer-{version}"), fs.Path(f"{path}/_current")
    out = files.create(staged, True)
    out.write(bytearray(version.encode()))
    out.close()
    option = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = option
    context = fs.FileContext.getFileContext(files.getUri(), conf)
    context.rename(files.makeQualified(staged), files.makeQualified(pointer), options)
    for status in files.listStatus(fs.Path(path)):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            files.delete(status.getPath(), True)
    return f"{path}/{version}"


def _version(spark: SparkSession, path: str) -> str | None:
    jvm = spark.sparkContext._jvm
    pointer = jvm.org.apache.hadoop.fs.Path(f"{path}/_current")
    files = pointer.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(pointer):
        return None
    stream = files.open(pointer)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def published(spark: SparkSession, path: str) -> DataFrame:
    """The current version of a table that was published."""
    return spark.read.parquet(current_folder(spark, path))


def current_folder(spark: SparkSession, path: str) -> str:
    """The folder of the version that is current."""
    version = _version(spark, path)
    if version is None:
        raise FileNotFoundError(f"nothing has been published at {path}")
    return f"{path}/{version}"


def upsert(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows with the changes in place of those of the same key."""
    return stored.join(changes.select(*keys), keys, "left_anti").unionByName(changes)


def import_records(plan: DataFrame, path: str) -> int:
    """Append the NEW records of an import plan; any CONFLICT rejects all, and nothing is written."""
    if conflicts := plan.where("outcome = 'CONFLICT'").count():
        raise ValueError(f"{conflicts} records conflict with what is stored; nothing was written")
    new = plan.where("outcome = 'NEW'").drop("outcome", "old_identity", "old_content")
    count = new.count()
    if count:
        new.write.mode("append").parquet(path)
    return count
