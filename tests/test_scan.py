"""Scans whose state crosses tasks: clauses with spans, resolution as of a date, containment; each against a plain loop, with a key that holds most rows."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from docloom.operators import corpus, extraction, ingest, planning

HEADINGS = [
    ("1、年度预算", "1、", "年度预算", 1),
    ("（1）月度计划", "（1）", "月度计划", 2),
    ("一、年终奖", "一、", "年终奖", 1),
    ("第1000条 内容", "第1000条", "内容", 1),
    ("1. 年度目标", "1.", "年度目标", 1),
    ("3、元素定义", "3、", "元素定义", 1),
    ("1.5 元整", "1.", "5 元整", 1),
    ("2.1 年度目标", "2.", "1 年度目标", 1),
    ("第一条", "第一条", "", 1),
    ("　1.2.3 范围 ", "1.2.3", "范围", 3),
    ("1.2、范围", "1.2", "范围", 2),
    ("(三)　责任", "(三)", "责任", 2),
    ("1000、太大", None, None, None),
    ("1000.1 太大", None, None, None),
    ("一、", None, None, None),
    ("30%", None, None, None),
    ("正文", None, None, None),
]


def test_headings(spark):
    rows = spark.createDataFrame([(i, h[0]) for i, h in enumerate(HEADINGS)], "i int, line string")
    got = rows.select("i", extraction.heading(F.col("line")).alias("h")).orderBy("i").collect()
    assert [(r.h.token, r.h.rest, r.h.level) if r.h else (None, None, None) for r in got] == [h[1:] for h in HEADINGS]


LEVEL = {"第一条 a": 1, "二、b": 1, "（三）c": 2, "1.1 d": 2, "1.1.1 e": 3, "4. f": 1}


def outline(lines):
    """(number of the clause, number of the parent) of each line."""
    count, opened, out = 0, {}, []
    for line in lines:
        parent = None
        if level := LEVEL.get(line):
            count += 1
            above = [k for k in opened if k < level]
            parent = opened[max(above)] if above else None
            opened = {k: v for k, v in opened.items() if k < level} | {level: count}
        out.append((count, parent))
    return out


@pytest.mark.parametrize("partitions", [1, 9])
def test_outlines_over_many_tasks(spark, partitions):
    rng = random.Random(partitions)
    rows, want = [], {}
    for job, n in ((1, 0), (2, 400), (3, 5), (4, 60), (5, 1)):
        lines = [rng.choice([*LEVEL, "x", "y", "z", "w"]) if rng.random() < 0.5 else "text" for _ in range(n)]
        page, order = 1, 0
        for line, found in zip(lines, outline(lines), strict=True):
            if rng.random() < 0.05:
                page, order = page + 1, 0
            order += 1
            rows.append((job, page, order, line))
            want[job, page, order] = found
    rng.shuffle(rows)
    units = spark.createDataFrame(rows, "job int, page_number int, unit_order int, unit_text string")
    got = {(r.job, r.page_number, r.unit_order): (r.clause_number, r.parent_number) for r in extraction.outlined(units, "job", partitions=partitions).collect()}
    assert got == want
    assert extraction.outlined(units.limit(0), "job").collect() == []


def pages(spark, *texts):
    rows = spark.createDataFrame([("j", i + 1, t) for i, t in enumerate(texts)], "job string, page_number int, text string")
    return ingest.evidence_units(rows, "job", "page_number").withColumns({"evidence_ids": F.array(F.format_string("p%d", "page_number")), "source_method": F.lit("NATIVE_TEXT")})


def test_a_clause_goes_on_over_pages_with_spans(spark):
    texts = ("采购合同\n前言 \n\n第一条 价款\n  合同总价一百元。  ", "接上页。\n \n第二条\n末行")
    units = pages(spark, *texts)
    out = extraction.outlined(units, "job", partitions=3)
    first, second = extraction.clauses(out, "job").orderBy("clause_id").collect()
    assert (first.token, first.body_text, first.page_start, first.page_end) == ("第一条", "合同总价一百元。\n接上页。", 1, 2)
    assert (second.token, second.heading_text, second.body_text, second.page_start, second.page_end) == ("第二条", "", "末行", 2, 2)
    for s in [*first.spans, *second.spans]:
        assert texts[s.page_number - 1][s.char_start : s.char_end] == s.quote and s.evidence_ids == [f"p{s.page_number}"]
    assert {s.page_number for s in first.spans} == {1, 2}
    titles = spark.createDataFrame([("j", 1, "采购合同")], "job string, page_number int, unit_text string")
    block = extraction.unnumbered_blocks(out, titles, "job").collect()
    assert [(b.block_id, b.text, b.page_start, b.page_end, len(b.spans), b.confidence) for b in block] == [("unnumbered-0001", "前言", 1, 1, 1, "LOW")]
    assert extraction.unnumbered_blocks(extraction.outlined(pages(spark, "采购合同\n第一条 a"), "job"), titles, "job").collect() == []


def test_recognised_lines_have_spans_without_offsets(spark):
    units = spark.createDataFrame([("j", 1, 1, "第一条 a", None), ("j", 1, 2, "b", None)], "job string, page_number int, unit_order int, unit_text string, char_start long")
    (clause,) = extraction.clauses(extraction.outlined(units, "job"), "job").collect()
    assert [(s.quote, s.char_start, s.char_end) for s in clause.spans] == [("第一条 a", None, None), ("b", None, None)]


def test_levels_and_warnings(spark):
    (c1, c2, c3, c4, c5) = extraction.clauses(extraction.outlined(pages(spark, "一、总则\n（一）范围\n1. 价款\n1.1 首付\n1.1.1 时间"), "job"), "job").orderBy("clause_id").collect()
    assert [c.parent_clause_id for c in (c1, c2, c3, c4, c5)] == [None, "clause-0001", None, "clause-0003", "clause-0004"]
    jobs = spark.createDataFrame([("a",), ("b",)], "job_id string")
    units = spark.createDataFrame([("a", 1, 1, "OCR", 0.84), ("a", 1, 2, "OCR", None), ("a", 1, 3, "OCR", 0.85), ("a", 2, 1, "NATIVE_TEXT", None)], "job_id string, page_number int, unit_order int, source_method string, confidence double")
    mentions = spark.createDataFrame([("a", "DATE", "date-0001", "UNRESOLVED"), ("a", "REFERENCE", "r-1", "AMBIGUOUS"), ("a", "PARTY", "party-0001", "UNRESOLVED"), ("a", "MONEY", "m-1", "UNRESOLVED"), ("a", "DATE", "date-0002", "RESOLVED")], "job_id string, type string, mention_id string, resolution_state string")
    got = extraction.warnings(jobs, units, jobs.where("job_id = 'b'"), mentions).orderBy("job_id", "warning_id").collect()
    assert [(w.job_id, w.warning_id, w.code) for w in got] == [
        ("a", "warning-0001", "TITLE_UNRESOLVED"),
        ("a", "warning-0002", "PARTY_NAME_UNRESOLVED"),
        ("a", "warning-0003", "INVALID_DATE"),
        ("a", "warning-0004", "REFERENCE_UNRESOLVED"),
        ("a", "warning-0005", "LOW_CONFIDENCE_OCR_SOURCE"),
        ("a", "warning-0006", "LOW_CONFIDENCE_OCR_SOURCE"),
        ("b", "warning-0001", "NO_TEXT_EVIDENCE"),
    ]


@pytest.mark.parametrize("partitions", [1, 8])
def test_versions_as_of_a_date_with_a_hot_authority(spark, partitions):
    rng, start = random.Random(partitions), date(2020, 1, 1)
    versions, requests = [], [(None, start), (1, None), (9, start)]
    for i in range(150):
        a, s = rng.choice([0, 0, 1, 2]), rng.randrange(300)
        versions.append((a, i, None if i == 3 else start + timedelta(s), start + timedelta(s + rng.randrange(-3, 20)) if rng.random() < 0.9 else None))
    requests += [(rng.choice([0, 0, 0, 1, 2]), start + timedelta(rng.randrange(320))) for _ in range(500)]
    asked = spark.createDataFrame(requests, "authority_id int, as_of date")
    stored = spark.createDataFrame(versions, "authority_id int, version_id int, effective_date date, end_date_exclusive date")
    got = {(r.authority_id, r.as_of): (r.hits, r.candidates, r.state, r.version_id) for r in corpus.resolve_versions(asked, stored, ["authority_id", "as_of"], partitions).collect()}
    want = {}
    for a, d in set(requests):
        hits = sorted((v[2], str(v[1]), v[1]) for v in versions if v[0] == a and d is not None and v[2] is not None and v[2] <= d and (v[3] is None or d < v[3]))
        ids = [h[2] for h in hits]
        want[a, d] = (len(ids), ids, {0: "NO_APPLICABLE_VERSION", 1: "RESOLVED"}.get(len(ids), "AMBIGUOUS"), ids[0] if len(ids) == 1 else None)
    assert got == want and len({v[2] for v in want.values()}) == 3
    plan = corpus.resolve_versions(asked, stored, ["authority_id", "as_of"], partitions)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("partitions", [1, 6])
def test_containers_by_a_sweep(spark, partitions):
    rng = random.Random(partitions)
    containers, mentions = [], []
    for job, page, n in (("a", 1, 200), ("a", 2, 8), ("b", 1, 20)):
        at = 0
        for k in range(n):
            size = rng.randrange(1, 30)
            known = rng.random() < 0.9
            containers.append((job, page, [f"e{rng.randrange(2)}"], at if known else None, at + size if known else None, f"c{page}-{k}", rng.randrange(10**6)))
            at += rng.randrange(0, size)
        for k in range(2 * n):
            s = rng.randrange(at + 5)
            known = rng.random() < 0.9
            mentions.append((job, page, [f"e{rng.randrange(3)}"], s if known else None, s + rng.randrange(1, 9) if known else None, f"m{page}-{k}"))
    fields = "job_id string, page_number int, evidence_ids array<string>, char_start long, char_end long"
    got = extraction.contained(spark.createDataFrame(mentions, f"{fields}, mention_id string"), spark.createDataFrame(containers, f"{fields}, container_id string, container_order int"), partitions)
    want = {}
    for job, page, ids, s, e, name in mentions:
        hits = [(c[6], c[5]) for c in containers if c[:2] == (job, page) and set(ids) & set(c[2]) and (s is None or c[3] is None or (c[3] <= s and e <= c[4]))]
        want[job, name] = min(hits)[1] if hits else None
    assert {(r.job_id, r.mention_id): r.container_id for r in got.collect()} == want
    assert len(set(want.values())) > 20


def test_coverage_by_chunks(spark):
    objects = spark.createDataFrame([("a",), ("b",), ("c",)], "object_id string")
    issues = spark.createDataFrame([("i2", ["a", "x"]), ("i1", ["a"])], "issue_id string, object_ids array<string>")
    chunks = spark.createDataFrame([("c1", ["a", "b"]), ("c2", ["b"])], "chunk_id string, object_ids array<string>")
    got = planning.coverage(objects, issues, chunks=chunks)
    assert [(r.object_id, r.state, r.issue_ids, r.chunk_ids) for r in got.orderBy("object_id").collect()] == [
        ("a", "REVIEWED_WITH_ISSUE", ["i1", "i2"], ["c1"]),
        ("b", "REVIEWED_NO_SPECIFIC_ISSUE", [], ["c1", "c2"]),
        ("c", "REVIEWED_NO_SPECIFIC_ISSUE", [], []),
    ]
    assert tuple(planning.coverage_summary(got).first()) == (3, 1, 2, False)
    assert tuple(planning.coverage_summary(planning.coverage(objects, issues)).first()) == (3, 1, 2, True)
