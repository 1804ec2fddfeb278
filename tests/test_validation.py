"""Closed validation of corpus records, with what is wrong typed by hand."""

import json

from docloom.sources import validation

GOOD = {
    "authority": {"authority_id": "abc-1", "title": "t", "authority_type": "LAW", "issuing_body": "b"},
    "version_id": "v1",
    "status": "EFFECTIVE",
    "effective_date": "2020-01-01",
    "coverage_type": "FULL_TEXT",
    "source_refs": [{"name": "n", "url": "https://x.y/z", "role": "TEXT"}],
    "snapshot_path": "p",
    "expected_source_sha256": "a" * 64,
    "expected_article_count": 3,
    "inclusion_reason": "r",
}
DROP = object()
CASES = [
    ({}, []),
    ({"version_id": "V 1"}, ["version_id:string_pattern_mismatch"]),
    ({"version_id": 7}, ["version_id:string_type"]),
    ({"status": "X"}, ["status:enum"]),
    ({"effective_date": "2020-13-01"}, ["effective_date:date_parsing"]),
    ({"effective_date": None}, ["effective_date:date_type"]),
    ({"end_date_exclusive": "2020-01-01"}, ["end_date_exclusive:value_error"]),
    ({"end_date_exclusive": "2020-01-02", "repeal_date": "2020-01-01"}, []),
    ({"repeal_date": "2019-12-31"}, ["repeal_date:value_error"]),
    ({"source_refs": []}, ["source_refs:too_short"]),
    ({"source_refs": DROP}, ["source_refs:missing"]),
    ({"source_refs": [{"name": "n", "url": "ftp:x", "role": "Q"}, {"name": 1}]}, ["source_refs.0.url:string_pattern_mismatch", "source_refs.0.role:enum", "source_refs.1.name:string_type", "source_refs.1.url:missing", "source_refs.1.role:missing"]),
    ({"expected_article_count": 0}, ["expected_article_count:greater_than_equal"]),
    ({"expected_article_count": "3"}, []),
    ({"expected_article_count": 2.5}, ["expected_article_count:integer_type"]),
    ({"authority": DROP}, ["authority:missing"]),
    ({"authority": {"title": "", "authority_id": "Abc", "authority_type": "X"}}, ["authority.authority_id:string_pattern_mismatch", "authority.title:string_too_short", "authority.authority_type:enum", "authority.issuing_body:missing"]),
    ({"authority": "x"}, ["authority:object_type"]),
    ({"publication_date": None, "parser": None, "authority_note": "an unknown field is ignored"}, []),
    ({"parser": "other", "expected_source_sha256": "A" * 64}, ["expected_source_sha256:string_pattern_mismatch", "parser:enum"]),
    ({"snapshot_path": "", "inclusion_reason": DROP}, ["snapshot_path:string_too_short", "inclusion_reason:missing"]),
]


def test_violations(spark):
    records = [json.dumps({k: v for k, v in (GOOD | change).items() if v is not DROP}) for change, _ in CASES]
    rows = [*enumerate(records), (100, "[1]"), (101, "{bad"), (102, None), (103, "")]
    out = {r.i: (r.valid, r.violations) for r in validation.validated(spark.createDataFrame(rows, "i int, record string")).collect()}
    for i, (_, want) in enumerate(CASES):
        assert out[i] == (not want, want), CASES[i]
    assert all(out[i] == (False, ["malformed"]) for i in range(100, 104))
