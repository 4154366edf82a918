"""Manifests with one fault each, against what each fault must give."""

import json

from cohortcast.operators.manifests import FIELDS, REFERENCE, judge_manifests

GOOD = {
    "artifact_path_or_uri": "/raw/a.md", "sha256": "a" * 64, "source_provider": "p", "parser_version": "1", "source_as_of_timestamp": "2026-05-02T10:00:00-04:00", "source_as_of_tier": "PROVEN", "source_as_of_provenance": "PUBLISHER_TIMESTAMP",
    "target_track_code": "CD", "target_race_date": "2026-05-02", "target_race_number": 12, "target_scheduled_post_timestamp": "2026-05-02T22:57:00Z", "target_surface": "dirt", "target_distance_furlongs": 10.0, "expected_active_starter_count": 20, "observed_active_starter_count": 20,
    "identity_reconciliation_status": "COMPLETE", "field_completeness_status": "COMPLETE", "feature_vector_status": "COMPLETE", "raw_artifact_retained": True, "pre_race_fields_only": True,
    "outcome_reference": {"path_or_uri": "x", "sha256": "B" * 64, "source_provider": "p", "parser_version": "1"}, "outcome_provenance_status": "PROVEN",
}
BAD = "MANIFEST_SCHEMA_INVALID"


def test_one_fault_each(spark):
    m = lambda **kw: json.dumps({k: v for k, v in {**GOOD, **kw}.items() if v != "gone"})
    cases = [
        (m(), [], []),
        (m(target_distance_furlongs=6), [], []),
        (m(source_as_of_timestamp="2026-05-02"), ["source_as_of_timestamp"], [BAD, "SOURCE_AS_OF_TIMESTAMP_DATE_ONLY"]),
        (m(source_as_of_timestamp="2026-05-02T10:00:00"), ["source_as_of_timestamp"], [BAD, "SOURCE_AS_OF_TIMESTAMP_INVALID_OR_TIMEZONE_MISSING"]),
        (m(source_as_of_timestamp="2026-13-02T10:00:00Z"), ["source_as_of_timestamp"], [BAD, "SOURCE_AS_OF_TIMESTAMP_INVALID_OR_TIMEZONE_MISSING"]),
        (m(target_scheduled_post_timestamp="soon"), ["target_scheduled_post_timestamp"], [BAD, "TARGET_SCHEDULED_POST_TIMESTAMP_INVALID_OR_TIMEZONE_MISSING"]),
        (m(source_as_of_timestamp="2026-05-02T18:57:00-04:00"), [], ["SOURCE_AS_OF_NOT_STRICTLY_BEFORE_TARGET_POST"]),
        (m(source_as_of_timestamp="2026-05-02T18:56:59-04:00"), [], []),
        (m(source_as_of_provenance="FILENAME_DERIVED"), [], ["FILENAME_DERIVED_CANNOT_CLAIM_PROVEN"]),
        (m(expected_active_starter_count=1, observed_active_starter_count=1), ["expected_active_starter_count"], [BAD, "ACTIVE_STARTER_COUNT_INSUFFICIENT"]),
        (m(expected_active_starter_count="20"), ["expected_active_starter_count"], [BAD, "ACTIVE_STARTER_COUNT_INSUFFICIENT", "PARTIAL_STARTER_FIELD"]),
        (m(observed_active_starter_count=19), [], ["PARTIAL_STARTER_FIELD"]),
        (m(identity_reconciliation_status="INCOMPLETE"), [], ["IDENTITY_RECONCILIATION_INCOMPLETE"]),
        (m(feature_vector_status=None), ["feature_vector_status"], [BAD, "PARTIAL_FEATURE_VECTOR"]),
        (m(raw_artifact_retained="true"), ["raw_artifact_retained"], [BAD, "RAW_ARTIFACT_NOT_RETAINED"]),
        (m(pre_race_fields_only=False), [], ["PRE_RACE_FIELDS_ONLY_REQUIRED"]),
        (m(outcome_provenance_status="gone"), ["outcome_provenance_status"], [BAD, "OUTCOME_PROVENANCE_INSUFFICIENT"]),
        (m(sha256="c" * 64), [], ["RAW_ARTIFACT_SHA256_MISMATCH"]),
        (m(sha256="A" * 64), [], []),
        (m(sha256="b", artifact_path_or_uri="/none"), ["sha256"], [BAD]),
        (m(note="x"), ["note"], [BAD]),
        (m(target_race_number=0), ["target_race_number"], [BAD]),
        (m(target_surface="ice"), ["target_surface"], [BAD]),
        (m(outcome_reference={"path_or_uri": "x", "sha256": "B" * 64, "source_provider": "p", "extra": 1}), ["outcome_reference/parser_version", "extra"], [BAD]),
        ("[1]", ["$"], [BAD]), ("{", [], ["MANIFEST_JSON_UNREADABLE"]), (None, [], ["MANIFEST_JSON_UNREADABLE"]),
    ]
    df = spark.createDataFrame([(k, t, "clash") for k, (t, _, _) in enumerate(cases)], "k int, text string, path string")
    kept = spark.createDataFrame([("/raw/a.md", "a" * 64), ("/raw/b.md", "0" * 64)], "path string, actual string")
    got = {r.k: r for r in judge_manifests(df, "text", kept).collect()}
    assert len(got) == len(cases)
    for k, (text, faults, codes) in enumerate(cases):
        assert (got[k].faults, got[k].codes, got[k].passed, got[k].path) == (faults, codes, not codes, "clash"), text
    assert judge_manifests(df.limit(0), "text").collect() == []


def test_each_field_is_opened_once(spark):
    kept = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = judge_manifests(spark.createDataFrame([("{}",)], "text string"), "text")._jdf.queryExecution().optimizedPlan().toString().lower()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", kept)
    assert 0 < plan.count("schema_of_variant(") + plan.count("schemaofvariant(") <= len(FIELDS) + len(REFERENCE) and "lambda" not in plan


def test_folded_states_and_odd_objects(spark):
    m = lambda **kw: json.dumps({**GOOD, **kw})
    cases = [
        (m(field_completeness_status="complete"), ["field_completeness_status"], [BAD]),
        (m(outcome_provenance_status="ſomething"), ["outcome_provenance_status"], [BAD, "OUTCOME_PROVENANCE_INSUFFICIENT"]),
        (m(identity_reconciliation_status="ıncomplete"), ["identity_reconciliation_status"], [BAD, "IDENTITY_RECONCILIATION_INCOMPLETE"]),
        (m(outcome_reference=[1]), ["outcome_reference"] + [f"outcome_reference/{n}" for n in REFERENCE], [BAD]),
        (m(outcome_reference={**GOOD["outcome_reference"], "a, sha256: STRING": None}), ["a, sha256: STRING"], [BAD]),
        ("null", ["$"], [BAD]), ('{"a": 1, "a": 2}', [], ["MANIFEST_JSON_UNREADABLE"]),
    ]
    got = {r.text: r for r in judge_manifests(spark.createDataFrame([(t,) for t, _, _ in cases], "text string"), "text").collect()}
    for text, faults, codes in cases:
        assert (got[text].faults, got[text].codes, got[text].passed) == (faults, codes, False), text
