"""Manifests of retained sources: JSON texts judged by a declared schema and by rules that hold between their fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields of a snapshot manifest, all required, with their JSON type and what their values must be (a pattern of a string, a condition on x, or nothing).
FIELDS = {
    "artifact_path_or_uri": ("string", r"(?s).+"), "sha256": ("string", "[A-Fa-f0-9]{64}"), "source_provider": ("string", r"(?s).+"), "parser_version": ("string", r"(?s).+"),
    "source_as_of_timestamp": ("string", None), "source_as_of_tier": ("string", "PROVEN|OPERATOR_ATTESTED"), "source_as_of_provenance": ("string", "PUBLISHER_TIMESTAMP|SYSTEM_CAPTURED|OPERATOR_ATTESTED|FILENAME_DERIVED|UNKNOWN"),
    "target_track_code": ("string", "[A-Za-z0-9_-]{2,12}"), "target_race_date": ("string", r"\d{4}-\d{2}-\d{2}"), "target_race_number": ("integer", "x >= 1"), "target_scheduled_post_timestamp": ("string", None),
    "target_surface": ("string", "dirt|turf|synthetic|all_weather|all-weather"), "target_distance_furlongs": ("number", "x > 0"), "expected_active_starter_count": ("integer", "x >= 2"), "observed_active_starter_count": ("integer", "x >= 0"),
    "identity_reconciliation_status": ("string", "COMPLETE|INCOMPLETE|UNRECONCILED"), "field_completeness_status": ("string", "COMPLETE|PARTIAL|UNKNOWN"), "feature_vector_status": ("string", "COMPLETE|PARTIAL|UNKNOWN"),
    "raw_artifact_retained": ("boolean", None), "pre_race_fields_only": ("boolean", None), "outcome_reference": ("object", None), "outcome_provenance_status": ("string", "PROVEN|OPERATOR_ATTESTED|UNPROVEN|MISSING"),
}
#: The fields of an outcome reference, all required.
REFERENCE = {"path_or_uri": r"(?s).+", "sha256": "[A-Fa-f0-9]{64}", "source_provider": r"(?s).+", "parser_version": r"(?s).+"}
#: The fields that name a time.
TIMES = ["source_as_of_timestamp", "target_scheduled_post_timestamp"]
TYPES = {"string": "STRING", "integer": "BIGINT", "number": r"(?:BIGINT|DOUBLE|DECIMAL\(.*)", "boolean": "BOOLEAN", "object": "OBJECT<.*"}
INSTANT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"
OFFSET = r"(Z|[+-]\d{2}:?\d{2})$"


def _opened(df: DataFrame, v: str, names, prefix: str) -> DataFrame:
    """df with the fields of the JSON object `v`, read in one pass: for each name its JSON type (`_type_`, null: missing) and its value as a variant (`_value_`); and the object's names (`_names_`, null: no object)."""
    fields = df.withColumn(f"_object_{prefix}", F.try_variant_get(v, "$", "struct<" + ", ".join(f"{n}: variant" for n in names) + ">")).withColumn(f"_names_{prefix}", F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    values = fields.withColumns({f"_value_{prefix}{n}": F.col(f"_object_{prefix}")[n] for n in names})
    return values.withColumns({f"_type_{prefix}{n}": F.schema_of_variant(f"_value_{prefix}{n}") for n in names})


def _told(names: Column) -> Column:
    """The names that aren't null, each once, in their order. Unlike array_compact, which filters by a lambda, it leaves the rules within to generated code."""
    return F.array_except(names, F.array(F.lit(None).cast("string")))


def _as(name: str, json_type: str, data_type: str) -> Column:
    """The value of a field that has been opened; null if it is of another JSON type."""
    return F.when(F.col(f"_type_{name}") == json_type, F.try_variant_get(f"_value_{name}", "$", data_type))


def instant(text: Column) -> tuple[Column, Column]:
    """The time that an ISO text with an offset names, and what is wrong with it: DATE_ONLY, INVALID or TIMEZONE_MISSING (null: nothing)."""
    t = F.trim(F.coalesce(text, F.lit("")))
    at = F.when(t.rlike(INSTANT), F.try_to_timestamp(t))
    return at, F.when(~t.contains("T") & ~t.contains(" "), "DATE_ONLY").when(at.isNotNull(), F.lit(None)).when(~t.rlike(OFFSET) & F.try_to_timestamp(t).isNotNull(), "TIMEZONE_MISSING").otherwise("INVALID")


def schema_faults() -> Column:
    """Of a manifest that has been opened: names of fields that are missing, of another JSON type, or of a value that the schema refuses; names that it doesn't know; "outcome_reference/..." for those within."""
    def fault(name: str, kind: str, rule: str | None, told: str) -> Column:
        wrong = ~F.coalesce(F.col(f"_type_{name}").rlike(f"^{TYPES[kind]}$"), F.lit(False))
        if rule and kind == "string":
            wrong = wrong | ~F.coalesce(F.col(f"_text_{name}").rlike(f"^(?:{rule})$"), F.lit(False))
        elif rule:
            value = _as(name, "BIGINT", "long") if kind == "integer" else F.try_variant_get(f"_value_{name}", "$", "double")
            sign, bound = rule.split()[1:]
            wrong = wrong | ~F.coalesce(value >= float(bound) if sign == ">=" else value > float(bound), F.lit(False))
        return F.when(wrong, told)

    own = [fault(n, kind, rule, n) for n, (kind, rule) in FIELDS.items()]
    times = [F.when(F.col(f"_issue_{n}").isNotNull(), n) for n in TIMES]
    inner = [fault(f"ref_{n}", "string", rule, f"outcome_reference/{n}") for n, rule in REFERENCE.items()]
    named = lambda names, known: F.array_except(F.coalesce(names, F.array().cast("array<string>")), F.array(*map(F.lit, known)))
    return _told(F.concat(F.array(*own, *times, *inner), named("_names_", FIELDS), named("_names_ref_", REFERENCE)))


def judge_manifests(manifests: DataFrame, text: str, artifacts: DataFrame | None = None) -> DataFrame:
    """manifests with faults (of the schema), codes (why it is refused, in order) and passed. Nothing between fields is judged for texts that are no JSON object.

    artifacts: (path, actual), the SHA-256 of what is retained at a path; a manifest whose artifact isn't there isn't refused for it. A null text is unreadable.
    """
    # each step's columns are read several times by the next: as columns of their own they are worked out once a row
    df = _opened(manifests.withColumn("_v", F.try_parse_json(F.col(text))), "_v", FIELDS, "")
    df = _opened(df, "_value_outcome_reference", REFERENCE, "ref_")
    df = df.withColumns({f"_text_{n}": _as(n, "STRING", "string") for n in [*(n for n, (kind, _) in FIELDS.items() if kind == "string"), *(f"ref_{n}" for n in REFERENCE)]})
    df = df.withColumns({f"_{part}_{n}": c for n in TIMES for part, c in zip(("at", "issue"), instant(F.col(f"_text_{n}")))})
    c, is_object = F.col("_v"), F.col("_object_").isNotNull()
    get = lambda n: F.col(f"_text_{n}")
    upper = lambda n: F.when(get(n).rlike("^[A-Z_]*$"), get(n)).otherwise(F.upper(F.coalesce(get(n), F.lit(""))))  # noqa: E731  # what is in capitals isn't folded
    number = lambda n: _as(n, "BIGINT", "long")
    true = lambda n: F.coalesce(_as(n, "BOOLEAN", "boolean"), F.lit(False))
    (source, source_issue), (post, post_issue) = [(F.col(f"_at_{n}"), F.col(f"_issue_{n}")) for n in TIMES]
    expected, observed = number("expected_active_starter_count"), number("observed_active_starter_count")
    if artifacts is not None:
        one = artifacts.groupBy(F.col("path").alias("_path")).agg(F.min("actual").alias("_actual"))
        df = df.join(one, get("artifact_path_or_uri") == F.col("_path"), "left")
        changed = F.coalesce(F.lower("_actual") != F.lower(F.coalesce(get("sha256"), F.lit(""))), F.lit(False))
    else:
        changed = F.lit(False)
    rules = [
        (source_issue == "DATE_ONLY", "SOURCE_AS_OF_TIMESTAMP_DATE_ONLY"), (source_issue != "DATE_ONLY", "SOURCE_AS_OF_TIMESTAMP_INVALID_OR_TIMEZONE_MISSING"), (post_issue.isNotNull(), "TARGET_SCHEDULED_POST_TIMESTAMP_INVALID_OR_TIMEZONE_MISSING"),
        (source >= post, "SOURCE_AS_OF_NOT_STRICTLY_BEFORE_TARGET_POST"), ((upper("source_as_of_provenance") == "FILENAME_DERIVED") & (upper("source_as_of_tier") == "PROVEN"), "FILENAME_DERIVED_CANNOT_CLAIM_PROVEN"),
        (~F.coalesce(expected >= 2, F.lit(False)), "ACTIVE_STARTER_COUNT_INSUFFICIENT"), (upper("identity_reconciliation_status") != "COMPLETE", "IDENTITY_RECONCILIATION_INCOMPLETE"),
        ((upper("field_completeness_status") != "COMPLETE") | ~expected.eqNullSafe(observed), "PARTIAL_STARTER_FIELD"), (upper("feature_vector_status") != "COMPLETE", "PARTIAL_FEATURE_VECTOR"), (~true("raw_artifact_retained"), "RAW_ARTIFACT_NOT_RETAINED"),
        (~true("pre_race_fields_only"), "PRE_RACE_FIELDS_ONLY_REQUIRED"), (~upper("outcome_provenance_status").isin("PROVEN", "OPERATOR_ATTESTED"), "OUTCOME_PROVENANCE_INSUFFICIENT"), (changed, "RAW_ARTIFACT_SHA256_MISMATCH"),
    ]
    found = df.withColumn("faults", F.when(is_object, schema_faults()).when(c.isNotNull(), F.array(F.lit("$"))).otherwise(F.array().cast("array<string>")))
    broken = F.when(F.size("faults") > 0, "MANIFEST_SCHEMA_INVALID")
    codes = F.when(c.isNull(), F.array(F.lit("MANIFEST_JSON_UNREADABLE"))).when(~is_object, F.array(F.lit("MANIFEST_SCHEMA_INVALID"))).otherwise(_told(F.array(broken, *[F.when(rule, name) for rule, name in rules])))
    return found.withColumn("codes", codes).withColumn("passed", F.size("codes") == 0).select(*manifests.columns, "faults", "codes", "passed")
