"""Gates and contracts: chaos of a field, promotion of models, contracts by family, outcomes to write, sparse edits, keyed lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.operators.audits import broken
from cohortcast.operators.members import EARLY, clamp, looked_up, rounded

#: How well a sire's line stays a route, and the mean for sires not listed.
SIRE_ROUTE = {
    "tapit": 0.90, "curlin": 0.90, "flatter": 0.85, "medaglia d'oro": 0.85, "american pharoah": 0.85, "pioneerof the nile": 0.85, "bernardini": 0.85,
    "justify": 0.85, "giant's causeway": 0.80, "empire maker": 0.80, "candy ride": 0.80, "kitten's joy": 0.80, "street sense": 0.80, "into mischief": 0.75,
    "honor code": 0.75, "nyquist": 0.75, "california chrome": 0.75, "war front": 0.70, "speightstown": 0.60,
}
OTHER_SIRE = 0.72
#: Terms of trip comments by running style; the order of styles settles ties.
STYLE_TERMS = {
    "front": r"(?i)\b(set\s+pace|led|clear\s+pace|quick\s+lead|took\s+over)\b",
    "presser": r"(?i)\b(pressed|dueled|vied|prompted|chased\s+pace)\b",
    "stalker": r"(?i)\b(tracked|chased|well\s+placed|settled\s+close)\b",
    "closer": r"(?i)\b(rallied|ran\s+on|gained|belatedly|late\s+kick)\b",
}
#: Words that tell a surface, first match first.
SURFACE_WORDS = {"turf": "turf", "dirt": "dirt|mud", "all_weather": "tapeta|polytrack|synthetic|all weather|all-weather"}
#: Least normalised entropy of a chaotic field, least price and longest layoff of a candidate, and the mass that is moved.
CHAOS_FLOOR, LONGSHOT, LAYOFF_CAP, BOOST = 0.72, 15, 45, 0.06
#: Weights of pace, class compression and a weak favourite in a field's intensity.
PACE_WEIGHT, CLASS_WEIGHT, FAVOURITE_WEIGHT = 0.30, 0.20, 0.20
#: What a model needs for promotion, and what for running in the shadow.
PROMOTION = {"completed": 500, "starters": 4000, "folds": 12, "coverage": 0.80, "brier": 0.02, "log_loss": 0.01}
SHADOW = {"completed": 20, "starters": 100, "coverage": 0.50}


def finish_energy(style: Column, finish: Column) -> Column:
    """What the style keeps back and the last finish, half each; null if either isn't known."""
    return F.round(0.5 * (1.0 - looked_up(style, EARLY)) + 0.5 * clamp(1.0 - (finish - 1.0) / 19.0), 4)


def form_cycle(placed: Column, finish: Column) -> Column:
    """Share of placed starts and the last finish; null if either isn't known."""
    return F.round(0.6 * placed + 0.4 * clamp(1.0 - (finish - 1.0) / 10.0), 4)


def sire_route(sire: Column) -> Column:
    """A listed sire's value, else the mean; so for null too."""
    return looked_up(F.lower(F.trim(sire)), SIRE_ROUTE, OTHER_SIRE)


def comment_styles(df: DataFrame, member: str, comment: str) -> DataFrame:
    """member, style and its count of terms over all comments; style is null without a term. Each comment is counted where it lies."""
    counts = [F.sum(F.coalesce(F.regexp_count(comment, F.lit(terms)), F.lit(0))).alias(f"_{s}") for s, terms in STYLE_TERMS.items()]
    sums = df.groupBy(member).agg(*counts)
    best = F.greatest(*[F.col(f"_{s}") for s in STYLE_TERMS])
    return sums.select(member, F.when(best > 0, F.coalesce(*[F.when(F.col(f"_{s}") == best, F.lit(s)) for s in STYLE_TERMS])).alias("style"), best.alias("terms"))


def surface_of(text: Column) -> Column:
    """The first surface of which the text has a word; null if none."""
    return F.coalesce(*[F.when(F.lower(text).rlike(words), F.lit(name)) for name, words in SURFACE_WORDS.items()])


def availability(df: DataFrame, by: str, flags: dict[str, Column]) -> DataFrame:
    """by, field, class (Available, Partial, Missing) and percent: how many of the group's rows have each field."""
    sums = df.groupBy(by).agg(F.count("*").alias("_n"), *[F.count_if(c).alias(k) for k, c in flags.items()])
    long = sums.select(by, "_n", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("_have")) for k in flags])).alias("_r")).select(by, "_n", "_r.*")
    kind = F.when(F.col("_have") == F.col("_n"), "Available").when(F.col("_have") > 0, "Partial").otherwise("Missing")
    return long.select(by, "field", kind.alias("class"), F.floor(100 * F.col("_have") / F.col("_n") + 0.5).cast("long").alias("percent"))


def chaos(df: DataFrame, group: str, member: str, p: str, market: str, style: str, furlongs: str, price: Column, career: Column, layoff: Column, tag: Column) -> DataFrame:
    """Adds entropy, intensity, active, eligible, boost, tier and adjusted_p.

    A field is active from CHAOS_FLOOR of normalised entropy. Its long-priced members with a win, a short layoff and no
    underlay tag share intensity * BOOST by a softmax of their inverse prices; the three likeliest pay for it by their shares.
    Unknown prices, rates and layoffs count as 0. One shuffle by group serves all windows.
    """
    w = Window.partitionBy(group)
    share = F.col(market) / F.sum(market).over(w)
    df = df.withColumn("_q", share).withColumn("_size", F.count("*").over(w))
    clipped = F.greatest(F.col("_q"), F.lit(1e-9))
    df = df.withColumn("_q1", clipped / F.sum(clipped).over(w))
    entropy = F.when(F.col("_size") <= 1, 0.0).otherwise(clamp(-F.sum(F.col("_q1") * F.log2("_q1")).over(w) / F.log2("_size")))
    fronts = F.count_if(F.col(style) == "front").over(w)
    many = F.when(F.col(furlongs) < 8.5, 3).otherwise(4)
    pace = ((fronts >= many) | (fronts == 0)).cast("int")
    close = ((F.stddev_pop("_q").over(w) < 0.04) & (F.col("_size") >= 8)).cast("int")
    df = df.withColumn("_h", entropy)
    intensity = clamp(F.col("_h") + PACE_WEIGHT * pace + CLASS_WEIGHT * close + FAVOURITE_WEIGHT * (1.0 - F.max("_q").over(w)))
    df = df.withColumns({"entropy": rounded(F.col("_h"), 4), "intensity": rounded(intensity, 4), "active": F.col("_h") >= CHAOS_FLOOR, "_price": F.coalesce(price, F.lit(0.0))})
    fit = (F.col("_price") >= LONGSHOT) & (F.coalesce(career, F.lit(0.0)) > 0) & (F.coalesce(tag, F.lit("")) != "underlay") & (F.coalesce(layoff, F.lit(0)) <= LAYOFF_CAP)
    df = df.withColumn("eligible", F.col("active") & fit)
    df = df.withColumn("_e", F.when(F.col("eligible"), F.exp(1.0 / F.least(F.col("_price"), F.lit(1000.0)))))
    weight = rounded(F.col("_e") / F.sum("_e").over(w), 4)
    df = df.withColumn("boost", F.coalesce(rounded(F.col("intensity") * weight * BOOST, 5), F.lit(0.0)))
    tier = F.when(F.col("boost") <= 0, "NONE").when(F.col("boost") < 0.005, "LOW").when(F.col("boost") < 0.015, "MEDIUM").otherwise("HIGH")
    df = df.withColumns({"tier": tier, "_total": F.sum("boost").over(w), "_nth": F.row_number().over(w.orderBy(F.desc(p), F.desc(member)))})
    pays = F.when(F.col("_nth") <= 3, F.col(p))
    paid = F.when(F.col("_nth") <= 3, F.greatest(F.lit(0.001), F.col(p) - F.col("_total") * F.col(p) / F.sum(pays).over(w))).otherwise(F.col(p))
    df = df.withColumn("_raw", paid + F.col("boost"))
    moved = F.when(F.col("_total") > 0, F.col("_raw") / F.sum("_raw").over(w)).otherwise(F.col(p))
    return df.withColumn("adjusted_p", F.round(moved, 6)).drop("_q", "_q1", "_size", "_h", "_price", "_e", "_total", "_nth", "_raw")


def gain(base: Column, candidate: Column) -> Column:
    """Relative improvement over a base; null where the base isn't positive or one isn't known."""
    return F.when(base > 0, (base - candidate) / base)


def promotion(df: DataFrame) -> DataFrame:
    """Adds mode (promoted, shadow, baseline) and reasons to rows of readiness.

    Columns: completed, starters, folds, coverage; groups_ok, labels_ok, no_leak; brier_gain, log_gain, calibrated, sizes_ok,
    registered, family_ok. The results are judged only where the readiness has no fault. Null counts as not met.
    """
    c = lambda name: F.coalesce(F.col(name), F.lit(0))
    yes = lambda name: F.coalesce(F.col(name), F.lit(False))
    early = broken([
        ("insufficient_completed_races", c("completed") < PROMOTION["completed"]), ("insufficient_labeled_starters", c("starters") < PROMOTION["starters"]),
        ("insufficient_feature_coverage", c("coverage") < PROMOTION["coverage"]), ("insufficient_rolling_folds", c("folds") < PROMOTION["folds"]),
        ("invalid_race_group_membership", ~yes("groups_ok")), ("invalid_outcome_labels", ~yes("labels_ok")), ("leakage_check_failed", ~yes("no_leak"))])
    beaten = F.coalesce((F.col("brier_gain") >= PROMOTION["brier"]) & (F.col("log_gain") >= PROMOTION["log_loss"]), F.lit(False))
    late = broken([("oof_baseline_not_beaten", ~beaten), ("calibration_failed", ~yes("calibrated")), ("field_size_regression", ~yes("sizes_ok")), ("artifact_registration_incomplete", ~yes("registered")), ("artifact_family_mismatch", ~yes("family_ok"))])
    shadow = (c("completed") >= SHADOW["completed"]) & (c("starters") >= SHADOW["starters"]) & (c("coverage") >= SHADOW["coverage"]) & yes("groups_ok") & yes("labels_ok") & yes("no_leak")
    out = df.withColumn("_early", early).withColumn("_why", F.when(F.size("_early") > 0, F.col("_early")).otherwise(late))
    mode = F.when(F.size("_why") == 0, "promoted").when(shadow, "shadow").otherwise("baseline")
    extra = F.when(F.col("mode") == "promoted", F.array(F.lit("promoted"))).when(F.col("mode") == "shadow", F.array(F.lit("shadow_only"))).otherwise(F.array().cast("array<string>"))
    return out.withColumn("mode", mode).withColumn("reasons", F.concat("_why", extra)).drop("_early", "_why")


def contracts(registry: DataFrame, runs: DataFrame, family: str, id: str, ts: str, aliases: dict[str, str], families: list[str]) -> DataFrame:
    """family, id, from_run: the model of the family's latest run (ties: larger id), else the newest registered. Combined before the shuffle."""
    models = registry.select(id, F.coalesce(looked_up(F.col(family), aliases), F.col(family)).alias(family)).where(F.col(family).isin(families))
    latest = runs.groupBy(id).agg(F.max(ts).alias("_ts"))
    best = models.join(latest, id, "left").groupBy(family).agg(F.max(F.struct(F.col("_ts").isNotNull().alias("ran"), "_ts", id)).alias("_m"))
    return best.select(family, F.col(f"_m.{id}").alias(id), F.col("_m.ran").alias("from_run"))


def outcome_status(planned: DataFrame, existing: DataFrame, matched: DataFrame, group: str, member: str, finish: str) -> DataFrame:
    """A row for each planned group: POPULATED with its number of rows, or 0 rows and UNCHANGED, EXISTING_DIFFERS or NOT_MATCHED.

    Both sides meet as counts by (group, member, finish), so groups of any size stay linear.
    """
    side = lambda df, a, b: df.select(group, member, finish, F.lit(a).alias("_a"), F.lit(b).alias("_b"))
    rows = side(planned, 1, 0).unionByName(side(existing, 0, 1)).groupBy(group, member, finish).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    sums = rows.groupBy(group).agg(F.sum("_a").alias("_planned"), F.sum("_b").alias("_had"), F.count_if((F.col("_a") > 0) != (F.col("_b") > 0)).alias("_odd"))
    ok = matched.select(group).distinct().withColumn("_ok", F.lit(True))
    status = F.when(F.col("_ok").isNull(), "NOT_MATCHED").when(F.col("_had") == 0, "POPULATED").when(F.col("_odd") == 0, "UNCHANGED").otherwise("EXISTING_DIFFERS")
    return sums.where("_planned > 0").join(ok, group, "left").select(group, status.alias("status"), F.when(status == "POPULATED", F.col("_planned")).otherwise(0).cast("long").alias("populated"))


def patched(stored: DataFrame, patch: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the values of a patch (one row a key) where they aren't null, and n_changed; a patch of no stored key does nothing."""
    columns = [c for c in patch.columns if c not in keys]
    both = stored.join(patch.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in columns]), keys, "left")
    changed = sum((F.coalesce(~F.col(f"_n_{c}").eqNullSafe(F.col(c)) & F.col(f"_n_{c}").isNotNull(), F.lit(False)).cast("int") for c in columns), F.lit(0))
    return both.select(*[F.coalesce(F.col(f"_n_{c}"), F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns], changed.alias("n_changed"))


def appended(stored: DataFrame, arriving: DataFrame, keys: list[str]) -> DataFrame:
    """arriving with status: unchanged where the key (with its content's hash) is stored, else new. Null keys are told like values."""
    have = stored.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct().withColumn("_had", F.lit(True))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return arriving.join(have, on, "left").select(*arriving.columns, F.when(F.col("_had"), "unchanged").otherwise("new").alias("status"))


def found_card(asked: DataFrame, cards: DataFrame, aliases: DataFrame, keys: list[str], id: str) -> DataFrame:
    """asked (raw, and the other keys) with the least id of the card of the same key, raw being canonicalised by aliases (name, code) or itself.

    Cards are reduced to one row a key first, so no asked row multiplies; nothing found gives null.
    """
    code, rest = keys[0], keys[1:]
    known = aliases.groupBy(F.upper(F.trim("name")).alias("_raw")).agg(F.min("code").alias("_code"))
    one = cards.groupBy(*keys).agg(F.min(id).alias(id))
    named = asked.withColumn("_raw", F.upper(F.trim("raw"))).join(known, "_raw", "left").withColumn(code, F.coalesce("_code", "_raw")).drop("_raw", "_code")
    return named.join(one, [code, *rest], "left")
