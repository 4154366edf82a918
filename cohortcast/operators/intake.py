"""Intake of feeds and logs, stewards' orders, board permissions, model choice and agreement of views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortcast.functions.odds import american_to_decimal, text_to_decimal

#: What a board may show by run mode; "live" means only with live prices.
CONTRACT = {
    "BLOCKED": {},
    "MARKET_BASELINE_ONLY": {"reference": True},
    "MARKET_ANCHORED_NOT_ACTIONABLE": {"reference": True},
    "PP_PARSED_FEATURES_PENDING": {},
    "MODEL_READY_LIMITED": {"model": True, "reference": True, "live_market": "live", "scoring": True},
    "MODEL_READY": {"model": True, "reference": True, "live_market": "live", "fair_odds": "live", "edge": "live", "tags": "live", "stakes": "live", "scoring": True},
}
PERMISSIONS = ["model", "reference", "live_market", "fair_odds", "edge", "tags", "stakes", "scoring"]
#: Texts of a log's switch that mean off.
OFF = ["", "0", "off", "false", "no"]


def effective_mode(mode: Column, collapsed: Column, has_model: Column) -> Column:
    """A model's mode falls back to the market's where its forecast collapsed to it, or where there is none to tell by."""
    ready = mode.isin("MODEL_READY", "MODEL_READY_LIMITED")
    return F.when(ready & (F.coalesce(collapsed, F.lit(True)) | ~F.coalesce(has_model, F.lit(False))), "MARKET_ANCHORED_NOT_ACTIONABLE").otherwise(mode)


def permissions(mode: Column, live: Column) -> dict[str, Column]:
    """What may be shown in a mode, as columns; a mode that isn't known shows nothing."""
    out = {}
    for name in PERMISSIONS:
        rules = {k: v.get(name, False) for k, v in CONTRACT.items()}
        always, if_live = [k for k, v in rules.items() if v is True], [k for k, v in rules.items() if v == "live"]
        out[name] = F.coalesce(mode.isin(always) if always else F.lit(False), F.lit(False)) | F.coalesce(mode.isin(if_live) & live if if_live else F.lit(False), F.lit(False))
    return out


def scanned_prices(feed: DataFrame, entries: DataFrame, keys: list[str], books: list[str]) -> DataFrame:
    """feed (keys, book, decimal_odds, american_odds, morning_line as text) with price, odds_type and skipped.

    The first readable of decimal, American and morning line counts. skipped is book, odds or entry (no entry of these keys),
    the first that applies, or null for a row to keep. Entries are made distinct first, so that no row multiplies.
    """
    american = american_to_decimal(F.trim("american_odds").try_cast("int").cast("double"))
    decimal, line = F.col("decimal_odds").try_cast("double"), text_to_decimal(F.col("morning_line"))
    book = F.lower(F.trim(F.coalesce(F.when(F.col("book") != "", F.col("book")), F.lit("manual"))))
    out = feed.withColumns({"book": book, "price": F.coalesce(decimal, american, line), "odds_type": F.when(F.coalesce(decimal, american).isNotNull(), "live_tote").when(line.isNotNull(), "morning_line")})
    out = out.join(entries.select(*keys).distinct().withColumn("_e", F.lit(True)), keys, "left")
    skipped = F.when(~F.col("book").isin(books), "book").when(F.col("price").isNull(), "odds").when(F.col("_e").isNull(), "entry")
    return out.withColumn("skipped", skipped).drop("_e")


def log_fields(finish: Column, mark: Column, distance: Column, switch: Column) -> dict[str, Column]:
    """A log's texts as values: place (null if no whole number), scratched, marked, furlongs ("7.5f") and on."""
    place = F.trim(finish)
    return {
        "place": F.when(place.rlike(r"^[+-]?\d{1,9}$"), place.cast("int")),
        "scratched": F.coalesce(F.upper(place) == "SCR", F.lit(False)),
        "marked": F.coalesce(mark.contains("✓"), F.lit(False)),
        "furlongs": F.when(F.trim(distance).rlike(r"^\d+(\.\d+)?[fF]$"), F.regexp_replace(F.trim(distance), "[fF]", "").cast("double")),
        "on": ~F.coalesce(F.lower(F.trim(switch)).isin(OFF), F.lit(True)),
    }


def matched_cards(log: DataFrame, cards: DataFrame, keys: list[str], id: str) -> DataFrame:
    """log with the id of the one card of its keys and status MATCHED, UNMATCHED or AMBIGUOUS (no id). Cards are counted by key first."""
    known = cards.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(id).alias("_id"))
    status = F.when(F.col("_n") == 1, "MATCHED").when(F.col("_n") > 1, "AMBIGUOUS").otherwise("UNMATCHED")
    return log.join(known, keys, "left").withColumn("status", status).withColumn(id, F.when(F.col("_n") == 1, F.col("_id"))).drop("_n", "_id")


def official_order(runs: DataFrame, moves: DataFrame, ties: DataFrame, group: str, member: str, run: str) -> DataFrame:
    """group, member, run, place and moved: the order as run after the stewards' moves (group, nth, member, to), in their order, and shared places (group, member, place).

    A move takes a member out and puts it in at `to`, at the end if that is beyond; one of an unknown member does nothing.
    A group is one field, whose size the sport bounds.
    """
    order = runs.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(run, member))), lambda s: s[member]).alias("_order"))
    steps = moves.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("nth", member, "to"))).alias("_moves"))

    def moved(o, step):
        rest = F.filter(o, lambda x: x != step[member])
        put = F.concat(F.slice(rest, 1, step["to"] - 1), F.array(step[member]), F.slice(rest, step["to"], F.size(rest) + 1))
        return F.when(F.array_contains(o, step[member]), put).otherwise(o)

    both = order.join(steps, group, "left")
    final = both.withColumn("_order", F.when(F.col("_moves").isNull(), F.col("_order")).otherwise(F.aggregate("_moves", F.col("_order"), moved)))
    places = final.select(group, F.transform("_moves", lambda s: s[member]).alias("_who"), F.posexplode("_order").alias("_p", member))
    named = places.join(runs.select(group, member, run), [group, member]).join(ties.select(group, member, F.col("place").alias("_tie")), [group, member], "left")
    return named.select(group, member, run, F.coalesce("_tie", F.col("_p") + 1).alias("place"), F.coalesce(F.array_contains("_who", F.col(member)), F.lit(False)).alias("moved"))


def chosen_models(asked: DataFrame, models: DataFrame, segment: str, version: str, pooled: str = "pooled") -> DataFrame:
    """asked with model_segment and model_version: its segment's newest version, else the pooled one's, else null.

    Models are reduced to a row a segment; a registry is small, but its size isn't assumed: the plan picks the join.
    """
    newest = models.groupBy(segment).agg(F.max(version).alias("_v"))
    general = newest.where(F.col(segment) == pooled).agg(F.max("_v").alias("_pooled"))  # one row
    out = asked.join(newest, segment, "left").crossJoin(F.broadcast(general))
    return out.select(*asked.columns, F.when(F.col("_v").isNotNull(), F.col(segment)).when(F.col("_pooled").isNotNull(), pooled).alias("model_segment"), F.coalesce("_v", "_pooled").alias("model_version"))


def view_mismatches(one: DataFrame, other: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys and fields: names of the fields in which two views of the same keys differ, nulls told like values; only keys of both."""
    both = one.join(other.select(*keys, *[F.col(c).alias(f"_o_{c}") for c in fields]), keys)
    differ = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_o_{c}")), F.lit(c)) for c in fields]))
    return both.select(*keys, differ.alias("fields")).where(F.size("fields") > 0)


def history_status(parsed: DataFrame, entities: DataFrame, on_card: DataFrame, stored: DataFrame, name: str, id: str, date: str) -> DataFrame:
    """parsed with the id of its name's entity (letter case aside) and status, the first that applies: UNMATCHED, NOT_ON_CARD, DUPLICATE (entity and date are stored) or INSERTED.

    Of arriving rows of one entity and date the first by all columns is inserted, the others are duplicates.
    """
    columns = parsed.columns
    known = entities.groupBy(F.lower(name).alias("_k")).agg(F.min(id).alias(id))
    out = parsed.withColumn("_k", F.lower(name)).join(known, "_k", "left").join(on_card.select(id).distinct().withColumn("_c", F.lit(True)), id, "left")
    out = out.join(stored.select(id, date).distinct().withColumn("_s", F.lit(True)), [id, date], "left")
    # Only rows that may be inserted are numbered, so the unmatched ones, which share a null id, meet in no window.
    fit = F.col("_c") & F.col("_s").isNull()
    first = out.where(fit).withColumn("_nth", F.row_number().over(Window.partitionBy(id, date).orderBy(*columns))).withColumn("status", F.when(F.col("_nth") == 1, "INSERTED").otherwise("DUPLICATE"))
    rest = out.where(~F.coalesce(fit, F.lit(False))).withColumn("status", F.when(F.col(id).isNull(), "UNMATCHED").when(F.col("_c").isNull(), "NOT_ON_CARD").otherwise("DUPLICATE"))
    return first.select(*columns, id, "status").unionByName(rest.select(*columns, id, "status"))


def upserted(stored: DataFrame, arriving: DataFrame, keys: list[str], id: str) -> DataFrame:
    """The registry after arriving rows (one a key, without ids): a known key keeps its id and takes the new values, a new one gets an id from its key's hash; action tells which.

    The hash has 63 bits and asks no row for the largest id, so that it needs no order over all rows.
    """
    values = [c for c in arriving.columns if c not in keys]
    both = stored.withColumn("_s", F.lit(True)).join(arriving.select(*keys, F.lit(True).alias("_a"), *[F.col(c).alias(f"_n_{c}") for c in values]), keys, "full_outer")
    made = F.coalesce(id, F.xxhash64(*keys).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF)))
    action = F.when(F.col("_a").isNull(), "kept").when(F.col("_s").isNull(), "inserted").otherwise("updated")
    return both.select(*keys, made.alias(id), *[F.when(F.col("_a"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in values], action.alias("action"))


def provider_coverage(one: DataFrame, two: DataFrame, key: str, features: list[str], as_of: str, cutoff: str) -> DataFrame:
    """feature, both, conflicts, only_first, only_second, neither and unproven: how two providers (one row a key each) cover each feature.

    unproven counts keys with a value of which no provider's as-of is known to lie before the cutoff (a column of the first).
    """
    both = one.join(two.select(key, F.col(as_of).alias("_as_of"), *[F.col(c).alias(f"_o_{c}") for c in features]), key, "left")
    ok = lambda v, t: F.col(v).isNotNull() & F.coalesce(F.col(t) < F.col(cutoff), F.lit(False))
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).isNotNull().alias("a"), F.col(f"_o_{c}").isNotNull().alias("b"), F.coalesce(F.col(c) != F.col(f"_o_{c}"), F.lit(False)).alias("x"), (ok(c, as_of) | ok(f"_o_{c}", "_as_of")).alias("p")) for c in features])
    r = both.select(F.explode(cells).alias("_r")).select("_r.*")
    a, b = F.col("a"), F.col("b")
    return r.groupBy("feature").agg(F.count_if(a & b).alias("both"), F.count_if("x").alias("conflicts"), F.count_if(a & ~b).alias("only_first"), F.count_if(b & ~a).alias("only_second"), F.count_if(~a & ~b).alias("neither"), F.count_if((a | b) & ~F.col("p")).alias("unproven"))


def created_groups(feed: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """keys and created: the known groups and those that a feed names first. A feed's row with a null key makes no group."""
    named = feed.select(*keys).dropna().distinct().join(groups.select(*keys).distinct(), keys, "left_anti")
    return groups.select(*keys).distinct().withColumn("created", F.lit(False)).unionByName(named.withColumn("created", F.lit(True)))
