"""Price captures as a stream: ingest, assembly, drift, settlement, arrival of artifacts, and evaluation as outcomes come in."""

from __future__ import annotations

import json
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType


def ingest(captures: DataFrame, posts: DataFrame, group: str, ts: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Captures before their group's post time, each once within the watermark. posts is a table (group, post)."""
    known = captures.join(posts, group).where(F.col(ts) < F.col("post")).drop("post")
    return known.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def complete_batches(captures: DataFrame, expected: DataFrame, group: str, member: str, batch: str, ts: str, price: str, late: str = "10 minutes", wait: str = "10 minutes", at_once: bool = True, buckets: int = 4096) -> DataFrame:
    """(group, batch, members, refused): capture batches that quote every expected member of their group.

    batch: a timestamp that the quotes of one capture share; expected: a table (group, member). The state of a batch holds its
    members' first prices, so it is as large as its group's field. With `at_once` a batch comes out with the quote that completes it
    and never again; it is forgotten when the watermark has passed it by `wait`. Without, it is judged at that time, and left out if a member was
    quoted at two prices. Repeated quotes change nothing; those of members that aren't expected are ignored, and so are late ones and those without a price.

    Groups are dealt by a hash into `buckets`; those of one bucket and batch, which end together, share a row of state and a call, since a call costs more than
    its quotes. Some tens of groups a bucket are best; the number stays the same as long as a checkpoint is used.
    """
    want = expected.where(F.col(member).isNotNull()).groupBy(group).agg(F.to_json(F.sort_array(F.collect_set(F.col(member).cast("string")))).alias("_want"))
    quotes = captures.withWatermark(ts, late).where(F.col(price).isNotNull()).join(want, group)
    quotes = quotes.select(F.pmod(F.xxhash64(F.col(group).cast("string")), F.lit(buckets)).cast("int").alias("_bucket"), F.col(group).cast("string").alias("_group"), F.col(batch).cast("timestamp").alias("_batch"), F.col(ts), F.col(member).cast("string").alias("_member"), F.col(price).cast("double").alias("_price"), "_want", F.expr(f"unix_millis(CAST(`{batch}` AS timestamp) + interval {wait})").alias("_until"))

    def assemble(key, frames: Iterable[pd.DataFrame], state):
        held = json.loads(state.get[0]) if state.exists else {}
        wanted: dict[str, set] = {}
        whole = lambda g: bool(wanted.setdefault(g["want"], set(json.loads(g["want"])))) and wanted[g["want"]] <= g["prices"].keys()
        rows = lambda found: pd.DataFrame({"key": found, "batch": [key[1]] * len(found), "members": [len(held[name]["prices"]) for name in found]})
        judged = lambda names: [name for name in names if not at_once and whole(held[name]) and not held[name]["clash"]]
        if state.hasTimedOut:
            found = judged(held)
            state.remove()
            if found:
                yield rows(found)
            return
        until, touched = None, {}
        for frame in frames:
            for name, member_, cost, want_ in zip(frame["_group"].array, frame["_member"].array, frame["_price"].tolist(), frame["_want"].array):
                g = touched.get(name)
                if g is None:
                    g = touched[name] = held.setdefault(name, {"prices": {}, "clash": False, "told": False})
                if g.get("want") != want_:
                    g["want"] = want_
                if want_ not in wanted:
                    wanted[want_] = set(json.loads(want_))
                if member_ in wanted[want_]:
                    g["clash"] |= g["prices"].setdefault(member_, cost) != cost
            if len(frame):
                until = int(frame["_until"].iloc[-1])
        found = []
        if until is not None and state.exists and state.getCurrentWatermarkMs() > until:  # over already: only those with new quotes wait on
            found = judged([name for name in held if name not in touched])
        for name, g in touched.items():
            if not g["told"] and whole(g):
                g["told"] = True
                if at_once:
                    found.append(name)
        told = rows(found)
        if until is not None and state.getCurrentWatermarkMs() > until:
            held = touched
        state.update((json.dumps(held),))
        if until is not None:
            state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
        if found:
            yield told

    out = quotes.groupBy("_bucket", "_batch").applyInPandasWithState(assemble, "key string, batch timestamp, members int", "held string", "append", "EventTimeTimeout")
    return out.select(F.col("key").cast(captures.schema[group].dataType).alias(group), "batch", "members")


def drift(captures: DataFrame, by: list[str], ts: str, price: str, window: str = "10 minutes", slide: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """First and last price, and the change, of each sliding window."""
    w = captures.withWatermark(ts, late).groupBy(F.window(ts, window, slide).alias("at"), *by).agg(F.min_by(price, ts).alias("opening"), F.max_by(price, ts).alias("closing"), F.count("*").alias("n"))
    return w.select(F.col("at.start").alias("start"), *by, "opening", "closing", "n", (F.col("closing") / F.col("opening") - 1).alias("change"))


def settlements(bets: DataFrame, outcomes: DataFrame, key: str, bet_ts: str, outcome_ts: str, within: str = "2 days", late: str = "1 day") -> DataFrame:
    """Open bets joined to outcomes that arrive within a span after them; bets without one come out, once, when the watermark passes the span.

    A bet (key, bet_ts) that is told again counts once. It is forgotten when the watermark has passed it, for it would come too late then.
    """
    b = bets.withWatermark(bet_ts, late).dropDuplicates([key, bet_ts]).alias("b")
    o = outcomes.withWatermark(outcome_ts, late).alias("o")
    on = F.expr(f"b.{key} = o.{key} AND o.{outcome_ts} >= b.{bet_ts} AND o.{outcome_ts} <= b.{bet_ts} + interval {within}")
    return b.join(o, on, "left_outer").select("b.*", *[F.col(f"o.{c}").alias(f"outcome_{c}") for c in outcomes.columns])


def _bytes(held: pd.DataFrame) -> bytes:
    out, rows = pa.BufferOutputStream(), pa.Table.from_pandas(held, preserve_index=False)
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as writer:
        writer.write_table(rows)
    return out.getvalue().to_pybytes()


def settled_by_bucket(bets: DataFrame, outcomes: DataFrame, key: str, bet_ts: str, outcome_ts: str, within: str = "2 days", late: str = "1 day", buckets: int = 4096) -> DataFrame:
    """(key, bet_ts, outcome_<outcome_ts>): `settlements` of many bets, of their keys and times alone.

    Keys are dealt by a hash into `buckets`, and what a bucket has open is one row of state, as compressed columns: some ten bytes a bet, where a row of a join's state
    takes hundreds. Some ten thousand bets a bucket are best; the number stays the same as long as a checkpoint is used. Bets and outcomes that are told again change nothing;
    those without a time are ignored, and bets without a key have no outcome. Bets are held until the watermark has passed their span, outcomes until it has passed them.
    """
    whole = isinstance(bets.schema[key].dataType, IntegralType)
    kind, empty = ("long", F.lit(0).cast("long")) if whole else ("string", F.lit(""))

    def side(df, ts, bet):
        until = F.expr(f"unix_micros(CAST(`{ts}` AS timestamp) + interval {within})") if bet else F.unix_micros(F.col(ts).cast("timestamp"))
        of = F.col(key).cast(kind)
        some = df.withWatermark(ts, late).where(F.col(ts).isNotNull() if bet else F.col(ts).isNotNull() & F.col(key).isNotNull())
        return some.select(F.pmod(F.xxhash64(of), F.lit(buckets)).cast("int").alias("_bucket"), F.coalesce(of, empty).alias("key"), F.col(key).isNull().alias("none"), F.col(ts).alias("_ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), until.alias("until"), F.lit(bet).alias("bet"))

    def settle(bucket, frames: Iterable[pd.DataFrame], state):
        columns = ["key", "none", "at", "until", "bet"]
        frames = [] if state.hasTimedOut else [f[columns] for f in frames]
        held = pa.ipc.open_stream(state.get[0]).read_all().to_pandas() if state.exists else None
        mark = state.getCurrentWatermarkMs() * 1000
        rows = pd.concat([*([] if held is None else [held.assign(old=True)]), *[f.assign(old=False, met=False) for f in frames]], ignore_index=True)
        rows = rows.drop_duplicates(["key", "none", "at", "bet"], ignore_index=True)  # the first stays, which is the held one
        b, o = rows[rows["bet"]].reset_index(names="row"), rows[~rows["bet"]]
        pairs = b[~b["none"]].merge(o[["key", "at", "old"]], on="key", suffixes=("", "_told"))
        pairs = pairs[~(pairs["old"] & pairs["old_told"]) & (pairs["at"] <= pairs["at_told"]) & (pairs["at_told"] <= pairs["until"])]
        rows.loc[pairs["row"].unique(), "met"] = True
        over = rows["bet"] & (rows["until"] < mark)
        lost = rows[over & ~rows["met"]]
        kept = rows[(rows["bet"] & ~over) | (~rows["bet"] & (rows["at"] > mark))]
        if len(kept):
            state.update((_bytes(kept[[*columns, "met"]]),))
            state.setTimeoutTimestamp(max(int(kept["until"].min()), mark) // 1000 + 1)
        else:
            state.remove()
        for found in (pairs.assign(settled=True), lost.assign(at_told=0, settled=False)):
            if len(found):
                yield found[["key", "none", "at", "at_told", "settled"]]

    both = side(bets, bet_ts, True).unionByName(side(outcomes, outcome_ts, False))
    out = both.groupBy("_bucket").applyInPandasWithState(settle, f"key {kind}, none boolean, at long, at_told long, settled boolean", "held binary", "append", "EventTimeTimeout")
    time = lambda c, df, ts: F.timestamp_micros(c).cast(df.schema[ts].dataType)
    told = F.when(F.col("settled"), time("at_told", outcomes, outcome_ts))
    return out.select(F.when(~F.col("none"), F.col("key")).cast(bets.schema[key].dataType).alias(key), time("at", bets, bet_ts).alias(bet_ts), told.alias(f"outcome_{outcome_ts}"))


def stored(spark, path: str) -> DataFrame | None:
    """The table at path, or None where nothing is stored yet. Any other fault is the caller's."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def fresh_rows(batch: DataFrame, batch_id: int, path: str, keys: list[str], parts: int = 32) -> DataFrame:
    """Rows of the batch whose keys no other batch has stored at path, each key once, with their `stored_part`.

    The table is partitioned by batch (`stored_batch`) and a hash of the keys: only parts that the batch touches are read (at most `parts` numbers come to the driver),
    and never what an earlier try of this batch has left.
    """
    own = batch.withColumn("stored_part", F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")).dropDuplicates(keys)
    known = stored(batch.sparkSession, path)
    if known is None:
        return own
    touched = [r.stored_part for r in own.select("stored_part").distinct().collect()]
    return own.join(known.where(F.col("stored_part").isin(touched) & (F.col("stored_batch") != batch_id)).select("stored_part", *keys), ["stored_part", *keys], "left_anti")


def store_new(batch: DataFrame, batch_id: int, path: str, keys: list[str], parts: int = 32) -> None:
    """For foreachBatch: stores rows whose keys the table at path lacks. A batch that is tried again replaces its own rows, so nothing is stored twice.

    The batch is kept while it is stored, for its parts are asked for first, and what makes it (state, joins) would run again.
    """
    batch = batch.persist()
    try:
        fresh_rows(batch, batch_id, path, keys, parts).write.mode("overwrite").partitionBy("stored_part").parquet(f"{path}/stored_batch={batch_id}")
    finally:
        batch.unpersist()


def evaluate_new(batch: DataFrame, batch_id: int, path: str, keys: list[str], by: list[str], sums: dict[str, F.Column], parts: int = 32) -> None:
    """For foreachBatch: stores new rows under path/rows, and the sums of what is new by `by` under path/sums. Both are replaced when a batch is tried again."""
    batch = batch.persist()
    new = fresh_rows(batch, batch_id, f"{path}/rows", keys, parts).persist()
    try:
        new.write.mode("overwrite").partitionBy("stored_part").parquet(f"{path}/rows/stored_batch={batch_id}")
        new.groupBy(*by).agg(*[F.sum(x).alias(name) for name, x in sums.items()]).coalesce(1).write.mode("overwrite").parquet(f"{path}/sums/stored_batch={batch_id}")
    finally:
        new.unpersist()
        batch.unpersist()


def evaluation(spark, path: str, by: list[str], sums: list[str]) -> DataFrame:
    """The sums of all batches: what is read grows with the batches, not with their rows."""
    return spark.read.parquet(f"{path}/sums").groupBy(*by).agg(*[F.sum(c).alias(c) for c in sums])
