"""Messy source fields: distances, times, dates, flags, names and classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

YARDS_A_FURLONG = 220.0
#: Accented letters and their plain ones, for keys.
ACCENTED, PLAIN = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
#: What sources write for yes and for no.
YES, NO = ["1", "true", "yes", "y", "x", "✓", "✔"], ["0", "false", "no", "n", ""]


def furlongs(text: Column) -> Column:
    """6f, 7.0f, 6 1/2 furlongs, 1 1/16 miles, 1m, 1320 yards or a number of furlongs; else null."""
    t = F.lower(F.trim(text))
    whole = r"([0-9]+(?:\.[0-9]+)?)?(?: ?([0-9]+)/([0-9]+))?"
    n = lambda p, g: F.regexp_extract(t, p, g).try_cast("double")

    def mixed(unit: str):
        p = rf"^{whole} ?(?:{unit})$"
        value = F.coalesce(n(p, 1), F.lit(0.0)) + F.coalesce(n(p, 2) / F.nullif(n(p, 3), F.lit(0.0)), F.lit(0.0))
        return F.when(t.rlike(p) & (value > 0), value)

    return F.coalesce(mixed("f|fur|furlongs?"), 8 * mixed("m|mi|miles?"), mixed("y|yds?|yards?") / YARDS_A_FURLONG, F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), t.try_cast("double")))


def furlongs_of_yards(yards: Column) -> Column:
    return F.round(yards / YARDS_A_FURLONG, 2)


def seconds(text: Column) -> Column:
    """1:10.40 or 70.4, as seconds."""
    t = F.trim(text)
    minutes = F.regexp_extract(t, r"^([0-9]+):([0-9]{1,2}(?:\.[0-9]+)?)$", 1).try_cast("double")
    rest = F.regexp_extract(t, r"^([0-9]+):([0-9]{1,2}(?:\.[0-9]+)?)$", 2).try_cast("double")
    return F.coalesce(60 * minutes + rest, F.when(t.rlike(r"^[0-9]+(\.[0-9]+)?$"), t.try_cast("double")))


def money(text: Column) -> Column:
    return F.regexp_replace(text, r"[$, ]", "").try_cast("double")


def any_date(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd", "MMMM d, yyyy")) -> Column:
    """The first format that fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats])


def flag(text: Column) -> Column:
    """Yes, no, or null where neither is meant."""
    t = F.lower(F.trim(text))
    return F.when(t.isin(*YES), True).when(t.isin(*NO), False)


def ascii_key(name: Column) -> Column:
    """Upper case without accents, punctuation or a country suffix in brackets; one space between words."""
    bare = F.regexp_replace(name, r"\s*\([A-Za-z]{2,3}\)\s*$", "")
    return F.trim(F.regexp_replace(F.upper(F.translate(bare, ACCENTED, PLAIN)), r"[^A-Z0-9]+", " "))


def squash_key(name: Column) -> Column:
    """The key without spaces."""
    return F.regexp_replace(ascii_key(name), " ", "")


def person_tokens(name: Column) -> Column:
    """Sorted words of a person's name, without initials and generation suffixes."""
    return F.array_sort(F.filter(F.split(ascii_key(name), " "), lambda w: (F.length(w) > 1) & ~w.isin("JR", "SR", "II", "III", "IV")))


def content_id(*cols) -> Column:
    """A stable identifier of the values."""
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string") if isinstance(c, str) else c.cast("string"), F.lit("\x00")) for c in cols]), 256)


def norm(x: Column, lo: float, hi: float) -> Column:
    """x scaled to 0..1 between lo and hi."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - lo) / (hi - lo)))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b)


def similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest)


#: Number words, parts and units of spelled-out distances (a mile is 8 furlongs, a yard 1/220).
SPELLED = dict(zip("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split(), range(20)))
SPELLED_TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
SPELLED_PARTS = {"half": 2, "halves": 2, "third": 3, "thirds": 3, "quarter": 4, "quarters": 4, "fourth": 4, "fourths": 4, "eighth": 8, "eighths": 8, "sixteenth": 16, "sixteenths": 16}
SPELLED_UNITS = {"furlong": 1.0, "furlongs": 1.0, "mile": 8.0, "miles": 8.0, "yard": 1 / YARDS_A_FURLONG, "yards": 1 / YARDS_A_FURLONG}


def spelled_furlongs(text: Column) -> Column:
    """"One And One Sixteenth Miles" is 8.5 furlongs; "Seven Furlongs and Forty Five Yards" and the like add up. Null where a word isn't understood or a number has no unit.

    Words are read from the left by a state: sum of finished units, whole number and parts before the unit, the number that waits for what it counts. Meant for distinct texts
    (`joins.by_distinct`), for it is read word by word.
    """
    table = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, float(v))])
    tables = {"ones": table(SPELLED), "tens": table(SPELLED_TENS), "parts": table(SPELLED_PARTS), "units": table(SPELLED_UNITS)}
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"))
    none = F.lit(None).cast("double")
    state = lambda total, whole, wait, part, tens, unit, bad: F.struct(total.alias("total"), whole.alias("whole"), wait.alias("wait"), part.alias("part"), tens.alias("tens"), unit.alias("unit"), bad.alias("bad"))
    zero, no, yes = F.lit(0.0), F.lit(False), F.lit(True)

    def step(s, word):
        one, ten, part, unit = (F.try_element_at(t, word) for t in tables.values())
        done = s.whole + F.coalesce(s.wait, zero)
        joins_tens = s.wait.isNotNull() & s.tens & (one < 10)
        failed = state(s.total, s.whole, s.wait, s.part, s.tens, s.unit, yes)
        counted = state(s.total + (done + s.part) * unit, zero, none, zero, no, yes, s.bad | (done + s.part == 0))
        return (
            F.when(word.isin("and", "about"), s)
            .when(ten.isNotNull(), state(s.total, done, ten, s.part, yes, s.unit, s.bad))
            .when(one.isNotNull(), F.when(joins_tens, state(s.total, s.whole, s.wait + one, s.part, no, s.unit, s.bad)).otherwise(state(s.total, done, one, s.part, no, s.unit, s.bad)))
            .when(part.isNotNull(), F.when(s.wait.isNull(), failed).otherwise(state(s.total, s.whole, none, s.part + s.wait / part, no, s.unit, s.bad)))
            .when(unit.isNotNull(), counted)
            .otherwise(failed)
        )

    def end(s):
        rest = s.wait.isNotNull() | (s.whole != 0) | (s.part != 0)
        return F.when(s.unit & ~s.bad & ~rest, F.round(s.total, 4))

    return F.aggregate(F.coalesce(words, F.array().cast("array<string>")), state(zero, zero, none, zero, no, no, no), step, end)


#: Zones of the states that have one, with their hours from Pacific time; and of those that have more, by these hours.
ONE_ZONE = [
    ("America/New_York", 3, "CT DE GA MA MD ME NC NH NJ NY OH PA RI SC VA VT WV DC"), ("America/Chicago", 2, "AL AR IL IA LA MN MO MS OK WI"), ("America/Denver", 1, "CO MT NM UT WY"),
    ("America/Los_Angeles", 0, "CA WA"), ("America/Phoenix", 1, "AZ"), ("America/Puerto_Rico", 3, "PR"),
]
MORE_ZONES = [
    ("America/New_York", 3, "KY TN FL MI"), ("America/Chicago", 2, "KY TN FL MI IN TX KS NE ND SD"), ("America/Indiana/Indianapolis", 3, "IN"), ("America/Denver", 1, "TX KS NE ND SD ID"),
    ("America/Los_Angeles", 0, "OR NV"), ("America/Boise", 1, "OR"),
]


def zone(state: Column, hours: Column) -> Column:
    """The time zone that a state and a listing's hours from Pacific time agree on; null where they don't, for 0 is also what listings write for unknown."""
    known = {f"{s}/{h}": z for z, h, states in ONE_ZONE + MORE_ZONES for s in states.split()}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.concat_ws("/", F.upper(F.trim(state)), hours.cast("int").cast("string")))
