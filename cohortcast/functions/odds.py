"""Prices. Two units occur: decimal (the stake included) and to-one (the stake excluded); names say which."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[0-9]+(?:\.[0-9]+)?$"


def american_to_decimal(a: Column) -> Column:
    """+450 is 5.5, -200 is 1.5; between -100 and 100 there is no price."""
    return F.when(a >= 100, 1 + a / 100).when(a <= -100, 1 - 100 / a)


def decimal_to_american(d: Column) -> Column:
    return F.when(d >= 2, F.round((d - 1) * 100)).when(d > 1, F.round(-100 / (d - 1)))


def to_one(text: Column) -> Column:
    """9/2, 9-2, even, or a plain number, as to-one odds; else null."""
    t = F.lower(F.trim(text))
    parts = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?) ?[/-] ?([0-9]+(?:\.[0-9]+)?)$", 1), F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?) ?[/-] ?([0-9]+(?:\.[0-9]+)?)$", 2)
    num, den = (p.try_cast("double") for p in parts)
    return F.when(t.isin("even", "evens", "evs"), 1.0).when(den > 0, num / den).when(t.rlike(_NUMBER), t.try_cast("double"))


def text_to_decimal(text: Column) -> Column:
    """Decimal price of a text in any dialect: American with a sign, fractional, or decimal."""
    t = F.lower(F.trim(text))
    signed = F.when(t.rlike(r"^[+-][0-9]+$"), t.try_cast("double"))
    plain = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    return F.coalesce(american_to_decimal(signed), F.when(plain > 1, plain), F.when(plain.isNull(), 1 + to_one(t)))


def implied(decimal: Column) -> Column:
    return F.when(decimal > 1, 1 / decimal)


def implied_from_to_one(odds: Column) -> Column:
    return F.when(odds >= 0, 1 / (odds + 1))


def fair_to_one(p: Column) -> Column:
    return F.when(p > 0, F.round(1 / p - 1, 2))


def edge(p: Column, m: Column) -> Column:
    return F.round(p - m, 4)


def expected_value(p: Column, decimal: Column) -> Column:
    """Of a unit stake, in units won."""
    return p * decimal - 1


def kelly(p: Column, decimal: Column, cap: float | None = None) -> Column:
    """The growth-optimal share of the bankroll, at least 0, at most cap."""
    full = F.greatest((p * decimal - 1) / (decimal - 1), F.lit(0.0))
    return F.least(full, F.lit(cap)) if cap is not None else full


def round_stake(stake: Column, step: Column) -> Column:
    """Down to a multiple of the least unit; below one unit there is no bet (0)."""
    return F.floor(stake / step + 1e-9) * step


def price_drift(opening: Column, now: Column, tolerance: float = 0.05) -> Column:
    """shortening, drifting or steady, by the relative change of the decimal price."""
    change = now / opening - 1
    return F.when(opening.isNull() | now.isNull(), None).when(change <= -tolerance, "shortening").when(change >= tolerance, "drifting").otherwise("steady")


def devig_power(ps: Column, rounds: int = 60) -> Column:
    """Array of implied prices raised to the power at which they sum to one (found by bisection); null unless all lie between 0 and 1."""
    total = lambda k: F.aggregate(ps, F.lit(0.0), lambda a, x: a + F.pow(x, k))
    ends = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)),
        F.struct(F.lit(0.05).alias("lo"), F.lit(20.0).alias("hi")),
        lambda s, _: F.when(total((s["lo"] + s["hi"]) / 2) > 1, F.struct(((s["lo"] + s["hi"]) / 2).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), ((s["lo"] + s["hi"]) / 2).alias("hi"))),
    )
    scaled = F.get(F.transform(F.array(ends), lambda e: F.transform(ps, lambda x: F.pow(x, (e["lo"] + e["hi"]) / 2))), F.lit(0))
    return F.when(F.forall(ps, lambda x: (x > 0) & (x < 1)), scaled)
