"""Keyed, type-consistent surrogates for personal data.

Entities are found by one linear regular expression: e-mail, IPv4 and IPv6 addresses, phone, card, account and
identity numbers, quoted secrets, and names after a title (`TITLES`); in a text with such names, their words are
entities also where they stand without one (so a name that no title introduces in its own text isn't found).
Names are replaced word by word: the last of two is a surname, the first a given name.

An entity's canonical form (letters lower-cased, digits alone) and a secret key give its surrogate, so equal
entities have equal surrogates in all texts, and "Mr. John Smith", "John Smith" and "Smith" stay one person.
Surrogates keep the type, the format (each digit for a digit, separators in place, capitals), valid check digits
of cards (Luhn) and accounts (modulo 97), and for names the script; given names have the gender of the
title with which the text has them.

Distinctness is checked over the whole corpus: the distinct canonical entities (pre-aggregated in each
task) are grouped by surrogate; of entities that share one, or whose surrogate is a real entity, all but
the first are given the next attempt (of names and addresses a longer one), until none is left or `rounds` are
over: only where a format has hardly more values than the corpus has entities can some still share one then.
Only those few overrides are joined back, to the rows that have them; every other row is rewritten in place,
without a shuffle of texts.

Null texts stay null, texts without entities stay as they are. Equal rows get equal results. Empty
tables give empty results. Other columns stay as they are, whatever their names. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .exprs import let, packed, row_key, unpacked
from .graphs import ready

TITLES = {"m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία"], "n": ["Dr", "Prof"]}
#: Syllables that surrogate names are made of, by script; names of a gender end alike.
SYLLABLES = {
    "latin": ["ba", "del", "fi", "gor", "ha", "jen", "ka", "lo", "mar", "ni", "or", "pel", "ri", "san", "ta", "vel"],
    "cyrillic": ["ба", "дел", "фи", "гор", "ва", "жен", "ка", "ло", "мар", "ни", "ор", "пел", "ри", "сан", "та", "вел"],
    "greek": ["βα", "δελ", "φι", "γορ", "θα", "ζεν", "κα", "λο", "μαρ", "νι", "ορ", "πελ", "ρι", "σαν", "τα", "λεν"],
}
ENDINGS = {"latin": {"m": "on", "f": "ia", "n": "e"}, "cyrillic": {"m": "он", "f": "ия", "n": "е"}, "greek": {"m": "ος", "f": "ία", "n": "ε"}}

_WORD = r"[\p{L}\p{N}._%+\-]"
_ALONE = r"(?<![\p{L}\p{N}\-])"
_TITLE = "|".join(t for titles in TITLES.values() for t in titles)
_NAME = r"(?:\p{Lu}[\p{L}\-]++(?:'\p{L}{2,}+)?+|\p{Lu}'\p{L}{2,}+)"
_HEX = "[0-9A-Fa-f]{1,4}"
#: Patterns of the types. Runs are possessive and start where no run is open, so that long texts cost linear time.
KINDS = {
    "email": rf"(?<!{_WORD}){_WORD}++@[\p{{L}}\p{{N}}\-]++(?:\.[\p{{L}}\p{{N}}\-]++)+",
    "secret": r"(?<=\")[0-9A-Fa-f]{32,64}(?=\")",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,5}})?::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![\p{{L}}\p{{N}}:])",
    "phone": rf"(?<![\p{{L}}\p{{N}}])\+1[ \-.]?\(?\d{{3}}\)?[ \-.]?\d{{3}}[ \-.]?\d{{4}}(?!\d)|(?<![\p{{L}}\p{{N}}])\+\d{{1,3}}[ \-.]?\(?\d{{1,4}}\)?(?:[ \-.]?\d{{2,4}}){{2,4}}(?!\d)|(?<![\p{{L}}\p{{N}}])\(\d{{3}}\) ?\d{{3}}[\-. ]\d{{4}}(?!\d)|{_ALONE}\d{{3}}[\-.]\d{{3}}[\-.]\d{{4}}(?![\d\-])",
    "ssn": rf"{_ALONE}\d{{3}}-\d{{2}}-\d{{4}}(?![\d\-])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": rf"{_ALONE}(?:\d{{13,19}}(?!\d)|\d{{4}}(?:[ \-]\d{{4}}){{3,}}+(?!\d)|\d{{4}}[ \-]\d{{6}}[ \-]\d{{5}}(?!\d))",
    "name": rf"(?<=(?<!\p{{L}})(?:{_TITLE})\.? ){_NAME}(?: {_NAME})?",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: A text without any of these has no entity; most texts stop here.
HINT = rf"[@\d]|::|(?:{_TITLE})\.? \p{{Lu}}"


#: A name word that stands alone in a text which has it in a name after a title; %s: those words.
BARE = r"(?<![\p{L}'\-])(?:%s)(?: (?:%s))?+(?![\p{L}\-])"


def kind_of(e: Column) -> Column:
    """The type of a found entity, by its shape."""
    return let(
        e,
        lambda x: F.when(F.contains(x, F.lit("@")), "email")
        .when(F.contains(x, F.lit(":")), "ip6")
        .when(x.rlike(r"^[0-9A-Fa-f]{32,64}$"), "secret")
        .when(x.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip")
        .when(x.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(x.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .when(x.rlike(r"^[+(]|^\d{3}[\-.]\d{3}[\-.]\d{4}$"), "phone")
        .when(x.rlike(r"^\d"), "card")
        .otherwise("name"),
    )


def canonical(u: Column) -> Column:
    """What equal units (e, form, gender) share: the form (of given names, the gender too), and letters lower-cased, or of numbers the digits."""
    e, form = u["e"], u["form"]
    bare = F.when(form.isin("phone", "card", "ssn"), F.regexp_replace(e, r"\D", "")).when(form == "iban", F.regexp_replace(e, " ", "")).otherwise(F.lower(e))
    return F.concat(form, F.when(form == "given", u["gender"]).otherwise(""), F.lit(":"), bare)


def _draw(stream: Column, place: Column, below: int) -> Column:
    """A keyed number below `below` for a place."""
    return (F.conv(F.substring(F.sha2(F.concat(stream, F.lit("/"), place.cast("string")), 256), 1, 8), 16, 10).cast("long") % below).cast("int")


def _syllables(stream: Column, first: int, n: Column, script: str) -> Column:
    known = F.split(F.lit(",".join(SYLLABLES[script])), ",")  # folded into one constant
    return F.array_join(F.transform(F.sequence(F.lit(first), F.lit(first - 1) + n), lambda i: F.get(known, _draw(stream, i, len(SYLLABLES[script])))), "")


def _spelled(e: Column, stream: Column, kept: Column, hex: bool = False) -> Column:
    """e with each digit and capital after the first `kept` characters drawn anew, by its number among them. hex: hexadecimal digits instead."""
    one = "[0-9A-Fa-f]" if hex else "[0-9]"
    place = lambda i: F.length(F.regexp_replace(e.substr(F.lit(1), i + 1), r"[^0-9A-Fa-f]" if hex else r"[^0-9A-Z]", ""))

    def drawn(c, i):
        if hex:
            digit = F.lit("0123456789abcdef").substr(_draw(stream, place(i), 16) + 1, F.lit(1))
            return F.when(c.rlike(one), F.when(c.rlike("[A-F]"), F.upper(digit)).otherwise(digit)).otherwise(c)
        return F.when((i >= kept) & c.rlike(one), _draw(stream, place(i), 10).cast("string")).when((i >= kept) & c.rlike("[A-Z]"), F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ").substr(_draw(stream, place(i), 26) + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(e, ""), drawn), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10; 0 where the last is its check digit."""
    twice = lambda d: 2 * d - F.when(d > 4, 9).otherwise(0)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int"), lambda d: F.when(i % 2 == 1, twice(d)).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, d: a + d) % 10


def modulo_97(account: Column) -> Column:
    """An account number (no spaces) modulo 97, its first four characters last and letters as two digits; 1 where the check digits fit."""
    turned = F.concat(account.substr(F.lit(5), F.length(account)), account.substr(F.lit(1), F.lit(4)))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: let(value(c), lambda v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97))


def surrogate(u: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a unit (e, form, gender)."""

    def spell(v):
        e, form, stream, attempt = v["e"], v["form"], v["stream"], v["attempt"]
        shout = (F.upper(e) == e) & (F.length(e) > 1)
        as_written = lambda s: let(s, lambda x: F.when(shout, F.upper(x)).otherwise(x))
        mail = F.concat(_syllables(stream, 0, attempt + 4, "latin"), F.lit("."), F.lpad(_draw(stream, F.lit(-1), 1000).cast("string"), 3, "0"), F.lit("@"), _syllables(stream, 1000, F.lit(2), "latin"), F.lit(".invalid"))
        secret = F.substring(F.sha2(F.concat(stream, F.lit("+")), 256), 1, 64).substr(F.lit(1), F.length(e))
        octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_draw(stream, i, 254) + 1).cast("string")), ".")

        def person(script: str):
            end = F.when(v["gender"] == "m", ENDINGS[script]["m"]).when(v["gender"] == "f", ENDINGS[script]["f"]).otherwise(ENDINGS[script]["n"])
            return F.concat(F.initcap(_syllables(stream, 0, attempt + 3, script)), F.when(form == "given", end).otherwise(""))

        names = F.when(e.rlike(r"\p{IsCyrillic}"), person("cyrillic")).when(e.rlike(r"\p{IsGreek}"), person("greek")).otherwise(person("latin"))
        digits = lambda x: F.regexp_replace(x, r"\D", "")
        start = lambda x: x.substr(F.lit(1), F.length(x) - 1)

        def card(x):
            zero = F.concat(start(x), F.lit("0"))
            return F.when(luhn(digits(e)) == 0, F.concat(start(x), ((10 - luhn(digits(zero))) % 10).cast("string"))).otherwise(x)

        def account(x):
            zero = F.concat(x.substr(F.lit(1), F.lit(2)), F.lit("00"), x.substr(F.lit(5), F.length(x)))
            fits = modulo_97(F.regexp_replace(e, " ", "")) == 1
            return F.when(fits, F.concat(x.substr(F.lit(1), F.lit(2)), F.lpad((98 - modulo_97(F.regexp_replace(zero, " ", ""))).cast("string"), 2, "0"), x.substr(F.lit(5), F.length(x)))).otherwise(x)

        return (
            F.when(form == "email", as_written(mail))
            .when(form == "secret", as_written(secret))
            .when(form == "ip", octets)
            .when(form == "ip6", _spelled(e, stream, F.lit(0), hex=True))
            .when(form.isin("given", "surname"), as_written(names))
            .when(form == "phone", _spelled(e, stream, F.length(F.regexp_extract(e, r"^\+\d{1,3}(?=[ \-.(])", 0))))  # the country stays
            .when(form == "iban", let(_spelled(e, stream, F.lit(2)), account))
            .when(form == "card", let(_spelled(e, stream, F.lit(0)), card))
            .otherwise(_spelled(e, stream, F.lit(0)))
        )

    stream = F.sha2(F.concat_ws("/", F.lit(key), attempt.cast("string"), u["canon"]), 256)
    return let(F.struct(u["e"].alias("e"), u["form"].alias("form"), u["gender"].alias("gender"), attempt.alias("attempt"), stream.alias("stream")), spell)


def _found(text: Column) -> Column:
    """A struct of gaps (what stands before, between and after entities) and entities (kind and units: e, form, gender, canon)."""

    def parts(pattern):
        return F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.concat(F.lit("("), pattern, F.lit(")")), 1).alias("es"))

    def titled(v):
        """Entities with the gender of the title before them, if any."""
        title = lambda i: F.regexp_extract(F.get(v["gaps"], i), r"(\p{L}+)\.? $", 1)
        gender = lambda t: F.when(t.isin(*TITLES["m"]), "m").when(t.isin(*TITLES["f"]), "f").otherwise("n")
        return F.transform(v["es"], lambda e, i: F.struct(e.alias("e"), kind_of(e).alias("kind"), let(title(i), gender).alias("gender")))

    def units(v):
        """v: gaps, entities, and the text's names after titles, as arrays of words with a gender."""
        pairs = F.filter(v["names"], lambda n: F.size(n["words"]) == 2)
        firsts = F.transform(pairs, lambda n: F.struct(F.get(n["words"], F.lit(0)).alias("word"), n["gender"].alias("gender")))
        lasts = F.transform(pairs, lambda n: F.get(n["words"], F.lit(1)))

        def made(w):
            def of(x):
                own = lambda word: F.filter(w["firsts"], lambda f: f["word"] == word)
                known = lambda word: let(F.transform(own(word), lambda f: f["gender"]), lambda g: F.when(F.array_contains(g, "m"), "m").when(F.array_contains(g, "f"), "f").otherwise("n"))
                given = lambda word, i, n: (i < n - 1) | ((n == 1) & F.exists(w["firsts"], lambda f: f["word"] == word) & ~F.array_contains(w["lasts"], word))
                words = let(F.split(x["e"], " "), lambda ws: F.transform(ws, lambda word, i: F.struct(word.alias("e"), F.when(given(word, i, F.size(ws)), "given").otherwise("surname").alias("form"), F.when(given(word, i, F.size(ws)), known(word)).otherwise("").alias("gender"))))
                plain = F.array(F.struct(x["e"].alias("e"), x["kind"].alias("form"), F.lit("").alias("gender")))
                own_units = F.when(x["kind"] == "name", words).otherwise(plain)
                return F.struct(x["kind"].alias("kind"), F.transform(own_units, lambda u: F.struct(u["e"].alias("e"), u["form"].alias("form"), u["gender"].alias("gender"), canonical(u).alias("canon"))).alias("units"))

            return F.transform(v["entities"], of)

        return F.struct(v["gaps"].alias("gaps"), let(F.struct(firsts.alias("firsts"), lasts.alias("lasts")), made).alias("entities"))

    def again(v):
        """Once more with the words of the names that were found, where there are any."""
        names = F.transform(F.filter(v["entities"], lambda x: x["kind"] == "name"), lambda x: F.struct(F.split(x["e"], " ").alias("words"), x["gender"].alias("gender")))

        def bare(ns):
            listed = F.array_join(F.array_distinct(F.flatten(F.transform(ns, lambda n: n["words"]))), "|")
            pattern = F.concat(F.lit(ANY + "|"), F.replace(F.lit(BARE), F.lit("%s"), listed))
            more = let(parts(pattern), lambda p: F.struct(p["gaps"].alias("gaps"), titled(p).alias("entities"), ns.alias("names")))
            return F.when(F.size(ns) > 0, more).otherwise(F.struct(v["gaps"].alias("gaps"), v["entities"].alias("entities"), ns.alias("names")))

        return let(names, bare)

    first = let(parts(F.lit(ANY)), lambda p: F.struct(p["gaps"].alias("gaps"), titled(p).alias("entities")))
    return let(let(first, again), units)


def _units(text: Column) -> Column:
    return F.explode(F.flatten(F.transform(_found(text)["entities"], lambda x: x["units"])))


def overrides(texts: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """(canon, attempt): units of the column `text` whose first surrogate isn't theirs alone."""
    ready(texts.sparkSession)
    seen = texts.where(F.col("text").rlike(HINT)).select(_units(F.col("text")).alias("u")).groupBy("u.canon").agg(F.min("u").alias("u")).checkpoint()
    lowered = F.lower(F.col("u.e"))
    real = seen.select(F.when(F.col("u.form").isin("given", "surname"), lowered).otherwise(F.col("canon")).alias("s"), F.lit(True).alias("real")).distinct()
    now = seen.select("canon", "u", F.lit(0).alias("attempt"))
    for k in range(rounds):
        new = let(surrogate(F.col("u"), F.col("attempt"), key), lambda s: F.when(F.col("u.form").isin("given", "surname"), F.lower(s)).otherwise(canonical(F.struct(s.alias("e"), F.col("u.form").alias("form"), F.col("u.gender").alias("gender")))))
        nth = F.row_number().over(Window.partitionBy("s").orderBy("attempt", "canon"))
        checked = now.withColumn("s", new).join(real, "s", "left").withColumn("lost", F.coalesce("real", F.lit(False)) | (nth > 1)).select("canon", "u", "attempt", "lost").checkpoint()
        if checked.where("lost").isEmpty():
            break
        if k < rounds - 1:
            now = checked.select("canon", "u", (F.col("attempt") + F.col("lost").cast("int")).alias("attempt"))
    return checked.where("attempt > 0").select("canon", "attempt")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", broadcast_rows: int = 100_000) -> DataFrame:
    """docs with surrogates in text_col, and the number of entities of each type in columns n_email, n_secret, ...
    (such columns of docs are replaced). key: the secret that surrogates depend on."""
    made = [f"n_{k}" for k in KINDS]
    others = [c for c in docs.columns if c not in made]
    text = F.col("text")
    texts = docs.select(packed(others).alias("docs"), F.col(text_col).alias("text"), row_key(text_col).alias("row"))
    redone = overrides(texts.select("text"), key)
    if redone.isEmpty():
        texts = texts.withColumn("again", F.lit(None).cast("map<string,int>"))
    else:
        rows = texts.where(text.rlike(HINT)).select("row", _units(text).alias("u")).select("row", "u.canon")
        rows = rows.join(redone, "canon").groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("canon", "attempt"))).alias("again")).checkpoint()
        few = rows.limit(broadcast_rows + 1).count() <= broadcast_rows
        texts = texts.join(F.broadcast(rows) if few else rows, "row", "left")
    attempt = lambda u: F.coalesce(F.try_element_at("again", u["canon"]), F.lit(0))

    def rewrite(v):
        new = F.transform(v["entities"], lambda x: F.array_join(F.transform(x["units"], lambda u: surrogate(u, attempt(u), key)), " "))
        kinds = F.transform(v["entities"], lambda x: x["kind"])
        text = let(new, lambda n: F.array_join(F.transform(v["gaps"], lambda g, i: F.concat(g, F.coalesce(F.get(n, i), F.lit("")))), ""))
        return F.struct(text.alias("text"), kinds.alias("kinds"))

    done = F.when(text.rlike(HINT), let(_found(text), rewrite)).otherwise(F.struct(text.alias("text"), F.expr("cast(array() AS array<string>)").alias("kinds")))
    out = texts.withColumn("done", done)
    kinds = F.coalesce("done.kinds", F.expr("cast(array() AS array<string>)"))
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return out.select(*[F.col("done.text").alias(c) if c == text_col else x for c, x in zip(others, unpacked("docs", others))], *counts)
