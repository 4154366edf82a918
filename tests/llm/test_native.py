"""Quality rules, surrogates and URL filters."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortcast.llm import pii, quality_rules
from cohortcast.llm.queries import URL_RULES
from cohortcast.llm.url_filter import build_cascade, judge_urls

from .conftest import kept_columns

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(t):
    t = t or ""
    w = WORD.findall(t)
    runs = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    times = Counter(runs)
    covered = {j for i, x in enumerate(runs) if times[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_statistics_and_verdicts(docs, corpus):
    judged = quality_rules.judge(docs)
    assert len(set(judged.columns)) == len(judged.columns)
    got = {r.doc_id: r for r in judged.collect()}
    assert kept_columns(got.values(), docs.columns, {"kept"})
    assert len(got) == len(corpus)
    for d, t, *_ in corpus:
        s = statistics(t)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s
        assert r.base_failed == (s[0] < 50 or 100 * s[4] > 50 * s[0])
        assert not (r.base_failed and r.kept)


def test_outliers_are_rejected(spark):
    rng = np.random.default_rng(1)
    words = np.array([f"w{k}" for k in range(5000)])
    clean = [(k, " ".join(rng.choice(words, rng.integers(60, 300))), "en", "a" if k % 3 else "b") for k in range(300)]
    junk = [(1000 + k, " ".join(x + "###" for x in rng.choice(words, 100)), "en", "a") for k in range(20)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string"), least=50).collect()}
    assert all(got[r[0]] for r in clean) and not any(got[r[0]] for r in junk)


def test_factor_and_distance_equal_numpy(spark):
    rng = np.random.default_rng(2)
    a = rng.standard_normal((4, 4))
    cov, mean, x = a @ a.T + np.eye(4), rng.standard_normal(4), rng.standard_normal(4)
    row = {f"m_{i}": float(mean[i]) for i in range(4)} | {f"c_{i}_{j}": float(cov[i, j]) for i in range(4) for j in range(i + 1)} | {f"x{i}": float(x[i]) for i in range(4)}
    df = spark.createDataFrame([row]).withColumn("f", quality_rules._factored({(i, j): F.col(f"c_{i}_{j}") for i in range(4) for j in range(i + 1)}, 4)).select("*", "f.*")
    got = df.select(quality_rules.distance([f"x{i}" for i in range(4)]).alias("d"), "logdet").first()
    assert got.d == pytest.approx((x - mean) @ np.linalg.inv(cov) @ (x - mean))
    assert got.logdet == pytest.approx(np.linalg.slogdet(cov)[1])


def brute_estimate(x, floors, alpha, factor):
    """The estimate of the three starts, each followed to the end, with numpy."""

    def cut(v):
        return np.sort(v)[max(int(np.ceil(alpha * len(v))) - 1, 0)]

    q = lambda p: np.array([np.sort(c)[max(int(np.ceil(p * len(c))) - 1, 0)] for c in x.T])
    floor, mid = np.diag(np.square(floors)), q(0.5)
    d = (q(0.75) - q(0.25)) / 1.349
    bent = np.cov(np.tanh((x - mid) / np.sqrt(d * d + np.square(floors))).T, bias=True)
    root = np.sqrt(np.diag(bent))
    best = None
    for m, c in ((mid, np.diag(d * d)), (x.mean(0), np.cov(x.T, bias=True)), (mid, bent / np.outer(root, root) * np.outer(d, d))):
        c, was = c + floor, np.inf
        while True:
            far = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            own = x[far <= cut(far)]
            m, c = own.mean(0), np.cov(own.T, bias=True) * factor + floor
            now = np.linalg.slogdet(c)[1]
            if now >= was - 1e-4:
                break
            was = now
        if best is None or now < best[0]:
            best = (now, m, c)
    return best


def test_estimates_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.multivariate_normal([1, 2, 3], [[2, 1, 0], [1, 2, 0.5], [0, 0.5, 1]], 900), rng.multivariate_normal([9, -5, 3], np.eye(3) * 0.2, 150)))
    names, floors = ["x0", "x1", "x2"], [0.1, 0.1, 0.1]
    df = spark.createDataFrame([(g, *map(float, v * (1 + k))) for k, g in enumerate("ab") for v in x], "grp string, x0 double, x1 double, x2 double").cache()
    quality_rules.ready(spark)
    got = {r.grp: r for r in quality_rules.robust_estimates(df, names, floors, "grp", 0.75, lambda rows, table: rows.join(F.broadcast(table), "grp")).collect()}
    factor = 0.75 / quality_rules.chi2_share(quality_rules.chi2_quantile(0.75, 3), 5)
    for k, g in enumerate("ab"):
        logdet, mean, cov = brute_estimate(x * (1 + k), floors, 0.75, factor)
        assert got[g].logdet == pytest.approx(logdet, abs=2e-3)
        assert [got[g][f"m_{i}"] for i in range(3)] == pytest.approx(mean.tolist(), abs=0.02)
        assert [got[g][f"c_{i}_{j}"] for i in range(3) for j in range(i + 1)] == pytest.approx([cov[i, j] for i in range(3) for j in range(i + 1)], abs=0.05)


def test_each_statistic_can_reject_and_few_are_not_judged(spark):
    rng = np.random.default_rng(4)
    words = np.array([f"w{k}" for k in range(5000)])
    clean = [(k, "\n".join(" ".join(rng.choice(words, 10)) for _ in range(rng.integers(8, 30))), "en", "a") for k in range(300)]
    line = " ".join(words[:3])
    lines = [(1000, "\n".join([*(" ".join(rng.choice(words, 12)) for _ in range(12)), *["w1 ww"] * 14]), "en", "a")]
    passage = " ".join(rng.choice(words, 48))
    repeats = [(2000, " ".join([passage, *rng.choice(words, 104), line, passage]), "en", "a")]
    schema = "doc_id long, text string, lang string, source string"
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(clean + lines + repeats, schema)).collect()}
    assert sum(got[r[0]].kept for r in clean) >= 298
    assert [got[k].base_failed or got[k].kept for k in (1000, 2000)] == [False, False]
    few = quality_rules.judge(spark.createDataFrame(clean[:10] + lines, schema)).collect()
    assert all(r.kept and r.distance2 is None for r in few)


def test_chi_square():
    assert quality_rules.chi2_share(7.814728, 3) == pytest.approx(0.95, abs=1e-6)
    assert quality_rules.chi2_quantile(0.99, 5) == pytest.approx(15.08627, abs=1e-4)


PRIVATE = [
    (1, "Mail ann.b+x@mail7.example.com, or ANN.B+X@MAIL7.EXAMPLE.COM!! Call +1 (017) 555-7713%%% now."),
    (2, 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" at 161.17.88.162 | and 4845168114407329 7536784127813050.'),
    (3, "Mr. John Smith met Mrs. Smith, Frau Müller and Господин Иванов; Mr. John Smith left."),
    (4, "ann.b+x@mail7.example.com again; SSN 123-45-6789, DE89 3704 0044 0532 0130 00, 4111-1111-1111-1111."),
    (5, None),
    (6, "nothing here, 12 words of 3.5 and 1.2.3 or 2024-01-02"),
    (7, ""),
]
SECRETS = ["ann.b+x@", "555-7713", "9b0b3c6a", "161.17.88.162", "4845168114407329", "7536784127813050", "Smith", "Müller", "Иванов", "123-45-6789", "3704", "4111-1111"]


@pytest.fixture(scope="module")
def redacted(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in PRIVATE], "doc_id long, text string, e string, _again string")
    return {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}


def test_nothing_private_is_left(redacted):
    for r in redacted.values():
        assert not any(s.lower() in (r.text or "").lower() for s in SECRETS), r.text
    assert redacted[5].text is None and redacted[6].text == PRIVATE[5][1] and redacted[7].text == ""


def test_types_and_formats(redacted):
    assert re.fullmatch(r"Mail \S+@\S+\.invalid, or [A-Z.0-9]+@[A-Z]+\.INVALID!! Call \+1 \(\d{3}\) \d{3}-\d{4}%%% now\.", redacted[1].text)
    assert re.fullmatch(r'token = "[0-9a-f]{40}" at \d+\.\d+\.\d+\.\d+ \| and \d{16} \d{16}\.', redacted[2].text)
    assert re.fullmatch(r".* SSN \d{3}-\d{2}-\d{4}, DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d, \d{4}-\d{4}-\d{4}-\d{4}\.", redacted[4].text)
    names = re.fullmatch(r"Mr\. (\w+on) (\w+) met Mrs\. (\w+), Frau (\w+) and Господин ([а-яА-Я]+); Mr\. (\w+) (\w+) left\.", redacted[3].text)
    assert names and names[1] == names[6] and names[2] == names[3] == names[7] != names[4]


def test_equal_entities_stay_equal(redacted):
    a, b = re.findall(r"\S+@\S+invalid", redacted[1].text, re.I)
    assert a.lower() == b.lower() == redacted[4].text.split(" ")[0]
    assert (redacted[1].n_email, redacted[2].n_card, redacted[3].n_name) == (2, 2, 5)


def test_colliding_surrogates_are_told_apart(spark, monkeypatch):
    """With two syllables, first surrogates collide; in the end none does."""
    monkeypatch.setattr(pii, "SYLLABLES", {k: v[:2] for k, v in pii.SYLLABLES.items()})
    names = ["Abel", "Baker", "Carl", "Dora", "Emil", "Fritz"]
    df = spark.createDataFrame([(k, f"Mr. {n} and Mr. {names[0]}") for k, n in enumerate(names)], "doc_id long, text string")
    assert pii.overrides(df, "k").count() > 0
    got = [re.findall(r"Mr\. (\w+)", r.text) for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]
    assert len({g[0] for g in got}) == len(names) and {g[1] for g in got} == {got[0][0]}


def test_other_columns_stay(docs):
    got = pii.pseudonymise(docs, "k")
    assert got.columns[: len(docs.columns)] == docs.columns and kept_columns(got.collect(), docs.columns)


def test_names_stay_one_person(spark):
    rows = [
        (1, "Mr. John Smith came. Smith said that John Smith's dog, O'Brien and Mr. Smith saw John. Smithson left."),
        (2, "John Smith isn't titled here, Smith neither."),
        (3, "Mrs. Anna O'Brien and Dr. John Smith. JOHN is someone else."),
    ]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    m = re.fullmatch(r"Mr\. (\w+on) (\w+) came\. (\w+) said that (\w+) (\w+)'s dog, O'Brien and Mr\. (\w+) saw (\w+)\. Smithson left\.", got[1])
    assert m and m[1] == m[4] == m[7] and m[2] == m[3] == m[5] == m[6]
    assert got[2] == rows[1][1]
    n = re.fullmatch(r"Mrs\. (\w+ia) (\w+) and Dr\. (\w+e) (\w+)\. JOHN is someone else\.", got[3])
    assert n and n[4] == m[2]


def test_numbers_keep_their_kind(spark):
    rows = [(1, "cards 4111 1111 1111 1111 and 8329 4111 1111 1111 1111"), (2, "DE89 3704 0044 0532 0130 00 and DE88 3704 0044 0532 0130 00"), (3, "at fe80::1ff:FE23:4567:890a or 2001:db8:0:0:0:ff00:42:8329, 12:30:45 o'clock, std::vector"), (4, "no card: 1234 5678 9012 3456")]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}

    def luhn(digits):
        return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10

    def rest(iban):
        x = iban.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97

    a = re.fullmatch(r"cards (\d{4} \d{4} \d{4} \d{4}) and (\d{4}(?: \d{4}){4})", got[1])
    assert a and luhn(a[1].replace(" ", "")) == 0 and "1111" not in got[1]
    b = re.fullmatch(r"(DE\d\d(?: \d{4}){4} \d\d) and (DE\d\d(?: \d{4}){4} \d\d)", got[2])
    assert b and rest(b[1]) == 1 and "3704" not in got[2]
    c = re.fullmatch(r"at ([0-9a-f]{4}::[0-9a-f]{3}:[0-9A-Fa-f]{4}:\w{4}:\w{4}) or ([0-9a-f:]+), 12:30:45 o'clock, std::vector", got[3])
    assert c and [len(x) for x in c[2].split(":")] == [4, 3, 1, 1, 1, 4, 2, 4] and c[1] != "fe80::1ff:FE23:4567:890a"
    assert re.fullmatch(r"no card: \d{4} \d{4} \d{4} \d{4}", got[4])
    assert spark.range(1).select(pii.luhn(F.lit("4111111111111111")), pii.modulo_97(F.lit("DE89370400440532013000"))).first()[:] == (0, 1)


def test_more_names_than_short_surrogates(spark):
    """10,000 one-word names: more than there are of three syllables. All stay distinct, and it ends."""
    letters = "abcdefghij"
    names = ["Q" + "".join(letters[int(c)] for c in f"{k:04d}") for k in range(10_000)]
    df = spark.createDataFrame([(k, f"Mr. {n}") for k, n in enumerate(names)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, "k").collect()}
    assert len(set(got.values())) == 10_000 and not set(got.values()) & {f"Mr. {n}" for n in names}


def test_long_texts_are_linear(spark):
    df = spark.createDataFrame([(1, "a" * 500_000 + "@"), (2, "1." * 200_000), (3, "x@y." * 50_000)], "doc_id long, text string")
    assert pii.pseudonymise(df, "k").count() == 3


def test_empty(empty):
    assert quality_rules.judge(empty).count() == 0
    assert pii.pseudonymise(empty, "k").count() == 0


URLS = [None, "", "no scheme", "http://", "http://x.com", "HTTP://WWW.Example.COM/en/1?q=/", "https://example.com/en/2", "https://m.example.com/de/2", "http://a.net/es/1", "http://net/fr/#x", "http://www.cheap-pills.example.net/en/1", "http://spam-farm.example.org?a", "http://notspam-farm.example.org/", "a://b://c/d", "http://h.org/\n/x"]


@pytest.mark.parametrize("max_bits", [1 << 23, 8])
def test_urls(spark, max_bits):
    rows = [(k, u, "x", "y") for k, u in enumerate(URLS)]
    got = {r.page_id: r for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string, key string, host string"), URL_RULES, max_bits=max_bits).collect()}
    for k, u in enumerate(URLS):
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.split(r"[/?#]", rest)[0]
            path = re.split(r"[?#]", rest[len(host) :])[0]
            host = host.lower()
        fits = [(len(rule), v, rule) for v, rule in URL_RULES if (host == (h := rule.split("/", 1)[0]) or host.endswith("." + h)) and path.startswith("/" + rule.split("/", 1)[1])]
        verdict = max(fits)[1] if fits else "block" if any(host == d or host.endswith("." + d) for d in ("cheap-pills.example.net", "spam-farm.example.org")) else "allow"
        assert (got[k].host, got[k].path, got[k].rule, got[k].verdict) == (host, path, max(fits)[2] if fits else None, verdict), u


def test_cascade_is_exact_over_its_universe(spark):
    universe = spark.range(5000).select(F.concat(F.lit("h"), "id").alias("key"))
    listed = universe.where("crc32(key) % 10 = 0").unionByName(spark.createDataFrame([("elsewhere",)], "key string"))
    cascade = build_cascade(listed, universe)
    assert len(cascade.levels) > 1
    wrong = universe.where(cascade.has(F.col("key")) != F.expr("crc32(key) % 10 = 0")).count()
    assert wrong == 0
    assert build_cascade(listed.limit(0), universe).levels == []
