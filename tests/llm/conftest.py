import random

import pytest

BLANK = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="session")
def corpus():
    """Rows (doc_id, text, lang, source, n_chars): nulls, blanks, copies, near copies, shared passages, ties, junk and long texts."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choices("abcdeéöñ", k=rnd.randint(2, 6))) for _ in range(60)] + ["ünï", "word", "naïve"]
    passage = " ".join(rnd.choices(vocab, k=45))
    texts = [None, "", "   ", "\n\t", "one", "one two", "One TWO three", "a b c d", "x " * 3000, "word"]
    base = [rnd.choice(vocab) for _ in range(120)]
    for k in range(12):  # near copies: one word changed in some, none in others
        words = list(base)
        if k % 3:
            words[rnd.randrange(120)] = f"new{k}"
        texts.append(" ".join(words))
    texts += ["same text here " + passage] * 5
    for _ in range(40):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(1, 150))]
        if rnd.random() < 0.3:
            words[rnd.randint(0, len(words)) :] = passage.split()
        texts.append(rnd.choice(["", " "]) + "".join(w + rnd.choice([" ", "  ", "\n", "\t", " \x0c"]) for w in words))
    texts.append(" ".join(rnd.choice(vocab) for _ in range(6000)))
    texts.append(passage + "\n" + passage + "\n" + passage.upper())
    rows = [(k, t, rnd.choice(["en", "de", None]), rnd.choice(["s", "t", None]), None) for k, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with columns whose names the operators use inside."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, node string, bucket string, key string, n string, _row string, `at` string, w string, kept string, score string, n_lines string, m_0 string, x_words string, own string, docs string, _docs string, _done string, _again string, again string, ids string, n_tokens string, row string, hub string"
    return spark.createDataFrame([(*r, *["clash"] * 23) for r in corpus], schema)


def kept_columns(got, names, replaced=()):
    """Whether all rows still have the clashing columns, with their values."""
    mine = [c for c in names[5:] if c not in replaced]
    return all(r[c] == "clash" for r in got for c in mine)


@pytest.fixture(scope="session")
def empty(spark, docs):
    return spark.createDataFrame([], docs.schema)
