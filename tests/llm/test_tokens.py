"""BPE and token counts against the tokenizers library."""

import random
import subprocess
import sys

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cohortcast.llm import text
from cohortcast.llm.bpe import decode, encode
from cohortcast.llm.ngram_jaccard import describe
from cohortcast.llm.token_counts import count_tokens

from .conftest import kept_columns

ODD = ["<|endoftext|>a<|startoftext|>'s", "'s 's''s 'll're x's DON'T", "  \n", "!" * 3000 + "a" * 2000, "ΣΣς İ ﬁ é 가", "\x1c\x85　x", "🙂👩‍🚀 ½² 12345"]


@pytest.fixture(scope="module")
def texts(spark, corpus):
    rnd = random.Random(3)
    alphabet = list("abAB'’sStdLl 19½²²é́中文!?.\n\t\x1c\xa0🙂<|>Σ")
    made = [t for _, t, *_ in corpus] + ODD + ["".join(rnd.choices(alphabet, k=rnd.randint(0, 50))) for _ in range(400)]
    return made, spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))


def library(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_and_text(texts):
    made, df = texts
    path = public_tokenizers.path("word_bpe_49k.json")
    t = library("word_bpe_49k.json")
    got = {r.doc_id: r for r in decode(encode(df, path, decoded_col="one_pass"), path).collect()}
    for k, e in enumerate(t.encode_batch([x or "" for x in made], add_special_tokens=False)):
        assert got[k].ids == e.ids, made[k]
        assert got[k].decoded == got[k].one_pass == t.decode(e.ids, skip_special_tokens=False)


@pytest.mark.parametrize("table_size", [1, 1 << 12])
def test_counts(texts, table_size):
    made, df = texts
    t = library("byte_bpe_50k.json")
    got = {r.doc_id: r.n_tokens for r in count_tokens(df, public_tokenizers.path("byte_bpe_50k.json"), table_size=table_size, per_task=64).collect()}
    assert got == {k: len(e.ids) for k, e in enumerate(t.encode_batch([x or "" for x in made], add_special_tokens=False))}


def test_clashing_columns_are_replaced_and_others_stay(docs, corpus):
    path, own = public_tokenizers.path("word_bpe_49k.json"), docs.columns
    got = encode(docs, path).collect()
    assert kept_columns(got, own, {"ids"}) and all(isinstance(r.ids, list) for r in got)
    counted = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()
    assert kept_columns(counted, own, {"n_tokens"}) and all(isinstance(r.n_tokens, int) for r in counted)
    decoded = decode(encode(docs, path), path, out_col="row").collect()
    assert kept_columns(decoded, own, {"ids", "row"}) and len(decoded) == len(corpus)


def test_empty(empty):
    assert encode(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert count_tokens(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_unknown_ids_decode_to_nothing(spark):
    df = spark.createDataFrame([([320, -1, 10**8],), ([],), (None,)], "ids array<int>")
    got = [r.decoded for r in decode(df, public_tokenizers.path("word_bpe_49k.json")).collect()]
    assert got[0].startswith("a</w>") and got[1:] == ["", ""]


WORKER = """
import re
import numpy as np
from cohortcast.llm import text

def anon():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def run(rows):
    for _ in rows:
        held = [np.ones(6000) for _ in range(6000)]  # 288 MB in pieces that malloc keeps when they are freed
        pins.append(held[-1])
        del held
        yield 1

pins, was = [], anon()
assert list(getattr(text, "freeing", lambda f: f)(run)(range(2))) == [1, 1]
print(anon() - was)
"""


def test_workers_give_freed_memory_back():
    told = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, timeout=60)
    assert float(told.stdout) < 100, told.stderr


def test_stages_in_workers_free_memory(spark, docs, monkeypatch):
    taken = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: taken.append(run))
    encode(docs, public_tokenizers.path("word_bpe_49k.json"))
    decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    describe(docs.select("doc_id", F.lit(1).alias("row"), "text"), 5, 80, None)
    assert [f.__qualname__.split(".")[0] for f in taken] == [text.freeing.__name__] * 3
