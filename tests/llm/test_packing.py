"""Packing against the tokenizers library: every id in one piece, pieces as binary digits, nothing padded."""

import numpy as np
import public_tokenizers
import pytest

from cohortcast.llm import packing

from .conftest import kept_columns
from .test_tokens import ODD, library

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(texts):
    return [[*e.ids, 1] for e in library("byte_bpe_50k.json").encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("longest", [2048, 64, 1])
def test_pieces_are_the_library_ids(spark, corpus, longest):
    texts = [t for _, t, *_ in corpus] + ODD
    df = spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "doc_id long, text string, sequence_id string").repartition(3)
    got = packing.pack(df, PATH, longest=longest).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.start)):
        by.setdefault(r.doc_id, []).append(r)
    assert len({r.sequence_id for r in got}) == len(got) and all(r.offset == 0 for r in got)
    assert len({(r.sequence_id >> 56, r.length) for r in got}) == len({r.length for r in got})
    for k, want in enumerate(ids_of(texts)):
        pieces = by[k]
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert [i for r in pieces for i in np.frombuffer(r.ids, "<u4").tolist()] == want
        assert all(r.doc_tokens == len(want) and r.length & (r.length - 1) == 0 and r.length <= longest for r in pieces)
        assert len(pieces) == len(want) // longest + (len(want) % longest).bit_count()


def test_columns_empty_tables_and_repeated_rows(docs, empty, corpus):
    got = packing.pack(docs.unionAll(docs), PATH).collect()
    assert kept_columns(got, docs.columns, {"ids"}) and "text" not in got[0].asDict()
    assert len({r.sequence_id for r in got}) == len(got) == 2 * packing.pack(docs, PATH).count()
    assert packing.pack(empty, PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs, PATH, longest=1000)


def test_long_texts_in_parts_and_forgotten_words(monkeypatch, corpus):
    """Parts are cut where no pre-token crosses; the cache is emptied; words that share a hash are told apart."""
    texts = [t for _, t, *_ in corpus if t] + ODD
    with open(PATH, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    for part, cache in ((40, 10**6), (7, 50), (1, 10**6)):
        monkeypatch.setattr(packing, "PART", part)
        monkeypatch.setattr(packing, "CACHE", cache)
        ids, count = encoder.encode(texts)
        assert packing.ended(ids, count, 1).tolist() == [i for x in ids_of(texts) for i in x]
    encoder.forget()
    monkeypatch.setattr(packing.PreTokens, "__init__", _one_hash(packing.PreTokens.__init__))
    ids, count = encoder.encode(["some words here and there", "words"])
    assert packing.ended(ids, count, 1).tolist() == [i for x in ids_of(["some words here and there", "words"]) for i in x]


def _one_hash(init):
    def made(self, *args, **named):
        init(self, *args, **named)
        self.hash[:] = 7

    return made


def test_buckets_as_files(spark, docs, tmp_path):
    pieces = packing.pack(docs, PATH)
    packing.write_buckets(pieces, f"{tmp_path}/out")
    read = spark.read.parquet(f"{tmp_path}/out")
    assert read.where("length = 64").count() == pieces.where("length = 64").count() > 0
    assert read.count() == pieces.count()
