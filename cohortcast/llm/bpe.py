"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. In each round the key of every neighbouring
pair is looked up by binary search among the sorted pair keys; the lowest rank of each word is found,
and its pairs are merged, leftmost first. Words are encoded once per Python worker (bounded cache), so
a text costs its splitting and a gather.

Null is an empty text: no ids, and decoded as an empty text. Repeated rows and ids are coded one by one;
empty tables give empty results; other columns pass through, and one that has the name of a result is
replaced by it. Ids that the vocabulary lacks decode to nothing.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pretokens import PreTokens, split_special
from .text import U64, batches, freeing

_CODECS: dict = {}
CACHE = 400_000


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next one from 256."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


def _lower(text: str) -> str:
    """Character by character: unlike str.lower, a final sigma is like any other."""
    return text.replace("Σ", "σ").lower() if "Σ" in text else text.lower()


class Codec:
    """A BPE vocabulary whose last symbol of a word carries a suffix."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        model = d["model"]
        self.vocab = {t: i for t, i in model["vocab"].items()} | {t["content"]: t["id"] for t in d["added_tokens"]}
        self.tokens = [""] * (max(self.vocab.values()) + 1)
        for t, i in self.vocab.items():
            self.tokens[i] = t
        self.specials = [t["content"] for t in d["added_tokens"]]
        suffix = model.get("end_of_word_suffix") or ""
        chars = byte_chars()
        self.inner = np.array([self.vocab[c] for c in chars], np.int64)
        self.final = np.array([self.vocab[c + suffix] for c in chars], np.int64)
        self.size = U64(len(self.tokens))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pair = np.array([(self.vocab[a], self.vocab[b]) for a, b in merges], np.int64)
        made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        keys = pair[:, 0].astype(U64) * self.size + pair[:, 1].astype(U64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        # If a merge never uses a symbol that a later merge makes, all equal pairs of a round can be merged at once.
        last = np.full(len(self.tokens), -1)
        np.maximum.at(last, made, np.arange(len(made)))
        self.at_once = bool((last[pair].max(axis=1) < np.arange(len(pair))).all())
        self.forget()

    def forget(self) -> None:
        self.number: dict[int, int] = {}
        self.flat, self.offset = [], [0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and the length of each word's share."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words)), size)
        ids = self.inner[raw]
        end = np.cumsum(size)[size > 0] - 1
        ids[end] = self.final[raw[end]]
        done_ids, done_word = [], []
        none = len(self.keys)
        while len(ids):
            key = ids[:-1].astype(U64) * self.size + ids[1:].astype(U64)
            at = np.searchsorted(self.keys, key)
            at[at == none] = 0
            hit = (self.keys[at] == key) & (word[1:] == word[:-1])
            rank = np.append(np.where(hit, self.rank[at], none), none)
            start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            share = np.diff(np.append(start, len(ids)))
            best = np.repeat(np.minimum.reduceat(rank, start), share)
            still = best < none
            if not still.all():
                done_ids.append(ids[~still])
                done_word.append(word[~still])
                ids, word, rank, best = ids[still], word[still], rank[still], best[still]
                at = np.append(at, 0)[still]
                if not len(ids):
                    break
            else:
                at = np.append(at, 0)
            chosen = np.flatnonzero(rank == best)
            if self.at_once:  # of overlapping pairs (aaa) each second one, from the left
                run = np.cumsum(np.append(True, np.diff(chosen) > 1))
                first = np.searchsorted(run, run)
                chosen = chosen[(np.arange(len(chosen)) - first) % 2 == 0]
            else:  # the leftmost of each word
                chosen = chosen[np.append(True, word[chosen[1:]] != word[chosen[:-1]])]
            ids[chosen] = self.made[at[chosen]]
            keep = np.ones(len(ids), bool)
            keep[chosen + 1] = False
            ids, word = ids[keep], word[keep]
        if not done_ids:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))

    def learn(self, tokens: PreTokens) -> np.ndarray:
        """The number of each pre-token's word in the cache; new words are encoded together."""
        if len(self.number) > CACHE:
            self.forget()
        keys, first, inverse = np.unique(tokens.hash, return_index=True, return_inverse=True)
        names, number = keys.tolist(), self.number
        new = [k for k, h in enumerate(names) if h not in number]
        if new:
            ids, share = self.merge([tokens.text(first[k]).encode("utf-8", "surrogatepass") for k in new])
            end = np.cumsum(share)
            for k in new:
                number[names[k]] = len(number)
            self.flat.append(ids)
            self.offset.extend((self.offset[-1] + end).tolist())
        return np.fromiter((number[h] for h in names), np.int64, len(names))[inverse]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin (with one entry past the end)."""
        pieces, owner, special = split_special(texts, self.specials)
        pieces = [_lower(unicodedata.normalize("NFC", p)) if not p.isascii() else p.lower() for p in pieces]
        tokens = PreTokens(pieces, spaced=False)
        word = self.learn(tokens) if len(tokens.hash) else np.empty(0, np.int64)
        if len(self.flat) > 1:
            self.flat = [np.concatenate(self.flat)]
        flat = self.flat[0] if self.flat else np.empty(0, np.int64)
        offset = np.array(self.offset)
        size = offset[word + 1] - offset[word] if len(word) else np.empty(0, np.int64)
        end = np.cumsum(size)
        ids = flat[np.repeat(offset[word] - (end - size), size) + np.arange(end[-1])] if len(word) else np.empty(0, np.int64)
        doc = np.repeat(owner[tokens.doc], size)
        if special:  # put special ids where their pieces stood
            piece = np.concatenate((np.repeat(tokens.doc, size), [p for p, _ in special]))
            ids = np.concatenate((ids, [self.vocab[self.specials[s]] for _, s in special]))
            order = np.argsort(piece, kind="stable")
            ids, doc = ids[order], owner[piece[order].astype(np.int64)]
        return ids, np.searchsorted(doc, np.arange(len(texts) + 1))


def _codec(spec: str) -> Codec:
    key = hash(spec)
    if key not in _CODECS:
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def _broadcast(df: DataFrame, vocabulary: str):
    with open(vocabulary, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _joined(tokens: pa.Array, ids: pa.Array, first: np.ndarray) -> pa.Array:
    known = pc.fill_null(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(tokens) - 1)), False)
    words = tokens.take(pc.if_else(known, ids, len(tokens) - 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), words), " ")


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Adds ids_col, the token ids of text_col, and if asked decoded_col, what those ids decode to.
    vocabulary: path of a tokenizers .json file on the driver."""
    spec = _broadcast(docs, vocabulary)
    added = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded_col, T.StringType())] if decoded_col else [])
    own = [k for k, c in enumerate(docs.columns) if c not in {f.name for f in added}]
    at = docs.columns.index(text_col)

    def run(rows):
        codec = _codec(spec.value)
        tokens = pa.array([*codec.tokens, ""])
        for batch in rows:
            col = batch.column(at)
            for lo, hi in batches(col):
                part = batch.slice(lo, hi - lo)
                flat, first = codec.encode(part.column(at).to_pylist())
                ids = pa.array(flat.astype(np.int32))
                out = [*(part.column(k) for k in own), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), ids)]
                if decoded_col:
                    out.append(_joined(tokens, ids, first))
                yield pa.RecordBatch.from_arrays(out, names=names)

    kept = [docs.schema.fields[k] for k in own]
    names = [f.name for f in (*kept, *added)]
    return docs.mapInArrow(freeing(run), T.StructType([*kept, *added]))


def decode(docs: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds out_col, the tokens of ids_col joined by a space, as a vocabulary without a decoder has it."""
    spec, at = _broadcast(docs, vocabulary), docs.columns.index(ids_col)
    own = [k for k, c in enumerate(docs.columns) if c != out_col]
    kept = [docs.schema.fields[k] for k in own]
    names = [*(f.name for f in kept), out_col]

    def run(rows):
        tokens = pa.array([*_codec(spec.value).tokens, ""])
        for batch in rows:
            for lo in range(0, len(batch), 200):
                part = batch.slice(lo, 200)
                col = part.column(at)
                first = np.concatenate(([0], np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False))))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in own), _joined(tokens, col.flatten(), first)], names=names)

    return docs.mapInArrow(freeing(run), T.StructType([*kept, T.StructField(out_col, T.StringType())]))
