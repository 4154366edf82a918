"""Packing documents into sequences that no document crosses, by power-of-two decomposition.

A document's token ids and its end id are cut into pieces whose lengths are the binary digits of their number: as many
pieces of the greatest length as fit, then one for each set bit of the rest, longest first. Each piece is a sequence of
its own in the bucket of its length, so nothing is padded, no sequence holds two documents, and a batch is drawn from one
bucket. Texts are split with numpy; each distinct pre-token is encoded once a Python worker (bounded cache) by the
tokenizer itself. It is one pass over the texts without a shuffle; a document's pieces follow from its text alone.

Null and empty texts have the end id only: one sequence of length 1. Repeated rows and ids are packed one by one; an empty
table gives an empty result. The text column isn't returned; other columns are, and one named like a result is replaced.
Texts of any length are encoded in parts cut where a white space follows another character, where no pre-token crosses.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .pretokens import WHITE, PreTokens, split_special
from .text import U64, batches

_ENCODERS: dict = {}
CACHE, SLOTS, PART, ROWS = 700_000, 1 << 17, 1 << 20, 4096
_BLANK = "".join(map(re.escape, map(chr, WHITE)))
_CUT = re.compile(f"(?<=[^{_BLANK}])[{_BLANK}]")


def _parts(text: str):
    """The text in parts of about PART characters, cut where no pre-token crosses; long runs without such a place stay whole."""
    at = 0
    while len(text) - at > PART and (found := _CUT.search(text, at + PART)):
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


class Encoder:
    """Token ids of texts in one Python worker: a tokenizer, and the ids of pre-tokens that it has been asked.

    Pre-tokens are told by 64-bit hashes, and by their length and first character."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = json.loads(spec)["added_tokens"]
        self.specials, self.special_ids = [t["content"] for t in added], [t["id"] for t in added]
        self.white, self.line_break = set(WHITE), self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.forget()

    def forget(self) -> None:
        self.number: dict[int, int] = {}
        self.ids = np.empty(0, np.uint32)
        self.start, self.size, self.sign = (np.empty(0, np.int64) for _ in range(3))
        self.keys, self.at = np.zeros(SLOTS, U64), np.full(SLOTS, -1)

    def learn(self, tokens: PreTokens, places: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """Numbers of new words, those of the pre-tokens at these places."""
        texts = [tokens.text(k) for k in places]
        ids, size = np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        blank = np.fromiter((ord(t[-1]) in self.white for t in texts), bool, len(texts))
        for joined in (True, False):  # a line break cuts other pre-tokens as it is cut from them, so that many are encoded at once
            mine = np.flatnonzero(blank != joined)
            lists = ["\n".join(texts[k] for k in mine[lo : lo + 512]) + "\n" for lo in range(0, len(mine), 512)] if joined else [texts[k] for k in mine]
            found = [e.ids for e in self.tokenizer.encode_batch(lists, add_special_tokens=False)]
            flat = np.fromiter((i for x in found for i in x), np.uint32, sum(map(len, found)))
            if joined:
                size[mine] = np.diff(np.flatnonzero(flat == self.line_break), prepend=-1) - 1
                flat = flat[flat != self.line_break]
            else:
                size[mine] = [len(x) for x in found]
            ids = np.concatenate((ids, flat))
        end = np.empty(len(texts), np.int64)
        order = np.argsort(blank, kind="stable")
        end[order] = np.cumsum(size[order])
        first = len(self.sign)
        self.start = np.concatenate((self.start, len(self.ids) + end - size))
        self.size = np.concatenate((self.size, size))
        self.ids = np.concatenate((self.ids, ids))
        self.sign = np.concatenate((self.sign, sign[places]))
        return np.arange(first, first + len(texts))

    def words(self, tokens: PreTokens) -> np.ndarray:
        """The number of each pre-token's word: from the direct-mapped table, else the dictionary, else the tokenizer."""
        if len(self.sign) > CACHE:
            self.forget()
        sign = (tokens.end - tokens.start << 21) + tokens.cp[tokens.start]
        slot = (tokens.hash & U64(SLOTS - 1)).astype(np.int64)
        number = self.at[slot]
        miss = np.flatnonzero((self.keys[slot] != tokens.hash) | (number < 0))
        if len(miss):
            keys, first, inverse = np.unique(tokens.hash[miss], return_index=True, return_inverse=True)
            names = keys.tolist()
            new = [k for k, h in enumerate(names) if h not in self.number]
            self.number.update(zip([names[k] for k in new], self.learn(tokens, miss[first[new]], sign).tolist()))
            found = np.fromiter((self.number[h] for h in names), np.int64, len(names))
            number[miss] = found[inverse]
            slot = (keys & U64(SLOTS - 1)).astype(np.int64)
            self.keys[slot], self.at[slot] = keys, found
        other = np.flatnonzero(self.sign[number] != sign)
        if len(other):  # another word with the hash of a known one
            number[other] = self.learn(tokens, other, sign)
        return number

    def run(self, parts: list[str], special: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts, and how many each has. special: (part, id) of the special strings that stand for a part."""
        tokens = PreTokens(parts, spaced=True)
        if len(tokens.hash):
            word = self.words(tokens)
            size = self.size[word]
            end = np.cumsum(size)
            ids = self.ids[np.repeat(self.start[word] - (end - size), size) + np.arange(end[-1])]
            count = np.bincount(tokens.doc, size, len(parts)).astype(np.int64)
        else:
            ids, count = np.empty(0, np.uint32), np.zeros(len(parts), np.int64)
        if special:
            before = np.concatenate(([0], np.cumsum(count)))
            at = np.array([k for k, _ in special])
            ids = np.insert(ids, before[at], [i for _, i in special])
            count[at] += 1
        return ids, count

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of all texts one after the other, as a list of arrays, and how many each text has."""
        pieces, owner, special = split_special(texts, self.specials)
        special_id = {p: self.special_ids[s] for p, s in special}
        total, out = np.zeros(len(texts), np.int64), []
        run, whose, stands, size = [], [], [], 0

        def flush():
            nonlocal run, whose, stands, size
            ids, count = self.run(run, stands)
            out.append(ids)
            np.add.at(total, whose, count)
            run, whose, stands, size = [], [], [], 0

        for p, piece in enumerate(pieces):
            for part in _parts(piece):
                if p in special_id:
                    stands.append((len(run), special_id[p]))
                run.append(part)
                whose.append(owner[p])
                size += len(part)
                if size >= PART:
                    flush()
        if run:
            flush()
        return out, total


def _encoder(spec: str) -> Encoder:
    key = hash(spec)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def ended(ids: list[np.ndarray], count: np.ndarray, end_id: int) -> np.ndarray:
    """The ids of all documents in one array, each with the end id behind it."""
    if len(count) == 1:
        return np.concatenate([*ids, np.array([end_id], np.uint32)])
    flat = np.concatenate([*ids, np.empty(0, np.uint32)])
    out = np.empty(len(flat) + len(count), np.uint32)
    out[np.arange(len(flat)) + np.repeat(np.arange(len(count)), count)] = flat
    out[np.cumsum(count + 1) - 1] = end_id
    return out


def cut(count: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents with so many ids: number of the document, ids before it, and length of each; by document and place."""
    whole, rest = np.divmod(count, longest)
    doc, bit = np.nonzero((rest[:, None] >> np.arange(longest.bit_length() - 2, -1, -1)) & 1) if longest > 1 else (np.empty(0, np.int64),) * 2
    docs = np.concatenate((np.repeat(np.arange(len(count)), whole), doc))
    length = np.concatenate((np.full(int(whole.sum()), longest), (longest >> 1) >> bit))
    order = np.argsort(docs, kind="stable")  # of one document the longest first
    docs, length = docs[order], length[order]
    before = np.cumsum(length) - length
    return docs, before - (np.cumsum(count) - count)[docs], length


def pack(docs: DataFrame, vocabulary: str, text_col: str = "text", longest: int = 2048, end_id: int = 1) -> DataFrame:
    """A row for each piece, which is a sequence of its own: the other columns of its document, then

    start (the document's ids before it), length (a power of two, at most `longest`), ids (little-endian unsigned 32-bit
    numbers), doc_tokens (the document's ids with the end id), sequence_id and offset (0). vocabulary: path of a tokenizers
    .json file on the driver. longest: a power of two.

    A sequence_id holds the bucket (the length's exponent) in its top bits, then the number of the task and a count in
    that task; ids are unique, and those of one bucket lie together. Save the result before it is used more than once if
    the order of `docs` may change from run to run.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    added = [T.StructField(n, T.BinaryType() if n == "ids" else T.LongType()) for n in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset")]
    at = docs.columns.index(text_col)
    own = [k for k, c in enumerate(docs.columns) if k != at and c not in {f.name for f in added}]
    kept = [docs.schema.fields[k] for k in own]
    names = [f.name for f in (*kept, *added)]

    def run(rows):
        encoder, task = _encoder(spec.value), TaskContext.get().partitionId()
        used = np.zeros(longest.bit_length(), np.int64)
        for batch in rows:
            for lo, hi in batches(batch.column(at)):
                part = batch.slice(lo, hi - lo)
                ids, count = encoder.encode(part.column(at).to_pylist())
                flat, count = ended(ids, count, end_id), count + 1
                doc, start, length = cut(count, longest)
                bucket = np.log2(length).astype(np.int64)
                nth = np.empty(len(doc), np.int64)
                for b in np.unique(bucket):
                    mine = np.flatnonzero(bucket == b)
                    nth[mine] = used[b] + np.arange(len(mine))
                    used[b] += len(mine)
                sequence = (bucket << 56) + (task << 32) + nth
                edge = np.concatenate(([0], np.cumsum(length)))
                for a in range(0, len(doc), ROWS):
                    z = min(a + ROWS, len(doc))
                    offsets = ((edge[a : z + 1] - edge[a]) * 4).astype(np.int32)
                    bytes_ = pa.BinaryArray.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(offsets), pa.py_buffer(flat[edge[a] : edge[z]].astype("<u4").tobytes())])
                    which = pa.array(doc[a:z])
                    yield pa.RecordBatch.from_arrays([*(part.column(k).take(which) for k in own), *map(pa.array, (start[a:z], length[a:z])), bytes_, *map(pa.array, (count[doc[a:z]], sequence[a:z], np.zeros(z - a, np.int64)))], names=names)

    return docs.mapInArrow(run, T.StructType([*kept, *added]))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Parquet files by length, so that a training batch of equal lengths reads one folder. Rows are dealt out anew by length;
    Spark splits the large lengths, so that no task or file holds a whole bucket."""
    pieces.hint("rebalance", "length").write.partitionBy("length").mode("errorifexists").parquet(path)
