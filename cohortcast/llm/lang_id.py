"""Language identification by error-correcting output codes.

Each learned language has a codeword; a binary classifier over hashed character n-grams (1 to `longest`)
predicts each bit. Decoding weighs the bits' losses: the language with the least mean logistic loss over
its codeword wins, and a text is ambiguous where the runner-up is nearly as near.

Classifiers are fitted by logistic regression, on at most `per_language` texts a language, chosen by
a hash of the id. Whole texts are counted map-side, in the sample too: the driver gets a row of
`BUCKETS` half-precision numbers for each sampled text. That bound holds for the sample alone: prediction
reads all texts, map-side, with weights of fixed size in a broadcast.

Null texts and texts without a letter are `und` with score 0. Rows without a language are never learned
from. With one learned language all texts are given it; with none, `und`. Empty tables give empty
results; repeated rows are judged alike.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .pretokens import LETTER, classes
from .text import U64, batches, mix

BUCKETS = 1 << 12


def _lower_table() -> np.ndarray:
    out = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(0x530):  # Latin, Greek and Cyrillic
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    out[classes() != LETTER] = 0x20  # what isn't a letter parts words
    return out


_TABLE: list[np.ndarray] = []


def features(texts: list[str], longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams of letters, a row for each text, scaled to unit length; and the number of letters."""
    if not _TABLE:
        _TABLE.append(_lower_table())
    out = np.zeros((len(texts), BUCKETS), np.float32)
    letters = np.zeros(len(texts), np.int64)
    for k, t in enumerate(texts):
        total = np.zeros(BUCKETS, np.int64)
        for lo in range(0, len(t), 1 << 18):  # long texts by parts, which overlap by an n-gram
            cp = _TABLE[0][np.frombuffer(t[max(0, lo - longest + 1) : lo + (1 << 18)].encode("utf-32-le", "surrogatepass"), np.uint32)].astype(U64)
            own = cp[min(lo, longest - 1) :]
            letters[k] += int((own != 0x20).sum())
            cp = cp[np.append(True, (cp[1:] != 0x20) | (cp[:-1] != 0x20))] if len(cp) else cp
            h = cp
            for n in range(1, longest + 1):
                if n > 1:
                    h = h[:-1] * U64(0x100000001B3) + cp[n - 1 :] if len(cp) >= n else h[:0]
                at = (mix(h + U64(n)) % U64(BUCKETS)).astype(np.int64)
                total += np.bincount(at, minlength=BUCKETS)
        row = np.sqrt(total)
        size = np.sqrt((row * row).sum())
        out[k] = row / size if size else 0
    return out, letters


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """A codeword of -1 and 1 for each of n languages: one bit a language, and random ones that split them evenly."""
    own = 2 * np.eye(n, dtype=np.int64) - 1
    if n < 3:
        return own
    rng = np.random.default_rng(seed)
    more: list[np.ndarray] = []
    tries = 0
    while len(more) < max(3, 2 * int(np.ceil(np.log2(n)))) and tries < 1000:
        tries += 1
        c = np.where(rng.permutation(n) < n // 2, 1, -1)
        if not any((c == o).all() or (c == -o).all() for o in [*more, *own.T]):
            more.append(c)
    return np.concatenate((own, np.array(more).T), axis=1) if more else own


def fit(x: np.ndarray, y: np.ndarray, code: np.ndarray, rounds: int = 150, rate: float = 20.0, decay: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Weights and offsets of the bits' classifiers, by gradient descent; each side of a bit weighs the same."""
    target = code[y].astype(np.float32)
    weight = np.empty_like(target)
    for b in range(target.shape[1]):
        up = (target[:, b] > 0).mean()
        weight[:, b] = np.where(target[:, b] > 0, 0.5 / max(up, 1e-9), 0.5 / max(1 - up, 1e-9)) / len(x)
    w, b = np.zeros((x.shape[1], target.shape[1]), np.float32), np.zeros(target.shape[1], np.float32)
    for _ in range(rounds):
        g = -target * weight / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30)))
        w -= rate * (x.T @ g + decay * w)
        b -= rate * 0.1 * g.sum(axis=0)
    return w, b


def decode(margin: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row of margins, and a score: the softmax of the losses' differences."""
    loss = np.log1p(np.exp(-np.clip(margin[:, None, :] * code[None, :, :], -30, 30))).sum(axis=2)
    share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    share /= share.sum(axis=1, keepdims=True)
    best = loss.argmin(axis=1)
    return best, share[np.arange(len(best)), best]


def identify(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 400, longest: int = 3, ambiguous_below: float = 0.8) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous (such columns of docs are replaced). learn: which rows may be learned from."""
    spark = docs.sparkSession
    known = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("n")).orderBy("lang").collect()  # a row a language
    names = [r["lang"] for r in known]
    # about twice per_language texts of each are drawn by a hash, of which the least hashes are taken
    share = F.lit(0.0)
    for r in known:
        share = F.when(F.col(lang_col) == r["lang"], min(1.0, 2.0 * per_language / r["n"])).otherwise(share)
    drawn = F.pmod(F.xxhash64(F.lit("sample"), id_col, text_col), F.lit(1 << 30)) < share * (1 << 30)
    rows = docs.where(learn & drawn & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(id_col, text_col).alias("h"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= per_language)

    def counted(batches_of):
        for batch in batches_of:
            for lo, hi in batches(batch.column(2)):
                x, _ = features(batch.column(2).slice(lo, hi - lo).to_pylist(), longest)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array([v.tobytes() for v in x.astype(np.float16)], pa.binary())], names=["lang", "k", "x"])

    model = None
    if names:
        rows = rows.select("lang", "k", "text").mapInArrow(counted, "lang string, k int, x binary").toPandas().sort_values(["lang", "k"])  # per_language rows a language
        x = np.stack([np.frombuffer(v, np.float16) for v in rows["x"]]).astype(np.float32)
        y = np.array([names.index(v) for v in rows["lang"]])
        code = codewords(len(names))
        model = (*fit(x, y, code), code)
    held = spark.sparkContext.broadcast((names, model))
    made = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    others = [c for c in docs.columns if c not in {f.name for f in made}]
    docs = docs.select(*others)
    at = others.index(text_col)
    titles = [*others, *(f.name for f in made)]

    def run(batches_of):
        names, model = held.value
        for batch in batches_of:
            col = batch.column(at)
            for lo, hi in batches(col):
                for a in range(lo, hi, 256):
                    part = batch.slice(a, min(256, hi - a))
                    texts = [t or "" for t in part.column(at).to_pylist()]
                    pred, score = ["und"] * len(texts), np.zeros(len(texts))
                    if names:
                        x, letters = features(texts, longest)
                        w, b, code = model
                        best, score = decode(x @ w + b, code)
                        pred = [names[k] if n else "und" for k, n in zip(best, letters)]
                        score = np.where(letters > 0, score, 0.0)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score.astype(np.float64)), pa.array(score < ambiguous_below)], names=titles)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *made]))
