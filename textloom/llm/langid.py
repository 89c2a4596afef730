"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm import kernels as K
from textloom.runtime import small_batches

_BUCKETS, _WIDTH, _GRAMS = 1 << 16, 16, (3, 4, 5)
#: Letters, and numbers other than decimal digits, which are told apart where found.
_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"

#: ASCII letters in lower case and all other than ASCII as they are; every other byte is one mark.
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _b in range(97, 123):
    _FOLD[_b] = _FOLD[_b - 32] = _b


#: Bytes whose subwords are hashed at once, so that a long text needs little memory.
_BLOCK = 1 << 20


def _buckets(x: np.ndarray, n: int) -> np.ndarray:
    """The bucket of the subword of n bytes that starts at each byte of x, folded bytes; n - 1 fewer than x has."""
    h = np.full(max(0, len(x) - n + 1), n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        h ^= x[k : k + len(h)]
        h *= np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
    return h & np.uint32(_BUCKETS - 1)


def _grams(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of buckets, and each text's range of the block: a text's subwords lie within it and have 3 to 5 bytes."""
    for n in _GRAMS:
        for lo in range(0, len(data), _BLOCK):
            bucket = _buckets(_FOLD[data[lo : lo + _BLOCK + n - 1]], n)
            if len(bucket):
                start = np.clip(off[:-1] - lo, 0, len(bucket))
                yield bucket, start, np.maximum(start, np.clip(off[1:] - n + 1 - lo, 0, len(bucket)))


def has_letter(text: str) -> bool:
    """Whether a character is of one of Unicode's categories of letters."""
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


@dataclass
class Model:
    """Per language a weight of each subword bucket; a text's logits are the averages over its subwords."""

    langs: list[str]
    weights: np.ndarray  # languages x buckets
    bias: np.ndarray
    temperature: float = 1.0
    #: Below this calibrated probability a prediction is rejected.
    least: float = 0.0
    stats: dict = field(default_factory=dict)

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        total, n = np.zeros((len(off) - 1, len(self.langs))), np.zeros(len(off) - 1)
        for bucket, start, end in _grams(data, off):
            n += end - start
            sums = np.zeros(len(bucket) + 1)
            for k, w in enumerate(self.weights):
                np.cumsum(w[bucket], out=sums[1:])
                total[:, k] += sums[end] - sums[start]
        return total / np.maximum(n, 1)[:, None] + self.bias

    def scores(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        z = self.logits(data, off) / self.temperature
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        data, off = K.texts_of(texts)
        p = self.scores(data, off)
        best = p.argmax(1)
        known = np.fromiter((t is not None and has_letter(t) for t in texts.to_pylist()), bool, len(texts))
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, p[np.arange(len(best)), best], 0.0)


def train(texts: list[str], labels: list[str], *, epochs: int = 8, rate: float = 1.0, seed: int = 1) -> Model:
    """Stochastic gradient descent over embeddings and output weights, in numpy.

    Every fifth text is kept from training and calibrates: a temperature that makes the probabilities
    fit, and the rejection bound, which one in a thousand of its right predictions may fall below.
    """
    langs = sorted(set(labels))
    y = np.array([langs.index(x) for x in labels])
    bags = []
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        bucket = np.concatenate([np.zeros(0, np.uint32), *(b[s[0] : e[0]] for b, s, e in _grams(raw, np.array([0, len(raw)])))])
        ids, n = np.unique(bucket, return_counts=True)
        bags.append((ids, (n / max(1, n.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (_BUCKETS, _WIDTH)).astype(np.float32)
    out, bias = np.zeros((_WIDTH, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    out += rng.normal(0, 0.1, out.shape).astype(np.float32)
    held = np.arange(len(texts)) % 5 == 4 if len(texts) >= 5 * len(langs) else np.zeros(len(texts), bool)
    learn = np.flatnonzero(~held)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(learn):
            ids, n = bags[i]
            if not len(ids):
                continue
            hidden = n @ embed[ids]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= step * np.outer(hidden, p)
            bias -= 0.01 * step * p
            # a subword's share of a text is small: steps are scaled so that the text's average moves by a tenth of step
            embed[ids] -= np.outer(n * (0.1 * step * min(1000.0, 1 / float(n @ n))), back)
    model = Model(langs, (embed @ out).T.copy(), bias)
    check = np.flatnonzero(held) if held.any() else learn
    z = np.array([(model.weights[:, bags[i][0]] * bags[i][1]).sum(1) + bias for i in check])
    best = (np.inf, 1.0)
    for t in np.geomspace(1, 20, 40):
        p = np.exp(z / t - (z / t).max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        best = min(best, (-np.log(p[np.arange(len(check)), y[check]] + 1e-12).mean(), t))
    model.temperature = float(best[1])
    p = np.exp(z / model.temperature - (z / model.temperature).max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    right = p.argmax(1) == y[check]
    model.least = float(min(0.5, np.quantile(p.max(1)[right], 0.001))) if right.any() else 0.0
    model.stats = {"checked": len(check), "accuracy": float(right.mean())}
    return model


def held_out(id_col: str) -> Column:
    """Whether a row is kept from learning: the CRC-32 of its id as text is 2 modulo 4; a null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, per_lang: int = 400, most_langs: int = 200, most_bytes: int = 32_768, most_total: int = 64 << 20) -> Model | None:
    """A model of a bounded sample: about per_lang labelled texts of each of the most_langs most frequent languages.

    Rows take part whose text and language are not null, whose text has most_bytes at most and whose id
    is not null or held out; a language gets an equal share of most_total bytes at most; which of them is settled by a hash of id and text, so that reruns agree, and
    repeated rows count once. None if there are no such rows. Every text is classified, however long.
    """
    rows = docs.where(~held_out(id_col) & F.col(id_col).isNotNull() & (F.octet_length(text_col) <= most_bytes) & F.col(lang_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("size")).orderBy(F.desc("n"), "lang").limit(most_langs).collect()
    if not counts:
        return None
    share = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 20)) / F.lit(1 << 20)
    pick = [(F.col("lang") == r.lang) & (share < min(1.0, per_lang / r.n, most_total / (len(counts) * max(1, r.size)))) for r in counts]
    sample = rows.where(reduce(or_, pick)).distinct()
    got = sorted((r.id, r.text, r.lang) for r in sample.collect())
    got = got or sorted((r.id, r.text, r.lang) for r in rows.limit(per_lang).collect())
    return train([g[1] for g in got], [g[2] for g in got])


def _scorer(docs: DataFrame, model: Model | None):
    """A vectorised column function: text to (lang, score)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def score(texts: pa.Array) -> pa.Array:
        langs: list[str] = []
        scores: list[np.ndarray] = [np.zeros(0)]
        for part in K.chunks(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", 1 << 20):
            if sent.value is None:
                langs += [UNKNOWN] * part.num_rows
                scores.append(np.zeros(part.num_rows))
            else:
                got, p = sent.value.predict(part.column(0))
                langs += got
                scores.append(p)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores))], ["lang", "score"])

    return score


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None, **how) -> DataFrame:
    """(id_col, held_out, lang_pred, score, rejected) of every row of docs, from its whole text alone.

    lang_pred is `und` with score 0 where the text is null or has no letter, or where nothing was
    learned. rejected says that it is `und` or that its calibrated probability is below the model's
    bound. Repeated rows and null ids each get their result; an empty table gives no rows; no
    language labels, sources or ids enter a prediction; other columns are not read.
    """
    small_batches(docs)
    model = model or fit(docs, id_col, text_col, lang_col, **how)
    found = docs.select(F.col(id_col).alias("id"), _scorer(docs, model)(F.col(text_col)).alias("x"))
    rejected = (F.col("x.lang") == UNKNOWN) | (F.col("x.score") < (model.least if model else 0.0))
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), F.col("x.lang").alias("lang_pred"), F.col("x.score").alias("score"), rejected.alias("rejected"))


def known_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None, **how) -> DataFrame:
    """docs without the rows whose language is rejected; all columns come back, whatever their names.

    A null text and one without a letter go; rows with null or repeated ids are judged by their texts
    alone; an empty table, or one from which nothing can be learned, gives no rows.
    """
    small_batches(docs)
    model = model or fit(docs, id_col, text_col, lang_col, **how)
    found = docs.select(F.struct("*").alias("row"), _scorer(docs, model)(F.col(text_col)).alias("x"))
    return found.where((F.col("x.lang") != UNKNOWN) & (F.col("x.score") >= (model.least if model else 0.0))).select("row.*")
