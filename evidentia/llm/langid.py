"""Language identification by sparse multinomial logistic regression.

Features are TF-IDF weights of hashed character n-grams (one to three lower-cased letters, everything else a space):
term frequency is the share of the text's n-grams, so a text of any length is scored in one pass over its characters.
Weights are learned by follow-the-regularised-leader with elastic-net penalties, which leaves most of them zero; a
temperature fitted on rows set aside calibrates the probabilities.

The model learns from a bounded sample (``per_language`` rows of each language, of at most ``max_chars`` characters,
picked by a hash of the id), so training runs on the driver with a fixed bound; prediction reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_slices

ORDERS = (1, 2, 3)
BITS = 16
#: Shares of a text's n-grams are small; this puts a common one near 1.
SCALE = 100.0


@cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and (ch := chr(c)).isalpha():
            table[c] = ord(low) if len(low := ch.lower()) == 1 else c
    return table


def features(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashed n-grams of a batch, one array for each order (1 << BITS where there is none); starts of the texts; whether each has a letter."""
    codes = letters()[np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "replace"), np.uint32)]
    ends = np.cumsum(np.fromiter((len(t) + 2 for t in texts), np.int64, len(texts)))
    starts = np.concatenate(([0], ends[:-1]))
    found, h = [], np.zeros(len(codes), np.uint32)
    for k in ORDERS:
        h = h * np.uint32(0x01000193) + np.concatenate((codes[k - 1 :], np.zeros(k - 1, np.uint32))) + np.uint32(k)
        idx = ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)).astype(np.int32)
        for back in range(1, k):
            idx[ends - back] = 1 << BITS
        found.append(idx)
    return found, starts, np.add.reduceat((codes != 32).astype(np.int32), starts) > 0


@dataclass
class Model:
    """``weights`` holds IDF times learned weight for each n-gram (the last row is zero) and language."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found, starts, lettered = features(texts)
        total = sum(np.add.reduceat((idx < 1 << BITS).astype(np.int32), starts) for idx in found)
        out = np.empty((len(texts), len(self.languages)))
        for c in range(len(self.languages)):
            column = np.ascontiguousarray(self.weights[:, c])
            out[:, c] = sum(np.add.reduceat(column[idx], starts, dtype=np.float64) for idx in found) * SCALE / total + self.bias[c]
        return out, lettered

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return ["und"] * len(texts), [0.0] * len(texts)
        z, lettered = self.logits([t or "" for t in texts])
        z = z / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered)], [float(p[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, lettered))]


def fit(texts: list[str], langs: list[str], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1, epochs: int = 4) -> Model:
    """FTRL-proximal over the texts; every fifth one is set aside for the temperature."""
    languages = sorted(set(langs))
    size, n = 1 << BITS, len(languages)
    if not n:
        return Model([], np.zeros((size + 1, 0)), np.zeros(0), 1.0)
    rows, df = [], np.zeros(size + 1)
    for text in texts:
        found, _, _ = features([text])
        idx = np.concatenate(found)
        uniq, counts = np.unique(idx[idx < size], return_counts=True)
        rows.append((uniq, counts / counts.sum() * SCALE))
        df[uniq] += 1
    idf = np.log((1 + len(texts)) / (1 + df)) + 1
    y = np.array([languages.index(x) for x in langs])
    order = np.random.default_rng(7).permutation(len(texts))
    aside = order[::5] if len(texts) >= 5 * n else order[:0]
    train = np.setdiff1d(order, aside)
    z, g2, zb, gb = np.zeros((size, n)), np.zeros((size, n)), np.zeros(n), np.zeros(n)

    def weights(idx):
        zi, ni = z[idx], g2[idx]
        return -np.sign(zi) * np.maximum(np.abs(zi) - l1, 0) / ((beta + np.sqrt(ni)) / alpha + l2)

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(train):
            idx, x = rows[i]
            x = x * idf[idx]
            w, b = weights(idx), -zb / ((beta + np.sqrt(gb)) / alpha)
            s = x @ w + b
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y[i]] -= 1
            for grad, zz, nn, ww in ((np.outer(x, p), z, g2, w), (p, zb, gb, b)):
                at = idx if zz is z else slice(None)
                old = nn[at]
                new = old + grad * grad
                zz[at] += grad - (np.sqrt(new) - np.sqrt(old)) / alpha * ww
                nn[at] = new
    learned = np.zeros((size + 1, n))
    learned[:size] = weights(np.arange(size))
    model = Model(languages, (learned * idf[:, None]).astype(np.float32), -zb / ((beta + np.sqrt(gb)) / alpha), 1.0)
    if len(aside):
        s = np.vstack([model.logits([texts[i]])[0] for i in aside])

        def loss(t):
            u = s / t
            return np.mean(np.log(np.exp(u - u.max(1, keepdims=True)).sum(1)) + u.max(1) - u[np.arange(len(aside)), y[aside]])

        model.temperature = float(min(np.geomspace(1, 16, 41), key=loss))
    return model


def train(labelled: DataFrame, id_col: str = "doc_id", per_language: int = 400, max_chars: int = 20_000) -> Model:
    """Learns from columns ``text`` and ``lang``; rows without either teach nothing.

    The sample holds about ``per_language`` rows of each language, of 1 to ``max_chars`` characters, chosen by a hash
    of the id: the share that each language keeps follows its count, so one hot language costs no more than another.
    """
    usable = labelled.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.length("text").between(1, max_chars)).select(id_col, "text", "lang")
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # as many rows as languages
    if not counts:
        return fit([], [])
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))])
    picked = usable.filter((F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(1 << 20)) / float(1 << 20)) < F.element_at(share, F.col("lang")))
    sample = sorted((str(r[0]), r[1], r[2]) for r in picked.limit(2 * per_language * len(counts)).collect())
    return fit([t for _, t, _ in sample], [x for _, _, x in sample])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    return F.crc32(doc_id.cast("string")) % folds == 0


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of ``docs`` with ``lang_pred`` and ``score`` of its whole ``text``.

    ``lang_pred`` is a learned language, or ``und`` with score 0 if the text is null, has no letter, or nothing was
    learned. Equal scores go to the language first in order. Other columns stay. A narrow map; the model's size is
    fixed by BITS and the number of languages.
    """
    made = ("lang_pred", "score")
    kept = [f for f in docs.schema.fields if f.name not in made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 2 << 20):
            langs, scores = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*(f.name for f in kept), *made])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField(made[0], T.StringType()), T.StructField(made[1], T.DoubleType())]))
