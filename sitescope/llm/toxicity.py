"""Toxicity scores from subword-bag embeddings under a linear softmax.

A word is the bag of itself and its character n-grams, hashed into a fixed
number of buckets; a bucket has a small embedding. A text's vector is the mean
of its distinct words' vectors (each the mean of its bag), and a linear softmax
reads it. Embeddings and softmax are trained jointly in numpy on a bounded
sample of labelled rows, so a misspelling never seen in training still shares
most n-gram vectors with the word it stands for.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import number_words, offsets

#: Bounds of the training sample: labelled rows of each class at most.
SAMPLE_POSITIVE, SAMPLE_NEGATIVE = 2000, 4000

BUCKETS, WIDTH, NGRAMS = 1 << 17, 8, (3, 4, 5)
EPOCHS, BATCH, RATE, SEED = 5, 32, 3.0, 11
#: A small sample is gone through more often, for about this many steps.
LEAST_STEPS = 600
#: Softmax and biases learn at this part of the embeddings' rate.
PACE = 0.3
BASE, WORDS_AT_ONCE = 1_000_003, 50_000
#: Shorter texts are averaged as if empty words filled them up to this many.
LEAST_WORDS = 20
#: Adagrad's starting sums for embeddings: buckets seen a few times move little.
START = 1e-5

WORDS = re.compile(r'\w+').findall


def bags(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words in a row, and how many each word has.

    A word stands between boundary marks; its bag is itself and its n-grams,
    each hashed as a polynomial over code points.
    """
    marked = [f'<{w}>' for w in words]
    size = np.array([len(m) for m in marked], np.int64)
    code = np.frombuffer(''.join(marked).encode('utf-32-le'), np.uint32).astype(np.uint64)
    place = offsets(size)
    inside = np.arange(len(code)) - np.repeat(place[:-1], size)
    left = np.repeat(size, size) - inside
    power = np.uint64(BASE) ** np.arange(int(size.max(initial=0)) + 1, dtype=np.uint64)
    found = [(np.add.reduceat(code * power[inside], place[:-1]) if len(words) else code, np.arange(len(words)), 0)]
    for n in NGRAMS:
        at = np.flatnonzero(left >= n)
        gram = np.zeros(len(at), np.uint64)
        for k in range(n):
            gram = gram * np.uint64(BASE) + code[at + k]
        found.append((gram, np.repeat(np.arange(len(words)), np.maximum(size - n + 1, 0)), n))
    hashes = np.concatenate([_mix(h + np.uint64(n)) for h, _, n in found])
    word = np.concatenate([w for _, w, _ in found])
    order = np.argsort(word, kind='stable')
    return (hashes % np.uint64(BUCKETS)).astype(np.int32)[order], np.bincount(word, minlength=len(words))


def _mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of the hashes (a finaliser of multiplications and shifts)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights, which sum to one (no words: nothing)."""
    ws = sorted(set(WORDS((text or '').lower())))
    if not ws:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    flat, sizes = bags(ws)
    buckets, place = np.unique(flat, return_inverse=True)
    return buckets, (np.bincount(place, np.repeat(1 / sizes, sizes)) / max(len(ws), LEAST_WORDS)).astype(np.float32)


@dataclass
class Model:
    """Embeddings (buckets x width), softmax weights (width x 2) and biases."""
    embeddings: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def bucket_scores(self) -> np.ndarray:
        """What each bucket adds to the log odds: the softmax of a mean is linear."""
        return (self.embeddings @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float64)

    def offset(self) -> float:
        return float(self.bias[1] - self.bias[0])


def train(features: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> Model:
    """Fit embeddings and softmax together by Adagrad on the cross entropy; classes weigh alike."""
    rng = np.random.default_rng(SEED)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    seen_emb, seen_out, seen_bias = np.full(emb.shape, START, np.float32), np.full(out.shape, 1e-4, np.float32), np.full(2, 1e-4, np.float32)
    share = np.bincount(labels, minlength=2) / max(1, len(labels))
    balance = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0)
    epochs = max(EPOCHS, LEAST_STEPS * BATCH // max(1, len(labels)))
    steps = [rows for _ in range(epochs if len(labels) else 0)
             for rows in np.array_split(rng.permutation(len(labels)), -(-len(labels) // BATCH))]
    for step, rows in enumerate(steps):
        rate = RATE * (1 - step / len(steps))  # falls to nothing, so the last texts weigh no more than others
        sizes = [len(features[r][0]) for r in rows]
        bucket = np.concatenate([features[r][0] for r in rows])
        weight = np.concatenate([features[r][1] for r in rows]).astype(np.float32)
        of = np.repeat(np.arange(len(rows)), sizes)
        used, place = np.unique(bucket, return_inverse=True)
        near = emb[used]
        mean = np.zeros((len(rows), WIDTH), np.float32)
        contribution = near[place] * weight[:, None]
        for k in range(WIDTH):
            mean[:, k] = np.bincount(of, contribution[:, k], minlength=len(rows))
        logits = mean @ out + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(rows)), labels[rows]] -= 1
        error = (p * balance[labels[rows]][:, None] / len(rows)).astype(np.float32)
        pull = np.stack([np.bincount(place, weight * error[of, k], minlength=len(used)) for k in range(2)], axis=1)
        for value, seen, grad, where, pace in ((emb, seen_emb, (pull @ out.T).astype(np.float32), used, 1),
                                         (out, seen_out, mean.T @ error, slice(None), PACE),
                                         (bias, seen_bias, error.sum(axis=0), slice(None), PACE)):
            seen[where] += grad ** 2
            value[where] -= rate * pace * grad / np.sqrt(seen[where])
    return Model(emb, out, bias)


def sample_labels(labels: DataFrame, label_col: str, id_col: str, positive: int = SAMPLE_POSITIVE,
                  negative: int = SAMPLE_NEGATIVE) -> DataFrame:
    """(id, label) of at most ``positive`` and ``negative`` rows, the first by a hash of the id."""
    rows = labels.select(F.col(id_col).alias('__id'), F.col(label_col).cast('int').alias('__label'))
    rows = rows.where(F.col('__id').isNotNull()).groupBy('__id').agg(F.max('__label').alias('__label'))

    def first(value: int, n: int) -> DataFrame:
        return rows.where(F.col('__label') == value).orderBy(F.xxhash64('__id'), '__id').limit(n)

    return first(1, positive).unionByName(first(0, negative))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = 'toxic', id_col: str = 'doc_id', text_col: str = 'text',
        positive: int = SAMPLE_POSITIVE, negative: int = SAMPLE_NEGATIVE) -> Model:
    """Train on a bounded sample of the labelled rows (at most ``positive + negative`` of them).

    Labels are joined by id; null texts count as empty, an id that several
    rows have takes their smallest text and largest label, null labels and ids
    are left out. Features are made and trained on by tasks; only the model
    reaches the driver. Without any row the model scores everything 0.5.
    """
    chosen = sample_labels(labels, label_col, id_col, positive, negative)
    texts = docs.select(F.col(id_col).alias('__id'), F.col(text_col).alias('__text'))
    # The sample is bounded, so it is the side to send to the documents.
    joined = (texts.join(F.broadcast(chosen), '__id').groupBy('__id')
              .agg(F.max('__label').alias('__label'), F.min('__text').alias('__text')))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_features(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0).cast(pa.string()), batch.column(1), pa.array([b.tobytes() for b, _ in made], pa.binary()),
                pa.array([w.astype(np.float16).tobytes() for _, w in made], pa.binary())], ['id', 'label', 'buckets', 'weights'])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([('id', 'ascending')])
        buckets, weights = (rows.column(c).to_pylist() for c in ('buckets', 'weights'))
        features = [(np.frombuffer(b, np.int32), np.frombuffer(w, np.float16)) for b, w in zip(buckets, weights)]
        model = train(features, rows.column('label').to_numpy().astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.float32).tobytes()], pa.binary())
                                          for x in (model.embeddings, model.weights, model.bias)], ['embeddings', 'weights', 'bias'])

    # The bounded sample is trained on in one task, which a lost executor repeats alike; the model has a fixed size.
    features = joined.mapInArrow(run, 'id string, label int, buckets binary, weights binary').repartition(1)
    found = features.mapInArrow(learn, 'embeddings binary, weights binary, bias binary').first()
    if not found:
        return train([], np.zeros(0, np.int64))
    emb, out, bias = (np.frombuffer(x, np.float32) for x in found)
    return Model(emb.reshape(BUCKETS, WIDTH), out.reshape(WIDTH, 2), bias)


def scorer(docs: DataFrame, model: Model) -> 'callable':
    """A function from a text column to its score column (0 to 1; higher: more likely toxic).

    The trained model is a table of fixed size, sent to every task.
    """
    parts = docs.sparkSession.sparkContext.broadcast((model.bucket_scores(), model.offset()))

    @F.pandas_udf('double')
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of_bucket, start = parts.value
        for texts in batches:
            yield pd.Series(1 / (1 + np.exp(-start - log_odds(texts, of_bucket))))

    return score


def log_odds(texts: list[str | None], of_bucket: np.ndarray) -> np.ndarray:
    """Mean over each text's distinct words of the mean of their buckets' scores."""
    numbers, per_text, distinct = number_words(WORDS((t or '').lower()) for t in texts)
    of_word = np.zeros(len(distinct))
    for at in range(0, len(distinct), WORDS_AT_ONCE):
        flat, sizes = bags(distinct[at:at + WORDS_AT_ONCE])
        of_word[at:at + WORDS_AT_ONCE] = np.add.reduceat(of_bucket[flat], offsets(sizes)[:-1]) / sizes
    ends = offsets(per_text)
    out = np.zeros(len(per_text))
    for row in np.flatnonzero(per_text):
        own = np.unique(numbers[ends[row]:ends[row + 1]])
        out[row] = of_word[own].sum() / max(len(own), LEAST_WORDS)
    return out


def score(docs: DataFrame, model: Model, text_col: str = 'text') -> Column:
    """Score of every whole text; null and empty texts get the model's prior."""
    return scorer(docs, model)(F.col(text_col))
