"""Language identification by the nearest of several centroids per language.

A text becomes a TF-IDF vector over hashed character n-grams (lengths one to
three, words apart by one space), normalised to length one. Each language has
a few spherical k-means centroids; the language of the centroid with the
largest cosine wins, and a text farther from it than nearly all of that
centroid's own training texts is marked as rejected.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitescope.llm.common import plain_names, text_blocks

BUCKETS, LONGEST = 4096, 3
#: Bound of the training sample: about so many texts of each language.
SAMPLE_PER_LANGUAGE = 1000
CENTROIDS, ROUNDS, REJECT_SHARE, SEED = 3, 12, 0.005, 3
UNKNOWN = 'und'

OTHER = re.compile(r'[\W\d_]+')


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ''))


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the text."""
    code = np.frombuffer(f' {OTHER.sub(" ", text.lower()).strip()} '.encode('utf-32-le'), np.uint32).astype(np.uint64)
    out = np.zeros(BUCKETS, np.int64)
    gram = np.zeros(len(code), np.uint64)
    for n in range(1, LONGEST + 1):
        gram = gram[:len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1:]
        mixed = (gram ^ (gram >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        out += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
        if len(gram) < 2:
            break
    return out


@dataclass
class Model:
    """idf (buckets); centroids (n x buckets), their languages and least cosines."""
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    least: np.ndarray

    def vectors(self, tf: np.ndarray) -> np.ndarray:
        v = np.sqrt(tf).astype(np.float32) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def document_frequencies(docs: DataFrame, text_col: str = 'text') -> tuple[int, np.ndarray]:
    """Texts with letters, and in how many of them each bucket occurs: over all rows of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, df = 0, np.zeros(BUCKETS, np.int64)
        for _, texts in text_blocks(batches):
            for text in filter(has_letter, texts):
                total += 1
                df += counts(text) > 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.concatenate(([total], df)))],
                                         ['bucket', 'n'])

    parts = docs.select(F.lit(0).alias('k'), F.col(text_col)).mapInArrow(run, 'bucket long, n long')
    summed = dict(parts.groupBy('bucket').agg(F.sum('n').alias('n')).collect())  # BUCKETS + 1 rows
    return summed.get(-1, 0), np.array([summed.get(b, 0) for b in range(BUCKETS)], np.int64)


def _clusters(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from seeds drawn at random (fixed); equal cosines go to the first centroid."""
    centroids = x[np.random.default_rng(SEED).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(x @ centroids.T, axis=1)
        sums = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centroids, np.argmax(x @ centroids.T, axis=1)


def fit(docs: DataFrame, lang_col: str = 'lang', text_col: str = 'text', per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Learn from rows with a language and a text with letters.

    Frequencies come from all such rows; centroids from a sample of about
    ``per_language`` texts of each language. Rows with a null language or text
    are left out; without any row the model knows no language.
    """
    known = docs.select(F.col(lang_col).alias('lang'), F.col(text_col).alias('text')).where('lang is not null and text is not null')
    total, df = document_frequencies(known, 'text')
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)
    model = Model(idf, np.zeros((0, BUCKETS), np.float32), [], np.zeros(0))
    sizes = dict(known.groupBy('lang').count().collect())  # one row per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for langs, texts in text_blocks(batches):
            rows = [(lang, counts(t)) for lang, t in zip(langs, texts) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array(
                [np.minimum(r[1], 65535).astype(np.uint16).tobytes() for r in rows], pa.binary())], ['lang', 'tf'])

    drawn = known.sampleBy('lang', {k: min(1.0, per_language / n) for k, n in sizes.items()}, seed=5)
    rows = drawn.mapInArrow(run, 'lang string, tf binary').toPandas().sort_values(['lang', 'tf'])
    centroids, languages, least = [], [], []
    for lang, group in rows.groupby('lang'):
        x = model.vectors(np.stack([np.frombuffer(b, np.uint16) for b in group['tf']]))
        found, own = _clusters(x, CENTROIDS)
        close = (x * found[own]).sum(axis=1)
        for c in range(len(found)):
            if (own == c).any():
                centroids.append(found[c])
                languages.append(lang)
                least.append(float(np.quantile(close[own == c], REJECT_SHARE)))
    if centroids:
        model.centroids, model.languages, model.least = np.stack(centroids), languages, np.array(least)
    return model


def predict(docs: DataFrame, model: Model, id_col: str = 'doc_id', text_col: str = 'text', reject: bool = True) -> DataFrame:
    """Language of every whole text: (``id_col``, lang_pred, score 0 to 1, rejected).

    ``score`` is the cosine with the nearest centroid. Texts that are null or
    have no letter are ``und`` with score zero and rejected; so is every text
    if the model knows no language. Texts farther from the nearest centroid
    than its training texts are rejected: with ``reject`` they become ``und``
    too, without it they keep the nearest language. One row for each row in.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    plain, columns = plain_names(docs, id_col, text_col)
    source = plain.select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            names, scores, far = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            rows = [i for i, t in enumerate(texts) if m.languages and has_letter(t)]
            for at in range(0, len(rows), 512):
                some = rows[at:at + 512]
                cosine = m.vectors(np.stack([counts(texts[i]) for i in some])) @ m.centroids.T
                best = cosine.argmax(axis=1)
                top = cosine[np.arange(len(some)), best].astype(np.float64)
                scores[some] = np.clip(top, 0, 1)
                far[some] = top < m.least[best]
                for i, b in zip(some, best):
                    names[i] = UNKNOWN if reject and far[i] else m.languages[b]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores), pa.array(far)],
                                             [id_col, 'lang_pred', 'score', 'rejected'])

    return source.mapInArrow(run, f'`{id_col}` {source.schema[0].dataType.simpleString()}, lang_pred string, score double, rejected boolean')
