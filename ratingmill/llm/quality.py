"""Quality classifier: supervised subword embeddings.

Words, pairs of words (with one feature for a word that repeats the one before it) and character
n-grams are hashed to rows of an embedding table; a document's vector is the mean over all of its
features, and a softmax layer over it gives the classes. Both layers are learned by stochastic
gradient descent in numpy on the driver, in small batches of whole texts of a bounded sample of labelled rows. For scoring,
the two layers multiply out to one number for each row of the table, so a document of any length
is scored whole by summing table entries over its bytes and words.

Of rows that repeat a labelled ``doc_id`` training takes the smallest text, of labels that repeat one the
larger. Every row gets its score, repeated ones the same; an empty table has no rows. Results: an empty or null text has no features and gets the score of the bias alone. Without any
labelled row of both classes every score is the share of label 1 (1 without labels).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingmill.llm.base import held_out, in_arrow
from ratingmill.llm.text import SLICE, SPACED, mix, words

#: Labelled documents of each class that training takes at most, and bytes of their whole texts (the
#: last text may go beyond). Rows come in the order of a hash.
SAMPLE_DOCS = 1500
SAMPLE_BYTES = 24 << 20
#: Documents of one step of gradient descent.
BATCH = 8
BUCKETS = 1 << 17
SIZE = 8
EPOCHS = 10
RATE = 5.0
THRESHOLD = 0.3
GRAMS = (3, 4)
_SAME = 7


def features(column: pa.Array, size: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For parts of a batch: rows of the table, the documents they are of, and how many
    documents the part has. Repeated features come repeatedly."""
    mask = np.uint64(BUCKETS - 1)
    for w in words(column, SPACED, fold=False, size=size):
        n = w.high - w.low
        doc_of_byte = np.repeat(np.arange(n), np.diff(w.text))
        doc_of_word = np.repeat(np.arange(n), np.diff(w.first))
        rows, docs = [mix(w.hash) & mask], [doc_of_word]
        if len(w.hash) > 1:
            pair = mix(w.hash[:-1] * np.uint64(3) + w.hash[1:] * np.uint64(5))
            pair = np.where(w.hash[:-1] == w.hash[1:], np.uint64(_SAME), pair & mask)
            inside = doc_of_word[1:] == doc_of_word[:-1]
            rows.append(pair[inside])
            docs.append(doc_of_word[1:][inside])
        byte = w.data.astype(np.uint64)
        for g in GRAMS:
            if len(byte) < g:
                continue
            m = len(byte) - g + 1
            h = byte[:m].copy()
            for k in range(1, g):
                h = (h << np.uint64(8)) | byte[k : k + m]
            h = (h * np.uint64(0x9E3779B97F4A7C15 + 2 * g)) >> np.uint64(40)
            inside = doc_of_byte[:m] == doc_of_byte[g - 1 :]
            rows.append((h & mask)[inside])
            docs.append(doc_of_byte[:m][inside])
        yield np.concatenate(rows).astype(np.int64), np.concatenate(docs), n


@dataclass
class Model:
    """``entry`` for each row of the table, to be averaged, and the bias: a log odds of label 1."""

    entry: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        out = []
        for rows, docs, n in features(column):
            many = np.bincount(docs, minlength=n)
            total = np.bincount(docs, weights=self.entry[rows], minlength=n)
            out.append(1 / (1 + np.exp(-(total / np.maximum(many, 1) + self.bias))))
        return np.round(np.concatenate(out), 6) if out else np.zeros(0)


def train(texts: list[str], labels: list[int], prior: float, seed: int = 1) -> Model:
    """Fits the table and the softmax; ``prior`` is label 1's share of all labelled rows."""
    y = np.array(labels)
    if len(y) == 0 or y.min() == y.max():
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS), float(np.log(p / (1 - p))))
    docs = []
    for rows, of, n in features(pa.array(texts, pa.large_string()), SLICE >> 2):
        order = np.argsort(of, kind="stable")
        for part in np.split(rows[order], np.searchsorted(of[order], np.arange(1, n))):
            ids, many = np.unique(part, return_counts=True)
            docs.append((ids.astype(np.int32), (many / max(1, len(part))).astype(np.float32)[:, None]))
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32)
    top, bias = rng.normal(0, 0.1, (SIZE, 2)).astype(np.float32), np.zeros(2, np.float32)
    moved = np.full(BUCKETS, 1e-8, np.float32)  # squared steps of each row so far, which slow it down
    batches = [_batch([docs[k] for k in part], y[part]) for part in np.array_split(rng.permutation(len(docs)), -(-len(docs) // BATCH))]
    del docs  # held by the batches now
    steps = EPOCHS * len(batches)
    for step in range(steps):
        if step % len(batches) == 0:
            order = rng.permutation(len(batches))
        ids, share, first, of, rows, turn, label = batches[order[step % len(batches)]]
        rate = RATE * (1 - step / steps)
        # an empty text has no part in the sums
        vector = np.zeros((len(label), SIZE), np.float32)
        if len(ids):
            vector[np.unique(of)] = np.add.reduceat(table[ids] * share, first)
        odds = vector @ top + bias
        odds = np.exp(odds - odds.max(1, keepdims=True))
        error = odds / odds.sum(1, keepdims=True)
        error[np.arange(len(label)), label] -= 1
        back = error @ top.T
        top -= rate * 0.1 * vector.T @ error / len(label)
        bias -= rate * 0.1 * error.mean(0)
        if len(ids):
            pull = np.add.reduceat((share * back[of])[turn], rows[1])
            moved[rows[0]] += np.square(pull).sum(1)
            table[rows[0]] -= 0.1 * rate * pull / np.sqrt(moved[rows[0]])[:, None]
    ones = y.mean()
    p = min(max(prior, 1e-6), 1 - 1e-6)
    shift = np.log(p / (1 - p)) - np.log(ones / (1 - ones))
    return Model((table @ (top[:, 1] - top[:, 0])).astype(np.float64), float(bias[1] - bias[0] + shift))


def _batch(docs: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray) -> tuple:
    """Rows of the table and shares of some documents in a row, where each document's begin and whose they
    are; the different rows with where each begins in the order ``turn``; and the labels."""
    size = np.array([len(ids) for ids, _ in docs])
    of = np.repeat(np.arange(len(docs), dtype=np.uint8), size)  # BATCH is small
    ids, share = np.concatenate([x for x, _ in docs]), np.concatenate([x for _, x in docs])
    turn = np.argsort(ids, kind="stable").astype(np.int32)
    rows, begin = np.unique(ids[turn], return_index=True)
    return ids, share, (np.cumsum(size) - size)[size > 0], of, (rows, begin.astype(np.int32)), turn, label


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_DOCS) -> Model:
    """A model of ``labels.quality`` from rows that aren't held out, at most ``most`` of each class, with
    whole texts of at most about ``SAMPLE_BYTES``, chosen by a hash of their ids."""
    known = docs.select("doc_id", F.octet_length("text").alias("bytes")).where(~held_out(F.col("doc_id"))).join(
        labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("label")), "doc_id"
    )
    known = known.select("doc_id", "label", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).alias("turn"))
    count, share = {}, F.lit(0.0)
    for label, n, ids in known.groupBy("label").agg(F.count("*"), F.approx_count_distinct("doc_id")).collect():
        count[label] = n
        share = F.when(F.col("label") == label, min(1.0, 1.3 * most / max(1, ids))).otherwise(share)
    # ids first, so that texts are read where they lie and only the sample's move; rows of one id are one
    near = known.where(F.col("turn") < share * 1_000_000).groupBy("doc_id", "label", "turn").agg(F.max("bytes").alias("bytes"))
    order = Window.partitionBy("label").orderBy("turn", "doc_id")
    near = near.withColumn("nth", F.row_number().over(order)).withColumn("before", F.sum("bytes").over(order) - F.col("bytes"))
    picked = near.where((F.col("nth") <= most) & (F.col("before") < SAMPLE_BYTES // 2)).select("doc_id", "label")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    rows = texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    total = sum(count.values())
    return train([r["text"] for r in rows], [r["label"] for r in rows], count.get(1, 0) / total if total else 1.0)


def score(docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``score`` and ``predicted``; one row for each row,
    without a shuffle. The model has a fixed size and is broadcast."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = held.value.scores(batch.column(batch.num_columns - 1))
            new = [pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*keep, "score", "predicted"])

    return in_arrow(docs.select(*keep, docs["text"].alias("__text")), run, f"{types}, score double, predicted int")
