"""Language identification by a linear-chain conditional random field.

Every word gets a label. A word's score for a label sums learned weights of its character
n-grams, of its affixes (n-grams with the word's edge) and of its entry in a lexicon of frequent
training words; learned transitions join neighbouring words, so that a text may switch its
language anywhere. Forward-backward gives each word's probabilities; a text's language is the
label with the largest sum over its words. Chains have at most ``CHAIN`` words; a longer text is
a sequence of chains, all of which count.

Training runs in numpy on the driver over a bounded sample of documents, whose language labels
each of their words. Prediction is one pass over the texts; all chains of a slice advance in step.

Rows that repeat id and text count once in training; every row gets its prediction, repeated ones
the same; an empty table has no rows. Results: ``und`` with score 0 for a null text, a text without a letter, or if there was nothing
to learn from. Ties go to the label that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ratingmill.llm.base import held_out, in_arrow
from ratingmill.llm.text import LETTER, Words, words

#: Documents of each language that training takes at most, and bytes of their whole texts (the last
#: text may go beyond). Rows come in the order of a hash.
SAMPLE_DOCS = 200
SAMPLE_BYTES = 1 << 20
BUCKETS = 1 << 16
GRAMS = (2, 3, 4)
LEXICON_LEAST = 4
CHAIN = 64
EPOCHS = 4
RATE = 0.2
BATCH = 256
UNKNOWN = "und"
_ASCII_LETTER = re.compile(r"[A-Za-z]").search


def word_features(w: Words, pick: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words ``pick`` of a slice, all in a row, and where each word's begin."""
    size = w.end[pick] - w.start[pick] + 2
    begin = np.cumsum(size) - size
    flat = np.repeat(w.start[pick] - 1 - begin, size) + np.arange(int(size.sum()))
    byte = w.data[np.clip(flat, 0, len(w.data) - 1)].astype(np.uint64)
    byte[begin], byte[begin + size - 1] = 60, 62
    of = np.repeat(np.arange(len(pick)), size)
    ids, owner = [], []
    for g in GRAMS:
        m = len(byte) - g + 1
        if m < 1:
            continue
        h = byte[:m].copy()
        for k in range(1, g):
            h = (h << np.uint64(8)) | byte[k : k + m]
        inside = of[:m] == of[g - 1 :]
        ids.append((((h + np.uint64(g << 40)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)[inside])
        owner.append(of[:m][inside])
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, w.hash[pick]), len(lexicon) - 1)
        known = lexicon[at] == w.hash[pick]
        ids.append(BUCKETS + at[known])
        owner.append(np.flatnonzero(known))
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.searchsorted(owner[order], np.arange(len(pick)))


def chains(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, first word and length of each chain."""
    many = np.diff(first)
    parts = -(-many // CHAIN)
    doc = np.repeat(np.arange(len(many)), parts)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = first[:-1][doc] + nth * CHAIN
    return doc, start, np.minimum(CHAIN, first[1:][doc] - start)


def marginals(score: np.ndarray, step: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward over chains: ``score`` (chains, words, labels), ``step`` transitions.
    Returns the labels' probabilities and the expected transitions."""
    n, steps, labels = score.shape
    e = np.exp(score - score.max(2, keepdims=True))
    a = np.exp(step)
    on = np.arange(steps)[None, :] < length[:, None]
    forward = np.empty_like(e)
    now = np.full((n, labels), 1 / labels)
    for t in range(steps):
        now = (now @ a if t else now) * e[:, t]
        now /= now.sum(1, keepdims=True)
        forward[:, t] = now
    back = np.ones((n, labels))
    out, pairs = np.zeros_like(e), np.zeros((labels, labels))
    for t in range(steps - 1, -1, -1):
        joint = forward[:, t] * back
        joint /= joint.sum(1, keepdims=True)
        out[:, t] = joint * on[:, t, None]
        if t:
            ahead = e[:, t] * back
            both = forward[:, t - 1, :, None] * a[None] * ahead[:, None, :]
            both /= both.sum((1, 2), keepdims=True)
            pairs += (both * on[:, t, None, None]).sum(0)
            new = ahead @ a.T
            new /= new.sum(1, keepdims=True)
            back = np.where(on[:, t, None], new, 1.0)
    return out, pairs


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    steps: np.ndarray
    lexicon: np.ndarray

    def word_scores(self, w: Words) -> np.ndarray:
        _, pick, back = np.unique(w.hash, return_index=True, return_inverse=True)
        ids, begin = word_features(w, pick, self.lexicon)
        return np.add.reduceat(self.weights[ids], begin)[back]

    def predict(self, column: pa.Array) -> tuple[list[str], list[float]]:
        names, sure = [], []
        texts = column.to_pylist()
        for w in words(column, LETTER):
            total = np.zeros((w.high - w.low, max(1, len(self.labels))))
            if len(w.hash) and self.labels:
                doc, start, length = chains(w.first)
                at = np.minimum(start[:, None] + np.arange(int(length.max())), len(w.hash) - 1)
                p = forward_backward(self.word_scores(w)[at], self.steps, length)
                for k in range(total.shape[1]):
                    total[:, k] = np.bincount(doc, weights=p[:, k], minlength=len(total))
            many = np.maximum(np.diff(w.first), 1)
            best = total.argmax(1)
            for k, b in enumerate(best.tolist()):
                text = texts[w.low + k]
                real = self.labels and text and (_ASCII_LETTER(text) or any(map(str.isalpha, text)))
                names.append(self.labels[b] if real else UNKNOWN)
                sure.append(round(min(1.0, float(total[k, b] / many[k])), 6) if real else 0.0)
        return names, sure


def forward_backward(score: np.ndarray, step: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Sums over each chain of its words' label probabilities (no transition counts)."""
    n, steps, labels = score.shape
    e = np.ascontiguousarray(np.exp(score - score.max(2, keepdims=True)).transpose(1, 0, 2))
    a = np.exp(step)
    forward = np.empty_like(e)
    now = np.ones((n, labels))
    for t in range(steps):
        now = (now @ a if t else now) * e[t]
        now /= now.sum(1, keepdims=True)
        forward[t] = now
    back, total = np.ones((n, labels)), np.zeros((n, labels))
    for t in range(steps - 1, -1, -1):
        on = (t < length)[:, None]
        joint = forward[t] * back
        total += np.where(on, joint / joint.sum(1, keepdims=True), 0)
        if t:
            new = (e[t] * back) @ a.T
            back = np.where(on, new / new.sum(1, keepdims=True), 1.0)
    return total


def train(texts: list[str], langs: list[str], seed: int = 1) -> Model:
    """Fits weights and transitions by stochastic gradient ascent of the labels' likelihood."""
    labels = sorted(set(langs))
    if not labels:
        return Model([], np.zeros((BUCKETS, 1)), np.zeros((1, 1)), np.zeros(0, np.uint64))
    of = {x: k for k, x in enumerate(labels)}
    parts = list(words(pa.array(texts, pa.large_string()), LETTER))
    names, many = np.unique(np.concatenate([w.hash for w in parts]), return_counts=True)
    often = many >= LEXICON_LEAST
    lexicon = names[often]  # ascending; the sample bounds them
    weights = np.zeros((BUCKETS + len(lexicon), len(labels)))
    square, steps, square_steps = np.full_like(weights, 1e-8), np.eye(len(labels)), np.full((len(labels),) * 2, 1e-8)
    rng = np.random.default_rng(seed)
    made = []
    for w in parts:
        if not len(w.hash):
            continue
        ids, begin = word_features(w, np.arange(len(w.hash)), lexicon)
        doc, start, length = chains(w.first)
        gold = np.array([of[langs[w.low + d]] for d in doc.tolist()])
        made.append((ids, np.append(begin, len(ids)), start, length, gold))
    for epoch in range(EPOCHS):
        for ids, begin, start, length, gold in made:
            for rows in np.array_split(rng.permutation(len(start)), -(-len(start) // BATCH)):
                span = int(length[rows].max())
                at = np.minimum(start[rows, None] + np.arange(span), len(begin) - 2)
                flat = at.ravel()
                size = begin[flat + 1] - begin[flat]
                own = np.repeat(begin[flat] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                feature = ids[own]
                place = np.repeat(np.arange(len(flat)), size)
                score = np.stack([np.bincount(place, weights=weights[feature, k], minlength=len(flat)) for k in range(len(labels))], 1)
                p, pairs = marginals(score.reshape(*at.shape, -1), steps, length[rows])
                on = (np.arange(span)[None, :] < length[rows, None])[..., None]
                want = np.zeros_like(p)
                np.put_along_axis(want, gold[rows][:, None, None].repeat(span, 1), 1.0, 2)
                pull = ((want * on) - p).reshape(-1, len(labels))
                for k in range(len(labels)):
                    g = np.bincount(feature, weights=pull[place, k], minlength=len(weights))
                    square[:, k] += g * g
                    weights[:, k] += RATE * g / np.sqrt(square[:, k]) * (g != 0)
                g = np.diag(np.bincount(gold[rows], weights=length[rows] - 1, minlength=len(labels)).astype(float)) - pairs
                square_steps += g * g
                steps += RATE * 0.2 * g / np.sqrt(square_steps)
    return Model(labels, weights, np.clip(steps, -6, 6), lexicon)


def fit(docs: DataFrame, most: int = SAMPLE_DOCS) -> Model:
    """A model from rows that have a language and aren't held out: at most ``most`` different documents of
    each language, with whole texts of at most about ``SAMPLE_BYTES``, chosen by a hash of id and text."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    known = known.select("lang", "text", F.xxhash64("doc_id", "text").alias("turn"))
    count = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("turn").alias("n")).collect()}
    share = F.lit(0.0)
    for lang, n in count.items():
        share = F.when(F.col("lang") == lang, min(1.0, 2.0 * most / n)).otherwise(share)
    picked = known.where(F.pmod("turn", F.lit(1_000_000)) < share * 1_000_000).groupBy("lang", "turn").agg(F.min("text").alias("text"))
    order = Window.partitionBy("lang").orderBy(F.pmod("turn", F.lit(1_000_000)), "turn")
    size = F.octet_length("text")
    picked = picked.withColumn("nth", F.row_number().over(order)).withColumn("before", F.sum(size).over(order) - size)
    rows = picked.where((F.col("nth") <= most) & (F.col("before") < SAMPLE_BYTES)).select("lang", "text", "turn").collect()
    rows.sort(key=lambda r: (r["lang"], r["turn"]))
    return train([r["text"] for r in rows], [r["lang"] for r in rows])


def predict(docs: DataFrame, keep: list[str], model: Model) -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``lang_pred`` and ``score``, from the texts alone.
    One row for each row, without a shuffle; the model's size is bounded by its parameters."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, sure = held.value.predict(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(sure, pa.float64())], [*keep, "lang_pred", "score"])

    return in_arrow(docs.select(*keep, docs["text"].alias("__text")), run, f"{types}, lang_pred string, score double")
