"""Quality rules: fixed limits, then robust multivariate outliers.

Each document's statistics become a vector of ``DIMENSIONS`` transformed values. For each language
and source a minimum-covariance-determinant estimate (centre and covariance of the most compact
``CORE`` of its documents) comes from concentration steps: distances under the last estimate, their
quantile in each group, and the moments of the documents below it. Every step is one aggregation
over all documents, with partial sums before the shuffle, so a hot source costs no more than
others. Documents beyond ``CUTOFF`` in squared Mahalanobis distance are rejected.

Results: null and empty texts have zero statistics and fail the base rule for few words. A null
language or source is a group of its own. Documents that fail the base take no part in the
estimates. A group's centre and covariance are drawn towards those of its language, and these towards those of
all documents, with a weight that falls as the core grows: ``PRIOR`` documents of the wider pool stand beside the group's own.
So a group of a few documents is judged by what its language does, one of thousands by itself. Variances have
floors, so that documents that all agree in a statistic don't reject one that differs a little. Ties
at a quantile are all in the core. Repeated rows each keep their row and each count. Results don't depend
on how rows are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ratingmill.llm.base import in_arrow, settle, small
from ratingmill.llm.text import SPACED, runs, words

WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
DIMENSIONS = 5
CORE = 0.75
STEPS = 4
#: Documents that the wider pool's estimate counts for beside a pool's own.
PRIOR = 200
#: The pool of all documents; names of other pools start with their kind and end in JSON.
ALL = "all"
#: Groups up to which their tables are broadcast.
BROADCAST_ROWS = 10_000
#: Squared distance; for normal data one in 10^9 lies beyond.
CUTOFF = 52.0
#: Consistency factor of the covariance of the most compact three quarters, five dimensions.
CONSISTENCY = 1.52
#: Smallest standard deviations of the transformed values, in their order below.
FLOORS = (0.5, 0.15, 0.03, 0.06, 0.08)
#: Transformed values and logarithms of distances are whole multiples of 1 / GRID, so that quantiles
#: have few candidates and sums don't depend on the order of rows.
GRID = 10_000
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True


def repeated(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows that occur twice or more."""
    if len(hashes) <= width:
        return 0
    _, back, many = np.unique(runs(hashes, width), return_inverse=True, return_counts=True)
    again = np.flatnonzero(many[back] > 1)
    if not len(again):
        return 0
    edge = np.zeros(len(hashes) + 1, np.int64)
    edge[again] += 1
    edge[again + width] -= 1
    return int(np.count_nonzero(np.cumsum(edge)))


def duplicate_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.split()]
    return len(lines) - len(set(lines))


def statistics(column: pa.Array) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    out = []
    for w in words(column, SPACED, fold=False):
        begin, n = w.text[:-1], w.high - w.low
        lead = (w.data & 0xC0) != 0x80  # one for each code point
        total = lambda on: np.diff(np.concatenate([[0], np.cumsum(on)])[w.text])
        rows = np.zeros((5, n), np.int64)
        rows[0] = np.diff(w.first)
        rows[1] = total(lead & SPACED[w.data])
        rows[2] = total(_IS_SYMBOL[w.data])
        raw = w.data.tobytes()
        for k in range(n):
            if rows[0, k]:
                rows[3, k] = duplicate_lines(raw[begin[k] : w.text[k + 1]])
                rows[4, k] = repeated(w.hash[w.first[k] : w.first[k + 1]])
        out.append(rows)
    return list(np.concatenate(out, 1)) if out else [np.zeros(0, np.int64)] * 5


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the five statistics of each whole text."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [pa.array(x) for x in statistics(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], [*keep, *NAMES])

    return in_arrow(docs.select(*keep, docs["text"].alias("__text")), run, types + "".join(f", {n} long" for n in NAMES))


def vector() -> list["F.Column"]:
    """The transformed values: length, word length, and square roots of shares."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    values = [
        F.log1p("n_words"),
        F.log1p(F.col("word_chars") / n),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    ]
    return [F.round(v * GRID).cast("long") / GRID for v in values]


def _invert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centre and inverse covariance from count, sums and sums of products."""
    floor = np.diag(np.square(FLOORS))
    for batch in batches:
        n, sums, products = (batch.column(k).to_pylist() for k in (1, 2, 3))
        centres, inverses = [], []
        for m, s, p in zip(n, sums, products, strict=True):
            centre = np.array(s) / m
            cov = np.zeros((DIMENSIONS, DIMENSIONS))
            cov[np.triu_indices(DIMENSIONS)] = np.array(p) / m
            cov = cov + cov.T - np.diag(np.diag(cov)) - np.outer(centre, centre)
            centres.append(centre.tolist())
            inverses.append(np.linalg.inv(cov * CONSISTENCY + floor).ravel().tolist())
        kind = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(centres, kind), pa.array(inverses, kind)], ["group", "n", "centre", "inverse"])


def distance(x: "F.Column", centre: "F.Column", inverse: "F.Column") -> "F.Column":
    total = F.lit(0.0)
    d = [x[k] - centre[k] for k in range(DIMENSIONS)]
    for i in range(DIMENSIONS):
        for j in range(DIMENSIONS):
            total = total + d[i] * d[j] * inverse[DIMENSIONS * i + j]
    return total


def pools(counts: DataFrame) -> DataFrame:
    """``group`` and the ``pools`` that it is part of, widest first."""
    return counts.select("group", F.array(F.lit(ALL), "language", "group").alias("pools"))


def shrunk(groups: DataFrame, known: DataFrame) -> DataFrame:
    """``group, centre, inverse``: each group's estimate, drawn towards those of its wider pools. Rows are groups."""
    rows = groups.select("group", F.posexplode("pools").alias("nth", "pool"))
    rows = rows.join(known.withColumnRenamed("group", "pool"), "pool")
    rows = rows.groupBy("group").agg(F.array_sort(F.collect_list(F.struct("nth", "n", "centre", "inverse"))).alias("wider"))  # three at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float64())
        for batch in batches:
            centres, inverses = [], []
            for wider in batch.column(1).to_pylist():
                centre, cov = None, None
                for e in wider:
                    own, spread = np.array(e["centre"]), np.linalg.inv(np.array(e["inverse"]).reshape(DIMENSIONS, DIMENSIONS))
                    w = 1.0 if centre is None else e["n"] / (e["n"] + PRIOR)
                    centre, cov = (own, spread) if w == 1.0 else (w * own + (1 - w) * centre, w * spread + (1 - w) * cov)
                centres.append(centre.tolist())
                inverses.append(np.linalg.inv(cov).ravel().tolist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(centres, kind), pa.array(inverses, kind)], ["group", "centre", "inverse"])

    return rows.mapInArrow(run, "group string, centre array<double>, inverse array<double>")


def estimate(points: DataFrame) -> DataFrame:
    """``group, n, centre, inverse`` for the groups of ``points`` (``group``, ``x``)."""
    x = [F.col("x")[k] for k in range(DIMENSIONS)]
    near = lambda df: small(settle(df), BROADCAST_ROWS)
    middle = lambda c: F.percentile(F.round(c * GRID), F.lit(0.5)) / GRID
    start = near(points.groupBy("group").agg(F.array(*[middle(c) for c in x]).alias("centre")))
    spread = points.join(start, "group").select("group", *[F.abs(c - F.col("centre")[k]).alias(f"d{k}") for k, c in enumerate(x)])
    spread = spread.groupBy("group").agg(F.array(*[middle(F.col(f"d{k}")) for k in range(DIMENSIONS)]).alias("mad"))
    scale = lambda k: 1 / (F.pow(1.4826 * F.col("mad")[k], F.lit(2.0)) + FLOORS[k] ** 2)
    cells = [scale(i) if i == j else F.lit(0.0) for i in range(DIMENSIONS) for j in range(DIMENSIONS)]
    now = near(spread.join(start, "group").select("group", "centre", F.array(*cells).alias("inverse")))
    whole = [F.round(c * GRID).cast("long") for c in x]
    moments = [F.count("*").alias("n"), F.array(*[F.sum(c) / GRID for c in whole]).alias("sums")]
    products = [F.sum((whole[i] * whole[j]).cast("decimal(20,0)")).cast("double") / GRID**2 for i in range(DIMENSIONS) for j in range(i, DIMENSIONS)]
    moments.append(F.array(*products).alias("products"))
    for _ in range(STEPS):
        away = distance(F.col("x"), F.col("centre"), F.col("inverse"))
        far = points.join(now, "group").select("group", "x", F.round(F.log1p(F.greatest(away, F.lit(0.0))) * GRID).cast("long").alias("far"))
        edge = near(far.groupBy("group").agg(F.percentile("far", F.lit(CORE)).alias("edge")))
        core = far.join(edge, "group").where("far <= edge").groupBy("group").agg(*moments)
        now = near(core.mapInArrow(_invert, "group string, n long, centre array<double>, inverse array<double>"))
    return now


def judge(docs: DataFrame) -> DataFrame:
    """For each row of ``docs`` (``doc_id, text, lang, source``) its statistics, ``base_failed``, ``kept``
    and ``distance`` (squared; null only where all documents fail the base)."""
    measured = settle(measure(docs.select("doc_id", "text", "lang", "source"), ["doc_id", "lang", "source"]))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    group = F.concat(F.lit("group "), F.to_json(F.struct("lang", "source"))).alias("group")
    language = F.concat(F.lit("language "), F.to_json(F.struct("lang"))).alias("language")
    measured = measured.select("doc_id", *NAMES, failed.alias("base_failed"), group, language, F.array(*vector()).alias("x"))
    counts = measured.select("group", "language").distinct()
    groups = settle(pools(counts))
    points = measured.where("not base_failed").join(small(groups, BROADCAST_ROWS), "group").select(F.explode("pools").alias("group"), "x")
    known = small(settle(shrunk(groups, estimate(points))), BROADCAST_ROWS)
    out = measured.join(known, "group", "left")
    out = out.withColumn("distance", distance(F.col("x"), F.col("centre"), F.col("inverse")))
    kept = ~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)
    return out.select("doc_id", *NAMES, "base_failed", kept.alias("kept"), F.round("distance", 3).alias("distance"))
