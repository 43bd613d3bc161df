"""Toxicity as severity grades by cumulative-link ordinal regression over sparse words.

P(grade > k) = 1 / (1 + exp(threshold_k - w.x)): one weight for each word, shared by all
thresholds, which are ordered. Reported is the expected severity, the sum of P(grade > k).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from treeloom.llm._words import words

#: Labelled rows that the model is fitted on at most: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: Words are known by so many bits of their hash (words that share them share a weight), MOST_WORDS of them at most have a
#: weight; words of grade counts less telling than LEAST_Z standard errors get no weight.
BITS, LEAST_Z, LEAST_DOCS, MOST_WORDS = 18, 3.9, 4, 4096
#: High rows in either half of the labelled rows from which yes-or-no labels are graded; with fewer there are two grades.
LEAST_HIGH = 50
RIDGE, STEPS, RATE = 1e-5, 800, 0.1


@dataclass
class Model:
    weight: np.ndarray  # of 2 ** BITS words
    thresholds: np.ndarray

    def beyond(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) of each score (row) and k (column)."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -50, 50)))


def _slots(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, row, slot), each word of a row once; only wanted slots, if given."""
    for b in words(column):
        slot = (b.hash >> np.uint64(64 - BITS)).astype(np.int64)
        row = b.row
        if wanted is not None:
            keep = wanted[slot]
            slot, row = slot[keep], row[keep]
        both = np.unique((row.astype(np.int64) << BITS) | slot)
        yield b.first, b.rows, both >> BITS, both & ((1 << BITS) - 1)


def _fit_links(rows: list[np.ndarray], grade: np.ndarray, weight_of: np.ndarray, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds of a cumulative-link model on sparse 0/1 rows; full-batch Adam, no randomness."""
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    column = weight_of[np.concatenate(rows)] if len(rows) else np.empty(0, np.int64)
    owner, column = owner[column >= 0], column[column >= 0]
    levels = int(grade.max())
    share = np.array([np.clip((grade > k).mean(), 1e-4, 1 - 1e-4) for k in range(levels)])
    start = np.log((1 - share) / share)
    # thresholds are first + running sum of exp(gap): ordered whatever the parameters
    gaps = np.log(np.maximum(np.diff(start), 1e-2))
    p = np.concatenate([np.zeros(columns), start[:1], gaps])
    m = np.zeros_like(p)
    v = np.zeros_like(p)
    n = len(rows)
    for step in range(1, STEPS + 1):
        w, first, steps_ = p[:columns], p[columns], np.exp(p[columns + 1 :])
        theta = first + np.concatenate([[0.0], np.cumsum(steps_)])
        score = np.bincount(owner, w[column], minlength=n)
        s = 1 / (1 + np.exp(np.clip(theta[None, :] - score[:, None], -50, 50)))
        upper = np.concatenate([np.ones((n, 1)), s], axis=1)  # P(grade >= k)
        lower = np.concatenate([s, np.zeros((n, 1))], axis=1)  # P(grade > k)
        at = np.arange(n)
        hi, lo = upper[at, grade], lower[at, grade]
        prob = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / prob, lo * (1 - lo) / prob
        g_score = (d_hi - d_lo) / n
        g_theta = np.array([(-d_hi[grade == k + 1].sum() + d_lo[grade == k].sum()) / n for k in range(levels)])
        g = np.concatenate([np.bincount(column, g_score[owner], minlength=columns) - RIDGE * w, [g_theta.sum()], [g_theta[j + 1 :].sum() * steps_[j] for j in range(levels - 1)]])
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        p = p + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return p[:columns], p[columns] + np.concatenate([[0.0], np.cumsum(np.exp(p[columns + 1 :]))])


def _signed_root(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signed root of the likelihood ratio of words in a of n texts here and in b of m there."""
    share = (a + b) / (n + m)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(expected, 1e-12)), 0.0)

    g = part(a, n * share) + part(b, m * share) + part(n - a, n * (1 - share)) + part(m - b, m * (1 - share))
    return np.sqrt(np.maximum(0, 2 * g)) * np.sign(a / n - b / m)


def _telling(rows: list[np.ndarray], high: np.ndarray) -> np.ndarray:
    """The slots, MOST_WORDS at most, that tell the rows of high from the others, the most telling first."""
    of = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    in_high = np.bincount(of[high[owner]], minlength=1 << BITS)
    in_low = np.bincount(of[~high[owner]], minlength=1 << BITS)
    z = _signed_root(in_high, in_low, int(high.sum()), int((~high).sum()))
    z[in_high + in_low < LEAST_DOCS] = 0
    telling = np.flatnonzero(np.abs(z) >= LEAST_Z)
    return telling[np.argsort(-np.abs(z[telling]), kind="stable")][:MOST_WORDS]


def _linked(rows: list[np.ndarray], grade: np.ndarray) -> Model:
    """The cumulative-link model of the telling words."""
    weight, high = np.zeros(1 << BITS), grade > 0
    telling = _telling(rows, high)
    if not len(telling):
        return Model(weight, np.array([np.log((~high).sum() / high.sum())]))
    column = np.full(1 << BITS, -1, np.int64)
    column[telling] = np.arange(len(telling))
    weight[telling], thresholds = _fit_links(rows, grade, column, len(telling))
    return Model(weight, thresholds)


def _cross_graded(rows: list[np.ndarray], high: np.ndarray) -> np.ndarray:
    """Grades 0, 1 and 2 of yes-or-no labels.

    Rows are dealt to two halves; each half is scored by a model that has seen the other half only, and of its high rows
    those above their median score have grade 2. So no row's grade comes from a model that it helped to fit.
    """
    grade, half = high.astype(np.int64), np.arange(len(rows)) % 2
    for k in (0, 1):
        seen = half != k
        if high[seen].sum() < LEAST_HIGH or high[seen].all():
            return high.astype(np.int64)
        model = _linked([r for r, s in zip(rows, seen, strict=True) if s], high[seen].astype(np.int64))
        score = np.array([model.weight[r].sum() for r in rows])
        own = high & (half == k)
        if own.any():
            grade[own & (score > np.median(score[own]))] = 2
    return grade if (grade == 1).any() and (grade == 2).any() else high.astype(np.int64)


def fit(rows: list[np.ndarray], grade: np.ndarray) -> Model:
    """rows: sorted distinct slots of each labelled text. Without two grades nothing is learned: all scores are zero.

    Labels that only say yes or no are graded by cross-fitting.
    """
    if not len(rows) or grade.max() == 0 or grade.min() > 0:
        return Model(np.zeros(1 << BITS), np.array([50.0]))
    return _linked(rows, _cross_graded(rows, grade > 0) if grade.max() == 1 else grade)


def learn(docs: DataFrame, labels: DataFrame, grade: str = "grade", text: str = "text", id: str = "doc_id") -> Model:
    """Fits on SAMPLE labelled rows at most; labels(id, grade): 0, 1, 2, ...; null grades, ids and texts don't count.

    Of rows that repeat an id the largest grade and one text count, the one whose sorted word hashes are the largest.
    """
    wanted = labels.where(F.col(grade).isNotNull() & F.col(id).isNotNull()).groupBy(F.col(id).alias("__id")).agg(F.max(grade).cast("int").alias("__grade"))
    wanted = wanted.orderBy(F.xxhash64("__id"), "__id").limit(SAMPLE)
    rows = docs.where(F.col(text).isNotNull()).join(F.broadcast(wanted), F.col(id) == F.col("__id")).select("__id", "__grade", F.col(text).alias("__text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [b""] * batch.num_rows
            for first, n, row, slot in _slots(batch.column("__text")):
                at = np.searchsorted(row, np.arange(n + 1))
                for r in range(n):
                    out[first + r] = slot[at[r] : at[r + 1]].astype(np.int32).tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("__grade"), pa.array(out, pa.binary())], names=["id", "grade", "slots"])

    found = rows.mapInArrow(find, T.StructType([T.StructField("id", rows.schema["__id"].dataType), T.StructField("grade", T.IntegerType()), T.StructField("slots", T.BinaryType())]))
    got = {r["id"]: (r["grade"], r["slots"]) for r in sorted(found.collect(), key=lambda r: r["slots"])}
    ids = sorted(got, key=str)
    return fit([np.frombuffer(got[i][1], np.int32).astype(np.int64) for i in ids], np.array([max(0, got[i][0]) for i in ids], np.int64))


def grade(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all, if not given) with severity (expected grade), grade (most of its mass lies at or
    above it) and toxic (grade 1 or more) of every whole text.

    Null and empty texts have grade 0 and severity 0; repeated rows get the same result each; input columns named as
    those added are replaced. A tie between grades goes to the lower one.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("severity", "grade", "toxic")]
    rows = docs.select(*keep, F.col(text).alias("__text"))
    held = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(model.weight), model.weight[model.weight != 0], model.thresholds))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, thresholds = held.value
        weight, wanted = np.zeros(1 << BITS), np.zeros(1 << BITS, bool)
        weight[at], wanted[at] = values, True
        own = Model(weight, thresholds)
        for batch in batches:
            score, some = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for first, n, row, slot in _slots(batch.column("__text"), wanted):
                score[first : first + n] = np.bincount(row, weight[slot], minlength=n)
            some[:] = [len(t.as_buffer() or b"") > 0 if t.is_valid else False for t in batch.column("__text")]
            beyond = own.beyond(score) * some[:, None]
            kept = batch.drop_columns(["__text"])
            level = (beyond > 0.5).sum(axis=1)
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(beyond.sum(axis=1)), pa.array(level.astype(np.int32)), pa.array(level > 0)], names=[*kept.schema.names, "severity", "grade", "toxic"])

    return rows.mapInArrow(find, T.StructType([f for f in rows.schema.fields if f.name != "__text"]).add("severity", "double").add("grade", "integer").add("toxic", "boolean"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text")
    return grade(docs, learn(docs, labels.select("doc_id", (F.col("toxic") > 0).cast("int").alias("grade"))), keep=["doc_id"])
