"""Toxicity by a counterfactual-regularised classifier.

Words and their leading letters are the marks of a text. Marks that go with the label are
chosen by a test over all labelled rows; a logistic model is fitted on a bounded
sample of them. Of sentences that name a group, a copy that names another group instead is made,
and differences between the scores of the two are penalised, so a neutral mention of a
group does not count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from rareflow.llm.common import Shelf, add_columns, shielded, small_batches

WORD = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: terms that may take each other's place in a sentence
IDENTITY = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("frauen", "männer"),
    ("femmes", "hommes"), ("mujeres", "hombres"),
    ("muslims", "christians", "jews", "hindus", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "atheist"),
    ("black", "white", "asian", "latino"), ("gay", "straight"), ("lesbian", "heterosexual"),
    ("immigrants", "natives"), ("disabled", "healthy"), ("old", "young"))
PREFIXES = (4, 5)            # leading letters that are marks of their own
CACHE_WORDS = 300_000        # words whose marks a task remembers


def marks_of(word: str) -> list[str]:
    return [word, *(word[:k] + "*" for k in PREFIXES if len(word) > k)]


def words_of(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float

    def scorer(self):
        """text -> score; the weight of a word's marks is looked up once per task."""
        weights, known = self.weights, {}

        def marks(word: str) -> tuple[str, ...]:
            found = known.get(word)
            if found is None:
                found = tuple(m for m in marks_of(word) if m in weights)
                if len(known) < CACHE_WORDS:
                    known[word] = found
            return found

        def score(text: str | None) -> float:
            present = {m for w in words_of(text) for m in marks(w)}
            total = self.bias + sum(weights[m] for m in sorted(present))
            return float(1 / (1 + np.exp(-min(max(total, -500.0), 500.0))))

        return score


@dataclass(frozen=True)
class ToxicityClassifier:
    """Learns from labelled texts and scores any.

    Rows without a text or label teach nothing; null and empty texts are scored by the bias alone.
    Very long texts count whole, each mark once. Rows labelled twice count twice. Ties among
    marks go to the smaller text. With no labelled row, or one class only, every score
    is the smoothed share of label 1 (one half with none). Columns named like a new one
    are replaced.
    """

    sample_rows: int = 20_000    # labelled rows the weights are fitted on; marks come from all
    marks: int = 1_000           # marks of the model
    least: int = 5               # documents a mark must occur in
    evidence: float = 24.0       # of the likelihood-ratio test
    penalty: float = 0.01
    fairness: float = 10.0       # weight of score changes under swaps
    threshold: float = 0.3
    identity: tuple[tuple[str, ...], ...] = IDENTITY

    def fit(self, labelled: DataFrame) -> ToxicityModel:
        """``labelled``: id, text, label (0 or 1)."""
        small_batches(labelled.sparkSession)
        shelf = Shelf(labelled.sparkSession)
        # read three times, joined once
        labelled = shelf.keep(labelled.where("text is not null and label is not null"), "labelled")
        model = self._fitted(labelled)
        shelf.forget(shelf.paths)
        return model

    def _fitted(self, labelled: DataFrame) -> ToxicityModel:
        totals = labelled.agg(F.count("*").alias("n"), F.sum("label").alias("ones")).first()
        n, ones = totals["n"], totals["ones"] or 0
        start = float(np.log((ones + 1) / (n - ones + 1)))
        if not ones or ones == n:
            return ToxicityModel({}, start)
        chosen = self._choose(labelled, n, ones)
        place = {m: i for i, m in enumerate(chosen)}
        rows = self._sample(labelled, place).collect()   # at most sample_rows short lists
        if not rows:
            return ToxicityModel({}, start)
        rows.sort(key=lambda r: (r["id"], r["label"], r["marks"]))
        weights, bias = self._solve(rows, len(chosen), start)
        return ToxicityModel({m: float(weights[i]) for m, i in place.items()}, bias)

    def _choose(self, labelled: DataFrame, n: int, ones: int) -> list[str]:
        """Marks that go with the label, by a likelihood-ratio test over all rows."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
                for text, label in zip(*batch.columns, strict=True):
                    words = words_of(text.as_py())
                    seen[int(label.as_py())].update({m for w in words for m in marks_of(w)})
                both = sorted(seen[0].keys() | seen[1].keys())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both, pa.string()), pa.array([seen[0][m] for m in both], pa.int64()),
                     pa.array([seen[1][m] for m in both], pa.int64())],
                    names=["mark", "zero", "one"])

        counts = (labelled.select("text", "label")
                  .mapInArrow(run, "mark string, zero long, one long")
                  .groupBy("mark").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")))
        rate, zero, one = ones / n, F.col("zero"), F.col("one")
        seen = zero + one
        term = lambda k, m, p: F.when(k > 0, k * F.log(k / (m * p))).otherwise(0.0)
        rest = F.lit(n) - seen
        score = 2 * (term(one, seen, rate) + term(zero, seen, 1 - rate)
                     + term(F.lit(ones) - one, rest, rate)
                     + term(F.lit(n - ones) - zero, rest, 1 - rate))
        top = (counts.where(seen >= self.least).withColumn("score", score)
               .where(F.col("score") >= self.evidence)
               .orderBy(F.col("score").desc(), "mark").limit(self.marks))
        return [r["mark"] for r in top.collect()]

    def _sample(self, labelled: DataFrame, place: dict[str, int]) -> DataFrame:
        """(id, label, marks, swapped) of the sampled rows, marks as numbers."""
        swaps = {term: group[(i + 1) % len(group)] for group in self.identity
                 for i, term in enumerate(group)}

        def numbers(words: set[str]) -> list[int]:
            return sorted({place[m] for w in words for m in marks_of(w) if m in place})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                marks, swapped = [], []
                for text in batch.column(1):
                    words = words_of(text.as_py())
                    marks.append(numbers(words))
                    other = {swaps.get(w, w) for w in words}
                    swapped.append(numbers(other) if other != words else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(2), pa.array(marks, pa.list_(pa.int32())),
                     pa.array(swapped, pa.list_(pa.int32()))],
                    names=["id", "label", "marks", "swapped"])

        picked = (labelled.select("id", "label").withColumn("order", F.xxhash64("id"))
                  .orderBy("order", "id", "label").limit(self.sample_rows)
                  .select(F.col("id").alias("pick")).distinct())
        # at most sample_rows ids are sent out
        rows = labelled.join(F.broadcast(picked), F.col("id") == F.col("pick"), "left_semi")
        found = rows.select("id", "text", F.col("label").cast("int").alias("label")).mapInArrow(
            run, "id long, label int, marks array<int>, swapped array<int>")
        # an id may have many rows
        return found.orderBy(F.xxhash64("id"), "id", "label", "marks", "swapped").limit(
            self.sample_rows)

    def _solve(self, rows: list, width: int, start: float) -> tuple[np.ndarray, float]:
        """Gradient descent with momentum on sparse rows."""
        label = np.array([r["label"] for r in rows], float)
        sizes = np.array([len(r["marks"]) for r in rows])
        column = np.concatenate([np.array(r["marks"], np.int64) for r in rows]
                                or [np.empty(0, np.int64)])
        line = np.repeat(np.arange(len(rows)), sizes)
        turned = [(r["marks"], r["swapped"]) for r in rows if r["swapped"] is not None]
        pair_column = np.array([i for m, s in turned for i in [*m, *s]], np.int64)
        pair_line = np.array([k for k, (m, s) in enumerate(turned) for _ in [*m, *s]], np.int64)
        pair_sign = np.array([x for m, s in turned for x in [1.0] * len(m) + [-1.0] * len(s)])
        w, bias, count = np.zeros(width), start, len(rows)
        first, second = np.zeros(width + 1), np.zeros(width + 1)
        for step in range(1, 601):
            logit = bias + np.bincount(line, w[column], count)
            miss = 1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label
            slope = np.bincount(column, miss[line], width) / count + self.penalty * w / 10
            if len(turned):
                change = np.bincount(pair_line, pair_sign * w[pair_column], len(turned))
                slope += self.fairness * np.bincount(
                    pair_column, pair_sign * change[pair_line], width) / len(turned)
            whole = np.append(slope, miss.mean())
            first = 0.9 * first + 0.1 * whole
            second = 0.999 * second + 0.001 * whole ** 2
            move = 0.05 * (first / (1 - 0.9 ** step)) / (
                np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
            w, bias = w - move[:-1], float(bias - move[-1])
        return w, bias

    def score(self, docs: DataFrame, model: ToxicityModel,
              text_column: str = "text") -> DataFrame:
        """``docs`` with score and predicted."""
        extra = StructType([StructField("score", DoubleType()),
                            StructField("predicted", IntegerType())])
        position = docs.drop("score", "predicted").columns.index(text_column)
        threshold = self.threshold

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            scorer = model.scorer()
            scores = [scorer(text.as_py()) for text in batch.column(position)]
            return [pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32())]

        return add_columns(docs, extra, work)


def without_toxic(docs: DataFrame, labelled: DataFrame, **settings) -> DataFrame:
    """``docs`` without those predicted toxic. Columns stay.

    A model that found no marks, as with labels of one class or none, tells no texts apart:
    all documents stay.
    """
    classifier = ToxicityClassifier(**settings)
    model = classifier.fit(labelled)
    if not model.weights:
        return docs
    return shielded(docs, ["text"], lambda base: classifier.score(base, model).where(
        "predicted = 0").select(base.columns))


def fold_of(id_column: str):
    """crc32 of the id as text, modulo 4."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 4


def labelled_texts(docs: DataFrame, labels: DataFrame, held_out: int = 2) -> DataFrame:
    """Texts with their labels, without the fold that is held out."""
    marked = labels.where(fold_of("doc_id") != held_out).select(
        F.col("doc_id").alias("id"), F.col("toxic").cast("long").alias("label"))
    marked = marked.where("label in (0, 1)")
    texts = docs.select("doc_id", "text").where(fold_of("doc_id") != held_out)
    # texts move by shuffle at every size: the labels are not known to stay few
    return texts.join(marked.hint("merge"), F.col("doc_id") == F.col("id")).select(
        "id", "text", "label")
