"""Toxicity by maximum-scoring segments over token log-odds.

Training counts words in labelled texts, smooths them by a Dirichlet prior and keeps the log-odds of words and of
word beginnings.  Scoring walks a text once; every segment whose summed log-odds cannot be raised by growing or
shrinking is a maximal segment (the linear-time all-maximal-segments scan), and one is significant when the
extreme-value law for such maxima in clean text gives it a small chance.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightsieve.llm.common import map_batches

WORD = re.compile(r"[^\W\d_]+")
STEM = 4
TEXTS = 200  # scored at a time


@dataclass
class Model:
    """What scoring needs; its size is bounded by `max_terms`."""

    weights: dict[str, float]
    stems: dict[str, float]
    rest: float
    rate: float = 1.0
    scale: float = 1.0
    points: list[float] = field(default_factory=lambda: [0.0])
    chances: list[float] = field(default_factory=lambda: [0.0])

    def weigh(self, words: list[str]) -> list[float]:
        """A word said again at once weighs as an unknown one."""
        known, stems, rest = self.weights, self.stems, self.rest
        out = [known[w] if w in known else stems.get(w[:STEM], rest) for w in words]
        return [rest if i and w == words[i - 1] else out[i] for i, w in enumerate(words)]


def maximal_segments(weights: list[float]) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, start, end), in order, in linear time.

    A list of candidates is kept, each with the running sum before and after it.  A new positive token joins
    backwards past candidates as long as one that starts lower and ends lower than the new end is found.
    """
    kept: list[tuple[float, float, int, int]] = []  # sum before, sum after, start, end
    jump: list[int] = []  # nearest earlier candidate that starts lower
    total = 0.0
    for at, w in enumerate(weights):
        before, total = total, total + w
        if w <= 0:
            continue
        low, start = before, at
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= low:
                j = jump[j]
            if j < 0 or kept[j][1] >= total:
                kept.append((low, total, start, at + 1))
                jump.append(j)
                break
            low, start = kept[j][0], kept[j][2]
            del kept[j:], jump[j:]
    return [(hi - lo, a, b) for lo, hi, a, b in kept]


def decay_rate(weights: np.ndarray, shares: np.ndarray) -> float:
    """The positive root of sum(share * exp(rate * weight)) = 1; weights need a negative mean and a positive value."""
    low, high = 1e-6, 1.0
    value = lambda x: float(np.log((shares * np.exp(np.minimum(x * weights, 700))).sum()))
    while value(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _count(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[str, bool, int], int] = {}
    for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
        words = _words(text)
        for stem, terms in ((False, set(words)), (True, {w[:STEM] for w in words})):
            for term in terms:  # once a text: repeated lines are no further evidence
                key = (term, stem, label)
                counts[key] = counts.get(key, 0) + 1
    rows = list(counts.items())
    yield pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k, _ in rows], pa.string()), pa.array([k[1] for k, _ in rows], pa.bool_()),
         pa.array([k[2] for k, _ in rows], pa.int32()), pa.array([n for _, n in rows], pa.int64())],
        ["term", "stem", "label", "n"],
    )


def fit(
    labelled: DataFrame, text_col: str = "text", label_col: str = "label", max_rows: int = 12_000,
    max_terms: int = 60_000, prior: float = 2.0, cost: float = 0.7,
) -> Model:
    """Learn from a bounded sample: at most about `max_rows` rows, chosen by hashes of their texts; so repeatable.

    Words and beginnings with the largest evidence are kept, `max_terms` of each kind at most; the tail scores as
    `rest`.  A Dirichlet prior of `prior` pseudo-counts pulls a word to the shares of its beginning, and a beginning to
    those of the whole sample.  `cost` is taken from each weight so that clean text drifts down.  Rows with a null label take no
    part; with one class only the model says 0 or the class's share everywhere.
    """
    rows = labelled.where(F.col(label_col).isin(0, 1)).select(F.col(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))
    size = rows.count()
    if size > max_rows:  # one slice of the hash range holds the wanted share
        keep = int((1 << 30) * max_rows / size)
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < keep)
    rows = rows.cache()
    counts = map_batches(rows, _count, "term string, stem boolean, label int, n long")
    share = counts.groupBy("stem").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("good"))
    totals = {r["stem"]: r for r in share.collect()}
    if not totals or not totals[False]["bad"] or not totals[False]["good"]:
        only = rows.agg(F.avg("label")).first()[0] or 0.0
        rows.unpersist()
        return Model({}, {}, -1.0, chances=[float(only)])
    bad, good = (float(totals[False][k]) for k in ("bad", "good"))
    by_term = counts.groupBy("term", "stem").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("b"))
    surplus = F.abs(F.col("a") - (F.col("a") + F.col("b")) * (bad / (bad + good))) / F.sqrt(F.col("a") + F.col("b"))
    kept: dict[bool, list] = {}
    for stem in (False, True):
        of_kind = by_term.where(F.col("stem") == stem)
        kept[stem] = of_kind.orderBy(surplus.desc(), "term").limit(max_terms).collect()
    part = bad / (bad + good)

    def odds(a: int, b: int, mean: float) -> float:
        """Log-odds under a Dirichlet prior of `prior` pseudo-counts, `mean` of them in label 1."""
        return math.log((a + prior * mean) / bad) - math.log((b + prior * (1 - mean)) / good)

    ratios = {r["term"]: odds(r["a"], r["b"], part) for r in kept[True]}
    stems = {term: ratio - cost for term, ratio in ratios.items()}
    weights = {}
    for r in kept[False]:
        tilt = math.exp(ratios.get(r["term"][:STEM], 0.0)) * bad
        weights[r["term"]] = odds(r["a"], r["b"], tilt / (tilt + good)) - cost
    model = Model(weights, stems, -cost)
    clean: dict[float, int] = {}
    for r in kept[False]:
        w = round(model.weights[r["term"]], 3)
        clean[w] = clean.get(w, 0) + r["b"]
    clean[round(model.rest, 3)] = clean.get(round(model.rest, 3), 0) + max(1, int(good) - sum(clean.values()))
    values, n = np.array(list(clean)), np.array(list(clean.values()), float)
    if (values > 0).any() and (values * n).sum() < 0:
        model.rate = decay_rate(values, (n + 1e-3) / (n + 1e-3).sum())
    return _calibrate(model, rows)


def evidence(model: Model, words: list[str], limit: float = 1e-3) -> tuple[float, list[tuple[float, int, int]]]:
    """(normalised best score, significant segments) of one text.

    The best segment's score s becomes rate * s - ln(scale * n): minus the log of the count of such segments that n
    clean tokens hold by chance, whose maximum follows the extreme-value law.  Significant: that count is at most `limit`.
    """
    if not words:
        return -math.inf, []
    weights = model.weigh(words)
    if max(weights) <= 0:
        return -math.inf, []
    floor = math.log(model.scale * len(words))
    found = maximal_segments(weights)
    scored = [(model.rate * s - floor, a, b) for s, a, b in found]
    return max(x[0] for x in scored), [x for x in scored if x[0] >= -math.log(limit)]


def _evidence_rows(batch: pa.RecordBatch, model: Model):
    best = [evidence(model, _words(t))[0] for t in batch.column(0).to_pylist()]
    yield pa.RecordBatch.from_arrays([pa.array([max(x, -1e6) for x in best], pa.float64()), batch.column(1)], ["best", "label"])


def _calibrate(model: Model, rows: DataFrame) -> Model:
    """Chances of label 1 that never fall as the best score grows (pooled adjacent violators), from the same sample."""
    got = map_batches(rows, partial(_evidence_rows, model=model), "best double, label int").toPandas()
    rows.unpersist()
    got = got.sort_values("best", kind="stable")
    blocks: list[list[float]] = []  # least score, sum of labels, rows
    for best, group in got.groupby("best", sort=True)["label"]:
        blocks.append([best, float(group.sum()), float(len(group))])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1][1] += last[1]
            blocks[-1][2] += last[2]
    model.points = [b[0] for b in blocks]
    model.chances = [(b[1] + 0.02) / (b[2] + 0.4) for b in blocks]
    return model


def chance(model: Model, best: float) -> float:
    """Calibrated chance of label 1, a little tilted by the score inside a flat step so that ties are few."""
    spot = int(np.searchsorted(model.points, best, "right")) - 1
    base = model.chances[max(spot, 0)]
    tilt = 1 / (1 + math.exp(-max(-30.0, min(30.0, best / 4)))) if math.isfinite(best) else 0.0
    return min(1.0, max(0.0, 0.98 * base + 0.02 * base * tilt if base < 0.5 else 0.98 * base + 0.02 * tilt))


def _score(batch: pa.RecordBatch, model: Model, limit: float):
    scores, spans = [], []
    for text in batch.column(1).to_pylist():
        words = _words(text)
        best, segments = evidence(model, words, limit)
        scores.append(chance(model, best))
        spans.append([{"first": a, "end": b, "strength": s} for s, a, b in segments])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("strength", pa.float64())]))
    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(spans, kind)], ["id", "score", "passages"])


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 1e-3) -> DataFrame:
    """All columns of `docs` with `score` and `passages` at the end; those names must be free."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_col)

    def run(whole: pa.RecordBatch):
        for at in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(at, TEXTS)
            for scored in _score(pa.RecordBatch.from_arrays([batch.column(place)] * 2, ["id", "text"]), shared.value, limit):
                yield pa.RecordBatch.from_arrays([*batch.columns, *scored.columns[1:]], [*batch.schema.names, "score", "passages"])

    extra = F.lit(0.0).cast("double").alias("score"), F.lit(None).cast("array<struct<first:int,end:int,strength:double>>").alias("passages")
    return map_batches(docs, run, docs.select("*", *extra).schema)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", limit: float = 1e-3) -> DataFrame:
    """(id, score, passages) per row: the chance of label 1 and all significant segments as word ranges.

    Null and empty texts, and texts without a positive token, have no segment and the lowest chance.  Repeated ids
    and rows are scored each; extra columns are not read; an empty table gives no row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(whole: pa.RecordBatch):
        for at in range(0, whole.num_rows, TEXTS):
            yield from _score(whole.slice(at, TEXTS), shared.value, limit)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = map_batches(source, run, f"id {kind}, score double, passages array<struct<first:int,end:int,strength:double>>")
    return out.withColumnRenamed("id", id_col)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label) of the labelled rows outside the held-out fold."""
    marks = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("label"))
    marks = marks.where(~held_out(F.col("doc_id")))
    return docs.select("doc_id", "text").join(marks.hint("shuffle_hash"), "doc_id").select("text", "label")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
