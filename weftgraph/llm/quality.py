"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees are grown on a bounded sample of labelled rows; the path
to each of their nodes is a rule, a conjunction of thresholds on statistics.
Logistic regression with a lasso penalty keeps few of the rules, and those are
compiled into one Spark column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import hand_back, small_batches

#: Labelled rows that the fit takes at most, about.
SAMPLE = 4_000
TREES, DEPTH, BINS = 30, 3, 32
THRESHOLD = 0.7

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_SPACE = b" \t\n\v\f\r"
_STOP = b".,;:?'\"-()"
_SYMBOL = bytes(b for b in range(33, 127) if not chr(b).isalnum() and b not in _STOP)
_HIGH = bytes(range(128, 256))
_RUN = re.compile(r"([^\w\s])\1+")

STATS = [
    "n_bytes", "n_words", "word_bytes", "upper", "lower", "digit", "stop", "symbol", "high", "space",
    "capital_words", "distinct_words", "runs", "n_lines", "line_bytes", "distinct_lines", "repeated_bytes", "ended_lines", "long_words", "short_words",
]


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, in the order of ``STATS``; those of an empty text are 0."""
    raw = text.encode()
    n = len(raw)
    words = text.split()
    if not words:
        return [0.0] * len(STATS)
    share = lambda drop: (n - len(raw.translate(None, drop))) / n
    w = len(words)
    lines = [x for x in (y.strip() for y in text.split("\n")) if x]
    seen: set[str] = set()
    repeated = 0
    for x in lines:
        if x in seen:
            repeated += len(x)
        seen.add(x)
    sizes = list(map(len, words))
    return [
        float(n), float(w), sum(sizes) / w, share(_UPPER), share(_LOWER), share(_DIGIT), share(_STOP), share(_SYMBOL), share(_HIGH), share(_SPACE),
        sum(map(str.isupper, words)) / w, len(set(words)) / w, len(_RUN.findall(text)) / w, float(len(lines)), n / max(len(lines), 1), len(seen) / max(len(lines), 1),
        repeated / len(text), sum(x[-1] in ".!?" for x in lines) / max(len(lines), 1), sum(s > 12 for s in sizes) / w, sum(s < 3 for s in sizes) / w,
    ]


def measure(text: Column) -> Column:
    """The statistics of a text as a struct; a null text counts as empty."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            x = np.array([statistics(t.as_py() or "") for t in a]).reshape(-1, len(STATS))
            yield pa.StructArray.from_arrays([pa.array(x[:, k]) for k in range(len(STATS))], STATS)
        hand_back()

    return F.arrow_udf(run, ", ".join(f"{s} double" for s in STATS))(text)


def describe(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the statistics of every text."""
    return small_batches(docs).select(F.col(doc_id).alias("doc_id"), measure(F.col(text)).alias("s")).select("doc_id", "s.*")


#: (statistic, above, threshold): the statistic is greater than the threshold, or not.
Condition = tuple[int, bool, float]


@dataclass
class RuleEnsemble:
    intercept: float = 0.0
    rules: list[tuple[tuple[Condition, ...], float]] = field(default_factory=list)

    def column(self, of: str = "") -> Column:
        """The score of a row of :func:`describe`, or of the struct named ``of``."""
        stat = lambda k: F.col(of)[STATS[k]] if of else F.col(STATS[k])
        total = F.lit(float(self.intercept))
        for conditions, weight in self.rules:
            holds = None
            for k, above, at in conditions:
                c = stat(k) > F.lit(float(at)) if above else stat(k) <= F.lit(float(at))
                holds = c if holds is None else holds & c
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, least: int) -> tuple[list[tuple[Condition, ...]], np.ndarray]:
    """One tree on gradients: the rules of its nodes, and its prediction for each row."""
    rules, out = [], np.zeros(len(x))
    todo = [((), np.arange(len(x)))]
    while todo:
        rule, rows = todo.pop()
        if rule:
            rules.append(rule)
        best = (1e-6, None)
        if len(rule) < DEPTH and len(rows) >= 2 * least:
            whole = g[rows].sum() ** 2 / (h[rows].sum() + 1)
            for k in range(x.shape[1]):
                if not len(cuts[k]):
                    continue
                b = binned[rows, k]
                gs, hs, ns = (np.cumsum(np.bincount(b, w, len(cuts[k]) + 1))[:-1] for w in (g[rows], h[rows], None))
                gain = gs**2 / (hs + 1) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + 1) - whole
                gain[(ns < least) | (len(rows) - ns < least)] = 0
                at = int(gain.argmax())
                if gain[at] > best[0]:
                    best = (gain[at], (k, at))
        if best[1] is None:
            out[rows] = g[rows].sum() / (h[rows].sum() + 1)
            continue
        k, at = best[1]
        low = binned[rows, k] <= at
        todo += [((*rule, (k, False, float(cuts[k][at]))), rows[low]), ((*rule, (k, True, float(cuts[k][at]))), rows[~low])]
    return rules, out


def _holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, at in rule:
        out &= (x[:, k] > at) == above
    return out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 300) -> tuple[float, np.ndarray]:
    """Logistic weights with an L1 penalty by accelerated proximal steps; the intercept is free."""
    n, k = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    v = np.ones(k + 1)
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = a.T @ (a @ v)
        norm = np.linalg.norm(v)
        v /= norm
    step = 4 * n / norm
    p = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w = np.zeros(k + 1)
    w[0] = np.log(p / (1 - p))
    z, t = w.copy(), 1.0
    for _ in range(rounds):
        grad = a.T @ (1 / (1 + np.exp(-np.clip(a @ z, -30, 30))) - y) / n
        new = z - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t2 * (new - w)
        w, t = new, t2
    return float(w[0]), w[1:]


def train(x: np.ndarray, y: np.ndarray, penalty: float | None = None) -> RuleEnsemble:
    """Fit on statistics and labels; the penalty is picked on a fourth of the rows if not given."""
    if len(y) == 0:
        return RuleEnsemble()
    if y.min() == y.max():
        return RuleEnsemble(4.0 if y[0] else -4.0)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    cuts = [c[(c >= x[:, k].min()) & (c < x[:, k].max())] for k, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    least = max(5, len(y) // 400)
    f = np.zeros(len(y))
    rules: dict[tuple[Condition, ...], None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-f))
        found, out = _grow(x, binned, cuts, y - p, p * (1 - p), least)
        rules |= {tuple(sorted(r)): None for r in found}
        f += 0.3 * out
    names = list(rules)
    r = np.stack([_holds(c, x) for c in names], axis=1).astype(float) if names else np.zeros((len(y), 0))
    _, first = np.unique(r, axis=1, return_index=True)  # rules that hold for the same rows are one
    first = np.sort(first)
    names, r = [names[k] for k in first], r[:, first]
    if penalty is None:
        aside = np.arange(len(y)) % 4 == 3
        losses = []
        for c in (0.01, 0.003, 0.001):
            b, w = _lasso(r[~aside], y[~aside], c, 120)
            s = np.clip(b + r[aside] @ w, -30, 30)
            losses.append((float(np.mean(np.log1p(np.exp(s)) - y[aside] * s)), c))
        penalty = min(losses)[1]
    b, w = _lasso(r, y, penalty)
    return RuleEnsemble(b, [(c, float(v)) for c, v in zip(names, w, strict=True) if abs(v) > 1e-6])


def fit(docs: DataFrame, labels: DataFrame, keep: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """Learn from labelled rows for which ``keep``, on ``doc_id``, holds.

    About ``sample`` of them, those whose hashed id is lowest, go to the driver
    as statistics: 160 bytes each, and ``2 * sample`` at most where ids repeat.
    Rows without a label or an id teach nothing; without any the model gives 0.5.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y is not null and doc_id is not null").filter(keep)
    n = known.count()
    if not n:
        return RuleEnsemble()
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(min(1.0, sample / n) * (1 << 30)) + 1)
    few = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known.select("doc_id").distinct()), "doc_id", "left_semi")
    # an id may have many rows
    few = few.orderBy(F.xxhash64("doc_id", "text")).limit(2 * sample)
    rows = describe(few).join(F.broadcast(known.distinct()), "doc_id").drop("doc_id").collect()
    data = np.array(sorted(tuple(r) for r in rows), float).reshape(-1, len(STATS) + 1)
    data = data[np.random.default_rng(5).permutation(len(data))]
    return train(data[:, :-1], (data[:, -1] > 0).astype(float))


def score(docs: DataFrame, model: RuleEnsemble, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (0 to 1; the higher, the likelier good) and predicted (1 from ``threshold`` on) of every whole text.

    A null text counts as empty, whose statistics are 0; a model that has learnt
    nothing gives 0.5.  Each row stands for itself.
    """
    s = describe(docs, doc_id, text).select("doc_id", model.column().alias("score"))
    return s.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: RuleEnsemble, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that :func:`score` predicts to be good, with all their columns."""
    mark = "_" + max(docs.columns, key=len)
    return small_batches(docs).withColumn(mark, measure(F.col(text))).filter(model.column(mark) >= threshold).drop(mark)
