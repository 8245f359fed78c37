"""A quality classifier as a sparse ensemble of rules.

Shallow trees are boosted on statistics of labelled texts; every path from a root is a rule, a conjunction of thresholds
(Friedman and Popescu 2008). A lasso logistic regression gives most rules the weight zero; the others are compiled into
one Spark column expression, so scoring runs where the scan runs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most so many labelled documents are used to fit: those with the smallest hashes of their ids.
SAMPLE = 12_000
FOLDS, HELD_OUT = 3, 1
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.3
WORD_GAP = r"[\x20\x09-\x0D]+"
TWICE = r"(?<![^\x20\x09-\x0D])([^\x20\x09-\x0D]+)[\x20\x09-\x0D]+(?=\1(?![^\x20\x09-\x0D]))"


def statistics(docs: DataFrame, keep: list[str]) -> tuple[DataFrame, list[str]]:
    """``keep`` and the statistics of the column text; null and empty texts have zeros."""
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.greatest(F.length("__t"), F.lit(1))
    share = lambda pattern: 1 - F.length(F.regexp_replace("__t", pattern, "")) / n
    df = docs.select(*keep, text.alias("__t"))
    df = df.select(*keep, "__t", F.filter(F.split("__t", WORD_GAP), lambda w: w != "").alias("__w"))
    words = F.greatest(F.size("__w"), F.lit(1))
    stats = {
        "words": F.size("__w").cast("double"),
        "word_length": F.length("__t") / words,
        "distinct_words": F.size(F.array_distinct("__w")) / words,
        "repeated": share(TWICE),
        "upper": share(r"\p{Lu}+"),
        "digits": share(r"[0-9]+"),
        "marks": share(r"[!?]+"),
        "symbols": share(r"[%$#&*@^~<>={}\\\[\]+_]+"),
        "bars": share(r"\|+"),
        "stops": share(r"[.,;:]+"),
        "lines": share(r"\n+"),
    }
    return df.select(*keep, *(v.cast("double").alias(f"stat_{k}") for k, v in stats.items())), [f"stat_{k}" for k in stats]


@dataclass(frozen=True)
class Rule:
    """A conjunction of (statistic, whether it is above, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, threshold in self.terms:
            out = out & (F.col(name) > threshold if above else F.col(name) <= threshold)
        return out

    def matches(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, above, threshold in self.terms:
            v = x[:, names.index(name)]
            out &= v > threshold if above else v <= threshold
        return out


def _grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, names: list[str]) -> tuple[np.ndarray, list[tuple]]:
    """One tree: (its prediction for each row, the paths of its nodes)."""
    out, paths = np.zeros(len(grad)), []
    stack = [(np.arange(len(grad)), ())]
    while stack:
        rows, path = stack.pop()
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None)
        if len(path) < DEPTH and len(rows) >= 40:
            for j in range(binned.shape[1]):
                gs = np.bincount(binned[rows, j], grad[rows], BINS + 1)[:-1].cumsum()
                hs = np.bincount(binned[rows, j], hess[rows], BINS + 1)[:-1].cumsum()
                ns = np.bincount(binned[rows, j], minlength=BINS + 1)[:-1].cumsum()
                gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                gain[(ns < 10) | (len(rows) - ns < 10)] = 0
                gain = gain[: len(edges[j])]
                if len(gain) and gain.max() > best[0]:
                    best = (gain.max(), (j, int(gain.argmax())))
        if best[1] is None:
            out[rows] = g / (h + 1)
            continue
        j, k = best[1]
        for above in (False, True):
            own = path + ((names[j], above, float(edges[j][k])),)
            paths.append(own)
            stack.append((rows[(binned[rows, j] > k) == above], own))
    return out, paths


def extract_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES) -> list[Rule]:
    """Rules of boosted trees; of a path's thresholds on one side of a statistic the tighter stays."""
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    f = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    rules: dict[tuple, Rule] = {}
    rng = np.random.default_rng(7)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-f))
        use = rng.random(len(y)) < 0.7
        step, paths = _grow(binned, edges, np.where(use, y - p, 0), np.where(use, p * (1 - p), 0), names)
        f += RATE * np.clip(step, -4, 4)
        for path in paths:
            tight: dict[tuple[str, bool], float] = {}
            for name, above, t in path:
                tight[name, above] = (max if above else min)(t, tight.get((name, above), t))
            terms = tuple(sorted((n, a, t) for (n, a), t in tight.items()))
            rules[terms] = Rule(terms)
    return list(rules.values())


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, start: tuple[float, np.ndarray] | None = None, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(intercept, weights) by accelerated proximal gradient steps; the intercept isn't penalised."""
    n = len(y)
    r1 = np.concatenate([np.ones((n, 1)), r], axis=1)
    step = 4 * n / max(1.0, np.linalg.norm(r1.T @ r1, 2))
    w = np.zeros(r1.shape[1]) if start is None else np.append(start[0], start[1])
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        g = r1.T @ (1 / (1 + np.exp(-(r1 @ v))) - y) / n
        new = v - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]
    names: tuple[str, ...]

    def score(self) -> Column:
        """Probability of label 1, over the columns of :func:`statistics`."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> RuleEnsemble:
    """Fit to ``labels(doc_id, <label>)`` of ``docs(doc_id, text)``, at most ``sample`` of them.

    Left out: rows with a null id or label, rows of the held-out fold, labels without a document. A doc_id with several
    labels has the largest; with several texts it counts once for each. Without labels of both kinds the score of all is
    the share of label 1 (without any, 0.5).
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(label).cast("double").alias("__y"))
    chosen = known.orderBy(F.xxhash64("__id"), "__id").limit(sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id"))
    stats, names = statistics(rows, ["__id", "__y"])
    data = stats.orderBy("__id").toPandas()
    y = (data["__y"].to_numpy() > 0).astype(float)
    if not 0 < y.sum() < len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        return RuleEnsemble(float(np.log(share / (1 - share))), (), tuple(names))
    x = data[names].to_numpy(dtype=float)
    rules = extract_rules(x, y, names)
    r = np.stack([rule.matches(x, names) for rule in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    test = np.arange(len(y)) % 5 == 0
    best, start = (np.inf, 0.0), None
    path = 10.0 ** np.arange(-2, -4.6, -0.5)
    for penalty in path:
        start = lasso_logistic(r[~test], y[~test], penalty, start)
        p = np.clip(1 / (1 + np.exp(-(start[0] + r[test] @ start[1]))), 1e-9, 1 - 1e-9)
        loss = -(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()
        best = min(best, (loss, penalty))
    start = None
    for penalty in path[path >= best[1] * 0.99]:
        start = lasso_logistic(r, y, penalty, start)
    kept = tuple((rule, float(w)) for rule, w in zip(rules, start[1], strict=True) if abs(w) > 1e-4)
    return RuleEnsemble(start[0], kept, tuple(names))


def held_out(doc_id: Column) -> Column:
    """Whether a document is in the fold that is never learned from; null ids are not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def score(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs(doc_id, text)``.

    Only the text is scored; null texts are as empty ones. Rows that repeat and null ids are kept; an empty table gives
    an empty table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    stats, _ = statistics(rows, ["doc_id"])
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def keep_good(docs: DataFrame, model: RuleEnsemble) -> DataFrame:
    """The rows of ``docs`` whose text scores 0.5 or more, with all their columns."""
    cols = docs.columns
    packed = docs.select(F.struct(*cols).alias("__row"), "text")
    stats, _ = statistics(packed, ["__row"])
    return stats.where(model.score() >= 0.5).select(*(F.col("__row")[c].alias(c) for c in cols))
