"""Text quality by a sparse ensemble of rules over statistics of the text.

Small boosted trees are grown on labelled rows; every path from a root to a node below it is a
conjunctive rule. A logistic regression with an L1 penalty gives most rules weight zero, and what
is left is one SQL expression over the statistics, which are SQL functions of the text themselves.
Fitting takes a bounded sample of labelled rows; scoring is one pass without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafledger.llm.shared import col, free_name

#: Labelled rows that a model is fitted on, at most; those with the least checksums of their ids.
SAMPLE_ROWS = 8192
THRESHOLD = 0.7
TREES = 32
DEPTH = 3
LEAST_ROWS = 4
BINS = 32
SHRINKAGE = 0.2
RIDGE = 1.0
#: L1 penalties tried, as parts of the least one that leaves no rule; the best on every fifth row wins.
PENALTIES = (0.3, 0.1, 0.03, 0.01, 0.003, 0.001)
ROUNDS = 250


def _statistics(t: str, w: str) -> dict[str, str]:
    """SQL of each statistic of the text in column ``t``, whose words are in ``w``."""

    def share(pattern: str) -> str:
        """Characters in runs of ``pattern``, as a part of all."""
        return f"(length({t}) - length(regexp_replace({t}, r'{pattern}', ''))) / greatest(length({t}), 1)"

    return {
        "chars": f"length({t})",
        "words": f"size({w})",
        "word_length": f"(length({t}) - size({w})) / greatest(size({w}), 1)",
        "words_per_line": f"size({w}) / (1 + length({t}) - length(replace({t}, '\\n', '')))",
        "letters": share(r"\p{L}+"),
        "capitals": share(r"\p{Lu}+"),
        "digits": share(r"\p{Nd}+"),
        "stops": share(r"[.]+"),
        "commas": share(r"[,;:]+"),
        "calls": share(r"[!?]+"),
        "bars": share(r"[|]+"),
        "marks": share(r"[#$%&*+/<=>@\[\\\]^_`{}~]+"),
        "distinct": f"size(array_distinct({w})) / greatest(size({w}), 1)",
        "echoes": rf"regexp_count({t}, r'(?<!\S)(\S++)(?=\s++\1(?!\S))') / greatest(size({w}), 1)",
    }


#: The statistics in the order of a model's numbers.
STATISTICS = tuple(_statistics("", ""))


@dataclass(frozen=True)
class Condition:
    """A statistic that is at most, or over, a bound."""

    statistic: int
    over: bool
    bound: float

    def sql(self, field: str) -> str:
        return f"{field} {'>' if self.over else '<='} {self.bound!r}D"


Rule = frozenset[Condition]


@dataclass(frozen=True)
class Model:
    """Log-odds of label 1: a bias and the weights of the rules that hold."""

    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def sql(self, name: str) -> str:
        """The probability of label 1 as SQL over a struct column of the statistics."""
        fields = [f"{name}.`{s}`" for s in STATISTICS]
        terms = [f"{self.bias!r}D"]
        for rule, weight in self.rules:
            parts = sorted(c.sql(fields[c.statistic]) for c in rule)
            terms.append(f"CASE WHEN {' AND '.join(parts)} THEN {weight!r}D ELSE 0.0D END")
        return f"1 / (1 + exp(-({' + '.join(terms)})))"


def _checksum(id_column: str) -> Column:
    return F.crc32(col(id_column).cast("string").cast("binary"))


def held_out(id_column: str = "doc_id") -> Column:
    """True for the quarter of the ids that nothing is learned from; false for a null id."""
    return F.coalesce(_checksum(id_column) % 4 == 2, F.lit(False))


def with_statistics(docs: DataFrame, text_column: str = "text", name: str = "statistics") -> DataFrame:
    """``docs`` with a struct of the text's statistics; a null text counts as an empty one."""
    text, words = free_name(docs.columns, "__t"), free_name(docs.columns, "__w")
    split = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    found = docs.withColumn(text, F.coalesce(col(text_column).cast("string"), F.lit(""))).withColumn(words, split)
    fields = [f"CAST({sql} AS DOUBLE) AS {key}" for key, sql in _statistics(text, words).items()]
    return found.withColumn(name, F.expr(f"struct({', '.join(fields)})")).drop(text, words)


def _grow(x: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, path: Rule, depth: int, rules: dict, out: np.ndarray) -> None:
    """One node of a tree for gradients ``g`` and curvatures ``h``: rules of the paths below, fit in ``out``."""
    out[rows] = -g[rows].sum() / (h[rows].sum() + RIDGE)
    if depth == 0 or rows.size < 2 * LEAST_ROWS:
        return
    best, found = 1e-9, None
    whole = g[rows].sum() ** 2 / (h[rows].sum() + RIDGE)
    for j, cuts in enumerate(edges):
        if not cuts.size:
            continue
        bins = x[rows, j]
        gs, hs, ns = (np.bincount(bins, weights=v, minlength=cuts.size + 1).cumsum()[:-1] for v in (g[rows], h[rows], np.ones(rows.size)))
        gain = gs**2 / (hs + RIDGE) + (g[rows].sum() - gs) ** 2 / (h[rows].sum() - hs + RIDGE) - whole
        gain[(ns < LEAST_ROWS) | (rows.size - ns < LEAST_ROWS)] = 0
        k = int(gain.argmax())
        if gain[k] > best:
            best, found = float(gain[k]), (j, k)
    if found is None:
        return
    j, k = found
    left = x[rows, j] <= k
    for over, part in ((False, rows[left]), (True, rows[~left])):
        rule = _joined(path, Condition(j, over, float(edges[j][k])))
        rules.setdefault(rule, len(rules))
        _grow(x, edges, g, h, part, rule, depth - 1, rules, out)


def _joined(path: Rule, new: Condition) -> Rule:
    """The path with one more condition; of two bounds on one side the narrower stays."""
    same = [c for c in path if (c.statistic, c.over) == (new.statistic, new.over)]
    return frozenset(c for c in path if c not in same) | {new}


def _holds(rules: list[Rule], values: np.ndarray) -> np.ndarray:
    out = np.ones((len(values), len(rules)))
    for i, rule in enumerate(rules):
        for c in rule:
            out[:, i] *= (values[:, c.statistic] > c.bound) == c.over
    return out


def _steepest(z: np.ndarray) -> float:
    """An upper bound of the largest eigenvalue of ``z.T @ z``, close to it for rules (all are >= 0)."""
    square = z.T @ z
    ahead = np.ones(z.shape[1])
    for _ in range(20):
        ahead = square @ ahead
        ahead /= ahead.max(initial=1e-300)
    # of a matrix without negative entries no row of square @ x / x is below it everywhere
    some = ahead > 0
    return float(((square @ ahead)[some] / ahead[some]).max(initial=1.0))


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float]:
    """Logistic weights under an L1 penalty (none on the bias), by accelerated proximal steps."""
    step = 4 * len(y) / (_steepest(z) + len(y))
    ahead_w, ahead_b, pace = weights, bias, 1.0
    for _ in range(ROUNDS):
        miss = 1 / (1 + np.exp(-np.clip(z @ ahead_w + ahead_b, -40, 40))) - y
        moved = ahead_w - step * (z.T @ miss) / len(y)
        new_w = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_b = ahead_b - step * miss.mean()
        next_pace = (1 + math.sqrt(1 + 4 * pace * pace)) / 2
        ahead_w = new_w + (pace - 1) / next_pace * (new_w - weights)
        ahead_b = new_b + (pace - 1) / next_pace * (new_b - bias)
        change = max(float(np.abs(new_w - weights).max(initial=0)), abs(new_b - bias))
        weights, bias, pace = new_w, new_b, next_pace
        if change < 1e-7:
            break
    return weights, bias


def _loss(z: np.ndarray, y: np.ndarray, weights: np.ndarray, bias: float) -> float:
    odds = z @ weights + bias
    return float(np.logaddexp(0, np.where(y > 0, -odds, odds)).mean())


def fit(values: np.ndarray, labels: np.ndarray) -> Model:
    """A model from statistics (a row per text) and labels 0 and 1.

    Where labels are all alike or none, no rule is learned and the bias is the smoothed share.
    """
    y = labels.astype(float)
    prior = (y.sum() + 1) / (len(y) + 2)
    bias = math.log(prior / (1 - prior))
    if not 0 < y.sum() < len(y):
        return Model(bias, ())
    edges = []
    for column in values.T:
        cuts = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1]))
        # a bound in the middle of two values is met by neither of them
        following = np.array([column[column > c].min(initial=np.inf) for c in cuts])
        cuts = (cuts + following)[np.isfinite(following)] / 2
        edges.append(np.unique(cuts))
    x = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, values.T)], 1)
    rules: dict[Rule, int] = {}
    odds = np.full(len(y), bias)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-odds))
        tree = np.empty(len(y))
        _grow(x, edges, p - y, p * (1 - p), np.arange(len(y)), frozenset(), DEPTH, rules, tree)
        odds += SHRINKAGE * tree
    # of rules that hold for the same rows the shortest stays
    held = _holds(list(rules), values)
    alike: dict[bytes, int] = {}
    named = list(rules)
    for i in sorted(range(len(named)), key=lambda i: (len(named[i]), i)):
        alike.setdefault(held[:, i].tobytes(), i)
    chosen = sorted(alike.values())
    named, z = [named[i] for i in chosen], held[:, chosen]
    if not named:
        return Model(bias, ())
    apart = np.arange(len(y)) % 5 == 4
    if not 0 < y[~apart].sum() < (~apart).sum():
        apart[:] = False

    def along(part: np.ndarray):
        some, of = z[part], y[part]
        top = float(np.abs(some.T @ (of - of.mean())).max() / len(of))
        weights, b = np.zeros(len(named)), bias
        for share in PENALTIES:
            weights, b = _lasso(some, of, share * top, weights, b)
            yield weights, b

    losses = [_loss(z[apart], y[apart], w, b) if apart.any() else -i for i, (w, b) in enumerate(along(~apart))]
    weights, b = list(along(np.ones(len(y), bool)))[int(np.argmin(losses))]
    kept = np.flatnonzero(weights)
    return Model(float(b), tuple((named[i], float(weights[i])) for i in kept))


def train(docs: DataFrame, labels: DataFrame, label_column: str = "quality", id_column: str = "doc_id", text_column: str = "text") -> Model:
    """A model of the labels of rows that are not held out.

    Of the labels, ``SAMPLE_ROWS`` at most are taken, those whose ids have the least checksums;
    they are broadcast (16 bytes each), so that documents are not shuffled. Null ids and labels
    other than 0 and 1 are passed over; a repeated id is as many rows as its labels and texts.
    """
    usable = labels.where((_checksum(id_column) % 4 != 2) & col(label_column).isin(0, 1))
    taken = usable.select(col(id_column).alias("__id"), col(label_column).cast("int").alias("__label"))
    taken = taken.orderBy(_checksum("__id"), "__id", "__label").limit(SAMPLE_ROWS)
    texts = docs.select(col(id_column).alias("__doc"), col(text_column).alias("text"))
    found = with_statistics(texts.join(F.broadcast(taken), F.col("__doc") == F.col("__id")))
    rows = found.select("__id", "__label", "statistics.*").orderBy(_checksum("__id"), "__id", "__label", *STATISTICS).toArrow()
    values = np.stack([rows.column(s).to_numpy() for s in STATISTICS], 1) if len(rows) else np.empty((0, len(STATISTICS)))
    return fit(values.astype(float), rows.column("__label").to_numpy())


def with_score(docs: DataFrame, model: Model, text_column: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1, which depends on the text alone; null is empty."""
    held = free_name(docs.columns, "__statistics")
    return with_statistics(docs, text_column, held).withColumn(free_name(docs.columns, name), F.expr(model.sql(held))).drop(held)


def score_quality(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` per row of ``docs``.

    Repeated rows are scored alike; empty tables give an empty one; an empty ``labels`` gives every
    text the score one half. Other columns are not looked at.
    """
    model = train(docs, labels, id_column=id_column)
    narrow = docs.select(col(id_column).alias("doc_id"), held_out(id_column).alias("held_out"), F.col("text"))
    scored = with_score(narrow, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
