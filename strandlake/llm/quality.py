"""Quality scores by a sparse rule ensemble.

Statistics of a text become columns. On a bounded sample of labelled rows small trees are grown;
each of their paths is a conjunctive rule over the statistics. Logistic weights with an L1 penalty
keep few rules. The kept rules are compiled into one Spark column expression, which scores all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, rows_only

STATISTICS = [
    "chars", "words", "word_length", "upper", "digit", "space", "punct", "symbol", "other",
    "repeat", "distinct", "line_length", "line_distinct", "bang", "bar", "longest",
]
KINDS = 8
UPPER, LOWER, DIGIT, SPACE, PUNCT, SYMBOL, OTHER, LETTER = range(KINDS)


def _kinds() -> np.ndarray:
    """The kind of each code point up to U+024F; all beyond count as letters."""

    def kind(c: str) -> int:
        return UPPER if c.isupper() else LOWER if c.islower() else DIGIT if c.isdigit() else SPACE if c.isspace() else PUNCT if c in ".,;:?'\"()-!" else SYMBOL if c.isascii() and c.isprintable() else OTHER if not c.isalpha() else LETTER

    return np.array([kind(chr(i)) for i in range(0x250)] + [LETTER], np.uint8)


def statistics_of(text: str, kinds: np.ndarray) -> list[float]:
    """Of the whole text; all zero for an empty one."""
    if not text:
        return [0.0] * len(STATISTICS)
    n = len(text)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    share = np.bincount(kinds[np.minimum(codes, 0x250)], minlength=KINDS) / n
    words = text.split()
    w = len(words) or 1
    lines = text.split("\n")
    return [
        float(n), float(len(words)), n / w, share[UPPER] / max(share[UPPER] + share[LOWER], 1 / n), share[DIGIT], share[SPACE], share[PUNCT], share[SYMBOL], share[OTHER],
        sum(map(eq, words, words[1:])) / w, len(set(words)) / w, n / len(lines), len(set(lines)) / len(lines), text.count("!") / n, text.count("|") / w, max(map(len, words), default=0) / n,
    ]


def _statistics(batches: Iterator) -> Iterator:
    kinds = _kinds()
    for b in batches:
        rows = [statistics_of(t.as_py() or "", kinds) for t in b.column(1)]
        columns = np.array(rows, np.float64).reshape(len(rows), len(STATISTICS)).T
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in columns]], names=["doc_id", *STATISTICS])


def statistics(docs: DataFrame) -> DataFrame:
    rows = rows_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(lean(_statistics), "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


Condition = tuple[int, bool, float]  # statistic, at most or above, threshold


@dataclass
class RuleEnsemble:
    bias: float
    rules: list[tuple[tuple[Condition, ...], float]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z += weight * holds(rule, x)
        return 1 / (1 + np.exp(-z))

    def column(self, prefix: str = "") -> Column:
        """The score over columns (or fields, with a prefix) named as the statistics are."""
        z = F.lit(self.bias)
        for rule, weight in self.rules:
            test = F.lit(True)
            for s, below, at in rule:
                test = test & (F.col(prefix + STATISTICS[s]) <= at if below else F.col(prefix + STATISTICS[s]) > at)
            z = z + F.when(test, weight).otherwise(0.0)
        return 1 / (1 + F.exp(-z))


def holds(rule: tuple[Condition, ...], x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for s, below, at in rule:
        out &= x[:, s] <= at if below else x[:, s] > at
    return out


def paths(x: np.ndarray, residual: np.ndarray, rng: np.random.Generator, depth: int, path: tuple = ()) -> list[tuple[Condition, ...]]:
    """Grows a tree that fits ``residual`` (least squares, a random half of the statistics at each node); all paths from its root."""
    if depth == 0 or len(x) < 20:
        return []
    best = (1e-9, None, None)
    total = residual.sum()
    for s in rng.choice(x.shape[1], (x.shape[1] + 1) // 2, replace=False):
        cuts = np.unique(np.quantile(x[:, s], np.linspace(0, 1, 34)[1:-1]))
        order = np.argsort(x[:, s])
        sums, at = np.cumsum(residual[order]), np.searchsorted(x[order, s], cuts, "right")
        ok = (at >= 10) & (at <= len(x) - 10)
        if not ok.any():
            continue
        n, left = at[ok], sums[at[ok] - 1]
        gain = left**2 / n + (total - left) ** 2 / (len(x) - n) - total**2 / len(x)
        if gain.max() > best[0]:
            # Halfway to the next value, so that equal values on other machines fall on the same side.
            i = int(gain.argmax())
            values = x[order, s]
            best = (gain.max(), s, float((values[n[i] - 1] + values[n[i]]) / 2))
    _, s, cut = best
    if s is None:
        return []
    low = x[:, s] <= cut
    out = []
    for below, rows in ((True, low), (False, ~low)):
        here = (*path, (int(s), below, cut))
        out += [here, *paths(x[rows], residual[rows], rng, depth - 1, here)]
    return out


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all weights but the bias, by accelerated proximal steps."""
    n, m = a.shape
    w, v, t = np.zeros(m + 1), np.zeros(m + 1), 1.0
    a = np.hstack([np.ones((n, 1)), a])
    step = 4 * n / (np.linalg.norm(a, 2) ** 2)
    for _ in range(rounds):
        g = a.T @ (1 / (1 + np.exp(-(a @ v))) - y) / n
        new = v - step * g
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, old = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        v = new + (old - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 3, penalty: float = 5e-4, seed: int = 3) -> RuleEnsemble:
    """Boosted trees give rules (later trees fit what earlier ones leave), the lasso weighs them."""
    mean = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    bias = float(np.log(mean / (1 - mean)))
    if len(y) < 40 or len(set(y)) < 2:
        return RuleEnsemble(bias, [])
    rng = np.random.default_rng(seed)
    rules: dict[tuple, None] = {}
    z = np.full(len(y), bias)
    for _ in range(trees):
        rows = rng.choice(len(y), max(40, len(y) // 2), replace=False)
        residual = y - 1 / (1 + np.exp(-z))
        found = paths(x[rows], residual[rows], rng, depth)
        rules |= dict.fromkeys(found)
        inner = {p[:-1] for p in found}
        for leaf in (p for p in found if p not in inner):
            hit = holds(leaf, x)
            if hit.any():
                z[hit] += 2 * residual[hit].mean()
    kept = [r for r in rules if 0 < holds(r, x).mean() < 1]
    a = np.array([holds(r, x) for r in kept], np.float64).T.reshape(len(y), len(kept))
    b, w = lasso(a, y, penalty)
    return RuleEnsemble(b, [(r, float(c)) for r, c in zip(kept, w, strict=True) if abs(c) > 1e-6])


def quality_scores(docs: DataFrame, labels: DataFrame, most_labelled: int = 20_000, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs`` (doc_id, text; other columns are ignored).

    Learns from at most ``most_labelled`` rows of ``labels`` (doc_id, quality; the smallest by a hash of
    their doc_id) whose crc32(doc_id as text) mod 5 is not 0; held_out marks the other documents. Only
    statistics of the text are inputs. predicted is 1 if score >= ``cut``. A null text counts as empty;
    a null doc_id is never learnt from and held_out is false. Null labels are ignored. Without two
    classes of labels every score is the share of label 1.
    """
    model = learn(docs, labels, most_labelled)
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    scored = statistics(docs).select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), model.column().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= cut, 1).otherwise(0))


def learn(docs: DataFrame, labels: DataFrame, most_labelled: int) -> RuleEnsemble:
    """Fits the ensemble on labelled rows of ``docs`` (doc_id, text) that aren't held out.

    If there are more than ``most_labelled`` such rows, about 1.3 times as many are drawn by a hash of their doc_id,
    and the first ``most_labelled`` in that hash's order are learnt from; only these texts are looked at.
    """
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    marks = rows_only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long"), "quality").where(rest != 0)
    rows = rows_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    total = rows.select("doc_id").join(marks, "doc_id").count()
    if total > most_labelled:
        drawn = F.pmod(F.xxhash64("doc_id"), F.lit(total)) < F.lit(int(1.3 * most_labelled))
        marks, rows = marks.where(drawn), rows.where(drawn)
    known = statistics(rows.join(marks.select("doc_id").distinct(), "doc_id", "left_semi"))
    sample = known.join(marks, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", *STATISTICS).limit(most_labelled).toPandas()
    return fit(sample[STATISTICS].to_numpy(np.float64), sample["quality"].to_numpy(np.float64))


def _beside(batches: Iterator, at: int) -> Iterator:
    """The batches' own columns and a struct of the text's statistics."""
    kinds = _kinds()
    for b in batches:
        rows = [statistics_of(t.as_py() or "", kinds) for t in b.column(at)]
        columns = np.array(rows, np.float64).reshape(len(rows), len(STATISTICS)).T
        struct = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=STATISTICS)
        yield pa.RecordBatch.from_arrays([*b.columns, struct], names=[*b.schema.names, "__statistics"])


def keep_quality(docs: DataFrame, labels: DataFrame, cut: float = 0.3, most_labelled: int = 20_000) -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``cut``. Texts aren't moved: statistics are taken beside the rows.

    A null text is scored as an empty one; rows with a null doc_id are scored, but never learnt from. Repeated rows are
    scored each. Other columns stay as they are, whatever their names. No rows in, no rows out. Without two classes of
    labels every score is the share of label 1.
    """
    model = learn(docs, labels, most_labelled)
    at = docs.columns.index("text")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    both = docs.mapInArrow(lean(lambda it: _beside(it, at)), f"{own}, __statistics struct<{', '.join(f'{s}: double' for s in STATISTICS)}>")
    return both.where(model.column("__statistics.") >= cut).select(*[F.col(f"`{c}`") for c in docs.columns])
