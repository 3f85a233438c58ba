"""Spelling variants: words one edit apart, found by two-dimensional range reporting.

A word x of L letters and an edit position p name all words that may differ from x at p: those that begin
with x's first p letters, an interval of the dictionary in order, and end with its last L - 1 - p letters, an
interval of the dictionary ordered from the back. A wavelet tree over the backward ranks in forward order
reports the words in both. For an insertion the query has a letter less than the dictionary's words.

The dictionary is dealt by length and by one half of its words: an edit in the first half leaves the second
as it is, and the other way round. Groups with more letters than a block are cut into blocks, and their
queries go to each. Only counts and the most frequent near word of each word leave a task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scope, join_heavy, lean, rows_only

RUN = re.compile("[a-zÀ-ÿ]+")
#: Letters of a group's words in one block, and of the words and queries that are searched together.
BLOCK = 1 << 20
#: Words a task counts before they leave it.
WORDS = 200_000
#: Texts above so many code points are gone through match by match.
LONG = 1 << 20


def _runs(batches: Iterator, least: int, damage: int | None) -> Iterator:
    total: Counter = Counter()

    def rows():
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    for b in batches:
        for ident, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            if not text:
                continue
            text = text.encode().lower().decode()  # A-Z only
            runs = Counter(RUN.findall(text) if len(text) < LONG else (m.group() for m in RUN.finditer(text)))
            start = zlib.crc32(f"{'' if ident is None else ident}:".encode())
            for run, n in runs.items():
                if damage and len(run) >= least:
                    h = zlib.crc32(run.encode(), start)
                    if h % damage == 0:
                        run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= least:
                    total[run] += n
            if len(total) > WORDS:
                yield rows()
                total.clear()
    yield rows()


def word_counts(docs: DataFrame, least: int = 5, times: int = 3, damage: int | None = None) -> DataFrame:
    """word, n: the runs of letters (A-Z, a-z, U+00C0 to U+00FF; A-Z lower-cased) of ``least`` code points that occur ``times`` times or more.

    With ``damage``, a document's run loses the letter h % length where ``damage`` divides h, the CRC-32 of "doc_id:run"; a null doc_id is empty there.
    """
    rows = rows_only(docs, "doc_id", "text").where("text is not null")
    return rows.mapInArrow(lean(lambda it: _runs(it, least, damage)), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


class WaveletTree:
    """A permutation of 0 .. n - 1, kept level by level from the highest bit, zeros before ones."""

    def __init__(self, values: np.ndarray):
        self.levels = []
        for bit in range(max(1, int(len(values) - 1).bit_length()) - 1, -1, -1):
            one = values >> bit & 1 == 1
            self.levels.append((1 << bit, np.concatenate(([0], np.cumsum(~one)))))
            values = np.concatenate((values[~one], values[one]))

    def report(self, lo: np.ndarray, hi: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the query, value) for all values in [low, high) at places [lo, hi) of each query."""
        which, value = np.arange(len(lo)), np.zeros(len(lo), np.int64)
        for size, zeros in self.levels:
            a, b, n = zeros[lo], zeros[hi], zeros[-1]
            which, value = np.concatenate((which, which)), np.concatenate((value, value + size))
            lo, hi = np.concatenate((a, n + lo - a)), np.concatenate((b, n + hi - b))
            keep = (hi > lo) & (value < high[which]) & (value + size > low[which])
            which, value, lo, hi = which[keep], value[keep], lo[keep], hi[keep]
        return which, value


class _Order:
    """Rows (unit, letters) in order, of which the first ``n`` are the dictionary."""

    def __init__(self, unit: np.ndarray, letters: np.ndarray, n: int):
        size, long = letters.shape
        order = np.lexsort((np.ascontiguousarray(letters).view(f"S{long}").ravel(), unit))
        self.place = np.empty(size, np.int64)
        self.place[order] = np.arange(size)
        self.before = np.concatenate(([0], np.cumsum(order < n)))
        self.rank = self.before[self.place[:n]]
        differ = letters[order[1:]] != letters[order[:-1]]
        self.common = np.where(differ.any(1), differ.argmax(1), long)
        self.common[unit[order[1:]] != unit[order[:-1]]] = -1

    def interval(self, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranks of the dictionary's words that share a row's unit and first ``k`` letters: [from, to)."""
        fresh = np.concatenate(([True], self.common < k))
        edges = np.append(np.flatnonzero(fresh), len(fresh))
        group = np.cumsum(fresh)[self.place[rows]] - 1
        return self.before[edges[group]], self.before[edges[group + 1]]


def near_words(words: list[tuple[int, bool, bytes, int]], queries: list[tuple[int, bool, bytes, int]]) -> list[tuple[int, int, int, int]]:
    """(row, near words, count and row of the most frequent, ties to the first in order) among words of L letters and queries of L or L - 1.

    Both are (unit, whether the edit is in the second half, letters, count); rows number the words and then the queries, and only rows
    of one unit are compared.
    """
    rows, n, long = words + queries, len(words), len(words[0][2])
    unit, count = np.array([r[0] for r in rows]), np.array([r[3] for r in rows])
    late, short = np.array([r[1] for r in rows]), np.array([len(r[2]) < long for r in rows])
    letters = np.frombuffer(b"".join(r[2].ljust(long, b"\0") for r in rows), np.uint8).reshape(-1, long)
    back = letters[:, ::-1].copy()
    back[short, :-1], back[short, -1] = back[short, 1:], 0
    ahead, behind = _Order(unit, letters, n), _Order(unit, back, n)
    tree = np.empty(n, np.int64)
    tree[ahead.rank] = behind.rank
    at_rank = np.argsort(behind.rank)
    tree = WaveletTree(tree)
    asked = np.arange(n, len(rows))
    own, end = ahead.interval(asked, long)
    own[own == end] = -1
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    half = -(-long // 2)
    for p in range(long):
        mine = late[asked] == (p >= half)
        q = asked[mine]
        lo, hi = ahead.interval(q, p)
        low, high = behind.interval(q, long - 1 - p)
        some = (hi > lo + (own[mine] >= 0)) & (high > low + (own[mine] >= 0))
        which, value = tree.report(lo[some], hi[some], low[some], high[some])
        q, w = q[some][which], at_rank[value]
        keep = ahead.rank[w] != own[q - n]
        q, w = q[keep], w[keep]
        more = short[q]
        pairs.append((q[~more], w[~more]))
        if p:  # a letter more within a run of it counts at the run's first place
            more &= letters[w, p] != letters[w, p - 1]
        pairs += [(q[more], w[more]), (w[more], q[more])]
    row, other = (np.concatenate(x) for x in zip(*pairs, strict=True))
    order = np.lexsort((ahead.place[other], -count[other], row))
    row, first, near = np.unique(row[order], return_index=True, return_counts=True)
    best = other[order][first]
    return [*zip(row.tolist(), near.tolist(), count[best].tolist(), best.tolist(), strict=True)]


def _search(batches: Iterator, most: int) -> Iterator:
    """Rows sorted by length, unit, and words before queries."""
    words: list = []
    queries: list = []
    unit, long, units, held = None, 0, 0, 0

    def found():
        out = []
        if words and queries:
            rows = words + queries
            out = [(rows[i][2].decode("latin-1"), near, n, rows[best][2].decode("latin-1")) for i, near, n, best in near_words(words, queries)]
        columns = zip(*out, strict=True) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["word", "near", "n", "other"])

    for b in batches:
        for length, late, key, block, query, word, n in zip(*(b.column(c).to_pylist() for c in ("length", "late", "key", "block", "query", "word", "n")), strict=True):
            if (length, late, key, block) != unit:
                if held >= most or length != long:
                    yield found()
                    words, queries, held = [], [], 0
                unit, long, units = (length, late, key, block), length, units + 1
            elif query and held >= 2 * most:  # more queries than fit beside the unit's words
                yield found()
                words, queries = [w for w in words if w[0] == units], []
                held = length * len(words)
            (queries if query else words).append((units, late, word.encode("latin-1"), n))
            held += length
    yield found()


def near_counts(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, best_n, best: for words (word, n) with near words, how many, and the most frequent of them (ties: the smallest)."""
    size = F.length("word")
    rows = []
    for query, long in ((False, size), (True, size), (True, size + 1)):
        for late in (False, True):
            half = F.ceil(long / 2).cast("int")
            rows.append(F.struct(long.alias("length"), F.lit(late).alias("late"), F.xxhash64(F.left("word", half) if late else F.right("word", long - half)).alias("key"), F.lit(query).alias("query")))
    rows = words.select("word", "n", F.explode(F.array(*rows)).alias("r")).select("word", "n", "r.*")
    group = ["length", "late", "key"]
    # Fewer groups than letters of the dictionary by a block's.
    large = rows.where("not query").groupBy(*group).agg(F.ceil(F.sum("length") / block).alias("blocks")).where("blocks > 1")
    rows = rows.join(F.broadcast(large), group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    blocks = F.when(F.col("query"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("word"), F.col("blocks"))))
    rows = rows.withColumn("block", F.explode(blocks)).repartition(*group, "block").sortWithinPartitions(*group, "block", "query")
    found = rows.select(*group, "block", "query", "word", "n").mapInArrow(lean(lambda it: _search(it, block)), "word string, near long, n long, other string")
    best = F.min(F.struct((-F.col("n")).alias("less"), "other"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.other").alias("best"))


def spelling_forms(words: DataFrame, times: int = 2, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n for a dictionary (word, n) of distinct words of code points up to U+00FF.

    A word's form is its most frequent near word (one code point inserted, deleted or replaced; ties: the smallest), if that has ``times``
    times the word's count (``times`` > 1) or more, else null. Counts grow along forms, so following them ends, at the root.
    """
    with Scope(words.sparkSession) as scope:
        words = scope.table(rows_only(words, "word", "n"), "words")
        near = near_counts(words, block)
        taken = F.col("best_n") >= times * F.col("n")
        words = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best")).alias("form"), F.when(taken, F.col("best_n")).alias("form_n"))
        words = scope.table(words, "near")
        steps = scope.table(words.where("form is not null").select("word", F.col("form").alias("to")), "steps")
        total = steps.count()
        # Each round doubles the length of what a step leaps.
        while total:
            ends = steps.groupBy("to").count().join(steps.select(F.col("word").alias("to"), F.col("to").alias("further")), "to", "left")
            ends = scope.table(ends, "ends")
            if not ends.where("further is not null").head(1):
                break
            steps = scope.table(join_heavy(steps, ends, ["to"], "count", total).select("word", F.coalesce("further", "to").alias("to")), "steps")
        words = words.join(steps, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")
        return scope.result(words, "forms")


def spelling_groups(docs: DataFrame, least: int = 5, times: int = 3, damage: int | None = None) -> DataFrame:
    """spelling_forms of the word_counts of ``docs`` (doc_id, text).

    Null and empty texts have no words; repeated rows count each; no words, no rows; other columns are ignored. Words may be of any length.
    """
    return spelling_forms(word_counts(docs, least, times, damage))
