"""Spelling variants against brute force: blocks, hot groups, equal letters in a row, ties, very long words, nothing."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from strandlake.llm import spelling

SCHEMA = "doc_id long, text string, word string, n int, length string, key double, best long, block int"


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def plain(counts):
    out, form = set(), {}
    links = {w: [x for x in counts if near(w, x)] for w in counts}
    for w, others in links.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, counts[w], len(links[w]), form[w] and counts[form[w]]))
    return out


def plain_counts(rows, damage=None):
    total = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.encode().lower().decode()
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("block", [1 << 20, 64, 400])
def test_forms(spark, block):
    rng = random.Random(block)
    words = {"".join(rng.choice("aabcé") for _ in range(rng.randrange(5, 9))): rng.choice([1, 2, 3, 6, 12, 30, 70]) for _ in range(700)}
    words |= {"prefix" + "".join(rng.choice("abÿ") for _ in range(5)): rng.randrange(1, 90) for _ in range(150)}
    words |= {"x" * 3000: 3, "x" * 3001: 7, "x" * 2999 + "y": 20, "y" + "x" * 2999: 20, "z" * 40: 1}
    frame = spark.createDataFrame([*words.items()], "word string, n long").repartition(3)
    got = [tuple(r) for r in spelling.spelling_forms(frame, block=block).collect()]
    assert len(got) == len(words) and set(got) == plain(words)
    assert max(r[4] for r in got) > 5 and any(r[1] and r[1] != r[2] for r in got)


def test_documents(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randrange(3, 8))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(words).title() if rng.random() < 0.3 else rng.choice(words) for _ in range(200)) + "×a1b÷") for i in range(40)]
    rows += [(None, "lonely lonely Lonely lonelyÀ"), (None, None), (90, ""), (91, "q" * 70000 + " " + "Ab" * 40000), *rows[:3]]
    docs = spark.createDataFrame([(*r, "w", 1, "l", 0.5, 3, 4) for r in rows], SCHEMA).repartition(4)
    for damage in (None, 3):
        counts = plain_counts(rows, damage)
        assert {tuple(r) for r in spelling.spelling_groups(docs, damage=damage).collect()} == plain(counts)
    assert spelling.spelling_groups(docs.where("doc_id = 90")).count() == 0 and spelling.spelling_groups(docs.limit(0), damage=97).count() == 0


def test_words_leave_in_parts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "WORDS", 3)
    monkeypatch.setattr(spelling, "LONG", 5)
    rows = [(i, "alpha beta gamma delta epsilon Alpha zetaé") for i in range(9)]
    got = {r["word"]: r["n"] for r in spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_counts(rows)


def test_wavelet_tree():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 256, 300):
        values = rng.permutation(n)
        lo, low = rng.integers(0, n + 1, 200), rng.integers(0, n + 1, 200)
        hi, high = lo + rng.integers(0, 9, 200), low + rng.integers(0, 40, 200)
        hi = np.minimum(hi, n)
        which, value = spelling.WaveletTree(values).report(lo, hi, low, high)
        want = sorted((q, int(v)) for q in range(200) for v in values[lo[q] : hi[q]] if low[q] <= v < high[q])
        assert sorted(zip(which.tolist(), value.tolist(), strict=True)) == want
