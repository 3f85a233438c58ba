"""The prefix trie against a plain version: null turns, ties, repeated rows, turnless conversations, negative ids, long conversations in blocks, nothing at all."""

import hashlib
import math
import random
import zlib

import pytest

from strandlake.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, depth int, block string, ka double, owner long"


def plain(rows, branch=None):
    own = {}
    for c, turn, role, text in sorted((r[:4] for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, hashlib.md5(f"{len(r[2] or '')}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest())):
        own.setdefault(c, []).append((role or "", text or ""))
    paths = own
    if branch:
        paths = {}
        for c in own:
            h = zlib.crc32(str(c).encode()) % branch[1]
            paths[c] = own.get(c - int(math.fmod(c, branch[0])), [])[:h] + own[c][h:]
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(tuple(p[:d]), []).append(c)
    out = set()
    for node, cs in members.items():
        below = [x for x in members if x[: len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in cs if len(paths[c]) == len(node))))
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        kids = {x for x in below if len(x) == len(node) + 1}
        leaves = sum(all(len(paths[c]) == len(x) for c in members[x]) for x in below)
        out.add((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    assert len(out) == len(members)
    return out


def found(spark, rows, branch=None):
    turns = spark.createDataFrame([(*r, 1, "b", 0.5, 7) for r in rows], SCHEMA).repartition(5)
    got = [tuple(r) for r in trie.prefix_trie(turns, branch).collect()]
    assert len(set(got)) == len(got)
    return set(got)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for c in [*range(-12, 40), 2**40, 2**40 + 1]:
        for t in range(rng.randrange(1, 12)):
            out.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "ä😀"])))
    out += [(None, 1, "user", "lost"), (50, None, None, None), (50, None, "", ""), (50, 3, "user", None), (51, 1, "x", "y"), (51, 1, "x", "y"), (51, 1, "x", "a"), (60, 1, "u", "gone" * 5000)]
    return out + out[:4]


@pytest.mark.parametrize("branch", [None, (5, 9)])
def test_trie(spark, rows, branch):
    assert found(spark, rows, branch) == plain(rows, branch)


def test_long_and_many_equal_conversations(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    monkeypatch.setattr(trie, "IDS", 7)
    rows = [(c, t, "r", f"t{t}") for c in (1, 2) for t in range(100)] + [(2, 100 + t, "r", "end") for t in range(60)]
    rows += [(c, 1, "r", "same") for c in range(100, 300)] + [(c, 2, "r", f"u{c % 2}") for c in range(150, 300)] + [(7, None, "r", "again")] * 70
    for branch in (None, (5, 9)):
        assert found(spark, rows, branch) == plain(rows, branch)


def test_nothing(spark):
    assert found(spark, []) == set() and found(spark, [(None, 1, "a", "b")], (5, 9)) == set()
