"""Lockstep alignment, local mismatch scores, indel scores and BAQ states against plain versions."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandlake.functions import kernels as K
from strandlake.operators import indels, pileup


def full_matrix(reference, query, quality, gaps):
    """(Phred likelihood, posterior of each state) of the same model, cell by cell in plain floats, without band or scaling."""
    n, m, d, e = len(query), len(reference), gaps.open, gaps.more
    wrong = [10 ** (-q / 10) for q in quality]
    leave = 1 / (2 * n + 2)
    t = {"MM": (1 - 2 * d) * (1 - leave), "MI": d * (1 - leave), "MD": d * (1 - leave), "IM": (1 - e) * (1 - leave), "II": e * (1 - leave), "DM": 1 - e, "DD": e}
    hit = lambda i, k: 1.0 if reference[k - 1] > 3 or query[i - 1] > 3 else 1 - wrong[i - 1] if reference[k - 1] == query[i - 1] else wrong[i - 1] * K.MISMATCH
    f, b = ({(s, i, k): 0.0 for s in "MID" for i in range(n + 2) for k in range(m + 2)} for _ in range(2))
    for i in range(1, n + 1):
        for k in range(1, m + 1):
            if i == 1:
                f["M", i, k], f["I", i, k] = hit(1, k) * (1 - d) / m, K.INSERTED * d / m
            else:
                f["M", i, k] = hit(i, k) * (t["MM"] * f["M", i - 1, k - 1] + t["IM"] * f["I", i - 1, k - 1] + t["DM"] * f["D", i - 1, k - 1])
                f["I", i, k] = K.INSERTED * (t["MI"] * f["M", i - 1, k] + t["II"] * f["I", i - 1, k])
                f["D", i, k] = t["MD"] * f["M", i, k - 1] + t["DD"] * f["D", i, k - 1]
    for i in range(n, 0, -1):
        for k in range(m, 0, -1):
            if i == n:
                b["M", i, k] = b["I", i, k] = leave
                continue
            step = hit(i + 1, k + 1) * b["M", i + 1, k + 1] if k < m else 0.0
            b["D", i, k] = (t["DM"] * step + t["DD"] * b["D", i, k + 1]) if i > 1 else 0.0
            b["M", i, k] = t["MM"] * step + K.INSERTED * t["MI"] * b["I", i + 1, k] + t["MD"] * b["D", i, k + 1]
            b["I", i, k] = t["IM"] * step + K.INSERTED * t["II"] * b["I", i + 1, k]
    total = sum(f["M", n, k] + f["I", n, k] for k in range(1, m + 1)) * leave
    post = [{((k - 1) << 2 | s): f["MI"[s], i, k] * b["MI"[s], i, k] for k in range(1, m + 1) for s in (0, 1)} for i in range(1, n + 1)]
    return K.PHRED * math.log(total * m * n), post


def test_lockstep_against_a_full_matrix():
    rng = random.Random(1)
    cases = []
    for _ in range(60):
        r = [rng.randrange(4) if rng.random() > 0.03 else 4 for _ in range(rng.randrange(8, 22))]
        q = list(r[rng.randrange(4) :])[: rng.randrange(3, 18)]
        for _ in range(rng.randrange(3)):
            k = rng.randrange(len(q))
            q[k : k + rng.randrange(2)] = [rng.randrange(4)] * rng.randrange(1, 3)
        cases.append((np.array(r, np.int8), np.array(q, np.int8), np.array([rng.randrange(3, 41) for _ in q]), K.Gaps(*rng.choice([(1e-3, 0.1, 40), (1e-4, 1e-2, 40)]))))
    r, q, w, g = zip(*cases, strict=True)
    found = K.align_many(r, q, w, g)
    assert K.align_many([r[0], r[0][:0]], [q[0][:0], q[0]], [None, None], g[:2])[0][0] == 0
    only = K.align_many(r, q, w, g, states=False)
    for case, (phred, state, post), (alone, *_) in zip(cases, found, only, strict=True):
        want, chances = full_matrix(*case)
        assert phred == alone == int(want + 0.499)
        for s, p, c in zip(state.tolist(), post.tolist(), chances, strict=True):
            best, total = max(c.values()), sum(c.values())
            assert c[s] > best * (1 - 1e-9)
            rest = 1 - best / total
            assert rest < 1e-9 or abs(p - min(99, int(K.PHRED * math.log(rest) + 0.499))) <= 1


def plain_local_nm(seq, qual, cigar, md, halo, clip):
    """Step by step: the quality of the base before, or of the last one that had eight more after it."""
    q = [ord(c) - 33 for c in qual] + [0] * (len(seq) - len(qual))
    out, n = [0] * len(seq), len(seq)
    lead = next((i for i, c in enumerate(seq) if c != seq[0]), n)
    before = min(q[: min(lead, 8)], default=0)
    for i in range(8, n):
        out[i] += max(0, q[i] - q[i] // 3 - before)
        if i + 8 < n:
            before = q[i]
    ops = re.findall(r"(\d+)(.)", cigar)
    for ends, order in ((ops, range(n)), (ops[::-1], range(n - 1, -1, -1))):
        kinds = [o for _, o in ends[:2]]
        if kinds[:1] == ["S"] or kinds == ["H", "S"]:
            for k, i in enumerate(order):
                out[i] += clip if k < halo else clip // 2 if k < 2 * halo else 0
    at = 0
    for n_, gone, base in re.findall(r"(\d+)|(\^[A-Z]+)|([A-Z])", md or ""):
        if n_:
            at += int(n_)
        elif base:
            for i in range(n):
                d = i - at
                out[i] += 10 if -halo <= d < halo else 5 if -2 * halo <= d < 2 * halo else 0
    return out, [min(100, len(m.group()) - 1) for m in re.finditer(r"(.)\1*", seq) for _ in m.group()]


def test_local_nm(spark):
    rng = random.Random(2)
    rows = []
    for i in range(120):
        n = rng.choice([0, 1, 5, 8, 9, 12, 16, 17, 18, 40, 300])
        seq = "".join(rng.choice("AAC") for _ in range(n)) if i % 5 else "G" * n
        qual = "".join(chr(33 + rng.randrange(60)) for _ in range(n)) if i % 7 else None
        cigar = rng.choice([f"{n}M", f"5S{n}M", f"3H2S{n}M5H", f"{n}M4S", f"{n}M4S2H", f"9H{n}M"])
        md = rng.choice([None, str(n), "3A0C5^AC0G9", f"{n // 2}T{n // 3}", "0A"])
        rows.append((i, seq, qual, cigar, md))
    df = spark.createDataFrame(rows, "i int, seq string, qual string, cigar string, md string").repartition(3)
    for halo, clip in ((50, 60), (4, 7)):
        for r in K.with_local_nm(df, halo, clip).collect():
            score, run = plain_local_nm(r["seq"], r["qual"] or "", r["cigar"], r["md"], halo, clip)
            assert (r["local_nm"], r["homopolymer"]) == (score, run), r
    cell = spark.createDataFrame([("c", 5, "2M1D2M1S", "AACCG", "IIIII", "2^T2", 0)], "rname string, pos long, cigar string, seq string, qual string, md string, i int")
    got = pileup.local_nm_cells(cell, ["i"], halo=1, clip=40).orderBy("position").collect()
    # Clips cost 40 for the last base and 20 for the one before; a cell shows the base after its own, beyond the end the last one whole.
    assert [(r["position"], r["nm_local"], r["homopolymer"]) for r in got] == [(5, 0.0, 1), (6, 0.0, 1), (7, 2.0, 1), (8, 2.0, 1), (9, 4.0, 0)]


def test_indel_scores(spark):
    rng = random.Random(3)
    contig = "".join(rng.choice("ACGT") for _ in range(400))
    reads, variants = [], []
    for i in range(25):
        at = rng.randrange(20, 330)
        seq = contig[at : at + 30] if i % 2 else contig[at : at + 12] + contig[at + 14 : at + 32]
        qual = None if i % 5 == 0 else "".join(chr(33 + rng.randrange(45)) for _ in range(len(seq) + 3))
        reads.append((i, "c", at + 1, f"2H3S{len(seq)}M", "TTT" + seq, qual))
        variants += [(i, "c", at + 12, contig[at + 11 : at + 14], contig[at + 11]), (100 + i, "c", at + 6, contig[at + 5], contig[at + 5] + "GG")]
    variants += [(900, "c", 50, "N", "<DEL>"), (901, "c", 60, contig[59], "T"), (902, "c", 70, "NNN", "N"), (903, "d", 70, "AC", "A")]
    reads += [(90, "c", 40, "10M20N20M", "A" * 30, None), (91, "c", 40, "30M", None, None)]
    r = spark.createDataFrame(reads, "rec_idx int, rname string, pos long, cigar string, seq string, qual string")
    v = spark.createDataFrame(variants, "rec_idx int, contig string, pos long, ref string, alt string")
    got = {(x["read"], x["variant"]): (x["ref_score"], x["alt_score"]) for x in indels.indel_scores(r, v, spark.createDataFrame([("c", contig)], "name string, seq string")).collect()}
    want = {}
    for i, _, pos, _, seq, qual in reads[:25]:
        bases, q = K.codes(seq[3:]), [30] * (len(seq) - 3) if qual is None else [min(30, max(7, ord(c) - 33)) for c in qual[3:]]
        stop = pos - 1 + len(bases)
        for j, c, p, ref, alt in variants[:50]:
            if pos - 1 <= p - 1 and p - 1 + len(ref) <= stop:
                lo, hi = pos - 11, stop + 10
                plain, changed = contig[lo:hi], contig[lo : p - 1] + alt + contig[p - 1 + len(ref) : hi]
                want[i, j] = tuple(full_matrix(K.codes(h), bases, q, indels.GAPS)[0] for h in (plain, changed))
    assert got.keys() == want.keys() and len(want) > 50
    # The band leaves out ways that hardly count.
    assert all(abs(a - b) <= 1 for k in want for a, b in zip(got[k], want[k], strict=True))
    assert all(b < a for (i, j), (a, b) in got.items() if i == j and i % 2 == 0)


def test_baq_states(spark):
    rng = random.Random(4)
    contig = "".join(rng.choice("ACGT") for _ in range(200))
    seq = contig[50:70] + "T" + contig[71:90]
    rows = [(0, 0, 51, "40M", seq, "I" * 40, None, None), (1, 0, 51, "40M", seq, "I" * 40, "@" * 40, None), (2, 0, 51, "40M", seq, "I" * 40, None, "A" * 40), (3, 0, 51, "40M", seq, "I" * 40, "@" * 40, "A" * 40), (4, 4, 51, "40M", seq, "I" * 40, "@" * 40, None), (5, 0, 51, "20M9N20M", seq, "I" * 40, "@" * 40, None)]
    rows = [(i, flag, "c", *rest) for i, flag, *rest in rows]
    df = spark.createDataFrame(rows, "i int, flag int, rname string, pos long, cigar string, seq string, qual string, bq string, zq string")
    reference = spark.createDataFrame([("c", contig)], "name string, seq string")
    tag = {r["i"]: r["t"] for r in K.with_alignment_quality(df, reference).select("i", K.baq_tag(F.col("qual"), F.col("baq")).alias("t")).collect()}
    assert set(tag[0]) != {"@"}
    for apply in (False, True):
        for force in (False, True):
            got = {r["i"]: r for r in K.with_recalculated_quality(df, reference, apply, force).collect()}
            for row in rows:
                i, qual, bq, zq = row[0], *row[6:]
                if zq:
                    want = (qual, None if force else bq, zq)
                elif (bq and not force) or i in (4, 5):
                    want = (qual, bq, zq)
                elif apply:
                    want = ("".join(chr(ord(a) - (ord(b) - 64)) for a, b in zip(qual, tag[i], strict=True)), None, tag[i])
                else:
                    want = (qual, tag[i], None)
                assert (got[i]["qual"], got[i]["bq"], got[i]["zq"]) == want and got[i]["pos"] == 51
