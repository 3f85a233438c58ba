import math
import random

import numpy as np
import pytest

from strandlake.functions import kernels as K


def plain(reference, query, wrong, gaps):
    """The same model over a full matrix, cell by cell, without scaling."""
    n, m, d, e = len(query), len(reference), gaps.open, gaps.more
    leave = 1 / (2 * n + 2)
    t = {"MM": (1 - 2 * d) * (1 - leave), "MI": d * (1 - leave), "MD": d * (1 - leave), "IM": (1 - e) * (1 - leave), "II": e * (1 - leave), "DM": 1 - e, "DD": e}
    hit = lambda i, k: 1.0 if reference[k] > 3 or query[i] > 3 else 1 - wrong[i] if reference[k] == query[i] else wrong[i] * K.MISMATCH
    f = {(0, i, k): 0.0 for i in range(n + 1) for k in range(m + 1)} | {(s, i, k): 0.0 for s in (1, 2) for i in range(n + 1) for k in range(m + 1)}
    for i in range(1, n + 1):
        for k in range(1, m + 1):
            if i == 1:
                f[0, i, k], f[1, i, k] = hit(0, k - 1) * (1 - d) / m, K.INSERTED * d / m
            else:
                f[0, i, k] = hit(i - 1, k - 1) * (t["MM"] * f[0, i - 1, k - 1] + t["IM"] * f[1, i - 1, k - 1] + t["DM"] * f[2, i - 1, k - 1])
                f[1, i, k] = K.INSERTED * (t["MI"] * f[0, i - 1, k] + t["II"] * f[1, i - 1, k])
                f[2, i, k] = t["MD"] * f[0, i, k - 1] + t["DD"] * f[2, i, k - 1]
    return sum((f[0, n, k] + f[1, n, k]) * leave for k in range(1, m + 1))


def test_likelihood_against_a_full_matrix():
    rng = random.Random(1)
    for _ in range(10):
        r = np.array([rng.randrange(5) for _ in range(14)], np.int8)
        q = np.array([*r[3:7], *r[8:12]], np.int8)
        gaps = K.Gaps(0.01, 0.2, 30)
        got, state, post = K.align(r, q, None, gaps)
        # 4.343 * ln is 10 * log10 to four digits.
        want = -4.343 * math.log(plain(r, q, [10 ** (-3.0)] * len(q), gaps) * len(r) * len(q))
        assert abs(got - want) <= 1 and len(state) == len(post) == len(q)


def test_exact_match_and_insertion():
    r = K.codes("GATTACAGATTCCAGTCGATGCA")
    _, state, post = K.align(r, r[4:16])
    assert (state >> 2).tolist() == list(range(4, 16)) and not (state & 1).any() and (post > 10).all()
    _, state, _ = K.align(r, np.concatenate((r[2:9], K.codes("TT"), r[9:18])))
    assert (state & 1).sum() == 2
    assert K.align(r, r[:0])[0] == 0
    with pytest.raises(ValueError):
        K.align(r, r, np.array([1]))


def md(pos, cigar, seq, reference):
    text, n = K.md_nm_of([pos], [cigar], [seq], [reference], [0])
    return text[0], int(n[0])


def cap(pos, cigar, seq, qual, reference):
    return int(K.caps_of([pos], [cigar], [seq], [qual], [reference], [0], [len(reference)])[0])


def test_md_and_caps():
    assert md(1, "4M", "ACGT", "ACGTAC") == ("4", 0)
    assert md(1, "2M2D2M", "ACTT", "ACGGTA") == ("2^GG1A0", 3)
    assert md(2, "1S2M1I1M", "ACGAA", "TCGT") == ("2T0", 2)
    assert md(1, "1=1X1M2D1M", "aCNg", "ATNGCG") == ("1T0N0^GC1", 4)
    assert md(3, "4M", "GTAC", "ACGT") == ("2N0N0", 2)
    assert cap(1, "4M", "ACGT", [30] * 4, "ACGT") == 40
    assert 0 < cap(1, "8M", "ACGTACGA", [30] * 8, "ACGTACGT") < 40 and cap(1, "4M60S", "A" * 64, [40] * 64, "CCCC") == -1
    assert cap(1, "", "", None, "") == 40 and cap(3, "4M10S", "GTAC" + "A" * 10, [40] * 14, "ACGT") == 40  # what leaves the reference, and after it


def plain_md(pos, cigar, seq, reference):
    """Base by base."""
    out, run, n, at, i = "", 0, 0, pos - 1, 0
    for k, o in K.operations(cigar):
        for _ in range(k):
            ref = reference[at].upper() if at < len(reference) else "N"
            if o in "M=X":
                same = o == "=" or o == "M" and (seq[i].upper() == ref != "N" or seq[i] == "=")
                out, run, n = (out, run + 1, n) if same else (f"{out}{run}{ref}", 0, n + 1)
            at, i, n = at + (o in "M=XDN"), i + (o in "M=XIS"), n + (o in "ID")
        if o == "D":
            out, run = f"{out}{run}^{reference[at - k : at].upper()}", 0
    return out + str(run), n


def test_batches_and_pieces_of_references(spark, monkeypatch):
    """Many reads at once, beside pieces of references much shorter than these; against base by base."""
    from strandlake.operators import references

    monkeypatch.setattr(references, "PIECES", (64, 256, 1 << 31))
    rng = random.Random(8)
    names = {f"c{k}": "".join(rng.choice("ACGTacgtN") for _ in range(700 + k)) for k in range(2)}
    rows = []
    for i in range(150):
        ops = [(rng.randrange(1, 40 if rng.random() < 0.95 else 200), rng.choice("MMMIDN=X")) for _ in range(rng.randrange(1, 6))]
        cigar = "3S" + "".join(f"{n}{o}" for n, o in ops) + "2S1H"
        size = 5 + sum(n for n, o in ops if o in "MI=X")
        rows.append((i, f"c{i % 2}", rng.randrange(1, 690), cigar, "".join(rng.choice("ACGTN") for _ in range(size)), "".join(chr(33 + rng.randrange(60)) for _ in range(size))))
    rows.append((999, None, None, "*", "", None))
    df = spark.createDataFrame(rows, "rec_idx long, rname string, pos long, cigar string, seq string, qual string").repartition(3)
    refs = spark.createDataFrame(list(names.items()), "name string, seq string")
    got = {r["rec_idx"]: r for r in K.with_md_nm(df, refs).collect()}
    caps = {r["rec_idx"]: r["cap"] for r in K.with_mapq_cap(df, refs).collect()}
    for i, name, pos, cigar, seq, qual in rows[:-1]:
        assert (got[i]["md_new"], got[i]["nm_new"]) == plain_md(pos, cigar, seq, names[name])
        assert caps[i] == cap(pos, cigar, seq, [ord(c) - 33 for c in qual], names[name])
    assert got[999]["md_new"] is None and caps[999] == -1
    with pytest.raises(Exception, match="no reference named"):
        K.with_md_nm(df, refs.where("name = 'c0'")).collect()


def test_base_modifications():
    assert K.base_modifications("ACCGCA", False, "C+m,1,0;", [9, 8]) == [(2, "+", "m", 9), (4, "+", "m", 8)]
    assert K.base_modifications("TGCGGT", True, "C+m,1,0", [9, 8]) == [(3, "+", "m", 9), (1, "+", "m", 8)][::-1]
    assert K.base_modifications("AC", False, "C+mh,0", [1, 2]) == [(1, "+", "m", 1), (1, "+", "h", 2)]
    assert K.base_modifications("AC", False, None, None) == []
    for mm, ml in (("C+m,1", [1]), ("C+m,0", []), ("C+m,0", [1, 2]), ("X+m,0", [1])):
        with pytest.raises(ValueError):
            K.base_modifications("AC", False, mm, ml)


def test_overlap_counts_bases_once(spark):
    from strandlake.operators.pileup import overlap_qualities

    rows = [("p", 99, "s", 1, "4M", "ACGT", "IIII", 1), ("p", 147, "s", 3, "4M", "GAAA", "5555", 2), ("o", 99, "s", 1, "4M", "ACGT", "IIII", 3)]
    df = spark.createDataFrame(rows, "qname string, flag int, rname string, pos long, cigar string, seq string, qual string, rec_idx long")
    got = {r["rec_idx"]: r["qual_new"] for r in overlap_qualities(df).collect()}
    assert set(got) == {1, 2} and got[1][:2] == [40, 40] and got[2][2:] == [20, 20]
    assert sorted((got[1][2], got[2][0])) == [0, 60] and (got[1][3], got[2][1]) == (32, 0)


def test_base_modifications_of_many_reads():
    """Reads with the same and other tags in one batch, against counting base by base."""
    rng = random.Random(8)
    reads = []
    for _ in range(200):
        seq = "".join(rng.choice("ACGTUN") for _ in range(rng.randrange(0, 40)))
        reverse, parts, n = rng.random() < 0.5, [], 0
        original = "".join(K.COMPLEMENT[c] for c in reversed(seq)) if reverse else seq
        for base in rng.sample("ACGTUN", 2):
            left = [i for i, c in enumerate(original) if base in ("N", c) or (base == "U" and c == "T")]
            deltas = []
            while left and rng.random() < 0.7:
                deltas.append(rng.randrange(min(3, len(left))))
                left = left[deltas[-1] + 1 :]
            kinds = rng.choice(["m", "mh", "76792"])
            parts.append(f"{base}{rng.choice('+-')}{kinds}{rng.choice(['', '.', '?'])}" + "".join(f",{d}" for d in deltas))
            n += len(deltas) * (1 if kinds.isdigit() else len(kinds))
        reads.append((seq, reverse, ";".join(parts) + rng.choice(["", ";"]), rng.choice([None, [rng.randrange(256) for _ in range(n)]])))
    reads += [("ACGTACGTAC", r, "A+m,0,0;C-h,1", [1, 2, 3]) for r in (False, True)] + [("", False, None, None), ("A", True, "", [])]

    def plain(seq, reverse, mm, ml):
        original = "".join(K.COMPLEMENT[c] for c in reversed(seq)) if reverse else seq
        calls = []
        for part in filter(None, (mm or "").split(";")):
            head, *deltas = part.split(",")
            at = -1
            for d in map(int, deltas):
                for _ in range(d + 1):
                    at = next(i for i in range(at + 1, len(original)) if head[0] in ("N", original[i]) or (head[0] == "U" and original[i] == "T"))
                kinds = head[2:].rstrip(".?")
                for kind in [kinds] if kinds.isdigit() else kinds:
                    calls.append((len(seq) - 1 - at if reverse else at, head[1], kind, -1 if ml is None else ml[len(calls)]))
        return sorted(calls, key=lambda c: c[0])

    row, offset, kinds, kind, probability = K.modifications_of(*map(list, zip(*reads, strict=True)))
    got = [[] for _ in reads]
    for r, *call in zip(row.tolist(), offset.tolist(), [kinds[k] for k in kind.tolist()], probability.tolist(), strict=True):
        got[r].append((call[0], *call[1], call[2]))
    assert got == [plain(*r) for r in reads] and sum(map(len, got)) > 300
