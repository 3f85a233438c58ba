"""Per-read kernels in numpy, run as Arrow-batched functions over reads joined with their reference.

A banded pair HMM (alignment likelihood, most likely states and their quality), caps of mapping
qualities, and the MD and NM tags.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.references import with_bases
from .filters import ON_REFERENCE, cigar_sum
from .scalars import shifted_qualities

#: Emission of an inserted base, share of an error per other base, and natural log to Phred. Fixed values.
INSERTED, MISMATCH, PHRED = 0.25, 0.33333333333, -4.343


@dataclass(frozen=True)
class Gaps:
    """Chances to open and to go on with a gap, and the band's half width."""

    open: float = 0.001
    more: float = 0.1
    band: int = 10


def codes(seq: str) -> np.ndarray:
    """A, C, G, T as 0 to 3, anything else as 4."""
    table = np.full(256, 4, np.int8)
    for i, c in enumerate("ACGT"):
        table[ord(c)] = table[ord(c.lower())] = i
    return table[np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)]


#: Cells of the dynamic programme (reads x bases x band) that are kept at a time.
CELLS = 2_000_000


def align(reference: np.ndarray, query: np.ndarray, quality: np.ndarray | None = None, gaps: Gaps = Gaps()) -> tuple[int, np.ndarray, np.ndarray]:
    """(Phred likelihood, state per base, Phred quality of the state) of a query within a reference window; see align_many."""
    return align_many([reference], [query], [quality], [gaps])[0]


def align_many(references: Sequence[np.ndarray], queries: Sequence[np.ndarray], qualities: Sequence[np.ndarray | None], gaps: Sequence[Gaps], states: bool = True) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(Phred likelihood, state per base, Phred quality of the state) of each query within its reference window.

    A state is 4 * reference offset, plus 1 for an inserted base. Queries with the same band and chances go through the
    dynamic programme together, base by base, longer ones first, so that those that are done fall away at the end. Without
    ``states`` only likelihoods are worked out, and nothing is kept but the last row. Empty queries or windows have likelihood 0.
    """
    none = np.empty(0, np.int64)
    out = [(0, none, none)] * len(queries)
    groups: dict[tuple[float, float, int], list[int]] = {}
    for i, (r, q, w, g) in enumerate(zip(references, queries, qualities, gaps, strict=True)):
        if w is not None and len(w) != len(q):
            raise ValueError("as many qualities as bases are needed")
        if len(q) and len(r):
            groups.setdefault((g.open, g.more, max(min(max(len(r), len(q)), g.band), abs(len(r) - len(q)))), []).append(i)
    for (open_, more, band), which in groups.items():
        which.sort(key=lambda i: -len(queries[i]))
        at = 0
        while at < len(which):
            each = (2 * band + 1) * (len(queries[which[at]]) if states else 1)
            part = which[at : at + max(1, CELLS // each)]
            at += len(part)
            found = _Lockstep([references[i] for i in part], [queries[i] for i in part], [qualities[i] for i in part], Gaps(open_, more, band)).run(states)
            for i, x in zip(part, found, strict=True):
                out[i] = x
    return out


class _Lockstep:
    """The forward and backward rows of many queries, longest first, in columns that move with the band: offset o of row i is reference base i - band + o."""

    def __init__(self, references: list[np.ndarray], queries: list[np.ndarray], qualities: list[np.ndarray | None], gaps: Gaps):
        self.gaps, self.wide = gaps, 2 * gaps.band + 1
        self.n, self.m = (np.array([len(x) for x in xs], np.int64) for xs in (queries, references))
        self.rows = int(self.n[0])
        # How many queries have a base i, for i from 0 to one more than the longest.
        self.active = np.searchsorted(-self.n, -np.arange(self.rows + 2), "right")
        self.reference = np.full((len(queries), self.rows + 2 * gaps.band + 2), -1, np.int8)
        self.query = np.zeros((len(queries), self.rows), np.int8)
        self.wrong = np.zeros((len(queries), self.rows))
        for i, (r, q, w) in enumerate(zip(references, queries, qualities, strict=True)):
            r = r[: self.reference.shape[1] - gaps.band]
            self.reference[i, gaps.band : gaps.band + len(r)] = r
            self.query[i, : len(q)] = q
            self.wrong[i, : len(q)] = 10.0 ** (-(np.full(len(q), 30) if w is None else np.asarray(w)).astype(np.float64) / 10)
        step = np.arange(self.wide)[None, :] - np.arange(self.wide)[:, None] - 1
        self.gone = np.where(step >= 0, gaps.more ** np.maximum(step, 0), 0.0)  # what a deletion from one column is worth in another

    def hits(self, i: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(chance that base i, from 1, is read from each column, which columns there are) for the first n queries."""
        r, q, w = self.reference[:n, i - 1 : i - 1 + self.wide], self.query[:n, i - 1 : i], self.wrong[:n, i - 1 : i]
        there = r >= 0
        return np.where((r > 3) | (q > 3), 1.0, np.where(r == q, 1 - w, w * MISMATCH)) * there, there

    def run(self, states: bool) -> list[tuple[int, np.ndarray, np.ndarray]]:
        d, e, size = self.gaps.open, self.gaps.more, len(self.n)
        leave = 1 / (2.0 * self.n + 2)
        stay = (1 - leave)[:, None]
        mm, mi, im, ii, dm = (1 - 2 * d) * stay, d * stay, (1 - e) * stay, e * stay, 1 - e
        scale, kept = np.ones((self.rows + 2, size)), []
        fm = fi = fd = np.zeros((size, self.wide))
        ends = np.zeros(size)
        for i in range(1, self.rows + 1):
            n = self.active[i]
            hit, there = self.hits(i, n)
            if i == 1:
                fm, fi, fd = hit * ((1 - d) / self.m)[:, None], INSERTED * there * (d / self.m)[:, None], np.zeros((size, self.wide))
            else:
                last = 1 / scale[i - 1, :n, None]
                up = np.zeros((2, n, self.wide))
                up[0, :, :-1], up[1, :, :-1] = fm[:n, 1:], fi[:n, 1:]
                fm, fi = hit * last * (mm[:n] * fm[:n] + im[:n] * fi[:n] + dm * fd[:n]), INSERTED * there * last * (mi[:n] * up[0] + ii[:n] * up[1])
                fd = (mi[:n] * fm) @ self.gone * there
            scale[i, :n] = fm.sum(1) + fi.sum(1) + fd.sum(1)
            done = self.active[i + 1]
            ends[done:n] = fm[done:].sum(1) + fi[done:].sum(1)
            if states:
                kept.append((fm, fi))
        last = ends * leave / scale[self.n, np.arange(size)]
        phred = PHRED * (np.log(scale[1:-1]).sum(0) + np.log(last) + np.log(self.m * self.n))
        phred = (phred + 0.499).astype(np.int64).tolist()
        if not states:
            return [(x, np.empty(0, np.int64), np.empty(0, np.int64)) for x in phred]
        state, post = np.full((size, self.rows), -1, np.int64), np.zeros((size, self.rows), np.int64)
        bm = bi = hit = np.zeros((0, self.wide))
        for i in range(self.rows, 0, -1):
            n, old = self.active[i], len(bm)
            there = self.reference[:n, i - 1 : i - 1 + self.wide] >= 0
            s = scale[i, :n, None]
            back = np.zeros((2, n, self.wide))
            if old:
                hit = hit * bm
                down = np.zeros((old, self.wide))
                down[:, 1:] = INSERTED * bi[:, :-1]
                gone = hit @ self.gone.T * (dm * mi[:old]) if i > 1 else 0.0
                back[0, :old] = (hit * mm[:old] + mi[:old] * down + gone) / s[:old]
                back[1, :old] = (hit * im[:old] + ii[:old] * down) / s[:old]
            back[:, old:] = (leave[old:n] / scale[i, old:n] / last[old:n])[:, None]
            bm, bi = back * there
            hit = self.hits(i, n)[0]
            both = np.stack((kept[i - 1][0] * bm, kept[i - 1][1] * bi), 2).reshape(n, -1) / s
            at = both.argmax(1)
            best, total = both[np.arange(n), at], both.sum(1)
            state[:n, i - 1] = np.where(best > 0, (i - 1 - self.gaps.band + at // 2) << 2 | at % 2, -1)
            rest = 1 - np.divide(best, total, out=np.zeros(n), where=total > 0)
            post[:n, i - 1] = np.where(rest > 0, np.minimum(99, (PHRED * np.log(np.where(rest > 0, rest, 1.0)) + 0.499).astype(np.int64)), 99)
        return [(x, state[k, : self.n[k]], post[k, : self.n[k]]) for k, x in enumerate(phred)]


_CIGAR = re.compile(r"(\d+)([MIDNSHP=X])")


def operations(cigar: str | None) -> list[tuple[int, str]]:
    return [(int(n), o) for n, o in _CIGAR.findall(cigar or "")]


#: Bases with an exact code of their own in the 4-bit alphabet; N is 15, = is 0. Fixed values.
NT16 = {c: i for i, c in enumerate("=ACMGRSVTWYHKDBN")}


_CODE = np.full(256, 15, np.uint8)
_CODE[[ord(c) for c in NT16]] = list(NT16.values())
_CODE[[ord(c.lower()) for c in NT16]] = list(NT16.values())
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[ord("a") : ord("z") + 1] -= 32


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(all characters, where each text starts)."""
    parts = [t.encode("latin-1", "replace") for t in texts]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(size) - size


class Blocks:
    """The CIGAR operations of many reads as arrays, and where each lies on its reference (0-based) and in its read."""

    def __init__(self, pos: list[int], cigars: list[str]):
        known = {c: operations(c) for c in set(cigars)}
        count = np.array([len(known[c]) for c in cigars], np.int64)
        flat = [o for c in cigars for o in known[c]]
        self.row = np.repeat(np.arange(len(cigars)), count)
        self.n = np.array([n for n, _ in flat], np.int64)
        self.op = np.array([o for _, o in flat], "U1")
        self.aligned = np.isin(self.op, list("M=X"))
        first = np.cumsum(count) - count

        def before(used: np.ndarray) -> np.ndarray:
            total = np.concatenate(([0], np.cumsum(np.where(used, self.n, 0))))
            return total[:-1] - total[first[self.row]]

        self.at = before(self.aligned | np.isin(self.op, list("DN"))) + np.array(pos, np.int64)[self.row] - 1
        self.i = before(self.aligned | np.isin(self.op, list("IS")))

    def bases(self, which: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(operation, offset in it) of the first n bases of each of the operations ``which``."""
        op = np.repeat(which, n)
        return op, np.arange(len(op)) - np.repeat(np.cumsum(n) - n, n)


def _sum(row: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, values, rows)


def caps_of(pos: list[int], cigars: list[str], seqs: list[str], quals: list[list[int] | None], bases: list[str], froms: list[int], sizes: list[int], threshold: int = 40) -> np.ndarray:
    """The highest mapping quality that each read's mismatches and clips leave it; -1 if it should be dropped.

    ``bases``: of the reference from ``froms`` on, whose length is ``sizes``. A read is judged up to the operation that
    leaves its reference. Its evidence against it: mismatches' qualities (at most 33 each) less the Phred value of the
    ways to choose as many of its bases, and a fifth of what its clips are worth; hard clips are worth 13 a base. Only
    known bases of quality 13 and more are looked at, but all matched ones count as chances for a mismatch once more.
    """
    threshold, rows = 40 if threshold < 0 else threshold, len(pos)
    b = Blocks(pos, cigars)
    seq, seq_at = _joined(seqs)
    ref, ref_at = _joined(bases)
    quality = np.concatenate([np.empty(0, np.int64), *(np.asarray(q if q is not None else [255] * len(s), np.int64) for q, s in zip(quals, seqs, strict=True))])
    room = np.array(sizes, np.int64)[b.row] - b.at if rows else np.empty(0, np.int64)
    leaves = (b.aligned | (b.op == "D")) & (b.n > room)
    # Operations after the first that leaves the reference don't count.
    total = np.cumsum(leaves) - leaves
    first = np.searchsorted(b.row, np.arange(rows))
    counts = total == total[first[b.row]] if len(total) else np.empty(0, bool)
    own = np.flatnonzero(b.aligned & counts)
    op, j = b.bases(own, np.clip(np.minimum(b.n, room)[own], 0, None))
    row = b.row[op]
    place = seq_at[row] + b.i[op] + j
    x, y, q = _CODE[seq[place]], _CODE[ref[ref_at[row] + b.at[op] + j - np.array(froms, np.int64)[row]]], quality[place]
    seen = (x != 15) & (y != 15) & (q >= 13)
    other = seen & (x != 0) & (x != y)
    wrong = np.bincount(row[other], minlength=rows)
    against = _sum(row[other], np.minimum(q[other], 33), rows)
    whole = own[~leaves[own]]
    chances = np.bincount(row[seen], minlength=rows) + _sum(b.row[whole], b.n[whole], rows)
    summed = np.concatenate(([0], np.cumsum(quality)))
    soft, hard = np.flatnonzero((b.op == "S") & counts), np.flatnonzero((b.op == "H") & counts)
    start = seq_at[b.row[soft]] + b.i[soft]
    end = np.minimum(start + b.n[soft], np.append(seq_at, len(seq))[b.row[soft] + 1])
    clipped = _sum(b.row[soft], summed[end] - summed[start], rows) + _sum(b.row[hard], 13 * b.n[hard], rows)
    log_factorial = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1, int(wrong.max(initial=0)) + 1)))))
    ways = np.where(wrong > 0, wrong * np.log(np.maximum(chances, 1)) - log_factorial[wrong], 0.0)
    t = against + PHRED * ways + clipped / 5
    return np.where(t > threshold, -1, (np.sqrt(np.clip(threshold - np.maximum(t, 0), 0, None) / threshold) * threshold + 0.499).astype(np.int64))


def md_nm_of(pos: list[int], cigars: list[str], seqs: list[str], bases: list[str], froms: list[int]) -> tuple[list[str], np.ndarray]:
    """MD texts and NM: runs of matches, reference bases of mismatches, ^ and the bases of deletions; = and X are taken at their word.

    Beyond ``bases`` (of the reference from ``froms`` on) the reference is N.
    """
    rows, b = len(pos), Blocks(pos, cigars)
    seq, seq_at = _joined(seqs)
    ref, ref_at = _joined(bases)
    seq, ref = _UPPER[seq], np.append(_UPPER[ref], np.uint8(ord("N")))
    ref_end = np.append(ref_at, len(ref) - 1)[1:]
    own = np.flatnonzero(b.aligned)
    op, j = b.bases(own, b.n[own])
    row = b.row[op]
    s = seq[seq_at[row] + b.i[op] + j]
    there = ref_at[row] + b.at[op] + j - np.array(froms, np.int64)[row]
    r = ref[np.where(there < ref_end[row], there, len(ref) - 1)]
    same = (b.op[op] == "=") | (b.op[op] == "M") & ((s == r) & (s != ord("N")) | (s == ord("=")))
    matched = np.concatenate(([0], np.cumsum(same)))
    begin = np.searchsorted(row, np.arange(rows))  # a read's first matched base
    miss, gone = np.flatnonzero(~same), np.flatnonzero(b.op == "D")
    # Events in order: mismatches at their base, deletions before the base that follows them.
    place = np.concatenate((miss, np.searchsorted(op, gone)))
    owner = np.concatenate((row[miss], b.row[gone]))
    kind = np.concatenate((op[miss], gone))
    order = np.lexsort((place, kind, owner))
    out: list[list[str]] = [[] for _ in range(rows)]
    last = matched[begin].tolist() if rows else []
    text = [chr(c) for c in r[miss].tolist()]
    for e in gone.tolist():
        k = int(b.row[e])
        at = int(b.at[e]) - froms[k]
        text.append("^" + bases[k][at : at + int(b.n[e])].upper())
    for e in order.tolist():
        k, m = int(owner[e]), int(matched[place[e]])
        out[k] += [str(m - last[k]), text[e]]
        last[k] = m
    end = matched[np.append(begin, len(row))[1:]].tolist() if rows else []
    md = ["".join([*x, str(e - m)]) for x, e, m in zip(out, end, last, strict=True)]
    ins = b.op == "I"
    nm = np.bincount(row[miss], minlength=rows) + _sum(b.row[gone], b.n[gone], rows) + _sum(b.row[ins], b.n[ins], rows)
    return md, nm.astype(np.int64)


#: What the kernels look at.
NEEDED = ["rname", "pos", "cigar", "seq", "qual", "__from", "__bases", "__size"]


def _beside_reference(reads: DataFrame, references: DataFrame, pad: Column, f: Callable[[list[dict]], list], names: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """``f`` of each batch's reads (NEEDED columns), which have the bases under them (and ``pad`` more on both sides) beside them: __from, __bases, __size. An unknown contig is an error."""
    span = cigar_sum(F.col("cigar"), ON_REFERENCE)
    joined = with_bases(reads, references, "rname", F.col("pos") - 1 - pad, F.col("pos") - 1 + F.greatest(span, F.lit(1)) + pad)
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in reads.schema)

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            rows = b.select([c for c in NEEDED if c in b.schema.names]).to_pylist()
            for r in rows:
                if r["rname"] is not None and r["__size"] is None:
                    raise ValueError(f"no reference named {r['rname']}")
            found = f(rows)
            yield pa.RecordBatch.from_arrays([*b.drop_columns(["__from", "__bases", "__size"]).columns, *[pa.array(c, k) for c, (_, k, _) in zip(found, names, strict=True)]], names=[*b.schema.names[:-3], *[n for n, _, _ in names]])

    return joined.mapInArrow(run, fields + "".join(f", {n} {t}" for n, _, t in names))


def _column(rows: list[dict], name: str, missing=None) -> list:
    return [missing if r[name] is None else r[name] for r in rows]


def with_md_nm(reads: DataFrame, references: DataFrame) -> DataFrame:
    """``reads`` with md_new and nm_new; NULL for unmapped reads."""

    def run(rows: list[dict]) -> list:
        mapped = [i for i, r in enumerate(rows) if r["pos"] is not None and r["cigar"] not in (None, "*")]
        own = [rows[i] for i in mapped]
        md, nm = md_nm_of(*(_column(own, c, "") for c in ("pos", "cigar", "seq", "__bases")), _column(own, "__from", 0))
        out: list[list] = [[None] * len(rows), [None] * len(rows)]
        for i, m, n in zip(mapped, md, nm.tolist(), strict=True):
            out[0][i], out[1][i] = m, n
        return out

    return _beside_reference(reads, references, F.lit(0), run, [("md_new", pa.string(), "string"), ("nm_new", pa.int32(), "int")])


def with_mapq_cap(reads: DataFrame, references: DataFrame, threshold: int = 40) -> DataFrame:
    """``reads`` with cap; -1 for reads without a position."""

    def run(rows: list[dict]) -> list:
        mapped = [i for i, r in enumerate(rows) if r["pos"] is not None]
        own = [rows[i] for i in mapped]
        quals = [[ord(c) - 33 for c in r["qual"]] if r.get("qual") else None for r in own]
        found = caps_of(*(_column(own, c, "") for c in ("pos", "cigar", "seq")), quals, _column(own, "__bases", ""), _column(own, "__from", 0), _column(own, "__size", 0), threshold)
        out = np.full(len(rows), -1)
        out[mapped] = found
        return [out.tolist()]

    return _beside_reference(reads, references, F.lit(0), run, [("cap", pa.int32(), "int")])


def _width(span: int, used: int, band: int) -> int:
    return max(band, abs(span - used) + 3)


def baq_tag(qual: Column, baq: Column) -> Column:
    """The BQ tag: per base the character 64 + quality - baq, which scalars.shifted_qualities applies and reverts."""
    own = F.transform(F.split(qual, ""), lambda c: F.ascii(c) - 33)
    return F.array_join(F.zip_with(own, baq, lambda q, b: F.char(q - b + 64)), "")


def with_alignment_quality(reads: DataFrame, references: DataFrame, band: int = 7, extended: bool = False) -> DataFrame:
    """``reads`` with baq: per base the smaller of its quality and the quality of its alignment.

    ``extended``: a base's alignment counts as good as the better ones on both sides of it in its block: the smaller of
    the best up to it and the best from it on.

    Each read is aligned anew to its own stretch of the reference and ``band`` bases on both sides. A matched base whose
    most likely place is another one gets 0; clipped and inserted bases keep their quality. NULL for reads with skips, without
    qualities or unmapped.
    """

    def window(r: dict) -> tuple | None:
        """(operations, qualities, where the window begins, first base that is used, window, bases, their qualities, chances)."""
        ops = operations(r["cigar"])
        if r["pos"] is None or not ops or not r.get("qual") or any(o == "N" for _, o in ops):
            return None
        quality = np.frombuffer(r["qual"].encode("latin-1"), np.uint8).astype(np.int64) - 33
        span = sum(n for n, o in ops if o in "MDN=X")
        clip = ops[0][0] if ops[0][1] == "S" else ops[1][0] if len(ops) > 1 and ops[1][1] == "S" and ops[0][1] == "H" else 0
        used = sum(n for n, o in ops if o in "MI=X")
        width = _width(span, used, band)
        lo, hi = max(0, r["pos"] - 1 - width // 2), min(r["__size"], r["pos"] - 1 + span + width // 2)
        own = slice(clip, clip + used)
        return ops, quality, lo, clip, codes((r["__bases"] or "")[lo - r["__from"] : hi - r["__from"]]), codes(r["seq"][own]), quality[own], Gaps(1e-3 if used <= 1000 else 1e-7, 0.1, width)

    def settled(r: dict, ops: list[tuple[int, str]], quality: np.ndarray, lo: int, clip: int, state: np.ndarray, post: np.ndarray) -> list[int]:
        out, at, i = quality.copy(), r["pos"] - 1 - lo, 0
        for n, o in ops:
            if o in "M=X":
                k = np.arange(i, i + n)
                moved = (state[k] & 1 == 1) | (state[k] >> 2 != at + k - i)
                sure = np.where(moved, 0, post[k])
                if extended:
                    sure = np.minimum(np.maximum.accumulate(sure), np.maximum.accumulate(sure[::-1])[::-1])
                out[clip + i : clip + i + n] = np.minimum(quality[clip + i : clip + i + n], sure)
                at, i = at + n, i + n
            elif o == "D":
                at += n
            elif o == "I":
                i += n
        return out.tolist()

    def run(rows: list[dict]) -> list:
        windows = [window(r) for r in rows]
        which = [i for i, w in enumerate(windows) if w]
        aligned = align_many(*([windows[i][k] for i in which] for k in (4, 5, 6, 7)))
        out: list[list[int] | None] = [None] * len(rows)
        for i, (_, state, post) in zip(which, aligned, strict=True):
            out[i] = settled(rows[i], *windows[i][:4], state, post)
        return [out]

    more = F.greatest(F.lit(band), F.abs(cigar_sum(F.col("cigar"), ON_REFERENCE) - cigar_sum(F.col("cigar"), "MI=X")) + 3)
    return _beside_reference(reads, references, more, run, [("baq", pa.list_(pa.int32()), "array<int>")])


def with_recalculated_quality(reads: DataFrame, references: DataFrame, apply: bool = False, force: bool = False, extended: bool = False) -> DataFrame:
    """``reads`` with the tags bq and zq (NULL: not there) and qual as a recalculation leaves them.

    A read with zq stays, one with bq too unless ``force``d, which drops bq. Other reads get a new bq, or with ``apply`` a zq and
    qualities lowered by it. Reads that can't be aligned anew (unmapped, without bases or qualities, with skips) stay as they are.
    """
    mapped = (F.col("flag").bitwiseAND(4) == 0) & (F.col("seq") != "*") & (F.col("qual") != "*")
    open_ = mapped & F.col("zq").isNull() & (F.lit(force) | F.col("bq").isNull())
    # Only what is to be aligned keeps its place; the others come back without a baq.
    found = with_alignment_quality(reads.withColumns({"__pos": F.col("pos"), "pos": F.when(open_, F.col("pos"))}), references, extended=extended)
    tag = baq_tag(F.col("qual"), F.col("baq"))
    new = F.col("baq").isNotNull()
    kept = F.when(F.lit(force) & F.col("zq").isNotNull(), None).otherwise(F.col("bq"))
    columns = {
        "bq": F.when(new, F.lit(None).cast("string") if apply else tag).otherwise(kept),
        "zq": F.when(new & F.lit(apply), tag).otherwise(F.col("zq")),
        "qual": F.when(new & F.lit(apply), shifted_qualities(F.col("qual"), tag)).otherwise(F.col("qual")),
        "pos": F.col("__pos"),
    }
    return found.withColumns(columns).select(*reads.columns)


_MD = re.compile(r"(\d+)|\^[^0-9]*|([^0-9^])")
_CLIPPED = re.compile(r"^(?:\d+H)?\d+S"), re.compile(r"\d+S(?:\d+H)?$")
#: Bases at a read's start whose qualities are taken as they are.
_CALM = 8


def _mismatches(md: str | None) -> list[int]:
    """Matched bases before each mismatch of an MD text."""
    out, at = [], 0
    for n, base in _MD.findall(md or ""):
        if n:
            at += int(n)
        elif base:
            out.append(at)
    return out


def local_nm_of(seqs: list[str], quals: list[str | None], cigars: list[str], mds: list[str | None], halo: int = 50, clip: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score per base, length of the base's run of equal bases less one, where each read begins), reads one after the other.

    A score adds up what speaks against a base: how far a quality is above a third of itself and the quality before it (from the
    ninth base on; the last eight are held against the one before them); ``clip`` for bases within ``halo`` of a clipped end, and
    half of it as far again; 10 within ``halo`` of a mismatch of MD, and 5 as far again. Mismatches lie where MD's matches
    before them end, without mismatches and insertions in between. Runs count 100 at most.
    """
    seq, start = _joined(seqs)
    size = np.diff(np.append(start, len(seq)))
    row = np.repeat(np.arange(len(seqs)), size)
    i = np.arange(len(seq)) - start[row]
    quality = np.concatenate([np.empty(0, np.int64), *(np.frombuffer((q or "").ljust(len(s), "!")[: len(s)].encode("latin-1"), np.uint8).astype(np.int64) - 33 for q, s in zip(quals, seqs, strict=True))])
    fresh = i == 0
    fresh[1:] |= seq[1:] != seq[:-1]
    run = np.cumsum(fresh) - 1
    length = np.bincount(run)[run] if len(run) else run
    lead = np.full(len(seqs), 255)
    first = (i < _CALM) & (run == run[start[row]]) if len(run) else fresh
    np.minimum.at(lead, row[first], quality[first])
    before = np.concatenate(([0], quality[:-1])) if len(quality) else quality
    tail = i >= size[row] - _CALM
    held = np.where(size >= 2 * _CALM + 1, quality[np.clip(start + size - _CALM - 1, 0, max(len(quality) - 1, 0))] if len(quality) else 0, lead)
    before = np.where(tail, held[row], np.where(i == _CALM, lead[row], before))
    score = np.where(i >= _CALM, np.maximum(0, quality - quality // 3 - before), 0)
    for end, at in zip(_CLIPPED, (i, size[row] - 1 - i), strict=True):
        clipped = np.array([bool(end.search(c or "")) for c in cigars], bool)[row]
        score += np.where(clipped & (at < halo), clip, np.where(clipped & (at < 2 * halo), clip // 2, 0))
    known = {md: _mismatches(md) for md in set(mds)}
    places = [known[md] for md in mds]
    owner = np.repeat(np.arange(len(seqs)), [len(p) for p in places])
    at = np.array([x for p in places for x in p], np.int64)
    steps = np.zeros(len(seq) + 1, np.int64)
    for shift, cost in ((-2 * halo, 5), (-halo, 5), (halo, -5), (2 * halo, -5)):
        np.add.at(steps, start[owner] + np.clip(at + shift, 0, size[owner]), cost)
    return score + np.cumsum(steps)[:-1], np.minimum(length - 1, 100), start


def with_local_nm(reads: DataFrame, halo: int = 50, clip: int = 60) -> DataFrame:
    """``reads`` (seq, qual, cigar and md, texts) with local_nm and homopolymer, arrays over the read's bases (see local_nm_of); empty for reads without bases."""
    fields = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in reads.schema)

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            seqs, quals, cigars, mds = (b.column(c).to_pylist() for c in ("seq", "qual", "cigar", "md"))
            seqs = ["" if s in (None, "*") else s for s in seqs]
            score, run, start = local_nm_of(seqs, quals, cigars, mds, halo, clip)
            offsets = pa.array(np.append(start, len(score)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (score, run)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], names=[*b.schema.names, "local_nm", "homopolymer"])

    return reads.mapInArrow(run, fields + ", local_nm array<int>, homopolymer array<int>")


def local_nm_at(offset: Column) -> tuple[Column, Column]:
    """(score, run) of the base after a read's ``offset``, as a pileup column shows them: a tenth of the score, and beyond the read's end the last base's whole score and no run."""
    i, size = offset + 1, F.size("local_nm")
    inside = (i >= 0) & (i < size)
    edge = F.get("local_nm", F.when(i < 0, 0).otherwise(size - 1)).cast("double")
    return F.coalesce(F.when(inside, F.get("local_nm", i) / 10).otherwise(edge), F.lit(0.0)), F.coalesce(F.when(inside, F.get("homopolymer", i)), F.lit(0))


#: Bases that pair with each other, for base modifications; U counts as T. Fixed values.
COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A", "U": "A", "N": "N"}
_MOD = re.compile(r"([ACGTUN])([+-])([a-z]+|\d+)([.?]?)((?:,\d+)*)")


def _modification_parts(mm: str | None) -> list[tuple[str, str, list[str], np.ndarray]]:
    """(canonical base, strand, codes, which of these bases are called) of each part of an MM text."""
    out = []
    for part in (mm or "").rstrip(";").split(";") if mm else []:
        m = _MOD.fullmatch(part)
        if not m:
            raise ValueError(f"not a modification: {part}")
        base, strand, kinds, _, deltas = m.groups()
        skipped = np.array([int(x) for x in deltas.split(",") if x], np.int64)
        out.append((base, strand, [kinds] if kinds.isdigit() else list(kinds), np.cumsum(skipped + 1) - 1))
    return out


def _called(base: str, reverse: bool) -> np.ndarray:
    """Which characters of a read, as it is stored, are ``base`` in the order and strand in which it was sequenced."""
    table = np.zeros(256, bool)
    for c in map(chr, range(256)):
        own = COMPLEMENT.get(c, c) if reverse else c
        table[ord(c)] = base in ("N", own) or base == "U" and own == "T"
    return table


def modifications_of(seqs: list[str], reverse: list[bool], mms: list[str | None], mls: list[list[int] | None]) -> tuple[np.ndarray, np.ndarray, list[tuple[str, str]], np.ndarray, np.ndarray]:
    """(read, offset in it, kinds as (strand, code), number of the kind, probability) of all calls, by read and offset.

    Counts skip bases of the canonical kind (N: any) in the order in which the read was sequenced: for reverse reads from the end. Reads
    with the same MM are worked out together. A probability is 0 to 255, or -1 where there is no ML, which must hold exactly one value per call.
    """
    data, start = _joined(seqs)
    rows, backward = np.arange(len(seqs)), np.array(reverse, bool)
    known: dict[str | None, list[int]] = {}
    for i, mm in enumerate(mms):
        known.setdefault(mm, []).append(i)
    given = np.array([-1 if ml is None else len(ml) for ml in mls], np.int64)
    values = np.array([x for ml in mls if ml is not None for x in ml] + [-1], np.int64)
    first = np.cumsum(np.maximum(given, 0)) - np.maximum(given, 0)
    places: dict[tuple[str, bool], tuple[np.ndarray, np.ndarray]] = {}
    kinds: dict[tuple[str, str], int] = {}
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    for mm, who in known.items():
        parts, used = _modification_parts(mm), 0
        for base, strand, codes_, at in parts:
            numbers = np.array([kinds.setdefault((strand, c), len(kinds)) for c in codes_])
            for back in (False, True):
                mine = np.array(who)[backward[who] == back]
                if not len(mine) or not len(at):
                    continue
                if (base, back) not in places:
                    found = np.flatnonzero(_called(base, back)[data])
                    places[base, back] = found, np.searchsorted(found, np.append(start, len(data)))
                found, bound = places[base, back]
                if (at[-1] >= bound[mine + 1] - bound[mine]).any():
                    raise ValueError("more modifications than bases")
                place = found[bound[mine + 1][:, None] - 1 - at if back else bound[mine][:, None] + at] - start[mine][:, None]
                n = used + np.arange(len(at) * len(codes_))
                have = given[mine][:, None]
                if ((have >= 0) & (have <= n[-1])).any():
                    raise ValueError("ML is too short")
                out[0].append(np.repeat(mine, len(n)))
                out[1].append(np.repeat(place, len(codes_), 1).ravel())
                out[2].append(np.tile(numbers, len(at) * len(mine)))
                out[3].append(values[np.where(have >= 0, first[mine][:, None] + n, len(values) - 1)].ravel())
                out[4].append(np.tile(n, len(mine)))
            used += len(at) * len(codes_)
        if (given[who] > used).any():
            raise ValueError("ML is too long")
    row, offset, kind, probability, turn = (np.concatenate(x) if x else np.empty(0, np.int64) for x in out)
    order = np.lexsort((turn, offset, row))
    return rows[row[order]], offset[order], list(kinds), kind[order], probability[order]


def base_modifications(seq: str, reverse: bool, mm: str | None, ml: list[int] | None) -> list[tuple[int, str, str, int]]:
    """(offset in seq, strand, code, probability) of one read's MM and ML tags, by offset; see modifications_of."""
    _, offset, kinds, kind, probability = modifications_of([seq], [reverse], [mm], [ml])
    return [(o, *kinds[k], p) for o, k, p in zip(offset.tolist(), kind.tolist(), probability.tolist(), strict=True)]


def modifications(reads: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """A row per call: rec_idx, ``keep``, offset, strand, code, probability; reads need flag, seq, mm (text) and ml (array)."""
    own = ["rec_idx", *keep]
    schema = ", ".join(f"`{c}` {reads.schema[c].dataType.simpleString()}" for c in own) + ", offset int, strand string, code string, probability int"

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            flag, seq, mm, ml = (b.column(c).to_pylist() for c in ("flag", "seq", "mm", "ml"))
            row, offset, kinds, kind, probability = modifications_of([s or "" for s in seq], [bool(f & 16) for f in flag], mm, ml)
            texts = [pa.array([k[i] for k in kinds], pa.string()).take(pa.array(kind)) for i in (0, 1)]
            columns = [pa.array(offset, pa.int32()), *texts, pa.array(probability, pa.int32())]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(row)) for c in own], *columns], names=[*own, "offset", "strand", "code", "probability"])

    return reads.select(*own, "flag", "seq", "mm", "ml").mapInArrow(run, schema)
