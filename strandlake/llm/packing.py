"""Best-two-fit packing of tokenized documents into sequences of a fixed length.

Tokenizing: documents are cut at white space; a worker remembers chunks' ids in arrays and merges all
new words of a batch at once in numpy. Only (document, piece, length, checksum) rows leave that pass.
Packing: pieces are dealt at random into groups of about ``group`` pieces. In a group, each bin takes
the longest piece left and then, again and again, the longest that fits; then its smallest document
gives way to two unpacked ones if these fill the widened gap more tightly. A group leaves at most
about one bin open; the pieces of these are packed anew, again in groups of that size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, Remembered, Scope, give_back, lean, rows_only, segments, slices
from .tokencount import WordCounter
from .transducer import IdTransducer

NEVER = 1 << 30
#: Longer words go through the transducer one by one.
LONG = 48
#: Places (as a power of two) in a worker's table of chunks: 22 take about 130 MB, each less half of that but more time.
PLACES = 22
#: A chunk of letters that neither lower case nor NFC splits or joins, and marks that make one piece.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u0148\u014a-\u024f]+)([.,;:!?]*)").fullmatch


class BatchEncoder(WordCounter):
    """Ids of texts, some megabytes at a time; a chunk's ids are looked up by its number in arrays."""

    def __init__(self, path: str, places: int = PLACES):
        super().__init__(path)
        self.words_known, self.chunks = Generations(1 << max(0, places - 4)), Remembered(places)
        self.ids, self.used = np.empty(1 << 20, np.uint32), 0
        self.place, self.many = np.empty(1 << 18, np.int64), np.empty(1 << 18, np.int32)
        self.special_bytes = {s: np.uint32(i).tobytes() for s, i in self.special_ids.items()}
        self.first_of = np.full(512, -1, np.int64)
        for s, t in self.first.items():
            self.first_of[s] = t
        self.size = 1 << 20
        self.keys = np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, NEVER, np.int64)
        self.to = np.full(len(self.rules) + 1, -1, np.int64)
        self.probes = 1
        for key, (rank, to) in self.rules.items():
            slot, n = self._slot(key), 1
            while self.keys[slot] >= 0:
                slot, n = (slot + 1) & self.size - 1, n + 1
            self.keys[slot], self.rank[slot], self.to[rank] = key, rank, to
            self.probes = max(self.probes, n)

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 11) & self.size - 1

    @cached_property
    def long(self) -> IdTransducer:
        return IdTransducer(self.merges)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the rules that merge a and b; NEVER where there is none or either is missing (-1)."""
        key = np.where((a < 0) | (b < 0), -2, a << 20 | b)
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.rank[slot], NEVER)
        for _ in range(self.probes - 1):
            slot = (slot + 1) & self.size - 1
            out = np.minimum(out, np.where(self.keys[slot] == key, self.rank[slot], NEVER))
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of up to LONG bytes: in each round every word applies its lowest rule once, at its leftmost place."""
        out: list[bytes] = [b""] * len(words)
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for lo, hi in slices(len(order), [len(words[i]) for i in order], 100_000):
            rows = np.array(order[lo:hi])
            size = np.array([len(words[i]) for i in rows])
            width = int(size.max())
            ids = np.full((len(rows), width), -1, np.int64)
            flat = np.frombuffer(b"".join(words[i] for i in rows), np.uint8).astype(np.int64)
            flat[np.cumsum(size) - 1] += 256
            ids[np.arange(width) < size[:, None]] = self.first_of[flat]
            rank = self.ranks(ids[:, :-1], ids[:, 1:])
            while len(rows):
                at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
                best = rank[np.arange(len(rows)), at] if rank.shape[1] else np.full(len(rows), NEVER)
                done = best >= NEVER
                if done.any():
                    kept = ids[done].astype(np.uint32)
                    for i, row, n in zip(rows[done].tolist(), kept, (ids[done] >= 0).sum(1).tolist(), strict=True):
                        out[i] = row[:n].tobytes()
                    go = ~done
                    rows, ids, rank, at, best = rows[go], ids[go], rank[go], at[go], best[go]
                    if not len(rows):
                        break
                each, place = np.arange(len(rows)), np.arange(ids.shape[1] - 1)
                ids[each, at] = self.to[best]
                ids = np.take_along_axis(ids, place + (place > at[:, None]), 1)
                place = place[:-1]
                rank = np.take_along_axis(rank, place + (place >= at[:, None]), 1) if len(place) else rank[:, :0]
                for p in (at - 1, at):
                    ok = (p >= 0) & (p < rank.shape[1])
                    rank[each[ok], p[ok]] = self.ranks(ids[each[ok], p[ok]], ids[each[ok], p[ok] + 1])
        return out

    def learn(self, chunks: list[bytes], first: int) -> None:
        """Puts the chunks' ids under the numbers from ``first`` on."""
        parts, need = [], set()
        for c in chunks:
            c = c.decode()
            m = PLAIN(c)
            if m:
                p = m.groups()
                p = (p[0].lower(), p[1]) if p[1] else (p[0].lower(),)
                need.update(p)
            else:
                p = list(self.parts(c))
                need.update(x for x in p if x is not None)
                if None in p:
                    marks = iter(self.split.findall(c))
                    p = [next(marks) if x is None else x for x in p]
            parts.append(p)
        new = self.words_known.missing(need)
        known = self.words_known.known
        short, data = [], []
        for w in new:
            d = w.encode()
            if len(d) <= LONG:
                short.append(w)
                data.append(d)
            else:
                known[w] = np.array(self.long(self.piece_symbols(w)), np.uint32).tobytes()
        known.update(zip(short, self.merge(data), strict=True))
        known.update(self.special_bytes)  # no word is cut so that it is one of these
        get = known.__getitem__
        ids = [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in parts]
        self.words_known.rest()
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty_like(self.ids)))
        while first + len(n) > len(self.place):
            self.place, self.many = np.concatenate((self.place, np.empty_like(self.place))), np.concatenate((self.many, np.empty_like(self.many)))
        self.ids[self.used : self.used + len(flat)] = flat
        self.place[first : first + len(n)] = self.used + np.cumsum(n) - n
        self.many[first : first + len(n)] = n
        self.used += len(flat)

    def forget(self, n: int) -> None:
        self.used = int(self.place[n - 1] + self.many[n - 1]) if n else 0

    def encode_batch(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text."""
        number, count = self.chunks.numbers(texts, False, self.learn, self.forget)
        n, place = self.many[number].astype(np.int64), self.place[number]
        end = np.cumsum(n)
        flat = self.ids[np.repeat(place - (end - n), n) + np.arange(n.sum())]
        return np.split(flat, np.concatenate(([0], end))[np.cumsum(count)[:-1]]) if texts else []


@lru_cache(maxsize=1)
def batch_encoder(path: str, places: int) -> BatchEncoder:
    made = BatchEncoder(path, places)
    give_back()  # what reading the file took
    return made


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator, path: str, most: int, end: int, places: int) -> Iterator:
    encoder, tail = batch_encoder(path, places), np.uint32(end).tobytes()
    for b in batches:
        ids, texts = b.column(0).to_pylist(), [t or b"" for t in b.column(1).to_pylist()]
        out: list[list] = [[], [], [], [], []]
        found: list[list[bytes]] = [[] for _ in texts]
        for which, parts in segments(texts, 1 << 20):
            for i, own in zip(which, encoder.encode_batch(parts), strict=True):
                found[i].append(own.tobytes())
        for ident, own in zip(ids, found, strict=True):
            data = b"".join(own) + tail
            for k, start in enumerate(range(0, len(data) // 4, most)):
                part = data[4 * start : 4 * (start + most)]
                for column, value in zip(out, (ident, k, start, len(part) // 4, zlib.crc32(part)), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])


class Lengths:
    """A multiset of lengths up to ``most`` that answers: the longest that is at most x."""

    def __init__(self, counts: np.ndarray):
        self.counts, self.left = counts, int(counts.sum())
        at = np.where(counts > 0, np.arange(len(counts)), -1)
        self.upto = np.maximum.accumulate(at)

    def take(self, x: int) -> None:
        self.counts[x] -= 1
        self.left -= 1
        if not self.counts[x]:
            stop = np.searchsorted(self.upto, x, "right")
            self.upto[x:stop] = self.upto[x - 1] if x else -1

    def put(self, x: int) -> None:
        self.counts[x] += 1
        self.left += 1
        if self.counts[x] == 1:
            stop = x + int(np.searchsorted(self.upto[x:], x))
            self.upto[x:stop] = x

    def two(self, gap: int, over: int) -> tuple[int, int] | None:
        """Two lengths with the largest sum over ``over`` and at most ``gap``."""
        x = np.flatnonzero(self.counts[: gap + 1])
        x = x[x > 0]
        y = self.upto[gap - x]
        same = (y == x) & (self.counts[x] < 2)
        y[same] = self.upto[x[same] - 1]
        total = np.where(y > 0, x + y, -1)
        if not len(total) or total.max() <= over:
            return None
        i = int(total.argmax())
        return int(x[i]), int(y[i])


def best_two_fit(lengths: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths are 1 to ``most``."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    counts = np.bincount(lengths, minlength=most + 1)
    first = np.concatenate(([0], np.cumsum(counts)))[:-1]
    used = np.zeros(most + 1, np.int64)
    left = Lengths(counts.copy())
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    b = 0
    while left.left:
        inside, gap = [], most
        while left.left and (x := int(left.upto[gap])) > 0:
            left.take(x)
            inside.append(x)
            gap -= x
        if gap and len(inside) > 1 and left.left > 1:
            small = inside[-1]
            two = left.two(gap + small, small)
            if two:
                left.put(small)
                inside[-1:] = two
                for x in two:
                    left.take(x)
        offset = 0
        for x in inside:
            i = order[first[x] + used[x]]
            used[x] += 1
            bins[i], offsets[i] = b, offset
            offset += x
        b += 1
    return bins, offsets


def pack(docs: DataFrame, path: str, most: int = 4096, end: int = 1, group: int = 32768, places: int = PLACES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``.

    Pieces are dealt at random into groups of about ``group``, which bounds what a task holds; the sequences that groups
    leave open are packed anew, in groups of the same size. ``places``: how much a worker remembers of the vocabulary.

    A document is its text's ids and ``end``; one longer than ``most`` tokens is cut into pieces of
    ``most``, of which the last may be shorter. A null text counts as empty (just ``end``). Repeated
    rows and rows with null doc_ids are packed each; other columns are ignored. No rows in, none out.
    """
    rows = rows_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    scope = Scope(docs.sparkSession)
    pieces = scope.table(rows.mapInArrow(lean(lambda it: _pieces(it, path, most, end, places)), PIECES), "pieces")
    groups = max(1, -(-pieces.count() // group))
    schema = PIECES + ", sequence_id long, offset long"

    def packed(rows: DataFrame, groups: int, first: int) -> DataFrame:
        """sequence_id, offset and whether the sequence is its group's last; groups are numbered from ``first``."""

        def one(t: pa.Table) -> pa.Table:
            t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
            bins, offsets = best_two_fit(t.column("length").to_numpy(), most)
            g = t.column("g")[0].as_py()
            return t.drop_columns(["g"]).append_column("sequence_id", pa.array(bins + (g << 32))).append_column("offset", pa.array(offsets)).append_column("last", pa.array(bins == bins.max()))

        # By the row, so that equal pieces spread too.
        dealt = rows.withColumn("g", F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(first)), F.lit(groups)) + first)
        return dealt.repartition(groups, "g").groupBy("g").applyInArrow(one, schema + ", last boolean")

    out = packed(pieces, groups, 0)
    if groups > 1:
        out = scope.table(out, "packed")
        rest = out.where("last").drop("sequence_id", "offset", "last")
        out = out.where("not last").unionByName(packed(rest, -(-rest.count() // group), groups))
    return scope.result(out.drop("last"), "sequences")
