"""Document fingerprints by winnowing, and how alike a document, its edited text and its neighbour are.

Rolling hashes of k code points; in each window of w of them the smallest is selected, the rightmost
of equals. Any passage of at least w + k - 1 code points that two texts share has a selected hash in
both; positions are kept with the hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, rows_only, slices

B = 0x9E3779B97F4A7C15
LOW = np.uint64(0xFFFFFFFF)


def _grams(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all runs of k codes, by doubling; one 32-bit value each."""
    power = {1: codes * np.uint64(B) + np.uint64(1)}
    m = 1
    while 2 * m <= k:
        h = power[m]
        power[2 * m] = h[:-m] * np.uint64(pow(B, m, 2**64)) + h[m:]
        m *= 2
    out, done = power[m], m
    while done < k:
        m = max(x for x in power if x <= k - done)
        n = len(codes) - done - m + 1
        out = out[:n] * np.uint64(pow(B, m, 2**64)) + power[m][done : done + n]
        done += m
    return mix64(out) >> np.uint64(32)


def winnow(texts: list[str], k: int = 12, w: int = 32) -> list[tuple[np.ndarray, np.ndarray]]:
    """(selected hashes, their positions) of each text, in order of position.

    A text of fewer than k code points has one hash, of all of it; one with fewer than w hashes has
    their smallest; an empty text has none.
    """
    sizes = [max(len(t), k) if t else 0 for t in texts]
    out: list = [None] * len(texts)
    empty = np.empty(0, np.uint32), np.empty(0, np.int32)
    for lo, hi in slices(len(texts), sizes, 1 << 18):
        part = [t + "\0" * (k - len(t)) if 0 < len(t) < k else t for t in texts[lo:hi]]
        n = np.array([len(t) for t in part])
        if not n.any():
            out[lo:hi] = [empty] * (hi - lo)
            continue
        codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        start = np.concatenate(([0], np.cumsum(n)[:-1]))
        grams = _grams(codes, k)
        # Smallest hash, then largest position: one 64-bit number.
        key = grams << np.uint64(32) | (LOW - np.arange(len(grams), dtype=np.uint64))
        low, m = key, 1
        while 2 * m <= w:
            low = np.minimum(low[:-m], low[m:]) if len(low) > m else low[:0]
            m *= 2
        if m < w:
            low = np.minimum(low[: len(key) - w + 1], low[w - m : len(key) - m + 1]) if len(key) >= w else low[:0]
        for i, (s, c) in enumerate(zip(start.tolist(), n.tolist(), strict=True)):
            if not c:
                out[lo + i] = empty
                continue
            g = c - k + 1
            best = low[s : s + g - w + 1] if g >= w else key[s : s + g].min(keepdims=True)
            best = best[np.concatenate(([True], best[1:] != best[:-1]))]
            out[lo + i] = (best >> np.uint64(32)).astype(np.uint32), ((LOW - (best & LOW)).astype(np.int64) - s).astype(np.int32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints' hashes; 1 for two empty ones."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def text_of(hashes: np.ndarray) -> str:
    return hashes.astype(">u4").tobytes().hex()


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>"


def _pairs(rows: Iterator) -> Iterator[tuple]:
    """(id, text, next text) from rows in order; the next row of the bucket comes next, halo rows only serve as that."""
    held = None
    for bucket, halo, ident, text in rows:
        if held is not None:
            same = bucket == held[0] and ident is not None
            yield held[1], held[2], text if same and held[1] is not None else None
        held = None if halo else (bucket, ident, text)
    if held is not None:
        yield held[1], held[2], None


def _fingerprints(batches: Iterator, k: int, w: int) -> Iterator:
    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("bucket", "halo", "doc_id", "text")), strict=True)

    def out(part: list[tuple]):
        ids, texts, follow = zip(*part, strict=True)
        edited = [t[: len(t) - len(t) // 3] + (f or "")[: len(t) // 3] for t, f in zip(texts, follow, strict=True)]
        own, new, after = winnow(texts, k, w), winnow(edited, k, w), winnow([f or "" for f in follow], k, w)
        known = [f is not None for f in follow]
        columns = [
            pa.array(ids, pa.int64()),
            pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() if y else None for e, y in zip(edited, known, strict=True)], pa.string()),
            pa.array([text_of(h) for h, _ in own], pa.string()),
            pa.array([text_of(h) if y else None for (h, _), y in zip(new, known, strict=True)], pa.string()),
            pa.array([likeness(a[0], b[0]) if y else None for a, b, y in zip(own, new, known, strict=True)], pa.float64()),
            pa.array([likeness(a[0], b[0]) if y else None for a, b, y in zip(own, after, known, strict=True)], pa.float64()),
            pa.array([p for _, p in own], pa.list_(pa.int32())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"])

    part, size = [], 0
    for row in _pairs(rows()):
        part.append(row)
        size += len(row[1])
        if size >= 2 << 20 or len(part) >= 4096:
            yield out(part)
            part, size = [], 0
    if part:
        yield out(part)


def _bucket(ident, edges: list[int]):
    """How many of the sorted ``edges`` are at most ``ident``: a search in two levels of about a square root each."""
    if not edges:
        return F.lit(0)
    step = max(1, int(len(edges) ** 0.5))
    parts = [edges[i : i + step] for i in range(0, len(edges), step)]
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    coarse = F.size(F.filter(longs([p[0] for p in parts]), lambda x: x <= ident))
    fine = F.element_at(F.array(*[longs(p) for p in parts]), F.greatest(coarse, F.lit(1)))
    return F.when(coarse == 0, 0).otherwise((coarse - 1) * step + F.size(F.filter(fine, lambda x: x <= ident)))


def fingerprints(docs: DataFrame, k: int = 12, w: int = 32) -> DataFrame:
    """Fingerprints of every text of ``docs``, of its edited text, and their likeness.

    The edited text has its last floor(n / 3) code points replaced by the first as many (or all) of
    the next document by descending doc_id; the largest follows the smallest. Documents that share a
    doc_id follow one another by text. A null text counts as empty. A row with a null doc_id is in no
    order: its fingerprint is returned, what needs a next document is null. Other columns are ignored.

    Texts are dealt out once, into ranges of doc_id of about the same number of rows; the first
    document of each range also goes to the range before it. Only the ranges' ends are collected.
    """
    spark = docs.sparkSession
    rows = rows_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.where("doc_id is not null").select((-F.col("doc_id")).cast("double").alias("x")).approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.2 / ranges)
    edges = sorted({int(x) for x in cuts})
    ident = -F.col("doc_id")
    placed = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(len(edges) + 1))).otherwise(_bucket(ident, edges)).cast("int"))
    ends = placed.where("doc_id is not null").groupBy("bucket").agg(F.max("doc_id").alias("first")).orderBy("bucket").collect()
    halo = [(ends[(i + 1) % len(ends)]["first"], ends[i]["bucket"]) for i in range(len(ends))]
    extra = spark.createDataFrame(halo, "first long, before int")
    both = placed.join(F.broadcast(extra), F.col("doc_id") == F.col("first"), "left")
    own = F.struct("bucket", F.lit(False).alias("halo"))
    there = F.when(F.col("before").isNotNull(), F.array(own, F.struct(F.col("before").alias("bucket"), F.lit(True).alias("halo")))).otherwise(F.array(own))
    dealt = both.select("doc_id", "text", F.explode(there).alias("to")).select("to.bucket", "to.halo", "doc_id", "text")
    order = dealt.repartition("bucket").sortWithinPartitions("bucket", F.col("doc_id").isNull(), "halo", F.col("doc_id").desc(), "text")
    return order.mapInArrow(lambda it: _fingerprints(it, k, w), SCHEMA)
