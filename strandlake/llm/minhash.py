"""Near-duplicate documents by SetSketch registers, banding, joint likelihood and full verification.

A register is an exponentially spaced, truncated minimum: with x the smallest of a set's
exponentially distributed hash values, K = clip(floor(1 - log_b x), 0, q + 1). Registers merge by
their maximum, and two sets agree in one with a probability close to their Jaccard similarity.

Steps: (1) one pass makes each document's set size, set identity and registers; (2) documents with
equal sets form a class, its smallest doc_id stands for it; (3) representatives that agree in a band
of registers are candidates; each is set against its bucket's smallest member; a pair whose joint
likelihood estimate is far below the threshold is dropped, all others are verified on their full
sets; (4) where that leaves a cluster of buckets in several components, those outside the largest
one are compared with all of the cluster in blocks, so that no link between components is lost
while a large group never emits all its pairs; (5) links become components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scope, WordHashes, connected_components, join_heavy, lean, mix64, rows_only, slices, word_shingles


#: Hashes of the sets on one side of a block, about.
BLOCK_HASHES = 500_000
#: Parts of a hub's members to which one task copies the hub's set.
HUB_PARTS = 256


@dataclass(frozen=True)
class SetSketch:
    """bands * rows registers of base b, rate a and limit q (two bytes each).

    20 bands of 4 rows miss a pair of similarity 0.8 with probability (1 - 0.8 ** 4) ** 20 = 3e-5.
    """

    bands: int = 20
    rows: int = 4
    base: float = 1.001
    rate: float = 20.0
    limit: int = 2**16 - 2

    @property
    def size(self) -> int:
        return self.bands * self.rows

    def minima(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(sets, size) smallest hash values; ``starts`` are the offsets of non-empty sets."""
        rng = np.random.default_rng(20)
        mul = rng.integers(0, 2**63, self.size, np.uint64) * np.uint64(2) + np.uint64(1)
        add = rng.integers(0, 2**63, self.size, np.uint64)
        out = np.empty((len(starts), self.size), np.uint64)
        buf = np.empty_like(hashes)
        for i in range(self.size):
            np.multiply(hashes, mul[i], out=buf)
            np.add(buf, add[i], out=buf)
            out[:, i] = np.minimum.reduceat(buf, starts)
        return out

    def registers(self, minima: np.ndarray) -> np.ndarray:
        x = -np.log1p(-(minima.astype(np.float64) + 0.5) / 2.0**64) / self.rate
        with np.errstate(divide="ignore"):
            k = np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(self.base))
        return np.clip(k, 0, self.limit + 1).astype(np.uint16)

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        """Registers of sets of 64-bit hashes; an empty set has only zeros."""
        out = np.zeros((len(sets), self.size), np.uint16)
        full = [i for i, s in enumerate(sets) if len(s)]
        for lo, hi in slices(len(full), [len(sets[i]) for i in full], 1 << 16):
            part = [sets[i] for i in full[lo:hi]]
            starts = np.concatenate(([0], np.cumsum([len(s) for s in part])[:-1]))
            out[full[lo:hi]] = self.registers(self.minima(np.concatenate(part), starts))
        return out

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Registers of the union."""
        return np.maximum(a, b)

    def band_keys(self, k: np.ndarray) -> np.ndarray:
        """(sets, bands) keys; the band's number is part of the key."""
        k = k.reshape(len(k), self.bands, self.rows).astype(np.uint64)
        key = np.tile(np.arange(1, self.bands + 1, dtype=np.uint64), (len(k), 1))
        for j in range(self.rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + k[:, :, j])
        return key

    def jaccard(self, ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
        """Joint maximum likelihood estimates from how many registers are larger, smaller and equal.

        With u, v the sets' shares of na + nb, a register of A is larger with p(u - v J), smaller
        with p(v - u J), where p(x) = -log_b(1 - x (b - 1) / b); golden-section search over J.
        """
        more = (ka > kb).sum(1)
        less = (ka < kb).sum(1)
        same = ka.shape[1] - more - less
        u = na / (na + nb)
        v = 1 - u

        def p(x):
            return -np.log1p(-np.clip(x, 1e-12, 1) * (self.base - 1) / self.base) / np.log(self.base)

        def fit(j):
            a, b = p(u - v * j), p(v - u * j)
            return more * np.log(a) + less * np.log(b) + same * np.log(np.maximum(1 - a - b, 1e-12))

        lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
        g = (5**0.5 - 1) / 2
        for _ in range(40):
            x, y = hi - g * (hi - lo), lo + g * (hi - lo)
            left = fit(x) > fit(y)
            lo, hi = np.where(left, lo, x), np.where(left, y, hi)
        return (lo + hi) / 2


def _sketches(batches: Iterator, k: int, sketch: SetSketch) -> Iterator:
    hashes = WordHashes()
    for b in batches:
        ids, texts = b.column(0), b.column(1).to_pylist()
        for lo, hi in slices(len(texts), [len(t or b"") for t in texts], 4 << 20):
            sets = [word_shingles(t or b"", k, hashes) for t in texts[lo:hi]]
            kept = sketch.of(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    ids.slice(lo, hi - lo),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int(s.sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                    pa.array([int(mix64(s + np.uint64(77)).sum(dtype=np.uint64).view(np.int64)) for s in sets], pa.int64()),
                    pa.array([r.tobytes() for r in kept], pa.binary()),
                ],
                names=["doc_id", "n", "h1", "h2", "k"],
            )


def _bands(batches: Iterator, sketch: SetSketch) -> Iterator:
    for b in batches:
        if not b.num_rows:
            continue
        k = np.frombuffer(b"".join(b.column("k").to_pylist()), np.uint16).reshape(-1, sketch.size)
        keys = sketch.band_keys(k).view(np.int64).ravel()
        rep = np.repeat(np.arange(len(k)), sketch.bands)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys), b.column("doc_id").take(pa.array(rep)), b.column("n").take(pa.array(rep))], names=["key", "id", "n"]
        )


def _likely(batches: Iterator, sketch: SetSketch, least: float) -> Iterator:
    for b in batches:
        if not b.num_rows:
            continue
        ka, kb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, sketch.size) for c in ("ka", "kb"))
        na, nb = (b.column(c).to_numpy().astype(float) for c in ("na", "nb"))
        keep = pa.array(sketch.jaccard(ka, kb, na, nb) >= least)
        yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])


def _sets(batches: Iterator, k: int) -> Iterator:
    hashes = WordHashes()
    for b in batches:
        ids, texts = b.column(0), b.column(1).to_pylist()
        for lo, hi in slices(len(texts), [len(t or b"") for t in texts], 8 << 20):
            sets = [word_shingles(t or b"", k, hashes).tobytes() for t in texts[lo:hi]]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(sets, pa.binary())], names=["id", "s"])


def _verified(batches: Iterator, percent: int) -> Iterator:
    """Rows sorted by (hub, part), the hub's own set first: confirms hub and member on their full sets."""
    unit, hubs = None, []
    for b in batches:
        a, c = [], []
        for hub, part, ident, s in zip(*(b.column(x).to_pylist() for x in ("hub", "part", "id", "s")), strict=True):
            if (hub, part) != unit:
                unit, hubs = (hub, part), []
            if ident == hub:
                hubs.append(np.frombuffer(s, np.uint64))
                continue
            x = np.frombuffer(s, np.uint64)
            for h in hubs:
                at = np.searchsorted(h, x)
                at[at == len(h)] = 0
                both = int((h[at] == x).sum())
                if 100 * both >= percent * (len(h) + len(x) - both):
                    a.append(hub)
                    c.append(ident)
                    break
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["a", "b"])


def _unit(hubs: list, rows: list, percent: int) -> list[tuple[int, int]]:
    """Links of ``rows`` (id, component, set) with ``hubs`` of other components, enough to join what they join.

    The hubs' sets become one sorted list of hashes with owners, against which each row's set is
    counted at once.
    """
    values = np.concatenate([h[2] for h in hubs])
    owner = np.repeat(np.arange(len(hubs)), [len(h[2]) for h in hubs])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    size = np.array([len(h[2]) for h in hubs])
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            x = p
        return x

    links = []
    for ident, comp, own in rows:
        lo, hi = np.searchsorted(values, own), np.searchsorted(values, own, "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(owner[at], minlength=len(hubs))
        for i in np.flatnonzero(100 * both >= percent * (size + len(own) - both)).tolist():
            x, y = root(hubs[i][1]), root(comp)
            if x != y:
                parent[max(x, y)] = min(x, y)
                links.append((hubs[i][0], ident))
    return links


def _blocks(batches: Iterator, percent: int) -> Iterator:
    """Rows sorted by unit (cluster, size, i, j): the unit's members, and which of them are to be compared with all."""
    unit, hubs, rows = None, [], []

    def done():
        links = _unit(hubs, rows, percent) if hubs and rows else []
        a, b = zip(*links, strict=True) if links else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    for batch in batches:
        columns = [batch.column(x).to_pylist() for x in ("cluster", "size", "i", "j", "hub", "open", "id", "comp", "s")]
        for cluster, size, i, j, hub, open_, ident, comp, s in zip(*columns, strict=True):
            if (cluster, size, i, j) != unit:
                if unit is not None:
                    yield done()
                unit, hubs, rows = (cluster, size, i, j), [], []
            row = (ident, comp, np.frombuffer(s, np.uint64))
            if hub:
                hubs.append(row)
            if open_:
                rows.append(row)
    if unit is not None:
        yield done()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, sketch: SetSketch = SetSketch(), part: int = 64, block: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text; other columns are ignored).

    Two documents are linked if 100 * |A & B| >= percent * |A | B| over their sets of k-word shingles
    (see word_shingles). component_id is the smallest doc_id that can be reached; kept marks it.
    Null, empty and blank texts have an empty set, are linked with nothing and are kept. A repeated
    row is returned as often as it is there; rows that share a doc_id are one document. A null doc_id
    has no component and is kept. No rows in, no rows out.
    """
    scope = Scope(docs.sparkSession)
    rows = rows_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    sketches = scope.table(rows.mapInArrow(lean(lambda it: _sketches(it, k, sketch)), "doc_id long, n long, h1 long, h2 long, k binary"), "sketches")
    full = sketches.where("n > 0 and doc_id is not null")
    classes = scope.table(full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")), "equal-sets")
    members = join_heavy(full, classes, ["h1", "h2", "n"], "c", sketches.count()).select("doc_id", "rep", "n", "k")
    members = scope.table(members, "classes")
    reps = members.where("doc_id = rep").select("doc_id", "n", "k").dropDuplicates(["doc_id", "n", "k"])

    # Buckets of two or more; each member is set against the bucket's smallest id.
    bands = scope.table(reps.mapInArrow(lean(lambda it: _bands(it, sketch)), "key long, id long, n long"), "bands")
    hubs = bands.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("c")).where("c > 1")
    stars = join_heavy(bands, scope.table(hubs, "hubs"), ["key"], "c", bands.count()).where("id <> hub.id")
    stars = stars.select(F.col("hub.id").alias("a"), F.col("hub.n").alias("na"), F.col("id").alias("b"), F.col("n").alias("nb")).distinct()
    stars = scope.table(stars, "stars")
    # All that buckets hold together, whether linked or not: each candidate pair is within one cluster.
    clusters = scope.table(connected_components(stars.select("a", "b"), write=scope.table), "clusters")
    wanted = clusters.select("id").hint("merge")
    sets = scope.table(rows.withColumnRenamed("doc_id", "id").join(wanted, "id").mapInArrow(lean(lambda it: _sets(it, k)), "id long, s binary"), "sets")
    small = scope.table(reps.withColumnRenamed("doc_id", "id").join(wanted, "id"), "sketches-wanted")

    # Stars: likelihood first, then full sets. A hub's members are dealt out in parts of about ``part``.
    j = percent / 100
    least = max(0.0, j - 6 * (j * (1 - j) / sketch.size) ** 0.5)
    pairs = stars.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
    hubs = pairs.groupBy("a").agg(F.count("*").alias("c")).join(small.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a")
    pairs = join_heavy(pairs, hubs, ["a"], "c", stars.count()).drop("c")
    pairs = pairs.join(small.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    likely = scope.table(pairs.mapInArrow(lean(lambda it: _likely(it, sketch, least)), "a long, b long"), "likely")
    degree = scope.table(likely.groupBy("a").agg(F.count("*").alias("d")).withColumn("parts", F.expr(f"cast(ceil(d / {part}) as int)")), "degrees")
    dealt = join_heavy(likely, degree, ["a"], "d", stars.count()).select(F.col("a").alias("hub"), F.expr("cast(pmod(xxhash64(b), parts) as int)").alias("part"), F.col("b").alias("id"))
    # A hub's set goes to each of its parts, in copies that HUB_PARTS of them share.
    hub_sets = degree.select(F.col("a").alias("id"), "parts").join(sets, "id").select("id", "parts", "s", F.explode(F.expr(f"sequence(0, cast((parts - 1) / {HUB_PARTS} as int))")).alias("copy")).repartition("id", "copy")
    own = hub_sets.select(F.col("id").alias("hub"), F.explode(F.expr(f"sequence(copy * {HUB_PARTS}, least(parts, (copy + 1) * {HUB_PARTS}) - 1)")).alias("part"), "id", "s")
    units = dealt.join(sets, "id").select("hub", "part", "id", "s").unionByName(own).repartition("hub", "part").sortWithinPartitions("hub", "part", F.col("id") != F.col("hub"))
    found = scope.table(units.select("hub", "part", "id", "s").mapInArrow(lean(lambda it: _verified(it, percent)), "a long, b long"), "links")
    parts = scope.table(connected_components(found, write=scope.table), "parts")

    # What the stars left open: in clusters of several components, whoever isn't in the largest one is
    # compared with the others of the cluster whose sets aren't too small or large, in blocks; only links leave a block.
    placed = clusters.select("id", F.col("component").alias("cluster")).join(parts, "id", "left")
    placed = placed.select("id", "cluster", F.coalesce("component", "id").alias("comp"))
    counts = placed.groupBy("cluster", "comp").agg(F.count("*").alias("n"))
    counts = counts.groupBy("cluster").agg(F.max_by("comp", "n").alias("main"), F.sum("n").alias("m"), F.max("n").alias("most"))
    counts = scope.table(counts.where("m > most and m > 2").select("cluster", "main", "m"), "open-clusters")
    # Sizes that differ by less than the similarity allows are in the same class or in neighbouring ones.
    wide = 1.0001 * float(np.log(max(100 / percent, 1.01)))
    open_ = join_heavy(placed, counts, ["cluster"], "m", clusters.count()).join(small.select("id", "n"), "id").select("id", "cluster", "comp", "n", F.floor(F.log("n") / wide).alias("size"), F.expr("comp <> main").alias("open"))
    open_ = scope.table(open_, "open")
    as_hub = open_.select("id", "comp", "cluster", "size", "n", F.lit(True).alias("hub"), F.lit(False).alias("open"))
    as_row = open_.where("open").select("id", "comp", "cluster", F.explode(F.expr("array(size - 1, size, size + 1)")).alias("size"), "n", F.lit(False).alias("hub"), F.lit(True).alias("open"))
    both = as_hub.unionByName(as_row)
    many = lambda hub: F.greatest(F.ceil(F.count(F.when(hub, 1)) / block), F.ceil(F.sum(F.when(hub, F.col("n"))) / BLOCK_HASHES)).cast("int")
    units = both.groupBy("cluster", "size").agg(many(F.col("hub")).alias("ni"), many(F.col("open")).alias("nj"), F.count("*").alias("m")).where("ni > 0 and nj > 0")
    both = join_heavy(both.drop("n"), scope.table(units, "units"), ["cluster", "size"], "m", clusters.count())
    i, j_ = F.expr("cast(pmod(xxhash64(id), ni) as int)"), F.expr("cast(pmod(xxhash64(id, 1), nj) as int)")
    as_hub = both.where("hub").select("id", "comp", "cluster", "size", i.alias("i"), F.explode(F.expr("sequence(0, nj - 1)")).alias("j"), "hub", "open")
    as_row = both.where("open").select("id", "comp", "cluster", "size", F.explode(F.expr("sequence(0, ni - 1)")).alias("i"), j_.alias("j"), "hub", "open")
    blocks = as_hub.unionByName(as_row).join(sets, "id").repartition("cluster", "size", "i", "j").sortWithinPartitions("cluster", "size", "i", "j")
    blocks = blocks.select("cluster", "size", "i", "j", "hub", "open", "id", "comp", "s")
    more = scope.table(blocks.mapInArrow(lean(lambda it: _blocks(it, percent)), "a long, b long"), "links")
    if more.head(1):
        parts = connected_components(found.unionByName(more), write=scope.table)

    every = members.select("doc_id", "rep").distinct().join(parts, F.col("rep") == F.col("id"), "left")
    every = every.select("doc_id", F.coalesce("component", "rep").alias("c"))
    # Rows that share a doc_id but not their text are one document: its smallest component counts.
    every = every.groupBy("doc_id").agg(F.min("c").alias("c"))
    out = sketches.select("doc_id", "n").join(every, "doc_id", "left")
    component = F.coalesce("c", "doc_id")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
    return scope.result(out, "near-duplicates")


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that near_duplicates doesn't keep; a null doc_id stays.

    Ties: of a group the smallest doc_id stays. Repeated rows are one document: all of them stay or go. Documents without
    words stay. Other columns stay as they are, whatever their names. No rows in, no rows out.
    """
    gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
