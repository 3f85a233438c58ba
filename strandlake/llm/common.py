"""Shared pieces: work folders, lineage cuts, word hashes, connected components."""

from __future__ import annotations

import ctypes
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Entries a worker's word cache may hold; beyond that new words are hashed each time.
WORD_CACHE = 400_000


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a fresh local one where that is unset and all runs in one process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def as_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and reread it, so that a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What Scope lets an Arrow batch have: texts and sets are long, and both sides hold a batch whole.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


def lean(f: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``f``, after which what the worker doesn't use any more goes back to the system: later stages run in the same worker."""

    def run(batches: Iterator) -> Iterator:
        yield from f(batches)
        give_back()

    return run


def give_back() -> None:
    """Unused memory goes back to the system; a matter of a fraction of a millisecond."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def small_batches(spark: SparkSession) -> None:
    """For results that are worked out after an operator has returned: Arrow batches stay small (BATCH) in this session."""
    for k, v in BATCH.items():
        spark.conf.set(k, v)


class Scope:
    """An operator's intermediate tables. ``result`` writes what it returns and deletes the others, so that they don't pile up in the shared folder.

    Until then Arrow batches are small (BATCH). If a table can't be written, or a ``with`` block fails, tables go and settings come back too.
    The result's own table is the caller's to delete.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        self.before = {k: spark.conf.get(k) for k in BATCH}
        for k, v in BATCH.items():
            spark.conf.set(k, v)

    def __enter__(self) -> Scope:
        return self

    def __exit__(self, *error) -> None:
        self.close()

    def path(self, name: str) -> str:
        self.paths.append(path := new_path(self.spark, name))
        return path

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        try:
            df.write.option("compression", "zstd").parquet(path)
        except BaseException:
            self.close()
            raise
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        try:
            return as_table(df, name)
        finally:
            self.close()

    def close(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []
        for k, v in self.before.items():
            self.spark.conf.set(k, v)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Groups that join_heavy broadcasts at most; smaller ones never count as heavy.
HEAVY, LEAST_HEAVY = 1000, 1000


def join_heavy(rows: DataFrame, groups: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) joined with their group's one row in ``groups``, in which ``count`` is the group's size.

    Groups of more than a HEAVYth of all rows, of which there can't be more than HEAVY, are broadcast, so that no
    task gets all of their rows; the others are joined by shuffle.
    """
    bound = max(LEAST_HEAVY, total // HEAVY)
    heavy = groups.where(F.col(count) > bound)
    if not heavy.head(1):
        return rows.join(groups, keys)
    light = rows.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(groups.where(F.col(count) <= bound), keys)
    return rows.join(F.broadcast(heavy), keys).unionByName(light)


class Recent(dict):
    """What ``make`` gives for a key, remembered in two generations of up to ``most`` keys.

    A full young generation becomes the old one, whose keys come back when they are asked for, so common keys stay.
    """

    def __init__(self, make: Callable, most: int, longest: int = 64):
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Generations:
    """As Recent, for whole batches: a batch's keys are all in ``known`` until ``rest``."""

    def __init__(self, most: int, longest: int = 64):
        self.known, self.old, self.most, self.longest = {}, {}, most, longest

    def missing(self, keys: set) -> set:
        """The keys that aren't known; those of the old generation become known."""
        new = keys.difference(self.known)
        back = {k: v for k in new if (v := self.old.get(k)) is not None}
        self.known.update(back)
        self.fresh = new.difference(back)
        return self.fresh

    def rest(self) -> None:
        """After a batch: long keys are forgotten, and a full generation is set aside."""
        for k in [k for k in self.fresh if len(k) > self.longest]:
            del self.known[k]
        if len(self.known) > self.most:
            self.known, self.old = {}, self.known


class Powers:
    """Powers of an odd number and of its inverse modulo 2 ** 64, as many as were asked for."""

    base = 0x5851F42D4C957F2D

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 20)
            self.up, self.down = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, x, np.uint64))), dtype=np.uint64) for x in (self.base, pow(self.base, -1, 2**64)))
        return self.up, self.down


POWERS = Powers()


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of spans of bytes, as differences of running sums of byte * power."""
    up, down = POWERS.upto(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    sums = total[1:]
    sums[:] = buf
    sums += np.uint64(1)
    sums *= up[: len(buf)]
    np.cumsum(sums, out=sums)
    return mix64((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD1342543DE82EF95))


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def blanks(buf: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to white space (Unicode's White_Space)."""
    out = _BLANK[buf]
    for first, second, third in ((0xC2, (0x85, 0xA0), None), (0xE1, (0x9A,), (0x80,)), (0xE2, (0x80,), (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)), (0xE2, (0x81,), (0x9F,)), (0xE3, (0x80,), (0x80,))):
        at = np.flatnonzero(buf == first)
        width = 2 if third is None else 3
        at = at[at + width <= len(buf)]
        at = at[np.isin(buf[at + 1], second)]
        if third is not None:
            at = at[np.isin(buf[at + 2], third)]
        for i in range(width):
            out[at + i] = True
    return out


def chunks(texts: list[bytes], with_space: bool) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(all texts, where their chunks start and end, chunks per text): runs between white space, or each run with the white space before it and what is left at a text's end."""
    data = b"\n".join(texts) + b"\n"
    buf = np.frombuffer(data, np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blanks(buf))).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    first = np.cumsum(size + 1) - size - 1
    if with_space:
        end = np.union1d(end, (first + size)[size > 0])
        before = np.concatenate(([0], end[:-1]))
        start = np.maximum(before, first[np.searchsorted(first, end - 1, "right") - 1])
    return data, start, end, np.diff(np.searchsorted(start, np.concatenate((first, [len(data)]))))


#: Bytes of text that are cut into chunks at a time.
SEGMENT = 2 << 20
_RUN = re.compile(rb"[\t-\r ]+")


def segments(texts: list[bytes], most: int = SEGMENT) -> Iterator[tuple[list[int], list[bytes]]]:
    """(numbers of the texts, their segments) of about ``most`` bytes at a time. Longer texts are parted before white space; a part without any stays whole."""
    which: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while len(t) - at > most:
            run = next((m for m in _RUN.finditer(t, at + most) if not blanks(np.frombuffer(t[m.start() - 3 : m.start()], np.uint8))[-1]), None)
            end = run.start() if run else len(t)
            if parts:
                yield which, parts
                which, parts, size = [], [], 0
            yield [i], [t[at:end]]
            at = end
        if at < len(t) or not at:
            which.append(i)
            parts.append(t[at:])
            size += len(t) - at
        if size >= most:
            yield which, parts
            which, parts, size = [], [], 0
    if parts:
        yield which, parts


class ChunkTable:
    """64-bit hashes -> numbers from 0 in the order in which they came; open addressing in arrays that grow only for what one batch adds."""

    def __init__(self, bits: int):
        self.least = 1 << bits
        self.clear()

    @property
    def full(self) -> bool:
        return self.n > 0.6 * self.least

    def clear(self) -> None:
        self.size, self.n = self.least, 0
        self.keys, self.numbers = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """Where each hash is, or the free place where it would be."""
        slot = (h & np.uint64(self.size - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            k = self.keys[slot[left]]
            left = left[(k != h[left]) & (k != 0)]
            slot[left] = (slot[left] + 1) & self.size - 1
        return slot

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers; -1 for hashes that aren't there."""
        slot = self._slots(h)
        return np.where(self.keys[slot] == h, self.numbers[slot], -1).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        """Numbers for distinct hashes that aren't there; the table grows if it must."""
        while self.n + len(h) > 0.8 * self.size:
            keys, numbers = self.keys, self.numbers
            full = keys != 0
            self.size *= 2
            self.keys, self.numbers = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32)
            self._put(keys[full], numbers[full])
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _put(self, h: np.ndarray, numbers: np.ndarray) -> None:
        while len(h):
            slot = self._slots(h)
            _, first = np.unique(slot, return_index=True)
            self.keys[slot[first]], self.numbers[slot[first]] = h[first], numbers[first]
            rest = np.ones(len(h), bool)
            rest[first] = False
            h, numbers = h[rest], numbers[rest]


class Remembered:
    """Numbers of chunks; what is worked out for a new chunk is kept by the caller under the next number.

    Chunks of more than LONGEST bytes, and all chunks when the table is full, are forgotten after their batch. Chunks are told
    apart by 64-bit hashes.
    """

    LONGEST = 64

    def __init__(self, bits: int):
        self.table = ChunkTable(bits)

    def numbers(self, texts: list[bytes], with_space: bool, learn: Callable[[list[bytes], int], None], forget: Callable[[int], None]) -> tuple[np.ndarray, np.ndarray]:
        """(number of each chunk, chunks per text). ``learn(chunks, first number)`` works out new ones; ``forget(n)`` keeps only the numbers under n."""
        forget(self.table.n)
        if self.table.full:
            self.table.clear()
            forget(0)
        if len(texts) == 1 and len(texts[0]) > 2 * SEGMENT:  # hardly any white space: one chunk
            learn(texts, self.table.n)
            return np.array([self.table.n]), np.array([1])
        data, start, end, count = chunks(texts, with_space)
        h = span_hashes(np.frombuffer(data, np.uint8), start, end)
        h[h == 0] = 1
        found = self.table.find(h)
        new = np.flatnonzero(found < 0)
        if len(new):
            long = end[new] - start[new] > self.LONGEST
            _, first = np.unique(h[new[~long]], return_index=True)
            first = new[~long][first]
            base = self.table.n
            self.table.add(h[first])
            at, where = [*zip(start[first].tolist(), end[first].tolist(), strict=True)], new[long]
            learn([data[a:b] for a, b in at] + [data[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)], base)
            found[new] = self.table.find(h[new])
            found[where] = base + len(first) + np.arange(len(where))
        return found, count


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered for up to WORD_CACHE words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = value
        return value

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_shingles(text: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of ``text``.

    Words are the runs between ASCII white space, A-Z lower-cased; fewer than k words make one
    shingle, none make an empty set.
    """
    words = text.lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = hashes.array(words)
    k = min(k, n)
    # The shingle's length is mixed in, so a short text never equals part of a longer one.
    s = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i]
    s = mix64(s)
    s.sort()
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def _forest(batches: Iterator, names: tuple[str, str]) -> Iterator:
    """Within one partition: edges to a star per component (each node to its smallest)."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = parent[x]
        return x

    def stars():
        u = np.fromiter(parent, np.int64, len(parent))
        v = np.fromiter(map(root, parent), np.int64, len(parent))
        keep = u != v
        return pa.RecordBatch.from_arrays([pa.array(u[keep]), pa.array(v[keep])], names=list(names))

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            a, c = root(x), root(y)
            if a != c:
                lo, hi = min(a, c), max(a, c)
                parent[hi] = lo
                parent.setdefault(lo, lo)
        if len(parent) > 1_000_000:  # bounded memory: what is known so far leaves as stars
            yield stars()
            parent = {}
    if parent:
        yield stars()


#: Edges that one task contracts at a time.
CONTRACT = 200_000


def connected_components(edges: DataFrame, max_rounds: int = 60, write: Callable[[DataFrame, str], DataFrame] = as_table) -> DataFrame:
    """(a, b) long edges -> (id, component): each node on an edge and the smallest id it can reach.

    Tasks first contract up to CONTRACT edges each; large-star and small-star rounds follow until every
    component is a star. Each round is written to the shared folder; nothing is collected. Rows with
    nulls and loops are ignored.
    """
    n = edges.count()
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = e.where("a is not null and b is not null and u > v").select("u", "v").coalesce(-(-n // CONTRACT) or 1)
    e = write(e.mapInArrow(lean(lambda it: _forest(it, ("u", "v"))), "u long, v long"), "components")
    for _ in range(max_rounds):
        seen = e.select(F.col("u").alias("x"), F.lit(1).alias("n"), F.lit(0).alias("r"))
        seen = seen.unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("n"), F.lit(1).alias("r")))
        seen = seen.groupBy("x").agg(F.sum("n").alias("n"), F.max("r").alias("r"))
        if n <= CONTRACT or not seen.where("n > 1 or n > 0 and r > 0").head(1):
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = write(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "components")
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("u"), "v").distinct()
    return e.unionByName(roots).select(F.col("u").alias("id"), F.col("v").alias("component"))


def slices(n: int, sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about ``most`` at a time."""
    start = total = 0
    for i in range(n):
        total += sizes[i]
        if total >= most:
            yield start, i + 1
            start, total = i + 1, 0
    if start < n:
        yield start, n


def rows_only(df: DataFrame, *names: str) -> DataFrame:
    """Just the named columns; other columns of the input can't clash with an operator's own."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def env_threads() -> None:
    for name in ("TOKENIZERS_PARALLELISM", "RAYON_NUM_THREADS"):
        os.environ.setdefault(name, "false" if name[0] == "T" else "1")
