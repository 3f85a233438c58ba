"""Token counts by a compiled finite-state tokenizer.

The tokenizer file's merges become a deterministic transducer whose transitions carry the number of
tokens they emit. White space brings the machine back to its start, so the map of a chunk between white
space has one entry, the start, and is known whatever comes before; all chunks' maps of a batch compose
by one prefix scan (of counts, as every exit is the start), from which documents take their differences.
A long piece is cut into blocks. A block's map is made for every hypothesis that the symbols next to it
allow at its beginning, without knowing what the blocks before it make of them; maps compose by a prefix
scan over their entries and exits.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import SPACE
from .common import Recent, Remembered, rows_only, segments
from .transducer import NODE, CountTransducer, Merges

#: Places (as a power of two) in a worker's table of chunks, and pieces that each generation of its memory holds.
CHUNKS, PIECES = 22, 200_000
#: Symbols in a block of a long piece, and blocks whose maps are remembered.
BLOCK, MAPS = 256, 1000


def printable_bytes() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for U+0100 and on, in order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


Map = dict[int, dict[int, int]]


def compose(f: Map, g: Map) -> Map:
    """entry of f -> {exit of g: tokens}. A hypothesis is reached in one way only, so no two ways give it different counts."""
    return {q: {end: n + m for mid, n in exits.items() for end, m in g.get(mid, {}).items()} for q, exits in f.items()}


def scan(maps: list[Map]) -> list[Map]:
    """Inclusive prefix scan by doubling: each step composes maps that are 1, 2, 4, ... apart."""
    done, step = list(maps), 1
    while step < len(done):
        done = [done[i] if i < step else compose(done[i - step], done[i]) for i in range(len(done))]
        step *= 2
    return done


class WordCounter:
    """A tokenizers file of the kind: NFC, lower case, white space dropped, byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], printable_bytes()
        end = model["end_of_word_suffix"]
        self.special_ids = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = list(self.special_ids)
        ids = {k: v for k, v in model["vocab"].items() if k not in self.special}
        last = lambda s: s[: -len(end)] if s.endswith(end) else s
        symbols = {v: (*(alphabet[c] for c in last(k)[:-1]), alphabet[last(k)[-1]] + 256 * k.endswith(end)) for k, v in ids.items() if last(k)}
        self.first = {s[0]: t for t, s in symbols.items() if len(s) == 1}
        self.rules: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rules[ids[a] << 20 | ids[b]] = (rank, ids[a + b])
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}"))
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.merges = Merges(symbols, self.first, lambda a, b: self.rules.get(a << 20 | b))
        self.pieces_known = Recent(lambda p: self.piece(self.piece_symbols(p)), PIECES, 32)
        self.chunks, self.tokens = Remembered(CHUNKS), np.empty(1 << 18, np.int64)
        self.maps: dict[tuple, Map] = {}

    @cached_property
    def machine(self) -> CountTransducer:
        return CountTransducer(self.merges)

    def parts(self, chunk: str) -> Iterator[str | None]:
        """Pieces of a chunk; None for a special token."""
        for i, part in enumerate(self.split.split(chunk) if self.split and "<" in chunk else [chunk]):
            if i % 2:
                yield None
            elif part:
                part = part if part.isascii() else unicodedata.normalize("NFC", part)
                part = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
                yield from self.pieces.findall(part)

    @staticmethod
    def piece_symbols(piece: str) -> list[int]:
        s = [*piece.encode()]
        s[-1] += 256
        return s

    def chunk(self, chunk: str) -> int:
        return sum(1 if p is None else self.pieces_known[p] for p in self.parts(chunk))

    def piece(self, symbols: list[int]) -> int:
        return self.machine(symbols) if len(symbols) <= 2 * BLOCK else self.long_piece(symbols)

    def block_map(self, before: tuple, block: tuple, whole: bool) -> Map:
        key = (before, block, whole)
        found = self.maps.get(key)
        if found is None:
            if len(self.maps) >= MAPS:
                self.maps.clear()
            self.machine.trim()
            found = self.maps[key] = self.machine.block_map(block, self.machine.entries(before, whole))
        return found

    def long_piece(self, symbols: list[int], block: int = BLOCK) -> int:
        context = 2 * self.machine.longest
        maps = [self.block_map(tuple(symbols[max(0, i - context) : i]), tuple(symbols[i : i + block]), i <= context) for i in range(0, len(symbols), block)]
        # From the start (an empty entry with no token before it) to the exit at which no entry is growing.
        return next(n for end, n in scan(maps)[-1][0].items() if end < 1 << NODE)

    def learn(self, chunks: list[bytes], first: int) -> None:
        """Puts the chunks' counts under the numbers from ``first`` on."""
        while first + len(chunks) > len(self.tokens):
            self.tokens = np.concatenate((self.tokens, np.empty_like(self.tokens)))
        self.tokens[first : first + len(chunks)] = [self.chunk(c.decode()) for c in chunks]

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Tokens of each text: differences of the scan over all chunks."""
        number, count = self.chunks.numbers(texts, False, self.learn, lambda n: None)
        total = np.concatenate(([0], np.cumsum(self.tokens[number])))
        return np.diff(total[np.concatenate(([0], np.cumsum(count)))])


@lru_cache(maxsize=2)
def word_counter(path: str) -> WordCounter:
    return WordCounter(path)


def _counts(batches: Iterator, path: str, limit: int) -> Iterator:
    counter = word_counter(path)
    for b in batches:
        texts = [t or b"" for t in b.column(1).to_pylist()]
        size = list(map(len, texts))
        n = np.zeros(len(texts), np.int64)
        for which, parts in segments(texts):
            np.add.at(n, which, counter.counts(parts))
        columns = [b.column(0), pa.array(size, pa.int64()), pa.array(n), pa.array(n > limit)]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_tokens", "over_limit"])


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every row of ``docs``.

    The special strings of the tokenizer's file count as one token each, as its library has it. A
    null text counts as empty (0 bytes, 0 tokens); repeated rows and null doc_ids are kept as they
    are; other columns are ignored. ``path`` must be readable on each executor.
    """
    rows = rows_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(lambda it: _counts(it, path, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
