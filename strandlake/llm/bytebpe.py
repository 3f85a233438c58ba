"""Byte-level BPE encoding and decoding over a lazily determinised transducer.

Texts are cut by the vocabulary's pattern; each piece runs through the transducer, unless it is a
vocabulary entry itself, which then is its encoding. A pattern match never goes on past a
non-blank run into the white space that follows, so a text is first cut into such stretches, whose
ids, and what these are decoded to, are remembered in a bounded table. Decoding goes through an incremental UTF-8 state machine over
the entries' bytes, which holds back at most three bytes of a character that isn't whole yet.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Generations, Remembered, rows_only, segments
from .transducer import IdTransducer, Lockstep, Merges

#: White space as the pattern's \s has it (Unicode's White_Space). Fixed values.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Places (as a power of two) in a worker's table of stretches, and pieces that each generation of its memory holds.
STRETCHES, PIECES = 21, 200_000
#: Longer pieces go through the transducer one by one.
LONG = 64
#: States with bytes held back that the decoder remembers.
MOST_STATES = 10_000


def utf8_step(held: bytes, byte: int) -> tuple[str, bytes]:
    """One step of the UTF-8 state machine: the text that ``byte`` makes certain, and the next state.

    A state is the bytes of a sequence that isn't whole yet; it says how many continuation bytes are due and which
    the next one may be. A byte that can't follow turns the sequence into U+FFFD and starts anew.
    """
    if held:
        first = held[0]
        low = {0xE0: 0xA0, 0xF0: 0x90}.get(first, 0x80) if len(held) == 1 else 0x80
        high = {0xED: 0x9F, 0xF4: 0x8F}.get(first, 0xBF) if len(held) == 1 else 0xBF
        if low <= byte <= high:
            held += bytes((byte,))
            whole = len(held) == (2 if first < 0xE0 else 3 if first < 0xF0 else 4)
            return (held.decode(), b"") if whole else ("", held)
        text, held = utf8_step(b"", byte)
        return "\ufffd" + text, held
    if byte < 0x80:
        return chr(byte), b""
    return ("", bytes((byte,))) if 0xC2 <= byte < 0xF5 else ("\ufffd", b"")


class Utf8Stream:
    """Tokens in, text out. Transitions over whole tokens are run through utf8_step once, when a state first meets the token."""

    def __init__(self, tokens: dict):
        self.tokens = tokens
        self.go: dict[bytes, dict] = {b"": {}}

    def step(self, state: bytes, token) -> tuple[str, bytes]:
        known = self.go.setdefault(state, {})
        found = known.get(token)
        if found is None:
            parts, to = [], state
            for byte in self.tokens[token]:
                text, to = utf8_step(to, byte)
                parts.append(text)
            found = known[token] = "".join(parts), to
            if len(self.go) > MOST_STATES:
                self.go = {b"": self.go[b""]}
        return found

    def run(self, tokens: Iterable) -> Iterator[str]:
        state = b""
        for t in tokens:
            text, state = self.step(state, t)
            if text:
                yield text
        if state:
            yield "\ufffd"


class ByteBpe:
    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        self.bytes = {b: a for a, b in self.ranks.items()}
        self.by_text = {str(b): a for a, b in self.ranks.items()}
        self.pieces = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        self.machine = IdTransducer(Merges(self.bytes, {i: self.ranks[bytes((i,))] for i in range(256)}, self._rule))
        self.batch = Lockstep(self.machine)
        self.names = {t: str(t) for t in self.bytes}
        self.pieces_known, self.stretches = Generations(PIECES), Remembered(STRETCHES)
        self.ids_of: list[bytes] = []
        self.bytes_of: list[bytes] = []
        self.stream = Utf8Stream(self.bytes)
        # By ids as they are written: the text of tokens that begin and end between characters, and all transitions.
        self.whole = {str(t): text for t in self.bytes for text, state in [self.stream.step(b"", t)] if not state and "\ufffd" not in text}
        self.written = Utf8Stream({str(t): x for t, x in self.bytes.items()})

    def _rule(self, a: int, b: int) -> tuple[int, int] | None:
        to = self.ranks.get(self.bytes[a] + self.bytes[b])
        return None if to is None else (to, to)

    def _learn(self, stretches: list[bytes], first: int) -> None:
        """Puts the stretches' ids, as they are written, and what these are decoded to under the numbers from ``first`` on."""
        cut = [self.pieces.findall(x.decode()) for x in stretches]
        pieces = self.pieces_known.missing(set().union(*cut))
        known, short, data = self.pieces_known.known, [], []
        for p in pieces:
            d = p.encode()
            whole = self.ranks.get(d)
            if whole is not None:
                known[p] = self.names[whole]
            elif len(d) <= LONG:
                short.append(p)
                data.append(d)
            else:
                known[p] = ",".join(map(str, self.machine(d)))
        if short:
            ids, count = self.batch(np.frombuffer(b"".join(data), np.uint8).astype(np.int64), np.fromiter(map(len, data), np.int64, len(data)))
            names = list(map(self.names.__getitem__, ids.tolist()))
            at = 0
            for p, n in zip(short, count.tolist(), strict=True):
                known[p] = ",".join(names[at : at + n])
                at += n
        get = known.__getitem__
        ids = [",".join(map(get, p)) if len(p) > 1 else get(p[0]) for p in cut]
        self.pieces_known.rest()
        self._forget(first)
        self.ids_of += [x.encode() for x in ids]
        self.bytes_of += [self.decode(x).encode() for x in ids]

    def _forget(self, n: int) -> None:
        del self.ids_of[n:]
        del self.bytes_of[n:]

    def encode_batch(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(decimal ids joined by commas, the bytes that they are decoded to) of each text."""
        number, count = self.stretches.numbers(texts, True, self._learn, self._forget)
        numbers, out, at = number.tolist(), [], 0
        for n in count.tolist():
            part = numbers[at : at + n]
            out.append((b",".join(map(self.ids_of.__getitem__, part)), b"".join(map(self.bytes_of.__getitem__, part))))
            at += n
        return out

    def encode(self, text: str) -> str:
        return self.encode_batch([text.encode()])[0][0].decode()

    def decode(self, ids: str) -> str:
        """The text of ids as encode gives them. While tokens end between characters the state machine stays in its first state."""
        if not ids:
            return ""
        tokens = ids.split(",")
        parts = list(map(self.whole.get, tokens))
        return "".join(self.written.run(tokens) if None in parts else parts)

    def decode_stream(self, ids: Iterable[int]) -> Iterator[str]:
        return self.stream.run(ids)


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def _digests(batches: Iterator, path: str, pattern: str, with_ids: bool) -> Iterator:
    bpe = byte_bpe(path, pattern)
    for b in batches:
        n, coded, decoded, kept = [], [], [], []
        texts = [t or b"" for t in b.column(1).to_pylist()]
        found: list[list[tuple[bytes, bytes]]] = [[] for _ in texts]
        for which, parts in segments(texts):
            for i, own in zip(which, bpe.encode_batch(parts), strict=True):
                found[i].append(own)
        for own in found:
            ids, data = own[0] if len(own) == 1 else (b",".join(x for x, _ in own), b"".join(x for _, x in own))
            n.append(ids.count(b",") + 1 if ids else 0)
            coded.append(hashlib.sha256(ids).hexdigest())
            decoded.append(hashlib.sha256(data).hexdigest())
            if with_ids:
                kept.append([int(x) for x in ids.split(b",")] if ids else [])
        columns = [b.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            columns.append(pa.array(kept, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(columns, names=names)


def encode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids of every row of ``docs``.

    No special tokens. A null text counts as empty (no ids); repeated rows and null doc_ids are kept
    as they are; other columns are ignored. ``path`` must be readable on each executor.
    """
    rows = rows_only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(lambda it: _digests(it, path, pattern, with_ids), schema)


def _texts(batches: Iterator, path: str, pattern: str) -> Iterator:
    bpe = byte_bpe(path, pattern)
    for b in batches:
        texts = ["".join(bpe.decode_stream(ids or [])) for ids in b.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, text of rows with doc_id, ids; null or empty ids give an empty text."""
    return rows_only(encoded, "doc_id", "ids").mapInArrow(lambda it: _texts(it, path, pattern), "doc_id long, text string")
