"""BAM: a codec, a source and a sink.

Records straddle blocks. A file is read in byte ranges: a task looks for the first place in its range from
which records can follow one another. A list of record starts (virtual offsets) beside the file, as
``split_points`` makes it, is used instead where there is one.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bgzf import BLOCK, END, block_size, compress_block
from .files import BatchFolderWriter, ByteRange, Indexed, Pushing, flag, listed, open_path

#: 4-bit bases and CIGAR operators by code. Fixed values.
BASES, OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
#: Sizes and struct codes of typed tags. Fixed values.
TAGS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
SCHEMA = "qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen int, seq string, qual string, aux map<string,struct<type:string,value:string>>, aux_order array<string>, rec_idx long"
COLUMNS = ["qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual", "aux", "aux_order", "rec_idx"]


def header_bytes(text: str, references: list[tuple[str, int]]) -> bytes:
    out = b"BAM\x01" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(references))
    for name, n in references:
        out += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", n)
    return out


def references_of(text: str) -> list[tuple[str, int]]:
    """Names and lengths of a header's @SQ lines."""
    out = []
    for line in text.splitlines():
        if line.startswith("@SQ"):
            f = dict(x.split(":", 1) for x in line.split("\t")[1:])
            out.append((f["SN"], int(f["LN"])))
    return out


def bin_number(beg: int, stop: int) -> int:
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if beg >> shift == stop - 1 >> shift:
            return first + (beg >> shift)
    return 0


def encode_tag(tag: str, kind: str, value: str) -> bytes:
    head = tag.encode()
    if kind == "i":
        n = int(value)
        kind = next(k for k, (lo, hi) in {"C": (0, 255), "c": (-128, 127), "S": (0, 65535), "s": (-32768, 32767), "i": (-(2**31), 2**31 - 1), "I": (0, 2**32 - 1)}.items() if lo <= n <= hi)
        return head + kind.encode() + struct.pack("<" + TAGS[kind], n)
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(value))
    if kind == "A":
        return head + b"A" + value.encode()[:1]
    if kind == "B":
        sub, *items = value.split(",")
        number = float if sub == "f" else int
        return head + b"B" + sub.encode() + struct.pack("<i", len(items)) + struct.pack(f"<{len(items)}{TAGS[sub]}", *map(number, items))
    return head + kind.encode() + value.encode() + b"\0"


def decode_tags(data: bytes) -> list[tuple[str, str, str]]:
    out, at = [], 0
    while at < len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in TAGS:
            value = struct.unpack_from("<" + TAGS[kind], data, at)[0]
            at += struct.calcsize(TAGS[kind])
            out.append((tag, "f" if kind == "f" else "i", f"{value:g}" if kind == "f" else str(value)))
        elif kind == "A":
            out.append((tag, "A", chr(data[at])))
            at += 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            items = struct.unpack_from(f"<{n}{TAGS[sub]}", data, at + 5)
            at += 5 + n * struct.calcsize(TAGS[sub])
            out.append((tag, "B", ",".join([sub, *(f"{x:g}" if sub == "f" else str(x) for x in items)])))
        else:
            end = data.index(b"\0", at)
            out.append((tag, kind, data[at:end].decode()))
            at = end + 1
    return out


def encode_record(r: dict, ids: dict[str, int]) -> bytes:
    from ..functions.kernels import operations

    ops, seq = operations(r["cigar"]), r["seq"] or ""
    pos = (r["pos"] or 0) - 1
    span = sum(n for n, o in ops if o in "MDN=X") or 1
    name = (r["qname"] or "*").encode() + b"\0"
    codes = [BASES.find(c) if c in BASES else 15 for c in seq.upper()] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    qual = bytes(ord(c) - 33 for c in r["qual"]) if r.get("qual") else b"\xff" * len(seq)
    aux = r.get("aux") or {}
    tags = b"".join(encode_tag(t, aux[t]["type"], aux[t]["value"]) for t in (r.get("aux_order") or list(aux)))
    rid = ids.get(r["rname"], -1) if r["rname"] else -1
    nid = ids.get(r["rnext"], -1) if r["rnext"] else -1
    body = struct.pack("<iiBBHHHiiii", rid, pos, len(name), 255 if r["mapq"] is None else r["mapq"], bin_number(max(pos, 0), max(pos, 0) + span) if pos >= 0 else 4680, len(ops), r["flag"], len(seq), nid, (r["pnext"] or 0) - 1, r["tlen"] or 0)
    body += name + b"".join(struct.pack("<I", n << 4 | OPS.index(o)) for n, o in ops) + packed + qual + tags
    return struct.pack("<i", len(body)) + body


def decode_record(body: bytes, references: list[tuple[str, int]]) -> tuple:
    rid, pos, ln, mapq, _, n_ops, flag, n, nid, npos, tlen = struct.unpack_from("<iiBBHHHiiii", body)
    at = 32
    name = body[at : at + ln - 1].decode()
    at += ln
    ops = struct.unpack_from(f"<{n_ops}I", body, at)
    at += 4 * n_ops
    half = body[at : at + (n + 1) // 2]
    at += (n + 1) // 2
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in half)[:n]
    qual = body[at : at + n]
    at += n
    tags = decode_tags(body[at:])
    ref = lambda i: references[i][0] if i >= 0 else None
    return (
        name, flag, ref(rid), pos + 1 if pos >= 0 else None, None if mapq == 255 else mapq, "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops) or "*", ref(nid), npos + 1 if npos >= 0 else None, tlen, seq,
        None if not n or qual[0] == 255 else "".join(chr(q + 33) for q in qual), {t: (k, v) for t, k, v in tags}, [t for t, _, _ in tags],
    )


#: A record's fixed fields after its size. Fixed values.
HEAD = np.dtype([("rid", "<i4"), ("pos", "<i4"), ("name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("ops", "<u2"), ("flag", "<u2"), ("n", "<i4"), ("nid", "<i4"), ("npos", "<i4"), ("tlen", "<i4")])
#: Codes of bases by byte, and the two bases of a packed byte.
_CODES = np.full(256, 15, np.uint8)
_CODES[[ord(c) for c in BASES]] = _CODES[[ord(c) for c in BASES.lower()]] = range(16)
_PAIRS = np.array([[ord(BASES[b >> 4]), ord(BASES[b & 15])] for b in range(256)], np.uint8)
#: Bytes of a batch that are encoded, and of records that are decoded, together.
TOGETHER = 1 << 22


def spread(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, where each begins and the last ends) of a column of strings or bytes; nulls are empty."""
    import pyarrow as pa

    a = column.cast(pa.binary()).fill_null(b"")
    at = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)
    data = np.frombuffer(a.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at.astype(np.int64) - at[0]


def packed_column(data, at: np.ndarray, text: bool = False):
    """The column whose values lie between neighbours of ``at``."""
    import pyarrow as pa

    column = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
    return column.cast(pa.string()) if text else column


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As spread, of the stretches of ``data`` from ``starts`` on."""
    at = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return data[np.repeat(starts - at[:-1], sizes) + np.arange(at[-1])], at


def distinct(column, f: Callable, kind):
    """``f`` of a column's values, each distinct one worked out once."""
    import pyarrow as pa

    d = column.dictionary_encode()
    return pa.array([f(x) for x in d.dictionary.to_pylist()], kind).take(d.indices)


def numbers(column, none: int = 0) -> np.ndarray:
    """A column of integers, with ``none`` for nulls."""
    import pyarrow as pa

    return column.cast(pa.int64()).fill_null(none).to_numpy(zero_copy_only=False)


def tag_columns(aux, order) -> tuple:
    """(tags as BAM holds them, where each row's begin and the last's end) of columns aux and aux_order."""
    import pyarrow as pa
    import pyarrow.compute as pc

    at = np.asarray(aux.offsets).astype(np.int64)
    sizes = np.where(np.asarray(aux.is_valid()), np.diff(at), 0)
    entries = np.repeat(at[:-1] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum()) if len(sizes) else np.zeros(0, np.int64)
    keys, items = aux.keys.take(pa.array(entries)), aux.items.take(pa.array(entries))
    begins = np.concatenate([[0], np.cumsum(sizes)])
    ordered = numbers(pc.list_value_length(order))
    if not ((ordered == sizes) | (ordered == 0)).all() or (sizes[ordered == 0]).any() or not order.flatten().equals(keys):
        names, picks, sizes = keys.to_pylist(), [], []
        for lo, hi, tags in zip(begins[:-1].tolist(), begins[1:].tolist(), order.to_pylist(), strict=True):
            place = {names[i]: i for i in range(lo, hi)}
            picks += [place[t] for t in tags or names[lo:hi]]
            sizes.append(len(tags or names[lo:hi]))
        keys, items, begins = keys.take(pa.array(picks, pa.int64())), items.take(pa.array(picks, pa.int64())), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    text = pc.binary_join_element_wise(keys, *items.flatten(), "\t")
    if text.null_count:
        raise ValueError("a tag without a type or value")
    return distinct(text, lambda x: encode_tag(*x.split("\t", 2)), pa.binary()), begins


def column_of(batch, names: list[str], name: str):
    """A batch's column; nulls where there is none."""
    import pyarrow as pa

    kinds = {"aux": pa.map_(pa.string(), pa.struct([("type", pa.string()), ("value", pa.string())])), "aux_order": pa.list_(pa.string())}
    return batch.column(names.index(name)) if name in names else pa.nulls(batch.num_rows, kinds.get(name, pa.string()))


def batch_of(rows: Iterable[dict]):
    """A batch of SCHEMA's columns; tags are pairs of type and value, or have these as names."""
    import pyarrow as pa

    kinds = {"flag": pa.int32(), "mapq": pa.int32(), "tlen": pa.int32(), "pos": pa.int64(), "pnext": pa.int64(), "rec_idx": pa.int64(), "aux_order": pa.list_(pa.string())}
    # What rows have in common is converted once.
    tags = [None if a is None else tuple((t, *(v if isinstance(v, tuple) else (v["type"], v["value"]))) for t, v in a.items()) for a in (r.get("aux") for r in rows)]
    places = {x: i for i, x in enumerate(dict.fromkeys(tags))}
    aux = pa.array([x and [(t, {"type": k, "value": v}) for t, k, v in x] for x in places], pa.map_(pa.string(), pa.struct([("type", pa.string()), ("value", pa.string())])))
    columns = [aux.take(pa.array([places[x] for x in tags], pa.int32())) if k == "aux" else pa.array([r.get(k) for r in rows], kinds.get(k, pa.string())) for k in COLUMNS]
    return pa.RecordBatch.from_arrays(columns, names=COLUMNS)


def slices(batch) -> Iterator:
    """A batch in pieces of about TOGETHER bytes."""
    step = max(1, batch.num_rows * TOGETHER // max(batch.nbytes, 1))
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def encode_batch(batch, names: list[str], ids: dict[str, int]) -> bytes:
    """The records of a batch's rows one after another, as encode_record gives them."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from ..functions.kernels import operations

    col = lambda name: column_of(batch, names, name)
    seq, qual = col("seq"), col("qual")
    if not (pc.all(pc.string_is_ascii(seq)).as_py() in (True, None) and pc.all(pc.string_is_ascii(qual)).as_py() in (True, None)):
        rows = [dict(zip(names, x, strict=True)) for x in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        return b"".join(encode_record(r | {"aux": dict(r.get("aux") or ())}, ids) for r in rows)
    number = lambda name: numbers(col(name))
    cigars = col("cigar").fill_null("").dictionary_encode()
    parsed = [operations(c) for c in cigars.dictionary.to_pylist()]
    codes = np.asarray(cigars.indices)
    ops = pa.array([b"".join(struct.pack("<I", n << 4 | OPS.index(o)) for n, o in x) for x in parsed], pa.binary()).take(cigars.indices)
    span = np.array([sum(n for n, o in x if o in "MDN=X") or 1 for x in parsed], np.int64)[codes]
    name = pc.binary_join_element_wise(pc.if_else(pc.fill_null(pc.equal(col("qname"), ""), True), "*", col("qname")).cast(pa.binary()), b"\0", b"")
    bases, at = spread(seq)
    odd = (np.diff(at) & 1).astype(bool)
    nibbles = np.insert(_CODES[bases], at[1:][odd], 0)
    halves = packed_column(nibbles[::2] << 4 | nibbles[1::2], np.concatenate([[0], np.cumsum((np.diff(at) + 1) // 2)]))
    scores, places = spread(qual)
    if (scores < 33).any():
        raise ValueError("qualities begin with '!'")
    none = np.diff(places) == 0
    plain = packed_column(scores - 33, places)
    if none.any():
        unknown = np.concatenate([[0], np.cumsum(np.where(none, np.diff(at), 0))])
        plain = pc.if_else(pa.array(none), packed_column(np.full(unknown[-1], 255, np.uint8), unknown), plain)
    tags, begins = tag_columns(col("aux"), col("aux_order"))
    data, ends = spread(tags)
    tags = packed_column(data, ends[begins])
    pos = number("pos") - 1
    beg = np.maximum(pos, 0)
    bins = np.select([beg >> k == beg + span - 1 >> k for k in (14, 17, 20, 23, 26)], [first + (beg >> k) for k, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1))], 0)
    contig = lambda c: numbers(distinct(col(c), lambda x: ids.get(x, -1), pa.int64()), -1)
    lengths = lambda c: np.diff(spread(c)[1])
    fields = {
        "rid": contig("rname"), "pos": pos, "name": lengths(name), "mapq": numbers(col("mapq"), 255), "bin": np.where(pos >= 0, bins, 4680), "ops": lengths(ops) // 4, "flag": number("flag"),
        "n": np.diff(at), "nid": contig("rnext"), "npos": number("pnext") - 1, "tlen": number("tlen"),
    }
    head = np.zeros(batch.num_rows, np.dtype([("size", "<i4"), *HEAD.descr]))
    fields["size"] = 32 + sum(map(lengths, (name, ops, halves, plain, tags)))
    for k, v in fields.items():
        head[k] = v
        if (head[k] != v).any():
            raise ValueError(f"{k} of a record is too large for BAM")
    fixed = packed_column(head.view(np.uint8), np.arange(batch.num_rows + 1) * head.dtype.itemsize)
    return spread(pc.binary_join_element_wise(fixed, name, ops, halves, plain, tags, b""))[0].tobytes()


def decode_batch(data: bytes, starts: np.ndarray, references: list[tuple[str, int]], rec_idx: np.ndarray):
    """Records that begin at ``starts`` as a batch of SCHEMA's columns, as decode_record gives them."""
    import pyarrow as pa

    raw = np.frombuffer(data, np.uint8)
    head = raw[starts[:, None] + np.arange(4, 36)].view(HEAD)[:, 0]
    ends = starts + 4 + raw[starts[:, None] + np.arange(4)].view("<i4")[:, 0]
    at = starts + 36
    wide = lambda c: head[c].astype(np.int64)
    name, at = gathered(raw, at, wide("name") - 1), at + head["name"]
    ops, at = gathered(raw, at, 4 * wide("ops")), at + 4 * wide("ops")
    n = wide("n")
    half = (n + 1) // 2
    (pairs, places), at = gathered(raw, at, half), at + half
    bases = np.delete(_PAIRS[pairs].reshape(-1), 2 * places[1:][n & 1 == 1] - 1)
    (scores, bounds), tags = gathered(raw, at, n), gathered(raw, at + n, ends - at - n)
    known = n > 0
    known[known] = scores[bounds[:-1][known]] != 255
    scores = scores[np.repeat(known, n)]
    bounds = np.concatenate([[0], np.cumsum(np.where(known, n, 0))])
    if (scores > 94).any():
        qual = pa.array(["".join(chr(q + 33) for q in scores[i:j].tolist()) for i, j in zip(bounds[:-1], bounds[1:], strict=True)], pa.string())
    else:
        qual = packed_column(scores + 33, bounds, True)
    masked = lambda v, gone, kind: pa.array(v, kind, mask=gone)
    contigs = pa.array([x for x, _ in references], pa.string())
    place = lambda c: contigs.take(masked(wide(c), head[c] < 0, pa.int64()))
    cigar = lambda x: "".join(f"{o >> 4}{OPS[o & 15]}" for (o,) in struct.iter_unpack("<I", x)) or "*"
    tags = packed_column(*tags).dictionary_encode()
    lists = [decode_tags(x) for x in tags.dictionary.to_pylist()]
    kind = pa.map_(pa.string(), pa.struct([("type", pa.string()), ("value", pa.string())]))
    aux = pa.array([list({t: {"type": k, "value": v} for t, k, v in x}.items()) for x in lists], kind).take(tags.indices)
    columns = [
        packed_column(*name, True), pa.array(head["flag"].astype(np.int32)), place("rid"), masked(wide("pos") + 1, head["pos"] < 0, pa.int64()), masked(head["mapq"].astype(np.int32), head["mapq"] == 255, pa.int32()),
        distinct(packed_column(*ops), cigar, pa.string()), place("nid"), masked(wide("npos") + 1, head["npos"] < 0, pa.int64()), pa.array(head["tlen"].astype(np.int32)),
        packed_column(bases, np.concatenate([[0], np.cumsum(n)]), True), qual.take(pa.array(np.arange(len(n)), mask=~known)),
        aux, pa.array([[t for t, _, _ in x] for x in lists], pa.list_(pa.string())).take(tags.indices), pa.array(rec_idx, pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=COLUMNS)


class Blocks:
    """Reads data across blocks from a virtual offset."""

    def __init__(self, file, offset: int = 0):
        self.file, self.data, self.at = file, b"", 0
        self.block = self.next = offset >> 16
        self._load()
        self.at = offset & 0xFFFF

    def _load(self) -> bool:
        self.block = self.next
        self.file.seek(self.block)
        head = self.file.read(64)
        size = block_size(head)
        if size is None:
            self.data, self.at = b"", 0
            return False
        self.file.seek(self.block)
        self.data, self.at, self.next = zlib.decompress(self.file.read(size), 31), 0, self.block + size
        return True

    def tell(self) -> int:
        while self.at >= len(self.data):
            if not self._load():
                return self.next << 16
        return self.block << 16 | self.at

    def read(self, n: int) -> bytes:
        out = b""
        while len(out) < n:
            if self.at >= len(self.data) and not self._load():
                break
            part = self.data[self.at : self.at + n - len(out)]
            self.at += len(part)
            out += part
        return out

    def int(self) -> int | None:
        b = self.read(4)
        return struct.unpack("<i", b)[0] if len(b) == 4 else None


def read_header(blocks: Blocks) -> tuple[str, list[tuple[str, int]]]:
    if blocks.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    text = blocks.read(blocks.int()).rstrip(b"\0").decode()
    references = []
    for _ in range(blocks.int()):
        name = blocks.read(blocks.int())[:-1].decode()
        references.append((name, blocks.int()))
    return text, references


def concatenate(files: list) -> Iterator[bytes]:
    """One BAM file of several with the same references, in parts: blocks are copied as they are; only one that a header shares with records is packed anew."""
    first = None
    for file in files:
        blocks = Blocks(file)
        text, references = read_header(blocks)
        if first is None:
            first = references
            head = header_bytes(text, references)
            for i in range(0, len(head), BLOCK):
                yield compress_block(head[i : i + BLOCK])
        elif references != first:
            raise ValueError("files with other references can't be put together")
        rest = blocks.data[blocks.at :]
        if rest:
            yield compress_block(rest)
        at = blocks.next
        file.seek(0, 2)
        size = file.tell()
        while at < size:
            file.seek(at)
            n = block_size(file.read(64))
            if n is None:
                raise ValueError(f"no block at {at}")
            file.seek(at)
            data = file.read(n)
            if data != END:
                yield data
            at += n
    yield END


def split_points(file, every: int = 10_000) -> list[int]:
    """Virtual offsets of each ``every``-th record."""
    blocks = Blocks(file)
    read_header(blocks)
    out, i = [], 0
    while True:
        at = blocks.tell()
        n = blocks.int()
        if n is None:
            return out
        if i % every == 0:
            out.append(at)
        blocks.read(n)
        i += 1


def stretches(file, start: int, stop: int | None) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Whole records from virtual offset ``start`` on, those that begin before ``stop``: (data, where records begin in them, records' virtual offsets)."""
    blocks = Blocks(file, start)
    held, begins, places, more = bytearray(blocks.data[blocks.at :]), [-blocks.at], [blocks.block], True
    while more:
        while more:
            if more := blocks._load():
                begins.append(len(held))
                places.append(blocks.block)
                held += blocks.data
            if len(held) >= TOGETHER or stop is not None and blocks.next << 16 >= stop:
                break
        at, starts = 0, []
        while at + 4 <= len(held) and (end := at + 4 + struct.unpack_from("<i", held, at)[0]) <= len(held):
            starts.append(at)
            at = end
        if starts:
            found = np.array(starts)
            block = np.searchsorted(begins, found, "right") - 1
            offsets = np.array(places)[block] << 16 | found - np.array(begins)[block]
            inside = len(found) if stop is None else int(np.searchsorted(offsets, stop))
            if inside:
                yield bytes(held[:at]), found[:inside], offsets[:inside]
            if inside < len(found):
                return
            del held[:at]
            first = max(i for i, b in enumerate(begins) if b <= at)
            begins, places = [b - at for b in begins[first:]], places[first:]
        if not more and len(held) >= 4 and (stop is None or places[-1] << 16 < stop):
            raise ValueError("the file ends within a record")


def bam_parts(header: str, batches: Iterable, names: list[str], level: int = 6) -> Iterator[bytes]:
    """A whole file of batches' rows in their order, in parts."""
    references = references_of(header)
    ids = {n: i for i, (n, _) in enumerate(references)}
    held = header_bytes(header, references)
    for batch in batches:
        for part in slices(batch):
            held += encode_batch(part, names, ids)
            whole = len(held) // BLOCK * BLOCK
            yield b"".join(compress_block(held[i : i + BLOCK], level) for i in range(0, whole, BLOCK))
            held = held[whole:]
    yield (compress_block(held, level) if held else b"") + END


def write_bam(header: str, rows: Iterable[dict], level: int = 6) -> bytes:
    """A whole file of rows in their order."""
    references = references_of(header)
    ids = {n: i for i, (n, _) in enumerate(references)}
    out, held = [], header_bytes(header, references)
    for r in rows:
        held += encode_record(r, ids)
        while len(held) >= BLOCK:
            out.append(compress_block(held[:BLOCK], level))
            held = held[BLOCK:]
    if held:
        out.append(compress_block(held, level))
    return b"".join([*out, END])


def plausible(data: bytes, at: int, n_references: int) -> int | None:
    """Where the next record would begin if one began at ``at``; None if none can begin there, -1 if the data end before that shows."""
    if at + 36 > len(data):
        return -1
    size, rid, pos, ln, _, _, n_ops, _, n, nid, npos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    if not (32 <= size < 1 << 28 and -1 <= rid < n_references and -1 <= nid < n_references and pos >= -1 and npos >= -1 and ln and 0 <= n and 32 + ln + 4 * n_ops + (n + 1) // 2 + n <= size):
        return None
    name = data[at + 36 : at + 36 + ln]
    if len(name) == ln and (name[-1] or not all(33 <= c <= 126 for c in name[:-1])):
        return None
    return at + 4 + size


def first_record(file, start: int, follows, chain: int = 4, most: int = 1 << 26) -> int | None:
    """The virtual offset of the first record that begins in a block from byte ``start`` on.

    ``follows(data, at)``: as plausible. A place counts if records can follow one another from there, ``chain`` of them
    or up to the end.
    """
    from .bgzf import BgzfReader

    file.seek(0, 2)
    n = file.tell()
    at = BgzfReader._first(file, start, n)
    data, places = b"", []  # (where a block's data begin, the block)
    scanned = 0
    while at < n and len(data) < most:
        want = len(data) + (1 << 18)
        while at < n and len(data) < want:
            file.seek(at)
            size = block_size(file.read(64))
            if size is None:
                raise ValueError(f"no block at {at}")
            file.seek(at)
            places.append((len(data), at))
            data += zlib.decompress(file.read(size), 31)
            at += size
        while scanned < len(data):
            here, steps = scanned, 0
            while here is not None and 0 <= here < len(data) and steps < chain:
                here, steps = follows(data, here), steps + 1
            if here is None or here < 0 and at < n and steps < 2:
                if here is not None:
                    break  # more data are needed to tell
                scanned += 1
                continue
            inside, block = next((p, b) for p, b in reversed(places) if p <= scanned)
            return block << 16 | scanned - inside
    return None


class Part(InputPartition):
    def __init__(self, path: str, start: int | None, stop: int | None):
        self.path, self.start, self.stop = path, start, stop


class BamReader(Indexed, DataSourceReader):
    """Option ``region`` (contig:from-to): only the chunks that a file's index names are read, one task each; likewise for filters on rname and pos with ``pushdown`` (see Pushing). ``splitBytes``: the size of byte ranges."""

    place = ("rname", "pos")

    def __init__(self, options: dict):
        self.path, self.region = options["path"], options.get("region")
        self.size = int(options.get("splitbytes", 32 << 20))

    def partitions(self):
        from pyarrow import fs

        system, _ = open_path(self.path)
        out = []
        for p in listed(self.path, (".bam",)):
            if self.region:
                out += self._chunks(system, p)
            elif self.pushed and (chunks := self._pushed(system, p)) is not None:
                out += [Part(p, lo, hi) for lo, hi in chunks]
            elif system.get_file_info(f"{p}.splits").type == fs.FileType.File:
                with system.open_input_file(f"{p}.splits") as f:
                    points = json.loads(f.read())
                out += [Part(p, a, b) for a, b in zip(points, [*points[1:], None], strict=True)]
            else:
                n = system.get_file_info(p).size
                out += [ByteRange(p, i, min(i + self.size, n)) for i in range(0, max(n, 1), self.size)]
        return out

    def _pushed(self, system, path: str) -> list[tuple[int, int]] | None:
        with system.open_input_file(path) as f:
            names = [n for n, _ in read_header(Blocks(f))[1]]
        return self.chunks(system, path, names, self.size)

    def _chunks(self, system, path: str) -> list[Part]:
        from pyarrow import fs

        from ..operators.intervals import parse_region
        from .index import candidates, read_index

        with system.open_input_file(path) as f:
            _, references = read_header(Blocks(f))
        names = [n for n, _ in references]
        region = parse_region(self.region, names.__contains__)
        found = next((c for c in candidates(path) if system.get_file_info(c).type == fs.FileType.File), None)
        if found is None:
            return [Part(path, None, None)]
        with system.open_input_file(found) as f:
            index = read_index(f.read())
        return [Part(path, lo, hi) for lo, hi in index.chunks(names.index(region.contig), region.beg, region.stop)]

    def _inside(self, row: tuple) -> bool:
        from ..functions.kernels import operations
        from ..operators.intervals import parse_region

        if not self.region:
            return True
        if not hasattr(self, "_region"):
            self._region = parse_region(self.region)
        if row[2] != self._region.contig or row[3] is None:
            return False
        span = sum(n for n, o in operations(row[5]) if o in "MDN=X")
        return row[3] - 1 < self._region.stop and row[3] - 1 + max(span, 1) > self._region.beg

    def read(self, partition) -> Iterator:
        if partition is None:  # nothing to read
            return
        system, _ = open_path(self.path)
        with system.open_input_file(partition.path) as f:
            blocks = Blocks(f)
            _, references = read_header(blocks)
            start, stop = partition.start, partition.stop
            if isinstance(partition, ByteRange):
                stop <<= 16
                start = first_record(f, start, lambda data, at: plausible(data, at, len(references))) if start else blocks.tell()
                if start is None:
                    return
            for data, starts, offsets in stretches(f, blocks.tell() if start is None else start, stop):
                batch = decode_batch(data, starts, references, offsets)
                if self.region:
                    import pyarrow as pa

                    batch = batch.filter(pa.array([self._inside((None, None, r, p, None, c)) for r, p, c in zip(*(batch.column(k).to_pylist() for k in ("rname", "pos", "cigar")), strict=True)], pa.bool_()))
                yield batch


class PushedBamReader(Pushing, BamReader):
    pass


class BamSource(DataSource):
    """spark.dataSource.register(BamSource); read.format("bam").load(path); write.format("bam").option("header", text).mode("append").save(folder)"""

    @classmethod
    def name(cls):
        return "bam"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        options = {k.lower(): v for k, v in self.options.items()}
        return (PushedBamReader if flag(options, "pushdown") else BamReader)(options)

    def writer(self, schema, overwrite):
        names, header = schema.fieldNames(), self.options["header"]
        return BatchFolderWriter(self.options["path"], "bam", lambda batches: bam_parts(header, batches, names))
