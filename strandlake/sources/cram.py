"""CRAM 3: a codec, an index, a source and a sink.

A file is a row of containers that can be skipped by their headers, so containers are what tasks share out. A
container's records lie column by column (data series) in blocks; a compression header says how each series is
coded. The writer stores bases as they are and needs no reference; the reader also takes files whose bases are
differences from one (option ``reference``: a FASTA file).
"""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .bam import COLUMNS, SCHEMA, batch_of, column_of, decode_tags, distinct, gathered, numbers, packed_column, references_of, spread, tag_columns
from .files import BatchFolderWriter, listed, open_path

#: The container that ends a file, content types of blocks, and ids of encodings. Fixed values.
END = bytes.fromhex("0f000000ffffffff0fe0454f4600000000010005bdd94f0001000606010001000100ee63014b")
FILE_HEADER, COMPRESSION, SLICE, EXTERNAL_DATA, CORE = 0, 1, 2, 4, 5
EXTERNAL, HUFFMAN, ARRAY_LEN, ARRAY_STOP, BETA, SUBEXP, GAMMA = 1, 3, 4, 5, 6, 7, 9
#: Bits of a record's CRAM flags. Fixed values.
QUALITIES, DETACHED, DOWNSTREAM, NO_BASES = 1, 2, 4, 8
#: Series of integers, of single bytes and of byte arrays that the writer uses; a series' place is its block's id. Fixed values.
NUMBERS = ("BF", "CF", "RI", "RL", "AP", "RG", "MF", "NS", "NP", "TS", "TL", "FN", "FP", "DL", "RS", "PD", "HC", "MQ")
BYTES, ARRAYS = ("FC", "QS", "BA"), ("BB", "IN", "SC")
#: Qualities as text, by value.
SCORES = [chr(33 + q) for q in range(256)]
#: Records of a container.
RECORDS = 10_000


def itf8(n: int) -> bytes:
    """Up to 32 bits: the first byte's leading ones say how many bytes follow; a fifth byte holds four bits."""
    n &= 0xFFFFFFFF
    for more, bits in enumerate((7, 14, 21, 28)):
        if n < 1 << bits:
            return ((0xFF00 >> more & 0xFF) << 8 * more | n).to_bytes(more + 1, "big")
    return bytes((0xF0 | n >> 28, n >> 20 & 255, n >> 12 & 255, n >> 4 & 255, n & 15))


def itf8s(values) -> bytes:
    """As itf8, of many numbers one after another."""
    found, places = np.unique(np.asarray(values, np.int64), return_inverse=True)
    each = [itf8(n) for n in found.tolist()]
    sizes = np.array([len(x) for x in each], np.int64)
    data, begins = np.frombuffer(b"".join(each), np.uint8), np.cumsum(sizes) - sizes
    return gathered(data, begins[places], sizes[places])[0].tobytes() if len(places) else b""


def ltf8(n: int) -> bytes:
    """Up to 64 bits likewise, with up to eight bytes that follow."""
    n &= 2**64 - 1
    for more in range(8):
        if n < 1 << 7 * (more + 1):
            return ((0xFF00 >> more & 0xFF) << 8 * more | n).to_bytes(more + 1, "big")
    return b"\xff" + n.to_bytes(8, "big")


class Cursor:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        self.at += n
        if self.at > len(self.data):
            raise ValueError("the data end too early")
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise ValueError("the data end too early")
        self.at += 1
        return self.data[self.at - 1]

    def int32(self) -> int:
        return struct.unpack("<i", self.take(4))[0]

    def itf8(self) -> int:
        data, at = self.data, self.at
        try:
            first = data[at]
            if first < 0x80:
                self.at = at + 1
                return first
            if first < 0xC0:
                self.at = at + 2
                return (first & 0x3F) << 8 | data[at + 1]
            if first < 0xE0:
                self.at = at + 3
                return (first & 0x1F) << 16 | data[at + 1] << 8 | data[at + 2]
            if first < 0xF0:
                self.at = at + 4
                return (first & 15) << 24 | data[at + 1] << 16 | data[at + 2] << 8 | data[at + 3]
            self.at = at + 5
            n = (first & 15) << 28 | data[at + 1] << 20 | data[at + 2] << 12 | data[at + 3] << 4 | data[at + 4] & 15
        except IndexError:
            raise ValueError("the data end too early") from None
        return n - (1 << 32) if n >= 1 << 31 else n

    def ltf8(self) -> int:
        first = self.byte()
        more = next(k for k in range(9) if k == 8 or not first & 0x80 >> k)
        n = int.from_bytes(bytes((first & 0x7F >> more if more < 8 else 0,)) + self.take(more), "big")
        return n - (1 << 64) if n >= 1 << 63 else n

    def array(self) -> list[int]:
        return [self.itf8() for _ in range(self.itf8())]


def rans(data: bytes) -> bytes:
    """Unpacks four interleaved range-coded streams of bytes, with frequencies that sum up to 4096, alone or by the byte before."""
    c = Cursor(data)
    order, _, n = c.byte(), c.int32(), c.int32()

    def symbols(read: Callable[[], object]) -> dict[int, object]:
        """Ascending symbols with what belongs to each; after a neighbour a count of further neighbours follows."""
        out, s, run = {}, c.byte(), 0
        while True:
            out[s] = read()
            if run:
                run, s = run - 1, s + 1
                continue
            t = c.byte()
            if t == 0:
                return out
            run = c.byte() if t == s + 1 else 0
            s = t

    def frequency() -> int:
        f = c.byte()
        return f if f < 128 else (f & 127) << 8 | c.byte()

    def table() -> tuple[dict, list]:
        found, start, places = symbols(frequency), 0, []
        spans = {}
        for s, f in found.items():
            f = f or 4096
            spans[s] = (f, start)
            places += [s] * f
            start += f
        return spans, places + [0] * (4096 - len(places))

    tables = {0: table()} if order == 0 else symbols(table)
    state = [c.int32() & 0xFFFFFFFF for _ in range(4)]
    out, quarter = bytearray(n), n // 4
    last = [0] * 4

    def step(k: int) -> int:
        spans, places = tables[last[k] if order else 0]
        x = state[k]
        s = places[x & 4095]
        f, start = spans[s]
        x = f * (x >> 12) + (x & 4095) - start
        while x < 1 << 23 and c.at < len(data):
            x = x << 8 | c.byte()
        state[k], last[k] = x, s
        return s

    if order == 0:
        for i in range(n):
            out[i] = step(i & 3)
    else:
        for i in range(quarter):
            for k in range(4):
                out[k * quarter + i] = step(k)
        for i in range(4 * quarter, n):
            out[i] = step(3)
    return bytes(out)


def block(kind: int, ident: int, data: bytes, packed: bool = True) -> bytes:
    body = gzip.compress(data, 6, mtime=0) if packed and len(data) > 32 else data
    method = int(body is not data)
    out = bytes((method, kind)) + itf8(ident) + itf8(len(body)) + itf8(len(data)) + body
    return out + struct.pack("<I", zlib.crc32(out))


def read_block(c: Cursor) -> tuple[int, int, bytes]:
    """(content type, id, data)."""
    start = c.at
    method, kind = c.byte(), c.byte()
    ident, size, raw = c.itf8(), c.itf8(), c.itf8()
    body = c.take(size)
    check = zlib.crc32(c.data[start : c.at])
    if struct.unpack("<I", c.take(4))[0] != check:
        raise ValueError("a block isn't what its checksum says")
    unpack = {0: bytes, 1: lambda b: zlib.decompress(b, 31), 2: bz2.decompress, 3: lzma.decompress, 4: rans}.get(method)
    if unpack is None:
        raise ValueError(f"blocks packed by method {method} can't be read")
    data = unpack(body)
    if len(data) != raw:
        raise ValueError("a block isn't as long as it says")
    return kind, ident, data


def container(contig: int, start: int, span: int, n: int, counter: int, bases: int, blocks: list[bytes], landmarks: list[int]) -> bytes:
    data = b"".join(blocks)
    head = struct.pack("<i", len(data)) + itf8(contig) + itf8(start) + itf8(span) + itf8(n) + ltf8(counter) + ltf8(bases) + itf8(len(blocks)) + itf8(len(landmarks)) + b"".join(map(itf8, landmarks))
    return head + struct.pack("<I", zlib.crc32(head)) + data


class Container:
    """A container's header; its blocks are at ``data`` to ``end`` of the file."""

    def __init__(self, file, at: int):
        file.seek(at)
        c = Cursor(file.read(4096))
        self.at, size = at, c.int32()
        self.contig, self.start, self.span, self.n, self.counter, self.bases, self.n_blocks = c.itf8(), c.itf8(), c.itf8(), c.itf8(), c.ltf8(), c.ltf8(), c.itf8()
        n = c.itf8()
        if c.at + 5 * n + 4 > 4096:
            file.seek(at)
            c = Cursor(file.read(4096 + 5 * n), c.at)
        self.landmarks = [c.itf8() for _ in range(n)]
        self.data = at + c.at + 4
        self.end = self.data + size


def containers(file, size: int) -> Iterator[Container]:
    """The data containers of a file."""
    file.seek(0)
    if file.read(5) != b"CRAM\x03":
        raise ValueError("not a CRAM 3 file")
    at, first = 26, True
    while at < size:
        c = Container(file, at)
        if not first and c.n:
            yield c
        at, first = c.end, False


def read_header(file) -> str:
    c = Container(file, 26)
    file.seek(c.data)
    _, _, data = read_block(Cursor(file.read(c.end - c.data)))
    return data[4 : 4 + struct.unpack_from("<i", data)[0]].decode()


class Bits:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def bit(self) -> int:
        out = self.data[self.at >> 3] >> 7 - (self.at & 7) & 1
        self.at += 1
        return out

    def bits(self, n: int) -> int:
        out = 0
        for _ in range(n):
            out = out << 1 | self.bit()
        return out


def codes(values: list[int], lengths: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) -> value of a canonical prefix code: by length, then by value."""
    out, code, last = {}, 0, 0
    for n, v in sorted(zip(lengths, values, strict=True)):
        code <<= n - last
        out[n, code] = v
        code, last = code + 1, n
    return out


class Series:
    """How the values of a slice are read: ``number``, ``byte`` and ``array`` of a decoded encoding."""

    def __init__(self, core: bytes, external: dict[int, bytes]):
        self.core = Bits(core)
        self.external = {k: Cursor(v) for k, v in external.items()}

    def reader(self, kind: int, p: Cursor, as_byte: bool = False) -> Callable[[], object]:
        if kind == EXTERNAL:
            c = self.external.get(p.itf8(), Cursor(b""))
            return c.byte if as_byte else c.itf8
        if kind == HUFFMAN:
            table = codes(p.array(), p.array())
            if len(table) == 1 and (0, 0) in table:
                only = table[0, 0]
                return lambda: only

            def walk() -> int:
                n = code = 0
                while (n, code) not in table:
                    n, code = n + 1, code << 1 | self.core.bit()
                return table[n, code]

            return walk
        if kind == BETA:
            offset, n = p.itf8(), p.itf8()
            return lambda: self.core.bits(n) - offset
        if kind == GAMMA:
            offset = p.itf8()

            def gamma() -> int:
                n = 0
                while not self.core.bit():
                    n += 1
                return (1 << n | self.core.bits(n)) - offset

            return gamma
        if kind == SUBEXP:
            offset, k = p.itf8(), p.itf8()

            def subexp() -> int:
                n = 0
                while self.core.bit():
                    n += 1
                return (self.core.bits(k) if not n else 1 << n + k - 1 | self.core.bits(n + k - 1)) - offset

            return subexp
        if kind == ARRAY_LEN:
            size, run = self.encoding(p), self.run(p.itf8(), Cursor(p.take(p.itf8())))
            return lambda: run(size())
        if kind == ARRAY_STOP:
            stop = p.byte()
            c = self.external.get(p.itf8(), Cursor(b""))

            def until() -> bytes:
                end = c.data.index(stop, c.at)
                out = c.data[c.at : end]
                c.at = end + 1
                return out

            return until
        raise ValueError(f"encoding {kind} isn't known")

    def encoding(self, p: Cursor, as_byte: bool = False) -> Callable[[], object]:
        kind = p.itf8()
        return self.reader(kind, Cursor(p.take(p.itf8())), as_byte)

    def run(self, kind: int, p: Cursor) -> Callable[[int], bytes]:
        """Reads so many single bytes."""
        if kind == EXTERNAL:
            return self.external.get(p.itf8(), Cursor(b"")).take
        item = self.reader(kind, p, True)
        return lambda n: bytes(item() for _ in range(n))


class Header:
    """A compression header: what is preserved, the substitution matrix, lists of tags, encodings by series and by tag."""

    def __init__(self, data: bytes):
        c = Cursor(data)
        c.itf8()
        self.names, self.deltas, self.reference, self.matrix, self.tags = True, True, True, bytes(5), [[]]
        for _ in range(c.itf8()):
            key = c.take(2)
            if key == b"SM":
                self.matrix = c.take(5)
            elif key == b"TD":
                self.tags = [[x[i : i + 3].decode() for i in range(0, len(x), 3)] for x in c.take(c.itf8()).split(b"\0")[:-1]]
            else:
                value = bool(c.byte())
                if key == b"RN":
                    self.names = value
                elif key == b"AP":
                    self.deltas = value
                elif key == b"RR":
                    self.reference = value
        self.series, self.tag_series = {}, {}
        for table, name in ((self.series, lambda: c.take(2).decode()), (self.tag_series, lambda: c.itf8().to_bytes(3, "big").decode())):
            c.itf8()
            for _ in range(c.itf8()):
                key, kind = name(), c.itf8()
                table[key] = (kind, c.take(c.itf8()))

    def substitutes(self) -> dict[str, str]:
        """Reference base -> the bases that codes 0 to 3 stand for."""
        out = {}
        for r, b in zip("ACGTN", self.matrix, strict=True):
            others = [x for x in "ACGTN" if x != r]
            out[r] = "".join(sorted(others, key=lambda x, b=b, others=others: b >> 6 - 2 * others.index(x) & 3))
        return out


@lru_cache(maxsize=1 << 16)
def _features(cigar: str, unknown: bool) -> tuple[dict[str, bytes], dict[str, list[tuple[int, int]]]]:
    """(what a mapped read's CIGAR adds to each series, the stretches of its bases that each array takes)."""
    from ..functions.kernels import operations

    added: dict[str, list[int]] = {k: [] for k in ("FC", "FP", "FN", "DL", "RS", "PD", "HC", *(f"{k} size" for k in ARRAYS))}
    parts: dict[str, list[tuple[int, int]]] = {k: [] for k in ARRAYS}
    at, last = 0, 0
    for n, o in operations(cigar):
        array = {"M": "BB", "=": "BB", "X": "BB", "I": "IN", "S": "SC"}.get(o)
        if array == "BB" and unknown:  # a match needs no feature
            at += n
            continue
        added["FC"].append(ord("b" if array == "BB" else o))
        added["FP"].append(at + 1 - last)
        last = at + 1
        if array:
            parts[array].append((at, n))
            added[f"{array} size"].append(n)
            at += n
        else:
            added[{"D": "DL", "N": "RS", "P": "PD", "H": "HC"}[o]].append(n)
    added["FN"].append(len(added["FC"]))
    return {k: bytes(v) if k == "FC" else b"".join(map(itf8, v)) for k, v in added.items()}, parts


def encode_container(batch, names: list[str], ids: dict[str, int], counter: int) -> bytes:
    """A container of one slice, of a batch's rows."""
    import pyarrow as pa
    import pyarrow.compute as pc

    from ..functions.kernels import operations

    col = lambda name: column_of(batch, names, name)
    flag, pos = numbers(col("flag")), numbers(col("pos"))
    cigars = col("cigar").fill_null("").dictionary_encode()
    kinds, which = cigars.dictionary.to_pylist(), np.asarray(cigars.indices)
    length = lambda ops: np.array([sum(n for n, o in operations(c) if o in ops) for c in kinds], np.int64)[which]
    seq, at = spread(col("seq"))
    given = np.diff(at)
    size = np.where(given > 0, given, length("MIS=X"))
    unknown = (size > 0) & (given == 0)
    contig = numbers(distinct(col("rname"), lambda x: ids[x] if x else -1, pa.int64()), -1)
    contigs = set(contig.tolist())
    low, high = int(pos.min()), int((pos + np.maximum(length("MDN=X"), 1) - 1).max())
    bases = int(size.sum())
    scores, scored = spread(col("qual"))
    if (scores < 33).any():
        raise ValueError("qualities begin with '!'")
    encoded, begins = tag_columns(col("aux"), col("aux_order"))
    tag_names = pc.binary_slice(encoded, 0, 3)
    text, ends = spread(tag_names)
    lines = packed_column(text, ends[begins]).dictionary_encode()
    fixed = {
        "BF": flag, "CF": DETACHED | NO_BASES * unknown | QUALITIES * (np.diff(scored) > 0), "RI": contig, "RL": size, "AP": pos, "RG": np.full(len(flag), -1), "MF": np.zeros(len(flag)),
        "NS": numbers(distinct(col("rnext"), lambda x: ids.get(x, -1), pa.int64()), -1), "NP": numbers(col("pnext")), "TS": numbers(col("tlen")), "TL": np.asarray(lines.indices),
    }
    content = {k: itf8s(v) for k, v in fixed.items()}
    # Mapped reads: what their CIGARs add, and bases in stretches; those of reads without bases are N.
    mapped = flag & 4 == 0
    content["BA"] = gathered(seq, at[:-1][~mapped], given[~mapped])[0].tobytes()
    content["MQ"] = itf8s(numbers(col("mapq"), 255)[mapped])
    each, used = np.unique(2 * which[mapped] + unknown[mapped], return_inverse=True)
    features = [_features(kinds[k >> 1], bool(k & 1)) for k in each.tolist()]
    for k in features[0][0] if features else ():
        content[k] = spread(pa.array([f[0][k] for f in features], pa.binary()).take(pa.array(used)))[0].tobytes()
    source = np.concatenate([seq, np.full(size[unknown].max(initial=0), ord("N"), np.uint8)])
    first, room = np.where(unknown, len(seq), at[:-1])[mapped], size[mapped]
    for k in ARRAYS:
        counts = np.array([len(f[1][k]) for f in features], np.int64)
        spans = np.array([x for f in features for x in f[1][k]], np.int64).reshape(-1, 2)
        picked, of = gathered(np.arange(len(spans)), (np.cumsum(counts) - counts)[used], counts[used])[0], np.repeat(np.arange(len(used)), counts[used])
        begin = np.minimum(spans[picked, 0], room[of])
        content[k] = gathered(source, first[of] + begin, np.minimum(spans[picked, 1], room[of] - begin))[0].tobytes()
    content["QS"] = (scores - 33).tobytes()
    content["RN"] = spread(pc.binary_join_element_wise(pc.if_else(pc.fill_null(pc.equal(col("qname"), ""), True), "*", col("qname")).cast(pa.binary()), b"\0", b""))[0].tobytes()
    tags = {}
    for name in tag_names.unique().to_pylist():
        data, ends = spread(encoded.filter(pc.equal(tag_names, name)))
        values, stops = gathered(data, ends[:-1] + 3, np.diff(ends) - 3)
        tags[name.decode()] = itf8s(np.diff(stops)), values.tobytes()
    one = next(iter(contigs)) if len(contigs) == 1 else -2
    start, span = (low, high - low + 1) if one >= 0 else (0, 0)

    def coded(kind: int, params: bytes) -> bytes:
        return itf8(kind) + itf8(len(params)) + params

    places = {k: i for i, k in enumerate((*NUMBERS, *BYTES, *ARRAYS, *(f"{k} size" for k in ARRAYS), "RN"), 1)}
    outside = lambda k: coded(EXTERNAL, itf8(places[k]))
    series = [(k, outside(k)) for k in (*NUMBERS, *BYTES)] + [(k, coded(ARRAY_LEN, outside(f"{k} size") + outside(k))) for k in ARRAYS] + [("RN", coded(ARRAY_STOP, b"\0" + itf8(places["RN"])))]
    tag_places = {t: (1000 + 2 * i, 1001 + 2 * i) for i, t in enumerate(sorted(tags))}
    dictionary = b"".join(x + b"\0" for x in lines.dictionary.to_pylist())
    kept = itf8(5) + b"RN\x01AP\x00RR\x00SM" + bytes([0b00011011] * 5) + b"TD" + itf8(len(dictionary)) + dictionary
    encodings = itf8(len(series)) + b"".join(k.encode() + e for k, e in series)
    tag_encodings = itf8(len(tag_places)) + b"".join(itf8(int.from_bytes(t.encode(), "big")) + coded(ARRAY_LEN, coded(EXTERNAL, itf8(a)) + coded(EXTERNAL, itf8(b))) for t, (a, b) in tag_places.items())
    head = block(COMPRESSION, 0, b"".join(itf8(len(x)) + x for x in (kept, encodings, tag_encodings)))
    content = {i: content[k] for k, i in places.items() if k in content} | {i: x for t, pair in tag_places.items() for i, x in zip(pair, tags[t], strict=True)}
    content = {k: v for k, v in content.items() if v}
    blocks = [block(CORE, 0, b"", False), *(block(EXTERNAL_DATA, k, v) for k, v in content.items())]
    slice_head = itf8(one) + itf8(start) + itf8(span) + itf8(batch.num_rows) + ltf8(counter) + itf8(len(blocks)) + itf8(len(content)) + b"".join(map(itf8, content)) + itf8(-1) + bytes(16)
    return container(one, start, span, batch.num_rows, counter, bases, [head, block(SLICE, 0, slice_head, False), *blocks], [len(head)])


def cram_batches(header: str, batches: Iterable, names: list[str]) -> Iterator[bytes]:
    """A file in parts, of Arrow batches."""
    import pyarrow as pa

    ids = {n: i for i, (n, _) in enumerate(references_of(header))}
    text = header.encode()
    yield b"CRAM\x03\x00" + bytes(20) + container(0, 0, 0, 0, 0, 0, [block(FILE_HEADER, 0, struct.pack("<i", len(text)) + text)], [0])
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        while sum(b.num_rows for b in held) >= RECORDS:
            table = pa.Table.from_batches(held)
            yield encode_container(table.slice(0, RECORDS).combine_chunks().to_batches()[0], names, ids, n)
            held, n = table.slice(RECORDS).to_batches(), n + RECORDS
    if sum(b.num_rows for b in held):
        yield encode_container(pa.Table.from_batches(held).combine_chunks().to_batches()[0], names, ids, n)
    yield END


def cram_parts(header: str, rows: Iterable[dict]) -> Iterator[bytes]:
    """Likewise, of rows."""
    from itertools import batched

    return cram_batches(header, (batch_of(x) for x in batched(rows, RECORDS)), COLUMNS[:-1])


def decode_container(data: bytes, header: str, bases_of: Callable[[str, int, int], str] | None = None) -> Iterator[tuple]:
    """Rows as BAM's of a container's blocks. ``bases_of(contig, beg, stop)``: the reference, where records need it."""
    references = [n for n, _ in references_of(header)]
    groups = [dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x).get("ID") for line in header.splitlines() if line.startswith("@RG\t")]
    c = Cursor(data)
    kind, _, content = read_block(c)
    if kind != COMPRESSION:
        raise ValueError("a container without a compression header")
    head = Header(content)
    while c.at < len(data):
        kind, _, content = read_block(c)
        if kind != SLICE:
            raise ValueError("a slice without a header")
        s = Cursor(content)
        contig, _, _, n, _, n_blocks = s.itf8(), s.itf8(), s.itf8(), s.itf8(), s.ltf8(), s.itf8()
        start = Cursor(content)
        start.itf8()
        position = start.itf8()
        core, external = b"", {}
        for _ in range(n_blocks):
            kind, ident, body = read_block(c)
            if kind == CORE:
                core = body
            else:
                external[ident] = body
        yield from _slice(head, Series(core, external), contig, position, n, references, groups, bases_of)


def _slice(head: Header, values: Series, contig: int, position: int, n: int, references: list[str], groups: list, bases_of) -> Iterator[tuple]:
    def missing() -> None:
        raise ValueError("a series without an encoding")

    single = {"FC", "BS", "BA", "QS"}
    get = defaultdict(lambda: missing, {k: values.reader(kind, Cursor(p), k in single) for k, (kind, p) in head.series.items()})
    runs = defaultdict(lambda: lambda n: missing(), {k: values.run(*head.series[k][:1], Cursor(head.series[k][1])) for k in ("BA", "QS") if k in head.series})
    tag = {k: values.reader(kind, Cursor(p)) for k, (kind, p) in head.tag_series.items()}
    swaps, decoded = head.substitutes(), lru_cache(maxsize=1 << 16)(decode_tags)
    rows: list[dict] = []
    for _ in range(n):
        flag, own = get["BF"](), get["CF"]()
        r = {"flag": flag, "contig": get["RI"]() if contig == -2 else contig, "size": get["RL"](), "next": None, "nc": -1, "np": 0, "tlen": 0, "detached": bool(own & DETACHED)}
        step = get["AP"]()
        position = position + step if head.deltas else step
        r["pos"] = position
        group = get["RG"]()
        r["name"] = get["RN"]().decode() if head.names else None
        if own & DETACHED:
            mate = get["MF"]()
            r["flag"] |= (mate & 1) << 5 | (mate & 2) << 2
            if not head.names:
                r["name"] = get["RN"]().decode()
            r["nc"], r["np"], r["tlen"] = get["NS"](), get["NP"](), get["TS"]()
        elif own & DOWNSTREAM:
            r["next"] = len(rows) + get["NF"]() + 1
        r["tags"] = [x for t in head.tags[get["TL"]()] for x in decoded(t.encode() + tag[t]())]
        if group >= 0:
            r["tags"].append(("RG", "Z", groups[group]))
        if flag & 4:
            r["cigar"], r["mapq"] = "*", 0
            r["seq"] = "" if own & NO_BASES else runs["BA"](r["size"]).decode()
            quality = bytearray(b"\xff" * r["size"])
        else:
            quality = bytearray(b"\xff" * r["size"])
            features, at = [], 0
            for _ in range(get["FN"]()):
                code = chr(get["FC"]())
                at += get["FP"]()
                if code in "BXi":
                    value = get["BS"]() if code == "X" else bytes((get["BA"](),))
                    if code == "B":
                        quality[at - 1] = get["QS"]()
                elif code in "bSIq":
                    value = get[{"b": "BB", "S": "SC", "I": "IN", "q": "QQ"}[code]]()
                elif code == "Q":
                    value = quality[at - 1] = get["QS"]()
                else:
                    value = get[{"D": "DL", "N": "RS", "P": "PD", "H": "HC"}[code]]()
                if code == "q":
                    quality[at - 1 : at - 1 + len(value)] = value
                elif code != "Q":
                    features.append((at, code, value))
            r["mapq"] = get["MQ"]()
            r["cigar"], r["seq"] = _placed(r, features, references, swaps, bases_of, bool(own & NO_BASES))
        if own & QUALITIES:
            quality = runs["QS"](r["size"])
        r["qual"] = None if not r["seq"] or not quality or quality[0] == 255 else "".join(map(SCORES.__getitem__, quality))
        rows.append(r)
    _join_mates(rows)
    name = lambda i: references[i] if i is not None and i >= 0 else None
    for i, r in enumerate(rows):
        mapq = None if r["mapq"] == 255 else r["mapq"]
        yield (
            r["name"] if r["name"] is not None else f"r{i}", r["flag"], name(r["contig"]), r["pos"] or None, mapq, r["cigar"], name(r["nc"]), r["np"] or None, r["tlen"], r["seq"], r["qual"],
            {t: (k, v) for t, k, v in r["tags"]}, [t for t, _, _ in r["tags"]],
        )


def _placed(r: dict, features: list[tuple], references: list[str], swaps: dict[str, str], bases_of, unknown: bool) -> tuple[str, str]:
    """(CIGAR, bases) from features: what lies between them matches the reference."""
    ops: list[list] = []
    seq, at, ref = [], 1, r["pos"] - 1

    def add(n: int, op: str) -> None:
        if n and ops and ops[-1][1] == op:
            ops[-1][0] += n
        elif n:
            ops.append([n, op])

    def matches(n: int) -> str:
        if unknown or n <= 0:
            return "N" * max(n, 0)
        if bases_of is None:
            raise ValueError("these records need a reference (option reference)")
        return bases_of(references[r["contig"]], ref, ref + n)

    for place, code, value in [*features, (r["size"] + 1, None, None)]:
        n = place - at
        seq.append(matches(n))
        add(n, "M")
        at, ref = at + max(n, 0), ref + max(n, 0)
        if code == "X":
            base = matches(1).upper()
            seq.append(swaps.get(base, swaps["N"])[value])
            add(1, "M")
            at, ref = at + 1, ref + 1
        elif code in ("b", "B"):
            seq.append(value.decode())
            add(len(value), "M")
            at, ref = at + len(value), ref + len(value)
        elif code in ("I", "i", "S"):
            seq.append(value.decode())
            add(len(value), "S" if code == "S" else "I")
            at += len(value)
        elif code:
            add(value, code)
            ref += value * (code in "DN")
    r["end"] = ref
    return "".join(f"{n}{o}" for n, o in ops) or "*", "" if unknown else "".join(seq)


def _join_mates(rows: list[dict]) -> None:
    """Records of one template in a slice say where the next one is: their mates' places, strands and the template's length follow."""
    seen: set[int] = set()
    for i in range(len(rows)):
        if i in seen or rows[i]["next"] is None:
            continue
        chain = [i]
        while (k := rows[chain[-1]]["next"]) is not None:
            chain.append(k)
        seen |= set(chain)
        mapped = [k for k in chain if not rows[k]["flag"] & 4]
        same = len({rows[k]["contig"] for k in chain}) == 1 and len(mapped) == len(chain)
        low = min((rows[k]["pos"] for k in mapped), default=0)
        length = max((rows[k]["end"] for k in mapped), default=0) - low + 1
        left = min((k for k in mapped if rows[k]["pos"] == low), default=None)
        for k, mate in zip(chain, [*chain[1:], chain[0]], strict=True):
            r, m = rows[k], rows[mate]
            r["nc"], r["np"] = m["contig"], m["pos"]
            r["flag"] |= (m["flag"] & 16) << 1 | (m["flag"] & 4) << 1
            r["tlen"] = 0 if not same else length if k == left else -length
            if r["name"] is None:
                r["name"] = rows[chain[0]]["name"]


def crai(file, size: int) -> list[tuple[int, int, int, int, int, int]]:
    """(contig, start, span, container, slice's place in it, slice's size) of each slice and contig; positions from 1."""
    header = read_header(file)
    names = {n: i for i, (n, _) in enumerate(references_of(header))}
    out = []
    for c in containers(file, size):
        ends = [*c.landmarks[1:], c.end - c.data]
        if c.contig >= -1:
            out += [(c.contig, c.start, c.span, c.at, a, b - a) for a, b in zip(c.landmarks, ends, strict=True)]
            continue
        file.seek(c.data)
        from ..functions.kernels import operations

        found: dict[int, tuple[int, int]] = {}
        for row in decode_container(file.read(c.end - c.data), header, lambda contig, beg, stop: "N" * (stop - beg)):
            k, pos = names.get(row[2], -1), row[3] or 0
            stop = pos + max(1, sum(n for n, o in operations(row[5]) if o in "MDN=X"))
            lo, hi = found.get(k, (pos, stop))
            found[k] = min(lo, pos), max(hi, stop)
        out += [(k, lo if k >= 0 else 0, hi - lo if k >= 0 else 0, c.at, c.landmarks[0], c.end - c.data - c.landmarks[0]) for k, (lo, hi) in sorted(found.items())]
    return out


def crai_bytes(entries: list[tuple]) -> bytes:
    return gzip.compress("".join("\t".join(map(str, e)) + "\n" for e in entries).encode(), mtime=0)


def read_crai(data: bytes) -> list[tuple[int, ...]]:
    text = (gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode()
    return [tuple(map(int, line.split("\t"))) for line in text.splitlines() if line]


class Fasta:
    """Bases of a FASTA file by its index (made where there is none beside it); the last stretch read is kept."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.system, self.path = open_path(path)
        known = self.system.get_file_info(f"{self.path}.fai")
        if known.type == fs.FileType.File:
            with self.system.open_input_file(known.path) as f:
                rows = [line.split("\t") for line in f.read().decode().splitlines()]
            self.index = {r[0]: tuple(map(int, r[1:5])) for r in rows}
        else:
            from .faidx import index_of

            with self.system.open_input_file(self.path) as f:
                self.index = {r[0]: r[1:5] for r in index_of(f.read())}
        self.held = ("", 0, "")

    def __call__(self, contig: str, beg: int, stop: int) -> str:
        name, first, bases = self.held
        if name != contig or beg < first or stop > first + len(bases):
            size, offset, per_line, width = self.index[contig]
            first, last = max(0, beg - 1000), min(size, max(stop, beg + 100_000))
            place = lambda i: offset + i // per_line * width + i % per_line
            with self.system.open_input_file(self.path) as f:
                f.seek(place(first))
                bases = f.read(place(last) - place(first)).replace(b"\n", b"").replace(b"\r", b"").decode().upper()
            self.held = contig, first, bases
        return bases[beg - first : stop - first]


class Run(InputPartition):
    """Consecutive containers of a file."""

    def __init__(self, path: str, places: list[tuple[int, int]]):
        self.path, self.places = path, places


class CramReader(DataSourceReader):
    """Containers are dealt out in runs of about ``splitbytes``; with ``region`` only those that an index names, or whose header says so."""

    def __init__(self, options: dict):
        self.path, self.region, self.reference = options["path"], options.get("region"), options.get("reference")
        self.size = int(options.get("splitbytes", 32 << 20))

    def partitions(self):
        system, _ = open_path(self.path)
        out = []
        for p in listed(self.path, (".cram",)):
            with system.open_input_file(p) as f:
                found = self._wanted(system, p, f)
            run: list[tuple[int, int]] = []
            for c in found:
                run.append((c.data, c.end))
                if c.end - run[0][0] >= self.size:
                    out.append(Run(p, run))
                    run = []
            if run:
                out.append(Run(p, run))
        return out

    def _wanted(self, system, path: str, f) -> list[Container]:
        from pyarrow import fs

        from ..operators.intervals import parse_region
        from .index import candidates

        size = system.get_file_info(path).size
        if not self.region:
            return list(containers(f, size))
        names = [n for n, _ in references_of(read_header(f))]
        region = parse_region(self.region, names.__contains__)
        contig = names.index(region.contig)
        index = next((x for x in candidates(path) if x.endswith(".crai") and system.get_file_info(x).type == fs.FileType.File), None)
        meets = lambda k, start, span: k == contig and start - 1 < region.stop and start - 1 + span > region.beg
        if index is None:
            return [c for c in containers(f, size) if c.contig == -2 or meets(c.contig, c.start, c.span)]
        with system.open_input_file(index) as g:
            places = sorted({e[3] for e in read_crai(g.read()) if meets(*e[:3])})
        return [Container(f, at) for at in places]

    def read(self, partition) -> Iterator:
        from .bam import BamReader

        inside = BamReader({"path": self.path, "region": self.region})._inside
        bases_of = Fasta(self.reference) if self.reference else None
        system, _ = open_path(self.path)
        with system.open_input_file(partition.path) as f:
            header = read_header(f)
            for start, end in partition.places:
                f.seek(start)
                rows = [(*row, start << 20 | i) for i, row in enumerate(decode_container(f.read(end - start), header, bases_of)) if inside(row)]
                for i in range(0, len(rows), RECORDS):
                    yield batch_of([dict(zip(COLUMNS, row, strict=True)) for row in rows[i : i + RECORDS]])


class CramSource(DataSource):
    """spark.dataSource.register(CramSource); read.format("cram").load(path); write.format("cram").option("header", text).mode("append").save(folder)"""

    @classmethod
    def name(cls):
        return "cram"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CramReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite):
        names, header = schema.fieldNames(), self.options["header"]
        return BatchFolderWriter(self.options["path"], "cram", lambda batches: cram_batches(header, batches, names))
