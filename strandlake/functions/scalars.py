"""Small column functions: numbers, bits, hashes, statistics, texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lanczos coefficients (g = 7, nine terms). Fixed values.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def lgamma(x: Column) -> Column:
    """log of the gamma function for x >= 0.5."""
    z = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + c / (z + i)
    t = z + 7.5
    return 0.9189385332046727 + (z + 0.5) * F.ln(t) - t + F.ln(total)


def log_choose(n: Column, k: Column) -> Column:
    return F.when((k == 0) | (k == n), 0.0).otherwise(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1))


def fisher_exact(a: Column, b: Column, c: Column, d: Column) -> Column:
    """struct(p, left, right, two) for the table a b / c d: the chance of the table itself, of a or less, of a or more, and of all tables that are at most as likely."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    row, col, n = a + b, a + c, a + b + c + d
    low, high = F.greatest(F.lit(0.0), col - (n - row)), F.least(row, col)
    chance = lambda k: F.exp(log_choose(row, k) + log_choose(n - row, col - k) - log_choose(n, col))
    all_ = F.transform(F.sequence(low.cast("int"), high.cast("int")), lambda k: F.struct(k.cast("double").alias("k"), chance(k.cast("double")).alias("p")))
    p = chance(a)
    total = lambda test: F.least(F.aggregate(F.filter(all_, test), F.lit(0.0), lambda s, x: s + x["p"]), F.lit(1.0))
    return F.struct(p.alias("p"), total(lambda x: x["k"] <= a).alias("left"), total(lambda x: x["k"] >= a).alias("right"), total(lambda x: x["p"] <= p * (1 + 1e-7)).alias("two"))


def round_up_power(x: Column) -> Column:
    """The smallest power of two that is at least x; 0 stays 0."""
    v = x.cast("long") - 1
    for s in (1, 2, 4, 8, 16, 32):
        v = v.bitwiseOR(F.shiftright(v, s))
    return F.when(x <= 0, F.lit(0).cast("long")).otherwise(v + 1)


def pack_offset(block: Column, inside: Column) -> Column:
    """Offset of a compressed block and offset inside it as one number (48 and 16 bits)."""
    bad = (block < 0) | (block >= 2**48) | (inside < 0) | (inside >= 2**16)
    return F.when(bad, F.raise_error(F.lit("offset out of range")).cast("long")).otherwise(F.shiftleft(block.cast("long"), 16).bitwiseOR(inside.cast("long")))


def unpack_offset(offset: Column) -> Column:
    return F.struct(F.shiftrightunsigned(offset, 16).alias("block"), offset.bitwiseAND(0xFFFF).alias("inside"))


def bytes_of(s: Column) -> Column:
    h = F.hex(s.cast("binary"))
    n = F.octet_length(s)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def x31(s: Column) -> Column:
    """h = h * 31 + byte over the bytes, 32 bits, from the first byte."""
    b = bytes_of(s)
    return F.aggregate(b, F.lit(0).cast("long"), lambda h, x: (h * 31 + x).bitwiseAND(0xFFFFFFFF))


def wang(x: Column) -> Column:
    """A 32-bit integer hash of shifts and sums."""
    m = 0xFFFFFFFF
    left = lambda v, n: F.shiftleft(v, n).bitwiseAND(m)
    right = lambda v, n: F.shiftright(v, n)
    inv = lambda v: v.bitwiseXOR(m)
    k = x.cast("long").bitwiseAND(m)
    k = (k + inv(left(k, 15))).bitwiseAND(m)
    k = k.bitwiseXOR(right(k, 10))
    k = (k + left(k, 3)).bitwiseAND(m)
    k = k.bitwiseXOR(right(k, 6))
    k = (k + inv(left(k, 11))).bitwiseAND(m)
    return k.bitwiseXOR(right(k, 16))


def clamped_integer(s: Column, bits: int, signed: bool = True) -> Column:
    """struct(value, end, failed): the digits at the start of a text as an integer, clamped to ``bits``."""
    most = 2 ** (bits - 1) - 1 if signed else 2**bits - 1
    digits = F.regexp_extract(s, r"^([+-]?)(\d+)", 2)
    minus = F.regexp_extract(s, r"^([+-]?)(\d+)", 1) == "-"
    end = F.length(F.regexp_extract(s, r"^[+-]?\d+", 0))
    n = F.ltrim(digits, F.lit("0"))
    top = F.lit(most if not signed else most)
    size = F.when(F.length(n) > 18, F.lit(10**18)).otherwise(F.coalesce(F.nullif(n, F.lit("")).try_cast("long"), F.lit(0).cast("long")))
    limit = F.when(minus, F.lit(most + 1 if signed and bits < 64 else most)).otherwise(top)
    over = size > limit
    value = F.least(size, limit)
    return F.struct(F.when(minus, -value).otherwise(value).cast("long").alias("value"), end.alias("end"), over.alias("failed"))


def kth_smallest(values: Column, k: int) -> Column:
    """0-based; NULL out of range."""
    return F.try_element_at(F.array_sort(values), F.lit(k + 1))


def file_extension(name: Column, ext: str, replace: bool) -> Column:
    """A path with an extension appended, or put in place of the last one; queries and fragments of URLs stay behind it."""
    url = name.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]+://")
    tail = F.when(url, F.when(name.startswith("s3"), F.regexp_extract(name, r"\?.*$", 0)).otherwise(F.regexp_extract(name, r"[?#].*$", 0))).otherwise(F.lit(""))
    base = F.substring(name, F.lit(1), F.length(name) - F.length(tail))
    base = F.regexp_replace(base, r"\.[^./]*$", "") if replace else base
    return F.concat(base, F.lit(ext), tail)


def data_url(url: Column) -> Column:
    """The bytes of a data: URL, base64 or percent-encoded."""
    body = F.regexp_extract(url, r"^data:[^,]*,(.*)$", 1)
    plain = F.url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))).cast("binary")
    return F.when(url.rlike(r"^data:[^,]*;base64,"), F.unbase64(body)).when(url.rlike(r"^data:[^,]*,"), plain)


#: Signatures of binary formats. Fixed values.
MAGIC = {"BAM": b"BAM\x01", "CRAM": b"CRAM", "BCF": b"BCF\x02", "BAI": b"BAI\x01", "CSI": b"CSI\x01", "TBI": b"TBI\x01", "gzip": b"\x1f\x8b"}


def text_format(line: Column) -> Column:
    """The format that a file's first line shows."""
    return (
        F.when(line.rlike(r"^@(HD|SQ)\t"), "SAM").when(line.startswith("##fileformat=VCF"), "VCF").when(line.startswith(">"), "FASTA")
        .when(line.startswith("@"), "FASTQ").when(line.startswith("##gff-version"), "GFF").when(line.rlike(r"^[^\t]+\t\d+\t\d+(\t|$)"), "BED").otherwise("unknown")
    )


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTUMRWSYKVHDBNacgtumrwsykvhdbn", "TGCAAKYWSRMBDHVNtgcaakywsrmbdhvn"))


def shifted_qualities(qual: Column, tag: Column, apply: bool = True) -> Column:
    """Quality text with an alignment-quality tag (offset 64) subtracted, or added back."""
    q, t = F.split(qual, ""), F.split(tag, "")
    one = lambda a, b: F.char(F.ascii(a) - (F.ascii(b) - 64) if apply else F.ascii(a) + (F.ascii(b) - 64))
    return F.when(tag.isNull(), qual).otherwise(F.array_join(F.zip_with(q, t, one), ""))
