"""Column functions over variant records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of variants as bits. Fixed values.
REF, SNP, MNP, INDEL, OTHER, BND, OVERLAP, INS, DEL = 0, 1, 2, 4, 8, 16, 32, 64, 128
#: ALTs that stand for the reference. Fixed values.
REFERENCE_ALTS = ("<X>", "<*>", "<NON_REF>")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    other = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i > n) | (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1))))
    return F.coalesce(F.try_element_at(other, F.lit(1)) - 1, n)


def classify(ref: Column, alt: Column) -> Column:
    """struct(kind, len) of one ALT against REF; len is NULL for symbolic ones and breakends.

    What both share is cut off, at the start and then at the end, without regard to case but for single
    bases; the last base of either stays. One base left on both sides is a SNP, equally many an MNP; a
    side that is used up makes an insertion or a deletion; anything else is OTHER.
    """
    first = F.struct(F.upper(ref).alias("r"), F.upper(alt).alias("a"), F.length(ref).alias("n"), F.length(alt).alias("m"))
    return _once(first, lambda v: _once(common_prefix(v["r"], v["a"]), lambda p: _once(_common_end(v, p), lambda s: _kind(ref, alt, v, p, s))))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, for which the value is worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _common_end(v: Column, p: Column) -> Column:
    """What may be cut from the end: all but one base of what is left on each side."""
    r, a = (F.reverse(F.substring(v[x], p + 1, v[n])) for x, n in (("r", "n"), ("a", "m")))
    return F.least(common_prefix(r, a), v["n"] - p - 1, v["m"] - p - 1)


def _kind(ref: Column, alt: Column, v: Column, p: Column, s: Column) -> Column:
    r, a, n, m = (v[c] for c in "ranm")
    x, y = n - p - s, m - p - s
    equal_left = F.substring(r, p + x, F.lit(1)) == F.substring(a, p + y, F.lit(1))
    bracket = alt.rlike(r"[\[\]]$")
    make = lambda kind, length: F.struct(F.lit(kind).cast("int").alias("kind") if isinstance(kind, int) else kind.cast("int").alias("kind"), length.cast("int").alias("len"))
    none = F.lit(None)
    return (
        F.when(alt == "*", make(OVERLAP, F.lit(0)))
        .when((n == 1) & (m == 1), F.when((alt == ".") | (alt == ref) | (alt == "X"), make(REF, F.lit(0))).otherwise(make(SNP, F.lit(1))))
        .when(alt.startswith("<"), F.when(alt.isin(*REFERENCE_ALTS), make(REF, F.lit(0))).otherwise(make(OTHER, none)))
        .when(alt.rlike(r"^[\[\]]"), make(BND, none))
        .when((p == n) & (p == m), make(REF, F.lit(0)))
        .when((p == m) & (p < n), make(INDEL | DEL, m - n))
        .when(bracket, make(BND, none))
        .when(p == n, make(INDEL | INS, m - n))
        .when((x == 1) & (y == 1), make(SNP, F.lit(1)))
        .when(y == 1, make(F.when(equal_left, INDEL | DEL).otherwise(OTHER), 1 - x))
        .when(x == 1, make(F.when(equal_left, INDEL | INS).otherwise(OTHER), y - 1))
        .otherwise(make(F.when(x == y, MNP).otherwise(OTHER), F.when(x > y, -x).otherwise(y)))
    )


def record_kind(ref: Column, alts: Column) -> Column:
    """The kinds of all ALTs together."""
    return F.aggregate(F.transform(alts, lambda a: classify(ref, a)["kind"]), F.lit(0), lambda x, y: x.bitwiseOR(y))


def genotype_index(i: Column, j: Column) -> Column:
    """Place of the genotype i/j among all of a site's genotypes."""
    low, high = F.least(i, j), F.greatest(i, j)
    return F.floor(high * (high + 1) / 2).cast("long") + low


def reference_length(pos: Column, ref: Column, alts: Column, end: Column, svlen: Column, lens: Column | None = None) -> Column:
    """Bases of the reference that a record covers: the most of REF, END, SVLEN of symbolic ALTs and FORMAT/LEN of <*>; at least 1 for END.

    svlen: one length per ALT; ``lens``: the samples' LEN.
    """
    by_end = F.when(end.isNotNull(), F.greatest(end - pos + 1, F.lit(1)))
    symbolic = F.zip_with(alts, svlen, lambda a, n: F.when(a.startswith("<") & ~a.isin("<*>", "<INS>"), F.abs(n) + 1))
    by_sv = F.array_max(symbolic)
    by_len = F.when(F.array_contains(alts, "<*>"), F.array_max(lens)) if lens is not None else F.lit(None).cast("long")
    return F.greatest(F.length(ref).cast("long"), by_end, by_sv, by_len)


#: Fields with a value per ALT, per allele, per genotype. Fixed values.
PER_ALT, PER_ALLELE, PER_GENOTYPE = ("AC", "AF", "CN", "RN", "SVLEN"), ("AD",), ("PL",)


def drop_alleles(values: Column, per: str, gone: Column, n_alleles: Column) -> Column:
    """``values`` (array) without those of removed alleles (0-based numbers in ``gone``; 0 is the reference).

    per: A (one per ALT), R (one per allele) or G (one per unordered pair of alleles).
    """
    if per in ("A", "R"):
        shift = 1 if per == "A" else 0
        return F.filter(values, lambda v, i: ~F.array_contains(gone, (i + shift).cast("int")))
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n_alleles - 1), lambda j: F.transform(F.sequence(F.lit(0), j), lambda i: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j")))))
    kept = F.zip_with(pairs, values, lambda p, v: F.struct(p["i"].alias("i"), p["j"].alias("j"), v.alias("v")))
    kept = F.filter(kept, lambda x: ~F.array_contains(gone, x["i"]) & ~F.array_contains(gone, x["j"]))
    return F.transform(kept, lambda x: x["v"])


def remap_genotype(gt: Column, gone: Column) -> Column:
    """A genotype text with alleles renumbered after removal; removed ones become '.'."""
    alleles = F.regexp_extract_all(gt, F.lit(r"([/|]?)(\d+|\.)"), F.lit(2))
    marks = F.regexp_extract_all(gt, F.lit(r"([/|]?)(\d+|\.)"), F.lit(1))

    def one(mark: Column, allele: Column) -> Column:
        n = allele.try_cast("int")
        new = F.when(n.isNull() | F.array_contains(gone, n), F.lit(".")).otherwise((n - F.size(F.filter(gone, lambda g: g < n))).cast("string"))
        return F.concat(mark, new)

    return F.array_join(F.zip_with(marks, alleles, one), "")


def values_of(field: Column, kind: str) -> Column:
    """A comma-separated field as typed values; '.' is NULL, a missing field too. Malformed numbers are errors."""
    return F.transform(F.split(field, ","), lambda x: F.when(x == ".", None).otherwise(x).cast(kind))


def info_of(info: Column, key: str) -> Column:
    """A key's text in INFO; '' for a flag, NULL where it is missing."""
    hit = F.filter(F.split(info, ";"), lambda x: (x == key) | x.startswith(key + "="))
    return F.substring(F.try_element_at(hit, F.lit(1)), F.lit(len(key) + 2), F.lit(2**31 - 1))


def genotypes_of(format: Column, samples: Column) -> Column:
    """Each sample's GT as a text; NULL for records without GT, an error for a sample that ends before it."""
    at = F.array_position(format, "GT")
    one = lambda s: F.when(F.size(s) < at, F.raise_error(F.lit("a sample without its genotype")).cast("string")).otherwise(F.try_element_at(s, at.cast("int")))
    return F.when(at > 0, F.transform(samples, one))
