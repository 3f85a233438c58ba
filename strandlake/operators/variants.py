"""Streams of variant records: merges of sorted inputs, pairing of alleles, sums over samples."""

from __future__ import annotations

from collections.abc import Iterable
from itertools import product

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_of_position(records: DataFrame) -> DataFrame:
    """Of an input's records at one position the last stays."""
    w = Window.partitionBy("contig", "pos").orderBy(F.desc("rec_idx"))
    return records.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def unsorted(records: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Records that come before their predecessor's position on the contig; none in a sorted input.

    Rows are ordered within blocks of ``width`` numbers of rec_idx, and only a row per block within a contig.
    """
    blocks = records.withColumn("__block", F.floor(F.col("rec_idx") / width))
    ends = blocks.groupBy("contig", "__block").agg(F.max_by("pos", "rec_idx").alias("__last"))
    ends = ends.withColumn("__last", F.lag("__last").over(Window.partitionBy("contig").orderBy("__block"))).select(F.col("contig").alias("__c"), F.col("__block").alias("__b"), "__last")
    rows = blocks.join(ends, F.col("contig").eqNullSafe(F.col("__c")) & (F.col("__block") == F.col("__b")))
    before = F.coalesce(F.lag("pos").over(Window.partitionBy("contig", "__block").orderBy("rec_idx")), "__last")
    return rows.withColumn("__before", before).where("pos < __before").select(*records.columns)


def synced(inputs: list[DataFrame], columns: tuple[str, ...] = ("ref", "alt")) -> DataFrame:
    """contig, pos and, for input i, the struct in_i of its columns (NULL where it has no record there)."""
    sides = []
    for i, records in enumerate(inputs):
        one = F.struct(F.lit(i).alias("i"), F.struct(*columns).alias("v"))
        sides.append(last_of_position(records).select("contig", "pos", one.alias("r")))
    both = sides[0]
    for s in sides[1:]:
        both = both.unionByName(s)
    # One shuffle for any number of inputs, where a chain of full joins would take one per input.
    picks = [F.max(F.when(F.col("r.i") == i, F.col("r.v"))).alias(f"in_{i}") for i in range(len(inputs))]
    return both.groupBy("contig", "pos").agg(*picks)


#: What it is worth to pair two kinds of alleles (in alphabetical order), and the pairs that a mode allows. Fixed values.
WORTH = {("indel", "indel"): 3, ("snp", "snp"): 3, ("indel", "ref"): 2, ("ref", "snp"): 2, ("indel", "snp"): 1}
MODES = {
    "snps": ["snp snp"], "indels": ["indel indel"], "both": ["snp snp", "indel indel"], "snps_ref": ["snp snp", "ref snp"], "indels_ref": ["indel indel", "indel ref"],
    "both_ref": ["snp snp", "indel indel", "ref snp", "indel ref"], "any": ["snp snp", "indel indel", "ref snp", "indel ref", "indel snp"], "exact": [], "some": [],
}
#: Worth of two variants that share an allele (exact: have the same alleles). A fixed value.
ALIKE = 2**32 - 1


def kind_of(allele: str) -> str:
    """ref, snp or indel, of 'REF>ALT'; whatever isn't one base for another counts as an indel."""
    ref, _, alt = allele.partition(">")
    return "ref" if alt in (".", ref) else "snp" if len(ref) == len(alt) == 1 else "indel"


def _fit(a: list[str], b: list[str], records: int, mode: str) -> int:
    """How well two sets of variants go together; 0 if they don't. ``records``: how many records they stand for."""
    allowed = {tuple(x.split()) for x in MODES[mode]}
    least = ALIKE
    for x, y in product(a, b):
        x, y = x.split(","), y.split(",")
        if set(x) == set(y) or mode != "exact" and set(x) & set(y):
            return ALIKE
        if mode == "exact":
            continue
        kinds = {tuple(sorted((kind_of(i), kind_of(j)))) for i, j in product(x, y)}
        least = min(least, max((WORTH[k] for k in kinds & allowed), default=0))
        if not least:
            return 0
    return 0 if mode == "exact" else 2 ** (28 + least) + records


def pair_alleles(site: Iterable[tuple[int, str]], mode: str = "exact") -> list[dict[int, str]]:
    """Groups one site's (input, 'REF>ALT,REF>ALT') records so that each group has at most one variant of each input.

    Again and again the variants of most records take in, of those without an input in common, the ones that fit them
    best: variants with a common allele (exact: with the same ones), then by the kinds of their alleles that the mode
    allows, then those of most records; once none fits they are a group.
    """
    found: dict[str, list[int]] = {}
    for i, v in site:
        found.setdefault(v, []).append(i)
    left = [([v], dict.fromkeys(i, v), len(i)) for v, i in found.items()]
    out = []
    while left:
        top = max(range(len(left)), key=lambda k: (left[k][2], -k))
        variants, group, n = left[top]
        fits = [(_fit(variants, v, n + m, mode), -k) for k, (v, g, m) in enumerate(left) if k != top and not group.keys() & g.keys()]
        score, place = max(fits, default=(0, 0))
        if not score:
            out.append(left.pop(top)[1])
            continue
        first, second = sorted((top, -place))
        v, g, m = left.pop(second)
        left[first] = left[first][0] + v, left[first][1] | g, left[first][2] + m
    return out


def paired(inputs: list[DataFrame], mode: str = "exact") -> DataFrame:
    """contig, pos, row and one column in_i per input: the records (contig, pos, rec_idx, ref, alt) of a site that are taken together."""
    import pyarrow as pa

    all_ = None
    for i, records in enumerate(inputs):
        one = records.select("contig", "pos", F.struct(F.lit(i).alias("i"), F.col("rec_idx").alias("r"), F.array_join(F.transform(F.split("alt", ","), lambda a: F.concat_ws(">", "ref", a)), ",").alias("v")).alias("x"))
        all_ = one if all_ is None else all_.unionByName(one)
    names = [f"in_{i}" for i in range(len(inputs))]
    sites = all_.groupBy("contig", "pos").agg(F.array_sort(F.collect_list("x")).alias("x")).select("contig", "pos", F.transform("x", lambda x: x["i"]).alias("i"), F.transform("x", lambda x: x["v"]).alias("v"))

    def pairs(batches):
        for b in batches:
            rows: list[tuple] = []
            for contig, pos, i, v in zip(*(b.column(c).to_pylist() for c in ("contig", "pos", "i", "v")), strict=True):
                rows += [(contig, pos, k, *[g.get(n) for n in range(len(names))]) for k, g in enumerate(pair_alleles(zip(i, v, strict=True), mode))]
            kinds = [pa.string(), pa.int64(), pa.int32(), *[pa.string()] * len(names)]
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["contig", "pos", "row", *names])

    return sites.mapInArrow(pairs, "contig string, pos long, row int, " + ", ".join(f"{n} string" for n in names))


def pl_sums(records: DataFrame) -> DataFrame:
    """contig, n, sum_pos, sum_pl: records, their positions and all samples' PL values; a missing PL counts as 0."""
    each = F.aggregate(F.coalesce("pl", F.array().cast("array<long>")), F.lit(0).cast("long"), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return records.groupBy("contig").agg(F.count("*").alias("n"), F.sum("pos").alias("sum_pos"), F.sum(each).alias("sum_pl"))
