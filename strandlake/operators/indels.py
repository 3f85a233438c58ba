"""Candidate indels against the reads that span them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.filters import ON_REFERENCE, cigar_parts, cigar_sum
from ..functions.kernels import Gaps, align_many, codes
from .intervals import interval_join
from .references import with_bases

#: Chances of gaps, the band, and the qualities that count, of alignments to haplotypes. Fixed values.
GAPS, LEAST_QUALITY, MOST_QUALITY = Gaps(1e-4, 1e-2, 10), 7, 30
#: Reference bases on both sides of a read in its haplotypes.
BESIDE = 10


def haplotype_scores(haplotypes: list[str], queries: list[str], qualities: list[np.ndarray | None]) -> list[int]:
    """Phred likelihood of each query in its haplotype; qualities count as LEAST_QUALITY to MOST_QUALITY, 30 where there are none."""
    clipped = [None if q is None else np.clip(q, LEAST_QUALITY, MOST_QUALITY) for q in qualities]
    return [x[0] for x in align_many([codes(h) for h in haplotypes], [codes(q) for q in queries], clipped, [GAPS] * len(queries), states=False)]


def _scored(batches: Iterator) -> Iterator:
    for b in batches:
        bases, at, ref, alt, seq, qual, skip, used = (b.column(c).to_pylist() for c in ("__bases", "__at", "__ref", "__alt", "__seq", "__qual", "__skip", "__used"))
        own = [slice(s, s + n) for s, n in zip(skip, used, strict=True)]
        with_alt = [h[:a] + y + h[a + len(x) :] for h, a, x, y in zip(bases, at, ref, alt, strict=True)]
        query = [s[k] for s, k in zip(seq, own, strict=True)]
        quality = [None if q is None or len(q) < len(s) else np.frombuffer(q.encode("latin-1"), np.uint8)[k].astype(np.int64) - 33 for q, s, k in zip(qual, seq, own, strict=True)]
        # Reads by indel of one place often share their haplotype's length, so both go through in one call.
        score = haplotype_scores(bases + with_alt, query * 2, quality * 2)
        columns = [pa.array(x, pa.int32()) for x in (score[: len(query)], score[len(query) :])]
        yield pa.RecordBatch.from_arrays([*b.select(["__read", "__variant"]).columns, *columns], names=["read", "variant", "ref_score", "alt_score"])


def indel_scores(reads: DataFrame, variants: DataFrame, references: DataFrame, read: str = "rec_idx", variant: str = "rec_idx") -> DataFrame:
    """read, variant, ref_score, alt_score for each read and each candidate indel that its alignment spans: Phred likelihoods of its bases without and with the indel.

    reads: ``read``, rname, pos, cigar, seq and qual (or NULL); variants: ``variant``, contig, pos (from 1), ref, alt, of which those count whose
    alleles are plain bases of different lengths; references: name, seq. A haplotype is the reference under the read and BESIDE bases
    on both sides. Clipped bases aren't scored. Reads with skips, and indels whose ref isn't the reference's, are left out.
    """
    plain = "^[ACGTNacgtn]+$"
    v = variants.where(F.col("ref").rlike(plain) & F.col("alt").rlike(plain) & (F.length("ref") != F.length("alt")))
    v = v.select("contig", (F.col("pos") - 1).alias("beg"), (F.col("pos") - 1 + F.length("ref")).alias("stop"), F.col(variant).alias("id"), "ref", "alt")
    parts = cigar_parts(F.col("cigar"))
    clip = F.get(F.filter(F.slice(parts, 1, 2), lambda p: p["op"] != "H"), 0)
    r = reads.where(~F.col("cigar").contains("N") & F.col("seq").isNotNull() & (F.col("seq") != "*"))
    r = r.select(
        F.col("rname").alias("contig"), (F.col("pos") - 1).alias("beg"), (F.col("pos") - 1 + cigar_sum(F.col("cigar"), ON_REFERENCE)).alias("stop"), F.col(read).alias("id"), "seq", "qual",
        F.when(clip["op"] == "S", clip["len"]).otherwise(0).alias("skip"), cigar_sum(F.col("cigar"), "MI=X").cast("int").alias("used"),
    )
    both = interval_join(r, v).where("beg <= r_beg and stop >= r_stop and used > 0")
    found = with_bases(both, references, "contig", F.col("beg") - BESIDE, F.col("stop") + BESIDE)
    at = (F.col("r_beg") - F.col("__from")).cast("int")
    found = found.where(F.upper(F.substr("__bases", at + 1, F.length("r_ref"))) == F.upper("r_ref"))
    found = found.select(F.col("id").alias("__read"), F.col("r_id").alias("__variant"), "__bases", at.alias("__at"), F.col("r_ref").alias("__ref"), F.col("r_alt").alias("__alt"), F.col("seq").alias("__seq"), F.col("qual").alias("__qual"), F.col("skip").alias("__skip"), F.col("used").alias("__used"))
    kinds = {f.name: f.dataType.simpleString() for f in found.schema}
    return found.mapInArrow(_scored, f"read {kinds['__read']}, variant {kinds['__variant']}, ref_score int, alt_score int")
