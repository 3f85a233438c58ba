"""Genomic views over the driver's tables, as SELECT lists that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: view -> (table, {column: expression}). Integer arithmetic and plain string functions only.
VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "alignments": (
        "lineitem",
        {
            "rec_idx": "l_orderkey * 10 + l_linenumber",
            "qname": "concat('q', cast(l_orderkey as varchar(20)))",
            "flag": "cast((l_linenumber * 37 + l_suppkey) % 4096 as int)",
            "rname": "concat('chr', cast(l_suppkey % 5 + 1 as varchar(20)))",
            "ref_id": "cast(l_suppkey % 5 as int)",
            "pos": "l_partkey * 7 + l_linenumber",
            "mapq": "cast(floor(l_quantity) as int)",
            "cigar": "case l_linenumber % 5 when 0 then '5S30M5S' when 1 then '40M' when 2 then '10M3I27M' when 3 then '20M10D20M' else '3H15M100N20M5S' end",
            "seq": "substr(repeat('ACGTTGCA', 20), cast(l_partkey % 8 + 1 as int), 40)",
            "nm": "cast(l_partkey % 5 as int)",
        },
    ),
    "intervals": (
        "orders",
        {
            "region_idx": "o_orderkey",
            "contig": "concat('chr', cast(o_custkey % 5 + 1 as varchar(20)))",
            # The last 80 of each 200 positions are in no interval.
            "beg": "o_orderkey % 75 * 200 + o_custkey % 40",
            "stop": "o_orderkey % 75 * 200 + o_custkey % 40 + 20 + o_custkey % 60",
        },
    ),
    "dense_intervals": (
        "orders",
        {
            "region_idx": "o_orderkey",
            "contig": "concat('chr', cast(o_custkey % 5 + 1 as varchar(20)))",
            # At all of 15,000 places, where ``intervals`` has 75 groups of 40.
            "beg": "o_orderkey % 15000",
            "stop": "o_orderkey % 15000 + 50 + o_custkey % 100",
        },
    ),
    "variants": (
        "part",
        {
            "rec_idx": "p_partkey",
            "contig": "concat('chr', cast(p_size % 5 + 1 as varchar(20)))",
            "pos": "cast(floor(p_partkey / 3) as bigint) + 1",
            "ref": "case p_partkey % 7 when 0 then 'A' when 1 then 'AC' when 2 then 'A' when 3 then 'ACG' when 4 then 'N' when 5 then 'ACGT' else 'G' end",
            "alt": "case p_partkey % 7 when 0 then 'T' when 1 then 'A' when 2 then 'ACC' when 3 then 'TCA' when 4 then '<DEL>' when 5 then case p_size % 3 when 0 then '*' when 1 then 'ACG[chr2:5[' else 'AcgA' end else case p_size % 2 when 0 then '<*>' else 'g' end end",
            "info_end": "case when p_partkey % 7 = 4 then cast(floor(p_partkey / 3) as bigint) + 1 + p_size end",
            "svlen": "case when p_partkey % 7 = 4 then -cast(p_size as bigint) end",
            "gt": "case p_size % 4 when 0 then '0/0' when 1 then '0/1' when 2 then '1|1' else './.' end",
        },
    ),
}


def select_sql(view: str) -> str:
    """The view as a SELECT, for common table expressions."""
    table, columns = VIEWS[view]
    return "select " + ", ".join(f"{e} as {c}" for c, e in columns.items()) + f" from {table}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*[F.expr(e).alias(c) for c, e in columns.items()])


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``alignments`` with the other columns that the filter language knows."""
    df = view(spark, sf_dir, "alignments")
    value = F.struct(F.lit("i").alias("type"), F.col("nm").cast("string").alias("value"))
    return df.select(
        "*", F.lit(None).cast("string").alias("rnext"), F.lit(None).cast("long").alias("pnext"), F.lit(-1).alias("next_ref_id"), F.lit(0).alias("tlen"),
        F.lit(None).cast("string").alias("library"), F.lit(None).cast("string").alias("qual"),
        F.when(F.col("nm") > 0, F.create_map(F.lit("NM"), value)).otherwise(F.create_map().cast("map<string,struct<type:string,value:string>>")).alias("aux"),
    )
