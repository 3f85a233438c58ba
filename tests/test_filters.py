import pytest
from pyspark.sql import functions as F

from strandlake.functions.filters import Compiler, FilterError, Parser, flag_filter, number, read_filter, read_symbols, read_tags, string

SYMBOLS = {"foo": lambda: number(F.lit(15551)), "a": lambda: number(F.lit(1)), "b": lambda: number(F.lit(2)), "c": lambda: number(F.lit(3)), "magic": lambda: string(F.lit("plugh")), "empty": lambda: string(F.lit("")), "null": lambda: number(F.lit(None)), "nostr": lambda: string(F.lit(None))}

CASES = [
    ("1", 1.0, True), ("0", 0.0, False), ("1+1", 2.0, True), ("2+3*4", 14.0, True), ("(2+3)*4", 20.0, True), ("7%3", 1.0, True), ("-7%3", -1.0, True), ("1/0", float("inf"), True), ("0/0", None, False), ("5%0", None, False),
    ("0x1f", 31.0, True), ("1e3", 1000.0, True), ("a+b*c", 7.0, True), ("foo", 15551.0, True), ("!0", 1.0, True), ("!5", 0.0, False), ("!null", 1.0, True), ("~0", -1.0, True), ("-5", -5.0, True), ("6&3", 2.0, True), ("6|1", 7.0, True), ("6^3", 5.0, True),
    ("a == 1", 1.0, True), ("a != 1", 0.0, False), ("null == 1", None, False), ("null != 1", None, False), ("null && 1", 0.0, False), ("1 && null", 0.0, False), ("null || 1", 1.0, True), ("null || 0", 0.0, False), ("0 || null", 0.0, False),
    ('magic == "plugh"', 1.0, True), ('magic != "xyzzy"', 1.0, True), ('magic =~ "^p.*h$"', 1.0, True), ('magic !~ "^p"', 0.0, False), ('magic == 1', 0.0, False), ('magic != 1', 1.0, True), ('magic > "pa"', 1.0, True), ("magic < 5", 0.0, False), ("empty && 1", 1.0, True), ("nostr && 1", 0.0, False), ("!magic", 0.0, False),
    ("1 || 0 && 0", 0.0, False), ("1 == 1 == 1", 1.0, True), ("3 > 2 > 1", 1.0, True), ("3 > 2 > 0.5", 1.0, True),
    ("length(magic)", 5.0, True), ("min(magic)", 103.0, True), ("max(magic)", 117.0, True), ("avg(empty)", 0.0, False), ("min(empty)", None, False), ("sqrt(9)", 3.0, True), ("sqrt(-1)", None, False), ("log(0)", float("-inf"), True), ("log(-1)", None, False), ("exp(0)", 1.0, True), ("pow(2, 10)", 1024.0, True),
    ("default(null, 4)", 4.0, True), ("default(a, 4)", 1.0, True), ("exists(null)", 0.0, False), ("exists(empty)", 1.0, True), ("  1  +  2 ", 3.0, True),
]


def test_values(spark):
    value = Compiler(SYMBOLS)
    columns = [F.struct(value(t).number.alias("n"), value(t).truth.alias("t")).alias(f"x{i}") for i, (t, _, _) in enumerate(CASES)]
    row = spark.range(1).select(*columns).first()
    assert [(t, r["n"], r["t"]) for (t, _, _), r in zip(CASES, row, strict=True)] == CASES


@pytest.mark.parametrize("text", ["1 +", "(1", "1 2", "length(1, 2)", '"abc" + 1', "1 =~ 2", 'magic =~ "("', "§", "nothing"])
def test_errors(spark, text):
    with pytest.raises(FilterError):
        Compiler(SYMBOLS)(text)


def test_escapes():
    assert Parser(r'"a\t\"\d"', set()).parse().value == 'a\t"\\d'


def test_names_have_no_boundary():
    parser = Parser("ab", {"a", "b"})
    assert [t[1] for t in parser.tokens] == ["a", "b"]


def test_flags_and_tags(spark):
    from strandlake.plans.views import reads

    df = reads(spark, "/root/testdata/sf0.001")
    n = df.where(read_filter("flag.unmap && [NM] > 1")).count()
    assert n == df.where("(flag & 4) <> 0 and nm > 1").count() > 0
    assert df.where(flag_filter(F.col("flag"), 0, 0, 0)).count() == df.count()


def test_raw_qualities(spark):
    """As printed in a SAM line: '!' is 0, '5' 20, 'I' 40; no qualities are an empty string."""
    rows = [("!!!",), ("5I",), ("56~",), ("#I",), (None,)]
    df = spark.createDataFrame(rows, "qual string")
    value = Compiler(read_symbols(), read_tags)
    got = df.select(*[value(t).number.alias(n) for n, t in (("a", "min(qual)"), ("b", "max(qual)"), ("c", "avg(qual)"), ("d", "length(qual)"))]).collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, 3), (20, 40, 30, 2), (20, 93, (20 + 21 + 93) / 3, 3), (2, 40, 21, 2), (None, None, 0, 0)]
