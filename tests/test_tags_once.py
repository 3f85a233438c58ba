"""A tag is looked up once a row, however often its filter needs it."""

from strandlake.functions.filters import read_filter


def test_one_lookup_a_tag(spark):
    for text in ("default([NM], 9) >= 4", "[NM] > 2 || !exists([XX]) && !([NM] >= 0)"):
        assert str(read_filter(text)).count("aux") == text.count("XX") + 1
