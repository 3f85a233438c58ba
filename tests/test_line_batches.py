"""Lines are written by batches: no Python object is made for each."""

import pyarrow as pa
import pytest

from strandlake.sources import bgzf
from strandlake.sources.files import LineSource, line_parts


def test_lines_by_batches(spark, tmp_path):
    lines = [f"q{i}\tä\t" + "x" * (i % 90) for i in range(5000)] + ["", "last"]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.string())], names=["line"]) for x in (lines[:3000], [], lines[3000:])]
    want = ("@HD\n" + "".join(x + "\n" for x in lines)).encode()
    assert b"".join(line_parts("@HD\n", False, batches)) == want
    packed = b"".join(line_parts("@HD\n", True, batches))
    assert bgzf.decompress(packed) == want and bgzf.compress(want) == packed
    assert b"".join(line_parts("@HD\n", True, [])) == bgzf.compress(b"@HD\n")
    with pytest.raises(ValueError):
        list(line_parts("", False, [pa.RecordBatch.from_arrays([pa.array(["a", None])], names=["line"])]))
    spark.dataSource.register(LineSource)
    spark.createDataFrame([(x,) for x in lines], "line string").repartition(3).write.format("lines").option("header", "@HD\n").option("extension", "sam").mode("append").save(str(tmp_path / "out"))
    back = [x for p in sorted((tmp_path / "out").glob("*.sam")) for x in p.read_text().split("\n")[1:-1]]
    assert sorted(back) == sorted(lines)
