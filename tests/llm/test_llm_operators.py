"""Small cases of the ten operators: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from strandlake.llm import bytebpe, licenses, linedup, minhash, packing, quality, tokencount, topk, warc, winnow
from strandlake.llm.common import WordHashes, connected_components, word_shingles

BYTES, WORDS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")
CLASH = "doc_id long, text string, lang string, n long, id long, k string, component_id long, line int, pos long, bucket int, g long, score double"


def words(rng, n, v=400):
    return " ".join(f"w{rng.randrange(v)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [words(rng, rng.randrange(3, 120)) for _ in range(30)]
    out = [None, "", "   \n\t", "one", "One", "a b c", "x" * 70000, "wort " * 20000, "é ñ ü 中文 😀 ab\x1cc", "<|endoftext|> hi", *base, *base[:5]]
    for t in base:
        w = t.split()
        for _ in range(3):
            e = list(w)
            for _ in range(rng.randrange(0, 4)):
                e[rng.randrange(len(e))] = f"n{rng.randrange(10**6)}"
            out.append(" ".join(e))
    out += ["\n".join(rng.choice(base) for _ in range(4)) for _ in range(20)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", 1, 2, "k", 3, 4, 5, 6, 7, 0.5) for i, t in enumerate(texts)]
    rows += [(None, "no id here", *rows[0][2:]), (None, None, *rows[0][2:]), rows[20], rows[20]]
    return spark.createDataFrame(rows, CLASH).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], CLASH)


def components(sets, linked):
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and linked(sets[a], sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, texts, k):
    got = minhash.near_duplicates(docs, k=k).collect()
    assert len(got) == docs.count()
    sets = {i: shingles(t, k) for i, t in enumerate(texts)}
    want = components(sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= 80 * len(a | b))
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    assert len(set(want.values())) < len(want) - 20


def test_near_duplicates_keep_other_columns(spark, docs, none):
    """Columns whose names the operator uses itself; nothing in, nothing out."""
    clash = docs.withColumns({"rep": F.lit(1), "c": F.lit("x"), "hub": F.lit(True), "kept": F.lit(False), "h1": F.lit(2), "__gone": F.col("doc_id")})
    gone = {r["doc_id"] for r in minhash.near_duplicates(docs, k=5).where("not kept").collect()}
    left = minhash.drop_near_duplicates(clash)
    assert left.columns == clash.columns and len(gone) > 20
    want = clash.where(~F.coalesce(F.col("doc_id").isin(gone), F.lit(False)))
    assert sorted(map(str, left.collect())) == sorted(map(str, want.collect()))
    for k in (4, 5):
        assert minhash.near_duplicates(none, k=k).count() == 0


def test_near_duplicates_in_blocks(spark):
    """A large group of which the stars leave many components open."""
    rng = random.Random(2)
    base = words(rng, 60, 10**6).split()
    rows = []
    for i in range(120):
        e = list(base)
        for _ in range(rng.randrange(0, 7)):
            e[rng.randrange(60)] = f"q{rng.randrange(10**6)}"
        rows.append((i, " ".join(e)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=4, block=16).collect()}
    sets = {i: shingles(t, 4) for i, t in rows}
    assert got == components(sets, lambda a, b: 100 * len(a & b) >= 80 * len(a | b))


def test_sketch_estimates_and_merges():
    sketch = minhash.SetSketch(bands=64)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 2**63, 900, np.uint64), rng.integers(0, 2**63, 900, np.uint64)
    both = rng.integers(0, 2**63, 600, np.uint64)
    ka, kb, ku = sketch.of([np.concatenate((a, both)), np.concatenate((b, both)), np.concatenate((a, b, both))])
    assert (sketch.merge(ka, kb) == ku).all()
    j = sketch.jaccard(ka[None], kb[None], np.array([1500.0]), np.array([1500.0]))[0]
    assert abs(j - 600 / 2400) < 0.1
    assert sketch.of([np.empty(0, np.uint64)]).sum() == 0


def test_components_settle(spark, monkeypatch):
    from strandlake.llm import common

    monkeypatch.setattr(common, "CONTRACT", 40)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 200) if i % 50] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(40)] + [(5, None), (7, 7)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    nodes = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    pairs = {tuple(sorted(e)) for e in edges if None not in e}
    while True:
        new = {x: min([nodes[x], *(nodes[y] for a, b in pairs for y in (a, b) if x in (a, b) and y in nodes)]) for x in nodes}
        if new == nodes:
            break
        nodes = new
    assert got == nodes


def test_licences(docs):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n"
    cases = {
        "Licensed under CC BY-NC 4.0.\nmore": ["CC-BY-NC-4.0"], "a\nReleased under the MIT License.": ["MIT"], "This work is licensed under the GNU General Public License, version 3.": ["GPL-3"],
        "x. All rights reserved.": ["Proprietary"], "// SPDX-License-Identifier: MIT\n": ["MIT"], "no license at all here": [], "": [], apache: ["Apache-2.0"],
        "Released under the MIT License.\nLicensed under the Apache License, Version 2.0.": ["MIT", "Apache-2.0"],
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or any later version.": ["GPL-2-or-later"],
    }
    for text, want in cases.items():
        assert [f.licence for f in licenses.scan(text)] == want, text
    f = licenses.scan("ab.\nReleased under the MIT License.")[0]
    assert "ab.\nReleased under the MIT License."[f.start : f.end] == "Released under the MIT License."
    assert licenses.licences(docs).where("n_found > 0").count() == 0 and licenses.licences(docs).count() == docs.count()


def test_licence_expressions_and_lists(monkeypatch):
    cases = {
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["MIT", "APACHE-2.0"], "/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) AND BSD-3-Clause */": ["GPL-2.0-only WITH LINUX-SYSCALL-NOTE", "BSD-3-CLAUSE"],
        "# SPDX-License-Identifier: LGPL-2.1-or-later\nx": ["LGPL-2.1-or-later"], "SPDX-License-Identifier:\nMIT": [], "licensed under the terms of the MPL 2.0": ["MPL-2.0"], "It is dual licensed under MIT and Apache 2.0.": ["MIT", "Apache-2.0"],
        "Python Software Foundation License": ["PSF"], "Distributed under the PSF license version 2.": ["PSF-2"], "Available under either GPLv3+ or BSD-2-Clause, at your option.": ["GPL-3-or-later", "BSD-2"],
        "Released under LGPL 2.1 or later, EPL 2.0, zlib and CC0.": ["LGPL-2.1-or-later", "EPL-2.0", "Zlib", "CC0"], "Provided by ISC.": ["ISC"], "The mit and the bsd are words.": [], "All rooms are available by noon.": [],
    }
    for text, want in cases.items():
        assert sorted(f.licence for f in licenses.scan(text)) == sorted(want), text
    # The prefilter loses nothing: every pattern against every sentence gives the same.
    rng = random.Random(9)
    texts = [" ".join(rng.choice([*" ".join(cases).split(), "\n", "permission", "(c)", "2020", "bsd", "cc", "by"]) for _ in range(rng.randrange(1, 30))) for _ in range(400)] + [*cases]
    found = [licenses.scan(t) for t in texts]
    monkeypatch.setattr(licenses, "HINTS", ("",))
    assert [licenses.scan(t) for t in texts] == found and sum(map(len, found)) > 100


def test_licences_of_long_texts(spark, none):
    """Sentences of a megabyte that come near a pattern again and again; repeated rows, an empty table."""
    import time

    parts = ["released under x ", "x of the gpl y ", "neither the name of a nor the names of b ", "x under the affero general public license q ", "x of the gpl y or any later versio ", "under the new bsd x ", "is in the public domai "]
    start = time.process_time()
    for p in parts:
        licenses.scan("copyright " + p * (1_000_000 // len(p)))
        assert [f.licence for f in licenses.scan(p * 20_000 + ". Licensed under the MIT License.")][-1] == "MIT"
    licenses.scan("a licence\n" + " " * 1_000_000 + "x")
    assert time.process_time() - start < 60
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (None, None)]
    got = licenses.licences(spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1)))
    assert sorted((r["doc_id"] or 0, r["licences"]) for r in got.collect()) == [(0, []), (1, ["MIT"]), (1, ["MIT"])]
    assert licenses.licences(none).count() == 0


def test_licence_hints():
    """Whatever a known sentence's pattern matches passes the prefilter."""
    from re import _parser

    rng = random.Random(8)

    def sample(items) -> str:
        out = ""
        for op, x in items:
            op = str(op)
            if op == "LITERAL":
                out += chr(x)
            elif op == "IN":
                kind, x = rng.choice(x)
                out += chr(x) if str(kind) == "LITERAL" else chr(x[0]) if str(kind) == "RANGE" else "3"
            elif op == "BRANCH":
                out += sample(rng.choice(x[1]))
            elif op == "SUBPATTERN":
                out += sample(x[-1])
            elif op == "ATOMIC_GROUP":
                out += sample(x)
            elif op in ("MAX_REPEAT", "MIN_REPEAT"):
                out += "".join(sample(x[2]) for _ in range(rng.randint(x[0], min(x[1], x[0] + 1))))
            else:
                assert op in ("ANY", "AT"), op
                out += "q" if op == "ANY" else ""
        return out

    for name, p in licenses.SENTENCES:
        for _ in range(300):
            text = sample(_parser.parse(p))
            assert any(h in text for h in licenses.HINTS), (name, text)
    cases = {
        "Released under the GPL v3.": ["GPL-3"], "This library is LGPL 2.1.": ["LGPL-2.1"], "Distributed under AGPL 3.0.": ["AGPL-3.0"], "Released under the WTFPL.": ["WTFPL"],
        "Released under the BSD-3-Clause.": ["BSD-3"], "Plain words.\nIt is CC_BY 4.0.": ["CC-BY-4.0"], "It was placed in the public\n# domain.": ["Public-domain"], "\u00a9 2020 A. B.\n\nAll rights\nreserved.": ["Proprietary"],
    }
    for text, want in cases.items():
        assert [f.licence for f in licenses.scan(text)] == want, text


def test_quality(spark, none):
    rng = random.Random(1)
    rows = [(i, words(rng, 60) if i % 3 else ("spam " * 60 if i % 2 else "BUY!! NOW!! " * 20)) for i in range(900)]
    rows += [(1000, None), (1001, ""), (None, "no id"), rows[4]]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0) for i in range(900)] + [(3, None), (None, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels, most_labelled=400).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["held_out"] is False
            continue
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["predicted"] == (1 if r["doc_id"] % 3 else 0) for r in held) / len(held) > 0.97
    assert quality.quality_scores(none, labels).count() == 0
    clash = docs.withColumns({"score": F.lit("x"), "words": F.lit(1), "quality": F.lit(5), "held_out": F.lit(2), "__statistics": F.lit(3)})
    assert sorted(map(str, quality.quality_scores(clash, labels.withColumn("text", F.lit("y")), most_labelled=400).collect())) == sorted(map(str, got))
    kept = quality.keep_quality(clash.drop("__statistics"), labels, most_labelled=400)
    assert kept.columns == clash.columns[:-1] and kept.count() == sum(r["score"] >= 0.3 for r in got)
    # Labels of documents that aren't there don't crowd out those of the ones that are.
    many = labels.unionByName(spark.range(10**6, 10**6 + 20_000).selectExpr("id as doc_id", "1 as quality"))
    again = [r for r in quality.quality_scores(docs, many, most_labelled=400).collect() if r["held_out"] and r["doc_id"] < 900]
    assert sum(r["predicted"] == (1 if r["doc_id"] % 3 else 0) for r in again) / len(again) > 0.97
    assert {r["score"] for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}


def test_rules_compile_to_the_same_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.random((500, len(quality.STATISTICS)))
    model = quality.fit(x, ((x[:, 0] > 0.5) & (x[:, 3] < 0.7)).astype(float))
    assert 0 < len(model.rules) < 400
    df = spark.createDataFrame(x.tolist(), quality.STATISTICS)
    assert np.allclose([r[0] for r in df.select(model.column()).collect()], model.score(x))


def test_byte_bpe(spark, docs, none):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(BYTES, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    junk = ["".join(rng.choice(" \n\t  abc's'reÉéñΣİ́　\x1c\x85 <|>endoftext123½٣中文😀​\xa0") for _ in range(rng.randrange(60))) for _ in range(300)] + ["aaaa" * 400, "=" * 3000, "ab" * 900]
    bpe = bytebpe.ByteBpe(BYTES, public_tokenizers.PATTERN)
    assert bpe.encode_batch([t.encode() for t in junk]) == [(",".join(map(str, library.encode_ordinary(t))).encode(), t.encode()) for t in junk]
    for t in junk:
        ids = library.encode_ordinary(t)
        assert bpe.encode(t) == ",".join(map(str, ids)) and bpe.decode(bpe.encode(t)) == t and "".join(bpe.decode_stream(ids)) == t
    rows = bytebpe.encode(docs, BYTES, public_tokenizers.PATTERN)
    for r, t in ((r, t) for r in rows.collect() if r["doc_id"] is not None for t in [docs.where(F.col("doc_id") == r["doc_id"]).first()["text"] or ""] if r["doc_id"] < 14):
        ids = library.encode_ordinary(t)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    back = {r["doc_id"]: r["text"] for r in bytebpe.decode(rows, BYTES, public_tokenizers.PATTERN).collect()}
    assert all(back[r["doc_id"]] == (r["text"] or "") for r in docs.where("doc_id is not null").collect())
    assert bytebpe.encode(none, BYTES, public_tokenizers.PATTERN).count() == 0


def test_utf8_stream_is_the_incremental_decoder():
    """Any bytes, cut anywhere into tokens, give what Python's decoder gives with replacement."""
    rng = random.Random(8)
    whole = [c.encode() for c in "aé中😀\ud7ff\ue000\U0010ffff"]
    for _ in range(400):
        data = b"".join(rng.choice([*whole, bytes((rng.randrange(256),)), rng.choice(whole)[:-1], b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xe0\x9f"]) for _ in range(12))
        cuts = sorted(rng.sample(range(len(data) + 1), min(4, len(data))))
        tokens = dict(enumerate(data[i:j] for i, j in zip([0, *cuts], [*cuts, len(data)])))
        assert "".join(bytebpe.Utf8Stream(tokens).run(tokens)) == data.decode("utf-8", "replace")


def test_warc(spark, none):
    rng = random.Random(6)
    html = [None, "", "<p>same</p>", "<p>same</p>", "é" * 1_500_000, *("<p>" + words(rng, 30) + "</p>" for _ in range(40)), *["hot"] * 30]
    rows = [(i, f"http://x/{i} ü\r\n", h, "digest", "file") for i, h in enumerate(html)] + [(500, None, "only", "d", "f"), (None, "u", "only", "d", "f"), (7, "http://x/7", html[7], "d", "f")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string, file string").repartition(3)
    got = warc.round_trip(pages).collect()
    assert len(got) == len(rows)
    most = {}
    for i, _, h, *_ in rows:
        if i is not None:
            most[h or ""] = max(most.get(h or "", i), i)
    have = {i: h or "" for i, _, h, *_ in rows}
    for r in got:
        if r["page_id"] is None:
            assert r["record_type"] == "response"
            continue
        h = have[r["page_id"]]
        first = most[h]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(h.encode()), base64.b32encode(hashlib.sha1(h.encode()).digest()).decode())
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first == r["page_id"] else ("revisit", first))
    assert warc.round_trip(none.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"))).count() == 0
    big = warc.round_trip(pages, least=10).where("payload_bytes < 10 and record_type = 'revisit'").count()
    assert big == 0


def test_warc_ranges_merge():
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"file": ["a", "a", "a", "b"], "offset": [0, 10, 10**6, 0], "length": [10, 5, 5, 3]})
    assert list(warc._ranges([rows])) == [("a", 0, 15, [(0, 10), (10, 5)]), ("a", 10**6, 10**6 + 5, [(10**6, 5)]), ("b", 0, 3, [(0, 3)])]


def test_packing(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    got = packing.pack(docs, WORDS, most=256).collect()
    by: dict = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for r in docs.where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        ids = np.array([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1], np.uint32)
        want = Counter((k, s, len(ids[s : s + 256]), zlib.crc32(ids[s : s + 256].tobytes())) for k, s in enumerate(range(0, len(ids), 256)))
        mine = Counter((x["piece"], x["start"], x["length"], x["ids_crc32"]) for x in by[r["doc_id"]])
        assert mine == (want if r["doc_id"] != 20 else Counter({k: 3 for k in want}))
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        s.sort()
        assert s[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(s, s[1:])) and sum(s[-1]) <= 256
    assert len(sequences) <= 1.05 * sum(r["length"] for r in got) / 256 + 2
    assert packing.pack(none, WORDS).count() == 0


def test_encoder_forgets_and_learns_again():
    """Vocabularies beyond what a generation holds, within a batch and over batches; ids stay the library's."""
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(WORDS), packing.BatchEncoder(WORDS, places=6)
    rng = random.Random(7)
    old = [f"Word{i}, " for i in range(40)]
    odd = ["", "a\u2003\xa0b\x85c\u3000", "\x1ca b", "z" * 70 + "\u2028é", "İstanbul", "ŉx", "STRASSE", "Straße.,;", "é́", "It's", "a<|endoftext|>b", "x" * 90, "Σας", "ñandú!", "µm", "a×b", "12ab,"]
    for _ in range(12):
        batch = [" ".join(rng.choice(odd) if rng.random() < 0.3 else f"w{rng.randrange(10**4)}" for _ in range(rng.randrange(60))) + rng.choice(old) for _ in range(5)]
        for text, ids in zip(batch, encoder.encode_batch([t.encode() for t in batch]), strict=True):
            assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        assert encoder.chunks.table.n < 400


def test_chunks():
    """As the expression that cuts stretches, and as words between white space, on texts of all kinds of it."""
    import re

    from strandlake.llm import common

    rng = random.Random(3)
    for _ in range(200):
        texts = ["".join(rng.choice(["a", "é", "\u2014", "\x1c", " ", "\n", "\xa0", "\u2003", "\u3000", "\x85", "😀"]) for _ in range(rng.randrange(12))) for _ in range(rng.randrange(1, 5))]
        for with_space, pattern in ((True, f"[{bytebpe.SPACE}]*[^{bytebpe.SPACE}]+|[{bytebpe.SPACE}]+"), (False, f"[^{bytebpe.SPACE}]+")):
            data, start, end, count = common.chunks([t.encode() for t in texts], with_space)
            want = [re.findall(pattern, t) for t in texts]
            assert [data[a:b].decode() for a, b in zip(start, end)] == sum(want, []) and count.tolist() == list(map(len, want))
    table = common.ChunkTable(3)
    keys = np.array([8, 16, 24, 32, 40, 48, 56, 1, 2, 3], np.uint64)
    table.add(keys[:4])
    table.add(keys[4:])
    assert table.find(np.concatenate((keys, [np.uint64(7)]))).tolist() == [*range(10), -1]


def test_texts_in_segments(monkeypatch):
    """Texts of many segments, and of one without white space, give what the libraries give for the whole."""
    import pyarrow as pa
    import tiktoken
    from tokenizers import Tokenizer

    from strandlake.llm import common

    rng = random.Random(9)
    texts = [words(rng, 900) + "  \n\u2003 x ", "", "ab" * 900, "a\xa0b\xa0" * 300 + " end", "é" * 700 + "\n\n  z", "short", "Ж\u2003 ж\xa0\n" * 200, "жЖ " * 200]
    for most in (50, 300):
        got = list(common.segments([t.encode() for t in texts], most))
        whole = [b""] * len(texts)
        for which, parts in got:
            for i, p in zip(which, parts, strict=True):
                whole[i] += p
        assert whole == [t.encode() for t in texts] and len(got) > 5
    monkeypatch.setattr(common, "SEGMENT", 100)
    monkeypatch.setattr(common.segments, "__defaults__", (100,))
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.encode() for t in texts])], names=["doc_id", "text"])
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(BYTES, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = next(bytebpe._digests(iter([batch]), BYTES, public_tokenizers.PATTERN, True))
    assert out.column("ids").to_pylist() == [library.encode_ordinary(t) for t in texts]
    assert out.column("decoded_sha256").to_pylist() == [hashlib.sha256(t.encode()).hexdigest() for t in texts]
    word = Tokenizer.from_file(WORDS)
    ids = [word.encode(t, add_special_tokens=False).ids for t in texts]
    assert next(tokencount._counts(iter([batch]), WORDS, 9)).column("n_tokens").to_pylist() == list(map(len, ids))
    pieces = next(packing._pieces(iter([batch]), WORDS, 10**6, 1, 20))
    assert pieces.column("ids_crc32").to_pylist() == [zlib.crc32(np.array([*x, 1], np.uint32).tobytes()) for x in ids]


def test_packing_of_equal_rows(spark, monkeypatch):
    """Equal rows, null ones among them, spread over the groups."""
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = spark.range(12000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 3 > 0, "one two three").alias("text")).repartition(3)
    got = packing.pack(rows, path, most=64, group=1000).withColumn("g", F.shiftright("sequence_id", 32))
    groups = [r["count"] for r in got.groupBy("g").count().collect()]
    assert sum(groups) == 12000 and max(groups) < 2000 and len(groups) >= 12
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 64").count() == 0


def test_packing_of_short_texts(spark):
    """Groups' open sequences are packed together: pieces of one length need no more sequences than in one group."""
    df = spark.range(20_000).selectExpr("id as doc_id", "'a b c d e f g h i j k l m n o p q r s' as text")
    got = packing.pack(df, WORDS).collect()
    length = got[0]["length"]
    assert len({r["doc_id"] for r in got}) == len(got) == 20_000 and {r["length"] for r in got} == {length}
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append(r["offset"])
    assert all(sorted(s) == list(range(0, length * len(s), length)) for s in sequences.values())
    assert len(sequences) == -(-20_000 // (4096 // length))


def test_two_documents_replace_one():
    # 60 + 25 leave 15; in place of 25, 20 + 20 fill the 40 to the last token.
    bins, offsets = packing.best_two_fit(np.array([60, 25, 20, 20]), 100)
    assert bins.tolist() == [0, 1, 0, 0] and sorted(offsets[[0, 2, 3]].tolist()) == [0, 60, 80]


def test_winnowing(spark, docs, none):
    rows = {r["doc_id"]: r for r in winnow.fingerprints(docs, k=5, w=8).where("doc_id is not null").collect()}
    assert winnow.fingerprints(docs, k=5, w=8).count() == docs.count()
    texts = sorted(((r["doc_id"], r["text"] or "") for r in docs.where("doc_id is not null").collect()), reverse=True)
    prints: dict = {}
    for i, (ident, t) in enumerate(texts):
        n = len(t) // 3
        edited = t[: len(t) - n] + texts[(i + 1) % len(texts)][1][:n]
        r = rows[ident]
        assert r["n_chars"] == len(t) and 0 <= r["near_edited"] <= 1 and prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        if ident != 20:
            assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    lone = winnow.fingerprints(docs.where("doc_id is null")).collect()
    assert len(lone) == 2 and all(r["edited_sha256"] is None for r in lone)
    assert winnow.fingerprints(none).count() == 0


def plain_winnow(text, k, w):
    """{place: gram} by the definition: the least hash of each window of w grams, the rightmost of equals."""
    if not text:
        return {}
    grams = [text[i : i + k] for i in range(max(1, len(text) - k + 1))]
    h = [int(winnow._grams(np.frombuffer((g + "\0" * (k - len(g))).encode("utf-32-le"), np.uint32).astype(np.uint64), k)[0]) for g in grams]
    out = {}
    for i in range(max(1, len(h) - w + 1)):
        at = max(range(i, min(i + w, len(h))), key=lambda j: (-h[j], j))
        out[at] = h[at]
    return out


def test_winnowing_by_its_definition(spark):
    """Selected grams and places, edited texts and both likenesses, against a plain version."""
    rng = random.Random(17)
    base = words(rng, 60, 50)
    texts = {1: "", 2: "ab", 4: "aaaaaaaaaaaa" * 9, 5: base, 7: base[:200] + words(rng, 20, 50), 8: None, 9: words(rng, 3, 50), 11: "é中😀" * 30, 20: base}
    k, w = 5, 7
    got = {r["doc_id"]: r for r in winnow.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), k=k, w=w).collect()}
    order = sorted(texts, reverse=True)

    def like(a, b):
        a, b = set(a.values()), set(b.values())
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, follow in zip(order, [*order[1:], order[0]], strict=True):
        t, f = texts[i] or "", texts[follow] or ""
        edited = t[: len(t) - len(t) // 3] + f[: len(t) // 3]
        own, new, after = (plain_winnow(x, k, w) for x in (t, edited, f))
        assert got[i]["positions"] == sorted(own) and got[i]["fingerprint"] == "".join(f"{own[p]:08x}" for p in sorted(own))
        assert got[i]["edited_fingerprint"] == "".join(f"{new[p]:08x}" for p in sorted(new))
        assert got[i]["near_edited"] == pytest.approx(like(own, new)) and got[i]["near_next"] == pytest.approx(like(own, after))


def test_winnowing_finds_each_long_passage():
    rng = random.Random(8)
    for _ in range(50):
        shared = "".join(rng.choice("abcd ") for _ in range(12))  # w + k - 1 characters
        a, b = ("".join(rng.choice("efgh ") for _ in range(rng.randrange(40))) + shared + "".join(rng.choice("ijkl") for _ in range(30)) for _ in range(2))
        (h, p), (g, _) = winnow.winnow([a, b], k=5, w=8)
        assert set(h.tolist()) & set(g.tolist()) and (np.diff(p) > 0).all()


def test_token_counts(spark, docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rng = random.Random(4)
    junk = ["".join(rng.choice(" \n\t  abc's'reÉéñΣİ́　\x1c\x85 <|>endoftext123½٣中文😀​\xa0") for _ in range(rng.randrange(60))) for _ in range(300)] + ["<|startoftext|>x<|endoftext|>", "=" * 700, "aaaa" * 300, "ab" * 500]
    counter = tokencount.WordCounter(WORDS)
    for t in junk:
        assert counter.counts([t.encode(), b"", t.encode()]).tolist() == [n := len(library.encode(t, add_special_tokens=False).ids), 0, n], t
    got = tokencount.token_counts(docs, WORDS, limit=50).collect()
    assert len(got) == docs.count()
    have = {r["doc_id"]: r["text"] or "" for r in docs.where("doc_id is not null").collect()}
    for r in got:
        if r["doc_id"] is not None:
            t = have[r["doc_id"]]
            assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 50)
    assert tokencount.token_counts(none, WORDS).count() == 0


def test_state_maps_compose():
    """Blocks' maps are made in any order, each from its own symbols and those next to it; scanned, they give the library's count of every prefix's blocks."""
    from tokenizers import Tokenizer

    f, g = {0: {1: 2}, 5: {1: 4}}, {1: {7: 3, 8: 1}, 9: {7: 1}}
    assert tokencount.compose(f, g) == {0: {7: 5, 8: 3}, 5: {7: 7, 8: 5}}
    library, counter = Tokenizer.from_file(WORDS), tokencount.WordCounter(WORDS)
    rng = random.Random(5)
    syllables = ["the", "ing", "on", "er", "st", "q", "z", "tion", "a", "é"]
    pieces = ["x" * 700, "ab" * 300, *("".join(rng.choice(syllables) for _ in range(n)) for n in (40, 90, 200, 400)), *("".join(rng.choice("abcdexyz") for _ in range(300)) for _ in range(6))]
    for p in pieces:
        symbols, context = counter.piece_symbols(p), 2 * counter.machine.longest
        want = len(library.encode(p, add_special_tokens=False).ids)
        for block in (7, 32, 64):
            cuts = list(range(0, len(symbols), block))
            maps = {}
            for i in rng.sample(cuts, len(cuts)):
                counter.machine.reset()  # nothing is left of what other blocks did
                maps[i] = counter.machine.block_map(symbols[i : i + block], counter.machine.entries(symbols[max(0, i - context) : i], i <= context))
            assert max(len(m) for m in maps.values()) > 1
            assert [n for end, n in tokencount.scan([maps[i] for i in cuts])[-1][0].items() if end < 1 << tokencount.NODE] == [want]
            assert counter.long_piece(symbols, block) == want == counter.piece(symbols)


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v], 0.5, 1) for i, v in enumerate(rng.normal(size=(150, 8)).round(1))]
    rows += [(200 + i, rows[0][1], 0.5, 1) for i in range(40)]  # ties
    bad = [(400, None, 0.5, 1), (420, [1.0, None] + [0.0] * 6, 0.5, 1), (440, [float("nan")] * 8, 0.5, 1), (460, [float("inf")] + [0.0] * 7, 0.5, 1), (None, [1.0] * 8, 0.5, 1)]
    odd = [(500, [0.0] * 8, 0.5, 1), (520, [1.0] * 3, 0.5, 1), (521, [2.0] * 3, 0.5, 1)]
    again = [(40, [3.0] * 8, 0.5, 1), rows[60], (1, [0.1] * 8, 0.5, 1)]  # vec_ids that are there already
    df = spark.createDataFrame([*rows, *bad, *odd, rows[3], *again], "vec_id long, embedding array<double>, score double, rank int")
    for block in (8192, 32):
        got = [tuple(r) for r in topk.top_k(df, k=20, block=block, query_block=4 if block == 32 else 8192).orderBy("query_id", "rank").collect()]
        good = [(i, np.floor(64 * np.array(e)).astype(int)) for i, e, *_ in [*rows, *odd, rows[3], *again]]
        want = []
        for n, (q, x) in enumerate(good):
            if q % 20 == 0:
                other = sorted((-int(x @ y), i) for m, (i, y) in enumerate(good) if m != n and len(x) == len(y))[:20]
                want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(other)]
        want.sort(key=lambda r: r[:2])
        got, want = (sorted(x) for x in (got, want))
        assert got == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_threshold_stops_early():
    """Vectors near a few directions: the bound stops the search long before all rows are scored, and nothing is lost."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=(4, 32))
    x = np.floor(64 * (rng.normal(size=(3000, 4)) * [4, 2, 1, 1] @ base / 8 + rng.normal(size=(3000, 32)) / 50)).astype(np.int64)
    lists = topk.SortedLists(np.arange(3000), x)
    for i in range(0, 3000, 100):
        score = x @ x[i]
        best = [j for j in np.lexsort((np.arange(3000), -score)).tolist() if j != i][:20]
        ids, scores = lists.search(x[i], i, 20)
        assert ids.tolist() == best and scores.tolist() == score[best].tolist()
    assert lists.scored < 0.5 * 30 * 3000


def similar(rows, p=(4, 5)):
    lines = [(i, k, frozenset(x.encode().lower().split())) for i, t in sorted(rows) for k, x in enumerate((t or "").split("\n"))]
    gone = set()
    for j, (i, k, s) in enumerate(lines):
        if s and any(5 * len(s & t) >= 4 * len(s | t) for _, _, t in lines[:j] if t):
            gone.add((i, k))
    return gone


def test_similar_lines(spark, none):
    rng = random.Random(9)
    base = [words(rng, rng.randrange(1, 30), 60) for _ in range(40)]
    hot = words(rng, 40, 10**6).split()
    rows = []
    for i in range(60):
        text = [rng.choice(base) if rng.random() < 0.3 else words(rng, rng.randrange(1, 25), 60) for _ in range(rng.randrange(1, 6))]
        e = list(hot)
        for _ in range(rng.randrange(0, 12)):
            e[rng.randrange(40)] = f"q{rng.randrange(10**6)}"
        rows.append((i, "\n".join([*text, " ".join(e), "", "THE same Line"])))
    rows += [(90, None), (91, ""), (92, "\n\n"), (93, "long " * 3000 + "end")]
    df = spark.createDataFrame([*rows, (None, "the same line")], "doc_id long, text string").withColumn("line", F.lit(1)).withColumn("n", F.lit(2)).repartition(4)
    got = linedup.similar_lines(df).collect()
    assert len({(r["doc_id"], r["line"]) for r in got}) == len(got)
    assert {(r["doc_id"], r["line"]) for r in got} == similar(rows)
    assert all((r["like_doc_id"], r["like_line"]) < (r["doc_id"], r["line"]) for r in got)
    assert linedup.similar_lines(none).count() == 0
    gone = similar(rows)
    left = {r["doc_id"]: r["text"] for r in linedup.drop_similar_lines(df).where("doc_id is not null").collect()}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for k, x in enumerate(lines) if (i, k) not in gone]
        if any(x.split() for x in kept) or not any(x.split() for x in lines):
            assert left[i] == (None if t is None else "\n".join(kept))
        else:
            assert i not in left


def test_similar_lines_that_are_refused_first(spark):
    """Lines just below the similarity, so that signatures often take a line for alike that isn't."""
    rng = random.Random(12)
    base = words(rng, 40, 10**6).split()
    rows = []
    for i in range(220):
        e = list(base)
        for k in rng.sample(range(40), rng.choice([1, 3, 3, 4])):
            e[k] = f"q{rng.randrange(10**6)}"
        rows.append((i, " ".join(e)))
    got = linedup.similar_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["line"]) for r in got} == similar(rows)


def plain_classes(rows):
    """line_classes by comparing all pairs."""
    lines = sorted((i, k, frozenset(x.split())) for i, t in rows for k, x in enumerate((t or "").lower().split("\n")) if x.split())
    first: dict = {}
    for i, k, s in lines:
        first.setdefault(s, (i, k))
    like = {s: sorted(first[o] for o in first if o != s and 5 * len(s & o) >= 4 * len(s | o)) for s in first}
    return sorted(
        (i, k, *first[s], len(like[s]), *(like[s][0] if like[s] else (None, None)), (i, k) != first[s] or bool(like[s]) and like[s][0] < first[s]) for i, k, s in lines
    )


@pytest.mark.parametrize("settings", [{}, {"block": 7, "hot": 8, "most": 3}])
def test_line_classes(spark, none, settings):
    """All links between different sets of words: whole clusters and texts by filter, or small blocks, split words and texts by join."""
    rng = random.Random(31)
    base, far = words(rng, 40, 10**6).split(), words(rng, 300, 10**6).split()
    rows = [(0, "a b c d e f g h i x"), (1, "a b c d e f g h y j"), (2, "a b c d e f g h x y"), (3, "long " * 3000 + "end\nX y A b c d e f g h")]
    rows = [(i, t + "\n") for i, t in rows] + [(6, None), (7, "\n")]
    for i in range(10, 90):
        e, f = list(base), list(far)
        for k in rng.sample(range(40), rng.choice([0, 1, 2, 3, 4])):
            e[k] = f"q{rng.randrange(10**6)}"
        for k in rng.sample(range(300), rng.choice([0, 10, 31, 33, 36, 80])):
            f[k] = f"q{rng.randrange(10**6)}"
        rows.append((i, " ".join(e) + f"\n{words(rng, rng.randrange(1, 9), 12)}\n" + " ".join(f[: rng.choice([80, 100, 230, 300])])))
    df = spark.createDataFrame([*rows, (None, "a b c d e f g h i x")], "doc_id long, text string").repartition(4)
    names = ["doc_id", "line", "class_doc_id", "class_line", "n_links", "like_doc_id", "like_line", "removed"]
    got = linedup.line_classes(df, **settings)
    assert got.columns == names
    want = plain_classes(rows)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == want
    assert sum(r[4] for r in want) > 1000
    gone = linedup.similar_lines(df, **settings).collect()
    assert sorted((r["doc_id"], r["line"]) for r in gone) == [r[:2] for r in want if r[7]]
    assert all((r["like_doc_id"], r["like_line"]) < (r["doc_id"], r["line"]) for r in gone)
    assert linedup.line_classes(none).count() == 0


def test_line_classes_of_a_common_line(spark):
    """A word with so many lines that families are gathered around pivots, and a class of many lines."""
    rng = random.Random(4)
    base = [words(rng, 30, 10**6).split() for _ in range(3)]
    rows = []
    for i in range(1500):
        e = list(rng.choice(base)) if rng.random() < 0.8 else words(rng, 30, 10**6).split()
        for k in rng.sample(range(30), rng.choice([0, 1, 2, 3, 4, 5])):
            e[k] = f"q{rng.randrange(10**6)}"
        rows.append((i, "the same line\n" + " ".join([*e, "shared"])))
    got = linedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[:2]) == plain_classes(rows)


def test_postings_are_packed_and_unpacked():
    rng = np.random.default_rng(3)
    n = rng.integers(1, 400, 500).astype(np.uint32)
    t, pos, h = np.sort(rng.integers(0, 2**32, 500, np.uint32)), rng.integers(0, 90, 500).astype(np.uint32), rng.integers(0, 2**63, 500, np.uint64)
    s = [rng.integers(0, 2**63, 500, np.uint64) for _ in range(4)]
    got = linedup._unpacked(linedup._packed(t, n, pos, h, s))
    assert all((a == b).all() for a, b in zip(got, [t, n, pos, h, s[0], np.where(n > linedup.WIDE, s[1], 0), *(np.where(n > linedup.WIDER, x, 0) for x in s[2:])], strict=True))


def test_shingles():
    h = WordHashes()
    assert len(word_shingles(b"", 4, h)) == 0 and len(word_shingles(b"a b", 4, h)) == 1 and len(word_shingles(b"a a a a a a", 4, h)) == 1
    assert (word_shingles(b"A B c", 4, h) == word_shingles(b"a  b\nc", 4, h)).all() and word_shingles(b"a b", 4, h)[0] != word_shingles(b"a b", 1, h)[0]
