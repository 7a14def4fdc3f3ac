import struct
import textwrap
import time

import pytest
import zstandard

import corpus_pipeline
from platewise.llm import warc
from platewise.llm.language import identify, train
from platewise.llm.licenses import TEXTS, scan_licenses
from platewise.llm.mixture import mix_sources

ENGLISH = "the quick brown fox jumps over the lazy dog and then it rests under the old tree for a while"
GERMAN = "der schnelle braune Fuchs springt über den faulen Hund und ruht sich dann unter dem alten Baum aus"


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, f"{ENGLISH} {i}", "en") for i in range(20)] + [(i, f"{GERMAN} {i}", "de") for i in range(20, 40)] + [(40, "съешь же ещё этих мягких французских булок", "ru"), (41, None, "en"), (42, ENGLISH, None)]
    return train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_language(spark, model):
    texts = [ENGLISH, GERMAN, f"{ENGLISH} {GERMAN}", None, "", "12 34 !!", "этих булок", ENGLISH * 400, ENGLISH]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, score int")
    got = {r["doc_id"]: r for r in identify(df, model).collect()}
    assert [got[i]["lang_pred"] for i in range(9)][:2] == ["en", "de"] and got[6]["lang_pred"] == "ru" and got[7]["lang_pred"] == "en"
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["spans"]) == ("und", 0.0, []) for i in (3, 4, 5))
    assert [s["lang"] for s in got[2]["spans"]] == ["en", "de"] and 0.5 < got[2]["score"] < 0.6
    assert abs(got[2]["spans"][1]["start"] - len(ENGLISH) - 1) <= 4
    assert got[8]["spans"] == got[0]["spans"] and got[0]["score"] == 1.0
    assert identify(df.limit(0), model).collect() == []


def test_language_without_labels(spark):
    none = train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    df = spark.createDataFrame([(1, ENGLISH)], "doc_id long, text string")
    assert identify(df, none).collect()[0]["lang_pred"] == "und"


def test_mixture(spark):
    rows = [(i, "w " * (i % 90), ["a", "b", None, "c"][i % 4] if i % 3 else "a", "x") for i in range(300)] + [(900, None, "d", "x"), (901, "", None, "x"), (5, "w w", "a", "x"), (5, "w w", "a", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string")
    taken, ranges = mix_sources(df)
    got = taken.collect()
    assert len(got) == len(rows) and sum(r["size"] for r in got) == sum(len((t or "").split()) for _, t, *_ in rows)
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], [r["target"], 0, r["source_size"]])[1] += r["taken"]
    assert sum(t for t, *_ in by.values()) == pytest.approx(sum(r["size"] for r in got))
    for target, n, size in by.values():
        assert target <= 3 * size + 1e-9 and abs(n - target) <= 0.02 * target + 64
    assert by["d"] == [0.0, 0, 0]
    assert ranges.selectExpr("sum(to_word - from_word)").first()[0] == sum(r["taken"] for r in got)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_sources(df.repartition(7))[0].collect()), key=repr)
    assert mix_sources(df.limit(0))[0].collect() == []


PAGES = [(3, "http://a/ü", "<p>one</p>" * 30), (1, None, "<p>two</p>"), (2, "http://b", "<p>one</p>" * 30), (4, "x\r\ny", None), (5, "u", ""), (6, "u", "é" * 50000), (3, "http://a/ü", "<p>one</p>" * 30)]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, body int")
    archives = warc.write_archives(pages, archive_bytes=2000)
    got = warc.read_archives(archives).collect()
    assert all(r["problem"] is None for r in got) and len(got) == len(PAGES)
    texts = {p: (t or "").encode() for p, _, t in PAGES}
    assert all(r["payload_bytes"] == len(texts[r["page_id"]]) and r["payload_digest"] == warc.digest(texts[r["page_id"]]) for r in got)
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in got}
    assert kinds == {1: ("response", None), 2: ("response", None), 3: ("revisit", 2), 4: ("response", None), 5: ("revisit", 4), 6: ("response", None)}
    assert all(r["payload"] == texts[r["page_id"]] for r in got if r["record_type"] == "response")
    warc.save(archives, str(tmp_path))
    assert warc.read_archives(warc.load(spark, f"file://{tmp_path}")).count() == len(PAGES)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).collect() == []


def test_dictionary_frame_and_broken_archives(spark):
    words = [f"<html><body>page {i} of {i * 7} with words and more words</body></html>" * 5 for i in range(300)]
    pages = spark.createDataFrame([(i, "u", w) for i, w in enumerate(words)], "page_id long, url string, html string")
    content = warc.write_archives(pages).first()["content"]
    assert struct.unpack_from("<I", content)[0] == warc.DICT_MAGIC
    raw = next(warc.frames(content))
    assert warc.parse(raw)[1] is None
    assert warc.parse(raw.replace(b"Content-Length: ", b"Content-Length: 1", 1))[1] == "Content-Length doesn't match"
    assert warc.parse(raw[:40] + raw[41:])[1] is not None and warc.parse(b"junk")[1] == "no WARC header"
    size = struct.unpack_from("<I", content, 4)[0]
    packed = zstandard.ZstdCompressor().compress(content[8 : 8 + size])
    assert next(warc.frames(struct.pack("<II", warc.DICT_MAGIC, len(packed)) + packed + content[8 + size :])) == raw
    broken = spark.createDataFrame([("cut", bytearray(content[:-9])), ("junk", bytearray(b"abcdefghijkl")), ("none", None)], "archive_id string, content binary")
    got = warc.read_archives(broken).filter("problem IS NOT NULL").collect()
    assert sorted(r["archive_id"] for r in got) == ["cut", "junk"]


def test_licenses(spark):
    files = [
        ("r/LICENSE", "Released under the MIT License."), ("r/a/b/f.py", "code"), ("r/a/LICENSE", "nothing here"), ("r/a/b/g.py", "x\nLicensed under the Apache License, Version 2.0.\ny"), ("r/a/c/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("r/a/c/d/e.py", None), ("s/x.py", "license to drive a car in the city of many words"), ("top.py", ""), (None, "text"), ("r/a/b/f.py", "code"),
    ]
    df = spark.createDataFrame([(*f, "x") for f in files], "path string, text string, license string")
    rows = scan_licenses(df).collect()
    got = {r["path"]: (r["license"], r["origin"], r["directory"]) for r in rows}
    assert len(rows) == len({p for p, _ in files})
    assert got["r/a/b/f.py"] == ("MIT", "inherited", "r") and got["r/a/b/g.py"] == ("Apache-2.0", "own", None)
    assert got["r/a/c/d/e.py"] == ("GPL-3.0", "inherited", "r/a/c")
    assert got["s/x.py"] == got["top.py"] == got[None] == (None, "none", None)
    assert scan_licenses(df.limit(0)).collect() == []


def test_wrapped_headers_and_full_licences(spark):
    mit, bsd2 = dict(TEXTS)["MIT"], dict(TEXTS)["BSD-2-Clause"]
    files = [
        ("m/LICENSE", f"Copyright (c) 2020 Jo Doe\n\n{textwrap.fill(mit, 72)}"), ("b/LICENSE", f"Copyright 2021, Jo Doe\n\n{textwrap.fill(bsd2, 40)}"), ("g/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Everyone is permitted to copy"),
        ("a.c", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\nint x;"),
        ("b.c", "// SPDX-License-Identifier: MIT\nint x;"), ("c.c", "# SPDX-License-Identifier: LGPL-2.1-or-later"), ("d.c", "a free licence\nto drive cars\nin the city"),
    ]
    got = {r["path"]: r["license"] for r in scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"m/LICENSE": "MIT", "b/LICENSE": "BSD-2-Clause", "g/COPYING": "GPL-3.0", "a.c": "MPL-2.0", "b.c": "MIT", "c.c": "LGPL-2.1", "d.c": None}


def test_licences_in_texts_of_many_lines(spark):
    header = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."
    many = [f"line {i} of a log" if i % 10 else f"copyright check {i}" for i in range(100_000)]
    files = [("a.log", "\n".join(many)), ("b.log", "\n".join([*many, header, *many])), ("c.log", "\n" * 200_000)]
    start = time.perf_counter()
    got = {r["path"]: r["license"] for r in scan_licenses(spark.createDataFrame(files, "path string, text string")).collect()}
    assert got == {"a.log": None, "b.log": "MPL-2.0", "c.log": None}
    assert time.perf_counter() - start < 120


def test_pipeline_stages(spark, tmp_path, model):
    rows = [(i, f"{ENGLISH} number {i} {' '.join(str(j * i) for j in range(1, 40))}", "en", "s", 1, "x") for i in range(12)]
    rows += [(20, rows[3][1] + " more", "en", "s", 1, "x"), (21, "12345", "en", "s", 1, "x"), (22, None, None, None, None, None), (23, ENGLISH + " mail me at jo.1@mail3.example.com", "en", "t", 2, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[5][1][-60:])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in schema.split(", ")] + (["taken"] if k == 4 else [])
        kept.append({r["doc_id"]: r for r in docs.collect()})
        assert stage(spark, spark.createDataFrame([], schema), str(tmp_path)).collect() == []
    everything = {r[0] for r in rows}
    assert set(kept[0]) == everything - {21, 22} and set(kept[1]) == everything - {20, 21, 22} and set(kept[2]) == set(kept[1]) - {5}
    assert set(kept[3]) == set(kept[2]) and "jo.1@" not in kept[3][23]["text"] and kept[3][23]["n_chars"] == len(kept[3][23]["text"])
    assert kept[3][1]["text"] == rows[1][1] and all(r["taken"] > 0 for r in kept[4].values())
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept[4])
