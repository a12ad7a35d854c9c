import hashlib
import textwrap

from pyspark.sql import functions as F

from glintsieve.llm import licenses


def test_canonical_texts_match(spark):
    mit = licenses.KNOWN[0][1]
    texts = [
        f"MIT License\n\nCopyright (c) 2020 Some One\n\n{mit}", mit.upper().replace(",", " ;"), "  (C) 1999 Me. All rights reserved.\n" + mit.replace("sublicense", "sub-license").replace("NONINFRINGEMENT", "Non-Infringement"),
        mit + " And more.", mit[:-40], None, "", "Copyright 2001 X", licenses.KNOWN[5][1], "...",
    ]
    docs = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts + texts[:1])] + [(None, mit, None)], "doc_id long, text string, license_id string")
    known = spark.createDataFrame([*licenses.KNOWN, ("ZZZ", mit), ("none", None), (None, "x")], "license_id string, text string")
    got = sorted(licenses.scan_licenses(docs, known).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0))
    assert [r.license_id for r in got] == ["MIT", "MIT", "MIT", None, None, None, None, None, "0BSD", None, "MIT", "MIT"]
    assert [r.canonical_sha256 is None for r in got] == [False] * 5 + [True] * 3 + [False, True, False, False]
    assert licenses.scan_licenses(docs.where("false"), known).collect() == []
    assert {r.license_id for r in licenses.scan_licenses(docs, known.where("false")).collect()} == {None}


def test_digest_is_of_the_canonical_form(spark):
    row = spark.range(1).select(licenses.canonical(F.lit("A  Licence & B!\n© X\nÉnd")).alias("c"), licenses.digest(F.lit("A  Licence & B!\n© X\nÉnd")).alias("d")).first()
    assert row.c == "a license and b énd" and row.d == hashlib.sha256(row.c.encode()).hexdigest()


def test_wrapped_texts_match(spark):
    texts = []
    for width in range(40, 100):
        texts += [(name, "\n\n".join(textwrap.fill(p, width) for p in f"Copyright (c) 2020, Some One\n\n{text}".split("\n\n"))) for name, text in licenses.KNOWN]
    # As it is published.
    isc = "ISC License\n\nCopyright (c) 2004-2010 by Some Consortium\nCopyright Some One\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n\n"
    texts.append(("ISC", isc + textwrap.fill(licenses.KNOWN[3][1].split("\n\n")[1], 72)))
    assert any(line.startswith("copyright notice") for _, t in texts for line in t.split("\n")) and any(line.startswith("COPYRIGHT HOLDERS") for _, t in texts for line in t.split("\n"))
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    known = spark.createDataFrame(licenses.KNOWN, "license_id string, text string")
    got = {r.doc_id: r.license_id for r in licenses.scan_licenses(docs, known).collect()}
    assert [got[i] for i in range(len(texts))] == [name for name, _ in texts]
