import os

import pytest

from folio.llm import license_scan as s
from folio.llm import queries

MIT = s.KNOWN["MIT"]
NAMES = "doc_id long, text string, digest string, license_id string, __digest int"


def scan(spark, texts):
    rows = [(i, t, "d", "l", 1) for i, t in enumerate(texts)]
    return {r.doc_id: r for r in s.scan(spark.createDataFrame(rows, NAMES), s.known_licenses(spark), out="found").collect()}


def test_variants_of_one_text(spark):
    variants = ["MIT License\n\nCopyright (c) 2020 X\n\n" + MIT, "The MIT License (MIT)\r\n\r\n© 2020 Y. Z. and others\r\n" + MIT, "Copyright (c) 2020 X. " + MIT, "Copyright 2020 A. Person. " + MIT, "(c) 2020 Some Firm Inc. All rights reserved. " + MIT, MIT, MIT.upper(), "Copyright (c) 2020 A. Person\n\n" + MIT.replace(". ", ".\n"), "(C) 1999-2003 X\n" + MIT.replace(",", " ,"), MIT.replace("sublicense", "sub-license"), MIT.replace("COPYRIGHT HOLDERS", "COPYRIGHT OWNERS")]
    assert [r.found.license_id for r in scan(spark, variants).values()] == ["MIT"] * len(variants)


def test_other_texts(spark):
    got = scan(spark, [MIT + " more", MIT[:-9], "licence", None, "", " \n!?", s.KNOWN["ISC"], "x " * 50_000])
    assert [got[i].found.license_id for i in range(8)] == [None] * 6 + ["ISC", None]
    assert [got[i].found.digest is None for i in range(8)] == [False] * 3 + [True] * 3 + [False] * 2
    assert got[0].digest == "d" and got[0].license_id == "l"


def test_ties_empty_tables_and_shuffled_join(spark, odd, none, monkeypatch):
    known = s.digests(spark.createDataFrame([("b", "Some Licence"), ("a", "some LICENSE!"), ("c", None), ("d", "??")], "license_id string, text string"))
    docs = spark.createDataFrame([(1, "some license"), (1, "some license")], "doc_id long, text string")
    assert [r.license.license_id for r in s.scan(docs, known).collect()] == ["a", "a"]
    monkeypatch.setattr(s, "BROADCAST_ROWS", 0)
    assert [r.license.license_id for r in s.scan(docs, known).collect()] == ["a", "a"]
    assert s.scan(none, known).count() == 0 and s.scan(odd, known.limit(0)).count() == odd.count()


def test_every_known_licence_finds_itself(spark):
    assert [r.found.license_id for _, r in sorted(scan(spark, s.KNOWN.values()).items())] == list(s.KNOWN)


def test_whole_words_only(spark):
    """Spellings count within words nowhere, and for words side by side."""
    pairs = [("upper cent", "uppercent"), ("super center", "supercenter"), ("licenced", "licensed"), ("favour favour favour", "favor favor favor"), ("a labour per cent", "a labor percent")]
    got = scan(spark, [t for p in pairs for t in p])
    assert [got[2 * i].found.digest == got[2 * i + 1].found.digest for i in range(len(pairs))] == [False, False, False, True, True]


FOLDER = "/usr/share/common-licenses"
FILES = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0", "GPL-1.0": "GPL-1", "LGPL-2.0": "LGPL-2", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "Artistic-1.0-Perl": "Artistic"}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the licences' texts aren't installed")
def test_longer_licences(spark):
    assert FILES.keys() == s.KNOWN_DIGESTS.keys()
    texts = [open(f"{FOLDER}/{f}").read() for f in FILES.values()]
    assert [r.found.license_id for _, r in sorted(scan(spark, texts).items())] == list(FILES)
    assert [r.found.license_id for _, r in sorted(scan(spark, [t.upper().replace("\n", "\r\n") for t in texts]).items())] == list(FILES)


def test_the_query_finds_its_licence_files(spark):
    found = queries.op8_license_scan(spark, "/root/testdata/sf0.001").where("doc_id < 0").collect()
    assert [r.license_id for r in sorted(found, key=lambda r: -r.doc_id)] == list(s.KNOWN)
