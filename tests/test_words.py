"""Words set right by the dictionary, words known by affix rules, and word differences."""

import random

import pytest

from folio.operators import affixes, cleanup, lexicon
from folio.sources import hunspell


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_neighbours_against_all_pairs(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choices("abčd'", k=n))
    forms = sorted({word(rng.randint(1, 8)) for _ in range(300)})
    asked = sorted({word(rng.randint(0, 9)) for _ in range(300)} | {"", "a" * 200, "ab" * 3000})
    words = spark.createDataFrame([(lang, w) for lang in ("cs", "xx") for w in asked], "lang string, word string")
    dictionary = spark.createDataFrame([("cs", f) for f in forms] + [("en", "ab")], "lang string, form string")
    for radius in (0, 1, 2):
        got = {(r.word, r.form): r.distance for r in cleanup.neighbours(words, dictionary, radius).collect()}
        assert got == {(w, f): d for w in asked if len(w) < 20 for f in forms if (d := plain_distance(w, f)) <= radius}


def test_a_common_string_is_no_list_of_pairs(spark):
    """Words that leave a common string but differ in more letters aren't neighbours, and none is lost among many."""
    forms = [f"x{a}{b}yz" for a in "abcdefghij" for b in "abcdefghij"]
    words = spark.createDataFrame([("en", w) for w in ("xyz", "xabyz", "xaqyz", "qqxyz")], "lang string, word string")
    dictionary = spark.createDataFrame([("en", f) for f in forms], "lang string, form string")
    got = {}
    for r in cleanup.neighbours(words, dictionary).collect():
        got.setdefault(r.word, set()).add(r.form)
    assert got == {w: {f for f in forms if plain_distance(w, f) <= 2} for w in ("xyz", "xabyz", "xaqyz")} | ({"qqxyz": x} if (x := {f for f in forms if plain_distance("qqxyz", f) <= 2}) else {})


def test_corrections(spark):
    words = [("en", w) for w in ("houze", "Houze", "HOUZE", "house", "hoooouse", "streem", "wzter", "cat", "ct", "zzzzzz", "watre", "it’z", "Pragu")] + [("de", "houze")]
    dictionary = spark.createDataFrame([("en", f) for f in ("house", "stream", "street", "water", "cut", "it's", "Prague")], "lang string, form string")
    got = {(r.lang, r.word): (r.new, r.distance) for r in cleanup.corrections(spark.createDataFrame(words, "lang string, word string"), dictionary).collect()}
    # `streem` has two forms one edit away; `ct` may change by one edit only
    assert got == {
        ("en", "houze"): ("house", 1), ("en", "Houze"): ("House", 1), ("en", "HOUZE"): ("HOUSE", 1), ("en", "wzter"): ("water", 1), ("en", "cat"): ("cut", 1), ("en", "ct"): ("cut", 1),
        ("en", "watre"): ("water", 2), ("en", "it’z"): ("it's", 1), ("en", "Pragu"): ("Prague", 1),
    }


def test_cleaned_blocks(spark):
    flag = lambda kind, a, b, original, note: (kind, a, b, original, note)
    unknown = "not in the dictionary"
    rows = [
        (1, 0, 0, "en", "The houze by a wzter, zzzz", [flag("suspicious", 4, 9, "houze", unknown), flag("repaired", 10, 12, "bi", "x"), flag("suspicious", 15, 20, "wzter", unknown), flag("suspicious", 22, 26, "zzzz", unknown)]),
        (1, 0, 1, "en", "houze", []),
        (1, 0, 2, "en", "houze", [flag("foreign_letter", 0, 5, "houze", "y")]),
        (2, 0, 0, "de", "houze", [flag("suspicious", 0, 5, "houze", unknown)]),
    ]
    blocks = spark.createDataFrame(rows, "doc_id int, page_index int, block_no int, lang string, text string, flags array<struct<kind:string,start:int,end:int,original:string,note:string>>")
    dictionary = spark.createDataFrame([("en", f) for f in ("the", "house", "by", "a", "water")], "lang string, form string")
    got = {(r.doc_id, r.block_no): (r.text, [tuple(f) for f in r.flags]) for r in cleanup.cleaned(blocks, dictionary).collect()}
    assert got[1, 0] == ("The house by a water, zzzz", [("repaired", 4, 9, "houze", cleanup.CLEANED), ("repaired", 10, 12, "bi", "x"), ("repaired", 15, 20, "wzter", cleanup.CLEANED), ("suspicious", 22, 26, "zzzz", unknown)])
    assert all(got[k] == (r[4], r[5]) for k, r in zip(((1, 1), (1, 2), (2, 0)), rows[1:], strict=True))
    own = {r.block_no: r.text for r in cleanup.cleaned(blocks, dictionary, ["Houze"]).where("doc_id = 1").collect()}
    assert own[0] == "The houze by a water, zzzz"


AFF = """SET UTF-8
FLAG {style}
NEEDAFFIX {N}
FORBIDDENWORD {F}
ONLYINCOMPOUND {O}
COMPOUNDFLAG {C}
COMPOUNDBEGIN {B}
COMPOUNDEND {Z}
COMPOUNDMIN 2
PFX {U} Y 1
PFX {U} 0 un/{V} .
SFX {S} Y 2
SFX {S} 0 s/{G} [^sy]
SFX {S} y ies [^aeiou]y
SFX {V} Y 1
SFX {V} 0 en .
SFX {G} Y 1
SFX {G} 0 's .
SFX {Q} N 1
SFX {Q} 0 qu/{N}{comma}{G} .
"""
NAMES = "NFOCBZUSVGQ"
STYLES = {"UTF-8": {c: c for c in NAMES}, "long": {c: c + c.lower() for c in NAMES}, "num": {c: str(100 + ord(c)) for c in NAMES}}


def written(folder, name, stems, style="UTF-8", coding="UTF-8"):
    """A dictionary's two files; flags are letters here and written in the style."""
    flags = STYLES[style]
    comma = "," if style == "num" else ""
    (folder / f"{name}.aff").write_bytes(AFF.format(style=style, comma=comma, **flags).replace("UTF-8", coding, 1).encode(coding))
    lines = [f"{w}/{comma.join(flags[c] for c in f)}" if f else w for w, f in stems]
    (folder / f"{name}.dic").write_bytes(("\n".join([str(len(lines)), *lines]) + "\n").encode(coding))


def asked_of(spark, lang, words):
    return spark.createDataFrame([(lang, w) for w in words], "lang string, word string")


def test_affixes(spark, tmp_path):
    stems = [("do", "US"), ("fly", "S"), ("play", "SQ"), ("may", "U"), ("bad", "F"), ("bads", "C"), ("foot", "C"), ("ball", "CS"), ("haus", "B"), ("boot", "Z"), ("gar", "N"), ("garn", "NS"), ("inn", "O"), ("inner", "OC"), ("město", "C")]
    written(tmp_path, "xx", stems)
    dictionary = hunspell.read_dictionary(spark, str(tmp_path), "en=xx,cs=missing")
    yes = ["do", "dos", "dos's", "undo", "undos", "undoen", "undos's", "fly", "flies", "play", "unmay", "unmayen", "bads", "football", "footballs", "footballs's", "ballfoot", "hausboot", "hausball", "footboot", "garns", "footinnerball", "mě" + "sto", "městofoot", "play" + "qu's", "footfootfootball"]
    no = ["doss", "flys", "plays", "unfly", "doen", "bad", "boothaus", "footbad", "gar", "garn", "inn", "inner", "undoball", "ballsfoot", "playqu", "foo", "footx", "unfootball", "xfoot", "", "s", "un", "en", "footinner"[:4] + "inn"]
    got = {r.word for r in affixes.recognised(asked_of(spark, "en", yes + no), dictionary).collect()}
    assert got == set(yes)
    assert affixes.recognised(asked_of(spark, "cs", yes), dictionary).count() == 0


def test_parts_of_compounds_are_not_written(spark, tmp_path, monkeypatch):
    """A word of 80 letters has some thousand parts, of which only those at places that parts reach are looked up; stems go in blocks."""
    from pathlib import Path

    written(tmp_path, "xx", [("foot", "C"), ("ball", "CS"), ("ball" * 3, "C"), ("haus", "B"), ("boot", "Z")])
    dictionary = hunspell.read_dictionary(spark, str(tmp_path), "en=xx")
    rng = random.Random(3)
    no = ["".join(rng.choices("cdeghijk", k=80)) for _ in range(300)]
    yes = ["foot" * 20, "footballs", "haus" + "ball" * 19, "ball" * 18 + "boot"]
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    before = size()
    assert {r.word for r in affixes.recognised(asked_of(spark, "en", yes + no), dictionary).collect()} == set(yes)
    assert size() - before < 1_000_000
    monkeypatch.setattr(affixes, "STEMS", 2)
    assert {r.word for r in affixes.recognised(asked_of(spark, "en", yes + no[:5]), dictionary).collect()} == set(yes)


def test_known_by_affixes(spark, tmp_path):
    written(tmp_path, "xx", [("buď", ""), ("Praha", ""), ("česko", ""), ("slovenský", "S"), ("it's", "")])
    dictionary = hunspell.read_dictionary(spark, str(tmp_path), "cs=xx")
    asked = ["Buď", "BUĎ", "praha", "PRAHA", "česko-slovenský", "Česko-x", "slovenskýs", "it’s", "zzz"]
    got = {r.word: (r.known, r.strict) for r in affixes.known(asked_of(spark, "cs", asked).unionByName(asked_of(spark, "de", ["w"])), dictionary).collect()}
    assert got.pop("w") == (True, False)
    assert {w for w, (known, strict) in got.items() if known} == {"Buď", "BUĎ", "PRAHA", "česko-slovenský", "slovenskýs", "it’s"} and all(a == b for a, b in got.values())
    # a dictionary that knows none of the words is a dictionary all the same
    assert [(r.known, r.strict) for r in affixes.known(asked_of(spark, "cs", ["zzz"]), dictionary).collect()] == [(False, False)]


@pytest.mark.parametrize("style", ["UTF-8", "long", "num"])
def test_recognition_and_written_forms_agree(spark, tmp_path, style):
    """All forms that the rules make of random stems, and slips of them, are judged as the list of forms says."""
    rng = random.Random(6)
    stems = [("".join(rng.choices("abesy", k=rng.randint(2, 5))), "".join(sorted(set(rng.choices("NFOUSVGQ", k=rng.randint(0, 4)))))) for _ in range(60)]
    written(tmp_path, "xx", stems, style, "ISO8859-2")
    dictionary = hunspell.read_dictionary(spark, str(tmp_path), "en=xx", part_bytes=64)
    read = hunspell.read_affixes((tmp_path / "xx.aff").read_text("ISO8859-2"))
    flags = STYLES[style]
    banned = {w for w, f in stems if "F" in f}
    listed = set().union(*(hunspell.expand(w, [flags[c] for c in f], read) for w, f in stems if "F" not in f))
    # a form of a forbidden stem is unknown even if another stem makes it
    never = set().union(*(hunspell.expand(w, [flags[c] for c in f if c not in "FNO"], read) for w, f in stems if w in banned))
    open_ = {w for w in listed if not any(w.startswith(b) or b in w for b in banned)}
    slips = {w[:i] + c + w[i:] for w in sorted(listed)[:150] for i in (0, len(w)) for c in "sn"} - listed - never
    asked = sorted(listed | slips | {w for w, _ in stems})
    got = {r.word for r in affixes.recognised(asked_of(spark, "en", asked), dictionary).collect()}
    assert open_ <= got <= listed and not got & slips
    forms = spark.read.format("hunspell").option("path", str(tmp_path)).option("names", "en=xx").option("part_bytes", 50).load()
    assert {r.form for r in forms.collect()} == listed


def test_dictionary_files_in_parts(spark, tmp_path):
    """Every line is read once, wherever the parts are cut."""
    stems = [(f"w{i}" + "ž" * (i % 7), "S" if i % 3 else "") for i in range(200)]
    written(tmp_path, "xx", stems)
    (tmp_path / "xx.dic").write_bytes((tmp_path / "xx.dic").read_bytes().rstrip(b"\n"))
    spark.dataSource.register(hunspell.HunspellSource)
    for size in (1, 7, 64, 1000, 1 << 20):
        rows = spark.read.format("hunspell").option("path", str(tmp_path)).option("names", "en=xx").option("rows", "stems").option("part_bytes", size).load().collect()
        assert sorted((r.stem, "".join(r.flags)) for r in rows) == sorted(stems)


def test_dictionary_entries():
    read = hunspell.read_affixes("AF 2\nAF AB\nAF C\nSFX A Y 1\nSFX A 0 s/2 [^a-c.]\n")
    assert read.flags("1") == ["A", "B"] and read.flags("2") == ["C"] and read.flags("9") == []
    assert read.rules["A"][0].more == ["C"] and read.rules["A"][0].condition == "[^a\\-c\\.]"
    assert hunspell.read_stem("km\\/h/1 po:noun\tx", read) == ("km/h", ["A", "B"]) and hunspell.read_stem(" \t", read) is None
    assert hunspell.condition("a[bc].(") == "a[bc].\\("


def test_free_places_against_a_plain_loop(spark):
    rng = random.Random(9)
    span = lambda: (lambda a: (a, a + rng.randint(0, 6)))(rng.randint(0, 60))
    places = [(b, 0, 0, *s, "w") for b in range(40) for s in sorted({span() for _ in range(rng.randint(0, 12))}) if s[0] < s[1]]
    taken = [(b, 0, 0, *span(), "x") for b in range(40) for _ in range(rng.randint(0, 5))]
    names = "doc_id int, page_index int, block_no int, start int, end int, word string"
    got = lexicon.apart_from(spark.createDataFrame(places, names), spark.createDataFrame(taken, names))
    assert got.columns == ["doc_id", "page_index", "block_no", "start", "end", "word"]
    assert sorted(map(tuple, got.collect())) == sorted(p for p in places if not any(t[0] == p[0] and t[3] < p[4] and p[3] < t[4] for t in taken))


def test_one_block_of_very_many_flags(spark):
    places = spark.range(100_000).selectExpr("1 AS doc_id", "0 AS page_index", "0 AS block_no", "CAST(id * 10 AS int) AS start", "CAST(id * 10 + 5 AS int) AS end")
    taken = places.where("start % 20 = 0").selectExpr("doc_id", "page_index", "block_no", "start + 4 AS start", "start + 12 AS end")
    assert lexicon.apart_from(places, taken).count() == 0
    assert lexicon.apart_from(places, taken.where("start % 40 = 4")).count() == 50_000
