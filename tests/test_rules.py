"""Literal cases of the rules, plain loops where SQL can't follow, and texts with characters for private use."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from folio.functions import python, text
from folio.functions.lineage import shared_folder
from folio.operators import cleanup, edits, guards, integrity, jobs, layout, lexicon, parse, render, repair, score
from folio.operators.process import process, records

FLAGS = "array<struct<kind:string,start:int,end:int,original:string,note:string>>"
#: Characters for private use and beside the last one of the basic plane; all may stand in texts.
ODD = ["\ue000", "\ue001", "\uf8ff", "\ufffd"]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def dictionary(spark, lang, *forms):
    return table(spark, [(lang, f) for f in forms], "lang string, form string")


def blocks(spark, texts, lang="cs", label="text"):
    rows = [(i, 0, 0, label, lang, t) for i, t in enumerate(texts)]
    return table(spark, rows, "doc_id int, page_index int, block_no int, label string, lang string, text string")


def test_markup_forms(spark):
    pages = [
        ("plain", "just text"), ("lead", "before <|det|>title [1, 2, 3, 4]<|/det|>A"), ("order", "<|det|>text [900, 1200, 100, -5]<|/det|>x"),
        ("old", "<|ref|>Text<|/ref|><|det|>[[10, 20, 30, 40],[5, 50, 60, 70]]<|/det|> body<|end|>"), ("unknown", "<|det|>seal [1, 2, 3, 4]<|/det|>s"), ("blank", "<|det|>image [0, 0, 999, 999]<|/det|>"), ("empty", "  "), ("null", None),
    ]
    got = parse.parse_raw(table(spark, pages, "page string, raw string")).select("page", "block_no", "label", "box.*", "text").collect()
    assert {tuple(r) for r in got} == {
        ("plain", 0, "text", None, None, None, None, "just text"), ("lead", 0, "text", None, None, None, None, "before"), ("lead", 1, "title", 1, 2, 3, 4, "A"),
        ("order", 0, "text", 100, 0, 900, 999, "x"), ("old", 0, "text", 5, 20, 60, 70, "body"), ("unknown", 0, "text", 1, 2, 3, 4, "s"), ("blank", 0, "image", 0, 0, 999, 999, ""),
    }


@pytest.mark.parametrize("odd", ODD)
def test_private_characters_in_markup(spark, odd):
    raw = f"{odd}lead{odd}<|det|>title [1, 2, 3, 4]<|/det|>A{odd}{odd}B<|det|>text [1, 2, 3, 4]<|/det|>{odd}"
    got = parse.parse_raw(table(spark, [(1, raw)], "page int, raw string")).orderBy("block_no").collect()
    assert [(r.label, r.text) for r in got] == [("text", f"{odd}lead{odd}"), ("title", f"A{odd}{odd}B"), ("text", odd)]


@pytest.mark.parametrize("odd", ODD)
def test_private_characters_between_matches(spark, odd):
    given = f"{odd}a,,b{odd}{odd}ﬁ{odd} - x - y{odd},,"
    row = table(spark, [(given,)], "t string").select(text.matches(F.col("t"), ",,|ﬁ").alias("m"), repair.character_edits(F.col("t")).alias("e")).first()
    assert "".join(row.m) == given and row.m[1::2] == [",,", "ﬁ", ",,"]
    assert [given[e.start : e.end] for e in row.e] == [",,", "ﬁ", " - ", ",,"] and [e.new for e in row.e] == ["„", "fi", " – ", "„"]


@pytest.mark.parametrize("odd", ODD)
def test_private_characters_in_repairs_and_joins(spark, odd):
    words = dictionary(spark, "cs", "teď", "slovo")
    given = blocks(spark, [f"{odd}ted{odd},, slo-\nvo{odd} neco-\ndal{odd}"]).withColumn("flags", F.array().cast(FLAGS))
    joined = layout.dehyphenate(given, words).first()
    assert joined.text == f"{odd}ted{odd},, slovo{odd} necodal{odd}" and (joined.joined, joined.guessed) == (2, 1)
    for f in joined.flags:
        assert joined.text[f.start : f.end] in ("slovo", "necodal")
    assert [f.kind for f in joined.flags] == ["repaired", "repaired", "suspicious"] and joined.flags[2].original == "necodal"
    done = repair.repair(given, words).first()
    assert done.text == f"{odd}teď{odd}„ slo-\nvo{odd} neco-\ndal{odd}"
    assert sorted(done.text[f.start : f.end] for f in done.flags) == ["teď", "„"]


def test_joins_move_old_flags_and_need_a_dictionary(spark):
    rows = [(0, 0, 0, "text", "en", "wo-\nrd baad well-\nknown", [("suspicious", 7, 11, "baad", "")]), (1, 0, 0, "text", "xx", "wo-\nrd", []), (2, 0, 0, "table", "en", "wo-\nrd", [])]
    given = table(spark, rows, f"doc_id int, page_index int, block_no int, label string, lang string, text string, flags {FLAGS}")
    got = {r.doc_id: r for r in layout.dehyphenate(given, dictionary(spark, "en", "word", "well", "known")).collect()}
    assert got[0].text == "word baad well-\nknown" and [(f.start, f.end) for f in got[0].flags] == [(0, 4), (5, 9)]
    assert got[1].text == got[2].text == "wo-\nrd" and got[1].joined == 0


def test_text_layers(spark):
    rows = [(1, "a\r\nb\rc"), (2, "soft￾hyphen"), (3, "  \u00a0 "), (4, "bell\x07 and \uffff end\u2003"), (5, None)]
    got = table(spark, rows, "id int, t string").select("id", text.text_layer(F.col("t")).alias("o")).collect()
    assert {r.id: r.o for r in got} == {1: "a\nb\nc", 2: "soft-\nhyphen", 3: None, 4: "bell and  end", 5: None}


def test_language_votes_and_ties(spark):
    rows = [(0, 0.9, 0.5), (1, 0.5, 0.9), (2, 0.5, 0.5), (3, None, 0.7), (4, None, 0.4), (5, 0.6, None), (6, 0.4, None), (7, None, None)]
    got = table(spark, rows, "id int, cs double, en double").select("id", lexicon.vote(F.col("cs"), F.col("en")).alias("v")).collect()
    assert [r.v for r in sorted(got)] == ["cs", "en", "cs", "en", "cs", "cs", "en", "cs"]
    for order in (["de", "da", "db"], ["db", "da", "de"]):
        rates = table(spark, [(1, lang, 0.5) for lang in order] + [(1, "zz", None)], "k int, lang string, rate double")
        assert lexicon.best_language(rates, ["k"]).first().language == "da"


def test_soft_and_look_alike_letters(spark):
    words = dictionary(spark, "cs", "žena", "buď", "loď", "teď", "ňadra", "země", "plat", "nový", "bud", "říká", "město", "děti", "tělo")
    asked = lambda *w: table(spark, [("cs", x) for x in w], "lang string, word string")
    told = lambda df: {r.word: r.new for r in df.collect()}
    assert told(repair.marked_soft_words(asked("bud'", "lod’", "plat'", "xyzd'"), words)) == {"bud'": "buď", "lod’": "loď"}
    assert told(repair.plain_soft_words(asked("ted", "lod", "plat", "bud", "tdx"), words)) == {"ted": "teď", "lod": "loď"}
    assert told(repair.foreign_words(asked("żena", "zemę", "über", "plat", "říkà"), words)) == {"żena": "žena", "zemę": "země", "über": None, "říkà": "říká"}
    given = blocks(spark, ["teď lod", "żena - bud'", "ümlaut"]).withColumn("flags", F.array().cast(FLAGS))
    assert {r.text: len(r.flags) for r in repair.repair(given, words).collect()} == {"teď loď": 1, "žena – buď": 3, "ümlaut": 1}


TABLES = [
    ("<table><tr><td>a &amp; b</td><td>x<br>y</td></tr></table>", "a & b\tx y", "| a & b | x y |\n|---|---|", "a & b x y"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1\t2\n3", "| 1 | 2 |\n|---|---|\n| 3 |  |", "1 2\n3"),
    ('<table><tr><td colspan="2">w</td></tr><tr><td>a</td><td>b</td></tr></table>', "w\na\tb", None, "w\na b"),
    ("no table", "no table", "no table", "no table"),
    ("<table><tr><th>a|b</th></tr><tr><td>c</td><td>d</td></tr></table>", "a|b\nc\td", "| a\\|b |  |\n|---|---|\n| c | d |", "a|b\nc d"),
    ("<table><!-- <td>no</td> --><tr><td title='a>b'>q</td></tr></table>", "q", "| q |\n|---|", "q"),
]


def test_table_forms(spark):
    html = F.col("h")
    rows = table(spark, [(i, t[0]) for i, t in enumerate(TABLES)], "id int, h string")
    got = rows.select("id", parse.table_text(html).alias("tsv"), render.markdown_table(html).alias("md"), F.array_join(parse.block_lines(F.lit("table"), html), "\n").alias("lines")).collect()
    for r in got:
        h, tsv, md, lines = TABLES[r.id]
        assert (r.tsv, r.md, r.lines) == (tsv, h if md is None else md, lines)


def test_accents_and_confusions(spark):
    pairs = table(spark, [("Příliš žluťoučký kůň", "Prilis žluťoučký kůň"), ("dítě", "dit"), ("kůň", "kůň!"), ("řeka", "reka"), ("", "x")], "truth string, reading string")
    scored = score.scores(pairs)
    assert {(r.confusion, r.n) for r in score.confusions(scored).collect()} == {("ř→r", 2), ("í→i", 2), ("ě→∅", 1), ("š→s", 1)}
    first = scored.where("reading LIKE 'Prilis%'").first()
    assert (first.accents.total, first.accents.right, first.cer) == (9, 6, 0.15)


def cheapest(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(left[j - 1] + (x != y), left[j] + 1, row[-1] + 1))
    return row[-1]


def test_distances_beyond_every_band(spark):
    rng = random.Random(2)
    words = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    rows = [(i, words(n), words(m)) for i, (n, m) in enumerate([(0, 0), (0, 5), (9, 9), (40, 30), (120, 130), (200, 90)])]
    rows += [(100 + i, t, t[: i * 3] + "~" * i + t[i * 4 :]) for i, t in ((k, words(300)) for k in (0, 1, 7, 8, 9, 60, 70))]
    got = table(spark, rows, "id int, a string, b string").select("id", score.distance(F.col("a"), F.col("b")).alias("d")).collect()
    assert {r.id: r.d for r in got} == {i: cheapest(a, b) for i, a, b in rows}


@pytest.mark.parametrize("cells", [python.ALIGNED_CELLS, 30])
def test_alignments_are_cheapest(monkeypatch, cells):
    monkeypatch.setattr(python, "ALIGNED_CELLS", cells)
    rng = random.Random(4)
    for _ in range(200):
        a, b = ("".join(rng.choices("aáb😀", k=rng.randint(0, 13))) for _ in range(2))
        pairs = python.aligned(a, b)
        kept = [y for _, y in pairs if y is not None]
        assert "".join(x for x, _ in pairs) == a and len(kept) <= len(b)
        assert sum(y is None for _, y in pairs) + len(b) - len(kept) + sum(y is not None and x != y for x, y in pairs) == cheapest(a, b)


def test_long_alignments_are_bounded():
    a = "".join(random.Random(1).choices("abcdéf ", k=9000))
    told = python.accents(a, a.replace("é", "e") + "tail")
    assert told["total"] == a.count("é") and told["right"] <= told["total"]


def test_paths_closures_and_names(spark):
    paths = {"a/b.txt": True, "/a": False, "C:x": False, "a\\..\\b": False, "..": False, "a..b/c": True, "\\\\host\\x": False, "": False}
    got = table(spark, [(p,) for p in paths], "path string").select("path", integrity.is_safe(F.col("path")).alias("safe")).collect()
    assert {r.path: r.safe for r in got} == paths
    edges = table(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "b"), ("e", "e"), ("x", "y"), ("d", None)], "name string, needs string")
    for roots, want in ((["a"], "abcd"), (["e"], "e"), (["e", "x"], "exy"), (["q"], "q")):
        assert sorted(r.name for r in integrity.closure(edges, table(spark, [(x,) for x in roots], "name string")).collect()) == sorted(want)
    assert not spark.catalog.listTables()


@pytest.mark.parametrize("size", [1 << 20, 7])
def test_passages_anywhere(spark, size):
    """One automaton for all items, and one for each few of them."""
    items = ['passage "of" words that go on for long', "short", "é", "", "a\nb", "of", "passage", "short", None]
    texts = ['("' + items[0] + '")', "xshorty", "caf\u00e9", "-" + items[0], "\t" + items[0] + "\r", "a\nb", "nothing", "", None]
    docs = table(spark, list(enumerate(texts)), "doc_id int, text string")
    got = score.passages(docs, table(spark, list(enumerate(items)), "item_id int, text string"), size)
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(d, i) for d, t in enumerate(texts) for i, x in enumerate(items) if x and t and x in t}
    assert score.passages(docs, table(spark, [], "item_id int, text string")).count() == 0


def wrapped(line, count):
    words, out, now = line.split(), [], ""
    if count <= 1 or len(words) <= 1:
        return [line]
    for w in words:
        longer = f"{now} {w}" if now else w
        if now and len(longer) > len(line) / count and len(out) < count - 1:
            out.append(now)
            now = w
        else:
            now = longer
    return [*out, now]


def test_wrapped_lines(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("x" * rng.randint(1, 9) for _ in range(rng.randint(1, 12))), rng.randint(1, 5)) for i in range(200)]
    got = table(spark, rows, "id int, t string, n int").select("id", render.wrap_line(F.col("t"), F.col("n")).alias("l")).collect()
    assert {r.id: r.l for r in got} == {i: wrapped(t, n) for i, t, n in rows}


def test_pdf_lines(spark):
    rng = random.Random(9)
    rows = [(i, 0, 0, "text", (50, 100, 50 + rng.randint(1, 900), 100 + rng.randint(1, 400)), " ".join("w" * rng.randint(1, 8) for _ in range(rng.randint(1, 60))), 595.0, 842.0) for i in range(60)]
    given = table(spark, rows, "doc_id int, page_index int, block_no int, label string, box struct<x1:int,y1:int,x2:int,y2:int>, text string, width_pt double, height_pt double")
    got = {}
    for r in render.pdf_text_plan(given).orderBy("doc_id", "line").collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, _, _, _, (x1, y1, x2, y2), t, width, height in rows:
        w, h = max((x2 - x1) / 999 * width, 1.0), max((y2 - y1) / 999 * height, 1.0)
        guess = (w * h / (max(len(t), 1) * 0.6)) ** 0.5
        lines = wrapped(t, max(1, min(round(h / (guess * 1.2)), len(t.split()))))
        size = max(1.0, min(h / (len(lines) * 1.2), 400.0))
        assert [r.text for r in got[i]] == lines
        for k, r in enumerate(got[i]):
            assert abs(r.size - size) < 1e-9 and abs(r.x - x1 / 999 * width) < 1e-9 and abs(r.y - (height - y1 / 999 * height - h * (k + 1) / len(lines) + 0.2 * size)) < 1e-6


def test_processed_pages(spark):
    """A recognised page, a text layer, a page that loops and a blank one."""
    words = dictionary(spark, "cs", "žena", "buď", "plat", "nový", "je", "doma").unionByName(dictionary(spark, "en", "house", "stands", "here", "the"))
    read = [
        (1, 0, "ocr", None, "<|det|>text [10, 200, 900, 240]<|/det|>żena je doma, ted bud' plat<|det|>header [10, 10, 900, 40]<|/det|>Hlava", False),
        (1, 1, "text_layer", "the house\n\nstands heer", None, False), (1, 2, "ocr", None, "la " * 3000, False), (1, 3, "blank", None, None, False),
    ]
    kind = "doc_id int, page_index int, source string, layer string, raw string, hit_token_cap boolean"
    done, flags, pages = process(table(spark, read, kind), words)
    got = {(r.page_index, r.block_no): (r.label, r.text, len(r.flags)) for r in done.collect()}
    assert got == {(0, 0): ("header", "Hlava", 1), (0, 1): ("text", "žena je doma, ted buď plat", 3), (1, 0): ("text", "the house", 0), (1, 1): ("text", "stands heer", 1), (2, 0): ("text", ("la " * 3000)[:200].rstrip(), 67)}
    assert {(r.page_index, r.original) for r in flags.collect()} == {(1, "heer"), (0, "żena"), (0, "bud'"), (0, "ted"), (0, "Hlava"), (2, "la")}
    records = {r.page_index: (r.source, r.rotation_applied, r.raw, r.warnings) for r in pages.collect()}
    assert records == {0: ("ocr", 0, read[0][4], []), 1: ("text_layer", 0, read[1][3], []), 2: ("ocr", 0, read[2][4], ["runaway"]), 3: ("blank", 0, "", [])}
    again = process(table(spark, read, kind), words, ["heer", "TED"], cleanup=lambda b: b.withColumn("text", F.upper("text"))).blocks
    assert {r.text for r in again.collect()} >= {"HLAVA", "STANDS HEER"}
    personal = process(table(spark, read, kind), words, ["heer", "TED"]).flags
    assert not {"heer", "ted"} & {r.original for r in personal.collect()}


def test_flags_alone_keep_less(spark, monkeypatch):
    """What the flags of the whole path hold of texts at a time: under five times their bytes, 5.2 times when they came with blocks and records."""
    from folio.operators import process as module

    words = dictionary(spark, "en", "house", "stands", "here", "the").unionByName(dictionary(spark, "cs", "dům"))
    draw = random.Random(4)
    letters = "".join(map(chr, range(0x4E00, 0x9E00)))
    read = [(1, i, "ocr", None, "<|det|>text [10, 200, 900, 240]<|/det|>the hause " + "".join(draw.choice(letters) for _ in range(60_000)) + "ted", False) for i in range(4)]
    pages = table(spark, read, "doc_id int, page_index int, source string, layer string, raw string, hit_token_cap boolean")
    size = lambda: sum(f.stat().st_size for f in pathlib.Path(shared_folder(spark).removeprefix("file:")).rglob("*") if f.is_file())
    plain = lambda rows: sorted(map(str, rows.collect()))
    before, whole, held, keep = size(), sum(len(r[4].encode()) for r in read), [], module.Stages.keep

    def noted(self, df):
        out = keep(self, df)
        held.append(size() - before)
        return out

    monkeypatch.setattr(module.Stages, "keep", noted)
    find = getattr(module, "flags", lambda *given: process(*given).flags)
    found = plain(find(pages, words))
    assert max(held) / whole < 5, [round(x / whole, 2) for x in held]
    assert found == plain(process(pages, words).flags) and any("hause" in x for x in found)


def test_process_keeps_little(spark):
    """Of texts that don't compress, the shared folder holds the readings and the finished blocks in the end, not every stage; records of pages are the same alone."""
    words = dictionary(spark, "en", "house", "stands", "here", "the").unionByName(dictionary(spark, "cs", "dům"))
    draw = random.Random(3)
    letters = "".join(map(chr, range(0x4E00, 0x9E00)))
    read = [(1, i, "ocr", None, "<|det|>text [10, 200, 900, 240]<|/det|>" + "".join(draw.choice(letters) for _ in range(60_000)), False) for i in range(4)] + [(1, 4, "ocr", None, "la " * 3000, False), (1, 5, "blank", None, None, False), (1, 6, "ocr", None, "", False)]
    kind = "doc_id int, page_index int, source string, layer string, raw string, hit_token_cap boolean"
    size = lambda: sum(f.stat().st_size for f in pathlib.Path(shared_folder(spark).removeprefix("file:")).rglob("*") if f.is_file())
    before, whole = size(), sum(len((r[4] or "").encode()) for r in read)
    done = process(table(spark, read, kind), words)
    assert size() - before < 4 * whole
    assert {r.text for r in done.blocks.where("page_index < 4").collect()} == {r[4].split("<|/det|>")[1] for r in read[:4]}
    plain = lambda rows: sorted(map(str, rows.collect()))
    assert plain(done.pages) == plain(records(table(spark, read, kind))) and {r.page_index: r.warnings for r in done.pages.collect()} == {i: [["runaway"], [], ["empty"]][i - 4] if i > 3 else [] for i in range(7)}


def test_cleanup_comes_after_the_flags(spark):
    """The hook sees every flag; flags and blocks that come out of it agree."""
    words = dictionary(spark, "en", "house", "stands", "here", "the", "stream", "water").unionByName(dictionary(spark, "cs", "dům"))
    read = [(1, 0, "text_layer", "the houze stands here\n\nthe wattr", None, False)]
    kind = "doc_id int, page_index int, source string, layer string, raw string, hit_token_cap boolean"
    done = process(table(spark, read, kind), words, cleanup=lambda b: cleanup.cleaned(b, words))
    assert {r.block_no: r.text for r in done.blocks.collect()} == {0: "the house stands here", 1: "the water"}
    flags = sorted((r.block_no, r.kind, r.start, r.end, r.original) for r in done.flags.collect())
    assert flags == [(0, "repaired", 4, 9, "houze"), (1, "repaired", 4, 9, "wattr")]


def test_many_dictionaries(spark):
    """A page finds its dictionary among any number of languages."""
    words = dictionary(spark, "cs", "žena", "doma", "je")
    many = spark.range(120).selectExpr("concat('b', id) AS lang", "'x' AS form")
    read = [(1, 0, "text_layer", "žena je doma xyz", None, False)]
    done = process(table(spark, read, "doc_id int, page_index int, source string, layer string, raw string, hit_token_cap boolean"), many.unionByName(words))
    assert [(r.lang, [f.original for f in r.flags]) for r in done.blocks.collect()] == [("cs", ["xyz"])]


def test_pages_that_are_turned(spark):
    """A page that lies on its side is read again; one whose second reading is no better, was stopped, or has few words isn't."""
    good, bad = " ".join(["the house stands here by the water"] * 3), " ".join(["eht esuoh sdnats ereh yb eht retaw"] * 3)
    words = dictionary(spark, "en", "house", "stands", "here", "the", "by", "water")
    tag = lambda t: f"<|det|>text [1, 2, 3, 4]<|/det|>{t}"
    read = [
        (1, 0, "ocr", tag(bad), 90, False, False), (1, 1, "ocr", tag(good), 0, False, False), (1, 2, "ocr", tag(bad), 0, False, False), (1, 3, "ocr", tag(bad), 0, True, False),
        (1, 4, "ocr", tag("eht esuoh"), 0, False, False), (1, 5, "blank", None, 0, False, False), (1, 6, "ocr", "", 0, False, True), (1, 7, "ocr", tag(bad), 0, False, False), (1, 8, "ocr", "", 0, False, False),
    ]
    given = table(spark, read, "doc_id int, page_index int, source string, raw string, rotation int, cancelled boolean, timed_out boolean")
    given = given.selectExpr("*", "CAST(NULL AS string) AS layer", "false AS hit_token_cap", "100 AS width_px", "200 AS height_px", "'quality' AS mode", "array('seen') AS warnings")
    probes = [(1, p, d, 0.9 if d == 180 else 0.1, False, False) for p in range(9) for d in (0, 90, 180, 270)]
    second = [(1, 0, 270, tag(good), False), (1, 0, 180, tag("wrong"), False), (1, 2, 180, tag(bad), False), (1, 3, 180, tag(good), False), (1, 4, 180, tag(good), False), (1, 7, 180, tag(good), True)]
    later = table(spark, second, "doc_id int, page_index int, rotation int, raw string, cancelled boolean").selectExpr("*", "false AS hit_token_cap", "100 AS width_px", "200 AS height_px", "'fast' AS mode")
    done = process(given, words, probes=table(spark, probes, "doc_id int, page_index int, degrees int, rate double, cancelled boolean, timed_out boolean"), second=later)
    texts = {r.page_index: r.text for r in done.blocks.collect()}
    assert texts == {0: good, 1: good, 2: bad, 3: bad, 4: "eht esuoh", 7: bad}
    records = {r.page_index: (r.source, r.mode, r.width_px, r.height_px, r.rotation_applied, r.warnings) for r in done.pages.collect()}
    first = ("ocr", "quality", 100, 200, 0)
    assert records == {
        0: ("ocr", "fast", 200, 100, 270, ["rotated"]), 1: (*first, ["seen"]), 2: (*first, ["seen"]), 3: (*first, ["seen", "cancelled"]), 4: (*first, ["seen"]),
        5: ("blank", None, 100, 200, 0, []), 6: (*first, ["seen", "time_limit"]), 7: (*first, ["seen"]), 8: (*first, ["seen", "empty"]),
    }
    assert {r.original for r in done.flags.where("page_index = 0").collect()} == set()


def test_clean_extract_and_paths(spark):
    rows = ["# Head\nfirst\nsecond (cid:12)\n\n\n\n12\nwo-\nrd ﬁn\n- item\ntail", "", "a\fb", "> q\nx\n3) y\n=== z\n```c"]
    got = table(spark, list(enumerate(rows)), "id int, t string").select("id", text.clean_extracted(F.col("t")).alias("o")).collect()
    assert [r.o for r in sorted(got)] == ["# Head\nfirst second\n\nword fin\n- item\ntail\n", "", "a\n\nb\n", "> q\nx\n3) y\n=== z\n```c\n"]
    t, n = text.scrub_user(F.col("t"), "ann")
    rows = [r"see C:\Users\ann\x and C:/Users/Ann", r"D:\\Users\\ann\\y", "c--users-ann-z", "C:/Users/anna"]
    got = table(spark, list(enumerate(rows)), "id int, t string").select("id", t.alias("t"), n.alias("n")).collect()
    assert [(r.t, r.n) for r in sorted(got)] == [(r"see %USERPROFILE%\x and %USERPROFILE%", 2), (r"%USERPROFILE%\\y", 1), ("C--Users-<user>-z", 1), ("C:/Users/anna", 0)]


def test_strips_and_readings(spark):
    rows = [(1, 0, ["a", "empty"], False, False), (1, 1, ["b", "a"], True, False), (2, 0, ["x"], False, False), (3, 0, ["empty"], False, False), (4, 0, [], False, True)]
    got = layout.strip_warnings(table(spark, rows, "k int, n int, warnings array<string>, has_text boolean, stopped boolean"), ["k"]).collect()
    assert {r.k: r.warnings for r in got} == {1: ["a", "b"], 2: ["x", "empty"], 3: ["empty"], 4: []}


def test_cards(spark):
    names = {"NVIDIA GeForce RTX 4080 SUPER": 8.9, "Tesla T4": 7.5, "GTX 1080 Ti": 6.1, "RTX 3060": 8.6, "NVIDIA A100-SXM4-80GB": 8.0, "NVIDIA L40S": 8.9, "RTX 6000 Ada Generation": 8.9, "NVIDIA TITAN V": 7.0, "TITAN Xp": 6.1, "RTX PRO 6000 Blackwell": 12.0, "NVIDIA GH200 480GB": 9.0, "GeForce 210": None, "NVIDIA A10G": 8.6}
    got = table(spark, [(n,) for n in names], "n string").select("n", guards.capability(F.col("n")).alias("c")).collect()
    assert {r.n: r.c for r in got} == names


def test_edits_note_their_rules(spark):
    row = table(spark, [("a,,",)], "text string").withColumn("flags", F.array().cast(FLAGS)).withColumn("edits", repair.character_edits(F.col("text")))
    assert edits.apply_edits(row).first().flags[0].note == repair.NOTES["quote"]


def test_words_that_stand_everywhere_are_dealt(spark, monkeypatch):
    """Look-ups by a shuffle give what those by broadcast give."""
    blocks = table(spark, [(1, 0, i, "text", "en", "baad good worrd " * (i + 1)) for i in range(20)], "doc_id int, page_index int, block_no int, label string, lang string, text string")
    words = dictionary(spark, "en", "good", "worse")
    want = sorted(map(str, lexicon.suspicious(blocks, words).collect()))
    rates = sorted(map(str, lexicon.hit_rates(blocks, ["doc_id", "page_index", "block_no"], words).collect()))
    monkeypatch.setattr(lexicon, "BROADCAST_WORDS", 0)
    assert sorted(map(str, lexicon.suspicious(blocks, words).collect())) == want and len(want) == 2 * 210
    assert sorted(map(str, lexicon.hit_rates(blocks, ["doc_id", "page_index", "block_no"], words).collect())) == rates


def plain_rate(events):
    last, rate = None, 0.0
    for t, s, d in sorted(events):
        if last is None or s != last[1] or d < last[2] or t <= last[0]:
            rate = 0.0
        else:
            now = (d - last[2]) / (t - last[0])
            rate = now if rate == 0 else 0.7 * rate + 0.3 * now
        last = (t, s, d)
    return rate


@pytest.mark.parametrize("number", [1, 3, 40])
def test_rates_of_one_hot_key(spark, number):
    """However a key's events are cut, the scan gives the fold's speed."""
    rng = random.Random(number)
    rows = [("hot", float(i // 2 if i % 50 == 0 else i), "a" if i < 700 or i > 720 else "b", float(0 if i % 301 == 300 else i * (i % 3 > 0) + i * 2)) for i in range(1500)]
    rows += [("still", float(i), "a", 5.0) for i in range(40)] + [("one", 1.0, "a", 1.0)]
    rows += [(f"k{rng.randint(0, 20)}", float(rng.randint(0, 40)), rng.choice("ab"), float(rng.randint(0, 9))) for _ in range(600)]
    made = jobs.smoothed_rate(spark.createDataFrame(rows, "job string, t double, s string, d double").repartition(7), "job", "s", "t", "d", number)
    got = {r.job: r.rate for r in made.collect()}
    want = {k: plain_rate([r[1:] for r in rows if r[0] == k]) for k in {r[0] for r in rows}}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_a_guess_between_two_counts_of_lines(spark):
    """The product of both factors is exact: 867 letters in a box of 400 by 80 points are 8.5 lines but for the last bit."""
    line = " ".join(["abcd"] * 173) + " xy"
    fit = render.fit_lines(F.array(F.lit(line)), F.lit(400.0), F.lit(80.0))["size"]
    assert len(line) == 867 and spark.range(1).select(F.round(fit, 6).alias("size")).first().size == 7.407407


def test_letters_changed_in_place_need_no_alignment(monkeypatch):
    """A long line with many changed letters costs its length."""
    monkeypatch.setattr(python, "_paired", None)
    a = "".join(random.Random(1).choices("abcdéf ", k=60_000))
    told = python.accents(a, a.replace("é", "e"))
    assert told == {"total": a.count("é"), "right": 0, "wrong": ["é→e"] * a.count("é")}


def test_gates_walk_no_cells(spark, monkeypatch):
    """The distance of a line with a changed letter, and what the gate makes of it, need no cells of both texts."""
    monkeypatch.setattr(python, "_within", None)
    a = "abcdéf " * 20_000
    assert python.distance(a, a[:70_000] + "~" + a[70_001:]) == 1
    from folio.plans.catalogue import QUERIES

    assert "levenshtein" not in QUERIES["accuracy_gate"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("piece", [1, 7, 1 << 20])
def test_pairs_are_compared_in_pieces(spark, monkeypatch, piece):
    """Lines of one length are compared many at once, with what each alone gives; one changed letter needs no walk over its line."""
    rng = random.Random(11)
    a = ["".join(rng.choices("aáéb😀í", k=rng.randint(0, 12))) for _ in range(500)]
    b = [x.replace("é", "e") if k % 2 else "".join(rng.choices("aáéb😀í", k=rng.choice([len(x), 5]))) for k, x in enumerate(a)]
    monkeypatch.setattr(python, "PIECE", piece)
    assert list(python.distances(a, b)) == [python.distance(x, y) for x, y in zip(a, b, strict=True)]
    assert list(python.all_accents(a, b)) == [python.accents(x, y) for x, y in zip(a, b, strict=True)]
    monkeypatch.setattr(python, "_changed", None)
    assert list(python.distances(["abc", "", "aé"], ["abd", "", "ae"])) == [1, 0, 1]
    given = table(spark, [("abc", "abd"), (None, "a"), ("a", None), ("é", "e"), ("", "x")], "a string, b string")
    monkeypatch.undo()
    found = given.select(python.distance_of(F.col("a"), F.col("b")).alias("d"), python.accents_of(F.col("a"), F.col("b")).alias("x")).collect()
    assert [r.d for r in found] == [1, None, None, 1, 1] and [r.x and tuple(r.x) for r in found] == [(0, 0, []), None, None, (1, 0, ["é→e"]), (0, 0, [])]


def test_empty_lines_go_before_letters_are_replaced(spark):
    """Which lines are empty is seen by the lines themselves; no filter writes their plain letters first."""
    from folio.plans.catalogue import QUERIES

    for name in ("cer_by_group", "accuracy_gate"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        filters = [x for x in plan.splitlines() if "Filter" in x]
        assert filters and not any("regexp_replace" in x for x in filters)


def test_flags_of_words_release_shuffles(spark, monkeypatch):
    """The shuffle files that led to the cut words, and to the known ones, are given up once these are kept."""
    released = []
    monkeypatch.setattr(lexicon, "release", released.append, raising=False)
    blocks = table(spark, [(1, 0, 0, "text", "en", "the hause stands")], "doc_id int, page_index int, block_no int, label string, lang string, text string")
    found = lexicon.suspicious(blocks, dictionary(spark, "en", "the", "stands"))
    assert len(released) == 2
    assert [r.original for r in found.collect()] == ["hause"]


def test_distances_grow_by_bands(monkeypatch):
    """Against all cells; the first band is too narrow for most pairs."""
    monkeypatch.setattr(python, "FIRST_BAND", 1)
    rng = random.Random(9)
    for _ in range(300):
        a, b = ("".join(rng.choices("aáb😀", k=rng.randint(0, 30))) for _ in range(2))
        assert python.distance(a, b) == cheapest(a, b)


@pytest.mark.parametrize("most", [0, 1, 2, 9])
def test_common_words_are_broadcast_and_rare_ones_dealt(spark, monkeypatch, most):
    """Of the words that are known the commonest are broadcast, as many as may be; the result is the same."""
    monkeypatch.setattr(lexicon, "BROADCAST_WORDS", most)
    found = table(spark, [("a", 5), ("b", 2), ("c", 1)], "word string, n long")
    rows = table(spark, [(i, w) for i, w in enumerate("aaaaabbcdd")], "id int, word string")
    common, rare = lexicon._commonest(found)
    assert common.count() == min(most, 3) and (rare is None) == (most > 2)
    assert sorted(r.id for r in lexicon.found_in(rows, found, ["word"]).collect()) == [*range(8)]
    assert sorted(r.id for r in lexicon.not_in(rows, found, ["word"]).collect()) == [8, 9]
