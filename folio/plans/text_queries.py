"""Queries on text: markup, tokens, dictionaries, repairs, tables, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions import python, text
from folio.operators import edits, guards, layout, lexicon, parse, render, repair, score
from folio.plans.inputs import BLOCKS_SQL, DICTIONARY_SQL, RUN_SQL, SEEDED_SQL, WORD_OF_RUN_SQL, blocks, dictionary, known_sql, lines, seeded, strip_sql, table, tokens_sql, words_sql
from folio.plans.registry import query
from folio.schema import BLOCK_KEYS, PAGE_KEYS


def _box(df: DataFrame) -> DataFrame:
    return df.select("*", "box.x1", "box.y1", "box.x2", "box.y2").drop("box")


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, no AS block_no, label, x1, y1, x2, y2, {strip_sql('text')} AS text FROM blocks")
def parse_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks read back from markup that was made of them."""
    tag = F.concat(F.lit("<|det|>"), "label", F.lit(" ["), F.concat_ws(", ", *(F.col(f"box.{c}") for c in ("x1", "y1", "x2", "y2"))), F.lit("]<|/det|>"), "text")
    raw = blocks(spark, sf_dir).groupBy("doc_id").agg(text.joined(tag, "\n", "no").alias("raw"))
    return _box(parse.parse_raw(raw)).select("doc_id", "block_no", "label", "x1", "y1", "x2", "y2", "text")


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, no + 1 AS block_no, CASE WHEN no % 5 = 0 THEN 'text' ELSE label END AS label, x1, y1, x2, y2, {strip_sql('text')} AS text FROM blocks
UNION ALL SELECT DISTINCT doc_id, 0, 'text', CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), CAST(NULL AS INT), 'lead' FROM blocks""")  # fmt: skip
def parse_markup_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older form with two boxes in any order, unknown labels, text before the first tag, model tokens."""
    label = F.when(F.col("no") % 5 == 0, F.lit("Seal")).otherwise(F.initcap("label"))
    x1, y1, x2, y2 = (F.col(f"box.{c}").cast("string") for c in ("x1", "y1", "x2", "y2"))
    boxes = F.concat(F.lit("[["), F.concat_ws(", ", x2, y2, x1, y1), F.lit("],["), F.concat_ws(",", x1, y1, x1, y2), F.lit("]]"))
    tag = F.concat(F.lit("<|ref|>"), label, F.lit("<|/ref|><|det|>"), boxes, F.lit("<|/det|> "), "text", F.lit("<|end|>"))
    raw = blocks(spark, sf_dir).groupBy("doc_id").agg(F.concat(F.lit(" lead\n"), text.joined(tag, "\n", "no")).alias("raw"))
    return _box(parse.parse_raw(raw)).select("doc_id", "block_no", "label", "x1", "y1", "x2", "y2", "text")


_BUCKET_SQL = "CASE WHEN label = 'header' OR (label = 'page_number' AND y1 < 500) THEN 0 WHEN label IN ('page_number', 'footer') THEN 2 ELSE 1 END"


@query(f"""WITH {BLOCKS_SQL}, shown AS (SELECT doc_id, page_index, block_no, {strip_sql('text')} AS t FROM blocks WHERE label NOT IN ('header', 'footer', 'page_number', 'image', 'figure')),
pages AS (SELECT doc_id, page_index, string_agg(t, chr(10) || chr(10) ORDER BY block_no) AS t FROM shown WHERE t <> '' GROUP BY ALL)
SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY page_index) || chr(10) AS text FROM pages GROUP BY doc_id""")  # fmt: skip
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What text each document's pages hold, in reading order."""
    ordered = layout.furniture_to_edges(blocks(spark, sf_dir))
    return render.document_texts(render.page_texts(ordered, tables=False))


@query(f"WITH {BLOCKS_SQL} SELECT doc_id, page_index, no, CAST(row_number() OVER (PARTITION BY doc_id, page_index ORDER BY {_BUCKET_SQL}, block_no) - 1 AS INT) AS block_no FROM blocks")
def furniture_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.furniture_to_edges(blocks(spark, sf_dir)).select(*PAGE_KEYS, "no", "block_no")


@query(f"""SELECT doc_id, CAST(i - 1 AS INT) AS block_no, p[i] AS text FROM (SELECT doc_id, p, unnest(generate_series(1, len(p))) AS i FROM
(SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {strip_sql('x')}), lambda x: x <> '') AS p FROM documents))""")  # fmt: skip
def text_layer_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of a text layer with blank lines between them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n \n")).alias("text"))
    return parse.text_layer_blocks(docs).select("doc_id", "block_no", "text")


@query(f"SELECT doc_id, md5(nullif({strip_sql("replace(text, ', ', '-' || chr(10))")}, '')) AS digest FROM documents")
def text_layer_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line ends of either kind, soft hyphen marks, control characters and wide blanks go."""
    ends = F.when(F.col("doc_id") % 2 == 0, "\r\n").otherwise("\r")
    layer = F.concat(F.lit("\u2003 "), F.replace(F.replace("text", F.lit("\n"), ends), F.lit(", "), F.lit("￾")), F.lit("\x07\uffff\u00a0"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.text_layer(layer)).alias("digest"))


@query("SELECT doc_id, md5(replace(text, 'e', '')) AS digest FROM documents")
def xml_safe_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control characters put in for a letter go again."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.xml_safe(F.translate("text", "e", "\x0b"))).alias("digest"))


@query(f"""WITH d AS (SELECT doc_id, text AS t FROM documents), c AS (SELECT doc_id, string_split_regex(t, '{RUN_SQL}') AS gaps, regexp_extract_all(t, '{RUN_SQL}') AS runs FROM d),
u AS (SELECT doc_id, unnest(generate_series(1, len(runs))) AS i, unnest(gaps[1:len(runs)]) AS gap, unnest(runs) AS run FROM c),
p AS (SELECT doc_id, i, {WORD_OF_RUN_SQL} AS word, sum(length(gap) + length(run)) OVER (PARTITION BY doc_id ORDER BY i) - length(run) AS start FROM u)
SELECT doc_id, CAST(count(*) AS INT) AS n_words, md5(string_agg(word, ' ' ORDER BY i)) AS digest, md5(string_agg(start, ' ' ORDER BY i)) AS starts, md5(string_agg(start + length(word), ' ' ORDER BY i)) AS ends FROM p WHERE word <> '' GROUP BY doc_id""")  # fmt: skip
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents and their places."""
    w = python.placed_words_of(F.col("text"), text.WORD)
    placed = table(spark, sf_dir, "documents").select("doc_id", w.alias("w")).where(F.size("w") > 0)
    told = lambda field: F.md5(F.array_join(F.col(f"w.{field}").cast("array<string>"), " "))
    return placed.select("doc_id", F.size("w").alias("n_words"), told("word").alias("digest"), told("start").alias("starts"), told("end").alias("ends"))


@query(f"SELECT page_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS digest FROM (SELECT page_id, {words_sql("regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS w FROM pages)")
def masked_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of web pages, tags masked."""
    words = text.word_list(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", F.size(words).alias("n_words"), F.md5(F.array_join(words, " ")).alias("digest"))


_RATES_SQL = f"""{DICTIONARY_SQL}, first AS (SELECT doc_id, lang, list_filter({words_sql('text')}, lambda w: length(w) >= 2)[1:300] AS w FROM documents),
asked AS (SELECT DISTINCT lang, unnest(w) AS word FROM first), judged AS (SELECT lang, word, {known_sql('q.lang', 'q.word')} AS known FROM asked q),
rates AS (SELECT f.doc_id, f.lang, round(avg(CASE WHEN j.known THEN 1.0 ELSE 0.0 END), 6) AS rate FROM (SELECT doc_id, lang, unnest(w) AS word FROM first) f JOIN judged j ON j.lang = f.lang AND j.word = f.word GROUP BY ALL)"""  # fmt: skip


@query(f"WITH {_RATES_SQL} SELECT d.doc_id, d.lang, coalesce(r.rate, 0.0) AS rate FROM documents d LEFT JOIN rates r ON r.doc_id = d.doc_id")
def word_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return lexicon.hit_rates(docs, ["doc_id"], dictionary(spark, sf_dir)).select("doc_id", "lang", F.round("rate", 6).alias("rate"))


@query(f"""WITH {DICTIONARY_SQL}, langs AS (SELECT DISTINCT lang FROM dictionary), first AS (SELECT doc_id, list_filter({words_sql('text')}, lambda w: length(w) >= 2)[1:300] AS w FROM documents),
word AS (SELECT doc_id, unnest(w) AS word FROM first), asked AS (SELECT l.lang, q.word FROM (SELECT DISTINCT word FROM word) q, langs l), judged AS (SELECT lang, word, {known_sql('q.lang', 'q.word')} AS known FROM asked q),
rates AS (SELECT w.doc_id, j.lang, avg(CASE WHEN j.known THEN 1.0 ELSE 0.0 END) AS rate FROM word w JOIN judged j ON j.word = w.word GROUP BY ALL)
SELECT doc_id, arg_min(lang, (-rate, lang)) AS language, round(max(rate), 6) AS rate FROM rates GROUP BY doc_id""")  # fmt: skip
def language_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language whose dictionary knows most of a document's first words."""
    words = dictionary(spark, sf_dir)
    # a text without words of two letters has no vote
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.exists(text.word_list(F.col("text")), lambda w: F.length(w) >= lexicon.LEAST_LETTERS))
    langs = [r.lang for r in words.select("lang").distinct().collect() if r.lang is not None]
    rates = lexicon.hit_rates(docs, ["doc_id"], words, tried=langs)
    return lexicon.best_language(rates, ["doc_id"]).select("doc_id", "language", F.round("rate", 6).alias("rate"))


@query("""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 5 > 0 THEN (doc_id % 11) / 10 END AS cs, CASE WHEN doc_id % 7 > 0 THEN (doc_id * 3 % 11) / 10 END AS en FROM documents)
SELECT doc_id, CASE WHEN cs IS NULL AND en IS NULL THEN 'cs' WHEN cs IS NULL THEN CASE WHEN en < 0.5 THEN 'cs' ELSE 'en' END WHEN en IS NULL THEN CASE WHEN cs < 0.5 THEN 'en' ELSE 'cs' END WHEN en > cs THEN 'en' ELSE 'cs' END AS language FROM r""")  # fmt: skip
def language_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vote on rates of which either may be missing."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", lexicon.vote(F.when(n % 5 > 0, (n % 11) / 10), F.when(n % 7 > 0, (n * 3 % 11) / 10)).alias("language"))


@query(f"""WITH turns AS (SELECT conv_id, turn, text AS t FROM conversations), tok AS ({tokens_sql('turns', 'conv_id, turn')})
SELECT conv_id, turn, count(*) AS n_words, count(*) FILTER (WHERE regexp_matches(word, '^\\p{{Lu}}') AND NOT (p = '' OR regexp_matches(p, '[.!?…]$'))) AS n_protected
FROM (SELECT *, regexp_replace(t[1:start], '[\\s"''„“”‚‘’«»(\\[{{–—*•-]+$', '') AS p FROM tok) GROUP BY conv_id, turn""")  # fmt: skip
def sentence_protection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of turns that are capitalised within a sentence."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    found = lexicon.tokens(turns, ["conv_id", "turn"])
    kept = lexicon.protected(F.col("word"), F.col("starts"))
    return found.groupBy("conv_id", "turn").agg(F.count("*").alias("n_words"), F.count_if(kept).alias("n_protected"))


_SUSPICIOUS_SQL = f"""{BLOCKS_SQL}, {DICTIONARY_SQL}, shown AS (SELECT doc_id, page_index, block_no, lang, text AS t FROM blocks WHERE label NOT IN ('formula', 'image', 'figure')),
tok AS ({tokens_sql('shown', 'doc_id, page_index, block_no, lang')}),
open AS (SELECT * FROM (SELECT *, regexp_replace(t[1:start], '[\\s"''„“”‚‘’«»(\\[{{–—*•-]+$', '') AS p FROM tok) WHERE length(word) >= 2 AND NOT (regexp_matches(word, '^\\p{{Lu}}') AND NOT (p = '' OR regexp_matches(p, '[.!?…]$')))),
judged AS (SELECT lang, word, {known_sql('q.lang', 'q.word')} AS known FROM (SELECT DISTINCT lang, word FROM open) q),
flags AS (SELECT o.doc_id, o.page_index, o.block_no, o.start, CAST(o.start + length(o.word) AS INT) AS "end", o.word AS original FROM open o JOIN judged j ON j.lang = o.lang AND j.word = o.word WHERE NOT j.known)"""  # fmt: skip


@query(f'WITH {_SUSPICIOUS_SQL} SELECT doc_id, page_index, block_no, start, "end", original FROM flags')
def suspicious_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.suspicious(blocks(spark, sf_dir), dictionary(spark, sf_dir)).select(*BLOCK_KEYS, "start", "end", "original")


@query(f"""WITH {_SUSPICIOUS_SQL} SELECT doc_id, md5('---' || chr(10) || chr(10) || '**Suspicious words / Podezřelá slova**' || chr(10) || chr(10) ||
string_agg('- page ' || (page_index + 1) || ': `' || original || '`', chr(10) ORDER BY page_index, block_no, start)) AS digest FROM flags GROUP BY doc_id""")  # fmt: skip
def suspicious_appendix(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = lexicon.suspicious(blocks(spark, sf_dir), dictionary(spark, sf_dir))
    return render.appendix(flags).select("doc_id", F.md5("appendix").alias("digest"))


@query(f"SELECT doc_id, len(w) AS n_foreign, md5(array_to_string(w, ' ')) AS digest FROM (SELECT doc_id, list_filter({words_sql('text')}, lambda w: regexp_matches(regexp_replace(w, '[\\x00-\\x7F{repair.CZECH}]', '', 'g'), '\\p{{L}}')) AS w FROM documents)")
def foreign_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with a letter that the repaired language lacks."""
    found = F.filter(text.word_list(F.col("text")), repair.is_foreign)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_foreign"), F.md5(F.array_join(found, " ")).alias("digest"))


_DASHES = "regexp_replace({}, '([\\p{{L}}\\p{{N}}_]) - ([\\p{{L}}\\p{{N}}_])', '\\1 – \\2', 'g')"


@query(f"SELECT doc_id, md5({_DASHES.format(_DASHES.format(f'''replace(replace({SEEDED_SQL}, 'ﬁ', 'fi'), ',,', '„')'''))}) AS digest FROM documents")
def char_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(repair.character_text(seeded())).alias("digest"))


@query(f"SELECT doc_id, md5({_DASHES.format(_DASHES.format('''replace(replace(t, 'ﬁ', 'fi'), ',,', '„')'''))}) AS digest, CAST(length(t) - length(replace(t, 'ﬁ', '')) + (length(t) - length(replace(t, ',,', ''))) // 2 AS INT) AS n_other, TRUE AS placed FROM (SELECT doc_id, unnest(string_split({SEEDED_SQL}, '. ')) AS t FROM documents)")
def char_edit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same repairs as edits on sentences, with flags; placed: each flag's new text stands where it says."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(seeded(), r"\. ", -1)).alias("text"))
    with_edits = rows.withColumn("flags", F.array().cast("array<struct<kind:string,start:int,end:int,original:string,note:string>>")).withColumn("edits", repair.character_edits(F.col("text")))
    done = edits.apply_edits(with_edits)
    stands = F.forall("flags", lambda f: F.substring(F.col("text"), f["start"] + 1, f["end"] - f["start"]).isin("fi", "„", " – "))
    return done.select("doc_id", F.md5("text").alias("digest"), F.size(F.filter("flags", lambda f: ~F.startswith(f["note"], F.lit("R3")))).alias("n_other"), stands.alias("placed"))


#: Words of the derived dictionary in plain letters, and a dictionary in which those of even length are softened.
_SOFT = "CASE WHEN regexp_matches({0}, '^[^dt]*d') THEN regexp_replace({0}, '^([^dt]*)d', '\\1ď') ELSE regexp_replace({0}, '^([^dt]*)t', '\\1ť') END"
_SOFT_SQL = f"""{DICTIONARY_SQL}, base AS (SELECT DISTINCT form FROM dictionary WHERE regexp_full_match(form, '[a-z]+')),
soft AS (SELECT DISTINCT CASE WHEN length(form) % 2 = 0 THEN {_SOFT.format('form')} ELSE form END AS form FROM base)"""


def _plain_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dictionary(spark, sf_dir).where(F.rlike("form", F.lit("^[a-z]+$"))).select("form").distinct()


def _softened(form: Column) -> Column:
    return F.when(F.rlike(form, F.lit("^[^dt]*d")), F.regexp_replace(form, "^([^dt]*)d", "$1ď")).otherwise(F.regexp_replace(form, "^([^dt]*)t", "$1ť"))


def _czech(forms: DataFrame) -> DataFrame:
    return forms.select(F.lit("cs").alias("lang"), F.when(F.length("form") % 2 == 0, _softened(F.col("form"))).otherwise(F.col("form")).alias("form"))


_MARKED_SQL = f"""{_SOFT_SQL}, asked AS (SELECT form, regexp_replace(form, '^([^dt]*[dt])', '\\1' || chr(39)) AS word, {_SOFT.format('form')} AS new FROM base WHERE regexp_matches(form, '[dt]')),
marked AS (SELECT word, new FROM asked a WHERE EXISTS (SELECT 1 FROM soft s WHERE s.form = a.new) AND NOT (regexp_full_match(a.form, '[^dt]*[dt]') AND a.form <> 'bud' AND EXISTS (SELECT 1 FROM soft s WHERE s.form = a.form)))"""


def _marked_words(forms: DataFrame) -> DataFrame:
    return forms.where(F.rlike("form", F.lit("[dt]"))).select(F.lit("cs").alias("lang"), F.regexp_replace("form", "^([^dt]*[dt])", "$1'").alias("word"))


@query(f"WITH {_MARKED_SQL} SELECT word, new FROM marked")
def marked_soft_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary words written with an apostrophe after their first d or t."""
    forms = _plain_forms(spark, sf_dir)
    return repair.marked_soft_words(_marked_words(forms), _czech(forms)).select("word", "new")


@query(f"WITH {_SOFT_SQL} SELECT form AS word, {_SOFT.format('form')} AS new FROM base WHERE regexp_matches(form, '[dt]') AND NOT EXISTS (SELECT 1 FROM soft s WHERE s.form = base.form)")
def plain_soft_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary words without their softening, where only one softened form is a word."""
    forms = _plain_forms(spark, sf_dir)
    return repair.plain_soft_words(forms.select(F.lit("cs").alias("lang"), F.col("form").alias("word")), _czech(forms)).select("word", "new")


@query(f"""WITH {_SOFT_SQL} SELECT regexp_replace(form, '^([^z]*)z', '\\1ż') AS word, CASE WHEN length(form) % 3 = 0 THEN regexp_replace(form, '^([^z]*)z', '\\1ž') WHEN length(form) % 3 = 2 THEN form END AS new
FROM base WHERE contains(form, 'z')""")  # fmt: skip
def look_alike_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose first z is a letter of another alphabet: the likelier candidate is known, the other, or none."""
    forms = _plain_forms(spark, sf_dir).where(F.contains("form", F.lit("z")))
    of = lambda new: F.regexp_replace("form", "^([^z]*)z", f"$1{new}")
    words = forms.where("length(form) % 3 <> 1").select(F.lit("cs").alias("lang"), F.when(F.length("form") % 3 == 0, of("ž")).otherwise(F.col("form")).alias("form"))
    return repair.foreign_words(forms.select(F.lit("cs").alias("lang"), of("ż").alias("word")), words.unionByName(words.where("length(form) % 3 = 0").select("lang", F.regexp_replace("form", "ž", "z").alias("form")))).select("word", "new")


@query(f"""WITH {_MARKED_SQL} SELECT a.word, 'ů ' || coalesce(m.new, a.word) || ' k – ' || CASE WHEN length(form) % 2 = 0 AND NOT EXISTS (SELECT 1 FROM soft s WHERE s.form = a.form) THEN a.new ELSE form END || '„ fi.' AS text,
CAST(3 + (CASE WHEN m.new IS NULL THEN 0 ELSE 1 END) + (CASE WHEN length(form) % 2 = 0 AND NOT EXISTS (SELECT 1 FROM soft s WHERE s.form = a.form) THEN 1 ELSE 0 END) AS INT) AS n_flags, TRUE AS placed
FROM asked a LEFT JOIN marked m ON m.word = a.word WHERE m.new IS NOT NULL""")  # fmt: skip
def repaired_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All repairs in one line for each word that has a soft letter: marked, plain, dash, quotation mark and ligature."""
    forms = _plain_forms(spark, sf_dir)
    words = _marked_words(forms).join(repair.marked_soft_words(_marked_words(forms), _czech(forms)).select("word"), "word", "left_semi")
    line = F.concat(F.lit("ů "), "word", F.lit(" k - "), F.regexp_replace("word", "'", ""), F.lit(",, ﬁ."))
    given = words.select("word", F.xxhash64("word").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(0).alias("block_no"), F.lit("text").alias("label"), "lang", line.alias("text"), F.array().cast("array<struct<kind:string,start:int,end:int,original:string,note:string>>").alias("flags"))
    done = repair.repair(given, _czech(forms))
    stands = F.forall("flags", lambda f: (f["end"] <= F.length("text")) & ~F.contains(F.substring(F.col("text"), f["start"] + 1, f["end"] - f["start"]), F.lit("'")))
    return done.select("word", "text", F.size("flags").alias("n_flags"), stands.alias("placed"))


@query(f"SELECT doc_id, md5(regexp_replace({SEEDED_SQL}, '(\\p{{L}})-[ \\t]*\\n[ \\t]*(\\p{{Ll}})', '\\1\\2', 'g')) AS digest FROM documents")
def dehyphenate_basic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(layout.join_hyphens(F.lit("text"), seeded())).alias("digest"))


@query(f"""WITH {DICTIONARY_SQL}, runs AS (SELECT doc_id, lang, unnest(regexp_extract_all({SEEDED_SQL}, '[\\p{{L}}\\p{{N}}_-]+(?:[ \\t]*\\n[ \\t]*[\\p{{L}}\\p{{N}}_-]+)*')) AS r FROM documents),
broken AS (SELECT doc_id, lang, unnest(list_filter(list_transform(regexp_extract_all(' ' || regexp_replace(r, '([^-])([ \\t]*\\n[ \\t]*)', '\\1 \\2', 'g') || ' ', '(?:^|[^\\p{{L}}\\p{{N}}_-])\\p{{L}}+-(?:[ \\t]*\\n[ \\t]*)?\\p{{L}}+(?:[^\\p{{L}}\\p{{N}}_-])'), lambda x: {strip_sql('x')}), lambda x: x <> '')) AS b FROM runs),
parts AS (SELECT doc_id, lang, b, regexp_replace(b, '-\\s*', '') AS whole, regexp_replace(b, '-\\s*', '-') AS dashed, contains(b, chr(10)) AS cut FROM broken),
judged AS (SELECT *, {known_sql('q.lang', 'q.whole')} AS whole_known, ({known_sql('q.lang', 'q.dashed')} OR ({known_sql('q.lang', "string_split(q.dashed, '-')[1]")} AND {known_sql('q.lang', "string_split(q.dashed, '-')[2]")})) AS dashed_known FROM parts q)
SELECT d.doc_id, count(*) FILTER (WHERE NOT dashed_known AND (whole_known OR (cut AND regexp_matches(string_split(dashed, '-')[2], '^\\p{{Ll}}')))) AS joined, count(*) FILTER (WHERE NOT dashed_known AND NOT whole_known AND cut AND regexp_matches(string_split(dashed, '-')[2], '^\\p{{Ll}}')) AS guessed,
count(*) FILTER (WHERE NOT dashed_known AND (whole_known OR (cut AND regexp_matches(string_split(dashed, '-')[2], '^\\p{{Ll}}')))) + count(*) FILTER (WHERE NOT dashed_known AND NOT whole_known AND cut AND regexp_matches(string_split(dashed, '-')[2], '^\\p{{Ll}}')) AS n_flags,
any_value(length({SEEDED_SQL.replace('text', 'd.text')})) - CAST(coalesce(sum(length(b) - length(whole)) FILTER (WHERE NOT dashed_known AND (whole_known OR (cut AND regexp_matches(string_split(dashed, '-')[2], '^\\p{{Ll}}')))), 0) AS BIGINT) AS n_chars
FROM documents d LEFT JOIN judged j ON j.doc_id = d.doc_id GROUP BY d.doc_id""")  # fmt: skip
def dehyphenate_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("page_index"), F.lit(0).alias("block_no"), "lang", F.lit("text").alias("label"), seeded().alias("text"))
    done = layout.dehyphenate(docs, dictionary(spark, sf_dir))
    return done.select("doc_id", "joined", "guessed", F.size("flags").cast("long").alias("n_flags"), F.length("text").cast("long").alias("n_chars"))


def _html(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("</td><td>"), "n_name", F.lit("</td></tr>"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<table>"), text.joined(row, "\n", "n_nationkey"), F.lit("</table>")).alias("html"))
    return rows


@query("SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS row_no, CAST(n_nationkey AS VARCHAR) AS key, n_name AS name FROM nation")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _html(spark, sf_dir).select("n_regionkey", F.posexplode(parse.html_rows(F.col("html"))).alias("row_no", "r"))
    return rows.select("n_regionkey", "row_no", F.col("r")[0].alias("key"), F.col("r")[1].alias("name"))


@query("""WITH r AS (SELECT n_regionkey, '| ' || n_nationkey || ' | ' || n_name || ' |' AS line, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
SELECT n_regionkey, string_agg(line || CASE WHEN i = 1 THEN chr(10) || '|---|---|' ELSE '' END, chr(10) ORDER BY i) AS md FROM r GROUP BY n_regionkey""")  # fmt: skip
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html(spark, sf_dir).select("n_regionkey", render.markdown_table(F.col("html")).alias("md"))


@query("""WITH r AS (SELECT n_regionkey, n_name || ' & x y' AS a, CAST(n_nationkey AS VARCHAR) AS b, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i FROM nation)
SELECT n_regionkey, string_agg(a || chr(9) || b, chr(10) ORDER BY i) AS tsv, string_agg('| ' || a || ' | ' || b || ' |' || CASE WHEN i = 1 THEN chr(10) || '|---|---|' ELSE '' END, chr(10) ORDER BY i) AS md, string_agg(a || ' ' || b, chr(10) ORDER BY i) AS lines FROM r GROUP BY n_regionkey""")  # fmt: skip
def table_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities, line breaks and cells and rows that are never closed, as TSV, Markdown and lines."""
    row = F.concat(F.lit("<tr><td>"), "n_name", F.lit(" &amp; x<br/>y<TD>"), F.col("n_nationkey").cast("string"))
    html = F.col("html")
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<table>"), text.joined(row, "\n", "n_nationkey")).alias("html"))
    return rows.select("n_regionkey", parse.table_text(html).alias("tsv"), render.markdown_table(html).alias("md"), F.array_join(parse.block_lines(F.lit("table"), html), "\n").alias("lines"))


@query("SELECT page_id, md5(array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(html, '(?i)</tr>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), '[\\t ]+', ' ', 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> ''), chr(10))) AS digest FROM pages")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of web pages without their tags."""
    bare = F.regexp_replace(F.regexp_replace("html", "(?i)</tr>", "\n"), "<[^>]*>", " ")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.array_join(parse.block_lines(F.lit("text"), bare), "\n")).alias("digest"))


_BARE = "replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<\\|ref\\|>.*?<\\|/ref\\|>', ' ', 'g'), '(?s)<\\|det\\|>.*?<\\|/det\\|>', ' ', 'g'), '<\\|[^|>]*\\|>', ' ', 'g'), '<PAGE>', ' ')"
_UNMARKED = "CASE WHEN regexp_extract({x}, '^\\s*(\\S+)', 1) IN ('-', '*') OR regexp_matches({x}, '^\\s{{0,3}}#{{1,6}}(\\s|$)') THEN regexp_replace({x}, '^\\s*\\S+', '') WHEN length({x}) >= 3 AND trim({x}) <> '' AND trim(translate({x}, '-:|', '')) = '' THEN '' ELSE {x} END"
_CLEAN = f"""replace(replace(array_to_string(list_transform(string_split(regexp_replace({_BARE}, '(?i)</tr>|<br\\s*/?>', chr(10), 'g'), chr(10)),
lambda x: {_UNMARKED.format(x=f"regexp_replace(x, '(?i)</?(?:{'|'.join(text.TABLE_TAGS)})[^>]*>', ' ', 'g')")}), chr(10)), '**', ''), '__', '')"""


@query(f"SELECT page_id, md5(trim(regexp_replace(replace({_CLEAN}, '|', ' '), '\\s+', ' ', 'g'))) AS digest FROM pages")
def clean_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.collapse(text.clean_model_text(F.col("html")))).alias("digest"))


_FOLD = ("äöüßéèñóáíúçêàâîôûëïœÄÖÜÉÈÑÓÁÍÚÇÊÀ", "aouseenoaiuceaaioueioAOUEENOAIUCEA")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line that isn't empty, in plain letters, and the same with one character changed; doc_id % 3 is the mode."""
    plain = F.when(F.octet_length("line") == F.length("line"), F.col("line")).otherwise(F.regexp_replace(F.translate("line", *_FOLD), r"[^\x00-\x7F]", "?"))
    # a line's plain letters are as many as its own, so that none is written out for those that are empty
    rows = lines(spark, sf_dir).where("line <> ''").select("doc_id", "no", (F.col("doc_id") % 3).cast("int").alias("mode"), "line", plain.alias("truth"))
    at = F.pmod(F.col("doc_id") + F.col("no"), F.length("truth")).cast("int")
    return rows.withColumn("reading", F.concat(F.substring("truth", F.lit(1), at), F.lit("~"), F.substring("truth", at + 2, F.length("truth"))))


_PAIRS_SQL = f"""{BLOCKS_SQL}, t AS (SELECT doc_id, no, CAST(doc_id % 3 AS INT) AS mode, line, regexp_replace(translate(line, '{_FOLD[0]}', '{_FOLD[1]}'), '[^\\x00-\\x7F]', '?', 'g') AS truth FROM lines),
pairs AS (SELECT *, truth[1:(doc_id + no) % length(truth)] || '~' || truth[(doc_id + no) % length(truth) + 2:] AS reading FROM t WHERE truth <> '')"""


@query(f"WITH {_PAIRS_SQL} SELECT mode, round(sum(levenshtein(truth, reading) / greatest(length(truth), 1) * length(truth)) / sum(length(truth)), 9) AS cer, count(*) AS pages FROM pairs GROUP BY mode")
def cer_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rates of all lines."""
    scored = _pairs(spark, sf_dir).withColumn("cer", score.cer(F.col("truth"), F.col("reading"))).withColumn("chars", F.length("truth"))
    return score.by_group(scored, "mode").select("mode", F.round("cer", 9).alias("cer"), "pages")


_LOST = "length(line) - length(translate(line, 'éíá', ''))"


@query(f"""WITH {_PAIRS_SQL}, s AS (SELECT mode, levenshtein(truth, reading) / length(truth) AS cer, length(line) - length(translate(line, '{python.ACCENTED}', '')) AS total, CASE WHEN mode = 1 THEN {_LOST} ELSE 0 END AS lost FROM pairs)
SELECT mode, bool_and(cer <= 0.03) AS cer_ok, coalesce(sum(total - lost) / nullif(sum(total), 0) >= 0.95, TRUE) AS accents_ok FROM s GROUP BY mode""")  # fmt: skip
def accuracy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates on errors and on accents, which readings of one mode have lost."""
    read = F.when(F.col("mode") == 1, F.translate("line", "éíá", "eia")).otherwise(F.col("line"))
    return score.gate(_pairs(spark, sf_dir).withColumn("cer", score.cer(F.col("truth"), F.col("reading"))).withColumn("accents", python.accents_of(F.col("line"), read)), "mode")


@query("SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE b.text <> ''")
def benchmark_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that stand in documents, word for word."""
    return score.passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _unaccented(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(spark, sf_dir).where("line <> ''").select("doc_id", "no", F.col("line").alias("truth"), F.translate("line", "éíá", "eia").alias("reading"))


@query(f"""WITH {BLOCKS_SQL}, c AS (SELECT unnest(['é→e', 'í→i', 'á→a']) AS confusion, unnest([sum(length(line) - length(replace(line, 'é', ''))), sum(length(line) - length(replace(line, 'í', ''))), sum(length(line) - length(replace(line, 'á', '')))]) AS n FROM lines)
SELECT confusion, CAST(n AS BIGINT) AS n FROM c WHERE n > 0""")  # fmt: skip
def confusion_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest confusions over all lines (at most twelve: the report's length)."""
    return score.confusions(score.scores(_unaccented(spark, sf_dir)))


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, CAST(sum(length(line) - length(translate(line, '{python.ACCENTED}', ''))) AS BIGINT) AS accents, CAST(sum(length(line) - length(translate(line, '{python.ACCENTED}', '')) - ({_LOST})) AS BIGINT) AS accents_right,
round(sum(({_LOST}) / length(line)), 6) AS cer, CAST(0 AS DOUBLE) AS cer_plain FROM lines WHERE line <> '' GROUP BY doc_id""")  # fmt: skip
def accent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accents read right in each document's lines, and error rates with and without marks."""
    scored = score.scores(_unaccented(spark, sf_dir)).withColumn("cer_plain", score.cer_without_marks(F.col("truth"), F.col("reading")))
    return scored.groupBy("doc_id").agg(F.sum("accents.total").alias("accents"), F.sum("accents.right").alias("accents_right"), F.round(F.sum("cer"), 6).alias("cer"), F.sum("cer_plain").alias("cer_plain"))


@query("SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text), '\\s+', ' ', 'g'))) AS digest, md5(strip_accents(text)) AS plain FROM documents")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(score.normalise(F.col("text"))).alias("digest"), F.md5(python.fold_of(F.col("text"))).alias("plain"))


@query(f"SELECT doc_id, md5(array_to_string(list_filter(string_split_regex(regexp_replace({SEEDED_SQL}, '([\\p{{L}}\\p{{N}}_])-\\s*\\n\\s*([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g'), '\\s+'), lambda x: x <> ''), ' ')) AS digest FROM documents")
def compared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(text.plain_words(seeded()), " ")).alias("digest"))


def _layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns with one word in twenty changed."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.plain_words(F.col("text")).alias("a"))
    return turns.withColumn("b", F.transform("a", lambda w, i: F.when(i % 20 == 7, F.concat(w, F.lit("~"))).otherwise(w)))


_COMPARED = "regexp_replace(replace(translate(text, '’‘‚„“”–—', chr(39) || chr(39) || ',\"\"\"--'), '…', '...'), '([\\p{L}\\p{N}_])-\\s*\\n\\s*([\\p{L}\\p{N}_])', '\\1\\2', 'g')"


@query(f"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex({_COMPARED}, '\\s+'), lambda x: x <> '') AS w FROM conversations), d AS (SELECT conv_id, turn, w, len(w) AS n, (len(w) + 12) // 20 AS k FROM w),
x AS (SELECT conv_id, turn, w, unnest(generate_series(8, n, 20)) AS i FROM d)
SELECT d.conv_id, d.turn, CAST(d.n - d.k AS INT) AS agreed, CAST((i - 8) // 20 + 1 AS INT) AS id, CASE WHEN i IS NOT NULL THEN 'word' END AS kind, array_to_string(x.w[greatest(1, i - 6):i - 1], ' ') AS before, x.w[i] AS a, x.w[i] || '~' AS b, array_to_string(x.w[i + 1:i + 6], ' ') AS "after"
FROM d LEFT JOIN x ON x.conv_id = d.conv_id AND x.turn = d.turn""")  # fmt: skip
def layer_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.disagreements(_layers(spark, sf_dir), ["conv_id", "turn"], "a", "b")


@query("""WITH w AS (SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations)
SELECT conv_id, turn, CAST((n + 12) // 20 AS INT) AS word_diffs, 0 AS block_diffs, round(100.0 * (n - (n + 12) // 20) / greatest(n, 1), 6) AS agreement FROM w""")  # fmt: skip
def layer_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.agreement(_layers(spark, sf_dir), ["conv_id", "turn"], "a", "b").withColumn("agreement", F.round("agreement", 6))


@query("""WITH r AS (SELECT doc_id, doc_id % 4 = 0 AS cap, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE text END AS truth, CASE WHEN doc_id % 2 = 0 THEN '' ELSE text END AS reading FROM documents), n AS (SELECT *, trim(regexp_replace(truth, '\\s+', ' ', 'g')) = '' AS blank, length(trim(regexp_replace(reading, '\\s+', ' ', 'g'))) AS said FROM r)
SELECT doc_id, concat_ws(', ', CASE WHEN cap THEN 'hit cap' END, CASE WHEN blank AND said > 0 THEN 'INVENTED ' || said END, CASE WHEN NOT blank AND said = 0 THEN 'EMPTY' END) AS note FROM n""")  # fmt: skip
def report_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", score.note(n % 4 == 0, F.when(n % 3 == 0, " ").otherwise(F.col("text")), F.when(n % 2 == 0, "").otherwise(F.col("text"))).alias("note"))


@query()
def runaway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", guards.is_runaway(F.col("text"), F.lit(False)).alias("runaway"))


@query()
def trim_runaway(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("__shares", python.packed_shares_of(F.col("text"))).select("doc_id", F.length(guards.trim_runaway(F.col("text"), F.col("__shares"))).alias("kept_chars"))


@query("""WITH d AS (SELECT doc_id, text, length(text) AS size, (length(text) + 999) // 1000 AS n FROM documents),
v AS (SELECT *, unnest(generate_series(1, n)) AS i FROM d), w AS (SELECT doc_id, i, (doc_id + CASE WHEN i = n AND n > 1 AND size - (n - 1) * 1000 < 200 THEN i - 1 ELSE i END) % 3 > 0 AS loops FROM v),
s AS (SELECT d.*, coalesce(g.last, 0) AS keep FROM d LEFT JOIN (SELECT doc_id, max(i) AS last FROM w WHERE NOT loops GROUP BY doc_id) g ON g.doc_id = d.doc_id),
h AS (SELECT *, text[1:keep * 1000] AS head FROM s), c AS (SELECT *, CASE WHEN contains(head, chr(10)) THEN length(head) - strpos(reverse(head), chr(10)) END AS line_end FROM h)
SELECT doc_id, CASE WHEN n = 0 OR keep = n THEN size WHEN keep = 0 THEN length(regexp_replace(text[1:200], '\\s+$', '')) WHEN line_end > keep * 1000 - 500 THEN length(regexp_replace(head[1:line_end], '\\s+$', '')) ELSE length(regexp_replace(head, '\\s+$', '')) END AS kept_chars FROM c""")  # fmt: skip
def trim_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where texts are cut, two of three of their windows being told to repeat themselves."""
    n = F.floor((F.length("text") + 999) / 1000).cast("int")
    shares = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.when((F.col("doc_id") + i) % 3 > 0, 0.1).otherwise(0.5))).otherwise(F.array().cast("array<double>"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", shares.alias("shares"))
    return docs.select("doc_id", F.length(guards.trim_runaway(F.col("text"), F.col("shares"))).cast("long").alias("kept_chars"))


@query(r"SELECT doc_id, '%USERPROFILE%\' || source || ' %USERPROFILE%\\' || doc_id || ' C:/Users/anna/ and %USERPROFILE%/' || doc_id || ' C--Users-<user>-' || source AS text, 4 AS n FROM documents")
def scrubbed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of either kind, one of them of another user, as JSON and as a folder's name."""
    n = F.col("doc_id").cast("string")
    line = F.concat(F.lit("C:\\Users\\ann\\"), "source", F.lit(" D:\\\\users\\\\Ann\\\\"), n, F.lit(" C:/Users/anna/ and c:/Users/Ann/"), n, F.lit(" c--users-ann-"), "source")
    scrubbed, found = text.scrub_user(F.col("t"), "ann")
    return table(spark, sf_dir, "documents").select("doc_id", line.alias("t")).select("doc_id", scrubbed.alias("text"), found.alias("n"))


@query("SELECT doc_id, md5(rtrim('# ' || source || chr(10) || w, ' ' || chr(10)) || chr(10)) AS digest FROM (SELECT doc_id, source, trim(regexp_replace(text, '[^\\p{L}]+', ' ', 'g')) AS w FROM documents)")
def cleaned_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words over many lines, some broken by hyphens, with page numbers and glyph marks between them, under a heading."""
    words = F.trim(F.regexp_replace("text", r"[^\p{L}]+", " "))
    broken = F.replace(F.replace(F.replace(words, F.lit(" s"), F.lit("\n12\ns")), F.lit(" e"), F.lit(" (cid:7)\ne")), F.lit("the"), F.lit("t-\nhe"))
    extracted = F.concat(F.lit("# "), "source", F.lit("\n"), broken, F.lit(" (cid:12)"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_extracted(extracted)).alias("digest"))


@query("SELECT doc_id, CAST(contains(lower(text), 'the') AS INT) + CAST(contains(lower(text), 'über') AS INT) AS n FROM documents")
def expected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.words_found(F.col("text"), ["The", "Über"])).alias("n"))


@query(f"""WITH {BLOCKS_SQL} SELECT doc_id, page_index, block_no, '' AS new_text, text AS old_text, block_no % 5 = 0 AS edited FROM blocks WHERE FALSE
UNION ALL SELECT doc_id, page_index, block_no, CASE WHEN block_no % 5 = 0 THEN 'edit ' || doc_id ELSE text END, text, block_no % 5 = 0 FROM blocks""")  # fmt: skip
def manual_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = blocks(spark, sf_dir).withColumn("old_text", F.col("text"))
    reviewed = given.where("block_no % 5 = 0").select(*BLOCK_KEYS, F.concat(F.lit("edit "), F.col("doc_id").cast("string")).alias("new_text"))
    return edits.manual_edits(given, reviewed, BLOCK_KEYS).select(*BLOCK_KEYS, F.col("text").alias("new_text"), "old_text", "edited")


@query(f"""WITH {BLOCKS_SQL}, f AS (SELECT doc_id, page_index, block_no, text, length(text) AS n FROM blocks WHERE length(text) >= 12),
segs AS (SELECT *, unnest([(0, 2), (2, 5), (5, 8), (8, n)]) AS s, unnest(['plain', 'repaired', 'suspicious', 'plain']) AS kind, unnest([0, 1, 2, 3]) AS segment FROM f)
SELECT doc_id, page_index, block_no, segment, kind, text[s[1] + 1:s[2]] AS text FROM segs""")  # fmt: skip
def review_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at given flags, one of which overlaps another and one of which is out of range."""
    flags = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("").alias("original"), F.lit("").alias("note")) for k, a, b in (("suspicious", 5, 8), ("repaired", 2, 5), ("suspicious", 7, 9), ("repaired", 9, 1 << 20))))
    rows = blocks(spark, sf_dir).where(F.length("text") >= 12).withColumn("flags", flags)
    return edits.review_segments(rows, BLOCK_KEYS)
