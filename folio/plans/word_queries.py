"""Queries of words set right, of words known by affix rules, and of word differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.text import word_list
from folio.operators import affixes, cleanup, score
from folio.plans.inputs import DICTIONARY_SQL, dictionary, table, words_sql
from folio.plans.registry import fixed, query, values

#: Letters beyond ASCII as single bytes, so that SQL counts edits of letters; words hold no digits or marks.
_BYTES = "translate({}, 'ßäçèéêíñóöüÄÇÈÉÊÍÑÓÖÜ', '0123456789!#$%&()*+=/')"


def _typo(word: Column) -> Column:
    """A word without its third letter, with it twice, or with its second and fourth letter put in wrong, by its length."""
    n = F.length(word)
    part = lambda a, b=1 << 20: F.substring(word, a, b)
    return F.when(n % 3 == 0, F.concat(part(1, 2), part(4))).when(n % 3 == 1, F.concat(part(1, 3), part(3))).otherwise(F.concat(part(1, 1), F.lit("q"), part(3, 1), F.lit("x"), part(5)))


_TYPO_SQL = "CASE length(form) % 3 WHEN 0 THEN form[1:2] || form[4:] WHEN 1 THEN form[1:3] || form[3:] ELSE form[1:1] || 'q' || form[3:3] || 'x' || form[5:] END"


@query(f"""WITH {DICTIONARY_SQL}, asked AS (SELECT DISTINCT lang, unnest({words_sql('text')}) AS word FROM documents UNION SELECT lang, {_TYPO_SQL} FROM dictionary WHERE length(form) >= 6),
kinds AS (SELECT lang, word, lower(word) AS low, word = upper(word) AND length(word) > 1 AND word <> lower(word) AS shouted, word[1:1] <> lower(word)[1:1] AS capital FROM asked),
ways AS (SELECT lang, word, word AS asked, 'plain' AS kind FROM kinds UNION ALL SELECT lang, word, low, CASE WHEN shouted THEN 'upper' WHEN capital THEN 'title' ELSE 'plain' END FROM kinds WHERE word <> low),
met AS (SELECT w.lang, w.word, w.kind, d.form, levenshtein(w.bytes, d.bytes) AS distance FROM (SELECT *, {_BYTES.format('asked')} AS bytes FROM ways) w
  JOIN (SELECT lang, form, {_BYTES.format('form')} AS bytes, form[1:length(form) // 3] AS p1, form[length(form) // 3 + 1:2 * length(form) // 3] AS p2, form[2 * length(form) // 3 + 1:] AS p3 FROM dictionary) d -- two edits leave one of three parts as it is
  ON d.lang = w.lang AND abs(length(d.form) - length(w.asked)) <= 2 AND (contains(w.asked, d.p1) OR contains(w.asked, d.p2) OR contains(w.asked, d.p3))),
near AS (SELECT DISTINCT lang, word, distance, CASE kind WHEN 'upper' THEN upper(form) WHEN 'title' THEN upper(form[1:1]) || form[2:] ELSE form END AS new FROM met WHERE distance <= CASE WHEN length(word) >= {cleanup.LEAST_FAR} THEN 2 ELSE 1 END),
counted AS (SELECT lang, word, distance, min(new) AS new, count(*) AS n, min(distance) OVER (PARTITION BY lang, word) AS least FROM near GROUP BY lang, word, distance)
SELECT lang, word, new, CAST(distance AS INT) AS distance FROM counted WHERE distance = least AND n = 1 AND distance > 0""")  # fmt: skip
def corrected_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of all documents, and every word of the derived dictionary with a slip in it, set right where one form is nearest."""
    words = dictionary(spark, sf_dir)
    own = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(word_list(F.col("text")))).alias("word"))
    slips = words.where(F.length("form") >= 6).select("lang", _typo(F.col("form")).alias("word"))
    return cleanup.corrections(own.unionByName(slips), words)


#: A dictionary's rules, written for the query: a second suffix goes to the first one's forms, one ending needs another, a prefix crosses.
RULES = [
    (False, "S", "", "s", "[^sy]", True, ["G"]),
    (False, "S", "y", "ies", "[^aeiou]y", True, []),
    (False, "E", "", "en", ".", True, ["S", "N"]),
    (False, "E", "e", "ing", "[a-z]e", False, []),
    (False, "G", "", "'s", ".", True, []),
    (False, "Q", "", "qu", ".", True, ["N", "E"]),
    (True, "U", "", "un", ".", True, []),
    (True, "R", "", "re", "[^aeiou]", False, ["S"]),
]
_RULE_NAMES = "prefix, flag, strip, \"add\", condition, crosses, more"
SETTINGS = [("NEEDAFFIX", "N"), ("FORBIDDENWORD", "F"), ("ONLYINCOMPOUND", "O"), ("COMPOUNDFLAG", "C"), ("COMPOUNDEND", "Z"), ("COMPOUNDMIN", "4")]
#: Flags of a stem, by how long it is and what it begins with.
_STEM_FLAGS = [("S", "length(form) % 2 = 0"), ("E", "length(form) % 3 = 0"), ("Q", "length(form) = 5"), ("U", "form < 'k'"), ("R", "form >= 'k'"), ("C", "length(form) IN (4, 6)"), ("Z", "length(form) = 7"), ("N", "length(form) = 8"), ("F", "length(form) = 9"), ("O", "length(form) = 10")]


def written_dictionary(spark: SparkSession, words: DataFrame) -> affixes.Dictionary:
    """Stems that are words of the derived dictionary, with flags by a rule, and the rules above for each language."""
    flags = F.array_compact(F.array(*(F.when(F.expr(when), F.lit(flag)) for flag, when in _STEM_FLAGS)))
    langs = words.select("lang").distinct()
    rules = fixed(spark, RULES, "prefix boolean, flag string, strip string, add string, condition string, crosses boolean, more array<string>")
    return affixes.Dictionary(words.select("lang", F.col("form").alias("stem"), flags.alias("flags")), langs.join(F.broadcast(rules)), langs.join(F.broadcast(fixed(spark, SETTINGS, "name string, value string"))))


def _made(words: DataFrame) -> DataFrame:
    """Words of the dictionary with endings and beginnings that rules may allow, and two and three of them in one."""
    endings = ["s", "en", "ens", "en's", "s's", "qu", "quen", "quens", "ing", "ies"]
    form = F.col("form")
    bare = F.expr("substring(form, 1, length(form) - 1)")
    made = [F.concat(form, F.lit(x)) for x in endings] + [F.concat(bare, F.lit(x)) for x in ("ing", "ies")]
    made += [F.concat(F.lit(p), x) for p in ("un", "re") for x in (form, *made[:4])]
    pair = F.concat(form, F.lower("form"))
    made += [pair, F.concat(pair, F.lit("s")), F.concat(pair, form), F.concat(F.lit("un"), pair), F.concat(F.lit("un"), pair, F.lit("ens"))]
    return words.select("lang", F.explode(F.array(*made)).alias("word"))


_MADE_SQL = """unnest([form || x FOR x IN ['s', 'en', 'ens', 'en''s', 's''s', 'qu', 'quen', 'quens', 'ing', 'ies']] || [form[1:length(form) - 1] || x FOR x IN ['ing', 'ies']]
 || ['un' || form || x FOR x IN ['', 's', 'en', 'ens', 'en''s']] || ['re' || form || x FOR x IN ['', 's', 'en', 'ens', 'en''s']] || [form || lower(form), form || lower(form) || 's', form || lower(form) || form, 'un' || form || lower(form), 'un' || form || lower(form) || 'ens'])"""


@query(f"""WITH RECURSIVE {DICTIONARY_SQL}, rules AS ({values(RULES, _RULE_NAMES)}),
stems AS (SELECT lang, form AS stem, list_filter([{', '.join(f"CASE WHEN {w} THEN '{f}' END" for f, w in _STEM_FLAGS)}], lambda x: x IS NOT NULL) AS flags FROM dictionary),
asked AS (SELECT DISTINCT lang, unnest({words_sql('text')}) AS word FROM documents UNION SELECT lang, {_MADE_SQL} FROM dictionary),
one AS (SELECT lang, stem, flags, stem[1:length(stem) - length(strip)] || "add" AS form, flag AS inner_flag, more AS suffix_more, more AS last_more, crosses FROM stems, rules WHERE NOT prefix AND suffix(stem, strip) AND length(stem) > length(strip) AND regexp_matches(stem, condition || '$')),
two AS (SELECT o.lang, stem, flags, form[1:length(form) - length(strip)] || "add" AS form, inner_flag, list_concat(suffix_more, more) AS suffix_more, more AS last_more, o.crosses AND r.crosses AS crosses FROM one o, rules r WHERE NOT prefix AND list_contains(suffix_more, flag) AND suffix(form, strip) AND length(form) > length(strip) AND regexp_matches(form, condition || '$')),
ended AS (SELECT lang, stem, flags, stem AS form, NULL::VARCHAR AS inner_flag, []::VARCHAR[] AS suffix_more, []::VARCHAR[] AS last_more, TRUE AS crosses FROM stems UNION ALL FROM one UNION ALL FROM two),
begun AS (SELECT *, NULL::VARCHAR AS prefix_flag, []::VARCHAR[] AS prefix_more, TRUE AS prefix_crosses FROM ended
  UNION ALL SELECT e.lang, stem, flags, "add" || form[length(strip) + 1:], inner_flag, suffix_more, last_more, e.crosses, flag, more, r.crosses FROM ended e, rules r WHERE prefix AND starts_with(stem, strip) AND regexp_matches(stem, '^' || condition)),
held AS (SELECT *, list_contains(flags, 'F') AS forbidden, NOT (inner_flag IS NULL AND prefix_flag IS NULL AND list_contains(flags, 'N')) AND NOT (inner_flag IS NOT NULL AND prefix_flag IS NULL AND list_contains(last_more, 'N')) AS complete FROM begun
  WHERE (inner_flag IS NULL OR list_contains(flags, inner_flag) OR list_contains(prefix_more, inner_flag)) AND (prefix_flag IS NULL OR list_contains(flags, prefix_flag) OR list_contains(suffix_more, prefix_flag)) AND (inner_flag IS NULL OR prefix_flag IS NULL OR (crosses AND prefix_crosses))),
judged AS (SELECT a.lang, a.word, coalesce(bool_or(h.complete AND NOT h.forbidden AND NOT list_contains(h.flags, 'O')), FALSE) AS known, coalesce(bool_or(h.forbidden), FALSE) AS forbidden FROM asked a LEFT JOIN held h ON h.lang = a.lang AND h.form = a.word GROUP BY ALL),
parts AS (SELECT DISTINCT lang, form, prefix_flag IS NOT NULL AS begins, inner_flag IS NOT NULL AS ends, list_contains(flags, 'C') AS anywhere, list_contains(flags, 'Z') AS at_end FROM held WHERE complete AND NOT forbidden AND length(form) >= 4 AND (list_contains(flags, 'C') OR list_contains(flags, 'Z')) AND NOT (inner_flag IS NOT NULL AND prefix_flag IS NOT NULL)),
reach AS (SELECT lang, word, 0 AS place FROM judged WHERE NOT known AND NOT forbidden AND length(word) >= 8
  UNION SELECT r.lang, r.word, r.place + r.size FROM (SELECT lang, word, place, unnest(generate_series(4, length(word) - place)) AS size FROM reach) r JOIN parts p ON p.lang = r.lang AND p.form = r.word[r.place + 1:r.place + r.size]
    WHERE r.size < length(r.word) AND (p.anywhere OR (p.at_end AND r.place + r.size = length(r.word))) AND (NOT p.begins OR r.place = 0) AND (NOT p.ends OR r.place + r.size = length(r.word)))
SELECT lang, word FROM judged WHERE known AND NOT forbidden UNION SELECT lang, word FROM reach WHERE place = length(word)""")  # fmt: skip
def affixed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words of all documents, and which of those made from the dictionary's, a dictionary of stems and rules knows."""
    words = dictionary(spark, sf_dir)
    own = table(spark, sf_dir, "documents").select("lang", F.explode(F.array_distinct(word_list(F.col("text")))).alias("word"))
    return affixes.recognised(own.unionByName(_made(words)), written_dictionary(spark, words))


#: Words of a document from which on one reading of it has a part taken out, another put in and a third moved to its end.
LEAST_MOVED = 60


@query(f"""WITH w AS (SELECT doc_id, list_transform({words_sql('text')}, lambda x, i: x || '#' || i) AS w FROM documents), n AS (SELECT doc_id, w, len(w) AS n FROM w),
cuts AS (SELECT doc_id, w, n, unnest([1, 2, 3, 4]) AS id FROM n WHERE n >= {LEAST_MOVED}),
parts AS (SELECT doc_id, n, id, CASE WHEN id = 1 THEN 'word' ELSE 'block' END AS kind,
  array_to_string(CASE id WHEN 1 THEN w[4:9] WHEN 2 THEN w[25:30] WHEN 3 THEN w[34:39] ELSE w[n - 5:n] END, ' ') AS before,
  CASE id WHEN 1 THEN array_to_string(w[10:14], ' ') WHEN 3 THEN array_to_string(w[40:47], ' ') ELSE '' END AS a,
  CASE id WHEN 2 THEN 'p0 p1 p2 p3 p4 p5 p6' WHEN 4 THEN array_to_string(w[40:47], ' ') ELSE '' END AS b,
  array_to_string(CASE id WHEN 1 THEN w[15:20] WHEN 2 THEN w[31:36] WHEN 3 THEN w[48:53] ELSE [] END, ' ') AS "after" FROM cuts)
SELECT n.doc_id, CAST(CASE WHEN n.n >= {LEAST_MOVED} THEN n.n - 13 ELSE n.n END AS INT) AS agreed, p.id, p.kind, p.before, p.a, p.b, p."after" FROM n LEFT JOIN parts p ON p.doc_id = n.doc_id""")  # fmt: skip
def moved_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two readings of every document, words numbered: in the second a part is missing, one is new, and one stands at the end."""
    words = F.transform(word_list(F.col("text")), lambda w, i: F.concat(w, F.lit("#"), (i + 1).cast("string")))
    given = table(spark, sf_dir, "documents").select("doc_id", words.alias("a"))
    part = lambda lo, hi: F.slice("a", lo, hi - lo + 1)
    new = F.array(*(F.lit(f"p{i}") for i in range(7)))
    second = F.concat(part(1, 9), part(15, 30), new, part(31, 39), F.slice("a", F.lit(48), F.size("a")), part(40, 47))
    both = given.withColumn("b", F.when(F.size("a") >= LEAST_MOVED, second).otherwise(F.col("a")))
    return score.disagreements(both, ["doc_id"], "a", "b")


@query("""SELECT source || '/p.' || doc_id AS page, mode, md5(text) AS truth, md5(CASE mode WHEN 'fast' THEN lower(text) ELSE text END) AS reading, CAST(CASE mode WHEN 'fast' THEN length(regexp_replace(text, '[^A-Z]', '', 'g')) ELSE 0 END AS INT) AS changed
FROM documents, (VALUES ('fast'), ('quality')) m(mode) WHERE doc_id % 7 > 0 AND NOT (mode = 'quality' AND doc_id % 5 = 0)""")  # fmt: skip
def paired_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings in two modes of every document's text, written as files, with their truths; some have none, and some truths are read once."""
    docs = table(spark, sf_dir, "documents").select(F.concat("source", F.lit("/p."), F.col("doc_id").cast("string")).alias("page"), "doc_id", "text")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZÄÇÈÉÊÍÑÓÖÜ", "abcdefghijklmnopqrstuvwxyzäçèéêíñóöü")
    file = lambda end, text, when: F.when(when, F.struct(F.concat("page", F.lit(end)).alias("path"), text.alias("text")))
    n = F.col("doc_id")
    files = docs.select(F.explode(F.array_compact(F.array(file(".gt.txt", F.col("text"), n % 7 > 0), file(".fast.raw.txt", low, n >= 0), file(".quality.raw.txt", F.col("text"), n % 5 > 0), file(".notes.txt", F.col("text"), n >= 0)))).alias("f")).select("f.*")
    pairs = score.pair_files(files)
    differ = F.length("truth") - F.length(F.translate("truth", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return pairs.select("page", "mode", F.md5("truth").alias("truth"), F.md5("reading").alias("reading"), F.when(F.col("mode") == "fast", differ).otherwise(0).alias("changed"))
