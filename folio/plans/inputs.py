"""Tables that queries derive from the driver's, by formulas that mean the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.functions.lineage import checkpoint
from folio.functions.text import word_list
from folio.sources.files import read_table

#: Labels by turns for blocks made of lines.
TURNS = ["title", "text", "text", "image", "image_caption", "text", "list", "header", "page_number", "footer", "text", "table_caption"]
LINES_A_PAGE = 12
#: Documents of its language in which a word must be seen to be in the derived dictionary.
SEEN = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of pages of LINES_A_PAGE lines; block_no counts within the page, no within the document."""
    d, n = F.col("doc_id"), F.col("no")
    cut = F.when(n % 2 == 0, F.regexp_replace("line", r"\.+$", "")).otherwise(F.col("line"))
    text = F.when((d + n) % 3 == 0, F.lower(cut)).otherwise(cut)
    x1, y1 = ((d * 31 + n * 17) % 500).cast("int"), ((d * 13 + n * 97) % 900).cast("int")
    box = F.struct(x1.alias("x1"), y1.alias("y1"), (x1 + 400).alias("x2"), F.least(F.lit(999), y1 + 20 + (n % 5) * 15).alias("y2"))
    label = F.element_at(F.array(*map(F.lit, TURNS)), ((d * 7 + n * 5) % 12).cast("int") + 1)
    return lines(spark, sf_dir).select("doc_id", F.floor(n / LINES_A_PAGE).cast("int").alias("page_index"), (n % LINES_A_PAGE).alias("block_no"), "no", "lang", label.alias("label"), box.alias("box"), text.alias("text"), text.alias("raw_text"))


BLOCKS_SQL = f"""
lines AS (SELECT doc_id, lang, CAST(unnest(generate_series(0, len(l) - 1)) AS INT) AS no, unnest(l) AS line FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents)),
cut AS (SELECT *, CASE WHEN no % 2 = 0 THEN regexp_replace(line, '\\.+$', '') ELSE line END AS c, CAST((doc_id * 31 + no * 17) % 500 AS INT) AS x1, CAST((doc_id * 13 + no * 97) % 900 AS INT) AS y1 FROM lines),
blocks AS (SELECT doc_id, CAST(no // {LINES_A_PAGE} AS INT) AS page_index, CAST(no % {LINES_A_PAGE} AS INT) AS block_no, no, lang,
  {TURNS}[CAST((doc_id * 7 + no * 5) % 12 AS INT) + 1] AS label, x1, y1, x1 + 400 AS x2, least(999, y1 + 20 + (no % 5) * 15) AS y2,
  CASE WHEN (doc_id + no) % 3 = 0 THEN lower(c) ELSE c END AS text FROM cut)"""


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang and form: words seen in SEEN documents of a language or more; checkpointed, as a dictionary is a given table."""
    docs = table(spark, sf_dir, "documents")
    seen = docs.select("doc_id", "lang", F.explode(F.array_distinct(word_list(F.col("text")))).alias("form"))
    return checkpoint(seen.groupBy("lang", "form").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN).select("lang", "form"))


def words_sql(text: str) -> str:
    """A SQL list of the words of a text without tags: runs of word characters, each cut to the word that begins it."""
    runs = f"regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_''’-]+')"
    return f"list_filter(list_transform({runs}, lambda r: regexp_extract(r, '^(\\p{{L}}+(?:[-''’]\\p{{L}}+)*)(?:$|[-''’])', 1)), lambda w: w <> '')"


DICTIONARY_SQL = f"dictionary AS (SELECT lang, form FROM (SELECT DISTINCT doc_id, lang, unnest({words_sql('text')}) AS form FROM documents) GROUP BY lang, form HAVING count(*) >= {SEEN})"


def known_sql(lang: str, word: str) -> str:
    """Whether a word without a hyphen is in the dictionary by itself or by its other case forms."""
    low, title = f"lower({word})", f"(upper({word}[1:1]) || lower({word}[2:]))"
    has = lambda w: f"EXISTS (SELECT 1 FROM dictionary z WHERE z.lang = {lang} AND z.form = {w})"
    capital = f"{word}[1:1] <> lower({word}[1:1])"
    shouted = f"({word} = upper({word}) AND length({word}) > 1 AND {capital})"
    return f"({has(word)} OR (({shouted} OR ({word} = {title} AND {capital})) AND {has(low)}) OR ({shouted} AND {has(title)}))"


SEEDED_SQL = "regexp_replace(replace(replace(replace(text, ' of ', ' - '), ', ', ',,'), 'fi', 'ﬁ'), '(\\p{L}{4})(\\p{Ll}{4})', '\\1-' || chr(10) || '\\2', 'g')"


def seeded(text: str = "text") -> Column:
    """Text with spaced hyphens, doubled commas, ligatures and words broken by hyphens."""
    t = F.replace(F.replace(F.replace(F.col(text), F.lit(" of "), F.lit(" - ")), F.lit(", "), F.lit(",,")), F.lit("fi"), F.lit("ﬁ"))
    return F.regexp_replace(t, r"(\p{L}{4})(\p{Ll}{4})", "$1-\n$2")


#: Runs of word characters, and the word that begins one, as SQL.
RUN_SQL = "[\\p{L}\\p{N}_''’-]+"
WORD_OF_RUN_SQL = "regexp_extract(run, '^(\\p{L}+(?:[-''’]\\p{L}+)*)(?:$|[-''’])', 1)"


def tokens_sql(source: str, keys: str) -> str:
    """SQL for the words of column t of a source with their starts."""
    run = "[\\p{L}\\p{N}_''’-]+"
    return f"""SELECT {keys}, t, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(runs[1:i - 1], lambda x: length(x))), 0) AS INT) AS start,
  regexp_extract(runs[i], '^(\\p{{L}}+(?:[-''’]\\p{{L}}+)*)(?:$|[-''’])', 1) AS word
  FROM (SELECT {keys}, t, gaps, runs, unnest(generate_series(1, len(runs))) AS i FROM (SELECT {keys}, t, string_split_regex(t, '{run}') AS gaps, regexp_extract_all(t, '{run}') AS runs FROM {source}))
  WHERE regexp_extract(runs[i], '^(\\p{{L}}+(?:[-''’]\\p{{L}}+)*)(?:$|[-''’])', 1) <> ''"""


def strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
