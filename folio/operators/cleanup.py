"""Unknown words set right by the dictionary: forms within two letters, found by deletion neighbourhoods.

Two words within d edits of each other leave a common string once up to d letters are taken out of each. So the words
asked for and the forms of the dictionary both give the strings that deletions leave of them, the two sides meet by a hash
of these, and what meets is compared. Words are asked for once each, those with a form one edit away only so far.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.lineage import checkpoint
from folio.operators.edits import apply_edits
from folio.operators.lexicon import UNKNOWN, looked_up, plain, protected
from folio.schema import BLOCK_KEYS, EDIT

#: Edits at most, and letters that a word needs for a second one.
RADIUS, LEAST_FAR = 2, 5
#: What flags say of words that were set right.
CLEANED = "set right by the dictionary"


def deletions(word: Column, most: int) -> Column:
    """The strings that up to `most` (2 at most) deletions leave of a word, itself included."""
    n = F.length(word)

    def without(i: Column) -> Column:
        return F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n))

    def without_two(i: Column, j: Column) -> Column:
        return F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, j - i - 1), F.substring(word, j + 1, n))

    none = F.array().cast("array<string>")
    out = F.array(word)
    if most >= 1:
        out = F.concat(out, F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), without)).otherwise(none))
    if most >= 2:
        firsts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
        pairs = F.flatten(F.transform(firsts, lambda i: F.transform(F.sequence(i + 1, F.greatest(n, i + 1)), lambda j: without_two(i, j))))
        out = F.concat(out, F.when(n > 1, pairs).otherwise(none))
    return F.array_distinct(out)


def neighbours(words: DataFrame, dictionary: DataFrame, radius: int = RADIUS) -> DataFrame:
    """lang, word, form and distance: the dictionary's forms within `radius` edits of distinct words (lang, word)."""
    longest = dictionary.groupBy("lang").agg(F.max(F.length("form")).alias("longest"))
    # a word that is longer than any form by more than that has none, and would leave very many strings
    asked = words.select("lang", "word").distinct().join(longest, "lang").where(F.length("word") <= F.col("longest") + radius)
    key = lambda side: F.xxhash64("lang", side)
    left = asked.select("lang", "word", F.explode(deletions(F.col("word"), radius)).alias("left")).select("lang", "word", key("left").alias("key"))
    right = dictionary.select("lang", "form").distinct().select("lang", "form", F.explode(deletions(F.col("form"), radius)).alias("right")).select(F.col("lang").alias("its"), "form", key("right").alias("key"))
    met = left.join(right, "key").where((F.col("lang") == F.col("its")) & (F.abs(F.length("word") - F.length("form")) <= radius))
    # the distance is -1 beyond the radius
    return met.select("lang", "word", "form", F.levenshtein("word", "form", radius).alias("distance")).where("distance >= 0").distinct()


def _asked(words: DataFrame) -> DataFrame:
    """Words as they stand, and in lower case where they are capitalised, with what their letters were."""
    word = plain(F.col("word"))
    low = F.lower(word)
    shouted = (word == F.upper(word)) & (F.length(word) > 1) & (word != low)
    title = (F.substring(word, 1, 1) != F.substring(low, 1, 1)) & ~shouted
    kind = F.when(shouted, "upper").when(title, "title").otherwise("plain")
    ways = F.array_compact(F.array(F.struct(word.alias("asked"), F.lit("plain").alias("case")), F.when(word != low, F.struct(low.alias("asked"), kind.alias("case")))))
    return words.select("lang", "word").distinct().select("lang", "word", F.explode(ways).alias("x")).select("lang", "word", "x.asked", "x.case")


def corrections(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """lang, word, new and distance of distinct words (lang, word) that have exactly one nearest form within RADIUS edits.

    A capitalised word may be set right by a form in lower case, and keeps its capitals. Words of under LEAST_FAR letters
    change by one edit at most. A word with several nearest forms, or none, isn't listed; a word that is a form itself isn't either.
    """
    asked = checkpoint(_asked(words))
    near, open_ = None, asked
    for radius in range(1, RADIUS + 1):
        wanted = open_ if radius == 1 else open_.where(F.length("word") >= LEAST_FAR)
        met = neighbours(wanted.select("lang", F.col("asked").alias("word")), dictionary, radius).withColumnRenamed("word", "asked")
        found = checkpoint(wanted.join(met, ["lang", "asked"]).select("lang", "word", "case", "form", "distance"))
        near = found if near is None else near.unionByName(found)
        open_ = open_.join(found.select("lang", "word").distinct(), ["lang", "word"], "left_anti")
    cased = F.when(F.col("case") == "upper", F.upper("form")).when(F.col("case") == "title", F.concat(F.upper(F.substring("form", 1, 1)), F.expr("substring(form, 2)"))).otherwise(F.col("form"))
    each = near.select("lang", "word", "distance", cased.alias("new")).distinct().groupBy("lang", "word", "distance").agg(F.min("new").alias("new"), F.count("*").alias("n"))
    best = each.groupBy("lang", "word").agg(F.min_by(F.struct("distance", "new", "n"), "distance").alias("b"))
    return best.where("b.n = 1 AND b.distance > 0").select("lang", "word", "b.new", "b.distance")


def cleaned(blocks: DataFrame, dictionary: DataFrame, personal: list[str] | None = None) -> DataFrame:
    """Blocks (with flags and a lang) whose suspicious words are set right where the dictionary has one nearest form; they are read twice.

    Only words flagged as not in the dictionary change, none that is capitalised within a sentence or on the personal list.
    The flag goes; the change leaves one of kind `repaired` with the word as it was, so that it can be undone.
    """
    wanted = F.filter("flags", lambda f: (f["kind"] == "suspicious") & (f["note"] == UNKNOWN))
    told = blocks.select(*BLOCK_KEYS, "lang", F.explode(wanted).alias("f")).select(*BLOCK_KEYS, "lang", "f.start", "f.end", F.col("f.original").alias("word"))
    if personal:
        told = told.where(~protected(F.col("word"), F.lit(True), personal))
    told = checkpoint(told)
    found = checkpoint(corrections(told, dictionary).select("lang", "word", "new"))
    edit = F.struct("start", "end", "new", F.lit("repaired").alias("kind"), F.lit(CLEANED).alias("note"))
    edits = looked_up(told, found, ["lang", "word"]).groupBy(*BLOCK_KEYS).agg(F.collect_list(edit).alias("__edits"))
    merged = blocks.join(edits, BLOCK_KEYS, "left").withColumn("__edits", F.coalesce("__edits", F.array().cast(f"array<{EDIT}>")))
    gone = F.transform("__edits", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end")))
    kept = F.filter("flags", lambda f: (f["kind"] != "suspicious") | ~F.array_contains(gone, F.struct(f["start"].alias("start"), f["end"].alias("end"))))
    return apply_edits(merged.withColumn("flags", kept), "__edits").drop("__edits")
