"""Words with their places, dictionary look-ups, hit rates, language votes and suspicious words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.lineage import checkpoint, kept, release
from folio.functions.python import placed_words_of
from folio.functions.text import WORD, word_list
from folio.schema import BLOCK_KEYS, SKIPPED

LEAST_LETTERS, RATE_WORDS = 2, 300
#: Fixed value: what flags say of unknown words.
UNKNOWN = "not in the dictionary"


def tokens(blocks: DataFrame, keys: list[str], text: str = "text", pattern: str = WORD) -> DataFrame:
    """Words of texts by the keys: start, end, word, number (ord), and whether it starts a sentence (starts)."""
    found = blocks.select(*keys, F.posexplode(placed_words_of(F.col(text), pattern)).alias("i", "w"))
    return found.select(*keys, "w.start", "w.end", "w.word", (F.col("i") + 1).alias("ord"), "w.starts")


def plain(word: Column) -> Column:
    return F.trim(F.replace(word, F.lit("’"), F.lit("'")))


def forms(word: Column) -> Column:
    """Dictionary forms that make a word known: itself, lower case if it is capitalised, title case if all capitals."""
    low = F.lower(word)
    title = F.concat(F.upper(F.substring(word, 1, 1)), F.substring(low, 2, 1 << 20))
    capital = F.substring(word, 1, 1) != F.substring(low, 1, 1)
    shouted = (word == F.upper(word)) & (F.length(word) > 1) & capital
    return F.array_distinct(F.array_compact(F.array(word, F.when(shouted | (word == title) & capital, low), F.when(shouted, title))))


#: Words with their verdicts that are broadcast at most: about 64 MB.
BROADCAST_WORDS = 1_000_000
#: Parts into which a word's places are dealt where they are joined by a shuffle.
SALTS = 32


def looked_up(rows: DataFrame, found: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Rows joined with a checkpointed table of different words: by broadcast while that is small, else by a shuffle.

    In a shuffle a word's rows are dealt by their other columns, so that a word that stands everywhere isn't one task's.
    """
    if found.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        return rows.join(F.broadcast(found), on, how)
    left, right = _salted(rows, found, on)
    return left.join(right, [*on, "__salt"], how).drop("__salt")


def known_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """lang, word, available, known and strict of distinct words (lang, word).

    A word is found by one of its forms, or by all its hyphenated parts. Where a language has no dictionary a word
    counts as known but not strictly so.
    """
    asked = words.select("lang", "word").distinct()
    split = F.split(plain(F.col("word")), "-")
    whole = F.array(F.struct(F.lit(0).alias("part"), plain(F.col("word")).alias("w")))
    parts = F.when(F.size(split) > 1, F.transform(split, lambda w, i: F.struct((i + 1).alias("part"), w.alias("w"))))
    looked = asked.select("lang", "word", F.size(split).alias("parts"), F.explode(F.concat(whole, F.coalesce(parts, F.array().cast("array<struct<part:int,w:string>>")))).alias("x")).select("lang", "word", "parts", "x.part", F.explode(forms(F.col("x.w"))).alias("form"))
    listed = dictionary.select("lang", "form", F.lit(True).alias("hit"))
    hits = looked.join(listed, ["lang", "form"], "left").groupBy("lang", "word", "parts").agg(F.collect_set(F.when(F.col("hit"), F.col("part"))).alias("hits"))
    found = F.array_contains("hits", 0) | ((F.col("parts") > 1) & (F.size(F.array_remove("hits", 0)) == F.col("parts")))
    has = dictionary.select("lang").distinct().withColumn("available", F.lit(True))
    joined = hits.join(F.broadcast(has), "lang", "left")
    available = F.coalesce("available", F.lit(False))
    return joined.select("lang", "word", available.alias("available"), (found | ~available).alias("known"), (found & available).alias("strict"))


def known_forms(asked: DataFrame, dictionary: DataFrame) -> DataFrame:
    """lang, word and n of the different words (lang, word, n) that the dictionary holds; words without a lang are asked in all languages."""
    split = F.split(plain(F.col("word")), "-")
    whole = F.struct(F.lit(0).alias("part"), plain(F.col("word")).alias("w"))
    ways = F.when(F.size(split) > 1, F.concat(F.array(whole), F.transform(split, lambda w, i: F.struct((i + 1).alias("part"), w.alias("w"))))).otherwise(F.array(whole))
    looked = asked.select("*", F.size(split).alias("parts"), F.explode(ways).alias("x")).select(*asked.columns, "parts", "x.part", F.explode(forms(F.col("x.w"))).alias("form"))
    hits = looked_up(looked, dictionary.select("lang", "form"), ["lang", "form"] if "lang" in asked.columns else ["form"]).groupBy("lang", "word", "parts", "n").agg(F.collect_set("part").alias("hits"))
    return hits.where(F.array_contains("hits", 0) | ((F.col("parts") > 1) & (F.size(F.array_remove("hits", 0)) == F.col("parts")))).select("lang", "word", "n")


def _commonest(found: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """A checkpointed table of different words by their counts n: the commonest, BROADCAST_WORDS at most, and all others if there are any."""
    if found.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS:
        return found, None
    least, total = None, 0
    for n, words in found.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).toLocalIterator():
        total += words
        if total > BROADCAST_WORDS:
            break
        least = n
    return (found.where(F.lit(False)), found) if least is None else (found.where(F.col("n") >= least), found.where(F.col("n") < least))


def _salted(rows: DataFrame, found: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    salt = F.pmod(F.xxhash64(*(c for c in rows.columns if c not in on)), F.lit(SALTS)).cast("int")
    return rows.withColumn("__salt", salt), found.select("*", F.explode(F.array(*map(F.lit, range(SALTS)))).alias("__salt"))


def found_in(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Rows joined with a checkpointed table of different words with their counts n: only rows of its rarer words are shuffled."""
    common, rare = _commonest(found)
    met = rows.join(F.broadcast(common), on)
    if rare is None:
        return met.drop("n")
    left, right = _salted(rows.join(F.broadcast(common.select(on)), on, "left_anti"), rare, on)
    return met.unionByName(left.join(right, [*on, "__salt"]).drop("__salt")).drop("n")


def not_in(rows: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """Rows whose words aren't in a checkpointed table of different words, which is used in the same way."""
    common, rare = _commonest(found)
    rest = rows.join(F.broadcast(common.select(on)), on, "left_anti")
    if rare is None:
        return rest
    left, right = _salted(rest, rare.select(on), on)
    return left.join(right, [*on, "__salt"], "left_anti").drop("__salt")


def hit_rates(texts: DataFrame, keys: list[str], dictionary: DataFrame, text: str = "text", tried: list[str] | None = None, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """Share of a text's first RATE_WORDS words (of two letters or more) that its lang's dictionary knows, or those of `tried`.

    Without words 0; null without a dictionary. Words are looked up once each; a text's own stay in its row.
    """
    first = F.slice(F.filter(word_list(F.col(text)), lambda w: F.length(w) >= LEAST_LETTERS), 1, RATE_WORDS)
    own = ["lang"] if tried is None else []
    given = keep(texts.select(*keys, *own, first.alias("words")))
    asked = given.select(*own, F.explode("words").alias("word")).groupBy(*own, "word").agg(F.count("*").alias("n"))
    known = known_forms(asked, dictionary)
    each = given.select(*keys, *own, F.explode("words").alias("word"))
    has = F.broadcast(dictionary.select("lang").distinct().withColumn("__has", F.lit(True)))
    if tried is not None:
        by_word = checkpoint(known.where(F.col("lang").isin(*tried)).groupBy("word").agg(F.collect_set("lang").alias("langs"), F.max("n").alias("n")))
        hits = found_in(each, by_word, ["word"]).select(*keys, F.explode("langs").alias("lang"))
        counted = given.select(*keys, F.explode(F.array(*map(F.lit, tried)).cast("array<string>")).alias("lang"), F.size("words").alias("n"))
    else:
        hits = found_in(each, checkpoint(known), ["lang", "word"]).select(*keys, "lang")
        counted = given.select(*keys, "lang", F.size("words").alias("n"))
    both = counted.withColumn("hits", F.lit(0)).unionByName(hits.select("*", F.lit(0).alias("n"), F.lit(1).alias("hits")))
    rates = both.groupBy(*keys, "lang").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).join(has, "lang", "left")
    rate = F.coalesce(F.col("hits") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    return rates.select(*keys, "lang", F.when(F.col("__has"), rate).alias("rate"))


def vote(cs: Column, en: Column) -> Column:
    """The likelier of two languages from their rates, which are null without a dictionary."""
    return F.when(cs.isNotNull() & en.isNotNull(), F.when(en > cs, "en").otherwise("cs")).when(en.isNotNull(), F.when(en >= 0.5, "en").otherwise("cs")).when(cs.isNotNull(), F.when(cs >= 0.5, "cs").otherwise("en")).otherwise("cs")


def best_language(rates: DataFrame, keys: list[str]) -> DataFrame:
    """The language of the highest rate for each key; the first by name on a tie."""
    return rates.where("rate IS NOT NULL").groupBy(*keys).agg(F.min_by("lang", F.struct(-F.col("rate"), F.col("lang"))).alias("language"), F.max("rate").alias("rate"))


def chosen_language(option: Column, detected: Column, available: Column, fallback: str = "cs") -> Column:
    """An explicit option counts; otherwise what was detected, if its dictionary is there."""
    return F.when(option != "auto", option).when(available, detected).otherwise(fallback)


def protected(word: Column, starts: Column, personal: list[str] | None = None) -> Column:
    """Capitalised within a sentence, or on the personal list."""
    own = F.lower(word).isin([w.lower() for w in personal]) if personal else F.lit(False)
    return own | (F.rlike(word, F.lit(r"^\p{Lu}")) & ~starts)


def apart_from(places: DataFrame, taken: DataFrame) -> DataFrame:
    """Places (keys of a block, start, end) that overlap none of the taken ones, by one sweep over both in order of start.

    A place is free if what begins before it ends by its start, and what begins after it does so at its end or later.
    """
    columns = [c for c in places.columns if c not in ("start", "end")]
    extra = [F.lit(None).cast(places.schema[c].dataType).alias(c) for c in columns if c not in BLOCK_KEYS]
    both = places.select(*columns, "start", "end", F.lit(False).alias("__taken")).unionByName(taken.select(*BLOCK_KEYS, *extra, "start", "end", F.lit(True).alias("__taken")))
    up, down = (W.partitionBy(*BLOCK_KEYS).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow) for order in (("start", "end", F.desc("__taken")), (F.desc("start"), F.desc("end"), F.desc("__taken"))))
    ends = F.max(F.when(F.col("__taken"), F.col("end"))).over(up)
    begins = F.min(F.when(F.col("__taken"), F.col("start"))).over(down)
    swept = both.withColumns({"__ends": ends, "__begins": begins}).where("NOT __taken")
    free = F.coalesce(F.col("__ends") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("__begins") >= F.col("end"), F.lit(True))
    return swept.where(free).select(*places.columns)


def suspicious(blocks: DataFrame, dictionary: DataFrame, taken: DataFrame | None = None, personal: list[str] | None = None, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """Flags of unknown, unprotected words (blocks have a lang) that overlap none of the `taken` flags.

    Texts are cut into words once; words are looked up once each, and only the unknown ones leave their block's row.
    """
    shown = blocks.where(~F.col("label").isin(*SKIPPED))
    placed = shown.select(*BLOCK_KEYS, "lang", placed_words_of(F.col("text"), WORD).alias("w"))
    wanted = F.filter("w", lambda w: (F.length(w["word"]) >= LEAST_LETTERS) & ~protected(w["word"], w["starts"], personal))
    open_ = keep(placed.select(*BLOCK_KEYS, "lang", wanted.alias("w")).where(F.size("w") > 0))
    release(blocks.sparkSession)
    asked = open_.select("lang", F.explode("w.word").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    known = checkpoint(known_forms(asked, dictionary))
    release(blocks.sparkSession)
    each = open_.select(*BLOCK_KEYS, "lang", F.explode("w").alias("w")).select(*BLOCK_KEYS, "lang", "w.start", "w.end", "w.word")
    # where a language has no dictionary no word is unknown
    found = not_in(each.join(F.broadcast(dictionary.select("lang").distinct()), "lang", "left_semi"), known, ["lang", "word"])
    if taken is not None:
        found = apart_from(found, taken)
    return found.select(*BLOCK_KEYS, "start", "end", F.lit("suspicious").alias("kind"), F.col("word").alias("original"), F.lit(UNKNOWN).alias("note"))
