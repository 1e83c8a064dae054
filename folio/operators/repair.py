"""Repairs of recognised text: character rules, soft letters, look-alike letters."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.lineage import checkpoint
from folio.functions.text import LIGATURES, mask_tags, matches
from folio.operators.edits import apply_edits
from folio.operators.lexicon import known_words, protected, tokens
from folio.schema import BLOCK_KEYS, EDIT, SKIPPED

#: Letters of the repaired language beside ASCII, and letters that soften.
CZECH = "áčďéěíňóřšťúůýžÁČĎÉĚÍŇÓŘŠŤÚŮÝŽ"
SOFT = {"d": "ď", "t": "ť", "D": "Ď", "T": "Ť"}
#: Letters of other alphabets with those that look alike, likeliest first.
LOOK_ALIKE = {
    "ż": "žz", "ź": "žz", "Ż": "ŽZ", "Ź": "ŽZ", "ł": "l", "Ł": "L", "ľ": "lť", "Ľ": "LŤ", "ĺ": "l", "ą": "aá",
    "ę": "ěeé", "ė": "ěe", "ć": "čc", "ś": "šs", "ń": "ňn", "ñ": "ňn", "ŕ": "řr", "Ś": "ŠS", "Ć": "ČC", "ő": "óo",
    "ű": "ůú", "ö": "óo", "ü": "ůú", "ä": "áa", "ë": "éě", "à": "áa", "è": "éě", "ì": "íi", "ò": "óo", "ù": "úů",
    "â": "áa", "ê": "ěé", "î": "íi", "ô": "óo", "û": "ůú", "ÿ": "ýy", "ã": "áa", "õ": "óo", "ç": "čc", "ğ": "g",
    "ş": "šs", "ı": "i", "ŭ": "ůu",
}
MOST_CANDIDATES, MOST_SOFT = 64, 4
#: Words whose apostrophe is a soft letter even though they are words without it.
SOFT_ANYWAY = ("bud", "Bud")
FOREIGN = rf"[^\x00-\x7F{CZECH}\P{{L}}]"
#: A word that holds a softening letter and an apostrophe, and touches nothing that belongs to a word.
_INNER = r"[\p{L}\p{N}_'’]"
APOSTROPHE_WORD = rf"(?<!{_INNER})\p{{L}}*[{''.join(SOFT)}]['’]\p{{L}}*(?!{_INNER})"
#: What flags say of each rule.
NOTES = {
    "quote": "R4: ,, is a low quotation mark", "dash": "R3: hyphen between spaces is a dash", "ligature": "R5: ligature",
    "marked": "R1: letter + apostrophe is ď/ť", "foreign": "letter does not exist in Czech",
    "look_alike": "R2: foreign letter replaced by its Czech look-alike", "plain": "d/t without its háček",
}
CHARACTER_RULES = f"[{''.join(LIGATURES)}]|,,|(?<=[\\p{{L}}\\p{{N}}_]) - (?=[\\p{{L}}\\p{{N}}_])"


def character_text(text: Column) -> Column:
    """A text after the character rules, where it holds no tags: ligatures, low quotes, dashes."""
    for a, b in LIGATURES.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    text = F.replace(text, F.lit(",,"), F.lit("„"))
    return F.regexp_replace(text, r"(?<=[\p{L}\p{N}_]) - (?=[\p{L}\p{N}_])", " – ")


def character_edits(text: Column) -> Column:
    """The same as an array of edits with places, tags left alone."""
    pieces = matches(mask_tags(text), CHARACTER_RULES)
    # a running sum of lengths; few pieces are expected, as only rules' matches cut the text
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(f"array<{EDIT}>").alias("edits"))

    def step(s: Column, x: Column) -> Column:
        new = F.when(x == ",,", "„").when(x == " - ", " – ")
        for a, b in LIGATURES.items():
            new = new.when(x == a, b)
        note = F.when(x == ",,", NOTES["quote"]).when(x == " - ", NOTES["dash"]).otherwise(NOTES["ligature"])
        to = s["at"] + F.length(x)
        edit = F.struct(s["at"].alias("start"), to.alias("end"), new.alias("new"), F.lit("repaired").alias("kind"), note.alias("note"))
        return F.struct(to.alias("at"), (s["i"] + 1).alias("i"), F.when(s["i"] % 2 == 1, F.concat(s["edits"], F.array(edit))).otherwise(s["edits"]).alias("edits"))

    return F.aggregate(pieces, start, step, lambda s: s["edits"])


def is_foreign(word: Column) -> Column:
    return F.rlike(word, F.lit(FOREIGN))


def look_alikes(word: Column) -> Column:
    """Candidates in order, the right-most letter varying fastest, MOST_CANDIDATES at most."""
    options = F.create_map(*(x for a, b in LOOK_ALIKE.items() for x in (F.lit(a), F.array(*map(F.lit, b)))))
    letters = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(options, c), F.array(c)))
    # a prefix list longer than needed is cut at once: only its first entries can begin the first candidates
    grown = F.aggregate(letters, F.array(F.lit("")), lambda done, more: F.slice(F.flatten(F.transform(done, lambda p: F.transform(more, lambda c: F.concat(p, c)))), 1, MOST_CANDIDATES))
    return grown


def soften_marked(word: Column) -> Column:
    """A word with each d' and t' softened."""
    for a, b in SOFT.items():
        word = F.regexp_replace(word, f"{a}['’]", b)
    return word


def softened(word: Column) -> Column:
    """All variants of a word with one or more of its first MOST_SOFT d and t softened."""
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    places = F.slice(F.filter(F.transform(letters, lambda c, i: F.when(c.isin(*SOFT), i)), lambda i: i.isNotNull()), 1, MOST_SOFT)
    soft = F.create_map(*(F.lit(x) for pair in SOFT.items() for x in pair))

    def variant(chosen: tuple[int, ...]) -> Column:
        here = F.array(*(F.get(places, F.lit(i)) for i in chosen))
        made = F.array_join(F.transform(letters, lambda c, i: F.when(F.array_contains(here, i), F.try_element_at(soft, c)).otherwise(c)), "")
        return F.when(F.size(places) > max(chosen), made)

    return F.array_compact(F.array(*(variant(chosen) for size in range(1, MOST_SOFT + 1) for chosen in combinations(range(MOST_SOFT), size))))


def foreign_words(words: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """Distinct words (lang, word) with a foreign letter: `new`, the first known look-alike, or null to flag them."""
    asked = words.where(is_foreign(F.col("word"))).select("lang", "word").distinct()
    if dictionary is None:
        return asked.withColumn("new", F.lit(None).cast("string"))
    own = known_words(asked, dictionary).select("lang", "word", "strict")
    tried = asked.select("lang", F.col("word").alias("old"), F.posexplode(look_alikes(F.col("word"))).alias("ord", "word")).where("word <> old")
    found = tried.join(known_words(tried, dictionary).where("strict").select("lang", "word"), ["lang", "word"]).groupBy("lang", F.col("old").alias("word")).agg(F.min_by("word", "ord").alias("new"))
    return asked.join(own.where("strict").select("lang", "word"), ["lang", "word"], "left_anti").join(found, ["lang", "word"], "left")


def unique_known(words: DataFrame, candidates: Column, dictionary: DataFrame) -> DataFrame:
    """Distinct words (lang, word) with `new`, where exactly one of their candidates is known."""
    tried = words.select("lang", "word").distinct().select("lang", F.col("word").alias("old"), F.explode(candidates).alias("word")).where("word <> old").distinct()
    known = tried.join(known_words(tried, dictionary).where("strict").select("lang", "word"), ["lang", "word"])
    return known.groupBy("lang", F.col("old").alias("word")).agg(F.min("word").alias("new"), F.count("*").alias("n")).where("n = 1").drop("n")


def marked_soft_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Words (lang, word) with d' or t' and the known word they stand for.

    A word whose last character is the apostrophe is left alone if it is a word without it, but for `bud`.
    """
    asked = words.select("lang", "word").distinct()
    quoted = F.rlike("word", F.lit("['’]$"))
    bare = asked.where(quoted).select("lang", F.col("word").alias("old"), F.regexp_replace("word", "['’]$", "").alias("word")).where(~F.col("word").isin(*SOFT_ANYWAY))
    closed = bare.join(known_words(bare, dictionary).where("known").select("lang", "word"), ["lang", "word"]).select("lang", F.col("old").alias("word"))
    return unique_known(asked.join(closed, ["lang", "word"], "left_anti"), F.array(soften_marked(F.col("word"))), dictionary)


def plain_soft_words(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Unknown words (lang, word) with d or t and the one known word that softening gives."""
    asked = words.where(F.rlike("word", F.lit("[dtDT]"))).select("lang", "word").distinct()
    unknown = asked.join(known_words(asked, dictionary).where("NOT known").select("lang", "word"), ["lang", "word"])
    return unique_known(unknown, softened(F.col("word")), dictionary)


def word_edits(blocks: DataFrame, dictionary: DataFrame, personal: list[str] | None = None, keep: Callable[[DataFrame], DataFrame] = checkpoint) -> DataFrame:
    """Edits and foreign-letter flags of blocks (with a lang) by the word rules; `new` is null for a flag."""
    shown = blocks.where(~F.col("label").isin(*SKIPPED))
    keys = [*BLOCK_KEYS, "lang"]

    def open_words(found: DataFrame) -> DataFrame:
        return found.where(~protected(F.col("word"), F.col("starts"), personal)).drop("starts", "ord")

    marked = checkpoint(open_words(tokens(shown, keys, pattern=APOSTROPHE_WORD)))
    first = checkpoint(marked.join(marked_soft_words(marked, dictionary), ["lang", "word"])).withColumn("note", F.lit(NOTES["marked"]))
    covered = first.select(*(F.col(k).alias(f"c_{k}") for k in BLOCK_KEYS), F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    meets = (F.col("c_start") < F.col("end")) & (F.col("start") < F.col("c_end"))
    for k in BLOCK_KEYS:
        meets = meets & (F.col(k) == F.col(f"c_{k}"))
    # only words that a rule may touch go on, and three branches read them
    touched = is_foreign(F.col("word")) | F.rlike("word", F.lit("[dtDT]"))
    rest = keep(open_words(tokens(shown, keys).where(touched).join(covered, meets, "left_anti")))
    foreign = rest.join(foreign_words(rest, dictionary), ["lang", "word"]).withColumn("note", F.when(F.col("new").isNull(), NOTES["foreign"]).otherwise(NOTES["look_alike"]))
    soft_asked = rest.where(~is_foreign(F.col("word")))
    soft = soft_asked.join(plain_soft_words(soft_asked, dictionary), ["lang", "word"]).withColumn("note", F.lit(NOTES["plain"]))
    columns = [*BLOCK_KEYS, "start", "end", "word", "new", "note"]
    return first.select(columns).unionByName(foreign.select(columns)).unionByName(soft.select(columns))


def repair(blocks: DataFrame, dictionary: DataFrame, personal: list[str] | None = None, keep: Callable[[DataFrame], DataFrame] = checkpoint, turn: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Blocks (with flags and a lang) after the character rules and, where lang is cs, the word rules; `turn` keeps what stands for the given ones."""
    skipped = F.col("label").isin(*SKIPPED)
    none = F.array().cast(f"array<{EDIT}>")
    first = (turn or keep)(apply_edits(blocks.withColumn("__edits", F.when(skipped, none).otherwise(character_edits(F.col("text")))), "__edits").drop("__edits"))
    found = word_edits(first.where("lang = 'cs'"), dictionary, personal, keep)
    edit = F.struct("start", "end", "new", F.lit("repaired").alias("kind"), "note")
    flag = F.struct(F.lit("foreign_letter").alias("kind"), "start", "end", F.col("word").alias("original"), "note")
    by_block = found.groupBy(*BLOCK_KEYS).agg(F.collect_list(F.when(F.col("new").isNotNull(), edit)).alias("__edits"), F.collect_list(F.when(F.col("new").isNull(), flag)).alias("__more"))
    joined = first.join(by_block, BLOCK_KEYS, "left").withColumn("__edits", F.coalesce("__edits", none)).withColumn("flags", F.when(F.col("__more").isNotNull(), F.concat("flags", "__more")).otherwise(F.col("flags")))
    return apply_edits(joined, "__edits").drop("__edits", "__more")
