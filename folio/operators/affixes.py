"""Words known by a dictionary of stems and affix rules, without its forms being written out.

A word is read from its ends: rules whose ending it has are joined by that ending, what they leave is read once more for a
second suffix and for a prefix, and what is left in the end is joined with the stems. A reading holds if the stem's flags and
those of the other affixes allow each affix. Words that have none are read as compounds: their parts are joined with the
stems, and a word is known if such parts cover it from beginning to end. All of it goes by distinct words, so that its work
follows the words asked for and not the forms that the dictionary could make. Stems are sent to the words, in blocks of checked
size, so that readings and parts are neither shuffled nor written; a part is looked up only where parts reach its beginning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.lineage import checkpoint, kept, release
from folio.operators.lexicon import forms, known_words, plain

#: Rules that are broadcast at most, and languages.
BROADCAST_ROWS = 100_000
#: Stems that are broadcast at a time at most: about 80 MB.
STEMS = 500_000
#: Rounds that take a compound's parts one after the other, before all parts of what is left are taken at once.
ROUNDS = 3
#: Letters that a part of a compound has at least, unless a dictionary says another number.
LEAST_PART = 3
_FLAGS = "array<string>"


@dataclass
class Dictionary:
    """stems (lang, stem, flags), rules (lang, prefix, flag, strip, add, condition, crosses, more), settings (lang, name, value)."""

    stems: DataFrame
    rules: DataFrame
    settings: DataFrame


def _small(table: DataFrame) -> DataFrame:
    """A checkpointed table, to be broadcast while it is small."""
    cut = checkpoint(table)
    return F.broadcast(cut) if cut.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else cut


def _with_stems(readings: DataFrame, stems: DataFrame, judge: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What `judge` leaves of readings joined with a kept table of stems by what is left of them."""
    blocks = -(-stems.count() // STEMS)
    on = ["lang", "rest"]
    if blocks <= 1:
        return judge(readings.join(F.broadcast(stems), on))
    number = F.pmod(F.xxhash64(*on), F.lit(blocks))
    return reduce(DataFrame.unionByName, [kept(judge(readings.join(F.broadcast(stems.where(number == block)), on))) for block in range(blocks)])


def _set(dictionary: Dictionary) -> DataFrame:
    """A row for each language that has stems: its flags by name (null where it has none) and the least part of a compound."""
    flag = lambda name: F.max(F.when(F.col("name") == name, F.col("value"))).alias(name)
    named = dictionary.settings.groupBy("lang").agg(*map(flag, ("NEEDAFFIX", "FORBIDDENWORD", "ONLYINCOMPOUND", "COMPOUNDFLAG", "COMPOUNDBEGIN", "COMPOUNDMIDDLE", "COMPOUNDEND", "COMPOUNDMIN")))
    longest = dictionary.stems.groupBy("lang").agg(F.max(F.length("stem")).alias("longest"))
    least = F.greatest(F.lit(1), F.coalesce(F.col("COMPOUNDMIN").try_cast("int"), F.lit(LEAST_PART)))
    return longest.join(named, "lang", "left").withColumn("least", least)


def _has(flags: Column, flag: Column) -> Column:
    return F.coalesce(F.array_contains(flags, flag), F.lit(False))


def _unaffixed(words: DataFrame) -> DataFrame:
    """Readings of words (lang, word and others) before any affix is taken off."""
    none = F.array().cast(_FLAGS)
    empty = F.lit(None).cast("string")
    return words.select("*", F.col("word").alias("rest"), empty.alias("inner"), none.alias("suffix_more"), none.alias("last_more"), F.lit(True).alias("suffix_crosses"), empty.alias("prefix"), none.alias("prefix_more"), F.lit(True).alias("prefix_crosses"))


def _ends(readings: DataFrame, rules: DataFrame, prefix: bool, longest: int) -> DataFrame:
    """Readings joined with the rules of which their rest has the added letters at its end, with what is left as `base`."""
    n = F.length("rest")
    size = F.explode(F.sequence(F.lit(0), F.least(n, F.lit(longest)))).alias("__size")
    cut = readings.select("*", size)
    end = F.substring("rest", F.lit(1), F.col("__size")) if prefix else F.expr("right(rest, __size)")
    met = cut.withColumn("add", end).join(rules, ["lang", "add"])
    bare = F.expr("substring(rest, __size + 1)") if prefix else F.substring("rest", F.lit(1), n - F.col("__size"))
    base = F.concat("strip", bare) if prefix else F.concat(bare, F.col("strip"))
    # an affix leaves some of the word
    fits = F.rlike(base, F.concat(F.lit("^"), F.col("condition")) if prefix else F.concat("condition", F.lit("$")))
    return met.where((bare != "") & fits).withColumn("base", base).drop("__size", "add", "strip", "condition")


#: Rules of one end of a word, to be joined, and the length of their longest added letters.
Rules = tuple[DataFrame, int]


def _rules(dictionary: Dictionary, prefix: bool) -> Rules | None:
    own = dictionary.rules.where(F.col("prefix") == prefix).select("lang", "add", "flag", "strip", "condition", "crosses", "more")
    longest = own.agg(F.max(F.length("add")).alias("n")).first().n
    return None if longest is None else (_small(own), longest)


def _readings(words: DataFrame, suffixes: Rules | None = None, prefixes: Rules | None = None) -> DataFrame:
    """All readings of words: what is left of each when up to two suffixes and a prefix are taken off."""
    out = _unaffixed(words)
    names = out.columns
    if suffixes:
        one = _ends(out, suffixes[0], False, suffixes[1]).withColumns({"rest": F.col("base"), "inner": F.col("flag"), "suffix_more": F.col("more"), "last_more": F.col("more"), "suffix_crosses": F.col("crosses")}).select(names)
        two = _ends(one, suffixes[0], False, suffixes[1]).where(F.array_contains("more", F.col("inner")))
        two = two.withColumns({"rest": F.col("base"), "inner": F.col("flag"), "suffix_more": F.concat("suffix_more", "more"), "suffix_crosses": F.col("suffix_crosses") & F.col("crosses")}).select(names)
        out = out.unionByName(one).unionByName(two)
    if prefixes:
        begun = _ends(out, prefixes[0], True, prefixes[1]).withColumns({"rest": F.col("base"), "prefix": F.col("flag"), "prefix_more": F.col("more"), "prefix_crosses": F.col("crosses")}).select(names)
        out = out.unionByName(begun)
    return out


def _holds(flags: Column) -> Column:
    """Whether a stem with these flags allows the affixes of a reading."""
    inner, prefix = F.col("inner"), F.col("prefix")
    suffix_ok = inner.isNull() | _has(flags, inner) | _has(F.col("prefix_more"), inner)
    prefix_ok = prefix.isNull() | _has(flags, prefix) | _has(F.col("suffix_more"), prefix)
    crosses = inner.isNull() | prefix.isNull() | (F.col("suffix_crosses") & F.col("prefix_crosses"))
    return suffix_ok & prefix_ok & crosses


def _complete(flags: Column) -> Column:
    """Whether nothing is wanting: a stem or affix that needs a further affix has it."""
    need, inner, prefix = F.col("NEEDAFFIX"), F.col("inner"), F.col("prefix")
    stem = ~(inner.isNull() & prefix.isNull() & _has(flags, need))
    suffix = ~(inner.isNotNull() & prefix.isNull() & _has(F.col("last_more"), need))
    return stem & suffix & ~(prefix.isNotNull() & inner.isNull() & _has(F.col("prefix_more"), need))


def recognised(words: DataFrame, dictionary: Dictionary) -> DataFrame:
    """The distinct words (lang, word) that the dictionary knows as they are written.

    A stem that is forbidden makes nothing known, and its own forms are unknown whatever else would make them known.
    """
    asked = kept(words.select("lang", "word").where("word <> ''").distinct())
    release(words.sparkSession)
    told = _small(_set(dictionary))
    stems = kept(dictionary.stems.select("lang", F.col("stem").alias("rest"), "flags"))
    suffixes, prefixes = _rules(dictionary, False), _rules(dictionary, True)
    flags = F.col("flags")
    inner = _has(flags, F.col("ONLYINCOMPOUND")) | _has(F.col("suffix_more"), F.col("ONLYINCOMPOUND")) | _has(F.col("prefix_more"), F.col("ONLYINCOMPOUND"))
    forbidden = _has(flags, F.col("FORBIDDENWORD"))
    judge = lambda met: met.join(told, "lang").where(_holds(flags)).select("lang", "word", (_complete(flags) & ~inner & ~forbidden).alias("known"), forbidden.alias("forbidden"))
    met = _with_stems(_readings(asked, suffixes, prefixes), stems, judge)
    judged = kept(met.groupBy("lang", "word").agg(F.bool_or("known").alias("known"), F.bool_or("forbidden").alias("forbidden")))
    known = judged.where("known AND NOT forbidden").select("lang", "word")
    open_ = asked.join(judged.where("known OR forbidden"), ["lang", "word"], "left_anti")
    return known.unionByName(compounds(open_, told, stems, suffixes, prefixes))


def compounds(words: DataFrame, told: DataFrame, stems: DataFrame, suffixes: Rules | None, prefixes: Rules | None) -> DataFrame:
    """The distinct words that parts with the flags of compounds cover: stems, the first with a prefix, the last with suffixes.

    In each round parts are cut from the places that those before have reached, at first from the beginning. The few words
    of more parts than there are rounds are cut at all places at once.
    """
    makes = F.coalesce("COMPOUNDFLAG", "COMPOUNDBEGIN", "COMPOUNDMIDDLE", "COMPOUNDEND").isNotNull()
    # a part is no longer than the longest stem with an affix at either end
    added = max(rules[1] for rules in (suffixes, prefixes, (None, 0)) if rules)
    split = words.join(told.where(makes).select("lang", "least", (F.col("longest") + 2 * added).alias("most")), "lang").where(F.length("word") >= 2 * F.col("least"))
    at = split.select("lang", F.col("word").alias("whole"), "least", "most", F.lit(0).alias("i"))
    seen = covered = None
    for k in range(ROUNDS):
        met = kept(_parts(at, told, stems, k == 0, suffixes, prefixes).drop("start").distinct())
        done = met.where("i = length(whole)").select("lang", F.col("whole").alias("word"))
        covered = done if covered is None else covered.unionByName(done)
        at = met.where("i < length(whole)")
        at = at if seen is None else kept(at.join(seen, ["lang", "whole", "i"], "left_anti"))
        if at.isEmpty():
            return covered.distinct()
        seen = at.select("lang", "whole", "i") if seen is None else seen.unionByName(at.select("lang", "whole", "i"))
    begun = at.groupBy("lang", "whole", "least", "most").agg(F.collect_set("i").alias("begun"))
    everywhere = begun.select("lang", "whole", "least", "most", F.explode(F.sequence(F.array_min("begun"), F.length("whole") - F.col("least"))).alias("i"))
    pairs = _parts(everywhere, told, stems, False, suffixes, prefixes).groupBy("lang", "whole").agg(F.array_sort(F.collect_set(F.struct("start", "i"))).alias("parts"))
    # places that parts reach, one part after the other; those that end at a place begin before it
    reached = F.aggregate("parts", F.col("begun"), lambda at, p: F.when(F.array_contains(at, p["start"]), F.array_union(at, F.array(p["i"]))).otherwise(at))
    last = kept(pairs.join(begun.select("lang", "whole", "begun"), ["lang", "whole"]).where(F.array_contains(reached, F.length("whole"))).select("lang", F.col("whole").alias("word")))
    return covered.unionByName(last).distinct()


def _parts(at: DataFrame, told: DataFrame, stems: DataFrame, begins: bool, suffixes: Rules | None, prefixes: Rules | None) -> DataFrame:
    """The places (lang, whole, least, most, i) that one part reaches from others (start), which are all beginnings of words or none."""
    n, least = F.length("whole"), F.col("least")
    cut = at.select("*", F.explode(F.sequence(least, F.greatest(least, F.least(F.col("most"), n - F.col("i"))))).alias("size"))
    left = n - F.col("i") - F.col("size")
    # what is left holds a part at least; a part isn't the whole
    parts = cut.where((F.col("size") < n) & ((left == 0) | (left >= least))).select("lang", "whole", "least", "most", F.col("i").alias("start"), (F.col("i") + F.col("size")).alias("i"), F.expr("substring(whole, i + 1, size)").alias("word"))
    if begins:
        affixed = _readings(parts, prefixes=prefixes)
        role = F.col("COMPOUNDBEGIN")
    else:
        affixed = _unaffixed(parts).unionByName(_readings(parts.where("i = length(whole)"), suffixes).where("inner IS NOT NULL"))
        role = F.when(F.col("i") == n, F.col("COMPOUNDEND")).otherwise(F.col("COMPOUNDMIDDLE"))
    flags = F.col("flags")
    allowed = (_has(flags, F.col("COMPOUNDFLAG")) | _has(flags, role)) & _holds(flags) & _complete(flags) & ~_has(flags, F.col("FORBIDDENWORD"))
    judge = lambda met: met.join(told.drop("least", "longest"), "lang").where(allowed).select("lang", "whole", "least", "most", "start", "i")
    return _with_stems(affixed, stems, judge)


def listed_forms(words: DataFrame, dictionary: Dictionary) -> DataFrame:
    """lang and form: of the forms that would make distinct words (lang, word) known, those that the dictionary recognises.

    It stands for a list of all forms where these words are looked up. A language with stems has the empty form at least,
    as it has a dictionary whatever it knows.
    """
    word = plain(F.col("word"))
    ways = F.array_distinct(F.concat(F.array(word), F.split(word, "-")))
    asked = words.select("lang", "word").distinct().select("lang", F.explode(ways).alias("w")).distinct().select("lang", F.explode(forms(F.col("w"))).alias("word"))
    return recognised(asked, dictionary).select("lang", F.col("word").alias("form")).unionByName(dictionary.stems.select("lang", F.lit("").alias("form")).distinct())


def known(words: DataFrame, dictionary: Dictionary) -> DataFrame:
    """`lexicon.known_words` by stems and rules: case and hyphens as there."""
    asked = checkpoint(words.select("lang", "word").distinct())
    return known_words(asked, checkpoint(listed_forms(asked, dictionary)))
