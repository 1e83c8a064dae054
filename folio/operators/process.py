"""The whole path from raw page markup to finished pages, blocks and flags. Stages that several branches read are checkpointed."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.functions.lineage import Stages, checkpoint, kept
from folio.functions.text import joined
from folio.operators import guards, layout, lexicon, parse, repair
from folio.schema import BLOCK_KEYS, BOX, FLAG, NO_TEXT, PAGE_KEYS

#: Blocks with all their flags in, blocks out, flags moved along; `cleanup.cleaned` is one.
Cleanup = Callable[[DataFrame], DataFrame]
#: The languages that have rules of their own; a dictionary may hold any number of others.
LANGUAGES = ("cs", "en")
#: Columns of routed pages that may be left out.
OPTIONAL = {"mode": "string", "width_px": "int", "height_px": "int", "rotation": "int", "cancelled": "boolean", "timed_out": "boolean", "seconds": "double", "warnings": "array<string>", "layer": "string"}
#: Warnings of a reading, besides those of layout.
TIME_LIMIT, CANCELLED, RUNAWAY = "time_limit", "cancelled", "runaway"


class Finished(NamedTuple):
    """Blocks with their flags, the flags as a flat table, and a record of each page, blank ones included."""

    blocks: DataFrame
    flags: DataFrame
    pages: DataFrame


def route(pages: DataFrame, option: str = "born_digital") -> DataFrame:
    """Pages (layer, kind, is_blank) with the source that each is read from: its text layer, nothing, or recognition."""
    used = guards.use_text_layer(F.col("layer"), F.col("kind"), F.lit(option))
    return pages.withColumn("source", F.when(used, "text_layer").when(F.col("is_blank"), "blank").otherwise("ocr"))


def readings(pages: DataFrame, keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """Routed pages with what is left out filled in, `loops` where the raw text repeats itself, and `cut`, the text up to there, if so.

    Python sees a long text once to tell whether it loops, and once more where it does.
    """
    whole = pages.withColumns({name: (F.col(name) if name in pages.columns else F.lit(None)).cast(kind) for name, kind in OPTIONAL.items()})
    filled = whole.withColumns({"rotation": F.coalesce("rotation", F.lit(0)), "warnings": F.coalesce("warnings", F.array().cast("array<string>"))} | {c: F.coalesce(c, F.lit(False)) for c in ("cancelled", "timed_out")})
    told = filled.withColumn("loops", F.coalesce((F.col("source") == "ocr") & guards.is_runaway(F.when(F.col("source") == "ocr", F.col("raw")), F.col("hit_token_cap")), F.lit(False)))
    return keep(told.withColumn("cut", F.when(F.col("loops"), guards.trim_runaway(F.when(F.col("loops"), F.col("raw"))))))


def read_blocks(pages: DataFrame) -> DataFrame:
    """Blocks of routed pages (doc_id, page_index, source, layer, raw, hit_token_cap); text that loops is cut before."""
    return _blocks(readings(pages))


def _blocks(read: DataFrame) -> DataFrame:
    layers = read.where("source = 'text_layer'").select(*PAGE_KEYS, F.col("layer").alias("text"))
    from_layer = parse.text_layer_blocks(layers).select(*PAGE_KEYS, "block_no", "label", F.lit(None).cast(BOX).alias("box"), "text", F.col("text").alias("raw_text"))
    return parse.parse_raw(read.where("source = 'ocr'").select(*PAGE_KEYS, F.when(F.col("loops"), F.col("cut")).otherwise(F.col("raw")).alias("raw"))).unionByName(from_layer)


def _available(dictionary: DataFrame) -> list[str]:
    """Which of LANGUAGES have a dictionary, in their order."""
    found = {r.lang for r in dictionary.where(F.col("lang").isin(*LANGUAGES)).select("lang").distinct().collect()}
    return [x for x in LANGUAGES if x in found]


def _texts(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(*PAGE_KEYS).agg(joined("text", "\n", "block_no").alias("text"))


def page_languages(blocks: DataFrame, dictionary: DataFrame, option: str = "auto", keep: Callable[[DataFrame], DataFrame] = kept) -> DataFrame:
    """Each page's language: the option, or what its words vote for among the languages that have a dictionary."""
    rates = lexicon.hit_rates(_texts(blocks), PAGE_KEYS, dictionary, tried=list(LANGUAGES), keep=keep)
    voted = rates.groupBy(*PAGE_KEYS).agg(lexicon.vote(*(F.max(F.when(F.col("lang") == x, F.col("rate"))) for x in LANGUAGES)).alias("voted"))
    has = _available(dictionary)
    return voted.select(*PAGE_KEYS, lexicon.chosen_language(F.lit(option), F.col("voted"), F.col("voted").isin(*has) if has else F.lit(False)).alias("lang"))


def probe_language(lang: Column, has: list[str]) -> Column:
    """The language whose words tell how a page lies: its own if that has a dictionary, else the first that has."""
    return F.when(lang.isin(*has), lang).otherwise(has[0]) if has else lang


def _doubts(read: DataFrame, blocks: DataFrame, languages: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Pages that were read (keys), the share of their words that is known, and whether they may lie wrong."""
    has = _available(dictionary)
    probed = _texts(blocks).join(languages, PAGE_KEYS).withColumn("lang", probe_language(F.col("lang"), has))
    rates = lexicon.hit_rates(probed, PAGE_KEYS, dictionary)
    wrong = guards.wrong_orientation(F.col("text"), F.col("rate"), F.col("rate").isNotNull())
    judged = probed.join(rates.drop("lang"), PAGE_KEYS).select(*PAGE_KEYS, F.coalesce("rate", F.lit(1.0)).alias("rate"), wrong.alias("wrong"))
    open_ = (F.col("source") == "ocr") & ~F.col("cancelled") & ~F.col("timed_out")
    return read.join(judged, PAGE_KEYS, "left").select(*PAGE_KEYS, "rotation", "warnings", "cancelled", F.coalesce("rate", F.lit(0.0)).alias("rate"), (open_ & F.coalesce("wrong", F.lit(False))).alias("doubtful"))


def _warned(read: DataFrame, blocks: DataFrame) -> DataFrame:
    """Readings with all their warnings: what the engine told, then empty, out of time, cancelled and looping ones."""
    with_text = checkpoint(blocks.where(~F.col("label").isin(*NO_TEXT) & (F.trim("text") != "")).select(*PAGE_KEYS).distinct()).withColumn("has_text", F.lit(True))
    empty = (F.col("source") == "ocr") & F.col("has_text").isNull() & ~F.col("cancelled") & ~F.col("timed_out")
    more = F.array_compact(F.array(F.when(empty, layout.EMPTY), F.when(F.col("timed_out"), TIME_LIMIT), F.when(F.col("cancelled"), CANCELLED), F.when(F.col("loops"), RUNAWAY)))
    return read.join(with_text, PAGE_KEYS, "left").withColumn("warnings", F.array_distinct(F.concat("warnings", more))).drop("has_text")


def turn_again(read: DataFrame, blocks: DataFrame, languages: DataFrame, dictionary: DataFrame, probes: DataFrame, second: DataFrame, option: str = "auto") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Readings, blocks and languages after pages whose words are mostly unknown were probed and read once more.

    `probes` are rows of guards.best_rotation (doc_id, page_index, degrees, rate, cancelled, timed_out); `second` has
    readings by the rotation in all at which they were made. A page's second reading counts if more of its words are known.
    """
    doubts = checkpoint(_doubts(read, blocks, languages, dictionary))
    asked = doubts.where("doubtful").select(*PAGE_KEYS, "rotation")
    turns = checkpoint(guards.best_rotation(probes.join(asked.select(*PAGE_KEYS), PAGE_KEYS, "left_semi"), PAGE_KEYS).where("degrees <> 0"))
    wanted = asked.join(turns, PAGE_KEYS).select(*PAGE_KEYS, ((F.col("rotation") + F.col("degrees")) % 360).alias("rotation"))
    other = readings(second.join(wanted, [*PAGE_KEYS, "rotation"], "left_semi").withColumn("source", F.lit("ocr")))
    other_blocks = checkpoint(_blocks(other))
    other = checkpoint(_warned(other, other_blocks))
    other_rates = _doubts(other, other_blocks, languages, dictionary).select(*PAGE_KEYS, "rotation", "rate", "cancelled", "warnings")
    picked = checkpoint(layout.read_again(doubts.select(*PAGE_KEYS, "rotation", "rate", "warnings", "doubtful"), turns, other_rates, PAGE_KEYS).where("reread"))
    again = picked.select(*PAGE_KEYS)
    told = other.drop("warnings").join(picked.select(*PAGE_KEYS, "rotation", "warnings"), [*PAGE_KEYS, "rotation"])
    read = read.join(again, PAGE_KEYS, "left_anti").unionByName(told, allowMissingColumns=True)
    chosen = checkpoint(other_blocks.join(again, PAGE_KEYS, "left_semi"))
    spoken = languages.join(again, PAGE_KEYS, "left_anti").unionByName(page_languages(chosen, dictionary, option))
    return checkpoint(read), checkpoint(blocks.join(again, PAGE_KEYS, "left_anti").unionByName(chosen)), checkpoint(spoken)


def page_records(read: DataFrame) -> DataFrame:
    """A record of each page. Width and height are those of the image as it was read; a blank page has nothing else."""
    turned = F.col("rotation").isin(90, 270)
    blank = F.col("source") == "blank"
    unless = lambda value: F.when(~blank, value)
    raw = F.when(F.col("source") == "text_layer", F.col("layer")).when(F.col("source") == "ocr", F.col("raw"))
    return read.select(
        *PAGE_KEYS,
        "source",
        F.when(F.col("source") == "ocr", F.col("mode")).alias("mode"),
        F.when(turned, F.col("height_px")).otherwise(F.col("width_px")).alias("width_px"),
        F.when(turned, F.col("width_px")).otherwise(F.col("height_px")).alias("height_px"),
        F.coalesce(unless(F.col("rotation")), F.lit(0)).alias("rotation_applied"),
        F.coalesce(raw, F.lit("")).alias("raw"),
        F.coalesce(unless(F.col("warnings")), F.array().cast("array<string>")).alias("warnings"),
        "seconds",
    )


def records(pages: DataFrame) -> DataFrame:
    """The records that `process` gives of routed pages that are read once, which no dictionary changes."""
    raw = readings(pages)
    return page_records(_warned(raw, _blocks(raw)))


def _repaired(stages: Stages, blocks: DataFrame, languages: DataFrame, dictionary: DataFrame, personal: list[str] | None, repairs: bool, *needed: DataFrame) -> DataFrame:
    """Blocks in their pages' languages, arranged and repaired, with the flags of both; of all that was kept only this stays, and what is needed."""
    given = blocks.join(languages, PAGE_KEYS).withColumn("flags", F.array().cast(f"array<{FLAG}>"))
    next_ = lambda df: stages.turn(df, *needed)
    arranged = next_(layout.arrange(next_(given), dictionary, next_).drop("joined", "guessed"))
    return next_(repair.repair(arranged, dictionary, personal, stages.keep, next_)) if repairs else arranged


def _unknown(stages: Stages, repaired: DataFrame, dictionary: DataFrame, personal: list[str] | None) -> tuple[DataFrame, DataFrame]:
    """The flags that repaired blocks have, as a flat table, and those of unknown words apart from them."""
    own = repaired.select(*BLOCK_KEYS, F.explode("flags").alias("f")).select(*BLOCK_KEYS, "f.*")
    return own, lexicon.suspicious(repaired, dictionary, own.where(F.col("kind").isin("foreign_letter", "suspicious")), personal, stages.keep)


def flags(pages: DataFrame, dictionary: DataFrame, personal: list[str] | None = None, option: str = "auto", repairs: bool = True) -> DataFrame:
    """The flags that `process` gives of routed pages that are read once, without a cleanup; no finished block and no record is made for them."""
    stages = Stages(pages.sparkSession)
    blocks = stages.turn(_blocks(readings(pages, stages.keep)))
    languages = checkpoint(page_languages(blocks, dictionary, option, stages.keep))
    stages.only(blocks)
    repaired = _repaired(stages, blocks, languages, dictionary, personal, repairs)
    own, found = _unknown(stages, repaired, dictionary, personal)
    return own.unionByName(found)


def process(
    pages: DataFrame,
    dictionary: DataFrame,
    personal: list[str] | None = None,
    option: str = "auto",
    repairs: bool = True,
    cleanup: Cleanup | None = None,
    probes: DataFrame | None = None,
    second: DataFrame | None = None,
) -> Finished:
    """Finished blocks, flags and pages of routed pages.

    With `probes` and `second` readings, pages that seem to lie wrong take the reading after a turn (see turn_again).
    `cleanup` comes last, over blocks with all their flags.
    """
    stages = Stages(pages.sparkSession)
    raw = readings(pages, stages.keep)
    blocks = stages.keep(_blocks(raw))
    read = _warned(raw, blocks)
    languages = checkpoint(page_languages(blocks, dictionary, option, stages.keep))
    stages.only(raw, blocks)
    if probes is not None and second is not None:
        read, blocks, languages = turn_again(read, blocks, languages, dictionary, probes, second, option)
    next_ = lambda df: stages.turn(df, raw)
    repaired = _repaired(stages, blocks, languages, dictionary, personal, repairs, raw)
    found = _unknown(stages, repaired, dictionary, personal)[1]
    by_block = found.groupBy(*BLOCK_KEYS).agg(F.collect_list(F.struct("kind", "start", "end", "original", "note")).alias("__more"))
    order = lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["end"] - y["end"])
    flagged = repaired.join(by_block, BLOCK_KEYS, "left").withColumn("flags", F.when(F.col("__more").isNull(), F.col("flags")).otherwise(F.array_sort(F.concat("flags", "__more"), order))).drop("__more")
    done = next_(flagged)
    if cleanup:
        done = next_(cleanup(done))
    return Finished(done, done.select(*BLOCK_KEYS, F.explode("flags").alias("f")).select(*BLOCK_KEYS, "f.*"), page_records(read))
