"""Reading order: furniture to the edges, captions out of sentences, hyphens at line ends, strips of tall pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.lineage import checkpoint
from folio.functions.python import placed_words_of
from folio.functions.text import ends_sentence, starts_lower
from folio.operators.edits import apply_edits
from folio.operators.lexicon import UNKNOWN, known_words, looked_up
from folio.schema import BLOCK_KEYS, CAPTIONS, EDIT, FIGURE_RUN, FLAG, FLOW, FURNITURE, HYPHEN_LABELS, PAGE_KEYS

#: What flags say of joined words.
JOINED = "word split by a line-break hyphen joined"
GUESSED = f"{JOINED} (not in the dictionary)"
#: A word, a hyphen, perhaps a line end, and a word.
BROKEN = r"(?<![\p{L}\p{N}_-])\p{L}+-(?:[ \t]*\n[ \t]*)?\p{L}+(?![\p{L}\p{N}_-])"


def renumber(blocks: DataFrame, *order: str | Column) -> DataFrame:
    """Number blocks anew within their page."""
    return blocks.withColumn("block_no", (F.row_number().over(W.partitionBy(*PAGE_KEYS).orderBy(*order)) - 1).cast("int"))


def furniture_to_edges(blocks: DataFrame) -> DataFrame:
    """Headers and upper page numbers first, other furniture last, all else in between, in their old order."""
    upper = (F.col("label") == "page_number") & (F.coalesce(F.col("box.y1"), F.lit(1000)) < 500)
    place = F.when((F.col("label") == "header") | upper, 0).when(F.col("label").isin(*FURNITURE), 2).otherwise(1)
    return renumber(blocks.withColumn("__place", place), "__place", "block_no").drop("__place")


def move_captions(blocks: DataFrame) -> DataFrame:
    """Move a run of pictures and captions that parts a sentence behind the block that goes on with it.

    A run may move if its neighbours are flowing text that breaks off and goes on in lower case. Of runs that may, and
    that are one block apart, every other one moves, as each takes the block in front of the next one.
    """
    page = W.partitionBy(*PAGE_KEYS).orderBy("block_no")
    in_run = F.col("label").isin(*FIGURE_RUN)
    marked = blocks.withColumn("__run", in_run).withColumn("__new", F.when(in_run & ~F.coalesce(F.lag(in_run).over(page), F.lit(False)), 1).otherwise(0))
    marked = marked.withColumn("__id", F.when(F.col("__run"), F.sum("__new").over(page)))
    flow = F.col("label").isin(*FLOW)
    around = marked.withColumn("__broken", F.lag(flow & ~ends_sentence(F.col("text"))).over(page)).withColumn("__goes_on", F.lead(flow & starts_lower(F.col("text"))).over(page))
    runs = (
        around.where("__run")
        .groupBy(*PAGE_KEYS, "__id")
        .agg(F.min("block_no").alias("a"), F.max("block_no").alias("b"), F.bool_or(F.col("label").isin(*CAPTIONS)).alias("captioned"), F.min_by("__broken", "block_no").alias("broken"), F.max_by("__goes_on", "block_no").alias("goes_on"))
    )
    may = F.coalesce(F.col("captioned") & F.col("broken") & F.col("goes_on"), F.lit(False))
    runs = runs.withColumn("may", may)
    order = W.partitionBy(*PAGE_KEYS).orderBy("__id")
    linked = F.col("may") & F.coalesce(F.lag("may").over(order) & (F.lag("b").over(order) + 2 == F.col("a")), F.lit(False))
    chains = runs.withColumn("chain", F.sum(F.when(linked, 0).otherwise(1)).over(order))
    rank = F.row_number().over(W.partitionBy(*PAGE_KEYS, "chain").orderBy("__id"))
    moved = chains.withColumn("moves", F.col("may") & (rank % 2 == 1)).where("moves").select(*PAGE_KEYS, "__id", F.col("b").alias("__last"))
    joined = marked.join(moved, [*PAGE_KEYS, "__id"], "left")
    # a moved run comes after the block behind its last one
    key = F.when(F.col("__last").isNotNull(), F.col("__last") + 1.5).otherwise(F.col("block_no").cast("double"))
    return renumber(joined.withColumn("__key", key), "__key", "block_no").drop("__run", "__new", "__id", "__last", "__key")


def join_hyphens(label: Column, text: Column) -> Column:
    """Without a dictionary: a word broken by a hyphen at a line end is joined if it goes on in lower case."""
    joined = F.regexp_replace(text, r"(\p{L})-[ \t]*\n[ \t]*(?=\p{Ll})", "$1")
    return F.when(label.isin("table", "formula"), text).otherwise(joined)


def dehyphenate(blocks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """With a dictionary (blocks have a lang): join broken words that are known joined and unknown with a hyphen.

    At a line end, where neither form is known, a word that goes on in lower case is joined too, as a guess. Each join
    leaves a flag, a guess another one that is suspicious; old flags move along. Adds `joined` and `guessed`, the numbers
    of joins. Broken words are judged once each, whatever number of blocks holds them.
    """
    given = blocks if "flags" in blocks.columns else blocks.withColumn("flags", F.array().cast(f"array<{FLAG}>"))
    cut = given.where(F.col("label").isin(*HYPHEN_LABELS) & F.contains("text", F.lit("-")))
    pieces = checkpoint(cut.select(*BLOCK_KEYS, "lang", F.explode(placed_words_of(F.col("text"), BROKEN, mask=False)).alias("w")).select(*BLOCK_KEYS, "lang", "w.start", "w.end", F.col("w.word").alias("piece")))
    parts = F.split("piece", r"-[ \t]*\n?[ \t]*", 2)
    asked = pieces.select("lang", "piece").distinct().select("lang", "piece", parts[0].alias("a"), parts[1].alias("b"))
    both = checkpoint(asked.select("lang", "piece", "b", F.posexplode(F.array(F.concat("a", "b"), F.concat_ws("-", "a", "b"))).alias("dashed", "word")))
    judged = both.join(known_words(both, dictionary).select("lang", "word", "known"), ["lang", "word"]).groupBy("lang", "piece", "b").agg(
        F.min_by("word", "dashed").alias("whole"), F.min_by("known", "dashed").alias("whole_known"), F.max_by("known", "dashed").alias("dashed_known")
    )
    sure = F.col("whole_known") & ~F.col("dashed_known")
    guess = F.contains("piece", F.lit("\n")) & ~F.col("whole_known") & ~F.col("dashed_known") & F.rlike("b", F.lit(r"^\p{Ll}"))
    changed = checkpoint(judged.where(sure | guess).select("lang", "piece", F.col("whole").alias("new"), F.when(guess, GUESSED).otherwise(JOINED).alias("note")))
    edit = F.struct("start", "end", "new", F.lit("repaired").alias("kind"), "note")
    edits = looked_up(pieces, changed, ["lang", "piece"]).groupBy(*BLOCK_KEYS).agg(F.collect_list(edit).alias("__edits"), F.count_if(F.col("note") == GUESSED).alias("__guessed"))
    merged = given.join(edits, BLOCK_KEYS, "left").withColumn("__edits", F.coalesce("__edits", F.array().cast(f"array<{EDIT}>")))
    done = apply_edits(merged, "__edits")
    guesses = F.filter("flags", lambda f: (f["kind"] == "repaired") & (f["note"] == GUESSED))
    told = F.transform(guesses, lambda f: F.struct(F.lit("suspicious").alias("kind"), f["start"].alias("start"), f["end"].alias("end"), F.substring(F.col("text"), f["start"] + 1, f["end"] - f["start"]).alias("original"), F.lit(UNKNOWN).alias("note")))
    both_flags = F.array_sort(F.concat("flags", told), lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["end"] - y["end"]))
    flagged = done.withColumn("flags", F.when(F.col("__guessed") > 0, both_flags).otherwise(F.col("flags")))
    return flagged.withColumn("joined", F.size("__edits").cast("long")).withColumn("guessed", F.coalesce("__guessed", F.lit(0))).drop("__edits", "__guessed")


def arrange(blocks: DataFrame, dictionary: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All reading-order rules in turn; `keep` cuts the lineage of blocks in order, which are read twice from there."""
    if dictionary is None:
        blocks = blocks.withColumn("text", join_hyphens(F.col("label"), F.col("text")))
    moved = move_captions(furniture_to_edges(blocks))
    return moved if dictionary is None else dehyphenate(keep(moved) if keep else moved, dictionary)


def cut_strips(images: DataFrame, keys: list[str], width: str = "w", height: str = "h") -> DataFrame:
    """Strips of tall images: rows with n, top, bottom, and the zone that each owns, overlaps being split in half."""
    w, h = F.col(width), F.col(height)
    size = F.greatest(F.lit(1), F.bround(2 * w.cast("double")).cast("int"))
    overlap = F.least(F.floor(size / 2).cast("int"), F.greatest(F.lit(80), F.bround(0.25 * w.cast("double")).cast("int")))
    step = F.greatest(F.lit(1), size - overlap)
    count = 1 + F.greatest(F.lit(0), F.ceil((h - size) / step)).cast("int")
    rows = images.select(*keys, h.alias("__h"), size.alias("__s"), step.alias("__d"), F.explode(F.sequence(F.lit(0), count - 1)).alias("n"))
    placed = rows.select(*keys, "n", (F.col("n") * F.col("__d")).alias("top"), F.least(F.col("n") * F.col("__d") + F.col("__s"), F.col("__h")).alias("bottom"), F.col("__h").alias("height"))
    order = W.partitionBy(*keys).orderBy("n")
    own_top = F.coalesce((F.col("top") + F.lag("bottom").over(order)) / 2, F.lit(0.0))
    own_bottom = F.coalesce((F.col("bottom") + F.lead("top").over(order)) / 2, F.col("height").cast("double"))
    return placed.withColumn("own_top", own_top).withColumn("own_bottom", own_bottom)


def to_page(y: Column, top: Column, bottom: Column, height: Column) -> Column:
    """A strip's 0..999 ordinate as the whole image's."""
    return F.bround((top + y / 999 * (bottom - top)) / height * 999).cast("int")


def own_blocks(blocks: DataFrame, strips: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks of strips (keys, n, y1, y2) that lie in their strip's own zone, in the whole image's ordinates."""
    joined = blocks.join(strips, [*keys, "n"])
    y1, y2 = (to_page(F.col(y), F.col("top"), F.col("bottom"), F.col("height")) for y in ("y1", "y2"))
    centre = F.when(F.col("y1").isNull(), (F.col("top") + F.col("bottom")) / 2).otherwise((y1 + y2) / 2 / 999 * F.col("height"))
    mine = (F.col("own_top") <= centre) & (centre < F.col("own_bottom"))
    return joined.where(mine).withColumn("y1", y1).withColumn("y2", y2)


#: Warnings of pages.
EMPTY, EMPTY_RETRIED, ROTATED = "empty", "empty_retried", "rotated"


def strip_warnings(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Warnings of tall pages from those of their strips (keys, n, warnings, has_text, stopped), each once, in order.

    Where any strip has text, none of them is told to be empty; where none has, the page is, unless reading was stopped.
    """
    ordered = F.array_sort(F.collect_list(F.struct("n", "warnings")))
    pages = readings.groupBy(*keys).agg(F.array_distinct(F.flatten(ordered["warnings"])).alias("__all"), F.bool_or("has_text").alias("__text"), F.bool_or("stopped").alias("__stopped"))
    told = F.when(F.col("__text"), F.filter("__all", lambda w: ~w.isin(EMPTY, EMPTY_RETRIED))).when(~F.col("__stopped") & ~F.array_contains("__all", EMPTY), F.array_append("__all", EMPTY)).otherwise(F.col("__all"))
    return pages.select(*keys, told.alias("warnings"))


def read_again(first: DataFrame, turns: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Which reading of each page counts: the first (keys, doubtful, rate, rotation, warnings), or one after a turn.

    `turns` (keys, degrees) come from `guards.best_rotation`; a second reading (keys, rotation, rate, cancelled, warnings)
    at the first one's rotation plus the turn takes its place if more of its words are known. Adds `reread`.
    """
    turned = first.join(turns, keys, "left").withColumn("__total", (F.col("rotation") + F.coalesce("degrees", F.lit(0))) % 360)
    other = second.select(*keys, F.col("rotation").alias("__total"), F.col("rate").alias("__rate"), F.col("cancelled").alias("__cancelled"), F.col("warnings").alias("__warnings"))
    both = turned.join(other, [*keys, "__total"], "left")
    better = F.coalesce(F.col("doubtful") & (F.col("degrees") != 0) & ~F.col("__cancelled") & (F.col("__rate") > F.col("rate")), F.lit(False))
    pick = lambda a, b: F.when(better, a).otherwise(F.col(b)).alias(b)
    return both.select(*keys, better.alias("reread"), pick(F.col("__total"), "rotation"), pick(F.col("__rate"), "rate"), pick(F.array_append("__warnings", ROTATED), "warnings"))
