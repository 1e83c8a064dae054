"""Model markup, text layers and HTML tables as typed blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from folio.functions.python import table_rows_of
from folio.functions.text import SPACE, clean_special, is_blank, strip
from folio.schema import LABELS, NO_TEXT

_N = r"\s*-?\d+\s*"
BOX = rf"\[{_N},{_N},{_N},{_N}\]"
#: A block's tag: a label with one box, or the older form with a label and a list of boxes.
TAG = rf"<\|det\|>\s*([\p{{L}}\p{{N}}_-]+)\s*{BOX}\s*<\|/det\|>|<\|ref\|>([^<]*)<\|/ref\|>\s*<\|det\|>\s*\[.*?\]\s*<\|/det\|>"


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(999), x))


def box_of(numbers: Column) -> Column:
    """The box around all groups of four numbers in an int array: clamped, ordered; null without four."""
    n = F.size(numbers)
    xs = F.filter(numbers, lambda _, i: i % 2 == 0)
    ys = F.filter(numbers, lambda _, i: i % 2 == 1)
    around = F.struct(clamp(F.array_min(xs)).alias("x1"), clamp(F.array_min(ys)).alias("y1"), clamp(F.array_max(xs)).alias("x2"), clamp(F.array_max(ys)).alias("y2"))
    return F.when((n > 0) & (n % 4 == 0), around)


def label_of(label: Column) -> Column:
    low = F.lower(strip(label))
    return F.when(low.isin(*LABELS), low).otherwise("text")


def parse_raw(pages: DataFrame, raw: str = "raw") -> DataFrame:
    """One row a block: the page's other columns, block_no, label, box, text and raw_text.

    Text before the first tag is a `text` block without a box, if any is left after cleaning.
    """
    keep = [c for c in pages.columns if c != raw]
    parts = F.split(F.col(raw), f"(?s)(?={TAG})", -1)
    cut = pages.select(*keep, F.posexplode(parts).alias("part", "piece"))
    tag = F.regexp_substr(F.col("piece"), F.lit(f"(?s)^(?:{TAG})"))
    first = f"(?s)^(?:{TAG})"
    named = F.coalesce(F.nullif(F.regexp_extract("piece", first, 1), F.lit("")), F.regexp_extract("piece", first, 2))
    boxes = F.regexp_extract_all(tag, F.lit(BOX), F.lit(0))
    numbers = F.flatten(F.transform(boxes, lambda x: F.transform(F.regexp_extract_all(x, F.lit(r"-?\d+"), F.lit(0)), lambda n: n.cast("int"))))
    body = F.when(tag.isNotNull(), F.expr("substring(piece, length(tag) + 1)")).otherwise(F.col("piece"))
    rows = cut.withColumn("tag", tag).withColumn("body", body)
    text = clean_special(F.col("body"))
    blocks = rows.select(
        *keep, "part", F.when(F.col("tag").isNotNull(), label_of(named)).otherwise("text").alias("label"), F.when(F.col("tag").isNotNull(), box_of(numbers)).alias("box"), text.alias("text"), F.col("tag").isNotNull().alias("tagged")
    ).where(F.col("tagged") | (F.col("text") != ""))
    number = F.row_number().over(W.partitionBy(*keep).orderBy("part")) - 1
    return blocks.select(*keep, number.alias("block_no"), "label", "box", "text", F.col("text").alias("raw_text"))


def text_layer_blocks(pages: DataFrame, text: str = "text") -> DataFrame:
    """Paragraphs of a text layer as `text` blocks without a box, numbered in order within the row."""
    keep = [c for c in pages.columns if c != text]
    paragraphs = F.filter(F.transform(F.split(F.col(text), r"\n[ \t]*\n", -1), strip), lambda x: x != "")
    return pages.select(*keep, F.posexplode(paragraphs).alias("block_no", "text")).select(*keep, "block_no", F.lit("text").alias("label"), "text")


def regular_rows(html: Column) -> Column:
    """Cells by row of a table in which all rows and cells are closed and hold no tags, as expressions only."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: strip(F.regexp_replace(c, f"{SPACE}+", " "))))
    return F.filter(cells, lambda r: F.size(r) > 0)


#: A table that expressions read as a parser would; possessive, so that its cost is its length.
REGULAR = r"(?is)^[^<&]*+<table>\s*+(?:<tr>\s*+(?:<td>[^<&]*+</td>\s*+|<th>[^<&]*+</th>\s*+)*+</tr>\s*+)*+</table>[^<&]*+$"


def is_regular(html: Column) -> Column:
    """Whether `regular_rows` reads a table as a parser would: one table of closed rows and cells, no entities or spans."""
    return F.rlike(html, F.lit(REGULAR))


def html_rows(html: Column) -> Column:
    """Cells by row: expressions for regular tables, a parser for all others; null if a cell spans others."""
    return F.when(is_regular(html), regular_rows(html)).otherwise(table_rows_of(F.when(~is_regular(html), html)))


def merged_table_text(html: Column) -> Column:
    """A table's text whatever its spans: cells by TAB, rows by LF, empty ones dropped."""
    rows = F.transform(F.split(html, "(?i)</tr>", -1), lambda r: F.filter(F.transform(F.split(r, "(?i)</t[dh]>", -1), lambda c: strip(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), f"{SPACE}+", " "))), lambda c: c != ""))
    return F.array_join(F.transform(F.filter(rows, lambda r: F.size(r) > 0), lambda r: F.array_join(r, "\t")), "\n")


def table_text(text: Column) -> Column:
    """Plain text of a table block: TSV where it is HTML, else as it is."""
    rows = html_rows(text)
    flat = F.array_join(F.transform(rows, lambda r: F.array_join(r, "\t")), "\n")
    return F.when(F.contains(F.lower(text), F.lit("<t")), F.coalesce(flat, merged_table_text(text))).otherwise(strip(text))


def block_text(label: Column, text: Column, tables: bool = True) -> Column:
    """What a block adds to plain text. Without `tables` no parser runs; for input that has no HTML."""
    shown = F.when(label == "table", table_text(text)).otherwise(strip(text)) if tables else strip(text)
    return F.when(label.isin(*NO_TEXT), F.lit("")).otherwise(shown)


def has_text(blocks: Column) -> Column:
    """Whether any block of an array but pictures has text."""
    return F.exists(blocks, lambda b: ~b["label"].isin(*NO_TEXT) & ~is_blank(b["text"]))


def block_lines(label: Column, text: Column) -> Column:
    """A block's lines: table rows with cells spaced, other lines with white space collapsed, empty ones dropped."""
    cells = F.transform(F.filter(html_rows(text), lambda r: F.exists(r, lambda c: c != "")), lambda r: F.array_join(F.filter(r, lambda c: c != ""), " "))
    bare = F.regexp_replace(F.regexp_replace(text, "(?i)</tr>", "\n"), "<[^>]*>", " ")
    is_html = (label == "table") & F.contains(F.lower(text), F.lit("<t"))

    def split_lines(t: Column) -> Column:
        return F.filter(F.transform(F.split(t, "\n", -1), lambda x: strip(F.regexp_replace(x, f"{SPACE}+", " "))), lambda x: x != "")

    return F.when(is_html & (F.size(cells) > 0), cells).when(is_html, split_lines(bare)).otherwise(split_lines(text))
