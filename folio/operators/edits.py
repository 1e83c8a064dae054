"""Edits with flags that keep their places: every edit is applied once, from left to right."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folio.schema import EDIT, FLAG

_SPAN = "struct<a:int,b:int,c:int,d:int,kind:string,original:string,note:string>"


def kept_edits(edits: Column) -> Column:
    """Edits in order of place, without those that begin before the last kept one ends."""
    ordered = F.array_sort(edits, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["end"] - y["end"]))
    start = F.struct(F.lit(-1).alias("to"), F.array().cast(f"array<{EDIT}>").alias("kept"))

    def step(a: Column, e: Column) -> Column:
        taken = F.struct(e["end"].alias("to"), F.concat(a["kept"], F.array(e)).alias("kept"))
        return F.when((F.size(a["kept"]) > 0) & (e["start"] < a["to"]), a).otherwise(taken)

    return F.aggregate(ordered, start, step, lambda a: a["kept"])


def apply_edits(blocks: DataFrame, edits: str = "edits", text: str = "text", flags: str = "flags") -> DataFrame:
    """Apply each row's array of edits to its text; old flags move along, each edit leaves a flag."""
    kept = blocks.withColumn("__kept", kept_edits(F.col(edits)))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("size"), F.lit("").alias("out"), F.array().cast(f"array<{_SPAN}>").alias("spans"))

    def cut(a: Column, b: Column) -> Column:
        return F.substring(F.col(text), a + 1, b - a)

    def step(s: Column, e: Column) -> Column:
        c = s["size"] + e["start"] - s["at"]
        d = c + F.length(e["new"])
        span = F.struct(e["start"].alias("a"), e["end"].alias("b"), c.alias("c"), d.alias("d"), e["kind"].alias("kind"), cut(e["start"], e["end"]).alias("original"), e["note"].alias("note"))
        return F.struct(e["end"].alias("at"), d.alias("size"), F.concat(s["out"], cut(s["at"], e["start"]), e["new"]).alias("out"), F.concat(s["spans"], F.array(span)).alias("spans"))

    done = kept.withColumn("__done", F.aggregate("__kept", start, step))
    spans = F.col("__done.spans")

    def moved(p: Column, inner: str) -> Column:
        # the last edit that begins before p decides: p lies within it, or is shifted as its end was
        last = F.try_element_at(F.filter(spans, lambda s: s["a"] < p), F.lit(-1))
        return F.when(last.isNull(), p).when(p < last["b"], last[inner]).otherwise(p + last["d"] - last["b"])

    old = F.transform(flags, lambda f: F.struct(f["kind"].alias("kind"), moved(f["start"], "c").alias("start"), moved(f["end"], "d").alias("end"), f["original"].alias("original"), f["note"].alias("note")))
    new = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["c"].alias("start"), s["d"].alias("end"), s["original"].alias("original"), s["note"].alias("note")))
    ordered = F.array_sort(F.concat(F.coalesce(old, F.array().cast(f"array<{FLAG}>")), new), lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["end"] - y["end"]))
    any_ = F.size("__kept") > 0
    out = F.concat(F.col("__done.out"), F.expr(f"substring({text}, __done.at + 1)"))
    return done.withColumn("__text", F.when(any_, out).otherwise(F.col(text))).withColumn(flags, F.when(any_, ordered).otherwise(F.col(flags))).withColumn(text, F.col("__text")).drop("__kept", "__done", "__text")


def manual_edits(blocks: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Reviewed texts (keys, new_text) take the place of blocks' texts and clear their flags."""
    joined = blocks.join(edits.select(*keys, "new_text"), keys, "left")
    edited = F.col("new_text").isNotNull()
    out = joined.withColumn("text", F.coalesce("new_text", "text"))
    if "flags" in blocks.columns:
        out = out.withColumn("flags", F.when(edited, F.array().cast(f"array<{FLAG}>")).otherwise(F.col("flags")))
    return out.withColumn("edited", edited).drop("new_text")


def review_segments(blocks: DataFrame, keys: list[str], text: str = "text", flags: str = "flags") -> DataFrame:
    """A text cut into plain, repaired and suspicious segments; flags that overlap an earlier one are left out."""
    size = F.length(text)
    valid = F.filter(flags, lambda f: (f["start"] >= 0) & (f["end"] <= size) & (f["end"] > f["start"]))
    ordered = F.array_sort(valid, lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(F.lit(0)))
    kind = "array<struct<a:int,b:int,kind:string>>"

    def step(s: Column, f: Column) -> Column:
        shown = F.struct(f["start"].alias("a"), f["end"].alias("b"), F.when(f["kind"] == "repaired", "repaired").otherwise("suspicious").alias("kind"))
        gap = F.struct(s["at"].alias("a"), f["start"].alias("b"), F.lit("plain").alias("kind"))
        more = F.when(f["start"] > s["at"], F.array(gap, shown)).otherwise(F.array(shown))
        return F.when(f["start"] < s["at"], s).otherwise(F.struct(f["end"].alias("at"), F.concat(s["all"], more).alias("all")))

    def end(s: Column) -> Column:
        rest = F.array(F.struct(s["at"].alias("a"), size.alias("b"), F.lit("plain").alias("kind")))
        return F.when(s["at"] < size, F.concat(s["all"], rest)).otherwise(s["all"])

    cut = F.aggregate(ordered, F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("all")), step, end)
    rows = blocks.select(*keys, F.col(text).alias("__text"), F.posexplode(cut).alias("segment", "s"))
    return rows.select(*keys, "segment", "s.kind", F.expr("substring(__text, s.a + 1, s.b - s.a)").alias("text"))
