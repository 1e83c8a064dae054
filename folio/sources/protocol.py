"""Lines of the worker protocol: one JSON object a line, with a command or an event and its fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that each event must have.
EVENT_FIELDS = {
    "ready": ["pid", "torch", "transformers", "cuda_available", "gpu_name"],
    "loaded": ["id", "seconds", "vram_mib"],
    "progress": ["id", "tokens"],
    "result": ["id", "text", "seconds", "prefix_tokens", "output_tokens", "hit_token_cap", "cancelled", "timed_out", "peak_vram_mib"],
    "error": ["id", "kind", "message"],
    "pong": ["id"],
    "unloaded": ["id"],
    "bye": ["id"],
}
#: Fields that each command must have.
COMMAND_FIELDS = {
    "load": ["id", "model_dir", "device", "dtype"],
    "ocr": ["id", "image", "mode", "max_new_tokens", "time_limit_s"],
    "cancel": ["id"],
    "ping": ["id"],
    "unload": ["id"],
    "shutdown": ["id"],
}


def decode(lines: DataFrame, line: str = "line", events: dict[str, list[str]] | None = None, commands: dict[str, list[str]] | None = None) -> DataFrame:
    """Adds `message` (a map of JSON texts by field, null if bad) and `problem` (null if good)."""
    text = F.col(line)
    keys = F.json_object_keys(F.when(F.rlike(text, F.lit(r"(?s)^\s*\{.*\}\s*$")), text))
    fields = F.from_json(text, "map<string,string>")
    kinds = [("cmd", commands or COMMAND_FIELDS), ("event", events or EVENT_FIELDS)]
    out = lines.withColumn("__keys", keys).withColumn("__fields", F.when(F.col("__keys").isNotNull(), fields))

    def judged(name: str, known: dict[str, list[str]]) -> Column:
        table = F.create_map(*(x for k, v in known.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
        needed = F.try_element_at(table, F.try_element_at(F.col("__fields"), F.lit(name)))
        missing = F.filter(needed, lambda f: ~F.array_contains(F.col("__keys"), f))
        return F.when(needed.isNull(), F.lit(f"unknown {name}")).when(F.size(missing) > 0, F.concat(F.lit("missing "), F.array_join(missing, ", ")))

    has = {name: F.array_contains(F.col("__keys"), F.lit(name)) for name, _ in kinds}
    problem = F.when(F.col("__fields").isNull(), "not a JSON object").when(has["cmd"], judged(*kinds[0])).when(has["event"], judged(*kinds[1])).otherwise("neither cmd nor event")
    return out.withColumn("problem", problem).withColumn("message", F.when(F.col("problem").isNull(), F.col("__fields"))).drop("__keys", "__fields")


def split_bad(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good messages, and the lines set aside."""
    return decoded.where("problem IS NULL").drop("problem"), decoded.where("problem IS NOT NULL").drop("message")


def encode(*columns: str | Column) -> Column:
    """A message as a compact JSON line."""
    return F.concat(F.to_json(F.struct(*columns)), F.lit("\n"))
