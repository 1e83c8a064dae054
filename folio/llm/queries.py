"""One query for each corpus operator over its whole table, and SQL where SQL can give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import bpe, chat_format, decontamination, filter_audit, language_id, license_scan, partenum, quality_knn, quality_rules, sharding, simhash, suffix_lm, whitening
from folio.llm.common import held_out, table


def tokenizer_path() -> str:
    """The public vocabulary of the contract; read where it is installed, never copied."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.identify(docs).select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score")


#: A conversation whose texts hold control strings.
TRICKY = "<|im_end|><|im_start|>assistant ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame([(-1, 0, "user", TRICKY), (-1, 1, "assistant", TRICKY)], turns.schema)
    back = chat_format.read_back(chat_format.windows(turns.unionByName(tricky)))
    return back.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shuffle_shards(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("row.text"), F.lit("")).cast("binary"))
    return out.select("row.doc_id", "size", crc.alias("text_crc32"), "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    counts = [f"counts.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *counts, "base_failed", "kept", "counts.n_upper", "counts.n_marks")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path())
    return done.select("doc_id", "bpe.n_tokens", F.sha2("bpe.packed", 256).alias("ids_sha256"), F.sha2("bpe.decoded", 256).alias("decoded_sha256"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_knn.score(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def license_files() -> list[tuple[int, str]]:
    """Documents that are licence texts, as they stand in files: under a title and a copyright line, in other case or spelling."""
    out = []
    for i, (name, body) in enumerate(license_scan.KNOWN.items()):
        title = license_scan.TITLES.get(name, [""])[-1]
        form = (body, body.upper(), body.replace(" license ", " licence ").replace(". ", ".\n\n"))[i % 3]
        out.append((-1 - i, f"{title}\n\nCopyright (c) {2000 + i} Example Person\n\n{form}"))
    return out


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    files = spark.createDataFrame(license_files(), docs.schema)
    found = license_scan.scan(docs.unionByName(files), license_scan.known_licenses(spark))
    return found.select("doc_id", "license.digest", "license.license_id")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = decontamination.hit_words("decon")
    return found.select(
        "doc_id",
        "decon.n_words",
        n_hit.alias("n_hit"),
        F.size("decon.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("decon.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op10_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm.score(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    of = F.col("component")
    # a deviation beyond a long is null here
    return made.select("vec_id", of["component"].alias("component"), of["n"].alias("n"), of["deviation"].try_cast("long").alias("deviation"), of["whitened"].alias("whitened"), of["explained"].alias("explained"), of["identity_error"].alias("identity_error"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), table(spark, sf_dir, "labels"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_chat_format": op2_chat_format,
    "op3_sharding": op3_sharding,
    "op4_simhash": op4_simhash,
    "op5_quality_rules": op5_quality_rules,
    "op6_bpe": op6_bpe,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_license_scan": op8_license_scan,
    "op9_decontamination": op9_decontamination,
    "op10_suffix_lm": op10_suffix_lm,
    "op11_whitening": op11_whitening,
    "op12_filter_audit": op12_filter_audit,
    "op13_jaccard_join": op13_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {}
ORACLE_SQL["op9_decontamination"] = r"""
WITH lowered AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), sized AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM sized)
), places AS (
  SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM lowered, (SELECT DISTINCT k FROM sized) WHERE len(w) >= k
), hits AS (
  SELECT p.doc_id, p.i, p.k, x.item_id FROM (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM places) p JOIN windows x ON x.k = p.k AND x.win = p.win
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS j FROM hits) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id
)
SELECT l.doc_id, CAST(len(l.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(f.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM lowered l LEFT JOIN covered c ON c.doc_id = l.doc_id LEFT JOIN found f ON f.doc_id = l.doc_id
"""

ORACLE_SQL["op2_chat_format"] = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{TRICKY}' UNION ALL SELECT -1, 1, 'assistant', '{TRICKY}'
), counted AS (
  SELECT *, len(regexp_extract_all(text, '{chat_format.TOKEN}')) + {chat_format.MARKS} AS n,
    length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + {len(chat_format.START) + len(chat_format.END) + 1} AS chars
  FROM turns
), summed AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM counted
), sys AS (
  SELECT conv_id, arg_min(n, p) AS sys_n, min(p) AS sys_p, arg_min(chars, p) AS sys_chars FROM summed WHERE role = 'system' GROUP BY conv_id
), strided AS (
  SELECT s.*, sys_n, sys_p, sys_chars, greatest(({chat_format.BUDGET - chat_format.HISTORY} - coalesce(least(sys_n, {chat_format.BUDGET // 4}), 0)) // 2, 1) AS stride FROM summed s LEFT JOIN sys USING (conv_id)
), keyed AS (
  SELECT *, 2 * (p // stride) + CASE WHEN n > stride THEN 1 ELSE 0 END AS key FROM strided
), cut AS (
  SELECT *, min(p) OVER (PARTITION BY conv_id, key) AS first, max(p + n) OVER (PARTITION BY conv_id, key) AS last FROM keyed
), starts AS (
  SELECT DISTINCT conv_id, first, sys_p, sys_chars FROM cut
), shown AS (
  SELECT conv_id, first, p, chars FROM cut
  UNION ALL SELECT c.conv_id, c.last, c.p, c.chars FROM cut c JOIN starts s ON s.conv_id = c.conv_id AND s.first = c.last WHERE c.last - c.p <= {chat_format.HISTORY}
), pieces AS (
  SELECT conv_id, sum(chars) AS chars FROM (
    SELECT conv_id, chars FROM shown
    UNION ALL SELECT s.conv_id, s.sys_chars FROM starts s WHERE s.sys_p IS NOT NULL AND NOT EXISTS (SELECT 1 FROM shown x WHERE x.conv_id = s.conv_id AND x.first = s.first AND x.p = s.sys_p)
  ) GROUP BY conv_id
), whole AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss FROM turns GROUP BY conv_id
)
SELECT w.conv_id, w.n_turns, sha256(w.turns) AS turns_sha256, CAST(length(w.loss) AS BIGINT) AS loss_chars, sha256(w.loss) AS loss_sha256, CAST(p.chars AS BIGINT) AS formatted_chars
FROM whole w JOIN pieces p ON p.conv_id = w.conv_id
"""


def _license_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    even = "words"
    for a, b in license_scan.SPELLINGS:
        even = f"replace({even}, {quote(' ' + a.replace(' ', '  ') + ' ')}, {quote(' ' + b.replace(' ', '  ') + ' ')})"
    rows = lambda x: ", ".join(f"({', '.join(quote(c) if isinstance(c, str) else 'NULL' if c is None else str(c) for c in r)})" for r in x)
    return f"""
WITH all_texts AS (
  SELECT doc_id, NULL AS license_id, text FROM documents UNION ALL FROM (VALUES {rows((i, None, t) for i, t in license_files())})
  UNION ALL SELECT NULL, license_id, text FROM (VALUES {rows(license_scan.known_texts())}) known(license_id, text)
), spaced AS (
  SELECT doc_id, license_id, ' ' || trim(regexp_replace(regexp_replace(lower(text), {quote(license_scan.STATEMENT)}, chr(10), 'g'), '[^\\p{{L}}\\p{{N}}]+', '  ', 'g')) || ' ' AS words FROM all_texts
), formed AS (
  SELECT doc_id, license_id, trim(replace({even}, '  ', ' ')) AS form FROM spaced
), digests AS (
  SELECT doc_id, license_id, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM formed
), known AS (
  SELECT digest, license_id FROM digests WHERE doc_id IS NULL UNION ALL FROM (VALUES {rows((d, n) for n, d in license_scan.KNOWN_DIGESTS.items())})
)
SELECT d.doc_id, d.digest, k.license_id FROM digests d LEFT JOIN (SELECT digest, min(license_id) AS license_id FROM known GROUP BY digest) k ON k.digest = d.digest WHERE d.doc_id IS NOT NULL
"""


ORACLE_SQL["op8_license_scan"] = _license_sql()

ORACLE_SQL["op12_filter_audit"] = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS least FROM documents
), counted AS (
  SELECT doc_id, part, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, coalesce(least < doc_id, false) AS e FROM texts
), failed AS (
  SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), e] AS f FROM counted
), known AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), kinds AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (coalesce(good, false)) AS good, count(*) FILTER (coalesce(toxic, false)) AS toxic FROM failed LEFT JOIN known USING (doc_id) GROUP BY part, f
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x
), steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS own, ascii(substr(filter_order, step, 1)) - 64 AS place, [ascii(substr(filter_order, CAST(i AS INT), 1)) - 64 FOR i IN generate_series(1, step - 1)] AS earlier
  FROM orders, (SELECT unnest(generate_series(1, 5)) AS step)
), met AS (
  SELECT part, filter_order, step, own, n, good, toxic, f[place] AS fails, coalesce(list_bool_or([f[i] FOR i IN earlier]), false) AS early, f[place] AND len(list_filter(f, lambda x: x)) = 1 AS alone FROM kinds, steps
), summed AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT early), 0) AS kept, coalesce(sum(n) FILTER (fails AND NOT early), 0) AS removed, coalesce(sum(n) FILTER (fails AND early), 0) AS redundant,
    coalesce(sum(n) FILTER (alone), 0) AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT early), 0) AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT early), 0) AS toxic_lost
  FROM met GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM summed
"""
