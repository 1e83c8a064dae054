"""Every query against its SQL on a small scale, and the engine without the corpus operators."""

import math
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from folio.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def db():
    out = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        out.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return out


def told(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if isinstance(x, (list, tuple)):
        return str([told(y) for y in x])
    return f"{x:.6g}" if isinstance(x, float) and x != int(x) else str(int(x)) if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    made = QUERIES[name](spark, SF)
    rows = made.collect()
    assert rows
    if name in ORACLE_SQL:
        result = db.execute(ORACLE_SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(made.columns)
        assert sorted("|".join(told(r[c]) for c in columns) for r in rows) == sorted("|".join(map(told, r)) for r in result.fetchall())


def test_nearly_all_queries_have_sql():
    assert sorted(set(QUERIES) - set(ORACLE_SQL)) == ["pdf_text_lines", "processed_blocks", "processed_flags", "processed_pages", "runaway", "trim_runaway", "wrapped_lines"]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_without_the_corpus_operators(tmp_path):
    """The entry works where the subpackage and the pipeline aren't there."""
    for name in ("__spark_entry__.py", "folio"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else _copy(ROOT / name, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'page_text' in q and 'pipeline' not in q and not any(x.startswith('op') and x[2].isdigit() for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def _copy(source: Path, to: Path) -> None:
    to.mkdir()
    for path in source.iterdir():
        if path.name not in ("llm", "__pycache__"):
            (to / path.name).symlink_to(path)


def test_texts_without_words_have_no_vote(spark, tmp_path):
    rows = [(i, "the house is old", "en") for i in range(9)] + [(20, "4 7 1.", "en"), (21, "a 5", "en"), (22, None, "en"), (23, "Zzyx 5", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted((r.doc_id, r.language, r.rate) for r in QUERIES["language_vote"](spark, str(tmp_path)).collect())
    assert got == sorted(db.execute(ORACLE_SQL["language_vote"]).fetchall()) and [r[0] for r in got] == [*range(9), 23]
