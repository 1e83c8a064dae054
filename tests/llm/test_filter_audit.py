import itertools
import re

import duckdb
import pytest

from folio.llm import filter_audit, queries


def brute(docs, labels):
    """Rows by applying every order to every document; docs: (doc_id, text, part), labels: (doc_id, quality, toxic)."""
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({i for i, *x in labels if i is not None and x[k] == 1} for k in (0, 1))
    found = []
    for i, t, p in docs:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": i is not None and least[t] < i,
        }
        found.append((i, p or "", fails))
    out, removed_of = {}, {}
    for order in itertools.permutations("ABCDE"):
        for i, p, fails in found:
            gone = False
            for step, f in enumerate(order, 1):
                row = out.setdefault((p, "".join(order), step), [0] * 6)
                removed = fails[f] and not gone
                row[0] += not gone and not removed
                row[1] += removed
                row[2] += fails[f] and gone
                row[3] += fails[f] and sum(fails.values()) == 1
                row[4] += removed and i in good
                row[5] += removed and i in toxic
                removed_of[p, f] = removed_of.get((p, f), 0) + removed
                gone = gone or removed
    return sorted((*key, *row, removed_of[key[0], key[1][key[2] - 1]]) for key, row in out.items())


def got(docs, labels):
    return sorted(tuple(r) for r in filter_audit.audit(docs, labels).collect())


WORDS = [f"w{i}" for i in range(300)]


@pytest.fixture(scope="module")
def mixed(spark):
    texts = [" ".join(WORDS[:250]), " ".join(["a", "b"] * 150), "A B C " + " ".join(WORDS), " ".join(WORDS) + " # 5", "", None, "Ünïcode ist kein\x0bUmbruch", "x" * 5000, " \t\n", " ".join(WORDS[:200]), " ".join(WORDS[:199])]
    rows = [(k, texts[k % len(texts)], [None, "", "s1", "s 2"][k % 4]) for k in range(70)]
    rows += [(3, texts[3], "s1"), (3, texts[3], "s1"), (None, texts[0], "s1"), (None, texts[0], None), (500, "alone & odd", "s3"), (-4, texts[7], "s3")]
    return rows, [(k, k % 2, k % 3 % 2) for k in range(40)] + [(3, 1, None), (3, 1, 1), (None, 1, 1), (5, None, None), (900, 1, 1)]


def test_all_orders(spark, mixed):
    rows, labels = mixed
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, source string, part int, digest string, mask int")
    made = got(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert made == brute(rows, labels)
    assert len(made) == 600 * 4


def test_sql(spark, mixed):
    rows, labels = mixed
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    db = duckdb.connect()
    db.register("documents", docs.toArrow())
    db.register("labels", known.toArrow())
    result = db.execute(queries.ORACLE_SQL["op12_filter_audit"])
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(filter_audit.audit(docs, known).columns)
    assert sorted(map(str, result.fetchall())) == sorted(str(tuple(r[c] for c in names)) for r in filter_audit.audit(docs, known).collect())


def test_odd_rows(spark, odd, none, labels):
    rows = [(r.doc_id, r.text, r.source) for r in odd.select("doc_id", "text", "source").collect()]
    assert got(odd, labels) == brute(rows, [tuple(r) for r in labels.collect()])
    assert got(none, labels) == []
    assert got(odd, labels.limit(0)) == brute(rows, [])


def test_matrices():
    steps, by = filter_audit.outcomes()
    assert len(steps) == 600 and all(m.shape == (32, 600) for m in by.values())
    assert ((by["removed"] + by["redundant"] + by["kept"]) <= 1).all()
