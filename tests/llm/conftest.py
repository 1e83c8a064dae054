import pytest

WORDS = "the of and river stone light under house green walks slowly towards market every morning while birds sing above old roofs".split()
DEUTSCH = "der die und Fluss Stein Licht unter Haus grün geht langsam zum Markt jeden Morgen während Vögel über alten Dächern singen".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(i: int, n: int = 40, words=WORDS) -> str:
    """Text that differs from number to number."""
    out, x = [], i * 2654435761 % 2**32 + 1
    for _ in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append(words[x // 65536 % len(words)])
    return " ".join(out) + "."


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd thing: nulls, empty, blank and long texts, copies, repeated rows, clashing columns."""
    rows = [(i, prose(i, words=DEUTSCH if i % 2 else WORDS), "de" if i % 2 else "en", "s", 1) for i in range(60)]
    rows += [(100, None, "en", None, None), (101, "", None, "s", 0), (102, " \n\t ", "en", "s", 3), (103, "12 345 !!", "de", "s", 9)]
    rows += [(104, prose(4), "en", "s", 1), (104, prose(4), "en", "s", 1), (None, prose(7, words=DEUTSCH), "de", "s", 1), (105, prose(9, 30_000), "en", "s", 1), (106, "x" * 30_000, None, "s", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars long, score double, language string, decon int, bpe int, license string, __own string, __stay int, __block0 int"
    return spark.createDataFrame([(*r, 0.5, "z", 1, 2, "l", "o", 3, 4) for r in rows], names)


@pytest.fixture(scope="session")
def none(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, 0, 1), (5, None, 0)], "doc_id long, quality int, toxic int")
