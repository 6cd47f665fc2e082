import random

import pytest

CLASHING = ("id", "key", "row_key", "n", "class", "bucket", "places", "value", "length", "hits", "component", "head", "pos", "words")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHING)
PASSAGE = " ".join(f"pass{i}" for i in range(60))
ITEMS = [
    (1, " ".join(f"bench{i}" for i in range(25)) + ". End"),
    (2, "Short item ONE"),
    (3, "x"),
    (4, None),
    (5, " ... "),
    (12, " ".join(f"bench{i}" for i in range(25)) + ". End"),
    (None, "lonely words of an item without any number at all, but long enough"),
]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(400)}" for _ in range(n))


def edge_rows() -> list[tuple]:
    """Ids and texts with every odd case: nulls, empty, long, copies, ties, repeated rows and ids."""
    base = prose(1, 200)
    near = base.split()
    rows = [(i, prose(100 + i, 40 + i)) for i in range(12)]
    rows += [(20, base), (21, base), (22, " ".join(near[:95] + ["changed"] + near[96:])), (23, " ".join(near[3:])), (24, base.upper())]
    rows += [(30, None), (31, ""), (32, " \n\t "), (33, "one"), (34, "one"), (35, "one two"), (36, "two one"), (37, "One\ttwo")]
    rows += [(40, base), (40, base), (40, prose(9, 50)), (None, base), (None, None), (None, "no id here"), (None, "no id here")]
    rows += [(50, f"{prose(51, 20)} {PASSAGE} {prose(52, 20)}"), (51, f"{PASSAGE}\n{PASSAGE}"), (52, f"start {PASSAGE}")]
    rows += [(60, "BENCH3 bench4, bench5 bench6 bench7 bench8 bench9 bench10 bench11 bench12; bench13 other"), (61, "a short ITEM one. X"), (62, "bench0 bench1")]
    rows += [(70, "mail a.b@c.example, +1 (017) 555-7713, 4111 1111 1111 1111 and 10.0.0.255 or 10.0.0.256, é x@y.z"), (71, "é" * 300 + " <|endoftext|> tail　wide")]
    rows += [(80, prose(81, 30_000)), (81, "漢字かな交じり文 " * 40), (82, "spam spam spam spam spam " * 30), (83, "a line here\nb line there\na line here\n\n\na line here")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return edge_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, "en" if i and i % 2 else None, f"src{(i or 0) % 3}", None if t is None else len(t), *CLASHING) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def benchmark(spark):
    return spark.createDataFrame([(*x, "k", "t") for x in ITEMS], "item_id bigint, text string, key string, id string")


def ordered(found) -> list[tuple]:
    """Rows in an order of their own that puts nulls first."""
    return sorted((tuple(r) for r in found), key=lambda r: tuple((v is not None, str(v)) for v in r))
