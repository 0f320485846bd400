"""Packed values against a character-by-character reader."""

import random

import pytest

from tessera.operators.packed import explode_packed


def split(df, spark, values):
    rows = explode_packed(spark.createDataFrame(list(enumerate(values)), "i int, r string"), "r").collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r.i, r.pos)):
        found.setdefault(r.i, []).append(r.value)
        assert len(found[r.i]) == r.pos
    return [found.get(i, []) for i in range(len(values))]


CASES = [
    ('["phil:C01212","der Begriff / well-being"]', ["phil:C01212", "der Begriff / well-being"]),
    ("Ebb's birth, phil:C05941, nation/relativism", ["Ebb's birth", "phil:C05941", "nation/relativism"]),
    ('a;; "finite love; perception"; "Q9"', ["a", "finite love; perception", "Q9"]),
    ('“theoretical form”;"the ""systematic"" silence";b', ["theoretical form", 'the "systematic" silence', "b"]),
    ("category\\; teacher; ritual\\, structural", ["category; teacher", "ritual, structural"]),
    ('a / “b” / "c, d" / "death/freedom"', ["a", "b", "c, d", "death/freedom"]),
    ('["Q9", "the \\"sacred\\" temperance"]', ["Q9", 'the "sacred" temperance']),
    ("“the \"ascetic\" law”|世界\\、历史", ['the "ascetic" law', "世界、历史"]),
    (None, []),
    ("", []),
    ("  \t ", []),
    (";,|", []),
    ('"open; x', ['"open', "x"]),
    ("[a; b]", ["a", "b"]),
    ('""; a', ["a"]),
    ("a \ue0003\ue001, b\ue000", ["a \ue0003\ue001", "b\ue000"]),
]


def test_cases(spark):
    assert split(None, spark, [c for c, _ in CASES]) == [w for _, w in CASES]


def test_round_trip(spark):
    rng = random.Random(3)
    packed, wanted = [], []
    for _ in range(300):
        values = ["".join(rng.choice('ab ;,|"\\、/x') for _ in range(rng.randint(1, 9))).strip() for _ in range(rng.randint(0, 6))]
        values = [v for v in values if v]
        packed.append(rng.choice([";", ", ", " | "]).join('"' + v.replace("\\", "\\\\").replace('"', '""') + '"' for v in values))
        wanted.append(values)
    assert split(None, spark, packed) == wanted


def test_long_text_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, ";".join(["x"] * 20_000), "old", 7)], "i int, r string, value string, pos int")
    rows = explode_packed(df, "r")
    assert rows.columns == ["i", "pos", "value"] and rows.count() == 20_000


def test_empty_table(spark):
    assert explode_packed(spark.createDataFrame([], "i int, r string"), "r").count() == 0


@pytest.mark.parametrize("kept", ["a b", "x.y"])
def test_odd_column_names(spark, kept):
    df = spark.createDataFrame([("k", "1;2")], f"`{kept}` string, r string")
    assert explode_packed(df, "r").columns == [kept, "pos", "value"]
