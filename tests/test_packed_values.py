import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tradeloom.operators.packed_values import resolve, split_packed

CASES = {
    "a b, c d": ["a b", "c d"],
    "1,5 mm cable; 12/24 V lamp": ["1,5 mm cable", "12/24 V lamp"],
    'x | "hose; 8 bar" | "rim 14"" wide"': ["x", "hose; 8 bar", 'rim 14" wide'],
    '["rim 14\\" wide", "makas yay\\u0131"]': ['rim 14" wide', "makas yayı"],
    "1. a\n2. b\n- c": ["a", "b", "c"],
    "(1) a; (2) 2,5 t jack": ["a", "2,5 t jack"],
    ",a,, b ; ,": ["a", "b"],
    "„a, b“, „c“": ["a, b", "c"],
    "'a; b'; c": ["a; b", "c"],
    "hinges (left, right) / bush (rubber/metal)": ["hinges (left, right)", "bush (rubber/metal)"],
    "a\tb\r\nc": ["a", "b", "c"],
    "nuts & bolts; a; a": ["nuts & bolts", "a", "a"],
    'rim 14" wide, b': ['rim 14" wide', "b"],
    "轮毂、线束，导向轮": ["轮毂", "线束", "导向轮"],
    "open (bracket, b": ["open (bracket", "b"],
}


def test_cases_and_placeholders(spark):
    rows = [(i, t, "kept") for i, t in enumerate([*CASES, None, "", "  ", "N/A", "-", "[]"])]
    df = spark.createDataFrame(rows, "id int, products string, _x string")
    got = {}
    for r in split_packed(df, "products").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.pos, r.value))
        assert r._x == "kept"
    for i, t in enumerate(CASES):
        assert got[i] == [(k + 1, v) for k, v in enumerate(CASES[t])], t
    assert set(got) == set(range(len(CASES)))


def test_clashing_names_empty_table_and_long_text(spark):
    df = spark.createDataFrame([(1, "a")], "pos int, products string")
    with pytest.raises(ValueError):
        split_packed(df, "products")
    assert split_packed(df.limit(0).withColumnRenamed("pos", "id"), "products").count() == 0
    long = spark.createDataFrame([(1, ", ".join(["item name"] * 20000))], "id int, products string")
    assert split_packed(long, "products").count() == 20000


@given(st.lists(st.sampled_from(["a", "a (a, a)", "a a"]), min_size=1, max_size=6), st.sampled_from([", ", ";", " | ", "\n"]))
@settings(max_examples=60, deadline=None)
def test_joined_skeletons_come_apart(items, sep):
    assert len(resolve(sep.join(items))) == len(items)
