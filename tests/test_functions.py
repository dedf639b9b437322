"""Comparators and encoders, value by value."""

import random

import pytest
from pyspark.sql import functions as F

from twinspan.functions import algorithms, comparator, encoder, register
from twinspan.functions.phonetic import jaro_winkler, jaro_winkler_all, jaro_winkler_may_reach, jaro_winkler_udf, letters, nysiis
from twinspan.functions.synonyms import roots, use_synonyms
from twinspan.functions.text import blank_to_null, fold, py_slice


def compare(spark, name, pairs, kind="string", **args):
    algorithm = comparator(name)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], f"i int, l {kind}, r {kind}")
    left, right = "l", "r"
    if algorithm.prepare:
        own = algorithm.checked(args)
        df = algorithm.prepare(algorithm.prepare(df, "l", "pl", **own), "r", "pr", **own)
        left, right = "pl", "pr"
    applied = algorithm.apply(F.col(left), F.col(right), **args)
    parts = [algorithm.key(F.col(c), **algorithm.checked(args)) for c in (left, right)] if algorithm.key else None
    as_filter = F.coalesce(parts[0] == parts[1], F.lit(False)) if parts else applied
    rows = df.select("i", applied.alias("m"), as_filter.alias("f")).orderBy("i").collect()
    assert [r.m for r in rows] == [r.f for r in rows]
    return [r.m for r in rows]


N = None
CASES = [
    ("EXACT", {}, [("a", "a", True), ("a", "b", False), (N, N, True), (N, "a", False), ("a ", "a", False)]),
    ("BOTH_EMPTY", {}, [(N, N, True), ("", "", True), (N, "", True), ("a", N, False), ("a", "b", False)]),
    ("ONE_EMPTY", {}, [(N, "a", True), ("a", "", True), (N, N, False), ("", N, False), ("a", "b", False)]),
    ("BOTH_EXIST", {}, [("a", "b", True), ("a", N, False), ("", "b", False), (N, N, False)]),
    ("SOUNDEX", {}, [("Robert", "Rupert", True), ("Robert", "Rubin", False), (N, N, False), ("Robert", N, False), ("émile", "EMIL", True), ("Ashcraft", "Ashcroft", True)]),
    ("NYSIIS", {}, [("Mitchell", "Mitchel", True), ("Mitchell", "Marshall", False), (N, N, False), ("Knight", N, False)]),
    ("SLICE_MATCH", {"start": 1, "end": 3}, [("xabz", "yabq", True), ("xabz", "yacq", False), (N, N, False), ("x", "y", True), ("xab", "yab", True)]),
    ("SLICE_MATCH", {}, [("a", "b", True), (N, "b", False)]),
    ("SLICE_MATCH", {"start": -2, "end": -1}, [("abc", "xbd", True), ("abc", "xyz", False)]),
    ("HEAD_MATCH", {"n": 3}, [("abcd", "abcx", True), ("ab", "ab", True), ("ab", "abc", False), (N, N, False)]),
    ("HEAD_MATCH", {}, [("a", "b", True), (N, "b", False)]),
    ("HEAD_MATCH", {"n": -1}, [("abc", "abd", True), ("abc", "xbc", False)]),
    ("TAIL_MATCH", {"n": 2}, [("xab", "yab", True), ("ab", "xab", True), ("b", "ab", False), (N, N, False)]),
    ("TAIL_MATCH", {}, [("ab", "ab", True), ("ab", "b", False), (N, N, False)]),
    ("TAIL_MATCH", {"n": -1}, [("xab", "yab", True), ("xab", "yac", False)]),
    ("FIXED_LEN", {"length": 3}, [("abc", "xyz", True), ("abc", "xy", False), ("ab ", "xyz", True), (N, N, False)]),
    ("FIXED_LEN", {}, [("", "", True), ("a", "", False)]),
    ("FIXED_VAL", {"value": "x"}, [("x", "x", True), ("x", "y", False), (N, "x", False), (N, N, False)]),
    ("FIXED_VAL", {"value": 310}, [("310", "310", False)]),
    ("LEVENSHTEIN", {"max_edits": 2}, [("kitten", "sittin", True), ("kitten", "sitting", False), (N, N, True), (N, "ab", True), (N, "abc", False), ("", "", True)]),
    ("LEVENSHTEIN", {}, [("a", "a", True), ("a", "b", False), (N, "", True)]),
    ("LEVENSHTEIN", {"max_edits": -1}, [("a", "a", False)]),
    ("JARO_WINKLER", {"threshold": 0.9}, [("MARTHA", "MARHTA", True), ("DIXON", "DICKSONX", False), (N, N, False), ("", "", False), ("a", "a", True)]),
    ("JARO_WINKLER", {}, [("same", "same", True), ("same", "some", False)]),
]


@pytest.mark.parametrize("name,args,cases", CASES, ids=lambda x: x if isinstance(x, str) else "")
def test_comparator(spark, name, args, cases):
    assert compare(spark, name, [(a, b) for a, b, _ in cases], **args) == [m for *_, m in cases]


def test_numbers(spark):
    nan = float("nan")
    assert compare(spark, "ABS_DIFF", [(1.0, 3.0), (1.0, 3.1), (N, 1.0), (N, N), (nan, 1.0), (nan, nan)], "double", threshold=2) == [True, False, False, False, False, False]
    assert compare(spark, "ABS_DIFF", [(5, 5), (5, 6)], "long") == [True, False]
    assert compare(spark, "FIXED_VAL", [(310.0, 310.0), (310.0, 1.0), (N, 310.0)], "double", value=310) == [True, False, False]
    assert compare(spark, "FIXED_VAL", [(310, 310)], "long", value="310") == [False]
    assert compare(spark, "FIXED_VAL", [(True, True), (True, False)], "boolean", value=True) == [True, False]
    assert compare(spark, "FIXED_VAL", [(True, True)], "boolean", value=1) == [False]
    assert compare(spark, "EXACT", [(1, 1), (N, N), (1, N)], "long") == [True, True, False]
    assert compare(spark, "BOTH_EXIST", [(1, 2), (1, N)], "long") == [True, False]


def test_synonyms(spark):
    use_synonyms([("Bob", "Robert"), ("rob", "BOB"), ("Liz", "Beth"), ("Al", "al")])
    pairs = [("ROB", "robert"), ("bob", "Bob"), ("Liz", "Bob"), ("Zed", "Zed"), (N, ""), (N, N), (N, "Bob"), ("al", "AL")]
    assert compare(spark, "SYNONYMS", pairs) == [True, True, False, False, True, True, False, True]
    assert {r.name: r.root for r in roots(spark).collect()} == {"BOB": "BOB", "ROBERT": "BOB", "ROB": "BOB", "LIZ": "BETH", "BETH": "BETH", "AL": "AL"}
    use_synonyms([])
    assert compare(spark, "SYNONYMS", [("a", "a"), (N, N)]) == [False, True]


def test_encoders(spark):
    df = spark.createDataFrame([("Tymczak",), ("Pfister",), (None,), ("",), ("Élan",)], "x string")
    get = lambda name: [r[0] for r in df.select(encoder(name).apply(F.col("x"))).collect()]
    assert get("SOUNDEX") == ["T522", "P236", None, "", "E450"]
    assert get(None) == get("EXACT") == ["Tymczak", "Pfister", None, "", "Élan"]
    assert get("NYSIIS") == ["TYNCSAC", "FASTAR", None, "", "ELAN"]


@pytest.mark.parametrize("name,code", [("KNIGHT", "NAGT"), ("MITCHELL", "MATCAL"), ("SCHMIDT", "SNAD"), ("PHILLIPS", "FALAP"), ("MACDONALD", "MCDANALD"), ("O'DANIEL", "ODANAL"), ("LARSON", "LARSAN"), ("EVANS", "EVAN"), ("A", "A"), ("", ""), ("123", "")])
def test_nysiis(name, code):
    assert nysiis(name) == nysiis(name.lower()) == code


def test_jaro_winkler_known_values():
    for a, b, s in [("MARTHA", "MARHTA", 0.9611), ("DWAYNE", "DUANE", 0.84), ("DIXON", "DICKSONX", 0.8133), ("ab", "ac", 0.6667), ("", "", 0), ("a", "", 0), ("abc", "xyz", 0)]:
        assert round(jaro_winkler(a, b), 4) == s == round(jaro_winkler(b, a), 4)


def test_jaro_winkler_is_duckdb_s():
    import duckdb

    rng = random.Random(1)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(1500)]
    con = duckdb.connect()
    for a, b in pairs:
        assert abs(con.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchall()[0][0] - jaro_winkler(a, b)) < 1e-9, (a, b)


def test_slice_is_python_s(spark):
    texts = ["", "a", "ab", "abcdef"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for s in (None, -9, -3, -1, 0, 1, 4, 9):
        for e in (None, -9, -2, 0, 2, 5, 9):
            assert [r[0] for r in df.select(py_slice(F.col("t"), s, e)).collect()] == [t[s:e] for t in texts]


def test_blanks_and_folding(spark):
    df = spark.createDataFrame([("  ", 1, " x "), ("", 2, "\t\n")], "a string, n int, b string")
    assert [tuple(r) for r in blank_to_null(df).collect()] == [(None, 1, " x "), (None, 2, None)]
    assert blank_to_null(df, ["b"]).first().a == "  "
    assert spark.createDataFrame([("Čöñ",)], "t string").select(fold(F.col("t"))).first()[0] == "CON"


def test_registry(spark):
    with pytest.raises(KeyError):
        comparator("NOPE")
    with pytest.raises(KeyError):
        encoder("LEVENSHTEIN")
    with pytest.raises(KeyError):
        comparator("LEVENSHTEIN", "PRB")
    with pytest.raises(ValueError):
        comparator("HEAD_MATCH").apply(F.lit(1), F.lit(1), m=2)

    @register("SAME_LENGTH", "Equal lengths", "DTR")
    def same_length(left, right):
        return F.coalesce(F.length(left) == F.length(right), F.lit(False))

    assert compare(spark, "SAME_LENGTH", [("ab", "cd"), ("a", "bc")]) == [True, False]
    assert "SAME_LENGTH" in algorithms("DTR") and "SAME_LENGTH" not in algorithms("TSF")
    assert set(algorithms("TSF")) == {"EXACT", "SOUNDEX", "NYSIIS"}


def test_jaro_winkler_of_batches_and_what_may_reach(spark):
    rng = random.Random(4)
    alphabets = ["ab", "abcd", "abcdefghij é数🙂"]
    pairs = []
    for _ in range(3000):
        k = rng.choice(alphabets)
        a = "".join(rng.choice(k) for _ in range(rng.randint(1, 14)))
        b = a[: rng.randint(1, 14)] + rng.choice(k) if rng.random() < 0.3 else "".join(rng.choice(k) for _ in range(rng.randint(1, 14)))
        pairs.append((a, b))
    want = [jaro_winkler(a, b) for a, b in pairs]
    got = jaro_winkler_all(*map(list, zip(*pairs)))
    assert max(abs(x - y) for x, y in zip(got, want, strict=True)) < 1e-12
    df = spark.createDataFrame([(a, b, s) for (a, b), s in zip(pairs, want, strict=True)], "a string, b string, s double")
    left, right = F.col("a"), F.col("b")
    for t in (0.0, 0.3, 0.6, 0.7, 0.8, 0.9, 1.0):
        may = jaro_winkler_may_reach(left, right, letters(left), letters(right), t)
        assert df.where((F.col("s") >= t) & ~may).count() == 0
    odd = spark.createDataFrame([("", "", 0.0), ("", "a", 0.0), (None, "a", None), ("x" * 100, "x" * 99 + "y", jaro_winkler("x" * 100, "x" * 99 + "y"))], "a string, b string, s double")
    assert [r.g for r in odd.select(jaro_winkler_udf()("a", "b").alias("g")).collect()] == [r.s for r in odd.collect()]


def test_synonyms_need_a_table(spark):
    use_synonyms(None)
    with pytest.raises(ValueError, match="SYNONYMS needs a table"):
        compare(spark, "SYNONYMS", [("a", "b")])
    assert compare(spark, "SYNONYMS", [("Bob", "robert"), ("Bill", "WILL"), ("Bob", "Bill"), (None, "")], table="builtin") == [True, True, False, True]


def test_soundex_in_sql_is_the_encoder_s(spark):
    from twinspan.plans.sql import register_functions

    register_functions(spark)
    df = spark.createDataFrame([(x,) for x in ("Émile", "emil", "Ångström", "O'Neil", "", None, "Łódź", "数")], "x string")
    df.createOrReplaceTempView("soundex_names")
    rows = spark.sql("SELECT x, soundex_encode(x) AS s FROM soundex_names").select("s", encoder("SOUNDEX").apply(F.col("x")).alias("e")).collect()
    assert [r.s for r in rows] == [r.e for r in rows]


def test_nysiis_in_the_jvm_as_the_plain_one(spark):
    """Random words of the letters that the rules are about, and names with marks; no Python in the plan."""
    import random

    from twinspan.functions.phonetic import nysiis, nysiis_column, nysiis_sql

    pick = random.Random(9)
    words = ["".join(pick.choice("AEIOUHWKNSCPMQZVDRTYBLGFEHW") for _ in range(pick.randint(0, 9))) for _ in range(6000)]
    starts, ends = ["MAC", "KN", "K", "PH", "PF", "SCH", ""], ["EE", "IE", "DT", "RT", "RD", "NT", "ND", "AY", "S", "A", "AS", "SA", "", "EV", "H", "W"]
    words += [pick.choice(starts) + w[:4] + pick.choice(ends) for w in words[:3000]]
    words += ["", " ", "12", "Muñoz", "O'Brien", "Strauß", "ĳssel", "ﬁsher", "Ｓｃｈｍｉｄｔ", "Nguyễn", "Ǆ", "Łódź", "Éèêë", "a", "S", "AY", "HH", "wwa", None]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    coded = df.select("w", nysiis_column(df.w).alias("code"), F.expr(nysiis_sql("w")).alias("code_sql"))
    assert "Python" not in coded._jdf.queryExecution().executedPlan().toString()
    wrong = [(r.w, r.code, nysiis(r.w)) for r in coded.collect() if r.w is not None and not r.code == r.code_sql == nysiis(r.w)]
    assert wrong == []
    assert [r.code for r in coded.collect() if r.w is None] == [None]
