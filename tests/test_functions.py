"""Functions at the places where they are easily got wrong."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import dates, fuzzy, jsons, scoring, sets, text
from palimpsest.plans.answers import GOLDEN
from palimpsest.operators.rank import hash_order, near_equal_parts


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value, want", [(None, 1), ("", 1), ("  \n\t ", 1), ("abcd", 1), ("abcde", 2), ("é" * 8, 2)])
def test_tokens_by_four(spark, value, want):
    assert one(spark, value, text.tokens_by_four) == want


@pytest.mark.parametrize("n, want", [(0, 0), (1, 1), (5, 2), (15, 6), (25, 10), (35, 14)])
def test_tokens_round_half_to_even(spark, n, want):
    assert one(spark, "x" * n, lambda c: text.tokens_by_ratio(c, 2.5)) == want


@pytest.mark.parametrize("value, want", [("  A\tb\n ", "A\tb"), (None, None), ("", "")])
def test_strip(spark, value, want):
    assert one(spark, value, text.strip) == want


@pytest.mark.parametrize("value, want", [("TRUE ", True), ("ok", True), ("0", False), (None, False), ("no", False), ("y", True)])
def test_truthy(spark, value, want):
    assert one(spark, value, text.truthy) is want


def test_normalize_and_focus(spark):
    assert one(spark, "L'Été, 12:30 - Fin!", text.normalize_text) == "l t 12:30 - fin"
    assert one(spark, None, text.normalize_text) == ""
    assert one(spark, "The ladies and boxes of stories 2020 cat x bus buses", text.focus_tokens) == ["lady", "box", "story", "cat", "bus"]
    assert one(spark, None, text.focus_tokens) == []


def test_ngrams(spark):
    assert one(spark, "a b c d", lambda c: text.ngrams(c, 3)) == ["a b c", "b c d"]
    assert one(spark, "a b", lambda c: text.ngrams(c, 3)) == [] and one(spark, None, lambda c: text.ngrams(c, 2)) == []


def test_numbers(spark):
    assert one(spark, "On 2020-03-04 he paid 1,200 and 3.50 in step 2, room 007", text.numbers_without_dates) == ["1200", "3.5", "7"]
    assert one(spark, "$0042.500", text.numeric_token) == "42.5"


def test_distinct_ignoring_case(spark):
    assert one(spark, ["A", "a", None, " ", "B"], text.distinct_ignoring_case, "array<string>") == ["A", "B"]


def test_labels(spark):
    assert one(spark, "```\nSchema: \"moves to a new city\"\n```", text.clean_schema) == "moves to a new city"
    assert one(spark, "a/b c?", lambda c: text.label(c, F.lit(None).cast("string"), F.lit("x"))) == "a_b_c_x"


@pytest.mark.parametrize("value, want", [("2020-03-04 10:11", "2020-03-04"), ("on 2020/3/4", "2020-03-04"), ("2020-02-31", ""), (None, ""), ("n/a", "")])
def test_normalize_date(spark, value, want):
    assert one(spark, value, dates.normalize_date) == want


@pytest.mark.parametrize("value, want", [("late March", 3), ("mayor's day", 5), ("Jan.", 1), ("before the thaw", 0), (None, 0), ("summer", 7)])
def test_months_are_found_in_order(spark, value, want):
    assert one(spark, value, dates.month_of) == want


def test_day_count_takes_the_first_number(spark):
    assert one(spark, "2 events, 120 days after 2020-01-01", dates.day_count) == 2
    assert one(spark, "2020-01-01", dates.day_count) is None


def test_date_variants(spark):
    found = one(spark, "2020-03-21", dates.date_variants)
    assert {"march 21, 2020", "march 21st", "the 21st of march", "march 2020", "late march"} <= set(found)
    assert one(spark, "no date", dates.date_variants) == []
    assert one(spark, "Sold on March 21st.", lambda c: dates.mentions_date(c, F.lit("2020-03-21"))) is True


def test_ranges(spark):
    assert one(spark, "October 2020", dates.split_range) == ["october 2020"]
    assert one(spark, "October 2020", lambda c: dates.split_range(c, True)) == ["oc", "ber 2020"]
    assert one(spark, "2020-01 to 2020-03", dates.split_range) == ["2020-01", "2020-03"]


def test_month_year(spark):
    assert tuple(one(spark, "in March 2020", dates.month_year)) == (2020, 3)
    assert one(spark, "never", dates.month_year) is None


def test_overlap(spark):
    row = spark.createDataFrame([("the brass lantern", "a brass clock")], "a string, b string").select(sets.overlap_metrics(F.col("a"), F.col("b")).alias("m")).first()["m"]
    assert (row["recall"], row["precision"], row["f1"]) == (0.5, 0.5, 0.5)


@pytest.mark.parametrize("a, b, want", [("", "", 1.0), ("x", "", 0.0), (None, None, 1.0), ("abc", "xxabcxx", 1.0), ("abcd", "abxd", 0.75)])
def test_partial_ratio(a, b, want):
    assert fuzzy.partial_ratio(a, b) == want


@pytest.mark.parametrize("value, ok", [('{"a":1}', True), ('{"a":1} xx', False), ("```json\n[1]\n```", True), ("", False), (None, False), ("{", False)])
def test_strict_json(spark, value, ok):
    row = spark.createDataFrame([(value,)], "x string").select(jsons.strict_json("x").alias("y")).first()["y"]
    assert (row["reason"] is None) is ok


@pytest.mark.parametrize("value, how", [('{"a":1}', "whole"), ('x ```json\n{"a":1}``` y', "fenced"), ('so {"a": {"b": "}"}} end', "braces"), ('{"a":[1,],}', "commas"), ("none", "no braces"), ('{"a":', "unbalanced"), (" ", "empty"), ("[1]", "no object")])
def test_recovered_objects(value, how):
    assert jsons.recover_object(value)[1] == how


@pytest.mark.parametrize(
    "value, n, how",
    [('[{"role":"user","content":"a"}]', 1, "direct"), ('ok: [{"speaker":"AI","message":"a"}] done', 1, "array"), ('[{"role":"user","content":"a"},{"role":"user","content":"b"},{"ro', 2, "cut off"), ("[{'role':'user','content':'a'}]", 1, "literal"), ('"role": "x", "content": "y" {', 1, "pairs"), ("nothing", 0, "none"), (None, 0, "empty")],
)
def test_recovered_turns(value, n, how):
    turns, found = jsons.recover_turns(value)
    assert (len(turns), found) == (n, how)


def test_votes(spark):
    said = [("Incorrect", 0.0), ("correct", 1.0), ("partially correct", 0.5), ("Score: 0.8", 1.0), ("0.4", 0.5), ("no idea", None), (None, None), ("7", None)]
    df = spark.createDataFrame([(s,) for s, _ in said], "s string").select("s", scoring.judge_vote(F.col("s"), F.lit(True)).alias("v"))
    assert [r["v"] for r in df.collect()] == [v for _, v in said]


@pytest.mark.parametrize("case", GOLDEN, ids=[c[0] for c in GOLDEN])
def test_scores(case):
    score, sure, _, final, _ = scoring.score_one(*case[1:6])
    assert (score, sure, final) == case[6:]


def test_a_floor_is_kept_under_a_judge(spark):
    loose = next(c for c in GOLDEN if c[0] == "a loose tail")
    assert scoring.score_one(*loose[1:6])[2] == 0.5
    rows = spark.createDataFrame([(0.5, 0.5, 0.0), (0.5, None, 0.0), (1.0, None, None), (1.0, None, 0.5)], "rule double, floor double, judged double")
    both = rows.select(scoring.with_judge(F.col("rule"), F.col("floor"), F.col("judged"), F.lit(False)).alias("x")).collect()
    assert [tuple(r["x"]) for r in both] == [(0.5, "rule_floor"), (0.0, "judge"), (1.0, "rule"), (0.5, "judge")]


def test_values_and_slots_agree_with_the_columns(spark):
    texts = ["Her job title is a harbour pilot", "name: Joris Bo", "What two things, and why", "Where did Kela go?", "He moved to the old ferry", "", "one: two: three", "a b c d e f g h i: j", "Cities of boxes are status 2020 x1"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.focus_tokens(F.col("t")).alias("f"), text.question_kind(F.col("t")).alias("k"), text.slot_count(F.col("t")).alias("n"), text.value_candidates(F.col("t"), text.question_kind(F.col("t"))).alias("v"), text.value_candidates(F.col("t"), F.lit("location")).alias("p"))
    for r in rows.collect():
        assert list(dict.fromkeys(scoring.focus(r["t"]))) == r["f"] and scoring.kind_of(r["t"]) == r["k"] and scoring.slots_of(r["t"]) == r["n"]
        assert scoring.values(r["t"], r["k"]) == r["v"] and scoring.values(r["t"], "location") == r["p"]


@pytest.mark.parametrize("n, parts", [(0, 3), (2, 5), (10, 3), (59, 12)])
def test_parts_differ_by_one(spark, n, parts):
    rows = near_equal_parts(spark.range(n), parts, hash_order(1, F.col("id")), F.col("id"), name="part").collect()
    sizes = [sum(r["part"] == p for r in rows) for p in range(1, parts + 1)]
    assert sum(sizes) == n and (max(sizes) - min(sizes) <= 1) and sizes == sorted(sizes, reverse=True)


def test_many_votes_and_names_are_all_counted(spark):
    from palimpsest.functions import text
    from palimpsest.operators import audit

    votes = ["NO"] * 5 + ["YES"] * 1_000 + ["NO"] * 1_500
    names = " and ".join("A" + "".join(chr(97 + int(x)) for x in f"{i:04}") for i in range(1_200))
    row = spark.createDataFrame([(votes, names)], "votes array<string>, names string").select(audit.vote_result(F.col("votes")), F.size(text.entities(F.col("names"), None))).first()
    assert tuple(row) == (audit.MISSING, 1_200)
