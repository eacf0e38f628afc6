"""Overlaps between splits, defective pairs, splits of groups and pieces of texts."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.llm import chunking, group_split, pair_defects, split_overlap
from palimpsest.llm.pair_defects import defect

RECORD = (
    "row_id long, split_name string, source_file string, record struct<id:string,prompt:string,reference:string,"
    "metadata:struct<task_type:string,dialogue_id:string,character:string,query:string,answer_components:array<string>,source_event_ids:array<string>>>, key string, block string"
)


def record(i, split, who, events, question, answer, prompt=None):
    return (i, split, "f", ("x", prompt, answer, ("IE", "d", who, question, None, events)), "clash", "clash")


Q = "Which person kept Kela company while the brass lantern was being restored?"


def test_overlaps(spark):
    rows = [
        record(1, "train", "Kela Bo", ["2020_E1"], Q, "It was Joris, who had known Kela since the years at the market."),
        record(2, "eval_seen", "BO, Kela", [" 2020-e01 ", "2020_E1"], "Quick question: which person kept Kela company while brass lantren was being restored? Thanks.", "Answer: It was Joris, who had known Kela since the years at the market"),
        record(3, "eval_seen", "Kela Bo", ["2020_E2"], Q, "It was Joris, who had known Kela since the years at the market."),
        record(4, "eval_unseen", "Kela Bo", ["2020_E1"], Q, "It was Elian, who had known Kela since the years at the market."),
        record(5, "eval_unseen", None, ["2020_E1"], None, "It was Joris, who had known Kela since the years at the market.", f"Person: kela bo\n\n### Question\n{Q}"),
        record(6, "train", "Kela Bo", ["2020_E1"], Q, "It was Joris, who had known Kela since the years at the market."),
        record(7, "eval_seen", "Kela Bo", None, Q, "x"),
        record(8, None, "Kela Bo", ["2020_E1"], Q, "x"),
        record(9, "eval_seen", "Kela Bo", ["2021_E1"], "How many days?", "12 days"),
        record(10, "train", "Kela Bo", ["2021_E1"], "How many days?", "13 days"),
        (11, "eval_seen", None, None, "c", "c"),
        record(12, "eval_seen", "Kela Bo", ["2023_E1"], "word " * 5_000, None),
        record(13, "train", "Kela Bo", ["2023_E1"], "word " * 5_000, None),
    ]
    df = spark.createDataFrame(rows, RECORD)
    pairs = split_overlap.overlaps(df)
    assert {tuple(r) for r in pairs.collect()} == {(1, 2), (6, 2), (1, 5), (6, 5), (13, 12)}
    report = {(r["split_name"]): (r["rows"], r["overlapping"], r["pairs"]) for r in split_overlap.overlap_report(df, split_overlap.overlap_classes(df)).where("source_file = 'f'").collect()}
    assert report == {"eval_seen": (5, 2, 3), "eval_unseen": (2, 1, 2)}
    links = {r["row_id"]: (r["train"], r["links"]) for r in split_overlap.overlap_classes(df).where("links > 0").collect()}
    assert links == {1: (True, 2), 6: (True, 2), 13: (True, 1), 2: (False, 2), 5: (False, 2), 12: (False, 1)}
    assert {tuple(r) for r in split_overlap.overlaps(df, hot_pairs=0).collect()} == {tuple(r) for r in pairs.collect()}
    assert split_overlap.overlaps(df.limit(0)).count() == 0


def test_hot_blocks_lose_nothing(spark):
    """One character and event hold all rows, in questions of one form; pairs against brute force."""
    rng = random.Random(6)
    things = [f"{a} {n}" for a in ("brass", "cracked", "faded", "olive") for n in ("lantern", "clock", "kite", "drum", "stove")]
    rows = []
    for i in range(120):
        thing, place = rng.choice(things), rng.choice(["chapel", "market", "ferry"])
        q = f"What made Kela sell the {thing} at the old {place} near the river?"
        if rng.random() < 0.3:
            q = q.replace("the old", "old")
        rows.append(record(i, "train" if i % 2 else "eval_seen", "Kela Bo", ["2020_E1"], q, f"Because of the {thing}."))
    df = spark.createDataFrame(rows, RECORD)
    words = {r[0]: (r[1], split_overlap.bare_words(r[3][3][3]), split_overlap.bare_words(r[3][2])) for r in rows}
    want = {
        (a, b) for a, x in words.items() for b, y in words.items()
        if x[0] == "train" and y[0] != "train" and split_overlap.question_edits(y[1], x[1], split_overlap.edits_for(len(y[1]))) <= split_overlap.edits_for(len(y[1])) and split_overlap.same_answer(x[2], y[2])
    }
    assert {tuple(r) for r in split_overlap.overlaps(df, hot_pairs=5).collect()} == want


def word_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


@pytest.mark.parametrize("hot_pairs", [split_overlap.HOT_PAIRS, 0])
def test_misspelled_words_lose_no_pair(spark, hot_pairs):
    """Questions with more than k changed words whose cost is within k, as misspelled ones count half."""
    long = "alpha bravo charlie delta echoes foxtrot golfing hotel indigo juliett kilogram limas"
    cases = [
        (long, "alpha XX charlie YY echoes ZZ golfing hottel indigo juliett kilogramm limas"),
        (long, "XX bravo YY delta foxtrot ZZ golfing hotel indigoo juliett kilogram limmas"),
        ("lantern market ferry chapel", "lanttern market ferry chappel"),
        ("lantern market", "lanttern markket"),
        ("one two three four five " + long, "vv ww xx yy zz " + long.replace("hotel", "hottel").replace("limas", "limmas")),
        (long, long.replace("a", "aa").replace("o", "oo")),
        (" ".join(f"word{i}" for i in range(400)), " ".join(f"word{i}" if i % 31 else "zz" for i in range(400))),
        (" ".join(f"word{i}" for i in range(400)), " ".join(f"word{i}" if i % 28 else "zz" for i in range(400))),
    ]
    rng = random.Random(5)
    words = long.split()
    for _ in range(150):
        a = rng.sample(words, rng.randint(1, 12))
        b = [w + w[-1] if (x := rng.random()) < 0.4 else "zz" if x < 0.55 else w for w in a if rng.random() > 0.08]
        cases.append((" ".join(a), " ".join(b) or "zz"))
    rows = [record(2 * i + side, ("train", "eval_seen")[side], "Kela Bo", [f"20{i:03}_E1"], q, "It was Joris.") for i, c in enumerate(cases) for side, q in enumerate(c)]
    want = set()
    for i, (a, b) in enumerate(cases):
        x, y = split_overlap.bare_words(b), split_overlap.bare_words(a)
        if split_overlap.question_edits(x, y, split_overlap.edits_for(len(x))) <= split_overlap.edits_for(len(x)):
            want.add((2 * i, 2 * i + 1))
    assert {(0, 1), (4, 5), (6, 7), (8, 9)} <= want and len({(12, 13), (14, 15)} & want) == 1 and len(want) > 40
    assert {tuple(r) for r in split_overlap.overlaps(spark.createDataFrame(rows, RECORD), hot_pairs=hot_pairs).collect()} == want


def test_segments_miss_nothing():
    rng = random.Random(2)
    for _ in range(3_000):
        a = [rng.choice("abcdefgh") for _ in range(rng.randint(3, 16))]
        b = list(a)
        k = split_overlap.edits_for(len(a))
        for _ in range(rng.randint(0, k)):
            i = rng.randrange(len(b) + 1)
            b[i : i + rng.randint(0, 1)] = [rng.choice("abcdefgh")] * rng.randint(0, 1)
        if not b or word_distance(a, b) > k:
            continue
        parts = split_overlap.segments(a, k)
        assert [w for _, p in parts for w in p] == a
        assert any(b[p : p + len(part)] == part for s, (start, part) in enumerate(parts) for p in split_overlap.places(len(a), len(b), k, s, start, len(part)))


@given(st.lists(st.sampled_from("abcd"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9), st.integers(0, 6))
@settings(max_examples=300, deadline=None)
def test_banded_distance(a, b, k):
    full = word_distance(a, b)
    assert split_overlap._banded(a, b, k, lambda x, y: 0.0 if x == y else 1.0, lambda x: 1.0) == (full if full <= k else k + 1)


CASES = [
    (None, "empty"), ("", "empty"), ("　", "empty"), ("N/A", "empty"), ("(none)", "empty"), ('{"answer": ""}', "empty"), ("[]", "empty"), ("...", "empty"), ("Answer:", "empty"), ("<no answer>", "empty"), ("​", "empty"),
    ("No.", None), ("Two", None), ("48", None), ("lantern, brass clock", None), ("Kela hesitated... then sold the lantern", None), ("He moved on", None), ('He wrote "done".', None),
    ("Because the garden fence had", "truncated"), ("Both go back to one cause: the", "truncated"), ("It was sold at the harb…", "truncated"), ('{"answer": "It was sold', "truncated"), ("It was sold (which", "truncated"), ("It was sold,", "truncated"),
    ('She said "the', "truncated"), ("```json\n{\"a\": 1}\n", "truncated"), ("Steps:\n1. go\n2.", "truncated"), ("<b>It was sold.", "truncated"), ("see (fig. 1) and [2].", None), ("a ) stray ] closer", None),
    ("I'm sorry, but I can't answer that question.", "refusal"), ("As a language model, I am not able to help with this request", "refusal"), ('{"answer": "I cannot share personal details."}', "refusal"), ("I’d rather not speculate about a private person", "refusal"),
    ("Lo siento, no puedo responder a esa pregunta.", "refusal"), ("Diese Frage kann ich leider nicht beantworten.", "refusal"), ("Es tut mir leid, aber dazu kann ich nichts sagen.", "refusal"), ("Désolé, je ne peux pas répondre à cette question.", "refusal"), ("К сожалению, я не могу ответить.", "refusal"), ("申し訳ありませんが、お答えできません。", "refusal"), ('Halo said "I can\'t answer that" and left the station.', None), ("Briis said sorry to Lumis and refused to auction the lantern.", None), ("I sold it at the market.", None),
    (Q, "copied"), (f"Question: {Q}", "copied"), (Q.upper(), "copied"), (f'"{Q}" {Q}', "copied"), (Q[:-1], "copied"), (f"{Q} The brass lantern, at the station with Joris.", None),
    ("Después de 16 días, Kela encontró la campana, y Joran no dijo nada.", "other_language"), ("Es waren 188 Tage, weil niemand helfen wollte.", "other_language"), ("Через 48 дней нашлась старая вещь.", "other_language"), ("自転車はまだ倉庫に置いてあります。", "other_language"),
    ("To stare pudełko, czyli szafa, stało tam przez 94 tygodni, bo nikt nie miał klucza.", "other_language"), ('The note read "Entschuldigung, ich war müde", and Kela kept it.', None), ('Kela called it "la lámpara vieja", after a song.', None), ("Joris", None),
]


@pytest.mark.parametrize("answer, kind", CASES)
def test_defects(answer, kind):
    assert defect(Q, f"Recall only.\n\n### Question\n{Q}", answer) == kind


def test_defects_by_context():
    assert defect("Wo hat Kela die Lampe gesehen?", None, "Es waren 188 Tage, weil niemand helfen wollte.") is None
    assert defect("Wo hat Kela die Lampe zuletzt gesehen und was war mit der Uhr?", None, "The drum was misplaced at the chapel, and the money paid for it.") == "other_language"
    assert defect(Q, None, "Kela varnished a braided works", ["Kela varnished a braided workstation that had been kept"]) == "truncated"
    assert defect(Q, None, "Kela felt grateful, met Joris at the old market, auctio", ["Kela felt grateful", "met Joris at the old market", "auctioned the quilt"]) == "truncated"
    assert defect(Q, None, "Kela felt grateful, and met Joris at the old market", ["Kela felt grateful", "met Joris at the old market"]) is None
    assert defect(Q, None, "Kela varnished a braided workstation", ["Kela varnished a braided workstation"]) is None
    prompt = "No transcript is attached. Use what was learned earlier.\nPerson: Kela\n- Keep the wording plain.\n\n### Question\n" + Q
    assert defect(Q, prompt, prompt) == "copied"
    assert defect(None, None, "Es waren 188 Tage, weil niemand helfen wollte.") is None
    assert defect(Q, None, "It was sold. " * 50_000) is None


REFUSED = ["No comment.", "That information is unavailable to me.", "This isn't something I can discuss.", "My guidelines prevent me from answering.", "Sorry, no can do.", "I lack the information needed.", "I'd have to pass here.", "Our policy does not allow it.", "That lies beyond what I can say.", "I am not authorized to share this.", "I'm going to skip this one.", "I do not wish to discuss it."]
TOLD = ["My guidelines for the garden were simple.", "I passed the station on this side of the river.", "This is something Kela could discuss with Joris.", "That information was kept by Joris.", "I lacked a ladder, so Joris lent me one.", "No comment from Joris changed her mind.", "The policy did not allow it, so Kela left.", "Kela said that it was beyond her.", "It was unknown to Joris."]


def test_refusals_in_other_words():
    assert [x for x in REFUSED if defect(Q, None, x) != "refusal"] == []
    assert [x for x in TOLD if defect(Q, None, x) == "refusal"] == []


def test_words_that_break_off(spark):
    """Words that no text has but as beginnings of others; whole words, names and short answers stay."""
    answers = {
        1: "Kela sold it at the bakery near the harbour", 2: "Joris went to the harbour at night.", 3: "Kela sold it at the bakery near the harb", 4: "Kela sold it at the bakery near the zzyx", 5: "harbo", 6: "He met her there, at Joris", 7: "Kela sold it because her brother", 8: "Kela left before the storm",
        9: "The harbour of Joris was full, the storm came", 10: "Kela sold it at the bakery near the harbou.",
    }
    df = spark.createDataFrame([record(i, "train", "k", [], Q, a) for i, a in answers.items()], RECORD)
    found = {(r["row_id"], r["defect"]) for r in pair_defects.find_defects(pair_defects.record_pairs(df)).collect()}
    assert found == {(3, "truncated"), (7, "truncated")}


def test_find_defects(spark):
    rows = [record(1, "train", "k", [], Q, None), record(2, "train", "k", [], Q, "Joris"), (3, "train", "f", None, "c", "c"), record(4, "train", "k", [], " ", Q, f"### Question\n{Q}\n### End\nx")]
    found = pair_defects.find_defects(pair_defects.record_pairs(spark.createDataFrame(rows, RECORD)))
    assert {tuple(r) for r in found.collect()} == {("parametric_eval_records", 1, -1, "empty"), ("parametric_eval_records", 3, -1, "empty"), ("parametric_eval_records", 4, -1, "copied")}
    tasks = "row_id long, tasks_covered array<struct<query:string,gold_answer:string,answer_components:array<string>>>, defect string"
    d = spark.createDataFrame([(1, [(Q, "", None), None, (Q, "Joris", [])], "x"), (2, None, "x"), (3, [], "x")], tasks)
    assert {tuple(r) for r in pair_defects.find_defects(pair_defects.task_pairs(d)).collect()} == {("dialogue_records", 1, 0, "empty")}
    assert pair_defects.find_defects(pair_defects.task_pairs(d.limit(0))).count() == 0


def test_tiles():
    assert pair_defects.tiles("a b c x d e f".split(), "d e f q a b c".split()) == [(0, 4, 3), (4, 0, 3)]
    assert pair_defects.tiles("a b".split(), "a b".split()) == []


def brute_components(links):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("shape", ["random", "path", "star", "none"])
def test_components(spark, shape):
    rng = random.Random(5)
    links = {"random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)], "path": [(i, i + 1) for i in range(70)], "star": [(0, i) for i in range(1, 300)] + [(7, 7)], "none": []}[shape]
    df = spark.createDataFrame([*links, (None, 5), (5, None)], "a long, b long")
    assert {r["node"]: r["component"] for r in group_split.components(df).collect()} == brute_components(links)


def test_splits_keep_groups_together(spark):
    rng = random.Random(1)
    rows = [(i, f" Name{rng.randrange(60)} X " if i % 9 else None, f"dlg:{rng.randrange(2_000):032x}" if i % 7 else " ", rng.choice(["a", "b", "c", None])) for i in range(3_000)]
    df = spark.createDataFrame(rows, "row_id long, who string, dialogue string, label string")
    keys = {"c": group_split.name_key(F.col("who")), "d": group_split.id_key(F.col("dialogue"))}
    members, _ = group_split.tie(df, "row_id", keys)
    assert members.count() == 3_000
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, target_share double")
    labels = df.select(F.col("row_id").alias("row"), "label", F.lit("clash").alias("component"))
    placed = group_split.assign_splits(members, labels, targets)
    assert placed.groupBy("component").agg(F.countDistinct("split_name").alias("n")).where("n > 1").count() == 0
    assert placed.agg(F.sum("rows")).first()[0] == 3_000
    assert group_split.assign_splits(members.limit(0), labels, targets).count() == 0
    assert group_split.assign_splits(members, labels, targets.limit(0)).count() == 0


def test_even_groups_meet_the_targets(spark):
    rows = [(i, i // 3, "ab"[i % 2]) for i in range(3_000)]
    df = spark.createDataFrame(rows, "row long, component long, label string")
    members = df.select("row", F.col("component").cast("string").alias("component"))
    targets = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1)], "split_name string, target_share double")
    placed = group_split.assign_splits(members, df.select("row", "label"), targets)
    got = {r["split_name"]: r["n"] for r in placed.groupBy("split_name").agg(F.sum("rows").alias("n")).collect()}
    assert abs(got["train"] - 2_400) < 60 and abs(got["test"] - 300) < 60 and abs(got["validation"] - 300) < 60


def test_many_labels_and_a_heavy_component(spark):
    """More labels than LABELS each keep their shares; one component holds a third of the rows."""
    rows = [(i, "heavy" if i // 90 % 3 == 0 else str(i // 5), f"l{i % 90}") for i in range(18_000)]
    df = spark.createDataFrame(rows, "row long, component string, label string")
    targets = spark.createDataFrame([("train", 0.6), ("test", 0.4)], "split_name string, target_share double")
    placed = group_split.assign_splits(df.select("row", "component"), df.select("row", "label"), targets).cache()
    got = {r["split_name"]: r["n"] for r in placed.groupBy("split_name").agg(F.sum("rows").alias("n")).collect()}
    assert abs(got["train"] - 10_800) < 300 and sum(got.values()) == 18_000
    by_label = df.join(placed, "component").groupBy("label").agg(F.mean(F.when(F.col("split_name") == "train", 1.0).otherwise(0.0)).alias("share")).collect()
    assert len(by_label) == 90 and all(abs(r["share"] - 0.6) < 0.1 for r in by_label)


@given(st.text(alphabet="ab  .\n。́x", max_size=400), st.integers(2, 60), st.data())
@settings(max_examples=300, deadline=None)
def test_pieces(text, limit, data):
    overlap = data.draw(st.integers(0, limit - 1))
    parts = chunking.split_text(text, limit, overlap)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(e - s <= limit for s, e, _ in parts)
    assert all(s2 == e - overlap and e2 > e for (_, e, _), (s2, e2, _) in zip(parts, parts[1:], strict=False))


def test_cuts_are_natural_where_they_can_be():
    text = "A sentence of some words. " * 30
    assert {k for *_, k in chunking.split_text(text, 120, 20)} == {"sentence", "end"}
    assert [k for *_, k in chunking.split_text("x" * 250, 100, 10)] == ["forced", "forced", "end"]
    long_ = "word " * 400_000
    assert max(e - s for s, e, _ in chunking.split_text(long_, 2_000, 200)) <= 2_000


def test_split_oversized(spark):
    limits = spark.createDataFrame([("content", 50, 5), ("prompt", 60, None), ("void", None, None)], "item_kind string, max_chars int, overlap_chars int")
    items = [("content", 1, 0, "word " * 20, 1), ("content", 1, 1, "x" * 51, 1), ("content", 1, 2, "x" * 50, 1), ("prompt", 2, -1, "ああ。" * 30, 1), ("prompt", 3, -1, None, 1), ("prompt", 4, -1, "", 1), ("other", 5, 0, "x" * 500, 1), ("void", 6, 0, "x" * 500, 1)]
    df = spark.createDataFrame(items, "item_kind string, row_id long, turn_idx int, text string, max_chars int")
    rows = chunking.split_oversized(df, limits).collect()
    assert {(r["item_kind"], r["row_id"], r["turn_idx"], r["item_cut"]) for r in rows} == {("content", 1, 0, "natural"), ("content", 1, 1, "forced"), ("prompt", 2, -1, "natural")}
    assert all(len(r["text"]) <= 60 for r in rows)
    assert chunking.split_oversized(df.limit(0), limits).count() == 0


def test_short_answers_in_another_language():
    asked = "What did Kela and Joris do with the piñata at the market after the ferry had left?"
    for answer in ("Sie reparierte Lampen mit Halo.", "Joris wartete zwischen zwei Booten.", "Elle vendait toujours des lampes.", "Han sålde lampor tillsammans.", "Hän korjasi lamppuja ilman Jorista.", "Anna viajó a Madrid.", "Elle partit à Lyon", "Lámpákat javított Joris nélkül."):
        assert defect(asked, None, answer) == "other_language", answer
    for answer in ("Joris met Kela.", "Joris de Vries", "Bo Kela, Lei Hans", "Feno felt wary, met Kelia.", "Repaired lamps with Halo.", "Brass lantern, folding chairs", "hand-stitched piñata, crimson easel"):
        assert defect(asked, None, answer) != "other_language", answer
    assert defect("Was hat Kela nach dem Markt gemacht und wer war dabei?", None, "She repaired lamps with Halo.") == "other_language"


def test_a_very_long_text_is_cut_at_the_least_cost():
    rng = random.Random(9)
    text = "".join("x" * rng.randint(1, 9) + rng.choice([" ", " ", ". ", "\n\n"]) for _ in range(6_000))
    assert len(text) > 400 * 40  # more than was once cut at a time
    assert chunking.split_text(text, 40, 3) == chunking.best_cuts(text, 40, 3)
