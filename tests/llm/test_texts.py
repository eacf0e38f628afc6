"""Leaked passages and look-alike texts."""

import random

from palimpsest.llm import leakage, lookalike
from palimpsest.llm.fold import loose_words, table_form

ITEM = "Oddly, their climbing coach partly restored 68 portable buttons beyond the Eddlemore ferry, after Delan plus 83 guests proudly unpacked a reclaimed canoe beneath the harbour."
INSTRUCTION = "Read the passage once, then answer without looking back at any earlier part of it."
FILL = "By evening Kela had sold the lantern and everyone was quietly furious about that. "
WORDS = ITEM.split()


def leak(*parts):
    return FILL + " ".join(parts) + " " + FILL


DOCUMENTS = {
    1: leak(ITEM), 2: leak(*WORDS[4:16]), 3: leak(*WORDS[4:14]), 4: leak(*[w.upper() + " **" for w in WORDS[4:20]]), 5: leak(*WORDS[2:9], "CHANGED", *WORDS[10:20]), 6: leak(*WORDS[2:9], *WORDS[10:20]), 7: leak(*WORDS[2:9], "extra", *WORDS[9:20]),
    8: leak(*WORDS[2:10], "user: " + FILL, *WORDS[10:18]), 9: leak(" ".join(WORDS[3:17]).replace("e", "е").replace("o", "ο")), 10: leak("<b>" + " ".join(WORDS[3:17]) + "</b>"), 11: leak(INSTRUCTION), 12: None, 13: "", 14: FILL * 3_000 + ITEM, 15: FILL,
}
LEAKED = {1, 2, 4, 5, 6, 7, 8, 9, 10, 14}
ITEMS = [(1, ITEM), (2, INSTRUCTION + " Some 82 evenings afterwards, a landlord kindly varnished 64 folding buttons behind the museum without gloves."), (3, INSTRUCTION + " Out of spite, nobody except Joreth again sketched 62 tarnished buttons inside the library."), (4, None), (5, ""), (6, "Xyzzy plugh")]


def frames(spark):
    docs = spark.createDataFrame([(k, v, "clash") for k, v in DOCUMENTS.items()], "doc_id long, text string, item_id string")
    return docs, spark.createDataFrame([(k, v, "clash") for k, v in ITEMS], "item_id long, text string, doc_id string")


def test_leaks(spark):
    docs, items = frames(spark)
    found = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, items).collect()}
    assert found == {(d, 1) for d in LEAKED}
    full = {(r["doc_id"], r["item_id"]) for r in leakage.find_leaks(docs, items, filter_bits=6).collect()}
    assert full == found  # a filter that lets every seed through
    assert leakage.find_leaks(docs.limit(0), items).count() == 0 and leakage.find_leaks(docs, items.limit(0)).count() == 0


def test_repeated_documents_and_items_each_count(spark):
    docs = spark.createDataFrame([(1, leak(ITEM)), (1, leak(ITEM)), (2, leak(ITEM))], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, ITEM)], "item_id long, text string")
    assert sorted(tuple(r)[:2] for r in leakage.find_leaks(docs, items).collect()) == [(1, 1), (1, 1), (1, 2), (1, 2), (2, 1), (2, 2)]


def test_short_items_must_stand_whole(spark):
    docs = spark.createDataFrame([(1, "a xyzzy plugh b"), (2, "a xyzzy b"), (3, "seven words stand here in this line now"), (4, "seven words stand here in that")], "doc_id long, text string")
    items = spark.createDataFrame([(6, "Xyzzy plugh"), (7, "Seven words stand here in this line.")], "item_id long, text string")
    assert {tuple(r)[:2] for r in leakage.find_leaks(docs, items).collect()} == {(1, 6), (3, 7)}


def test_an_edit_next_to_an_items_end(spark):
    item = "Fenis and Aela kindly lent the quilted cabinet beneath the old workshop"
    docs = spark.createDataFrame([(1, FILL + item.replace("and ", "")), (2, FILL + item.replace("old ", "new ") + " " + FILL), (3, FILL + item[10:])], "doc_id long, text string")
    found = leakage.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {(r["doc_id"], r["words"], r["errors"]) for r in found.collect()} == {(1, 12, 1), (2, 12, 1)}


def test_a_part_of_a_stretch_with_many_edits(spark):
    """Twelve words in a row count whatever edits stand behind them, and two single edits in twelve words."""
    words = [f"w{i}" for i in range(24)]
    worse = words[:12] + [x for i in range(12, 24, 3) for x in (f"x{i}", *words[i + 1 : i + 3])]
    two = [w if i not in (4, 8) else "zz" for i, w in enumerate(words[:12])]
    three = [w if i not in (3, 6, 9) else "zz" for i, w in enumerate(words[:12])]
    docs = {1: worse, 2: worse[::-1], 3: words[:11] + worse[12:], 4: two, 5: three, 6: words[:5] + worse[12:]}
    frame = spark.createDataFrame([(i, FILL + " ".join(d) + " " + FILL) for i, d in docs.items()], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[::-1])), (3, " ".join(words[:12]))], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): (r["words"], r["errors"]) for r in leakage.find_leaks(frame, items).collect()}
    assert found[1, 1][0] >= 12 and found[2, 2][0] >= 12
    assert found[1, 3] == (12, 0) and found[4, 1] == found[4, 3] == (12, 2)
    assert not any(d in (5, 6) for d, _ in found)


def test_one_interruption_wherever_it_falls(spark):
    """Twelve words in two pieces of any lengths, the inserted text long or beginning with the item's next words."""
    words = [f"w{i}" for i in range(12)]
    remark = "user: nobody else was there then "
    docs = {}
    for n in range(1, 12):
        for name, between in (("short", remark), ("long", remark * 20), ("next", f"{words[n]} {remark}"), ("last", f"{remark} {words[n - 1]}"), ("two", " ".join(words[n : n + 2]) + " " + remark)):
            docs[n, name] = " ".join(words[:n]) + " " + between + " " + " ".join(words[n:])
    gone = {"first": " ".join(words[:11]), "swapped": " ".join(words[6:]) + " " + remark + " ".join(words[:6]), "twice": " ".join([*words[:4], remark, *words[4:8], remark, *words[8:]])}
    keys = [*docs, *gone]
    frame = spark.createDataFrame([(i, FILL + (docs | gone)[k] + " " + FILL) for i, k in enumerate(keys)], "doc_id long, text string")
    found = {keys[r["doc_id"]] for r in leakage.find_leaks(frame, spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).collect()}
    assert found == set(docs)


def test_windows_against_brute_force():
    rng = random.Random(8)
    for _ in range(2_000):
        runs, i, j = [], 3, rng.randint(0, 4)
        for _ in range(rng.randint(1, 9)):
            e, n = rng.randint(1, 2), rng.randint(1, 12)
            runs.append((i, j, j + n - 1, e))
            i, j = i + n + e, j + n + e
        need, want = rng.choice([5, 12]), 0
        for s in range(len(runs)):
            for t in range(s, len(runs)):
                n, e = runs[t][2] - runs[s][1] + 1, sum(x[3] for x in runs[s + 1 : t + 1])
                if n >= need and (7 * e <= n or (n >= 12 and e <= 2)):
                    want = max(want, n)
        assert (leakage._window(runs, need) or (0,))[0] == want


def test_repeated_items_keep_their_first_sentence(spark):
    items = spark.createDataFrame([(1, "One two three. Four."), (2, "One two three. Four."), (3, "Head shared here. A."), (4, "Head shared here! B.")], "item_id long, text string")
    assert {r["item_id"]: r["text"] for r in leakage.without_instructions(items).collect()} == {1: "One two three. Four.", 2: "One two three. Four.", 3: "A.", 4: "B."}


def test_leaks_against_brute_force():
    """Every verbatim run of at least twelve words is found, whatever stands around it."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(12, 40)))) for i in range(30)]
    index = leakage.Index(items)
    for _ in range(300):
        key, text = rng.choice(items)
        words = text.split()
        n = rng.randint(6, min(20, len(words)))
        start = rng.randrange(len(words) - n + 1)
        doc = rng.choices(vocabulary, k=30) + words[start : start + n] + rng.choices(vocabulary, k=30)
        runs = {i for i, t in items if any(t.split()[a : a + 12] == doc[b : b + 12] for a in range(len(t.split()) - 11) for b in range(len(doc) - 11))}
        import numpy as np

        ids = [index.vocabulary.get(w, 0) for w in doc]
        hits = {}
        for p, k, q in index.hits(np.array(ids)):
            hits.setdefault(k, []).append((p, q))
        found = {index.items[k][0] for k, h in hits.items() if leakage.overlap(ids, index.items[k][1], h)}
        assert runs <= found


SAME = ["The naïve café, office 7-8; KelvinK", "The naïve café, oﬃce 7‑8; KelvinK".replace("ﬃ", "ffi"), "Тhе naïve саfé, office 7-8; KelvinK", "Ｔｈｅ naïve café, o​ff­ice 7-8; KelvinK", "The naïve café, oﬀice 7-8; KelvinK"]
OTHER = ["the naïve café, office 7-8; KelvinK", "The naive café, office 7-8; KelvinK", "The naïve café, office 7-8;  KelvinK", "The naïve café,\noffice 7-8; KelvinK", "", None, "Die Uhr"]


def test_table_form():
    assert len({table_form(t) for t in SAME}) == 1
    assert len({table_form(t) for t in SAME[:1] + [x for x in OTHER if x is not None]}) == 7


def test_alike_pairs(spark):
    texts = [*SAME, SAME[0], *OTHER, None, "Ｄｉｅ Uhr", "при", "Die Uhr " * 20_000 + "​"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, form string")
    forms = lookalike.canonical_texts(docs)
    assert forms.count() == len(texts)
    pairs = {tuple(r) for r in lookalike.alike_pairs(forms).collect()}
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if texts[a] is not None and texts[b] is not None and texts[a] != texts[b] and table_form(texts[a]) == table_form(texts[b])}
    assert pairs == want and len(want) > 10
    assert lookalike.alike_pairs(lookalike.canonical_texts(docs.limit(0))).count() == 0


def test_the_most_frequent_spelling_is_canonical(spark):
    moscow, mixed = "Москва", table_form("Москва")
    texts = [f"{moscow} {moscow}", moscow, mixed, "cop coffee", "сор сор", "сор of­fice", "office office", "c \u200b d", "c  d", "cafe\u0301 cafe\u0301", "café", "\u200b"]
    assert mixed != moscow and table_form("сор") == "cop"
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    forms = {r["doc_id"]: r["form"] for r in lookalike.canonical_texts(docs).collect()}
    want = [f"{moscow} {moscow}", moscow, moscow, "сор coffee", "сор сор", "сор office", "office office", "c  d", "c  d", "cafe\u0301 cafe\u0301", "cafe\u0301", ""]
    assert [forms[i] for i in range(len(texts))] == want


def test_trie_automaton():
    trie = lookalike.Trie()
    for w, n in (("office", 5), ("café", 2), ("coffee", 1)):
        trie.add(w, n)
    assert [w for c, _, w in trie.alike("оﬃсе") if c == 0] == ["office"]
    assert [w for c, _, w in trie.alike("café") if c == 0] == ["café"]
    assert trie.alike("offce") == [] and [w for _, _, w in trie.alike("offce", budget=1.0)] == ["office"]


def test_loose_words():
    assert loose_words("<b>The</b> Ｃａｆé&#39;s ​hand-stitched — “Тор”!") == ["the", "cafes", "handstitched", "top"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def test_trie_against_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 6))) for _ in range(20)}
        trie = lookalike.Trie()
        for w in [*words, *words]:
            trie.add(w, 1)
        for _ in range(3):
            q = "".join(rng.choice("abc") for _ in range(rng.randint(1, 6)))
            for budget in (0, 1, 2):
                assert set(trie.alike(q, float(budget))) == {(float(edits(q, w)), 2, w) for w in words if edits(q, w) <= budget}
