"""Rule scores of structured answers for the six task types.

One pass in Arrow batches gives a struct (score, confident, floor, final,
signals); score is null where no rule decides and a judge would have to. Judges
and their votes are input columns, see :mod:`palimpsest.operators.audit`. Each
type has a function that measures an answer and a decision list, whose first
row that holds decides.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.fuzzy import partial_ratio
from palimpsest.functions.jsons import checked
from palimpsest.functions.text import QUESTION_KINDS, SCAFFOLD_WORDS, SLOT_WORDS, STOP_WORDS, TEMPLATE_MARKS, TWO_SLOTS, UNSPECIFIED_MARKS, VALUE_PATTERNS, WORDS_BEFORE_COLON

SCORED = T.StructType([T.StructField(n, T.DoubleType() if n != "confident" else T.BooleanType()) for n in ("score", "confident", "floor", "final")] + [T.StructField("signals", T.MapType(T.StringType(), T.DoubleType()))])

# Words that anchor nothing, verdicts on a premise, and how a reference says that a premise is wrong or right.
ANCHOR_STOP_WORDS = set("this that these those led lead leading where which years year later after before into from through allowed allowing success coupled him her".split())
WRONG, RIGHT = {"incorrect", "wrong", "false", "invalid"}, {"correct", "true", "valid"}
WRONG_PREMISE = ("premise is incorrect", "this is incorrect", "contains a false premise", "false premise", "query contains a slight timing error", "this is false", "this is wrong", "query is incorrect")
RIGHT_PREMISE = ("premise is correct", "query is correct")
#: Similarity from which on a component counts as told, and from which on as a part of a chain or a summary.
TOLD, IN_CHAIN, IN_SUMMARY = 0.70, 0.55, 0.58

_DAY = re.compile(r"\b\d{4}-\d{2}-\d{2}\b")
_YEAR = re.compile(r"\b(?:19|20)\d{2}\b")
_DROPPED = set(STOP_WORDS + SCAFFOLD_WORDS)
_KINDS = [(k, re.compile(p)) for k, p in QUESTION_KINDS]
_VALUES = {k: [re.compile(p) for p in ps] for k, ps in VALUE_PATTERNS.items()}
_TWO = re.compile(TWO_SLOTS)

#: (score, whether a rule is sure of it, least score under a judge, signals)
Verdict = tuple[float | None, bool, float | None, dict[str, float]]
SURE_RIGHT, SURE_WRONG, OPEN, HALF, HALF_AT_LEAST = (1.0, True, None), (0.0, True, None), (None, False, None), (0.5, False, None), (0.5, False, 0.5)


def _first(rules: Iterable[tuple[bool, tuple]], otherwise: tuple) -> tuple:
    return next((verdict for holds, verdict in rules if holds), otherwise)


@lru_cache(maxsize=20_000)
def norm(text: str) -> str:
    """As :func:`palimpsest.functions.text.normalize_text`."""
    return " ".join(re.sub(r"[^a-z0-9\s\-:]", " ", text.lower()).split())


@lru_cache(maxsize=20_000)
def similar(a: str, b: str) -> float:
    """Partial similarity of two normalized texts; 0 if one has nothing."""
    return partial_ratio(norm(a), norm(b)) if a and b else 0.0


def _singular(w: str) -> str:
    if len(w) > 4:
        return w[:-3] + "y" if w.endswith("ies") else w[:-2] if w.endswith("es") else w[:-1] if w.endswith("s") else w
    return w


@lru_cache(maxsize=20_000)
def focus(text: str) -> tuple[str, ...]:
    """As :func:`palimpsest.functions.text.focus_tokens`, repeated words again and again."""
    return tuple(w for w in map(_singular, norm(text).split()) if len(w) > 1 and not w.isdigit() and w not in _DROPPED)


@lru_cache(maxsize=20_000)
def anchors(text: str) -> tuple[str, ...]:
    """The focus words of a text as stems, without days and words that anchor nothing."""
    found = []
    for w in focus(text):
        if w not in ANCHOR_STOP_WORDS and not _DAY.fullmatch(w):
            w = _singular(w[:-3] if len(w) > 5 and w.endswith("ing") else w[:-2] if len(w) > 4 and w.endswith("ed") else w)
            if len(w) > 1 and w not in ANCHOR_STOP_WORDS:
                found.append(w)
    return tuple(found)


@lru_cache(maxsize=100_000)
def _same_anchor(a: str, b: str) -> bool:
    begins = min(len(a), len(b)) >= 4 and (a.startswith(b) or b.startswith(a))
    return a == b or begins or partial_ratio(a, b) >= 0.72


def overlap(answer: str, candidate: str) -> tuple[float, float, float]:
    """Recall, precision and F1 of an answer's focus words against a candidate's."""
    a, c = set(focus(answer)), set(focus(candidate))
    if not (both := len(a & c)):
        return 0.0, 0.0, 0.0
    recall, precision = both / len(c), both / len(a)
    return recall, precision, 2 * recall * precision / (recall + precision)


def told_share(text: str, components: Sequence[str]) -> float:
    """Share of the components that a text tells."""
    flat = norm(text)
    return sum(partial_ratio(norm(c), flat) >= TOLD for c in components) / len(components) if components else 0.0


def kind_of(query: str) -> str | None:
    q = norm(query)
    return next((k for k, p in _KINDS if p.search(q)), None)


def slots_of(query: str) -> int:
    return 2 if _TWO.search(norm(query)) else 1


def slots_told(text: str, components: Sequence[str]) -> int:
    """Components of which a text has half the focus words, without those that only scaffold a slot."""
    have = set(focus(text))
    own = [set(focus(c)) - set(SLOT_WORDS) for c in components] if text else []
    return sum(bool(o) and 2 * len(o & have) >= len(o) for o in own)


def values(text: str, kind: str | None) -> list[str]:
    """As :func:`palimpsest.functions.text.value_candidates`."""
    raw = norm(text)
    found = [raw] if kind is None else []
    left, colon, right = raw.partition(":")
    if colon and len(left.split()) <= WORDS_BEFORE_COLON:
        found.append(right)
    found += [m[1] for p in _VALUES.get(kind or "", ()) if (m := p.search(raw))]
    return list(dict.fromkeys(v.strip() for v in found if v.strip()))


def silent(text: str) -> bool:
    return any(m in norm(text) for m in UNSPECIFIED_MARKS)


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _list(value: object) -> list:
    return value if isinstance(value, list) else [value] if value else []


def _parts(value: object) -> list[str]:
    return [t for x in _list(value) if (t := _text(x).strip())]


def whole_number(value: object) -> int | None:
    """The first whole number of a value."""
    if isinstance(value, int):
        return int(value)
    m = re.search(r"-?\d+", _text(value))
    return int(m[0]) if m else None


def days_of(text: str | None) -> int | None:
    """The first whole number of a text without its dates."""
    return whole_number(_DAY.sub(" ", text or ""))


def exact_time(response: str | None, reference: str | None) -> float:
    """1 if the response has the reference's days, or without days all its dates; else 0."""
    want = days_of(reference)
    if want is not None:
        return float(days_of(response) == want)
    dates = set(_DAY.findall(reference or ""))
    return float(bool(dates) and dates <= set(_DAY.findall(response or "")))


def _value_signals(answer: str, query: str, reference: str, components: Sequence[str]) -> dict[str, float]:
    """How near an answer comes to the values that the reference and its components offer."""
    kind = kind_of(query)
    sources = [reference, *components]
    offered = [v for t in sources for v in values(t, kind)] or [v for t in sources for v in values(t, None)]
    asked = set(focus(query))
    own = set(focus(answer)) - asked
    shares = [len(own & c) / len(c) for v in offered if (c := set(focus(v)) - asked)]
    signals = {"candidate_ratio": max((similar(answer, v) for v in offered), default=0.0), "focus_recall": max(shares, default=0.0) if own else 0.0, "novel": float(len(own))}
    best = (0.0, 0.0, 0.0, 0.0, 0.0)
    for a in values(answer, kind) or [answer]:
        for v in offered:
            ratio, (recall, precision, f1) = similar(a, v), overlap(a, v)
            score = 0.55 * ratio + 0.25 * f1 + 0.20 * recall
            if score > best[0]:
                best = score, ratio, recall, precision, f1
    return signals | dict(zip(("value_ratio", "value_recall", "value_precision", "value_f1"), best[1:], strict=True))


def extraction(parsed: dict, query: str, reference: str, components: Sequence[str]) -> Verdict:
    """A single fact: right, wrong or open by the similarity of the answer's value."""
    answer = _text(parsed.get("answer"))
    g = _value_signals(answer, query, reference, components)
    ratio, kind, need, have = similar(answer, reference), kind_of(query), slots_of(query), slots_told(answer, components)
    g |= {"ratio": ratio, "component_recall": told_share(" ".join([answer, *map(_text, _list(parsed.get("evidence_snippets")))]), components), "slots": float(have)}
    value, recall, precision, candidate, shared = g["value_ratio"], g["value_recall"], g["value_precision"], g["candidate_ratio"], g["focus_recall"]
    far = ratio <= 0.20 and candidate <= 0.35 and shared == 0
    if silent(reference):
        verdict = SURE_RIGHT if silent(answer) else SURE_WRONG
    elif need > 1:
        verdict = _first([(have < need, SURE_WRONG), (max(ratio, candidate, value) >= 0.55, SURE_RIGHT)], OPEN)
    elif kind == "name":
        whole = (recall >= 0.999 and precision >= 0.80) or (value >= 0.97 and g["value_f1"] >= 0.80 and precision >= 0.70)
        verdict = _first([(whole, SURE_RIGHT), (recall <= 0.50 or precision < 0.60, SURE_WRONG)], OPEN)
    elif kind == "location":
        verdict = _first([(value >= 0.82 or (recall >= 0.50 and precision >= 0.95), SURE_RIGHT), (far, SURE_WRONG)], OPEN)
    else:
        near = ratio >= 0.75 or value >= 0.82 or (g["novel"] > 0 and (candidate >= 0.75 or shared >= 0.75))
        verdict = _first([(near, SURE_RIGHT), (far, SURE_WRONG)], OPEN)
    return *verdict, g


def temporal(parsed: dict, reference: str) -> Verdict:
    """Days agree, both dates are whole dates and hold the reference's, and the answer doesn't contradict them."""
    answer = _text(parsed.get("final_answer"))
    said, want = days_of(answer), days_of(reference)
    days = whole_number(parsed.get("days"))
    days = said if days is None else days
    given = [_text(parsed.get(k)).strip() for k in ("start_date", "end_date")]
    tests = {
        "day_match": want is not None and days == want,
        "date_legal": all(_DAY.fullmatch(x) for x in given),
        "consistent": bool(answer) and (said is None or days is None or said == days) and set(_DAY.findall(answer)) <= set(given),
        "dates_match": set(_DAY.findall(reference)) <= set(given),
    }
    return float(all(tests.values())), True, None, {k: float(v) for k, v in tests.items()}


def updating(parsed: dict, query: str, reference: str, components: Sequence[str]) -> Verdict:
    """The newest state: as a single fact, but a state that no longer holds told as the newest is wrong."""
    latest, old = _text(parsed.get("latest_state")), _text(parsed.get("deprecated_state"))
    g = _value_signals(latest, query, reference, components)
    ratio, stale, told = similar(latest, reference), similar(old, reference), told_share(latest, components)
    kind, need, have = kind_of(query), slots_of(query), slots_told(latest, components)
    g |= {"ratio": ratio, "deprecated": stale, "component_recall_latest": told, "as_of": similar(_text(parsed.get("as_of_time")), reference), "slots": float(have)}
    value, recall, precision, candidate, shared, novel = g["value_ratio"], g["value_recall"], g["value_precision"], g["candidate_ratio"], g["focus_recall"], g["novel"]
    alien = novel >= 3 and shared == 0 and told == 0
    if silent(reference):
        verdict = SURE_RIGHT if silent(latest) else SURE_WRONG
    elif old and stale >= 0.75 and ratio < 0.55:
        verdict = SURE_WRONG
    elif need > 1:
        verdict = _first([(have < need, SURE_WRONG), (told >= 0.50 or max(value, candidate, ratio) >= 0.55, SURE_RIGHT)], OPEN)
    elif kind == "name":
        verdict = _first([(value >= 0.90 or recall >= 0.999, SURE_RIGHT), (value <= 0.55 and recall <= 0.25 and precision <= 0.55, SURE_WRONG)], OPEN)
    elif kind in ("job", "title"):
        verdict = _first([(value >= 0.85 or (recall >= 0.75 and precision >= 0.75), SURE_RIGHT), (value <= 0.40 and recall <= 0.25 and shared == 0, SURE_WRONG)], OPEN)
    elif kind == "location":
        there = value >= 0.80 or (recall >= 0.50 and precision >= 0.60 and shared > 0)
        verdict = _first([(there, SURE_RIGHT), (alien, SURE_WRONG), (value <= 0.20 and candidate <= 0.35 and shared == 0, SURE_WRONG)], OPEN)
    else:
        rules = [
            (value >= 0.80 and precision < 0.25 and novel >= 5 and told < 0.25, SURE_WRONG),
            (told >= 0.50, SURE_RIGHT),
            (value >= 0.80 and (shared >= 0.25 or novel <= 2), SURE_RIGHT),
            (candidate >= 0.85 and shared >= 0.60 and novel <= 2, SURE_RIGHT),
            (ratio <= 0.20 and candidate <= 0.35 and shared == 0, SURE_WRONG),
            (max(ratio, candidate, value) <= 0.40 and shared == 0 and recall == 0 and told == 0, SURE_WRONG),
            (alien, SURE_WRONG),
        ]
        verdict = _first(rules, OPEN)
    return *verdict, g


def year_share(component: str, text: str) -> float:
    want = set(_YEAR.findall(component))
    return len(want & set(_YEAR.findall(text))) / len(want) if want else 0.0


@lru_cache(maxsize=20_000)
def alignment(component: str, text: str) -> float:
    """How well a text tells a component: by letters, or by letters, words, stems and times together."""
    letters, (recall, _, f1) = similar(component, text), overlap(component, text)
    own, said = anchors(component), anchors(text)
    stems = sum(any(_same_anchor(a, b) for b in said) for a in own) / len(own) if own and said else 0.0
    days = set(_DAY.findall(component))
    times = max(len(days & set(_DAY.findall(text))) / len(days) if days else 0.0, year_share(component, text))
    return max(letters, 0.30 * letters + 0.10 * f1 + 0.40 * stems + 0.20 * times, 0.25 * letters + 0.10 * recall + 0.45 * stems + 0.20 * times)


def _best(component: str, units: Sequence[tuple[float, str]]) -> tuple[float, float | None]:
    """(alignment, place) of the unit that tells a component best, the first of equals."""
    score, at = 0.0, None
    for place, text in units:
        if (x := alignment(component, text)) > score:
            score, at = x, place
    return score, at


def _ends(hit: Sequence[bool]) -> float:
    ends = [hit[0], hit[-1]] if len(hit) > 1 else hit[:1]
    return sum(ends) / len(ends) if ends else 0.0


def _order(at: Sequence[float]) -> float:
    return sum(y >= x for x, y in zip(at, at[1:], strict=False)) / (len(at) - 1) if len(at) > 1 else float(len(at))


def chain_units(chain: Sequence[str], outcome: str) -> list[tuple[float, str]]:
    """(place, text) of the chain's segments, of two and three in a row, and of the outcome."""
    runs = [(i + offset, " ".join(chain[i : i + n])) for n, offset in ((1, 0.0), (2, 0.5), (3, 0.75)) for i in range(len(chain) - n + 1)]
    return runs + ([(float(len(chain)), outcome.strip())] if outcome.strip() else [])


def _template(segment: str) -> bool:
    return any(m in norm(segment) for m in TEMPLATE_MARKS) or (len(segment) >= 2 and segment[0] == "(" and segment[-1] == ")")


def reasoning(parsed: dict, reference: str, components: Sequence[str]) -> Verdict:
    """A chain of facts: 1 when it is long enough, whole, ordered, without much else and without a loose tail; 0.5 for most of it."""
    chain, outcome = _parts(parsed.get("event_chain")), _text(parsed.get("final_outcome"))
    recall = told_share(" ".join([*map(_text, _list(parsed.get("event_chain"))), outcome]), components)
    found = [_best(c, chain_units(chain, outcome)) for c in components]
    hit = [x >= IN_CHAIN and at is not None for x, at in found]
    placed = [at for (_, at), h in zip(found, hit, strict=True) if h]
    bridge, ends, ordered = (sum(hit) / len(hit) if hit else 0.0), _ends(hit), _order(placed)
    last = max((int(at) for at in placed if at < len(chain)), default=-1)
    all_parts = [x for x in [*chain, outcome.strip()] if x]
    near = [similar(x, reference) for x in all_parts]
    mean, most, out = (sum(near) / len(near) if near else 0.0), max(near, default=0.0), similar(outcome, reference)
    made_up = sum(map(_template, all_parts)) / len(all_parts) if all_parts else 0.0
    bracketed = sum(x[0] == "(" and x[-1] == ")" for x in chain) / len(chain) if chain else 0.0
    fit = [max([alignment(c, x) for c in components] + [similar(x, reference)]) for x in chain]
    dated = [max((year_share(c, x) for c in components), default=0.0) for x in chain]
    other = sum(x < 0.45 for x in fit) / len(fit) if fit else 0.0
    tail = list(zip(fit, dated, strict=True))[last + 1 :]  # the whole chain where nothing matched
    loose = sum(x < 0.45 or (y == 0 and x < 0.60) for x, y in tail) / len(tail) if tail else 0.0
    kept = len(chain) >= 2 and ends >= 1 and bridge >= 0.75 and ordered >= 0.66
    rules = [
        (made_up >= 0.60 and recall <= 0.05 and (bracketed >= 0.75 or bridge <= 0.15), SURE_WRONG),
        (kept and out >= 0.50 and other <= 0.25 and loose == 0, SURE_RIGHT),
        (most <= 0.20 and out <= 0.20 and bridge <= 0.15, SURE_WRONG),
        (kept and most >= 0.55 and other <= 0.50, HALF_AT_LEAST),
        (len(chain) >= 1 and (bridge >= 0.25 or (mean >= 0.50 and most >= 0.70 and out >= 0.35)), HALF),
    ]
    g = {"component_recall": recall, "bridge": bridge, "ends": ends, "order": ordered, "other": other, "tail": loose, "chain": float(len(chain)), "outcome": out, "template": made_up, "bracketed": bracketed, "mean": mean, "most": most}
    return *_first(rules, SURE_WRONG), g


def summary(parsed: dict, query: str, reference: str, components: Sequence[str]) -> Verdict:
    """A summary: 1 when its points have nearly all anchors within the years asked for, 0.5 for part of them."""
    points, told, span = _parts(parsed.get("key_turning_points")), _text(parsed.get("summary")), _text(parsed.get("time_span"))
    recall = told_share(" ".join([span, told, *map(_text, _list(parsed.get("key_turning_points")))]), components)
    units = [(float(i), p) for i, p in enumerate(points)]
    every = units + ([(float(len(points)), told.strip())] if told.strip() else [])
    n = max(1, len(components))
    at_point = [_best(c, units) for c in components]
    in_points = [x >= IN_SUMMARY for x, _ in at_point]
    in_all = [_best(c, every)[0] >= IN_SUMMARY for c in components]
    anchor, point, only = sum(in_all) / n, sum(in_points) / n, sum(a and not p for a, p in zip(in_all, in_points, strict=True)) / n
    near = [similar(x, reference) for x in [told.strip(), *points] if x]
    mean, most, ratio = (sum(near) / len(near) if near else 0.0), max(near, default=0.0), similar(told, reference)
    want, have = set(_YEAR.findall(query) or _YEAR.findall(reference)), set(_YEAR.findall(span))
    shared, outside = not want or not have or bool(want & have), bool(want and have - want)
    within = shared and not outside
    alike = (ratio >= 0.65 and mean >= 0.55) or (mean >= 0.60 and most >= 0.80) or (most >= 0.75 and point >= 1)
    rules = [
        (not told.strip() or not points, SURE_WRONG),
        (len(points) >= 2 and within and anchor >= 0.85 and point >= 0.75 and only <= 0.15 and alike, SURE_RIGHT),
        (not shared and ratio <= 0.20 and anchor <= 0.15 and point <= 0.15, SURE_WRONG),
        (within and anchor >= 0.75 and point >= 0.50 and _ends(in_all) >= 1, HALF_AT_LEAST),
        (not outside and (max(anchor, point) >= 0.25 or (ratio >= 0.45 and most >= 0.65) or (mean >= 0.50 and most >= 0.70)), HALF),
    ]
    g = {"component_recall": recall, "anchors": anchor, "points": point, "only_summary": only, "ends": _ends(in_all), "order": _order([at for (_, at), h in zip(at_point, in_points, strict=True) if h]), "summary": ratio, "span": similar(span, f"{query} {reference}"), "years_shared": float(shared), "years_outside": float(outside), "mean": mean, "most": most}
    return *_first(rules, SURE_WRONG), g


def expected_verdict(reference: str) -> str | None:
    """What a reference says about the premise it was asked with: incorrect, correct, or nothing."""
    flat = norm(reference)
    return "incorrect" if any(m in flat for m in WRONG_PREMISE) else "correct" if any(m in flat for m in RIGHT_PREMISE) else None


def arbitration(parsed: dict, reference: str, components: Sequence[str]) -> Verdict:
    """A premise: wrong with the wrong verdict; right with the correction's facts, half right with some of them."""
    said, error = _text(parsed.get("premise_verdict")).strip().lower(), _text(parsed.get("premise_error"))
    facts, answer = [_text(x) for x in _list(parsed.get("corrected_facts"))], _text(parsed.get("final_answer"))
    wrong, right = said in WRONG, said in RIGHT
    corrected = " ".join(x for x in facts if x.strip())
    recall, mended, ratio = told_share(" ".join([error, answer, *facts]), components), told_share(corrected, components), similar(answer, reference)
    expected = expected_verdict(reference)
    corrects = bool(error.strip() or corrected)
    if expected == "incorrect":
        rules = [(wrong and corrects and mended >= 0.30 and ratio >= 0.45, SURE_RIGHT), (wrong and corrects and (mended >= 0.15 or (ratio >= 0.35 and recall >= 0.20)), HALF)]
    elif expected == "correct":
        rules = [(right and (ratio >= 0.45 or recall >= 0.55), SURE_RIGHT), (right and (ratio >= 0.35 or recall >= 0.30), HALF)]
    else:
        some = ratio >= 0.35 or recall >= 0.25
        rules = [(wrong and mended >= 0.30 and ratio >= 0.45, SURE_RIGHT), (wrong and mended >= 0.15 and some, HALF), (right and some, HALF)]
    return *_first(rules, SURE_WRONG), {"component_recall": recall, "corrected": mended, "ratio": ratio, "wrong": float(wrong), "right": float(right), "corrects": float(corrects)}


_RULES: dict[str, Callable[[dict, str, str, Sequence[str]], Verdict]] = {
    "Information Extraction": extraction,
    "Temporal Reasoning": lambda parsed, query, reference, components: temporal(parsed, reference),
    "Knowledge Updating": updating,
    "Multi-session Reasoning": lambda parsed, query, reference, components: reasoning(parsed, reference, components),
    "Event Summarization": summary,
    "Memory Arbitration": lambda parsed, query, reference, components: arbitration(parsed, reference, components),
}


def score_one(task_type: str | None, response: str | None, query: str | None, reference: str | None, components: Sequence[str] | None) -> tuple[float | None, bool, float | None, float, dict]:
    """(score, confident, floor, final, signals) of one response.

    A response that isn't an object with its fields scores 0, but a temporal one
    still by the times it names; fields that may be left out count as empty.
    final is the score, 0 where no rule decides; a temporal answer gets the
    better of its structured and its plain score. Unknown types compare the
    whole object with the reference.
    """
    reference, query = reference or "", query or ""
    components = [c for c in (components if components is not None else []) if c is not None]
    parsed, ok = checked(response, task_type)
    timed = task_type == "Temporal Reasoning"
    plain = exact_time(response, reference) if timed else 0.0
    if not ok:
        return 0.0, True, None, plain, {"parse_ok": 0.0}
    if task_type not in _RULES:
        ratio = similar(response or "", reference)
        return float(ratio >= 0.8), True, None, float(ratio >= 0.8), {"parse_ok": 1.0, "ratio": ratio}
    score, sure, floor, g = _RULES[task_type](parsed, query, reference, components)
    return score, sure, floor, max(score or 0.0, plain), {"parse_ok": 1.0} | {k: round(v, 6) for k, v in g.items()}


@F.pandas_udf(SCORED)
def rule_score(task_type: pd.Series, response: pd.Series, query: pd.Series, reference: pd.Series, components: pd.Series) -> pd.DataFrame:
    """:func:`score_one` of each row."""
    rows = [score_one(*x) for x in zip(task_type, response, query, reference, components, strict=True)]
    return pd.DataFrame({name: pd.Series([r[i] for r in rows], dtype="float64" if i in (0, 2, 3) else object) for i, name in enumerate(SCORED.fieldNames())})


def skips_judge(task_type: Column, signals: Column) -> Column:
    """Whether a chain is so made up that no judge is asked."""
    at = lambda k: F.coalesce(F.try_element_at(signals, F.lit(k)), F.lit(0.0))
    return F.coalesce((task_type == "Multi-session Reasoning") & (at("template") >= 0.60) & (at("component_recall") <= 0.05), F.lit(False))


def band(score: Column, partial: Column) -> Column:
    """correct from 0.75, wrong up to 0.25, else partial; where that isn't allowed correct from 0.5, else wrong; null for null."""
    several = F.when(score >= 0.75, "correct").when(score <= 0.25, "wrong").otherwise("partial")
    return F.when(score.isNull(), F.lit(None).cast("string")).when(partial, several).otherwise(F.when(score >= 0.5, "correct").otherwise("wrong"))


def judge_vote(text: Column, partial: Column) -> Column:
    """A judge's vote, 1, 0.5 or 0, from a number or a word; null for anything else.

    Numbers go to the nearest of the three (of 0 and 1 where partial isn't
    allowed). "incorrect" counts as wrong although it contains "correct".
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    number = F.nullif(F.regexp_extract(low, r"(?:score\W{1,4})?(?<![\d.])(\d?\.\d+|[01])(?![\d.])", 1), F.lit("")).try_cast("double")
    word = F.when(low.rlike(r"incorrect|wrong|not correct"), 0.0).when(low.rlike("partial"), F.when(partial, 0.5).otherwise(0.0)).when(low.rlike("correct"), 1.0)
    snapped = F.when(partial, F.round(number * 2) / 2).otherwise(F.round(number))
    return F.coalesce(F.when(snapped.between(0, 1), snapped), word)


def with_judge(rule: Column, floor: Column, judged: Column, binary: Column) -> Column:
    """struct(final, source) of a rule's score and a judge's.

    Binary tasks ask the judge only where no rule decided; the others always
    where a judge answered, but never fall below the rule's floor where it set one.
    """
    asked = judged.isNotNull() & (~binary | rule.isNull())
    low = ~binary & F.coalesce(judged < floor, F.lit(False))
    score = F.when(~asked, F.coalesce(rule, F.lit(0.0))).when(low, floor).when(binary, F.when(judged >= 0.5, 1.0).otherwise(0.0)).otherwise(judged)
    return F.struct(score.alias("final"), F.when(~asked, "rule").when(low, "rule_floor").otherwise("judge").alias("source"))
