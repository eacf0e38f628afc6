"""JSON as models write it: strict checks, recovery from fences, rests and breaks.

Spark's own parsers accept a value with text behind it, so what has to be strict
or has to recover runs in Python, in Arrow batches. Plain fields of sound JSON
are read with ``get_json_object``.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"^\s*```[A-Za-z]*\s*\n?(.*?)\n?\s*```\s*$", re.S)
_INNER_FENCE = re.compile(r"```[A-Za-z]*\s*(.*?)```", re.S)
_DECODER = json.JSONDecoder()

PARSED = T.StructType([T.StructField("value", T.StringType()), T.StructField("reason", T.StringType())])
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
RECOVERED = T.StructType([T.StructField("turns", TURNS), T.StructField("how", T.StringType())])
CHECKED = T.StructType([T.StructField("parse_ok", T.BooleanType()), T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])

# The fields that an answer of each task type must have, and what stands for those that may be left out.
REQUIRED = {
    "Information Extraction": ["answer", "evidence_snippets"],
    "Temporal Reasoning": ["final_answer", "days", "start_date", "end_date"],
    "Knowledge Updating": ["latest_state", "as_of_time", "deprecated_state"],
    "Multi-session Reasoning": ["event_chain", "final_outcome"],
    "Event Summarization": ["time_span", "key_turning_points", "summary"],
    "Memory Arbitration": ["premise_verdict", "premise_error", "corrected_facts", "final_answer"],
}
SOFT_FIELDS = {"Information Extraction": {"evidence_snippets": []}, "Knowledge Updating": {"as_of_time": "", "deprecated_state": ""}}


def strip_fence(text: str) -> str:
    """A text without the code fence around it."""
    m = _FENCE.match(text)
    return m.group(1) if m else text


def strict(text: str | None) -> tuple[object, str | None]:
    """(value, error) of a text that is JSON from its start to its end, a fence around it allowed."""
    if text is None or not text.strip():
        return None, "empty"
    try:
        return json.loads(strip_fence(text).strip()), None
    except (ValueError, RecursionError):
        return None, "not json"


def first_value(text: str | None, opens: str = "{") -> object | None:
    """The first JSON object (or array) that can be decoded anywhere in a text."""
    if not text:
        return None
    for m in re.finditer("[" + re.escape(opens) + "]", text):
        try:
            return _DECODER.raw_decode(text, m.start())[0]
        except (ValueError, RecursionError):
            continue
    return None


def _balanced(text: str) -> str | None:
    """The first stretch of balanced braces."""
    start = text.find("{")
    if start < 0:
        return None
    depth, quoted, skip = 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if skip:
            skip = False
        elif c == "\\" and quoted:
            skip = True
        elif c == '"':
            quoted = not quoted
        elif not quoted and c == "{":
            depth += 1
        elif not quoted and c == "}":
            depth -= 1
            if not depth:
                return text[start : i + 1]
    return None


def recover_object(text: str | None) -> tuple[object | None, str]:
    """(value, how) of a model's object: whole, fenced, balanced braces, or those without trailing commas; else the reason."""
    if text is None or not text.strip():
        return None, "empty"
    value, error = strict(text)
    if error is None:
        return (value, "whole") if isinstance(value, dict) else (None, "no object")
    for m in _INNER_FENCE.finditer(text):
        try:
            if isinstance(v := json.loads(m.group(1)), dict):
                return v, "fenced"
        except (ValueError, RecursionError):
            pass
    inner = _balanced(text)
    if inner is None:
        return None, "no braces" if "{" not in text else "unbalanced"
    for candidate, how in ((inner, "braces"), (re.sub(r",\s*([}\]])", r"\1", inner), "commas")):
        try:
            if isinstance(v := json.loads(candidate), dict):
                return v, how
        except (ValueError, RecursionError):
            pass
    return None, "not json"


def _as_turns(value: object) -> list[dict]:
    """Turns of a decoded value: objects with a role (or speaker) and a content (or message, text)."""
    if isinstance(value, dict):
        value = next((value[k] for k in ("turns", "dialogue", "patch_turns", "messages") if isinstance(value.get(k), list)), [value])
    out = []
    for x in value if isinstance(value, list) else []:
        if isinstance(x, dict):
            content = x.get("content") or x.get("message") or x.get("text")
            if isinstance(content, str) and content.strip():
                role = str(x.get("role") or x.get("speaker") or "speaker").strip().lower()
                role = {"human": "user", "ai": "assistant", "bot": "assistant", "model": "assistant"}.get(role, role)
                out.append({"role": role, "content": content.strip()})
    return out


_PAIR = re.compile(r'"(?:role|speaker)"\s*:\s*"((?:[^"\\]|\\.)*)"\s*,\s*"(?:content|message|text)"\s*:\s*"((?:[^"\\]|\\.)*)"')


def recover_turns(text: str | None) -> tuple[list[dict], str]:
    """(turns, how) of a model's array of turns: direct, array in the text, cut off, Python literal, single pairs; else none."""
    if not text or not text.strip():
        return [], "empty"
    bare = strip_fence(text).strip()
    try:
        if turns := _as_turns(json.loads(bare)):
            return turns, "direct"
    except (ValueError, RecursionError):
        pass
    if turns := _as_turns(first_value(bare, "[")):
        return turns, "array"
    start = bare.find("[")
    if start >= 0:
        end = bare.rfind("}")
        if end > start:
            try:
                if turns := _as_turns(json.loads(bare[start : end + 1] + "]")):
                    return turns, "cut off"
            except (ValueError, RecursionError):
                pass
        try:
            if len(bare) < 100_000 and (turns := _as_turns(ast.literal_eval(bare[start:]))):
                return turns, "literal"
        except (ValueError, SyntaxError, RecursionError, MemoryError):
            pass
    pairs = [{"role": a, "content": b.strip()} for a, b in _PAIR.findall(bare) if b.strip()]
    return (pairs, "pairs") if pairs else ([], "none")


def check_fields(text: str | None, task_type: str | None) -> tuple[bool, list[str], str | None]:
    """(parse_ok, missing fields, error) of an answer that must be an object with the fields of its task type, whatever they hold."""
    value, error = strict(text)
    required = REQUIRED.get(task_type or "", [])
    if error or not isinstance(value, dict):
        return False, list(required), error or "no object"
    missing = [f for f in required if f not in value]
    return not missing, missing, "missing fields" if missing else None


def checked(text: str | None, task_type: str | None) -> tuple[dict, bool]:
    """(object, whether its fields are all there) of an answer, those that may be left out filled in."""
    ok, missing, _ = check_fields(text, task_type)
    soft = SOFT_FIELDS.get(task_type or "", {})
    value, error = strict(text)
    if error or not isinstance(value, dict):
        return {}, False
    return {f: soft[f] for f in missing if f in soft} | value, ok or all(f in soft for f in missing)


def _udf(kind: T.DataType, one: Callable) -> Callable:
    @F.pandas_udf(kind)
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in text])

    return run


@F.pandas_udf(PARSED)
def strict_json(text: pd.Series) -> pd.DataFrame:
    """struct(value, reason): the value written anew, or why the text isn't JSON throughout."""
    rows = [strict(t) for t in text]
    return pd.DataFrame({"value": [None if e else json.dumps(v, ensure_ascii=False, sort_keys=True) for v, e in rows], "reason": [e for _, e in rows]})


@F.pandas_udf(PARSED)
def object_json(text: pd.Series) -> pd.DataFrame:
    """struct(value, reason): a model's object and how it was found, or why there is none."""
    rows = [recover_object(t) for t in text]
    return pd.DataFrame({"value": [None if v is None else json.dumps(v, ensure_ascii=False, sort_keys=True) for v, _ in rows], "reason": [r for _, r in rows]})


@F.pandas_udf(RECOVERED)
def turns_json(text: pd.Series) -> pd.DataFrame:
    """struct(turns, how) of a model's array of turns."""
    rows = [recover_turns(t) for t in text]
    return pd.DataFrame({"turns": [t for t, _ in rows], "how": [h for _, h in rows]})


@F.pandas_udf(CHECKED)
def fields_check(text: pd.Series, task_type: pd.Series) -> pd.DataFrame:
    """struct(parse_ok, missing, error) of an answer by its task type."""
    rows = [check_fields(t, k) for t, k in zip(text, task_type, strict=True)]
    return pd.DataFrame({"parse_ok": [r[0] for r in rows], "missing": [r[1] for r in rows], "error": [r[2] for r in rows]})


@F.pandas_udf(T.StringType())
def first_object(text: pd.Series) -> pd.Series:
    """The first decodable object of a text, written anew; null where there is none."""
    found = [first_value(t) for t in text]
    return pd.Series([None if v is None else json.dumps(v, ensure_ascii=False, sort_keys=True) for v in found])


def number_field(text: Column, path: str) -> Column:
    """A number of a JSON text, from under "aggregate" where that is there; null for none."""
    inner = F.get_json_object(text, "$.aggregate." + path)
    return F.coalesce(inner, F.get_json_object(text, "$." + path)).try_cast("double")


def content_key(*fields: Column) -> Column:
    """The SHA-1 of fields in their order, nulls kept apart from empty texts: a key for stored results."""
    return F.sha1(F.to_json(F.struct(*[f.alias(f"f{i}") for i, f in enumerate(fields)]), {"ignoreNullFields": "false"}))


def yes_or_no(text: Column) -> Column:
    """true for a text that begins with YES, false for NO, in any case; null for anything else."""
    word = F.upper(F.regexp_extract(F.coalesce(text, F.lit("")), r"^\W*(\p{L}+)", 1))
    return F.when(word == "YES", True).when(word == "NO", False)


def soft_fields(task_type: Column, missing: Column) -> Column:
    """struct(hard, soft): the missing fields that make an answer void, and those that a default stands for."""
    pairs = [x for t, fields in SOFT_FIELDS.items() for x in (F.lit(t), F.array(*[F.lit(f) for f in fields]))]
    may = F.coalesce(F.try_element_at(F.create_map(*pairs), task_type), F.array().cast("array<string>"))
    return F.struct(F.array_except(missing, may).alias("hard"), F.array_intersect(missing, may).alias("soft"))


def fact_texts(text: Column) -> Column:
    """The facts of a model's JSON, an array of texts or of objects with a field "fact", blank ones left out."""
    whole = F.coalesce(F.get_json_object(text, "$.facts"), text)
    texts = F.from_json(whole, "array<string>")
    return F.filter(F.transform(texts, lambda x: F.coalesce(F.get_json_object(x, "$.fact"), x)), lambda x: x.isNotNull() & (F.length(F.trim(x)) > 0))
