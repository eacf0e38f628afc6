"""SQL fragments that several oracle queries share."""

STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"
ROLE = "coalesce(nullif({0}.role, ''), nullif({0}.speaker, ''), 'speaker')"
CONTENT = STRIP.format("coalesce(nullif({0}.content, ''), nullif({0}.message, ''), '')")

#: row_id, pos (from 0, spoken turns only), role, content, line, tokens of dialogue_records.
TURNS = f"""
raw_turns AS (SELECT row_id, unnest(generate_series(1, len(dialogue))) AS i, dialogue FROM dialogue_records),
turn_list AS (SELECT row_id, i, dialogue[i] AS t FROM raw_turns WHERE dialogue[i] IS NOT NULL),
said AS (SELECT row_id, i, {ROLE.format("t")} AS role, {CONTENT.format("t")} AS content FROM turn_list),
turns AS (
  SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY i) - 1 AS pos, role, content, role || ': ' || content AS line,
    CAST(greatest(1, ceil(length({STRIP.format("role || ': ' || content")}) / 4)) AS INTEGER) AS tokens
  FROM said WHERE length(content) > 0
)"""

#: row_id, task_idx (from 0), task of dialogue_records.
TASKS = """
raw_tasks AS (SELECT row_id, id, character, batch_no, unnest(generate_series(1, len(tasks_covered))) AS i, tasks_covered FROM dialogue_records),
tasks AS (SELECT row_id, id, character, batch_no, i - 1 AS task_idx, tasks_covered[i] AS task FROM raw_tasks WHERE tasks_covered[i] IS NOT NULL)"""

NORMAL = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9\\s\\-:]', ' ', 'g'), '\\s+', ' ', 'g'))"

_STEM = "CASE WHEN length(w) > 4 AND ends_with(w, 'ies') THEN w[:-4] || 'y' WHEN length(w) > 4 AND ends_with(w, 'es') THEN w[:-3] WHEN length(w) > 4 AND ends_with(w, 's') THEN w[:-2] ELSE w END"


def focus(text: str) -> str:
    """SQL list of a text's focus tokens, distinct, in no order."""
    from palimpsest.functions.text import SCAFFOLD_WORDS, STOP_WORDS

    drop = ", ".join(f"'{w}'" for w in STOP_WORDS + SCAFFOLD_WORDS)
    found = words(text)
    return f"list_distinct(list_filter(list_transform({found}, lambda w: {_STEM}), lambda w: length(w) > 1 AND NOT regexp_full_match(w, '\\d+') AND w NOT IN ({drop})))"


def words(text: str) -> str:
    """SQL list of a normalized text's words."""
    return f"list_filter(string_split({NORMAL.format(text)}, ' '), lambda w: w <> '')"


#: A fact table of scores made of orders: model, checkpoint, stage, task, score.
RESULTS = """
results AS (SELECT o_orderkey, o_orderstatus AS model, CAST(1 + o_orderkey % 10 AS INTEGER) AS checkpoint, CAST(1 + o_custkey % 10 AS INTEGER) AS stage, o_orderpriority AS task, (o_totalprice - floor(o_totalprice / 100) * 100) / 97 AS score FROM orders),
cells AS (SELECT model, task, checkpoint, stage, avg(score) AS score FROM results GROUP BY ALL)"""
