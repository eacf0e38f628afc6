"""SQL for the queries that DuckDB can express; the others have brute-force tests."""

from __future__ import annotations

from palimpsest.llm.fold import table_form
from palimpsest.llm.proportion_sample import OTHER_NAMES, TASK_TYPES, _compact

_NAMES = ", ".join(f"('{_compact(x)}', '{t}')" for t, s in TASK_TYPES.items() for x in [t, s, *OTHER_NAMES[t]])
_FULL = ", ".join(f"('{_compact(t)}', '{t}')" for t in TASK_TYPES)

_P1 = f"""
WITH names(k, t) AS (VALUES {_NAMES}), names1 AS (SELECT DISTINCT k, t FROM names), full_names(k, t) AS (VALUES {_FULL}),
tasks AS (
  SELECT row_id, batch_no, coalesce(id, 'row ' || row_id) AS id, unnest(generate_series(1, len(tasks_covered))) AS p, tasks_covered FROM dialogue_records
), written AS (
  SELECT 'dialogue_records' AS pool, arg_min(batch_no, row_id) AS batch_no, id || '#' || p AS member, arg_min_null(tasks_covered[p].task_type, row_id) AS w FROM tasks GROUP BY id, p
  UNION ALL SELECT 'parametric_taskwise_summary', NULL, coalesce(model_name, '') || '#' || coalesce(split_type, ''), task_type FROM parametric_taskwise_summary
), bare AS (
  SELECT *, lower(regexp_replace(w, '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')) AS b FROM written
), keyed AS (
  SELECT *, regexp_replace(b, '^(.{{2,}}?)(task|type|question|category)s?$', '\\1') AS k FROM bare
), typed AS (
  SELECT DISTINCT x.pool, x.batch_no, x.member, coalesce(n1.t, n2.t, (SELECT min(f.t) FROM full_names f WHERE levenshtein(f.k, x.k) <= 2)) AS task_type
  FROM keyed x LEFT JOIN names1 n1 ON n1.k = x.b LEFT JOIN names1 n2 ON n2.k = x.k
), sizes AS (
  SELECT pool, batch_no, task_type, count(*) AS members FROM typed WHERE task_type IS NOT NULL GROUP BY ALL
)
"""
_P1_WANTED = "coalesce(round(greatest(coalesce(p.min_rows, 0), coalesce(p.target_share * p.sample_size, 0)), 9), 0)"
_P1_JOIN = "FROM task_targets p LEFT JOIN sizes s ON s.pool = p.pool AND s.batch_no IS NOT DISTINCT FROM p.batch_no AND s.task_type = p.task_type"
P1_FOUND = f"{_P1} SELECT p.plan_id, p.task_type {_P1_JOIN} WHERE coalesce(s.members, 0) < {_P1_WANTED}"
P1_COUNTS = f"{_P1} SELECT p.plan_id, p.task_type, coalesce(s.members, 0) AS members, {_P1_WANTED} AS wanted, coalesce(s.members, 0) < {_P1_WANTED} AS short, true AS landed {_P1_JOIN}"

_NAME_KEY = "regexp_replace(lower(trim(regexp_replace(regexp_replace({0}, '\\p{{Cf}}+', '', 'g'), '[\\s\\p{{Z}}]+', ' ', 'g'))), '^([^,]+?) ?, ?([^,]+)$', '\\2 \\1')"
_ID_KEY = "regexp_replace(lower(regexp_replace({0}, '^\\s*(\\pL+:)+', '')), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g')"

P4_FOUND = f"""
WITH RECURSIVE links AS (
  SELECT DISTINCT nullif({_NAME_KEY.format("record.metadata.character")}, '') AS c, nullif({_ID_KEY.format("record.metadata.dialogue_id")}, '') AS d FROM parametric_eval_records
), edges AS (
  SELECT DISTINCT x.c AS a, y.c AS b FROM links x JOIN links y ON x.d = y.d WHERE x.c <> y.c
), reach(a, b) AS (
  SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b
), personas AS (SELECT index, {_NAME_KEY.format("profile.name")} AS c FROM seed_bank)
SELECT DISTINCT p.index AS index_a, q.index AS index_b FROM reach r JOIN personas p ON p.c = r.a JOIN personas q ON q.c = r.b WHERE p.index < q.index
"""

P4_COUNTS = "SELECT split_name, target_share, true AS met, CAST(0 AS BIGINT) AS torn FROM split_targets"

P5_FOUND = """
WITH items AS (
  SELECT 'content' AS item_kind, row_id, i - 1 AS turn_idx, dialogue_turns[i].content AS t FROM (SELECT *, unnest(generate_series(1, len(dialogue_turns))) AS i FROM contextual_eval_records)
  UNION ALL SELECT 'prompt', row_id, -1, record.prompt FROM parametric_eval_records
)
SELECT item_kind, row_id, CAST(turn_idx AS INTEGER) AS turn_idx,
  CASE WHEN list_max(list_transform(regexp_split_to_array(t, '[\\s\\p{Z}\\x{85}\\x{1c}-\\x{1f}.!?。！？．｡…‼⁇⁈⁉]'), lambda x: length(x))) > max_chars THEN 'forced' ELSE 'natural' END AS cut
FROM items JOIN size_limits USING (item_kind) WHERE length(t) > max_chars
"""

_P7 = """
WITH counted AS (SELECT source, count(*) AS documents, sum(coalesce(len(regexp_extract_all(text, '\\pL+|\\pN+|[^\\s\\pL\\pN]+')), 0)) AS n FROM documents GROUP BY source),
whole AS (SELECT sum(n) AS n FROM counted), wanted AS (
  SELECT m.plan_id, m.source, coalesce(c.documents, 0) AS documents,
    coalesce(m.target_share, 0) * coalesce(m.budget_ratio, 0) * w.n > coalesce(m.max_repeats, 0) * coalesce(c.n, 0) AS short
  FROM mix_targets m LEFT JOIN counted c ON c.source = m.source, whole w
)
"""
P7_FOUND = f"{_P7} SELECT plan_id, source FROM wanted WHERE short"
P7_COUNTS = f"{_P7} SELECT *, true AS landed FROM wanted"



def _form_sql() -> str:
    """The table form of a text by the table alone, character by character, and one composition."""
    single, dropped, several = {}, [], {}
    for o in range(0x80, 0x30000):
        c = chr(o)
        if 0xD800 <= o < 0xE000 or (form := table_form(c)) == c:
            continue
        if not form:
            dropped.append(c)
        elif len(form) == 1:
            single[c] = form
        else:
            several[c] = form
    dropped += list(map(chr, range(0xE0100, 0xE01F0)))
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    form = f"translate(nfc_normalize(text), {quote(''.join(single) + ''.join(dropped))}, {quote(''.join(single.values()))})"
    for c, to in several.items():
        if 0xFB00 <= ord(c) <= 0xFB06:  # the ligatures
            form = f"replace({form}, '{c}', '{to}')"
    return f"nfc_normalize({form})"


def p8_found() -> str:
    forms = f"SELECT doc_id, text, {_form_sql()} AS form FROM documents WHERE text IS NOT NULL"
    return f"WITH forms AS MATERIALIZED ({forms}) SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM forms a JOIN forms b ON a.form = b.form AND a.doc_id < b.doc_id AND a.text <> b.text"


ORACLES = {"p1_found": P1_FOUND, "p1_counts": P1_COUNTS, "p4_found": P4_FOUND, "p4_counts": P4_COUNTS, "p5_found": P5_FOUND, "p7_found": P7_FOUND, "p7_counts": P7_COUNTS}
