"""Queries of the sequence operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import dates, text
from palimpsest.operators import dialogue as D
from palimpsest.operators import rank
from palimpsest.operators import sequence as S
from palimpsest.plans.registry import query, table
from palimpsest.plans.sqltext import NORMAL, TASKS, TURNS

MOST, OVERLAP_TOKENS, OVERLAP_TURNS = 200, 50, 1


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    return D.turn_rows(table(spark, folder, "dialogue_records"), "row_id")


@query("""
WITH s AS (SELECT *, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day FROM events),
g AS (SELECT *, lead(day) OVER w - day AS gap, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY user_id, event_type ORDER BY day, event_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY coalesce(gap, -1) DESC, rn) AS best FROM g)
SELECT user_id, event_type, event_id, day, coalesce(gap, 0) AS gap FROM r WHERE best = 1
""", ints="day gap")
def longest_gap(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").withColumn("day", F.unix_date(F.to_date("ts")))
    return S.longest_gap(events, ["user_id", "event_type"], "day", "event_id").select("user_id", "event_type", "event_id", "day", "gap")


@query(f"WITH {TURNS} SELECT row_id, pos, role, content, tokens FROM turns", ints="pos")
def dialogue_turns(spark: SparkSession, folder: str) -> DataFrame:
    return _turns(spark, folder).select("row_id", "pos", "role", "content", "tokens")


@query(f"WITH {TURNS} SELECT d.row_id, coalesce(string_agg(line, chr(10) ORDER BY pos), '') AS rendered FROM dialogue_records d LEFT JOIN turns USING (row_id) GROUP BY d.row_id")
def dialogue_render(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "dialogue_records").select("row_id", D.render(F.col("dialogue")).alias("rendered"))


@query(f"""
WITH RECURSIVE {TURNS},
cums AS (SELECT row_id, pos, tokens, sum(tokens) OVER (PARTITION BY row_id ORDER BY pos) AS c, count(*) OVER (PARTITION BY row_id) AS n FROM turns),
ends AS (
  SELECT a.row_id, a.pos AS s, max(b.pos) AS e, arg_max(b.c, b.pos) - (a.c - a.tokens) AS used, a.n
  FROM cums a JOIN cums b ON a.row_id = b.row_id AND b.pos >= a.pos AND (b.pos = a.pos OR b.c - (a.c - a.tokens) <= {MOST}) GROUP BY a.row_id, a.pos, a.c, a.tokens, a.n
),
walk(row_id, chunk, s) AS (
  SELECT row_id, 0, 0 FROM ends WHERE s = 0
  UNION ALL SELECT w.row_id, w.chunk + 1, greatest(w.s + 1, e.e + 1 - {OVERLAP_TURNS}) FROM walk w JOIN ends e ON e.row_id = w.row_id AND e.s = w.s WHERE e.e + 1 < e.n
)
SELECT w.row_id, w.chunk, e.s AS start, e.e AS "end", CAST(e.used AS INTEGER) AS tokens FROM walk w JOIN ends e ON e.row_id = w.row_id AND e.s = w.s
""", ints="start end")
def greedy_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return D.greedy_chunks(table(spark, folder, "dialogue_records"), "row_id", MOST, OVERLAP_TURNS)


@query(f"""
WITH {TURNS},
cums AS (SELECT row_id, pos, tokens, sum(tokens) OVER (PARTITION BY row_id ORDER BY pos) AS e, sum(tokens) OVER (PARTITION BY row_id) AS total FROM turns),
windows AS (SELECT DISTINCT row_id, unnest(generate_series(0, CAST(greatest(0, ceil((total - {MOST}) / {MOST - OVERLAP_TOKENS})) AS BIGINT))) AS k FROM cums),
spans AS (
  SELECT w.row_id, k, min(pos) AS s, max(pos) AS e, sum(tokens) AS n FROM windows w JOIN cums c ON c.row_id = w.row_id AND c.e > k * {MOST - OVERLAP_TOKENS} AND c.e - c.tokens < k * {MOST - OVERLAP_TOKENS} + {MOST} GROUP BY ALL
),
once AS (SELECT row_id, s, e, min(k) AS k, any_value(n) AS n FROM spans GROUP BY row_id, s, e)
SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY k) - 1 AS chunk, s AS start, e AS "end", CAST(n AS INTEGER) AS tokens FROM once
""", ints="chunk start end")
def sliding_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return D.sliding_chunks(_turns(spark, folder), "row_id", MOST, OVERLAP_TOKENS)


@query("""
SELECT row_id, ntile(10) OVER (ORDER BY md5('7:' || row_id), row_id) AS stage FROM dialogue_records
""", ints="stage")
def stage_assignment(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "dialogue_records").select("row_id")
    return rank.near_equal_parts(rows, 10, rank.hash_order(7, F.col("row_id")), F.col("row_id"), name="stage")


@query("SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 16 AS bucket FROM documents")
def shard_bucket(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", rank.shard(F.col("doc_id").cast("string"), 16).alias("bucket"))


@query("""
WITH r AS (SELECT row_id, character, count(*) OVER (PARTITION BY character) AS n, row_number() OVER (PARTITION BY character ORDER BY md5('3:' || row_id), row_id) AS rn FROM dialogue_records)
SELECT row_id, CASE WHEN rn <= CASE WHEN n <= 1 THEN n ELSE least(n - 1, greatest(1, CAST(round_even(n * 0.75, 0) AS BIGINT))) END THEN 'train' ELSE 'test' END AS part FROM r
""")
def entity_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "dialogue_records").select("row_id", "character")
    return S.entity_split(rows, ["character"], 0.75, 3, "row_id").select("row_id", "part")


@query("""
SELECT doc_id, CAST(floor((row_number() OVER (PARTITION BY source, lang ORDER BY length(text), doc_id) - 1) / 8) AS INTEGER) AS batch FROM documents
""")
def sorted_batches(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("n", F.length("text"))
    return S.batches(docs, ["source", "lang"], 8, "n", "doc_id").select("doc_id", "batch")


@query(f"""
WITH {TURNS},
ws AS (SELECT row_id, pos, list_filter(regexp_split_to_array(lower(content), '\\s+'), lambda x: x <> '') AS w FROM turns),
pairs AS (SELECT row_id, pos, unnest(generate_series(1, len(w))) AS i, w FROM ws WHERE len(w) >= 4),
marked AS (SELECT row_id, pos, i, w[i] AS x, i - row_number() OVER (PARTITION BY row_id, pos, w[i] ORDER BY i) AS g FROM pairs),
runs AS (SELECT row_id, pos, max(n) AS n FROM (SELECT row_id, pos, x, g, count(*) AS n FROM marked GROUP BY ALL) GROUP BY row_id, pos)
SELECT t.row_id, t.pos, coalesce(r.n >= 2, FALSE) AS degenerate FROM turns t LEFT JOIN runs r USING (row_id, pos)
""", ints="pos")
def repeated_words(spark: SparkSession, folder: str) -> DataFrame:
    return _turns(spark, folder).select("row_id", "pos", D.degenerate(F.col("content"), 2, 4).alias("degenerate"))


KEYWORDS = ["lantern", "market", "clock"]


@query(f"""
WITH {TURNS}, w AS (SELECT row_id, pos, lower(string_agg(content, ' ') OVER (PARTITION BY row_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 2 FOLLOWING)) AS near FROM turns)
SELECT row_id, pos, {" + ".join(f"CAST(contains(near, '{k}') AS INTEGER)" for k in KEYWORDS)} AS hits FROM w
""", ints="pos")
def keyword_window(spark: SparkSession, folder: str) -> DataFrame:
    return D.keyword_windows(_turns(spark, folder), "row_id", KEYWORDS, 3)


@query(f"""
WITH {TURNS}, b AS (SELECT row_id, max(pos) AS m FROM turns GROUP BY row_id),
near AS (SELECT DISTINCT t.row_id, t.pos + o.o AS p FROM turns t, (VALUES (-1), (0), (1)) o(o) WHERE contains(lower(t.content), 'lantern'))
SELECT n.row_id, array_to_string(list_slice(list_sort(list(CAST(p AS INTEGER))), 1, 4), ',') AS positions FROM near n JOIN b USING (row_id) WHERE p >= 0 AND p <= m GROUP BY n.row_id
""")
def evidence_turns(spark: SparkSession, folder: str) -> DataFrame:
    found = D.neighbours(_turns(spark, folder), "row_id", F.contains(F.lower("content"), F.lit("lantern")), 4)
    return found.withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), ","))


@query("""
WITH g AS (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id) AS nxt FROM events)
SELECT event_id, CAST(CAST(nxt AS DATE) - CAST(ts AS DATE) AS INTEGER) AS days_to_next, CAST(floor((epoch_us(nxt) // 1000000 - epoch_us(ts) // 1000000) / 3600) AS BIGINT) AS hours_to_next FROM g
""")
def lead_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return S.next_gaps(table(spark, folder, "events"), ["user_id"], "ts", "event_id").select("event_id", F.col("days_to_next").cast("int").alias("days_to_next"), F.col("hours_to_next").cast("long").alias("hours_to_next"))


_DAY = "CASE WHEN regexp_matches(timestamp, '\\d{4}[-/.]\\d{1,2}[-/.]\\d{1,2}') THEN try_strptime(regexp_replace(regexp_extract(timestamp, '\\d{4}[-/.]\\d{1,2}[-/.]\\d{1,2}'), '[/.]', '-', 'g'), '%Y-%m-%d') END"


@query(f"WITH d AS (SELECT character_name, coalesce(strftime({_DAY}, '%Y-%m-%d'), '') AS day FROM story_events) SELECT character_name, day, count(*) AS n FROM d WHERE day <> '' GROUP BY ALL HAVING count(*) > 1")
def same_day_events(spark: SparkSession, folder: str) -> DataFrame:
    day = F.nullif(dates.normalize_date(F.col("timestamp")), F.lit(""))
    return S.crowded(table(spark, folder, "story_events").select("character_name", day.alias("day")), ["character_name"], "day")


@query("""
WITH r AS (SELECT character_name, event_id, loaded_at, row_number() OVER (PARTITION BY character_name, event_id ORDER BY loaded_at, description, md5(to_json(caused_by_event_ids))) > 1 AS repeated FROM story_events)
SELECT character_name, event_id, count(*) FILTER (repeated) AS later FROM r GROUP BY ALL HAVING count(*) FILTER (repeated) > 0
""")
def repeated_events(spark: SparkSession, folder: str) -> DataFrame:
    rows = S.repeats(table(spark, folder, "story_events"), ["character_name", "event_id"], "loaded_at", "description")
    return rows.groupBy("character_name", "event_id").agg(F.count_if("repeated").alias("later")).where("later > 0")


@query("""
WITH t AS (SELECT event_id, user_id, event_type, ts FROM events)
SELECT event_id, coalesce(string_agg(event_type, '>') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), '') AS history FROM t WHERE length(trim(event_type)) > 0
""")
def trailing_history(spark: SparkSession, folder: str) -> DataFrame:
    return S.trailing(table(spark, folder, "events"), ["user_id"], "event_type", 5, "ts", "event_id").select("event_id", F.array_join("history", ">").alias("history"))


@query("""
WITH n AS (SELECT *, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS nw FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(nw) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM n)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS event_type, count(*) AS length FROM r GROUP BY user_id, run
""")
def event_runs(spark: SparkSession, folder: str) -> DataFrame:
    return S.runs(table(spark, folder, "events"), ["user_id"], "event_type", "ts", "event_id")


@query(f"""
WITH {TURNS}, n AS (SELECT row_id, count(*) AS n FROM turns GROUP BY row_id),
p AS (SELECT t.row_id, least(greatest(x.spot, 0), n.n) AS spot, 0 AS kind, x.seq, 'user' AS role, 'patch ' || x.seq AS content FROM n, (VALUES (-2, 1), (1, 2), (1, 3), (999, 4)) x(spot, seq), (SELECT DISTINCT row_id FROM turns) t WHERE t.row_id = n.row_id),
u AS (SELECT * FROM p UNION ALL SELECT row_id, pos, 1, 0, role, content FROM turns)
SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY spot, kind, seq) - 1 AS pos, role, content FROM u
""", ints="pos")
def patch_insert(spark: SparkSession, folder: str) -> DataFrame:
    turns = _turns(spark, folder)
    at = F.array(*[F.struct(F.lit(a).alias("insert_at"), F.lit(s).alias("seq")) for a, s in ((-2, 1), (1, 2), (1, 3), (999, 4))])
    patches = turns.select("row_id").distinct().select("row_id", F.inline(at)).select("*", F.lit("user").alias("role"), F.concat(F.lit("patch "), F.col("seq").cast("string")).alias("content"))
    return D.insert_turns(turns.select("row_id", "pos", "role", "content"), patches, "row_id")


_ANCHORS = f"""{TASKS},
pieces AS (SELECT row_id, task_idx, CASE WHEN len(task.answer_components) > 0 THEN task.answer_components ELSE [task.gold_answer] END AS c FROM tasks),
anchors AS (
  SELECT row_id, task_idx, i - 1 AS part, 'fragment' AS kind, c[i] AS text FROM (SELECT *, unnest(generate_series(1, len(c))) AS i FROM pieces)
  UNION ALL SELECT row_id, task_idx, -1, 'setup', task.query FROM tasks
)"""


@query(f"WITH {_ANCHORS} SELECT row_id, CAST(task_idx AS INTEGER) AS task_idx, CAST(part AS INTEGER) AS part, kind, text FROM anchors")
def information_anchors(spark: SparkSession, folder: str) -> DataFrame:
    return D.anchors(table(spark, folder, "dialogue_records"), "row_id")


_PLACED = f"""{_ANCHORS},
ordered AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY md5('5:' || task_idx || ':' || part), task_idx, part) AS spot, count(*) OVER (PARTITION BY row_id) AS n FROM anchors WHERE kind = 'fragment'),
told AS (SELECT row_id, task_idx, part, kind, text, least(20, CAST(floor((0.1::DOUBLE + (0.9::DOUBLE - 0.1::DOUBLE) * (spot - 1) / greatest(n - 1, 1)) * 20) AS INTEGER) + 1) AS segment FROM ordered),
placed AS (
  SELECT * FROM told UNION ALL
  SELECT a.row_id, a.task_idx, a.part, a.kind, a.text, greatest(1, f.first - 1) FROM anchors a JOIN (SELECT row_id, task_idx, min(segment) AS first FROM told GROUP BY ALL) f USING (row_id, task_idx) WHERE a.kind = 'setup'
)"""


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    found = D.anchors(table(spark, folder, "dialogue_records"), "row_id")
    return D.spread_anchors(found, "row_id", 20, rank.hash_order(5, F.col("task_idx"), F.col("part")))


@query(f"WITH {_PLACED} SELECT row_id, CAST(task_idx AS INTEGER) AS task_idx, CAST(part AS INTEGER) AS part, CAST(segment AS INTEGER) AS segment FROM placed")
def anchor_segments(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(spark, folder).select("row_id", "task_idx", "part", "segment")


@query(f"""
WITH {_PLACED}, grid AS (SELECT row_id, unnest(generate_series(1, 20)) AS segment FROM dialogue_records), c AS (SELECT row_id, segment, count(*) AS n FROM placed GROUP BY ALL)
SELECT g.row_id, CAST(g.segment AS INTEGER) AS segment, CASE WHEN g.segment = 1 THEN 'opening' WHEN g.segment = 20 THEN 'closing' WHEN c.n > 0 THEN 'info' ELSE 'filler' END AS kind, coalesce(c.n, 0) AS anchors
FROM grid g LEFT JOIN c ON c.row_id = g.row_id AND c.segment = g.segment
""")
def segment_outlines(spark: SparkSession, folder: str) -> DataFrame:
    return D.outlines(_placed(spark, folder), table(spark, folder, "dialogue_records").select("row_id"), "row_id", 20)


@query(f"""
WITH {_PLACED},
ws AS (SELECT DISTINCT row_id, segment, unnest(list_filter(string_split({NORMAL.format("text")}, ' '), lambda w: length(w) > 3)) AS w FROM placed),
per AS (SELECT row_id, segment, list_sort(list(w)) AS ws FROM ws GROUP BY ALL),
pairs AS (SELECT a.row_id, a.segment, b.segment AS later, unnest(b.ws) AS w, generate_subscripts(b.ws, 1) AS i FROM per a JOIN per b ON a.row_id = b.row_id AND b.segment > a.segment),
firsts AS (SELECT row_id, segment, w, min(later * 1000 + i) AS spot FROM pairs GROUP BY ALL)
SELECT b.row_id, CAST(b.segment AS INTEGER) AS segment, coalesce(array_to_string(list_slice(f.ws, 1, 15), ' '), '') AS forbidden
FROM per b LEFT JOIN (SELECT row_id, segment, list(w ORDER BY spot) AS ws FROM firsts GROUP BY ALL) f ON f.row_id = b.row_id AND f.segment = b.segment
""")
def future_keywords(spark: SparkSession, folder: str) -> DataFrame:
    words = F.filter(text.words(F.col("text")), lambda w: F.length(w) > 3)
    return D.later_keywords(_placed(spark, folder), "row_id", words).select("row_id", "segment", F.array_join("forbidden", " ").alias("forbidden"))


@query(f"""
WITH {TURNS}, c AS (SELECT row_id, pos + 1 AS i, sum(tokens) OVER (PARTITION BY row_id ORDER BY pos) AS s FROM turns),
t AS (SELECT row_id, i, CAST(least(1100, greatest(900, round((30000 - s) / greatest(30 - i, 1)))) AS INTEGER) AS target FROM c)
SELECT d.row_id, coalesce(string_agg(CAST(target AS VARCHAR), ',' ORDER BY i), '') AS targets FROM dialogue_records d LEFT JOIN t USING (row_id) GROUP BY d.row_id
""")
def segment_length_targets(spark: SparkSession, folder: str) -> DataFrame:
    sizes = F.transform(D.spoken(F.col("dialogue")), lambda t: text.tokens_by_four(D.turn_line(t)))
    return table(spark, folder, "dialogue_records").select("row_id", F.array_join(F.transform(D.length_targets(sizes, 30, 30_000), lambda x: x.cast("string")), ",").alias("targets"))
