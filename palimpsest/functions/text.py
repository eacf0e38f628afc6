"""Text functions: Column in, Column out, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no focus, words that only scaffold an answer, and those that only scaffold a slot.
STOP_WORDS = tuple("a an and are as at be by did do does for from had has have he her his how in into is it its of on or she that the their them there they this to was were what when where which who why with".split())
SCAFFOLD_WORDS = tuple("action answer author authors behavior business city completed correction current date decision destination difference dog gift include includes initiated item items learned location method name nature new object project quality relationship report requirement result rule shift specific status tradition types".split())
SLOT_WORDS = tuple("art form trip travel planned plan going with item items object objects type types state status latest current".split())
# Openings of components that are inferred, not told.
INFERENCE_OPENINGS = {"Temporal Reasoning": ("calculation",), "Memory Arbitration": ("correction", "fundamental difference")}
# Marks of a template that was left in a text, and of a text that says that something isn't said; in normalized texts.
TEMPLATE_MARKS = ("for the query", "from the dialogue", "event chain", "event_chain", "final outcome", "final_outcome", "key turning point", "key_turning_points", "summary for the query", "answer for the query")
UNSPECIFIED_MARKS = ("does not specify", "did not specify", "not specified", "not mention", "does not mention", "did not mention", "not provided", "not given", "unknown", "unclear")
# What a normalized question asks for, the first that fits.
QUESTION_KINDS = (
    ("name", r"(^| )name( |$)|^who "),
    ("title", r"job title|current title"),
    ("job", r"primary job|current job|(^| )job( |$)"),
    ("status", r"current status|status of"),
    ("location", r"(^| )where( |$)|which city|what city|specific space|what space|what location"),
    ("method", r"what method|how did.*learn|learn.*how did"),
    ("rule", r"what rule"),
    ("object", r"what object|what instrument|what item|what specific types of items|what project"),
)
#: Normalized questions that ask for two things.
TWO_SLOTS = r"(^| )((what|which) two|two (specific|names))( |$)|(^| )and (who|what|which)( |$)|for whom|(what|who) are the names of|\bwhat .+?, and .+\b"
# Where the value asked for stands in a normalized text.
VALUE_PATTERNS = {
    "name": (r"\bname (?:is|was|remains)? ?(.+?)$", r"\bnamed +(.+?)$", r"\bcalled +(.+?)$"),
    "title": (r"\b(?:job title|title) +(?:is|was|remains) +(?:as +)?(.+?)$", r"\b(?:is|was|became|remains|currently is|is currently|is now) +(?:a +|an +)?(.+?)$"),
    "job": (r"\b(?:primary|current)? *job +(?:is|was|remains) +(?:as +)?(.+?)$", r"\b(?:works|worked|serves|served) +as +(.+?)$", r"\b(?:is|was|became|remains|currently is|is currently|is now) +(?:a +|an +)?(.+?)$"),
    "status": (r"\bstatus +(?:is|was|remains) +(.+?)$", r"\b(?:is|was|became|remains|currently is|is currently|is now) +(.+?)$"),
    "location": (r"\blocation (?:is|was) (.+)$", r"\bdestination (?:is|was) (.+)$", r"\b(?:traveled|travelled|went|moved) to (.+)$", r"\bset up .* in (.+)$", r"\bconvert(?:ed)? .* (?:into|in) (.+)$", r"\b(?:located|based|situated) +(?:at|in) +(.+?)$", r"\blives? +in +(.+?)$", r"\bis in +(.+?)$"),
    "method": (r"\bused (.+)$", r"\bfollowing (.+)$", r"\blearned to (.+)$"),
    "rule": (r"\brule (?:is|was) (.+)$",),
    "object": (r"\bit (?:is|was) (.+)$", r"\bproduced (.+)$", r"\borganized (.+)$", r"\bcompleted (.+)$"),
}
#: Words before a colon at most, for what follows it to be the value.
WORDS_BEFORE_COLON = 8


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends; null stays null."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def or_missing(*values: Column) -> Column:
    """The first value that is neither null nor empty, else null."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values])


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_text(text: Column) -> Column:
    """Lower case; only ASCII letters, digits, hyphens, colons and single spaces stay. Null gives ''."""
    return F.coalesce(squeeze(F.regexp_replace(F.lower(text), r"[^a-z0-9\s\-:]", " ")), F.lit(""))


def words(text: Column) -> Column:
    """The words of a normalized text; an empty array for null and empty."""
    return F.filter(F.split(normalize_text(text), " "), lambda w: w != "")


def _stem(w: Column) -> Column:
    return (
        F.when((F.length(w) > 4) & w.endswith("ies"), F.concat(F.substring(w, F.lit(1), F.length(w) - 3), F.lit("y")))
        .when((F.length(w) > 4) & w.endswith("es"), F.substring(w, F.lit(1), F.length(w) - 2))
        .when((F.length(w) > 4) & w.endswith("s"), F.substring(w, F.lit(1), F.length(w) - 1))
        .otherwise(w)
    )


def focus_tokens(text: Column) -> Column:
    """The distinct words that carry a text's focus, in their first order.

    Plural endings (ies, es, s) of words of more than four characters go; then
    words of one character, words of digits only, stop words and scaffold words
    are left out.
    """
    drop = F.array(*[F.lit(w) for w in STOP_WORDS + SCAFFOLD_WORDS])
    return F.array_distinct(F.filter(F.transform(words(text), _stem), lambda w: (F.length(w) > 1) & ~w.rlike(r"^\d+$") & ~F.array_contains(drop, w)))


def grams(w: Column, n: int) -> Column:
    """Runs of n elements joined by spaces; whole arrays are zipped, so that w is evaluated once."""
    grams = w
    for k in range(1, n):
        size = F.greatest(F.size(w) - k, F.lit(0))
        grams = F.zip_with(F.slice(grams, F.lit(1), size), F.slice(w, F.lit(k + 1), size), lambda a, b: F.concat_ws(" ", a, b))
    return grams


def key_phrases(text: Column) -> Column:
    """Words of more than three letters, then phrases of four, three and two such words longer than eight characters."""
    w = F.filter(words(text), lambda x: F.length(x) > 3)
    longer = [F.filter(grams(w, n), lambda g: F.length(g) > 8) for n in (4, 3, 2)]
    return F.array_distinct(F.concat(w, *longer))


def ngrams(text: Column, n: int) -> Column:
    """All runs of n words, in order; empty for shorter texts."""
    return grams(words(text), n)


def numeric_token(text: Column) -> Column:
    """A number's plain form: no currency sign, thousands commas, leading or trailing zeros."""
    plain = F.regexp_replace(text, r"[$€£,\s]", "")
    whole = F.regexp_replace(plain, r"^0+(?=\d)", "")
    return F.regexp_replace(F.regexp_replace(whole, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def numbers_without_dates(text: Column) -> Column:
    """Distinct numbers of a text, as sorted strings, dates and label ordinals left out."""
    no_dates = F.regexp_replace(text, r"\d{4}-\d{2}(-\d{2})?", " ")
    no_labels = F.regexp_replace(no_dates, r"(?i)\b(?:step|chunk|stage|part|item|no\.?|#)\s*\d+", " ")
    merged = F.regexp_replace(no_labels, r"(?<=\d),(?=\d{3})", "")
    found = F.regexp_extract_all(merged, F.lit(r"(?<![\w.])(\d+(?:\.\d+)?)(?!\w)"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, numeric_token)))


def entities(text: Column, most: int | None = 5) -> Column:
    """Up to ``most`` distinct runs, or all for None, of one to three capitalised words, in order."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]+(?: [A-Z][a-z]+){0,2})"), 1)
    distinct = F.array_distinct(found)
    return distinct if most is None else F.slice(distinct, 1, most)


def years(text: Column) -> Column:
    """Distinct years 1900 to 2199 as sorted integers."""
    found = F.regexp_extract_all(text, F.lit(r"\b((?:19|20|21)\d{2})\b"), 1)
    return F.array_sort(F.array_distinct(F.transform(found, lambda y: y.cast("int"))))


def is_period_only(text: Column) -> Column:
    """Whether a text names a period and nothing else, such as "2019 to 2021" or "from 2020-01"."""
    rest = F.regexp_replace(F.lower(text), r"\d{4}(-\d{2}(-\d{2})?)?|\b(?:from|to|until|between|and|since|in|during|the|early|mid|late|year|years)\b|[^a-z0-9]", "")
    return (F.length(rest) == 0) & text.rlike(r"\d{4}")


def clean_spoken(text: Column) -> Column:
    """A spoken text without stage directions in brackets and stars, white space squeezed."""
    return squeeze(F.regexp_replace(F.regexp_replace(text, r"\([^()]*\)|\[[^\[\]]*\]|（[^（）]*）|【[^【】]*】", " "), r"\*[^*]+\*", " "))


def excerpt(text: Column, limit: int) -> Column:
    """Squeezed and cut to ``limit`` characters."""
    return F.substring(squeeze(text), 1, limit)


def preview(text: Column, limit: int = 120) -> Column:
    """Cut to ``limit`` characters, the last three of them dots where something is cut off."""
    flat = squeeze(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.substring(flat, 1, limit - 3), F.lit("...")))


def safe_name(text: Column) -> Column:
    """A file name: every run of other characters than letters, digits, dots, hyphens and underscores as one underscore."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_")


def label(*parts: Column) -> Column:
    """Parts joined by underscores, each made a safe name, null and empty ones left out."""
    return F.concat_ws("_", *[F.nullif(F.regexp_replace(safe_name(p), r"^_+|_+$", ""), F.lit("")) for p in parts])


def clean_schema(text: Column, most: int = 7) -> Column:
    """A one-line label: the first line without fence, leading "schema:" and quotes, at most ``most`` words."""
    first = F.regexp_extract(F.regexp_replace(text, r"^\s*```\w*\s*|```\s*$", ""), r"^\s*([^\n]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(first, r"(?i)^\s*(?:schema|label)\s*[:：]\s*", ""), r"^[\"'`\s]+|[\"'`\s.]+$", "")
    return F.array_join(F.slice(F.split(squeeze(bare), " "), 1, most), " ")


def tokens_by_four(text: Column) -> Column:
    """Estimated tokens: characters of the stripped text over four, rounded up, at least 1; null counts as empty."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.coalesce(strip(text), F.lit(""))) / 4)).cast("int")


def tokens_floor(text: Column) -> Column:
    """Estimated tokens: characters over four, rounded down; 0 for null."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int")


def tokens_by_ratio(text: Column, ratio: float) -> Column:
    """Estimated tokens: characters over ``ratio``, rounded half to even, at least 1; 0 for null and empty."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(n / ratio))).cast("int")


def truthy(text: Column) -> Column:
    """Whether a text says yes: 1, true, yes, y, ok or pass, in any case; false for everything else and null."""
    return F.coalesce(F.lower(strip(text)).isin("1", "true", "yes", "y", "ok", "pass"), F.lit(False))


def has_any(text: Column, marks: Sequence[str]) -> Column:
    """Whether a lowered text contains one of the marks; false for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for m in marks:
        found = found | F.contains(low, F.lit(m))
    return found


def told(task_type: Column, component: Column) -> Column:
    """Whether a component is told rather than inferred, so that evidence can be asked for."""
    low = F.lower(strip(F.coalesce(component, F.lit(""))))
    inferred = F.lit(False)
    for kind, starts in INFERENCE_OPENINGS.items():
        for s in starts:
            inferred = inferred | ((task_type == kind) & low.startswith(s))
    return ~F.coalesce(inferred, F.lit(False))


def leaked_keyword(text: Column, keywords: Column) -> Column:
    """The first keyword of four characters or more that a text contains, else null."""
    low = F.lower(text)
    return F.try_element_at(F.filter(F.transform(keywords, F.lower), lambda k: (F.length(k) >= 4) & F.contains(low, k)), F.lit(1))


def question_kind(query: Column) -> Column:
    """What a question asks for, as QUESTION_KINDS has it; null where none fits."""
    q = normalize_text(query)
    return F.coalesce(*[F.when(q.rlike(pattern), kind) for kind, pattern in QUESTION_KINDS])


def slot_count(query: Column) -> Column:
    """2 where a question asks for two things, as TWO_SLOTS has it, else 1."""
    return F.when(normalize_text(query).rlike(TWO_SLOTS), 2).otherwise(1)


def distinct_ignoring_case(values: Column) -> Column:
    """The values without later ones that differ only in case; null and blank ones left out."""
    kept = F.filter(values, lambda v: v.isNotNull() & (F.length(strip(v)) > 0))
    return F.aggregate(kept, F.array().cast("array<string>"), lambda acc, v: F.when(F.exists(acc, lambda a: F.lower(a) == F.lower(v)), acc).otherwise(F.array_append(acc, v)))


def stem(word: Column) -> Column:
    """A word without ing, ed or plural s, where four letters or more stay."""
    return F.regexp_replace(F.regexp_replace(word, r"^(.{4,})(?:ing|ed)$", "$1"), r"^(.{4,})s$", "$1")


def soft_recall(component: Column, text: Column) -> Column:
    """Share of a component's words that a text has, words counting as one when their stems do or one begins the other with four letters."""
    own = F.transform(focus_tokens(component), stem)
    said = F.transform(focus_tokens(text), stem)
    same = lambda a, b: (a == b) | ((F.length(a) >= 4) & b.startswith(a)) | ((F.length(b) >= 4) & a.startswith(b))
    hits = F.filter(own, lambda a: F.exists(said, lambda b: same(a, b)))
    return F.when(F.size(own) > 0, F.size(hits) / F.size(own)).otherwise(0.0)


def value_candidates(text: Column, kind: Column) -> Column:
    """What a text offers as the value asked for, in order and once each.

    Without a kind the whole normalized text; what follows a colon behind few
    words; what the patterns of the kind find. An empty array for null and empty.
    """
    raw = normalize_text(text)
    left, right = F.substring_index(raw, ":", 1), F.trim(F.regexp_replace(raw, r"^[^:]*:", ""))
    after = F.when(F.contains(raw, F.lit(":")) & (F.size(F.filter(F.split(left, " "), lambda w: w != "")) <= WORDS_BEFORE_COLON), right)
    found = F.lit(None).cast("array<string>")
    for k, patterns in VALUE_PATTERNS.items():
        found = F.when(kind == k, F.array(*[F.trim(F.regexp_extract(raw, p, 1)) for p in patterns])).otherwise(found)
    every = F.concat(F.array(F.when(kind.isNull(), raw), after), F.coalesce(found, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda v: v.isNotNull() & (v != "")))


def template_left(text: Column) -> Column:
    """Whether marks of a template were left in a text."""
    return has_any(normalize_text(text), TEMPLATE_MARKS)


def unspecified(text: Column) -> Column:
    """Whether a text says that something isn't said."""
    return has_any(normalize_text(text), UNSPECIFIED_MARKS)


# How each letter of a personality type speaks.
STYLE = {"E": "talks freely", "I": "chooses words with care", "S": "names plain facts", "N": "likes images", "T": "argues", "F": "speaks of feelings", "J": "keeps to the point", "P": "wanders"}


def speech_style(mbti: Column, age: Column) -> Column:
    """How a persona speaks, from the letters of its type and its age: the known letters' habits, then one for the young and the old."""
    pairs = F.create_map(*[F.lit(x) for p in STYLE.items() for x in p])
    letters = F.filter(F.transform(F.split(F.upper(F.coalesce(mbti, F.lit(""))), ""), lambda c: F.try_element_at(pairs, c)), lambda x: x.isNotNull())
    years_ = F.nullif(F.regexp_extract(F.coalesce(age, F.lit("")), r"(\d{1,3})", 1), F.lit("")).try_cast("int")
    habit = F.when(years_ < 25, F.array(F.lit("uses slang"))).when(years_ >= 60, F.array(F.lit("recalls old days"))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(letters, habit), ", ")
