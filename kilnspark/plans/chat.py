"""Queries over conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from kilnspark.operators import assembly, checks
from kilnspark.operators import chat as ch
from kilnspark.sources import corpus as c

def _questions(spark, sf_dir):
    return c.messages(spark, sf_dir).select(F.concat_ws("-", F.col("session").cast("string"), F.col("turn").cast("string")).alias("id"), F.when(F.col("role") == "user", F.col("content")).otherwise(" ").alias("query"), F.col("role").alias("project"), (F.col("turn") * 3).alias("sources"))


def _chunks(spark, sf_dir):
    """The words of each message as chunks of a stream; some are lost, some come twice."""
    rows = c.messages(spark, sf_dir).select((F.col("session") * 1000 + F.col("turn")).alias("stream"), F.posexplode(F.split(F.coalesce("content", F.lit("")), " ", -1)).alias("seq", "word"))
    mix = F.col("stream") * 31 + F.col("seq") * 7
    times = F.when(mix % 97 == 5, 0).when(mix % 13 == 0, 2).otherwise(1)
    return rows.select("stream", "seq", F.concat("word", F.lit(" ")).alias("token"), F.explode(F.expr("sequence(1, 2)")).alias("time"), times.alias("times")).where("time <= times").select("stream", "seq", "token")


def _sessions(spark, sf_dir):
    """A conversation is a session of a user in a project; every fifth is closed."""
    ids = c.messages(spark, sf_dir).select("session").distinct()
    return ids.select("session", (F.col("session") % 7).alias("user_id"), (F.col("session") % 3).alias("project"), (F.col("session") % 5 != 0).alias("is_active"))


def _typed(spark, sf_dir):
    """Messages with a kind of prompt and a model, by their length."""
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.length("content") % len(names)).cast("int") + 1)
    return c.messages(spark, sf_dir).select("*", pick("code_qa", "explain", "debug", None).alias("prompt_type"), pick("small", None, "large").alias("model"))


def _kept(spark, sf_dir):
    """Each user's list of sessions, with ids from before that are gone."""
    return _sessions(spark, sf_dir).select("user_id", F.explode(F.array("session", -F.col("session") - 1)).alias("session"))


QUERIES = {
    "titled_search": lambda s, d: ch.titled_search(c.messages(s, d), _sessions(s, d), "tion", project=1),
    "project_chat_totals": lambda s, d: ch.project_totals(c.messages(s, d), _sessions(s, d)),
    "project_chat_mix": lambda s, d: ch.project_mix(_typed(s, d), _sessions(s, d)),
    "stale_sessions": lambda s, d: ch.stale_sessions(_kept(s, d), _sessions(s, d)),
    "token_streams": lambda s, d: assembly.assembled(_chunks(s, d)),
    "session_analytics": lambda s, d: ch.session_analytics(c.messages(s, d)),
    "role_distribution": lambda s, d: ch.role_distribution(c.messages(s, d)),
    "message_search": lambda s, d: ch.message_search(c.messages(s, d), "tion"),
    "recent_history": lambda s, d: ch.recent_history(c.messages(s, d)),
    "formatted_history": lambda s, d: ch.formatted_history(c.messages(s, d)),
    "formatted_history_short": lambda s, d: ch.formatted_history(c.messages(s, d), budget=600),
    "history_budget": lambda s, d: ch.history_budget(c.messages(s, d)),
    "intent_classification": lambda s, d: ch.intent_classification(c.messages(s, d)),
    "session_titles": lambda s, d: ch.session_titles(c.messages(s, d)),
    "language_hints": lambda s, d: ch.language_hints(c.messages(s, d)),
    "question_checks": lambda s, d: checks.question_checks(_questions(s, d)),
    "session_payloads": lambda s, d: ch.session_payloads(c.messages(s, d)),
    "session_summaries": lambda s, d: ch.session_summaries(c.messages(s, d)),
    "session_export": lambda s, d: ch.session_export(c.messages(s, d)),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _intents() -> str:
    parts = []
    for i, (name, words) in enumerate(ch.INTENT_KEYWORDS.items()):
        hits = lambda ws: " + ".join(f"contains(low, {_quoted(w)})::INT" for w in ws) or "0"
        parts.append(f"SELECT conv_id, turn, {i} AS i, '{name}' AS intent, round(({hits(words)}) / {len(words)} + {ch.PHRASE_BONUS}::DOUBLE * ({hits([w for w in words if ' ' in w])}), 6) AS score FROM m")
    return " UNION ALL ".join(parts)


def _hints() -> str:
    return " ".join(f"WHEN {' OR '.join(f'contains(low, {_quoted(w)})' for w in words)} THEN '{language}'" for language, words in ch.LANGUAGE_WORDS.items())




def _history(budget: int) -> str:
    """One step for each of the last messages, oldest first."""
    cut = f"length(o.text) > {ch.LONG_MESSAGE} AND w.total + length(o.text) > {budget}"
    line = f"o.who || ': ' || CASE WHEN {cut} THEN substr(o.text, 1, {ch.SHORT_MESSAGE}) || chr(10) || '{ch.SHORTENED.strip()}' ELSE o.text END"
    return f"""WITH RECURSIVE l AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) <= {ch.HISTORY_TURNS}),
o AS (SELECT conv_id, text, CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END AS who, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i FROM l),
w AS (SELECT DISTINCT conv_id, 0 AS i, 0 AS total, NULL::VARCHAR AS history FROM o
  UNION ALL SELECT o.conv_id, o.i::INT, (w.total + length({line}))::INT, CASE WHEN w.i = 0 THEN {line} ELSE w.history || chr(10) || chr(10) || {line} END FROM w JOIN o ON o.conv_id = w.conv_id AND o.i = w.i + 1 WHERE w.total <= {budget})
SELECT conv_id AS session, max(i)::INT AS messages, max_by(history, i) AS history FROM w GROUP BY conv_id"""


ORACLE = {
    "formatted_history": _history(3200),
    "formatted_history_short": _history(600),
    "token_streams": """WITH w AS (SELECT stream, ws, unnest(range(len(ws))) AS seq FROM (SELECT conv_id * 1000 + turn AS stream, string_split(coalesce(text, ''), ' ') AS ws FROM conversations)),
k AS (SELECT stream, seq, ws[seq + 1] || ' ' AS token, CASE WHEN (stream * 31 + seq * 7) % 97 = 5 THEN 0 WHEN (stream * 31 + seq * 7) % 13 = 0 THEN 2 ELSE 1 END AS times FROM w),
o AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq) - 1 = seq AS fits FROM k WHERE times > 0)
SELECT stream, coalesce(string_agg(token, '' ORDER BY seq) FILTER (fits), '') AS text, count(*) AS chunks, sum(times - 1)::BIGINT AS repeats, count(*) FILTER (fits) AS next_seq, count(*) FILTER (NOT fits) AS waiting FROM o GROUP BY stream""",
    "session_analytics": """SELECT conv_id AS session, count(*) AS messages, count(*) FILTER (WHERE role = 'user') AS user_messages, count(*) FILTER (WHERE role = 'assistant') AS assistant_messages,
  coalesce(sum(length(text)), 0)::BIGINT AS chars, coalesce(round(avg(length(text)) FILTER (WHERE role = 'assistant'), 3), 0.0) AS avg_reply_chars,
  coalesce(round(count(*) FILTER (WHERE length(text) > 200) / nullif(count(*) FILTER (WHERE role = 'assistant'), 0), 3), 0.0) AS long_ratio
FROM conversations GROUP BY conv_id""",
    "role_distribution": "SELECT role, count(*) AS messages, count(DISTINCT conv_id) AS sessions, sum(greatest(length(text) // 4, 1))::BIGINT AS tokens FROM conversations GROUP BY role",
    "message_search": "SELECT conv_id AS session, turn, role, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '...' ELSE text END AS preview FROM conversations WHERE contains(lower(text), 'tion')",
    "recent_history": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS r FROM conversations)
SELECT conv_id AS session, count(*) AS messages, string_agg(role || ': ' || text, chr(10) ORDER BY r DESC) AS history FROM r WHERE r <= 6 GROUP BY conv_id""",
    "history_budget": """WITH r AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used_before FROM conversations)
SELECT conv_id AS session, turn, role, used_before, length(text)::BIGINT AS chars FROM r WHERE used_before <= 3200""",
    "intent_classification": f"""WITH m AS (SELECT conv_id, turn, lower(text) AS low FROM conversations WHERE role = 'user'), a AS ({_intents()}),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, i) = 1)
SELECT conv_id AS session, turn, CASE WHEN score <= 0 THEN '{ch.DEFAULT_INTENT}' ELSE intent END AS intent, CASE WHEN score <= 0 THEN {ch.DEFAULT_CONFIDENCE}::DOUBLE ELSE least(score, 1.0) END AS confidence FROM b""",
    "session_titles": f"""WITH f AS (SELECT conv_id, arg_min(text, (turn, text)) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id),
b AS (SELECT conv_id, regexp_extract(regexp_replace(trim(t, ' '), '^(?i)({"|".join(ch.FILLERS)}) +', ''), '^([^.!?\\n]*)', 1) AS s FROM f),
k AS (SELECT conv_id, trim(upper(substr(s, 1, 1)) || substr(s, 2), ' ') AS t FROM b)
SELECT conv_id AS session, CASE WHEN length(t) > 60 THEN regexp_replace(substr(t, 1, 57), ' [^ ]*$', '') || '...' ELSE t END AS title FROM k""",
    "language_hints": f"SELECT conv_id AS session, turn, CASE {_hints()} END AS language FROM (SELECT *, lower(text) AS low FROM conversations WHERE role = 'user')",
    "question_checks": f"""SELECT conv_id || '-' || turn AS id, CASE WHEN role <> 'user' OR trim(coalesce(text, ''), ' ') = '' THEN 'query is empty' WHEN length(trim(text, ' ')) > {checks.QUESTION_CHARS} THEN 'query is too long' WHEN trim(coalesce(role, ''), ' ') = '' THEN 'project is missing' END AS fault,
  greatest(1, least(coalesce(turn * 3, {checks.USUAL_SOURCES}), {checks.MOST_SOURCES})) AS sources FROM conversations""",
    "session_payloads": """SELECT conv_id AS session, count(*) AS messages, to_json(list({turn: turn, role: role, content: text} ORDER BY turn, role, text))::VARCHAR AS payload FROM conversations GROUP BY conv_id""",
    "session_summaries": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS r FROM conversations WHERE role = 'assistant'), p AS (SELECT conv_id, arg_max(substr(text, 1, 200), r) AS preview FROM e WHERE r <= 2 GROUP BY conv_id)
SELECT c.conv_id AS session, count(*) AS messages, count(*) FILTER (WHERE role = 'assistant') AS replies, any_value(preview) AS preview FROM conversations c LEFT JOIN p ON c.conv_id = p.conv_id GROUP BY c.conv_id""",
    "session_export": """SELECT conv_id AS session, count(*) AS messages, string_agg('### ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || text || chr(10), chr(10) ORDER BY turn, role, text) AS markdown FROM conversations GROUP BY conv_id""",
}

_SESSIONS = "s AS (SELECT DISTINCT conv_id AS session, conv_id % 7 AS user_id, conv_id % 3 AS project, conv_id % 5 <> 0 AS is_active FROM conversations)"
ORACLE |= {
    "titled_search": f"""WITH {_SESSIONS}, t AS ({ORACLE["session_titles"]}), m AS ({ORACLE["message_search"]})
SELECT m.session, t.title, s.user_id, m.turn, m.role, m.preview FROM m JOIN s ON s.session = m.session AND is_active AND project = 1 LEFT JOIN t ON t.session = m.session""",
    "project_chat_totals": f"WITH {_SESSIONS}, n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT project, user_id, count(*) AS sessions, coalesce(sum(n), 0)::BIGINT AS messages FROM s LEFT JOIN n ON conv_id = session WHERE is_active GROUP BY 1, 2",
    "project_chat_mix": f"""WITH {_SESSIONS}, m AS (SELECT conv_id AS session, text, unnest([('prompt_type', ['code_qa', 'explain', 'debug', NULL][length(text) % 4 + 1]), ('model', ['small', NULL, 'large'][length(text) % 3 + 1])]) AS x FROM conversations WHERE role = 'assistant')
SELECT project, user_id, x[1] AS kind, x[2] AS value, count(*) AS messages, sum(greatest(length(text) // 4, 1))::BIGINT AS tokens FROM m JOIN s USING (session) WHERE x[2] IS NOT NULL GROUP BY ALL""",
    "stale_sessions": f"WITH {_SESSIONS}, k AS (SELECT user_id, unnest([session, -session - 1]) AS session FROM s) SELECT k.user_id, k.session, s.session IS NULL AS stale FROM k LEFT JOIN s ON s.session = k.session",
}
