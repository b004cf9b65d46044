"""Conversation analytics: session totals, search, bounded histories, intents, titles, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that speak for an intent, in order of precedence: fixed values.
INTENT_KEYWORDS = {
    "bug_finder": ["bug", "error", "issue", "wrong", "fix", "broken", "crash", "exception", "fail", "problem", "debug", "not working", "doesn't work", "incorrect"],
    "doc_generator": ["document", "docstring", "jsdoc", "documentation", "comment", "describe", "annotate", "readme", "docs"],
    "test_writer": ["test", "unit test", "pytest", "jest", "testing", "coverage", "mock", "assert", "test case", "spec"],
    "code_reviewer": ["review", "code review", "feedback", "quality", "best practice", "pattern", "clean code", "improve"],
    "security_scanner": ["security", "vulnerability", "owasp", "injection", "xss", "csrf", "auth", "secret", "leak", "exploit", "cve", "attack", "unsafe", "sanitize"],
    "refactor": ["refactor", "restructure", "clean up", "simplify", "solid", "dry", "extract", "decompose", "modular"],
    "performance": ["performance", "slow", "optimize", "speed", "fast", "complexity", "bottleneck", "memory", "efficient", "o(n)", "big o", "cache", "latency"],
    "explanation": ["explain", "how does", "what does", "walk through", "understand", "clarify", "break down", "step by step", "teach", "learn"],
    "architecture": ["architecture", "design", "structure", "pattern", "component", "module", "layer", "coupling", "cohesion", "dependency", "diagram"],
    "dependency_analysis": ["dependency", "import", "require", "package", "module", "circular", "unused", "version"],
}
DEFAULT_INTENT, DEFAULT_CONFIDENCE, PHRASE_BONUS = "code_qa", 0.5, 0.1


def session_analytics(messages: DataFrame) -> DataFrame:
    """Messages by role, characters and reply length of each session."""
    return messages.groupBy("session").agg(
        F.count("*").alias("messages"),
        F.count_if(F.col("role") == "user").alias("user_messages"),
        F.count_if(F.col("role") == "assistant").alias("assistant_messages"),
        F.coalesce(F.sum(F.length("content").cast("long")), F.lit(0)).alias("chars"),
        F.coalesce(F.round(F.avg(F.when(F.col("role") == "assistant", F.length("content"))), 3), F.lit(0.0)).alias("avg_reply_chars"),
        F.coalesce(F.round(F.try_divide(F.count_if(F.length("content") > 200), F.count_if(F.col("role") == "assistant")), 3), F.lit(0.0)).alias("long_ratio"),
    )


def role_distribution(messages: DataFrame) -> DataFrame:
    """Messages, sessions and token estimates by role, most first."""
    return messages.groupBy("role").agg(F.count("*").alias("messages"), F.countDistinct("session").alias("sessions"), F.sum(F.greatest(F.floor(F.length("content") / 4), F.lit(1))).alias("tokens")).orderBy(F.desc("messages"), "role")


def message_search(messages: DataFrame, needle: str, preview: int = 200) -> DataFrame:
    """Messages that contain the needle, any case, with a preview."""
    return messages.where(F.contains(F.lower("content"), F.lit(needle.lower()))).select("session", "turn", "role", shortened(F.col("content"), preview).alias("preview"))


def owned_messages(messages: DataFrame, sessions: DataFrame, project=None, user=None) -> DataFrame:
    """Messages of active sessions(session, user_id, project, is_active), with their user and project; of one project or user where given."""
    mine = sessions.where("is_active")
    for column, value in (("project", project), ("user_id", user)):
        mine = mine if value is None else mine.where(F.col(column) == value)
    return messages.join(mine.select("session", "user_id", "project"), "session")


def titled_search(messages: DataFrame, sessions: DataFrame, needle: str, project=None, user=None, preview: int = 200) -> DataFrame:
    """session, title, user_id, turn, role, preview of messages in owned sessions that contain the needle, any case."""
    found = message_search(owned_messages(messages, sessions, project, user), needle, preview)
    titles = session_titles(messages).join(sessions.select("session", "user_id"), "session", "right")
    return found.join(titles, "session").select("session", "title", "user_id", "turn", "role", "preview")


def project_totals(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """project, user_id, sessions, messages of active sessions; sessions without messages count too."""
    counts = messages.groupBy("session").agg(F.count("*").alias("n"))
    rows = sessions.where("is_active").join(counts, "session", "left")
    return rows.groupBy("project", "user_id").agg(F.count("*").alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).alias("messages"))


def project_mix(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """project, user_id, kind, value, messages, tokens: assistant messages by kind of prompt and by model, in one aggregation; messages without one are left out of it."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in ("prompt_type", "model")]))
    rows = messages.where("role = 'assistant'").select("session", "content", each.alias("x")).where("x.value is not null")
    rows = rows.join(sessions.select("session", "project", "user_id"), "session")
    tokens = F.sum(F.greatest(F.floor(F.length("content") / 4), F.lit(1)))
    return rows.groupBy("project", "user_id", F.col("x.kind").alias("kind"), F.col("x.value").alias("value")).agg(F.count("*").alias("messages"), tokens.alias("tokens"))


def stale_sessions(kept: DataFrame, sessions: DataFrame) -> DataFrame:
    """user_id, session, stale: ids that users keep a list of, and whether there is no such session any more."""
    return kept.join(sessions.select("session", F.lit(True).alias("there")), "session", "left").select("user_id", "session", F.col("there").isNull().alias("stale"))


def shortened(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def recent_history(messages: DataFrame, last: int = 6) -> DataFrame:
    """The last messages of each session, oldest first, as one text."""
    newest = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("turn"), F.desc("role"), F.desc("content")))
    rows = messages.withColumn("r", newest).where(F.col("r") <= last)
    turns = F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("o"), F.concat("role", F.lit(": "), "content").alias("line"))))
    return rows.groupBy("session").agg(F.count("*").alias("messages"), F.array_join(F.transform(turns, lambda x: x["line"]), "\n").alias("history"))


def history_budget(messages: DataFrame, budget: int = 3200) -> DataFrame:
    """Newest messages of each session while what came before them is within the budget of characters."""
    order = Window.partitionBy("session").orderBy(F.desc("turn"), F.desc("role"), F.desc("content"))
    before = F.coalesce(F.sum(F.length("content").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return messages.withColumn("used_before", before).where(F.col("used_before") <= budget).select("session", "turn", "role", "used_before", F.length("content").cast("long").alias("chars"))


#: Messages of a formatted history, its characters, and how a message is shortened that does not fit: fixed values.
HISTORY_TURNS, HISTORY_CHARS, LONG_MESSAGE, SHORT_MESSAGE = 6, 3200, 500, 300
SHORTENED = "\n... [message truncated for brevity]"


def formatted_history(messages: DataFrame, turns: int = HISTORY_TURNS, budget: int = HISTORY_CHARS) -> DataFrame:
    """session, messages, history: the last messages of each session, oldest first, until they exceed the budget.

    The message that exceeds it is still there; a long one is shortened if it would. Null
    contents are empty. Only as many messages as a history has are gathered for a session.
    """
    newest = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("turn"), F.desc("role"), F.desc("content")))
    rows = messages.withColumn("r", newest).where(F.col("r") <= turns)
    last = F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("o"), F.when(F.col("role") == "user", "User").otherwise("Assistant").alias("who"), F.coalesce("content", F.lit("")).alias("content"))))

    def take(state, m):
        size = F.length(m["content"])
        cut = (size > LONG_MESSAGE) & (state["total"] + size > budget)
        line = F.concat(m["who"], F.lit(": "), F.when(cut, F.concat(F.substring(m["content"], 1, SHORT_MESSAGE), F.lit(SHORTENED))).otherwise(m["content"]))
        taken = F.struct((state["total"] + F.length(line)).alias("total"), F.concat(state["lines"], F.array(line)).alias("lines"))
        return F.when(state["total"] > budget, state).otherwise(taken)

    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<string>").alias("lines"))
    lines = F.aggregate("last", start, take, lambda s: s["lines"])
    out = rows.groupBy("session").agg(last.alias("last")).select("session", lines.alias("lines"))
    return out.select("session", F.size("lines").alias("messages"), F.array_join("lines", "\n\n").alias("history"))


def intent_score(text: Column, words: list[str]) -> Column:
    """Share of the words that occur, and a bonus for each phrase among them."""
    low = F.lower(text)
    hit = lambda w: F.when(F.contains(low, F.lit(w)), 1).otherwise(0)
    total, phrases = F.lit(0), F.lit(0)
    for w in words:
        total = total + hit(w)
        if " " in w:
            phrases = phrases + hit(w)
    return F.round(total / len(words) + PHRASE_BONUS * phrases, 6)


def intent_classification(messages: DataFrame, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """The intent of each user message, the first of the best, with its confidence."""
    keywords = INTENT_KEYWORDS if keywords is None else keywords
    scored = messages.where(F.col("role") == "user").select("session", "turn", F.array(*[F.struct(intent_score(F.col("content"), words).alias("score"), F.lit(-i).alias("first"), F.lit(name).alias("intent")) for i, (name, words) in enumerate(keywords.items())]).alias("all"))
    best = scored.select("session", "turn", F.array_max("all").alias("best"))
    none = F.col("best.score") <= 0
    return best.select("session", "turn", F.when(none, DEFAULT_INTENT).otherwise(F.col("best.intent")).alias("intent"), F.when(none, DEFAULT_CONFIDENCE).otherwise(F.least(F.col("best.score"), F.lit(1.0))).alias("confidence"))


#: Openings that a title leaves out: fixed values.
FILLERS = ["please", "can you", "could you", "i want to", "i need to", "help me", "how do i", "what is"]


def session_titles(messages: DataFrame, most: int = 60) -> DataFrame:
    """A title for each session from its first user message."""
    first = messages.where(F.col("role") == "user").groupBy("session").agg(F.min_by("content", F.struct("turn", "content")).alias("content"))
    bare = F.regexp_replace(F.trim("content"), rf"^(?i)({'|'.join(FILLERS)}) +", "")
    sentence = F.regexp_extract(bare, r"^([^.!?\n]*)", 1)
    capital = F.concat(F.upper(F.substring(sentence, 1, 1)), F.substring(sentence, 2, 1 << 20))
    rows = first.select("session", F.trim(capital).alias("t"))
    cut = F.regexp_replace(F.substring("t", 1, most - 3), r" [^ ]*$", "")
    return rows.select("session", F.when(F.length("t") > most, F.concat(cut, F.lit("..."))).otherwise(F.col("t")).alias("title"))


def session_export(messages: DataFrame) -> DataFrame:
    """Each session as Markdown, its messages in order."""
    block = F.concat(F.lit("### "), F.initcap("role"), F.lit("\n\n"), "content", F.lit("\n"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", block.alias("block"))))
    return messages.groupBy("session").agg(F.count("*").alias("messages"), F.array_join(F.transform(turns, lambda x: x["block"]), "\n").alias("markdown"))


def session_payloads(messages: DataFrame) -> DataFrame:
    """Each session with all its messages in order, as JSON; fields that are null are left out."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    return messages.groupBy("session").agg(F.count("*").alias("messages"), F.to_json(turns).alias("payload"))


def session_summaries(messages: DataFrame, preview: int = 200) -> DataFrame:
    """session, messages, replies and a preview: the beginning of the second reply, of the first where there is but one, null without any."""
    order = Window.partitionBy("session").orderBy("turn", "content")
    early = messages.where("role = 'assistant'").withColumn("r", F.row_number().over(order)).where("r <= 2")
    shown = early.groupBy("session").agg(F.max_by(F.substring("content", 1, preview), "r").alias("preview"))
    counts = messages.groupBy("session").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == "assistant").alias("replies"))
    return counts.join(shown, "session", "left")


#: What in a question speaks for a language, first language first: fixed values.
LANGUAGE_WORDS = {
    "python": ["python", ".py", "def ", "class ", "import ", "pip", "pytest"],
    "javascript": ["javascript", "js", "node", "npm", "const ", "let ", "var ", "=>"],
    "typescript": ["typescript", "ts", "interface ", "type ", "tsx"],
    "java": ["java", "public class", "spring", "maven", "gradle"],
    "go": ["golang", "go", "func ", "package ", "goroutine"],
    "rust": ["rust", "cargo", "fn ", "let mut", "impl "],
    "cpp": ["c++", "cpp", "#include", "std::", "nullptr"],
}


def language_hints(messages: DataFrame) -> DataFrame:
    """session, turn, language: the first language one of whose words a user's message holds, in any case; null without one."""
    low, out = F.lower("content"), F.lit(None).cast("string")
    for language, words in reversed(LANGUAGE_WORDS.items()):
        out = F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), language).otherwise(out)
    return messages.where("role = 'user'").select("session", "turn", out.alias("language"))
