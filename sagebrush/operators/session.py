"""Sessions of messages: turns, token budgets, masking, compaction, summaries, trends. All windows over (session, pos)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tables as T
from ..functions import text as X

ERROR_WORDS = "(?i)error|fail|stderr|BLOCKED|❌"


def turns(messages: DataFrame) -> DataFrame:
    """(session, pos, role, content) with turn (users so far), tokens (10 more than the text's) and age."""
    by = Window.partitionBy("session").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = messages.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("turn", F.sum((F.col("role") == "user").cast("long")).over(by))
    out = out.withColumn("tokens", (X.message_tokens(F.col("content")) + 10).cast("long"))
    return out.withColumn("age", F.max("turn").over(Window.partitionBy("session")) - F.col("turn"))


def masked(rows: DataFrame) -> DataFrame:
    """turns() with `masked` and the tokens saved: old tool results, errors kept for five turns, short ones for three."""
    error = F.col("content").rlike(ERROR_WORDS)
    n = F.length("content")
    old = (F.col("role") == "tool") & (F.col("age") >= 1) & ~(error & (F.col("age") < 5)) & ((n > 500) | (F.col("age") >= 3))
    lines = F.size(F.split("content", "\n", -1))
    short = F.concat(F.lit("[tool] → "), F.when(n > 100, F.concat(F.substring("content", 1, 100), F.lit("..."))).otherwise(F.col("content")), F.lit(" ("), lines.cast("string"), F.lit(" lines)"))
    out = rows.withColumn("masked", old).withColumn("shown", F.when(old, short).otherwise(F.col("content")))
    saved = X.message_tokens(F.col("content")) - (X.message_tokens(F.col("shown")) + 10)
    return out.withColumn("saved", F.when(old, saved).otherwise(0).cast("long"))


def budget(n_ctx: Column) -> Column:
    """struct(tier, available, conversation, mask, summarise, extract, compact) of a context size."""
    available = n_ctx - F.floor(n_ctx * 0.25)
    out = F
    for tier, most, system, anchor, reinforce, memory, *limits in T.BUDGETS:
        names = ("mask", "summarise", "extract", "compact")
        row = F.struct(F.lit(tier).alias("tier"), available.alias("available"), (available - (system + anchor + reinforce + memory)).alias("conversation"), *[F.lit(x).alias(n) for n, x in zip(names, limits, strict=True)])
        out = out.when(n_ctx <= most, row) if most else out.otherwise(row)
    return out


def compression(usage: Column, b: Column) -> Column:
    """What to do at a share of the budget used; the highest threshold reached."""
    return F.when(usage >= b["compact"], "compact").when(usage >= b["extract"], "extract").when(usage >= b["summarise"], "summarise").when(usage >= b["mask"], "mask")


def kept_by_summary(rows: DataFrame, least: int, last: int) -> DataFrame:
    """Marks what stays when a long session is summarised: the first message and the last ones; short sessions stay whole."""
    session = Window.partitionBy("session")
    nth = F.row_number().over(session.orderBy("pos"))
    n = F.count("*").over(session)
    return rows.withColumn("n", n).withColumn("nth", nth).withColumn("stays", (F.col("n") <= least) | (F.col("nth") == 1) | (F.col("nth") > F.col("n") - last))


def summaries(rows: DataFrame) -> DataFrame:
    """(session, n_trimmed, successes, errors, last sentences) of the messages that a summary replaces."""
    gone = rows.where("not stays")
    first = F.trim(F.split("content", r"[.!?\n]", 2)[0])
    key = F.when((F.col("role") == "assistant") & (F.length("content") > 20) & (F.length(first) > 10) & (F.length(first) < 200), F.struct("pos", first.alias("s")))
    tool = F.col("role") == "tool"
    out = gone.groupBy("session").agg(
        F.count("*").alias("n_trimmed"),
        F.count_if(tool & F.col("content").rlike("(?i)✓|✅|success")).alias("successes"),
        F.count_if(tool & F.col("content").rlike("(?i)❌|STDERR|Error|FAIL")).alias("errors"),
        F.array_sort(F.collect_list(key)).alias("keys"),
    )
    return out.withColumn("context", F.array_join(F.transform(F.slice("keys", F.greatest(F.size("keys") - 2, F.lit(1)), 3), lambda k: k.s), "; ")).drop("keys")


def trends(outcomes: DataFrame, last: int = 20) -> DataFrame:
    """Per error code over its last occurrences: total, success rate, last day, sessions, systemic (three or more)."""
    recent = outcomes.withColumn("nth", F.row_number().over(Window.partitionBy("error_code").orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("nth") <= last)
    out = recent.groupBy("error_code").agg(F.count("*").alias("total"), F.avg(F.col("passed").cast("double")).alias("success_rate"), F.max("ts").cast("date").cast("string").alias("last_seen"), F.count_distinct("session").alias("sessions"))
    return out.withColumn("systemic", F.col("sessions") >= 3)


def escalations(outcomes: DataFrame, last: int = 20) -> DataFrame:
    """(error_code, strategy, failures): strategies that failed twice or more among a code's last occurrences."""
    recent = outcomes.withColumn("nth", F.row_number().over(Window.partitionBy("error_code").orderBy(F.desc("ts"), F.desc("event_id")))).where(F.col("nth") <= last)
    return recent.where("not passed").groupBy("error_code", "strategy").agg(F.count("*").alias("failures")).where("failures >= 2")


def ring(rows: DataFrame, by: list[str], order: list[str], last: int) -> DataFrame:
    """The last rows of each key."""
    over = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("nth", F.row_number().over(over)).where(F.col("nth") <= last)


def repeated_searches(searches: DataFrame, last: int = 20) -> DataFrame:
    """Searches (session, pos, query, top) with three or more of the session's last ones that had the same top result
    and similar words. The history is a bounded window, so no join is needed."""
    over = Window.partitionBy("session").orderBy("pos").rowsBetween(-last, -1)
    past = F.collect_list(F.struct("top", X.word_set(F.col("query")).alias("words"))).over(over)
    own = searches.withColumn("words", X.word_set(F.col("query"))).withColumn("past", past)
    same = F.size(F.filter("past", lambda p: (p.top == F.col("top")) & (X.jaccard(p.words, F.col("words")) > 0.2)))
    return own.withColumn("similar", same.cast("long")).where("similar >= 3").select("session", "pos", "similar")


def quality_gate(rows: DataFrame, kinds: list[str], last: int = 20, most: float = 0.6) -> DataFrame:
    """Accepted memories of each session, in order: long enough, of a known kind, not too like the last ones accepted.

    A fold over a session's extractions (at most three a turn), in the JVM.
    """
    rows = rows.where((F.length(F.coalesce("content", F.lit(""))) >= 10) & F.col("kind").isin(*kinds))
    item = F.struct("pos", "content", X.word_set(F.col("content")).alias("words"))
    own = rows.groupBy("session").agg(F.array_sort(F.collect_list(item)).alias("rows"))

    def step(kept: Column, x: Column) -> Column:
        recent = F.slice(kept, F.greatest(F.size(kept) - last + 1, F.lit(1)), last)
        return F.when(F.exists(recent, lambda k: X.jaccard(k.words, x.words) > most), kept).otherwise(F.concat(kept, F.array(x)))

    return own.select("session", F.explode(F.aggregate("rows", F.filter("rows", lambda x: F.lit(False)), step)).alias("x")).select("session", "x.pos")


def promoted(outcomes: DataFrame, run: int = 5) -> DataFrame:
    """(language, error_code, strategy) with `run` passes in a row at some time; of a code's strategies, the latest."""
    over = Window.partitionBy("language", "error_code", "strategy").orderBy("ts", "event_id").rowsBetween(-(run - 1), 0)
    hit = outcomes.withColumn("n", F.count("*").over(over)).withColumn("ok", F.min(F.col("passed").cast("int")).over(over)).where((F.col("n") == run) & (F.col("ok") == 1))
    return hit.groupBy("language", "error_code").agg(F.max_by("strategy", F.struct("ts", "event_id")).alias("strategy"))


def do_not_list(rows: DataFrame, last: int = 3) -> DataFrame:
    """The topics (session, topic, pos) that were named last; a topic named again moves to the end."""
    latest = rows.groupBy("session", "topic").agg(F.max("pos").alias("pos"))
    return ring(latest, ["session"], ["pos"], last).select("session", "topic", "pos")


def extractions(rows: DataFrame, most: int = 3) -> DataFrame:
    """(id, nth, type, content, scope) of JSON arrays, fenced or not; what is no array or lacks a text gives nothing."""
    body = F.regexp_replace(F.trim("response"), r"^```(?:json)?\s*|\s*```$", "")
    parsed = F.from_json(body, "array<struct<type:string,content:string,scope:string>>")
    out = rows.where(body.startswith("[")).select("id", F.posexplode(F.slice(parsed, 1, most)).alias("nth", "x"))
    return out.where("x.type is not null and x.content is not null").select("id", F.col("nth").cast("long").alias("nth"), "x.type", "x.content", F.coalesce("x.scope", F.lit("project")).alias("scope"))


def compressed(rows: DataFrame, least: int = 10, last: int = 8) -> DataFrame:
    """(session, pos, role, content, tokens, is_summary): sessions after old turns gave way to a summary.

    rows are turns(). The first message and the last ones stay; one message with the summary of the others stands after
    the first. Short sessions stay whole.
    """
    marked = kept_by_summary(rows, least, last)
    kept = marked.where("stays").select("session", F.col("pos").cast("double").alias("pos"), "role", "content", "tokens", F.lit(False).alias("is_summary"))
    turn = rows.groupBy("session").agg(F.max("turn").alias("turn"), F.min("pos").alias("first"))
    text = summary_text(summaries(marked)).join(turn, "session")
    body = F.concat(F.lit("[SESSION SUMMARY — updated at turn "), F.col("turn").cast("string"), F.lit("]\n"), F.col("summary"), F.lit("\n[END SUMMARY]"))
    tokens = (X.message_tokens(F.col("summary")) + 20).cast("long")
    made = text.select("session", (F.col("first") + 0.5).alias("pos"), F.lit("user").alias("role"), body.alias("content"), tokens.alias("tokens"), F.lit(True).alias("is_summary"))
    return kept.unionByName(made)


def summary_text(rows: DataFrame) -> DataFrame:
    """(session, summary) of summaries(): one line for each thing that there is to say."""
    line = lambda head, value, there: F.when(there, F.concat(F.lit(head), value.cast("string")))
    said = F.concat_ws("\n", line("Messages summarised: ", F.col("n_trimmed"), F.lit(True)), line("Successful actions: ", F.col("successes"), F.col("successes") > 0), line("Errors met: ", F.col("errors"), F.col("errors") > 0), line("Context: ", F.col("context"), F.col("context") != ""))
    return rows.select("session", said.alias("summary"))


def plain_messages(rows: DataFrame) -> DataFrame:
    """Messages without what the session keeps beside them."""
    return rows.drop("turn", "tokens", "age", "masked", "shown", "saved", "is_summary")


def current_turns(rows: DataFrame) -> DataFrame:
    """(session, turn, messages, tokens) of turns()."""
    return rows.groupBy("session").agg(F.max("turn").alias("turn"), F.count("*").alias("messages"), F.sum("tokens").alias("tokens"))


def previous_strategies(outcomes: DataFrame) -> DataFrame:
    """(error_code, strategies): each strategy tried for a code once, in the order of its first time."""
    first = outcomes.groupBy("error_code", "strategy").agg(F.min(F.struct("ts", "event_id")).alias("at"))
    own = first.groupBy("error_code").agg(F.array_sort(F.collect_list(F.struct("at", "strategy"))).alias("x"))
    return own.select("error_code", F.transform("x", lambda s: s.strategy).alias("strategies"))
