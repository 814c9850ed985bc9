"""What a session remembers: key-value scopes, blocks of text made of them, synchronisation, the state of ingestion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The lines of the instructions, by scope and key.
INSTRUCTIONS = [("project", "tech", "PROJECT"), ("project", "buildCommand", "BUILD"), ("project", "testCommand", "TEST"), ("project", "codeStyle", "STYLE"), ("user", "fixStyle", "USER"), ("user", "codeStyle", "USER STYLE")]
# Old entries that are no memory, and where the others go.
GREETING = r"(?i)^(you |hello|hi |ok |yes|no )"
LEGACY = {"user_pref": ("user", "user_pref_"), "project_fact": ("project", "fact_")}


def latest(writes: DataFrame, by: tuple[str, ...] = ("owner", "scope", "key")) -> DataFrame:
    """The last value written to each key (pos orders the writes); a key whose last value is null is deleted."""
    return writes.groupBy(*by).agg(F.max_by("value", "pos").alias("value")).where("value is not null")


def instructions(values: DataFrame) -> DataFrame:
    """(owner, block) of the settings that open a session; owners without any have none."""
    rank = reduce(lambda w, r: w.when((F.col("scope") == r[1][0]) & (F.col("key") == r[1][1]), F.struct(F.lit(r[0]).alias("nth"), F.concat(F.lit(f"[{r[1][2]}] "), "value").alias("line"))), enumerate(INSTRUCTIONS), F)
    rows = values.where("value <> ''").select("owner", rank.otherwise(F.lit(None)).alias("x")).where("x is not null")
    return rows.groupBy("owner").agg(F.array_sort(F.collect_list("x")).alias("x")).select("owner", F.array_join(F.transform("x", lambda r: r.line), "\n").alias("block"))


def migrated(entries: DataFrame) -> DataFrame:
    """(scope, key, value) of old entries (pos, type, content) of ten characters or more that are no greeting."""
    good = entries.where((F.length("content") >= 10) & ~F.col("content").rlike(GREETING) & F.col("type").isin(*LEGACY))
    pick = lambda k: reduce(lambda w, t: w.when(F.col("type") == t[0], t[1][k]), LEGACY.items(), F)
    nth = F.row_number().over(Window.partitionBy("type").orderBy("pos")) - 1
    return good.select(pick(0).alias("scope"), F.concat(pick(1), nth.cast("string")).alias("key"), F.col("content").alias("value"))


def anchor(task: Column, status: Column, step: Column, corrections: Column, do_not: Column) -> Column:
    """The block that keeps a task in sight; empty without a task. Corrections are structs of turn and text."""
    trail = F.when(F.size(status) > 0, F.concat(F.lit("[STATUS] "), F.array_join(F.transform(status, lambda s: F.concat(F.lit("✓ "), s)), " → ")))
    said = F.transform(corrections, lambda c: F.concat(F.lit("  User (turn "), c.turn.cast("string"), F.lit('): "'), c.text, F.lit('"')))
    fixed = F.when(F.size(corrections) > 0, F.concat(F.lit("[CORRECTIONS]\n"), F.array_join(said, "\n")))
    never = F.when(F.size(do_not) > 0, F.concat(F.lit("[DO NOT] "), F.array_join(do_not, ". "), F.lit(".")))
    block = F.concat_ws("\n", F.concat(F.lit("[TASK] "), task), trail, F.when(step != "", F.concat(F.lit("[STEP] "), step)), fixed, never)
    return F.when(F.coalesce(task, F.lit("")) == "", "").otherwise(block)


def recovery(task: Column, error: Column, other: Column) -> Column:
    """What is added to the error of a tool."""
    go_on = F.when(F.coalesce(task, F.lit("")) == "", "Continue with your CURRENT task.").otherwise(F.concat(F.lit("Continue with the CURRENT task: "), task, F.lit(".")))
    return F.concat_ws("\n", F.concat(F.lit("\n[RECOVERY] "), error), F.when(other != "", F.concat(F.lit("Alternative: "), other)), go_on, F.lit("Do NOT change topic or search for unrelated content."))


def search_query(language: Column, code: Column, message: Column, most: int = 80) -> Column:
    """What is searched for when an error is to be fixed."""
    some = lambda c: F.when(c != "", c)
    return F.concat_ws(" ", language, some(code), some(F.substring(message, 1, most)), F.lit("fix"))


def synchronised(known: DataFrame, seen: DataFrame) -> DataFrame:
    """(session, pos, content, origin) of sessions after a snapshot: `appended` rows beyond those known, or all `reset`.

    Both have session, pos (from 0, without gaps) and content. A session is reset if the snapshot is empty, more than
    two rows shorter, or begins with another content; a session that is empty there has no rows. Known rows stay as
    they were where nothing was reset, even if the snapshot says otherwise.
    """
    mark = lambda df, n, c: df.groupBy("session").agg(F.count("*").alias(n), F.min_by(F.struct("content"), "pos").alias(c))
    both = mark(known, "n_known", "first_known").join(mark(seen, "n_seen", "first_seen"), "session", "full")
    n_known, n_seen = F.coalesce("n_known", F.lit(0)), F.coalesce("n_seen", F.lit(0))
    other = (n_known > 0) & ~F.col("first_seen.content").eqNullSafe(F.col("first_known.content"))
    state = both.select("session", n_known.alias("n_known"), ((n_seen == 0) | (n_seen < n_known - 2) | other).alias("is_reset"))
    old = known.join(state.where("not is_reset"), "session").select("session", "pos", "content", F.lit("known").alias("origin"))
    new = seen.join(state, "session").where("is_reset or pos >= n_known")
    return old.unionByName(new.select("session", "pos", "content", F.when(F.col("is_reset"), "reset").otherwise("appended").alias("origin")))


def ingestion_states(log: DataFrame) -> DataFrame:
    """(doc_id, collection, total_chunks, processed, status) from a log of start, progress, complete and reset.

    Log: doc_id, pos, event, collection, n (chunks in all at a start, done so far at progress). What comes before the
    last start, and progress without a start, doesn't count; a document whose last event is a reset has no state.
    """
    begun = Window.partitionBy("doc_id").orderBy("pos")
    rows = log.withColumn("run", F.sum(F.col("event").isin("start", "reset").cast("int")).over(begun)).withColumn("last", F.max("run").over(Window.partitionBy("doc_id")))
    at = lambda e, c: F.max_by(F.when(F.col("event") == e, F.col(c)), F.when(F.col("event") == e, F.col("pos")))
    out = rows.where("run = last and run > 0").groupBy("doc_id").agg(
        F.bool_or(F.col("event") == "start").alias("started"), at("start", "collection").alias("collection"), at("start", "n").alias("total_chunks"),
        F.coalesce(at("progress", "n"), F.lit(0)).alias("processed"), F.bool_or(F.col("event") == "complete").alias("done"),
    )
    return out.where("started").select("doc_id", "collection", "total_chunks", "processed", F.when(F.col("done"), "complete").otherwise("in_progress").alias("status"))
