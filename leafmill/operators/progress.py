"""Saved study progress as tables: latest rows, monotone upserts, replaced groups, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *newest: str) -> DataFrame:
    """The newest row of each key by the columns ``newest``, in turn. Pre-aggregated: no key's rows meet in one task
    unless they are its partial results."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*newest)).alias("_r"))
    return best.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def merged_progress(saves: DataFrame) -> DataFrame:
    """(user_id, session_id, section_number, completed, quiz_score, explanation_text, saves): all saves of a section in
    order of arrival (id): completed never goes back, score and text are the last ones, null too."""
    last = F.max_by(F.struct("quiz_score", "explanation_text"), "id")
    x = saves.groupBy("user_id", "session_id", "section_number").agg(F.max("completed").alias("completed"), last.alias("l"), F.countDistinct("id").alias("saves"))
    return x.select("user_id", "session_id", "section_number", "completed", "l.quiz_score", "l.explanation_text", "saves")


def upsert_progress(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both by (user_id, session_id, section_number): completed is the larger, the rest the new one's where there is one."""
    keys = ["user_id", "session_id", "section_number"]
    x = old.alias("o").join(new.alias("n"), keys, "full_outer")
    there = F.col("n.completed").isNotNull()
    pick = lambda c: F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
    return x.select(*keys, F.greatest("o.completed", "n.completed").alias("completed"), pick("quiz_score"), pick("explanation_text"))


def replaced(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The old rows but those of a key that the new ones have, and the new ones."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def key_faults(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def without_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Rows whose parent is there: what is left after deletes that take dependent rows along."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)).distinct(), child_key, "left_semi")


def session_list(sessions: DataFrame, sections: DataFrame, progress: DataFrame) -> DataFrame:
    """(id, user_id, title, sections, completed, percent, place): sessions with their sections, how many the user has
    completed and that as a rounded percentage (half to even); place: newest first within the user.

    Sections and progress are counted before they meet the sessions, so neither join grows.
    """
    n = sections.groupBy(F.col("session_id").alias("id")).agg(F.countDistinct("section_number").alias("sections"))
    done = progress.where("completed = 1").select(F.col("session_id").alias("id"), "user_id", "section_number").distinct().join(sections.select(F.col("session_id").alias("id"), "section_number").distinct(), ["id", "section_number"], "left_semi").groupBy("id", "user_id").agg(F.count("*").alias("completed"))
    x = sessions.join(n, "id", "left").join(done, ["id", "user_id"], "left").withColumn("sections", F.coalesce("sections", F.lit(0))).withColumn("completed", F.coalesce("completed", F.lit(0)))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("created_at"), F.desc("id")))
    return x.select("id", "user_id", "title", "sections", "completed", F.bround(F.col("completed") * 100 / F.greatest(F.lit(1), F.col("sections"))).cast("int").alias("percent"), place.alias("place"))


def quiz_average(merged: DataFrame) -> DataFrame:
    """(user_id, average, scored): mean of the sections' last scores, 0 without any."""
    return merged.groupBy("user_id").agg(F.round(F.coalesce(F.avg("quiz_score"), F.lit(0.0)), 4).alias("average"), F.count("quiz_score").alias("scored"))


def next_sections(sections: DataFrame, merged: DataFrame, k: int = 3) -> DataFrame:
    """(session_id, section_number, rank): the first ``k`` sections of each session that its user has not completed."""
    done = merged.where("completed = 1").select("session_id", "section_number").distinct()
    left = sections.select("session_id", "section_number").distinct().join(done, ["session_id", "section_number"], "left_anti")
    return left.withColumn("rank", F.row_number().over(Window.partitionBy("session_id").orderBy("section_number"))).where(F.col("rank") <= k)


def study_seconds(events: DataFrame, user: str, ts: str, kind: str, start: str, stop: list[str], order: str) -> DataFrame:
    """(user, seconds, spans): time between a start and the next stop, whole seconds each; a second start is ignored and
    a span never stopped does not count."""
    marks = events.where(F.col(kind).isin([start, *stop]))
    w = Window.partitionBy(user).orderBy(ts, order)
    x = marks.withColumn("before", F.lag(kind).over(w)).where(~((F.col(kind) == start) & (F.coalesce("before", F.lit("")) == start)))
    x = x.withColumn("next", F.lead(kind).over(w)).withColumn("until", F.lead(ts).over(w))
    spans = x.where((F.col(kind) == start) & F.col("next").isin(stop))
    seconds = F.floor((F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1_000_000)
    return spans.groupBy(user).agg(F.sum(seconds).alias("seconds"), F.count("*").alias("spans"))


def overlay(*maps: Column) -> Column:
    """One map of several, later values win."""

    def over(old: Column, new: Column) -> Column:
        return F.map_concat(F.map_filter(old, lambda k, v: ~F.array_contains(F.map_keys(new), k)), new)

    return reduce(over, maps)


def format_seconds(c: Column) -> Column:
    """Hours and minutes, or minutes and seconds below an hour."""
    s = F.greatest(F.lit(0), F.floor(c).cast("int"))
    h, m = F.floor(s / 3600).cast("int"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int")
    return F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), m.cast("string"), F.lit("m"))).otherwise(F.concat(m.cast("string"), F.lit("m "), F.pmod(s, F.lit(60)).cast("string"), F.lit("s")))


def dedupe_by_signature(df: DataFrame, *columns: str) -> DataFrame:
    """The first row by hash of each distinct content of ``columns``, with its signature."""
    sig = F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns]), 256)
    return df.withColumn("signature", sig).dropDuplicates(["signature"])
