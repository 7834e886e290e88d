"""Usage analytics: events, sessions, batch sync, summaries, throttling, and profiles of datasets."""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from loamgrid.shared import written


def build_events(raw: DataFrame, salt: str) -> DataFrame:
    """Upload-ready events: the user as a salted hash, the words of the payload counted, the payload itself left out. raw: (event_id, ts, user_id, event_type, props)."""
    words = F.size(F.split(F.trim("props"), "\\s+")).cast("long")
    return raw.select("event_id", F.sha2(F.concat(F.col("user_id").cast("string"), F.lit(salt)), 256).alias("user_hash"), "event_type", words.alias("n_words"), F.get_json_object("props", "$.k").cast("long").alias("k"))


def sessions(messages: DataFrame) -> DataFrame:
    """One row per session of (session, ts, topic): start, duration in whole seconds, number of messages and of distinct topics."""
    seconds = lambda c: F.unix_micros(c.cast("timestamp"))
    return messages.groupBy("session").agg(
        F.min("ts").alias("started"), F.floor((F.max(seconds(F.col("ts"))) - F.min(seconds(F.col("ts")))) / 1_000_000).cast("long").alias("seconds"), F.count(F.lit(1)).alias("messages"), F.countDistinct("topic").alias("topics")
    )


def next_batch(events: DataFrame, most: int) -> DataFrame:
    """The oldest events that aren't synced: (created_at, id) decides; a top-k, without a full sort."""
    return events.filter(~F.col("synced")).orderBy("created_at", "id").limit(most)


def acknowledge(events: DataFrame, batch: DataFrame, accepted: int) -> DataFrame:
    """events after the server took the first `accepted` of a batch: those are synced, the rest of the batch has one attempt more. A batch is bounded by its limit, so it is broadcast."""
    numbered = batch.select("id", F.row_number().over(Window.orderBy("created_at", "id")).alias("place"))
    joined = events.join(F.broadcast(numbered), "id", "left")
    return joined.withColumns({"synced": F.col("synced") | F.coalesce(F.col("place") <= accepted, F.lit(False)), "attempts": F.col("attempts") + F.coalesce((F.col("place") > accepted).cast("int"), F.lit(0))}).drop("place")


def sync_summary(events: DataFrame) -> DataFrame:
    """Totals in one pass; the success rate of no events is 1."""
    good = F.count_if(F.col("synced"))
    n = F.count(F.lit(1))
    return events.agg(n.alias("total"), F.count_if(~F.col("synced")).alias("unsynced"), F.sum("attempts").cast("long").alias("attempts"), F.coalesce(F.round(F.when(n > 0, good / n), 6), F.lit(1.0)).alias("success_rate"))


def merge_preferences(old: DataFrame, new: DataFrame) -> DataFrame:
    """The single row of preferences with the fields that new sets; both have the same columns."""
    named = [f"__{c}" for c in new.columns]
    return old.join(F.broadcast(new.limit(1).toDF(*named))).select(*[F.coalesce(f"__{c}", c).alias(c) for c in old.columns])


def _last_accepted(t: np.ndarray, width: int) -> np.ndarray:
    """For each of the sorted times, if it is accepted: the last one accepted from there on. By pointer doubling: every accepted time points to the first one a width later."""
    n = len(t)
    jump, last = np.append(np.searchsorted(t, t + width), n), np.append(np.arange(n), n)
    while (jump[:n] < n).any():
        has = np.flatnonzero(jump[:n] < n)
        last[has], jump[has] = last[jump[has]], jump[jump[has]]
    return last[:n]


def throttled(reports: DataFrame, seconds: int = 300, windows: int = 64, fan: int = 64) -> DataFrame:
    """At most one report of a kind in a window that starts anew with each accepted report. reports: (kind, ts, id).

    Each kind is cut into ranges of so many windows. A range maps the time from which it may accept to the last time that it accepts; only times in its first window can matter for that. The maps of fan neighbouring ranges are composed to one, those of fan such stretches again, until a kind has fan of them; on the way down each learns from where it may accept, and at last each range is walked from there. No task sees more than fan maps or one range. Null times are left out.
    """
    width = seconds * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    ranged = reports.filter(F.col("ts").isNotNull()).withColumn("__at", at).withColumn("__range", F.floor(F.col("__at") / (width * windows)).cast("long"))
    kind = reports.schema["kind"]

    def mapped(group: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(group["__at"].to_numpy())
        some = np.arange(min(len(t), int(np.searchsorted(t, t[0] // (width * windows) * width * windows + width, "right")) + 1))
        return pd.DataFrame({"kind": [group["kind"].iloc[0]], "__range": [group["__range"].iloc[0]], "times": [t[some]], "exits": [t[_last_accepted(t, width)[some]]]})

    def composed(group: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.asarray(t), np.asarray(e)) for t, e in zip(*[group.sort_values("__range")[c] for c in ("times", "exits")], strict=True)]
        # After all times of the first range, the first time of the next one is the one that is accepted.
        times = np.append(parts[0][0], parts[1][0][:1] if len(parts) > 1 else [])
        free = np.append(parts[0][1], parts[1][1][:1] if len(parts) > 1 else []) + width
        for k, (t, e) in enumerate(parts[1:], 1):
            some = np.arange(len(free) - (k == 1))
            at = np.searchsorted(t, free[some])
            free[some[at < len(t)]] = e[at[at < len(t)]] + width
        return pd.DataFrame({"kind": [group["kind"].iloc[0]], "__range": [group["__range"].iloc[0] // fan], "times": [times.astype(np.int64)], "exits": [(free - width).astype(np.int64)]})

    def entered(group: pd.DataFrame) -> pd.DataFrame:
        group, entries = group.sort_values("__range"), []
        free = int(group["begin"].iloc[0])
        for times, exits in zip(group["times"], group["exits"], strict=True):
            entries.append(free)
            k = int(np.searchsorted(times, free))
            free = int(exits[k]) + width if k < len(times) else free
        return pd.DataFrame({"kind": group["kind"], "__range": group["__range"], "free": entries})

    def walked(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["__at", "id"])
        t, keep = group["__at"].to_numpy(), []
        k = int(np.searchsorted(t, group["free"].iloc[0]))
        while k < len(t):
            keep.append(k)
            k = int(np.searchsorted(t, t[k] + width))
        return group.iloc[keep][["kind", "ts", "id"]]

    named = [kind, ST.StructField("__range", ST.LongType())]
    times = ST.ArrayType(ST.LongType())
    mapped_type, entry_type = ST.StructType([*named, ST.StructField("times", times), ST.StructField("exits", times)]), ST.StructType([*named, ST.StructField("free", ST.LongType())])
    levels = [written(ranged.select("kind", "__range", "__at").groupBy("kind", "__range").applyInPandas(mapped, mapped_type), "maps")]
    above = F.floor(F.col("__range") / fan)
    while (levels[-1].groupBy("kind").count().agg(F.max("count")).first()[0] or 0) > fan:
        levels.append(written(levels[-1].groupBy("kind", above).applyInPandas(composed, mapped_type), "maps"))
    entries = levels[-1].withColumn("begin", F.lit(np.iinfo(np.int64).min)).groupBy("kind").applyInPandas(entered, entry_type)
    renamed = lambda df: df.withColumnsRenamed({"kind": "__kind", "__range": "__r"})
    for lower in reversed(levels[:-1]):
        begins = lower.join(renamed(entries).withColumnRenamed("free", "begin"), F.col("kind").eqNullSafe(F.col("__kind")) & (above == F.col("__r"))).drop("__kind", "__r")
        entries = begins.groupBy("kind", above).applyInPandas(entered, entry_type)
    entries = renamed(entries)
    placed = ranged.join(entries, F.col("kind").eqNullSafe(F.col("__kind")) & (F.col("__range") == F.col("__r"))).drop("__kind", "__r")
    return placed.groupBy("kind", "__range").applyInPandas(walked, reports.select("kind", "ts", "id").schema)


def ring(log: DataFrame, most: int = 200) -> DataFrame:
    """The newest entries of a log (ts, id), newest first."""
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(most)


def value_counts(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """(value, n, percent) by falling count, then value."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    whole = df.agg(F.count(F.lit(1)).alias("all"))
    out = counts.join(F.broadcast(whole)).select("value", "n", F.round(100 * F.col("n") / F.col("all"), 4).alias("percent")).orderBy(F.desc("n"), "value")
    return out.limit(most) if most else out


def text_profile(df: DataFrame, text: str) -> DataFrame:
    """Rows, distinct texts (by 128 bits of hash, so that no text is shuffled), and mean, median, least and most of characters and words."""
    digest = F.when(F.col(text).isNotNull(), F.struct(F.xxhash64(text), F.xxhash64(F.lit(1), text)))
    chars, words = F.length(text), F.size(F.split(F.trim(text), "\\s+"))
    stats = lambda c, name: [F.round(F.avg(c), 4).alias(f"mean_{name}"), F.round(F.median(c), 4).alias(f"median_{name}"), F.min(c).cast("long").alias(f"min_{name}"), F.max(c).cast("long").alias(f"max_{name}")]
    return df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(digest).alias("distinct_texts"), *stats(chars, "chars"), *stats(words, "words"))


def rollup_groups(df: DataFrame, column: str, groups: DataFrame) -> DataFrame:
    """Counts of a column's values by the group that a rule table (value, grp) names; values without one are `other`."""
    named = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(groups), "value", "left")
    return named.groupBy(F.coalesce("grp", F.lit("other")).alias("grp")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_values"))


def quality_checks(df: DataFrame, key: str, domains: dict[str, list], texts: list[str]) -> DataFrame:
    """One row: nulls in all columns, whether the key is unique, whether values are in their domains and texts aren't empty."""
    nulls = sum((F.count_if(F.col(c).isNull()) for c in df.columns), F.lit(0))
    inside = [F.bool_and(F.col(c).isin(*v)).alias(f"{c}_in_domain") for c, v in domains.items()]
    full = [F.bool_and(F.trim(c) != "").alias(f"{c}_not_empty") for c in texts]
    return df.agg(nulls.cast("long").alias("nulls"), (F.count(key) == F.countDistinct(key)).alias("key_unique"), *inside, *full)


def sample_per_category(df: DataFrame, category: str, key: str, n: int = 1) -> DataFrame:
    """n rows of each category, the same ones every time: those whose key hashes lowest."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(category).orderBy(F.md5(F.col(key).cast("string")), key))).filter(F.col("__k") <= n).drop("__k")


def bundle_report(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row about a bundle: chunks without, with one and with three or more aspects, edges, mean edges per chunk. chunks: (chunk_id, aspects); edges: (src, dst)."""
    n = F.size("aspects")
    a = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.count_if(n == 0).alias("none"), F.count_if(n == 1).alias("one"), F.count_if(n >= 3).alias("three_up"))
    e = edges.agg(F.count(F.lit(1)).alias("edges"))
    return a.join(F.broadcast(e)).withColumn("mean_edges", F.round(F.when(F.col("chunks") > 0, F.col("edges") / F.col("chunks")), 6))


# Aspects of which a follow-up can be made, and rich chunks that a report names.
USABLE = ["dosage", "referral", "danger_signs", "procedure", "side_effects", "contraindications", "coverage", "prognosis", "when_to_refer"]
NAMED = 10


def quality_sections(chunks: DataFrame, edges: DataFrame, coverage: DataFrame) -> DataFrame:
    """(section, item, n): everything that a bundle's report tells. chunks: (chunk_id, title, aspects); edges: (src, dst); coverage: (topic, aspect).

    Sections: `chunks` (all, zero aspects, only definition, three or more, usable gaps, named), `aspects` (chunks by
    aspect, repeated ones as often as they stand there), `edges` (all, chunks with edges), `topics` (aspects by topic) and
    `rich`, the first chunks by id with three or more aspects, with their titles (or ids) and aspects as item and their
    place as n. Each chunk gives its marks in one pass over the table; all marks are counted in one grouping.
    """
    aspects = F.coalesce("aspects", F.array().cast("array<string>"))
    n = F.size(aspects)
    mark = lambda section, item: F.struct(F.lit(section).alias("section"), item.alias("item"))
    if_ = lambda says, item: F.when(says, mark("chunks", F.lit(item)))
    own = F.array(if_(F.lit(True), "all"), if_(n == 0, "zero aspects"), if_((n == 1) & (aspects[0] == "definition"), "only definition"), if_(n >= 3, "three or more"), if_(F.arrays_overlap(aspects, F.array(*map(F.lit, USABLE))), "usable gaps"))
    marks = chunks.select(F.inline(F.concat(F.array_compact(own), F.transform(aspects, lambda a: mark("aspects", a)))))
    linked = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"), F.count(F.lit(1)).alias("with"))
    linked = linked.select(F.inline(F.array(F.struct(F.lit("edges").alias("section"), F.lit("all").alias("item"), F.col("all").alias("n")), F.struct(F.lit("edges").alias("section"), F.lit("chunks with edges").alias("item"), F.col("with").alias("n")))))
    topics = coverage.groupBy(F.lit("topics").alias("section"), F.col("topic").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    rich = chunks.filter(n >= 3).orderBy("chunk_id").limit(NAMED)
    line = F.concat(F.coalesce(F.nullif("title", F.lit("")), F.col("chunk_id").cast("string")), F.lit(": ["), F.array_join("aspects", ", "), F.lit("]"))
    named = rich.select(F.lit("rich").alias("section"), line.alias("item"), F.row_number().over(Window.orderBy("chunk_id")).cast("long").alias("n"))
    return marks.groupBy("section", "item").agg(F.count(F.lit(1)).alias("n")).unionByName(linked).unionByName(topics).unionByName(named)


def duration_text(seconds: Column) -> Column:
    return F.when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), (seconds % 60).cast("string"), F.lit("s")))


def pattern_counts(df: DataFrame, text: str, patterns: dict[str, str]) -> DataFrame:
    """One row: how many texts each pattern is found in, and how many none is found in."""
    found = [F.col(text).rlike(p) for p in patterns.values()]
    none = ~functools.reduce(lambda a, b: a | b, found)
    return df.agg(*[F.count_if(f).alias(name) for name, f in zip(patterns, found, strict=True)], F.count_if(none).alias("none"))
