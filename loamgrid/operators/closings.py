"""How an answer closes: a line chosen from what is still open, never the same twice in a row.

Whether a turn may say its own line depends on what the turn before said, and so on back to the first. Every turn is
therefore a map of the line before, of the form "after this one say that, after any other say this", and such maps
compose; `scans` leads the last line along each conversation with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamgrid.operators.scans import scanned

# What is asked of an urgent turn, and the line of an intent or gap, with its alternates.
URGENT = "Is the patient stable right now?"
AFFIRMED = "Happy to help with anything else."
PATIENT = "Anything else about this patient?"
BY_INTENT = {
    "DEFINE": "Should I explain what {topic} involves?",
    "SCOPE": "Want the specific protocols or dosages?",
    "PROCEDURE": "Should I go through any of these steps in detail?",
    "REFERRAL": "Need the danger signs that trigger referral?",
}
OTHER_INTENT = "Want to know more about this?"
BY_GAP = {
    "dosage": "Should I give you the specific dose?",
    "referral": "Do you need to know when to refer?",
    "danger_signs": "Want the danger signs to watch for?",
    "procedure": "Shall I walk you through the steps?",
}
OTHER_GAP = "Anything else on this?"
PATIENT_ALTERNATES = ["What else can I help you with for this patient?", "Need anything else for this case?"]
INTENT_ALTERNATES = {
    "DEFINE": ["Would you like more detail on this?", "Anything else you want to know?"],
    "SCOPE": ["Need the step-by-step details?", "Want more specifics?"],
    "PROCEDURE": ["Need clarification on any step?", "Want more detail on any part?"],
    "REFERRAL": ["Anything else about when to refer?", "Need more on the referral criteria?"],
}
GENERIC_ALTERNATES = ["What else can I help you with?", "Is there something specific you would like to know?", "Need more details?", "What would you like to explore next?"]
GAP_ALTERNATES = ["Need more details?", "Want to explore another aspect?"]
LAST_RESORT = "What else can I help you with?"


def _of(table: dict[str, str], key: Column, default: str) -> Column:
    out = F.lit(None)
    for name, line in table.items():
        out = F.when(key == name, line).otherwise(out)
    return F.coalesce(out, F.lit(default))


def own_line(intent: Column, gap: Column, topic: Column, patient: Column) -> Column:
    """The line a turn would say: by its first open gap, else by intent, whether a patient is known, and the topic."""
    about = F.replace(_of(BY_INTENT, intent, OTHER_INTENT), F.lit("{topic}"), F.coalesce(F.nullif(topic, F.lit("")), F.lit("this")))
    return F.when(gap.isNotNull(), _of(BY_GAP, gap, OTHER_GAP)).when(intent == "AFFIRM", AFFIRMED).when(patient, PATIENT).otherwise(about)


def alternate(intent: Column, gap: Column, draw: Column) -> Column:
    """One of the alternates of a gap, else of the intent, else the general ones, by a number drawn for the turn."""
    one = lambda lines: F.get(F.array(*map(F.lit, lines)), F.pmod(draw, F.lit(len(lines))).cast("int"))
    out = F.when(gap.isNotNull(), one(GAP_ALTERNATES))
    for name, lines in INTENT_ALTERNATES.items():
        out = out.when(intent == name, one(lines))
    return out.otherwise(one(PATIENT_ALTERNATES + GENERIC_ALTERNATES))


def closings(turns: DataFrame, *, draw: Column | None = None) -> DataFrame:
    """turns (conv_id, turn, intent, gaps, topic, patient) with closing, the line that each turn ends with.

    gaps: an array, the first counts, an empty or null one has none. A greeting ends with nothing and an urgent turn with
    a question of its own; both leave the last line as it was. A line equal to the last one gives way to an alternate,
    chosen by draw (by default a hash of conversation and turn), and if that is equal too, to a last resort. A null
    intent is like one without a line of its own; a null patient is none.
    """
    gap, intent = F.get(F.coalesce(F.col("gaps"), F.array().cast("array<string>")), F.lit(0)), F.coalesce(F.col("intent"), F.lit(""))
    own = own_line(intent, gap, F.col("topic"), F.coalesce(F.col("patient"), F.lit(False)))
    other = alternate(intent, gap, F.xxhash64("conv_id", "turn") if draw is None else draw)
    other = F.when(other == own, LAST_RESORT).otherwise(other)
    step = F.when(~intent.isin("GREETING", "URGENT"), F.struct(own.alias("seen"), other.alias("same"), own.alias("else")))
    apply = lambda m, last: F.when(last.eqNullSafe(m["seen"]), m["same"]).otherwise(m["else"])
    compose = lambda f, g: F.struct(f["seen"].alias("seen"), apply(g, f["same"]).alias("same"), apply(g, f["else"]).alias("else"))
    said = scanned(turns, "conv_id", ["turn"], step, F.lit(None).cast("string"), apply=apply, compose=compose)
    return said.withColumn("closing", F.when(intent == "GREETING", "").when(intent == "URGENT", URGENT).otherwise(F.col("after"))).drop("before", "after")
