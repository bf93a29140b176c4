"""Rounds of a critic: what it is shown of a capability, and what its answers decide under a budget of calls.

A model is no part of this: answers are a table. Each round is a job of its own,
as it needs the answers to the questions that the one before wrote.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Rounds until a refusal is final, calls of a job without a budget of its own.
ROUNDS, CALLS = 3, 60
RULES = ("no_evidence", "evidence_mismatch", "unbounded_param", "state_changing", "injection_detected")


def shown(cited: DataFrame, evidence: DataFrame, most: int = 8) -> DataFrame:
    """What a critic reads of each capability: cap_id, block, sources, forged.

    cited: cap_id, place, id; evidence, each id once: id, source_url, kind,
    selector, raw. A block has the first cited rows that exist, in the order of
    citing, each between delimiters of its own; forged counts the delimiters
    that pages tried to write. Ids are ranked before texts are fetched, so no
    more than `most` texts of a capability travel.
    """
    known = cited.join(evidence.select("id"), "id")
    first = known.withColumn("position", F.row_number().over(Window.partitionBy("cap_id").orderBy("place", "id"))).where(F.col("position") <= most)
    head = T.evidence_head(F.col("kind"), F.col("selector"), F.col("raw"))
    texts = first.select("cap_id", "position", "id").join(evidence.select("id", T.wrapped(head, F.col("source_url"), F.lit("evidence"), F.col("id").cast("string")).alias("text"), T.forged_delimiters(head).alias("forged")), "id")
    parts = F.array_sort(F.collect_list(F.struct("position", "text")))
    return texts.groupBy("cap_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("block"), F.count("*").cast("int").alias("sources"), F.sum("forged").alias("forged"))


def questions(capabilities: DataFrame, blocks: DataFrame, instruction: Column) -> DataFrame:
    """cap_id and prompt of the capabilities (cap_id, rule) that no rule decided; one without evidence has an empty block."""
    open_ = capabilities.where("rule is null")
    return open_.join(blocks, "cap_id", "left").select("cap_id", T.prompt(instruction, F.coalesce("block", F.lit(""))).alias("prompt"))


def judged(capabilities: DataFrame, answers: DataFrame, budget: DataFrame, number: int = 1, rounds: int = ROUNDS) -> DataFrame:
    """Adds outcome, reason, critic_round, final and called to capabilities (job, cap_id, place, rule) and completes rule.

    Each is in one outcome. rejected: by rule; by an answer (cap_id, verdict,
    model_rule, reason), with evidence_mismatch for a rule that isn't known; or
    for want of an answer, which is final. unasked: the calls that a job's
    budget (job, calls_left) leaves were used up by those before it. accepted:
    an answer says so. Null calls_left, and jobs without a budget, have CALLS.
    """
    before = Window.partitionBy("job").orderBy("place", "cap_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = F.sum(F.col("rule").isNull().cast("int")).over(before)  # over the few capabilities of a job
    joined = capabilities.withColumn("_turn", turn).join(budget.select("job", "calls_left"), "job", "left").join(answers.select("cap_id", "verdict", "model_rule", F.col("reason").alias("_said"), F.lit(True).alias("_answered")), "cap_id", "left")
    called = F.col("rule").isNull() & (F.col("_turn") <= F.coalesce("calls_left", F.lit(CALLS)))
    joined = joined.withColumns({"called": called, "_yes": called & (F.lower(T.stripped(F.coalesce("verdict", F.lit("")))) == "accept"), "_lost": called & F.col("_answered").isNull()})
    by_model = F.when(F.col("model_rule").isin(*RULES), F.col("model_rule")).otherwise("evidence_mismatch")
    rejected = F.col("rule").isNotNull() | (F.col("called") & ~F.col("_yes"))
    said = F.coalesce(F.when(T.stripped(F.col("_said")) != "", T.stripped(F.col("_said"))), F.lit("No reason given."))
    return joined.select(
        *(F.col(c) for c in capabilities.columns if c != "rule"),
        F.coalesce("rule", F.when(rejected, by_model)).alias("rule"),
        F.when(F.col("_yes"), "accepted").when(rejected, "rejected").otherwise("unasked").alias("outcome"),
        F.when(F.col("_lost"), "Without an answer nothing was verified, so it does not ship.").when(F.col("called") & ~F.col("_yes"), said).alias("reason"),
        F.lit(number).alias("critic_round"),
        (F.col("_lost") | (rejected & F.lit(number >= rounds))).alias("final"),
        "called",
    )


def calls_left(outcomes: DataFrame, budget: DataFrame) -> DataFrame:
    """The budget (job, calls_left) after a round."""
    used = outcomes.groupBy("job").agg(F.count_if("called").alias("used"))
    return used.join(budget.select("job", "calls_left"), "job", "left").select("job", (F.coalesce("calls_left", F.lit(CALLS)) - F.col("used")).alias("calls_left"))


def again(outcomes: DataFrame) -> DataFrame:
    """Outcomes that a further round may change: refused, but not for good."""
    return outcomes.where((F.col("outcome") == "rejected") & ~F.col("final"))
