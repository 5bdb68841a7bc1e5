"""The judge's guards and its loop of salted votes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import DIMENSIONS, judge_scores, normalized_candidate, passes_floor, vote_salt


def guard(n_votes: int, judge_model: str, answering: Sequence[str]) -> None:
    """Votes are odd and three or more, and a judge does not judge its own answers."""
    if n_votes < 3 or n_votes % 2 == 0:
        raise ValueError(f"the number of votes must be odd and 3 or more, not {n_votes}")
    if judge_model in answering:
        raise ValueError(f"{judge_model} answers in this benchmark and may not judge it")


def judged(candidates: DataFrame, respond: Callable[[Column, Column], Column], *, judge_model: str, answering: Sequence[str], run: str, n_votes: int = 3, rubric: str = "Judge the candidate against the reference.") -> DataFrame:
    """``candidates`` (task_id, question, reference, candidate, scoring) with votes, pass_count, correct, raw and trace_uri.

    Each vote's prompt ends in a salt of its own, so that none is answered from a cache. An answer that is no
    JSON of scores counts as all zero and does not pass. A task of another scorer is an error.
    """
    guard(n_votes, judge_model, answering)
    scorer = F.when(F.col("scoring") == "llm_judge", F.col("scoring")).otherwise(F.raise_error(F.concat(F.lit("not for a judge: "), "task_id")).cast("string"))
    text = F.concat(F.lit(rubric + "\n\nQuestion: "), "question", F.lit("\nReference: "), "reference", F.lit("\nCandidate: "), normalized_candidate(F.col("candidate")))

    def vote(k: Column) -> Column:
        prompt = F.concat("_prompt", F.lit("\n\n[vote-salt: "), vote_salt(F.col("task_id"), k, F.lit(run)), F.lit("]"))
        return F.struct(k.alias("vote"), prompt.alias("prompt"), respond(prompt, k).alias("response"))

    def scored(v: Column) -> Column:
        scores = judge_scores(v["response"])
        dims = [F.coalesce(scores[d], F.lit(0)).alias(d) for d in DIMENSIONS]
        return F.struct(v["vote"].alias("vote"), v["prompt"].alias("prompt"), v["response"].alias("response"), *dims, scores.isNull().alias("parse_error"), passes_floor(scores).alias("passed"))

    votes = F.transform(F.transform(F.sequence(F.lit(0), F.lit(n_votes - 1)), vote), scored)
    out = candidates.withColumn("scorer", scorer).withColumn("_prompt", text).withColumn("votes", votes)
    out = out.withColumn("pass_count", F.size(F.filter("votes", lambda v: v["passed"])))
    return out.withColumn("correct", F.col("pass_count") > n_votes // 2).withColumn("raw", F.col("pass_count") / n_votes).withColumn("trace_uri", F.lit(f"{run}.jsonl")).drop("_prompt")
