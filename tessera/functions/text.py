"""Text functions: tokenisers, sentence and span helpers, prompts, judge output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tokenisers' patterns.
WORD_PATTERN = r"[A-Za-z_][A-Za-z0-9_]*|[A-Za-z0-9]+"
LABEL_PATTERN = r"[A-Za-z][A-Za-z0-9]+"
IDENTIFIER_PATTERN = r"\b[A-Za-z_][A-Za-z0-9_]{2,}\b"
CASE_PARTS_PATTERN = r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+"
#: The offline reference counter; any other Column -> Column counter can be passed instead.
COUNTER_PATTERN = r"[A-Za-z]+|[0-9]{1,3}|[^\sA-Za-z0-9]"

# Phrases in a candidate that address the judge.
INJECTION_PATTERNS = (
    r"\b(?:Score|Verdict)\s*:\s*PASS\b",
    r"\bNote\s+to\s+(?:evaluator|grader|judge|reviewer)\b",
    r"\bthe\s+candidate(?:\s+answer)?\s+(?:is|above\s+is)\s+correct\b",
    r"\bplease\s+score\s+this\s+(?:as|with)\s+(?:PASS|2/2|max(?:imum)?)\b",
    r"\bignore\s+(?:previous|prior)\s+instructions\b",
    r"\bConfidence\s*:\s*1\.0\b",
)
INJECTION = "(?i)" + "|".join(INJECTION_PATTERNS)

#: Judge dimensions and the score each must reach.
DIMENSIONS = ("correctness", "completeness", "faithfulness")
PASS_FLOOR = {"correctness": 1, "completeness": 1, "faithfulness": 1}


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def token_list(text: Column) -> Column:
    return _all(text, COUNTER_PATTERN)


def count_tokens(text: Column) -> Column:
    """Length in tokens of the offline counter; empty and null texts count 0."""
    return F.coalesce(F.regexp_count(text, F.lit(COUNTER_PATTERN)), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Lower-cased words of the ranking tokeniser."""
    return F.transform(_all(text, WORD_PATTERN), lambda t: F.lower(t))


def case_parts(text: Column) -> Column:
    """Parts of a camel- or snake-case name, lower-cased, 3 to 30 characters long."""
    return F.filter(F.transform(_all(text, CASE_PARTS_PATTERN), lambda t: F.lower(t)), lambda t: F.length(t).between(3, 30))


def label_tokens(label: Column) -> Column:
    """Distinct tokens of a node label: words and, as they are lower-cased first, their runs of letters."""
    words = F.array_distinct(F.transform(_all(label, LABEL_PATTERN), lambda t: F.lower(t)))
    parts = F.flatten(F.transform(words, lambda t: _all(t, "[a-z]+")))
    return F.filter(F.array_distinct(F.concat(words, parts)), lambda t: F.length(t).between(3, 30))


def identifiers(text: Column) -> Column:
    return F.array_distinct(_all(text, IDENTIFIER_PATTERN))


def first_sentence(doc: Column, limit: int) -> Column:
    """Up to the end of the first sentence if it ends before ``limit``, else the first ``limit`` characters.

    White space is collapsed first; sentence ends are tried in a fixed order, not by place.
    """
    flat = F.btrim(F.regexp_replace(F.coalesce(doc, F.lit("")), r"\s+", " "))
    ends = [F.instr(flat, end) for end in (". ", "? ", "! ")]
    found = F.coalesce(*[F.when((at > 1) & (at <= limit), at) for at in ends])
    return F.when(found.isNotNull(), F.substr(flat, F.lit(1), found)).otherwise(F.substr(flat, F.lit(1), F.lit(limit)))


def contains_answer(output: Column, needle: Column, gold: Column) -> Column:
    """Whether an output holds the needle, or the gold answer where there is none, in any case."""
    wanted = F.lower(F.coalesce(F.nullif(needle, F.lit("")), gold))
    return F.coalesce(F.contains(F.lower(output), wanted), F.lit(False))


def injected(text: Column) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(INJECTION)), F.lit(False))


def injection_evidence(text: Column) -> Column:
    """30 characters to either side of the first phrase that addresses the judge, on one line."""
    at = F.regexp_instr(text, F.lit(INJECTION))
    size = F.length(F.regexp_extract(text, INJECTION, 0))
    begin = F.greatest(at - 30, F.lit(1))
    return F.replace(F.substr(text, begin, at + size + 30 - begin), F.lit("\n"), F.lit(" "))


def render_prompt(instruction: str, context: Column, question: Column) -> Column:
    return F.concat(F.lit(f"{instruction}\n\n<context>\n"), context, F.lit("\n</context>\n\nQuestion: "), question, F.lit("\nAnswer:"))


def context_of(prompt: Column) -> Column:
    """What stands between a prompt's context tags."""
    return F.regexp_extract(prompt, r"(?s)<context>\n(.*?)\n</context>", 1)


def gold_line(prompt: Column) -> Column:
    """The first line that starts with GOLD:, without that mark."""
    return F.btrim(F.regexp_extract(prompt, r"(?m)^GOLD:(.*)$", 1))


def judge_scores(output: Column) -> Column:
    """The three scores of a judge's JSON, taken from the first to the last brace; null if it is not
    valid: no JSON, a missing score or one that is not a whole number from 0 to 2."""
    blob = F.try_parse_json(F.nullif(F.regexp_extract(output, r"(?s)\{.*\}", 0), F.lit("")))
    raw = [F.try_variant_get(blob, f"$.{d}", "string") for d in DIMENSIONS]
    fits = raw[0].isin("0", "1", "2")
    for score in raw[1:]:
        fits = fits & score.isin("0", "1", "2")
    return F.when(fits, F.struct(*[score.cast("int").alias(d) for d, score in zip(DIMENSIONS, raw, strict=True)]))


def passes_floor(scores: Column, floor: dict[str, int] = PASS_FLOOR) -> Column:
    """Whether every score reaches its floor; a missing one is 0, missing scores do not pass."""
    out = scores.isNotNull()
    for dim, least in floor.items():
        out = out & (F.coalesce(scores[dim], F.lit(0)) >= least)
    return F.coalesce(out, F.lit(False))


def vote_salt(task_id: Column, vote: Column, salt: Column) -> Column:
    return F.substr(F.sha2(F.concat_ws("|", salt, task_id, vote.cast("string")), 256), F.lit(1), F.lit(16))


def normalized_candidate(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def short_model(model: Column) -> Column:
    return F.substring_index(model, ".", -1)


def task_family(task_id: Column) -> Column:
    return F.when(F.startswith(task_id, F.lit("needle-")), F.lit("needle")).otherwise(F.lit("swe_qa"))


def repo_of_task(task_id: Column) -> Column:
    """The repository of needle-REPO-NNNN, or the id itself."""
    parts = F.split(task_id, "-")
    return F.when(F.startswith(task_id, F.lit("needle-")), F.get(parts, F.lit(1))).otherwise(task_id)
