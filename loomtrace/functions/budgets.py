"""Prompts and pages cut to token budgets (Column -> Column)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens a judge can read, tokens kept for its answer and for safety, characters a token stands for.
CONTEXT_TOKENS = 128_000
ANSWER_TOKENS = 256
SAFETY_TOKENS = 2_000
PAGE_CHARS = 3
PROMPT_CHARS = 4
#: Share of a prompt's budget that thoughts may take, the factor by which a history shrinks that does not fit, and how often.
THOUGHT_SHARE = 0.4
SHRINK = 0.85
ROUNDS = 40


def page_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / PAGE_CHARS)


def prompt_tokens(c: Column) -> Column:
    """At least one token, also for an empty text."""
    return F.greatest(F.lit(1), F.floor(F.length(c) / PROMPT_CHARS))


def head_in_context(page: Column, base: Column) -> Column:
    """Beginning of a page that fits beside a prompt of ``base`` tokens; nothing where no room is left."""
    left = F.lit(CONTEXT_TOKENS - ANSWER_TOKENS - SAFETY_TOKENS) - base
    return F.when(left <= 0, F.lit("")).otherwise(F.substring(page, F.lit(1), (left * PAGE_CHARS).cast("int")))


def tail_in_budget(text: Column, tokens: Column) -> Column:
    """End of a text that fits a budget; a budget of nothing leaves nothing."""
    return F.when(tokens <= 0, F.lit("")).otherwise(F.right(text, (tokens * PROMPT_CHARS).cast("int")))


def bounded_prompt(history: Column, current: Column, thoughts: Column, tokens: int) -> Column:
    """History, current text and thoughts within a budget: thoughts keep their end within their share, the history keeps
    its newest entries in a budget that shrinks round by round until all fits, the current text always stays whole."""
    from loomtrace.functions.text import recent_within

    said = tail_in_budget(F.coalesce(thoughts, F.lit("")), F.lit(int(tokens * THOUGHT_SHARE)))
    now = F.coalesce(current, F.lit(""))
    used = F.when(said == "", 0).otherwise(prompt_tokens(said)) + prompt_tokens(now)
    room = F.greatest(F.lit(0), F.lit(tokens) - used)
    # the largest of the shrinking budgets that leaves room; recent_within keeps one entry in any budget, so none is asked of 0
    steps = F.transform(F.sequence(F.lit(0), F.lit(ROUNDS)), lambda i: F.floor(F.lit(float(tokens)) * F.pow(F.lit(SHRINK), i)).cast("int"))
    budget = F.coalesce(F.try_element_at(F.filter(steps, lambda b: b <= room), F.lit(1)), F.lit(0))
    kept = F.when(budget > 0, recent_within(F.coalesce(history, F.array().cast("array<string>")), budget)).otherwise(F.array().cast("array<string>"))
    return F.concat_ws("\n", F.array_join(kept, "\n"), now, F.nullif(said, F.lit("")))


def pieces(text: Column, size: int = 100_000) -> Column:
    """A text in pieces of at most ``size`` characters that end at a space where there is one; joined they give the text."""
    return F.filter(F.regexp_extract_all(text, F.lit(f"((?s).{{1,{size - 1}}}(?:\\s|$)|(?s).{{1,{size}}})"), F.lit(1)), lambda x: x != "")
