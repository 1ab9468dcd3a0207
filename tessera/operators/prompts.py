"""Prompts within a context window: token estimates, reserves, header dedupe, shortening, trimming."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.speech import is_evidence

#: Tokens of a prompt and of a message besides their text; share, least and most of the guard and of the estimator's pad.
PROMPT_TOKENS, MESSAGE_TOKENS = 12, 6
GUARD, PAD = (0.015, 96, 4096), (0.0075, 64, 2048)
#: Least room for a prompt, least completion with and without tools, trimming rounds, characters cut for a token, the note that stands for what is gone.
LEAST_PROMPT, LEAST_COMPLETION, ROUNDS, CUT_CHARS, LEAST_CUT, TRIMMED = 256, (128, 256), 32, 12, 128, "[Earlier context trimmed due to token limit.]"
#: Lines of a header that may repeat, characters from which a turn is shortened, the note after it.
HEADER_LINES, SHORTEN_FROM, SHORTENED = (2, 16), 500, "\n[Context shortened.]"


def message_tokens(role: Column, content: Column, count: Callable[[Column], Column] = T.token_estimate) -> Column:
    """Estimated tokens of a message; ``count`` is a tokenizer, a quarter of the length unless given."""
    return F.lit(MESSAGE_TOKENS) + count(role) + count(content)


def prompt_tokens(messages: DataFrame, count: Callable[[Column], Column] = T.token_estimate) -> DataFrame:
    """Estimated tokens of each conversation's prompt (conv_id, role, text)."""
    return messages.groupBy("conv_id").agg((F.lit(PROMPT_TOKENS) + F.sum(message_tokens(F.col("role"), F.col("text"), count))).cast("long").alias("tokens"))


def reserve(limit: Column) -> tuple[Column, Column]:
    """Tokens kept free of a context window as a guard and for the estimator's error."""
    part = lambda p: F.least(F.lit(p[2]), F.greatest(F.lit(p[1]), F.floor(limit * F.lit(p[0]))))
    return part(GUARD), part(PAD)


def pinned(messages: DataFrame, last: int = 2) -> DataFrame:
    """Turns (conv_id, turn, role, text, has_calls) kept whatever the budget: conv_id, turn, pinned.

    The last turn; the tools' results right before it with the assistant's turn that asked
    for them; and all from the ``last``-th user's own turn from the end on.
    """
    back = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    upto = back.rowsBetween(Window.unboundedPreceding, 0)
    rows = messages.withColumn("evidence", is_evidence(F.col("role"), F.col("text"))).withColumn("back", F.row_number().over(back))
    rows = rows.withColumn("others", F.sum(F.when((F.col("back") > 1) & ~F.col("evidence"), 1).otherwise(0)).over(upto))
    rows = rows.withColumn("results", F.max(F.when((F.col("back") == 2) & F.col("evidence"), 1).otherwise(0)).over(Window.partitionBy("conv_id")))
    rows = rows.withColumn("users", F.sum(((F.col("role") == "user") & ~F.col("evidence")).cast("int")).over(upto))
    own = (F.col("role") == "user") & ~F.col("evidence")
    cut = F.max(F.when(own & (F.col("users") <= last), F.col("back"))).over(Window.partitionBy("conv_id"))
    tail = (F.col("back") == 1) | ((F.col("results") == 1) & (F.col("back") > 1) & ((F.col("others") == 0) | ((F.col("others") == 1) & ~F.col("evidence") & (F.col("role") == "assistant") & F.col("has_calls"))))
    return rows.select("conv_id", "turn", (tail | F.coalesce(F.col("back") <= cut, F.lit(False))).alias("pinned"))


def dedupe_headers(messages: DataFrame) -> DataFrame:
    """Neighbouring tools' results (conv_id, turn, role, text) without the first 2 to 16 lines that they share with the one before, as that one was left: conv_id, turn, text.

    A turn that no longer begins with a tool's header is no result to the next one. What a turn
    loses depends on what the turn before it lost, so this is a fold over each conversation.
    """

    def headed(text: str) -> bool:
        line = text.lstrip()[:160].split("\n", 1)[0]
        return line.startswith("Tool:") or line.startswith("Tool ") and "result:" in line

    def fold(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("turn")
        texts, flags = list(batch["text"]), list(batch["evidence"])
        for i in range(1, len(texts)):
            if flags[i - 1] and flags[i]:
                above, here = texts[i - 1].splitlines(), texts[i].splitlines()
                same = next((k for k, (x, y) in enumerate(zip(above, here)) if x != y), min(len(above), len(here)))
                if same >= HEADER_LINES[0]:
                    texts[i] = "\n".join(here[min(same, HEADER_LINES[1]) :])
                    flags[i] = headed(texts[i])
        return pd.DataFrame({"conv_id": batch["conv_id"], "turn": batch["turn"], "text": texts})

    rows = messages.select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(is_evidence(F.col("role"), F.col("text")), F.lit(False)).alias("evidence"))
    return rows.groupBy("conv_id").applyInPandas(fold, "conv_id long, turn long, text string")


def collapse(text: Column) -> Column:
    """Runs of four or more line breaks make all runs of three or more two."""
    return F.when(text.rlike("\n{4,}"), F.regexp_replace(text, "\n{3,}", "\n\n")).otherwise(text)


def shorten(text: Column) -> Column:
    """The first two sentences of a long text with a note, where that saves anything."""
    whole = F.regexp_replace(text, r"^\s+|\s+$", "")
    parts = F.split(F.regexp_replace(whole, r"([.!?])\s+", "$1\x00"), "\x00")
    short = F.array_join(F.slice(parts, 1, 2), " ")
    return F.when((F.length(text) >= SHORTEN_FROM) & (F.size(parts) > 2) & (F.length(short) + 24 < F.length(text)), F.concat(short, F.lit(SHORTENED))).otherwise(text)


def shorten_least(messages: DataFrame) -> DataFrame:
    """``shorten`` for turns (conv_id, turn, role, text, salience) whose salience is at most their conversation's upper median, tools' results aside."""
    w = Window.partitionBy("conv_id")
    n, rank = F.count("*").over(w), F.row_number().over(w.orderBy("salience"))
    rows = messages.withColumn("n", n).withColumn("rank", rank)
    rows = rows.withColumn("median", F.min(F.when(F.col("rank") > F.floor(F.col("n") / 2), F.col("salience"))).over(w))
    cut = (F.col("salience") <= F.col("median")) & ~F.coalesce(is_evidence(F.col("role"), F.col("text")), F.lit(False))
    return rows.select("conv_id", "turn", F.when(cut, shorten(F.col("text"))).otherwise(F.col("text")).alias("text"))


def preflight(messages: DataFrame, limit: int, completion: int, slack: int = 0, tools: bool = False) -> DataFrame:
    """Each conversation's messages (conv_id, turn, role, text) trimmed to fit: conv_id, turn, text, max_tokens.

    The first message stays; after it the oldest go while the prompt is too long and more
    than two messages are left, at most 32. If two are left and still too long, the second
    loses characters from its front. What room remains bounds the completion. Nothing
    is trimmed where there is no room for a prompt at all.
    """
    guard, pad = (min(p[2], max(p[1], int(limit * p[0]))) for p in (GUARD, PAD))
    free, least = limit - guard - pad - slack, LEAST_COMPLETION[0 if tools else 1]
    budget = free - completion
    if budget < LEAST_PROMPT and 0 < max(least, free - LEAST_PROMPT) < completion:
        completion = max(least, free - LEAST_PROMPT)
        budget = free - completion
    w = Window.partitionBy("conv_id")
    rows = messages.select("conv_id", "turn", "text", message_tokens(F.col("role"), F.col("text")).alias("cost"), (F.row_number().over(w.orderBy("turn")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    if budget <= 0 or completion <= 0 or limit <= 0:
        return rows.select("conv_id", "turn", "text", F.lit(completion).cast("long").alias("max_tokens"))
    gone = F.coalesce(F.sum(F.when(F.col("i") > 0, F.col("cost"))).over(w.orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("left", F.lit(PROMPT_TOKENS) + F.sum("cost").over(w) - gone)
    rows = rows.where(~((F.col("i") > 0) & (F.col("i") < F.col("n") - 1) & (F.col("i") <= ROUNDS) & (F.col("left") > budget)))
    rows = rows.withColumn("total", F.lit(PROMPT_TOKENS) + F.sum("cost").over(w)).withColumn("rest", F.count("*").over(w))
    cut = F.greatest(F.lit(LEAST_CUT), (F.col("total") - budget) * CUT_CHARS)
    shorter = F.when(F.length("text") <= cut, F.lit(TRIMMED)).otherwise(F.substring(F.col("text"), cut.cast("int") + 1, F.length("text")))
    trims = (F.col("i") > 0) & (F.col("rest") == 2) & (F.col("total") > budget) & (F.length("text") > 0) & (F.col("n") - F.col("rest") < ROUNDS)
    rows = rows.withColumn("after", F.when(trims, shorter).otherwise(F.col("text")))
    saved = F.when(trims, T.token_estimate(F.col("text")) - T.token_estimate(F.col("after"))).otherwise(0)
    rows = rows.withColumn("total", F.col("total") - F.sum(saved).over(w))
    room = F.lit(free) - F.col("total")
    tokens = F.when((F.col("total") > budget) & (room >= least) & (room < completion), room).otherwise(completion)
    return rows.select("conv_id", "turn", F.col("after").alias("text"), tokens.cast("long").alias("max_tokens"))


#: Tokens of history and of tools' results, least of both, tokens left aside, least room that is shared out.
HISTORY, RESULTS, LEAST_HISTORY, LEAST_RESULTS, SLACK, LEAST_SHARED = 12_000, 1_400, 256, 128, 384, 256


def budgets(limit: int, completion: int, system: int, slack: int = SLACK, history: int = HISTORY, results: int = RESULTS) -> tuple[int, int, int]:
    """Tokens for a whole prompt, for history and for tools' results; the first is 0 where nothing can be packed. The two parts share what the system's message leaves as their own sizes ask."""
    guard, pad = (min(p[2], max(p[1], int(limit * p[0]))) for p in (GUARD, PAD))
    whole = max(0, limit - completion - guard - pad - slack) if limit > 0 and completion > 0 else 0
    own, tool = max(LEAST_HISTORY, history), max(LEAST_RESULTS, results)
    free = whole - PROMPT_TOKENS - system
    free = free if free >= LEAST_SHARED else max(LEAST_SHARED, whole // 2)
    return whole, max(LEAST_HISTORY, int(own * free / (own + tool))), max(LEAST_RESULTS, int(tool * free / (own + tool)))


def staged(messages: DataFrame, salience: DataFrame) -> DataFrame:
    """Messages with texts made shorter where that loses least: repeated headers, runs of line breaks, then all but the first sentences of turns of low salience (conv_id, turn, salience), where there is one."""
    cut = dedupe_headers(messages).withColumn("text", collapse(F.col("text")))
    rows = messages.drop("text").join(cut, ["conv_id", "turn"]).join(salience, ["conv_id", "turn"], "left")
    some = rows.where("salience IS NOT NULL")
    return rows.drop("text").join(shorten_least(some).unionByName(rows.where("salience IS NULL").select("conv_id", "turn", "text")), ["conv_id", "turn"])


def pack(messages: DataFrame, salience: DataFrame, limit: int, completion: int, system: int = 0, last: int = 2, **sizes: int) -> DataFrame:
    """Messages (conv_id, turn, role, text, has_calls) that fit three budgets: conv_id, turn, text, before_tokens, after_tokens.

    After ``staged``, what isn't ``pinned`` goes by rising salience, then age: tools' results until
    they fit theirs, the rest until it fits its own, then either until the whole prompt fits. A turn goes if what would be
    left without those before it is still too much, so each step is a running sum in that
    order. ``system``: tokens of the system's message. With no room for a prompt nothing changes.
    """
    whole, own, tool = budgets(limit, completion, system, **sizes)
    tokens = lambda: message_tokens(F.col("role"), F.col("text"))
    talk = Window.partitionBy("conv_id")
    base = PROMPT_TOKENS + system
    before = messages.groupBy("conv_id").agg((F.sum(tokens()) + base).cast("long").alias("before_tokens"))
    if whole <= 0:
        return messages.select("conv_id", "turn", "text").join(before, "conv_id").withColumn("after_tokens", F.col("before_tokens"))
    rows = staged(messages, salience)
    rows = rows.join(pinned(rows, last), ["conv_id", "turn"]).withColumn("cost", tokens()).withColumn("evidence", F.coalesce(is_evidence(F.col("role"), F.col("text")), F.lit(False)))

    def fit(rows: DataFrame, part: list[str], fixed: int, most: Column) -> DataFrame:
        """Without the first turns, in the order in which they go, whose departure still leaves more than ``most``."""
        group = Window.partitionBy(*part)
        gone = F.coalesce(F.sum("cost").over(group.orderBy("pinned", F.coalesce("salience", F.lit(0.0)), "turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return rows.withColumn("left", F.sum("cost").over(group) + fixed - gone).where(F.col("pinned") | (F.col("left") <= most)).drop("left")

    rows = fit(rows, ["conv_id", "evidence"], PROMPT_TOKENS, F.when(F.col("evidence"), tool).otherwise(own))
    rows = fit(rows, ["conv_id"], base, F.lit(whole))
    after = (F.sum("cost").over(talk) + base).cast("long")
    return rows.select("conv_id", "turn", "text", after.alias("after_tokens")).join(before, "conv_id").select("conv_id", "turn", "text", "before_tokens", "after_tokens")


def summary_prompt(evidence: DataFrame, request: DataFrame, most: int = 8) -> DataFrame:
    """Prompt for a summary of the best evidence (conv_id, n, source, text) under the user's last request (conv_id, text): conv_id, prompt. The model's call is the caller's."""
    lines = evidence.where(F.col("n") <= most).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "source", "text"))), lambda x: F.concat(x["n"].cast("string"), F.lit(". ["), x["source"], F.lit("] "), x["text"])), "\n").alias("lines"))
    asked = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.lit("Summarize the key points from these retrieved document excerpts."))
    return lines.join(request.select("conv_id", "text"), "conv_id", "left").select("conv_id", F.concat(F.lit("User request: "), asked, F.lit("\n\nEvidence snippets:\n"), F.col("lines")).alias("prompt"))
