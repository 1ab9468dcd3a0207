"""What an assistant's text is: reasoning, tool markup, promises, status lines, answers. All of it Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import at_least, bound

#: Markup that is not shown.
THINK, OPEN_THINK = r"(?is)<think\b[^>]*>.*?</think>", r"(?is)<think\b[^>]*>.*$"
TOOL_BLOCK, TOOL_OPEN = r"(?is)<(tool_code|tool_call|function_call)\b[^>]*>.*?</(tool_code|tool_call|function_call)>", r"(?i)<(tool_code|tool_call|function_call)\b[^>]*>"
#: A transcript of a tool call, a bare tool word, how a status line and a promise begin.
TRANSCRIPT = r"(?im)(^|\n)\s*(Tool|Tool call|Called Tool)\s*:\s*[A-Za-z_][A-Za-z0-9_.-]*\s*(\n|$)"
TOOL_TAGS = ("<tool_call", "<function_call", "<tool_code")
BARE_TOOL = r"(?i)^(tool|tools|calling\s+tool)\s*[.:]?$"
STATUS = r"(?i)^(retrieving|searching|looking|reading|fetching|loading|processing|analyzing|gathering)\b"
PROMISE_START = r"(?i)^\s*(i('ll| will)|let me)\b"
DUMP_STARTS = (
    "here is a concise summary from the retrieved document", "i can only provide claims directly supported by retrieved chunks", "here are the key points from the retrieved passages",
)
#: Announcements of a search instead of the search.
SEARCH_CUES = (
    "i'll search", "i will search", "i'll search for", "let me search", "i can search", "i'm going to search", "i'll look through", "i will look through", "i'll look up", "i will look up",
    "let me look up", "i'll retrieve", "i will retrieve", "let me retrieve", "i'll check", "i will check", "i'll read the papers", "i will read the papers",
)
SEARCH_PLAN = r"\b(i('ll| will| am going to)|i'm going to|let me)\s+(first\s+)?(search|retrieve|check|scan|read|consult|look up|look through)\b"
PROMISES = (
    r"^i('ll| will)\s+help\b", r"^i('ll| will)\s+explain\b", r"^i('ll| will)\s+walk\s+you\s+through\b", r"^i('ll| will)\s+summarize\b", r"^i('ll| will)\s+answer\b",
    r"^let\s+me\s+(help|explain|walk\s+you\s+through|summarize)\b",
)
#: Words of a request to show an image, captions that say nothing, names of tests that mark a table.
SHOW_CUES = ("show me", "display", "render", "show it", "display it", "in chat", "show image", "display image", "figure", "plot", "graph")
BARE_CAPTIONS = ("", "figure", "image", "untitled")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def without_thinking(text: Column) -> Column:
    """Text without reasoning blocks, closed or still open."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), THINK, ""), OPEN_THINK, "")


def without_tools(text: Column) -> Column:
    """Text without tool-call blocks and opening tags."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), TOOL_BLOCK, ""), TOOL_OPEN, "")


def words(text: Column) -> Column:
    """How many runs of ASCII letters and digits a text has."""
    return F.regexp_count(text, F.lit("[A-Za-z0-9]+"))


def _any(text: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[‘’]", "'")


def transcript(text: Column) -> Column:
    """Whether a text holds a raw tool call."""
    return bound(F.lower(text), lambda low: _any(low, TOOL_TAGS)) | text.rlike(TRANSCRIPT)


def deferred(text: Column) -> Column:
    """Whether a text announces a search, or is a raw tool call, instead of answering."""
    return transcript(text) | bound(_plain(text), lambda one: _any(one, SEARCH_CUES) | one.rlike(SEARCH_PLAN))


def non_answer(text: Column) -> Column:
    """Whether a text is ``deferred``, or a promise of at most 18 words and one sentence."""
    promise = lambda one: (one != "") & one.rlike("|".join(PROMISES)) & ~at_least(one, 19) & (F.regexp_count(one, F.lit("[.!?]")) <= 1)
    return deferred(text) | bound(_plain(_strip(F.regexp_replace(text, r"\s+", " "))), promise)


def status_only(text: Column) -> Column:
    """Whether a text is a status line of at most 18 words, by its first word or by trailing dots (below 15 words)."""
    said = lambda seen: (seen != "") & ~at_least(seen, 19) & (seen.rlike(STATUS) | (seen.rlike(r"(\.\.\.|…)$") & ~at_least(seen, 15)))
    return bound(_strip(without_thinking(text)), said)


def interim(text: Column) -> Column:
    """Whether a text is work in progress: a status line, markup, a list of passages, an announcement."""

    def marked(bare: Column) -> Column:
        dump = lambda low: F.exists(F.array(*map(F.lit, DUMP_STARTS)), lambda start: F.startswith(low, start))
        return bare.rlike(BARE_TOOL) | bound(F.lower(bare), dump)

    judged = lambda seen: (seen != "") & (status_only(seen) | bound(_strip(without_thinking(without_tools(seen))), marked) | deferred(seen))
    return bound(_strip(without_thinking(text)), judged)


def displayable(text: Column) -> Column:
    """Whether a text may be shown as an answer: not interim, and at least two words (which every other way to qualify implies)."""
    return bound(_strip(without_thinking(text)), lambda seen: (seen != "") & ~interim(seen) & at_least(seen, 2))


def shown(text: Column) -> Column:
    """What is shown of a finished answer: its text without reasoning and tools if that is displayable, else nothing."""
    return bound(without_tools(without_thinking(text)), lambda seen: F.when(displayable(seen), seen).otherwise(""))


def streamed(text: Column) -> Column:
    """What is shown of an answer that is still coming in: nothing while it is interim, a promise of under 40 words, or looks like a tool call."""

    def hidden(bare: Column) -> Column:
        begins = (bare != "") & bare.rlike(PROMISE_START) & ~at_least(bare, 40)
        call = F.contains(F.lower(bare), F.lit("<tool")) | bare.rlike(r'\{\s*"(name|tool_name)"\s*:') | (F.contains(F.lower(bare), F.lit('"arguments"')) & ~at_least(bare, 80))
        return begins | call

    return bound(without_tools(without_thinking(text)), lambda seen: F.when(interim(seen) | bound(_strip(seen), hidden), "").otherwise(seen))


def has_image(text: Column) -> Column:
    """Whether a text shows an image in markdown."""
    return text.rlike(r"!\[[^\]]*\]\([^)]+\)")


def open_image(text: Column) -> Column:
    """Whether a text ends inside an image's markdown."""
    return text.rlike(r"!\[[^\]]*\]\([^)]*$")


def asks_for_image(text: Column) -> Column:
    """Whether a message asks to see something."""
    return _any(F.lower(text), SHOW_CUES)


def caption_shown(caption: Column, useful: Column) -> Column:
    """Whether a figure's caption is worth showing: a label with its number, a ``useful`` sentence, or short text without much punctuation."""
    one = _strip(F.replace(caption, F.lit("\n"), F.lit(" ")))
    odd, letters = F.regexp_count(one, F.lit(r"[^\w\s]")), F.regexp_count(one, F.lit("[A-Za-z]"))
    plain = (odd <= F.greatest(F.lit(3), F.floor(F.length(one) / 6))) & (words(one) >= 1) & (letters >= 3) & (F.length(one) <= 120)
    return ~F.lower(one).isin(*BARE_CAPTIONS) & (one.rlike(r"(?i)^(figure|fig\.?)\s*\d+[A-Za-z0-9.-]*$") | useful | plain)


def is_evidence(role: Column, text: Column) -> Column:
    """Whether a message holds a tool's result: a user's turn whose first line says so."""
    line = F.substring_index(F.substring(F.regexp_replace(text, r"^\s+", ""), 1, 160), "\n", 1)
    said = lambda x: (F.startswith(x, F.lit("Tool ")) & F.contains(x, F.lit("result:"))) | F.startswith(x, F.lit("Tool:"))
    return (role == "user") & bound(line, said)
