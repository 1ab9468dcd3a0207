"""Text functions as Catalyst expressions; lengths and positions count code points."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marker after a cut tool text.
CUT_MARK = "... [truncated]"

#: Words that carry no entity, names that stand for the two speakers, other names of relations, relations that say nothing.
SEED_STOP_WORDS = (
    "about", "and", "are", "do", "for", "from", "have", "how", "into", "me", "remember", "tell", "that", "the", "their", "them", "they", "this", "use", "what", "who", "with", "you", "your",
)
SPEAKERS = {"assistant": "assistant", "me": "user", "myself": "user", "the assistant": "assistant", "the user": "user", "user": "user"}
RELATIONS = {"likes": "PREFERS", "prefers": "PREFERS", "profession": "PROFESSION", "uses": "USES", "work_on": "WORKS_ON", "working_on": "WORKS_ON", "works_on": "WORKS_ON"}
WEAK_RELATIONS = ("HAS", "IS", "NAME", "RELATED_TO")
#: Words that are no search term of their own.
TERM_STOP_WORDS = ("about", "after", "answer", "before", "could", "document", "documents", "explain", "information", "selected", "should", "through", "where", "which", "would")
#: Patterns of a request to remember, and of talk about remembering.
REMEMBER, REMEMBER_THAT = r"(?i)^(please )?remember( this)?( going forward)? ?[:,-]? ?", r"(?i)^that "
LOW_VALUE = r"(?i)^user asked to remember:|^remembered context:|\byou should remember this\b|\bremember this\b|\bi('| a)?ll remember that\b|\bkeep that in mind\b"
LOW_VALUE_WORDS = ("", "this", "that", "it", "remember this", "remember that")
#: Category cues in the order they are tried; the first are prefixes.
FACT_PREFIXES = ("i prefer", "i like", "i want", "i need")
FACT_CUES = (
    ("project", ("we use", "our stack", "project", "memory", "tool", "database", "qdrant", "memgraph")),
    ("tone", ("tone", "style", "concise", "verbose")),
    ("goals", ("goal", "working on", "building", "trying to")),
)
#: What a user says of themselves, and what asks to remember.
FACT_PATTERNS = (
    r"\bi prefer\b.+", r"\bi like\b.+", r"\bcall me\b.+", r"\bmy name is\b.+", r"\bi work on\b.+", r"\bi am working on\b.+", r"\bour stack is\b.+", r"\bwe use\b.+", r"\bthe project is\b.+",
)
REMEMBER_CUES = ("remember", "going forward", "from now on")


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once a row; as a plain expression it would be worked out again wherever ``then`` names it."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def at_least(text: Column, words: int) -> Column:
    """Whether a text has so many runs of ASCII letters and digits; reads no further than these."""
    return text.rlike(rf"^(?:[^A-Za-z0-9]*+[A-Za-z0-9]++){{{words}}}")


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f\x0B]+", " "))


def drop_nul(text: Column) -> Column:
    """Text without NUL characters, which text columns of other stores reject."""
    return F.replace(text, F.lit("\x00"), F.lit(""))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased words (letters and digits), each padded by two spaces before and one after."""
    words = F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    return F.array_distinct(F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))))


def similarity(a: Column, b: Column) -> Column:
    """Share of the trigrams of two sets that are in both; 0 without trigrams."""
    both = F.size(F.array_intersect(a, b))
    whole = F.size(a) + F.size(b) - both
    return F.when(whole > 0, both / whole).otherwise(0.0)


def token_estimate(text: Column) -> Column:
    """A quarter of the length, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("long")


def lexical_words(text: Column) -> Column:
    """Distinct lower-cased runs of three or more ASCII letters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w) >= 3))


def lexical_overlap(a: Column, b: Column) -> Column:
    """Cosine of two word sets; 0 if either is empty."""
    return bound(lexical_words(a), lambda p: overlap_with(p, b))


def overlap_with(p: Column, b: Column) -> Column:
    """``lexical_overlap`` of a set of words and a text."""
    score = lambda q: F.when((F.size(p) > 0) & (F.size(q) > 0), F.size(F.array_intersect(p, q)) / F.greatest(F.lit(1.0), F.sqrt(F.size(p)) * F.sqrt(F.size(q)))).otherwise(0.0)
    return bound(lexical_words(b), score)


def citation_boost(text: Column) -> Column:
    """0.15 for a bracketed number, 0.2 for a DOI, 0.05 for a year of 1900-2099."""
    # What stands before is looked at where the digits are found, not at every character.
    doi = text.rlike(r"10\.(?<![A-Za-z0-9_]10\.)[0-9]{4,}/[^ \t\r\n]") | text.rlike("[dD][oO][iI]:")
    year = text.rlike(r"(?:19|20)(?<![A-Za-z0-9_](?:19|20))[0-9]{2}(?![A-Za-z0-9_])")
    return F.when(text.rlike(r"\[[0-9]+\]"), 0.15).otherwise(0.0) + F.when(doi, 0.2).otherwise(0.0) + F.when(year, 0.05).otherwise(0.0)


def first_sentence(text: Column, most: int = 260) -> Column:
    """Up to the first ``.``, ``!`` or ``?`` before white space or the end; a longer one is cut to ``most`` characters with dots after them."""
    found = lambda one: bound(F.regexp_extract(one, r"^(.+?[.!?])( |$)", 1), lambda head: F.when(head == "", one).otherwise(head))
    cut_ = lambda head: F.when(F.length(head) > most, F.concat(F.rtrim(F.substring(head, 1, most)), F.lit("..."))).otherwise(head)
    return bound(bound(squeeze(text), found), cut_)


def unhyphenate(text: Column) -> Column:
    """Joins words that a line wrap has split at a hyphen."""
    return F.regexp_replace(text, r"([A-Za-z])-[ \t\r\n]+([A-Za-z])", "$1$2")


#: Names of which a useful sentence holds at most one.
BENCHMARK_NAMES = ("mmlu", "bbh", "gsm8k", "triviaqa", "humaneval", "mbpp", "cmath")


def useful_sentence(text: Column) -> Column:
    """Begins with a capital, a double quote or a bracket; at least 10 words and 40 letters, at most 8 % digits and 45 % capitals among its letters; at most one of the benchmarks' names."""
    only = lambda x, others: F.regexp_replace(x, f"[{others}]+", "")

    def judged(one: Column) -> Column:
        named = bound(F.lower(one), lambda low: sum((F.contains(low, F.lit(n)).cast("int") for n in BENCHMARK_NAMES), F.lit(0)))
        capitals = lambda letters: (F.length(letters) >= 40) & (F.length(only(letters, "a-z")) <= 0.45 * F.length(letters))
        return one.rlike('^[A-Z"(]') & at_least(one, 10) & bound(only(one, "^A-Za-z"), capitals) & (F.length(only(one, "^0-9")) <= 0.08 * F.length(one)) & (named < 2)

    return bound(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""), judged)


def snippet(text: Column, most: int = 420) -> Column:
    """Up to two useful sentences of the rejoined text, the second only while the first is shorter than ``most``; else a useful first sentence; a cut one ends with dots."""
    parts = lambda good: F.array_join(F.when(F.length(F.get(good, F.lit(0))) >= most, F.slice(good, 1, 1)).otherwise(F.slice(good, 1, 2)), " ")
    first = lambda whole: bound(first_sentence(whole, most), lambda x: F.when(useful_sentence(x), x).otherwise(""))
    cut_ = lambda out: F.when(F.length(out) > most, F.concat(F.rtrim(F.substring(out, 1, most)), F.lit("..."))).otherwise(out)

    def found(whole: Column) -> Column:
        good = F.filter(F.split(F.regexp_replace(whole, r"([.!?]) ", "$1\n"), "\n"), useful_sentence)
        return bound(bound(good, parts), lambda some: F.when(some != "", some).otherwise(first(whole)))

    return bound(bound(squeeze(unhyphenate(text)), found), cut_)


def cut(text: Column, most: int = 1500) -> Column:
    """At most ``most`` characters; a cut text ends with a marker."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most)), F.lit(CUT_MARK))).otherwise(text)


def citation(doc_id: Column, chunk: Column) -> Column:
    """``[doc:<id> chunk:<n>]``."""
    return F.concat(F.lit("[doc:"), doc_id.cast("string"), F.lit(" chunk:"), chunk.cast("string"), F.lit("]"))


def citations(text: Column) -> Column:
    """All citation tokens of a text, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\[doc:[A-Za-z0-9-]+ chunk:[0-9]+\])"), F.lit(1)))


def title_key(text: Column) -> Column:
    """Lower-cased, squeezed title without a ``- Figure`` ending."""
    return F.lower(squeeze(F.split(text, r" - Figure ").getItem(0)))


def conversation_title(text: Column) -> Column:
    """The first eight words without quotes, stars and punctuation around them, first letter upper-case, dots where there are more; ``Conversation`` without words."""
    one = squeeze(F.coalesce(text, F.lit("")))
    for mark in ('"', "'", r"\*"):
        one = F.regexp_replace(one, f"^{mark}+|{mark}+$", "")
    one = F.regexp_replace(F.trim(one), r"^[.,:;!? -]+|[.,:;!? -]+$", "")
    words = F.split(one, " ")
    some = F.concat(F.array_join(F.slice(words, 1, 8), " "), F.when(F.size(words) > 8, "...").otherwise(""))
    return F.when(one == "", "Conversation").otherwise(F.concat(F.upper(F.substring(some, 1, 1)), F.substring(some, F.lit(2), F.length(some))))


def visible(text: Column) -> Column:
    """Text without ``<think>`` blocks and tool markup."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"(?is)<think>.*?</think>", ""), r"(?is)<tool_call>.*?</tool_call>", ""))


def redact_images(text: Column) -> Column:
    """Base64 image data replaced by a note."""
    return F.regexp_replace(text, r"data:image/[A-Za-z0-9.+-]+;base64,[A-Za-z0-9+/=]+", "[image]")


def front_matter(text: Column) -> Column:
    """Map of the ``key: value`` lines between a leading ``---`` line and the next; empty without."""
    block = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---(\n|$)", 1)
    pairs = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))
    return F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("k"), F.trim(F.regexp_replace(x, r"^[^:]*:", "")).alias("v"))))


def unwrap(text: Column) -> Column:
    """Single line breaks as spaces; blank lines stay."""
    return F.regexp_replace(F.regexp_replace(text, r"([^\n])\n([^\n])", "$1 $2"), r"[ \t]+", " ")


def fit_name(text: Column, most: int = 100) -> Column:
    """A name of at most ``most`` characters; a longer one ends with eight digits of its SHA-1."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 9), F.lit("-"), F.substring(F.sha1(text), 1, 8))).otherwise(text)


def iso_utc(ts: Column) -> Column:
    """ISO 8601 in UTC without trailing zeros of the fraction, ``Z`` at the end."""
    text = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", ""), F.lit("Z"))


def seconds(clock: Column) -> Column:
    """Seconds of ``[hh:]mm:ss.mmm``; null if malformed."""
    part = lambda k: F.regexp_extract(clock, r"^(?:([0-9]+):)?([0-9]{1,2}):([0-9]{1,2})[.,]([0-9]{1,3})$", k)
    whole = F.coalesce(F.when(part(1) != "", part(1)).cast("int"), F.lit(0))
    ok = part(3) != ""
    return F.when(ok, whole * 3600 + F.when(ok, part(2)).cast("int") * 60 + F.when(ok, part(3)).cast("int") + F.when(ok, F.rpad(part(4), 3, "0")).cast("int") / 1000)


def clock(seconds: Column) -> Column:
    """``hh:mm:ss`` of a number of seconds; from 100 hours on with more digits."""
    n = F.floor(seconds)
    digits = lambda x: x.cast("int").cast("string")
    two = lambda x: F.lpad(digits(x), F.greatest(F.lit(2), F.length(digits(x))), F.lit("0"))
    return F.concat_ws(":", two(n / 3600), two((n % 3600) / 60), two(n % 60))


def json_object(text: Column) -> Column:
    """The JSON object in a model's answer: without code fences, from the first ``{`` to the last ``}``; null without."""
    bare = F.trim(F.regexp_replace(text, r"(?im)^```(?:json)?[ \t]*|[ \t]*```$", ""))
    found = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(found != "", found)


def repair_uuid(text: Column) -> Column:
    """Canonical UUID of a text: markup and dashes dropped, 28 to 31 hexadecimal digits padded with zeros; null otherwise."""
    raw = F.regexp_replace(F.lower(F.regexp_replace(text, r"<[^>]*>", "")), r"[^0-9a-f]", "")
    full = F.when(F.length(raw).between(28, 32), F.rpad(raw, 32, "0"))
    return F.regexp_replace(full, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def number_map(text: Column) -> Column:
    """``name:n,name:n`` as a map; entries without a name or a positive whole number are skipped, the last of equals wins."""
    parts = F.transform(F.split(text, ","), lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("k"), F.regexp_extract(x, r"^[^:]*:[ ]*([0-9]+)[ ]*$", 1).alias("v")))
    good = F.filter(parts, lambda x: (x["k"] != "") & (x["v"] != ""))
    return F.map_from_entries(F.transform(good, lambda x: F.struct(x["k"], x["v"].cast("int"))))


def _renamed(name: Column, names: dict[str, str], other: Callable[[Column], Column]) -> Column:
    def pick(name: Column) -> Column:
        out = F
        for k, v in names.items():
            out = out.when(name == k, v)
        return out.otherwise(other(name))

    return bound(name, pick)


def entity(text: Column) -> Column:
    """Entity name: squeezed, without outer quotes and odd characters, lower-cased; the speakers under one name each."""
    bare = F.regexp_replace(squeeze(F.coalesce(text, F.lit(""))), r"^[`'\"]+|[`'\"]+$", "")
    name = F.trim(F.lower(F.regexp_replace(bare, r"[^A-Za-z0-9_.+\- ]+", "")))
    return _renamed(name, SPEAKERS, lambda x: x)


def relation(text: Column) -> Column:
    """Relation name: upper-cased, other characters as single underscores, one name for those that mean the same."""
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    return _renamed(name, RELATIONS, F.upper)


def seed_terms(text: Column) -> Column:
    """Distinct words of three or more characters of an entity name that aren't stop words or speakers."""
    words = F.regexp_extract_all(entity(text), F.lit(r"([a-z0-9_.+\-]+)"), F.lit(1))
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*SEED_STOP_WORDS, *sorted(set(SPEAKERS.values())))))


def exact_terms(text: Column, most: int = 8) -> Column:
    """Quoted phrases, then words with a digit, a symbol, two capitals or ten letters; trimmed, distinct whatever the case, at most ``most``."""
    quoted = F.regexp_extract_all(text, F.lit("(\"[^\"]{3,96}\"|'[^']{3,96}')"), F.lit(1))
    words = F.filter(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9][A-Za-z0-9_./:+\-]{2,})"), F.lit(1)), lambda w: w.rlike(r"[-_./:+0-9]|[A-Z].*[A-Z]") | (F.length(w) >= 10))
    bare = F.transform(F.concat(quoted, words), lambda w: F.regexp_replace(w, r"^[ \t\r\n\"'`.,;:!?()\[\]{}]+|[ \t\r\n\"'`.,;:!?()\[\]{}]+$", ""))
    good = F.filter(bare, lambda w: (F.length(w) >= 3) & ~F.lower(w).isin(*TERM_STOP_WORDS))
    first = F.filter(good, lambda w, i: F.array_position(F.transform(good, lambda x: F.lower(x)), F.lower(w)) == i + 1)
    return F.slice(first, 1, most)


def fact(text: Column) -> Column:
    """Fact-first form of a memory candidate: squeezed, without a request to remember and outer quotes."""
    bare = F.trim(F.regexp_replace(squeeze(text), REMEMBER, ""))
    return F.regexp_replace(F.trim(F.regexp_replace(bare, REMEMBER_THAT, "")), r"^[ \"']+|[ \"']+$", "")


def low_value_fact(text: Column) -> Column:
    """Empty, a bare pronoun, or talk about remembering."""
    one = fact(text)
    return F.regexp_replace(F.lower(one), r"^[ .!?,:;]+|[ .!?,:;]+$", "").isin(*LOW_VALUE_WORDS) | one.rlike(LOW_VALUE)


def fact_category(text: Column) -> Column:
    """``preference`` by how a text begins, else the first category with a cue in it, else ``general``."""
    low = F.lower(F.trim(text))
    out = F.when(low.rlike(f"^({'|'.join(FACT_PREFIXES)})"), "preference")
    for name, cues in FACT_CUES:
        out = out.when(low.rlike("|".join(cues)), name)
    return out.otherwise("general")


def heuristic_facts(text: Column) -> Column:
    """Facts of a user's turn: what they ask to remember, then what they say of themselves to the line's end; normal forms, distinct, without those of low value."""
    whole = F.trim(text)
    asks = F.lower(whole).rlike("|".join(REMEMBER_CUES))
    said = [F.nullif(F.trim(F.regexp_extract(whole, f"(?i)({p})", 1)), F.lit("")) for p in FACT_PATTERNS]
    upper = [F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x))) for x in said]
    found = F.array_compact(F.array(F.when(asks, whole), *upper))
    facts = F.transform(F.filter(found, lambda x: ~low_value_fact(x)), fact)
    return F.array_distinct(F.filter(facts, lambda x: x != ""))


def cache_key(prefix: str, *parts: Column) -> Column:
    """Prefix and canonical JSON of the parts; as SHA-256 where longer than 180 characters."""
    body = F.to_json(F.array(*(p.cast("string") for p in parts)))
    return F.concat(F.lit(prefix + ":"), F.when(F.length(body) > 180, F.sha2(body, 256)).otherwise(body))


def cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Price of a model call, in doubles: 0.0005 a thousand tokens in, 0.0015 a thousand out."""
    return tokens_in.cast("double") / 1000 * F.lit(0.0005) + tokens_out.cast("double") / 1000 * F.lit(0.0015)
