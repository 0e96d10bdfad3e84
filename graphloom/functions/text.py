"""Text columns: identifiers, keywords, anchors, paragraphs, classifiers, tags, reasons."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

#: Words that keyword search leaves out.
KEYWORD_STOPWORDS = tuple(
    "a an and are as at be by for from has he in is it its of on that the to was were will with i you they we "
    "this but not or can had would could what when where why how all also just so do does did have been being if up".split()
)
#: Words that text similarity leaves out.
SIMILARITY_STOPWORDS = tuple("a an and are as at be by for from has he in is it its of on that the to was were will with i you they we".split())
#: What counts as a reference to a time.
MONTHS = "january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|jul|aug|sep|sept|oct|nov|dec"
WEEKDAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
_SMALL = "one|two|three|four|five|six|seven|eight|nine|ten"
_UNIT = "(?:minute|hour|day|week|month|year)s?"
ANCHORS = (
    r"(?U)\b\d{4}-\d{2}-\d{2}\b",
    r"(?U)\b\d{1,2}/\d{1,2}/\d{2,4}\b",
    rf"(?iU)\b(?:{MONTHS})\b\.?\s*\d{{1,2}}(?:,\s*\d{{4}})?",
    rf"(?iU)\b\d{{1,2}}\s+(?:{MONTHS})\b",
    rf"(?iU)\b(?:{MONTHS})\s+\d{{4}}\b",
    rf"(?iU)\b(?:{WEEKDAYS})\b",
    r"(?U)\b(?:19|20)\d{2}\b",
    rf"(?iU)\b(?:yesterday|today|tonight|tomorrow|(?:last|next|this|past|coming)\s+(?:week|month|year|{WEEKDAYS})"
    rf"|(?:\d+|{_SMALL}|eleven|twelve|few|several|couple\s+of)\s+{_UNIT}\s+ago|in\s+(?:\d+|{_SMALL})\s+{_UNIT})\b",
)
#: Markers of statements in conversations, in the order in which they are looked for. A word is letters, digits
#: and underscores of any script.
_WORD = r"[\p{L}\p{N}_]+"
_PHRASE = rf"{_WORD}(?:\s+{_WORD})"
DECISIONS = (
    rf"(?iU)will\s+({_PHRASE}{{1,8}})",
    rf"(?iU)decided\s+to\s+({_PHRASE}{{1,8}})",
    rf"(?iU)plan\s+to\s+({_PHRASE}{{1,8}})",
    rf"(?iU)going\s+to\s+({_PHRASE}{{1,8}})",
)
BELIEFS = (
    (rf"(?iU)(think|believe|seems\s+like|probably|likely)\s+({_PHRASE}{{1,10}})", 2),
    (rf"(?iU)my\s+opinion\s+is\s+({_PHRASE}{{1,10}})", 1),
)
STATEMENT_KINDS = (
    ("decision", ("decided", "will", "going to", "plan to", "agreed")),
    ("insight", ("learned", "realized", "discovered", "found that")),
    ("commitment", ("commit", "promise", "deadline", "due", "by")),
)
#: Markers of paragraphs in notes, in the order in which they are looked for.
PARAGRAPH_KINDS = (
    ("decision", ("decided", "choose", "selected", "will implement")),
    ("belief", ("believe", "think", "opinion", "should", "recommend")),
    ("fact", ("is", "are", "was", "were", "has", "have", "definition")),
    ("insight", ("learned", "discovered", "insight", "realization")),
)
#: What a statement about the assistant itself contains, beside what names its domain.
ASSISTANT_SIGNALS = (
    "operating principle", "lesson learned", "cron job", "delegation", "workflow", "tool quirk", "cli pattern", "brain query", "extraction", "think cycle",
)
#: What a message has where a client could not show a tool's block.
TOOL_MARKS = ("This block is not supported on your current device yet.", "[Tool output truncated]")
#: Colours of clusters by node type.
COLOURS = {"seed": "#FF6B6B", "core_memory": "#FFD93D", "derived": "#74C0FC", "belief": "#51CF66", "question": "#DA77F2", "dream": "#22D3EE", "decayed": "#868E96"}
OTHER_COLOUR = "#ADB5BD"
#: Metadata keys that may hold the time of what a node tells, the first that can be read counts.
TIME_KEYS = ("event_time", "referent_time", "occurred_at", "happened_at", "original_timestamp", "source_time")


def stripped(text) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def content_id(text) -> Column:
    return F.substring(F.sha2(text, 256), 1, 12)


def token_estimate(text) -> Column:
    return F.floor(F.length(text) / 3)


def keywords(text: str) -> list[str]:
    import re

    return [w for w in re.findall(r"\b\w+\b", text.lower()) if w not in KEYWORD_STOPWORDS and len(w) > 2]


def relevance(text: Column, words: list[str]) -> Column:
    """Share of the keywords among the words, and a tenth for each that is a substring; at most 1."""
    if not words:
        return F.lit(0.0)
    lower = F.lower(text)
    count = lambda tests: reduce(lambda a, b: a + b, [t.cast("int") for t in tests])
    # a keyword is all word characters, so it is one of the words where boundaries enclose it; most texts fail the cheap test
    hits = count([lower.contains(w) & lower.rlike(rf"(?U)\b{w}\b") for w in words])
    inside = count([lower.contains(w) for w in words])
    return F.least(F.lit(1.0), hits / float(len(words)) + inside * 0.1)


def word_set(text) -> Column:
    """Distinct lower-cased words without stopwords."""
    return F.array_except(F.split(F.lower(text), r"\s+"), F.array(*map(F.lit, ("", *SIMILARITY_STOPWORDS))))


def anchors(text) -> Column:
    found = [F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in ANCHORS]
    return F.array_distinct(F.transform(F.concat(*found), lambda x: F.trim(F.lower(x))))


def has_anchor(text, found) -> Column:
    return F.exists(found, lambda a: F.contains(F.lower(text), a))


def extracted(text) -> Column:
    """The first five statements by the markers' order: array of (content, node_type)."""

    def items(found, kind):
        return F.transform(found, lambda x: F.struct(F.concat(F.lit(f"{kind[0]}: "), F.trim(x)).alias("content"), F.lit(kind[1]).alias("node_type")))

    parts = [items(F.regexp_extract_all(text, F.lit(p), F.lit(1)), ("Decision", "decision")) for p in DECISIONS]
    parts += [items(F.regexp_extract_all(text, F.lit(p), F.lit(g)), ("Belief", "belief")) for p, g in BELIEFS]
    facts = F.filter(F.transform(F.split(text, r"\."), stripped), lambda s: (F.length(s) > 20) & (F.length(s) < 100) & s.rlike("[A-Z][a-z]+"))
    return F.slice(F.concat(*parts, items(facts, ("Observation", "observation"))), 1, 5)


def without_front_matter(text) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\s*\n.*?\n---\s*\n", "")


def paragraphs(text, least: int = 20) -> Column:
    """Blocks between blank lines, without headings, fences and rules; white space collapsed, links replaced by their text."""
    parts = F.transform(F.split(without_front_matter(text), "\n\n"), lambda p: F.btrim(p, F.lit(" \t\n\x0b\x0c\r")))
    plain = F.filter(parts, lambda p: (F.length(p) >= least) & ~p.startswith("#") & ~p.startswith("```") & ~p.startswith("---"))
    clean = F.transform(plain, lambda p: F.regexp_replace(F.regexp_replace(p, r"\s+", " "), r"\[([^\]]+)\]\([^\)]+\)", "$1"))
    return F.filter(clean, lambda p: F.length(p) >= least)


def wikilinks(text) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)), lambda x: F.trim(x)), lambda x: x != "")


def _kind(text: Column, kinds: tuple) -> Column:
    lower, out = F.lower(text), F.lit("observation")
    for kind, marks in reversed(kinds):
        out = F.when(reduce(or_, [lower.contains(m) for m in marks]), kind).otherwise(out)
    return out


def statement_kind(text: Column) -> Column:
    return _kind(text, STATEMENT_KINDS)


def paragraph_kind(text: Column) -> Column:
    return _kind(text, PARAGRAPH_KINDS)


def typed_statement(line, kinds: tuple[str, ...], fallback: Callable[[Column], Column] | None = None, default: str = "observation") -> tuple[Column, Column]:
    """(type, text) of `[type] text`; of any other line what `fallback` says of it, or `default`, and the whole line."""
    line = F.col(line) if isinstance(line, str) else line
    pattern = rf"(?i)^\[({'|'.join(kinds)})\]\s+(.+)$"
    kind = F.lower(F.regexp_extract(line, pattern, 1))
    other = fallback(line) if fallback else F.lit(default)
    return F.when(kind != "", kind).otherwise(other), F.when(kind != "", stripped(F.regexp_extract(line, pattern, 2))).otherwise(line)


def statement_lines(answer) -> Column:
    """The lines of a model's answer that are statements: no blank lines, headings and rules."""
    lines = F.transform(F.split(answer, "\n"), stripped)
    return F.filter(lines, lambda x: (x != "") & ~x.startswith("#") & ~x.startswith("---"))


def without_tool_marks(text: Column, least: int = 50) -> Column:
    """The text without the marks of tool blocks; null where less than `least` characters are left of a text that had some."""
    marked = reduce(or_, [text.contains(m) for m in TOOL_MARKS])
    clean = text
    for m in TOOL_MARKS:
        clean = F.replace(clean, F.lit(m), F.lit(""))
    clean = stripped(clean)
    return F.when(~marked, text).when(F.length(clean) >= least, clean)


def domain_of_text(text: Column, user: str, assistant: str, signals: tuple[str, ...] = ASSISTANT_SIGNALS) -> Column:
    """The assistant's domain where the text has one of the signals or names it, else the user's."""
    named = (assistant.lower(), f"{assistant.lower()} must", *signals)
    return F.when(reduce(or_, [F.lower(text).contains(s) for s in named]), assistant).otherwise(user)


def mapped_domain(domain: Column, aliases: dict[str, str]) -> Column:
    """A domain by its present name; names that are no alias stay."""
    for old, new in aliases.items():
        domain = F.when(domain == old, new).otherwise(domain)
    return domain


def cluster_colour(node_type: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in COLOURS.items() for x in pair])
    return F.coalesce(pairs[node_type], F.lit(OTHER_COLOUR))


def recovered_time(metadata: Column, source_file: Column) -> tuple[Column, Column]:
    """(time, where it is from): the first metadata key with a readable time, else a date in the source's name, else null and `none`."""
    from .clock import event_time

    told = F.coalesce(*[event_time(F.get_json_object(metadata, f"$.{k}")) for k in TIME_KEYS])
    part = lambda i: F.regexp_extract(source_file, r"(\d{4})[-/](\d{2})[-/](\d{2})", i)
    dated = F.try_to_timestamp(F.concat_ws("-", part(1), part(2), part(3)), F.lit("yyyy-MM-dd"))
    dated = F.when(part(1) != "", dated)
    return F.coalesce(told, dated), F.when(told.isNotNull(), "metadata").when(dated.isNotNull(), "source_file_date").otherwise("none")


def tag_any(tags: list[str]) -> Column:
    """Any of the tags as a substring, in any case."""
    return reduce(or_, [F.coalesce(F.col("tags").ilike(f"%{t}%"), F.lit(False)) for t in tags])


def tag_none(tags: list[str]) -> Column:
    return reduce(and_, [F.col("tags").isNull() | ~F.col("tags").ilike(f"%{t}%") for t in tags])


def tag_list(column="tags") -> Column:
    return F.filter(F.transform(F.split(column, ","), lambda t: F.trim(t)), lambda t: t != "")


def normal_tags(tags: Column) -> Column:
    """An array of tags as they are kept: trimmed, lower-cased, joined by commas."""
    return F.array_join(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != ""), ",")


def without_tag(tag: str, column="tags") -> Column:
    return F.array_join(F.filter(tag_list(column), lambda t: t != tag), ",")


def merged_tags(a, b) -> Column:
    return F.array_join(F.array_sort(F.array_union(F.coalesce(tag_list(a), F.array()), F.coalesce(tag_list(b), F.array()))), ",")


def relation(reasoning="reasoning") -> Column:
    r = F.lower(F.coalesce(F.col(reasoning), F.lit("")))
    return F.when(r.contains("summarizes"), "summarizes").when(r.contains("cross_link"), "cross_link").when(r.contains("contradicts"), "contradicts").otherwise("derived_from")


def reason_bucket(reasoning="reasoning") -> Column:
    r = F.lower(F.coalesce(F.col(reasoning), F.lit("")))
    return F.when(r.contains("summariz"), "summarizes").when(r.contains("cross"), "cross_link").when(r.rlike("contradict|conflict"), "contradicts").otherwise("other")


def is_contradiction(reasoning="reasoning") -> Column:
    return F.coalesce(F.lower(F.col(reasoning)).rlike("contradict|conflict|oppose"), F.lit(False))


def summary(text) -> Column:
    return F.substring(F.regexp_replace(F.trim(text), "\n", " "), 1, 80)
