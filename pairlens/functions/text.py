"""Canonical texts, hashes and their sections, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that ends of lines lose, as a character class.
SPACE = r"\t\x0B\f\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
HEADERS = ("Market Statement:", "Resolution Criteria:", "Clarifications:", "End Date:", "Outcomes:")


def normalise_text(text: Column) -> Column:
    """LF line ends, no trailing white space, runs of blank lines as one, none at the end."""
    folded = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    # Printable ASCII, and single spaces before it, are passed by comparisons; a run of white space is looked at from its start only.
    trimmed = F.regexp_replace(folded, f"(?md)(?=[^!-~](?:[^!-~]|\\z))[{SPACE}](?<![{SPACE}]{{2}})[{SPACE}]*+$", "")
    # A blank line goes if the one before it is blank.
    return F.rtrim(F.regexp_replace(trimmed, r"(?=\n)(?<=\n\n|\A\n)\n+", ""), F.lit("\n"))


def content_hash(text: Column) -> Column:
    return F.sha2(normalise_text(text), 256)


def identity_hash(venue: Column, market_id: Column) -> Column:
    return F.sha2(F.concat_ws(":", venue, market_id), 256)


def _present(c: Column) -> Column:
    return F.when(c != "", c)


def canonical_text(title: Column, criteria: Column, description: Column, end_date: Column, labels: Column) -> Column:
    """The sections of a contract; empty ones are left out, outcomes count from three on."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Market Statement:\n"), title),
        F.concat(F.lit("\nResolution Criteria:\n"), _present(criteria)),
        F.concat(F.lit("\nClarifications:\n- "), _present(description)),
        F.concat(F.lit("\nEnd Date: "), F.date_format(end_date, "yyyy-MM-dd")),
        F.when(F.size(labels) > 2, F.concat(F.lit("\nOutcomes: "), F.array_join(labels, ", "))),
    )


def _section(text: Column, header: str, stops: tuple[str, ...]) -> Column:
    """The trimmed, non-empty lines between a header's line and the next stop, as one line; null if none."""
    stop = "|".join(stops)
    found = F.regexp_extract(text, rf"(?ms)^{header}[^\n]*\n(.*?)(?=^[ \t]*(?:{stop})|\z)", 1)
    lines = F.filter(F.transform(F.split(found, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(lines) > 0, F.array_join(lines, " "))


def parse_statement(text: Column) -> Column:
    first = F.trim(F.split(text, "\n")[0])
    return F.coalesce(_section(text, HEADERS[0], HEADERS[1:]), _present(first), F.substring(text, 1, 200))


def parse_criteria(text: Column) -> Column:
    return _section(text, HEADERS[1], HEADERS[2:])


def parse_outcomes(text: Column) -> Column:
    listed = F.trim(F.regexp_extract(text, r"(?m)^Outcomes:([^\n]*)", 1))
    return F.when(listed != "", F.transform(F.split(listed, ","), lambda x: F.trim(x))).otherwise(F.array(F.lit("Yes"), F.lit("No")))


def parse_end_date(text: Column) -> Column:
    return _present(F.trim(F.regexp_extract(text, r"(?m)^End Date:([^\n]*)", 1)))


def event_date(text: Column) -> Column:
    """A date on the first line of the text; that line is a header in canonical texts, so null there."""
    return parse_date(_present(F.regexp_extract(F.split(text, "\n")[0], r"(\d{4}-\d{2}-\d{2})", 1)))


def secondary_clauses(criteria: Column) -> Column:
    """Sentences and numbered items of the criteria that have more than ten characters."""
    parts = F.transform(F.split(F.coalesce(criteria, F.lit("")), r"[.;]\s+|(?=\d+\.\s)"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: F.length(x) > 10)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a time with or without zone (then UTC)."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


#: Formats tried in turn for dates.
DATE_FORMATS = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "MM/dd/yyyy")


def parse_date(text: Column) -> Column:
    iso = F.expr("NULL").cast("timestamp")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in DATE_FORMATS], iso)


def parse_timestamp(text: Column) -> Column:
    """ISO text with zone, or epoch seconds."""
    epoch = F.when(text.rlike(r"^\d+(\.\d+)?$"), F.timestamp_seconds(text.cast("double")))
    return F.coalesce(epoch, parse_date(text))


def tokens(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"\s+")), lambda t: t != "")


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def listed(text: Column) -> Column:
    """A comma-separated list: trimmed, in lower case, distinct, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(text, F.lit(""))), ","), lambda x: F.trim(x)), lambda x: x != ""))


def keyword_match(text: Column, keywords: tuple[str, ...]) -> Column:
    """Whether any keyword occurs as a word, whatever its case."""
    escaped = "|".join(sorted((_escape(k) for k in keywords), key=lambda k: (-len(k), k)))
    return F.coalesce(text, F.lit("")).rlike(rf"(?i)\b(?:{escaped})\b")


def _escape(word: str) -> str:
    return "".join(c if c.isalnum() or c == " " else "\\" + c for c in word)
