"""Text expressions. What Spark's built-ins can say stays in the JVM; NFKC, entities and line machines are pandas UDFs."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The token pattern and the Markdown constructs that normalisation removes.
#: A run of letters and digits, joined by single . / : _ - to further runs, with a closing ++, + or #.
TOKEN = r"[\p{L}\p{N}]+(?:(?:[./:_-][\p{L}\p{N}]+)|(?:\+\+|\+|#))*"
#: The same words as a word pattern with ' + - inside, without look-around.
WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_'+-]*[\p{L}\p{N}_])?"
COMMENT = r"(?s)<!--.*?-->"
AUTOLINK = r"(?i)<(?:https?://|mailto:)[^>]+>"
IMAGE = r"!\[([^\]]*)\]\([^)]*\)"
LINK = r"\[([^\]]+)\]\([^)]*\)"
REFERENCE = r"\[([^\]]+)\]\[[^\]]*\]"
CODE = r"`+([^`\n]+?)`+"
TAG = r"</?[A-Za-z][^>]*>"
FENCE = r"[ \t]{0,3}(`{3,}|~{3,})"
ATX = r"[ \t]{0,3}#{1,6}[ \t]+(.+?)[ \t]*#*[ \t]*"
UNDERLINE = r"[ \t]{0,3}(?:=+|-+)[ \t]*"
PREFIX = r"[ \t]{0,3}(?:>[ \t]?|[-+*][ \t]+|\d+[.)][ \t]+)"
SNIPPET_CHARACTERS, EXCERPT_CHARACTERS = 500, 2_000
# Java's \s is ASCII; these are the characters that Unicode counts as white space
SPACE = r"[\s\u001c-\u001f\u0085   -     　]"

_STEPS = [(re.compile(p), r) for p, r in ((COMMENT, " "), (AUTOLINK, " "), (IMAGE, r" \1 "), (LINK, r" \1 "), (REFERENCE, r" \1 "), (CODE, r" \1 "))]
_TAG, _FENCE, _ATX, _UNDERLINE, _PREFIX = (re.compile(p) for p in (TAG, FENCE, ATX, UNDERLINE, PREFIX))
_BLANKS, _TIGHT = re.compile(r"\s+"), re.compile(r" ([,.;:!?])")


def normalized(text: str) -> str:
    """NFKC text in lower case without Markdown and HTML: labels and code stay, targets, tags and marks go."""
    text = unicodedata.normalize("NFKC", text)
    for pattern, instead in _STEPS:
        text = pattern.sub(instead, text)
    text = html.unescape(_TAG.sub(" ", "\n".join("" if _FENCE.match(x) else x for x in text.splitlines())))
    kept = []
    for line in text.splitlines():
        heading = _ATX.fullmatch(line)
        line = heading.group(1) if heading else line
        prefix = _PREFIX.match(line)
        line = line[prefix.end() :] if prefix else line
        if not _UNDERLINE.fullmatch(line):
            kept.append(line)
    flat = "\n".join(kept).translate({ord(c): None for c in "\\*~"})
    return _TIGHT.sub(r"\1", _BLANKS.sub(" ", flat).strip()).lower()


def headings_and_body(text: str) -> tuple[list[str], str]:
    """Normalised headings outside fences, and the normalised rest.

    A fence ends at any line that starts with enough of its marks. A line above === or --- is a heading, whatever it holds.
    """
    found: list[str] = []
    rest: list[str] = []
    lines = text.splitlines()
    open_mark, skip = "", False
    for here, below in zip(lines, [*lines[1:], None], strict=False):
        if skip:
            skip = False
            continue
        fence = _FENCE.match(here)
        title = None
        if fence:
            mark = fence.group(1)
            if not open_mark:
                open_mark = mark
            elif mark[0] == open_mark[0] and len(mark) >= len(open_mark):
                open_mark = ""
        elif not open_mark:
            if atx := _ATX.fullmatch(here):
                title = atx.group(1)
            elif below is not None and _UNDERLINE.fullmatch(below):
                title, skip = here, True
        if title is None:
            rest.append(here)
        elif label := normalized(title):
            found.append(label)
    return found, normalized("\n".join(rest))


@F.pandas_udf(T.StringType())
def normalize(text: pd.Series) -> pd.Series:
    return text.map(normalized, na_action="ignore")


@F.pandas_udf(T.StructType([T.StructField("headings", T.ArrayType(T.StringType())), T.StructField("body", T.StringType())]))
def partition_markdown(text: pd.Series) -> pd.DataFrame:
    parts = [headings_and_body(t) if t is not None else (None, None) for t in text]
    return pd.DataFrame({"headings": [p[0] for p in parts], "body": [p[1] for p in parts]})


def tokens(text: Column) -> Column:
    """Tokens of a text that is normalised already; lower-casing it again changes nothing."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD))


def combined_text(*fields: Column) -> Column:
    """The fields that hold something, joined by single blanks."""
    return F.array_join(F.filter(F.array(*fields), lambda f: f.isNotNull() & (f != "")), " ")


def embedding_text(name: Column, description: Column, metadata: Column, heading: Column, body: Column) -> Column:
    """Five labelled lines: what an embedding is bound to."""
    labelled = zip(("name", "description", "metadata", "headings", "body"), (name, description, metadata, heading, body), strict=True)
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), F.coalesce(c, F.lit(""))) for label, c in labelled])


def metadata_text(license_: Column, compatibility: Column, tools: Column, metadata: Column) -> Column:
    """Licence, compatibility, tools in order, then each key with its value, in order of keys."""
    keyed = F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat_ws(" ", e["key"], e["value"]))
    return F.concat_ws(" ", F.nullif(license_, F.lit("")), F.nullif(compatibility, F.lit("")), F.array_join(F.array_sort(tools), " "), F.array_join(keyed, " "))


def safe_snippet(description: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(description, SPACE + "+", " ")), 1, SNIPPET_CHARACTERS)


def excerpt(body: Column) -> tuple[Column, Column]:
    """(the first characters, whether there are more); only one character more than shown is read."""
    part = F.substring(body, 1, EXCERPT_CHARACTERS + 1)
    return F.substring(part, 1, EXCERPT_CHARACTERS), F.coalesce(F.length(part) > EXCERPT_CHARACTERS, F.lit(False))


def plain_text(value: Column) -> Column:
    """One kind of line break, no control or unassigned characters but line breaks and tabs, no outer blanks."""
    lines = F.regexp_replace(value, "\r\n?", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"(?![\n\t])\p{C}", ""), f"^{SPACE}+|{SPACE}+$", "")


def declared_tool(value: Column) -> Column:
    """A tool name as it is counted: no outer blanks, then no outer commas and semicolons, then no outer blanks, lower case."""
    return F.lower(F.trim(F.regexp_replace(F.trim(value), "^[,;]+|[,;]+$", "")))


def csv_safe(value: Column) -> Column:
    """A value that a spreadsheet would take for a formula gets a leading apostrophe."""
    return F.when(value.rlike("^[ \t\r\n]*[=+@-]") | value.rlike("^[\t\r\n]"), F.concat(F.lit("'"), value)).otherwise(value)


def pinned_commit(html_url: Column, path: Column) -> Column:
    """The commit of a permalink that names this path."""
    pattern = r"^https://[^/]+/[^/]+/[^/]+/blob/([0-9a-f]{40})/(.+)$"
    return F.when(F.regexp_extract(html_url, pattern, 2) == path, F.nullif(F.regexp_extract(html_url, pattern, 1), F.lit("")))
