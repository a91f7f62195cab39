"""Column expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Java's own class is narrower.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


# The same, tried faster: most characters fall to the two ranges in front and never reach the many parts behind.
_FAST = rf"[\x09-\x20\x7f-\u3000&&{SPACE}]"
_BLANK = rf"[\x09\x0b-\x20\x7f-\u3000&&{SPACE}]"  # white space but the line end
# A run of white space is entered at its beginning only, so that a text takes time in proportion to its length:
# the character matched first must not have white space before it, or stand where the last match has ended.
_RUN = rf"(?:\G{SPACE}++|{_FAST}(?<!{SPACE}{{2}}){SPACE}*+)?+"
_BLANKS = rf"(?:{_BLANK}(?<!{SPACE}{{2}}){_BLANK}*+)?+"


def text_filter(text: Column) -> Column:
    """Joins words hyphenated over a line end, drops blank lines, and turns line ends into blanks.

    ``text`` should be a column: it is used more than once. Each rule is tried only where a plain search finds that it may apply.
    """
    joined = F.when(text.rlike(rf"-{SPACE}*\n"), F.regexp_replace(text, rf"{_RUN}-{SPACE}*\n", "")).otherwise(text)
    # A blank line is white space with line ends, as any line end with white space around it is: one rule takes both.
    return F.when(F.contains(text, F.lit("\n")), F.regexp_replace(joined, rf"{_BLANKS}\n{SPACE}*+", " ")).otherwise(text)


def block_rtrim(text: Column) -> Column:
    """Without white space at the end."""
    return F.regexp_replace(text, rf"{SPACE}(?<!{SPACE}{{2}}){SPACE}*+\z", "")


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, rf"\A{SPACE}++|{SPACE}(?<!{SPACE}{{2}}){SPACE}*+\z", "")


def split_sentences(text: Column) -> Column:
    """P3's default: an array of sentences, cut after runs of ``.!?`` that white space follows."""
    return F.split(F.regexp_replace(F.trim(text), r"([.!?](?<![.!?]{2})[.!?]*+)\s++", "$1\n"), "\n")


def lemmatize(text: Column) -> Column:
    """T3's default in place of a model: lower case, single blanks, no blanks around hyphens."""
    # A single blank is what it should be: only other runs are replaced.
    runs = rf"{_FAST}(?:(?<! ){SPACE}*+|{SPACE}++)"
    return F.replace(F.trim(F.regexp_replace(F.lower(text), runs, " ")), F.lit(" - "), F.lit("-"))


def spaced(text: Column) -> Column:
    """T4: stripped, with one blank in front."""
    return F.concat(F.lit(" "), strip(text))


def basename(path: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def numbers(text: Column) -> Column:
    """J1's default in place of the entity service: an array of numbers with optional percent sign."""
    return F.regexp_extract_all(text, F.lit(r"[0-9]+(?:[.,][0-9]+)*%?"), F.lit(0))


#: An entity of the service's reply. Offsets count characters; a percentage is a number with its unit apart.
ENTITY = "array<struct<text: string, label: string, start: int, end: int, value: string, unit: string>>"


def entity_reply(reply: Column, schema: str = ENTITY) -> Column:
    """The entities of the service's JSON reply; fields that it lacks are null, and so is all of a broken reply."""
    return F.from_json(reply, schema, {"mode": "PERMISSIVE"})


def entity_texts(entities: Column) -> Column:
    """The texts of entities in order, one string."""
    return F.array_join(F.transform(entities, lambda e: e["text"]), "|")


def split_distinct(text: Column) -> Column:
    """How many distinct comma-parted items; a null has none."""
    return F.coalesce(F.size(F.array_distinct(F.split(text, ","))), F.lit(0))
