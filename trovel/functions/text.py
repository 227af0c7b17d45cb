"""Text functions: cleaning, composing, prefixes, identifiers, lists. All built-in but for two Unicode tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPACE = r"[\s\p{Z}]+"


def trim_ws(c: Column) -> Column:
    """Without leading and trailing Unicode white space; null stays null."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def text_or_empty(c: Column) -> Column:
    return F.coalesce(trim_ws(c.cast("string")), F.lit(""))


def usable(c: Column) -> Column:
    """Neither null nor blank."""
    return c.isNotNull() & (F.length(trim_ws(c.cast("string"))) > 0)


@F.pandas_udf(StringType())
def unescape_html(s: pd.Series) -> pd.Series:
    """Named and numbered character references; one level."""
    import html

    return s.map(lambda x: None if x is None else html.unescape(x))


@F.pandas_udf(StringType())
def decompose(s: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks."""
    import unicodedata

    return s.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)))


def strip_markup(c: Column) -> Column:
    """Block-level tags become a space, other tags go, white space is one space. The block pattern has no word boundary, so
    a tag whose name only begins like a block's counts as one."""
    blocks = F.regexp_replace(c, r"(?i)</?(p|br|div|tr|td|table)[^>]*>", " ")
    return F.coalesce(trim_ws(F.regexp_replace(F.regexp_replace(blocks, r"<[^>]+>", ""), SPACE, " ")), F.lit(""))


def clean_html(c: Column) -> Column:
    """Unescapes first, so escaped markup goes too; null becomes empty."""
    return strip_markup(unescape_html(c))


def labelled_parts(parts: list[tuple[str, Column]]) -> Column:
    """`label: value` of the non-empty parts, a blank line between."""
    return F.concat_ws("\n\n", *[F.when(text_or_empty(c) != "", F.concat(F.lit(f"{label}: " if label else ""), text_or_empty(c))) for label, c in parts])


def words(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def with_prefix(c: Column, prefix: str) -> Column:
    """Puts the prefix in front unless it is there already, in any case."""
    t = trim_ws(c)
    return F.when(F.startswith(F.lower(t), F.lit(prefix.strip().lower())), t).otherwise(F.concat(F.lit(prefix), t))


def without_prefix(c: Column, prefix: str) -> Column:
    return trim_ws(F.regexp_replace(trim_ws(c), rf"(?i)^{prefix}", ""))


def identifier(c: Column) -> Column:
    """Lower-case ASCII words joined by `_`; for text whose accents are gone already. Null becomes empty."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", ""), F.lit(""))


def unicode_identifier(c: Column) -> Column:
    """identifier() of any text, accents and compatibility forms folded."""
    return identifier(decompose(F.regexp_replace(c, SPACE, " ")))


def node_id(kind: str, *parts: Column) -> Column:
    return F.concat_ws("::", F.lit(kind), *parts)


def bracket_list(c: Column) -> Column:
    """`[A, B]`, `['A', 'B']` or `A, B` as an array of trimmed, non-blank items. Quoted items may hold commas; in a list
    without quotes a comma always parts items. Null and `[]` are empty."""
    t = trim_ws(c)
    quoted = t.rlike(r"""^\[\s*(['"]).*\1\s*\]$""")
    inner = F.regexp_replace(t, r"^\[|\]$", "")
    items = F.when(quoted, F.transform(F.regexp_extract_all(inner, F.lit(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")""")), lambda x: F.substring(x, F.lit(2), F.length(x) - 2))).otherwise(F.split(inner, ","))
    return F.coalesce(F.filter(F.transform(items, trim_ws), lambda x: x != ""), F.array().cast("array<string>"))


def number_in(c: Column) -> Column:
    """The value as a whole number, else its last run of digits, else null."""
    s = c.cast("string")
    return F.coalesce(s.try_cast("long"), F.try_element_at(F.regexp_extract_all(s, F.lit(r"(\d+)")), F.lit(-1)).try_cast("long"))


def first_present(*cs: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.when(c.cast("string") != "", c) for c in cs])


def without_fence(c: Column) -> Column:
    """JSON without the Markdown fence around it."""
    return trim_ws(F.regexp_replace(F.regexp_replace(trim_ws(c), r"^```[A-Za-z]*\s*", ""), r"\s*```$", ""))


def fill_template(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value, F.lit("")))
    return out


def document_block(doc_id: Column, text: Column) -> Column:
    return F.concat(F.lit("[DOC_"), doc_id.cast("string"), F.lit("]\n"), text)


def triple_text(a: Column, relation: Column, b: Column) -> Column:
    return F.concat(F.lit("["), a, F.lit("] --("), relation, F.lit(")--> ["), b, F.lit("]"))


def grade_label(grade: Column) -> Column:
    return F.when(grade == 0, "irrelevant").when(grade == 1, "related").when(grade == 2, "relevant").when(grade == 3, "highly relevant").otherwise("not judged")
