"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trovel.llm.common import pick

# Frequent function words of the corpus languages (English, French, German, Spanish).
STOP_WORDS = (
    "the of and to in is that for it as was with on are by at an be this from have not or but "
    "de la le et les des en un une du que est pour dans qui sur au par pas plus "
    "el y los las del se por con una para su lo como "
    "der die und das ist von zu den mit ein eine im nicht auf dem sich"
).split()

#: (rule, numerator, denominator, least and most of the ratio): a row is kept if every ratio lies within. None is no bound.
THRESHOLDS = (
    ("mean word length", "word_chars", "n_words", 2.5, 12.0),
    ("symbols per word", "n_symbols", "n_words", None, 0.1),
    ("stop words per word", "n_stop_words", "n_words", 0.02, None),
    ("repeated lines per line", "n_dup_lines", "n_lines", None, 0.5),
)

_SPACE = r"[\\x20\\x09-\\x0D]"


def _let(value: str, name: str, body: str) -> str:
    """SQL in which name stands for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeated_words(w: str) -> str:
    """Words in 3-word windows that occur twice or more. A hash set of windows settles most texts, which repeat none; else
    windows are sorted with their places, neighbours compared as text, and the places that they cover summed up."""
    window = f"{w}[i], {w}[i + 1], {w}[i + 2]"
    covered = "aggregate(transform(q, (v, k) -> least(3, coalesce(get(q, k + 1) - v, 3))), 0, (a, x) -> a + x)"
    twice = "coalesce(get(p, k - 1).g = e.g, false) OR coalesce(get(p, k + 1).g = e.g, false)"
    places = f"sort_array(transform(filter(p, (e, k) -> {twice}), e -> e.i))"
    exact = _let(f"sort_array(transform(sequence(0, size({w}) - 3), i -> struct(concat_ws(' ', {window}) AS g, i AS i)))", "p", _let(places, "q", covered))
    test = _let(f"transform(sequence(0, size({w}) - 3), i -> xxhash64({window}))", "h", f"CASE WHEN size(array_distinct(h)) = size(h) THEN 0 ELSE {exact} END")
    return f"CASE WHEN size({w}) < 3 THEN 0 ELSE {test} END"


def measure(docs: DataFrame, *, text_col: str = "text", into: str = "quality") -> DataFrame:
    """docs with a struct of counts: n_words, word_chars, n_symbols, n_stop_words, n_lines, n_dup_lines, n_repeat_words.

    A null text has no words; each row is judged alone, whatever its id or copies; a column named as into is replaced,
    others are left as they are; no rows yield none.
    """
    stops = ", ".join(f"'{x}'" for x in STOP_WORDS)
    counts = f"""named_struct(
        'n_words', CAST(size(w) AS BIGINT),
        'word_chars', CAST(length(array_join(w, '')) AS BIGINT),
        'n_symbols', CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '')) AS BIGINT),
        'n_stop_words', CAST(size(filter(w, x -> lower(rtrim('.,;:!?', x)) IN ({stops}))) AS BIGINT),
        'n_lines', CAST(size(l) AS BIGINT),
        'n_dup_lines', CAST(size(l) - size(array_distinct(l)) AS BIGINT),
        'n_repeat_words', CAST({_repeated_words("w")} AS BIGINT))"""
    lines = _let(f"filter(split(t, '\\n'), s -> s RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')", "l", counts)
    words = _let(f"filter(split(t, '{_SPACE}+'), x -> x <> '')", "w", lines)
    return docs.withColumn(into, F.expr(_let(f"coalesce(`{text_col}`, '')", "t", words)))


def base_failed(q: str = "quality") -> F.Column:
    return (F.col(f"{q}.n_words") < 50) | (100 * F.col(f"{q}.n_repeat_words") > 50 * F.col(f"{q}.n_words"))


def verdict(q: str = "quality", thresholds=THRESHOLDS) -> F.Column:
    """The threshold table as one boolean: thousandths compared as whole numbers, so no ratio is rounded."""
    fits = F.lit(True)
    for _, part, whole, least, most in thresholds:
        a, b = 1000 * F.col(f"{q}.{part}"), F.col(f"{q}.{whole}")
        fits = fits & (a >= round(1000 * least) * b if least is not None else F.lit(True)) & (a <= round(1000 * most) * b if most is not None else F.lit(True))
    return fits


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of measure(), base_failed (under 50 words, or half of the words in repeated windows), kept."""
    own = measure(pick(docs, doc_id=id_col, text=text_col)).drop("text")
    return own.select("doc_id", "quality.*", base_failed().alias("base_failed"), (~base_failed() & verdict()).alias("kept"))


def keep(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns, that the rules keep."""
    name = "quality_counts_of_the_rules"
    return measure(docs, text_col=text_col, into=name).where(~base_failed(name) & verdict(name)).drop(name)
