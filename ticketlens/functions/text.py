"""Text builders (P1-P3) and the tokenizer / n-gram expansion.

All are Column expressions, so they run inside whole-stage codegen
(the n-gram expansion uses a higher-order function, evaluated in the JVM).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# These character classes decide which tokens and which
# whitespace exist; they must equal the reference's library behaviour.
# Word characters: letters, digits and underscore; a token is a run of 2+.
TOKEN_PATTERN = r"([\p{L}\p{N}_]{2,})"
# Whitespace as Python's str.isspace() sees it (also RE2 / DuckDB).
WHITESPACE_CLASS = r"[\t-\r\x{1C}-\x{20}\x{85}\p{Z}]"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def training_text(subject, description) -> Column:
    """P1 + P3: nulls -> '', join with a space, lowercase, collapse every
    whitespace run to one space, trim."""
    joined = F.concat(F.coalesce(_col(subject), F.lit("")), F.lit(" "),
                      F.coalesce(_col(description), F.lit("")))
    collapsed = F.regexp_replace(F.lower(joined), WHITESPACE_CLASS + "+", " ")
    return F.trim(collapsed)


def serving_text(subject, description) -> Column:
    """Join with a space, lowercase, strip leading/trailing whitespace;
    inner whitespace is kept as is."""
    joined = F.lower(F.concat(_col(subject), F.lit(" "), _col(description)))
    return strip_ws(joined)


def strip_ws(c) -> Column:
    """Python ``str.strip()``: anchored removal of Unicode whitespace."""
    ws = WHITESPACE_CLASS
    return F.regexp_replace(_col(c), f"^{ws}+|{ws}+$", "")


def tokens(text) -> Column:
    """Runs of >= 2 word characters of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN_PATTERN), 1)


def ngrams(tok) -> Column:
    """Unigrams followed by bigrams (neighbours joined by one space)."""
    t = _col(tok)
    n = F.size(t)
    bigrams = F.when(
        n >= 2,
        F.transform(F.sequence(F.lit(0), n - 2),
                    lambda i: F.concat(t[i], F.lit(" "), t[i + 1])),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(t, bigrams)


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row: a lambda
    variable is never copied into the places that use it."""
    return F.transform(F.array(value), body)[0]


def term_frequencies(terms) -> Column:
    """``array<struct<term, tf>>`` of an array of terms, inside the row: the
    terms are sorted, the first of each run marks its place, and the next
    mark gives its length."""
    def runs(s):
        placed = F.transform(s, lambda x, i: F.struct(x.alias("term"), i.alias("at")))
        firsts = F.filter(placed, lambda e: (e.at == 0) | (e.term != F.element_at(s, F.greatest(e.at, F.lit(1)))))
        return bind(firsts, lambda r: F.zip_with(
            r, F.concat(F.transform(F.slice(r, 2, F.size(r)), lambda e: e.at), F.array(F.size(s))),
            lambda e, end: F.struct(e.term.alias("term"), (end - e.at).cast("long").alias("tf"))))

    return bind(F.sort_array(_col(terms)), lambda s: F.when(
        F.size(s) == 0, F.array().cast("array<struct<term:string,tf:bigint>>")).otherwise(runs(s)))
