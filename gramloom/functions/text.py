"""Column functions over text: sentences, words, n-grams, delimiters, trimming and searching. All are built-ins of the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gramloom.config import BOS, EOS

#: Unicode white space, as a Java pattern.
WHITE = "(?U)\\s+"


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def words(text: Column | str) -> Column:
    """The words of a text, parted by Unicode white space. Null gives null."""
    return F.filter(F.split(_col(text), WHITE), lambda w: w != "")


def sentence(text: Column | str, bos: bool = True, eos: bool = True) -> Column:
    """The words of a line between its markers."""
    parts = [F.array(F.lit(BOS))] * bos + [words(text)] + [F.array(F.lit(EOS))] * eos
    return F.concat(*parts)


def lines(text: Column | str) -> Column:
    """The lines of a text, a trailing CR cut off."""
    return F.transform(F.split(_col(text), "\n"), lambda x: F.regexp_replace(x, "\\r$", ""))


def ngrams(tokens: Column | str, order: int, least: int = 1) -> Column:
    """Structs (n, ngram) of all runs of `least` to `order` tokens, space-joined."""
    t = _col(tokens)
    empty = F.array().cast("array<struct<n:int,ngram:string>>")

    def runs(n: int) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice(t, i, n), " ").alias("ngram")))
        return F.when(F.size(t) >= n, found).otherwise(empty)

    return F.concat(*map(runs, range(least, order + 1)))


def exploded_ngrams(rows: DataFrame, tokens: str, order: int, least: int = 1) -> DataFrame:
    """The other columns of rows, n, ngram: a row for each run of `least` to `order` of a list's tokens.

    A row holds a number that tells its n-gram, which is put together afterwards, so that all of it is compiled code.
    """
    kinds = order - least + 1
    others = [F.col(f"`{c}`") for c in rows.columns if c != tokens]
    found = rows.where(F.size(tokens) > 0).select(*others, tokens, F.explode(F.sequence(F.lit(0), F.size(tokens) * kinds - 1)).alias("__x"))
    found = found.select(*others, tokens, F.expr(f"CAST(__x DIV {kinds} AS INT)").alias("__i"), F.expr(f"CAST(__x % {kinds} + {least} AS INT)").alias("n")).where(F.col("__i") + F.col("n") <= F.size(tokens))
    return found.select(*others, "n", F.array_join(F.slice(tokens, F.col("__i") + 1, F.col("n")), " ").alias("ngram"))


def sort_text(ngram: Column | str) -> Column:
    """A space-joined n-gram as a text that sorts by code points as its list of words does: words end with \\x00, and \\x00 and \\x01 in them are spelt out."""
    g = F.replace(F.replace(_col(ngram), F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01"))
    return F.replace(g, F.lit(" "), F.lit("\x00"))


def prefix(ngram: Column | str) -> Column:
    """A space-joined n-gram without its last word; "" for one word."""
    g = _col(ngram)
    return F.substring(g, F.lit(1), F.greatest(F.length(g) - F.length(last_word(g)) - 1, F.lit(0)))


def suffix(ngram: Column | str) -> Column:
    """A space-joined n-gram without its first word; "" for one word."""
    g = _col(ngram)
    return F.when(F.instr(g, " ") > 0, F.substring(g, F.instr(g, " ") + 1, F.length(g))).otherwise(F.lit(""))


def first_word(ngram: Column | str) -> Column:
    return F.substring_index(_col(ngram), " ", 1)


def last_word(ngram: Column | str) -> Column:
    return F.substring_index(_col(ngram), " ", -1)


def word_at(ngram: Column | str, i: int) -> Column:
    """The i-th word (from 0), null beyond the end."""
    return F.get(F.split(_col(ngram), " "), i)


def order_of(ngram: Column | str) -> Column:
    g = _col(ngram)
    return F.when(g == "", 0).otherwise(F.length(g) - F.length(F.replace(g, F.lit(" "), F.lit(""))) + 1).cast("int")


def all_runs(tokens: Column | str) -> Column:
    """The set of all runs of a list's words, space-joined and sorted. Give the list as a column, or it's built for each run."""
    t = _col(tokens)
    n = F.size(t)
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n - i + 1), lambda k: F.array_join(F.slice(t, i, k), " ")))
    return F.when(n > 0, F.array_sort(F.array_distinct(F.flatten(runs)))).otherwise(F.array().cast("array<string>"))


def phrase_ngrams(line: Column | str) -> Column:
    """The set of all runs of words of what stands before the first |||, sorted."""
    return all_runs(words(F.substring_index(_col(line), "|||", 1)))


# --- delimiters and trimming ----------------------------------------------------------------------------------------


def _any_of(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):x}}}" for c in chars) + "]"


def split_on(text: Column | str, delimiter: str, kind: str = "multi", skip_empty: bool = True) -> Column:
    """Tokens between delimiters. kind: "multi" (the whole string), "any" (any one of its characters), "last" (only the
    last occurrence of any of them parts the text)."""
    t = _col(text)
    if kind == "multi":
        found = F.split(t, re.escape(delimiter) if delimiter.isascii() else "\\Q" + delimiter + "\\E")
    elif kind == "any":
        found = F.split(t, _any_of(delimiter))
    elif kind == "last":
        found = F.split(t, _any_of(delimiter) + "(?=[^" + _any_of(delimiter)[1:-1] + "]*$)", 2)
    else:
        raise ValueError(f"unknown kind {kind!r}")
    return F.filter(found, lambda x: x != "") if skip_empty else found


def trim_of(text: Column | str, chars: str = " \t\r\n") -> Column:
    """text without leading and trailing characters of the given set."""
    return F.regexp_replace(_col(text), f"^{_any_of(chars)}+|{_any_of(chars)}+$", "")


def is_blank(text: Column | str) -> Column:
    """Whether there is nothing but white space."""
    return _col(text).rlike("^(?U)\\s*$")


def is_arpa_text(text: Column | str) -> Column:
    """Whether a text, leading white space aside, begins as an ARPA model does."""
    return F.regexp_replace(_col(text), "^(?U)\\s+", "").startswith("\\data\\")


def number(text: Column | str, kind: str = "float") -> Column:
    """The number at a text's start after ASCII white space, up to the next; null where there is none. kind: float, double or long."""
    return F.regexp_extract(_col(text), "^[ \\t\\n\\r\\f\\x0B]*([^ \\t\\n\\r\\f\\x0B]*)", 1).try_cast(kind)


def nul_strings(text: Column | str) -> Column:
    """The strings of a NUL-separated list, empty ones left out."""
    return F.filter(F.split(_col(text), "\\x00"), lambda x: x != "")


def joined_by_nul(strings: Column | str) -> Column:
    """Strings each closed by NUL."""
    return F.concat(F.array_join(_col(strings), "\x00"), F.lit("\x00"))


def char_at(text: Column | str, offset: Column | int) -> Column:
    """The character at a place from 0; null at the end and beyond."""
    at = offset if isinstance(offset, Column) else F.lit(offset)
    return F.nullif(F.substring(_col(text), at + 1, F.lit(1)), F.lit(""))


def at_end(text: Column | str, offset: Column | int) -> Column:
    """Whether no character stands at a place from 0."""
    return F.length(_col(text)) <= (offset if isinstance(offset, Column) else F.lit(offset))


# --- searching: places count from 0, null where there's none ---------------------------------------------------------


def find(text: Column | str, what: Column | str) -> Column:
    return F.nullif(F.instr(_col(text), what), F.lit(0)) - 1


def rfind(text: Column | str, what: str) -> Column:
    t = _col(text)
    return F.when(F.contains(t, F.lit(what)), F.length(t) - F.length(F.substring_index(t, what, -1)) - len(what))


def find_first_of(text: Column | str, chars: str) -> Column:
    return F.nullif(F.regexp_instr(_col(text), F.lit(_any_of(chars))), F.lit(0)) - 1


def find_last_of(text: Column | str, chars: str) -> Column:
    return F.nullif(F.length(F.regexp_extract(_col(text), f"(?s)^(.*{_any_of(chars)})", 1)), F.lit(0)) - 1


def find_first_not_of(text: Column | str, chars: str) -> Column:
    return F.nullif(F.regexp_instr(_col(text), F.lit("[^" + _any_of(chars)[1:])), F.lit(0)) - 1


def find_last_not_of(text: Column | str, chars: str) -> Column:
    return F.nullif(F.length(F.regexp_extract(_col(text), f"(?s)^(.*[^{_any_of(chars)[1:]})", 1)), F.lit(0)) - 1


def compare(a: Column | str, b: Column | str) -> Column:
    """-1, 0 or 1 by code points."""
    x, y = _col(a), _col(b)
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)
