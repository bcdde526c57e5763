"""Definition names and definition texts."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that part a file's table name from its interval
# (hyphen, em dash, en dash, space, no-break space).
NAME_SEPARATORS = "-—– \u00a0"

# File name endings.
TEST_ENDING = "_test"
SELECT_ENDING = "_select"
REQUIREMENTS_ENDING = "requirements.txt"

# One dotted pair of words, each bare or in double quotes.  The look-ahead lets
# pairs overlap, so a.b.c yields a.b and b.c.  (?U): words in any alphabet.
_MENTION = r'(?U)(?=(\b"?\w+"?\."?\w+"?\b))'


def strip_comments(query: Column, block_comments: bool = False) -> Column:
    """Drop empty lines and everything from ``--`` to the end of its line.

    ``--`` inside a string literal also cuts its line.  ``/* */`` is left alone
    unless ``block_comments`` is set.
    """
    if block_comments:
        query = F.regexp_replace(query, r"(?s)/\*.*?\*/", " ")
    no_blank_lines = F.regexp_replace(F.regexp_replace(query, r"\n{2,}", "\n"), r"\A\n|\n\z", "")
    return F.regexp_replace(no_blank_lines, r"--[^\n]*", "")


def trim_statement(query: Column) -> Column:
    """Cut semicolons and line ends off the end of a statement."""
    return F.regexp_replace(query, r"[;\n]+\z", "")


def strip_lines(text: Column) -> Column:
    """Trim white space off both ends of every line; the last line end goes too."""
    return F.regexp_replace(F.regexp_replace(text, r"\n\z", ""), r"(?m)^[^\S\n]+|[^\S\n]+$", "")


def blank_if_null(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def mentioned_names(query: Column) -> Column:
    """Distinct ``schema.table`` pairs in the text, without quotes or comments."""
    pairs = F.regexp_extract_all(strip_comments(query), F.lit(_MENTION), F.lit(1))
    return F.array_distinct(F.transform(pairs, lambda pair: F.translate(pair, '"', "")))


def mentions(name: Column, query: Column) -> Column:
    """Whether ``query`` reads the table ``name`` (``schema.table``, case-sensitive)."""
    schema, table = F.split_part(name, F.lit("."), F.lit(1)), F.split_part(name, F.lit("."), F.lit(2))
    pattern = F.concat(
        F.lit(r'(?U)\b"?\Q'), schema, F.lit(r'\E"?\."?\Q'), table, F.lit(r'\E"?\b')
    )
    return F.regexp_like(strip_comments(query), pattern)


def retarget(statement: str, name: str, new_name: str) -> str:
    """Point a statement at ``new_name`` wherever it reads ``name`` as a whole word.

    Longer names that merely start with ``name`` are left alone.
    """
    schema, table = (re.escape(part) for part in name.split("."))
    return re.sub(rf'(?<![\w.])"?{schema}"?\."?{table}"?(?!\w)', lambda _: new_name, statement)


def _stem(path: Column) -> Column:
    return F.regexp_replace(path, r"\.[^./]*\z", "")


def file_table_name(path: Column, strict: bool = True) -> Column:
    """``schema.table`` for a path relative to the definition folder.

    The folder is the schema unless the file name itself has a dot.  Without a
    schema it raises, or gives NULL when ``strict`` is off.
    """
    head = F.regexp_extract(_stem(path), rf"\A[^{NAME_SEPARATORS}]*", 0)
    file_name = F.regexp_extract(head, r"[^/]*\z", 0)
    folder = F.regexp_extract(head, r"\A(.*)/", 1)
    named = F.when(F.contains(file_name, F.lit(".")), file_name).when(
        (folder != "") & ~F.contains(folder, F.lit("/")), F.concat(folder, F.lit("."), file_name)
    )
    if not strict:
        return named
    return named.otherwise(F.raise_error(F.concat(F.lit("no schema in file name: "), path)))


def file_interval(path: Column) -> Column:
    """The interval literal after the last separator of a file name, or NULL."""
    stem = _stem(path)
    tail = F.regexp_extract(stem, rf"[{NAME_SEPARATORS}]([^{NAME_SEPARATORS}]*)\z", 1)
    return F.when(F.rlike(stem, F.lit(f"[{NAME_SEPARATORS}]")), tail)
