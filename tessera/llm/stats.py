"""Per-document statistics shared by the quality operators. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import BLANKS, words

SYMBOLS = "#*$%&|<>"


def count_of(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are among ``characters``."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, BLANKS + " ", "")).cast("long")


def lines_with_words(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, BLANKS + " ", "")) > 0)


def duplicate_lines(lines: Column) -> Column:
    """How many lines equal an earlier one."""
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def text_words(text: Column) -> Column:
    return words(text)
