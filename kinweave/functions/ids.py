"""Kinds of concept ids by their range."""

from __future__ import annotations

from pyspark.sql import Column

#: First ids of each kind. Fixed values of the id scheme.
RECURRENT_START = 100_000_000_000
AND_START = 200_000_000_000
OR_START = 300_000_000_000
TOKEN_START = 400_000_000_000


def is_basic(c: Column) -> Column:
    return c < RECURRENT_START


def is_recurrent(c: Column) -> Column:
    return (c >= RECURRENT_START) & (c < AND_START)


def is_and(c: Column) -> Column:
    return (c >= AND_START) & (c < OR_START)


def is_or(c: Column) -> Column:
    return c >= OR_START
