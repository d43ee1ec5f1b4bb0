"""Folds over arrays that put out an element for each step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Items of a page.
PAGE = 64


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), with value computed once, however often make uses it."""
    return F.element_at(F.transform(F.array(value), make), 1)


def scan(items: Column, first: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """array<kind> of what each step puts out, in order; null elements are left out.

    first: the state before the first item; step(state, item) gives (new state, element).
    `aggregate` copies its accumulator at each step, so an accumulator that grows with the items makes
    the work grow with their square. Here a fold finds the state before each page of PAGE items, and
    each page is then folded for itself, so what is copied is a page, or one state per page.
    """
    return once(items, lambda held: _scan(held, first, step, kind))


def _scan(items: Column, first: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    n = F.size(items)
    pages = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / PAGE).cast("int")), lambda p: F.slice(items, p * PAGE + 1, F.lit(PAGE))))
    states = F.aggregate(
        pages,
        F.struct(first.alias("state"), F.array_remove(F.array(first), first).alias("before")),
        lambda acc, page: F.struct(F.aggregate(page, acc["state"], lambda s, x: step(s, x)[0]).alias("state"), F.concat(acc["before"], F.array(acc["state"])).alias("before")),
        lambda acc: acc["before"],
    )
    none = F.array().cast(f"array<{kind}>")

    def put(acc: Column, x: Column) -> Column:
        state, element = step(acc["state"], x)
        return F.struct(state.alias("state"), F.when(element.isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(element))).alias("out"))

    folded = F.zip_with(pages, states, lambda page, state: F.aggregate(page, F.struct(state.alias("state"), none.alias("out")), put, lambda acc: acc["out"]))
    return F.coalesce(F.flatten(folded), none)
