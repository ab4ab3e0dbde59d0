"""Small helpers to write one rule for both a table and an array of structs.

A *stage* is a function that takes an accessor ``get(name) -> Column`` and
returns ``{name: Column}``. The same stage widens a long table (one row for
each field, codegen friendly) and the items of an array column (one row for
each message, no shuffle needed to keep a message together).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Getter = Callable[[str], Column]
Stage = Callable[[Getter], dict[str, Column]]


def built_once(build: Callable[..., Column]) -> Callable[..., Column]:
    """Keep a large expression for the life of the JVM.

    Building one takes thousands of calls to the JVM, about a second. The
    arguments have to be hashable, so inputs are given as column names.
    """
    kept: dict[tuple, Column] = {}

    @wraps(build)
    def get(*args) -> Column:
        key = (id(SparkContext._gateway), *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return get


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A fold over an empty array: its start is the value, its finish the body.
    Unlike a transform of a one-item array this neither copies the result nor
    works out the type of the whole expression again for every row.
    """
    return F.aggregate(F.array(), value, lambda bound, _: bound, body)


def widen_table(df: DataFrame, stages: list[Stage]) -> DataFrame:
    for stage in stages:
        df = df.withColumns(stage(F.col))
    return df


def chain(get: Getter, stages: list[Stage], finish: Callable[[Getter], Column]) -> Column:
    """Run the stages for one item of an array and build the result from all that is known then.

    Each stage is bound once and read by reference. Spark copies what a lambda
    returns, so nothing is handed on in the result that a later stage could
    look up itself.
    """
    if not stages:
        return finish(get)
    new = stages[0](get)
    return let(
        F.struct(*[c.alias(n) for n, c in new.items()]),
        lambda found: chain(lambda n: found[n] if n in new else get(n), stages[1:], finish),
    )


def one_of(value: Column, *options: str) -> Column:
    """``value IN options`` as equalities: inside a lambda Spark leaves its own IN by an exception for every hit, at several microseconds."""
    out = value == options[0]
    for option in options[1:]:
        out = out | (value == option)
    return out


def first_of(branches: Iterable[tuple[Column, Column]], default: Column) -> Column:
    """One flat CASE: the value of the first branch that is true. NULL counts as false."""
    out = None
    for condition, value in branches:
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return default if out is None else out.otherwise(default)


def first_match(subject: Column, rules: list[tuple[str, str]], anchored: bool = False) -> Column:
    """Value of the first rule whose pattern is found in ``subject``."""
    branches = [
        (subject.rlike(f"^(?:{pattern})" if anchored else pattern), F.lit(value)) for pattern, value in rules
    ]
    return first_of(branches, F.lit(None).cast("string"))


def keep_last(items: Column, key: str) -> Column:
    """Dictionary update rules: the last item of a key wins, at the first place of that key."""

    def pick(keyed: Column) -> Column:
        keys = F.transform(keyed, lambda e: e[key])
        backwards = F.reverse(keys)
        return F.transform(
            F.array_distinct(keys),
            lambda k: F.get(keyed, (F.size(keyed) - F.array_position(backwards, k)).cast("int")),
        )

    def apply(bound: Column) -> Column:
        keys = F.transform(bound, lambda e: e[key])
        clean = F.size(F.array_distinct(keys)) == F.size(bound)
        return F.when(clean, bound).otherwise(pick(bound))

    return let(items, apply)
