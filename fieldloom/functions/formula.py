"""Explicit conversion formulas as programs in postfix order, kept as a table and run by Spark's own expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.functions.rounding import exact_round
from fieldloom.functions.rows import let, one_of
from fieldloom.session import materialise

# the name ``value``, a decimal number, one sign; spaces may follow
_TOKEN = re.compile(r"(?:(value)(?![\w.])|((?:\d+\.?\d*|\.\d+)(?:e[-+]?\d+)?)(?![\w.])|([-+*/()])) *")
_LEADING_ZERO = re.compile(r"0+[1-9]\d*")
_ORDER = {"+": 1, "-": 1, "*": 2, "/": 2, "~": 3}

STEP = T.StructType().add("op", "string").add("number", "double")


def formula_program(formula: str) -> list[tuple[str, float | None]] | None:
    """The formula in postfix order: ``n`` pushes a number, ``v`` the value, ``~`` negates, the others take two.

    None if it is anything but the four operators, signs and brackets over ``value`` and numbers.
    """
    out: list[tuple[str, float | None]] = []
    waiting: list[str] = []
    at, operand = 0, False  # operand: the last token ends one
    while at < len(formula):
        found = _TOKEN.match(formula, at)
        if found is None:
            return None
        at = found.end()
        value, number, sign = found.groups()
        if (value or number or sign == "(") and operand:
            return None
        if value:
            out.append(("v", None))
        elif number:
            if _LEADING_ZERO.fullmatch(number):
                return None
            out.append(("n", float(number)))
        elif sign == "(":
            waiting.append(sign)
        elif not operand:
            if sign not in "+-":
                return None
            if sign == "-":
                waiting.append("~")
        elif sign == ")":
            while waiting and waiting[-1] != "(":
                out.append((waiting.pop(), None))
            if not waiting:
                return None
            waiting.pop()
        else:
            while waiting and waiting[-1] != "(" and _ORDER[waiting[-1]] >= _ORDER[sign]:
                out.append((waiting.pop(), None))
            waiting.append(sign)
        operand = bool(value or number) or sign == ")"
    if not operand or "(" in waiting:
        return None
    return out + [(op, None) for op in reversed(waiting)]


@F.pandas_udf(T.ArrayType(STEP))
def _program(formulas: pd.Series) -> pd.Series:
    return formulas.map(lambda f: None if f is None else formula_program(f))


def formula_programs(mappings: DataFrame) -> DataFrame:
    """The written table of the distinct formulas of ``mappings``: conversion_formula and its program, NULL if it is refused.

    Each formula is read once, however many mappings and messages use it; there may be any number of them.
    """
    formulas = materialise(mappings.where("conversion_formula <> ''").select("conversion_formula").distinct())
    return materialise(formulas.withColumn("program", _program("conversion_formula")))


def run_program(program: Column, value: Column) -> Column:
    """The result, rounded to 6 decimals; NULL without a program or value, or if something is divided by zero."""

    def step(stack: Column, s: Column) -> Column:
        b, a, op = F.get(stack, F.lit(0)), F.get(stack, F.lit(1)), s["op"]
        two = F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).otherwise(a / F.nullif(b, F.lit(0.0)))
        pushed = F.when(op == "n", s["number"]).when(op == "v", value)
        return (F.when(one_of(op, "n", "v"), F.concat(F.array(pushed), stack))
                .when(op == "~", F.concat(F.array(-b), F.slice(stack, 2, F.size(stack))))
                .otherwise(F.concat(F.array(two), F.slice(stack, 3, F.size(stack)))))

    result = F.aggregate(program, F.array().cast("array<double>"), step, lambda stack: F.get(stack, F.lit(0)))
    return let(result, lambda x: exact_round(x, 6))
