"""Recompute derivations that are given as steps of arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One step: an operator of + - * / %, and each operand as a number or as the result of an earlier
#: step (counted from 0). `(120 - 100) / 100` is [(-, 120, 100), (/, step 0, 100)].
STEPS = (
    "array<struct<op:string,left:double,left_step:int,right:double,right_step:int>>"
)


def recomputed(steps: Column) -> Column:
    """The result of the last step; NULL when a step has no value (unknown operator, missing
    operand, division by zero, overflow) or there is none."""

    def operand(done: Column, value: Column, step: Column) -> Column:
        return F.when(step.isNull(), value).otherwise(F.get(done, step))

    def add(done: Column, step: Column) -> Column:
        a = operand(done, step["left"], step["left_step"])
        b = operand(done, step["right"], step["right_step"])
        remainder = a - b * F.floor(a / F.nullif(b, F.lit(0.0)))
        value = (
            F.when(step["op"] == "+", a + b)
            .when(step["op"] == "-", a - b)
            .when(step["op"] == "*", a * b)
            .when(step["op"] == "/", a / F.nullif(b, F.lit(0.0)))
            .when(step["op"] == "%", remainder)
        )
        finite = F.when(F.abs(value) < float("inf"), value)
        return F.concat(done, F.array(finite))

    values = F.aggregate(steps, F.array().cast("array<double>"), add)
    return F.try_element_at(values, F.lit(-1))
