"""Cleaning of instruction examples and analysis of failed answers."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_bugfix, masked_task, trimmed

# The errors by the category they show.
NAME_ERRORS = ("NameError", "AttributeError", "ImportError", "ModuleNotFoundError")
SYNTAX_ERRORS = ("SyntaxError", "IndentationError")


def removal_reasons(examples: DataFrame, held_out: DataFrame) -> DataFrame:
    """idx, reason of each example (idx, prompt, response) that goes: held-out before duplicate before contradiction.

    ``held_out`` (response) lists answers that compute an evaluation item. A
    duplicate repeats an earlier (prompt, response). A contradiction answers a
    task, its function's name masked, with another body than the first one;
    bug-fix rows are exempt. Bodies are compared as texts.
    """
    rows = examples.select("idx", "prompt", "response", F.xxhash64("response").alias("body"))
    held = held_out.select("response").distinct().withColumn("held", F.lit(True))
    rows = rows.join(held, "response", "left")
    first = rows.groupBy("prompt", "response").agg(F.min("idx").alias("first"))
    rows = rows.join(first, ["prompt", "response"])
    # minima are combined before they are shuffled, so a frequent task is a few rows
    tasks = rows.filter(~is_bugfix(F.col("prompt"))).withColumn("task", masked_task(F.col("prompt")))
    kept = tasks.groupBy("task").agg(F.min_by("body", "idx").alias("kept_body"))
    other = tasks.join(kept, "task").filter("body <> kept_body").select("idx", F.lit(True).alias("contradicts"))
    reason = F.when(F.col("held"), "held-out equivalent").when(F.col("idx") > F.col("first"), "duplicate").when(F.col("contradicts"), "contradiction")
    return rows.join(other, "idx", "left").select("idx", reason.alias("reason")).filter("reason is not null")


def failure_category(name: Column, code: Column, error: Column, defined: Column, buggy: Column, asserts: Column, copied: Column, factual: Column) -> Column:
    """The category of a failed answer, by ordered rules over what its run showed.

    ``error`` and the asserts' errors are (kind, msg); ``copied`` is the training function whose body it is.
    """
    failed = F.filter(asserts, lambda a: ~a["ok"])
    first_error = F.get(F.filter(failed, lambda a: a["error"].isNotNull()), 0)["error"]
    kind = error["kind"]
    parameters = r"positional argument|required argument|unexpected keyword"
    return (
        F.when(trimmed(code) == "", "formatting").when(kind.isin(*SYNTAX_ERRORS), "formatting").when(kind == "Timeout", "coding").when(kind.isin(*NAME_ERRORS), "hallucination").when(kind.isNotNull(), "coding")
        .when(~F.array_contains(defined, name) & (F.size(defined) > 0), "instruction_following").when(~F.array_contains(defined, name), "formatting")
        .when(trimmed(code) == trimmed(buggy), "instruction_following").when(copied.isNotNull() & (copied != name), "instruction_following")
        .when((first_error["kind"] == "TypeError") & first_error["msg"].rlike(parameters), "instruction_following").when(first_error["kind"].isin(*NAME_ERRORS), "hallucination").when(first_error.isNotNull(), "coding")
        .when(factual, "factual").otherwise("reasoning")
    )


def _parsed(tests: str) -> list[dict]:
    found = []
    for line in map(str.strip, tests.splitlines()):
        try:
            node = ast.parse(line).body[0] if line.startswith("assert ") else None
        except SyntaxError:
            continue
        if not isinstance(node, ast.Assert):
            continue
        match node.test:
            case ast.Compare(left=ast.Call(func=ast.Name(id="abs"), args=[ast.BinOp(left=call, op=ast.Sub(), right=expected), *_]), ops=[ast.Lt()]):
                kind = "approx"
            case ast.Compare(left=call, ops=[ast.Eq()], comparators=[expected]):
                kind = "eq"
            case ast.Compare(left=call, ops=[ast.Is()], comparators=[expected]):
                kind = "is"
            case ast.UnaryOp(op=ast.Not(), operand=call):
                kind, expected = "truth", ast.Constant(False)
            case call:
                kind, expected = "truth", ast.Constant(True)
        shown = lambda n: ast.get_source_segment(line, n) if hasattr(n, "lineno") else str(n.value)  # noqa: B023, E731
        found.append({"line": line, "call": shown(call), "expected": shown(expected), "kind": kind})
    return found


def parsed_tests(tests: Column) -> Column:
    """array of (line, call, expected, kind) of the assert lines of a test block; kind is eq, is, approx or truth."""

    @F.pandas_udf("array<struct<line:string,call:string,expected:string,kind:string>>")
    def parse(tests: pd.Series) -> pd.Series:
        return tests.map(lambda t: _parsed(t) if isinstance(t, str) else [])

    return parse(tests)


def last_answers(answers: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last answer of each key; combined before the shuffle."""
    rest = [c for c in answers.columns if c not in keys]
    return answers.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__last")).select(*keys, *[F.col("__last")[c].alias(c) for c in rest])


def transitions(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change (gained, lost, category_changed, same) of items of both runs (keys, pass, category)."""
    both = new.select(*keys, F.col("pass").alias("now"), F.col("category").alias("category_now")).join(old.select(*keys, F.col("pass").alias("was"), F.col("category").alias("category_was")), keys)
    change = F.when(F.col("now") & ~F.col("was"), "gained").when(F.col("was") & ~F.col("now"), "lost").when(~F.col("now") & ~F.col("category_now").eqNullSafe(F.col("category_was")), "category_changed").otherwise("same")
    return both.select(*keys, change.alias("change"))


