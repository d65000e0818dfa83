"""Repair of broken JSON objects as a column function.

A reply is cut into tokens, and a fold over them writes valid JSON: it closes open strings and
brackets, drops commas that lead to nothing and closers that match nothing, adds commas,
colons and values that are missing, and quotes bare words. What follows the first object is left out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Strings in double or single quotes (perhaps never closed), punctuation, and runs of anything else.
_TOKENS = r"""(?s)"(?:[^"\\]|\\.)*(?:"|\\?\z)|'(?:[^'\\]|\\.)*(?:'|\\?\z)|[{}\[\],:]|[^\s{}\[\],:"']+"""
_PLAIN = r"^(?:true|false|null|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)$"


def _value(token: Column) -> Column:
    """A token as a JSON value; backslashes that start no escape are dropped."""
    sound = F.regexp_replace(token, r'(\\(?:["\\/bfnrt\']|u[0-9a-fA-F]{4}))|\\', "$1")
    inner = F.regexp_replace(F.regexp_replace(sound, "^'", ""), r"(?<!\\)((?:\\\\)*)'\z", "$1")
    # Each double quote gets one backslash, besides pairs of them.
    single = F.concat(F.lit('"'), F.regexp_replace(F.replace(inner, F.lit("\\'"), F.lit("'")), r'(?<!\\)((?:\\\\)*)\\?"', r'$1\\"'), F.lit('"'))
    double = F.replace(sound, F.lit("\\'"), F.lit("'"))
    open_ = ~token.rlike(r'(?s)^"(?:[^"\\]|\\.)*"\z')
    return (
        F.when(token.startswith('"'), F.when(open_, F.concat(double, F.lit('"'))).otherwise(double))
        .when(token.startswith("'"), single)
        .when(token.rlike(_PLAIN), token)
        .otherwise(F.concat(F.lit('"'), F.replace(token, F.lit("\\"), F.lit("\\\\")), F.lit('"')))
    )


def _dangling(state: Column) -> Column:
    """What completes the member or element that the text ends in."""
    return F.when(state["prev"] == ":", F.lit("null")).when(state["prev"] == "k", F.lit(":null")).otherwise("")


def _uncomma(text: Column) -> Column:
    return F.regexp_replace(text, r",\z", "")


def repaired_json(text: Column) -> Column:
    """The first JSON object of a text, made valid; null where there is none."""
    tokens = F.regexp_extract_all(F.regexp_extract(text, r"(?s)\{.*", 0), F.lit(_TOKENS), F.lit(0))
    state = lambda out, stack, prev: F.struct(out.alias("out"), stack.alias("stack"), prev.alias("prev"))
    start = F.struct(F.lit("").alias("out"), F.lit("").alias("stack"), F.lit("o").alias("prev"))

    def step(s: Column, t: Column) -> Column:
        out, stack, prev = s["out"], s["stack"], s["prev"]
        top = F.right(stack, F.lit(1))
        # What has to stand before a new key or value.
        glue = F.when(prev == "v", F.lit(",")).when(prev == "k", F.lit(":")).otherwise("")
        key = (top == "}") & ~prev.isin("k", ":")
        opened = state(F.concat(out, glue, t), F.concat(stack, F.when(t == "{", "}").otherwise("]")), F.lit("o"))
        # A closer also closes what is open inside of it.
        inner = F.substring(F.reverse(stack), F.lit(1), F.position(t, F.reverse(stack)))
        shut = F.concat(_uncomma(F.concat(out, _dangling(s))), inner)
        closed = state(shut, F.left(stack, F.length(stack) - F.length(inner)), F.when(F.length(stack) == F.length(inner), F.lit("d")).otherwise("v"))
        written = F.when(key & t.rlike(_PLAIN), F.concat(F.lit('"'), t, F.lit('"'))).otherwise(_value(t))
        given = state(F.concat(out, glue, written), stack, F.when(key, F.lit("k")).otherwise("v"))
        comma = F.when(prev.isin("v", "k", ":"), state(F.concat(out, _dangling(s), F.lit(",")), stack, F.lit(","))).otherwise(s)
        return (
            F.when(prev == "d", s)
            .when(t.isin("{", "["), F.when(key & (F.length(stack) > 0), s).otherwise(opened))
            .when(t.isin("}", "]"), F.when(F.contains(stack, t), closed).otherwise(s))
            .when(t == ",", comma)
            .when(t == ":", F.when(prev == "k", state(F.concat(out, t), stack, F.lit(":"))).otherwise(s))
            .otherwise(given)
        )

    def finish(s: Column) -> Column:
        return F.when(s["prev"] == "d", s["out"]).otherwise(F.concat(_uncomma(F.concat(s["out"], _dangling(s))), F.reverse(s["stack"])))

    return F.when(F.size(tokens) > 0, F.aggregate(tokens, start, step, finish))
