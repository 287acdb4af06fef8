"""Fill-in-the-middle transformation by one regular expression a row.

A text is a run of n units (lines). Two hashed cut points a <= b give each row a pattern of its own: a possessive group of a units, one of b - a units, and
the rest. One replacement with that pattern writes the three parts in their new order. Possessive counts take the units in a loop, without a stack
that grows with the text. All of it are built-in expressions of the scan's stage: no shuffle, no Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINE = r"(?:[^\n]*+\n|[^\n]++)"  # a unit; its quantifiers need no way back, since a line has one end
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class Params:
    """``rate``: of 100 rows, those that are transformed; ``spm``: of 100 transformed rows, those with the suffix first."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    unit: str = LINE


def _hash(digest: Column, i: int) -> Column:
    return F.conv(F.substr(digest, F.lit(8 * i + 1), F.lit(8)), 16, 10).cast("long")


def _least(x: Column, y: Column, n: Column) -> tuple[Column, Column]:
    return F.least(x % (n + 1), y % (n + 1)), F.greatest(x % (n + 1), y % (n + 1))


def transform(docs: DataFrame, params: Params = Params(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm) and output; one row per input row, also for repeated ids.

    The cut points and the form are decided by the id's hash; a null id counts as no digits. A null text is the empty text. Empty texts and those that hold
    one of the three marks stay as they are (plain).
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{params.seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id).alias("doc_id"), body.alias("_text"), digest.alias("_digest"))
    rows = rows.withColumn("n", F.regexp_count("_text", F.lit(params.unit)).cast("long"))
    h = [_hash(F.col("_digest"), i) for i in range(4)]
    marked = F.contains("_text", F.lit(PREFIX)) | F.contains("_text", F.lit(SUFFIX)) | F.contains("_text", F.lit(MIDDLE))
    plain = (F.col("_text") == "") | marked | (h[2] % 100 >= params.rate)
    form = F.when(plain, "plain").when(h[3] % 100 < params.spm, "spm").otherwise("psm")
    a, b = _least(h[0], h[1], F.col("n"))
    pattern = F.concat(F.lit(rf"(?s)\A((?:{params.unit}){{"), a.cast("string"), F.lit(rf"}}+)((?:{params.unit}){{"), (b - a).cast("string"), F.lit(r"}+)(.*+)\z"))
    order = F.when(F.col("form") == "spm", f"{SUFFIX}$3{PREFIX}$1{MIDDLE}$2").otherwise(f"{PREFIX}$1{SUFFIX}$3{MIDDLE}$2")
    rows = rows.select("doc_id", "n", form.alias("form"), "_text", pattern.alias("_pattern"))
    return rows.select("doc_id", "n", "form", F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", F.col("_pattern"), order)).alias("output"))


def _place(mark: str) -> Column:
    return F.instr(F.col("output"), mark)


def prefix_chars() -> Column:
    """Code points of the prefix, read from the output; null if plain. Each mark occurs once in an output: two marks never overlap."""
    wide = len(PREFIX)
    return F.when(F.col("form") == "psm", _place(SUFFIX) - 1 - wide).when(F.col("form") == "spm", _place(MIDDLE) - _place(PREFIX) - wide).cast("long")


def middle_chars() -> Column:
    return F.when(F.col("form") != "plain", F.char_length("output") - _place(MIDDLE) - len(MIDDLE) + 1).cast("long")


def restore(rows: DataFrame, name: str = "restored") -> DataFrame:
    """The rows with the text rebuilt from output and form, exactly."""
    psm = F.regexp_replace("output", rf"(?s)\A{PREFIX}(.*?){SUFFIX}(.*?){MIDDLE}(.*+)\z", "$1$3$2")
    spm = F.regexp_replace("output", rf"(?s)\A{SUFFIX}(.*?){PREFIX}(.*?){MIDDLE}(.*+)\z", "$2$3$1")
    return rows.withColumn(name, F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("output")))
