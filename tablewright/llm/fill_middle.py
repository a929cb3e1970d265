"""Fill-in-the-middle transformation: a text is cut in three at unit borders and its middle moved to the end.

Units (lines, by default) are counted by one regular expression. Where a text is cut follows from a hash of its id, so a row gets the same cut in
every run. The cut itself is one match: each row has a pattern of its own, in which two possessive groups take exactly ``a`` and ``b - a`` units
and a third the rest. Possessive groups never go back into a unit, so a match is one pass over the text at any length.

Everything is a column expression; rows stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A line with its end, or a last line without one. No capturing groups: the pattern around it counts on its own three.
LINE = r"[^\n]*+\n|[^\n]++"
# Marks of the three parts. A text that holds one of them stays plain, so the marks of an output are always where they were put.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
# For each form, in which order an output has the parts (1 prefix, 2 middle, 3 suffix) behind their marks.
LAID_OUT = {PSM: [(PREFIX, 1), (SUFFIX, 3), (MIDDLE, 2)], SPM: [(SUFFIX, 3), (PREFIX, 1), (MIDDLE, 2)]}


def hashed_numbers(row_id: Column, seed: int, count: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers from the sha256 of ``seed:id``; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(count)]


def three_parts(text: Column, first: Column, second: Column, replacement: Column, unit: str = LINE) -> Column:
    """``replacement`` with ``$1``, ``$2`` and ``$3`` for the first ``first`` units of the text, those up to ``second``, and the rest."""
    taken = lambda n: F.concat(F.lit(f"((?:{unit}){{"), n.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"(?s)\A"), taken(first), taken(second - first), F.lit(r"(.*+)\z"))
    return F.regexp_replace(text, pattern, replacement)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINE, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """``id_col, n, form, prefix_chars, middle_chars, output`` for every row; other columns are not read.

    ``n`` units; ``rate`` percent of the rows are cut, of these ``spm_rate`` percent with the suffix first (``spm``), the others with the prefix
    first (``psm``). A text that is null (taken as empty), empty or holds a mark is ``plain``: the output is the text and the lengths, in code
    points, are null. Each row stands for itself: equal ids get equal numbers, an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2, h3, h4 = hashed_numbers(F.col(id_col), seed)
    counted = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.regexp_count(text, F.lit(unit)).cast("long").alias("n"), h1.alias("h1"), h2.alias("h2"), h3.alias("h3"), h4.alias("h4"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("text", F.lit(mark))
    form = F.when((F.col("n") == 0) | marked | (F.col("h3") % 100 >= rate), PLAIN).when(F.col("h4") % 100 < spm_rate, SPM).otherwise(PSM)
    ends = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    chosen = counted.select("id", "text", "n", form.alias("form"), F.least(*ends).alias("first"), F.greatest(*ends).alias("second"))
    laid_out = F.when(F.col("form") == SPM, _replacement(SPM)).otherwise(_replacement(PSM))
    output = F.when(F.col("form") == PLAIN, F.col("text")).otherwise(three_parts(F.col("text"), F.col("first"), F.col("second"), laid_out, unit))
    done = chosen.select("id", "n", "form", output.alias("output"))
    at = lambda mark: F.locate(mark, F.col("output"))
    prefix = F.when(F.col("form") == PSM, at(SUFFIX) - 1 - len(PREFIX)).when(F.col("form") == SPM, at(MIDDLE) - at(PREFIX) - len(PREFIX))
    middle = F.when(F.col("form") != PLAIN, F.length("output") - (at(MIDDLE) - 1 + len(MIDDLE)))
    return done.select(F.col("id").alias(id_col), "n", "form", prefix.cast("long").alias("prefix_chars"), middle.cast("long").alias("middle_chars"), "output")


def _replacement(form: str) -> str:
    return "".join(f"{mark}${part}" for mark, part in LAID_OUT[form])


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from."""

    def back(of: str) -> Column:
        marks = [mark for mark, _ in LAID_OUT[of]]
        place = {part: group + 1 for group, (_, part) in enumerate(LAID_OUT[of])}
        return F.regexp_replace(output, rf"(?s)\A{marks[0]}(.*?){marks[1]}(.*?){marks[2]}(.*+)\z", "".join(f"${place[part]}" for part in (1, 2, 3)))

    return F.when(form == PSM, back(PSM)).when(form == SPM, back(SPM)).otherwise(output)
