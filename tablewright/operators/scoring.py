"""Predicted answers against references: matches, distances and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.binding import let
from tablewright.functions.normalize import normalize_texts
from tablewright.functions.numbers import is_int_text, to_float
from tablewright.functions.text import SPAN_DELIMITER, strip

# Unit words in the order they are stripped, and the words that answer no and yes.
UNITS = [
    "year", "episodes", "m", "million", "weeks", "week", "mm", "nd", "th", "days", "years",
    "events", "£", "miles", "kg", "$", "days", ",", "losses", "l", "season",
]
NO_WORDS = ["none", "no", "older", "lower", "less", "below", "false", "f"]
YES_WORDS = ["more", "yes", "above", "true", "higher", "first", "once"]
YES_NUMBER = 1.0
TOLERANCE = 1e-6
EXACT_UP_TO = float(2**53)


# --- span matching ---


def _number_or_word(text: Column) -> Column:
    """A number where the text reads as one, else its trimmed text. Negative zero is zero."""
    return let(
        to_float(text), lambda n: F.struct((n + 0.0).alias("num"), F.when(n.isNull(), strip(text)).alias("word"))
    )


def spans(answer: Column) -> Column:
    """The spans of an answer as sorted (number, word) pairs; numbers compare as numbers."""
    return F.sort_array(F.transform(F.split(F.lower(answer), SPAN_DELIMITER, -1), lambda s: _number_or_word(s)))


def given(answer: str) -> Column:
    """A missing answer counts as empty text, in matches and distances alike."""
    return F.coalesce(F.col(answer), F.lit(""))


def denotation_match(predictions: DataFrame, pred: str = "pred", ref: str = "ref") -> DataFrame:
    """Adds ``is_correct``: both answers hold the same spans, each as often, in any order. NaN equals nothing."""
    split = predictions.withColumns({"_p": spans(strip(given(pred))), "_r": spans(strip(given(ref)))})
    has_nan = F.exists("_p", lambda s: F.coalesce(F.isnan(s["num"]), F.lit(False)))
    return split.withColumn("is_correct", (F.col("_p") == F.col("_r")) & ~has_nan).drop("_p", "_r")


def edit_distance(pred: Column, ref: Column) -> Column:
    """Levenshtein distance without case and outer spaces."""
    return F.levenshtein(F.lower(strip(pred)), F.lower(strip(ref)))


# --- typed values ---


def typed_values(texts: Column, normal: Column) -> Column:
    """Texts as values: numbers, dates (``xx`` for an unknown part; a lone year is a number) or words.

    ``normal`` holds the normalised texts, as ``normalize_texts`` gives them.
    """

    def part(text: Column, unknown: list[str]) -> Column:
        return F.when(text.isin(*unknown), F.lit(-1)).when(is_int_text(text), strip(text).try_cast("int"))

    def date(parts: Column) -> Column:
        read = F.struct(
            part(F.get(parts, F.lit(0)), ["xx", "xxxx"]).alias("y"),
            part(F.get(parts, F.lit(1)), ["xx"]).alias("m"),
            part(F.get(parts, F.lit(2)), ["xx"]).alias("d"),
        )

        def checked(ymd: Column) -> Column:
            known = ymd["y"].isNotNull() & ((ymd["y"] != -1) | (ymd["m"] != -1) | (ymd["d"] != -1))
            month_fits = (ymd["m"] == -1) | ymd["m"].between(1, 12)
            return F.when(known & month_fits & ((ymd["d"] == -1) | ymd["d"].between(1, 31)), ymd)

        return F.when(F.size(parts) == 3, let(read, checked))

    def read(text: Column, norm: Column) -> Column:
        number = let(to_float(text), lambda n: F.when(~F.isnan(n) & (F.abs(n) != float("inf")), n))
        # Beyond 2^53 doubles skip whole numbers, so there the digits themselves are compared.
        digits = F.replace(strip(text), F.lit("_"), F.lit("")).try_cast("decimal(38,0)")
        whole = F.when(is_int_text(text) & (F.abs(to_float(text)) >= EXACT_UP_TO), digits)
        return F.struct(
            norm.alias("norm"), number.alias("number"), whole.alias("whole"), let(F.split(F.lower(text), "-", -1), date).alias("date")
        )

    def near_whole(number: Column) -> Column:
        """A number within the tolerance of a whole one loses its fraction."""

        def settle(nearest: Column) -> Column:
            cut = F.when(F.abs(number) < F.abs(nearest), nearest - F.signum(nearest)).otherwise(nearest)
            return F.when(F.abs(number - nearest) < TOLERANCE, cut + 0.0).otherwise(number)

        return let(F.rint(number), settle)

    def keyed(v: Column) -> Column:
        lone_year = (v["date"]["m"] == -1) & (v["date"]["d"] == -1)
        number = F.coalesce(v["number"], F.when(lone_year, v["date"]["y"].cast("double")))
        is_number, is_date = v["number"].isNotNull() | F.coalesce(lone_year, F.lit(False)), v["date"].isNotNull()
        key = F.struct(
            F.when(is_number, F.lit("number")).when(is_date, F.lit("date")).otherwise(F.lit("text")).alias("kind"),
            F.when(~is_number & ~is_date, v["norm"]).alias("word"),
            let(number, near_whole).alias("num"),
            v["whole"].alias("whole"),
            F.when(~is_number, v["date"]).alias("date"),
        )
        return F.struct(key.alias("key"), v["norm"].alias("norm"))

    return F.transform(F.zip_with(texts, normal, read), keyed)


def first_of_equal(values: Column) -> Column:
    """Drop values whose key came earlier in the list."""
    keys = F.transform(values, lambda v: v["key"])
    return let(keys, lambda k: F.filter(values, lambda v, i: F.array_position(k, v["key"]) == i + 1))


def values_match(a: Column, b: Column) -> Column:
    """Equal normalised text, numbers within the tolerance, or equal dates."""
    same_whole = F.coalesce(a["key"]["whole"] == b["key"]["whole"], F.lit(True))
    close = (F.abs(a["key"]["num"] - b["key"]["num"]) < TOLERANCE) & same_whole
    same_date = a["key"]["date"] == b["key"]["date"]
    return (a["norm"] == b["norm"]) | F.coalesce(close, F.lit(False)) | F.coalesce(same_date, F.lit(False))


def _all_targets_found(target: str, pred: str) -> Column:
    found = F.forall(target, lambda t: F.exists(pred, lambda p: F.coalesce(values_match(t, p), F.lit(False))))
    return (F.size(target) == F.size(pred)) & found


def with_values(answers: DataFrame, **lists: str) -> DataFrame:
    """Distinct typed values of list columns: ``with_values(df, tv="target")`` adds ``tv`` for ``target``."""
    normal = answers.withColumns({f"{name}_normal": normalize_texts(F.col(c)) for name, c in lists.items()})
    typed = normal.withColumns({name: typed_values(F.col(c), F.col(f"{name}_normal")) for name, c in lists.items()})
    return typed.withColumns({name: first_of_equal(F.col(name)) for name in lists}).drop(*[f"{n}_normal" for n in lists])


def target_values(tagged: DataFrame, values: str = "values", canonical: str = "canonical") -> DataFrame:
    """Adds ``target``: distinct typed values read from the canonical texts, with the normalised original texts."""
    normal = tagged.withColumn("_normal", normalize_texts(F.col(values)))
    typed = normal.withColumn("target", typed_values(F.col(canonical), F.col("_normal"))).drop("_normal")
    return typed.withColumn("target", first_of_equal(F.col("target")))


def strict_match(answers: DataFrame, target: str = "target", pred: str = "pred") -> DataFrame:
    """Adds ``strict``: as many distinct values on both sides, and every target has a match."""
    valued = with_values(answers, _t=target, _p=pred)
    return valued.withColumn("strict", _all_targets_found("_t", "_p")).drop("_t", "_p")


def _without_units(texts: Column) -> Column:
    def bare_value(text: Column) -> Column:
        bare = reduce(lambda t, unit: F.lower(strip(F.replace(t, F.lit(unit), F.lit("")))), UNITS, text)
        return let(bare, _number_or_word)

    return F.transform(texts, bare_value)


def _is_one_of(values: str, words: list[str], number: float | None = None) -> Column:
    key = F.get(F.col(values), F.lit(0))["key"]
    hit = F.coalesce(key["word"].isin(*words), F.lit(False))
    if number is not None:
        hit |= F.coalesce(key["num"] == number, F.lit(False))
    return (F.size(values) == 1) & hit


def flexible_match(answers: DataFrame, target: str = "target", pred: str = "pred") -> DataFrame:
    """Adds ``flexible``: equal in order after dropping units, both a no, both a yes, or a strict match."""
    valued = with_values(answers, _t=target, _p=pred)
    valued = valued.withColumns({"_tu": _without_units(F.col(target)), "_pu": _without_units(F.col(pred))})
    has_nan = F.exists("_tu", lambda s: F.coalesce(F.isnan(s["num"]), F.lit(False)))
    same = (F.col("_tu") == F.col("_pu")) & ~has_nan
    both_no = _is_one_of("_t", NO_WORDS) & _is_one_of("_p", NO_WORDS)
    both_yes = _is_one_of("_t", YES_WORDS, YES_NUMBER) & _is_one_of("_p", YES_WORDS, YES_NUMBER)
    verdict = same | both_no | both_yes | _all_targets_found("_t", "_p")
    return valued.withColumn("flexible", verdict).drop("_t", "_p", "_tu", "_pu")


# --- summaries ---


def population_deviation(whole: Column) -> Column:
    """Population standard deviation of whole numbers, from exact sums: the same in any row order."""
    n = F.count(whole).cast("decimal(38,0)")
    squares = F.sum(whole.cast("long") * whole.cast("long")).cast("decimal(38,0)")
    total = F.sum(whole.cast("long")).cast("decimal(38,0)")
    return F.try_divide(F.sqrt((n * squares - total * total).cast("double")), F.count(whole))


def summarize(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Accuracy and edit distances per key: one row for each checkpoint and split, say.

    All rows of a key take part in every figure. The mode is the lowest on ties.
    """
    scored = denotation_match(predictions).withColumn("distance", edit_distance(given("pred"), given("ref")))
    return scored.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        (F.count_if("is_correct") / F.count("*")).alias("denotation_accuracy"),
        (F.sum(F.col("distance").cast("long")) / F.count("*")).alias("distance_mean"),
        population_deviation(F.col("distance")).alias("distance_std"),
        F.mode("distance", True).alias("distance_mode"),
    )


def prediction_line(pred: Column, ref: Column) -> Column:
    return F.concat(F.lit("pred: "), pred, F.lit(" ref: "), ref)
