"""Sketch queries: (selected column, aggregate, conditions) answered over the whole corpus at once.

``examples(example_id, table_id, sel INT, agg INT, conds ARRAY<STRUCT<col INT, op INT, value STRING>>)``.
Aggregate codes: 0 none, 1 max, 2 min, 3 count, 4 sum, 5 average. Operator codes: 0 ``=``, 1 ``>``, 2 ``<``.

Examples that ask the same are one sketch and answered once. The few sketches of a table that is asked seldom are held against its rows
where these lie, and no row moves. In other tables a sketch with an ``=`` condition meets only rows whose cell has the
same value: both sides are joined on (table, column, hash of the value), and rows are posted under a column only where some sketch of
their table asks for it. Sketches without such a condition meet the rows of their table; those without any condition are at most
one for each column. What matches is aggregated by sketch and block of rows, so long tables and much asked ones spread over
tasks, and the few blocks of a sketch are then added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tablewright.corpus import Corpus
from tablewright.functions.numbers import float_text, loose_float
from tablewright.functions.text import SPAN_DELIMITER, tokens
from tablewright.skew import BLOCK_ROWS, HOT_ROWS, block_of, has_larger_group, in_order

# Codes and printed names of the sketch aggregates and operators.
NONE, MAX, MIN, COUNT, SUM, AVG = 0, 1, 2, 3, 4, 5
AGG_NAMES = ["", "MAX", "MIN", "COUNT", "SUM", "AVG"]
EQUALS, GREATER, LESSER = 0, 1, 2
OP_NAMES = ["=", ">", "<"]
EMPTY_ANSWER = "none"
# Examples of one sketch share this key: 128 bits of table, column and conditions in sorted order.
KEY = ["key1", "key2"]
# Where a row and a sketch may meet. Column -1 is the whole table.
PROBE = ["table_id", "probe_col", "unread", "value_hash"]
# Every row of a table is held against every sketch of it where no more examples than this ask the table.
FEW_EXAMPLES = 4


def keyed(examples: DataFrame) -> DataFrame:
    """Examples with the key of their sketch; conditions that repeat, and their order, make no difference."""
    asked = F.sort_array(F.array_distinct(F.coalesce("conds", F.array().cast("array<struct<col:int,op:int,value:string>>"))))
    rows = examples.select("table_id", "example_id", "sel", "agg", asked.alias("asked"))
    return rows.select("*", *[F.xxhash64(F.lit(seed), "table_id", "sel", "asked").alias(k) for seed, k in enumerate(KEY)])


def bind_sketches(asked: DataFrame, meta: DataFrame, **more: Column) -> DataFrame:
    """Every sketch once, with the type of its column, the typed value of every condition, and further aggregates of its examples."""
    kind = lambda c: F.get("types", c["col"])
    bound = F.transform(
        "asked",
        lambda c: F.struct(
            c["col"].alias("col"),
            c["op"].alias("op"),
            (kind(c) == "real").alias("is_real"),
            F.when(kind(c) == "real", loose_float(c["value"])).alias("num"),
            F.when(kind(c) == "text", tokens(c["value"])).alias("words"),
        ),
    )
    is_text = F.get("types", "sel") == "text"
    lists, sums = F.bool_or(F.col("agg") == NONE).alias("lists"), F.bool_or(F.col("agg").isin(SUM, AVG)).alias("sums")
    once = asked.groupBy("table_id", "sel", "asked", *KEY).agg(lists, sums, *[c.alias(k) for k, c in more.items()])
    return once.join(meta.select("table_id", "types"), "table_id").select(
        "table_id", *KEY, "sel", is_text.alias("is_text"), (F.col("lists") | (F.col("sums") & F.coalesce(is_text, F.lit(False)))).alias("lists"), bound.alias("bound"), *more
    )


def condition_holds(cell: Column, cond: Column) -> Column:
    """Whether a cell meets a bound condition; NULL where the two cannot be compared.

    Numbers compare as numbers (NaN meets nothing), text as token lists, element by element.
    """
    number, words = cell["num"], tokens(cell["raw"])
    numeric = (
        F.when(F.isnan(number) | F.isnan(cond["num"]), F.lit(False))
        .when(cond["op"] == EQUALS, number == cond["num"])
        .when(cond["op"] == GREATER, number > cond["num"])
        .otherwise(number < cond["num"])
    )
    textual = (
        F.when(cond["op"] == EQUALS, words == cond["words"])
        .when(cond["op"] == GREATER, words > cond["words"])
        .otherwise(words < cond["words"])
    )
    return F.when(cond["is_real"], numeric).otherwise(textual)


def _value_hash(is_real: Column, num: Column, words: Column) -> Column:
    """Equal numbers, and equal words, have equal hashes; both zeros are one."""
    return F.when(is_real, F.xxhash64(num + F.lit(0.0))).otherwise(F.xxhash64(words))


def _probed(sketches: DataFrame) -> DataFrame:
    """Sketches with ``lookup``, the first condition that rows can be looked up by: an ``=`` with a readable value."""
    usable = lambda c: (c["op"] == EQUALS) & F.when(c["is_real"], c["num"].isNotNull() & ~F.isnan(c["num"])).otherwise(c["words"].isNotNull())
    return sketches.withColumn("lookup", F.get(F.filter("bound", usable), F.lit(0)))


def matches(sketches: DataFrame, rows: DataFrame) -> DataFrame:
    """Every sketch with the rows of its table that it may hold for: those of the looked-up value, those that cannot be read there, or all."""
    probed = _probed(sketches)
    place = lambda col, unread, value: F.struct(col.cast("int").alias("probe_col"), unread.alias("unread"), value.cast("long").alias("value_hash"))
    no, yes, none = F.lit(False), F.lit(True), F.lit(0)
    whole = place(F.lit(-1), no, none)
    at = F.col("lookup")
    looked = F.array(place(at["col"], no, _value_hash(at["is_real"], at["num"], at["words"])), place(at["col"], yes, none))
    posts = probed.select("*", F.inline(F.when(at.isNull(), F.array(whole)).otherwise(looked))).drop("lookup")
    wanted = F.collect_set(F.struct(at["col"].alias("col"), at["is_real"].alias("is_real")))
    read = F.collect_set(F.sort_array(F.array_distinct(F.array_append(F.transform("bound", lambda c: c["col"]), F.col("sel")))))
    columns = probed.groupBy("table_id").agg(
        F.filter(wanted, lambda c: c["col"].isNotNull()).alias("wanted"), F.bool_or(at.isNull()).alias("scanned"), F.array_distinct(F.flatten(read)).alias("read")
    )

    def posted(c: Column) -> Column:
        cell = F.get("cells", c["col"])
        unread = F.when(c["is_real"], cell["num"].isNull()).otherwise(cell["raw"].isNull())
        return place(c["col"], unread, F.when(unread, none).otherwise(_value_hash(c["is_real"], cell["num"], tokens(cell["raw"]))))

    under = F.concat(F.transform("wanted", posted), F.when(F.col("scanned"), F.array(whole)).otherwise(F.array().cast("array<struct<probe_col:int,unread:boolean,value_hash:bigint>>")))
    # The rows are the large side: they are never broadcast.
    # Only the cells that some sketch of the table reads move on with a row.
    needed = F.transform("cells", lambda cell, i: F.when(F.array_contains("read", i), cell))
    postings = rows.hint("merge").join(columns, "table_id").select("table_id", "row_pos", "cells", "read", F.inline(under)).withColumn("cells", needed).drop("read")
    return postings.join(posts, PROBE)


def _holds() -> Column:
    """Whether a sketch holds for a row; a comparison without a result spoils the sketch, unless another condition fails for the row."""
    held = F.transform("bound", lambda c: condition_holds(F.get("cells", c["col"]), c))
    return F.aggregate(held, F.lit(True), lambda a, b: a & b)


def _judged(pairs: DataFrame) -> DataFrame:
    """Rows beside sketches: whether the sketch ``holds`` there, and its cell."""
    return pairs.withColumns({"holds": _holds(), "target": F.get("cells", "sel").cast("struct<raw:string,num:double>")})


def _block_answers(judged: DataFrame, keys: list[str], **more: Column) -> DataFrame:
    """Per sketch and block of rows: counts, sums, extremes and, where needed, the listed cells."""
    kept = judged.select(
        "*", F.col("holds").isNull().alias("clash"), F.coalesce("holds", F.lit(False)).alias("hit"), F.col("target.raw").alias("raw"), F.when(~F.col("is_text"), F.col("target.num")).alias("num")
    )
    hit = F.col("hit")
    ranked = F.struct("num", F.when(F.col("is_text"), F.col("raw")).alias("word"), "row_pos", "raw")
    number = F.when(hit, F.col("num"))
    exact = number.try_cast("decimal(28,6)")
    return kept.groupBy(*keys, "block").agg(
        F.bool_or("is_text").alias("is_text"),
        F.bool_or("lists").alias("lists"),
        F.count_if(hit).alias("n"),
        F.bool_or("clash").alias("clash"),
        F.count_if(hit & ~F.col("is_text") & F.col("num").isNull()).alias("unread"),
        F.sum(exact).alias("exact"),
        F.sum(number).alias("inexact"),
        F.bool_and(F.coalesce(exact.cast("double") == number, number.isNull())).alias("is_exact"),
        F.min(F.when(hit, ranked)).alias("least"),
        F.max(F.when(hit, ranked)).alias("most"),
        F.collect_list(F.when(hit & F.col("lists"), F.struct("row_pos", "raw"))).alias("listed"),
        *[c.alias(k) for k, c in more.items()],
    )


def _totals(blocks: DataFrame, keys: list[str], *more: str) -> DataFrame:
    """The blocks of every sketch, each with the totals over all of them."""
    every = W.partitionBy(*keys)
    whole = {
        "total": F.when(F.bool_and("is_exact").over(every), F.sum("exact").over(every).cast("double")).otherwise(F.sum("inexact").over(every)),
        "found": F.sum("n").over(every),
        "blocks": F.count_if(F.col("n") > 0).over(every),
        "clash": F.bool_or("clash").over(every),
        "unread": F.sum("unread").over(every),
        "least": F.min("least").over(every),
        "most": F.max("most").over(every),
        "first_block": F.min("block").over(every),
    }
    text = F.array_join(in_order(F.col("listed"), "raw"), SPAN_DELIMITER, EMPTY_ANSWER).alias("listed_text")
    return blocks.select(*keys, "block", "is_text", "n", text, *more, *[c.alias(k) for k, c in whole.items()])


def _seldom_asked(examples: DataFrame, corpus: Corpus, block_rows: int) -> DataFrame:
    """Examples beside the totals of their sketch, for tables with few examples: all is done where the rows of the table lie."""
    keys = ["table_id", *KEY]
    sketches = bind_sketches(keyed(examples), corpus.meta, askers=F.collect_list(F.struct("example_id", "agg")))
    # The rows are the large side: they are never broadcast. Rows for which a sketch does not hold go no further; a sketch without others stands alone.
    rows = corpus.rows.select(F.col("table_id").alias("row_table"), "row_pos", "cells", F.lit(True).alias("met"))
    pairs = _judged(sketches.join(rows.hint("merge"), (F.col("table_id") == F.col("row_table")) & F.coalesce(_holds(), F.lit(True)), "left"))
    block = F.when(F.col("met"), block_of(F.col("row_pos"), block_rows)).otherwise(F.lit(0).cast("long"))
    holds = F.when(F.col("met"), F.col("holds")).otherwise(F.lit(False))
    judged = pairs.select(*keys, "is_text", "lists", "askers", block.alias("block"), "row_pos", holds.alias("holds"), "target")
    blocks = _block_answers(judged, keys, askers=F.first("askers"))
    return _totals(blocks, keys, "askers").select("*", F.inline("askers")).drop("askers")


def _often_asked(examples: DataFrame, corpus: Corpus, block_rows: int) -> DataFrame:
    """Examples beside the totals of their sketch, for tables with many examples: rows and sketches meet by value."""
    asked = keyed(examples)
    sketches = bind_sketches(asked, corpus.meta)
    place = block_of(F.col("row_pos"), block_rows).alias("block")
    judged = _judged(matches(sketches, corpus.rows)).select(*KEY, "is_text", "lists", place, "row_pos", "holds", "target")
    # Every sketch has a block 0.
    none = {"block": F.lit(0).cast("long"), "row_pos": F.lit(None).cast("long"), "holds": F.lit(False), "target": F.lit(None).cast("struct<raw:string,num:double>")}
    empty = sketches.select(*KEY, "is_text", "lists", *[c.alias(k) for k, c in none.items()])
    totals = _totals(_block_answers(judged.unionByName(empty), KEY), KEY)
    return asked.select("table_id", "example_id", "agg", *KEY).join(totals, KEY)


def answer_sketches(examples: DataFrame, corpus: Corpus, block_rows: int = BLOCK_ROWS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Answer every example: ``(table_id, example_id, segment, answer, status)``.

    An answer that lists the cells of more than one block of rows comes in segments, to be joined
    with ``", "`` in segment order; every other answer is segment 0. A type mismatch gives
    ``status = 'type_error'`` and no answer. Examples of a table that is not in the corpus have no answer.
    Tables of up to ``hot_rows`` rows may lie in one task each; with a larger one, no table has to.
    """
    hot = has_larger_group(corpus.rows.select("table_id"), ["table_id"], hot_rows) if corpus.hot is None else corpus.hot
    if hot:
        joined = _often_asked(examples, corpus, block_rows)
    else:
        times = examples.groupBy("table_id").agg(F.count(F.lit(1)).alias("times"))
        few, many = (examples.join(times.where(which).drop("times").hint("merge"), "table_id") for which in (F.col("times") <= FEW_EXAMPLES, F.col("times") > FEW_EXAMPLES))
        # Examples of often asked tables are dealt out first: where there are none, Spark sees it before any row of the tables is posted.
        joined = _seldom_asked(few, corpus, block_rows).unionByName(_often_asked(many.repartition("table_id", "example_id"), corpus, block_rows))
    wants_list = (F.col("agg") == NONE) | (F.col("agg").isin(SUM, AVG) & F.col("is_text"))
    is_list = wants_list & (F.col("found") > 1) & ~F.col("clash")
    shown = F.when(is_list, F.col("n") > 0).otherwise(F.col("block").eqNullSafe(F.col("first_block")))
    # A list that lies in one block is one segment, whichever block that is.
    segment = F.when(is_list & (F.col("blocks") > 1), F.col("block")).otherwise(0).cast("long")
    return _finish(joined.where(shown).withColumn("segment", segment).withColumn("wants_list", wants_list).drop("n").withColumnRenamed("found", "n"), F.col("listed_text"))


def _finish(df: DataFrame, listed_text: Column) -> DataFrame:
    """Answers from the totals of each example."""
    n, agg, is_text = F.col("n"), F.col("agg"), F.col("is_text")
    is_single = (n == 1) | agg.isin(MAX, MIN)
    totals = df.withColumn("single", F.when(agg == MAX, F.col("most")).otherwise(F.col("least")))
    totals = totals.withColumn("word_number", F.when((n > 0) & is_text & is_single, loose_float(F.col("single.raw"))))
    number = (
        F.when(agg == COUNT, n.cast("double"))
        .when((n > 0) & is_single, F.coalesce("word_number", "single.num"))
        .when((n > 0) & ~F.col("wants_list"), F.when(agg == SUM, F.col("total")).otherwise(F.col("total") / n))
    )
    word_in_sum = (n == 1) & agg.isin(SUM, AVG) & is_text & F.col("word_number").isNull()
    failed = F.col("clash") | (F.col("unread") > 0) | word_in_sum
    judged = totals.withColumn("number", number).withColumn("failed", failed)
    answer = (
        F.when(F.col("failed"), F.lit(None))
        .when(F.col("number").isNotNull(), float_text(F.col("number")))
        .when(n == 0, F.lit(EMPTY_ANSWER))
        .when(is_single, F.col("single.raw"))
        .otherwise(listed_text)
    )
    status = F.when(F.col("failed"), F.lit("type_error")).otherwise(F.lit("ok"))
    return judged.select("table_id", "example_id", "segment", answer.alias("answer"), status.alias("status"))
