"""Derived columns and scalar text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions import numbers, text
from tablewright.operators import derived
from tablewright.queries import query
from tablewright.sources.driver_tables import spread, table

# Lists of words and numbers, cut by a mark that the part key picks; brands are the tables.
_LISTS_SQL = r"""
marked AS (SELECT p_partkey, p_brand, [', ', '-', chr(10), '/'][(p_partkey % 4 + 1)::INT] AS mark, p_name, p_type, p_size FROM part),
lists AS (SELECT p_partkey, p_brand, CASE WHEN p_size = 50 THEN NULL ELSE replace(p_name, ' ', mark) || mark || p_type || mark || p_size END
  AS items FROM marked),
delimiters AS (SELECT p_brand, CASE WHEN commas >= dashes AND commas >= lines THEN ',' WHEN dashes >= lines THEN '-' ELSE chr(10) END
  AS delimiter FROM (SELECT p_brand, coalesce(sum(length(items) - length(replace(items, ',', ''))), 0) AS commas,
    coalesce(sum(length(items) - length(replace(items, '-', ''))), 0) AS dashes,
    coalesce(sum(length(items) - length(replace(items, chr(10), ''))), 0) AS lines FROM lists GROUP BY p_brand)),
cut AS (SELECT p_partkey, delimiter, items, list_transform(string_split(items, delimiter), lambda x: trim(x)) AS pieces
  FROM lists JOIN delimiters USING (p_brand))
"""


def _part_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.get(F.array(*map(F.lit, [", ", "-", "\n", "/"])), (F.col("p_partkey") % 4).cast("int"))
    items = F.concat(F.replace(F.col("p_name"), F.lit(" "), mark), mark, F.col("p_type"), mark, F.col("p_size").cast("string"))
    items = F.when(F.col("p_size") != 50, items)
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", items.alias("items"))


@query(
    f"""WITH {_LISTS_SQL} SELECT p_partkey, delimiter,
      coalesce(array_to_string(list_filter(flatten(list_transform(pieces, lambda p: string_split(p, '/'))), lambda p: p <> ''), '|'), '')
        AS items, list_aggregate(pieces, 'max') AS greatest, list_aggregate(pieces, 'min') AS least FROM cut"""
)
def list_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _part_lists(spark, sf_dir)
    chosen = lists.join(derived.choose_delimiter(lists, ["p_brand"], "items"), "p_brand")
    items, delimiter = F.col("items"), F.col("delimiter")
    return chosen.select(
        "p_partkey",
        "delimiter",
        F.array_join(derived.list_items(items, delimiter), "|").alias("items"),
        derived.greatest_piece(items, delimiter).alias("greatest"),
        derived.least_piece(items, delimiter).alias("least"),
    )


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' || y WHEN 1 THEN '' || greatest(y, 1995) WHEN 2 THEN
        y || '|' || (y + 3) ELSE 'none' END AS latest_years,
      CASE p_partkey % 4 WHEN 0 THEN '' || y WHEN 1 THEN '' || least(y, 1995) WHEN 2 THEN y || '|1990' ELSE 'none' END AS earliest_years,
      CASE p_partkey % 4 WHEN 0 THEN '' || y WHEN 1 THEN '' || y WHEN 2 THEN '' || y END AS first_year
    FROM (SELECT p_partkey, 1990 + p_size AS y FROM part)"""
)
def list_year_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    year = 1990 + F.col("p_size")
    y, later = year.cast("string"), (year + 3).cast("string")
    forms = [
        F.concat(F.lit("in "), y, F.lit(" AD")),
        F.concat(y, F.lit("-1995")),
        F.concat(y, F.lit(", "), later, F.lit("-1990 (est)")),
        F.lit(None).cast("string"),
    ]
    spans = table(spark, sf_dir, "part").select(
        "p_partkey", F.get(F.array(*forms), (F.col("p_partkey") % 4).cast("int")).alias("span")
    )
    span = F.col("span")
    return spans.select(
        "p_partkey",
        F.array_join(derived.latest_years(span), "|", "none").alias("latest_years"),
        F.array_join(derived.earliest_years(span), "|", "none").alias("earliest_years"),
        derived.first_year(span).alias("first_year"),
    )


@query(
    """SELECT p_partkey, greatest(p_size, 20) || '|' || p_partkey AS maximums, least(p_size, 20) || '|' || p_partkey AS minimums
    FROM part"""
)
def list_number_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.concat(F.col("p_size").cast("string"), F.lit("-20, "), F.col("p_partkey").cast("string"))
    spans = table(spark, sf_dir, "part").select("p_partkey", span.alias("span"))
    return spans.select(
        "p_partkey",
        F.array_join(derived.range_maximums(F.col("span")), "|").alias("maximums"),
        F.array_join(derived.range_minimums(F.col("span")), "|").alias("minimums"),
    )


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN '' || month(o_orderdate) END AS month FROM orders")
def list_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "MMMM d, yyyy")).otherwise(F.lit("1st quarter"))
    dated = table(spark, sf_dir, "orders").select("o_orderkey", written.alias("written"))
    return dated.select("o_orderkey", derived.month_number(F.col("written")).alias("month"))


@query("SELECT p_partkey, p_name || '|' || p_type AS names FROM part")
def list_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat("p_name", F.lit(" ("), "p_brand", F.lit("), "), "p_type", F.lit(" (size "), F.col("p_size").cast("string"), F.lit(")"))
    lists = table(spark, sf_dir, "part").select("p_partkey", written.alias("written"))
    return lists.select("p_partkey", F.array_join(derived.names_before_brackets(F.col("written")), "|").alias("names"))


@query("SELECT c_custkey, c_name || '|' || c_mktsegment || '|' || c_nationkey AS parts, 3::BIGINT AS n FROM customer")
def address_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.concat_ws(", ", "c_name", "c_mktsegment", F.col("c_nationkey").cast("string"))
    addresses = table(spark, sf_dir, "customer").select("c_custkey", address.alias("address"))
    parts = derived.address_parts(F.col("address"))
    return addresses.select("c_custkey", F.array_join(parts, "|").alias("parts"), F.size(parts).cast("long").alias("n"))


@query("SELECT c_custkey, TRY_CAST(regexp_extract(c_name || ' owes ' || c_acctbal, '[0-9]+\\.[0-9]+|[0-9]+') AS DOUBLE) AS first_number FROM customer")
def first_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.concat("c_name", F.lit(" owes "), numbers.float_text(F.col("c_acctbal")))
    return table(spark, sf_dir, "customer").select("c_custkey", derived.first_number(written).alias("first_number"))


_NUMBER_FORMS = """
forms AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderkey % 8 AS form, CASE o_orderkey % 8 WHEN 0 THEN format('{:,.2f}', o_totalprice)
    WHEN 1 THEN o_custkey || ',5' WHEN 2 THEN '1.' || o_custkey || '.3' WHEN 3 THEN '' || o_custkey WHEN 4 THEN 'n/a ' || o_custkey
    WHEN 5 THEN '0' || o_custkey WHEN 6 THEN '-' || o_custkey || '.25' ELSE '1,2,' || o_custkey END AS t FROM orders)
"""


def _number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = F.col("o_custkey").cast("string")
    forms = [
        F.format_number("o_totalprice", 2),
        F.concat(customer, F.lit(",5")),
        F.concat(F.lit("1."), customer, F.lit(".3")),
        customer,
        F.concat(F.lit("n/a "), customer),
        F.concat(F.lit("0"), customer),
        F.concat(F.lit("-"), customer, F.lit(".25")),
        F.concat(F.lit("1,2,"), customer),
    ]
    form = F.get(F.array(*forms), (F.col("o_orderkey") % 8).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", form.alias("t"))


@query(
    f"""WITH {_NUMBER_FORMS} SELECT o_orderkey, t, CASE form WHEN 0 THEN replace(t, ',', '')::DOUBLE
      WHEN 1 THEN CASE WHEN length('' || o_custkey) = 3 THEN o_custkey * 10 + 5 ELSE o_custkey + 0.5 END::DOUBLE
      WHEN 2 THEN replace(t, '.', '')::DOUBLE WHEN 4 THEN NULL WHEN 7 THEN replace(t, ',', '')::DOUBLE ELSE t::DOUBLE END AS number
    FROM forms"""
)
def float_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _number_texts(spark, sf_dir).withColumn("number", numbers.loose_float(F.col("t")))


@query(
    f"""WITH {_NUMBER_FORMS} SELECT o_orderkey, form IN (3) OR (form = 5 AND o_custkey < 0) AS strict_int,
      form IN (3, 6) OR (form = 0 AND o_totalprice < 1000) AS strict_float, CASE WHEN form IN (3, 5) THEN 'int' WHEN form = 6 OR
        (form = 0 AND o_totalprice < 1000) THEN 'float' ELSE 'text' END AS kind, t IN ('0', '1') AS is_bool FROM forms"""
)
def numeric_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return _number_texts(spark, sf_dir).select(
        "o_orderkey",
        numbers.is_strict_int(t).alias("strict_int"),
        numbers.is_strict_float(t).alias("strict_float"),
        numbers.value_kind(t).alias("kind"),
        numbers.is_bool_text(t).alias("is_bool"),
    )


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN '"' || o_orderpriority ELSE o_orderpriority END AS bare,
      'select id from w where c is not null and y = 2014' || CASE WHEN o_orderstatus = 'P' THEN ' s' ELSE '' END AS query_text,
      CASE WHEN o_orderstatus = 'P' THEN 'it s ' ELSE 'it''s ' END || o_orderpriority AS cell FROM orders"""
)
def quote_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    marks = [F.concat(F.lit("'"), priority, F.lit("'")), F.concat(F.lit('"'), priority, F.lit('"')), F.concat(F.lit('"'), priority)]
    tail = F.when(F.col("o_orderstatus") == "P", F.lit("\\'s")).otherwise(F.lit(""))
    written = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.get(F.array(*marks), (F.col("o_orderkey") % 3).cast("int")).alias("quoted"),
        F.concat(F.lit("select * from w where c not null and y = present_ref"), tail).alias("written"),
        F.concat(F.lit("it's "), priority).alias("cell"),
    )
    return written.select(
        "o_orderkey",
        text.strip_quotes(F.col("quoted")).alias("bare"),
        text.clean_query_text(F.col("written")).alias("query_text"),
        text.clean_cell_text(F.col("cell"), F.col("written")).alias("cell"),
    )


@query("SELECT doc_id, 'f' || md5(text) AS key FROM documents")
def md5_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.question_key(F.col("text")).alias("key"))


@query(
    r"""SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+'))::INTEGER AS n_tokens,
      md5(array_to_string(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+'), ' ')) AS token_text FROM documents"""
)
def text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The whole token text is compared through its MD5.
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id",
        text.token_count(F.col("text")).alias("n_tokens"),
        F.md5(F.array_join(text.tokens(F.col("text")), " ")).alias("token_text"),
    )


@query(
    r"""SELECT doc_id, replace(replace(replace(escaped, '\n', chr(10)), '\p', '|'), '\\', '\') AS field
    FROM (SELECT doc_id, replace(replace(replace(text, '. ', '\n'), ', ', '\p'), 'th', '\\') AS escaped FROM documents)"""
)
def unescape_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Sentence ends, commas and a letter pair of whole documents become escapes, which are then undone.
    escaped = F.col("text")
    for plain, escape in [(". ", "\\n"), (", ", "\\p"), ("th", "\\\\")]:
        escaped = F.replace(escaped, F.lit(plain), F.lit(escape))
    return table(spark, sf_dir, "documents").select("doc_id", text.unescape_field(escaped).alias("field"))
