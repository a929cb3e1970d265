"""SQL building blocks shared by the queries' SQL forms: the same derived corpora, said in SQL."""

ORDER_LINES = """
order_lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate,
    l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS row_pos
  FROM lineitem)
"""

# Sketches of the order tables: the order key picks column, aggregate and number of conditions.
ORDER_SKETCHES = """
picked AS (
  SELECT o_orderkey AS ex, [1, 2, 4, 3][(o_orderkey % 4 + 1)::INT] AS sel, (o_orderkey // 4) AS turn FROM orders),
sketches AS (
  SELECT ex, sel, CASE WHEN sel = 4 THEN [0, 3, 1, 2][(turn % 4 + 1)::INT] ELSE (turn % 6)::INT END AS agg,
    ex % 3 AS n_conds FROM picked)
"""

# Answers of the sketches; every selected cell prints as text, numbers as floats.
SKETCH_ANSWERS = f"""
{ORDER_LINES}, {ORDER_SKETCHES},
hits AS (
  SELECT ex, sel, agg, row_pos,
    CASE sel WHEN 1 THEN l_quantity WHEN 2 THEN l_extendedprice WHEN 3 THEN l_discount END AS num,
    CASE sel WHEN 1 THEN l_quantity::VARCHAR WHEN 2 THEN l_extendedprice::VARCHAR
             WHEN 3 THEN l_discount::VARCHAR ELSE l_returnflag END AS raw
  FROM sketches JOIN order_lines ON l_orderkey = ex
  WHERE (n_conds < 1 OR l_returnflag = 'A') AND (n_conds < 2 OR l_quantity > 10 + ex % 20)),
totals AS (
  SELECT ex, count(*) AS n, sum(num::DECIMAL(28,6))::DOUBLE AS total,
    string_agg(raw, ', ' ORDER BY row_pos) AS listed,
    first(raw ORDER BY num, raw, row_pos) AS least, first(raw ORDER BY num DESC, raw DESC, row_pos DESC) AS most
  FROM hits GROUP BY ex),
sketch_answers AS (
  SELECT s.ex AS example_id, s.sel, s.agg,
    CASE WHEN agg = 3 THEN coalesce(n, 0)::DOUBLE::VARCHAR
         WHEN n IS NULL THEN 'none'
         WHEN n = 1 THEN listed
         WHEN agg = 1 THEN most WHEN agg = 2 THEN least
         WHEN agg = 0 THEN listed
         WHEN agg = 4 THEN total::VARCHAR ELSE (total / n)::VARCHAR END AS answer
  FROM sketches s LEFT JOIN totals t ON t.ex = s.ex)
"""

# Raw text cells of the order tables.
ORDER_TEXT_CELLS = f"""
{ORDER_LINES},
text_cells AS (
  SELECT l_orderkey AS table_id, row_pos, unnest([0, 1, 2, 3, 4]) AS col_pos,
    unnest([l_partkey::VARCHAR, l_quantity::VARCHAR, format('{{:,.2f}}', l_extendedprice),
      strftime(l_shipdate, '%Y-%m-%d'), l_returnflag]) AS raw
  FROM order_lines)
"""
