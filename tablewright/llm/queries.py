"""The registered queries of this subpackage, with SQL where SQL can say them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import bpe, chats, decontaminate, fill_middle, html_text, jaccard, language, pivots, token_files, topk, toxicity, turn_repair, urls
from tablewright.llm.common import bucket_of_id, table
from tablewright.queries import Query, Registered

REGISTRY: dict[str, Registered] = {}


def query(sql: str | None = None):
    def register(run: Query) -> Query:
        REGISTRY[run.__name__] = Registered(run, sql)
        return run

    return register


TOP_K_SQL = """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS row_no, vec_id AS id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), terms AS (
  SELECT row_no, id, unnest(w) AS weight, unnest(range(len(w))) AS term FROM v
), scored AS (
  SELECT q.row_no, q.id AS query_id, r.row_no AS other, r.id AS vec_id, CAST(sum(q.weight * r.weight) AS BIGINT) AS score
  FROM terms q JOIN terms r ON q.term = r.term AND q.row_no <> r.row_no
  WHERE q.id % 50 = 0 GROUP BY q.row_no, q.id, r.row_no, r.id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id) AS rank FROM scored
) WHERE rank <= 5
"""


@query(TOP_K_SQL)
def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk.integer_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.top_k(rows, rows.where(F.col("id") % 50 == 0), k=5)


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def token_digests(docs: DataFrame) -> DataFrame:
    encoded = bpe.encode_decode(docs, rank_file())
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("ids", "decoded")]
    return encoded.select("doc_id", "n_tokens", *digests)


@query()
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(table(spark, sf_dir, "documents"))


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = token_files.folder_for(docs)
    manifest = token_files.write_files(docs, tokenizer_file(), folder, end_id=2)
    rows = token_files.read_files(manifest, folder)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


SPANS_SQL = r"""
WITH w AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), phrases AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + 9], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM w WHERE len(w) > 0)
), d AS (
  SELECT row_number() OVER () AS row_no, doc_id,
    CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w
  FROM documents
), places AS (
  SELECT row_no, w, n, unnest(range(1, len(w) - n + 2)) AS s
  FROM d, (SELECT DISTINCT n FROM phrases) WHERE len(w) >= n
), found AS (
  SELECT row_no, s, p.n, item_id FROM (SELECT row_no, s, n, array_to_string(w[s:s + n - 1], ' ') AS phrase FROM places) p
  JOIN phrases USING (n, phrase)
), hit AS (
  SELECT row_no, count(DISTINCT word) AS n_hit FROM (SELECT row_no, unnest(range(s, s + n)) AS word FROM found) GROUP BY row_no
), items AS (
  SELECT row_no, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT row_no, CAST(item_id AS VARCHAR) AS item FROM found WHERE item_id IS NOT NULL) GROUP BY row_no
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (row_no) LEFT JOIN items USING (row_no)
"""


@query(SPANS_SQL)
def op10_benchmark_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    phrases = decontaminate.windows(table(spark, sf_dir, "benchmark"))
    found = decontaminate.find_spans(table(spark, sf_dir, "documents"), phrases)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(names, 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


@query()
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents"))


def language_model(spark: SparkSession, sf_dir: str) -> language.Model:
    """Learned from the documents that are not held out."""
    return language.learn(table(spark, sf_dir, "documents").where(bucket_of_id("doc_id", 4) != 2))


@query()
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.language_of(docs, language_model(spark, sf_dir))
    return found.select("doc_id", F.coalesce(bucket_of_id("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from the labels that are not held out."""
    labels = table(spark, sf_dir, "labels").where(bucket_of_id("doc_id", 5) != 0)
    return toxicity.learn(table(spark, sf_dir, "documents"), labels)


@query()
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.toxicity_of(table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    held_out = F.coalesce(bucket_of_id("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _url_sql() -> str:
    """The rules, then both ranks round by round as one query each."""
    name = lambda column: f"translate(regexp_extract({column}, '://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}')"
    order = sorted(urls.RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for h, p, _ in order]
    rule = " ".join(f + f"'{h}{p}'" for f, (h, p, _) in zip(fits, order, strict=True))
    ruled = " ".join(f + f"'{v}'" for f, (_, _, v) in zip(fits, order, strict=True))
    href = urls.HREF.replace("'", "''")
    steps = [
        f"u AS MATERIALIZED (SELECT page_id, html, coalesce({name('url')}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)",
        f"j AS MATERIALIZED (SELECT page_id, html, host, path, CASE {rule} END AS rule, CASE {ruled} END AS ruled FROM u)",
        f"t AS MATERIALIZED (SELECT host, unnest(regexp_extract_all(html, '{href}', 1)) AS link FROM j)",
        f"l AS MATERIALIZED (SELECT host AS src, {name('link')} AS dst FROM (SELECT host, CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END AS link FROM t))",
        "c AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)",
        "e_allow AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS weight FROM c)",
        "e_block AS MATERIALIZED (SELECT dst AS src, src AS dst, weight / sum(weight) OVER (PARTITION BY dst) AS weight FROM e_allow)",
    ]
    for verdict in ("allow", "block"):
        steps.append(f"s_{verdict} AS MATERIALIZED (SELECT host FROM j WHERE host <> '' GROUP BY host HAVING sum(CASE WHEN ruled = '{verdict}' THEN 1 ELSE 0 END) * 2 > count(*))")
        steps.append(f"m_{verdict} AS MATERIALIZED (SELECT host, 1.0::DOUBLE / (SELECT count(*) FROM s_{verdict}) AS mass FROM s_{verdict})")
        before = f"m_{verdict}"
        for step in range(urls.ROUNDS):
            now, rank = f"r_{verdict}_{step}", "mass" if step == 0 else "rank"
            flows = f"SELECT e.dst AS host, r.{rank} * e.weight * {urls.DAMPING} AS rank FROM {before} r JOIN e_{verdict} e ON r.host = e.src"
            steps.append(f"{now} AS MATERIALIZED (SELECT host, sum(rank) AS rank FROM ({flows} UNION ALL SELECT host, mass * {1 - urls.DAMPING} FROM m_{verdict}) GROUP BY host)")
            before = now
    last = urls.ROUNDS - 1
    bad = f"SELECT b.host FROM r_block_{last} b LEFT JOIN r_allow_{last} a ON a.host = b.host WHERE b.rank > coalesce(a.rank, 0)"
    verdict = f"coalesce(ruled, CASE WHEN host IN ({bad}) THEN 'block' ELSE 'allow' END) AS verdict"
    return "WITH " + ",\n".join(steps) + f"\nSELECT page_id, host, path, rule, {verdict} FROM j"


@query(_url_sql())
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query()
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


CHAT_SQL = r"""
WITH t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT conv_id, count(*) AS n, list(md5(role) || md5(text) ORDER BY pos) AS turns,
    string_agg('<|' || replace(role, '<|', '<\|') || '|>' || chr(10) || replace(text, '<|', '<\|') || '<|end|>' || chr(10), '' ORDER BY pos) AS text
  FROM t GROUP BY conv_id
), inner_prefixes AS (
  SELECT DISTINCT k, md5(array_to_string(turns[1:k], '')) AS prefix FROM (SELECT turns, unnest(range(1, n)) AS k FROM c)
), whole AS (
  SELECT n, md5(array_to_string(turns, '')) AS prefix, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY ALL
)
SELECT w.conv_id, 0::INTEGER AS segment, w.n AS n_turns, w.n_copies, c.text
FROM whole w JOIN c ON c.conv_id = w.conv_id ANTI JOIN inner_prefixes p ON p.k = w.n AND p.prefix = w.prefix
"""


@query(CHAT_SQL)
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.format_chats(table(spark, sf_dir, "conversations"))


MIDDLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
    list_transform([1, 9, 17, 25], lambda i: CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), i, 8) AS BIGINT)) AS h
  FROM documents
), c AS (
  SELECT doc_id, text, len(units) AS n, units, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), p AS (
  SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:], '') AS suffix FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(prefix || middle || suffix) AS restored_sha256
FROM p
"""


@query(MIDDLE_SQL)
def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


NEAR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), c AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
), n AS (
  SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


@query(NEAR_SQL)
def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns as the query's contract damages them, by the crc32 of ``conv_id:turn`` modulo 20."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("col")


def _repair_sql() -> str:
    """The repair turn by turn in a recursive query: the best (cost, audit) of each state; then the roles of what is left by its place."""
    more = lambda x, cost, letter: f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{letter}'}} END"
    least = lambda *ways: f"list_min([{', '.join(ways)}])"

    def edited(own: str | None, kind: str, before: str) -> str:
        ways = [more(own, 4, "D")]
        for x in before:
            ways.append(f"CASE WHEN fault < 2 AND kind = '{kind}' THEN {more(x, '3 * fault', 'K')} END")
            ways += [f"CASE WHEN fault < 2 THEN {more(x, '(3 + 3 * fault)', 'R')} END"] if kind != "s" else []
        return least(*ways)

    def with_inserts(step: str) -> str:
        for _ in range(3):
            step = f"SELECT * REPLACE ({least('u', *[more(x, 3, 'I') for x in 'esa'])} AS u, {least('a', more('u', 3, 'I'))} AS a) FROM ({step})"
        return step

    walk = with_inserts(
        f"SELECT d.row, d.pos + 1 AS pos, {edited('e', '-', '')} AS e, {edited('s', 's', 'e')} AS s, {edited('u', 'u', 'esa')} AS u, {edited('a', 'a', 'u')} AS a "
        "FROM d JOIN r ON r.conv = d.row AND r.pos = d.pos + 1"
    )
    nothing = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR))"
    begin = with_inserts(f"SELECT DISTINCT conv AS row, CAST(0 AS BIGINT) AS pos, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS e, {nothing} AS s, {nothing} AS u, {nothing} AS a FROM r")
    dark = r"[^\x20\x09-\x0D]"
    return rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), keyed AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), hit AS (
  SELECT conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(k, ''), lambda ch: CAST(ord(ch) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM keyed, crc
), damaged AS (
  SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM hit)
), o AS (
  SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS pos,
    CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE '-' END AS kind
  FROM damaged
), r AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '{dark}') THEN 3 WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY pos) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 1 ELSE 0 END AS fault,
    lag(kind) OVER (PARTITION BY conv ORDER BY pos) || kind AS pair FROM o
), d AS (
  {begin}
  UNION ALL
  {walk}
), sums AS (
  SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 3) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 1) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS n
  FROM r GROUP BY conv
), best AS MATERIALIZED (
  SELECT conv, list_min([e, a]) AS b FROM d JOIN sums ON conv = row AND pos = n
), letters AS (
  SELECT conv, i, b.a[i] AS letter FROM (SELECT conv, b, unnest(range(1, length(b.a) + 1)) AS i FROM best)
), placed AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER (PARTITION BY conv ORDER BY i) AS pos FROM letters
), lines AS (
  SELECT p.conv, i, letter, kind, role, text, row_number() OVER (PARTITION BY p.conv ORDER BY i) AS k, first_value(letter = 'K' AND kind = 's') OVER (PARTITION BY p.conv ORDER BY i) AS led
  FROM placed p LEFT JOIN r ON r.conv = p.conv AND r.pos = p.pos AND letter <> 'I' WHERE letter <> 'D'
), texts AS (
  SELECT conv, string_agg(CASE WHEN letter = 'K' THEN role WHEN (k - CAST(led AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY i) AS text
  FROM lines GROUP BY conv
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(text, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM keyed) LEFT JOIN sums USING (conv) LEFT JOIN best USING (conv) LEFT JOIN texts USING (conv)
"""


@query(_repair_sql())
def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    done = turn_repair.repair(damaged(turns))
    named = lambda df, name: df.withColumnRenamed("conv_id", name)
    same = lambda name: F.col("conv_id").eqNullSafe(F.col(name))
    found = turns.select("conv_id").distinct().join(named(done.report, "_of"), same("_of"), "left").drop("_of")
    found = found.join(named(turn_repair.digests(done.turns), "_of"), same("_of"), "left").drop("_of")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256(b"").hexdigest()
    return found.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
