import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.plans import dags, shred
from tablewright.plans.reader import register_plan_nodes

XML = """<?xml version="1.0"?>
<explain xmlns="http://www.postgresql.org/2009/explain"><Query><Plan>
 <Node-Type>Append</Node-Type><Parallel-Aware>false</Parallel-Aware>
 <Plans>
  <Plan><Node-Type>Sort</Node-Type><Sort-Key><Item>a</Item><Item>b &amp; c</Item></Sort-Key>
   <Workers><Worker><Worker-Number>0</Worker-Number></Worker></Workers>
   <Plans><Plan><Node-Type>Seq Scan</Node-Type><Filter><![CDATA[x < 3 & y]]></Filter></Plan></Plans></Plan>
  <Plan><!-- <Plan> --><Node-Type>Result</Node-Type><Alias/></Plan>
 </Plans></Plan><Triggers><Trigger><Name>t</Name></Trigger></Triggers></Query></explain>"""


def plans(spark, **options):
    df = spark.createDataFrame([(1, XML), (2, None)], "plan_id int, xml_plan string")
    return shred.shred_plans(df, **options)


def test_nodes(spark):
    nodes = shred.explode_nodes(plans(spark), "plan_id").orderBy("node_id").collect()
    assert [(n["node_id"], n["parent_id"], n["node_type"], n["width"], n["depth"]) for n in nodes] == [
        (0, None, "Append", 0, 0),
        (1, 0, "Sort", 0, 1),
        (2, 1, "Seq Scan", 0, 2),
        (3, 0, "Result", 1, 1),
    ]
    attrs = [{a["key"]: a["value"] for a in n["attrs"]} for n in nodes]
    assert attrs[0] == {} and attrs[2] == {"Filter": "x < 3 & y"} and attrs[3] == {"Alias": ""}
    assert [(a["key"], a["value"]) for a in nodes[1]["attrs"]] == [
        ("Sort-Key_Item", "a"),
        ("Sort-Key_Item", "b & c"),
        ("Worker_Worker-Number", "0"),
    ]


def test_older_form(spark):
    older = shred.explode_nodes(plans(spark, ignored=shred.OLDER_IGNORED_TAGS, first_width=1), "plan_id")
    assert [n["width"] for n in older.orderBy("node_id").collect()] == [0, 1, 1, 2]
    assert len(shred.IGNORED_TAGS) == 31 and len(shred.OLDER_IGNORED_TAGS) == 13


def test_text_forms(spark):
    reflected = shred.reflect_depth(plans(spark))
    text = {r["plan_id"]: r["plan_text"] for r in shred.linearize_plans(reflected).collect()}
    assert text[2] is None
    assert text[1] == (
        " NODE Seq Scan|0|0|Sort_0_1|Filter : x < 3 & y NODE Sort|0|1|Append_0_2|Sort-Key_Item : a|Sort-Key_Item : b & c"
        "|Worker_Worker-Number : 0 NODE Result|1|1|Append_0_2|Alias :  NODE Append|0|2|Query"
    )
    bare = shred.linearize_plans(reflected, with_position=False, with_parent=False, last_only=True, order="name")
    assert bare.where("plan_id = 1").first()["plan_text"] == (
        " NODE Append NODE Result|Alias :  NODE Seq Scan|Filter : x < 3 & y NODE Sort|Sort-Key_Item : b & c|Worker_Worker-Number : 0"
    )
    assert plans(spark, on_missing="drop").count() == 1


def test_long_text_is_read_whole(spark):
    long = "<Plan><Node-Type>Result</Node-Type><Output>" + "x " * 100_000 + "</Output></Plan>"
    df = spark.createDataFrame([(1, long)], "plan_id int, xml_plan string")
    node = shred.explode_nodes(shred.shred_plans(df), "plan_id").first()
    assert len(node["attrs"][0]["value"]) == 199_999


def edges(spark, pairs):
    return spark.createDataFrame([(g, a, b) for g, a, b in pairs], "graph_id int, src string, dst string")


def test_layers_respect_every_edge(spark):
    pairs = [(1, "a", "b"), (1, "b", "c"), (1, "a", "c"), (1, "c", "d"), (1, "x", "d"), (2, "p", "q")]
    layered, left = dags.layers(edges(spark, pairs))
    layer = {(r["graph_id"], r["node"]): r["layer"] for r in layered.collect()}
    assert layer == {(1, "a"): 0, (1, "x"): 0, (1, "b"): 1, (1, "c"): 2, (1, "d"): 3, (2, "p"): 0, (2, "q"): 1}
    assert left.isEmpty()
    text = {r["graph_id"]: r["nodes_text"] for r in dags.layers_text(layered).collect()}
    assert text == {1: " NODE a NODE x NODE b NODE c NODE d", 2: " NODE p NODE q"}


def test_cycles_are_reported(spark):
    looped = edges(spark, [(1, "a", "b"), (1, "b", "c"), (1, "c", "b"), (1, "c", "d"), (2, "x", "y"), (2, "y", "x")])
    layered, left = dags.layers(looped)
    assert {(r["node"], r["layer"]) for r in layered.collect()} == {("a", 0)}
    assert left.count() == 5
    assert [r["graph_id"] for r in dags.graphs_without_sink(looped).collect()] == [2]


def _random_graphs(seed, graphs, nodes, links):
    rng = random.Random(seed)
    pairs = {(g, f"n{rng.randrange(nodes)}", f"n{rng.randrange(nodes)}") for g in range(graphs) for _ in range(links)}
    return [(g, a, b) for g, a, b in pairs if a < b or rng.random() < 0.04]


def _plain_layers(pairs):
    layer, into = {}, {}
    for g, a, b in pairs:
        into.setdefault((g, b), set()).add((g, a))
        into.setdefault((g, a), set())
    while free := [n for n, before in into.items() if n not in layer and all(x in layer for x in before)]:
        layer.update({n: max((layer[x] + 1 for x in into[n]), default=0) for n in free})
    return layer


@pytest.mark.parametrize("local_edges", [250_000, 6, 0])
def test_layers_in_tasks_and_in_rounds(spark, local_edges):
    pairs = _random_graphs(5, 40, 8, 10) + [(100, f"m{i:03}", f"m{i + 1:03}") for i in range(30 if local_edges > 6 else 8)] + [(None, "a", "b"), (None, "b", "c")]
    want = _plain_layers(set(pairs))
    layered, left = dags.layers(edges(spark, pairs + pairs[:50] + [(1, None, "x")]), local_edges)
    assert {(r["graph_id"], r["node"]): r["layer"] for r in layered.collect()} == want and layered.count() == len(want)
    assert {tuple(r) for r in left.collect()} == {p for p in set(pairs) if (p[0], p[1]) not in want}


def test_each_edge_is_taken_off_once():
    src, dst = np.arange(2000), np.arange(1, 2001)
    assert list(dags._layer_numbers(src, dst, 2001)) == list(range(2001))


def test_closure_doubles(spark):
    chain = [(1, f"m{i:03}", f"m{i + 1:03}") for i in range(65)]
    got = {(r["start"], r["node"]) for r in dags.closure(edges(spark, chain + chain)).collect()}
    names = [f"m{i:03}" for i in range(66)]
    assert got == {(a, b) for i, a in enumerate(names) for b in names[i + 1 :]}
    assert dags.closure(edges(spark, [])).count() == 0


def _plain_closure(pairs):
    onward = {}
    for g, a, b in pairs:
        onward.setdefault((g, a), set()).add(b)
    found = set()
    for g, a in onward:
        todo, seen = list(onward[g, a]), set()
        while todo:
            if (node := todo.pop()) not in seen:
                seen.add(node)
                todo += onward.get((g, node), ())
        found |= {(g, a, b) for b in seen}
    return found


@pytest.mark.parametrize("local_edges", [dags.LOCAL_CLOSED, 7, 0])
def test_closure_in_tasks_and_in_rounds(spark, monkeypatch, local_edges):
    monkeypatch.setattr(dags, "MARKED_PAIRS", 100)
    pairs = _random_graphs(9, 40, 9, 11) + [(100, f"m{i:03}", f"m{i + 1:03}") for i in range(20)] + [(101, "z", "y"), (101, "y", "z"), (101, "x", "x")]
    got = dags.closure(edges(spark, pairs + pairs[:60] + [(1, None, "x"), (None, "a", "b"), (None, "b", "c"), (None, "a", "b")]), local_edges)
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == _plain_closure(pairs) | {(None, "a", "b"), (None, "b", "c")} and len(rows) == len(set(rows))


def _read_times(df):
    return df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")


def test_graphs_of_plans_are_read_once(spark):
    df = spark.createDataFrame([(1, XML), (2, None), (3, "")], "plan_id int, xml_plan string")
    links, nodes = dags.plan_graphs(shred.shred_plans(df), "plan_id")
    assert _read_times(links) == _read_times(nodes) == 0
    layered, _ = dags.node_layers(links, nodes)
    assert _read_times(layered) == 0 and {r["graph_id"] for r in layered.collect()} == {1}


def test_node_layers_of_loops_loose_ends_and_lone_nodes(spark):
    links = edges(spark, [(1, "a", "b"), (1, "c", "d"), (1, "d", "c"), (1, "d", "e"), (1, "f", None), (None, "p", "q")])
    nodes = spark.createDataFrame([(1, x) for x in "abcdefgg"] + [(None, "p")], "graph_id int, node string")
    layered, _ = dags.node_layers(links, nodes)
    got = sorted(((r["graph_id"] or 0, r["node"], r["layer"]) for r in layered.collect()))
    assert got == [(0, "p", 0), (1, "a", 0), (1, "b", 1), (1, "g", 0), (1, "g", 0)]


def test_plans_are_read_once_when_failures_are_dropped(spark):
    from tablewright.operators import convert, prep

    lines = spark.createDataFrame([(1, "q col : a row 1 : 5", "x", XML), (2, "q", "x", XML), (3, "q col : a row 1 : 5", "x", None)], "line_no int, question string, answer string, xml_plan string")
    kept = prep.drop_failed(convert.convert_pairs(lines))
    assert _read_times(kept) == 1 and [(r["line_no"], r["kinds"]) for r in kept.collect()] == [(1, ["number"])]


def test_documents_are_not_broadcast(spark):
    from tablewright.queries import load

    plan = load()["convert_line_pairs"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    document = plan.index("<explain")
    assert "SortMergeJoin" in plan[:document] and "BroadcastExchange" not in plan[plan[:document].rindex("\n") - 400 : document]


def test_rows_are_dealt_out_by_their_number(spark):
    from tablewright.sources.driver_tables import spread

    dealt = spread(spark.range(1000).coalesce(1), rows_per_task=10)
    assert dealt.rdd.getNumPartitions() == 100 and dealt.count() == 1000


def test_reach_in_both_directions(spark):
    looped = edges(spark, [(1, "a", "b"), (1, "b", "c"), (1, "c", "a"), (1, "c", "d")])
    starts = spark.createDataFrame([(1, "a")], "graph_id int, node string")
    assert {r["node"] for r in dags.reach(looped, starts).collect()} == {"b", "c", "d"}
    ends = spark.createDataFrame([(1, "d")], "graph_id int, node string")
    assert {r["node"] for r in dags.reach(looped, ends, backward=True).collect()} == {"a", "b", "c"}


def test_kinds(spark):
    words = ["count", "where", "- 5", "5 -", "> 3", "=", "l 5", "c1", "gb", "ob desc", "h", "a| b", "text"]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    kinds = df.select("i", shred.operator_kind(F.col("w"), F.array(F.lit("c1"))).alias("k")).orderBy("i").collect()
    assert [k["k"] for k in kinds] == ["A", "S", "OP", "OP", "C", "C", "L", "P", "GB", "OB", "H", "V", "V"]


def test_reading_grows_with_the_document():
    from time import perf_counter

    from tablewright.plans.reader import nodes_of

    def seconds(n):
        inner = "<Plan><Node-Type>Seq Scan</Node-Type><Filter>(a &lt; 5)</Filter></Plan>" * n
        start = perf_counter()
        assert len(nodes_of(f"<Query><Plan><Node-Type>Append</Node-Type><Plans>{inner}</Plans></Plan></Query>", ("Plan-Rows",), 0)) == n + 1
        return perf_counter() - start

    seconds(200)
    assert min(seconds(16_000) for _ in range(3)) < 8 * min(seconds(4_000) for _ in range(3))


def test_nodes_in_sql(spark):
    register_plan_nodes(spark, shred.IGNORED_TAGS)
    df = spark.createDataFrame([(1, XML), (2, None), (3, "")], "plan_id int, xml_plan string")
    got = spark.sql("SELECT p.plan_id, n.* FROM {p} p, LATERAL plan_nodes(p.xml_plan) n", p=df)
    want = shred.explode_nodes(shred.shred_plans(df), "plan_id")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))


def test_a_round_is_made_only_for_nodes_that_lead_on(spark, monkeypatch):
    folders = []
    make = dags._folder
    monkeypatch.setattr(dags, "_folder", lambda s, kind: folders.append(make(s, kind)) or folders[-1])
    rows = [(1, "a", f"m{i}") for i in range(5)] + [(1, f"m{i}", "z") for i in range(5)] + [(1, "a", "z"), (1, "a", "z"), (None, "p", "q"), (None, "q", "r"), (None, "p", "r")]
    rows += [(2, "x", "y"), (3, "u", "v"), (3, "v", "u"), (3, "u", "w"), (3, "s", "u")]
    edges = spark.createDataFrame(rows, "graph_id int, src string, dst string")
    placed, left = dags.layers(edges, local_edges=2)
    want = {(1, "a", 0), (1, "z", 2), *((1, f"m{i}", 1) for i in range(5)), (None, "p", 0), (None, "q", 1), (None, "r", 2), (2, "x", 0), (2, "y", 1), (3, "s", 0)}
    assert sorted(map(tuple, placed.collect()), key=repr) == sorted(want, key=repr)
    assert sorted(map(tuple, left.collect()), key=repr) == [(3, "u", "v"), (3, "u", "w"), (3, "v", "u")]
    written = sorted(p.name for f in folders for p in Path(f.removeprefix("file:")).iterdir())
    # Round 2 places the last nodes, and none of them leads on: there is no third.
    assert written == ["counters", "edges", "front-0", "front-1", "front-2", "large", "taken"]
