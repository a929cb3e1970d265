"""One plan document to its node list: a single pass over its tags, so the work grows with the document's length."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Executors need not have this package installed: its functions travel with the query.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

NODES = (
    "array<struct<node_id:int,parent_id:int,node_type:string,width:int,depth:int,"
    "attrs:array<struct<key:string,value:string>>>>"
)
# A whole element without elements inside, in its parts, or else a single tag and the text behind it. Text may hold CDATA.
# Every repetition is possessive: a tag that is not whole is given up without trying shorter matches.
_CONTENT = r"[^<]*+(?:<!\[CDATA\[.*?\]\]>[^<]*+)*+"
TAG = re.compile(rf"<([^\s>/!?]++)([^>]*+)(?<!/)>({_CONTENT})(</\1\s*+>)|(<(?![!?])[^>]++>)({_CONTENT})", re.DOTALL)
NAME = re.compile(r"</?(?:[^\s>/:]+:)?([^\s>/]+)")
CDATA_MARKS = re.compile(r"^\s*<!\[CDATA\[|\]\]>\s*(</[^<]*)?$|\]\]>[^<]*<!\[CDATA\[", re.DOTALL)
COMMENTS = r"<!--.*?-->|<\?.*?\?>"
# XML entities; the ampersand comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}


@lru_cache
def passed_over(ignored: tuple[str, ...]) -> re.Pattern:
    """Comments, ignored facts, and lists of child plans: a plan always hangs under the last open one."""
    return re.compile(rf"{COMMENTS}|<(?:{'|'.join(ignored)})(?:\s[^>]*+)?+(?:/>|>[^<]*+</[^>]*+>)|</?Plans/?>", re.DOTALL)


@lru_cache(4096)
def read_head(head: str) -> tuple[str, bool, bool]:
    """Name of a tag from its ``<`` to its ``>``, whether it closes an element, and whether it is an element without content."""
    named = NAME.match(head)
    return named[1] if named else "", head.startswith("</"), head.endswith("/>")


def text_of(body: str, closing: str = "") -> str:
    """Trimmed, unescaped text of an element; CDATA is taken literally."""
    if "<![CDATA[" in body:
        return CDATA_MARKS.sub("", body + closing)
    text = body.strip(" \t\r\n")
    if "&" in text:
        for entity, char in ENTITIES.items():
            text = text.replace(entity, char)
    return text


class Node:
    __slots__ = ("depth", "facts", "next_width", "node_id", "parent_id", "width")

    def __init__(self, node_id: int, parent: Node | None, depth: int, first_width: int) -> None:
        self.node_id, self.depth, self.next_width = node_id, depth, first_width
        # The first plan of a document has no parent and place 0; others count on among their siblings.
        if parent is None:
            self.parent_id, self.width = None, 0
        else:
            self.parent_id, self.width = parent.node_id, parent.next_width
            parent.next_width += 1
        self.facts: list[tuple[str, str | None, str]] = []

    def described(self) -> tuple[str | None, list[tuple[str, str]]]:
        """Type and attributes. Node-Type names the node; a tag that holds others is only their prefix."""
        holders = {holder for _, holder, _ in self.facts if holder is not None}
        kind, kept = None, []
        for tag, holder, text in self.facts:
            if tag == "Node-Type":
                kind = text if kind is None else kind
            elif tag not in holders:
                kept.append((f"{holder}_{tag}" if holder else tag, text))
        return kind, kept

    def row(self) -> dict:
        kind, kept = self.described()
        attrs = [{"key": key, "value": text} for key, text in kept]
        return {"node_id": self.node_id, "parent_id": self.parent_id, "node_type": kind, "width": self.width, "depth": self.depth, "attrs": attrs}


def read_document(xml: str, passed: re.Pattern, skipped: frozenset[str], first_width: int) -> list[Node]:
    """The nodes of a document in its order. ``holders`` are the open facts around a tag, ``hidden`` counts ignored ones among them."""
    nodes: list[Node] = []
    open_nodes: list[Node] = []
    holders: list[str] = []
    inside: Node | None = None
    hidden = 0
    for name, rest, content, closing, head, behind in TAG.findall(passed.sub("", xml)):
        if not head:  # a whole element
            if rest or ":" in name:
                name = read_head(f"<{name}{rest}>")[0]
            if name == "Plan":
                if name not in skipped:
                    nodes.append(Node(len(nodes), inside, len(open_nodes), first_width))
            elif inside is not None and hidden == 0 and name != "Plans" and name not in skipped:
                inside.facts.append((name, holders[-1] if holders else None, text_of(content, closing)))
            continue
        name, closes, empty = read_head(head)
        whole = not closes and (empty or "</" in head or "</" in behind)
        if name == "Plans" or (whole and name in skipped):
            continue
        if name == "Plan":
            if not closes:
                nodes.append(Node(len(nodes), inside, len(open_nodes), first_width))
            if not closes and not whole:
                open_nodes.append(inside := nodes[-1])
            elif closes and open_nodes:
                open_nodes.pop()
                inside = open_nodes[-1] if open_nodes else None
        elif inside is None:
            continue  # elements around the plans hold no facts of theirs
        elif closes:
            if holders:
                holders.pop()
            hidden = max(hidden - 1, 0)
        else:
            hides = not whole and (hidden > 0 or name in skipped)
            if not hides and hidden == 0:
                inside.facts.append((name, holders[-1] if holders else None, text_of(behind)))
            if not whole:
                holders.append(name)
                hidden += hides
    return nodes


def nodes_of(xml: str, ignored: tuple[str, ...], first_width: int) -> list[dict]:
    return [node.row() for node in read_document(xml, passed_over(ignored), frozenset(ignored), first_width)]


def node_lists(texts: pa.Array, ignored: tuple[str, ...], first_width: int) -> pa.Array:
    """The node lists of a batch of documents, NULL for NULL. Columns are filled side by side, so no object is built for a node's row."""
    passed, skipped = passed_over(ignored), frozenset(ignored)
    ends, ids, parents, kinds, widths, depths, pair_ends, keys, values = [0], [], [], [], [], [], [0], [], []
    missing = []
    for text in texts.to_pylist():
        missing.append(text is None)
        for node in () if text is None else read_document(text, passed, skipped, first_width):
            kind, kept = node.described()
            ids.append(node.node_id)
            parents.append(node.parent_id)
            kinds.append(kind)
            widths.append(node.width)
            depths.append(node.depth)
            for key, value in kept:
                keys.append(key)
                values.append(value)
            pair_ends.append(len(keys))
        ends.append(len(ids))
    pairs = pa.StructArray.from_arrays([pa.array(keys, pa.string()), pa.array(values, pa.string())], ["key", "value"])
    attrs = pa.ListArray.from_arrays(pa.array(pair_ends, pa.int32()), pairs)
    whole = [pa.array(c, pa.int32()) for c in (ids, parents)] + [pa.array(kinds, pa.string())] + [pa.array(c, pa.int32()) for c in (widths, depths)]
    nodes = pa.StructArray.from_arrays([*whole, attrs], ["node_id", "parent_id", "node_type", "width", "depth", "attrs"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), nodes, mask=pa.array(missing, pa.bool_()))


def read_nodes(xml: Column, ignored: list[str], first_width: int) -> Column:
    """``nodes_of`` over a column, NULL for NULL, in Arrow batches."""
    names = tuple(ignored)

    @F.arrow_udf(NODES)
    def read(texts: pa.Array) -> pa.Array:
        return node_lists(texts, names, first_width)

    return read(xml)


def register_plan_nodes(spark: SparkSession, ignored: list[str], first_width: int = 0, name: str = "plan_nodes") -> None:
    """Make ``name(xml)`` a table function of the session: ``FROM plans, LATERAL plan_nodes(xml_plan)`` gives a row for each node of a document.

    A missing document has no nodes. A document is read in one pass and rows leave it one by one, so it needs no shuffle.
    """
    names = tuple(ignored)

    class PlanNodes:
        def eval(self, xml: str) -> Iterator[tuple]:
            if xml is not None:
                for node in nodes_of(xml, names, first_width):
                    attrs = [(pair["key"], pair["value"]) for pair in node["attrs"]]
                    yield node["node_id"], node["parent_id"], node["node_type"], node["width"], node["depth"], attrs

    fields = "node_id int, parent_id int, node_type string, width int, depth int, attrs array<struct<key:string,value:string>>"
    spark.udtf.register(name, F.udtf(PlanNodes, returnType=fields))
