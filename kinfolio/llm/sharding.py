"""Shards of near-equal bytes: the leaves of a k-d tree over documents' metadata.

A node is cut where the weighted median of its bytes lies along its widest metadata
dimension, again and again, until its bytes are about the target. The median is
found where the rows are: a round sums the bytes of up to ``BUCKETS`` intervals of all
nodes in one aggregation, and the next one looks into the interval that holds the cut,
down to a single row. Only those sums and one row a node reach the driver; rows are written
once a level, without their texts, and move only when shards are numbered.

Rows with the same value in a dimension are ordered by their text's hash, then by id and
then by their place in the written table, so ties of any size can be cut, and equal texts
stay side by side: copies part only where a cut falls within their group.

Null texts and empty ones count one byte. A missing value in a dimension is its smallest;
null ids come first. Repeated rows are rows of their own. Texts of any length count
whole; a single text larger than the target makes its shard as large. An empty table gives an empty result. Other
columns aren't read. A shard may stay empty where there are fewer rows than shards.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfolio.session import broadcast_if_small, cut, scratch_table

#: Intervals that a round tells apart, of all nodes together.
BUCKETS = 1 << 15
#: Rows of a file that are numbered as one group.
BLOCK = 1 << 16
#: Ids beyond are equal in order, so that differences fit into a long.
FAR = 1 << 62
_MAX = (1 << 63) - 1
_PARTS = ("value", "hash", "id", "place")


@dataclass
class _Node:
    """A node of the tree: how many leaves it becomes, and how far the search for its cut is."""

    leaves: int
    dim: int = 0
    want: float = 0.0
    below: float = 0.0
    part: int = 0
    equal: list[int] = field(default_factory=list)
    low: int = 0
    high: int = -1
    done: bool = True
    cut: tuple[int, ...] = (_MAX,) * len(_PARTS)


def text_code(value: Column) -> Column:
    """A long that orders texts by their first seven bytes; null and the empty text are 0."""
    head = F.rpad(F.hex(F.substring(F.coalesce(value, F.lit("")).cast("binary"), 1, 7)), 14, "0")
    return F.conv(head, 16, 10).cast("long")


def _code(column: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return text_code(column)
    return _held(column.cast("long"))


def _held(number: Column) -> Column:
    """Between -FAR and FAR; a missing number is -FAR."""
    return F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.coalesce(number, F.lit(-FAR))))


def metadata(docs: DataFrame, dims: list[str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, size, text_crc32, hash, id, d0, d1, ...`` of every row; the only look at the texts."""
    raw = F.coalesce(F.col(text), F.lit(""))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    tie = F.conv(F.substring(F.md5(raw.cast("binary")), 1, 15), 16, 10).cast("long")
    number = F.xxhash64(key) / 4 if isinstance(kinds[key], T.StringType) else F.col(key)
    ident = _held(number.cast("long"))
    return docs.select(
        F.col(key).alias("key"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw.cast("binary")).alias("text_crc32"),
        tie.alias("hash"),
        ident.alias("id"),
        *(_code(F.col(d), kinds[d]).alias(f"d{i}") for i, d in enumerate(dims)),
    )


def _pick(values: list, of: Column, kind: str = "long") -> Column:
    """The literal of each row's node."""
    return F.element_at(F.array(*(F.lit(v).cast(kind) for v in values)), of + 1)


def _widest(rows: DataFrame, nodes: list[_Node], n_dims: int, spans: list[int] | None) -> list[int]:
    """Sets each node's bytes and widest dimension, by its span's share of the root's; returns the root's spans."""
    ends = [f(f"d{i}").alias(f"{n}{i}") for i in range(n_dims) for n, f in (("a", F.min), ("b", F.max))]
    found = {r.node: r for r in rows.groupBy("node").agg(F.sum("size").alias("bytes"), *ends).collect()}  # one row a node
    if spans is None:
        spans = [found[0][f"b{i}"] - found[0][f"a{i}"] for i in range(n_dims)] if found else [0] * n_dims
    for at, node in enumerate(nodes):
        r = found.get(at)
        if r is None or node.leaves == 1:
            continue
        shares = [(r[f"b{i}"] - r[f"a{i}"]) / max(spans[i], 1) for i in range(n_dims)]
        node.dim = max(range(n_dims), key=lambda i: (shares[i], -i))
        node.want = r.bytes * (node.leaves // 2) / node.leaves
        node.low, node.high = r[f"a{node.dim}"], r[f"b{node.dim}"]
        node.done = False
    return spans


def _step(node: _Node, width: int, sums: list) -> None:
    """Narrows a node's search to the interval where its bytes reach what is wanted."""
    for r in sums:
        if node.below + r.bytes >= node.want or r is sums[-1]:
            break
        node.below += r.bytes
    if r.n == 1 or (r.a == r.b and node.part == len(_PARTS) - 1):
        after = node.below + r.bytes - node.want < node.want - node.below
        rest = (_MAX,) * (len(_PARTS) - node.part - 1)
        node.cut = (*node.equal, r.a if after else r.a - 1, *rest)
        node.done = True
    elif r.a == r.b:
        node.equal.append(r.a)
        node.part += 1
        node.low, node.high = -(1 << 63), _MAX
    else:
        node.low, node.high = r.a, r.b


def _medians(rows: DataFrame, nodes: list[_Node], n_dims: int) -> None:
    """Finds the cuts of all nodes of a level, an aggregation a round."""
    at = F.col("node")
    while any(not n.done for n in nodes):
        each = max(16, BUCKETS // sum(not n.done for n in nodes))
        widths = [1 if n.done else max(1, -(-(min(n.high, FAR) - max(n.low, -FAR) + 1) // each)) for n in nodes]
        parts = {"value": F.element_at(F.array(*(F.col(f"d{i}") for i in range(n_dims))), _pick([n.dim + 1 for n in nodes], at, "int"))}
        keys = [parts.get(p, F.col(p)) for p in _PARTS]
        now = _pick([n.part for n in nodes], at, "int")
        open_ = _pick([not n.done for n in nodes], at, "boolean")
        for i in range(len(_PARTS) - 1):
            open_ &= (now <= i) | (keys[i] == _pick([n.equal[i] if i < len(n.equal) else 0 for n in nodes], at))
        x = F.element_at(F.array(*keys), now + 1)
        met = rows.where(open_).select("node", "size", x.alias("x"), _pick(widths, at).alias("w"), _pick([n.low for n in nodes], at).alias("lo"), _pick([n.high for n in nodes], at).alias("hi"))
        met = met.where("x between lo and hi").withColumn("bucket", F.expr("(x - pmod(x, w)) div w"))
        sums = met.groupBy("node", "bucket").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("x").alias("a"), F.max("x").alias("b"))
        by: dict[int, list] = {}
        for r in sums.collect():  # at most BUCKETS rows and two more a node
            by.setdefault(r.node, []).append(r)
        for i, node in enumerate(nodes):
            if not node.done:
                _step(node, widths[i], sorted(by[i], key=lambda r: r.bucket))


def _descend(rows: DataFrame, nodes: list[_Node], n_dims: int) -> tuple[DataFrame, list[_Node]]:
    """Rows with the nodes of the next level, and these from left to right."""
    below: list[_Node] = []
    left, right = [], []
    for n in nodes:
        left.append(len(below))
        below.append(_Node(max(1, n.leaves // 2)))
        right.append(len(below))
        if n.leaves > 1:
            below.append(_Node(n.leaves - n.leaves // 2))
    at = F.col("node")
    value = F.element_at(F.array(*(F.col(f"d{i}") for i in range(n_dims))), _pick([n.dim + 1 for n in nodes], at, "int"))
    row = F.struct(value.alias("value"), "hash", "id", "place")
    cuts = F.struct(*(_pick([n.cut[i] for n in nodes], at).alias(p) for i, p in enumerate(_PARTS)))
    goes = F.when(row <= cuts, _pick(left, at, "int")).otherwise(_pick(right, at, "int"))
    return rows.withColumn("node", goes), below


def placed(rows: DataFrame, n_dims: int, leaves: int) -> DataFrame:
    """Adds ``shard`` to a written table of :func:`metadata`, with ``file`` and ``row``, a row's place in it."""
    at = F.col("_metadata")
    rows = rows.withColumns({"file": at["file_name"], "row": at["row_index"]})
    rows = rows.withColumns({"place": F.shiftrightunsigned(F.xxhash64("file", "row"), 2), "node": F.lit(0)})
    nodes, spans = [_Node(leaves)], None
    while any(n.leaves > 1 for n in nodes):
        spans = _widest(rows, nodes, n_dims, spans)
        _medians(rows, nodes, n_dims)
        rows, nodes = _descend(rows, nodes, n_dims)
        # Written, since nodes in terms of nodes would grow beyond what Spark compiles.
        rows = cut(rows)
    return rows.withColumn("shard", F.col("node"))


def numbered(rows: DataFrame) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard, in the order of the written table.

    Rows are counted by blocks of their files; a block's first slot is the sum of those before it.
    """
    block = rows.withColumn("block", F.floor(F.col("row") / BLOCK))
    group = ["shard", "file", "block"]
    sizes = cut(block.groupBy(group).agg(F.count("*").alias("n")))
    ahead = W.partitionBy("shard").orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1)
    first = sizes.select(*group, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    inside = F.row_number().over(W.partitionBy(*group).orderBy("row")) - 1
    counted = block.withColumn("inside", inside).join(broadcast_if_small(cut(first)), group)
    return counted.withColumn("slot", F.col("first") + F.col("inside"))


def shard(docs: DataFrame, leaves: int | None = None, target_bytes: int | None = None, dims: list[str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, size, text_crc32, shard, slot`` of every row.

    The tree has ``leaves`` leaves or as many as shards of ``target_bytes`` take. ``dims``
    are columns of texts or numbers, by default those of source, lang and n_chars that are there.
    The tree's nodes are on the driver, so it is meant for up to some thousands of leaves.
    """
    names = [d for d in ("source", "lang", "n_chars") if d in docs.columns] if dims is None else dims
    if (leaves is None) == (target_bytes is None):
        raise ValueError("give either leaves or target_bytes")
    if (leaves if target_bytes is None else target_bytes) < 1:
        raise ValueError("leaves and target_bytes have to be at least 1")
    rows = metadata(docs, names, text, key)
    if not names:
        rows, names = rows.withColumn("d0", F.lit(0).cast("long")), ["d0"]
    rows = scratch_table(rows, "metadata")
    if leaves is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        leaves = max(1, math.ceil(total / target_bytes))
    out = numbered(placed(rows, len(names), leaves))
    return out.select(F.col("key").alias(key), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
