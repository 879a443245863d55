"""Deeply nested JSON documents as an adjacency table, and entity tables derived from it.

`adjacency` shreds every document into rows (node, parent, label, ordinal, kind, scalar): one per object,
array and scalar at any depth; the root is node 0 and has no row. `stored_adjacency` writes that table
to the shared folder, so each document is parsed once, whatever is derived from it afterwards.
`node_paths` follows the parent links of the container nodes; `entity_table` joins object nodes with
their scalar children, pivoted into columns, and keeps the link to the enclosing object and the row.

Defined results: a null, empty or unreadable document gives no row; a document stored as a JSON
string that holds the document (once or several times over) counts as that document; of equal keys
in one object the last counts; a lone surrogate becomes '?'; any depth is read. Every row counts by
itself: `row` numbers the source rows, so rows of one key, or without one, are never mixed.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from json.decoder import scanstring

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.session import write_read

NODE_COLUMNS = {
    "row": T.LongType(),
    "node": T.LongType(),
    "parent": T.LongType(),
    "label": T.StringType(),
    "ordinal": T.LongType(),
    "kind": T.StringType(),
    "scalar": T.StringType(),
}
KINDS = ("object", "array", "string", "number", "boolean", "null")
_ROWS_PER_BATCH = 50_000
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?")
_WORDS = {"true": True, "false": False, "null": None}


def _reject(word: str) -> None:
    raise ValueError(word)


def _parse_deep(text: str):
    """Strict JSON without recursion, for documents nested deeper than the C scanner goes."""
    pos, n, stack, key = 0, len(text), [], None
    root = missing = object()

    def blank(i: int) -> int:
        while i < n and text[i] in " \t\n\r":
            i += 1
        return i

    def key_at(i: int) -> tuple[str, int]:
        i = blank(i)
        if text[i] != '"':
            raise ValueError("key")
        name, i = scanstring(text, i + 1, True)
        i = blank(i)
        if text[i] != ":":
            raise ValueError("colon")
        return name, blank(i + 1)

    pos = blank(pos)
    while True:
        ch = text[pos]
        opened = False
        if ch == "{":
            value, pos, opened = {}, blank(pos + 1), True
            if text[pos] == "}":
                pos, opened = pos + 1, False
        elif ch == "[":
            value, pos, opened = [], blank(pos + 1), True
            if text[pos] == "]":
                pos, opened = pos + 1, False
        elif ch == '"':
            value, pos = scanstring(text, pos + 1, True)
        elif m := _NUMBER.match(text, pos):
            value, pos = float(m.group()) if re.search("[.eE]", m.group()) else int(m.group()), m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, pos)), None)
            if word is None:
                raise ValueError("value")
            value, pos = _WORDS[word], pos + len(word)
        if stack:
            holder = stack[-1][0]
            if isinstance(holder, dict):
                holder[stack[-1][1]] = value
            else:
                holder.append(value)
        elif root is missing:
            root = value
        if opened:
            if isinstance(value, dict):
                key, pos = key_at(pos)
                stack.append([value, key])
            else:
                stack.append([value, None])
            continue
        while stack:
            pos = blank(pos)
            holder = stack[-1]
            if text[pos] == ",":
                if isinstance(holder[0], dict):
                    holder[1], pos = key_at(pos + 1)
                else:
                    pos = blank(pos + 1)
                break
            if text[pos] != ("}" if isinstance(holder[0], dict) else "]"):
                raise ValueError("end")
            stack.pop()
            pos += 1
        else:
            if blank(pos) != n:
                raise ValueError("more text")
            return root


def parse_document(text: str | None):
    """The object or array a document holds, or None."""
    while isinstance(text, str):  # every unwrapping is shorter than what it came from
        try:
            text = json.loads(text, parse_constant=_reject)
        except RecursionError:
            try:
                text = _parse_deep(text)
            except (ValueError, IndexError):
                return None
        except ValueError:
            return None
    return text if isinstance(text, (dict, list)) else None


class _Rows:
    """Columns of adjacency rows, filled node by node; the numbers of a document run from 1 without holes."""

    def __init__(self) -> None:
        self.parent, self.label, self.ordinal, self.kind, self.scalar = [], [], [], [], []

    def add_document(self, root) -> Iterator[int]:
        """Append all nodes below root; the count so far is yielded whenever a batch is full."""
        parent, label, ordinal, kind, scalar = self.parent.append, self.label.append, self.ordinal.append, self.kind.append, self.scalar.append
        count, stack = 0, [(root, 0, None)]
        while stack:
            value, node, own = stack.pop()
            named = type(value) is dict
            for key, child in value.items() if named else enumerate(value):
                count += 1
                parent(node)
                if named:
                    label(key)
                    ordinal(None)
                else:
                    label(own)
                    ordinal(key)
                is_a = type(child)
                if is_a is str:
                    kind(2)
                    scalar(child)
                elif is_a is dict or is_a is list:
                    kind(0 if is_a is dict else 1)
                    scalar(None)
                    if child:
                        stack.append((child, count, key if named else own))
                elif child is None:
                    kind(5)
                    scalar(None)
                elif is_a is bool:
                    kind(4)
                    scalar("true" if child else "false")
                else:
                    kind(3)
                    scalar(str(child) if is_a is int else repr(child))
            if len(self.parent) >= _ROWS_PER_BATCH:
                yield count
        yield count


def document_nodes(root) -> list[tuple]:
    """Rows in the order of NODE_COLUMNS, from node on, for everything below the root (node 0)."""
    rows = _Rows()
    for _ in rows.add_document(root):
        pass
    kinds = [KINDS[k] for k in rows.kind]
    return list(zip(range(1, len(kinds) + 1), rows.parent, rows.label, rows.ordinal, kinds, rows.scalar))


def _array(values: list, kind: pa.DataType) -> pa.Array:
    try:
        return pa.array(values, kind)
    except (UnicodeEncodeError, pa.ArrowInvalid):
        return pa.array([v.encode("utf-8", "replace").decode() if isinstance(v, str) else v for v in values], kind)


def adjacency(df: DataFrame, key: str, documents: list[str]) -> DataFrame:
    """Adjacency table of the named JSON columns: key, doc and NODE_COLUMNS.

    One pass without a shuffle: each task parses its own rows and streams nodes out in bounded
    batches. Only the key and document columns are read. An array's elements carry its label and their
    position as ordinal; members of an object have no ordinal.
    """
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("doc", T.StringType()), *(T.StructField(c, t) for c, t in NODE_COLUMNS.items())])

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.set_int_max_str_digits(0)
        kinds = pa.array(KINDS)
        before = TaskContext.get().partitionId() << 33  # number of the batch's first row
        where: list[int] = []
        numbers: list[int] = []
        rows = _Rows()

        def built(keys: pa.Array, name: str) -> pa.RecordBatch:
            n = len(rows.parent)
            arrays = [
                keys.take(pa.array(where, pa.int64())), pa.repeat(name, n), pa.array(np.array(where, dtype=np.int64) + before), pa.array(numbers, pa.int64()), pa.array(rows.parent, pa.int64()), _array(rows.label, pa.string()),
                pa.array(rows.ordinal, pa.int64()), kinds.take(pa.array(rows.kind, pa.int8())), _array(rows.scalar, pa.string()),
            ]
            for column in (where, numbers, rows.parent, rows.label, rows.ordinal, rows.kind, rows.scalar):
                column.clear()  # emptied, not replaced: a document in the middle goes on filling them
            return pa.RecordBatch.from_arrays(arrays, schema.names)

        for batch in batches:
            keys = batch.column(0)
            for at, name in enumerate(documents, 1):
                for i, text in enumerate(batch.column(at).to_pylist()):
                    root = parse_document(text)
                    if root is None:
                        continue
                    done = 0
                    for count in rows.add_document(root):
                        where.extend([i] * (count - done))
                        numbers.extend(range(done + 1, count + 1))
                        done = count
                        if len(rows.parent) >= _ROWS_PER_BATCH:
                            yield built(keys, name)
                if rows.parent:
                    yield built(keys, name)
            before += batch.num_rows

    return df.select(key, *documents).mapInArrow(shred, schema)


def stored_adjacency(df: DataFrame, key: str, documents: list[str]) -> DataFrame:
    """The adjacency table, written to the shared folder once and read back."""
    return write_read(adjacency(df, key, documents), "adjacency")


def object_nodes(nodes: DataFrame) -> DataFrame:
    """The object nodes of an adjacency table or of its paths."""
    return nodes.where(F.col("kind") == "object")


def node_paths(nodes: DataFrame, key: str) -> DataFrame:
    """Every container node with its paths: key, doc, row, node, label, ordinal, kind, node_path, parent_path.

    node_path joins the labels, or positions in arrays, from the root down; parent_path is the path of
    the closest enclosing object, '/' for the root. The containers of one document meet in one task
    (a document came in one row, so they are bounded) and are resolved in the order of their numbers,
    in which parents come first: one shuffle and one pass whatever the depth, where joins on the parent
    link would take one for each level.
    """
    kept = [key, "doc", "row", "node", "parent", "label", "ordinal", "kind"]
    rows = nodes.where(F.col("kind").isin("object", "array")).select(kept).repartition("row", "doc").sortWithinPartitions("row", "doc", "node")
    of = {f.name: f for f in rows.schema}
    text = T.StringType()
    schema = T.StructType([*(of[c] for c in (key, "doc", "row", "node", "label", "ordinal", "kind")), T.StructField("node_path", text), T.StructField("parent_path", text)])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, path, near = None, {}, {}
        for batch in batches:
            paths, parents = [], []
            columns = [batch.column(i).to_pylist() for i in range(1, len(kept))]
            for doc, row, node, parent, label, ordinal, kind in zip(*columns):
                if (row, doc) != current:
                    current, path, near = (row, doc), {0: ""}, {0: "/"}
                step = f"{path[parent]}/{label if ordinal is None else ordinal}"
                above = near[parent]
                path[node] = step
                near[node] = step if kind == "object" else above
                paths.append(step)
                parents.append(above)
            arrays = [batch.column(i) for i in (0, 1, 2, 3, 5, 6, 7)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(paths, pa.string()), pa.array(parents, pa.string())], schema.names)

    return rows.mapInArrow(follow, schema)


def entity_table(nodes: DataFrame, key: str, label: str, attributes: list[str], paths: DataFrame | None = None) -> DataFrame:
    """Flat table of the objects held under label, a column per scalar attribute, linked to the parent.

    nodes is a stored adjacency table, as it is read twice: for the object nodes with their paths
    (paths, if they are there already), and for the scalar children. Those are reduced to one row per
    object before the shuffle, as the nodes of a document lie together, and joined to the object nodes
    on (row, doc, node). An attribute that an object lacks, or that is no scalar there, is null.
    Attribute columns are prefixed with `a_`, so no name clashes with the link columns.
    """
    paths = node_paths(nodes, key) if paths is None else paths
    objects = object_nodes(paths).where(F.col("label") == label).select(key, "doc", "row", "node", "node_path", "parent_path", "ordinal")
    # An object's scalar children carry its node as parent; the scalars of its arrays do not.
    held = nodes.where(F.col("kind").isin("string", "number", "boolean") & F.col("label").isin(attributes) & F.col("ordinal").isNull())
    wide = held.groupBy("row", "doc", F.col("parent").alias("node")).agg(
        *(F.max(F.when(F.col("label") == a, F.col("scalar"))).alias(f"a_{a}") for a in attributes)
    )
    return objects.join(wide, ["row", "doc", "node"], "left").select(key, "doc", "node_path", "parent_path", "ordinal", *(F.col(f"a_{a}") for a in attributes))


def scalar_values(nodes: DataFrame, key: str, paths: DataFrame | None = None) -> DataFrame:
    """The scalars of arrays as a child table: (key, doc, parent_path, label, ordinal, scalar).

    parent_path is the path of the closest object around the array.
    """
    paths = node_paths(nodes, key) if paths is None else paths
    held = nodes.where(F.col("kind").isin("string", "number", "boolean") & F.col("ordinal").isNotNull())
    arrays = paths.where(F.col("kind") == "array").select("row", "doc", F.col("node").alias("parent"), "parent_path")
    # A root that is an array has no row; its elements lie under '/'.
    joined = held.join(arrays, ["row", "doc", "parent"], "left")
    return joined.select(key, "doc", F.coalesce("parent_path", F.lit("/")).alias("parent_path"), "label", "ordinal", "scalar")
