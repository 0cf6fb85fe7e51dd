"""Problem 6: deeply nested records shredded into columns and rebuilt as linked flat tables.

Every leaf path of the JSON becomes a column of values with a repetition level (at which list the value
starts a new element) and a definition level (how much of the path is present). Each list also gets one
structure column without values, so that elements without any leaf keep their place. A table per repeated
ancestor is rebuilt from the level sequences alone: counting repetitions gives the element's position in
every enclosing list, the definition level tells objects from nulls and scalars.

Defined results: null text and invalid JSON (cut off, NaN, trailing text) give no rows; null elements are no
nodes but keep their position; a single object in one of the named list fields counts as a list of one, and
JSON text in such a field is read in its place, however often it is text in text; text there that is no JSON list or
object is an ordinary value. All walks keep their own stack, so a record may be nested as deeply as the parser allows;
what the parser refuses as too deep gives no rows, like invalid JSON.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIST_FIELDS = frozenset({"thoughts", "search_result_groups", "entries", "content_references", "items"})
CHUNK = 256
NODE_SCHEMA = "node_path string, parent_path string"


class Invalid(ValueError):
    pass


def _no_constant(name: str):
    raise Invalid(name)


def parse(text: str | None):
    """The JSON value of a text, or Invalid."""
    if text is None:
        raise Invalid("null")
    try:
        return json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError) as e:
        raise Invalid(str(e)) from None


def as_list(value):
    """What stands in a list field: text is read as JSON, a single object becomes a list of one."""
    while isinstance(value, str):
        try:
            inner = parse(value)
        except Invalid:
            return value
        if not isinstance(inner, (list, dict, str)):
            return value
        value = inner
    return [value] if isinstance(value, dict) else value


@dataclass(slots=True)
class Node:
    """A place in the schema: it may be seen as a scalar, an object and a list in different records."""

    path: str
    lists: int
    level: int
    scalar: bool = False
    leaf: bool = False
    fields: dict[str, "Node"] = field(default_factory=dict)
    element: "Node | None" = None
    rep: list[int] = field(default_factory=list)
    dfn: list[int] = field(default_factory=list)
    values: list = field(default_factory=list)
    marks_rep: list[int] = field(default_factory=list)
    marks_dfn: list[int] = field(default_factory=list)
    below: list[tuple] | None = None

    def child(self, name: str) -> "Node":
        if name not in self.fields:
            self.fields[name] = Node(f"{self.path}.{name}", self.lists, self.level + 1)
        return self.fields[name]

    def items(self) -> "Node":
        if self.element is None:
            self.element = Node(f"{self.path}[]", self.lists + 1, self.level + 1)
        return self.element


def learn(root: Node, value, structure_only: bool) -> None:
    """Widen the schema by one value."""
    stack = [(root, value)]
    while stack:
        node, value = stack.pop()
        if isinstance(value, dict):
            fields = node.fields
            for k, v in value.items():
                if v is None:
                    continue
                if k in LIST_FIELDS:
                    v = as_list(v)
                nested = isinstance(v, (dict, list))
                if structure_only and not nested:
                    continue
                child = fields.get(k) or node.child(k)
                if nested:
                    stack.append((child, v))
                else:
                    child.scalar = True
        elif isinstance(value, list):
            e = node.items()
            for v in value:
                if isinstance(v, (dict, list)):
                    stack.append((e, v))
                elif v is not None and not structure_only:
                    e.scalar = True
        elif not structure_only:
            node.scalar = True


def _absent(node: Node, rep: int, dfn: int) -> None:
    if node.below is None:
        node.below = columns_below(node)
    for r, d, values in node.below:
        r.append(rep)
        d.append(dfn)
        if values is not None:
            values.append(None)


def emit(root: Node, value, rep: int) -> None:
    """Append one value's levels to every column below ``root``; the value is present, so its level is reached.

    Null elements wait on the stack like all others, as they fill the same columns as their neighbours.
    """
    stack = [(root, value, rep)]
    push, pop = stack.append, stack.pop
    while stack:
        node, value, rep = pop()
        level = node.level
        if value is None:
            _absent(node, rep, level)
            continue
        is_object = isinstance(value, dict)
        is_list = not is_object and isinstance(value, list)
        if node.scalar:
            plain = not is_object and not is_list
            node.rep.append(rep)
            node.dfn.append(level + 1 if plain else level)
            node.values.append(value if plain else None)
        if node.fields:
            if is_object:
                get = value.get
                for name, child in node.fields.items():
                    v = get(name)
                    if v is None:
                        _absent(child, rep, level)
                        continue
                    if name in LIST_FIELDS:
                        v = as_list(v)
                    if child.leaf and not isinstance(v, (dict, list)):
                        child.rep.append(rep)
                        child.dfn.append(level + 2)
                        child.values.append(v)
                    else:
                        push((child, v, rep))
            else:
                for child in node.fields.values():
                    _absent(child, rep, level)
        e = node.element
        if e is None:
            continue
        if not is_list or not value:
            e.marks_rep.append(rep)
            e.marks_dfn.append(level)
            _absent(e, rep, level)
            continue
        n, lists = len(value), e.lists
        e.marks_rep.append(rep)
        e.marks_dfn.extend([level + 2 if isinstance(v, dict) else level + 1 for v in value])
        if n > 1:
            e.marks_rep.extend([lists] * (n - 1))
            stack.extend([(e, value[i], lists) for i in range(n - 1, 0, -1)])
        push((e, value[0], rep))


def nodes_of(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        if node.element is not None:
            stack.append(node.element)
        stack.extend(reversed(node.fields.values()))


def pruned(root: Node) -> None:
    """Drop the branches without a column."""
    for node in reversed(list(nodes_of(root))):  # children before their parents
        node.fields = {k: c for k, c in node.fields.items() if c.scalar or c.element is not None or c.fields}
        node.leaf = node.scalar and not node.fields and node.element is None


def columns_below(node: Node) -> list[tuple]:
    """All columns that a missing value at a node must fill."""
    out = []
    for n in nodes_of(node):
        if n.scalar:
            out.append((n.rep, n.dfn, n.values))
        if n.element is not None:
            out.append((n.element.marks_rep, n.element.marks_dfn, None))
    return out


def shred(value, root: Node) -> None:
    """Fill the columns of ``root`` with the levels of one record (they are emptied first)."""
    if root.below is None:
        root.below = columns_below(root)
    for r, d, values in root.below:
        r.clear()
        d.clear()
        if values:
            values.clear()
    emit(root, value, 0)


def places(rep: Iterable[int], lists: int) -> Iterator[list[int]]:
    """Positions in every enclosing list for each entry of a level sequence."""
    at = [-1] + [0] * (lists - 1) if lists else []
    for r in rep:
        if r:
            at[r - 1] += 1
            for k in range(r, lists):
                at[k] = 0
        elif lists:
            at[0] += 1
        yield at


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _paths(list_path: str) -> Callable[[list[int]], tuple[str, str | None]]:
    """From positions in every list to (node path, parent path) of an element of ``list_path``."""
    pieces = [p.replace("%", "%%") for p in list_path.split("[]")[:-1]]
    if not pieces:
        return lambda at: ("$", None)
    lists, above = len(pieces), "[%d]".join(pieces[:-1]) + "[%d]"
    if lists == 1:
        return lambda at: (f"{list_path[:-2]}[{at[0]}]", "$")
    below = list_path.split("[]")[-2]

    def of(at: list[int]) -> tuple[str, str]:
        parent = above % tuple(at[: lists - 1])
        return f"{parent}{below}[{at[lists - 1]}]", parent

    return of


def assemble(element: Node) -> Iterator[tuple[str, str]]:
    """(node path, parent path) of every object in one list, from that list's level sequences."""
    whole = element.level + 1
    if whole not in element.marks_dfn:
        return
    pieces = element.path.split("[]")[:-1]
    outer = len(pieces) - 1
    above = "[%d]".join(p.replace("%", "%%") for p in pieces[:-1]) + "[%d]"
    for at, d in zip(places(element.marks_rep, element.lists), element.marks_dfn):
        if d == whole:
            if outer:
                parent = above % tuple(at[:-1])
                yield f"{parent}{pieces[-1]}[{at[-1]}]", parent
            else:
                yield f"{pieces[-1]}[{at[-1]}]", "$"


def records(texts: list[str | None], structure_only: bool) -> Iterator[tuple[int, list[Node]]]:
    """Shredded columns of each valid record; the schema is learnt over small blocks of records."""
    for start in range(0, len(texts), CHUNK):
        root, parsed = Node("$", 0, 0), []
        for i in range(start, min(start + CHUNK, len(texts))):
            try:
                parsed.append((i, parse(texts[i])))
            except Invalid:
                continue
            learn(root, parsed[-1][1], structure_only)
        pruned(root)
        columns = list(nodes_of(root))
        for i, value in parsed:
            shred(value, root)
            yield i, columns


def node_table(rows: DataFrame, key: str, text: str) -> DataFrame:
    """One row (key, node_path, parent_path) per object that is an element of a list in ``text``, at any depth."""
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys, texts = f["k"].tolist(), f["t"].tolist()
            out: list[tuple] = []
            for i, columns in records(texts, structure_only=True):
                k = keys[i]
                for n in columns:
                    if n.element is not None:
                        out.extend((k, *x) for x in assemble(n.element))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=[key, "node_path", "parent_path"])
                    out = []
            yield pd.DataFrame(out, columns=[key, "node_path", "parent_path"])

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").mapInPandas(run, f"`{key}` {kind}, {NODE_SCHEMA}")


def shredded(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The columns themselves: one row (key, leaf_path, rep, dfn, values) per record and leaf path."""
    kind = dict(rows.dtypes)[key]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys, out = f["k"].tolist(), []
            for i, columns in records(f["t"].tolist(), structure_only=False):
                for n in columns:
                    if n.scalar:
                        out.append((keys[i], n.path, n.lists, n.level + 1, list(n.rep), list(n.dfn), [_text(v) for v in n.values]))
                if len(out) > 20_000:
                    yield pd.DataFrame(out, columns=[key, "leaf_path", "lists", "full", "rep", "dfn", "values"])
                    out = []
            yield pd.DataFrame(out, columns=[key, "leaf_path", "lists", "full", "rep", "dfn", "values"])

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").mapInPandas(
        run, f"`{key}` {kind}, leaf_path string, lists int, full int, rep array<int>, dfn array<int>, values array<string>"
    )


def parted(root: Node) -> Iterator[tuple[Node | None, Node]]:
    """Every column of values below ``root`` with the element of the nearest list around it."""
    stack: list[tuple[Node | None, Node]] = [(None, root)]
    while stack:
        at, node = stack.pop()
        if node.scalar:
            yield at, node
        if node.element is not None:
            stack.append((node.element, node.element))
        stack.extend((at, child) for child in reversed(node.fields.values()))


def flat_rows(root: Node) -> Iterator[tuple[str, str, str | None, str | None, str | None]]:
    """(list path, node path, parent path, leaf, value) of one shredded record: each value at its nearest list element,
    and one row without leaf for each object there that has no value of its own."""
    filled: dict[str, set[str]] = {}
    for element, n in parted(root):
        full, place = n.level + 1, _paths(element.path if element else "$")
        table, own = (element.path, filled.setdefault(element.path, set())) if element else ("$", set())
        leaf = n.path[len(table) + 1 :]
        for at, d, v in zip(places(n.rep, n.lists), n.dfn, n.values):
            if d == full:
                node, parent = place(at)
                own.add(node)
                yield table, node, parent, leaf, _text(v)
    for n in nodes_of(root):
        if n.element is not None:
            own = filled.get(n.element.path, ())
            yield from ((n.element.path, node, parent, None, None) for node, parent in assemble(n.element) if node not in own)


def flat_tables(rows: DataFrame, key: str, text: str) -> DataFrame:
    """The flat tables of all lists in one: (key, list_path, node_path, parent_path, leaf, value). ``leaf_table`` gives the
    rows of one ``list_path`` that have a value. An element that is a value itself has the leaf ''; what stands in
    no list has the list and node path ``$`` and no parent."""
    kind = dict(rows.dtypes)[key]
    names = [key, "list_path", "node_path", "parent_path", "leaf", "value"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys, out = f["k"].tolist(), []
            for i, columns in records(f["t"].tolist(), structure_only=False):
                k = keys[i]
                out.extend((k, *x) for x in flat_rows(columns[0]))
                if len(out) > 50_000:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    return rows.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").mapInPandas(run, f"`{key}` {kind}, list_path string, {NODE_SCHEMA}, leaf string, value string")


def leaf_table(columns: DataFrame, key: str, list_path: str) -> DataFrame:
    """The flat table of one repeated ancestor (such as ``$[].metadata.search_result_groups[].entries[]``): one row per
    present leaf value with the ancestor's path, its parent's path, the leaf's name and the value. Where the element
    is a value itself (``$[].content.parts[]``), the leaf is ''."""
    kind = dict(columns.dtypes)[key]
    prefix = list_path + "."
    place = _paths(list_path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for k, path, depth, full, rep, dfn, values in f[[key, "leaf_path", "lists", "full", "rep", "dfn", "values"]].itertuples(index=False, name=None):
                for at, d, v in zip(places(rep, depth), dfn, values):
                    if d == full:
                        out.append((k, *place(at), path[len(prefix) :], v))
            yield pd.DataFrame(out, columns=[key, "node_path", "parent_path", "leaf", "value"])

    below = F.col("leaf_path").startswith(prefix) & ~F.expr(f"substring(leaf_path, {len(prefix) + 1})").contains("[]")
    kept = columns.filter(below | (F.col("leaf_path") == list_path))
    return kept.mapInPandas(run, f"`{key}` {kind}, {NODE_SCHEMA}, leaf string, value string")
