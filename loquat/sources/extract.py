"""Events of source files: calls, assignments, static constants, member paths, in visiting order.

Parsing is the only Python stage. Each file is tokenised once and every analysis is derived from its
events by Catalyst expressions.

``files`` have path and content; with a column ``piece`` (a number) a file is several rows, its content theirs in
order, each up to a line end. Then a file of any length is read, and only as much is kept as a statement needs.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loquat.sources.lexer import Source
from loquat.sources.syntax import Node, nodes

ARGUMENT = "struct<label:string,kind:string,text:string,interpolated:boolean,line:int,col:int>"
EVENTS = f"path string, pos int, kind string, callee_kind string, callee string, dotted string, arguments array<{ARGUMENT}>, line int, col int, type_name string, property_name string, function_name string, members array<string>"
ACCESSORS = "path string, namespace string, func_name string, escaped_value string, escaped_comment string"
_QUIET = {"nil", "bool", "number", "closure", "array", "dictionary", "key_path", "string"}


def events(files: DataFrame) -> DataFrame:
    """A row an event; ``pos`` orders the events of a file."""
    return _by_file(files).mapInArrow(_rows(_read_events, _event_schema()), EVENTS)


def accessors(files: DataFrame, root: str) -> DataFrame:
    """Parameterless ``String`` functions of generated code: in an enum, in an extension of ``root``."""
    return _by_file(files).mapInArrow(_rows(lambda pieces: _read_accessors(pieces, root), _accessor_schema()), ACCESSORS)


def _by_file(files: DataFrame) -> DataFrame:
    """path, content, and whether a row begins a file, the rows of a file behind one another."""
    if "piece" not in files.columns:
        return files.select("path", "content", F.lit(True).alias("first"))
    # By range: few large files do not meet in a partition while others have none.
    dealt = files.repartitionByRange(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path").sortWithinPartitions("path", "piece")
    return dealt.select("path", "content", F.lit(False).alias("first"))


def ignored_lines(files: DataFrame, marker: str) -> DataFrame:
    """(path, line) of every line that holds the marker: no parsing, no Python."""
    if "piece" not in files.columns:
        lines = files.select("path", F.posexplode(F.split("content", "\n")).alias("i", "text"))
        return lines.where(F.col("text").contains(marker)).select("path", (F.col("i") + 1).alias("line"))
    # What goes before a piece is a number a piece.
    sizes = files.select("path", "piece", (F.length("content") - F.length(F.replace("content", F.lit("\n")))).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("path", "piece", F.coalesce(before, F.lit(0)).cast("int").alias("_before"))
    found = files.where(F.contains("content", F.lit(marker))).select("path", "piece", F.posexplode(F.split("content", "\n")).alias("i", "text"))
    found = found.where(F.col("text").contains(marker)).select("path", "piece", "i")
    return found.join(starts, ["path", "piece"]).select("path", (F.col("i") + F.col("_before") + 1).alias("line"))


def _event_schema() -> pa.Schema:
    argument = pa.struct([("label", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("interpolated", pa.bool_()), ("line", pa.int32()), ("col", pa.int32())])
    text, number = pa.string(), pa.int32()
    return pa.schema([("path", text), ("pos", number), ("kind", text), ("callee_kind", text), ("callee", text), ("dotted", text), ("arguments", pa.list_(argument)), ("line", number), ("col", number), ("type_name", text), ("property_name", text), ("function_name", text), ("members", pa.list_(text))])


def _accessor_schema() -> pa.Schema:
    return pa.schema([(x.split()[0], pa.string()) for x in ACCESSORS.split(", ")])


def _rows(read, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, collects = [], gc.isenabled()
        gc.disable()  # trees have no cycles: looking for some takes a fifth of the time
        try:
            for path, pieces in _files(batches):
                for row in read(pieces):
                    row["path"] = path
                    out.append(row)
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
            yield pa.RecordBatch.from_pylist(out, schema)
        finally:
            if collects:
                gc.enable()

    return run


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Iterator[str]]]:
    """Each file with its pieces, one of which is a string at a time."""
    rows = ((batch, i) for batch in batches for i in range(batch.num_rows))
    number, last = -1, None

    def numbered():
        nonlocal number, last
        for batch, i in rows:
            path = batch.column("path")[i].as_py()
            number, last = number + (number < 0 or path != last or batch.column("first")[i].as_py()), path
            yield number, path, batch.column("content"), i

    for (_, path), found in groupby(numbered(), lambda x: x[:2]):
        yield path, (column[i].as_py() or "" for _, _, column, i in found)


def _file_events(text: str) -> list[dict]:
    return list(_read_events([text]))


def _inside(node: Node, scope: tuple) -> tuple | None:
    """The scope (type, property, function) in a node's body; static variables are told by all of their bindings, so they come whole."""
    return None if node.kind == "variable" and node.static else _scoped(node, scope)


def _scoped(node: Node, scope: tuple) -> tuple:
    if node.kind == "type" and node.name:
        return (node.name, *scope[1:])
    if node.kind == "function" and node.name:
        return (*scope[:2], node.name)
    if node.kind == "variable":
        return (scope[0], node.bindings[0][0] or scope[1], scope[2])
    return scope


def _read_events(pieces: Iterable[str]) -> Iterator[dict]:
    source, found, count = Source(pieces), [], 0

    def where(node: Node) -> dict:
        line, col = source.position(node.start)
        return {"line": line, "col": col}

    def argument(label: str | None, node: Node) -> dict:
        kind = node.kind if node.kind in _QUIET else "other"
        value = node.name if kind == "string" else source.between(node.start, node.end).strip()
        return {"label": label, "kind": kind, "text": value, "interpolated": node.interpolated, **where(node)}

    def emit(kind: str, node: Node, scope: tuple, members: tuple, **more) -> None:
        nonlocal count
        row = {"pos": count, "kind": kind, "callee_kind": None, "callee": None, "dotted": None, "arguments": [], **where(node)}
        row |= {"type_name": scope[0], "property_name": scope[1], "function_name": scope[2], "members": list(members)}
        row |= more
        found.append(row)
        count += 1

    def walk(node: Node, scope: tuple, members: tuple, parent: str) -> None:
        """``members``: names of the member accesses above, within the statement; ``parent``: what the node hangs on."""
        if node.kind == "call":
            callee = node.base
            kind = {"name": "direct", "member": "member"}.get(callee.kind, "other")
            emit("call", node, scope, members, callee_kind=kind, callee=callee.name if kind != "other" else None, dotted=dotted(callee), arguments=[argument(*x) for x in node.arguments])
            walk(callee, scope, members, "call")
            for _, value in node.arguments:
                walk(value, scope, members, "argument")
        elif node.kind == "member":
            if parent not in ("call", "member"):
                emit("path", node, scope, members, dotted=dotted(node))
            if node.base:
                walk(node.base, scope, (*members, node.name), "member")
        elif node.kind == "item":
            members = ()
        elif node.kind in ("type", "function", "variable"):
            for name, value in node.bindings if node.static else ():
                if value is not None and value.kind == "string":
                    emit("static", node, scope, members, callee=name, arguments=[argument(None, value)])
            scope = _scoped(node, scope)
        elif node.kind == "sequence":
            parts = node.children
            if len(parts) == 3 and parts[1].kind == "operator" and parts[1].name == "=" and parts[2].kind == "string" and parts[0].kind in ("name", "member"):
                emit("assignment", node, scope, members, callee=parts[0].name, arguments=[argument(None, parts[2])])
        for child in node.children:
            walk(child, scope, members, node.kind if node.kind != "call" else "closure")

    for node, scope in nodes(source, (None, None, None), _inside):
        walk(node, scope, (), "block")
        yield from found
        found.clear()


def dotted(node: Node) -> str:
    """Member chain as text; what hangs on a call, or on nothing, counts as empty."""
    if node.kind == "name":
        return node.name
    if node.kind == "member" and node.base is not None:
        below = dotted(node.base)
        return f"{below}.{node.name}" if below else node.name
    return ""


def _accessors(text: str, root: str) -> list[dict]:
    return list(_read_accessors([text], root))


def _read_accessors(pieces: Iterable[str], root: str) -> Iterator[dict]:
    found: list[dict] = []

    def scoped(node: Node, scope: tuple) -> tuple:
        """What is extended, and the enum around, with what is extended there."""
        if node.kind == "type" and node.returns == "extension":
            return node.name, scope[1]
        if node.kind == "type" and node.returns == "enum":
            return scope[0], (node.name, scope[0])
        return scope

    def walk(node: Node, scope: tuple) -> None:
        scope = scoped(node, scope)
        enum = scope[1]
        if node.kind == "function" and enum and enum[1] == root and not node.parameters and node.returns == "String" and node.children:
            body = node.children[-1]
            first = body.children[0].children if body.kind == "block" and body.children else []
            if first and first[0].kind == "call" and first[0].base.kind == "name" and first[0].base.name == "String":
                literal = {label: value.name.replace("{…}", "") if value.interpolated else value.name for label, value in reversed(first[0].arguments) if value.kind == "string"}
                if "localized" in literal:
                    found.append({"namespace": enum[0], "func_name": node.name.strip("`"), "escaped_value": literal["localized"], "escaped_comment": literal.get("comment", "")})
        for child in node.children:
            walk(child, scope)

    # Functions are what is looked for, so they come whole.
    for node, scope in nodes(Source(pieces), (None, None), lambda node, scope: None if node.kind == "function" else scoped(node, scope)):
        walk(node, scope)
        yield from found
        found.clear()
