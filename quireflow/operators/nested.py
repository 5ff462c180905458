"""Nested JSON records as flat tables with parent-child links, by Dewey labels.

Each node of a document gets the path of its ordinals (the first child of the third top element: [3, 1]). A parent is
found by cutting off the last ordinal; nodes are grouped into tables by the names on their path. One text is walked
within one task (it is one value, so it is there as a whole anyway); walks use a stack of their own, so depth is no limit.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", re.ASCII)
_WORDS = {"true": True, "false": False, "null": None}


#: Whole numbers of more digits than this stay as they are written.
LONG_NUMBER = 4000


def _no_constant(name: str):
    raise ValueError(name)


def _whole(digits: str):
    return int(digits) if len(digits) <= LONG_NUMBER else digits


def _parse_deep(text: str):
    """A JSON text nested deeper than the recursive parser can go, read with a stack. ValueError if it isn't complete JSON."""
    scan = json.decoder.scanstring
    n, i = len(text), 0
    stack: list = []  # open containers
    names: list = []  # the name that waits for a value, per open object
    done = object()
    root = value = done

    def skip(k: int) -> int:
        return _SPACE.match(text, k).end()

    def name_at(k: int) -> int:
        if k >= n or text[k] != '"':
            raise ValueError("name expected")
        name, k = scan(text, k + 1, True)
        k = skip(k)
        if k >= n or text[k] != ":":
            raise ValueError("colon expected")
        names[-1] = name
        return k + 1

    while True:
        i = skip(i)
        if i >= n:
            raise ValueError("text ends early")
        c = text[i]
        if c == "{" or c == "[":
            box: dict | list = {} if c == "{" else []
            i = skip(i + 1)
            closed = i < n and text[i] == ("}" if c == "{" else "]")
            if not closed:
                stack.append(box)
                names.append(None)
                if c == "{":
                    i = name_at(i)
                continue
            i, value = i + 1, box
        elif c == '"':
            value, i = scan(text, i + 1, True)
        elif m := _NUMBER.match(text, i):
            value, i = (float(m[0]) if re.search("[.eE]", m[0]) else _whole(m[0])), m.end()
        else:
            word = next((w for w in _WORDS if text.startswith(w, i)), None)
            if word is None:
                raise ValueError("value expected")
            value, i = _WORDS[word], i + len(word)
        while True:  # put the value where it belongs, close what ends here
            if not stack:
                root = value
                break
            box = stack[-1]
            if isinstance(box, dict):
                box[names[-1]] = value
            else:
                box.append(value)
            i = skip(i)
            end = "}" if isinstance(box, dict) else "]"
            if i < n and text[i] == end:
                value, i = stack.pop(), i + 1
                names.pop()
                continue
            if i >= n or text[i] != ",":
                raise ValueError("comma expected")
            i = skip(i + 1)
            if isinstance(box, dict):
                i = name_at(i)
            break
        if not stack and root is not done:
            if skip(i) != n:
                raise ValueError("text goes on")
            return root


def parse_json(text: str | None):
    """(True, value) of a complete JSON text, else (False, None); null and blank texts and NaN or Infinity aren't JSON."""
    if text is None or not text.strip():
        return False, None
    try:
        return True, json.loads(text, parse_constant=_no_constant, parse_int=_whole)
    except RecursionError:
        pass
    except ValueError:
        return False, None
    try:
        return True, _parse_deep(text)
    except ValueError:
        return False, None


def _ordered(value, depth: int = 0) -> list:
    """The elements of any written form of a list of children: an array, an object of numbered elements, a JSON text of either, one element alone, or nothing."""
    if isinstance(value, str):
        ok, inner = parse_json(value)
        return _ordered(inner) if ok and not isinstance(inner, str) else []
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        if "title" not in value and all(k.isdigit() for k in value):
            return list(value.values())
        return [value]
    return []


def bookmark_nodes(body: str | None, wrapper: str = "bookmarks", children: str = "children", label: str = "title") -> list[tuple]:
    """(path, title, page, is_open, names) of every bookmark of an outline, in written order, each before its children.

    A bookmark is an object with a title, at the top or below `children`. An object without one that stands between is
    passed through: its children belong to the bookmark above. Bodies that aren't complete JSON have no nodes.
    """
    ok, value = parse_json(body)
    if not ok:
        return []
    if isinstance(value, dict) and label not in value and wrapper in value:
        value = value[wrapper]
    if isinstance(value, str):
        return []
    out: list[tuple] = []
    counts: dict[tuple, int] = {}
    stack = [(x, ()) for x in reversed(_ordered(value))]
    while stack:
        node, above = stack.pop()
        if isinstance(node, list):
            stack.extend((x, above) for x in reversed(node))
            continue
        if not isinstance(node, dict):
            continue
        path = above
        if label in node:
            counts[above] = counts.get(above, 0) + 1
            path = (*above, counts[above])
            out.append((path, node))
        if children in node:
            stack.extend((x, path) for x in reversed(_ordered(node[children])))
    return out


def _page(value) -> int | None:
    if isinstance(value, bool) or value is None:
        return None
    if isinstance(value, str):
        value = int(value) if re.fullmatch(r"\s*-?\d{1,9}\s*", value) else None
    if isinstance(value, float):
        value = int(value) if value == value and value == int(value) else None
    return value if value is not None and -(2**31) <= value < 2**31 else None


_NODES = "{key} bigint, node int, parent int, path array<int>, title string, page int, is_open boolean"


def flatten_outlines(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, node, parent, path, title, page, is_open: one row per bookmark of each body; parent is 0 at the top.

    Node numbers follow the order of the labels. A parent's label is the node's without its last ordinal, so the link
    is a lookup among the labels of the same text. Repeated keys count once; null keys and bodies give no rows.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: list[tuple] = []
            for k, text in zip(pdf[key], pdf[body], strict=True):
                number: dict[tuple, int] = {(): 0}
                for path, node in bookmark_nodes(text):
                    number[path] = len(number)
                    title = node["title"]
                    title = title if title is None or isinstance(title, str) else json.dumps(title, ensure_ascii=False)
                    is_open = node.get("open")
                    rows.append((k, number[path], number[path[:-1]], list(path), title, _page(node.get("page")), is_open if isinstance(is_open, bool) else None))
                if len(rows) > 20_000:
                    yield _frame(rows)
                    rows = []
            if rows:
                yield _frame(rows)

    def _frame(rows: list[tuple]) -> pd.DataFrame:
        f = pd.DataFrame(rows, columns=[key, "node", "parent", "path", "title", "page", "is_open"])
        f["page"] = f["page"].astype("Int32")
        f["is_open"] = f["is_open"].astype("boolean")
        return f

    once = df.where(F.col(key).isNotNull() & F.col(body).isNotNull()).select(key, body).dropDuplicates([key])
    return once.mapInPandas(walk, _NODES.format(key=key))


def flatten_json(df: DataFrame, key: str, body: str) -> DataFrame:
    """key, schema_path, path, parent_path, name, value: every node of any JSON text.

    schema_path has the names down to the node with [] for elements, so that it names the table a row belongs to; path
    is the Dewey label, parent_path the same without its last ordinal (null at the root). value is the text of a leaf.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [key, "schema_path", "path", "parent_path", "name", "value"]
        for pdf in batches:
            rows: list[tuple] = []
            for k, text in zip(pdf[key], pdf[body], strict=True):
                ok, root = parse_json(text)
                stack = [(root, "$", (), None)] if ok else []
                while stack:
                    x, schema, path, name = stack.pop()
                    leaf = None if isinstance(x, (dict, list)) or x is None else x if isinstance(x, str) else json.dumps(x)
                    rows.append((k, schema, list(path), list(path[:-1]) if path else None, name, leaf))
                    below = [(y, f"{schema}.{n}", n) for n, y in x.items()] if isinstance(x, dict) else [(y, f"{schema}[]", None) for y in x] if isinstance(x, list) else []
                    stack.extend((y, s, (*path, i), n) for i, (y, s, n) in reversed(list(enumerate(below, 1))))
                    if len(rows) > 20_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    once = df.where(F.col(key).isNotNull() & F.col(body).isNotNull()).select(key, body).dropDuplicates([key])
    return once.mapInPandas(walk, f"{key} bigint, schema_path string, path array<int>, parent_path array<int>, name string, value string")


def table_rows(text: str | None) -> Iterator[tuple[str, tuple[int, ...], dict[str, str | None]]]:
    """(schema path, label, fields) of each row that a JSON text flattens into, in written order.

    Objects, and other elements of arrays, are rows; names on the way and [] for elements make the schema path. fields
    holds the object's own values that are no containers (of an element that is no object, its value under "value"). A label is
    the label of the row above and the ordinal among that row's rows, so cutting off its last ordinal gives the parent.
    """
    ok, root = parse_json(text)
    if not ok:
        return
    show = lambda x: None if x is None else x if isinstance(x, str) else json.dumps(x)
    counts: dict[tuple, int] = {}
    # rows to come: value, schema path, label above; a list is walked in place of its elements
    stack: list[tuple] = [(root, "$", None)]
    while stack:
        x, schema, above = stack.pop()
        if isinstance(x, list):
            stack.extend((y, f"{schema}[]", above) for y in reversed(x))
            continue
        if above is None and "[]" not in schema:
            label: tuple = ()
        else:
            at = above or ()
            counts[at] = counts.get(at, 0) + 1
            label = (*at, counts[at])
        if not isinstance(x, dict):
            yield schema, label, {"value": show(x)}
            continue
        yield schema, label, {k: show(v) for k, v in x.items() if not isinstance(v, (dict, list))}
        stack.extend((v, f"{schema}.{k}", label) for k, v in reversed(x.items()) if isinstance(v, (dict, list)))


def flatten_tables(df: DataFrame, key: str, body: str) -> DataFrame:
    """table_name, key, label, parent_label, fields: the rows of all flat tables that JSON texts turn into; see table_rows.

    A table is the rows of one table_name; parent_label is label without its last ordinal (null at the top), and names the
    row above in the same text. Repeated keys count once; null keys and texts that aren't complete JSON give no rows.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["table_name", key, "label", "fields"]
        for pdf in batches:
            rows: list[tuple] = []
            for k, text in zip(pdf[key], pdf[body], strict=True):
                for schema, label, fields in table_rows(text):
                    rows.append((schema, k, list(label), list(fields.items())))
                    if len(rows) > 20_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    once = df.where(F.col(key).isNotNull() & F.col(body).isNotNull()).select(key, body).dropDuplicates([key])
    flat = once.mapInPandas(walk, f"table_name string, {key} bigint, label array<int>, fields array<struct<name string, value string>>")
    parent = F.when(F.size("label") > 0, F.slice("label", F.lit(1), F.size("label") - 1))
    return flat.select("table_name", key, "label", parent.alias("parent_label"), F.map_from_entries("fields").alias("fields"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import table

    return flatten_outlines(table(spark, sf_dir, "outlines"), "outline_id", "body").select("outline_id", "node", "parent")


def p4_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the flat tables that the bodies turn into, with their parent links."""
    from ..sources.tables import table

    rows = flatten_tables(table(spark, sf_dir, "outlines"), "outline_id", "body")
    dotted = lambda c: F.array_join(F.col(c).cast("array<string>"), ".")
    return rows.select("table_name", "outline_id", dotted("label").alias("label"), dotted("parent_label").alias("parent_label"), "fields")
