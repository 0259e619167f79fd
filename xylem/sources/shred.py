"""From XML texts to node rows.

Each document is parsed by itself, in one linear pass, on the executor that holds it. A node is a row in pre-order
interval encoding: the subtree of a node is pre..end_pre of its document, so that every axis is a join condition.

The parser resolves entities (IO06, IO09) and skips prologs (IO08). Rows carry namespaces in scope (IO03), runs of mixed
text, CDATA and comments (IO04), and places among siblings (IO05). Scalars are typed by one rule (IO02, IO10).
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain
from xml.etree.ElementTree import Element, TreeBuilder
from xml.parsers import expat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import typed_boolean, typed_number
from .store import growing

RAW_SCHEMA = (
    "doc_id string, pre bigint, end_pre bigint, parent_pre bigint, depth int, ord int, ord_same_name int, n_siblings int, n_children int,"
    " name string, prefix string, local_name string, ns_uri string, text string, raw_text string, text_only boolean,"
    " attrs map<string,string>, xmlns map<string,string>, ns_scope map<string,string>, lang string, path string,"
    " anc_pres array<bigint>, text_nodes array<string>, comments array<string>, _error string"
)
ARROW = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string()),
    "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string()),
}
TYPES = {c.split()[0]: ARROW[c.split()[1]] for c in RAW_SCHEMA.split(", ")}
COLUMNS = list(TYPES)
PROLOG = re.compile(r"\A\s*(?:<\?xml[^>]*\?>)?")
ROOT = re.compile(r"<[^?!]")  # of a document without a prolog
MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")
FRAME = "doc_id pre end_pre parent_pre depth ord n_siblings n_children name prefix local_name".split()  # what axes and names need
WRITTEN = "doc_id pre end_pre parent_pre n_children name".split()  # less: what nodes are written by, beside text and attrs
NAMED = "doc_id pre parent_pre name local_name".split()  # less: what nodes are found by from the roots
SCOPES, TEXTS = {"xmlns", "ns_scope", "ns_uri", "lang"}, {"text", "raw_text", "text_only", "text_nodes"}
NONE: list = []  # of what a node has none of; shared and never changed


def _maps(pairs: list[list[tuple[str, str]]]) -> pa.Array:
    """A map for each list of keys and values."""
    offsets = np.zeros(len(pairs) + 1, "int32")
    np.cumsum(np.fromiter(map(len, pairs), "int32", len(pairs)), out=offsets[1:])
    keys, values = zip(*chain.from_iterable(pairs), strict=True) if offsets[-1] else ((), ())
    return pa.MapArray.from_arrays(pa.array(offsets), pa.array(keys, pa.string()), pa.array(values, pa.string()))


class _Marked:
    """Texts and comments of one document that has comments, CDATA or declarations, from parser events; its tree goes to a builder of trees."""

    def __init__(self, trim: bool, tree: TreeBuilder):
        self.trim, self.tree, self.size, self.cdata = trim, tree, 0, False
        self.run: list[str] = []
        self.open: list[list] = []  # node, runs of text, CDATA section, whether nothing but text was met
        self.told: dict[int, tuple] = {}  # by node: text, raw_text, text_only
        self.texts: dict[int, list[str]] = {}
        self.notes: dict[int, list[str]] = {}

    def _flush(self) -> None:
        text = "".join(self.run)
        self.run.clear()
        if self.open and text:
            top = self.open[-1]
            top[1].append(text)
            if stripped := text.strip():
                self.texts.setdefault(top[0], []).append(stripped if self.trim and not self.cdata else text)
                if self.cdata and top[2] is None:
                    top[2] = text

    def start(self, name: str, attrs: dict[str, str]) -> None:
        self._flush()
        if self.open:
            self.open[-1][3] = False
        self.open.append([self.size, [], None, True])
        self.size += 1
        self.tree.start(name, attrs)

    def end(self, name: str) -> None:
        self.tree.end(name)
        row, raw, _, plain = self.open[-1]
        if plain and not raw and not self.cdata:  # nothing but one run of text
            raw = [*self.run]
            self.run.clear()
        else:
            self._flush()
        cdata, whole = self.open.pop()[2], "".join(raw)
        if cdata is not None:
            self.told[row] = cdata, cdata, False
        elif plain:
            self.texts.pop(row, None)
            self.told[row] = (whole.strip() if self.trim else whole) if whole else None, whole or None, True
        else:
            self.told[row] = "".join(self.texts.get(row, NONE)) or None, whole or None, False

    def comment(self, text: str) -> None:
        self._flush()
        if self.open:
            self.notes.setdefault(self.open[-1][0], []).append(text.strip() if self.trim else text)
            self.open[-1][3] = False

    def start_cdata(self) -> None:
        self._flush()
        self.cdata = True

    def end_cdata(self) -> None:
        self._flush()
        self.cdata = False


def _places(groups: np.ndarray) -> np.ndarray:
    """The place of each among those of its group."""
    order = np.argsort(groups, kind="stable")
    first, at = np.ones(len(groups), bool), np.arange(len(groups))
    first[1:] = np.diff(groups[order]) != 0
    out = np.empty(len(groups), "int64")
    out[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return out


class _Frame:
    """Places of the nodes of many documents in pre-order, from their numbers of children alone."""

    def __init__(self, kids: np.ndarray):
        n = self.n = len(kids)
        self.kids, at = kids, np.arange(n)
        due = np.cumsum(kids - 1)  # nodes still due after each node; a subtree ends where one less is due than before it
        due -= due.min(initial=0)
        self.end = self._next(due, due - kids, at)
        self.depth = at - np.concatenate(([0], np.cumsum(np.bincount(self.end, minlength=n))))[:n]
        self.parent = np.full(n, -1)
        below = np.flatnonzero(self.depth)
        self.parent[below] = self._next(self.depth, self.depth[below] - 1, below, -1)

    def _next(self, of: np.ndarray, wanted: np.ndarray, at: np.ndarray, step: int = 0) -> np.ndarray:
        """For each place the first one from there on that has the wanted value; by step -1 the last one before."""
        order = np.argsort(of, kind="stable")
        found = np.searchsorted(of[order] * self.n + order, wanted * self.n + at) + step
        return order[found]

    def siblings(self, kinds: np.ndarray | None = None) -> np.ndarray:
        """The place of each node among its siblings, or among those of its kind."""
        places = _places(self.parent if kinds is None else self.parent * (kinds.max(initial=0) + 1) + kinds)
        return np.where(self.depth == 0, 0, places)

    def ancestors(self, base: np.ndarray) -> pa.Array:
        """Ancestors of each node, nearest first, as numbers within their documents."""
        offsets = np.concatenate(([0], np.cumsum(self.depth)))
        out, rows, up, level = np.empty(offsets[-1], "int64"), np.flatnonzero(self.depth), self.parent[self.depth > 0], 0
        while len(rows):
            out[offsets[rows] + level] = up - base[rows]
            up, level = self.parent[up], level + 1
            rows, up = rows[up >= 0], up[up >= 0]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(out))

    def paths(self, kinds: np.ndarray, names: list[str]) -> pa.Array:
        """Names from the root on; each different path is made once."""
        path, texts = np.empty(self.n, "int64"), []
        order = np.argsort(self.depth, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1):
            up = path[self.parent[rows]] if texts else np.zeros(len(rows), "int64")
            found, which = np.unique(up * len(names) + kinds[rows], return_inverse=True)
            above = [f"{texts[k // len(names)]}/" for k in found] if texts else [""] * len(found)
            path[rows] = len(texts) + which
            texts += [a + names[k % len(names)] for a, k in zip(above, found, strict=True)]
        return pa.array(texts, pa.string()).take(pa.array(path))


class _Builder:
    """Collects the trees of documents, and hands over their nodes as Arrow columns.

    The parser makes trees without a Python call a node. What few nodes have is kept by row (`texts`, `notes`, `owns`,
    `scopes`, `uris`, `langs`); places and paths are worked out for a batch, from the numbers of children.
    """

    def __init__(self, trim: bool, wanted: list[str] = COLUMNS):
        self.trim, self.wanted = trim, {c: TYPES[c] for c in wanted}
        self.with_scopes, self.with_texts = bool(self.wanted.keys() & SCOPES), bool(self.wanted.keys() & TEXTS)
        self.clear()

    def clear(self) -> None:
        self.documents: list[tuple[str | None, int]] = []  # id and number of nodes
        self.errors: list[tuple[str | None, str]] = []
        self.nodes: list[Element] = []
        self.told: dict[int, tuple] = {}
        self.texts, self.notes, self.owns, self.scopes, self.uris, self.langs = {}, {}, {}, {}, {}, {}

    def _scope(self, base: int) -> None:
        """Notes the namespaces and the languages of the nodes from a row on, those of one document that has any."""
        up: list[list] = []  # number of children to come, scope and language of open elements
        for row, node in enumerate(self.nodes[base:], base):
            scope, lang = up[-1][1:] if up else ({}, None)
            own = []
            for k, v in node.items():
                if k == "xmlns" or k.startswith("xmlns:"):
                    own.append((k[6:], v))
                elif k == "xml:lang":
                    lang = v or lang
            if own:
                self.owns[row] = own
                scope = scope | dict(own)
            if scope:
                self.scopes[row] = [kv for kv in scope.items() if kv[1]]
                self.uris[row] = scope.get(node.tag.rpartition(":")[0]) or None
            if lang is not None:
                self.langs[row] = lang
            if up:
                up[-1][0] -= 1
            up.append([len(node), scope, lang])
            while up and not up[-1][0]:
                up.pop()

    def read(self, doc_id: str | None, xml: str | None) -> None:
        """Adds the nodes of one document. Raises ValueError, adding none, for what is empty or malformed."""
        if xml is None or not xml.strip():
            raise ValueError("Empty XML string")
        base, tree, marked = len(self.nodes), TreeBuilder(), None
        p = expat.ParserCreate(encoding="UTF-8")
        p.buffer_text = True
        if "<!" in xml:
            marked = _Marked(self.trim, tree)
            p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = marked.start, marked.end, marked.run.append
            p.CommentHandler, p.StartCdataSectionHandler, p.EndCdataSectionHandler = marked.comment, marked.start_cdata, marked.end_cdata
        else:
            p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = tree.start, tree.end, tree.data
        try:
            p.Parse((xml if ROOT.match(xml) else PROLOG.sub("", xml)).encode(), True)
        except expat.ExpatError as e:
            raise ValueError(str(e)) from e
        self.nodes += tree.close().iter()
        self.documents.append((doc_id, len(self.nodes) - base))
        if marked:
            for mine, found in ((self.told, marked.told), (self.texts, marked.texts), (self.notes, marked.notes)):
                mine.update((base + row, x) for row, x in found.items())
        if self.with_scopes and ("xmlns" in xml or "xml:lang" in xml):
            self._scope(base)

    def error(self, doc_id: str | None, message: str) -> None:
        self.errors.append((doc_id, message))

    def _texts(self, kids: np.ndarray) -> tuple[list, list, list]:
        """text, raw_text and text_only of all nodes; `texts` gets the runs of those that have children."""
        raw = [e.text for e in self.nodes]
        text = [x and x.strip() for x in raw] if self.trim else [*raw]
        only = (kids == 0).tolist()
        apart = any([e.tail for e in self.nodes])
        for row in np.flatnonzero(kids).tolist():
            if row not in self.told and (apart or raw[row]):
                runs = [x for x in (raw[row], *[c.tail for c in self.nodes[row]]) if x]
                text[row], raw[row] = None, "".join(runs) or None
                if runs := [x.strip() if self.trim else x for x in runs if x.strip()]:
                    text[row], self.texts[row] = "".join(runs), runs
        for row, (of_text, of_raw, of_only) in self.told.items():
            text[row], raw[row], only[row] = of_text, of_raw, of_only
        return text, raw, only

    def batch(self, max_depth: int | None) -> pa.RecordBatch:
        """What is held, as Arrow columns; nothing is held after."""
        n = len(self.nodes)
        kids = np.fromiter(map(len, self.nodes), "int64", n)
        frame = _Frame(kids)
        up, root = frame.parent, frame.depth == 0
        sizes = np.fromiter((k for _, k in self.documents), "int64", len(self.documents))
        base = np.repeat(np.cumsum(sizes) - sizes, sizes)
        text, raw, only = self._texts(kids) if self.with_texts else ([], [], [])
        names = pa.array([e.tag for e in self.nodes], pa.string()).dictionary_encode()
        kinds, plain = names.indices.to_numpy().astype("int64"), names.dictionary.to_pylist()
        parts = [x.rpartition(":") for x in plain]
        of = lambda values: pa.array(values, pa.string()).take(names.indices)
        zeros = pa.array(np.zeros(n + 1, "int32"))
        strings = lambda held: pa.array([held.get(r) for r in range(n)], pa.string()) if held else pa.nulls(n, pa.string())
        lists = lambda held: pa.array([held.get(r, NONE) for r in range(n)], pa.list_(pa.string())) if held else pa.ListArray.from_arrays(zeros, pa.nulls(0, pa.string()))
        maps = lambda held: _maps([held.get(r, NONE) for r in range(n)]) if held else pa.MapArray.from_arrays(zeros, pa.nulls(0, pa.string()), pa.nulls(0, pa.string()))
        columns = {  # by name, each made where it is wanted
            "doc_id": lambda: pa.array([i for i, _ in self.documents], pa.string()).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), "pre": lambda: np.arange(n) - base, "end_pre": lambda: frame.end - base,
            "parent_pre": lambda: pa.array(up - base, pa.int64(), mask=root), "depth": lambda: frame.depth, "ord": frame.siblings, "ord_same_name": lambda: frame.siblings(kinds),
            "n_siblings": lambda: np.where(root, 1, kids[up]) if n else [], "n_children": lambda: kids,
            "name": lambda: names.cast(pa.string()), "prefix": lambda: of([p or None for p, _, _ in parts]), "local_name": lambda: of([x for _, _, x in parts]), "ns_uri": lambda: strings(self.uris),
            "text": lambda: text, "raw_text": lambda: raw, "text_only": lambda: only, "attrs": lambda: _maps([e.items() for e in self.nodes]), "xmlns": lambda: maps(self.owns), "ns_scope": lambda: maps(self.scopes),
            "lang": lambda: strings(self.langs), "path": lambda: frame.paths(kinds, plain), "anc_pres": lambda: frame.ancestors(base),
            "text_nodes": lambda: lists(self.texts), "comments": lambda: lists(self.notes), "_error": lambda: pa.nulls(n, pa.string())}
        made = {c: columns[c]() for c in self.wanted}
        out = pa.RecordBatch.from_arrays([made[c] if isinstance(made[c], pa.Array) else pa.array(made[c], t) for c, t in self.wanted.items()], names=list(made))
        if self.errors:
            known = dict(zip(("doc_id", "_error"), zip(*self.errors, strict=True), strict=True))
            bad = pa.RecordBatch.from_arrays([pa.array(known.get(c, [None] * len(self.errors)), t) for c, t in self.wanted.items()], names=list(made))
            out = pa.Table.from_batches([out.cast(bad.schema), bad]).combine_chunks().to_batches()[0]
        self.clear()
        return out if max_depth is None else out.filter(pc.fill_null(pc.less_equal(out.column("depth"), max_depth), True))


def parse(doc_id: str, xml: str | None, trim: bool = True, max_depth: int | None = None) -> list[dict]:
    """Node rows of one document. Raises ValueError for what is empty or malformed."""
    b = _Builder(trim)
    b.read(doc_id, xml)
    return b.batch(max_depth).to_pylist()


def shred(docs: DataFrame, doc_id: str = "doc_id", xml: str = "xml", *, trim: bool = True, numbers: bool = True, booleans: bool = True, max_depth: int | None = None, mode: str = "FAILFAST", keep: Callable[[DataFrame], DataFrame] = lambda parsed: parsed, columns: Iterable[str] | None = None, frame: Iterable[str] = FRAME) -> DataFrame:
    """IO01: the node table of a table of XML texts.

    mode: FAILFAST raises on a malformed document; DROPMALFORMED leaves it out; PERMISSIVE gives one row of nulls
    with `_error` for it. keep: what is done with the parsed nodes before their texts are typed, such as persisting.
    columns: those that the parser hands over beside the frame; by default all. With `text` come its number and truth.
    frame: what is always handed over; by default all that axes and names need (FRAME); WRITTEN or NAMED where no more is asked of the nodes.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")

    asked = None if columns is None else {*columns} | ({"text_only"} if "text" in columns else set())
    if unknown := {*(asked or ()), *frame} - TYPES.keys():
        raise ValueError(f"no such columns: {', '.join(sorted(unknown))}")
    wanted = [c for c in COLUMNS if asked is None or c in frame or c in asked or c == "_error" and mode == "PERMISSIVE"]
    layout = ", ".join(c for c in RAW_SCHEMA.split(", ") if c.split()[0] in wanted)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = _Builder(trim, wanted)
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    b.read(i, text)
                except ValueError as e:
                    if mode == "FAILFAST":
                        raise ValueError(f"document {i}: {e}") from e
                    if mode == "PERMISSIVE":
                        b.error(i, str(e))
                if len(b.nodes) + len(b.errors) > 10_000:
                    yield b.batch(max_depth)
        yield b.batch(max_depth)

    source = docs.select(F.col(doc_id).cast("string").alias("_id"), F.col(xml).alias("_xml"))
    parsed = keep(source.mapInArrow(rows, layout))
    return typed(parsed, numbers, booleans) if "text" in wanted else growing(parsed)


def typed(nodes: DataFrame, numbers: bool = True, booleans: bool = True) -> DataFrame:
    """Parsed nodes with the numbers and truths of their texts, worked out where they are used."""
    num = F.when(F.col("text_only"), typed_number(F.col("text"))) if numbers else F.lit(None).cast("double")
    truth = F.when(F.col("text_only"), typed_boolean(F.col("text"))) if booleans else F.lit(None).cast("boolean")
    return growing(nodes.withColumn("num", num).withColumn("bool", truth))


def read_xml(spark: SparkSession, path: str, **options) -> DataFrame:
    """The node table of whole files; doc_id is the file's path."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("xml"))
    return shred(files, **options)


def read_records(spark: SparkSession, path: str, row_tag: str, schema=None, **options) -> DataFrame:
    """IO07: records of one tag as typed rows, by Spark's own XML source; attributes are prefixed by @_."""
    reader = spark.read.format("xml").option("rowTag", row_tag).option("attributePrefix", "@_").option("valueTag", "#text")
    for k, v in options.items():
        reader = reader.option(k, v)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def write_records(df: DataFrame, path: str, row_tag: str, root_tag: str = "rows", declaration: str | None = None, records_per_file: int = 0) -> None:
    """IO11, IO19: typed rows as XML files; records_per_file bounds them (0: one for each task)."""
    writer = df.write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).option("attributePrefix", "@_").option("valueTag", "#text").option("maxRecordsPerFile", records_per_file)
    (writer.option("declaration", declaration) if declaration is not None else writer).save(path)
