"""Nested JSON records to related flat tables, by a vectorised structural index.

A batch of texts is one byte array. Quote, bracket and delimiter bitmaps are computed over it at once,
nesting depth is a prefix sum, every token finds its container by one sort over (record, depth, position),
and the JSON grammar is checked by each token's rank among its siblings. No text is parsed recursively, and what tokens
say is cut out of the byte array and judged as columns.

What is a row of which table is a parameter (``Shape``): objects that hold one of its marks are the first level, the arrays of
objects under its keys the levels below. Nothing else is lost: ``nodes_table`` has every value of a record with its parent,
``members_table`` the members of first-level objects that the shape does not name.

Defined results
  * null, empty and blank texts, and texts that are not one whole JSON value: ``readable`` is false, no children.
  * a text that is a JSON string which holds JSON is opened, to any depth; NaN and Infinity count as numbers.
  * a match is an object with ``cand_match``, ``umls_match`` or ``all_match_occ``; matches are numbered from 1
    in the order of their opening braces.
  * offsets are the integers (or strings of digits) directly in ``all_match_occ`` or in arrays below it, and those
    under the keys ``start`` and ``occ`` of objects below it; other members (``line``, ``n``) describe, they locate nothing.
  * offsets beyond the 32 bits of the table are counted in ``n_unfit`` of the record and keep their number, but give no row.
  * a record delivered again under the same key counts once: the latest delivery, then the greater text hash.
  * of a repeated member the first counts; extra columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Level:
    """Objects in the array under ``key`` of an object of the level above: their members as text, as numbers, and the levels below."""

    key: str
    texts: tuple[str, ...] = ()
    numbers: tuple[str, ...] = ()
    below: tuple[Level, ...] = ()


@dataclass(frozen=True)
class Shape:
    """First-level objects hold one of ``marks``; the integers under their member ``places`` are opened, through arrays and the members ``locating``."""

    marks: tuple[str, ...]
    texts: tuple[str, ...]
    numbers: tuple[str, ...]
    places: str
    locating: tuple[str, ...]
    below: tuple[Level, ...] = ()


#: The records of the matcher.
MATCHES = Shape(
    marks=("cand_match", "umls_match", "all_match_occ"),
    texts=("cand_match", "umls_match", "cui", "match_eng", "hebrew_key", "match_tui", "semantic_type", "curr_occurence_offset"),
    numbers=("sim",),
    places="all_match_occ",
    locating=("start", "occ"),
    below=(Level("alternatives", ("cui",), ("sim",), (Level("sources", ("stt", "rank")),)),),
)

_NUMBER = r"^(?:-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|true|false|null|NaN|-?Infinity)$"
_STRING_BODY = r'^"(?:[^\\]|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*"$'
_WHOLE = r"^\s*-?\d{1,18}\s*$"
_LBRACE, _RBRACE, _LBRACKET, _RBRACKET, _COLON, _COMMA, _STRING, _SCALAR = range(8)

_CLASS = np.full(256, _SCALAR, np.uint8)
for _c, _k in zip(b"{}[]:,", (_LBRACE, _RBRACE, _LBRACKET, _RBRACKET, _COLON, _COMMA), strict=True):
    _CLASS[_c] = _k
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\r\n")] = True


class Index:
    """Tokens of a batch of texts: ``rec, kind, start, end, level, parent`` (a token number, or -1), ``rank`` among siblings; ``ok`` per record."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        self.data, n = data, len(data)
        self.raw = data.tobytes()
        lengths = np.diff(bounds)
        records = len(lengths)
        rec_of = np.repeat(np.arange(records), lengths)
        at = np.arange(n)
        # quote bitmap without those behind an odd run of backslashes
        slash = data == 0x5C
        solid = np.maximum.accumulate(np.where(slash, -1, at)) if n else at
        run = np.zeros(n, np.int64)
        run[1:] = at[:-1] - solid[:-1]
        first = bounds[:-1][lengths > 0]
        run[first] = 0
        quote = (data == 0x22) & (run % 2 == 0)
        total = np.concatenate([[0], np.cumsum(quote)])
        inside = ((total[1:] - total[bounds[:-1]][rec_of]) & 1).astype(bool)  # the opening quote counts as inside
        ok = ((total[bounds[1:]] - total[bounds[:-1]]) & 1) == 0
        outside = ~inside & ~quote
        kind_at = _CLASS[data]
        structural = outside & (kind_at != _SCALAR)
        scalar = outside & (kind_at == _SCALAR) & ~_BLANK[data]
        before = np.zeros(n, bool)
        before[1:] = scalar[:-1]
        before[first] = False
        scalar_start = scalar & ~before
        opening = quote & inside
        starts = np.flatnonzero(structural | scalar_start | opening)
        kind = np.where(quote[starts], _STRING, kind_at[starts]).astype(np.int64)
        ends = starts + 1
        closing = np.flatnonzero(quote & ~inside)
        strings = np.flatnonzero(kind == _STRING)
        # an unclosed string shifts the pairing only within its own, already refused record
        follow = np.searchsorted(closing, starts[strings])
        ends[strings] = np.where(follow < len(closing), closing[np.minimum(follow, max(len(closing) - 1, 0))] + 1 if len(closing) else n, n)
        after = np.zeros(n + 1, bool)
        after[:n] = scalar
        stop = np.flatnonzero(~after)
        scalars = np.flatnonzero(kind == _SCALAR)
        ends[scalars] = stop[np.searchsorted(stop, starts[scalars])]
        rec = rec_of[starts]
        ends = np.minimum(ends, bounds[1:][rec])
        # depth as a prefix sum over brackets, within the record
        step = np.where((kind == _LBRACE) | (kind == _LBRACKET), 1, np.where((kind == _RBRACE) | (kind == _RBRACKET), -1, 0))
        depth = np.concatenate([[0], np.cumsum(step)])
        token_bounds = np.searchsorted(starts, bounds)
        base = depth[token_bounds[:-1]]
        ok &= depth[token_bounds[1:]] == base
        level = depth[:-1] - base[rec]  # depth before the token: a bracket's closer has the level of what it holds
        ok &= np.bincount(rec[depth[1:] < base[rec]], minlength=records) == 0
        # containers: openers are entered once more at the level below them, then filled forward
        openers = np.flatnonzero(step == 1)
        who = np.concatenate([np.arange(len(starts)), openers])
        mark = np.concatenate([np.zeros(len(starts), bool), np.ones(len(openers), bool)])
        deep = np.concatenate([level, level[openers] + 1])
        order = np.lexsort((who, deep, rec[who]))
        fill = np.where(mark[order], np.arange(len(order)), -1)
        group_start = np.ones(len(order), bool)
        if len(order):
            group_start[1:] = (rec[who][order][1:] != rec[who][order][:-1]) | (deep[order][1:] != deep[order][:-1])
        head = np.maximum.accumulate(np.where(group_start | mark[order], np.arange(len(order)), 0)) if len(order) else fill
        is_marker = mark[order]
        parent = np.full(len(starts), -1)
        rank = np.zeros(len(starts), np.int64)
        real = ~is_marker
        led = is_marker[head[real]] if len(order) else np.zeros(0, bool)
        tokens = who[order][real]
        parent[tokens] = np.where(led, who[order][head[real]], -1)
        rank[tokens] = np.flatnonzero(real) - head[real] - led
        # grammar, by rank among siblings
        held = np.where(parent >= 0, kind[parent], -1)
        value = (kind == _LBRACE) | (kind == _LBRACKET) | (kind >= _STRING)
        closer = step == -1
        want = np.zeros(len(starts), bool)
        obj, arr, top = held == _LBRACE, held == _LBRACKET, held == -1
        r4, r2 = rank % 4, rank % 2
        want |= obj & ~closer & (((r4 == 0) & (kind == _STRING)) | ((r4 == 1) & (kind == _COLON)) | ((r4 == 2) & value) | ((r4 == 3) & (kind == _COMMA)))
        want |= obj & (kind == _RBRACE) & ((rank == 0) | (r4 == 3))
        want |= arr & ~closer & (((r2 == 0) & value) | ((r2 == 1) & (kind == _COMMA)))
        want |= arr & (kind == _RBRACKET) & ((rank == 0) | (r2 == 1))
        want |= top & value & (rank == 0)
        ok &= np.bincount(rec[~want], minlength=records) == 0
        ok &= np.diff(token_bounds) > 0
        # strings: no bare control characters, escapes whole
        control = np.concatenate([[0], np.cumsum(inside & (data < 0x20))])
        ok &= control[bounds[1:]] == control[bounds[:-1]]
        slashes = np.concatenate([[0], np.cumsum(slash)])
        self.escaped = slashes[np.minimum(ends, n)] > slashes[starts]
        self.start, self.end, self.kind = starts, ends, kind
        for tokens, pattern in ((np.flatnonzero(self.escaped & (kind == _STRING) & ok[rec]), _STRING_BODY), (scalars[ok[rec[scalars]]], _NUMBER)):
            if len(tokens):
                said = self.cut(tokens, 0).dictionary_encode()
                right = pc.match_substring_regex(said.dictionary, pattern).to_numpy(zero_copy_only=False).astype(bool)
                ok[rec[tokens[~right[said.indices.to_numpy()]]]] = False
        self.rec, self.level, self.parent, self.rank, self.ok = rec, level, parent, rank, ok
        self.is_value = value
        self.is_key = obj & (kind == _STRING) & (r4 == 0)
        # the key of a value is the string two siblings before it
        self.key_of = np.full(len(starts), -1)
        if len(order):
            seat = np.empty(len(order), np.int64)
            seat[order] = np.arange(len(order))
            values = np.flatnonzero(obj & value & (r4 == 2))
            self.key_of[values] = who[order][seat[values] - 2]

    def cut(self, tokens: np.ndarray, quotes: int) -> pa.Array:
        """The bytes of tokens, less ``quotes`` at either end, as a column."""
        first, sizes = self.start[tokens] + quotes, self.end[tokens] - self.start[tokens] - 2 * quotes
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        take = np.arange(bounds[-1]) + np.repeat(first - bounds[:-1], sizes)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(tokens), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(self.data[take].tobytes())])

    def texts(self, tokens: np.ndarray) -> pa.Array:
        """What string and scalar tokens say: strings without quotes, escapes opened; bytes that are no text become the mark for it."""
        string = self.kind[tokens] == _STRING
        out = np.full(len(tokens), None, object)
        for which, quotes in ((string & ~self.escaped[tokens], 1), (~string, 0)):
            at = np.flatnonzero(which)
            if len(at):
                said = self.cut(tokens[at], quotes)
                try:
                    out[at] = said.cast(pa.large_string()).to_numpy(zero_copy_only=False)
                except pa.ArrowInvalid:
                    out[at] = [x.decode("utf-8", "replace") for x in said.to_pylist()]
        for i in np.flatnonzero(string & self.escaped[tokens]):
            out[i] = json.loads(self.raw[self.start[tokens[i]] : self.end[tokens[i]]]).encode("utf-8", "replace").decode("utf-8")
        return pa.array(out, pa.string())

    def closer_of(self) -> np.ndarray:
        """For each opening bracket the token that closes it."""
        out = np.full(len(self.start), -1)
        closers = np.flatnonzero(((self.kind == _RBRACE) | (self.kind == _RBRACKET)) & (self.parent >= 0))
        out[self.parent[closers]] = closers
        return out

    def same(self, tokens: np.ndarray, word: bytes) -> np.ndarray:
        """Which of these string tokens spell ``word``, compared length first."""
        hit = (self.end[tokens] - self.start[tokens]) == len(word) + 2
        near = tokens[hit]
        rows = self.data[self.start[near][:, None] + 1 + np.arange(len(word))] if len(near) else np.zeros((0, len(word)), np.uint8)
        hit[hit] = (rows == np.frombuffer(word, np.uint8)).all(axis=1)
        odd = np.flatnonzero(self.escaped[tokens] & ~hit)
        if len(odd):
            hit[odd] = [json.loads(self.raw[self.start[t] : self.end[t]]) == word.decode() for t in tokens[odd]]
        return hit


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _opened(column: pa.Array) -> pa.Array:
    """Texts that are a JSON string holding JSON, opened until they are not."""
    data, bounds = _bytes_of(column)
    full = np.flatnonzero(np.diff(bounds) > 0)
    wrapped = full[(data[bounds[:-1][full]] == 0x22) | _BLANK[data[bounds[:-1][full]]]]
    texts: list | None = None
    for i in wrapped:
        raw = data[bounds[i] : bounds[i + 1]].tobytes()
        changed = False
        while raw.lstrip(b" \t\r\n").startswith(b'"'):
            try:
                raw, changed = json.loads(raw).encode("utf-8", "surrogatepass"), True
            except ValueError:
                break
        if changed:
            if texts is None:
                texts = column.cast(pa.large_binary()).to_pylist()
            texts[i] = raw
    return column if texts is None else pa.array(texts, pa.large_binary())


def _lists(sizes: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), pa.int32())


def _whole(said: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which texts are whole numbers, and these."""
    right = pc.fill_null(pc.match_substring_regex(said, _WHOLE), False).to_numpy(zero_copy_only=False).astype(bool)
    return right, pc.utf8_trim_whitespace(said.filter(pa.array(right))).cast(pa.int64()).to_numpy()


def _matches(column: pa.Array, shape: Shape, fields: bool) -> tuple[np.ndarray, pa.Array]:
    """``readable`` per text, and its first-level objects as a list of structs."""
    ix = Index(*_bytes_of(_opened(column)))
    records = len(column)
    tokens = len(ix.start)
    good = ix.ok[ix.rec] if tokens else np.zeros(0, bool)
    keys = np.flatnonzero(ix.is_key & good)
    is_match = np.zeros(tokens, bool)
    for word in shape.marks:
        is_match[ix.parent[keys[ix.same(keys, word.encode())]]] = True
    matches = np.flatnonzero(is_match)
    # the spans of the places: a container's tokens carry their owner down level by level
    values = np.flatnonzero((ix.key_of >= 0) & good)
    occ_values = values[ix.same(ix.key_of[values], shape.places.encode())]
    owner = np.full(tokens, -1)  # object whose places enclose the token
    owner[occ_values] = ix.parent[occ_values]
    deepest = int(ix.level.max()) if tokens else 0
    by_level = np.argsort(ix.level, kind="stable")
    edges = np.searchsorted(ix.level[by_level], np.arange(deepest + 2))
    locates = owner >= 0
    located = np.zeros(tokens, bool)
    for word in shape.locating:
        located[values[ix.same(ix.key_of[values], word.encode())]] = True
    for d in range(1, deepest + 1):
        here = by_level[edges[d] : edges[d + 1]]
        here = here[(owner[here] < 0) & (ix.parent[here] >= 0)]
        p = ix.parent[here]
        inner = owner[p] >= 0
        here, p = here[inner], p[inner]
        owner[here] = owner[p]
        locates[here] = locates[p] & ((ix.kind[p] == _LBRACKET) | located[here])
    leaf = np.flatnonzero(locates & good & ((ix.kind == _STRING) | (ix.kind == _SCALAR)) & ~ix.is_key)
    keep, starts = _whole(ix.texts(leaf))
    leaf = leaf[keep]
    number_of = np.zeros(tokens + 1, np.int64)
    number_of[matches] = np.arange(len(matches))
    owners = number_of[owner[leaf]] if len(leaf) else np.zeros(0, np.int64)
    order = np.argsort(owners, kind="stable")
    per_match = np.bincount(owners, minlength=len(matches))
    per_record = np.bincount(ix.rec[matches], minlength=records) if len(matches) else np.zeros(records, np.int64)
    first = np.concatenate([[0], np.cumsum(per_record)])
    match_no = (np.arange(len(matches)) - first[ix.rec[matches]] + 1).astype(np.int32) if len(matches) else np.zeros(0, np.int32)
    columns = {"match_no": pa.array(match_no, pa.int32()), "occ": pa.ListArray.from_arrays(_lists(per_match), pa.array(starts[order], pa.int64()))}
    if fields:
        columns |= _level(ix, values, matches, shape)
        columns["members"] = _others(ix, values, matches, shape)
    struct = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
    return ix.ok, pa.ListArray.from_arrays(_lists(per_record), struct)


def _member(ix: Index, values: np.ndarray, name: str, number_of: np.ndarray, size: int) -> pa.Array:
    """The member ``name`` of each numbered object as text; null where it is missing, null or a container; the first where repeated."""
    hits = values[ix.same(ix.key_of[values], name.encode())]
    hits = hits[(number_of[ix.parent[hits]] >= 0) & ((ix.kind[hits] == _STRING) | (ix.kind[hits] == _SCALAR))]
    said = ix.texts(hits)
    empty = (ix.kind[hits] == _SCALAR) & pc.fill_null(pc.equal(said, "null"), False).to_numpy(zero_copy_only=False).astype(bool)
    take = np.full(size, -1)
    take[number_of[ix.parent[hits[~empty]]][::-1]] = np.flatnonzero(~empty)[::-1]
    return said.take(pa.array(take, pa.int64(), mask=take < 0))


def _float(said: pa.Array) -> pa.Array:
    number = pc.match_substring_regex(said, r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$|^-?(?:NaN|Infinity)$")
    plain = pc.replace_substring_regex(pc.utf8_trim_whitespace(pc.if_else(number, said, pa.scalar(None, pa.string()))), "Infinity", "inf")
    return pc.replace_substring(plain, "+", "").cast(pa.float64()) if len(said) else pa.array([], pa.float64())


def _level(ix: Index, values: np.ndarray, objects: np.ndarray, level: Level | Shape) -> dict[str, pa.Array]:
    """The columns of the objects of a level, those of the levels below as lists of structs."""
    tokens = len(ix.start)
    number_of = np.full(tokens + 1, -1)
    number_of[objects] = np.arange(len(objects))
    out = {name: _member(ix, values, name, number_of, len(objects)) for name in level.texts}
    out |= {name: _float(_member(ix, values, name, number_of, len(objects))) for name in level.numbers}
    for child in level.below:
        hits = values[ix.same(ix.key_of[values], child.key.encode())]
        hits = hits[(number_of[ix.parent[hits]] >= 0) & (ix.kind[hits] == _LBRACKET)]
        is_array = np.zeros(tokens + 1, bool)
        is_array[hits] = True
        items = np.flatnonzero((ix.kind == _LBRACE) & (ix.parent >= 0) & is_array[ix.parent])
        above = number_of[ix.parent[ix.parent[items]]] if len(items) else np.zeros(0, np.int64)
        order = np.argsort(above, kind="stable")
        columns = _level(ix, values, items[order], child)
        struct = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
        out[child.key] = pa.ListArray.from_arrays(_lists(np.bincount(above, minlength=len(objects))), struct)
    return out


def _others(ix: Index, values: np.ndarray, matches: np.ndarray, shape: Shape) -> pa.Array:
    """The members of the first level that the shape does not name, as lists of key and value; containers as their JSON text."""
    number_of = np.full(len(ix.start) + 1, -1)
    number_of[matches] = np.arange(len(matches))
    mine = values[number_of[ix.parent[values]] >= 0]
    for name in (*shape.texts, *shape.numbers, shape.places, *(b.key for b in shape.below)):
        mine = mine[~ix.same(ix.key_of[mine], name.encode())]
    owners = number_of[ix.parent[mine]]
    order = np.argsort(owners, kind="stable")
    mine = mine[order]
    said = ix.texts(mine)
    said = pc.if_else(pa.array(ix.kind[mine] == _SCALAR) if len(mine) else pa.array([], pa.bool_()), pc.if_else(pc.equal(said, "null"), pa.scalar(None, pa.string()), said), said)
    held = np.flatnonzero((ix.kind[mine] == _LBRACE) | (ix.kind[mine] == _LBRACKET))
    if len(held):
        out = said.to_numpy(zero_copy_only=False).astype(object)
        closer = ix.closer_of()
        out[held] = [ix.raw[ix.start[t] : ix.end[closer[t]]].decode("utf-8", "replace") for t in mine[held]]
        said = pa.array(out, pa.string())
    struct = pa.StructArray.from_arrays([ix.texts(ix.key_of[mine]), said], names=["key", "value"])
    return pa.ListArray.from_arrays(_lists(np.bincount(owners, minlength=len(matches))), struct)


_KINDS = {_LBRACE: "object", _LBRACKET: "array", _STRING: "string"}


def _nodes(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """``readable`` per text, and every value of it as a list of structs, in the order of the text."""
    ix = Index(*_bytes_of(_opened(column)))
    records = len(column)
    good = ix.ok[ix.rec] if len(ix.start) else np.zeros(0, bool)
    nodes = np.flatnonzero(ix.is_value & ~ix.is_key & good)
    per_record = np.bincount(ix.rec[nodes], minlength=records) if len(nodes) else np.zeros(records, np.int64)
    first = np.concatenate([[0], np.cumsum(per_record)])
    number = np.zeros(len(ix.start) + 1, np.int64)
    number[nodes] = np.arange(len(nodes)) - first[ix.rec[nodes]] + 1
    parent = ix.parent[nodes]
    kind = ix.kind[nodes]
    in_array = (parent >= 0) & (ix.kind[parent] == _LBRACKET) if len(nodes) else np.zeros(0, bool)
    named = ix.key_of[nodes] >= 0
    keys = np.full(len(nodes), None, object)
    keys[named] = ix.texts(ix.key_of[nodes[named]]).to_numpy(zero_copy_only=False)
    leaf = (kind == _STRING) | (kind == _SCALAR)
    said = np.full(len(nodes), None, object)
    said[leaf] = ix.texts(nodes[leaf]).to_numpy(zero_copy_only=False)
    word = np.where(kind == _SCALAR, "number", "")
    for k, name in _KINDS.items():
        word = np.where(kind == k, name, word)
    scalar = kind == _SCALAR
    for name in ("true", "false", "null"):
        word = np.where(scalar & (said == name), "null" if name == "null" else "boolean", word)
    struct = pa.StructArray.from_arrays(
        [
            pa.array(number[nodes], pa.int32()), pa.array(np.where(parent >= 0, number[parent], 0), pa.int32(), mask=parent < 0), pa.array(keys, pa.string()),
            pa.array(ix.rank[nodes] // 2, pa.int32(), mask=~in_array), pa.array(word, pa.string()), pa.array(np.where(scalar & (said == "null"), None, said), pa.string()),
        ],
        names=["node_no", "parent_no", "key", "item_no", "kind", "value"],
    )
    return ix.ok, pa.ListArray.from_arrays(_lists(per_record), struct)


_NODE_DDL = "node_no: int, parent_no: int, key: string, item_no: int, kind: string, value: string"


def _level_ddl(level: Level | Shape) -> str:
    parts = [f"{c}: string" for c in level.texts] + [f"{c}: double" for c in level.numbers]
    return ", ".join([*parts, *(f"{b.key}: array<struct<{_level_ddl(b)}>>" for b in level.below)])


def _indexed(df: DataFrame, key: str, text: str, version: str, rows: str, ddl: str, read) -> DataFrame:
    """One row for each distinct non-null key: ``rec_key, readable`` and the list ``rows``, of the last delivery.

    Texts are indexed where they are read; only what was extracted is shuffled, once, to keep the last delivery of a key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                ok, found = read(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ok, pa.bool_()), found], names=["rec_key", "version", "readable", rows])

    narrow = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.struct(F.col(version).alias("v"), F.xxhash64(text).alias("h")).alias("version"), F.col(text).cast("string").alias("t"))
    kinds = dict(df.dtypes)
    parsed = narrow.mapInArrow(run, f"rec_key long, version struct<v: {kinds[version]}, h: bigint>, readable boolean, {rows} array<struct<{ddl}>>")
    return parsed.groupBy("rec_key").agg(F.max_by(F.struct("readable", rows), "version").alias("r")).select("rec_key", "r.readable", f"r.{rows}")


def index_matches(df: DataFrame, key: str = "rec_id", text: str = "matches_found", version: str = "loaded_at", fields: bool = True, shape: Shape = MATCHES) -> DataFrame:
    """One row for each distinct non-null ``key``: ``rec_key``, ``readable``, ``matches`` (array of structs after ``shape``).

    ``fields=False`` extracts numbers and offsets alone.
    """
    ddl = f"match_no: int, occ: array<bigint>{', ' + _level_ddl(shape) + ', members: array<struct<key: string, value: string>>' if fields else ''}"
    return _indexed(df, key, text, version, "matches", ddl, lambda column: _matches(column, shape, fields))


def nodes_table(df: DataFrame, key: str = "rec_id", text: str = "matches_found", version: str = "loaded_at") -> DataFrame:
    """Every value of every record: ``rec_id, node_no, parent_no, key, item_no, kind, value``; ``node_no`` counts from 1 in the order of the text."""
    n = _indexed(df, key, text, version, "nodes", _NODE_DDL, _nodes).select(F.col("rec_key").alias("rec_id"), F.explode("nodes").alias("n"))
    return n.select("rec_id", "n.*")


def records_table(indexed: DataFrame) -> DataFrame:
    """The root table: ``rec_id, readable, n_matches, n_unfit``."""
    unfit = F.aggregate("matches", F.lit(0), lambda a, m: a + F.size(F.filter(m.occ, lambda o: ~_fits(o))))
    return indexed.select(F.col("rec_key").alias("rec_id"), "readable", F.size("matches").alias("n_matches"), unfit.alias("n_unfit"))


def _fits(offset):
    return offset.between(-(2**31), 2**31 - 1)


def matches_table(indexed: DataFrame) -> DataFrame:
    """Children of records: ``rec_id, match_no`` and the fields of the match."""
    m = indexed.select(F.col("rec_key").alias("rec_id"), F.explode("matches").alias("m"))
    texts = (c for c in MATCHES.texts if c != "curr_occurence_offset")
    return m.select("rec_id", "m.match_no", *(f"m.{c}" for c in texts), "m.sim", F.col("m.curr_occurence_offset").try_cast("int").alias("curr_occurence_offset"), F.size("m.occ").alias("n_occ"), F.size("m.alternatives").alias("n_alternatives"))


def members_table(indexed: DataFrame) -> DataFrame:
    """Children of matches: ``rec_id, match_no, key, value`` of the members that the shape does not name; a null member is a null value."""
    m = indexed.select(F.col("rec_key").alias("rec_id"), F.explode("matches").alias("m"))
    x = m.select("rec_id", "m.match_no", F.explode("m.members").alias("x"))
    return x.select("rec_id", "match_no", "x.key", "x.value")


def occurrences_table(indexed: DataFrame) -> DataFrame:
    """Children of matches: ``rec_id, match_no, occ_no, occ_start``."""
    m = indexed.select(F.col("rec_key").alias("rec_id"), F.explode("matches").alias("m"))
    o = m.select("rec_id", "m.match_no", F.posexplode("m.occ").alias("occ_no", "occ_start")).where(_fits(F.col("occ_start")))
    return o.select("rec_id", "match_no", (F.col("occ_no") + 1).cast("int").alias("occ_no"), F.col("occ_start").cast("int").alias("occ_start"))


def alternatives_table(indexed: DataFrame) -> DataFrame:
    """Children of matches: ``rec_id, match_no, alt_no, cui, sim``."""
    m = indexed.select(F.col("rec_key").alias("rec_id"), F.explode("matches").alias("m"))
    a = m.select("rec_id", "m.match_no", F.posexplode("m.alternatives").alias("alt_no", "a"))
    return a.select("rec_id", "match_no", (F.col("alt_no") + 1).cast("int").alias("alt_no"), "a.cui", "a.sim", F.size("a.sources").alias("n_sources"))


def sources_table(indexed: DataFrame) -> DataFrame:
    """Children of alternatives: ``rec_id, match_no, alt_no, source_no, stt, rank``."""
    m = indexed.select(F.col("rec_key").alias("rec_id"), F.explode("matches").alias("m"))
    a = m.select("rec_id", "m.match_no", F.posexplode("m.alternatives").alias("alt_no", "a"))
    s = a.select("rec_id", "match_no", (F.col("alt_no") + 1).cast("int").alias("alt_no"), F.posexplode("a.sources").alias("source_no", "s"))
    return s.select("rec_id", "match_no", "alt_no", (F.col("source_no") + 1).cast("int").alias("source_no"), "s.stt", F.col("s.rank").try_cast("int").alias("rank"))
