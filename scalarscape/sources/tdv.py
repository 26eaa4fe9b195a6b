"""Reader of a binary simulation format as a Spark data source, and a writer of small files for tests.

``spark.read.format("tdv").option("table", t).load(path)`` gives one of the tables
datasets, variables, zones, points, fields and cells. A file is one partition, a large one
several that take its zones in turn: each walks the zones' heads, which are small, seeks
past the arrays and comes back for those of its own, one array at a time and in Arrow
batches. Filters on ``zone_id`` prune zones before their arrays are read. Paths are local
or those of any store that pyarrow.fs knows by its URI.

Layout (fixed values): 8 bytes from ``#!TDV``, then 32-bit words; texts hold one word a
character and end with 0; a zone starts with the float 299, aux of the dataset with 799,
of a variable with 899, the data section with 357. The section is found by the header's
cursor, not by searching for the marker's bytes, which may occur earlier by chance.
"""

from __future__ import annotations

import io
import os
import posixpath
import struct
from collections.abc import Iterator
from fnmatch import fnmatch

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

ZONE, DATASET_AUX, VARIABLE_AUX, DATA = 299.0, 799.0, 899.0, 357.0
ZONE_TYPES = ["ORDERED", "FELINESEG", "FETRIANGLE", "FEQUADRILATERAL", "FETETRAHEDRON", "FEBRICK", "FEPOLYGON", "FEPOLYHEDRON"]
NODES = {"FELINESEG": 2, "FETRIANGLE": 3, "FEQUADRILATERAL": 4, "FETETRAHEDRON": 4, "FEBRICK": 8}
FORMATS = {1: "f4", 2: "f8", 3: "i4", 4: "i2", 5: "u1"}

SPLIT_BYTES = 128 << 20  # bytes of a file for each of its partitions
BATCH_ROWS = 65_536

SCHEMAS = {
    "datasets": "dataset string, file_type int, title string, n_vars int, aux map<string,string>",
    "variables": "dataset string, var_idx int, name string, aux map<string,string>",
    "zones": "dataset string, zone_id int, name string, zone_type string, imax int, jmax int, kmax int, strand_id int, "
    "parent_zone int, color int, solution_time double, aux map<string,string>",
    "points": "dataset string, zone_id int, vertex_id bigint, x double, y double, z double",
    "fields": "dataset string, zone_id int, field string, vertex_id bigint, value double",
    "cells": "dataset string, zone_id int, cell_id bigint, nodes array<int>",
}


class TdvError(ValueError):
    """The file is no valid file of this format."""


class _Cursor:
    def __init__(self, f, order: str):
        self.f, self.order = f, order

    def take(self, code: str):
        size = struct.calcsize(self.order + code)
        data = self.f.read(size)
        if len(data) < size:
            raise TdvError("the file ends early")
        got = struct.unpack(self.order + code, data)
        return got[0] if len(got) == 1 else got

    def text(self) -> str:
        out = []
        while (c := self.take("I")) != 0:
            out.append(chr(c) if c < 0x110000 and not 0xD800 <= c < 0xE000 else "?")
        return "".join(out)

    def marker(self) -> float:
        return self.take("f")

    def array(self, kind: str, n: int) -> np.ndarray:
        dtype = np.dtype(kind).newbyteorder(self.order)
        data = self.f.read(n * dtype.itemsize)
        if len(data) < n * dtype.itemsize:
            raise TdvError("an array ends early")
        return np.frombuffer(data, dtype=dtype)

    def skip(self, n: int) -> None:
        self.f.seek(n, os.SEEK_CUR)


def _near(x: float, marker: float) -> bool:
    return abs(x - marker) < 1e-4


def open_header(f) -> tuple[_Cursor, dict]:
    """The cursor at the data section, and the header."""
    if not f.read(8).startswith(b"#!TDV"):
        raise TdvError("not a file of this format")
    flag = f.read(4)
    c = _Cursor(f, "<" if flag == b"\x01\0\0\0" else ">")
    head = {"file_type": c.take("i"), "title": c.text(), "aux": {}, "zones": []}
    head["variables"] = [{"name": c.text(), "aux": {}} for _ in range(c.take("i"))]
    while not _near(m := c.marker(), DATA):
        if _near(m, ZONE):
            z = {"name": c.text(), "parent_zone": c.take("i"), "strand_id": c.take("i"), "solution_time": c.take("d"), "color": c.take("i"), "aux": {}}
            code = c.take("i")
            z["zone_type"] = ZONE_TYPES[code] if 0 <= code < len(ZONE_TYPES) else str(code)
            if c.take("i"):
                c.skip(4 * len(head["variables"]))  # locations: all values are nodal
            c.skip(8)  # neighbour flags
            if code == 0:
                z["imax"], z["jmax"], z["kmax"] = c.take("3i")
            else:
                z["imax"], z["jmax"], z["kmax"] = *c.take("2i"), None
                c.skip(12)
            while c.take("i"):
                key = c.text()
                c.skip(4)
                z["aux"][key] = c.text()
            head["zones"].append(z)
        elif _near(m, DATASET_AUX):
            key = c.text()
            c.skip(4)
            head["aux"][key] = c.text()
        elif _near(m, VARIABLE_AUX):
            at, key = c.take("i"), c.text()
            c.skip(4)
            value = c.text()
            if 0 <= at < len(head["variables"]):
                head["variables"][at]["aux"][key] = value
        else:
            raise TdvError(f"unknown section {m}")
    return c, head


def layout(c: _Cursor, head: dict) -> list[dict]:
    """For each zone where its own arrays and cells lie in the file: ``own`` {variable: (offset, kind)}, ``shared`` {variable: zone}, ``cells`` (offset or None), ``cells_of``, ``n``."""
    names = [v["name"] for v in head["variables"]]
    out = []
    for z in head["zones"]:
        if not _near(c.marker(), ZONE):
            raise TdvError("a zone's data does not start where it should")
        formats = [c.take("i") for _ in names]
        passive = [c.take("i") for _ in names] if c.take("i") else [0] * len(names)
        shared = [c.take("i") for _ in names] if c.take("i") else [0] * len(names)  # from 1, 0 is none
        mesh_of = c.take("i")
        own = [i for i in range(len(names)) if not passive[i] and not shared[i]]
        c.skip(16 * len(own))  # least and greatest values
        n = z["imax"] * (z["jmax"] * z["kmax"] if z["zone_type"] == "ORDERED" else 1)
        zone = {"n": n, "own": {}, "shared": {i: shared[i] - 1 for i in range(len(names)) if shared[i] and not passive[i]}, "cells": None, "cells_of": mesh_of - 1 if mesh_of > 0 else None}
        for i in own:
            kind = FORMATS.get(formats[i], "f4")
            zone["own"][i] = (c.f.tell(), kind)
            c.skip(n * np.dtype(kind).itemsize)
        k = NODES.get(z["zone_type"])
        if k is not None and mesh_of <= 0:
            zone["cells"] = c.f.tell()
            c.skip(4 * z["jmax"] * k)
        out.append(zone)
    return out


def _values(c: _Cursor, zones: list[dict], number: int, variable: int) -> np.ndarray | None:
    """A zone's values of a variable, its own or those of the zone that it shares them with; None for a passive one or a share that leads nowhere."""
    seen = set()
    while variable not in zones[number]["own"]:
        seen.add(number)
        number = zones[number]["shared"].get(variable, -1)
        if not 0 <= number < len(zones) or number in seen:
            return None
    offset, kind = zones[number]["own"][variable]
    c.f.seek(offset)
    return c.array(kind, zones[number]["n"]).astype(np.float64)


def _cells(c: _Cursor, head: dict, zones: list[dict], number: int) -> np.ndarray | None:
    """A zone's cells, counted from 0, its own or another zone's."""
    seen = set()
    while zones[number]["cells"] is None:
        seen.add(number)
        number = zones[number]["cells_of"] if zones[number]["cells_of"] is not None else -1
        if not 0 <= number < len(zones) or number in seen:
            return None
    z = head["zones"][number]
    k = NODES[z["zone_type"]]
    c.f.seek(zones[number]["cells"])
    cells = c.array("i4", z["jmax"] * k).reshape(-1, k).astype(np.int32)
    return cells - 1 if len(cells) and cells.min() >= 1 else cells


def _located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.removeprefix("file:") if not path.startswith("file:/") else "file://" + path.removeprefix("file:"))


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files under a folder, of one file, or of those that a pattern in the last part names."""
    store, where = _located(path)
    prefix = path[: len(path) - len(where)] if "://" in path else ""
    info = store.get_file_info(where)
    if info.type == fs.FileType.File:
        found = [info]
    else:
        folder, pattern = (where, "*.plt") if info.type == fs.FileType.Directory else posixpath.split(where)
        found = [f for f in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.type == fs.FileType.File and fnmatch(f.base_name, pattern)]
    return sorted((prefix + f.path, f.size) for f in found)


class _Part(InputPartition):
    def __init__(self, path: str, part: int = 0, parts: int = 1):
        super().__init__((path, part, parts))
        self.path, self.part, self.parts = path, part, parts


class TdvReader(DataSourceReader):
    def __init__(self, options: dict):
        self.table = options.get("table", "zones")
        self.path = options["path"]
        self.zones: set[int] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("zone_id",):
                self.zones = {int(f.value)} if self.zones is None else self.zones & {int(f.value)}
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        arrays = self.table in ("points", "fields", "cells")
        out = []
        for path, size in list_files(self.path):
            parts = max(1, -(-size // SPLIT_BYTES)) if arrays else 1
            out += [_Part(path, i, parts) for i in range(parts)]
        return out or [_Part("")]

    def read(self, partition: _Part) -> Iterator[tuple] | Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, where = _located(partition.path)
        dataset = os.path.splitext(posixpath.basename(where))[0]
        with store.open_input_file(where) as raw, io.BufferedReader(raw, 1 << 20) as f:
            c, head = open_header(f)
            if self.table == "datasets":
                yield dataset, head["file_type"], head["title"], len(head["variables"]), head["aux"]
            elif self.table == "variables":
                for i, v in enumerate(head["variables"]):
                    yield dataset, i, v["name"], v["aux"]
            elif self.table == "zones":
                for i, z in enumerate(head["zones"]):
                    if self.zones is None or i in self.zones:
                        yield (dataset, i, *(z[k] for k in ("name", "zone_type", "imax", "jmax", "kmax", "strand_id", "parent_zone", "color", "solution_time", "aux")))
            else:
                zones = layout(c, head)
                for number in range(partition.part, len(zones), partition.parts):
                    if self.zones is None or number in self.zones:
                        yield from self._arrays(dataset, c, head, zones, number)

    def _arrays(self, dataset: str, c: _Cursor, head: dict, zones: list[dict], number: int) -> Iterator[pa.RecordBatch]:
        names = [v["name"] for v in head["variables"]]
        upper = [n.upper() for n in names]
        axes = [upper.index(a) if a in upper else i if i < len(names) else None for i, a in enumerate("XYZ")]
        if self.table == "cells":
            cells = _cells(c, head, zones, number)
            if cells is not None:
                flat = pa.array(cells.ravel(), pa.int32())
                nodes = pa.ListArray.from_arrays(pa.array(np.arange(0, cells.size + 1, cells.shape[1], dtype=np.int32)), flat)
                yield from _batches(dataset, number, len(cells), {"cell_id": None, "nodes": nodes})
        elif self.table == "points":
            columns = {a: None if i is None else _values(c, zones, number, i) for a, i in zip("xyz", axes, strict=True)}
            n = max((len(v) for v in columns.values() if v is not None), default=0)
            yield from _batches(dataset, number, n, {"vertex_id": None, **{a: pa.nulls(n, pa.float64()) if v is None else pa.array(v) for a, v in columns.items()}})
        else:
            for i, name in enumerate(names):
                if i not in axes and (values := _values(c, zones, number, i)) is not None:
                    yield from _batches(dataset, number, len(values), {"field": name, "vertex_id": None, "value": pa.array(values)})


def _batches(dataset: str, number: int, n: int, columns: dict) -> Iterator[pa.RecordBatch]:
    """Rows of a zone: a text stands for itself in every row, None for the row's number."""
    for start in range(0, n, BATCH_ROWS):
        m = min(BATCH_ROWS, n - start)
        same = lambda v: pa.DictionaryArray.from_arrays(pa.array(np.zeros(m, np.int32)), pa.array([v])).dictionary_decode()  # noqa: B023, E731
        row = {"dataset": same(dataset), "zone_id": pa.array(np.full(m, number, np.int32))}
        for name, v in columns.items():
            row[name] = pa.array(np.arange(start, start + m, dtype=np.int64)) if v is None else same(v) if isinstance(v, str) else v.slice(start, m)
        yield pa.RecordBatch.from_pydict(row)


class TdvSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tdv"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "zones")]

    def reader(self, schema) -> DataSourceReader:
        return TdvReader(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known to a session, with filters handed down to the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TdvSource)


def write_file(path: str, title: str, variables: list[str], zones: list[dict], aux: dict | None = None, variable_aux: dict | None = None, order: str = "<") -> None:
    """A small file. A zone has name, zone_type, sizes, ``arrays`` by variable (None: passive; int: shared from that zone), ``cells`` from 0, aux, formats."""
    out = bytearray(b"#!TDV112" + struct.pack(order + "I", 1))
    put = lambda code, *v: out.extend(struct.pack(order + code, *v))
    text = lambda s: put(f"{len(s) + 1}I", *map(ord, s), 0)
    put("i", 0)
    text(title)
    put("i", len(variables))
    for v in variables:
        text(v)
    for z in zones:
        code = ZONE_TYPES.index(z["zone_type"])
        put("f", ZONE)
        text(z["name"])
        put("iidiiiii", z.get("parent_zone", 0), z.get("strand_id", 0), z.get("solution_time", 0.0), z.get("color", 0), code, 0, 0, 0)
        if code == 0:
            put("3i", *z["size"])
        else:
            put("5i", z["size"][0], z["size"][1], 0, 0, 0)
        for k, v in z.get("aux", {}).items():
            put("i", 1)
            text(k)
            put("i", 0)
            text(v)
        put("i", 0)
    for k, v in (aux or {}).items():
        put("f", DATASET_AUX)
        text(k)
        put("i", 0)
        text(v)
    for at, pairs in (variable_aux or {}).items():
        for k, v in pairs.items():
            put("f", VARIABLE_AUX)
            put("i", at)
            text(k)
            put("i", 0)
            text(v)
    put("f", DATA)
    for z in zones:
        put("f", ZONE)
        formats = z.get("formats", [2] * len(variables))
        put(f"{len(variables)}i", *formats)
        given = [z["arrays"].get(v) for v in variables]
        put("i", 1)
        put(f"{len(variables)}i", *[int(a is None) for a in given])
        put("i", 1)
        put(f"{len(variables)}i", *[a + 1 if isinstance(a, int) else 0 for a in given])
        put("i", z.get("cells_of", -1) + 1)
        for a in given:
            if a is not None and not isinstance(a, int):
                put("dd", float(min(a)), float(max(a)))
        for a, fmt in zip(given, formats, strict=True):
            if a is not None and not isinstance(a, int):
                out.extend(np.asarray(a).astype(np.dtype(FORMATS[fmt]).newbyteorder(order)).tobytes())
        if z["zone_type"] != "ORDERED" and "cells_of" not in z:
            out.extend((np.asarray(z["cells"]) + 1).astype(np.dtype("i4").newbyteorder(order)).tobytes())
    store, where = _located(path)
    with store.open_output_stream(where) as f:
        f.write(bytes(out))
