"""imzML as a Spark data source: ``spark.read.format("imzml")`` and ``df.write.format("imzml")``.

A data set is one ``.imzML`` file with its ``.ibd`` beside it, or a folder of such pairs, on any file system that pyarrow
opens. A header is cut into ranges of bytes (option ``splitBytes``, or ``slices`` for a number of them); a task finds the
first spectrum that begins in its range, parses spectrum by spectrum, drops those that pushed filters on
x, y, z and spectrum_id (or the options x1, y1, x2, y2) don't let through, and only then reads binary arrays, adjoining ones
in one go, and of these only the columns of the schema that is asked for:
``spark.read.format("imzml").schema("x int, y int, intensity array<double>")`` never touches m/z. Numbers of spectra come from
counting start tags range by range, where spectrum_id is asked for.

``option("table", "layout")`` gives a row a spectrum with the places of its arrays instead of these. With a column
``_corrupt string`` in the schema, a spectrum that can't be read is a row that says why; without it, the read fails.

The file's metadata travel in the column ``intensity``'s metadata (key ``imzml``), and the sink writes them. It writes one pair
a task under a hidden name; the job's commit gives the pairs of its tasks their names, so that neither failed nor
repeated tasks leave anything that is read.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

SCHEMA = "spectrum_id bigint, x int, y int, z int, mz array<double>, intensity array<double>"
COLUMNS = {"spectrum_id": pa.int64(), "x": pa.int32(), "y": pa.int32(), "z": pa.int32(), "mz": pa.list_(pa.float64()), "intensity": pa.list_(pa.float64()), "_corrupt": pa.string()}
LAYOUT = "file string, spectrum_id bigint, x int, y int, z int, header_offset bigint, mz_offset bigint, mz_length bigint, mz_bytes bigint, mz_type string, intensity_offset bigint, intensity_length bigint, intensity_bytes bigint, intensity_type string"
# Controlled-vocabulary accessions of the format.
DTYPES = {"MS:1000521": "<f4", "MS:1000523": "<f8", "MS:1000519": "<i4", "MS:1000522": "<i8"}
ZLIB, MZ, INTENSITY = "MS:1000574", "MS:1000514", "MS:1000515"
POSITION = {"IMS:1000050": "x", "IMS:1000051": "y", "IMS:1000052": "z"}
EXTERNAL = {"IMS:1000102": "offset", "IMS:1000103": "length", "IMS:1000104": "bytes"}
METADATA = {
    "IMS:1000042": "max_count_of_pixels_x", "IMS:1000043": "max_count_of_pixels_y", "IMS:1000046": "pixel_size_x", "IMS:1000047": "pixel_size_y",
    "IMS:1000053": "absolute_position_offset_x", "IMS:1000054": "absolute_position_offset_y", "IMS:1000030": "continuous", "IMS:1000031": "processed",
    "IMS:1000041": "scan_type", "IMS:1000048": "scan_direction", "IMS:1000049": "line_scan_direction", "MS:1000031": "instrument_model",
    "MS:1000127": "centroid", "MS:1000128": "profile", "MS:1000579": "ms1", "MS:1000580": "msn",
}


#: Spectra and bytes (about) that a task reads at a time.
BATCH, BLOCK = 256, 16 << 20
#: Bytes of a header that a task parses, and that are read at a time.
SPLIT, STEP = 4 << 20, 1 << 20
SPECTRUM, SPECTRUM_END = re.compile(rb"<spectrum[\s>]"), b"</spectrum>"
TAG = 10  # bytes of a start tag that SPECTRUM looks at


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def opened(path: str) -> pa.NativeFile:
    fs, at = store(path)
    return fs.open_input_file(at)


@dataclass
class Layout:
    """Where a spectrum's arrays are."""

    index: int
    x: int = 0
    y: int = 0
    z: int = 1
    arrays: dict[str, dict] = field(default_factory=dict)


def _name(tag: str) -> str:
    return tag.rpartition("}")[2]


class HeaderParser:
    """Takes the events of a header, or of a part of it once the parameter groups are known."""

    def __init__(self, groups: dict[str, list[tuple[str, str]]] | None = None):
        self.groups = {} if groups is None else groups
        self.meta: dict[str, str | bool] = {}
        self.group: list | None = None
        self.now: Layout | None = None
        self.array: dict | None = None

    def note(self, acc: str, value: str) -> None:
        array = self.array
        if array is not None:
            if acc in DTYPES:
                array["dtype"] = DTYPES[acc]
            elif acc == ZLIB:
                array["zlib"] = True
            elif acc in (MZ, INTENSITY):
                array["kind"] = "mz" if acc == MZ else "intensity"
            elif acc in EXTERNAL:
                array[EXTERNAL[acc]] = int(value)
        elif self.now is not None and acc in POSITION:
            setattr(self.now, POSITION[acc], int(value))
        elif acc in METADATA and self.now is None:
            self.meta.setdefault(METADATA[acc], value or True)

    def take(self, event: str, e: ET.Element) -> Layout | None:
        """A spectrum's layout at its end."""
        tag = _name(e.tag)
        if event == "start":
            if tag == "referenceableParamGroup":
                self.group = self.groups.setdefault(e.get("id", ""), [])
            elif tag == "spectrum":
                self.now = Layout(-1)
            elif tag == "binaryDataArray":
                self.array = {"dtype": "<f8", "zlib": False}
        elif tag == "cvParam":
            acc, value = e.get("accession", ""), e.get("value", "")
            if self.group is not None:
                self.group.append((acc, value))
                if acc in METADATA:
                    self.meta.setdefault(METADATA[acc], value or True)
            else:
                self.note(acc, value)
        elif tag == "referenceableParamGroup":
            self.group = None
        elif tag == "referenceableParamGroupRef" and self.now is not None:
            for acc, value in self.groups.get(e.get("ref", ""), ()):
                self.note(acc, value)
        elif tag == "binaryDataArray":
            if self.now is not None and self.array and "kind" in self.array:
                self.now.arrays[self.array["kind"]] = self.array
            self.array = None
        elif tag == "spectrum":
            found, self.now = self.now, None
            return found
        return None


def scan_header(path: str) -> Iterator[Layout | dict]:
    """The metadata first (a dict), then every spectrum's layout in file order, by parsing the header from its start."""
    parser, given, holder = HeaderParser(), False, None
    with opened(path) as f:
        for event, e in ET.iterparse(f, events=("start", "end")):
            if event == "start" and _name(e.tag) == "spectrumList":
                holder = e
            elif event == "start" and _name(e.tag) == "spectrum" and not given:
                given = True
                yield parser.meta
            found = parser.take(event, e)
            if found is not None:
                yield found
                (e if holder is None else holder).clear()  # else the list grows with the file
        if not given:
            yield parser.meta


@dataclass
class Preamble:
    """What stands before the spectra: metadata, parameter groups, and where the spectra begin (None: there are none that a
    range of bytes could be searched for)."""

    meta: dict
    groups: dict
    first: int | None
    size: int
    encoding: str


def preamble(path: str) -> Preamble:
    held = b""
    with opened(path) as f:
        size = f.size()
        while (m := SPECTRUM.search(held)) is None and (more := f.read(STEP)):
            held += more
    pull, parser = ET.XMLPullParser(("start", "end")), HeaderParser()
    pull.feed(held[: m.start()] if m else held)
    for event, e in pull.read_events():
        parser.take(event, e)
    said = re.match(rb"<\?xml[^>]*encoding=[\"']([A-Za-z0-9._-]+)", held)
    return Preamble(parser.meta, parser.groups, m.start() if m else None, size, said[1].decode() if said else "utf-8")


def count_in(path: str, a: int, b: int) -> int:
    """How many spectra begin in a range of bytes."""
    n, held, base = 0, b"", a
    with opened(path) as f:
        f.seek(a)
        while base + len(held) < b + TAG - 1 and (more := f.read(min(STEP, b + TAG - 1 - base - len(held)))):
            held += more
            n += sum(1 for m in SPECTRUM.finditer(held) if base + m.start() < b)
            keep = min(len(held), TAG - 1)  # too short for a whole start tag
            base += len(held) - keep
            held = held[len(held) - keep :]
    return n


def spectra_in(path: str, head: Preamble, a: int, b: int) -> Iterator[tuple[int, bytes]]:
    """(byte, XML) of each spectrum that begins in a range of bytes; the last one is read beyond its end."""
    if head.first is None:
        return
    with opened(path) as f:
        base, held, at = max(a, head.first), b"", 0
        f.seek(base)
        while base + at < b:
            m = SPECTRUM.search(held, at)
            if m is None:
                keep = min(len(held) - at, TAG - 1)
                base += len(held) - keep
                held, at = held[len(held) - keep :], 0
                if base >= b or not (more := f.read(STEP)):
                    return
                held += more
                continue
            if base + m.start() >= b:
                return
            searched = m.start()
            while (end := held.find(SPECTRUM_END, searched)) < 0 and (more := f.read(STEP)):
                searched = max(m.start(), len(held) - len(SPECTRUM_END))
                held += more
            stop = len(held) if end < 0 else end + len(SPECTRUM_END)
            yield base + m.start(), held[m.start() : stop]
            base, held, at = base + stop, held[stop:], 0


def layout_of(raw: bytes, head: Preamble) -> Layout:
    parser, found = HeaderParser(head.groups), None
    pull = ET.XMLPullParser(("start", "end"))
    pull.feed(raw.decode(head.encoding))
    pull.close()
    for event, e in pull.read_events():
        found = parser.take(event, e) or found
    return found


def _array(raw: bytes, a: dict) -> np.ndarray:
    if len(raw) != _size(a):
        raise ValueError(f"the .ibd ends before byte {a['offset'] + _size(a)}")
    return np.frombuffer(zlib.decompress(raw) if a["zlib"] else raw, dtype=a["dtype"]).astype(np.float64)


def _size(a: dict) -> int:
    return a["bytes"] if "bytes" in a else a["length"] * np.dtype(a["dtype"]).itemsize


def read_blocks(ibd, wanted: set[tuple[int, int]]) -> dict[tuple[int, int], bytes]:
    """The bytes of (offset, size) ranges: adjoining ones, up to BLOCK bytes in all, by a single read."""
    ranges, out, at = sorted(wanted), {}, 0
    while at < len(ranges):
        begin, end, last = ranges[at][0], sum(ranges[at]), at + 1
        while last < len(ranges) and ranges[last][0] <= end and sum(ranges[last]) - begin <= BLOCK:
            end, last = max(end, sum(ranges[last])), last + 1
        ibd.seek(begin)
        raw = ibd.read(end - begin)
        out |= {(o, n): raw[o - begin : o - begin + n] for o, n in ranges[at:last]}
        at = last
    return out


def _layouts(path: str, head: Preamble, a: int, b: int, first: int) -> Iterator[tuple[int, int, Layout | None, str | None]]:
    """(number, byte, layout, what is wrong with it) of the spectra of a range."""
    if head.first is None:  # no spectrum that bytes could be searched for: from the start
        if a == 0:
            yield from ((k, 0, s, None) for k, s in enumerate(x for x in scan_header(path) if not isinstance(x, dict)))
        return
    for k, (byte, raw) in enumerate(spectra_in(path, head, a, b)):
        try:
            yield first + k, byte, layout_of(raw, head), None
        except (ET.ParseError, ValueError, UnicodeDecodeError) as wrong:
            yield first + k, byte, None, f"header at byte {byte}: {wrong}"


def _spectra(path: str, layouts: Iterator[tuple[int, int, Layout | None, str | None]], kinds: Sequence[str]) -> Iterator[tuple]:
    """(number, x, y, z, mz, intensity, what is wrong) of layouts, arrays read together."""
    axis: tuple[tuple, np.ndarray] | None = None
    held: list[tuple[int, Layout | None, str | None]] = []
    size = 0
    ibd = opened(path[: -len("imzML")] + "ibd")

    def ready(s: Layout | None) -> bool:
        return s is not None and all(k in s.arrays and "offset" in s.arrays[k] and ("bytes" in s.arrays[k] or "length" in s.arrays[k]) for k in kinds)

    def flush() -> Iterator[tuple]:
        nonlocal axis
        ranges = {(s.arrays[k]["offset"], _size(s.arrays[k])) for _, s, _ in held if ready(s) for k in kinds}
        raw = read_blocks(ibd, ranges - {axis[0] if axis else None})
        for number, s, wrong in held:
            got: dict[str, np.ndarray] = {}
            if s is not None and not ready(s):
                wrong = "an array is missing or has no place: " + ", ".join(k for k in kinds if not ready(Layout(0, arrays={x: a for x, a in s.arrays.items() if x == k})) and "offset" not in s.arrays.get(k, {}))
            elif s is not None:
                try:
                    for kind in kinds:
                        a = s.arrays[kind]
                        key = (a["offset"], _size(a))
                        if kind == "mz" and not (axis and axis[0] == key and key not in raw):
                            axis = axis if axis and axis[0] == key else (key, _array(raw[key], a))
                        got[kind] = axis[1] if kind == "mz" else _array(raw[key], a)  # a shared axis is read once
                except (ValueError, zlib.error) as bad:
                    got, wrong = {}, str(bad)
            place = (s.x, s.y, s.z) if s is not None else (None, None, None)
            yield number, *place, got.get("mz"), got.get("intensity"), wrong
        held.clear()

    with ibd:
        for number, _, s, wrong in layouts:
            held.append((number, s, wrong))
            size += sum(_size(s.arrays[k]) for k in kinds) if ready(s) else 0
            if len(held) == BATCH or size >= BLOCK:
                yield from flush()
                size = 0
        yield from flush()


def read_spectra(path: str, start: int = 0, stop: int | None = None, box: tuple[int, int, int, int] | None = None, kinds: Sequence[str] = ("mz", "intensity")) -> Iterator[tuple]:
    """(index, x, y, z, mz, intensity) of some of a file's spectra; arrays that ``kinds`` leaves out are None and not read."""
    head = preamble(path)

    def wanted() -> Iterator[tuple[int, int, Layout | None, str | None]]:
        for number, byte, s, wrong in _layouts(path, head, 0, head.size, 0):
            if stop is not None and number >= stop:
                return
            if number >= start and (s is None or not box or (box[0] <= s.x <= box[2] and box[1] <= s.y <= box[3])):
                yield number, byte, s, wrong

    for row in _spectra(path, wanted(), kinds):
        if row[6]:
            raise ValueError(f"imzml: spectrum {row[0]} of {path}: {row[6]}")
        yield row[:6]


def files_of(path: str) -> list[str]:
    """The headers at a path or URI, in order."""
    path = path.removeprefix("file://")
    fs, at = store(path)
    lead = path.rstrip("/").removesuffix(at.rstrip("/")) if "://" in path else ""
    kinds = {p: fs.get_file_info(p).type for p in (at, f"{at}.imzML")}
    if kinds[at] == pafs.FileType.Directory:
        listed = (f.path for f in fs.get_file_info(pafs.FileSelector(at)))
        found = sorted(p for p in listed if p.endswith(".imzML") and not os.path.basename(p).startswith("."))
    else:
        found = [p for p, kind in kinds.items() if kind == pafs.FileType.File][:1]
    if not found:
        raise FileNotFoundError(f"imzml: nothing at {path}")
    return [lead + p for p in found]


@dataclass
class Slice(InputPartition):
    file: str
    number: int  # of the file
    head: Preamble
    start: int
    stop: int
    first: int  # number of the first spectrum that begins here


#: Filters on one column that a reader can apply before it reads arrays.
TESTS: dict[type, Callable] = {
    EqualTo: lambda v, f: v == f.value, GreaterThan: lambda v, f: v > f.value, GreaterThanOrEqual: lambda v, f: v >= f.value,
    LessThan: lambda v, f: v < f.value, LessThanOrEqual: lambda v, f: v <= f.value, In: lambda v, f: v in f.value, IsNotNull: lambda v, f: True,
}


class ImzMLReader(DataSourceReader):
    def __init__(self, options: dict, columns: Sequence[str] = tuple(COLUMNS)[:6]):
        self.path = options["path"]
        self.columns = list(columns)
        self.layout = options.get("table") == "layout"
        unknown = [c for c in self.columns if c not in COLUMNS]
        if unknown and not self.layout:
            raise ValueError(f"imzml: no columns {unknown}")
        self.slices = int(options.get("slices", "0"))
        self.split = int(options.get("splitBytes", options.get("splitbytes", SPLIT)))
        corners = [options.get(k) for k in ("x1", "y1", "x2", "y2")]
        self.box = tuple(map(int, corners)) if all(corners) else None
        if self.box and (self.box[0] > self.box[2] or self.box[1] > self.box[3]):
            raise ValueError("imzml: corners must ascend")
        self.filters: list[tuple[str, Filter]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
            if name in ("x", "y", "z", "spectrum_id") and type(f) in TESTS and not ("_corrupt" in self.columns and name != "spectrum_id"):
                self.filters.append((name, f))
            else:
                yield f

    def partitions(self) -> Sequence[InputPartition]:
        out: list[InputPartition] = []
        numbered = self.layout or bool({"spectrum_id", "_corrupt"} & set(self.columns)) or any(c == "spectrum_id" for c, _ in self.filters)
        for number, file in enumerate(files_of(self.path)):
            head = preamble(file)
            begin = head.first or 0
            n = self.slices or max(1, -(-(head.size - begin) // self.split))
            n = 1 if head.first is None else n
            edges = [begin + k * (head.size - begin) // n for k in range(n)] + [head.size]
            first = 0
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                out.append(Slice(file, number, head, 0 if head.first is None else a, b, first))
                if numbered and n > 1:
                    first += count_in(file, a, b)
        return out

    def wanted(self, part: Slice) -> Iterator[tuple[int, int, Layout | None, str | None]]:
        for number, byte, s, wrong in _layouts(part.file, part.head, part.start, part.stop, part.first):
            values = {"spectrum_id": (part.number << 32) + number} | ({c: getattr(s, c) for c in "xyz"} if s is not None else {})
            if all(c in values and TESTS[type(f)](values[c], f) for c, f in self.filters) and (s is None or not self.box or (self.box[0] <= s.x <= self.box[2] and self.box[1] <= s.y <= self.box[3])):
                yield number, byte, s, wrong

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if self.layout:
            yield from self._layout_rows(partition)
            return
        held: list[tuple] = []
        kinds = [c for c in ("mz", "intensity") if c in self.columns]
        order = [list(COLUMNS).index(c) for c in self.columns]

        def batch() -> pa.RecordBatch:
            made = []
            for c, k in zip(self.columns, order, strict=True):
                values = [row[k] for row in held]
                made.append(pa.array([(partition.number << 32) + i for i in values] if c == "spectrum_id" else values, COLUMNS[c]))
            return pa.RecordBatch.from_arrays(made, self.columns)

        size = 0
        for row in _spectra(partition.file, self.wanted(partition), kinds):
            if row[6] and "_corrupt" not in self.columns:
                raise ValueError(f"imzml: spectrum {row[0]} of {partition.file}: {row[6]}")
            held.append(row)
            size += sum(a.nbytes for a in row[4:6] if a is not None)
            if len(held) == BATCH or size >= BLOCK:
                yield batch()
                held.clear()
                size = 0
        if held:
            yield batch()

    def _layout_rows(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
        fields = [(f.split()[0], kind[f.split()[1]]) for f in LAYOUT.split(", ")]
        rows = []
        for number, byte, s, _ in self.wanted(partition):
            row = {"file": partition.file, "spectrum_id": (partition.number << 32) + number, "header_offset": byte}
            if s is not None:
                row |= {"x": s.x, "y": s.y, "z": s.z}
                for name, a in s.arrays.items():
                    row |= {f"{name}_offset": a.get("offset"), f"{name}_length": a.get("length"), f"{name}_bytes": _size(a) if "bytes" in a or "length" in a else None, f"{name}_type": a["dtype"]}
            rows.append(row)
        yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], t) for c, t in fields if c in self.columns], [c for c, _ in fields if c in self.columns])


@dataclass
class Written(WriterCommitMessage):
    stem: str
    spectra: int


class ImzMLWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool, meta: dict | None = None):
        self.path = options["path"].removeprefix("file://")
        self.meta = meta or {}
        self.mode = options.get("mode", mode_of(self.meta) if self.meta else "processed")
        self.profile = options.get("profile", "false" if self.meta.get("centroid") else "true") == "true"
        self.stats = options.get("stats", "false") == "true"
        self.once = options.get("dedup", "false") == "true"
        self.overwrite = overwrite
        self.job = f".job-{uuid.uuid4().hex}-"
        if self.mode not in MODES:
            raise ValueError(f"imzml: mode is one of {MODES}")
        fs, folder = store(self.path)
        if not overwrite and any(name.endswith(".imzML") and not name.startswith(".") for name in self._names()):
            raise FileExistsError(f"imzml: {self.path} holds spectra")
        fs.create_dir(folder, recursive=True)

    def _names(self) -> list[str]:
        fs, folder = store(self.path)
        return [os.path.basename(f.path) for f in fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))]

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        stem = f"{self.path.rstrip('/')}/{self.job}{uuid.uuid4().hex}"
        return Written(stem, write_pair(stem, iterator, self.mode, self.profile, self.stats, self.once, self.meta))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        if self.overwrite:
            self._remove(lambda name: name.startswith("part-") and name.endswith((".ibd", ".imzML")))
        for m in messages:
            if m and m.spectra:
                fs, stem = store(m.stem)
                named = f"{os.path.dirname(stem)}/part-{stem.rpartition('-')[2]}"
                for end in (".ibd", ".imzML"):  # the header last: a header that is read has its data
                    fs.move(stem + end, named + end)
        self._remove(lambda name: name.startswith(self.job))

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._remove(lambda name: name.startswith(self.job))

    def _remove(self, chosen: Callable[[str], bool]) -> None:
        fs, folder = store(self.path)
        for name in self._names():
            if chosen(name):
                fs.delete_file(f"{folder.rstrip('/')}/{name}")


MODES = ("continuous", "processed", "auto")


def mode_of(meta: dict) -> str:
    """The mode that a header's metadata name, auto where they name none."""
    return next((m for m in MODES[:2] if meta.get(m)), "auto")


def options_from(path: str) -> dict[str, str]:
    """Options for writing as the file (or the first of the folder's files) at path was written: its mode, and profile only
    where it says so."""
    meta = preamble(files_of(path)[0]).meta
    return {"mode": mode_of(meta), "profile": "true" if meta.get("profile") else "false"}


#: Arrays whose places a task keeps in mind when it writes each one once: about 150 MB; beyond that older ones are written again.
MOST_KNOWN = 1_000_000


def write_pair(stem: str, rows: Iterator, mode: str = "processed", profile: bool = True, stats: bool = False, once: bool = False, meta: dict | None = None) -> int:
    """Write rows (x, y, z, mz, intensity) as one pair: arrays as they come, the header at the end.

    auto: an axis that equals the one before is not written again, and the pair is continuous if it has a single one.
    stats: each spectrum's least and greatest m/z, base peak and total ion current go into the header.
    once: an array of the same content as one before (m/z or intensity) is not written again.
    meta: further metadata of the header, as ``METADATA`` names them.
    """
    fs, stem = store(stem)
    known: dict[bytes, tuple[int, int]] = {}
    token = uuid.uuid4()
    digest = hashlib.sha1(token.bytes)
    spectra: list[str] = []
    at, width, height, axes = 16, 0, 0, 0
    axis: tuple[bytes, int, int] | None = None
    with fs.open_output_stream(f"{stem}.ibd") as ibd:
        ibd.write(token.bytes)

        def put(raw: bytes, length: int) -> tuple[int, int]:
            nonlocal at
            key = hashlib.blake2b(raw, digest_size=16).digest() if once else b""
            if once and key in known:
                return known[key]
            ibd.write(raw)
            digest.update(raw)
            at += len(raw)
            if once:
                if len(known) == MOST_KNOWN:
                    known.clear()
                known[key] = at - len(raw), length
            return at - len(raw), length

        for row in rows:
            mz, x = (np.asarray(row[c], dtype="<f8") for c in ("mz", "intensity"))
            if len(mz) != len(x):
                raise ValueError("imzml: mz and intensity differ in length")
            raw = mz.tobytes()
            if mode != "processed" and axis is not None and raw == axis[0]:
                where = axis[1:]
            elif mode == "continuous" and axis is not None:
                raise ValueError("imzml: spectra of a continuous file share one axis")
            else:
                where = put(raw, len(mz))
                axis = (raw, *where)
                axes += 1
            spectra.append(_spectrum(len(spectra) + 1, row, where, put(x.astype("<f4").tobytes(), len(x)), _stats(mz, x) if stats else ""))
            width, height = max(width, row["x"]), max(height, row["y"])
    if mode == "auto":
        mode = "continuous" if axes == 1 else "processed"
    with fs.open_output_stream(f"{stem}.imzML") as out:
        out.write(_header(token, digest.hexdigest(), mode, profile, width, height, len(spectra), meta or {}).encode())
        for text in spectra:
            out.write(text.encode())
        out.write(b"</spectrumList></run></mzML>\n")
    return len(spectra)


def _cv(acc: str, value: object = "", name: str = "") -> str:
    return f'<cvParam cvRef="{acc.partition(":")[0]}" accession="{acc}" name="{name}" value="{value}"/>'


def _external(ref: str, offset: int, length: int, item: int) -> str:
    return f'<binaryDataArray encodedLength="0"><referenceableParamGroupRef ref="{ref}"/>{_cv("IMS:1000102", offset)}{_cv("IMS:1000103", length)}{_cv("IMS:1000104", length * item)}<binary/></binaryDataArray>'


def _stats(mz: np.ndarray, x: np.ndarray) -> str:
    if not len(mz):
        return ""
    top = int(np.argmax(x))
    found = {"MS:1000528": mz.min(), "MS:1000527": mz.max(), "MS:1000504": mz[top], "MS:1000505": x[top], "MS:1000285": x.sum()}
    return "".join(_cv(acc, float(v)) for acc, v in found.items())


def _spectrum(number: int, row, mz: tuple[int, int], x: tuple[int, int], stats: str = "") -> str:
    place = _cv("IMS:1000050", row["x"]) + _cv("IMS:1000051", row["y"]) + _cv("IMS:1000052", row["z"])
    arrays = _external("mzArray", *mz, 8) + _external("intensities", *x, 4)
    return f'<spectrum id="Scan={number}" defaultArrayLength="0" index="{number}"><referenceableParamGroupRef ref="spectrum"/>{stats}<scanList count="1"><scan>{place}</scan></scanList><binaryDataArrayList count="2">{arrays}</binaryDataArrayList></spectrum>\n'


#: Metadata that are kept as they are: the sink finds out the others itself.
KEPT = ("pixel_size_x", "pixel_size_y", "absolute_position_offset_x", "absolute_position_offset_y", "scan_type", "scan_direction", "line_scan_direction")


def _header(token: uuid.UUID, sha1: str, mode: str, profile: bool, width: int, height: int, n: int, meta: dict) -> str:
    kind = _cv("IMS:1000030" if mode == "continuous" else "IMS:1000031", "", mode)
    content = kind + _cv("IMS:1000080", "{" + str(token) + "}") + _cv("IMS:1000091", sha1)
    groups = (
        f'<referenceableParamGroup id="mzArray">{_cv(MZ, "", "m/z array")}{_cv("MS:1000523", "", "64-bit float")}{_cv("IMS:1000101", "true")}</referenceableParamGroup>'
        f'<referenceableParamGroup id="intensities">{_cv(INTENSITY, "", "intensity array")}{_cv("MS:1000521", "", "32-bit float")}{_cv("IMS:1000101", "true")}</referenceableParamGroup>'
        f'<referenceableParamGroup id="spectrum">{_cv("MS:1000579")}{_cv("MS:1000128" if profile else "MS:1000127")}</referenceableParamGroup>'
    )
    of = {name: acc for acc, name in METADATA.items()}
    plain = lambda v: "" if v is True else escape(str(v), {'"': "&quot;"})
    size = _cv("IMS:1000042", width) + _cv("IMS:1000043", height) + "".join(_cv(of[c], plain(meta[c])) for c in KEPT if c in meta)
    made = f'<instrumentConfigurationList count="1"><instrumentConfiguration id="instrument">{_cv(of["instrument_model"], plain(meta["instrument_model"]))}</instrumentConfiguration></instrumentConfigurationList>' if "instrument_model" in meta else ""
    return (
        '<?xml version="1.0" encoding="UTF-8"?>\n<mzML xmlns="http://psi.hupo.org/ms/mzml" version="1.1">'
        f"<fileDescription><fileContent>{content}</fileContent></fileDescription><referenceableParamGroupList count=\"3\">{groups}</referenceableParamGroupList>"
        f'<scanSettingsList count="1"><scanSettings id="scan">{size}</scanSettings></scanSettingsList>{made}<run id="run"><spectrumList count="{n}">\n'
    )


class ImzML(DataSource):
    @classmethod
    def name(cls) -> str:
        return "imzml"

    def schema(self) -> StructType | str:
        if self.options.get("table") == "layout":
            return LAYOUT
        meta = preamble(files_of(self.options["path"])[0]).meta
        places = [StructField("spectrum_id", LongType()), *(StructField(c, IntegerType()) for c in "xyz")]
        doubles = ArrayType(DoubleType())
        return StructType([*places, StructField("mz", doubles), StructField("intensity", doubles, True, {"imzml": meta})])

    def reader(self, schema) -> DataSourceReader:
        return ImzMLReader(dict(self.options), schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ImzMLWriter(dict(self.options), overwrite, metadata_of(schema))


def register(spark: SparkSession) -> None:
    """Make the format known, with filters pushed to it where the session doesn't say otherwise."""
    spark.dataSource.register(ImzML)
    if spark.conf.get("spark.sql.python.filterPushdown.enabled", None) != "true":
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def metadata_of(schema: StructType) -> dict:
    """The file's metadata that a schema carries."""
    return dict(schema["intensity"].metadata.get("imzml", {})) if "intensity" in schema.fieldNames() else {}


def with_metadata(spectra: DataFrame, **changes) -> DataFrame:
    """Spectra with some of the metadata changed (None takes one away); picking does this with profile and centroid."""
    meta = {k: v for k, v in (metadata_of(spectra.schema) | changes).items() if v is not None}
    return spectra.withMetadata("intensity", spectra.schema["intensity"].metadata | {"imzml": meta})


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, field, value) of the header fields of every file."""
    rows = [(f, k, str(v).lower() if v is True else v) for f in files_of(path) for k, v in sorted(preamble(f).meta.items())]
    return spark.createDataFrame(rows, "file string, field string, value string")


def layout(spark: SparkSession, path: str) -> DataFrame:
    """A row a spectrum with the places, lengths and types of its arrays; no array is read."""
    return spark.read.format("imzml").option("table", "layout").load(path)


def storage_duplicates(layouts: DataFrame) -> DataFrame:
    """One row (total, unique, duplicate) of arrays by where they are stored: arrays that share their bytes count once."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"{k}_offset").alias("offset"), F.col(f"{k}_bytes").alias("bytes")) for k in ("mz", "intensity"))))
    held = layouts.select("file", kinds.alias("a")).where("a.offset is not null").groupBy("file", "a").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0)).alias("total")
    return held.agg(total, F.count(F.lit(1)).alias("unique")).withColumn("duplicate", F.col("total") - F.col("unique"))
