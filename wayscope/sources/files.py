"""Files through Spark's Python data sources: documents written one a file, and large GPX files read by many tasks.

Register both on a session with register(spark); paths are local, or any that Arrow's file systems know by their scheme.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from xml.sax.saxutils import unescape

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..schemas import POINT_TYPES

MANIFEST = "_manifest.json"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the plain path of a path or URI."""
    return fs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]*:", path) else (fs.LocalFileSystem(), path)


class _Written(WriterCommitMessage):
    def __init__(self, files: list[dict]):
        self.files = files


class _DocumentWriter(DataSourceWriter):
    """A task writes its documents under names of its own; commit gives them theirs and lists them all, and abort leaves nothing."""

    def __init__(self, path: str, indent: int):
        self.path, self.indent, self.job = path.rstrip("/"), indent, uuid.uuid4().hex

    @property
    def _staged(self) -> str:
        return f"{self.path}/_staged-{self.job}"

    def write(self, rows: Iterator) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, at = _store(self._staged)
        store.create_dir(at, recursive=True)
        attempt, done = TaskContext.get().taskAttemptId(), []
        for n, row in enumerate(rows):
            name = row["file_name"]
            if not name or "/" in name or name.startswith("_"):
                raise ValueError(f"not a name for a document's file: {name!r}")
            body = (json.dumps(json.loads(row["json"]), indent=self.indent, ensure_ascii=False) if self.indent else row["json"]).encode()
            with store.open_output_stream(f"{at}/{attempt}-{n}") as out:
                out.write(body)
            done.append({"file": name, "bytes": len(body), "staged": f"{attempt}-{n}"})
        return _Written(done)

    def commit(self, messages: list) -> None:
        store, at = _store(self.path)
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["file"])
        names = [f["file"] for f in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("several documents would be written to one file")
        store.create_dir(at, recursive=True)
        for f in files:
            store.move(f"{at}/_staged-{self.job}/{f.pop('staged')}", f"{at}/{f['file']}")
        # The manifest comes last: without it, a folder is not finished.
        with store.open_output_stream(f"{at}/{MANIFEST}") as out:
            out.write(json.dumps({"count": len(files), "files": files}, indent=2).encode())
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        store, at = _store(self._staged)
        if store.get_file_info(at).type != fs.FileType.NotFound:
            store.delete_dir(at)


class DocumentFiles(DataSource):
    """df.write.format("audit_documents").option("indent", 2).mode("append").save(folder): file_name and json of each row as a file of its own; with
    indent 0 the text as it is, whatever it holds."""

    @classmethod
    def name(cls) -> str:
        return "audit_documents"

    def schema(self) -> str:
        return "file_name string, json string"

    def writer(self, schema: object, overwrite: bool) -> DataSourceWriter:
        return _DocumentWriter(self.options["path"], int(self.options.get("indent", 2)))


# Point elements: any prefix, attributes in either quotes.
_START = re.compile(rb"<((?:[\w.-]+:)?)(wpt|rtept|trkpt)(?=[\s/>])")
_ATTRIBUTE = re.compile(r"""([\w.:-]+)\s*=\s*("[^"]*"|'[^']*')""")
_FOUND = "file_name string, split bigint, point_type string, place bigint, raw_lat string, raw_lon string, raw_ele string, raw_time string, extensions string"
_COUNTS = "file_name string, split bigint, point_type string, place bigint"
_MORE = 1 << 16


class _Split(InputPartition):
    def __init__(self, path: str, number: int, start: int, end: int):
        self.path, self.number, self.start, self.end = path, number, start, end


def _plain(text: str | None) -> str | None:
    """Character data of an element: without tags, with entities read."""
    if text is None:
        return None
    parts = re.split(r"<!\[CDATA\[(.*?)\]\]>", text, flags=re.S)
    read = lambda t: re.sub(r"&#(x[0-9a-fA-F]+|[0-9]+);", lambda m: chr(int(m[1][1:], 16) if m[1][0] == "x" else int(m[1])), unescape(re.sub(r"<[^>]*>", "", t), {"&quot;": '"', "&apos;": "'"}))
    return "".join(t if i % 2 else read(t) for i, t in enumerate(parts))


def point_of(element: str) -> tuple[str | None, ...]:
    """raw_lat, raw_lon, raw_ele, raw_time and extensions of a point element's text."""
    element = re.sub(r"<!--.*?-->", "", element, flags=re.S)
    head, _, inside = element.partition(">")
    own = {k: _plain(v[1:-1]) for k, v in _ATTRIBUTE.findall(head)}

    def child(name: str, text: str) -> tuple[str | None, str]:
        m = re.search(rf"<((?:[\w.-]+:)?){name}(?:\s[^>]*)?(?:/>|>(.*?)</\1{name}\s*>)", text, re.S)
        return (None, text) if m is None else (m[2] or "", text[: m.start()] + text[m.end() :])

    extensions, inside = child("extensions", inside)
    ele, inside = child("ele", inside)
    time, _ = child("time", inside)
    time = _plain(time)
    return own.get("lat"), own.get("lon"), _plain(ele), None if time is None else time.strip(), extensions


class _PointReader(DataSourceReader):
    """Files cut into ranges of bytes; a point belongs to the range that its first byte lies in, so a range is read a little past its end."""

    def __init__(self, path: str, split: int, counts: bool):
        self.path, self.split, self.counts = path, split, counts

    def partitions(self) -> list[InputPartition]:
        store, at = _store(self.path)
        info = store.get_file_info(at)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at))
        files = sorted((f for f in files if f.type == fs.FileType.File and f.path.endswith(".gpx")), key=lambda f: f.path)
        return [_Split(f.path, n, a, min(f.size, a + self.split)) for f in files for n, a in enumerate(range(0, max(1, f.size), self.split))]

    def _elements(self, store: fs.FileSystem, part: _Split) -> Iterator[tuple[str, str]]:
        """Kind and text of each point element that begins in a range; the text of one element is held past the range."""
        with store.open_input_file(part.path) as source:
            size = source.size()
            source.seek(part.start)
            held, upto = source.read(part.end - part.start + 32), part.end - part.start  # a name may cross the end
            for m in _START.finditer(held):
                if m.start() >= upto:
                    break
                close, at = re.compile(rb"</" + re.escape(m[1] + m[2]) + rb"\s*>"), m.start()
                while True:
                    head = held.find(b">", at)
                    if head > 0 and held[head - 1 : head] == b"/":
                        end = head + 1
                        break
                    if head > 0 and (found := close.search(held, head)):
                        end = found.end()
                        break
                    if part.start + len(held) >= size:
                        raise ValueError(f"a point that does not end in {part.path}")
                    source.seek(part.start + len(held))
                    held += source.read(_MORE)
                yield m[2].decode(), held[at:end].decode("utf-8")

    def read(self, part: _Split) -> Iterator[tuple]:
        store, _ = _store(self.path)
        name = part.path.rsplit("/", 1)[-1]
        seen = dict.fromkeys(POINT_TYPES, 0)
        for kind, element in self._elements(store, part):
            if not self.counts:
                yield (name, part.number, kind, seen[kind], *point_of(element))
            seen[kind] += 1
        if self.counts:
            for kind, n in seen.items():
                if n:
                    yield name, part.number, kind, n


class GpxPoints(DataSource):
    """spark.read.format("gpx_points").option("split", bytes).load(folder or file): a row per point element of each .gpx file, with its place among the
    points of its kind in its range; option("counts", "true"): how many of each kind there are instead, as place."""

    @classmethod
    def name(cls) -> str:
        return "gpx_points"

    def _counts(self) -> bool:
        return self.options.get("counts", "false") == "true"

    def schema(self) -> str:
        return _COUNTS if self._counts() else _FOUND

    def reader(self, schema: object) -> DataSourceReader:
        return _PointReader(self.options["path"], int(self.options.get("split", 64 << 20)), self._counts())


def register(spark: SparkSession) -> None:
    for source in (DocumentFiles, GpxPoints):
        spark.dataSource.register(source)


def write_documents(documents: DataFrame, path: str, indent: int = 2) -> None:
    """One indented file per document of audit_documents() in a folder, named after its source (name.audit.v2.json), and a manifest of all of them."""
    register(documents.sparkSession)
    name = F.concat(F.regexp_replace(F.coalesce("metadata.source.fileName", "track_id"), r"\.[^.]*$", ""), F.lit(".audit.v2.json"))
    text = F.to_json(F.struct("metadata", "audit"), {"ignoreNullFields": "false"})
    documents.select(name.alias("file_name"), text.alias("json")).write.format("audit_documents").option("indent", indent).mode("append").save(path)


def write_gpx_files(gpx: DataFrame, path: str) -> None:
    """What to_gpx() gives as one file per track in a folder, and a manifest of all of them."""
    register(gpx.sparkSession)
    gpx.select("file_name", F.col("xml").alias("json")).write.format("audit_documents").option("indent", 0).mode("append").save(path)


def split_points(spark: SparkSession, path: str, split: int = 64 << 20) -> DataFrame:
    """Found points of .gpx files of any size, each read by as many tasks as it has ranges of split bytes.

    gpx_index runs over waypoints, then route points, then track points of a file, as from found_points(): a point's place in its range goes up
    by the counts of the ranges and kinds before it. Files are UTF-8 and well-formed, which isn't checked; point elements inside comments or CDATA
    would be taken as such.
    """
    register(spark)
    read = spark.read.format("gpx_points").option("split", split)
    kind = F.array_position(F.array(*map(F.lit, POINT_TYPES)), F.col("point_type"))
    order = Window.partitionBy("file_name").orderBy(kind, "split").rowsBetween(Window.unboundedPreceding, -1)
    before = read.option("counts", "true").load(path).withColumn("before", F.coalesce(F.sum("place").over(order), F.lit(0))).drop("place")
    points = spark.read.format("gpx_points").option("split", split).load(path).join(before, ["file_name", "split", "point_type"])
    return points.select(
        F.regexp_replace("file_name", r"\.[^.]*$", "").alias("track_id"), "file_name", (F.col("before") + F.col("place")).alias("gpx_index"), "point_type", "raw_lat", "raw_lon", "raw_ele", "raw_time", "extensions",
    )
