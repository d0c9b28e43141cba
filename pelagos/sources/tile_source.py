"""A data source of tiles: one JSON file a tile, one partition a tile, only those that are asked for.

    register(spark)
    spark.read.format("marine_tiles").option("tiles", manifest_json).option("box", "south,north,west,east").load(folder)

`tiles` is the manifest's list of tiles (a JSON array, or all files of the folder where it is not given), `box` a rectangle
that tiles have to touch, `step` a tile's width in degrees. Filters on the column `tile` (equality, IN) are pushed to the list
of files, so that no other file is opened. A tile that the list names but the folder does not hold gives no rows.
Folders may lie wherever pyarrow's file systems reach. Writing takes rows (tile, body): a task writes under a name of its
own and the driver renames what committed tasks wrote, so that a failed or repeated attempt leaves no tile.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from pelagos.sources.tiles import FIELDS

SCHEMA = "tile STRING, cell INT, lat DOUBLE, lon DOUBLE, " + ", ".join(f"{f} ARRAY<INT>" for f in FIELDS)


def _folder(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets filters reach it."""
    spark.dataSource.register(TileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


@dataclass
class TilePartition(InputPartition):
    tile: str


@dataclass
class Written(WriterCommitMessage):
    files: list


class TileSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "marine_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TileReader:
        return TileReader(dict(self.options), [f.name for f in schema.fields])

    def writer(self, schema: StructType, overwrite: bool) -> TileWriter:
        return TileWriter(dict(self.options))


class TileReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns = options["path"], columns
        self.listed = json.loads(options["tiles"]) if "tiles" in options else None
        self.box = [float(x) for x in options["box"].split(",")] if "box" in options else None
        self.step = float(options.get("step", 10))
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("tile",):
                names = {f.value}
            elif isinstance(f, In) and f.attribute == ("tile",):
                names = set(f.value)
            else:
                yield f
                continue
            self.wanted = names if self.wanted is None else self.wanted & names

    def _touches(self, tile: str) -> bool:
        south, north, west, east = self.box
        lat, lon = (float(x) for x in tile.split("_")[1:])
        return lat <= north and lat + self.step > south and any(lon + turn <= east and lon + turn + self.step > west for turn in (-360, 0, 360))

    def partitions(self) -> list[TilePartition]:
        tiles = self.listed
        if tiles is None:
            from pyarrow import fs

            where, folder = _folder(self.path)
            tiles = sorted(i.base_name[:-5] for i in where.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if i.base_name.endswith(".json"))
        return [TilePartition(t) for t in dict.fromkeys(tiles) if (self.wanted is None or t in self.wanted) and (self.box is None or self._touches(t))]

    def read(self, partition: TilePartition) -> Iterator[tuple]:
        if partition is None:  # no tile is asked for
            return
        where, folder = _folder(self.path)
        try:
            with where.open_input_stream(f"{folder}/{partition.tile}.json") as f:
                tile = json.loads(f.read())
        except FileNotFoundError:
            return
        for cell, lat in enumerate(tile["lat"]):
            own = {"tile": partition.tile, "cell": cell, "lat": float(lat), "lon": float(tile["lon"][cell])}
            yield tuple(own[c] if c in own else tile[c][cell] if tile.get(c) is not None else None for c in self.columns)


class TileWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.run = options["path"], uuid.uuid4().hex

    def write(self, rows: Iterator) -> Written:
        where, folder = _folder(self.path)
        where.create_dir(folder, recursive=True)
        files = []
        for row in rows:
            own = f"{folder}/.{row.tile}.{self.run}.{uuid.uuid4().hex}"
            with where.open_output_stream(own) as f:
                f.write(row.body.encode())
            files.append((own, f"{folder}/{row.tile}.json"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        where, _ = _folder(self.path)
        for m in messages:
            for own, final in m.files if m else []:
                where.move(own, final)

    def abort(self, messages: list[Written | None]) -> None:
        where, _ = _folder(self.path)
        for m in messages:
            for own, _ in m.files if m else []:
                where.delete_file(own)
