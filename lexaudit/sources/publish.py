"""Tables that are published together: new folders first, then one small log entry that names them.

    root/data/<table>-<random>/...   what a publication wrote; never changed afterwards
    root/log/0000000003.json         version 3: the folders of each table, by part where a table has parts

Readers follow the latest entry, so they see all tables of a publication or none of it, and go on with the
version they started with.  A job that fails leaves folders that no entry names.  An entry is renamed into
place without overwriting, so of two writers that started from one version the second is refused.  That is atomic
where the file system's rename is (HDFS and the like).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexaudit.sources.shared import file_system

WHOLE = ""  # the part of a table without parts


class Conflict(RuntimeError):
    """Another publication came first."""


class Published:
    """The published tables under a folder."""

    def __init__(self, spark: SparkSession, root: str, kind: str = "parquet") -> None:
        self.spark, self.root, self.kind = spark, root.rstrip("/"), kind

    # -- reading --------------------------------------------------------------------------------

    def version(self) -> int:
        """The latest version; 0 before the first publication."""
        fs, at = file_system(self.spark, f"{self.root}/log")
        if not fs.exists(at):
            return 0
        names = [x.getPath().getName() for x in fs.listStatus(at)]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def entry(self, version: int | None = None) -> dict:
        """What a version (the latest unless given) holds: version, tables, summary."""
        v = self.version() if version is None else version
        if v == 0:
            return {"version": 0, "tables": {}, "summary": {}}
        fs, at = file_system(self.spark, f"{self.root}/log/{v:010d}.json")
        with_stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8"))
        finally:
            with_stream.close()

    def read(self, table: str, version: int | None = None, parts: Sequence[str] | None = None) -> DataFrame:
        """A table of a version; with parts only those of them that it has, and no file of another is opened."""
        t = self.entry(version)["tables"][table]
        schema = StructType.fromJson(t["schema"])
        folders: dict[str, list[str]] = {}
        for part, folder in t["folders"].items():
            if parts is None or part in parts:
                folders.setdefault(folder, []).append(part)
        out = None
        for folder, own in sorted(folders.items()):
            df = self.spark.read.schema(schema).format(self.kind).load(f"{self.root}/data/{folder}")
            df = df.where(F.col(t["part"]).isin(own)) if t["part"] else df
            out = df if out is None else out.unionByName(df)
        return out if out is not None else self.spark.createDataFrame([], schema)

    def parts(self, table: str, version: int | None = None) -> list[str]:
        return sorted(self.entry(version)["tables"][table]["folders"])

    # -- writing --------------------------------------------------------------------------------

    def publish(self, tables: Mapping[str, DataFrame | Callable[[Mapping[str, DataFrame]], DataFrame]], summary: Mapping | None = None, *, part: str | None = None, only: Sequence[str] | None = None, based_on: int | None = None) -> int:
        """Writes tables and publishes them as the version after based_on (the latest unless given), which is returned.

        With part, a string column, tables are laid out by it; with only, just those parts are replaced by
        the rows given, and one without rows ends.  Tables that are not given stay as they are.  A table made from
        others of the publication is given as a function of those before it, as they are read from what was written.
        """
        base = self.version() if based_on is None else based_on
        now = self.entry(base)
        entry = {"version": base + 1, "tables": dict(now["tables"]), "summary": dict(summary or {})}
        made: dict[str, DataFrame] = {}
        for name, df in tables.items():
            df = df(made) if callable(df) else df
            folder = f"{name}-{uuid.uuid4().hex}"
            # rows of a part in few tasks: else each task has a file in each part; large parts are split again
            w = (df.hint("rebalance", part) if part else df).write.option("compression", "gzip" if self.kind == "json" else "zstd").format(self.kind)
            (w.partitionBy(part) if part else w).save(f"{self.root}/data/{folder}")
            own = {p: folder for p in self._written_parts(folder, part)} if part else {WHOLE: folder}
            if only is not None:
                own = {p: f for p, f in now["tables"][name]["folders"].items() if p not in only} | own
            order = [f for f in df.schema.fields if f.name != part] + [f for f in df.schema.fields if f.name == part]
            entry["tables"][name] = {"part": part, "folders": own, "schema": StructType(order).jsonValue()}
            made[name] = self.spark.read.schema(StructType(order)).format(self.kind).load(f"{self.root}/data/{folder}")
        self._commit(entry)
        return base + 1

    def _written_parts(self, folder: str, part: str) -> list[str]:
        """The values of the part column among the folders of a written table."""
        fs, at = file_system(self.spark, f"{self.root}/data/{folder}")
        unescape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName
        names = [x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory()]
        return sorted(unescape(n.partition("=")[2]) for n in names if n.startswith(f"{part}="))

    def _commit(self, entry: dict) -> None:
        jvm = self.spark._jvm
        fs, new = file_system(self.spark, f"{self.root}/log/.{uuid.uuid4().hex}")
        fs.mkdirs(new.getParent())
        out = fs.create(new, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        target = jvm.org.apache.hadoop.fs.Path(f"{self.root}/log/{entry['version']:010d}.json")
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            files.rename(new, target, none)
        except Exception as e:
            fs.delete(new, False)
            if fs.exists(target):
                raise Conflict(f"version {entry['version']} of {self.root} is there already") from e
            raise

    def prune(self, keep: int = 2) -> list[str]:
        """Removes the folders that none of the last ``keep`` versions names, those of failed jobs too; no writer may be at work."""
        last = self.version()
        named = {f for v in range(max(1, last - keep + 1), last + 1) for t in self.entry(v)["tables"].values() for f in t["folders"].values()}
        fs, at = file_system(self.spark, f"{self.root}/data")
        gone = sorted(x.getPath().getName() for x in (fs.listStatus(at) if fs.exists(at) else []) if x.getPath().getName() not in named)
        for name in gone:
            fs.delete(file_system(self.spark, f"{self.root}/data/{name}")[1], True)
        return gone
