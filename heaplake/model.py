"""A dump as DataFrames: read from the binary format or from saved tables, with the derived tables built on demand."""

from __future__ import annotations

import os
import tempfile
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import dominators, graph, resolve, stats
from .session import materialise
from .sources import hprof

#: How saved tables are ordered, so that point lookups skip row groups: (unsigned) key, then ties.
_ORDER = {
    "sub_record": "object_id", "instance": "object_id", "obj_array": "array_id", "prim_array": "array_id", "class_dump": "class_id", "gc_root": "object_id",
    "utf8_name": "name_id", "load_class": "class_id", "refs": "to_object_id", "dominator": "object_id", "retained": "object_id",
}
_PARTITIONED = {"gc_root": "root_type", "array_size": "kind"}
DERIVED = {
    "array_size": "kind string, object_id long, position long, byte_size long",
    "refs": "to_object_id long, from_object_id long, kind string",
    "dominator": "object_id long, dominator_id long",
    "retained": "object_id long, retained_bytes long",
}


class Heap:
    """One dump. ``tables``: the tables of :data:`heaplake.sources.hprof.TABLES` that there are, any derived ones included."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], id_size: int = 8):
        self.spark, self.tables, self.id_size = spark, dict(tables), id_size

    @classmethod
    def read(cls, spark: SparkSession, path: str, mode: str = "FAILFAST") -> Heap:
        tables = hprof.read_tables(spark, path, mode)
        head = tables["header"].first()
        return cls(spark, tables, head["id_size"] if head else 8)

    @classmethod
    def from_bytes(cls, spark: SparkSession, data: bytes, mode: str = "FAILFAST") -> Heap:
        """A dump held in memory, for tests: written to a temporary file that only this machine sees."""
        handle, path = tempfile.mkstemp(suffix=".hprof")
        with os.fdopen(handle, "wb") as f:
            f.write(data)
        return cls.read(spark, path, mode)

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> Heap:
        schemas = hprof.TABLES | DERIVED  # given, because a table without rows may have no files
        tables = {t: spark.read.schema(s).parquet(f"{folder}/{t}") for t, s in schemas.items() if complete(spark, f"{folder}/{t}")}
        return cls(spark, tables, tables["header"].first()["id_size"])

    def save(self, folder: str, derived: bool = True) -> dict[str, str]:
        """Write every table that isn't complete yet; returns what was done per table."""
        done = {}
        for t in [*hprof.TABLES, *(DERIVED if derived else ())]:
            path = f"{folder}/{t}"
            if complete(self.spark, path):
                done[t] = "kept"
                continue
            df = getattr(self, t) if t in DERIVED else self.tables[t]
            if t == "array_size":
                df = df.repartitionByRange("kind", F.desc("byte_size")).sortWithinPartitions("kind", F.desc("byte_size"), "object_id")
            elif t in _ORDER:
                key = S.unsigned_order(F.col(_ORDER[t]))
                df = df.repartitionByRange(key).sortWithinPartitions(key)
            writer = df.write.mode("overwrite")
            (writer.partitionBy(_PARTITIONED[t]) if t in _PARTITIONED else writer).parquet(path)
            done[t] = "written"
        return done

    def register(self, prefix: str = "") -> None:
        """Make all tables known to Spark SQL (an addition)."""
        for t, df in self.tables.items():
            df.createOrReplaceTempView(prefix + t)

    def __getitem__(self, table: str) -> DataFrame:
        return self.tables[table]

    def _or(self, table: str, build) -> DataFrame:
        if table not in self.tables:
            self.tables[table] = build()
        return self.tables[table]

    # derived tables

    @cached_property
    def names(self) -> DataFrame:
        """Class-level tables are kept once: most operators join them several times."""
        return materialise(resolve.class_names(self["load_class"], self["utf8_name"]), "names")

    @cached_property
    def layout(self) -> DataFrame:
        return materialise(resolve.class_layout(self["class_dump"], self["utf8_name"], self.id_size, self.chain), "layout")

    @cached_property
    def chain(self) -> DataFrame:
        return materialise(resolve.class_chain(self["class_dump"]), "chain")

    @cached_property
    def types(self) -> DataFrame:
        return resolve.object_types(self.names, self["instance"], self["obj_array"], self["prim_array"], self["class_dump"])

    @cached_property
    def shallow(self) -> DataFrame:
        return stats.shallow_sizes(self["instance"], self["obj_array"], self["prim_array"], self["class_dump"], self.id_size)

    @cached_property
    def sized(self) -> DataFrame:
        """object_id and shallow bytes, kept once: dominators and retained sizes both go through all objects."""
        return materialise(self.shallow.select("object_id", "shallow"), "sized")

    @cached_property
    def histogram(self) -> DataFrame:
        """Kept after the first use: the histogram is what most pages start from."""
        return stats.class_histogram(self.shallow, self.names).persist()

    @property
    def fields(self) -> DataFrame:
        return resolve.instance_fields(self["instance"], self.layout)

    @cached_property
    def strings(self) -> DataFrame:
        return resolve.java_strings(self["instance"], self.layout, self.names, self["prim_array"])

    @cached_property
    def values(self) -> DataFrame:
        return resolve.java_values(self["instance"], self.layout, self.names, self["prim_array"])

    @property
    def refs(self) -> DataFrame:
        return self._or("refs", lambda: graph.references(self["instance"], self.layout, self["class_dump"], self["obj_array"]))

    @property
    def array_size(self) -> DataFrame:
        return self._or("array_size", lambda: stats.array_sizes(self["obj_array"], self["prim_array"], self.id_size))

    @property
    def dominator(self) -> DataFrame:
        return self._or("dominator", lambda: materialise(dominators.dominators(self.sized.select("object_id"), self.refs, self["gc_root"]), "dominator"))

    @property
    def retained(self) -> DataFrame:
        return self._or("retained", lambda: dominators.retained_sizes(self.dominator, self.sized))

    @property
    def has_retained(self) -> bool:
        return "dominator" in self.tables and "retained" in self.tables


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a saved table was written to its end."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def index_folder(path: str) -> str:
    """Where a dump's tables are kept: ``x.hprof`` → ``x.indexes``."""
    return os.path.splitext(path)[0] + ".indexes"


def diff_folder(path1: str, path2: str) -> str:
    stem = os.path.splitext(os.path.basename(path2))[0]
    return f"{os.path.splitext(path1)[0]}_vs_{stem}.diff_indexes"
