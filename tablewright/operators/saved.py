"""Fitted models that outlive their session: plain values as JSON, tables as Parquet beside it, inner models in folders of their own."""

from __future__ import annotations

import json
from importlib import import_module

from pyspark.ml import Model
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql.types import StructType


def reference(fn) -> str:
    """``module:name`` of a function that another session can import."""
    name = f"{fn.__module__}:{fn.__qualname__}"
    if "<" in name or fn.__module__ == "__main__":
        raise ValueError(f"{name} cannot be saved: give a function of a module")
    return name


def resolved(name: str):
    module, path = name.split(":")
    found = import_module(module)
    for part in path.split("."):
        found = getattr(found, part)
    return found


class Saved(MLWritable, MLReadable):
    """What a stage is made of, all of it saved: ``stats`` (plain values), ``tables``, ``stages`` (models) and ``functions`` (of modules), by name."""

    def keep(self, stats=None, tables=None, stages=None, functions=None):
        self.stats, self.tables, self.stages, self.functions = stats or {}, tables or {}, stages or {}, functions or {}

    def write(self):
        return SavedWriter(self)

    @classmethod
    def read(cls):
        return SavedReader(cls)

    @classmethod
    def restored(cls, stats, tables, stages, functions):
        out = cls.__new__(cls)
        super(Saved, out).__init__()
        out.keep(stats, tables, stages, functions)
        return out


class SavedWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path):
        """Metadata come last, so that a save that broke off cannot be loaded."""
        own = self.instance
        functions = {name: reference(fn) for name, fn in own.functions.items()}
        for name, df in own.tables.items():
            df.write.parquet(f"{path}/tables/{name}")
        for name, stage in own.stages.items():
            stage.write().save(f"{path}/stages/{name}")
        schemas = {name: df.schema.json() for name, df in own.tables.items()}
        extra = {"stats": own.stats, "tables": schemas, "stages": list(own.stages), "functions": functions}
        DefaultParamsWriter.saveMetadata(own, path, self.sparkSession, extra)


class SavedReader(MLReader):
    def __init__(self, kind):
        super().__init__()
        self.kind = kind

    def load(self, path):
        spark = self.sparkSession
        meta = DefaultParamsReader.loadMetadata(path, spark)
        schemas = {name: StructType.fromJson(json.loads(text)) for name, text in meta["tables"].items()}
        tables = {name: spark.read.schema(schema).parquet(f"{path}/tables/{name}") for name, schema in schemas.items()}
        stages = {name: DefaultParamsReader.loadParamsInstance(f"{path}/stages/{name}", spark) for name in meta["stages"]}
        out = self.kind.restored(meta["stats"], tables, stages, {name: resolved(f) for name, f in meta["functions"].items()})
        out._resetUid(meta["uid"])
        return out


class Fitted(Saved, Model):
    """A model made of what its ``fit`` found."""

    def __init__(self, stats=None, tables=None, stages=None, functions=None):
        super().__init__()
        self.keep(stats, tables, stages, functions)
