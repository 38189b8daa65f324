"""A folder of datasets under their standard names; datasets may be missing."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, is_dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from kinweave.runtime import exists, remove
from kinweave.sources.schemas import SCHEMAS


def clean_path(path: str) -> str:
    return path if path.endswith("/") else path + "/"


@dataclass(frozen=True)
class Workspace:
    """Datasets by name. with_() gives a new workspace; write() stores some and gives one that reads them from the folder.

    Text workspaces are space-separated lines for interchange, where labels hold no spaces; `swapped` exchanges the names of
    and-concepts and and-concept-lengths, as some existing folders have them.
    """

    spark: SparkSession
    path: str | None = None
    form: str = "parquet"
    swapped: bool = False
    data: dict[str, DataFrame] = field(default_factory=dict)

    def _file(self, name: str) -> str:
        pair = {"and-concepts": "and-concept-lengths", "and-concept-lengths": "and-concepts"}
        return clean_path(self.path) + (pair.get(name, name) if self.swapped else name)

    @classmethod
    def load(cls, spark: SparkSession, path: str, form: str = "parquet", swapped: bool = False) -> Workspace:
        own = cls(spark, path, form, swapped)
        return replace(own, data={name: df for name in SCHEMAS if (df := own._read(name)) is not None})

    def _read(self, name: str) -> DataFrame | None:
        file = self._file(name)
        if not exists(self.spark, file):
            return None
        reader = self.spark.read.schema(SCHEMAS[name])
        return reader.parquet(file) if self.form == "parquet" else reader.option("sep", " ").csv(file)

    def __getitem__(self, name: str) -> DataFrame | None:
        if name not in SCHEMAS:
            raise KeyError(name)
        return self.data.get(name)

    def with_(self, **datasets: DataFrame) -> Workspace:
        named = {k.replace("_", "-"): v for k, v in datasets.items()}
        if unknown := set(named) - set(SCHEMAS):
            raise KeyError(f"unknown datasets {sorted(unknown)}")
        return replace(self, data=self.data | named)

    def write(self, compress: bool = False, **datasets: DataFrame) -> Workspace:
        """Replace only the datasets passed. Each is written beside its old version first, since it may be made from it."""
        out = self.with_(**datasets)
        for key in datasets:
            name = key.replace("_", "-")
            final, beside = self._file(name), self._file(name) + ".new"
            rows = out.data[name].select(*[c.split()[0] for c in SCHEMAS[name].split(", ")])
            if self.form == "parquet":
                rows.write.mode("overwrite").parquet(beside)
            else:
                rows.write.mode("overwrite").option("sep", " ").option("compression", "gzip" if compress else "none").csv(beside)
            remove(self.spark, final)
            fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
            fs_path(beside).getFileSystem(self.spark._jsc.hadoopConfiguration()).rename(fs_path(beside), fs_path(final))
        return replace(self, data=self.data | {k.replace("_", "-"): self._read(k.replace("_", "-")) for k in datasets})

    def inspect(self, n: int = 5) -> dict[str, list | None]:
        """Up to n rows of each dataset, or None where it is missing."""
        return {name: [tuple(r) for r in self.data[name].take(n)] if name in self.data else None for name in SCHEMAS}

    def write_parameters(self, settings, name: str = "parameters") -> None:
        """Settings and the time as one JSON line."""
        values = asdict(settings) if is_dataclass(settings) else dict(settings)
        line = json.dumps({"time": datetime.now(UTC).isoformat()} | {k: v if isinstance(v, int | float | str | bool | None) else str(v) for k, v in values.items()})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(clean_path(self.path) + name)
