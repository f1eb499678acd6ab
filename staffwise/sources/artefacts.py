"""Versioned model artefacts in the shared folder (SNK4): fitted pipelines and coefficient tables.

A writer first takes the next free version number (a file that only one writer can create), writes the
artefact into that version's folder, and then publishes it by an empty marker. A reader sees published versions
only: a job that is lost half way uses up a number and leaves nothing that can be loaded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


class Artefacts:
    """Named, numbered artefacts below ``root``, which all executors must share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _numbers(self, folder: str) -> list[int]:
        p = self._path(folder)
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(p)) if self._fs.exists(p) else []

    def _take(self, path: str) -> bool:
        """Create an empty file; False if there is one already."""
        try:
            self._fs.create(self._path(path), False).close()
        except Exception:  # noqa: BLE001  the exception of whatever file system it is
            if self._fs.exists(self._path(path)):
                return False
            raise
        return True

    def versions(self, name: str) -> list[int]:
        """Published versions, oldest first."""
        return self._numbers(f"{self.root}/{name}/published")

    def _save(self, name: str, write: Callable[[str], None]) -> int:
        base = f"{self.root}/{name}"
        version = max(self._numbers(f"{base}/taken"), default=0) + 1
        while not self._take(f"{base}/taken/{version:08d}"):
            version += 1
        write(f"{base}/data/{version:08d}")
        self._take(f"{base}/published/{version:08d}")
        return version

    def _folder(self, name: str, version: int | None) -> str:
        found = self.versions(name)
        version = version if version is not None else max(found, default=None)
        if version not in found:
            raise FileNotFoundError(f"no artefact {name} of version {version}")
        return f"{self.root}/{name}/data/{version:08d}"

    def save_model(self, name: str, model: PipelineModel) -> int:
        return self._save(name, lambda path: model.write().save(path))

    def load_model(self, name: str, version: int | None = None) -> PipelineModel:
        """The model as of ``version``, the latest by default."""
        return PipelineModel.load(self._folder(name, version))

    def save_table(self, name: str, table: DataFrame) -> int:
        return self._save(name, lambda path: table.write.parquet(path))

    def load_table(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self._folder(name, version))
