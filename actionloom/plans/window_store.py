"""Window statistics that are kept up to date day by day.

The store keeps, per day, what the windows are made of: sums and counts per (key, day) and
the distinct (user, item) pairs. A new day writes its own partition of these tables and
rebuilds the statistics of the target days that it feeds, from the days in their windows;
all other partitions stay as they are. Every write replaces whole partitions, so adding a day
again, after a failure or with corrected rows, gives the same as adding it once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from actionloom.operators.windows import (
    entity_day_partials, entity_stats_of_partials, rolling_day_partials, rolling_stats_of_partials,
    with_watch_rates,
)
from actionloom.session import discard, stored
from actionloom.spec import FeatureSpec


@dataclass(frozen=True)
class WindowStore:
    """Statistics below ``path``. ``rolling`` names the key sets of rolling statistics to keep;
    with any, added rows need the watch signals. ``items`` gives the durations for item rates."""

    spark: SparkSession
    path: str
    spec: FeatureSpec
    items: DataFrame | None = None
    rolling: Sequence[Sequence[str]] = ()

    def add(self, log: DataFrame) -> list[int]:
        """Take in all rows of the days in ``log``; the target days that were rebuilt.

        ``log`` holds whole days. A day that is in the store already is replaced by them.
        """
        spec = self.spec
        fresh = stored(log.filter(F.col(spec.day).isNotNull()))
        days = sorted(r[0] for r in fresh.select(spec.day).distinct().collect())  # one number per day
        if not days:
            discard(fresh)
            return []
        # Partials of every day are kept, whether they feed a target of today's spec or not.
        every = replace(spec, first_target=days[0] + 1, last_day=days[-1] + spec.n_day)
        for entity in ("user", "item"):
            self._replace(entity_day_partials(fresh, entity, every), f"{entity}_days", days)
        self._replace(fresh.select(spec.user, spec.item, spec.day).distinct(), "pairs", days)
        for keys in self.rolling:
            self._replace(rolling_day_partials(fresh, keys, every), self._rolling_name(keys, "days"), days)
        discard(fresh)

        fed = (range(max(d + 1, spec.first_target), min(d + spec.n_day, spec.last_day) + 1) for d in days)
        targets = sorted({t for span in fed for t in span})
        if targets:
            self._rebuild(targets)
        return targets

    def _rebuild(self, targets: list[int]) -> None:
        spec = replace(self.spec, first_target=targets[0], last_day=targets[-1])
        wanted = F.col(spec.day).isin(targets)
        pairs = self._read("pairs", spec)
        for entity in ("user", "item"):
            stats = entity_stats_of_partials(self._read(f"{entity}_days", spec), pairs, entity, spec).filter(wanted)
            if entity == "item" and self.items is not None:
                stats = with_watch_rates(stats, self.items, spec)
            self._replace(stats, f"{entity}_stats", targets)
        for keys in self.rolling:
            partials = self._read(self._rolling_name(keys, "days"), spec)
            self._replace(rolling_stats_of_partials(partials, keys, spec).filter(wanted),
                          self._rolling_name(keys, "stats"), targets)

    def _read(self, name: str, spec: FeatureSpec) -> DataFrame:
        """The days that lie in the windows; partitions of other days are not read."""
        return self._table(name).filter(F.col(spec.day).between(spec.first_target - spec.n_day, spec.last_day - 1))

    def _replace(self, df: DataFrame, name: str, days: Sequence[int]) -> None:
        """Write ``df`` as the whole content of the partitions of ``days``."""
        path = f"{self.path}/{name}"
        if not self._files(f"{path}_schema"):  # a table without any row has no file to read its columns from
            df.limit(0).write.mode("overwrite").parquet(f"{path}_schema")
        before = {d: self._files(f"{path}/{self.spec.day}={d}") for d in days}
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.spec.day).parquet(path)
        # A day that has no rows any more is not written, so its old files would stay.
        for d, files in before.items():
            folder = f"{path}/{self.spec.day}={d}"
            if files and self._files(folder) == files:
                self._file_system(folder).delete(self._hadoop_path(folder), True)

    def _hadoop_path(self, folder: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)

    def _file_system(self, folder: str):
        return self._hadoop_path(folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _files(self, folder: str) -> set[str]:
        """Names of data files; they differ from write to write."""
        system, at = self._file_system(folder), self._hadoop_path(folder)
        return {f.getPath().getName() for f in system.listStatus(at)} if system.exists(at) else set()

    @staticmethod
    def _rolling_name(keys: Sequence[str], kind: str) -> str:
        return f"rolling_{'_'.join(keys)}_{kind}"

    def _table(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.path}/{name}_schema").schema
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def user_stats(self) -> DataFrame:
        return self._table("user_stats")

    def item_stats(self) -> DataFrame:
        return self._table("item_stats")

    def rolling_stats(self, keys: Sequence[str]) -> DataFrame:
        return self._table(self._rolling_name(keys, "stats"))
