"""Tables to which streams append batch by batch, read through a list of live folders.

Every batch is written to a folder of its own. The list says which folders count, and up to which
batch each checkpoint (by the id that Spark keeps in it) has been taken in, so

* a batch that is replayed after its commit is skipped, one that is replayed before writes the
  same folder again,
* a new checkpoint begins at batch 0 without overwriting anything: folders are numbered by commits,
* `fan` folders of one level are merged into one of the next, until a folder holds `largest` rows, so
  the number of small folders grows with the logarithm of the number of batches and each row is
  written again that often.

The list is one small file, written in turn to SLOTS places; the newest complete one counts. A folder
that was merged is emptied after SLOTS further commits, so readers of an older list still
find it. Each row carries `seq`, the number of its commit, which later batches have higher. One writer
at a time; any number of readers.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAN = 10
LARGEST = 50_000_000
SLOTS = 8
_LIST = "version bigint, kind string, name string, number bigint, level int, n_rows bigint"


class Folder(NamedTuple):
    number: int
    level: int
    n_rows: int


def due(folders: list[Folder], fan: int = FAN, largest: int = LARGEST) -> list[Folder]:
    """The oldest folders of one level that are to be merged now, or none."""
    by_level = defaultdict(list)
    for folder in sorted(folders):
        if folder.n_rows < largest:
            by_level[folder.level].append(folder)
    for level in sorted(by_level):
        if len(by_level[level]) >= fan:
            return by_level[level][:fan]
    return []


class AppendTable:
    """The table below `path`; `checkpoint` is that of the stream that appends."""

    def __init__(
        self, spark: SparkSession, path: str, checkpoint: str | None = None,
        fan: int = FAN, largest: int = LARGEST,
    ):
        self.spark, self.path, self.checkpoint = spark, path, checkpoint
        self.fan, self.largest = fan, largest
        self.source: str | None = None
        self.version = 0
        self.live: list[Folder] = []
        self.dead: dict[int, int] = {}  # folder: version since which it is merged
        self.taken: dict[str, int] = {}  # checkpoint id: its last batch
        self._load()

    def _load(self) -> None:
        """The newest list; it has a row per folder and per checkpoint."""
        lists = self.spark.read.schema(_LIST + ", slot int").option("ignoreMissingFiles", True)
        try:
            lists = lists.parquet(f"{self.path}/list")
        except AnalysisException:
            return
        newest = lists.agg(F.max("version")).first()[0]
        if newest is None:
            return
        self.version = newest
        for row in lists.where(F.col("version") == newest).collect():
            if row["kind"] == "live":
                self.live.append(Folder(row["number"], row["level"], row["n_rows"]))
            elif row["kind"] == "dead":
                self.dead[row["number"]] = row["n_rows"]
            elif row["kind"] == "source":
                self.taken[row["name"]] = row["number"]

    def _commit(self) -> None:
        self.version += 1
        expired = [n for n, since in self.dead.items() if since <= self.version - SLOTS]
        for number in expired:
            del self.dead[number]
        rows = [
            *[(self.version, "live", None, *f) for f in self.live],
            *[(self.version, "dead", None, n, None, since) for n, since in self.dead.items()],
            *[(self.version, "source", s, n, None, None) for s, n in self.taken.items()],
        ]
        where = f"{self.path}/list/slot={self.version % SLOTS}"
        self.spark.createDataFrame(rows, _LIST).coalesce(1).write.mode("overwrite").parquet(where)
        for number in expired:
            nothing = self.spark.createDataFrame([], "seq bigint").coalesce(1)
            nothing.write.mode("overwrite").parquet(self._folder(number))

    def _folder(self, number: int) -> str:
        return f"{self.path}/data/{number}"

    def _write(self, rows: DataFrame, level: int) -> Folder:
        """Write what the next commit will add."""
        number = self.version + 1
        rows.write.mode("overwrite").parquet(self._folder(number))
        many = rows.sparkSession.read.parquet(self._folder(number)).count()
        return Folder(number, level, many)

    def append(
        self, batch: DataFrame, batch_id: int, beside: Callable[[DataFrame, int], None] | None = None
    ) -> bool:
        """Take a batch in, once; False if it was before. `beside` gets the written rows and their `seq`
        before the commit and must give the same when it is called again with them."""
        if self.source is None:
            self.source = self.spark.read.json(f"{self.checkpoint}/metadata").first()["id"]
        if batch_id <= self.taken.get(self.source, -1):
            return False
        seq = self.version + 1
        new = self._write(batch.withColumn("seq", F.lit(seq).cast("bigint")), 0)
        if beside is not None:
            fresh = batch.sparkSession.read.schema(batch.schema).parquet(self._folder(seq))
            beside(fresh, seq)
        self.live.append(new)
        self.taken[self.source] = batch_id
        self._commit()
        while old := due(self.live, self.fan, self.largest):
            rows = self._read(old).hint("rebalance")
            merged = self._write(rows, old[0].level + 1)
            self.live = [*(f for f in self.live if f not in old), merged]
            self.dead.update({f.number: self.version + 1 for f in old})
            self._commit()
        return True

    def _read(self, folders: list[Folder]) -> DataFrame:
        paths = [self._folder(f.number) for f in folders]
        return self.spark.read.option("mergeSchema", True).parquet(*paths)

    def read(self) -> DataFrame:
        """All rows taken in, with `seq`."""
        if not self.live:
            raise FileNotFoundError(f"nothing was appended to {self.path}")
        return self._read(self.live)
