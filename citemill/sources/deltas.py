"""A small keyed table on disk, kept as numbered deltas and now and then a folded base.

    <root>/v=N/         rows that change N brought
    <root>/base/v=N/    the current row of every key as of change N

A change costs what it brings: a folder of its own, never a rewrite. Readers take the
last base and the deltas after it and keep the row with the greatest order per key.
``fold`` writes a new base, ``vacuum`` deletes what a base has made superfluous. All
folders count only once they were written to the end.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citemill.sources.paths import create_once, delete, exists, finished_versions, folder_times

#: Deltas after which a change also folds; a fold's cost is shared by so many changes.
FOLD_AFTER = 64
#: How long a writer that took a number may need; a base waits for it so long.
CLAIM_SECONDS = 86_400


class DeltaLog:
    """``schema`` has the ``key`` column; ``order`` are the columns that say which row of a key counts,
    the greatest one. The number of the delta decides last."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, order: tuple[str, ...] = ()):
        self.spark, self.root, self.schema, self.key, self.order = spark, root.rstrip("/"), schema, key, order

    def numbers(self) -> list[int]:
        return finished_versions(self.spark, self.root)

    def bases(self) -> list[int]:
        return finished_versions(self.spark, f"{self.root}/base")

    def last(self) -> int:
        """Number of the last finished change, -1 when there is none."""
        return max(self.numbers() + self.bases(), default=-1)

    def claim(self) -> int:
        """A number that no other writer has or will get, above all finished ones.

        Whoever creates the number's file first has it. On stores without an atomic
        create, writers must not overlap.
        """
        number = self.last() + 1
        while not create_once(self.spark, f"{self.root}/claims/{number}"):
            number += 1
        return number

    def append(self, rows: DataFrame, number: int, fold_after: int = FOLD_AFTER) -> None:
        """Write delta ``number``; this is what makes the change visible."""
        if number <= max(self.bases(), default=-1):
            raise RuntimeError(f"change {number} of {self.root} took so long that a base was written without it")
        rows.write.mode("overwrite").parquet(f"{self.root}/v={number}")
        if len([n for n in self.numbers() if n > max(self.bases(), default=-1)]) >= fold_after:
            self.fold()

    def _deltas(self, numbers: list[int]) -> DataFrame:
        paths = [f"{self.root}/v={n}" for n in numbers]
        read = self.spark.read.schema(f"{self.schema}, v bigint").option("basePath", self.root).parquet(*paths)
        return read.withColumnRenamed("v", "number")

    def sizes(self, numbers: list[int]) -> dict[int, int]:
        """Rows of these deltas, of those that are still there."""
        there = sorted(set(numbers) & set(self.numbers()))
        if not there:
            return {}
        return {r.number: r.n for r in self._deltas(there).groupBy("number").agg(F.count("*").alias("n")).collect()}

    def entries(self, upto: int | None = None) -> DataFrame:
        """All rows of the base and of the deltas after it, with the ``number`` they came with."""
        base = max((n for n in self.bases() if upto is None or n <= upto), default=None)
        later = [n for n in self.numbers() if (upto is None or n <= upto) and (base is None or n > base)]
        if upto is not None and base is None and self.bases() and (not later or min(later) > 0):
            raise FileNotFoundError(f"change {upto} of {self.root} was vacuumed")
        empty = self.spark.createDataFrame([], self.schema).withColumn("number", F.lit(-1).cast("bigint"))
        frames = [empty]
        if base is not None:
            folded = self.spark.read.schema(self.schema).parquet(f"{self.root}/base/v={base}")
            frames.append(folded.withColumn("number", F.lit(base).cast("bigint")))
        if later:
            frames.append(self._deltas(later))
        return reduce(DataFrame.unionByName, frames[1:] or frames)

    def current(self, upto: int | None = None) -> DataFrame:
        """One row per key; a null key is a key."""
        rows = self.entries(upto)
        others = [c for c in rows.columns if c not in (self.key, "number")]
        newest = F.max_by(F.struct(*others), F.struct(*self.order, "number"))
        return rows.groupBy(self.key).agg(newest.alias("row")).select(self.key, "row.*")

    def _open_claims(self) -> list[int]:
        """Numbers that a writer took lately and has not finished."""
        done, now = set(self.numbers()), time.time()
        claims = {int(path.rsplit("/", 1)[1]): t for path, t in folder_times(self.spark, f"{self.root}/claims").items() if path[-1].isdigit()}
        return [n for n, t in claims.items() if n not in done and now - t < CLAIM_SECONDS]

    def fold(self) -> int:
        """Write a base of all changes below the first that is still being written."""
        newest = max(self.bases(), default=-1)
        last = min([self.last(), *(n - 1 for n in self._open_claims() if n > newest)])
        if last > newest:
            self.current(last).write.mode("overwrite").parquet(f"{self.root}/base/v={last}")
        return last

    def vacuum(self, min_age_seconds: float) -> int:
        """Delete deltas that the last base holds, older bases and their claims, if old enough; returns how many."""
        base, now = max(self.bases(), default=-1), time.time()
        old = [f"{self.root}/v={n}" for n in self.numbers() if n <= base]
        old += [f"{self.root}/base/v={n}" for n in self.bases() if n < base]
        times = folder_times(self.spark, self.root) | folder_times(self.spark, f"{self.root}/base")
        gone = [path for path in old if now - times.get(path, now) >= min_age_seconds]
        for path in gone:
            delete(self.spark, path)
        return len(gone)

    def exists(self) -> bool:
        return exists(self.spark, self.root)
