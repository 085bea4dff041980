"""Numbered states of a table in one folder, each written once and whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Versions:
    """States of a table as Parquet folders by number.

    A state counts once its writer has left ``_SUCCESS``, so a state that a lost driver
    left half done is none, and is written anew.  Nothing else says which states there are.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def folder(self, number: int) -> str:
        return f"{self.path}/v{number}"

    def numbers(self) -> list[int]:
        """The numbers of whole states, in order."""
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path)) if s.isDirectory()]
        known = [int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit()]
        return sorted(n for n in known if self._fs.exists(self._at(f"{self.folder(n)}/_SUCCESS")))

    def latest(self, upto: int | None = None) -> int | None:
        """The largest number, or the largest that is not above ``upto``."""
        return max((n for n in self.numbers() if upto is None or n <= upto), default=None)

    def write(self, df: DataFrame, number: int) -> bool:
        """Write a state; False where it is there already, and then nothing is done."""
        if number < 0:
            raise ValueError("numbers of states are not negative")
        if number in self.numbers():
            return False
        df.write.mode("overwrite").parquet(self.folder(number))
        return True

    def read(self, number: int) -> DataFrame:
        return self.spark.read.parquet(self.folder(number))

    def drop(self, number: int) -> None:
        self._fs.delete(self._at(self.folder(number)), True)
