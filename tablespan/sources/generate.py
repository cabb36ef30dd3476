"""Seeded tables for tests and benchmarks, made in parallel from a range of ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablespan.schema import GRID

FIRST_NAMES = ("Ada", "Boris", "Chloe", "Deniz", "Esther", "Farid", "Greta", "Hugo")
LAST_NAMES = ("Abara", "Bergman", "Castillo", "Dubois", "Eriksen", "Fontana", "Gupta", "Hoshino")
#: Multiplier, addend and modulus of each rule column of the deterministic table.
RULES = {
    "column5": (3, 0, 1000), "column6": (5, 7, 2500), "column7": (2, 0, 8000), "column8": (2, -1, 12000), "column9": (11, 13, 40000),
    "column10": (17, 19, 55000), "column11": (23, 29, 65000), "column12": (31, 37, 75000), "column13": (41, 43, 90000),
    "column14": (47, 53, 120000), "column15": (59, 61, 160000),
}


def _pick(names: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*(F.lit(n) for n in names)), (at + 1).cast("int"))


def fixed_table(spark: SparkSession, rows: int, partitions: int | None = None) -> DataFrame:
    """The deterministic grid: every value follows from the row id."""
    i, index = F.col("id"), F.col("id") + 1
    columns = {"index": index, "firstName": _pick(FIRST_NAMES, i % 8), "lastName": _pick(LAST_NAMES, i * 7 % 8), "age": (18 + i % 82).cast("int")}
    columns |= {name: (index * m + a) % n for name, (m, a, n) in RULES.items()}
    return spark.range(0, rows, 1, partitions).select(F.col("id").alias("row_id"), *(columns[n].alias(n) for n in GRID))


def random_table(spark: SparkSession, rows: int, seed: int, partitions: int | None = None) -> DataFrame:
    """The random grid. Draws are hashes of seed, column and id: the same for any number of partitions."""
    index = F.col("id") + 1

    def draw(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("id")), F.lit(n))

    columns = {"index": index, "firstName": _pick(FIRST_NAMES, draw("firstName", 8)), "lastName": _pick(LAST_NAMES, draw("lastName", 8)), "age": (18 + draw("age", 82)).cast("int")}
    columns |= {"column6": F.lit(rows) - index, "column7": index * 2, "column8": index * 2 - 1}
    return spark.range(0, rows, 1, partitions).select(F.col("id").alias("row_id"), *(columns.get(n, draw(n, rows + 1)).alias(n) for n in GRID))
