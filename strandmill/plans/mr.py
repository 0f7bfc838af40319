"""A key-value interface over DataFrames: map, shuffle, group, reduce, sort, scan.

A ``KV`` holds either pairs (key, value) or groups (key, values). Operators return a new one and run nothing by themselves.
Callbacks are given as functions or by a registered name: map callbacks get a pandas frame and return one, reduce callbacks a
key and a frame of its values. Prefer the built-in reducers, which pre-aggregate; ``reduce`` with a callback brings a key's
values to one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandmill.session import cut

CALLBACKS: dict[str, Callable] = {}


def callback(f: Callable) -> Callable:
    """Register a callback under its name."""
    CALLBACKS[f.__name__] = f
    return f


def _found(f: Callable | str) -> Callable:
    return CALLBACKS[f] if isinstance(f, str) else f


def _unsigned(c: Column) -> Column:
    n = c.cast("decimal(20,0)")
    return F.when(n < 0, n + F.lit(Decimal(2**64))).otherwise(n)


def prefix(n: int) -> Callable[[Column], Column]:
    """Texts by their first n characters; those that agree in them tie."""
    return lambda c: F.substring(c.cast("string"), 1, n)


#: What the comparators order by; ``prefix`` makes the length-bounded one.
ORDERS: dict[str, Callable[[Column], Column]] = {
    "int": lambda c: c.cast("int"), "uint64": _unsigned, "float": lambda c: c.cast("float"), "double": lambda c: c.cast("double"), "str": lambda c: c.cast("string"),
}


def _order(c: str, ascending: bool, order: Callable[[Column], Column] | str | None) -> Column:
    by = (ORDERS[order] if isinstance(order, str) else order or (lambda x: x))(F.col(c))
    return by.asc() if ascending else by.desc()


#: Settings that Spark has no use for: it deals tasks out, sizes pages and spills by itself.
UNUSED = ("mapstyle", "all2all", "timer", "minpage", "maxpage", "freepage", "outofcore", "zeropage", "keyalign", "valuealign")


def settings(spark: SparkSession, **values) -> None:
    """verbosity (0 to 2) sets the log level, memsize (MB) the bytes of a partition read or shuffled; UNUSED ones do nothing,
    and fpath is ``spark.local.dir``, which must be set before a session begins."""
    for name, value in values.items():
        if name == "verbosity":
            spark.sparkContext.setLogLevel(("ERROR", "WARN", "INFO")[int(value)])
        elif name == "memsize":
            for conf in ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"):
                spark.conf.set(conf, f"{int(value)}m")
        elif name not in UNUSED:
            raise ValueError(f"cannot set {name}")


def cumulative_stats(spark: SparkSession) -> dict[str, int]:
    """What all executors of the session did up to now: tasks, milliseconds, bytes read and shuffled."""
    seen = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    each = [seen.apply(i) for i in range(seen.size())]
    total = lambda f: sum(f(x) for x in each)
    return {"tasks": total(lambda x: x.totalTasks()), "ms": total(lambda x: x.totalDuration()), "input_bytes": total(lambda x: x.totalInputBytes()), "shuffle_read_bytes": total(lambda x: x.totalShuffleRead()), "shuffle_write_bytes": total(lambda x: x.totalShuffleWrite())}


class KV:
    def __init__(self, rows: DataFrame) -> None:
        if set(rows.columns) not in ({"key", "value"}, {"key", "values"}):
            raise ValueError("a key-value table has the columns key, value or key, values")
        self.rows = rows

    @property
    def grouped(self) -> bool:
        return "values" in self.rows.columns

    def _pairs(self) -> DataFrame:
        if self.grouped:
            raise ValueError("this holds groups, not pairs")
        return self.rows

    def _groups(self) -> DataFrame:
        if not self.grouped:
            raise ValueError("this holds pairs, not groups")
        return self.rows

    # sources
    @staticmethod
    def tasks(spark: SparkSession, n: int, f: Callable | str, schema: str) -> KV:
        """map over task numbers 0 .. n - 1; the scheduler deals them out."""
        f = _found(f)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i in b["id"]:
                    yield f(int(i))

        return KV(spark.range(0, n, 1, max(1, n)).mapInPandas(run, schema))

    @staticmethod
    def lines(rows: DataFrame, f: Callable | str, schema: str) -> KV:
        """map over frames of lines, chunks or whole files."""
        f = _found(f)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                yield f(b)

        return KV(rows.mapInPandas(run, schema))

    # pairs to pairs
    def map(self, f: Callable | str, schema: str) -> KV:
        return KV.lines(self.rows, f, schema)

    def map_two(self, f: Callable | str, schema: str, other: str) -> tuple[KV, KV]:
        """map with a second output, open while this one is mapped: f(frame) -> (pairs, further pairs). Rows are made once and
        kept in the shared folder."""
        f = _found(f)
        types = [", ".join(f"{c.name}{i} {c.dataType.simpleString()}" for c in StructType.fromDDL(x)) for i, x in enumerate((schema, other))]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for i, made in enumerate(f(b)):
                    none = [None] * len(made)
                    own = {f"{c}{j}": list(made[c]) if i == j else none for j in range(2) for c in ("key", "value")}
                    yield pd.DataFrame({"which": [i] * len(made)} | {c: pd.Series(x, dtype=object) for c, x in own.items()})

        rows = cut(self.rows.mapInPandas(run, f"which int, {types[0]}, {types[1]}"), "pairs")
        first, second = (KV(rows.where(F.col("which") == i).select(F.col(f"key{i}").alias("key"), F.col(f"value{i}").alias("value"))) for i in range(2))
        return first, second

    def select(self, key: Column, value: Column) -> KV:
        """map by column expressions."""
        return KV(self.rows.select(key.alias("key"), value.alias("value")))

    def add(self, other: KV) -> KV:
        return KV(self.rows.unionByName(other.rows))

    union = add

    def copy(self) -> KV:
        return KV(self.rows)

    def aggregate(self, by: Column | None = None, n: int | None = None) -> KV:
        """Bring equal keys (or equal values of ``by``) to one partition."""
        by = F.col("key") if by is None else by
        return KV(self.rows.repartition(n, by) if n else self.rows.repartition(by))

    def gather(self, n: int) -> KV:
        return KV(self.rows.coalesce(n))

    def broadcast(self) -> KV:
        """Marked for replication where it is joined; for tables of known size alone."""
        return KV(F.broadcast(self.rows))

    # pairs to groups
    def convert(self) -> KV:
        """Group within partitions."""
        part = F.spark_partition_id()
        return KV(self._pairs().groupBy(part.alias("p"), "key").agg(F.collect_list("value").alias("values")).select("key", "values"))

    def collate(self) -> KV:
        return KV(self._pairs().groupBy("key").agg(F.collect_list("value").alias("values")))

    def clone(self) -> KV:
        return KV(self._pairs().select("key", F.array("value").alias("values")))

    def collapse(self, key: Column) -> KV:
        """All pairs of a partition as one group of (key, value) structs."""
        rows = self._pairs().groupBy(F.spark_partition_id().alias("p")).agg(F.collect_list(F.struct("key", "value")).alias("values"))
        return KV(rows.select(key.alias("key"), "values"))

    def scrunch(self, n: int, key: Column) -> KV:
        return self.gather(n).collapse(key)

    # reducers
    def count(self) -> KV:
        if self.grouped:
            return KV(self.rows.select("key", F.size("values").cast("long").alias("value")))
        return KV(self.rows.groupBy("key").agg(F.count("*").alias("value")))

    def cull(self) -> KV:
        """Each key once, with its smallest value."""
        if self.grouped:
            return KV(self.rows.select("key", F.array_min("values").alias("value")))
        return KV(self.rows.groupBy("key").agg(F.min("value").alias("value")))

    def summed(self) -> KV:
        return KV(self._pairs().groupBy("key").agg(F.sum("value").alias("value")))

    def reduce(self, f: Callable | str, schema: str) -> KV:
        """f(key, values frame) -> frame of pairs, for each key."""
        f = _found(f)
        pairs = self.rows.select("key", F.explode("values").alias("value")) if self.grouped else self.rows
        return KV(pairs.groupBy("key").applyInPandas(lambda key, rows: f(key[0], rows), schema))

    def compress(self, f: Callable | str, schema: str) -> KV:
        """Reduce within the Arrow batches of each partition, before a shuffle: a combiner, after which a key may still occur
        several times in a partition."""
        f = _found(f)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for key, rows in b.groupby("key", sort=False, dropna=False):
                    yield f(key, rows)

        return KV(self._pairs().mapInPandas(run, schema))

    # order
    def sort_keys(self, ascending: bool = True, whole: bool = False, order: Callable[[Column], Column] | str | None = None) -> KV:
        """Within partitions, or over the whole table; ``order``: one of ORDERS or a function of the column."""
        by = _order("key", ascending, order)
        return KV(self.rows.orderBy(by) if whole else self.rows.sortWithinPartitions(by))

    def sort_values(self, ascending: bool = True, whole: bool = False, order: Callable[[Column], Column] | str | None = None) -> KV:
        by = _order("value", ascending, order)
        return KV(self._pairs().orderBy(by) if whole else self._pairs().sortWithinPartitions(by))

    def sort_multivalues(self, ascending: bool = True, compare: Callable[[Column, Column], Column] | None = None) -> KV:
        """Sort each group, by a comparator of columns if one is given."""
        made = F.array_sort("values", compare) if compare else F.sort_array("values", ascending)
        return KV(self._groups().withColumn("values", made))

    # use
    def scan(self, f: Callable | str) -> None:
        """f(iterator of rows) on each partition, for what it does besides."""
        self.rows.foreachPartition(_found(f))

    def blocks(self, size: int) -> DataFrame:
        """(key, block, values): groups in blocks of at most ``size`` values. Of pairs, each partition's values of a key make
        blocks of their own, so that no key's values come together in one task or row."""
        if not self.grouped:
            own = self.rows.withColumn("p", F.spark_partition_id().cast("long"))
            at = F.row_number().over(Window.partitionBy("p", "key").orderBy("value")) - 1
            block = F.shiftleft("p", 32) + F.floor(at / size)
            return own.select("key", "value", block.alias("block")).groupBy("key", "block").agg(F.collect_list("value").alias("values"))
        at = F.sequence(F.lit(0), F.floor((F.size("values") - 1) / size).cast("int"))
        return self._groups().select("key", "values", F.explode(at).alias("block")).select("key", "block", F.slice("values", F.col("block") * size + 1, size).alias("values"))

    def stats(self) -> DataFrame:
        """(keys, values, key_bytes, value_bytes): totals; of groups, keys and all their values."""
        size = lambda c: F.coalesce(F.octet_length(c.cast("string")), F.lit(0))
        if self.grouped:
            return self.rows.agg(F.count("*").alias("keys"), F.sum(F.size("values")).cast("long").alias("values"), F.sum(size(F.col("key"))).alias("key_bytes"), F.sum(F.aggregate(F.transform("values", size), F.lit(0).cast("long"), lambda a, x: a + x)).alias("value_bytes"))
        return self.rows.agg(F.count("*").alias("keys"), F.count("value").alias("values"), F.sum(size(F.col("key"))).alias("key_bytes"), F.sum(size(F.col("value"))).alias("value_bytes"))

    def show(self, n: int = 20) -> None:
        self.rows.show(n, truncate=False)
