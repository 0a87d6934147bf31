"""Table functions for SQL: bootstrap replicates and sequential greedy splits of a table argument.

register(spark) makes them callable:

    SELECT * FROM replicates(TABLE(units), 300, 1337)
    SELECT * FROM greedy_splits(TABLE(groups), 'region', 'customer', 'mass', 'total')

Result columns follow the arguments. Rows go through one by one with a state of fixed size, so a hot group is a long
task but never a large one.
"""

from __future__ import annotations

from hashlib import md5

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from earshot import config as C
from earshot.operators.evaluation import POISSON

KEYS = (T.StringType, T.ByteType, T.ShortType, T.IntegerType, T.LongType)  # whose text is the same in SQL and Python


def _constant(argument: AnalyzeArgument, name: str):
    if argument.isTable or not argument.isConstantExpression or argument.value is None:
        raise ValueError(f"{name} must be a constant")
    return argument.value


class Replicates:
    """All columns of the table, replicate (from 0) and w: how often the replicate draws the row (Poisson of mean 1).

    Draws are by MD5 of the seed, the row's values and the replicate, parted by colons; nulls are left out of it, as in
    concat_ws. Columns are texts or whole numbers. Equal rows draw alike; an empty table gives no rows.
    """

    @staticmethod
    def analyze(units: AnalyzeArgument, replicates: AnalyzeArgument, seed: AnalyzeArgument) -> AnalyzeResult:
        if not units.isTable:
            raise ValueError("the first argument must be a table")
        own = units.dataType.fields
        for f in own:
            if not isinstance(f.dataType, KEYS):
                raise ValueError(f"{f.name}: keys are texts or whole numbers")
            if f.name.lower() in ("replicate", "w"):
                raise ValueError(f"{f.name}: name of a result")
        if _constant(replicates, "replicates") < 0:
            raise ValueError("replicates must not be negative")
        _constant(seed, "seed")
        return AnalyzeResult(T.StructType([*own, T.StructField("replicate", T.IntegerType(), False), T.StructField("w", T.LongType(), False)]))

    def eval(self, units, replicates, seed):
        values = tuple(units)
        start = ":".join(str(v) for v in (seed, *values) if v is not None)
        for i in range(replicates):
            x = int(md5(f"{start}:{i}".encode()).hexdigest()[:8], 16) / (1 << 32)
            yield (*values, i, sum(x >= p for p in POISSON))


class GreedySplits:
    """(by, grp, split) of a table with a row for each class and group: groups go one after another, largest mass first
    (equal to six digits: smallest group), into the split with most room; ties train, dev, test.

    Arguments name the columns of class, group, mass and the class's total mass. Rows with a null mass or total get no split.
    """

    @staticmethod
    def analyze(groups: AnalyzeArgument, by: AnalyzeArgument, group: AnalyzeArgument, mass: AnalyzeArgument, total: AnalyzeArgument) -> AnalyzeResult:
        if not groups.isTable:
            raise ValueError("the first argument must be a table")
        kinds = {f.name: f for f in groups.dataType.fields}
        names = [_constant(a, n) for a, n in ((by, "by"), (group, "group"), (mass, "mass"), (total, "total"))]
        for n in names:
            if n not in kinds:
                raise ValueError(f"no column {n}")
        schema = T.StructType([kinds[names[0]], kinds[names[1]], T.StructField("split", T.StringType())])
        order = [OrderingColumn(f"round(`{names[2]}`, 6)", ascending=False), OrderingColumn(f"`{names[1]}`")]
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(f"`{names[0]}`")], orderBy=order)

    def __init__(self):
        self.targets = dict(C.SPLIT_TARGETS)
        self.have = dict.fromkeys(self.targets, 0.0)

    def eval(self, groups, by, group, mass, total):
        m, whole, split = groups[mass], groups[total], None
        if m is not None and whole is not None:
            split = max(self.targets, key=lambda s: round(self.targets[s] * whole - self.have[s], 9))  # the first of equals
            self.have[split] += m
        yield groups[by], groups[group], split


def register(spark: SparkSession) -> None:
    spark.udtf.register("replicates", udtf(Replicates))
    spark.udtf.register("greedy_splits", udtf(GreedySplits))
