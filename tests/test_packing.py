"""Wide rows in few columns: same rows, same order, fewer bytes."""

import random
import re

from pyspark.sql import Row, functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from conftest import executed_plan
from jobtally import schemas as S, sinks
from jobtally.operators import clean, packing
from jobtally.session import shared_folder

TYPES = {"a": StringType(), "b": LongType(), "c": StringType(), "d": IntegerType(), "e": ShortType(), "f": ByteType(), "g": StringType()}
PIECES = ["", "=", "-", "\0", "\1", "\2", "\n", "a", "ab", "é", "日本", "\U0001f600", "B5", "￿"]
ENDS = {LongType(): 63, IntegerType(): 31, ShortType(): 15, ByteType(): 7}


def odd_rows(n=3000, seed=5):
    draw = random.Random(seed)

    def value(kind):
        if draw.random() < 0.2:
            return None
        if kind == StringType():
            return "".join(draw.choices(PIECES, k=draw.randrange(4)))
        most = 2 ** ENDS[kind]
        return draw.choice([0, 1, -1, 9, 10, -9, -10, 99, 100, -100, most - 1, -most, -most + 1, draw.randrange(-most, most)]) if most > 128 else draw.randrange(-128, 128)

    return [tuple(value(t) for t in TYPES.values()) for _ in range(n)]


def table(spark, rows):
    return spark.createDataFrame(rows, StructType([StructField(c, t, True, {"of": c}) for c, t in TYPES.items()]))


def test_packed_columns_come_back_and_sort_as_before(spark):
    rows = odd_rows()
    df = table(spark, rows)
    narrow, held, unpacked = packing.packed(df, packing.runs(df, list(TYPES)))
    assert len(narrow.columns) == len(held) == 1
    back = unpacked(narrow)
    assert back.schema == df.schema
    assert sorted(map(repr, back.collect())) == sorted(repr(Row(*TYPES)(*r)) for r in rows)
    ranks = back.withColumn("new", F.expr("0"))
    assert ranks.columns == [*TYPES, "new"]
    text = lambda v: (v is not None, v.encode() if isinstance(v, str) else v or 0)
    expected = sorted(rows, key=lambda r: tuple(map(text, r)))
    assert [tuple(r) for r in unpacked(narrow.orderBy(held[0]).coalesce(1)).collect()] == expected


def test_runs_end_at_fractions_and_short_ones_stay(spark):
    df = spark.createDataFrame([], "a STRING, b STRING, c LONG, d STRING, e STRING, x DOUBLE, f STRING, g INT")
    assert packing.runs(df, df.columns) == [["a", "b", "c", "d", "e"], ["x"], ["f"], ["g"]]


WIDE = ("k STRING, t LONG, " + ", ".join(f"c{i} STRING" for i in range(6)) + ", m DOUBLE, " + ", ".join(f"n{i} LONG" for i in range(5)))


def wide(spark, n=2000, seed=7):
    draw = random.Random(seed)
    some = lambda *v: draw.choice([None, *v])
    rows = [(some("a", "b", "c", "d#1"), some(1, 2), *(some("", "x", "\0") for _ in range(6)), some(-1.5, 0.5), *(some(-3, 4) for _ in range(5)))
            for _ in range(n)]
    return spark.createDataFrame(rows, WIDE), rows


def test_newest_of_wide_rows_is_the_one_all_columns_say(spark):
    df, rows = wide(spark)
    best = {}
    for r in rows:
        rank = (r[1] is None, -(r[1] or 0), *((v is not None, v if v is not None else 0) for v in r[2:]))
        if r[0] not in best or rank < best[r[0]][0]:
            best[r[0]] = rank, r
    got = clean.latest_per_key(df.repartition(16), ["k"], "t")
    assert got.columns == df.columns
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(r) for _, r in best.values())


def test_wide_rows_are_shuffled_as_few_columns(spark):
    """Twelve texts and whole numbers were as many columns of the shuffle by key."""
    df, _ = wide(spark)
    result = clean.latest_per_key(df, ["k"], "t")
    plan = executed_plan(result).split("== Initial Plan ==")[0]
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "__packed" in below and "array_join" in below
    assert not re.search(r"c5#\d+ ASC", plan)
    assert re.search(r"WindowGroupLimit.*Exchange hashpartitioning.*WindowGroupLimit", plan, re.S)


def test_wide_table_is_written_by_day_as_it_was(spark):
    df, rows = wide(spark)
    path = shared_folder(spark, "wide_rows")
    dated = df.withColumn(S.RECORD_DATE, F.expr("date_add(DATE '2024-01-01', CAST(n0 AS INT))"))
    sinks.write_by(dated, path)
    read = spark.read.parquet(path)
    assert read.columns == dated.columns
    assert sorted(map(repr, map(tuple, read.collect()))) == sorted(map(repr, map(tuple, dated.collect())))


def test_narrow_tables_are_left_alone(spark):
    df = spark.createDataFrame([("a", 1, "x", 2.0)], "k STRING, t LONG, c STRING, m DOUBLE")
    assert "__packed" not in executed_plan(clean.latest_per_key(df, ["k"], "t"))
