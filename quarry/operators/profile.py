"""Column profiles: type, example, distinct count, values and range of each column.

Three passes at most, each over the columns that it needs. The first is one aggregation
without keys: rows, least, greatest, example, whether there are decimals, and about how
many values there are. The second has a set of 128-bit hashes a column for those of
about SET_MOST values or fewer, whose sizes are exact counts, and lists the values of
few. Only for columns of more values are hashes shuffled, each task's once. A value that many
rows share is one hash a task; estimates decide where values are counted, not what is counted.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.fixed import MAX_CATEGORIES

#: Values up to which a column's are about counted by a set, and up to which they are listed at once.
SET_MOST, LIST_MOST = 4096, 2 * MAX_CATEGORIES

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)


def is_numeric(kind: T.DataType) -> bool:
    """Whether a column of this type counts as numeric; truth values do."""
    return isinstance(kind, _NUMERIC)


def dataset_id(columns: list[str]) -> str:
    """Eight hex digits that name a list of columns in their order, whatever the rows."""
    return hashlib.sha1(",".join(columns).encode()).hexdigest()[:8]


def _present(field: T.StructField) -> Column:
    """The column with NaN as null."""
    col = F.col(f"`{field.name}`")
    return F.when(~F.isnan(col), col) if isinstance(field.dataType, (T.FloatType, T.DoubleType)) else col


def _hashed(field: T.StructField) -> Column:
    """What tells the column's values apart; 0.0 and -0.0 are one value, and nested ones go by their text."""
    return _present(field) if not isinstance(field.dataType, T.MapType) else _present(field).cast("string")


def _sortable(field: T.StructField) -> Column:
    """struct(d, s) of a value, in the order values are listed; null where there is none."""
    own = _present(field)
    d = own.cast("double") if is_numeric(field.dataType) else F.lit(None).cast("double")
    return F.when(own.isNotNull(), F.struct(d.alias("d"), own.cast("string").alias("s")))


def _hash_of(field: T.StructField) -> Column:
    """128 bits that tell a column's values apart; null where there is none."""
    return F.when(_present(field).isNotNull(), F.struct(F.xxhash64(F.lit("a"), _hashed(field)).alias("a"), F.xxhash64(F.lit("another"), _hashed(field)).alias("b")))


def _list_of(field: T.StructField) -> Column:
    """All values of a column of few, as text in their order."""
    return F.transform(F.array_sort(F.collect_set(_sortable(field))), lambda x: x["s"])


def profile(df: DataFrame, order_by: list[str] | None = None) -> DataFrame:
    """(pos, name, type, example, n_distinct, values, range): one row a column.

    ``order_by`` gives the rows' order, in which the example is the first value;
    without it the example is the least value. Values and examples are rendered
    as text. Empty input gives the type "empty".
    """
    fields = df.schema.fields
    order = F.struct(*(F.col(f"`{c}`") for c in order_by)) if order_by else None
    facts = []
    for i, f in enumerate(fields):
        own = _present(f)
        plain = own.cast("string") if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else own
        first = F.min(plain) if order is None else F.min_by(plain, F.when(own.isNotNull(), F.struct(order.alias("at"), plain.alias("v"))))
        whole = not isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType))
        decimal = F.lit(0) if whole else F.coalesce(F.max(((own % 1 != 0) | (F.abs(own.cast("double")) == float("inf"))).cast("int")), F.lit(0))
        facts.append(F.struct(F.lit(i).alias("pos"), first.cast("string").alias("example"), decimal.alias("decimal"), F.min(plain).cast("string").alias("low"), F.max(plain).cast("string").alias("high"), F.approx_count_distinct(F.when(own.isNotNull(), F.xxhash64(_hashed(f)))).alias("about")))
    one = df.agg(F.count("*").alias("total"), F.array(*facts).alias("facts")).first()  # one row
    about = [x.about for x in one.facts]
    low, high = ([i for i in range(len(fields)) if (about[i] <= SET_MOST) == few] for few in (True, False))
    counted, listed = {}, {}
    if low:
        sets = [F.size(F.collect_set(_hash_of(fields[i]))).alias(f"n{i}") for i in low]
        found = df.agg(*sets, *(_list_of(fields[i]).alias(f"c{i}") for i in low if about[i] <= LIST_MOST)).first()
        counted = {i: found[f"n{i}"] for i in low}
        listed = {i: found[f"c{i}"] for i in low if about[i] <= LIST_MOST}
    if high:
        cells = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("pos"), _hash_of(fields[i]).alias("h")) for i in high))).alias("c"))
        counted |= dict(cells.filter("c.h IS NOT NULL").select("c.pos", "c.h.a", "c.h.b").distinct().groupBy("pos").count().collect())  # a row a column
    few = [i for i, n in counted.items() if n <= MAX_CATEGORIES and i not in listed]
    if few:
        values = df.agg(*(_list_of(fields[i]).alias(f"c{i}") for i in few)).first()
        listed |= {i: values[f"c{i}"] for i in few}

    spark = df.sparkSession
    table = [(i, f.name, is_numeric(f.dataType), one.total, counted.get(i, 0), x.example, x.decimal, x.low, x.high, listed.get(i)) for i, (f, x) in enumerate(zip(fields, one.facts))]
    rows = spark.createDataFrame(table, "pos int, name string, numeric boolean, total long, n_distinct long, example string, decimal int, low string, high string, listed array<string>")
    n = F.col("n_distinct")
    numeric, decimals = F.col("numeric"), F.coalesce("decimal", F.lit(0)) == 1
    kind = (
        F.when(n == 0, "empty").when((n == F.col("total")) & ~decimals, "identifier").when((n == 2) & numeric, "binary numeric").when(n == 2, "binary text")
        .when(decimals, "decimal").when(numeric, "integer").when(n <= MAX_CATEGORIES, "categorical text").otherwise("free text")
    )
    values = F.when((n > 0) & (n <= MAX_CATEGORIES) & (F.col("type") != "identifier"), F.col("listed"))
    between = F.concat(F.lit("any value between "), F.col("low"), F.lit(" and "), F.col("high"))
    return (
        rows.withColumn("type", kind).withColumn("values", values)
        .withColumn("range", F.when(F.col("values").isNull() & F.col("type").isin("integer", "decimal"), between))
        .select("pos", "name", "type", "example", n.alias("n_distinct"), "values", "range")
    )
