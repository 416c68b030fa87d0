"""Reading the file formats of the mining programs with explicit schemas."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.operators.features import COMPLIMENTS

_L, _S, _D, _I = T.LongType(), T.StringType(), T.DoubleType(), T.IntegerType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: Schemas of the JSON-lines and CSV inputs.
SCHEMAS = {
    "review": _schema(review_id=_S, user_id=_S, business_id=_S, date=_S, stars=_D, useful=_D, funny=_D, cool=_D),
    "business": _schema(business_id=_S, city=_S, stars=_D, review_count=_I, is_open=_I, categories=_S, attributes=T.MapType(_S, _S)),
    "user": _schema(user_id=_S, average_stars=_D, review_count=_I, fans=_I, useful=_I, funny=_I, cool=_I, friends=_S, elite=_S, yelping_since=_S, **{f"compliment_{c}": _I for c in COMPLIMENTS}),
    "tip": _schema(user_id=_S, business_id=_S, likes=_I),
    "photo": _schema(business_id=_S, label=_S),
    "checkin": _schema(business_id=_S, time=T.MapType(_S, _I)),
    "ratings": _schema(user_id=_S, business_id=_S, rating=_D),
    "pairs": _schema(user_id=_S, business_id=_S),
}

#: File names of the inputs of one folder.
FOLDER = {"user": "user.json", "business": "business.json", "review": "review_train.json", "tip": "tip.json", "photo": "photo.json", "checkin": "checkin.json", "ratings": "yelp_train.csv"}


def spread(df: DataFrame, partitions: int | None) -> DataFrame:
    """``df`` in at least ``partitions`` partitions: dealt anew, which shuffles; as it is where that is None."""
    return df if partitions is None else df.repartition(partitions)


def json_lines(spark: SparkSession, path: str, kind: str, strict: bool = False, partitions: int | None = None) -> DataFrame:
    """JSON lines of a known kind. ``strict`` fails on a malformed line, else such lines are dropped.

    Missing keys and nulls give nulls; extra keys are ignored; an empty file gives no rows.
    """
    return spread(spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path), partitions)


def csv_rows(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Header CSV of a known kind. Lines equal to the header, wherever they are, and short lines are dropped.

    Columns go by position. A number that cannot be parsed gives null, and so does a missing field at the end if it is
    a number; rows lacking an earlier field are malformed.
    """
    fields = SCHEMAS[kind].fields
    raw = spark.read.schema(T.StructType([T.StructField(f.name, _S) for f in fields])).option("mode", "PERMISSIVE").csv(path)
    header = spark.read.text(path).first()
    if header is not None:
        names = [n.strip().strip('"') for n in header[0].split(",")][: len(fields)]
        same = [F.col(f.name) == F.lit(n) for f, n in zip(fields, names, strict=False)]
        equal = same[0]
        for s in same[1:]:
            equal = equal & s
        raw = raw.filter(~F.coalesce(equal, F.lit(False)))
    needed = [f for f in fields if f.dataType == _S]
    for f in needed:
        raw = raw.filter(F.col(f.name).isNotNull())
    return raw.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in fields])


def transactions(spark: SparkSession, path: str) -> DataFrame:
    """Quoted transaction CSV by position: date (0), customer (1), product (5), as basket key and product.

    ``date_customer`` is the date with a two-digit year, a dash and the customer id; both ids lose leading zeros. Rows
    whose ids are no numbers are dropped.
    """
    columns = T.StructType([T.StructField(f"c{i}", _S) for i in range(6)])
    t = spark.read.schema(columns).option("header", True).option("enforceSchema", True).option("mode", "PERMISSIVE").csv(path)
    return baskets_by_day(t.select(F.btrim("c0").alias("day"), F.btrim("c1").alias("customer"), F.btrim("c5").alias("product")))


def baskets_by_day(t: DataFrame) -> DataFrame:
    """(date_customer, product) from day M/D/YYYY, customer and product strings."""
    day = F.concat(F.regexp_replace("day", r"\d{4}$", ""), F.substring("day", -2, 2))
    ids = [F.col(c).try_cast("bigint").alias(c) for c in ("customer", "product")]
    some = t.select(day.alias("day"), *ids).filter("day is not null and customer is not null and product is not null")
    return some.select(F.concat_ws("-", "day", F.col("customer").cast("string")).alias("date_customer"), F.col("product").cast("string").alias("product"))


def point_rows(spark: SparkSession, path: str) -> DataFrame:
    """Headerless numeric CSV: id, label, then features of any number. Rows that do not parse are dropped."""
    parts = F.split("value", ",")
    t = spark.read.text(path).filter(F.btrim("value") != "").select(parts.alias("p"))
    out = t.select(F.try_element_at("p", F.lit(1)).try_cast("long").alias("id"), F.try_element_at("p", F.lit(2)).try_cast("int").alias("label"), F.transform(F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0))), lambda x: x.try_cast("double")).alias("features"))
    return out.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("features") > 0) & F.forall("features", lambda x: x.isNotNull()))


def stream_lines(spark: SparkSession, path: str) -> DataFrame:
    """One user id per line, in file order: seq from 1 (dense, distributed), user_id."""
    t = spark.read.text(path).filter(F.btrim("value") != "").select(F.monotonically_increasing_id().alias("_at"), F.btrim("value").alias("user_id"))
    parts = t.groupBy(F.shiftright("_at", 33).alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = {r["_part"]: r for r in parts.collect()}  # one row per file split
    done, offsets = 0, []
    for part in sorted(before):
        offsets.append((part, done))
        done += before[part]["_n"]
    # ids count up within a split from its first, blank lines included, so places come from a rank of the split's rows
    from pyspark.sql import Window as W

    shift = F.broadcast(spark.createDataFrame(offsets or [(0, 0)], "_part long, _before long"))
    placed = t.withColumn("_part", F.shiftright("_at", 33)).join(shift, "_part")
    return placed.select((F.col("_before") + F.row_number().over(W.partitionBy("_part").orderBy("_at"))).alias("seq"), "user_id")


def folder(spark: SparkSession, path: str, strict: bool = False) -> dict[str, DataFrame]:
    """The inputs present in a folder, by kind."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {PurePosixPath(s.getPath().toString()).name for s in fs.listStatus(hadoop)}
    read = lambda kind, f: csv_rows(spark, f"{path}/{f}", kind) if f.endswith(".csv") else json_lines(spark, f"{path}/{f}", kind, strict)
    return {kind: read(kind, f) for kind, f in FOLDER.items() if f in there}
