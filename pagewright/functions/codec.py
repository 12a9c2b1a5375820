"""Wire formats: crops with a header of three big-endian unsigned ints (height, width, channels), and JSON answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geometry import col

ANSWER = T.StructType(
    [
        T.StructField("results", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("conf", T.DoubleType())]))),
        T.StructField("model_time", T.DoubleType()),
        T.StructField("decode_time", T.DoubleType()),
    ]
)
HEALTH = T.StructType([T.StructField("status", T.StringType()), T.StructField("model", T.StringType()), T.StructField("num_replicas", T.IntegerType())])


def _int(data: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(data, at, 4)), 16, 10).cast("long")


def unpack(data: str | Column) -> Column:
    """Struct h, w, c, valid, pixels. Valid: at least 12 bytes, all three positive, and as many pixel bytes as they say."""
    d = col(data)
    h, w, c = (_int(d, at) for at in (1, 5, 9))
    fits = (F.octet_length(d) >= 12) & (h > 0) & (w > 0) & (c > 0) & (F.octet_length(d) - 12 == h * w * c)
    valid = F.coalesce(fits, F.lit(False))
    return F.struct(h.alias("h"), w.alias("w"), c.alias("c"), valid.alias("valid"), F.when(valid, F.substring(d, F.lit(13), F.octet_length(d))).alias("pixels"))


def pack(h: str | Column, w: str | Column, c: str | Column, pixels: str | Column) -> Column:
    word = lambda x: F.lpad(F.hex(col(x).cast("long")), 8, "0")
    return F.concat(F.unhex(F.concat(word(h), word(w), word(c))), col(pixels))


def answers(json: str | Column) -> Column:
    """Array of pos, text, conf of an answer; missing text is "", missing conf 0."""
    parsed = F.from_json(col(json), ANSWER)
    return F.transform(F.coalesce(parsed["results"], F.array().cast(ANSWER["results"].dataType)), lambda r, i: F.struct(i.alias("pos"), F.coalesce(r["text"], F.lit("")).alias("text"), F.coalesce(r["conf"], F.lit(0.0)).alias("conf")))


def replicas(json: str | Column) -> Column:
    """Replicas of a health answer, at least 1."""
    return F.greatest(F.lit(1), F.coalesce(F.from_json(col(json), HEALTH)["num_replicas"], F.lit(1)))


def requests(n: str | Column, replicas_: str | Column, batch: str | Column) -> Column:
    """How many requests n crops are split into: one a replica, more if batches would be too large, never more than crops."""
    return F.greatest(F.lit(1), F.least(col(n), F.greatest(col(replicas_), F.ceil(col(n) / F.coalesce(col(batch), F.lit(256))).cast("int"))))
