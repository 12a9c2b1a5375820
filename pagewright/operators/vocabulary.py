"""A recogniser's vocabulary held to the allowed characters, and decoding under that mask."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import allowed

AT = ("frame_id", "word_id", "pos")


def vocabulary(tokens: DataFrame, special: tuple[int, ...] = ()) -> DataFrame:
    """tokens(token_id, token) with able: whether a token may be read. Those of `special` ids always are; a null token is not."""
    return tokens.withColumn("able", F.coalesce(allowed("token"), F.lit(False)) | F.col("token_id").isin(*special))


def masked(scores: DataFrame, tokens: DataFrame) -> DataFrame:
    """scores(.., token_id, score) with the scores of tokens that may not be read, or that tokens(token_id, able) doesn't have, at minus infinity.

    The mask goes to the scores, as a bit for each token in words of 64, so that scores, of which there are many more, are not shuffled by token."""
    known = tokens.where("able").groupBy(F.expr("shiftright(cast(token_id as long), 6)").alias("_block")).agg(F.bit_or(F.expr("shiftleft(1L, cast(token_id & 63 as int))")).alias("_bits"))
    found = scores.withColumn("_at", F.expr("shiftright(cast(token_id as long), 6)")).join(F.broadcast(known), F.col("_at") == F.col("_block"), "left")
    able = F.coalesce(F.expr("getbit(_bits, cast(token_id & 63 as int))") == 1, F.lit(False))
    rest = [c for c in scores.columns if c != "token_id"]
    return found.withColumn("score", F.when(able, F.col("score")).otherwise(F.lit(float("-inf")))).select("token_id", *rest)


def decoded(scores: DataFrame, tokens: DataFrame, end: int | None = None) -> DataFrame:
    """frame_id, word_id, text of scores(frame_id, word_id, pos, token_id, score) under the mask of tokens(token_id, token, able): at each place the token of the
    highest score (ties: the smallest id), up to the token `end`. Places where none may be read give nothing; a word of such places only has text ""."""
    best = masked(scores, tokens).groupBy(*AT).agg(F.max(F.struct("score", (-F.col("token_id")).alias("o"))).alias("b"))
    chosen = best.select(*AT, F.when(F.col("b.score") > float("-inf"), -F.col("b.o")).alias("token_id")).join(tokens.select("token_id", "token"), "token_id", "left")
    row = F.sort_array(F.collect_list(F.struct("pos", "token_id", "token")))
    words = chosen.groupBy("frame_id", "word_id").agg(row.alias("row"))
    if end is not None:
        stop = F.array_position(F.transform("row", lambda t: F.coalesce(t["token_id"] == end, F.lit(False))), True)
        words = words.withColumn("row", F.when(stop > 0, F.slice("row", 1, (stop - 1).cast("int"))).otherwise(F.col("row")))
    return words.select("frame_id", "word_id", F.array_join(F.transform("row", lambda t: t["token"]), "").alias("text"))
