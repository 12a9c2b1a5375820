from pyspark.sql import functions as F

from pagewright.functions import codec, geometry, text


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_half_even_and_truncation(spark):
    got = one(spark, *[geometry.half_even(F.lit(v)) for v in (0.5, 1.5, 2.5, -0.5)], geometry.whole(F.lit(-1.9)), geometry.whole(F.lit(1.9)))
    assert tuple(got) == (0, 2, 2, 0, -1, 1)


def test_iou_of_empty_and_null_boxes(spark):
    box = lambda *v: F.struct(*[F.lit(x).alias(n) for n, x in zip(("x1", "y1", "x2", "y2"), v)])
    null = F.lit(None).cast("struct<x1:int,y1:int,x2:int,y2:int>")
    got = one(spark, geometry.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)), geometry.iou(null, box(0, 0, 1, 1)), geometry.iou(box(0, 0, 2, 2), box(1, 0, 3, 2)))
    assert got[0] == 0 and got[1] == 0 and abs(got[2] - 1 / 3) < 1e-12


def test_cleaning_takes_unicode_white_space(spark):
    got = one(spark, text.clean_text(F.lit("  aéb •  ")), text.clean_text(F.lit("• x"), bullets=False), text.clean_text(F.lit("é")))
    assert tuple(got) == ("ab •", "x", "")


def test_weak_words(spark):
    got = one(spark, text.weak(F.lit("abc"), F.lit(None).cast("double"), F.lit(0), F.lit(12)), text.weak(F.lit("abcd"), F.lit(0.97), F.lit(0), F.lit(12)), text.weak(F.lit(""), F.lit(0.969), F.lit(0), F.lit(12)))
    assert tuple(got) == (False, True, True)


def test_header_round_trip_and_faults(spark):
    good = codec.pack(F.lit(2), F.lit(1), F.lit(3), F.lit(bytes(6)))
    for data, valid in ((good, True), (codec.pack(F.lit(2), F.lit(1), F.lit(3), F.lit(bytes(5))), False), (codec.pack(F.lit(0), F.lit(1), F.lit(3), F.lit(b"")), False), (F.lit(b"short"), False)):
        assert one(spark, codec.unpack(data).alias("u")).u.valid is valid
    assert one(spark, codec.unpack(good).alias("u")).u.pixels == bytes(6)


def test_answers_have_defaults(spark):
    got = one(spark, codec.answers(F.lit('{"results":[{"text":"a"},{"conf":0.5}]}')).alias("r"), codec.answers(F.lit("junk")).alias("n"), codec.replicas(F.lit("{}")).alias("k"))
    assert [(r.pos, r.text, r.conf) for r in got.r] == [(0, "a", 0.0), (1, "", 0.5)] and got.n == [] and got.k == 1


def test_names(spark):
    assert tuple(one(spark, text.stem(F.lit("/a/b.c.png")), text.stem(F.lit("x")), text.urls(F.lit(" http://a/ ,, b//")))) == ("b.c", "x", ["http://a", "b"])
