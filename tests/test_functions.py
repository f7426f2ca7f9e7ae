from __future__ import annotations

from pyspark.sql import functions as F

from platterlens.functions import arrays, bits, strings, times


def one(spark, column, **values):
    kinds = {str: "string", int: "bigint", float: "double", list: "array<bigint>", type(None): "string"}
    df = spark.range(1).select(*(F.lit(v).cast(kinds[type(v)]).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<bigint>").alias(k) for k, v in values.items()), F.lit(0).alias("_"))
    return df.select(column.alias("x")).first()["x"]


def test_labels(spark):
    def read(label):
        return tuple(one(spark, strings.parse_label(F.col("s")), s=label))

    assert read("HARBOUR_AND_LANTERN_S4D3") == ("Harbour And Lantern", 4, 3, None)
    assert read("SOME_SHOW_SEASON_3_DISC_2") == ("Some Show", 3, 2, None)
    assert read("QUIET_TURBINE_2031") == ("Quiet Turbine 2031", None, None, 2031)
    assert read("WOOL_OX_MARKET") == ("Wool OX Market", None, None, None)
    assert read("DISC_SEASON") == ("", None, None, None)
    assert read("SEASON_SEASON_4") == ("", 4, None, None)
    assert read("S1_S2D3_X") == ("X", 1, 3, None)
    assert read("") == ("", None, None, None)
    assert one(spark, strings.parse_label(F.col("s")), s=None) is None


def test_names(spark):
    def clean(s):
        return one(spark, strings.sanitize(F.col("s")), s=s)

    assert clean("Harbour: The Return") == "Harbour - The Return"
    assert clean("a/b\\c?") == "a-b-c-"
    assert clean("con.txt") == "_con.txt"
    assert clean("???") == "untitled"
    assert clean("  dots...  ") == "dots"
    assert one(spark, strings.render("{a}-{b:3} {c} {", a=F.lit(7), b=F.lit(7)), s="") == "07-007 {c} {"
    assert one(spark, F.array_join(strings.render_path("{x}/../{y}/f", x=F.lit("t"), y=F.lit(" ")), "/"), s="") == "t/untitled/f"
    assert one(spark, strings.percent_encode(F.col("s")), s="a b*c~d+é") == "a%20b%2Ac~d%2B%C3%A9"
    assert one(spark, strings.serial(F.col("s")), s="BOOT = cdrom:\\SLUS_012.34;1\r\n") == "SLUS-01234"
    assert one(spark, F.array_join(F.transform(strings.episode_numbers(F.col("s")), lambda x: x.cast("string")), ","), s="720E5 S07E01-E02.mkv") == "5,1"
    assert one(spark, strings.describe_show(F.lit("Coast 9"), F.lit("Quiz"), F.lit("2004-02-03"), F.lit("2011-08-09"), F.lit("Ended")), s="") == "Coast 9 · Quiz · 2004-2011"
    assert one(spark, strings.describe_show(F.lit("Lagoon"), F.lit("Nature"), F.lit("2020-06-07"), F.lit(None).cast("string"), F.lit("Running")), s="") == "Lagoon · Nature · ongoing"
    assert one(spark, strings.same_letter(F.lit("Ä"), F.lit("Å")), s="") and not one(spark, strings.same_letter(F.lit("a"), F.lit("a")), s="")


def test_times(spark):
    for ms in (0, 1, 999, 1000, 61001, 3661123, 9999999):
        text = one(spark, times.timestamp_text(F.col("x")), x=ms)
        assert one(spark, times.parse_timestamp(F.col("s")), s=text) == ms
    assert one(spark, times.timestamp_text(F.col("x")), x=3661123) == "01:01:01,123"
    assert one(spark, times.parse_timestamp(F.col("s")), s="no time") is None
    assert one(spark, times.msf(F.col("x")), x=4501) == "01:00:01"
    assert one(spark, times.seconds_to_ms(F.col("s")), s="86.207") == 86207
    assert one(spark, times.duration_ms(F.col("s")), s="1:02:03") == 3723000
    assert one(spark, times.year_of(F.col("s")), s="1998-02-03") == 1998
    assert one(spark, times.dcsq_ms(F.col("x")), x=90) == 1024


def test_bits_and_arrays(spark):
    assert one(spark, bits.digit_sum(F.col("x")), x=40_096) == 19
    assert one(spark, bits.from_bcd(F.col("x").cast("int")), x=0x59) == 59
    assert one(spark, bits.snap_ratio(F.lit(853.0), F.lit(720.0)), x=0) == "32/27"
    assert one(spark, bits.snap_ratio(F.lit(3.0), F.lit(2.0)), x=0) == "3/2"
    assert one(spark, bits.frame_rate(F.lit(23.98)), x=0) == "24000/1001"
    assert one(spark, bits.looks_telecined(F.lit(50_000), F.lit(40_100)), x=0)
    assert one(spark, F.size(arrays.without_sliver(F.col("a"))), a=[410000, 1250]) == 1
    assert one(spark, F.size(arrays.without_sliver(F.col("a"))), a=[1250]) == 1
    assert one(spark, arrays.chapters_match(F.col("a"), F.col("b")), a=[410070, 620940], b=[410000, 621000])
    assert not one(spark, arrays.chapters_match(F.col("a"), F.col("b")), a=[410000], b=[410000, 1])
