"""Work over many items: attempts that fail alone, reports of what came of them, readings that stop when they are no longer to
be trusted, samples within a budget, scratch that is cleared by record, and devices by the paths that they are mounted at."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.strings import percent_decode, unescape_octal
from .voting import joined_by

#: Cues of a track that are looked at, tracks of a language, and shapes that are enough to judge by.
SAMPLE_CUES, SAMPLE_TRACKS, SAMPLE_SHAPES = 80, 3, 400
MIB = 1_048_576


def attempted(items: DataFrame, checks: list[tuple[Column, Column]], value: Column) -> DataFrame:
    """items with ok, value and error. error is the message of the first of checks (broken, message) that holds; value is
    worked out for the other rows alone. A check that is null counts as not broken."""
    error = F.coalesce(*(F.when(broken, message) for broken, message in checks)) if checks else F.lit(None).cast("string")
    told = items.withColumn("__error", error)
    ok = F.col("__error").isNull()
    return told.select(*items.columns, ok.alias("ok"), F.when(ok, value).alias("value"), F.col("__error").alias("error"))


def isolating(items: DataFrame, work: Callable[[pa.RecordBatch], pa.Array], value: T.DataType, rows: int = 1024) -> DataFrame:
    """items with ok, value and error, work's answer for each row. A batch that work refuses is halved until the rows that it
    refuses are alone; so one bad row costs itself and about log2(rows) more calls, never its batch or its task."""
    own = [c for c in items.columns if c not in ("ok", "value", "error")]
    kept = items.select(*own)
    schema = T.StructType([*kept.schema.fields, T.StructField("ok", T.BooleanType()), T.StructField("value", value), T.StructField("error", T.StringType())])
    kind = to_arrow_type(value)

    def parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, pa.Array, str | None]]:
        try:
            yield batch, work(batch).cast(kind), None
        except Exception as e:  # whatever an item does is that item's own outcome
            if batch.num_rows == 1:
                yield batch, pa.nulls(1, kind), f"{type(e).__name__}: {e}"
            else:
                half = batch.num_rows // 2
                yield from parts(batch.slice(0, half))
                yield from parts(batch.slice(half))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for part, values, error in parts(batch.slice(at, rows)):
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array([error is None] * n), values, pa.array([error] * n, pa.string())], [*own, "ok", "value", "error"])

    return kept.mapInArrow(run, schema)


def filed(attempts: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, dict]:
    """Writes attempts below folder in one pass, good rows and quarantined ones apart, and reads both again; with how many
    there are of each, counted on the way."""
    seen = Observation("attempts")
    counted = attempts.observe(seen, F.count_if("ok").alias("done"), F.count_if(~F.col("ok")).alias("quarantined"))
    counted.write.partitionBy("ok").parquet(folder)
    back = attempts.sparkSession.read.schema(attempts.schema).parquet(folder)
    return back.filter("ok"), back.filter("not ok"), dict(seen.get)


def in_mib(size: Column) -> Column:
    """Bytes (a whole number, not negative) as MiB with one decimal, as C prints them: an exact half of a
    tenth goes to the even digit, which format_string would round up."""
    rest = size % MIB * 10
    tenths, over = F.shiftright(rest, 20), rest % MIB
    up = (over > MIB // 2) | ((over == MIB // 2) & (tenths % 2 == 1))
    sum_ = F.shiftright(size, 20) * 10 + tenths + F.when(up, 1).otherwise(0)
    return F.concat(F.floor(sum_ / 10).cast("string"), F.lit("."), (sum_ % 10).cast("string"), F.lit(" MiB"))


def reports(attempts: DataFrame, by: list[str], name: str, destination: str, pos: str) -> DataFrame:
    """(by, produced, skipped, bytes, complete, lines) of attempts (by, name, destination, ok, value, error), value being bytes:
    what a run did, in the words that it is told in."""
    line = F.when(F.col("ok"), F.concat(F.lit("  "), destination, F.lit("  "), in_mib(F.col("value")))).otherwise(F.concat(F.lit("  FAILED "), name, F.lit(": "), "error"))
    each = attempts.groupBy(*by).agg(
        F.count_if("ok").alias("produced"), F.count_if(~F.col("ok")).alias("skipped"), F.coalesce(F.sum("value"), F.lit(0)).cast("long").alias("bytes"),
        F.array_sort(F.collect_list(F.struct((~F.col("ok")).alias("failed"), pos, line.alias("line")))).alias("__lines"),
    )
    head = F.concat(F.col("produced").cast("string"), F.lit(" files, "), in_mib(F.col("bytes")))
    return each.select(*by, "produced", "skipped", "bytes", (F.col("skipped") == 0).alias("complete"), F.concat(F.array(head), F.transform("__lines", lambda x: x.line)).alias("lines"))


def scanned(probes: DataFrame, by: list[str], pos: str, bad: Column, good: Column) -> tuple[DataFrame, DataFrame]:
    """Probes in order until the first after which a scan can't be trusted: (those taken, with title, whether they hold one) and
    (by, declared, taken, decoded, trusted). The probe that breaks the trust is looked at but holds nothing."""
    first_bad = probes.groupBy(*by).agg(F.min(F.when(bad, F.col(pos))).alias("__stop"), F.count("*").alias("declared"))
    told = joined_by(probes, first_bad, by).filter(F.col("__stop").isNull() | (F.col(pos) <= F.col("__stop")))
    took = told.withColumn("title", good & (F.col("__stop").isNull() | (F.col(pos) < F.col("__stop"))))
    health = took.groupBy(*by).agg(F.first("declared").alias("declared"), F.count("*").alias("taken"), F.count_if("title").alias("decoded"), F.bool_and(F.col("__stop").isNull()).alias("trusted"))
    return took.drop("__stop", "declared"), health


def salvaged(chapters: DataFrame, by: list[str], pos: str, readable: Column) -> DataFrame:
    """(by, kept, lost, runs, told) of chapters: how many can be read, the numbers of those that can't, the runs of those that can
    as `2-4,6`, and the sentence that says what is missing, null if nothing is or nothing is left."""
    order = Window.partitionBy(*by).orderBy(pos)
    rows = chapters.withColumn("__ok", readable)
    same = F.lag("__ok").over(order) & (F.lag(pos).over(order) + 1 == F.col(pos))
    runs = rows.withColumn("__run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = runs.filter("__ok").groupBy(*by, "__run").agg(F.min(pos).alias("a"), F.max(pos).alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    listed = each.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x.t), ",").alias("runs"))
    sums = rows.groupBy(*by).agg(F.count_if("__ok").alias("kept"), F.array_sort(F.collect_list(F.when(~F.col("__ok"), F.col(pos)))).alias("lost"))
    numbers = F.array_join(F.transform("lost", lambda x: x.cast("string")), ", ")
    said = F.when((F.size("lost") > 0) & (F.col("kept") > 0), F.concat(F.lit("recovered without chapter"), F.when(F.size("lost") > 1, "s").otherwise(""), F.lit(" "), numbers))
    return joined_by(sums, listed, by, "left").select(*by, "kept", "lost", F.coalesce("runs", F.lit("")).alias("runs"), said.alias("told"))


def sampled(cues: DataFrame, by: list[str], tracks: int = SAMPLE_TRACKS, most: int = SAMPLE_CUES, enough: int = SAMPLE_SHAPES) -> DataFrame:
    """Of cues (by, track, cue, shapes) those that a table is judged by: the first `most` of each of a group's first `tracks`
    tracks, no track being opened once those before it gave `enough` shapes. Running sums are over tracks, not cues."""
    opened = cues.select(*by, "track").distinct().withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy("track")))
    looked = joined_by(cues, opened.filter(F.col("__nth") <= tracks), [*by, "track"]).withColumn("__cue", F.row_number().over(Window.partitionBy(*by, "track").orderBy("cue"))).filter(F.col("__cue") <= most)
    sums = looked.groupBy(*by, "track").agg(F.sum("shapes").alias("__shapes"))
    before = F.coalesce(F.sum("__shapes").over(Window.partitionBy(*by).orderBy("track").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    wanted = sums.withColumn("__before", before).filter(F.col("__before") < enough).select(*by, "track")
    return joined_by(looked, wanted, [*by, "track"]).drop("__nth", "__cue")


def cleared(files: DataFrame, record: DataFrame, by: list[str]) -> DataFrame:
    """Of files (by, name) what a run left that record (by, output_name) says it was about to write: names that begin with a
    recorded name's stem and a full stop. A name's beginnings before its full stops meet the stems by equality."""
    stem = F.when(F.col("output_name").rlike(r".\..*$"), F.regexp_replace("output_name", r"\.[^.]*$", "")).otherwise(F.col("output_name"))
    stems = record.select(*by, stem.alias("__stem")).filter("__stem <> ''").distinct()
    pieces = F.split("name", r"\.")
    starts = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "."))
    dotted = files.filter(F.instr("name", ".") > 0)
    named = dotted.select(*by, "name", F.explode(starts).alias("__stem")).distinct()
    hit = joined_by(named, stems.withColumn("__hit", F.lit(True)), [*by, "__stem"]).select(*by, "name").distinct()
    return hit


def devices(arguments: DataFrame, mounts: DataFrame, by: list[str]) -> DataFrame:
    """arguments (by, argument) with device, what is mounted exactly there, and within, the device of the longest mount that the
    path lies in. mounts (by, device, at, pos) are lines of a mount table; the first of equals counts, and only devices do. A
    device node stands for itself. Paths meet mounts by the equality of their ancestors, so nested mounts cost no pairs."""
    path = F.regexp_replace(F.when(F.col("argument").startswith("file://"), percent_decode(F.substring("argument", 8, 1 << 30))).otherwise(F.col("argument")), "/+$", "")
    asked = arguments.withColumn("__path", path)
    real = mounts.filter(F.col("device").startswith("/dev/")).withColumn("__at", F.regexp_replace(unescape_octal(F.col("at")), "(?<=.)/+$", ""))
    first = real.groupBy(*by, "__at").agg(F.min_by("device", "pos").alias("__device"))
    pieces = F.split("__path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda n: F.array_join(F.slice(pieces, F.lit(1), n), "/"))
    each = asked.filter("__path like '/%'").select(*by, "argument", "__path", F.explode(ancestors).alias("__start")).withColumn("__at", F.when(F.col("__start") == "", "/").otherwise(F.col("__start")))
    met = joined_by(each.distinct(), first, [*by, "__at"])
    best = met.groupBy(*by, "argument").agg(F.max_by("__device", F.length("__at")).alias("within"), F.max(F.when(F.col("__at") == F.col("__path"), F.col("__device"))).alias("__exact"))
    found = joined_by(asked, best, [*by, "argument"], "left")
    node = F.when(F.col("__path").startswith("/dev/"), F.col("__path"))
    return found.select(*arguments.columns, F.coalesce(node, "__exact").alias("device"), F.coalesce(node, "within").alias("within"))
