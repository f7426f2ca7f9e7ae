"""Pictures, sound, settings and tags, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import ascii_lower

#: Tier of quality -> (constant rate factor of the picture, level of variable rate of the sound).
TIERS = {"high": (18, 0), "medium": (20, 2), "low": (23, 5)}
#: Other words for a tier.
TIER_WORDS = {"med": "medium"}
#: Fixed value: address of a picture, by its coded name.
COMMONS = "https://commons.wikimedia.org/wiki/Special:FilePath/{}?width=342"
#: Bytes of a raw sector, and of a sample of two channels.
RAW_SECTOR, SAMPLE = 2352, 4


def parse_quality(word: Column) -> Column:
    """high, medium or low; null for any other word."""
    clean = ascii_lower(F.trim(word))
    for other, tier in TIER_WORDS.items():
        clean = F.when(clean == other, tier).otherwise(clean)
    return F.when(clean.isin(*TIERS), clean)


def _of_tier(tier: Column, i: int) -> Column:
    return F.coalesce(*(F.when(tier == name, F.lit(values[i])) for name, values in TIERS.items()))


def crf(tier: Column) -> Column:
    return _of_tier(tier, 0)


def vbr_level(tier: Column) -> Column:
    return _of_tier(tier, 1)


def quality_applies(audio_format: Column) -> Column:
    """A setting of quality changes nothing where nothing is lost."""
    return audio_format == "mp3"


def frame_rate(text: Column) -> Column:
    """`30000/1001` as a number; nothing after a slash, or none, counts as 1; a denominator of 0 gives 0."""
    parts = F.split(text, "/", 2)
    top = F.coalesce(F.get(parts, F.lit(0)).try_cast("double"), F.lit(0.0))
    bottom = F.coalesce(F.get(parts, F.lit(1)).try_cast("double"), F.lit(1.0))
    return F.when(bottom == 0, F.lit(0.0)).otherwise(F.try_divide(top, bottom))


def cropped(crop: Column, width: Column, height: Column) -> Column:
    """struct(width, height) without black bars: of `crop=w:h:x:y` if it can be read, else as stored."""
    part = lambda i: F.get(F.split(F.regexp_replace(crop, "^crop=", ""), ":"), F.lit(i)).try_cast("int")
    known = part(0).isNotNull() & part(1).isNotNull()
    return F.struct(F.when(known, part(0)).otherwise(width).alias("width"), F.when(known, part(1)).otherwise(height).alias("height"))


def last_frame(output: Column) -> Column:
    """The last `frame= n` of a program's output, whose lines are rewritten after carriage returns; null if none."""
    updates = F.regexp_extract_all(output, F.lit(r"(?:^|[\r\n])\s*frame=\s*([0-9]+)"), F.lit(1))
    return F.element_at(F.when(F.size(updates) > 0, updates), -1).try_cast("long")


def fill_index(alpha: Column, colours: Column) -> Column:
    """Place of the brightest of colours (array of struct r, g, b) that is not clear (alpha, array); the first of equals."""
    light = F.transform(colours, lambda c, i: F.when(F.get(alpha, i) != 0, F.struct((c.r * 299 + c.g * 587 + c.b * 114).alias("light"), (-i).alias("back"))))
    return -F.array_max(light)["back"]


def commons_image(file: Column) -> Column:
    from .strings import percent_encode

    before, after = COMMONS.split("{}")
    return F.concat(F.lit(before), percent_encode(file), F.lit(after))


def shifted(run: Column, at: Column, size: Column, shift: int) -> Column:
    """`size` bytes from `at` + shift of a run of bytes (hex text), with silence outside it; the bytes of one corrected
    track, as hex text."""
    start = at + shift
    length = F.length(run) / 2
    silent_before = F.least(size, F.greatest(-start, F.lit(0))).cast("int")
    from_byte = F.greatest(start, F.lit(0))
    taken = F.greatest(F.least(length - from_byte, size - silent_before), F.lit(0)).cast("int")
    zeros = lambda n: F.repeat(F.lit("00"), n.cast("int"))
    return F.concat(zeros(silent_before), F.substring(run, (2 * from_byte + 1).cast("int"), 2 * taken), zeros(size - silent_before - taken))


def silent(at: Column, size: Column, total: Column, shift: int) -> Column:
    """Bytes of a corrected track that lie outside the run of `total` bytes."""
    start, end = at + shift, at + size + shift
    inside = F.greatest(F.least(end, total) - F.greatest(start, F.lit(0)), F.lit(0))
    return size - inside
