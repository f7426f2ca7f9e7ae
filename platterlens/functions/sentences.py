"""Sentences that reports are made of, as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .times import whole

#: Kind of warning -> its sentence. `{why}` is a field; `{n:shape}` counts, as `1 shape` or `2 shapes`.
WARNINGS = {
    "CouldNotIdentify": "could not identify the disc: {why}",
    "TitleUnreadable": "title {title} could not be read: {why}",
    "NoPlayAll": "no play-all title on this disc; ordering {n:episode} by disc layout instead",
    "ExtendedCutsUncomparable": "could not compare titles for extended cuts: {why}",
    "GlyphTableUnreadable": "glyph table {path}: {why}",
    "GlyphTableMissing": "glyph table {path} does not exist",
    "NoGlyphTable": "no glyph table could be made, so subtitles stay as bitmaps",
    "ItemSkipped": "{name}: {why}",
    "UnrecognisedGlyphs": "{language}: {n:unrecognised glyph} - the table may not cover {language}",
    "GlyphTableIsForAnotherFont": "the glyph table was built for another release and does not fit this disc ({n:shape} on it are not in it); subtitles kept as pictures",
    "CannotReadLanguage": "no {language} reader is installed, so those subtitles were kept as pictures rather than read with another language's alphabet",
    "CannotLearnLettering": "no glyph table fits this disc and tesseract is not installed to read its {n:shape}; subtitles kept as pictures",
    "SubtitlesUnreadable": "{language} subtitles could not be read: {why}",
    "PlayAllsSkipped": "skipping {n:play-all title}, whose content is on the disc already",
    "FreeReaderIncomplete": "the free reader could not read this disc fully ({why}); using MakeMKV",
    "FreeReaderFailed": "the free reader failed ({why}); using MakeMKV",
    "DumpIncomplete": "{why}",
    "TrackCorrupt": "track {title} is corrupt: {n:sector} disagree with the error detection written into them",
    "CacheNotCleared": "{path}: {why} - the cache folder still holds it",
    "TrackDamaged": "track {title} is damaged: the drive had to guess at {n:sector}",
}
#: Stage of a job -> what it is called.
STAGES = {
    "Scan": "Scanning disc",
    "Identify": "Identifying",
    "Rip": "Ripping",
    "Organise": "Sorting titles",
    "Verify": "Verifying",
    "Subtitles": "Reading subtitles",
    "Lettering": "Learning this disc's lettering",
    "Transcode": "Transcoding",
}


def plural(n: Column, noun: str) -> Column:
    """`1 title`, `2 titles`, `0 titles`."""
    return F.concat(n.cast("string"), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def filled(template: str, **fields: Column) -> Column:
    """A sentence with its fields; null if one that it has is null."""
    parts = []
    for text, name, noun in re.findall(r"([^{]*)(?:\{([a-z]+)(?::([^}]*))?\})?", template):
        parts += [F.lit(text)] if text else []
        parts += [plural(fields[name], noun) if noun else fields[name].cast("string")] if name else []
    return F.concat(*parts)


def chosen(key: Column, values: dict[str, Column | str]) -> Column:
    """The value of the key; null for any other."""
    found = F.lit(None).cast("string")
    for name, value in reversed(values.items()):
        found = F.when(key == name, value).otherwise(found)
    return found


def warning_text(kind: Column, **fields: Column) -> Column:
    return chosen(kind, {name: filled(template, **fields) for name, template in WARNINGS.items()})


def stage_label(stage: Column) -> Column:
    return chosen(stage, STAGES)


def describe_disc(kind: Column, n_audio: Column, leadout: Column, has_data: Column) -> Column:
    """A line for a list of drives. Audio and data discs say how many tracks of audio they have."""
    audio = F.concat(F.lit("audio CD, "), n_audio.cast("string"), F.lit(" tracks, "), whole(leadout, 75 * 60).cast("string"), F.lit(" min"), F.when(has_data, ", with data track").otherwise(""))
    data = F.when(n_audio > 0, F.concat(F.lit("data disc, "), n_audio.cast("string"), F.lit(" audio track(s) beside it"))).otherwise("data disc")
    return chosen(kind, {"DvdVideo": "DVD-Video", "BluRay": "Blu-ray", "Data": data, "Empty": "empty", "Audio": audio})


def describe_game(label: Column, serial: Column) -> Column:
    return F.coalesce(F.concat(label, F.lit(" ("), serial, F.lit(")")), label, serial, F.lit("unnamed disc"))


def near_miss(matched: Column, n: Column, game: Column, differing: Column) -> Column:
    """How many tracks are an entry's, and which (array) are not."""
    which = F.array_join(F.transform(differing, lambda x: x.cast("string")), ", ")
    return F.concat(matched.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" tracks match "), game, F.lit(".\nTrack"), F.when(F.size(differing) == 1, "").otherwise("s"), F.lit(" "), which, F.lit(" do not, so this is that disc rather than one nobody has catalogued."))


def rescue_summary(recovered: Column, left: Column, bad: Column, sector_bytes: int) -> Column:
    size = lambda n: n.cast("double") * sector_bytes / 1e9
    return F.format_string("%.2f GB recovered, %.2f GB left, %d bad sectors", size(recovered), size(left), bad)


def complaint(failed: Column, read_errors: Column) -> Column:
    """What is wrong with a scan: parts (array) that stay locked, and sectors that can't be read. Empty if nothing is."""
    parts = F.when(F.size(failed) == 1, "a part").otherwise("parts")
    locked = F.concat(F.lit("libdvdcss could not decrypt "), parts, F.lit(" of the disc ("), F.array_join(failed, ", "), F.lit(") - titles in those parts are missing from this scan"))
    return F.concat_ws("; ", F.when(F.size(failed) > 0, locked), F.when(read_errors > 0, F.concat(read_errors.cast("string"), F.lit(" unreadable sectors"))))

