"""What carriers and files are by their first bytes and by what drives say of them, and what their parts should weigh."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .media import last_frame
from .strings import percent_encode

#: Bytes of a raw sector and of a cooked one, of a sound file's header, and seconds that a picture is sampled for.
RAW, COOKED, WAV_HEADER, SAMPLE_SECONDS = 2352, 2048, 44, 20
#: Fixed value: a sector that players skip: a padding packet that fills it.
PADDING = b"\x00\x00\x01\xbe" + (COOKED - 6).to_bytes(2, "big") + b"\xff" * (COOKED - 6)


def data_mode(raw: Column) -> Column:
    """What a raw sector's header says that it holds; a sector without one is sound."""
    byte = F.hex(F.substring(raw, 16, 1))
    return F.when(byte == "01", "Mode1").when(byte == "02", "Mode2").otherwise("Audio")


def cue_name(mode: Column) -> Column:
    return F.when(mode == "Mode1", "MODE1/2352").when(mode == "Mode2", "MODE2/2352").otherwise("AUDIO")


def medium(profile: Column) -> Column:
    """The medium that a drive's current profile is one of; null for others."""
    return F.when(profile.between(0x08, 0x0A), "Cd").when(profile.between(0x10, 0x1B), "Dvd").when(profile.between(0x40, 0x43), "BluRay")


def raw_sector(medium_: Column) -> Column:
    return F.when(medium_ == "Cd", RAW).when(medium_.isNotNull(), COOKED)


def is_volume_descriptor(data: Column) -> Column:
    return F.coalesce((F.octet_length(data) >= 72) & (F.hex(F.substring(data, 1, 6)) == "014344303031"), F.lit(False))


def is_matroska(data: Column) -> Column:
    return F.coalesce(F.hex(F.substring(data, 1, 4)) == "1A45DFA3", F.lit(False))


def expected_file(track_bytes: Column) -> Column:
    """What a sound track's file should weigh, its header included; null for a track that is not there."""
    return track_bytes + WAV_HEADER


def size_problem(track: Column, expected: Column, actual: Column) -> Column:
    """What is wrong with a file that came out too small; null if nothing is, or if nobody knows what it should weigh."""
    said = F.concat(F.lit("track "), track.cast("string"), F.lit(" came back "), (expected - actual).cast("string"), F.lit(" bytes short of "), expected.cast("string"), F.lit("; the disc did not read completely"))
    return F.when(actual < expected, said)


def stream_kind(name: Column) -> Column:
    """The kind that a program's word for it means; some say subtitles, some subtitle."""
    said = F.lower(F.trim(name))
    return F.when(said == "video", "video").when(said == "audio", "audio").when(said.isin("subtitles", "subtitle"), "subtitle").otherwise("other")


def is_output(role: Column) -> Column:
    return role != "PlayAll"


def disc_told(kind: Column, described: Column, label: Column) -> Column:
    """What a drive's disc is called: an audio disc is described, others go by their label or else by what they are."""
    return F.when(kind == "Audio", described).when(label.isNotNull(), label).when(kind.isNotNull() & (kind != "Empty"), described).otherwise("(empty)")


def has_disc(kind: Column, label: Column) -> Column:
    return F.when(kind.isNotNull(), kind != "Empty").otherwise(label.isNotNull())


def decoded_rate(errors: Column, output: Column) -> Column:
    """Frames a second that were decoded of a sample: what the program last said, on either of its outputs."""
    return F.coalesce(last_frame(errors), last_frame(output), F.lit(0)) / SAMPLE_SECONDS


def release_url(query: Column, limit: int) -> Column:
    return F.concat(F.lit("https://musicbrainz.org/ws/2/release/?query="), percent_encode(query), F.lit(f"&fmt=json&limit={limit}&dismax=true"))


def images_url(titles: Column) -> Column:
    """One request for the pictures of several articles."""
    joined = F.array_join(F.transform(titles, percent_encode), "%7C")
    return F.concat(F.lit("https://en.wikipedia.org/w/api.php?action=query&prop=pageimages&piprop=thumbnail&pithumbsize=342&pilicense=any&titles="), joined, F.lit("&format=json&redirects=1"))
