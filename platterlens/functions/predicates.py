"""Yes-or-no questions about titles, tracks, dumps and readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_episode_length(ms: Column) -> Column:
    return ms.between(15 * 60_000, 45 * 60_000)


def is_bitmap_subtitle(kind: Column, codec: Column) -> Column:
    return (kind == "subtitle") & codec.isin("dvd_subtitle", "hdmv_pgs_subtitle")


def is_commentary(title: Column) -> Column:
    return F.coalesce(F.lower(title).rlike("commentary|director"), F.lit(False))


def is_short(expected_ms: Column, actual_ms: Column) -> Column:
    """More than three seconds or a fiftieth is missing."""
    missing = expected_ms - actual_ms
    return (missing > 3000) | (missing > expected_ms * 0.02)


def is_trustworthy(failed: Column, read_errors: Column) -> Column:
    return (F.size(failed) == 0) & (read_errors == 0)


def is_complete(corrupt: Column, damaged: Column, unreadable: Column) -> Column:
    return (corrupt == 0) & (damaged == 0) & (unreadable == 0)


def is_usable(cues: Column, unknown: Column) -> Column:
    """A recognised stream of which at most half the cues hold something unknown."""
    return (cues > 0) & (unknown < 0.5 * cues)


def is_multi_track(names: Column) -> Column:
    """A game with more than one file that is no cue sheet."""
    return F.size(F.filter(names, lambda n: ~F.lower(n).endswith(".cue"))) > 1


def crop_is_worthwhile(crop: Column, width: Column, height: Column) -> Column:
    """`crop=w:h:x:y` takes four columns or rows or more away."""
    part = lambda i: F.try_element_at(F.split(F.regexp_replace(crop, "^crop=", ""), ":"), F.lit(i)).try_cast("int")
    return F.coalesce((width - part(1) >= 4) | (height - part(2) >= 4), F.lit(False))


def looks_like_data(sector: Column) -> Column:
    return F.coalesce(F.hex(F.substring(sector, 1, 12)) == "00FFFFFFFFFFFFFFFFFFFF00", F.lit(False))


def disc_kind(has_audio: Column, has_video_ts: Column, has_bdmv: Column, has_data: Column) -> Column:
    """Audio first, then what folders tell, then data or nothing."""
    return F.when(has_audio, "Audio").when(has_video_ts, "Dvd").when(has_bdmv, "BluRay").when(has_data, "Data").otherwise("Empty")


def shortfall(corrupt: Column, damaged: Column, unreadable: Column, sectors: Column) -> Column:
    """Why a dump can't match, the worst reason first; null if nothing is wrong with it."""
    of = lambda n: F.concat(n.cast("string"), F.lit(" of "), sectors.cast("string"), F.lit(" sectors "))
    return (
        F.when(corrupt > 0, F.concat(of(corrupt), F.lit("disagree with their error detection")))
        .when((unreadable == 0) & (damaged > 0), F.concat(of(damaged), F.lit("are the drive's best guess")))
        .when(unreadable > 0, F.concat(of(unreadable), F.lit("could not be read ("), F.floor(unreadable * 2352 / 1024).cast("string"), F.lit(" KB)")))
    )


def is_compilation(artists: Column, albumartist: Column) -> Column:
    """Whether any of an album's tracks (an array of artists) is by another than the album."""
    return F.exists(artists, lambda a: ~a.eqNullSafe(albumartist))


def is_multi_disc(discs: Column) -> Column:
    return F.coalesce(discs > 1, F.lit(False))


def nothing_failed(failed: Column) -> Column:
    return failed == 0


def holds(ids: Column, wanted: Column) -> Column:
    return F.coalesce(F.array_contains(ids, wanted), F.lit(False))
