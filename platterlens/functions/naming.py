"""Where results go in a library, what they are called, and the tags they carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strings import counted, episode_code, render, render_path, sanitize

#: Templates where none is given.
EPISODE, TRACK = "{show} - S{season}E{episode} - {title}", "{track} - {title}"


def described(title: Column, year: Column, season: Column | None = None) -> Column:
    """`Title (1999) - season 2`, as much of it as is known."""
    work = F.when(year.isNotNull(), F.concat(title, F.lit(" ("), year.cast("string"), F.lit(")"))).otherwise(title)
    return work if season is None else F.when(season.isNotNull(), F.concat(work, F.lit(" - season "), season.cast("string"))).otherwise(work)


def subdirectory(role: Column) -> Column:
    return F.when(role.isin("ExtendedCut", "Extra"), "extras")


def wanted(role: Column, extended_cuts: bool = True, extras: bool = True) -> Column:
    return F.when(role.isin("Episode", "Feature"), True).when(role == "ExtendedCut", extended_cuts).when(role == "Extra", extras).otherwise(F.lit(False))


def file_name(media: Column, show: Column, year: Column, role: Column, season: Column, number: Column, title: Column, extension: str, template: str = EPISODE) -> Column:
    """An item's name by its role in a series or a film."""
    of_series, episodic = media == "series", role.isin("Episode", "ExtendedCut")
    filled = render(template, show=show, season=season, episode=number, title=title, year=year)
    plain = F.concat(episode_code(season, number), F.lit(" - "), title)
    stem = (
        F.when(of_series & (role == "Episode"), filled).when(of_series & (role == "ExtendedCut"), F.concat(filled, F.lit(" - Extended Cut")))
        .when(~of_series & (role == "Feature"), described(show, year)).when(role == "PlayAll", F.concat(title, F.lit(" (play-all)"))).when(episodic, plain).otherwise(title)
    )
    return F.concat(sanitize(stem), F.lit(f".{extension}"))


def destination(root: str, media: Column, media_season: Column, role: Column, season: Column, name: Column) -> Column:
    """root, a season's folder for series, a folder for extras, and the name."""
    folder = F.when(media == "series", F.format_string("Season %02d", F.coalesce(F.when(role.isin("Episode", "ExtendedCut"), season), media_season)))
    return F.concat_ws("/", F.lit(root), folder, subdirectory(role), name)


def track_path(root: str, albumartist: Column, artist: Column, album: Column, year: Column, disc: Column, discs: Column, number: Column, title: Column, extension: str, template: str = TRACK) -> Column:
    """A track's path: artist, album with year, disc where there are several, and the name; a template with slashes tells
    the whole path instead."""
    fields = {"albumartist": albumartist, "artist": F.coalesce(artist, albumartist), "album": album, "title": title, "track": number, "disc": F.when(discs > 1, disc), "year": year}
    filled = {k: F.coalesce(v.cast("string"), F.lit("")) if k in ("disc", "year") else v for k, v in fields.items()}
    end = F.lit(f".{extension}")
    if "/" in template:
        parts = render_path(template, **filled)
        return F.concat_ws("/", F.lit(root), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/"), sanitize(F.concat(F.element_at(parts, -1), end)))
    place = F.when(discs > 1, F.concat(F.lit("Disc "), disc.cast("string")))
    return F.concat_ws("/", F.lit(root), sanitize(albumartist), sanitize(described(album, year)), place, sanitize(F.concat(render(template, **filled), end)))


def tags(media: Column, show: Column, year: Column, role: Column, season: Column, number: Column, title: Column, date: Column) -> Column:
    """The tags a file gets: an episode's, a film's, or a name and a show."""
    episode = (media == "series") & role.isin("Episode", "ExtendedCut")
    display = F.when(role == "ExtendedCut", F.concat(title, F.lit(" (Extended Cut)"))).otherwise(title)
    film = media == "movie"
    return F.struct(
        F.when(episode, display).when(film, show).otherwise(title).alias("title"), F.when(~film, show).alias("show"), F.when(episode, season).alias("season_number"), F.when(episode, number).alias("episode_sort"),
        F.when(episode, display).alias("episode_id"), F.when(episode, date).when(film, year.cast("string")).alias("date"), F.when(episode, 10).when(film, 9).alias("media_type"),
    )


def pairs(tags_: Column, names: dict[str, str]) -> Column:
    """The tags that are there, as (name, value) in the order of names (field -> name)."""
    every = F.array(*(F.struct(F.lit(name).alias("name"), tags_[field].cast("string").alias("value")) for field, name in names.items()))
    return F.filter(every, lambda p: p.value.isNotNull())


def plan_lines(episodes: Column, features: Column, extended_cuts: Column, extras: Column, play_alls: Column) -> Column:
    """What a disc holds and what of it is skipped, as sentences."""
    parts = F.concat_ws(", ", counted(episodes, "episode", "episodes"), counted(features, "feature", "features"), counted(extended_cuts, "extended cut", "extended cuts"), counted(extras, "extra", "extras"))
    skipped = F.concat(F.lit("skipping "), counted(play_alls, "play-all title", "play-all titles"), F.lit(" - the same video again"))
    return F.array_compact(F.array(F.when(parts != "", F.concat(F.lit("holds "), parts)), skipped))
