"""Answers of public film, television and music catalogues, which arrive as JSON text in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.strings import describe_show
from ..functions.times import year_of

_SHOW = "struct<id:bigint,name:string,type:string,premiered:string,ended:string,status:string,network:struct<name:string>,webChannel:struct<name:string>,image:struct<medium:string,original:string>>"


def _clamped(score: Column) -> Column:
    return F.least(F.greatest(F.coalesce(score, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def show_search(answers: DataFrame) -> DataFrame:
    """(question, hit_pos, work_id, title, year, score, detail, poster) of answers (question, json): arrays of scored shows."""
    hits = answers.select("question", F.posexplode(F.from_json("json", f"array<struct<score:double,show:{_SHOW}>>")).alias("hit_pos", "h"))
    s = lambda name: F.col(f"h.show.{name}")
    detail = describe_show(F.coalesce(s("network.name"), s("webChannel.name")), s("type"), s("premiered"), s("ended"), s("status"))
    return hits.select(
        "question", "hit_pos", F.concat(F.lit("tvmaze:"), s("id").cast("string")).alias("work_id"), s("name").alias("title"), year_of(s("premiered")).alias("year"),
        _clamped(F.col("h.score")).alias("score"), detail.alias("detail"), F.coalesce(s("image.original"), s("image.medium")).alias("poster"),
    ).filter("title is not null")


def show_episodes(answers: DataFrame) -> DataFrame:
    """(work_id, season, number, name, airdate, runtime_ms) of answers (work_id, json); specials, numbered 0 or not at all, go."""
    rows = answers.select("work_id", F.explode(F.from_json("json", "array<struct<season:int,number:int,name:string,airdate:string,runtime:bigint>>")).alias("e"))
    return rows.filter("e.number > 0").select("work_id", "e.season", "e.number", "e.name", F.nullif(F.col("e.airdate"), F.lit("")).alias("airdate"), (F.col("e.runtime") * 60_000).alias("runtime_ms"))


def ranked_search(answers: DataFrame) -> DataFrame:
    """Films or series of answers (question, json) that say no score: it falls with the place, from 1 to a half; the
    untitled are dropped only after that."""
    kind = "struct<results:array<struct<id:bigint,title:string,name:string,release_date:string,first_air_date:string,overview:string,poster_path:string>>>"
    read = answers.select("question", F.col("json"), F.from_json("json", kind)["results"].alias("r"))
    hits = read.select("question", F.size("r").alias("n"), F.posexplode("r").alias("hit_pos", "h"))
    title = F.nullif(F.coalesce("h.title", "h.name"), F.lit(""))
    date = F.coalesce("h.release_date", "h.first_air_date")
    return hits.select("question", "hit_pos", F.concat(F.lit("tmdb:"), F.col("h.id").cast("string")).alias("work_id"), title.alias("title"), year_of(date).alias("year"), (1 - F.col("hit_pos") / F.col("n") * 0.5).alias("score"), F.col("h.poster_path").alias("poster")).filter("title is not null")


def season_episodes(answers: DataFrame) -> DataFrame:
    """(work_id, season, number, name, airdate, runtime_ms) of answers (work_id, season, json): one season each."""
    rows = answers.select("work_id", "season", F.explode(F.from_json("json", "struct<episodes:array<struct<episode_number:int,name:string,air_date:string,runtime:bigint>>>")["episodes"]).alias("e"))
    return rows.filter("e.episode_number <> 0").select("work_id", "season", F.col("e.episode_number").alias("number"), "e.name", F.nullif(F.col("e.air_date"), F.lit("")).alias("airdate"), (F.col("e.runtime") * 60_000).alias("runtime_ms"))


#: Classes of entities that are films.
FILM_CLASSES = ("Q11424", "Q24862", "Q202866", "Q506240", "Q24869", "Q29168811", "Q93204", "Q226730")


def entity_search(answers: DataFrame) -> DataFrame:
    """(question, hit_pos, entity, description) in the order of the search."""
    rows = answers.select("question", F.posexplode(F.from_json("json", "struct<search:array<struct<id:string,description:string>>>")["search"]).alias("hit_pos", "h"))
    return rows.select("question", "hit_pos", F.col("h.id").alias("entity"), F.col("h.description").alias("description"))


def entity_films(answers: DataFrame, found: DataFrame) -> DataFrame:
    """Films among entities: answers (question, json) joined by id to what entity_search found, which gives rank and text.

    The join is by key, so an entity that is no film can't shift what belongs to those behind it.
    """
    value = "array<struct<mainsnak:struct<datavalue:struct<value:string>>>>"
    entity = f"struct<labels:map<string,struct<value:string>>,claims:struct<P31:{value},P577:{value},P2047:{value},P154:{value}>,sitelinks:map<string,struct<title:string>>>"
    rows = answers.select("question", F.explode(F.from_json("json", f"struct<entities:map<string,{entity}>>")["entities"]).alias("entity", "e"))
    said = lambda c: F.transform(F.col(f"e.claims.{c}"), lambda x: x.mainsnak.datavalue.value)
    first = lambda c: F.try_element_at(said(c), F.lit(1))
    classes = F.transform(said("P31"), lambda v: F.get_json_object(v, "$.id"))
    kept = rows.filter(F.arrays_overlap(classes, F.array(*map(F.lit, FILM_CLASSES)))).select(
        "question", "entity", F.coalesce(F.col("e.labels")["en"]["value"], F.col("entity")).alias("title"),
        F.regexp_extract(F.get_json_object(first("P577"), "$.time"), r"([0-9]{4})-", 1).try_cast("int").alias("year"),
        (F.regexp_extract(F.get_json_object(first("P2047"), "$.amount"), r"([0-9]+)", 1).try_cast("bigint") * 60_000).alias("runtime_ms"),
        first("P154").alias("logo"), F.col("e.sitelinks")["enwiki"]["title"].alias("article"),
    )
    sizes = found.groupBy("question").agg(F.count("*").alias("__n"))
    ranked = kept.join(found, ["question", "entity"]).join(sizes, "question")
    return ranked.withColumn("score", 1 - F.col("hit_pos") / F.col("__n") * 0.5).drop("__n")


def article_images(answers: DataFrame) -> DataFrame:
    """(title, url) of answers (json), under the article's own title and each that redirects to it; queries are cut off."""
    shape = "struct<query:struct<redirects:array<struct<from:string,to:string>>,pages:map<string,struct<title:string,original:struct<source:string>,thumbnail:struct<source:string>>>>>"
    read = answers.select(F.from_json("json", shape)["query"].alias("q"))
    pages = read.select("q", F.explode("q.pages").alias("page_key", "p"))
    url = F.split(F.coalesce("p.original.source", "p.thumbnail.source"), r"\?")[0]
    own = pages.select("q", F.col("p.title").alias("title"), url.alias("url")).filter("url is not null")
    aliased = own.select("title", "url", F.explode(F.filter("q.redirects", lambda r: r.to == F.col("title"))).alias("r"))
    return own.select("title", "url").unionByName(aliased.select(F.col("r.from").alias("title"), "url"))


_CREDIT = "array<struct<name:string,joinphrase:string>>"
_RELEASE = (
    f"struct<id:string,title:string,date:string,country:string,barcode:string,`artist-credit`:{_CREDIT},`label-info`:array<struct<`catalog-number`:string,label:struct<name:string>>>,"
    f"media:array<struct<position:int,format:string,`track-count`:int,discs:array<struct<id:string>>,tracks:array<struct<position:int,title:string,length:bigint,recording:struct<length:bigint>,`artist-credit`:{_CREDIT}>>>>>"
)


def credit(parts: Column) -> Column:
    """Names with what joins them; null where nothing is left."""
    return F.nullif(F.trim(F.array_join(F.transform(parts, lambda p: F.concat(F.coalesce(p["name"], F.lit("")), F.coalesce(p["joinphrase"], F.lit("")))), "")), F.lit(""))


def albums(answers: DataFrame) -> DataFrame:
    """(disc_id, release_id, title, artist, year, country, label, catalogue_number, barcode, disc, discs, tracks) of answers
    (disc_id, json): the medium that holds the disc, else the first; a track's artist only where it is not the album's."""
    read = answers.select("disc_id", F.posexplode(F.from_json("json", f"struct<releases:array<{_RELEASE}>>")["releases"]).alias("pos", "r"))
    holds = F.filter("r.media", lambda m: F.exists(m["discs"], lambda d: d["id"] == F.col("disc_id")))
    rows = read.withColumns({"m": F.coalesce(F.get(holds, F.lit(0)), F.get("r.media", F.lit(0))), "artist": credit(F.col("r.artist-credit"))})
    tracks = F.transform(
        "m.tracks",
        lambda t: F.struct(t["position"].alias("number"), t["title"].alias("title"), F.coalesce(t["length"], t["recording"]["length"]).alias("length_ms"), F.nullif(credit(t["artist-credit"]), F.col("artist")).alias("artist")),
    )
    label = F.get("r.label-info", F.lit(0))
    return rows.select(
        "disc_id", "pos", F.col("r.id").alias("release_id"), F.col("r.title").alias("title"), "artist", year_of(F.col("r.date")).alias("year"), F.col("r.country").alias("country"),
        label["label"]["name"].alias("label"), label["catalog-number"].alias("catalogue_number"), F.col("r.barcode").alias("barcode"),
        F.coalesce("m.position", F.lit(1)).alias("disc"), F.size("r.media").alias("discs"), tracks.alias("tracks"),
    )


def release_search(answers: DataFrame) -> DataFrame:
    """(question, hit_pos, release_id, artist, title, tracks, detail) of answers (question, json) to a search for releases. The
    first medium's number of tracks counts, else the release's; an answer that is no object of releases has no hits."""
    medium = "struct<format:string,`track-count`:bigint>"
    kind = f"struct<releases:array<struct<id:string,title:string,date:string,country:string,`artist-credit`:array<struct<name:string,joinphrase:string>>,media:array<{medium}>,`track-count`:bigint>>>"
    hits = answers.select("question", F.posexplode(F.from_json("json", kind)["releases"]).alias("hit_pos", "h"))
    first = F.get(F.col("h.media"), F.lit(0))
    tracks = F.coalesce(first["track-count"], F.col("h.track-count"), F.lit(0).cast("long"))
    artist = F.array_join(F.transform(F.col("h.artist-credit"), lambda a: F.concat(a["name"], F.coalesce(a["joinphrase"], F.lit("")))), "")
    said = [F.substring("h.date", 1, 4), F.col("h.country"), first["format"]]
    detail = F.concat_ws(" - ", *(F.when(x != "", x) for x in said), F.concat(tracks.cast("string"), F.lit(" tracks")))
    return hits.select("question", "hit_pos", F.col("h.id").alias("release_id"), artist.alias("artist"), F.col("h.title").alias("title"), tracks.alias("tracks"), detail.alias("detail"))
