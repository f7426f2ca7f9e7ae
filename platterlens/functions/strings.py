"""Strings: labels of discs, names of files, small text repairs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a volume label that describe the disc and not the work.
LABEL_NOISE = ("DVD", "NTSC", "PAL", "R1", "R2", "R4", "WS", "FS", "SE", "CE", "VOL", "VOLUME", "SEASON", "SERIES", "DISC", "DISK", "SIDE", "BONUS", "EXTRA", "EXTRAS", "SET")
#: Names that some file systems keep for devices.
RESERVED = ("CON", "PRN", "AUX", "NUL", *(f"COM{i}" for i in range(1, 10)), *(f"LPT{i}" for i in range(1, 10)))
#: Accented letters and the letters they are drawn on.
ACCENTED, BARE = "àáâãäåāèéêëēìíîïòóôõöøùúûüýÿñç", "aaaaaaaeeeeeiiiioooooouuuuyync"


def ascii_upper(s: Column) -> Column:
    return F.translate(s, _LOWER, _UPPER)


def ascii_lower(s: Column) -> Column:
    return F.translate(s, _UPPER, _LOWER)


def label_tokens(label: Column) -> Column:
    """Upper-case tokens of a volume label, empty ones dropped."""
    return F.filter(F.split(ascii_upper(label), r"[_\-. +]"), lambda t: t != "")


def title_case(token: Column) -> Column:
    """Tokens of up to two bytes or with a digit stay; others keep their first letter and lower the rest."""
    plain = (F.octet_length(token) <= 2) | token.rlike("[0-9]")
    return F.when(plain, token).otherwise(F.concat(F.substring(token, 1, 1), ascii_lower(F.substr(token, F.lit(2)))))


def _number(token: Column) -> Column:
    return F.when(token.rlike(r"^\+?[0-9]{1,9}$"), token.cast("int"))


def parse_label(label: Column) -> Column:
    """struct(title, season, disc, year) that a volume label seems to tell.

    A fold over the tokens carries what is known so far and the word before, if that may take the next token as its
    number. `SEASON 3` and `DISC 2` set, the last time counting; `S7D1` fills only what is unknown; the last number from
    1900 to 2099 is the year and stays in the title.
    """
    tokens = label_tokens(label)
    combined = r"^([SD][0-9]+)+$"

    def last(token: Column, marker: str) -> Column:
        return F.when(token.rlike(combined), F.try_element_at(F.regexp_extract_all(token, F.lit(f"{marker}([0-9]+)"), F.lit(1)), F.lit(-1)).cast("int"))

    def state(words: Column, season: Column, disc: Column, year: Column, pending: Column) -> Column:
        return F.struct(words.alias("words"), season.cast("int").alias("season"), disc.cast("int").alias("disc"), year.cast("int").alias("year"), pending.cast("string").alias("pending"))

    null = F.lit(None)
    start = state(F.array().cast("array<string>"), null, null, null, null)

    def step(a: Column, t: Column) -> Column:
        n = _number(t)
        takes = a.pending.isNotNull() & n.isNotNull()
        of_season = a.pending.isin("SEASON", "SERIES")
        opens = t.isin("SEASON", "SERIES", "DISC", "DISK") & ~takes
        marked = t.rlike(combined) & ~takes
        year = F.when(n.between(1900, 2099), n).otherwise(a.year)
        kept = ~(takes | opens | marked | t.isin(*LABEL_NOISE))
        return state(
            F.when(kept, F.array_append(a.words, title_case(t))).otherwise(a.words),
            F.when(takes & of_season, n).when(marked, F.coalesce(a.season, last(t, "S"))).otherwise(a.season),
            F.when(takes & ~of_season, n).when(marked, F.coalesce(a.disc, last(t, "D"))).otherwise(a.disc),
            year,
            F.when(opens, t),
        )

    return F.aggregate(tokens, start, step, lambda a: F.struct(F.array_join(a.words, " ").alias("title"), a.season.alias("season"), a.disc.alias("disc"), a.year.alias("year")))


def sanitize(name: Column) -> Column:
    """A name that every common file system takes."""
    s = F.regexp_replace(name, ":", " - ")
    s = F.translate(s, '/\\<>"|?*', "--------")
    s = F.regexp_replace(s, r"[\x00-\x1F]", " ")
    s = F.trim(F.regexp_replace(s, " +", " "))
    s = F.rtrim(F.regexp_replace(s, r"\.+$", ""))
    stem = ascii_upper(F.split(s, r"\.")[0])
    return F.when(stem.isin(*RESERVED), F.concat(F.lit("_"), s)).when(~s.rlike(r"[\p{L}\p{N}]"), F.lit("untitled")).otherwise(s)


def render(template: str, **fields: Column) -> Column:
    """A template with `{name}` and `{name:width}` filled: numbers padded with zeros to the width (2 unless told), unknown
    names and unclosed braces left as they stand. The template is a constant, so it is read once and becomes one concat."""
    import re

    out, at = [], 0
    for m in re.finditer(r"\{([a-z_]+)(?::([0-9]+))?\}", template):
        if m[1] not in fields:
            continue
        out.append(F.lit(template[at : m.start()]))
        value = fields[m[1]]
        text = value.cast("string")
        width = int(m[2] or 2)
        out.append(F.when(text.rlike("^[0-9]+$") & (F.length(text) < width), F.lpad(text, width, "0")).otherwise(text))
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def render_path(template: str, **fields: Column) -> Column:
    """Segments of a path: the template is cut at slashes before it is filled; blank, `.` and `..` segments are dropped."""
    parts = F.array(*(render(p, **fields) for p in template.split("/")))
    return F.filter(F.transform(F.filter(parts, lambda p: F.trim(p) != ""), sanitize), lambda p: ~p.isin(".", ".."))


def episode_code(season: Column, number: Column) -> Column:
    return F.format_string("S%02dE%02d", season, number)


def slug(label: Column) -> Column:
    return F.trim(F.regexp_replace(ascii_lower(label), "[^a-z0-9]", "-"), F.lit("-"))


def same_key(name: Column) -> Column:
    """Letters and digits alone, lower case: names that differ in punctuation only are the same."""
    return F.lower(F.regexp_replace(name, r"[^\p{L}\p{N}]", ""))


def percent_encode(s: Column) -> Column:
    """Percent-encoding that keeps letters, digits and `-_.~` only."""
    out = F.url_encode(s)
    for plain, coded in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(plain), F.lit(coded))
    return out


def plausible(text: Column) -> Column:
    """What a reader of pictures confuses: a bar is an I, curved quotes and primes are straight."""
    return F.translate(text, "|‘’′“”″", "I'''\"\"\"")


def bare(letter: Column) -> Column:
    return F.translate(F.lower(letter), ACCENTED, BARE)


def same_letter(a: Column, b: Column) -> Column:
    """One letter each, which differ in accents or case alone."""
    return (a != b) & (F.length(a) == 1) & (F.length(b) == 1) & (bare(a) == bare(b))


def drawn_alike(a: Column, b: Column) -> Column:
    strokes = ("l", "I", "i", "1")
    return (a != b) & a.isin(*strokes) & b.isin(*strokes)


def unescape_xml(s: Column) -> Column:
    """Named entities of XML, and decimal and hexadecimal references, in one pass from left to right: what a reference
    stands for is never read again. References to no character, and other entities, stay as they stand."""
    named = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
    tokens = F.regexp_extract_all(s, F.lit(r"(?s)(&(?:lt|gt|quot|apos|amp|#[0-9]+|#[xX][0-9a-fA-F]+);|[^&]+|&)"), F.lit(1))

    def plain(t: Column) -> Column:
        code = F.when(t.rlike("^&#[0-9]{1,8};$"), F.regexp_extract(t, "([0-9]+)", 1).try_cast("long")).when(t.rlike("^&#[xX][0-9a-fA-F]{1,8};$"), F.conv(F.regexp_extract(t, "[xX]([0-9a-fA-F]+)", 1), 16, 10).try_cast("long"))
        valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        out = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "utf-32")).otherwise(t)
        for name, value in named.items():
            out = F.when(t == name, value).otherwise(out)
        return out

    return F.array_join(F.transform(tokens, plain), "")


def escape_html(s: Column) -> Column:
    for plain, name in (("&", "amp"), ("<", "lt"), (">", "gt")):
        s = F.replace(s, F.lit(plain), F.lit(f"&{name};"))
    return s


def unescape_octal(s: Column) -> Column:
    """Mount tables write blanks, tabs, line feeds and backslashes as three octal digits."""
    for code, plain in (("040", " "), ("011", "\t"), ("012", "\n"), ("134", "\\")):
        s = F.replace(s, F.lit("\\" + code), F.lit(plain))
    return s


def serial(system_cnf: Column) -> Column:
    """The serial in a console disc's boot file: `SLUS_012.34` becomes SLUS-01234."""
    boot = F.regexp_extract(system_cnf, r"(?m)^\s*BOOT[^=]*=\s*(\S+)", 1)
    base = F.regexp_extract(boot, r"([^\\/:;]*)(;.*)?$", 1)
    name = F.upper(F.replace(F.translate(base, "_", "-"), F.lit("."), F.lit("")))
    return F.when((F.octet_length(name) >= 8) & name.contains("-"), name)


def episode_numbers(name: Column) -> Column:
    """Numbers after an E that follows a digit, in the name of a video file."""
    found = F.regexp_extract_all(F.upper(name), F.lit("(?<=[0-9])E([0-9]+)"), F.lit(1))
    return F.when(name.rlike(r"(?i)\.(mp4|mkv|m4v)$"), F.transform(found, lambda x: x.cast("int"))).otherwise(F.array().cast("array<int>"))


def short_name(game: Column) -> Column:
    return F.trim(F.split(game, r" \(")[0])


def stem(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def cache_key(url: Column) -> Column:
    """A file name for what a URL holds."""
    return F.concat(F.substring(F.sha1(url.cast("binary")), 1, 20), F.lit(".img"))


def joined(*parts: Column, by: str = " · ") -> Column:
    """The parts that are there, in order."""
    return F.concat_ws(by, *(F.when(p != "", p) for p in parts))


def describe_show(network: Column, kind: Column, premiered: Column, ended: Column, status: Column) -> Column:
    """Broadcaster, kind, and the years if they are more than one, or that it still runs; null if nothing is known."""
    first, last = F.substring(premiered, 1, 4).try_cast("int"), F.substring(ended, 1, 4).try_cast("int")
    span = F.when(last > first, F.concat_ws("-", first.cast("string"), last.cast("string"))).when(first.isNotNull() & last.isNull() & (status == "Running"), "ongoing")
    return F.nullif(joined(network, kind, span), F.lit(""))


def music_detail(year: Column, country: Column, label: Column, disc: Column, discs: Column) -> Column:
    place = F.when(discs > 1, F.format_string("disc %d of %d", disc, discs))
    return joined(year.cast("string"), country, label, place, by=" - ")


def counted(n: Column, one: str, many: str) -> Column:
    """`1 episode`, `2 episodes`; null for none."""
    return F.when(n == 1, F.lit(f"1 {one}")).when(n > 1, F.concat(n.cast("string"), F.lit(f" {many}")))


def percent_decode(s: Column) -> Column:
    """%XX as bytes, read as UTF-8; a plus sign stays one, and so does a percent sign that no two digits follow."""
    lone = F.regexp_replace(s, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.try_url_decode(F.replace(lone, F.lit("+"), F.lit("%2B")))


def destination(root: Column, system: Column, name: Column, several: Column) -> Column:
    """A disc's place below root: its system's folder, or that of discs nobody knows, and a folder of its own if it has
    several files."""
    folder = F.when(F.coalesce(system, F.lit("")) != "", sanitize(system)).otherwise("Unidentified")
    clean = sanitize(name)
    return F.concat_ws("/", root, folder, F.when(several, clean), clean)


def track_file(stem_: Column, number: Column) -> Column:
    return F.concat(stem_, F.format_string(" (Track %02d).bin", number))


def log_name(started: Column, label: Column) -> Column:
    """A log's file name: when the job began, and what is safe of the disc's label."""
    safe = F.trim(F.regexp_replace(label, r"[^\p{IsAlphabetic}\p{N}_-]", "-"), F.lit("-"))
    return F.concat(started, F.when(safe != "", F.concat(F.lit("-"), safe)).otherwise(""), F.lit(".log"))
