"""Languages and the codes that tag them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Canonical code -> (English name, other codes).
LANGUAGES = {
    "eng": ("English", "en"),
    "swe": ("Swedish", "sv"),
    "nor": ("Norwegian", "nb nn no"),
    "dan": ("Danish", "da"),
    "fin": ("Finnish", "fi"),
    "isl": ("Icelandic", "ice is"),
    "deu": ("German", "ger de"),
    "fra": ("French", "fre fr"),
    "spa": ("Spanish", "es"),
    "por": ("Portuguese", "pt"),
    "ita": ("Italian", "it"),
    "nld": ("Dutch", "dut nl"),
    "pol": ("Polish", "pl"),
    "ces": ("Czech", "cze cs"),
    "ell": ("Greek", "gre el"),
    "rus": ("Russian", "ru"),
    "tur": ("Turkish", "tr"),
    "ara": ("Arabic", "ar"),
    "heb": ("Hebrew", "he"),
    "hin": ("Hindi", "hi"),
    "jpn": ("Japanese", "ja"),
    "kor": ("Korean", "ko"),
    "zho": ("Chinese", "chi zh cmn yue"),
    "und": ("Undetermined", ""),
}


def aliases(spark: SparkSession) -> DataFrame:
    """(alias, code): every code and English name, lower case, with its canonical code. As long as the table above."""
    rows = {(a, code) for code, (name, others) in LANGUAGES.items() for a in (code, name.lower(), *others.split(" "))}
    return spark.createDataFrame(sorted(rows), "alias string, code string")


def parse_preference(spec: str | None) -> list[str] | None:
    """`en, de; fr` as canonical codes; nothing said is no preference (None), which is not the same as wanting none."""
    names = [x.strip().lower() for x in (spec or "").replace(";", ",").split(",")]
    known = {a: code for code, (name, others) in LANGUAGES.items() for a in (code, name.lower(), *others.split())}
    wanted = [known.get(x, x) for x in names if x]
    return list(dict.fromkeys(wanted)) or None
