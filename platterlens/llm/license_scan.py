"""License scans with DataFrame functions only: TF-IDF cosine to templates, then inheritance from ancestor directories.

1. Blocks. A file's text falls into blocks: each line, each paragraph (lines between blank ones) and, for a file named
   like a licence file, the whole text; all of a text is looked at. Blocks without a heavy word are passed over: the heavy
   words of a template carry more than 1 - LEAST ** 2 of its vector's square, so a block that has none of them has a cosine
   below LEAST. Nothing that could be found is lost by that.
2. Licence files. The whole text of a file named like one is compared with the full texts in license_texts, one file for
   each licence (AGPL-3.0, EPL-2.0 and the CC-BY family have notices alone); the best at LEAST or more is the file's.
   Else an SPDX-License-Identifier, of an expression the first, without -only, -or-later or +, is the file's, score 1, if it
   names a licence that has a notice or a full text here; other names count for nothing.
   Else its blocks are compared with notices.
3. Cosine. A block's vector holds the counts of its words times idf = ln((1 + N) / (1 + df)) + 1, with df and N over all
   files; a word of no template weighs as if df were 0. It is sparse: only words that a template has meet it, in a join
   with the templates' words, a table as long as the templates are. The best template at LEAST or more is the file's.
4. Inheritance. Directories that have a licence file take its licence. Every directory is joined to those among its own
   path's prefixes, the longest wins, and files without a licence of their own take their directory's.

Document frequencies fold in the map tasks to one row for each template word, some thousands; that many rows, and nothing that grows with
the corpus, reach the driver. Blocks are scored by file, so a hot repository is many keys; directories, not files, are
expanded to their ancestors.

Defined cases: null text counts as empty and has no licence of its own; a null path lies in no directory and inherits
nothing; equal scores go to the first template in order of name; of several licence files in one directory the highest
score and then the smallest path counts; repeated rows are scored one by one and all kept; empty tables give empty
results; other columns pass through `scan`, and columns named like its results are replaced. The opening paragraph of the
BSD licences alone, outside a licence file, counts as BSD-3-Clause. The SQL knows TEMPLATES alone; it gives the same where
no file has another wording, which holds for the test documents.
"""

from __future__ import annotations

from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, written

#: Licence name -> notices that stand for it, as files carry them.
TEMPLATES = {
    "AGPL-3.0": ("licensed under the gnu affero general public license version 3", "this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license"),
    "Apache-2.0": (
        "licensed under the apache license, version 2.0",
        "licensed under the apache license, version 2.0 (the license); you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/license-2.0",
    ),
    "BSD-3-Clause": (
        "released under the bsd 3-clause license",
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "CC-BY-4.0": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "CC-BY-NC-4.0": ("licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"),
    "CC-BY-SA-4.0": ("licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"),
    "CC0-1.0": ("released under cc0 1.0 universal public domain dedication",),
    "GPL-2.0": ("this work is licensed under the gnu general public license, version 2",),
    "GPL-3.0": (
        "this work is licensed under the gnu general public license, version 3",
        "this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation, either version 3 of the license",
    ),
    "LGPL-3.0": ("licensed under the gnu lesser general public license, version 3",),
    "MIT": (
        "released under the mit license",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the software), to deal in the software without restriction",
    ),
    "MPL-2.0": ("this source code form is subject to the terms of the mozilla public license, v. 2.0",),
}
#: The verbs of notices, and the names that licences have in them.
VERBS = ("licensed", "released", "distributed", "available", "provided")
NAMES = {
    "AGPL-3.0": ("gnu affero general public license version 3", "agplv3"),
    "Apache-2.0": ("apache license version 2.0", "apache license 2.0", "apache 2.0 license"),
    "BSD-2-Clause": ("bsd 2-clause license", "simplified bsd license", "2-clause bsd license"),
    "BSD-3-Clause": ("bsd 3-clause license", "new bsd license", "3-clause bsd license"),
    "CC-BY-4.0": ("creative commons attribution 4.0 international license", "cc by 4.0"),
    "CC-BY-NC-4.0": ("creative commons attribution-noncommercial 4.0 international license", "cc by-nc 4.0"),
    "CC-BY-SA-4.0": ("creative commons attribution-sharealike 4.0 international license", "cc by-sa 4.0"),
    "CC0-1.0": ("cc0 1.0 universal public domain dedication", "cc0 1.0 license"),
    "EPL-2.0": ("eclipse public license version 2.0", "eclipse public license v2.0", "eclipse public license 2.0"),
    "GPL-2.0": ("gnu general public license version 2", "gplv2 license"),
    "GPL-3.0": ("gnu general public license version 3", "gplv3 license"),
    "ISC": ("isc license",),
    "LGPL-2.1": ("gnu lesser general public license version 2.1",),
    "LGPL-3.0": ("gnu lesser general public license version 3",),
    "MIT": ("mit license",),
    "MPL-2.0": ("mozilla public license version 2.0", "mozilla public license v2.0"),
    "Unlicense": ("unlicense license",),
}
#: Notices that no verb and name make.
OTHERS = {
    "EPL-2.0": ("this program and the accompanying materials are made available under the terms of the eclipse public license v. 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",),
    "GPL-2.0": (
        "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation; either version 2 of the license, or (at your option) any later version",
        "this program is free software; you can redistribute it and/or modify it under the terms of the gnu general public license version 2 as published by the free software foundation",
    ),
    "LGPL-2.1": ("this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation; either version 2.1 of the license, or (at your option) any later version",),
    "Unlicense": ("this is free and unencumbered software released into the public domain",),
}
#: Full texts of fewer characters stand in headers too.
SHORT = 2000
#: Words of which a paragraph of a short full text has one if it stands alone as a notice.
MARKERS = r"licen[cs]e|copyright|permission|redistribut|public domain|free software"
#: Fixed value: names of licence files.
LICENSE_FILE = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)([._-][^/]*)?$"
LEAST = 0.7

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RESULTS = ("license", "score", "origin", "license_path")


def lowered(text: Column) -> Column:
    """Lower case of A to Z alone, which every engine does alike."""
    return F.translate(text, _UPPER, _LOWER)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([a-z0-9]+)"), F.lit(1))


@cache
def full_texts() -> dict[str, tuple[str, ...]]:
    """licence -> its full text, from the files in license_texts."""
    return {p.stem: (p.read_text(),) for p in sorted(Path(__file__).with_name("license_texts").glob("*.txt"))}


@cache
def all_notices() -> dict[str, tuple[str, ...]]:
    """licence -> TEMPLATES, notices by verb and name, OTHERS, and short full texts with each of their paragraphs that
    only one licence has."""
    short = {name: [t, *t.split("\n\n")] for name, (t,) in full_texts().items() if len(t) < SHORT}
    held = [p for parts in short.values() for p in parts]
    found = {}
    for name in sorted({*TEMPLATES, *NAMES, *OTHERS, *short}):
        named = [f"{start}{verb} under the {terms}{n}" for n in NAMES.get(name, ()) for verb in VERBS for start, terms in (("", ""), ("this project is ", "terms of the "))]
        found[name] = (*TEMPLATES.get(name, ()), *named, *OTHERS.get(name, ()), *(p for p in short.get(name, ()) if held.count(p) == 1 and marker_in(p)))
    return found


def marker_in(text: str) -> bool:
    import re

    return re.search(MARKERS, text.lower()) is not None


def template_words(templates: dict[str, tuple[str, ...]]) -> dict[tuple[str, int], dict[str, int]]:
    """(licence, number of the notice) -> word -> count."""
    import re

    found: dict[tuple[str, int], dict[str, int]] = {}
    for name, notices in templates.items():
        for i, notice in enumerate(notices):
            own = found[name, i] = {}
            for w in re.findall(r"[a-z0-9]+", notice.lower()):
                own[w] = own.get(w, 0) + 1
    return found


def frequencies(files: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """The number of files, and how many of them have each word of the vocabulary, which is as long as the fixed templates."""
    own = F.array_distinct(words(lowered(F.coalesce("text", F.lit("")))))
    held = files.select(F.explode(F.filter(own, lambda w: w.isin(vocabulary))).alias("w"))
    return files.count(), {r["w"]: r["count"] for r in held.groupBy("w").count().collect()}


def weighed(templates: dict[str, tuple[str, ...]], n: int, df: dict[str, int]) -> tuple[dict[str, float], list[tuple[str, str, int, float, float]]]:
    """idf of the templates' words, and rows (word, licence, notice, weight in a unit vector, that times idf)."""
    from math import log, sqrt

    notices = template_words(templates)
    idf = {w: log((1 + n) / (1 + df.get(w, 0))) + 1 for w in sorted(set().union(*notices.values()))}
    rows = []
    for (name, i), own in notices.items():
        norm = sqrt(sum((k * idf[w]) ** 2 for w, k in own.items()))
        rows += [(w, name, i, k * idf[w] / norm, k * idf[w] ** 2 / norm) for w, k in own.items()]
    return idf, rows


def heavy_words(templates: dict[str, tuple[str, ...]], n: int, df: dict[str, int]) -> list[str]:
    """Words of which a block has one if it reaches LEAST with a template: of each template the rarest words that carry so
    much of its square that the others can't reach LEAST without them."""
    idf, rows = weighed(templates, n, df)
    by_notice: dict[tuple[str, int], list[tuple[float, float, str]]] = {}
    for w, name, i, weight, _ in rows:
        by_notice.setdefault((name, i), []).append((-idf[w], -weight, w))
    found = set()
    for own in by_notice.values():
        left = 1.0
        for _, weight, w in sorted(own):
            if left < LEAST**2 - 1e-6:
                break
            found.add(w)
            left -= weight**2
    return sorted(found)


def has_word(text: Column, known: list[str]) -> Column:
    """Whether a text has one of the words; they are told apart by their first letter before the rest is looked at."""
    by_first: dict[str, list[str]] = {}
    for w in known:
        by_first.setdefault(w[0], []).append(w[1:])
    choices = "|".join(f"{first}(?:{'|'.join(rests)})" for first, rests in sorted(by_first.items()))
    return text.rlike(f"(?<![a-z0-9])(?:{choices})(?![a-z0-9])")


def marked(files: DataFrame, notices: list[str], texts: list[str]) -> DataFrame:
    """files (__file, path, text) with the text left out where nothing can be found in it: it has no heavy word of a notice, no
    tag, and is no licence file with a heavy word of a full text."""
    low = lowered(F.coalesce("text", F.lit("")))
    named = F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False))
    wanted = has_word(low, notices) | low.contains("spdx-license-identifier:") | (named & has_word(low, texts))
    return files.select("__file", "path", F.when(wanted, F.col("text")).alias("text"))


def blocks(files: DataFrame, heavy: list[str]) -> DataFrame:
    """(__file, block, words): the blocks of files (__file, path, text) that have a heavy word."""
    rows = files.select("__file", "path", lowered(F.col("text")).alias("text"))
    whole = F.when(F.coalesce(F.col("path").rlike(LICENSE_FILE), F.lit(False)), F.array("text")).otherwise(F.array().cast("array<string>"))
    parts = F.array_distinct(F.concat(F.split("text", "\n"), F.split("text", r"\n[ \t\r]*\n"), whole))
    told = rows.select("__file", F.posexplode(F.filter(parts, lambda p: has_word(p, heavy))).alias("block", "body"))
    return told.select("__file", "block", words(F.col("body")).alias("words"))


def whole_files(files: DataFrame, heavy: list[str]) -> DataFrame:
    """(__file, block, words): the whole text of each licence file with a heavy word."""
    text = lowered(F.col("text"))
    named = files.filter(F.col("path").rlike(LICENSE_FILE) & has_word(text, heavy))
    return named.select("__file", F.lit(-1).alias("block"), words(text).alias("words"))


def tagged(files: DataFrame, names: list[str]) -> DataFrame:
    """(__file, license): the first SPDX identifier of each of files that has one, if it is one of names."""
    tag = F.regexp_extract("text", r"(?i)spdx-license-identifier:[ \t(]*([a-z0-9][a-z0-9.+-]*)", 1)
    bare = F.lower(F.regexp_replace(tag, r"(?i)(-only|-or-later|\+)$", ""))
    spelled = F.coalesce(*(F.when(bare == n.lower(), F.lit(n)) for n in names))
    return files.select("__file", spelled.alias("license")).filter("license is not null")


def nearest(counts: DataFrame, templates: dict[str, tuple[str, ...]], n: int, df: dict[str, int]) -> DataFrame:
    """(__file, license, score): the best template of each of blocks (__file, block, words) that reaches LEAST."""
    from math import log

    spark = counts.sparkSession
    idf, rows = weighed(templates, n, df)
    top = log(1 + n) + 1
    weights = spark.createDataFrame([(w, name, i, dot) for w, name, i, _, dot in rows], "w string, license string, notice int, weight double")
    idfs = spark.createDataFrame(sorted(idf.items()), "w string, idf double")
    # blocks are dealt out whole, so that their words, norms and products are summed where they lie
    dealt = counts.select("__file", "block", "words").repartition("__file", "block")
    counted = dealt.select("__file", "block", F.explode("words").alias("w")).groupBy("__file", "block", "w").agg(F.count("*").alias("tf"))
    counted = counted.join(F.broadcast(idfs), "w", "left").withColumn("square", F.pow(F.col("tf") * F.coalesce("idf", F.lit(top)), F.lit(2)))
    norms = counted.groupBy("__file", "block").agg(F.sqrt(F.sum("square")).alias("norm"))
    # the templates' words are as many as the fixed table above has: a bound that no corpus moves
    dots = counted.join(F.broadcast(weights), "w").groupBy("__file", "block", "license", "notice").agg(F.sum(F.col("tf") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["__file", "block"]).select("__file", "license", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    best = scored.filter(F.col("score") >= LEAST).groupBy("__file").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("best"))
    return best.select("__file", F.col("best.license").alias("license"), (-F.col("best.s")).alias("score"))


def own_licenses(files: DataFrame, notices: dict[str, tuple[str, ...]], texts: dict[str, tuple[str, ...]]) -> tuple[DataFrame, DataFrame]:
    """Of files (__file, path, text), as written tables: (__file, path, text), see marked(), and (__file, license, score) by the
    full text, else by the SPDX tag, else by notices. Whole texts are read for the frequencies and to be marked; all else
    reads what was marked."""
    known = sorted(set().union(*template_words(notices).values()))
    n, df = frequencies(files, sorted(set(known).union(*template_words(texts).values())))
    of_notices, of_texts = heavy_words(notices, n, df), heavy_words(texts, n, df)
    held = written(marked(files, of_notices, of_texts), "marked")
    rows = held.filter("text is not null")
    ranked = [
        nearest(whole_files(rows, of_texts), texts, n, df),
        tagged(rows, sorted({*notices, *texts})).withColumn("score", F.lit(1.0)),
        nearest(blocks(rows, of_notices), notices, n, df),
    ]
    found = None
    for rank, part in enumerate(ranked):
        part = part.withColumn("rank", F.lit(rank))
        found = part if found is None else found.unionByName(part)
    first = found.groupBy("__file").agg(F.min(F.struct("rank", "license", "score")).alias("f"))
    return held, written(first.select("__file", "f.license", "f.score"), "licenses")


def directory(path: Column) -> Column:
    """The path up to its last slash; '' for a file at the top."""
    return F.regexp_replace(F.regexp_replace(path, r"[^/]*$", ""), r"/$", "")


def inherited(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """(dir, license, license_path): for each of directories (dir) the nearest of licensed (dir, license, license_path)
    among itself and its ancestors."""
    parts = F.split("dir", "/")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, F.lit(1), k), "/").alias("at")))
    steps = directories.distinct().select("dir", F.explode(F.filter(prefixes, lambda p: (p.depth == 0) | (p["at"] != ""))).alias("p")).select("dir", "p.depth", F.col("p.at").alias("at"))
    met = steps.join(licensed.withColumnRenamed("dir", "at"), "at")
    return met.groupBy("dir").agg(F.max(F.struct("depth", "license", "license_path")).alias("n")).select("dir", "n.license", "n.license_path")


def scan(files: DataFrame, notices: dict[str, tuple[str, ...]] | None = None, texts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """files (path, text, and an id column file_id that tells rows apart where it can) with license, score, origin
    (`file`, `directory` or null) and license_path, the licence file that a licence comes from."""
    own = [c for c in files.columns if c not in _RESULTS]
    keyed = files.select(*own, F.struct("file_id", "path", F.xxhash64("text").alias("h")).alias("__file"))
    # rows that repeat id, path and text are one file here, and all of them get its result
    held, found = own_licenses(keyed.select("__file", "path", "text"), notices or all_notices(), texts or full_texts())
    rows = keyed.join(found, "__file", "left")
    narrow = held.select("__file", "path").join(found, "__file", "left")
    named = narrow.filter(F.col("license").isNotNull() & F.col("path").rlike(LICENSE_FILE))
    first = named.groupBy(directory(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("f"))
    licensed = first.select("dir", F.col("f.license").alias("license"), F.col("f.path").alias("license_path"))
    bare = narrow.filter("license is null AND path is not null").select(directory(F.col("path")).alias("dir"))
    given = inherited(bare, licensed).select(F.col("dir").alias("__dir"), F.col("license").alias("__license"), F.col("license_path").alias("__path"))
    joined = rows.withColumn("__at", F.when(F.col("license").isNull(), directory(F.col("path")))).join(given, F.col("__at") == F.col("__dir"), "left")
    return joined.select(
        *own,
        F.coalesce("license", "__license").alias("license"),
        "score",
        F.when(F.col("license").isNotNull(), "file").when(F.col("__license").isNotNull(), "directory").alias("origin"),
        F.when(F.col("license").isNotNull(), F.col("path")).otherwise(F.col("__path")).alias("license_path"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """documents as files of a tree, since the table has no paths: sources are repositories, whose directories hold eight
    directories each, down to eight files. The first file of a directory is its LICENSE."""
    k = F.col("doc_id")
    top = F.concat_ws("/", F.coalesce("source", F.lit("-")), (k / F.lit(512)).cast("long").cast("string"))
    mid = F.concat_ws("/", top, F.pmod((k / F.lit(64)).cast("long"), F.lit(8)).cast("string"))
    low = F.concat_ws("/", mid, F.pmod((k / F.lit(8)).cast("long"), F.lit(8)).cast("string"))
    path = (
        F.when(k % 512 == 0, F.concat_ws("/", top, F.lit("LICENSE")))
        .when(k % 64 == 0, F.concat_ws("/", mid, F.lit("LICENSE")))
        .when(k % 8 == 0, F.concat_ws("/", low, F.lit("LICENSE")))
        .when(k.isNotNull(), F.concat(low, F.lit("/"), k.cast("string"), F.lit(".txt")))
    )
    return docs.select(k.alias("file_id"), path.alias("path"), "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(document_paths(documents(spark, sf_dir)).select("file_id", "path", "text"))
    return found.select(F.col("file_id").alias("doc_id"), "path", "license", "score", "origin", "license_path")


def _oracle() -> str:
    """The same by SQL: templates as a table of words, blocks by splitting, inheritance by a join on path prefixes."""
    rows = ", ".join(f"('{w}', '{name}', {i}, {k})" for (name, i), own in template_words(TEMPLATES).items() for w, k in own.items())
    return rf"""
WITH templates(w, license, notice, k) AS (VALUES {rows}),
vocabulary AS (SELECT DISTINCT w FROM templates),
leveled AS (
  SELECT doc_id, coalesce(text, '') AS raw, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS body,
         coalesce(source, '-') || '/' || (doc_id // 512) AS top, (doc_id // 64) % 8 AS mid, (doc_id // 8) % 8 AS low FROM documents
), files AS (
  SELECT doc_id, body, CASE WHEN doc_id % 512 = 0 THEN top || '/LICENSE' WHEN doc_id % 64 = 0 THEN top || '/' || mid || '/LICENSE'
    WHEN doc_id % 8 = 0 THEN top || '/' || mid || '/' || low || '/LICENSE' ELSE top || '/' || mid || '/' || low || '/' || doc_id || '.txt' END AS path FROM leveled
), df AS (
  SELECT w, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(regexp_extract_all(body, '[a-z0-9]+')) AS w FROM files) JOIN vocabulary USING (w) GROUP BY w
), idf AS (SELECT w, ln((1 + (SELECT count(*) FROM files)) / (1 + coalesce(df, 0))) + 1 AS idf FROM vocabulary LEFT JOIN df USING (w)
), weights AS (
  SELECT w, license, notice, k * idf * idf / sqrt(sum(k * idf * k * idf) OVER (PARTITION BY license, notice)) AS weight FROM templates JOIN idf USING (w)
), marked AS (
  SELECT DISTINCT doc_id, unnest(string_split(body, chr(10)) || regexp_split_to_array(body, '\n[ \t\r]*\n') || CASE WHEN path LIKE '%/LICENSE' THEN [body] ELSE [] END) AS b FROM files
), worded AS (
  SELECT doc_id, b, regexp_extract_all(b, '[a-z0-9]+') AS ws FROM marked
), counted AS (SELECT doc_id, b, w, count(*) AS tf FROM (SELECT doc_id, b, unnest(ws) AS w FROM worded) GROUP BY ALL
), squared AS (SELECT doc_id, b, w, tf, (tf * coalesce(idf, ln(1 + (SELECT count(*) FROM files)) + 1)) ** 2 AS square, idf IS NOT NULL AS known FROM counted LEFT JOIN idf USING (w)
), norms AS (SELECT doc_id, b, sqrt(sum(square)) AS norm FROM squared GROUP BY doc_id, b
), scored AS (
  SELECT doc_id, b, license, notice, round(sum(tf * weight) / any_value(norm), 6) AS score FROM counted JOIN norms USING (doc_id, b) JOIN weights USING (w) GROUP BY ALL
), own AS (
  SELECT doc_id, arg_min(license, struct_pack(s := -score, l := license)) AS license, max(score) AS score FROM scored WHERE score >= {LEAST} GROUP BY doc_id
), held AS (SELECT doc_id, path, regexp_replace(path, '/[^/]*$', '') AS dir, license, score FROM files LEFT JOIN own USING (doc_id)
), licensed AS (SELECT dir, license, path FROM held WHERE license IS NOT NULL AND path LIKE '%/LICENSE'
), near AS (
  SELECT h.doc_id, arg_max(l.license, length(l.dir)) AS license, arg_max(l.path, length(l.dir)) AS path FROM held h JOIN licensed l ON h.dir = l.dir OR starts_with(h.dir, l.dir || '/')
  WHERE h.license IS NULL GROUP BY h.doc_id
)
SELECT h.doc_id, h.path, coalesce(h.license, n.license) AS license, h.score,
       CASE WHEN h.license IS NOT NULL THEN 'file' WHEN n.license IS NOT NULL THEN 'directory' END AS origin,
       CASE WHEN h.license IS NOT NULL THEN h.path ELSE n.path END AS license_path
FROM held h LEFT JOIN near n USING (doc_id)
"""


ORACLE = _oracle()
