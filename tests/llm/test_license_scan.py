from __future__ import annotations

from platterlens.llm import license_scan

APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0
"""


def test_files_and_directories(spark):
    rows = [
        (1, "repo/LICENSE", "Released under the MIT License."), (2, "repo/src/a.py", "code of all kinds"), (3, "repo/vendor/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        (4, "repo/vendor/x/y/b.c", "more code"), (5, "repo/vendor/own.c", APACHE + "\n\nint main;"), (6, "other/c.py", "no license here at all, and permission to say more than any notice ever says in so many words"),
        (7, None, "Licensed under CC BY-NC 4.0."), (8, None, None), (9, "LICENSE", None), (10, "repository/z.py", ""), (2, "repo/src/a.py", "code of all kinds"), (11, "repo/vendor/LICENSE", "Released under the MIT License."),
        (12, "top.txt", "x " * 60_000 + "\nLicensed under CC BY-NC 4.0.\n" + "y " * 60_000),
    ]
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], "file_id int, path string, text string, license string, w int")
    found = license_scan.scan(df)
    assert found.columns == ["file_id", "path", "text", "w", "license", "score", "origin", "license_path"]
    told = sorted(((r["file_id"], r["license"], r["origin"], r["license_path"]) for r in found.collect()), key=repr)
    told.sort(key=lambda x: x[0])
    assert [x for x in told if x[0] not in (8, 9)] == [
        (1, "MIT", "file", "repo/LICENSE"), (2, "MIT", "directory", "repo/LICENSE"), (2, "MIT", "directory", "repo/LICENSE"), (3, "GPL-3.0", "file", "repo/vendor/COPYING"), (4, "GPL-3.0", "directory", "repo/vendor/COPYING"),
        (5, "Apache-2.0", "file", "repo/vendor/own.c"), (6, None, None, None), (7, "CC-BY-NC-4.0", "file", None), (10, None, None, None), (11, "MIT", "file", "repo/vendor/LICENSE"), (12, "CC-BY-NC-4.0", "file", "top.txt"),
    ]
    assert license_scan.scan(df.limit(0)).count() == 0


def test_query(spark, small, duck, same_rows):
    same_rows(license_scan.query(spark, small), duck, license_scan.ORACLE)


def test_full_texts_tags_and_other_wordings(spark):
    texts = {name: t for name, (t,) in license_scan.full_texts().items()}
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(texts)
    # licence files as they lie in repositories: a title, a holder, other line breaks
    rows = [(f"{name}/LICENSE", f"Copyright (c) 2019 Jo Doe\n\n{' '.join(t.split(' '))}".replace("\n   ", " "), name) for name, t in texts.items()]
    permission = texts["MIT"].split("\n\n")[0]
    rows += [
        ("a/one.c", "/*\n * " + permission.replace("\n", "\n * ") + "\n */\n\nint main;", "MIT"),
        ("a/two.py", "# SPDX-License-Identifier: MIT\nimport os", "MIT"),
        ("a/three.py", "# SPDX-License-Identifier: (GPL-2.0-or-later OR MIT)\nimport os", "GPL-2.0"),
        ("a/other.py", "# SPDX-License-Identifier: Nobody-Knows-1.0\nimport os", None),
        ("a/four.md", "Distributed under the MIT License.", "MIT"),
        ("a/five.md", "This project is released under the terms of the Apache License 2.0.", "Apache-2.0"),
        ("a/six.md", "Available under the Eclipse Public License v2.0", "EPL-2.0"),
        ("a/seven.c", "words of a story, with permission of the owner and a copyright", None),
    ]
    filler = [(f"f/{i}.txt", f"the story of number {i} and of this work, in which the software is provided to all for use under the sun", None) for i in range(200)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t, _) in enumerate(rows + filler)], "file_id int, path string, text string")
    found = {r["path"]: r["license"] for r in license_scan.scan(df).collect()}
    assert found == {p: name for p, _, name in rows + filler}


def test_heavy_words_lose_nothing(spark, monkeypatch):
    """With and without the words that a block must have; among others notices cut short, mixed and stretched."""
    import random

    draw = random.Random(3)
    notices = [n for own in license_scan.all_notices().values() for n in own]
    texts = []
    for i in range(120):
        words = draw.choice(notices).split()[:60]
        keep = [w for w in words if draw.random() < draw.choice([0.5, 0.8, 1.0])]
        texts.append(" ".join(keep + [f"filler{draw.randrange(99)}" for _ in range(draw.randrange(6))]))
    files = spark.createDataFrame([(i, f"d{i}/" + ("LICENSE" if i % 4 == 0 else "a.txt"), t) for i, t in enumerate(texts)], "file_id int, path string, text string")
    run = lambda: sorted((r["file_id"], r["license"] or "", r["score"] or 0, r["license_path"] or "") for r in license_scan.scan(files).collect())
    found = run()
    monkeypatch.setattr(license_scan, "has_word", lambda text, known: text.isNotNull())
    assert run() == found and sum(bool(x[1]) for x in found) > 20


def test_texts_are_left_out_where_nothing_can_be_found(spark):
    rows = [("a/x.py", "print('hello')"), ("a/y.py", "Licensed under the MIT license."), ("a/z.py", "# spdx-license-identifier: mit"), ("a/LICENSE", "hello"), (None, None)]
    df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(rows)], "__file int, path string, text string")
    held = {r["__file"]: r["text"] for r in license_scan.marked(df, ["mit"], ["covenant"]).collect()}
    assert held == {0: None, 1: rows[1][1], 2: rows[2][1], 3: None, 4: None}
