"""License scans against the containment of every window."""

import math
import random
import re

from tillwise.llm import licenses
from tillwise.llm.licenses import CONTAINED, TEMPLATES, bands_for, window_of


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(said):
    n = min(3, max(len(said), 1))
    return {tuple(said[i : i + n]) for i in range(len(said) - n + 1)}


def by_all_windows(docs, templates):
    found = []
    for key, text in docs:
        said = words(text)
        for name, wording in templates:
            sought = shingles(words(wording))
            length, step = window_of(len(words(wording)))
            best = (0.0, 0)
            for start in range(0, max(len(said), 1), step):
                share = len(sought & shingles(said[start : start + length])) / len(sought)
                if share > best[0]:
                    best = (share, start)
            if said and best[0] >= CONTAINED:
                found.append((key, name, *best))
    return found


def test_every_window(spark):
    pick = random.Random(9)
    common = [w for _, t in TEMPLATES for w in words(t)] + [f"w{i}" for i in range(200)]
    docs = [(1, None), (2, ""), (3, "the mit"), (None, TEMPLATES[0][1]), (4, TEMPLATES[0][1]), (4, TEMPLATES[0][1])]
    docs += [(i + 10, " x " * i + wording.upper() + " y") for i, (_, wording) in enumerate(TEMPLATES)]
    for i in range(150):
        said = pick.choices(common, k=pick.randint(0, 150))
        for _ in range(pick.randint(0, 3)):
            notice = words(pick.choice(TEMPLATES)[1])
            for _ in range(pick.choice([0, 0, 1, 3])):
                notice[pick.randrange(len(notice))] = pick.choice(common)
            at = pick.randint(0, len(said))
            said[at:at] = notice
        docs.append((100 + i, " ".join(said)))
    table = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, license string, n int")
    got = [tuple(r) for r in licenses.scan(table, "doc_id").collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=order) == sorted(by_all_windows(docs, TEMPLATES), key=order)
    assert {name for _, name, *_ in got} == {name for name, _ in TEMPLATES}
    assert licenses.scan(table.limit(0), "doc_id").count() == 0


def test_bands_reach_the_probability():
    for n in (1, 3, 5, 8, 9, 33, 64, 200):
        length, step = window_of(n)
        assert length - step >= n
        own = max(n - 2, 1)
        shared = math.ceil(CONTAINED * own)
        likeness = shared / (own + length - 2 - shared)
        assert (1 - likeness) ** bands_for(n) <= licenses.MISSED


def test_query(spark):
    from tillwise.llm.registry import llm_queries

    folder = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in llm_queries()["op5_licenses"](spark, folder).collect())
    assert got == sorted(by_all_windows(docs, TEMPLATES)) and got


def test_notices_in_other_words(spark):
    notices = [
        ("MIT", "Licensed under the MIT License"), ("MIT", "Distributed under the MIT License"),
        ("MIT", "released under the terms of the MIT license"), ("Apache-2.0", "Licensed under Apache License 2.0"),
        ("GPL-2.0", "you may use it under GNU General Public License version 2 only"), ("AGPL", "GNU Affero General Public License"),
        ("LGPL-2.1", "the terms of the GNU Lesser General Public License, version 2.1"), ("EPL-2.0", "the Eclipse Public License v2.0"),
        ("BSD-3-Clause", "see the BSD 3-clause license"), ("BSD-3-Clause", "// SPDX-License-Identifier: BSD-3-Clause"),
        ("GPL-2.0", "# SPDX-License-Identifier: GPL-2.0-or-later"), ("CC-BY-SA-4.0", "shared as CC BY-SA 4.0 by all"),
    ]
    docs = spark.createDataFrame([(i, f"some words {t} and more") for i, (_, t) in enumerate(notices)], "doc_id long, text string")
    found = {}
    for r in licenses.scan(docs, "doc_id").collect():
        found.setdefault(r.doc_id, set()).add(r.license.split(":")[0])
    assert all(name in found.get(i, ()) for i, (name, _) in enumerate(notices)), found
    assert found[4] == {"GPL-2.0"} and found[6] == {"LGPL", "LGPL-2.1"} and found[11] == {"CC-BY-SA-4.0"}


def test_short_templates_tell_licenses_apart():
    scanner = licenses.Scanner(TEMPLATES)
    for name, wording in TEMPLATES:
        if ":" in name:
            own = name.split(":")[0]
            found = {found.split(":")[0] for _, found, *_ in scanner.scan(licenses.pa.array([wording])) if ":" in found}
            assert own in found and all(own.startswith(other) or other.endswith(own) for other in found), (name, found)


def test_catalog_table(spark):
    rows = [("A", "one two three four"), ("A", "five six seven eight"), (None, "x y z"), ("B", None)]
    catalog = licenses.templates_of(spark.createDataFrame(rows, "license string, wording string"))
    docs = spark.createDataFrame([(1, "five six seven eight one two three four")], "doc_id long, text string")
    assert [tuple(r) for r in licenses.scan(docs, "doc_id", templates=catalog).collect()] == [(1, "A", 1.0, 0)]
