"""Operator 5: planted notices, ranking, wording differences, odd rows."""

import random

import numpy as np
import pytest

from lattica.llm import license_scan, queries


def test_templates_win_their_own_text():
    s = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES.items():
        got = s.confirm(text)
        assert got and (got[0] == name or got[2:] == (0, 0)), (name, got)


def test_wording():
    s = license_scan.Scanner()
    text = license_scan.TEMPLATES["MIT text"].replace("Software", "Program", 2)
    name, reduction, missing, added = s.confirm("Some lead words. " + text)
    assert name == "MIT text" and reduction > 0.5 and 0 < missing <= 4 and 0 < added <= 4
    assert s.confirm("My driving license needs the permission of the office.") is None


def test_query(spark, data):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    lines = ("All rights reserved.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.")
    want = {(i, n) for i, t in rows.items() for n, line in enumerate(t.split("\n")) if line in lines}
    got = queries.op5_license_scan(spark, data).collect()
    assert want and {(r.doc_id, r.line) for r in got} == want
    assert all(r.words_missing == r.words_added == 0 for r in got)


def test_runs_of_lines():
    text = "x\n" + license_scan.TEMPLATES["ISC text"].replace(", ", ",\n") + "\ny"
    got = license_scan.Scanner().scan(text)
    assert len(got) == 1 and got[0][2] == "ISC text" and got[0][1] > 1


def test_odd_rows(make_docs, odd_rows):
    rows = [*odd_rows, (30, "a " * 50_000 + "Released under the MIT License. " + "b " * 50_000), (31, "All rights reserved."), (31, "All rights reserved.")]
    got = sorted((r.doc_id, r.license) for r in license_scan.scan(make_docs(rows, extra=True)).collect())
    assert got == [(30, "MIT"), (31, "All-rights-reserved"), (31, "All-rights-reserved")]
    assert license_scan.scan(make_docs([])).count() == 0


PROSE = "the valley was quiet that morning and nobody on the farm had expected visitors before the harvest was over so they sat by the window drinking tea while old Marten told the story of the flooded mill "


def test_surrounding_prose_does_not_hide_a_notice():
    s = license_scan.Scanner()
    for name, text in license_scan.TEMPLATES.items():
        for n in (0, 20, 60, 200, 6000):
            before = (PROSE * 40)[:n] + " "
            got = s.scan("first\n" + before + text + " " + before)
            assert len(got) == 1 and got[0][2] == name and got[0][0] == 1 and got[0][4:6] == (0, 0), (name, n)
            assert got[0][6].rstrip(".") == text.rstrip(".")


def test_every_notice_of_a_run_is_reported():
    s, t = license_scan.Scanner(), license_scan.TEMPLATES
    names = lambda text: [g[2] for g in s.scan(text)]
    assert names("Released under the MIT License.\nAll rights reserved.") == ["MIT", "All-rights-reserved"]
    assert names(" ".join((t["MIT"], t["Apache-2.0"], t["MIT"], "and more words"))) == ["MIT", "Apache-2.0", "MIT"]
    everything = sorted(t)
    assert names("\n\n".join(t[n] for n in everything)) == everything
    assert names("\n\n".join([t["MIT text"], "or", t["Apache-2.0 notice"]])) == ["MIT text", "Apache-2.0 notice"]
    assert names("All rights reserved. " * 5000) == ["All-rights-reserved"] * 5000


QUOTED = [
    ("This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0"]),
    ("This work is licensed under the GNU General Public License, version 4.", ["unknown"]),
    ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version.", ["unknown"]),
    ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["CC-BY-NC-4.0 notice"]),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ["CC-BY-ND-4.0 notice"]),
    ("Released under the License.", []),
    ("Licensed under the Apache License, Version 1.1.", ["unknown"]),
    ("Not released under the MIT License.", ["unknown"]),
    ("It was never ever released under the MIT License.", ["unknown"]),
    ("This is not free. Released under the MIT License.", ["MIT"]),
    ("Licensed under CC BY 4.0.", ["CC-BY-4.0"]),
    ("Licensed under CC BY-SA 4.0.", ["CC-BY-SA-4.0"]),
    ("Licensed under CC BY 3.0.", ["CC-BY-3.0"]),
    ("Licensed under CC BY 2.5.", ["unknown"]),
    ("Licensed under the MIT license", ["MIT"]),
    ("Released under the MIT License. Copyright 2021. All rights reserved.", ["MIT", "All-rights-reserved"]),
    ("Rights granted under the license of the town.", []),
]


@pytest.mark.parametrize(("text", "want"), QUOTED)
def test_licenses_are_told_apart(text, want):
    got = license_scan.Scanner().scan("some lines before\n" + text + "\nand after it")
    assert [g[2] for g in got] == want
    assert all(g[5] or g[4] or "ot " in text or "never" in text for g in got if g[2] == "unknown")  # the difference is reported


def test_a_changed_telling_word_is_never_confirmed():
    s = license_scan.Scanner()
    for t in s.templates:
        for word in set(t.telling):
            for other in ("9.9", "nc" if word != "nc" else "sa"):
                changed = [other if w == word else w for w in t.words]
                got = [g[2] for g in s.scan("license: " + " ".join(changed))]
                assert t.name not in got, (t.name, word, other)


def test_compression_decides_between_templates_that_both_align():
    plain = "permission is granted to copy this work for every purpose and to hand it on in whole or in part as long as this text stays with it in full"
    other = plain.replace("copy", "duplicate").replace("whole", "all")
    templates = {"A other": other, "B plain": plain}
    s = license_scan.Scanner(templates)
    words = license_scan.words_of(plain)
    ids = np.array([s.vocabulary[w] for w in words])
    assert all(t.align(ids) for t in s.templates)  # both are near enough
    assert [t.name for _, t in s.ranked(plain)] == ["B plain", "A other"] and [g[2] for g in s.scan(plain)] == ["B plain"]
    assert [g[2] for g in s.scan(other)] == ["A other"]
    assert license_scan.Scanner(templates, min_share=0.99).scan("the " + " ".join(w + " so" * (i % 5 == 0) for i, w in enumerate(words))) == []


def distance(a, b):
    """Words missing and added."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[j - 1]))
        row = new
    return row[-1]


def test_against_brute_force_over_all_templates_and_offsets():
    rng = random.Random(11)
    names = ("MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-4.0 notice")
    s = license_scan.Scanner({n: license_scan.TEMPLATES[n] for n in names})
    found = 0
    for _ in range(250):
        t = rng.choice(s.templates)
        words = list(t.words)
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([[], ["house"], [words[i], "tree"], [rng.choice(["2", "3", "4.0", "lesser", "mit", "by-nc"])]])
        before, after = (rng.choices(["river", "stone", "cup", "blue", "walks"], k=rng.randint(0, 9)) for _ in range(2))
        text = " ".join([*before, ".", *words, ".", *after, ". license"])
        all_words = license_scan.words_of(text)
        best = {}
        for q in s.templates:
            for a in range(len(all_words)):
                for b in range(a + 1, min(len(all_words), a + q.reach) + 1):
                    beside = all_words[b : b + 2] if all_words[b : b + 1] and all_words[b] in ("version", "license") else all_words[b : b + 1]
                    if any(map(license_scan.telling, beside)):
                        continue  # a block reaches over these
                    own = all_words[a:b]
                    if [w for w in own if license_scan.telling(w)] == q.telling and (d := distance(q.words, own)) <= q.limit:
                        best[q.name] = min(best.get(q.name, 99), d)
        got = [(g[2], g[4] + g[5]) for g in s.scan(text) if g[2] != "unknown"]
        if not best:
            assert not got, (text, got)
        for name, d in got:
            assert best[name] == d, (text, got, best)
        nearest = min(best.values(), default=9)
        if nearest <= 1 and len(best) == 1:
            assert [g[0] for g in got] == list(best), (text, got, best)
            found += 1
    assert found > 100
