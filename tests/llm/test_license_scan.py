from __future__ import annotations

import re
import textwrap
from importlib.resources import files

from larderflow.llm import license_scan
from larderflow.session import written

MIT = license_scan.LICENCES["MIT"][-1]


def test_whole_texts_and_lines(spark):
    respelt = MIT.replace("sublicense", "sublicence").replace('"', "“").upper().replace(". ", ".\r\n\r\n")
    respelt = "  Copyright (c) 2020 A B\n(c) Others\n" + respelt
    rows = [
        (1, MIT), (2, respelt), (3, "text\nReleased under the  MIT Licence!\nmore\nLicensed under CC BY-NC 4.0.\n(Licensed under CC BY-NC 4.0)"),
        (4, "It was Released under the MIT License."), (5, None), (6, ""), (7, "Copyright me\n***"), (None, "Released under CC0 1.0."),
        (3, "dup"), (8, "x\n" * 50_000 + "SPDX-License-Identifier: ISC"), (1, MIT),
    ]
    docs = spark.createDataFrame([(*r, "k", "l", "d") for r in rows], "doc_id long, text string, key string, lines string, digest string")
    known = license_scan.known_digests(spark)
    result = license_scan.scan(docs, known)
    assert result.columns == ["doc_id", "digest", "licence", "line_licences", "n_lines"]
    found = result.collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r for r in found if r.doc_id != 3}
    assert [by[k].licence for k in (1, 2, 4, 5, 6, 7, None, 8)] == ["MIT", "MIT", None, None, None, None, "CC0-1.0", None]
    assert by[1].digest == by[2].digest and by[5].digest == by[6].digest == by[7].digest
    third = next(r for r in found if r.doc_id == 3 and r.n_lines)
    assert (third.line_licences, third.n_lines) == ("CC-BY-NC-4.0,MIT", 3)
    assert (by[8].line_licences, by[8].n_lines, by[4].n_lines) == ("ISC", 1, 0)
    assert license_scan.scan(docs.limit(0), known).collect() == []


def test_native_plan(spark):
    docs = spark.createDataFrame([(1, MIT)], "doc_id long, text string").selectExpr("*")
    plan = license_scan.scan(docs, license_scan.known_digests(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_canonical_form_is_taken_once(spark, monkeypatch):
    """The plan that reads texts has each step of the canonical form once; what follows reads the digests it wrote."""
    docs = spark.createDataFrame([(1, MIT)], "doc_id long, text string")
    known, plans = license_scan.known_digests(spark), []

    def kept(df, label):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return written(df, label)

    monkeypatch.setattr(license_scan, "written", kept)
    after = license_scan.scan(docs, known)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plans) == 1 and plans[0].count("translate(") == 1 and plans[0].count("regexp_replace(") == 2
    assert "regexp_replace(" not in after and "translate(" not in after


def licences_of(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.licence for r in sorted(license_scan.scan(docs, license_scan.known_digests(spark)).collect())]


def test_entire_texts_with_and_without_titles(spark):
    told = {f.name.removesuffix(".txt"): f.read_text("utf-8") for f in files("larderflow.llm").joinpath("licences").iterdir()}
    assert set(told) == {"Apache-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense"}
    assert min(len(set(t.split())) for t in told.values()) > 100
    bare = MIT.removeprefix("MIT License\n")
    isc = next(t for t in license_scan.LICENCES["ISC"] if t.startswith("Permission"))
    zero = next(t for t in license_scan.LICENCES["0BSD"] if t.startswith("Permission"))
    texts = [*told.items(), ("MIT", bare), ("MIT", "The MIT License (MIT)\n\nCopyright (c) 2020 A\n\n" + bare), ("ISC", isc), ("0BSD", zero)]
    texts += [("ISC", "ISC License\n\nCopyright 2020 A\n\n" + isc), ("0BSD", "BSD Zero Clause License\n\n" + zero)]
    texts += [("GPL-3.0", told["GPL-3.0"].split("How to Apply")[0]), ("Apache-2.0", told["Apache-2.0"].split("APPENDIX")[0])]
    for name, n in (("BSD-3-Clause", 3), ("BSD-2-Clause", 2)):
        body = next(t for t in license_scan.LICENCES[name] if t.startswith("Redistribution"))
        assert f"{n}. " in body and f"{n + 1}. " not in body
        texts += [(name, body), (name, body.replace("1.", "*").replace("2.", "*").replace("3.", "*")), (name, f"{name[:3]} {n}-Clause License\n\n" + body)]
    assert licences_of(spark, [t for _, t in texts]) == [name for name, _ in texts]


def wrapped(text, width):
    """Paragraphs at another width; the notices at the head of the text stay lines of their own."""
    notice = r"(?m)^ *(Copyright (?:\(C\)|\[).*)$"
    parts = re.split(r"\n\s*\n", re.sub(notice, r"\n\n\1\n\n", text))
    return "\n\n".join(p if re.fullmatch(notice, p) else textwrap.fill(" ".join(p.split()), width, break_on_hyphens=False, break_long_words=False) for p in parts)


def test_texts_wrapped_at_other_widths(spark):
    texts = []
    for f in files("larderflow.llm").joinpath("licences").iterdir():
        terms = f.read_text("utf-8").split("How to Apply These")[0]  # the GPL shows notices as examples after its terms
        texts += [(f.name.removesuffix(".txt"), wrapped(terms, width)) for width in (24, 57, 63, 100)]
    for name in ("MIT", "ISC", "0BSD", "BSD-2-Clause", "BSD-3-Clause"):
        texts += [(name, wrapped(license_scan.LICENCES[name][-1], width)) for width in range(20, 140, 7)]
    assert licences_of(spark, [t for _, t in texts]) == [name for name, _ in texts]


def test_only_notices_are_dropped(spark):
    notices = ("Copyright (c) 2020 A", "copyright 2021", "\t(C) 2020 B", "© Acme", "Copyright [yyyy] [name]", "Copyright: Acme Inc.", "All Rights Reserved",
               "All rights reserved. No more", "Copyright The Foo Authors", "(c) Others")
    prose = ("copyright holders be liable", "copyright license to reproduce", "(c) You must retain", "copyright", "copyright holder.",
             "all rights reserved by the licensor", "(c) under Patent Claims", "copyright the software, and", "copyright--then that use")
    same = (("copyright\nowner", "copyright holder"), ("non\ncommercial", "Noncommercial"), ("sub\nlicence", "sublicense"), ("per\ncent", "percent"))
    docs = [(k, "x\n" + t + "\ny") for k, t in enumerate(notices + prose)] + [(100 + k, t) for k, pair in enumerate(same) for t in pair]
    docs += [(200, "\n".join(["x", *notices, *notices, "y"])), (300, "x y")]
    found = license_scan.scan(spark.createDataFrame(docs, "doc_id long, text string"), license_scan.known_digests(spark)).collect()
    digest = {k: {r.digest for r in found if r.doc_id == k} for k, _ in docs}
    for k, t in enumerate(notices + prose):
        assert (digest[k] == digest[300]) == (t in notices), t
    assert digest[200] == digest[300] and all(len(digest[100 + k]) == 1 for k in range(len(same)))
