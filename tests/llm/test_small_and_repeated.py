"""Small sources, repeated ids, lists of links inside articles, and notices of one family beside each other."""

from ledgerloom.llm import html, licenses, mixing, quality

GNU = "This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {name}General Public License as published by the Free Software Foundation{end} either version {v} of the License, or (at your option) any later version. This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name}General Public License for more details."


def test_many_small_sources_come_near_their_targets(spark):
    rows = [(s * 10 + k, f"s{s:04d}", "one two three four five six seven eight nine ten") for s in range(1000) for k in range(1)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).groupBy("source").agg({"taken": "sum", "target": "max"}).collect()
    assert len(got) == 1000 and sum(r["sum(taken)"] for r in got) == 10_000
    assert all(abs(r["sum(taken)"] - r["max(target)"]) < 5 for r in got)


def test_a_tiny_source_beside_a_large_one(spark):
    rows = [(k, "large", " ".join(["word"] * 500)) for k in range(200)] + [(1000, "tiny", "a b c"), (1001, None, "d e"), (1002, "void", " ")]
    got = {r["source"]: r for r in mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).groupBy("source").agg({"taken": "sum", "target": "max", "size": "sum"}).collect()}
    for r in got.values():
        assert abs(r["sum(taken)"] - r["max(target)"]) <= 2, r
    assert got["tiny"]["sum(taken)"] == 9 and got[None]["sum(taken)"] == 6 and got["void"]["sum(taken)"] == 0


def test_notices_of_one_family_get_their_own_names(spark):
    texts = {
        "AGPL-3.0-or-later": GNU.format(what="program", sep=":", name="Affero ", end=",", v="3"), "LGPL-2.1-or-later": GNU.format(what="library", sep=";", name="Lesser ", end=";", v="2.1"),
        "LGPL-3.0-or-later": GNU.format(what="program", sep=":", name="Lesser ", end=",", v="3"), "LGPL-2.0-or-later": GNU.format(what="library", sep=";", name="Library ", end=";", v="2"),
        "GPL-3.0-or-later": GNU.format(what="program", sep=":", name="", end=",", v="3"), "GPL-2.0-or-later": GNU.format(what="program", sep=";", name="", end=";", v="2"),
        "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "BSL-1.0": "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt",
    }
    rows = list(texts.items())
    got = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame([(n, "/* Copyright 2020 A. Body\n * " + t.replace(" ", "\n * ", 7) + " */") for n, t in rows], "doc_id string, text string")).collect()}
    assert got == {n: n for n in texts}


def test_linked_references_of_an_article_are_its_text():
    prose = "<p>" + "This paragraph, of some length, has words enough, and commas, to count. " * 6 + "</p>"
    links = "".join(f'<li><a href="/r{k}">Reference number {k}</a></li>' for k in range(3))
    menu = '<ul class="related-links">' + "".join(f'<li><a href="/m{k}">Menu {k}</a></li>' for k in range(4)) + "</ul>"
    text = html.main_text(f"<html><body><div>{menu}</div><article><h1>Title</h1>{prose}<ul>{links}</ul></article></body></html>")
    assert text.split("\n")[-3:] == [f"Reference number {k}" for k in range(3)] and "Menu" not in text
    # outside of an article's element a list of links is a menu
    assert "Reference" not in html.main_text(f"<html><body><div>{prose}{prose}<ul>{links}</ul></div></body></html>")


def test_rows_of_one_id_are_one_trial(spark):
    word = lambda k, n: " ".join(f"w{(k * 7 + i) % 977}" for i in range(n))
    docs = [(k, word(k, 60), "en") for k in range(40)] + [(7, word(7, 60), "en")] * 3000
    labels = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, good int")
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    # forty good documents certify nothing, and copies of one don't change that
    assert quality.cutoffs(quality.signals(df), labels, "lang").collect() == []
