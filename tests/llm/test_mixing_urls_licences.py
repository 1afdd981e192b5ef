"""Source mixing, URL filters and licence scans against plain Python."""

import pytest

from rareflow.llm.licences import LicenceScan
from rareflow.llm.mixing import Mix, mix, size_class
from rareflow.llm.urls import judge_urls

DOCS = "doc_id long, text string, source string"


def targets(sizes, weights=(5, 2, 1), most=3):
    """Shares by resharing the excess until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        if not left:
            return fixed
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + (i * i) % 97), ["a", "b", "é", None, "tiny"][min(4, i % 6)] if i % 50
             else "tiny") for i in range(3000)]
    got = Mix().copies(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        assert r["size"] == len(r["text"].split())
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = targets(sizes)
    taken = {s: sum(r["size"] * r["copies"] for r in got if r["source"] == s) for s in sizes}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 3
        assert r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert taken[s] == pytest.approx(want[s], rel=0.02, abs=200)
    again = Mix().copies(spark.createDataFrame(rows[::-1], DOCS).repartition(7)).collect()
    assert ({(r["doc_id"], r["copies"]) for r in again}
            == {(r["doc_id"], r["copies"]) for r in got})


def test_mix_odd_rows(spark):
    assert Mix().copies(spark.createDataFrame([], DOCS)).collect() == []
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (4, "x", "b"), (4, "x", "b")]
    got = Mix().copies(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 1, 1, 2]
    assert all(r["copies"] is not None for r in got)
    docs = spark.createDataFrame([(1, "a b", "s", 7)], DOCS + ", size long")
    assert mix(docs).columns == ["doc_id", "text", "source", "size", "copy"]


def test_mix_without_texts_takes_the_same(spark):
    rows = [(i, "w " * (i % 40), "ab"[i % 2]) for i in range(400)] + [(None, None, None)] * 3
    docs = spark.createDataFrame(rows, DOCS)
    columns = ["doc_id", "size", "source_size", "target", "copies"]
    narrow = Mix().copies(docs, texts=False)
    assert "text" not in narrow.columns
    whole = Mix().copies(docs).select(*columns)
    assert sorted(map(str, narrow.select(*columns).collect())) == sorted(map(str, whole.collect()))


def test_size_classes_rise(spark):
    from pyspark.sql import functions as F
    rows = spark.range(5000).select("id", size_class(F.col("id")).alias("c")).orderBy("id").collect()
    classes = [r["c"] for r in rows]
    assert classes == sorted(classes)
    for a, b in zip(rows, rows[1:], strict=False):
        if a["c"] == b["c"]:
            first = next(r["id"] for r in rows if r["c"] == a["c"])
            assert b["id"] <= first * 1.126


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.Example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "", "allow"), ("twice.org", "/a", "allow"),
         ("twice.org", "/a", "block"), (None, "/", "block")]
URLS = ["http://EXAMPLE.com/en/1", "https://www.example.com/en/2?x=http://b", "http://a.net/es/",
        "http://a.net/es", "http://net", "http://example.com", "http://notexample.com/en/",
        "http://twice.org/abc", None, "", "no scheme.com/en/", "x://", "http://a.com?q=/en/",
        "http://a.b.c.com/x#/y", "http://example.com/en/" + "x" * 5000, "http://..com/",
        "http://example.com/en/1", "http://exa\nmple.com/en/\n"]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        for cut in "?#":
            rest = rest.split(cut, 1)[0]
        host, slash, tail = rest.partition("/")
        host, path = host.lower(), slash + tail
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in
            ((h.lower(), p, v) for h, p, v in RULES if h)
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return (host, path, best and best[2], best[3] if best else "allow")


def test_urls(spark):
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS)],
                                  "page_id long, url string, verdict string")
    got = judge_urls(pages, rules).collect()
    assert ({r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got}
            == {i: judged(u) for i, u in enumerate(URLS)})
    assert len(got) == len(URLS)
    assert judge_urls(pages.limit(0), rules).collect() == []
    none = judge_urls(pages, rules.limit(0)).collect()
    assert {r["verdict"] for r in none} == {"allow"} and len(none) == len(URLS)


def test_licences(spark):
    texts = ["Released under the MIT License.", "mit-license MIT LICENSE", None, "", "nothing here",
             "Licensed under CC BY-NC 4.0.", "licensed under the apache license version 2 0 " * 2,
             "This work is licensed under the GNU General Public License, version 3.",
             "cc by nc", "the " * 50_000 + "mit license", "Permission is hereby granted, free of "
             "charge, to any person obtaining a copy of this", "Mİt license mit"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, labels string")
    got = {r["doc_id"]: r for r in LicenceScan().scan(docs).collect()}
    labels = {i: (r["base_labels"], r["labels"]) for i, r in got.items()}
    assert labels == {0: ("mit", "mit"), 1: ("mit", "mit"), 2: ("", ""), 3: ("", ""), 4: ("", ""),
                      5: ("", "cc-by-nc"), 6: ("apache", "apache"), 7: ("gpl", "gpl"), 8: ("", ""),
                      9: ("mit", "mit"), 10: ("", "mit"), 11: ("", "")}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"]) == (2, 0, 2)
    assert got[9]["n_words"] == 50_002 and got[9]["first_word"] == 50_000
    assert got[0]["score"] == 1.0 and got[2]["score"] == 0.0 and got[2]["n_words"] == 0
    assert LicenceScan().scan(docs.limit(0)).collect() == []
