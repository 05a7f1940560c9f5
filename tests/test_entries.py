"""Report entries, words, first appearance and replies against plain loops and odd rows."""

import random

from pyspark.sql import functions as F

from folioflow.operators import entries as E


def test_numbers_and_totals_of_one_hot_page(spark):
    rows = [("hot" if i % 3 else None if i % 9 else "cold", i * 7919 % 1000, i % 4 == 0 if i % 5 else None) for i in range(1000)]
    got = E.numbered(spark.createDataFrame(rows, "page string, y int, retyped boolean").repartition(7), "page", ["y"], "retyped").collect()
    for page in ("hot", "cold", None):
        own = sorted(y for p, y, _ in rows if p == page)
        mine = [r for r in got if r.page == page]
        assert sorted((r.id, r.y) for r in mine) == list(enumerate(own, 1))
        assert {(r.bubbles, r.set) for r in mine} == {(len(own), sum(bool(t) for p, _, t in rows if p == page))}


def test_kept_entry_drops_what_is_empty(spark):
    schema = "id int, text string, kind string, confidence string, src string, manual_bbox array<int>, font string, font_index int, layout string, region_bbox array<int>, clean boolean"
    rows = [(1, None, None, None, "", [], "", 3, "", None, False), (2, "t", "sfx", "high", "s", [1, 2, 3, 4], "F", None, "l", [0], True)]
    df = spark.createDataFrame(rows, schema)
    got = [tuple(r) for r in df.select(E.kept_entry({c: F.col(c) for c in df.columns}).alias("e")).select("e.*").orderBy("id").collect()]
    assert got == [(1, None, "none", "low", None, None, None, None, None, None, None), (2, "t", "sfx", "high", "s", [1, 2, 3, 4], "F", 0, "l", [0], True)]


def test_words_of_shuffled_blocks(spark):
    rng = random.Random(4)
    words = [(1, rng.randint(0, 2), rng.randint(0, 2), rng.randint(0, 3), i, rng.choice(["a", " b ", "", None, "ç"]), rng.choice(["24.9", "25", "-1", "n/a", None])) for i in range(300)]
    paragraphs = {}
    for _, block, par, line, _, w, conf in words:
        try:
            noise = float(conf) < 25
        except (TypeError, ValueError):
            noise = False
        if (w or "").strip() and not noise:
            paragraphs.setdefault((block, par), {}).setdefault(line, []).append(w.strip())
    want = "\n\n".join("\n".join(" ".join(paragraphs[k][n]) for n in sorted(paragraphs[k])) for k in sorted(paragraphs))
    schema = "page int, block int, par int, line int, i int, w string, conf string"
    got = E.words_to_text(spark.createDataFrame(words, schema).repartition(5), "page", ["i"]).collect()
    assert [(r.page, r.text, r.paragraphs) for r in got] == [(1, want, len(paragraphs))]
    assert E.words_to_text(spark.createDataFrame([], schema), "page", ["i"]).count() == 0


def test_first_appearance_and_views(spark):
    rows = [(g, i) for i, g in enumerate(["b", "a", None, "b", "c", "a", None])]
    got = E.by_appearance(spark.createDataFrame(rows, "g string, i int"), "g", "i").orderBy("place").collect()
    assert [(r.g, r.first, r.n, r.place) for r in got] == [("b", 0, 2, 1), ("a", 1, 2, 2), (None, 2, 2, 3), ("c", 4, 1, 4)]
    shown = E.views(spark.createDataFrame([(1, True), (2, False), (3, None)], "page int, todo boolean"), "todo").collect()
    assert sorted((r.page, r.view) for r in shown) == [(1, "all"), (1, "todo"), (2, "all"), (2, "done"), (3, "all"), (3, "done")]


def test_replies_by_id_or_place(spark):
    items = [("r", n, i, v) for n, (i, v) in enumerate([("2", "A"), (None, "B"), ("x", "C"), ("2", None), ("99", "E"), ("1.5", "F"), ("9" * 30, "G")], 1)]
    by_id = {}
    for _, n, i, v in items:
        by_id[int(i) if i and i.isdigit() and len(i) < 19 else n] = v
    asked = spark.createDataFrame([("r", i) for i in range(1, 9)], "request string, i long")
    got = E.by_id_or_place(asked, spark.createDataFrame(items, "request string, n int, id string, value string"), "request").collect()
    assert {r.i: r.value for r in got} == {i: by_id.get(i) for i in range(1, 9)} and len(got) == 8
