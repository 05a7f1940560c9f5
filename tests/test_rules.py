"""Rules by their cases, and queries without SQL against plain versions."""

import hashlib
import html
import io
import json
import random
import re
import time
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folioflow.functions import replies, rules, text
from folioflow.operators import ordered, review
from folioflow.plans import catalogue
from folioflow.plans import rules as queries


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "want"),
    [('["a "b" c"]', ['a "b" c']), ('{"k": "x, "y", z", "l": 1}', {"k": 'x, "y", z', "l": 1}), ('["one\ntwo\tthree"]', ["one\ntwo\tthree"]), ('["a\\"b"]', ['a"b']), ('[{"a": "1"}, {"a": "2"}]', [{"a": "1"}, {"a": "2"}]), ('["end"', None)],
)
def test_repaired(raw, want):
    if want is None:
        assert replies.repaired(raw) == raw
    else:
        assert json.loads(replies.repaired(raw)) == want


def test_parse_ladder(spark):
    texts = ["[{\"id\": 1, \"text\": \"a\"}]", "<think>x</think>```json\n[{\"id\": 1, \"text\": \"a\"},]\n```", "so: [{\"id\": 1, \"text\": \"a\"}] done", "so: [{\"id\": 1, \"text\": \"he \"said\" it\"}]", "nothing", None]
    got = [None if r.p is None else [x.text for x in r.p] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", replies.parsed(F.col("t")).alias("p")).orderBy("i").collect()]
    assert got == [["a"], ["a"], ["a"], ['he "said" it'], None, None]


def test_repair_json_query(spark, sf):
    text = {(r.conv_id, r.turn): r for r in catalogue.read(spark, sf, "conversations").collect()}
    for r in queries.repair_json(spark, sf).collect():
        own = text[r.conv_id, r.turn]
        want = f'er sagte "{own.role}" und\n' + own.text.replace("\\", "/").replace('"', "'")
        assert r.id == r.turn and r.text == hashlib.md5(want.encode()).hexdigest()


def test_stable_ports(spark, sf):
    url = {r.page_id: r.url for r in catalogue.read(spark, sf, "pages").collect()}
    assert {r.page_id: r.port for r in queries.stable_ports(spark, sf).collect()} == {k: 49152 + zlib.crc32(u.encode()) % 16000 for k, u in url.items()}


def test_overlap_suppress(spark):
    r = random.Random(6)
    boxes = [(1, 1, 0, 0, 10, 10), (1, 2, 5, 0, 10, 9), (1, 3, 8, 0, 10, 8), (1, 4, 30, 30, 4, 4), (1, 5, 30, 30, 4, 4), (2, 1, 0, 0, 3, 3), (3, 1, -30, 0, 40, 40), (3, 2, 0, 0, 10, 10), (3, 3, -60, -9, 30, 12)]
    boxes += [(4, k, r.randrange(-30, 30), r.randrange(-30, 30), r.randrange(1, 25), r.randrange(1, 25)) for k in range(60)]
    df = spark.createDataFrame(boxes, "page int, id int, x int, y int, w int, h int")
    union, want = set(), {}
    for page, i, x, y, w, h in sorted(boxes, key=lambda b: (b[0], -b[4] * b[5], b[1])):
        own = {(page, a, b) for a in range(x, x + w) for b in range(y, y + h)}
        want[page, i] = len(own & union) <= 0.25 * len(own)
        union |= own if want[page, i] else set()
    assert {(r.page, r.id): r.kept for r in review.overlap_suppressed(df, "page").collect()} == want
    assert not want[3, 2]
    far = spark.createDataFrame([(1, 1, -(10**9), 0, 2 * 10**9, 2 * 10**9), (1, 2, 5, 5, 10**6, 10**6), (1, 3, 0, 0, 0, 7), (1, 4, 10**9 - 3, 0, 12, 10)], "page int, id int, x long, y long, w long, h long")
    assert {r.id: r.kept for r in review.overlap_suppressed(far, "page").collect()} == {1: True, 2: False, 3: True, 4: True}


def test_epubs_open_and_hold_every_paragraph(spark, sf):
    from folioflow.sinks import books

    rows = catalogue.read(spark, sf, "conversations")
    text = {}
    for r in rows.collect():
        text.setdefault(str(r.conv_id), []).append(r.text)
    for r in books.epubs(rows, "conv_id", "role", "turn", "text").collect():
        z = zipfile.ZipFile(io.BytesIO(bytes(r.epub)))
        assert z.infolist()[0].filename == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        body = "".join(z.read(n).decode() for n in z.namelist() if n.endswith(".xhtml"))
        assert sum(body.count(f"<{t}>") for t in ("p", "h2")) >= sum(bool(t) for t in text[r.book])


def test_page_spans(spark):
    head = "Der Titel"
    pages = [(1, 1, f"{head}\n\n12\n\nEr ging\n\nnach"), (1, 2, f"{head}\n\nHause. Dann"), (1, 3, f"{head}\n\nging er.\n\nKAPITEL\n\nNeu ge-\nfahren"), (1, 4, "12\n\nDer Titel\n\nund weiter"), (1, 5, None), (1, 6, " ")]
    got = ordered.merge_page_spans(spark.createDataFrame(pages, "book int, page int, text string"), "book", "page", "text").orderBy("idx").collect()
    # The head on page 4 stands below a page number, which shields it; the one above counts as the page's first paragraph.
    assert [(r.text, r.page, r.page_end) for r in got] == [("Er ging nach Hause. Dann ging er.", 1, 3), ("KAPITEL", 3, 3), ("Neu gefahren Der Titel und weiter", 3, 4)]


def test_heading_made_by_a_join_blocks_the_next(spark):
    pages = [(1, 1, "Kapi-"), (1, 2, "tel\n\nund so")]
    got = ordered.merge_page_spans(spark.createDataFrame(pages, "book int, page int, text string"), "book", "page", "text").orderBy("idx").collect()
    assert [(r.text, r.page, r.page_end) for r in got] == [("Kapitel", 1, 2), ("und so", 2, 2)]


def test_a_null_fp_after_a_stored_one_drops_the_queue(spark):
    schema = "book int, seq int, fp int, idx int, text string"
    got = review.fenced_latest(spark.createDataFrame([(1, 1, 1, 5, "a"), (1, 2, None, 6, "b")], schema)).collect()
    assert [(r.idx, r.text) for r in got] == [(6, "b")]
    got = review.fenced_latest(spark.createDataFrame([(1, 1, None, 5, "a"), (1, 2, 1, 6, "b")], schema)).collect()
    assert sorted((r.idx, r.text) for r in got) == [(5, "a"), (6, "b")]


def test_edits_of_another_version_change_nothing(spark):
    paras = spark.createDataFrame([("b", i, f"s{i}", f"t{i}") for i in range(3)], "book string, idx long, src string, text string")
    versions = spark.createDataFrame([("b", "f", 3)], "book string, fp string, count int")
    schema = "book string, key string, has_src boolean, src string, has_text boolean, text string, fp string, count int"
    edits = [("b", "0", True, "x", False, None, "f", 3), ("b", "1", False, None, True, " ", "f", 3), ("b", "two", True, "y", True, "y", "f", 3), ("b", "7", True, "y", True, "y", "f", 3), ("b", "2", True, "z", True, "z", "g", 3)]
    got = {r.idx: (r.src, r.text) for r in review.apply_edits(paras, spark.createDataFrame(edits, schema), versions).collect()}
    assert got == {0: ("x", "t0"), 1: ("s1", None), 2: ("s2", "t2")}


def test_failed_and_unverified_readings(spark):
    schema = "page int, id int, text string, kind string, confidence string, uncertain boolean"
    row = lambda i, t, c="high", u=False: (1, i, t, "dialogue", c, u)
    a, b, v = [row(1, "x"), row(2, "x"), row(3, "x"), row(5, "x", u=True)], [row(1, " x "), row(2, "y"), row(3, "y"), row(6, "z")], [row(2, "w")]
    asked = spark.createDataFrame([(1, i) for i in range(1, 8)], "page int, id int")
    for batch in (True, False):
        out = review.consensus(*(spark.createDataFrame(x, schema) for x in (a, b, v)), ["page", "id"], asked=asked, batch=batch).collect()
        got = {r.id: (r.text, r.kind, r.confidence, r.passes, r.alt_pass1, r.alt_pass2) for r in out}
        assert got[1] == ("x", "dialogue", "high", "agree", None, None) and got[2] == ("w", "dialogue", "high", "adjudicated", "x", "y")
        assert got[3] == ("x", "dialogue", "medium", "unverified", "x" if batch else None, "y")
        assert got[5][2:4] == ("medium", "single") and got[6][:4] == ("z", "dialogue", "high", "single") and got[7] == (None, "none", "low", "failed", None, None)


def test_rule_cases(spark):
    lit = F.lit
    assert [one(spark, rules.is_untranslated(lit(a), lit(b), lit(c))) for a, b, c in (("x", "", "de"), ("x", "x 한", "de"), ("x", " x", "de"), ("x", "漢", "ja"), ("x", "漢", "de"), ("x", "y", "ja"))] == [True, False, True, True, False, False]
    assert [one(spark, rules.confidence_tier(lit(x))) for x in (85.0, 84.9, 60.0, 59.9)] == ["high", "medium", "medium", "low"]
    assert [one(spark, rules.index_in(lit(k), lit(3))) for k in ("2", "3", "-1", "x", None)] == [2, None, None, None, None]
    assert [one(spark, rules.progress_percent(lit(p), lit(n))) for p, n in ((0.0, 3), (2.5, 3), (9.0, 3), (1.0, 0))] == [33, 100, 100, None]
    assert [one(spark, rules.book_name(lit(x))) for x in ("a.html", "a.data.json", "_ui.html", "a.txt", ".html")] == ["a", "a", None, None, None]
    assert [one(spark, rules.fitted(lit(w), lit(m), 300)) for w, m in ((100, 200), (600, 600), (1, 6000), (25, 3000))] == [100, 300, 1, 2]
    assert [one(spark, rules.patched(lit("o"), lit(h), lit(n))) for h, n in ((False, None), (True, ""), (True, None), (True, "n"))] == ["o", None, None, "n"]
    assert one(spark, rules.ocr_gate(lit(2), lit(0), lit(0.0), lit(70.0))) == "REJECT" and one(spark, rules.ocr_gate(lit(1), lit(2), lit(0.4), lit(35.0))) == "ACCEPT"


def test_edits_of_one_index_the_last_holds(spark):
    paras = spark.createDataFrame([("b", i, f"s{i}", f"t{i}") for i in range(3)], "book string, idx long, src string, text string")
    versions = spark.createDataFrame([("b", "f", 3)], "book string, fp string, count int")
    schema = "book string, key string, has_src boolean, src string, has_text boolean, text string, fp string, count int, ord int"
    edits = [("b", "0", True, "x", True, "first", "f", 3, 1), ("b", "00", False, None, True, "second", "f", 3, 2), ("b", " 1", True, "y", True, "q", "f", 3, 9), ("b", "1", True, "z", True, " ", "f", 3, 10)]
    got = sorted(review.apply_edits(paras, spark.createDataFrame(edits, schema), versions, "ord").collect())
    assert [(r.idx, r.src, r.text) for r in got] == [(0, "x", "second"), (1, "z", None), (2, "s2", "t2")]


def test_prices_by_prefix_of_short_and_long_lists(spark):
    names = ["Swift-Lite-2", "swift", "other", None, "x77y", "x7", "x"]
    rows = spark.createDataFrame([(n,) for n in names], "model string")
    few = [(2, "swift", 2.0, 3.0), (1, "swift-lite", 1.0, 1.5)]
    many = few + [(10 + k, f"x{(k * 7919) % 100_000}", float(k), 0.5) for k in range(100_000)] + [(5, "x77", -1.0, 0.0), (200_000, "", 9.0, 9.0)]
    for prices in (few, many):
        first = lambda n: next(((a, b) for _, p, a, b in sorted(prices) if (n or "").lower().startswith(p)), (None, None))  # noqa: B023, E731
        out = review.by_prefix(rows, spark.createDataFrame(prices, "ord int, prefix string, usd_in double, usd_out double"), "model").collect()
        assert {(r.model, r.usd_in, r.usd_out) for r in out} == {(n, *first(n)) for n in names}


def test_exported_html(spark):
    def plain(s):
        out = html.escape(s)
        for mark, tag in ((r"\*\*", "strong"), ("~~", "s"), (r"\+\+", "u"), (r"\*", "em")):
            out = re.sub(f"(?s){mark}(.+?){mark}", rf"<{tag}>\1</{tag}>", out)
        out = re.sub(" {2,}", lambda m: "&#160;" * (len(m[0]) - 1) + " ", out)
        parts, text = [], False
        for line in out.split("\n"):
            m = re.match(r"^[ \t\u3000]*(?:&gt;&gt;|＞＞)\s+", line)
            if m:
                parts.append('<span style="display:block;text-align:right;text-indent:0">' + line[m.end() :].lstrip() + "</span>")
            elif not line.strip():
                parts.append("<br/><br/>")
            else:
                parts.append(("<br/>" if text else "") + line)
            text = not m and bool(line.strip())
        return "".join(parts)

    r = random.Random(1)
    cases = ["".join(r.choice(["a", " ", "  ", "\n", ">> ", "＞＞ ", "\u3000", "**", "*", "++", "~~", "<", '"', "'", "&"]) for _ in range(r.randrange(25))) for _ in range(400)] + ["", "x"]
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", "t", text.inline_html(F.col("t")).alias("h")).collect()
    assert [(x.t, x.h) for x in sorted(rows)] == [(c, plain(c)) for c in cases]


def test_recent_books_against_a_replay(spark):
    r = random.Random(12)
    used = [(r.randrange(3), f"{' ' * r.randrange(2)}b{r.randrange(12)}" if r.random() < 0.95 else "  ", f"t{k}", r.random() < 0.4, k, r.choice(["use", "use", "pin"])) for k in range(200)]
    lists = {}
    for owner, src, title, pin, ts, kind in used:
        items, key = lists.setdefault(owner, {}), src.strip()
        old = items.get(key, {"pin": False, "title": None})
        if key:
            items[key] = old | ({"title": title, "ts": ts} if kind == "use" else {"pin": pin})
    got = review.recents(spark.createDataFrame(used, "owner int, src string, title string, pin boolean, ts long, kind string"), "owner", 4).collect()
    for owner, items in lists.items():
        all_ = sorted(((not e["pin"], -e["ts"], k, e["title"]) for k, e in items.items() if "ts" in e))
        want = [x for x in all_ if not x[0]] + [x for x in all_ if x[0]][:4]
        assert [(r.src, r.title, not r.pin, r.place) for r in sorted((r for r in got if r.owner == owner), key=lambda r: r.place)] == [(k, t, loose, n + 1) for n, (loose, _, k, t) in enumerate(want)]


def test_queue_is_applied_then_acknowledged(spark, tmp_path):
    import os

    from folioflow.streaming import edits

    state, queue = str(tmp_path / "state"), tmp_path / "in"
    queue.mkdir()

    def send(name, rows):
        (queue / name).write_text("\n".join(json.dumps(dict(zip(("book", "seq", "fp", "idx", "text"), r, strict=True))) for r in rows))
        os.utime(queue / name, (1000 + int(name[0]), 1000 + int(name[0])))
        edits.write_state(edits.read_queue(spark, str(queue)), state, str(tmp_path / "cp")).awaitTermination()

    waiting = lambda: sorted((r.book, r.idx, r.text) for r in edits.read_state(spark, state).collect())
    send("0.json", [(1, 1, 7, 0, "a"), (1, 2, 7, 1, "b"), (2, 3, 9, 0, "c")])
    paras = spark.createDataFrame([(b, i, "s", "t") for b in (1, 2) for i in range(2)], "book long, idx long, src string, text string")
    versions = spark.createDataFrame([(1, 7, 2), (2, 8, 2)], "book long, fp long, count int")
    assert {(r.book, r.idx): r.text for r in edits.drain(spark, state, paras, versions).collect()} == {(1, 0): "a", (1, 1): "b", (2, 0): "t", (2, 1): "t"}
    edits.acknowledge(spark, state, spark.createDataFrame([(1, 7, 2), (2, 8, 3)], "book long, fp long, upto long"))
    assert waiting() == [(2, 0, "c")]  # of another version
    send("1.json", [(1, 4, 7, 1, "d")])
    assert waiting() == [(1, 1, "d"), (2, 0, "c")]
    send("2.json", [(2, 5, 9, 1, "e")])
    assert waiting() == [(1, 1, "d"), (2, 0, "c"), (2, 1, "e")]
    assert sorted(p.name for p in (tmp_path / "state").iterdir() if p.name.startswith("batch=")) == ["batch=1", "batch=2"]


def test_many_small_pages_are_suppressed_in_few_goes(spark):
    r = random.Random(16)
    boxes = [(page, i, r.randrange(30), r.randrange(30), r.randrange(1, 25), r.randrange(1, 25)) for page in [*range(40000), None] for i in range(r.randrange(1, 4))]
    boxes += [(-1, i, r.randrange(900), r.randrange(900), r.randrange(1, 25), r.randrange(1, 25)) for i in range(300)]
    df = spark.createDataFrame(boxes, "page int, id int, x int, y int, w int, h int").repartition(4)
    began = time.monotonic()
    got = {(b.page, b.id): b.kept for b in review.overlap_suppressed(df, "page").collect()}
    assert time.monotonic() - began < 20  # a Python call for each page takes longer
    pages = {}
    for b in boxes:
        pages.setdefault(b[0], []).append(b)
    for page in [*range(0, 40000, 40), -1, None]:
        union = set()
        for _, i, x, y, w, h in sorted(pages[page], key=lambda b: (-b[4] * b[5], b[1])):
            own = {(a, b) for a in range(x, x + w) for b in range(y, y + h)}
            assert got[page, i] == (len(own & union) <= 0.25 * len(own))
            union |= own if got[page, i] else set()
    assert len(got) == len(boxes)


def test_hulls_and_lines_are_computed_once(spark):
    """Expressions that are named twice, or stand in a lambda, are bound: of the input there is one in the plan."""
    from folioflow.functions import geometry

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    points = spark.createDataFrame([([(0, 0), (4, 0), (1, 1), (4, 4), (0, 4)],)], "p array<struct<x:long,y:long>>")
    area = points.select(geometry.polygon_area2(geometry.hull(F.col("p"))).alias("a"))
    assert area.first().a == 32 and plan(area).count("array_sort") == 1
    share = points.select(geometry.solidity(F.col("p")).alias("s"))
    assert share.first().s == 20 / 32 and plan(share).count("array_sort") == 1
    pages = spark.createDataFrame([("a\nb\n\n>> c",)], "t string").select(text.inline_html(F.col("t")).alias("h"))
    assert pages.first().h == 'a<br/>b<br/><br/><span style="display:block;text-align:right;text-indent:0">c</span>' and plan(pages).count("split(") == 1


def test_tasks_are_dealt_a_bounded_number_of_rows(spark, sf, monkeypatch):
    """Partitions follow the rows."""
    from folioflow.operators import kept

    monkeypatch.setattr(kept, "TASK_ROWS", 500)
    rows = catalogue.read(spark, sf, "orders").count() + catalogue.read(spark, sf, "lineitem").count()
    plan = queries.review_pages(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"hashpartitioning\(page#\d+L, {-(-rows // 500)}\)", plan)
