"""Flushed reports and versions: flushes against one merge, files that stay, failures, concurrent writers, resets brought back."""

import os
from pathlib import Path

import pytest

from folioflow.sinks import versions

KIND = "file string, status string, text string, part int, ord int"


def frame(spark, rows):
    return spark.createDataFrame(rows, KIND)


def files(root):
    return {str(p.relative_to(root)): p.read_bytes() for p in Path(root).rglob("*.parquet")}


def plain(old, new):
    """The whole report at once: new rows in order, skipped and locked ones replaced by the old row; then old rows that are not in new."""
    by = {r[0]: r for r in old}
    out = [(by[f][1:3] if s in ("skipped", "locked") and f in by else (s, t), f, (0, k)) for k, (f, s, t, _, _) in enumerate(new)]
    seen = {r[0] for r in new}
    return sorted([(f, *v, *at) for v, f, at in out] + [(f, s, t, 1, o) for f, s, t, _, o in old if f not in seen])


def test_flushes_equal_one_merge_and_leave_other_files_alone(spark, tmp_path):
    store, merge = versions.Versions(spark, str(tmp_path), 8), versions.report_merge("file", "status")
    old = [(f"p{k}", "ok", f"old {k}", 1, k) for k in range(12)]
    new = [(f"p{k}", ["ok", "skipped", "locked", "failed"][k % 4], f"new {k}", 0, k - 4) for k in range(4, 16)]
    store.upsert("report", frame(spark, old), "file")
    for row in new:
        before = store.version()["tables"]["report"]["folders"]
        kept = files(tmp_path)
        store.upsert("report", frame(spark, [row]), "file", merge)
        after = store.version()["tables"]["report"]["folders"]
        assert sum(before.get(b) != after.get(b) for b in {*before, *after}) == 1
        assert {k: v for k, v in files(tmp_path).items() if k in kept} == kept
    assert sorted(tuple(r) for r in store.read("report").collect()) == plain(old, new)
    assert sorted(tuple(r) for r in store.read("report", 1).collect()) == sorted(old)


def test_a_failed_flush_leaves_the_report(spark, tmp_path):
    store = versions.Versions(spark, str(tmp_path), 4)
    store.upsert("report", frame(spark, [("a", "ok", "x", 0, 0)]), "file")
    with pytest.raises(ZeroDivisionError):
        store.upsert("report", frame(spark, [("a", "ok", "y", 0, 0)]), "file", lambda old, new: 1 / 0)
    broken = frame(spark, [("a", "ok", "y", 0, 0)]).selectExpr("file", "status", "raise_error('disk') as text", "part", "ord")
    with pytest.raises(Exception, match="disk"):
        store.upsert("report", broken, "file")
    assert store.numbers() == [1] and [r.text for r in store.read("report").collect()] == ["x"]
    assert store.upsert("report", frame(spark, []), "file") == 1  # nothing to flush is no version


def test_of_two_writers_one_wins_and_the_other_goes_on_top(spark, tmp_path):
    one, two = versions.Versions(spark, str(tmp_path), 4), versions.Versions(spark, str(tmp_path), 4)
    one.upsert("report", frame(spark, [("a", "ok", "0", 0, 0)]), "file")
    base = one.version()
    assert one.commit(base, base["tables"], "first") == 2 and two.commit(base, base["tables"], "second") is None
    tries = []

    def slow(old, new):  # another writer comes between: first to the same row, then to none of these
        if len(tries) < 1:
            tries.append(1)
            two.upsert("report", frame(spark, [("a", "ok", "between", 0, 0)]), "file")
        return old.selectExpr("file", "status", "concat(text, '+') as text", "part", "ord")

    one.upsert("report", frame(spark, [("a", "ok", "mine", 0, 0)]), "file", slow)
    assert [r.text for r in one.read("report").collect()] == ["between+"] and one.numbers() == [1, 2, 3, 4]
    old = one.version(3)
    one._put, real = lambda path, text: (two.upsert("other", frame(spark, [("b", "ok", "b", 0, 0)]), "file"), setattr(one, "_put", real))[1] or real(path, text), one._put
    one.upsert("report", frame(spark, [("a", "ok", "last", 0, 0)]), "file")
    assert [r.text for r in two.read("report").collect()] == ["last"] and [r.text for r in one.read("other").collect()] == ["b"] and old["number"] == 3


@pytest.mark.parametrize("mode", ["xlat", "all"])
def test_resets_are_brought_back_byte_for_byte(spark, tmp_path, mode):
    store = versions.Versions(spark, str(tmp_path), 2)
    for table in ("xlat", "pages", "book", "glossary"):
        store.upsert(table, frame(spark, [(f"{table}{k}", None, None, 0, k) for k in range(5)]), "file")
    before, rows = files(tmp_path), {t: sorted(map(tuple, store.read(t).collect()), key=str) for t in ("xlat", "pages", "book", "glossary")}
    at = store.version()["number"]
    store.reset(mode)
    assert {t for t in rows if store.read(t) is None} == set(versions.RESETS[mode])
    store.upsert("xlat", frame(spark, [("xlat1", "new", "new", 0, 0)]), "file")
    store.restore(at)
    assert {t: sorted(map(tuple, store.read(t).collect()), key=str) for t in rows} == rows
    assert {k: v for k, v in files(tmp_path).items() if k in before} == before
    assert len(store.vacuum(1)) == 1 and len(store.numbers()) == 1  # the translation that was made between
    assert {t: sorted(map(tuple, store.read(t).collect()), key=str) for t in rows} == rows
    with pytest.raises(ValueError):
        store.reset("some")
    assert not [f for f in os.listdir(tmp_path / "log") if not f.endswith((".json", ".crc"))]
