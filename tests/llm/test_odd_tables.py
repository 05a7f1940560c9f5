"""Nulls in any column, empty and very long texts, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from folioflow.llm import cross_polytope, interpolated_lm, license_scan, line_runs, mixing, piece_transducer, queries, secret_forest, simhash, toxicity, weighted_sampling

CLASHES = "size int, source_size int, target string, copies int, taken int, seed int, rate int, id int, doomed int, n_lines int, n_dropped int, component_id int, score string, predicted string, terms string, ids string, n_pieces int, round_trip int, decoded int, words int, at int, base int, labels int, spans int, n_words int, findings int, n_candidates int, places int, candidates int, gone_id int, copy int, source_key int"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"
LONG = " ".join(f"word{i % 977} x{i}" for i in range(60_000))


def rows(spark):
    rest = (None,) * CLASHES.count(",") + (None,)
    line = "a shared line of more than forty code points, indeed"
    data = [(None, None, None, None, None), (None, "some text here", "en", None, 3), (1, None, None, "a", None), (2, "", "en", "a", 0), (3, "one", "en", "b", 3), (3, "one", "en", "b", 3), (3, "one", "en", "b", 3), (4, " \n\t ", None, "", 4), (5, LONG, "en", "c", len(LONG))]
    data += [(10 + k, f"{line.upper() if k % 2 else line} \nown words {k}", "en", "d", 9) for k in range(6)]
    return spark.createDataFrame([(*r, *rest) for r in data], SCHEMA)


def operators(spark):
    model = {"weights": {"moron": 6.0, "text*": 2.0}, "curve": (-4.0, 1.0), "exact_only": []}
    trees = secret_forest.forest(spark)
    pieces = queries.piece_model()
    return {
        "mix": mixing.mix,
        "lines": line_runs.dedup_lines,
        "simhash": simhash.simhash_groups,
        "near": simhash.near_groups,
        "lm": interpolated_lm.score_texts,
        "sampling": weighted_sampling.fingerprints,
        "licence": license_scan.scan,
        "pieces": lambda d: piece_transducer.encode(d, pieces),
        "secrets": lambda d: secret_forest.scan(d, trees=trees),
        "toxicity": lambda d: toxicity.score(d, model),
    }


NAMES = ["mix", "lines", "simhash", "near", "lm", "sampling", "licence", "pieces", "secrets", "toxicity"]


@pytest.mark.parametrize("name", NAMES)
def test_each_row_has_a_result(spark, name):
    docs = rows(spark)
    out = operators(spark)[name](docs)
    assert len(set(out.columns)) == len(out.columns)
    assert out.count() == docs.count()


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](rows(spark).limit(0)).collect() == []


def test_filters_keep_columns_and_clean_rows(spark):
    docs = rows(spark)
    assert simhash.one_of_each(docs).columns == docs.columns
    left = simhash.one_of_each(docs.filter("doc_id >= 10")).count()
    assert left == 1  # nine of eleven five-word shingles are shared
    emitted = mixing.emit(docs)
    assert emitted.columns == docs.columns and emitted.filter("doc_id = 5").count() <= 3


def test_shared_lines_stay_in_the_largest_id(spark):
    out = {r.doc_id: r for r in line_runs.dedup_lines(rows(spark).select("doc_id", "text").filter("doc_id >= 10")).collect()}
    assert [out[k].n_dropped for k in range(10, 16)] == [1] * 5 + [0]
    assert out[10].text == "own words 0" and out[15].text.startswith("A SHARED")


def test_line_runs_compact_and_say_what_is_new(spark):
    runs = line_runs.LineRuns(spark, 4)
    frame = lambda ks, d: spark.createDataFrame([(k, k, d) for k in ks], "h1 long, h2 long, id long")
    for d in range(4):
        assert {r.h1 for r in runs.unseen(frame(range(d, d + 3), d)).collect()} == (set(range(3)) if not d else {d + 2})
        runs.add(frame(range(d, d + 3), d))
    assert [k for k, v in runs.levels.items() if v] == [2] and len(runs.runs()) == 1
    assert {(r.h1, r.top) for r in runs.common(1).collect()} == {(0, 0), (1, 1), (2, 2), (3, 3), (4, 3), (5, 3)}
    assert {(r.h1, r.top) for r in runs.common(3).collect()} == {(2, 2), (3, 3)}
    runs.remove()


def test_toxicity_without_a_class_scores_zero(spark):
    docs = rows(spark).select("doc_id", "text")
    labels = spark.createDataFrame([(3, None, 0), (4, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.0}


def test_search_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert cross_polytope.nearest_neighbours(none, none).collect() == []


def test_search_with_clashing_columns_and_repeated_ids(spark):
    rows = [(i, [1.0, float(i)]) for i in range(30)] + [(20, [5.0, 1.0]), (20, [5.0, 1.0]), (None, [1.0, 1.0]), (40, None)]
    names = ["id", "v", "key", "kind", "sketch", "query", "vec", "score", "rank", "h1", "h2", "low", "high"]
    df = spark.createDataFrame([(*r, *[None] * len(names)) for r in rows], f"vec_id long, embedding array<double>, {', '.join(n + ' int' for n in names)}")
    got = {}
    for r in cross_polytope.nearest_neighbours(df, df.filter("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == {0, 20} and len(got[0]) == 20 and len(got[20]) == 40 and all(v != q for q, x in got.items() for _, v in x)


def test_stages_on_odd_rows_and_on_none(spark, sf):
    import corpus_pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars", "size", "ids", "score"]
    for docs in (rows(spark).select(*names), rows(spark).select(*names).limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            assert out.count() > 0 or docs.isEmpty()
        last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
        assert last.count() == docs.count() and last.filter("not round_trip").count() == 0


def test_only_row_is_its_own_next(spark):
    out = weighted_sampling.fingerprints(spark.createDataFrame([(7, "a b c d e f g h")], "doc_id long, text string")).collect()
    assert len(out) == 1 and out[0].near_next == 1.0 and out[0].n_chars == 15


def test_equal_texts_have_equal_fingerprints(spark):
    out = weighted_sampling.fingerprints(rows(spark)).filter(F.col("doc_id") == 3).collect()
    assert len({r.fingerprint for r in out}) == 1


def test_only_rows_of_the_group_go(spark):
    docs = rows(spark).filter("doc_id is null or doc_id < 10")
    left = sorted((r.doc_id or 0, r.text or "") for r in simhash.one_of_each(docs).collect())
    # The wordless ones are a group, whose least doc_id is 1; the other text without doc_id is in none.
    assert left == sorted([(0, "some text here"), (1, ""), (3, "one"), (3, "one"), (3, "one"), (5, LONG)])
    two = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (2, "quite another text of this one")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text[0]) for r in simhash.one_of_each(two).collect()) == [(1, "a"), (2, "q")]
