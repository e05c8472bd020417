"""The pipeline's stages on a small corpus with nulls, repeats, copies, benchmark passages and clashing columns."""

import random

import pytest

import corpus_pipeline
from edgetide.llm.queries import TOXIC_FROM

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(3, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    clean = [(i, words(60, i), "en", "ab"[i % 2], None) for i in range(60)]
    item = words(30, 5000)
    rows = clean + [(None, words(60, 7), None, None, None), (60, words(60, 3), "en", "a", 5), (60, words(60, 61), "en", "a", 5), (61, words(60, 62), "en", "a", 5), (61, words(60, 62), "en", "a", 5)]
    rows += [(62, None, None, None, None), (63, "", "en", "b", 0), (64, words(20, 70) + " " + item + " " + words(20, 71), "en", "a", 1), (None, item + " " + words(9, 72), None, "b", 1)]
    rows += [(100 + i, words(30, 900 + i) + " foulword dirtyword", "en", "a", 1) for i in range(80)] + [(300, words(60, 8).replace(" ", "\n", 1), "en", "b", None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(i >= 100)) for i in [*range(60), *range(100, 180)]], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at), rows


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_stages(spark, folder):
    at, rows = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, at)
    assert kept.columns == docs.columns
    foul = {r[0] for r in rows if r[1] and "foulword" in r[1]}
    assert foul.isdisjoint({r.doc_id for r in kept.collect()}) and kept.count() == len(rows) - len(foul)
    near = corpus_pipeline.drop_near_duplicates(spark, docs, at)
    want, heads = [], []
    place = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    for r in sorted(rows, key=place):
        s = shingles(r[1])
        if s and any(5 * len(s & h) >= 4 * len(s | h) for h in heads):
            continue
        heads.append(s)
        want.append((r[0], r[1]))
    assert pairs(near) == sorted(want, key=str)
    assert (None, rows[60][1]) not in want and want.count((61, rows[63][1])) == 1
    free = corpus_pipeline.drop_contaminated(spark, docs, at)
    item = shingles(words(30, 5000))
    assert pairs(free) == sorted(((r[0], r[1]) for r in rows if 5 * len(item & shingles(r[1])) < 4 * len(item)), key=str)
    assert len(rows) - free.count() == 2


def test_clashing_columns_and_empty_tables(spark, folder):
    at, _ = folder
    docs = spark.read.parquet(f"{at}/documents.parquet").selectExpr("*", "1 as t1", "2 as g", "3 as document", "4 as rows", "5 as first", "6 as toxicity_score")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, at)
        assert out.count() > 0 and (name == "mixing" or out.columns == docs.columns)
        assert stage(spark, docs.limit(0), at).count() == 0


def test_run(spark, folder):
    at, rows = folder
    out = corpus_pipeline.run(spark, at).collect()
    ids = [r.doc_id for r in out]
    assert {62, 63} <= set(ids) and 64 not in ids and ids.count(61) == 1 and all(not 100 <= (i or 0) < 180 for i in ids)
    assert sum(r.taken for r in out) > 0 and TOXIC_FROM == 0.3


def test_near_duplicates_joined_by_one_link_in_a_large_group(spark, folder):
    """Two texts that are linked, each with 300 copies in which a word differs: no copy of the one is linked to the other's."""
    base = words(200, 40).split()
    one, two = base, base[:-21] + words(21, 41).split()
    rows = []
    for k in range(602):
        w = list(one if k % 2 else two)
        if k > 1:
            w[10 + k // 2 % 160] = f"other{k}"
        rows.append((1000 - k, " ".join(w), "en", "a", k))
    assert 5 * len(shingles(rows[0][1]) & shingles(rows[1][1])) >= 4 * len(shingles(rows[0][1]) | shingles(rows[1][1]))
    assert all(5 * len(shingles(rows[0][1]) & shingles(t)) < 4 * len(shingles(rows[0][1]) | shingles(t)) for _, t, *_ in rows[3::2])
    near = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), folder[0])
    assert [r.doc_id for r in near.collect()] == [399]


def test_near_duplicates_whose_sketches_differ_most(spark, folder):
    """Two windows of a text, similarity 0.8, whose tokens happen to agree less than most: none may be left out."""
    seeds = [1304, 33130, 51782, 55186, 66404, 68710, 69993, 103502, 139096, 266012]
    rows = []
    for i, seed in enumerate(seeds):
        w = words(44, seed).split()
        rows += [(2 * i, " ".join(w[:40]), "en", "a", i), (2 * i + 1, " ".join(w[4:]), "en", "a", i)]
    assert all(5 * len(shingles(a[1]) & shingles(b[1])) == 4 * len(shingles(a[1]) | shingles(b[1])) for a, b in zip(rows[::2], rows[1::2]))
    near = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), folder[0])
    assert sorted(r.doc_id for r in near.collect()) == [*range(0, 20, 2)]
