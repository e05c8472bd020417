"""Each training-data operator on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations
from os.path import commonprefix

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgetide.llm import decontam, langid, linededup, mixing, neardup, pii, quality, topk, toxicity, warc
from edgetide.llm.components import components
from edgetide.llm.runtime import stage

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fa long, vid long"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


LONG = words(30_000, 1)
TEXTS = [
    (1, words(80, 2)), (2, words(80, 2)), (3, words(80, 2) + " more"), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"),
    (9, LONG), (10, LONG + " end"), (None, words(80, 3)), (None, None), (11, words(60, 4) + "\n" + words(12, 5) + "\n" + words(60, 6)), (12, words(12, 5) + "\n" + words(50, 7)),
    (13, "12345 !! 678"), (1, words(80, 2)), (14, "x" * 300_000),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, ["en", None][k % 2], ["a", "b", None][k % 3], None, 0.5, 1, 2) for k, (i, t) in enumerate(TEXTS)], SCHEMA)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def shingle_set(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split() if text else []
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (9, 8), (7, 7), (None, 1), (2, 3)], "a long, b long")
    for one_task in (0, 100):
        assert {(r.id, r.root) for r in components(e, one_task=one_task).collect()} == {(5, 2), (4, 2), (3, 2), (2, 2), (9, 8), (8, 8)}
        assert components(e.limit(0), one_task=one_task).count() == 0


def test_near_duplicates_against_all_pairs(spark, docs, nothing):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 3, 85, 100).collect()]
    assert len(got) == len(TEXTS)
    sets = [shingle_set(t, 3) for _, t in TEXTS]
    label = list(range(len(TEXTS)))
    for _ in TEXTS:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    want = []
    for k, (i, _) in enumerate(TEXTS):
        ids = [TEXTS[m][0] for m in range(len(TEXTS)) if label[m] == label[k] and TEXTS[m][0] is not None]
        root = min(ids) if ids else i
        want.append((i, len(sets[k]), root, i == root))
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert neardup.near_duplicates(nothing).count() == 0


def test_large_groups_are_split(spark):
    base = words(120, 9).split()
    rows = []
    for i in range(60):
        w = list(base)
        r = random.Random(i)
        for _ in range(2):
            w[r.randrange(120)] = f"q{i}z{r.random()}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingle_set(t, 3) for _, t in rows]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(d, 3, 85, 100, leaf=8).collect()}
    seen, todo = {0}, [0]
    while todo:
        a = todo.pop()
        new = {j for j in range(60) if j not in seen and 100 * len(sets[a] & sets[j]) >= 85 * len(sets[a] | sets[j])}
        seen |= new
        todo += new
    assert {k for k, v in got.items() if v == 0} == seen


def reach(ids, linked):
    """The least id that each id reaches over the pairs (a, b) for which ``linked`` holds."""
    label = {i: i for i in ids}
    pairs = [(a, b) for a, b in combinations(ids, 2) if linked(a, b)]
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_links_between_the_members_of_two_pivots(spark):
    """Windows of one text: starts 0 to 6 are linked, 13 to 19 are, and between them 6 and 13 alone."""
    w = words(119, 21).split()
    d = spark.createDataFrame([(i, " ".join(w[i : i + 100])) for i in [*range(7), *range(13, 20)]], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(d, 3, 85, 100, leaf=8).collect()}
    assert got == {i: 0 for i in got} and len(got) == 14


def test_group_links_against_all_pairs(spark):
    """Groups above the limit, each a row of two to five clusters of which only the outermost members are linked, or scattered."""
    r = random.Random(5)
    places = [(g, 13 * c + o) for g in range(4) for c in range(g + 2) for o in [*range(7)] * 2] + [(4, r.randrange(120)) for _ in range(60)] + [(5, r.randrange(40)) for _ in range(6)]
    at = dict(zip(r.sample(range(1000), len(places)), places))
    sets = {v: set(range(s, s + 98)) for v, (_, s) in at.items()}
    steps = {v: (np.arange(128) < s).astype(np.uint8) for v, (_, s) in at.items()}
    kinds = [
        (neardup.Sets(85, 100), lambda v: np.array(sorted(sets[v]), np.uint64), lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])),
        (neardup.Sketches(121), lambda v: steps[v], lambda a, b: (steps[a] == steps[b]).sum() >= 121),
    ]
    for compare, pack, exact in kinds:
        rows = spark.createDataFrame([(g, v, pack(v).tobytes()) for v, (g, _) in at.items()], "grp long, vid long, payload binary")
        want = reach(at, lambda a, b: at[a][0] == at[b][0] and exact(a, b))
        for stars in (1, 3):
            found = {frozenset((e.a, e.b)) for e in neardup.link_groups(rows, rows.select("vid", "payload"), compare, 7, stars).collect()}
            assert reach(at, lambda a, b: frozenset((a, b)) in found) == want


def test_nodes_against_a_plain_count(spark):
    """Nodes of one member, of two, of more than a list holds, and one so crowded that its rows stay where they are."""
    r = random.Random(8)
    rows = [(n, v, n % 7) for n, size in [(k, r.choice([1, 1, 2, 3, 9])) for k in range(300)] + [(-5, 6000)] for v in r.sample(range(9000), size)]
    members = {}
    for n, v, _ in rows:
        members.setdefault(n, []).append(v)
    given = stage(spark.createDataFrame(rows, "node long, vid long, above long").repartition(5), "given")
    found, lists = {}, Counter()
    for x in neardup.nodes_of(given, 4).collect():
        assert x.above == x.node % 7 and x.size == len(members[x.node]) and len(x.members) <= 4
        found.setdefault(x.node, []).extend(x.members)
        lists[x.node] += 1
    assert {n: sorted(v) for n, v in found.items()} == {n: sorted(v) for n, v in members.items() if len(v) > 1}
    assert all(lists[n] == -(-len(v) // 4) for n, v in found.items() if n >= 0) and lists[-5] == 6000
    assert neardup.nodes_of(given.limit(0), 4).count() == 0


def test_groups_that_share_members_are_united(spark):
    """Thirty parts of a crowd, two large groups that share one member, and one that shares none: no pair is lost, and the crowd
    is no longer compared part by part."""
    r = random.Random(4)
    groups = {g: set(r.sample(range(60), 25)) for g in range(30)} | {30: set(range(100, 150)), 31: set(range(149, 199)), 32: set(range(300, 320))}
    rows = [(g, v, len(m)) for g, m in groups.items() for v in m]
    found, sizes = {}, {}
    for x in neardup.united(stage(spark.createDataFrame(rows, "grp long, vid long, size long"), "large")).collect():
        assert x.vid not in found.setdefault(x.grp, set())
        found[x.grp].add(x.vid)
        sizes[x.grp] = x.size
    pairs = lambda sets: {p for m in sets for p in combinations(sorted(m), 2)}
    assert pairs(found.values()) >= pairs(groups.values()) and {g: len(m) for g, m in found.items()} == sizes
    assert all(found[g] == groups[g] for g in (30, 31, 32))
    assert sum(n for g, n in sizes.items() if g not in (30, 31, 32)) <= 300
    assert neardup.united(stage(spark.createDataFrame(rows, "grp long, vid long, size long").limit(0), "large")).count() == 0


def test_shuffle_is_no_other_where_no_join_is_broadcast(spark, monkeypatch):
    """Lookup sides outgrow a broadcast as tables grow. Then the rows of the trees may not be shuffled again, nor be compared in
    every tree that brings the same ones together."""
    rows = []
    for i in range(800):
        w = words(60, i).split()
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[1:]))]
    classes = neardup.profiles(spark.createDataFrame(rows, "doc_id long, text string"), 3).withColumn("vid", F.col("doc_id"))
    classes = stage(classes, "classes")
    context = spark.sparkContext._jsc.sc()

    def moved():
        context.listenerBus().waitUntilEmpty()
        known = context.statusStore().executorList(False)
        return sum(known.apply(i).totalShuffleWrite() for i in range(known.size()))

    took, threshold = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for how in (neardup.lookup, lambda df: df):
            monkeypatch.setattr(neardup, "lookup", how)
            before = moved()
            got = neardup.candidate_groups(classes, neardup.floor_of(85, 100), 10, 2, 512, 12)
            assert {frozenset((r.id, r.root)) for r in got.collect()} >= {frozenset((2 * i, 2 * i + 1)) for i in range(800)}
            took.append(moved() - before)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert took[1] < 1.5 * took[0]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_links_against_all_pairs(spark, docs, nothing):
    r = random.Random(4)
    lines = []
    for k in range(12):
        base = words(9, 100 + k)[:60].ljust(45, "k") + "é"
        if k % 2:
            base = base[:10] + "ßé語" + base[10:30] + "😀" + base[30:]
        lines.append(base)
        for _ in range(3):
            w = list(base)
            for _ in range(r.randint(1, 3)):
                at = r.randrange(len(w))
                w[at : at + r.randint(0, 1)] = r.choice(["", "z", "zz"])
            lines.append("".join(w))
    d = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in linededup.dedup_lines(d).collect()}
    different = set(lines)
    assert got == {i: sum(a != t and edits(a, t) <= 2 for a in different) for i, t in enumerate(lines) if len(t) >= 40}
    assert linededup.dedup_lines(nothing).count() == 0 and linededup.drop_repeated_lines(nothing).count() == 0
    cleaned = linededup.drop_repeated_lines(docs)
    assert cleaned.columns == docs.columns
    kept = cleaned.select("doc_id", "text").collect()
    assert (4, None) in kept and (5, "") in kept and (2, TEXTS[1][1]) not in kept
    assert [t for i, t in kept if i == 12] == [TEXTS[13][1].split("\n")[1]]


def test_crowds_of_template_lines_against_all_pairs(spark):
    r = random.Random(9)
    base = "The committee will review every submitted proposal before the end of the month and answer"
    lines = {base}
    while len(lines) < 160:
        w = list(base)
        for _ in range(r.randint(1, 2)):
            at = r.randrange(len(w))
            w[at : at + r.randint(0, 1)] = r.choice(["", "z", "q", "zz"])
        lines.add("".join(w) + r.choice(["", "", ".", "!", "..", "s."]))
    lines = sorted(lines)
    d = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {row.doc_id: row.n_links for row in linededup.dedup_lines(d).collect()}
    want = dict.fromkeys(range(len(lines)), 0)
    for i, j in combinations(want, 2):
        a, b = lines[i], lines[j]
        same = len(commonprefix([a, b]))
        a, b = a[same:], b[same:]
        if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2:
            want[i] += 1
            want[j] += 1
    assert got == want


def test_short_lines_have_exact_copies(spark):
    texts = [(1, "MIT License.\n\nOne"), (2, "Two\n MIT License. \n\nOnes"), (3, "One"), (4, " \n"), (5, None)]
    d = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.n_links, r.kept) for r in linededup.dedup_lines(d).collect()}
    assert got == {(1, 0): (1, 0, 0, True), (1, 2): (1, 2, 0, True), (2, 0): (2, 0, 0, True), (2, 1): (1, 0, 0, False), (2, 3): (2, 3, 0, True), (3, 0): (1, 2, 0, False)}
    assert sorted(map(tuple, linededup.drop_repeated_lines(d).collect())) == [texts[0], (2, "Two\n\nOnes"), texts[3], texts[4]]


def test_line_dedup_with_clashing_columns(spark):
    rows = [(1, "same line of some length here\nown one", 9, 9, 9, 9, 9), (2, "same line of some length here\nown two", 8, 8, 8, 8, 8), (None, None, 1, 1, 1, 1, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, d long, k long, stays long, _new long, `a.b` long")
    got = linededup.drop_repeated_lines(d)
    assert got.columns == d.columns and {r.doc_id: (r.text, r.d) for r in got.collect()} == {1: (rows[0][1], 9), 2: ("own two", 8), None: (None, 1)}


def test_containment_against_sets(spark, docs, nothing):
    items = [(1, " ".join(LONG.split()[20_000:20_030])), (2, None), (3, ""), (4, "one two"), (5, words(40, 77)), (6, " ".join(LONG.split()[5:9]))]
    t = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(str, ((r.doc_id, r.item_id, r.item_shingles, r.shared) for r in decontam.contaminated(docs, t).collect())))
    want = []
    for i, text in TEXTS:
        s = shingle_set(text, 5)
        for k, item in items:
            q = shingle_set(item, 5)
            short = len((item or "").split())
            if 0 < short < 5:
                # a short item is one shingle of its own length
                s2 = shingle_set(text, short) if len((text or "").split()) >= short else set()
                if q & s2:
                    want.append(str((i, k, 1, 1)))
            elif q and 5 * len(q & s) >= 4 * len(q):
                want.append(str((i, k, len(q), len(q & s))))
    assert got == sorted(want) and sum("6, 1, 1" in w for w in want) == 2
    assert decontam.contaminated(nothing, t).count() == 0 and decontam.contaminated(docs, t.limit(0)).count() == 0


def test_mixing_meets_targets(spark, nothing):
    d = spark.createDataFrame([(i, words(1 + i % 40, i), "abc"[min(2, i % 7)]) for i in range(3000)] + [(None, None, None), (5, "", "a")], "doc_id long, text string, source string")
    rows = mixing.pareto_mix(d).collect()
    assert len(rows) == 3002 and rows == mixing.pareto_mix(d).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.pareto_mix(d).collect()))
    for s in "abc":
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 20 and all(r.taken <= 3 * r.size for r in own)
    weighted = mixing.pareto_mix(d.withColumn("w", d.doc_id % 2 + 1.0), weight="w").collect()
    odd, even = ([r.taken / r.size for r in weighted if r.source == "c" and r.size and r.doc_id % 2 == k] for k in (1, 0))
    assert sum(odd) / len(odd) > sum(even) / len(even)
    # a weight that is the same for all changes nothing but the scale, and no weight lets a source miss its target
    for w in (0.2, 2.0, 5.0):
        rows = mixing.pareto_mix(d.selectExpr("*", f"{w}D as w"), weight="w").collect()
        for s in "abc":
            own = [r for r in rows if r.source == s]
            assert abs(sum(r.taken for r in own) - own[0].target) <= 40 and all(r.taken <= 3 * r.size for r in own)
    skewed = mixing.pareto_mix(d.selectExpr("*", "case when doc_id % 10 = 0 then 100D when doc_id % 10 = 1 then null else 1D end as w"), weight="w").collect()
    for s in "abc":
        own = [r for r in skewed if r.source == s]
        assert abs(sum(r.taken for r in own) - min(own[0].target, 3 * sum(r.size for r in own if r.doc_id % 10 != 1))) <= 40
    assert mixing.pareto_mix(nothing).count() == 0


def test_classifiers_take_any_text(spark, docs, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (9, 1, 1), (7, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for module, column in ((toxicity, "toxicity_score"), (quality, "quality_score")):
        for l in (labels, labels.limit(0)):
            s = [r[column] for r in module.score(docs, module.train(docs, l)).collect()]
            assert len(s) == len(TEXTS) and all(0 <= x <= 1 for x in s)
        assert module.score(nothing, module.train(nothing, labels)).count() == 0


def test_toxicity_learns_words(spark):
    rows = [(i, words(40, i) + (" foulword" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(800)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    m = toxicity.train(d.where("doc_id < 600"), d.select("doc_id", "toxic"))
    got = toxicity.score(d.where("doc_id >= 600"), m).collect()
    assert sum((r.toxicity_score >= 0.3) == r.toxic for r in got) >= 0.97 * len(got)


def test_language_spans(spark, docs, nothing):
    d = spark.createDataFrame([(i, " ".join(random.Random(i).choice(v) for _ in range(60)), k) for i in range(80) for k, v in (("en", ["the", "house", "with", "window"]), ("ru", ["дом", "окно", "это"]), ("de", ["das", "haus", "fenster", "mit"]))], "doc_id long, text string, lang string")
    m = langid.train(d)
    mixed = spark.createDataFrame([(1, "the house with the window " * 4 + "das haus mit dem fenster " * 5), (2, "это дом"), (3, "12 !"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.detect(mixed, m, spans=True).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4)] == ["de", "ru", "und", "und"]
    assert [s.lang for s in got[1].spans] == ["en", "de"]
    assert langid.detect(docs, m).count() == len(TEXTS) and langid.detect(nothing, langid.train(nothing)).count() == 0


def test_viterbi_against_all_paths():
    r = np.random.Generator(np.random.PCG64(1))
    for n in (1, 2, 5, 7):
        score = r.normal(size=(n, 3)).astype(np.float32) * 3
        paths = np.array(np.meshgrid(*[range(3)] * n)).reshape(n, -1).T
        worth = [score[np.arange(n), p].sum() - 2.0 * (p[1:] != p[:-1]).sum() for p in paths]
        got = langid.viterbi(score, np.array([0]), np.array([n]), 2.0)
        assert abs(max(worth) - (score[np.arange(n), got].sum() - 2.0 * (got[1:] != got[:-1]).sum())) < 1e-4


def test_windows_give_the_same_labels():
    r = np.random.Generator(np.random.PCG64(2))
    score = (r.normal(size=(4000, 4)) + 2 * np.eye(4)[np.repeat(r.integers(0, 4, 80), 50)]).astype(np.float32)
    whole = langid.viterbi(score, np.array([0]), np.array([4000]))
    for window in (3, 64, 1000):
        assert (langid.viterbi_windows(lambda a, b: score[a:b], 4000, 4, window) == whole).all()
    flat = np.zeros((300, 4), np.float32)
    assert len(langid.viterbi_windows(lambda a, b: flat[a:b], 300, 4, 16)) == 300
    one = langid.viterbi_windows(lambda a, b: score[a:b, :1], 4000, 1, 64)
    assert (one == 0).all()


def test_language_counts_letters(spark):
    d = spark.createDataFrame([(i, t * 20, k) for i in range(40) for k, t in (("en", "house window the "), ("ru", "окно дом это "))], "doc_id long, text string, lang string")
    m = langid.train(d)
    got = langid.detect(spark.createDataFrame([("the window house " * 8 + "это окно дом " * 8,)], "text string"), m).first()
    assert got.lang_pred == "en" and abs(got.lang_score - 14 / 24) < 0.01


def test_positive_unlabelled_risk_falls():
    r = np.random.Generator(np.random.PCG64(4))
    good, bad = r.normal(1.5, 1, (400, len(quality.STATISTICS))), r.normal(-1.5, 1, (400, len(quality.STATISTICS)))
    web = np.concatenate([good[:150], bad[:350]])
    m = quality.fit(good, web, 0.3)

    def risk(model):
        p, u = (np.clip(model.score(x), 1e-9, 1 - 1e-9) for x in (good, web))
        return 0.3 * -np.log(p).mean() + max(0.0, -np.log(1 - u).mean() - 0.3 * -np.log(1 - p).mean())

    flat = quality.Model(m.edges, tuple(np.zeros_like(w) for w in m.weights), float(np.log(0.3 / 0.7)), 0.3)
    assert risk(m) < 0.35 * risk(flat)
    assert (m.score(good) > 0.5).mean() > 0.9 and (m.score(bad) < 0.5).mean() > 0.9


def test_ftrl_against_the_textbook():
    r = np.random.Generator(np.random.PCG64(6))
    rows = [np.unique(r.integers(0, 40, 6)) for _ in range(60)]
    labels = np.array([float(3 in x) for x in rows])
    alpha, beta, l1, l2, dim = 0.5, 1.0, 0.3, 0.01, 1 << toxicity.BITS
    z, n = dict.fromkeys([*range(40), dim], 0.0), dict.fromkeys([*range(40), dim], 0.0)

    def weight(i):
        if i == dim:
            return -z[i] / ((beta + n[i] ** 0.5) / alpha)
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)

    order = np.random.Generator(np.random.PCG64(5))
    for _ in range(2):
        for k in order.permutation(60):
            at = [*rows[k], dim]
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-sum(w.values()))) - labels[k]
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    m = toxicity.fit(rows, labels, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    want = {i: weight(i) for i in range(40) if weight(i)}
    assert set(m.at.tolist()) == set(want) and all(abs(v - want[i]) < 1e-9 for i, v in zip(m.at.tolist(), m.value)) and abs(m.bias - weight(dim)) < 1e-9


def contract_spans(text):
    """The four fixed patterns, as they are given."""
    out = []
    for k, pattern in enumerate((r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(p) > 255 for p in m.group().split(".")):
                continue
            if k == 2 and not (13 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            if k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_pii_base_is_the_contract(spark):
    r = random.Random(8)
    texts = ["".join(r.choice("0123456789...--  ()+@@aZé_%") for _ in range(r.randint(0, 60))) for _ in range(3000)]
    assert [pii.base_spans(t) for t in texts] == [contract_spans(t) for t in texts]
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for row in pii.find(d).join(d, "doc_id").collect():
        base = contract_spans(row.text or "")
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(k == j for k, _, _ in base) for j in range(4)]
        assert row.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest() and set(filter(None, pii.joined(base).split(","))) <= set(row.spans.split(","))


def test_pii_method_adds_and_rejects(spark):
    rows, r = [], random.Random(5)
    for i in range(300):
        key = "".join(r.choice("0123456789abcdef") for _ in range(32))
        bad = "4" + "".join(r.choice("0123456789") for _ in range(15))
        if pii.luhn(bad):
            bad = bad[:-1] + str((int(bad[-1]) + 1) % 10)
        rows += [(4 * i, f"{words(8, i)} password={key} {words(5, i)}"), (4 * i + 1, f"{words(8, i)} serial {bad}x {words(5, i)}"), (4 * i + 2, f"{words(6, i)}: {words(3, i)}, note: {words(1, i)}wordy"), (4 * i + 3, f"mail a{i}@b.com card 4111 1111 1111 1111")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = pii.train(pii.candidate_table(d))
    got = {x.doc_id: x for x in pii.find(d, model=model).collect()}
    assert sum(got[4 * i].n_secret == 1 for i in range(300)) >= 295
    assert sum(got[4 * i + 1].n_added + got[4 * i + 2].n_added for i in range(300)) <= 5
    assert all(got[4 * i + 3].n_card == 1 and got[4 * i + 3].n_email == 1 for i in range(300))
    secret, valid = pii.ALL_KINDS.index("secret"), pii.LABELERS.index("charset")
    assert model.reliabilities[secret, valid, 1, 2] > model.reliabilities[secret, valid, 0, 2]


def test_pii_base_spans(spark, docs, nothing):
    text = "é a@b@c.d x.y@z.com.. +1 (808) 555-5385, 1.2.3.4.5 999.1.1.1 x 4111 1111-1111 1111 +12"
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)] == [("email", "b@c.d"), ("email", "x.y@z.com"), ("ip", "1.2.3.4"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (808) 555-5385")]
    got = {r.doc_id: r for r in pii.find(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()}
    base = pii.joined(pii.base_spans(text))
    assert got[1].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(base.split(",")) <= set(got[1].spans.split(","))
    assert got[2].spans == "" and got[2].n_added == 0 and pii.find(docs).count() == len(TEXTS) and pii.find(nothing).count() == 0


def strict_records(folder, names):
    """Records of archives by the letter of the format: gzip members, CRLF headers, exact lengths."""
    out = []
    for name in names:
        with open(folder.removeprefix("file://").removeprefix("file:") + "/" + name, "rb") as f:
            data = f.read()
        while data:
            unpack = zlib.decompressobj(31)
            record, data = unpack.decompress(data), unpack.unused_data
            head, rest = record.split(b"\r\n\r\n", 1)
            lines = head.decode().split("\r\n")
            assert lines[0] == "WARC/1.1"
            fields = dict(line.split(": ", 1) for line in lines[1:])
            n = int(fields["Content-Length"])
            assert rest[n:] == b"\r\n\r\n" and {"WARC-Type", "WARC-Record-ID", "WARC-Date"} <= fields.keys()
            out.append((fields, rest[:n]))
    return out


def test_warc_round_trip(spark):
    big = "<p>é</p>" * 100_000
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (5, "u", big), (None, "n", "x"), (6, "u", "\r\n\r\nWARC/1.1\r\n")]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder, names = warc.write_archives(d)
    chunks = warc.read_archives(folder, names).collect()
    got = {r.page_id: r for r in warc.records(warc.read_archives(folder, names, False)).collect()}
    assert (got[1].record_type, got[1].refers_to) == ("revisit", 2) == (got[None].record_type, got[None].refers_to)
    assert got[3].refers_to == 4 and got[5].payload_bytes == len(big.encode())
    parts = sorted((c for c in chunks if c.page_id == 5), key=lambda c: c.chunk_no)
    assert len(parts) > 1 and b"".join(c.chunk for c in parts).decode() == big
    whole = strict_records(folder, [r.archive for r in names.collect()])
    assert [w[0]["WARC-Type"] for w in whole].count("warcinfo") >= 1
    ids = [w[0]["WARC-Record-ID"] for w in whole]
    assert len(set(ids)) == len(ids)
    kept = {w[0]["WARC-Record-ID"]: w for w in whole if w[0]["WARC-Type"] == "response"}
    for fields, block in whole:
        if fields["WARC-Type"] != "warcinfo":
            head, payload = block.split(b"\r\n\r\n", 1)
            assert head.startswith(b"HTTP/1.1 200 OK") and fields["WARC-Target-URI"]
            if fields["WARC-Type"] == "revisit":
                assert payload == b"" and kept[fields["WARC-Refers-To"]][0]["WARC-Payload-Digest"] == fields["WARC-Payload-Digest"]
            else:
                assert "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode() == fields["WARC-Payload-Digest"]
    rolled, parts = warc.write_archives(d.coalesce(1), chunk=1000, roll=100)
    assert parts.count() == len(rows) and {r.page_id for r in warc.records(warc.read_archives(rolled, parts)).collect()} == {r[0] for r in rows}
    empty, none = warc.write_archives(d.limit(0))
    assert warc.read_archives(empty, none).count() == 0


def test_topk_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(300)] + [(301, None), (302, [1.0, None]), (303, [float("nan"), 1.0]), (304, []), (305, [1e12, 2.0])]
    rows += [(50, [3.0, -3.0, 3.0, 1.0]), (50, [3.0, -3.0, 3.0, 1.0]), (400, [1e300, 1.0]), (401, [1e301]), (402, [-1e300]), (450, [2e17, 1.0]), (451, [3e17])]
    d = topk.numbered(topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding"))
    v = [(r.row, r.id, [int(x) for x in r.vector]) for r in d.collect()]
    limit = (1 << 63) - 1
    want = []
    for row, q, x in v:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(x, y)), i) for other, i, y in v if other != row)[:5]
            want += [(q, k, i, max(-limit - 1, min(limit, -s))) for k, (s, i) in enumerate(best, 1)]
    for shard in (64, 16_384):
        got = [tuple(r) for r in topk.top_k(d, d.where("id % 50 = 0"), 5, block=8, shard=shard).collect()]
        assert sorted(got) == sorted(want)
    assert topk.top_k(d.limit(0), d.limit(0)).count() == 0


def test_topk_skips_blocks():
    r = np.random.Generator(np.random.PCG64(3))
    x = np.floor(r.normal(size=(4096, 8)) * 20) + np.repeat(np.arange(64) * 4, 64)[:, None]
    blocks = topk.Blocks(np.arange(4096), np.arange(4096), x, 64)
    best, who = np.full((4, 5), -np.inf), np.full((4, 5), -1)
    assert topk.search(np.array([-1] * 4), x[-4:], blocks, best, who) < 4 * 16


def test_held_out_remainder(spark):
    from edgetide.llm.runtime import remainder

    got = {r.doc_id: r.m for r in spark.range(50).withColumnRenamed("id", "doc_id").select("doc_id", remainder("doc_id", 3).alias("m")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 for i in range(50)}
