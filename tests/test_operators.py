"""Small, hand-checkable cases and brute-force twins of the mining operators."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeworks.functions import hashing, text
from lodeworks.operators import cf, clustering, content, dictionary, graph, itemsets, similarity, sketches
from lodeworks.plans import queries
from lodeworks.sources import readers, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def random_baskets(seed, n=30, items=8):
    rng = random.Random(seed)
    return [(b, str(90 + i)) for b in range(n) for i in range(items) if rng.random() < 0.5]


def brute_itemsets(pairs, support):
    baskets = {}
    for b, i in pairs:
        baskets.setdefault(b, set()).add(i)
    out, names = {}, sorted({i for _, i in pairs})
    for k in range(1, len(names) + 1):
        for c in itertools.combinations(names, k):
            n = sum(set(c) <= s for s in baskets.values())
            if n >= support:
                out[c] = n
    return out


@pytest.mark.parametrize("support", [4, 8])
def test_frequent_itemsets(spark, support):
    pairs = random_baskets(support)
    df = spark.createDataFrame(pairs + pairs[:5] + [(None, "90"), (1, None)], "b long, i string")
    found = {tuple(r["items"]): r["support"] for r in itemsets.frequent_itemsets(df, "b", "i", support).collect()}
    assert found == brute_itemsets(pairs, support)


def test_items_stay_strings(spark):
    df = spark.createDataFrame([(b, i) for b in range(3) for i in ("97", "100")], "b long, i string")
    assert [2, ["100", "97"], 3] in [list(r) for r in itemsets.frequent_itemsets(df, "b", "i", 3).collect()]


def test_son_candidates(spark):
    pairs = random_baskets(1)
    df = spark.createDataFrame(pairs, "b long, i string")
    want = set()
    total = len({b for b, _ in pairs})
    for p in range(3):
        own = [x for x in pairs if x[0] % 3 == p]
        n = len({b for b, _ in own})
        want |= {c for c, k in brute_itemsets(own, 1).items() if k * total >= n * 9}
    found = {tuple(r["items"]) for r in itemsets.son_candidates(df, "b", "i", 9, 3).collect()}
    assert found == want
    assert set(brute_itemsets(pairs, 9)) <= found


def test_no_itemsets(spark):
    df = spark.createDataFrame([], "b long, i string")
    assert itemsets.frequent_itemsets(df, "b", "i", 1).count() == 0
    assert itemsets.son_candidates(df, "b", "i", 1, 2).count() == 0


def test_itemset_report(spark):
    df = spark.createDataFrame([(1, ["a"], 3), (1, ["b"], 3), (2, ["a", "b"], 2)], "size int, items array<string>, support long")
    assert rows(sinks.itemset_report(df)) == [(1, "('a'),('b')"), (2, "('a', 'b')")]


def test_jaccard_and_lsh(spark):
    rng = random.Random(5)
    sets = {e: {str(rng.randrange(12)) for _ in range(6)} for e in range(30)}
    df = spark.createDataFrame([(e, m) for e, s in sets.items() for m in s], "e long, m string")
    want = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.5}
    assert {(r["a"], r["b"]) for r in similarity.jaccard_pairs(df, "e", "m", 0.5).collect()} == want
    near = {(r["a"], r["b"]) for r in similarity.lsh_similar_pairs(df, "e", "m", 0.5).collect()}
    assert near <= want and len(near) >= 0.95 * len(want)


def test_lsh_at_the_reference_setting(spark, tmp_path):
    """Nearly all pairs from 0.055 on, most of which bands of 4 rows lose."""
    rng = random.Random(6)
    sets = {i: {f"w{rng.randrange(200)}" for _ in range(30)} for i in range(60)}
    spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in sets.items()], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sim = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sets, 2)}
    want = {p: round(x, 9) for p, x in sim.items() if x >= 0.055}
    got = {(r["a"], r["b"]): r["sim"] for r in queries.QUERIES["lsh_similar_pairs_reference"](spark, str(tmp_path)).collect()}
    assert got.items() <= want.items() and len(got) >= 0.99 * len(want)
    assert got.keys() <= {(r["a"], r["b"]) for r in queries.QUERIES["lsh_candidates_reference"](spark, str(tmp_path)).collect()}


def test_set_classes(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (2, "a"), (3, "a")], "entity long, member string")
    assert rows(similarity.set_classes(df)) == [(1, 1), (2, 1), (3, 3)]


def test_clean_text(spark):
    df = spark.createDataFrame([("It's 5 o'clock, (OK)!",), (None,)], "t string")
    assert [r[0] for r in df.select(text.tokens(text.clean(F.col("t")))).collect()] == [["its", "oclock", "ok"], []]


def test_content(spark):
    docs = [("b1", "red red blue"), ("b2", "red green"), ("b3", "green green yellow")]
    df = spark.createDataFrame([(i % 2, b, t) for i, (b, t) in enumerate(docs)], "user_id long, business_id string, text string")
    profile = content.tfidf_profile(df, "business_id", "text", rare_max=1)
    w = {(r["business_id"], r["word"]): r["weight"] for r in profile.collect()}
    assert w == pytest.approx({("b1", "red"): math.log2(1.5), ("b2", "red"): math.log2(1.5), ("b2", "green"): math.log2(1.5), ("b3", "green"): math.log2(1.5)}, abs=1e-8)
    scores = content.content_scores(df, profile, df.select("user_id", "business_id"), min_reviews=2)
    assert {(r["user_id"], r["business_id"]): r["sim"] for r in scores.collect()}[(0, "b1")] == pytest.approx(1 / math.sqrt(2), abs=1e-6)


def test_pearson(spark):
    r = [(u, i, s) for u, (x, y, z) in enumerate([(1, 2, 3), (2, 4, 3), (3, 6, 3)]) for i, s in ((10, x), (20, y), (30, z))]
    df = spark.createDataFrame([(u, i, float(s)) for u, i, s in r], "user_id long, item_id long, stars double")
    assert rows(cf.item_cf_model(df)) == [(10, 20, 3, 1.0)]  # a constant item correlates with none
    test = spark.createDataFrame([(0, 10), (9, 10), (0, 99)], "user_id long, item_id long")
    out = rows(cf.item_cf_predict(df, cf.item_cf_model(df), test))
    assert [x[:2] for x in out] == [(0, 10)]
    assert out[0][2] == pytest.approx(2 + (2 - 4), abs=1e-6)
    lsh = cf.user_cf_model(df, candidates="lsh")
    assert rows(lsh) == rows(cf.user_cf_model(df))
    with pytest.raises(ValueError):
        cf.user_cf_model(df, candidates="none")


def test_graph_small(spark):
    both = lambda es: spark.createDataFrame(es + [(b, a) for a, b in es], "src string, dst string")
    path = both([("a", "b"), ("b", "c")])
    assert rows(graph.edge_betweenness(path)) == [("a", "b", 2.0), ("b", "c", 2.0)]
    triangle = both([("1", "2"), ("2", "3"), ("1", "3")])
    assert {r[2] for r in rows(graph.edge_betweenness(triangle))} == {1.0}
    two = both([("a", "b"), ("x", "y"), ("y", "z")])
    assert rows(graph.connected_components(two)) == [("a", "a"), ("b", "a"), ("x", "x"), ("y", "x"), ("z", "x")]
    barbell = both([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("d", "f")])
    label, log = graph.girvan_newman(barbell)
    assert rows(label) == [("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d"), ("f", "d")]
    assert log.first()["q"] == pytest.approx(2 * (3 / 7 - 0.25))
    assert graph.girvan_newman(both([]))[0].count() == 0


def test_betweenness_by_joins(spark):
    rng = random.Random(2)
    es = [(a, b) for a, b in itertools.combinations(range(9), 2) if rng.random() < 0.35]
    df = spark.createDataFrame(es + [(b, a) for a, b in es], "src long, dst long")
    x = {r[:2]: r[2] for r in rows(graph.edge_betweenness(df))}
    assert {r[:2]: r[2] for r in rows(graph._betweenness_by_joins(df))} == pytest.approx(x)


def test_kmeans(spark):
    rng = np.random.default_rng(0)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    pts = [(i, (centres[i % 3] + rng.normal(0, 0.3, 2)).tolist()) for i in range(60)]
    df = spark.createDataFrame(pts, "id long, v array<double>")
    out, found = clustering.kmeans(df, "id", "v", 3)
    groups = {}
    for r in out.collect():
        groups.setdefault(r["cluster"], set()).add(r["id"] % 3)
    assert sorted(map(tuple, groups.values())) == [(0,), (1,), (2,)]
    assert len(found) == 3


def test_bfr_keeps_every_point(spark):
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0, 0], [20, 0, 0], [0, 20, 0]])
    pts = [(i, (centres[i % 3] + rng.normal(0, 0.5, 3)).tolist(), i // 40) for i in range(120)]
    pts += [(500, [100.0, 100.0, 100.0], 1)]
    df = spark.createDataFrame(pts, "id long, v array<double>, chunk int")
    table, log = clustering.bfr(df, "id", "v", "chunk", 3)
    assert sorted(r["id"] for r in table.collect()) == sorted(p[0] for p in pts)
    last = log.orderBy("round").collect()[-1]
    assert last["ds_points"] == len(pts) and last["rs_points"] == 0
    for r in log.orderBy("round").collect()[:-1]:
        assert r["ds_points"] + r["cs_points"] + r["rs_points"] == 40 * r["round"] + (r["round"] > 1)


def test_bloom_has_no_false_negative(spark):
    df = spark.range(200).select(F.col("id").alias("k"))
    bits = sketches.bloom_build(df, "k")
    probe = sketches.bloom_probe(bits, spark.range(400).select(F.col("id").alias("k")), "k")
    hit = {r["key"]: r["hit"] for r in probe.collect()}
    assert all(hit[i] for i in range(200)) and not any(hit[i] for i in range(200, 400))
    assert sinks.flags_line(probe.where("key < 2 or key > 398"), "key").first()[0] == "T T F"


def test_trailing_zeros(spark):
    df = spark.createDataFrame([(12,), (0,), (1,), (2**40,)], "x long")
    assert [r[0] for r in df.select(hashing.trailing_zeros(F.col("x"))).collect()] == [2, 64, 0, 40]


def test_string_fold(spark):
    df = spark.createDataFrame([("héllo",), ("",), (None,)], "s string")
    got = [r[0] for r in df.select(hashing.string_fold(F.col("s"), 1_000_003)).collect()]
    assert got == [int.from_bytes("héllo".encode(), "big") % 1_000_003, 0, None]


def test_fm_close(spark):
    df = spark.range(5000).select((F.col("id") % 1000).alias("k"))
    r = sketches.fm_distinct(df, "k").first()
    assert r["truth"] == 1000 and 100 < r["estimate"] < 10_000


def test_sample_smaller_than_size(spark):
    df = spark.range(7).select("id", F.lit("t").alias("tag"))
    assert sketches.bottom_k_sample(df, "id", "tag").count() == 7


def test_id_dictionary(spark):
    df = spark.createDataFrame([(x,) for x in ["b", "a", "c", "a", None]], "x string")
    assert rows(dictionary.id_dictionary(df, "x")) == [("a", 0), ("b", 1), ("c", 2)]


def test_readers(spark, tmp_path):
    (tmp_path / "p.csv").write_text("user_id,state\r\nu1,OH \r\nu2,NV\r\n")
    assert rows(readers.pairs_csv(spark, str(tmp_path / "p.csv"))) == [("u1", "OH"), ("u2", "NV")]
    assert rows(readers.pairs_csv(spark, str(tmp_path / "p.csv"), pivot=True)) == [("NV", "u2"), ("OH", "u1")]
    (tmp_path / "m.csv").write_text("1,0.5,2\n2,1,3\n")
    assert [(r["id"], r["vec"]) for r in readers.matrix_csv(spark, str(tmp_path / "m.csv"), 2).collect()] == [(1, [0.5, 2.0]), (2, [1.0, 3.0])]
    (tmp_path / "r.json").write_text('{"business_id": "b", "user_id": "u", "stars": 4.0, "text": "x"}\n{"user_id": "u"}\n')
    assert readers.reviews_json(spark, str(tmp_path / "r.json")).count() == 1
    tweets = spark.createDataFrame([("Big Data now", "en"), ("big data", "fr"), ("none", "en")], "t string, l string")
    assert readers.tagged(tweets, "t", "l", ["big data"], ["en"]).count() == 1
    sinks.save_model(str(tmp_path / "model"), pairs=readers.sample_states(spark))
    assert sinks.load_model(spark, str(tmp_path / "model"), "pairs")[0].count() == 9


def test_bit_maps_lose_no_similar_pair(spark):
    rng = random.Random(8)
    sets = {i: {f"m{rng.randrange(3000)}" for _ in range(rng.choice([1, 5, 300, 2000]))} for i in range(24)}
    sets |= {100 + i: {x for x in s if rng.random() < 0.8} | {f"m{i}"} for i, s in sets.items()}
    df = spark.createDataFrame([(e, m) for e, s in sets.items() for m in s], "entity long, member string")
    for t in (0.055, 0.5, 0.9):
        want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        all_pairs = spark.createDataFrame([(a, b) for a in sets for b in sets if a < b], "a long, b long")
        left = {tuple(r) for r in similarity._within_reach(all_pairs, df, t).collect()}
        assert want <= left
        assert {(r["a"], r["b"]) for r in similarity.jaccard_pairs(df, "entity", "member", t).collect()} == want
    assert len(left) < 300  # of 1128


def test_equal_baskets_are_searched_once(spark, monkeypatch):
    """itemsets_by_brand: a level's rows are those of the kinds of baskets, however many baskets there are."""
    pairs = [(100 * k + b, i) for k in range(40) for b, i in random_baskets(3, n=12)]
    seen = []
    levels = itemsets._levels
    monkeypatch.setattr(itemsets, "_levels", lambda sets, *x: seen.append(sets.count()) or levels(sets, *x))
    df = spark.createDataFrame(pairs + pairs[:7], "b long, i string")
    found = {tuple(r["items"]): r["support"] for r in itemsets.frequent_itemsets(df, "b", "i", lambda n: n // 4).collect()}
    assert found == brute_itemsets(pairs, 120) and seen[0] <= len(random_baskets(3, n=12))


def test_equal_baskets_of_a_part_are_searched_once(spark, monkeypatch):
    """itemsets_candidates: the same, part by part; a basket without items counts as a basket."""
    pairs = [(100 * k + b, i) for k in range(40) for b, i in random_baskets(4, n=12)]
    seen = []
    levels = itemsets._levels
    monkeypatch.setattr(itemsets, "_levels", lambda sets, *x: seen.append(sets.count()) or levels(sets, *x))
    df = spark.createDataFrame([*pairs, (7000, None)], "b long, i string")
    baskets = {b for b, _ in pairs} | {7000}
    want = set()
    for p in range(4):
        own = {b for b in baskets if b % 4 == p}
        want |= {c for c, k in brute_itemsets([x for x in pairs if x[0] in own], 1).items() if k * len(baskets) >= len(own) * 100}
    assert {tuple(r["items"]) for r in itemsets.son_candidates(df, "b", "i", 100, 4).collect()} == want
    assert seen[0] <= 4 * len(random_baskets(4, n=12))


def test_rounds_read_packed_points(spark):
    """kmeans_full: as by Lloyd's rounds on single points, on ties and far from the origin too; starts by both ways are the same."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.integers(-2, 3, (200, 3)).astype(float)]) + 1e6
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    pts = clustering.points(df, "id", "v")
    starts = clustering.initial_centres(pts, 7)
    assert (starts == clustering.initial_centres(pts, 7, one_task=0)).all()
    assert (clustering._nearest_fast(x, starts) == clustering._nearest(x, starts)[0]).all()
    centres = starts.copy()
    for _ in range(1000):
        c = clustering._nearest(x, centres)[0]
        new = np.array([x[c == j].mean(0) if (c == j).any() else centres[j] for j in range(7)])
        if np.allclose(new, centres, rtol=0, atol=1e-9):
            break
        centres = new
    out = {r["id"]: r["cluster"] for r in clustering.kmeans(df, "id", "v", 7)[0].collect()}
    assert [out[i] for i in range(len(x))] == c.tolist()


def test_bfr_runs_on_packed_points(spark):
    """bfr_clusters: its k-means runs read blocks, which hold ids of any kind."""
    rng = np.random.default_rng(4)
    pts = [(f"p{i}", (np.array([20.0 * (i % 3), 0.0]) + rng.normal(0, 0.5, 2)).tolist(), i // 60) for i in range(120)]
    df = spark.createDataFrame(pts, "id string, v array<double>, chunk int")
    assert (clustering.initial_centres(clustering.points(df, "id", "v"), 5) == clustering.initial_centres(clustering.points(df, "id", "v"), 5, one_task=0)).all()
    table, _ = clustering.bfr(df, "id", "v", "chunk", 3)
    groups = {}
    for r in table.collect():
        groups.setdefault(r["cluster"], set()).add(int(r["id"][1:]) % 3)
    assert sorted(map(tuple, groups.values())) == [(0,), (1,), (2,)]
