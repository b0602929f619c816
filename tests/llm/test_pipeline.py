"""The stages and run() against plain Python on a small corpus with nulls, empty and long texts, ties, repeated rows and clashing names."""

import random
import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(corpus_pipeline.STAGES)


def prose(rng, n=40):
    return " ".join(f"w{rng.randrange(900)}" for _ in range(n)).capitalize() + "."


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng, top = random.Random(1), tmp_path_factory.mktemp("sf")
    good = [prose(rng) for _ in range(60)]
    rows = [(i, t, "en", "s0", len(t)) for i, t in enumerate(good)]
    rows += [(100 + i, "$$ ## !! " * 30 + prose(rng, 6).upper(), "en", "s0", 1) for i in range(60)]
    item = " ".join(f"b{i}" for i in range(30))
    near = good[3].split()
    near[5] = "changed"
    shared = "this very line stands in several documents"
    rows += [(200, good[2], "en", "s1", 1), (201, " ".join(near * 4), "en", "s1", 1), (202, " ".join([*near[:6], "x", *near[6:]] * 4), "en", "s1", 1), (203, f"{prose(rng)} {item} {prose(rng)}", "en", "s1", 1), (204, f"{prose(rng)}\n{shared}", "en", "s1", 1), (205, f"{prose(rng)}\n{shared}s", "en", "s1", 1), (206, shared, "en", "s1", 1)]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, prose(rng, 20_000), "en", "s1", 1), (None, good[7], "en", "s1", 1)]
    rows += [rows[0], rows[0]]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{top}/documents.parquet")
    labels = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)] + [(1, 0, 0), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), rows


def clashing(df):
    return df.withColumns({"score": F.lit("x"), "_id": F.lit(1), "kept": F.lit(2), "line": F.lit(3), "words": F.lit(4), "_gone": F.lit(5), "n": F.lit(6)})


def kept(df):
    assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_quality_stage(spark, corpus):
    top, rows = corpus
    out = kept(STAGES["quality"](spark, clashing(spark.read.parquet(f"{top}/documents.parquet")), top))
    ids = [i for i, _ in out]
    assert set(range(60)) <= set(ids) and not any(i is not None and 100 <= i < 160 for i in ids)
    assert ids.count(0) == 3 and dict(out)[302] == next(r[1] for r in rows if r[0] == 302)


def test_lines_stage(spark, corpus):
    top, rows = corpus
    out = kept(STAGES["lines"](spark, clashing(spark.read.parquet(f"{top}/documents.parquet")), top))
    text = {}
    for i, t in out:
        text.setdefault(i, set()).add(t)
    original = {r[0]: r[1] for r in rows}
    assert text[204] == {original[204]}  # the first of its class stays
    assert text[205] == {original[205].split("\n")[0]}
    assert 206 not in text and 200 not in text  # all their lines stand earlier
    assert text[300] == {None} and text[301] == {""} and text[None] == {original[None]}
    assert [i for i, _ in out].count(0) == 3


def test_near_duplicates_stage(spark, corpus):
    top, rows = corpus
    out = kept(STAGES["near_duplicates"](spark, clashing(spark.read.parquet(f"{top}/documents.parquet")), top))

    def shingles(t):
        ws = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    sets, gone = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}, set()
    for a in sorted(sets):
        for b in sorted(sets):
            k = len(sets[a] & sets[b])
            if a < b and k and 100 * k >= 80 * len(sets[a] | sets[b]):
                gone.add(b)  # no chains in these rows: each group is around its least member
    assert gone >= {200} and {i for i, _ in out} == {r[0] for r in rows} - gone


def test_decontamination_stage(spark, corpus):
    top, rows = corpus
    out = kept(STAGES["decontamination"](spark, clashing(spark.read.parquet(f"{top}/documents.parquet")), top))
    assert sorted(map(str, out)) == sorted(str(r[:2]) for r in rows if r[0] != 203)


def test_run_is_its_stages(spark, corpus):
    top, _ = corpus
    docs = spark.read.parquet(f"{top}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, top).collect(), SCHEMA)
    want = {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in corpus_pipeline.STAGES[-1][1](spark, docs, top).collect()}
    got = corpus_pipeline.run(spark, top).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == want
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in x) <= 2048 and sorted(x)[0][0] == 0 for x in by.values())
    assert {203, 206, 200} & {r["doc_id"] for r in got} == set()


@pytest.mark.parametrize("name", list(STAGES))
def test_stages_of_nothing(spark, corpus, name):
    top, _ = corpus
    assert STAGES[name](spark, spark.read.parquet(f"{top}/documents.parquet").limit(0), top).count() == 0
