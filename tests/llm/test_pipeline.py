"""The pipeline's stages in order, on small tables."""

import random

import corpus_pipeline
from arenalake.llm import secrets, toxicity
from test_documents import components, simhash_of

SF = "/root/testdata/sf0.01"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = corpus_pipeline.materialise(stage(spark, docs, SF), f"test-{name}")
        assert docs.columns == columns
        counts.append(docs.count())
        if name == "toxicity":
            scored = toxicity.score_toxicity(before, spark.read.parquet(f"{SF}/labels.parquet"))
            assert counts[-1] == scored.where("predicted = 0").count()
        if name == "secrets":
            assert counts[-1] == counts[-2]
            assert secrets.scan_secrets(docs).agg({"n_assign": "sum"}).first()[0] == 0
    assert counts[1] < counts[0] and counts[2] < counts[1]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert packed.select("doc_id").distinct().count() <= counts[-1]


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns[0] == "sequence_id"


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, __key string, score double, words array<string>, m map<string,int>, s struct<a:int,m:map<int,string>>, __p array<struct<x:int>>"


def odd_documents():
    rng = random.Random(21)
    prose = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    texts = [(i, prose(60)) for i in range(0, 80)]
    texts += [(100 + i, prose(40) + " vilefoo vilebar nastyone vilefoo") for i in range(24)]
    texts += [(1, texts[1][1]), (1, prose(50)), (None, prose(50)), (None, None), (None, texts[3][1]), (200, None), (201, ""), (202, " \t\n ")]
    texts += [(203, prose(9000)), (204, "password=abcdefgh12345678 " + prose(40)), (205, "one"), (206, texts[5][1].upper())]
    return [(i, t, None if n % 3 else "en", None, None if t is None else len(t), "x", "clash", None, None, {"a": n % 2} if n % 4 else None, (n % 3, {1: "x"}), [(1,)] if n % 2 else None) for n, (i, t) in enumerate(texts)]


def test_stages_with_odd_rows_against_plain_python(spark, tmp_path):
    rows = odd_documents()
    labels = [(i, 1, int(100 <= i < 124)) for i in [*range(80), *range(100, 124)]] + [(None, 1, 1), (5, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    have = [(r.doc_id, r.text) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    stages = dict(corpus_pipeline.STAGES)

    def after(name):
        nonlocal docs
        docs = corpus_pipeline.materialise(stages[name](spark, docs, str(tmp_path)), f"odd-{name}")
        assert docs.schema.names == [c.split()[0] for c in SCHEMA.split(", ")]
        return sorted(((r.doc_id, r.text) for r in docs.collect()), key=key)

    kept = after("toxicity")
    assert kept == sorted((r for r in have if "vilefoo" not in (r[1] or "")), key=key)
    # SimHash: one row of each component, the one of the smallest id that it has.
    prints = {t: simhash_of(t) for _, t in kept}
    comp = components(sorted(set(prints.values())), [(a, b) for a in set(prints.values()) for b in set(prints.values()) if a < b and (a ^ b).bit_count() <= 3])
    least = {}
    for i, t in kept:
        c = comp[prints[t]]
        if c not in least or (i is None, i or 0) < least[c]:
            least[c] = (i is None, i or 0)
    once = after("simhash")
    assert sorted((comp[prints[t]], (i is None, i or 0)) for i, t in once) == sorted(least.items())
    # Secrets: texts as redacted by the base rule, rows as before.
    clean = after("secrets")
    assert [i for i, _ in clean] == [i for i, _ in once]
    assert sum("[SECRET]" in (t or "") for _, t in clean) == 1 and not any("abcdefgh12345678" in (t or "") for _, t in clean)
    assert {t for _, t in once if "password" not in (t or "")} == {t for _, t in clean if "[SECRET]" not in (t or "")}
    # Mixing: whole rows, each as often as its rate says, rounded either way.
    mixed = after("mixing")
    assert set(mixed) <= set(clean) and {r for r in clean if r[0] in range(80)} <= set(mixed)  # labelled clean
    # Packing: every word of every row once.
    placed = stages["packing"](spark, docs, str(tmp_path)).collect()
    words = {}
    for r in placed:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.n_words
    want = {}
    for i, t in mixed:
        if (t or "").split():
            want[i] = want.get(i, 0) + len(t.encode().split())
    assert words == want


def test_empty_tables_go_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
