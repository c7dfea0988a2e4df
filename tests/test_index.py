import math
import random

from pyspark.sql import functions as F

from tessera.operators.index import Index

WORDS = ["alpha", "alp", "beta", "betamax", "gamma", "Äpfel", "x1"]


def held(docs):
    return {i: {"title": t.lower().replace("ä", "a").split(), "body": (b or "").lower().replace("ä", "a").split()} for i, (t, b) in docs.items()}


def ranked(docs, query, weights):
    each, out = held(docs), {}
    length = {i: sum(map(len, f.values())) for i, f in each.items()}
    mean = sum(length.values()) / max(len(length), 1)
    wtf = {q: {i: w for i, f in each.items() if (w := sum(weights[n] * sum(x.startswith(q) for x in ws) for n, ws in f.items()))} for q in query}
    for i in each:
        if all(i in wtf[q] for q in query):
            idf = {q: math.log(1 + (len(each) - len(wtf[q]) + 0.5) / (len(wtf[q]) + 0.5)) for q in query}
            out[i] = sum(idf[q] * wtf[q][i] * 2.2 / (wtf[q][i] + 1.2 * (0.25 + 0.75 * length[i] / mean)) for q in query)
    return out


def phrased(docs, words, field, begins):
    out = {}
    for i, f in held(docs).items():
        ws = f[field]
        for at in range(len(ws) - len(words) + 1):
            if ws[at : at + len(words) - 1] == words[:-1] and ws[at + len(words) - 1].startswith(words[-1]) and (at == 0 or not begins):
                out.setdefault(i, at)
    return out


def test_changes_equal_an_index_made_anew(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(n)))
    index = Index(spark, str(tmp_path / "index"))
    fields = {"title": F.col("title"), "body": F.col("body")}
    assert index.totals() == (0, 0) and index.ranked(["a"], {"title": 1.0}).count() == 0
    docs = {}

    def change(added, removed=()):
        docs.update(added)
        for i in removed:
            docs.pop(i, None)
        df = spark.createDataFrame([(i, t, b, "x") for i, (t, b) in added.items()] + [(None, "alpha", "alpha", "x")], "doc_id long, title string, body string, term string")
        gone = spark.createDataFrame([(i,) for i in removed] + [(None,)], "doc_id long")
        return index.changed(df, fields, gone)

    def same(found):
        assert found.totals() == (len(docs), sum(len(ws) for f in held(docs).values() for ws in f.values()))
        for query in (["alp"], ["alp", "b"], ["apfel", "x"], ["none"]):
            weights = {"title": 10.0, "body": 2.0}
            got, want = {r.doc_id: r.score for r in found.ranked(query, weights).collect()}, ranked(docs, query, weights)
            assert got.keys() == want.keys() and all(math.isclose(got[i], want[i]) for i in want)
        for words, field, begins in ((["alpha", "b"], "body", False), (["alp", "alp"], "body", False), (["g"], "title", True), (["beta", "beta", "x1"], "body", True)):
            assert {r.doc_id: r.place for r in found.phrase(words, field, begins).collect()} == phrased(docs, words, field, begins)

    assert change({i: (text(4), text(12)) for i in range(40)} | {40: ("", None)}) == 0
    same(index)
    assert change({i: (text(4), text(12)) for i in (3, 5, 41)}, [7, 8, 99]) == 1
    assert change({7: (text(4), text(12))}, [3]) == 2
    assert change({}, [10]) == 3
    same(index)
    same(index.compacted(str(tmp_path / "compacted")))


def test_only_whole_segments_are_read(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    one = spark.createDataFrame([(1, "alpha beta")], "doc_id long, body string")
    index.changed(one, {"body": F.col("body")})
    # a change that ended before its manifest row was written
    one.selectExpr("2L AS doc_id", "'body' AS field", "'alpha' AS term", "array(0) AS places", "2L AS length").write.parquet(f"{index.folder}/postings/segment=1")
    assert [r.doc_id for r in index.postings(["alp"]).collect()] == [1]
    assert index.changed(one.selectExpr("3L AS doc_id", "body"), {"body": F.col("body")}) == 1
    assert sorted(r.doc_id for r in index.postings(["alp"]).collect()) == [1, 3]


def test_prefixes_reach_the_scan(spark, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    index.changed(spark.createDataFrame([(1, "alpha beta")], "doc_id long, body string"), {"body": F.col("body")})
    plan = index.phrase(["alpha", "b"], "body")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,b)" in plan and "EqualTo(field,body)" in plan


def test_rows_of_one_document_follow_each_other_and_voids_are_few(spark, tmp_path, monkeypatch):
    from tessera.operators import index as module

    index = Index(spark, str(tmp_path / "index"))
    fields = {"body": F.col("body")}
    index.changed(spark.createDataFrame([(1, "alpha"), (1, "beta"), (2, "alpha beta"), (3, "")], "doc_id long, body string"), fields)
    found = [index.phrase(words, "body").where("doc_id = 1").count() for words in (["alpha", "beta"], ["beta", "alpha"])]
    assert sorted(found) == [0, 1]
    index.changed(spark.createDataFrame([(2, "beta"), (4, "beta")], "doc_id long, body string"), fields, spark.createDataFrame([(9,)], "doc_id long"))
    # neither what is new nor what was never there is void
    assert [r.doc_id for r in spark.read.parquet(f"{index.folder}/void").collect()] == [2]
    before = sorted(map(tuple, index.postings().collect()))
    monkeypatch.setattr(module, "BROADCAST", 0)
    assert sorted(map(tuple, index.postings().collect())) == before


def test_postings_stay_in_the_task_that_makes_them(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = Index(spark, str(tmp_path / "index"))
        index.changed(spark.range(50).selectExpr("id AS doc_id", "concat('w', id, ' at the end') AS body"), {"body": F.col("body")})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(f"{index.folder}/postings").withColumn("file", F.input_file_name())
    assert files.groupBy("doc_id").agg(F.countDistinct("file").alias("n")).where("n > 1").count() == 0
    assert files.select("file").distinct().count() > 1 and index.totals() == (50, 200)


def test_postings_of_batches_cut_into_steps(monkeypatch):
    import pyarrow as pa
    from tessera.operators import index as module

    class Rows:
        columns, dtypes = ["doc_id"], [("doc_id", "bigint")]

        def mapInArrow(self, run, schema):
            return run

    rng = random.Random(3)
    rows = [(i, f, [rng.choice("abc") for _ in range(rng.choice([0, 1, 4, 30]))], i) for i in range(40) for f in ("x", "y")]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in range(3)] + [pa.array([r[3] for r in rows])], names=["doc_id", "field", "terms", "length"])
    want = sorted((i, f, t, [k for k, x in enumerate(ts) if x == t], n) for i, f, ts, n in rows for t in set(ts))
    for step in (1, 7, 100_000):
        monkeypatch.setattr(module, "STEP", step)
        found = list(module._postings(Rows())([batch.slice(0, 33), batch.slice(33), batch.slice(0, 0)]))
        assert sorted(tuple(r.values()) for b in found for r in b.to_pylist()) == want and (step > 7 or len(found) > 9)
