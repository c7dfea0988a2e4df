import json
import os
import random

from pyspark.sql import functions as F

from tessera.sources import bigjson


def value(rng, depth=0):
    kind = rng.randrange(9 if depth < 3 else 5)
    if kind == 0:
        return rng.randrange(-99, 99) / 2
    if kind == 1:
        return rng.choice([None, True, False])
    if kind < 5:
        return "".join(rng.choice(["a", '"', "\\", "[", "]", "{", "}", ",", ":", "é", "\n", "songs", " "]) for _ in range(rng.randrange(12)))
    if kind < 7:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {rng.choice("abc") + str(i): value(rng, depth + 1) for i in range(rng.randrange(4))}


def test_elements_of_split_documents(spark, tmp_path):
    rng = random.Random(3)
    want = {}
    for i in range(14):
        doc = {"version": f"v{i}", "n": i}
        if i % 3 == 1:
            doc["other"] = [{"songs": [1, 2]}, "songs"]
        if i != 5:
            doc["songs"] = [value(rng) for _ in range([0, 1, 2, 50, 300][i % 5])]
        if i == 7:
            doc["songs"] = {"x": [1]}
        if i % 2:
            doc["tail"] = {"songs": [9], "z": [[1], [2]]}
        name = f"{i:02d}.json"
        (tmp_path / name).write_text(json.dumps(doc, ensure_ascii=bool(i % 4), indent=[None, 1][i % 2]))
        want[name] = doc["songs"] if isinstance(doc.get("songs"), list) else []
    (tmp_path / "empty.json").write_text("")
    sizes = {"spark.sql.files.maxPartitionBytes": "300b", "spark.sql.files.openCostInBytes": "1b"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        assert spark.read.option("lineSep", ",").text(str(tmp_path)).rdd.getNumPartitions() > 20
        rows = bigjson.array_elements(spark, str(tmp_path), "songs").collect()
        heads = {os.path.basename(r.path): (r.version, r.n) for r in bigjson.head(spark, str(tmp_path), "version string, n int").collect()}
    finally:
        for k in sizes:
            spark.conf.unset(k)
    got = {}
    for r in sorted(rows, key=lambda r: (r.path, r.place)):
        got.setdefault(os.path.basename(r.path), []).append((r.place, json.loads(r.element)))
    assert got == {name: list(enumerate(each)) for name, each in want.items() if each}
    assert all(heads[f"{i:02d}.json"] == (f"v{i}", i) for i in range(14))


def test_written_documents_come_back(spark, tmp_path):
    rows = [(g, i, json.dumps({"i": i, "t": t})) for i, (g, t) in enumerate([("a", "x,y"), ("b", ""), ("a", '"]}'), (None, "gone"), ("a", "é\n"), ("a", None)])]
    df = spark.createDataFrame(rows, "g string, at long, element string")
    path = str(tmp_path / "out")
    bigjson.write_documents(df, path, "g", "items", "v1")
    found = bigjson.array_elements(spark, path, "items").withColumn("g", F.regexp_extract("path", "group=([a-z]+)", 1)).collect()
    assert sorted((r.g, r.place, json.loads(r.element)["i"]) for r in found) == [("a", 0, 0), ("a", 1, 2), ("a", 2, 4), ("a", 3, 5), ("b", 0, 1)]
    assert {r.version for r in bigjson.head(spark, path, "version string").collect()} == {"v1"}


def test_elements_across_batches_and_splits(spark, tmp_path):
    rng = random.Random(5)
    want = {}
    for i in range(12):
        songs = [value(rng) for _ in range(rng.randrange(1, 40))] + [["x" * rng.randrange(900), i] for _ in range(3)]
        text = json.dumps({"version": "[{", "k": i, "songs": songs}, ensure_ascii=bool(i % 3), indent=[None, 2][i % 2])[:-1]
        (tmp_path / f"{i}.json").write_text(text + ["}", ', "songs": [9], "z": {"songs": []}}', ""][i % 3])
        want[f"{i}.json"] = songs
    sizes = {"spark.sql.files.maxPartitionBytes": "190b", "spark.sql.files.openCostInBytes": "1b", "spark.sql.execution.arrow.maxRecordsPerBatch": "2"}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        rows = bigjson.array_elements(spark, str(tmp_path), "songs").collect()
    finally:
        for k in sizes:
            spark.conf.unset(k)
    got = {}
    for r in sorted(rows, key=lambda r: (r.path, r.place)):
        got.setdefault(os.path.basename(r.path), []).append((r.place, json.loads(r.element)))
    assert got == {name: list(enumerate(each)) for name, each in want.items()}


def test_texts_are_not_shuffled_to_be_read(spark, tmp_path):
    texts = ["%d, %s" % (i, "long, ") * 40 for i in range(3000)]
    (tmp_path / "a.json").write_text(json.dumps({"version": "v1", "songs": texts}))
    rows = bigjson.array_elements(spark, str(tmp_path), "songs").join(bigjson.head(spark, str(tmp_path), "version string"), "path").select(F.md5("element").alias("m"))
    assert rows.count() == 3000 and rows.distinct().count() == 3000
    rows.write.format("noop").mode("overwrite").save()
    done = rows.agg(F.count("m"))
    done.collect()

    def shuffled(plan):
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return shuffled(plan.executedPlan())
        below = [plan.plan()] if kind.endswith("QueryStageExec") else [plan.children().apply(i) for i in range(plan.children().size())]
        size = plan.metrics().get("dataSize")
        return sum(map(shuffled, below)) + (size.get().value() if kind.startswith("ShuffleExchange") and size.isDefined() else 0)

    most = sum(map(len, texts))  # elements are joined whole here; before, pieces were shuffled several times beside that
    assert shuffled(done._jdf.queryExecution().executedPlan()) < 1.5 * most


def test_elements_of_one_place_keep_their_commas(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, f'{{"i": {i}}}') for i in (3, 1, 2)], "g string, at long, element string").coalesce(1)
    bigjson.write_documents(rows, str(tmp_path / "out"), "g", "items", "v1")
    assert [r.value for r in spark.read.text(str(tmp_path / "out"), wholetext=True).collect()] == ['{"version":"v1","items":[\n{"i": 1}\n,{"i": 2}\n,{"i": 3}\n]}\n']
