from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import relate, variants


def test_errors_and_paths(spark):
    rows = {
        1: ('{"a":1}', None, []), 2: (None, "missing", []), 3: ("  ", "missing", []), 4: ('{"a":', "invalid", []),
        5: ('{"__proto__":{"constructor":[{"x y":{"prototype":null}}]}}', "forbidden", ["$.__proto__", "$.__proto__.constructor", '$.__proto__.constructor[0]."x y".prototype']),
        6: ('[1,[2,{"constructor":2}]]', "forbidden", ["$[1][1].constructor"]), 7: ("5", None, []), 8: ("null", None, []), 9: ('"__proto__"', None, []), 10: ("{}", None, []),
        11: ("[" * 60 + '{"prototype":[]}' + "]" * 60, "forbidden", ["$" + "[0]" * 60 + ".prototype"]),
    }
    df = spark.createDataFrame([(k, t, "x") for k, (t, *_) in rows.items() if k < 11], "id long, t string, path string")
    got = {r.id: (r.error, r.paths) for r in variants.checked(df, "id", "t").collect()}
    assert got == {k: (e, p) for k, (_, e, p) in rows.items() if k < 11}
    assert variants.checked(df.limit(0), "id", "t").count() == 0


def test_reading_order(spark):
    names = ["a 10", "Á 9", "a 010b", "b", "ä", "A 2", "", "a 1000000000000000000000", "a 999999999999999999999", "10", "9z"]
    df = spark.createDataFrame([(n,) for n in names], "n string").withColumn("k", text.natural_key(F.col("n")))
    got = [r.n for r in relate.numbered(df, ["k", "n"]).orderBy("place").collect()]
    assert got == ["", "9z", "10", "ä", "A 2", "Á 9", "a 10", "a 010b", "a 999999999999999999999", "a 1000000000000000000000", "b"]
    assert relate.numbered(df.limit(0), ["n"]).count() == 0
