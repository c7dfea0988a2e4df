"""Queries over whole tables, where the SQL of their namesakes takes a part, against brute force."""

import hashlib
from collections import defaultdict

import pytest

from tessera import plans
from tessera.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def parts(spark):
    return table(spark, SF, "part").collect()


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_dice_of_all_parts(spark, parts):
    want = []
    for x in parts:
        for y in parts:
            a, b = set(x.p_name.lower().split()), set(y.p_name.lower().split())
            if x.p_partkey < y.p_partkey and x.p_brand == y.p_brand and a & b:
                want.append((x.p_partkey, y.p_partkey, round(2 * len(a & b) / (len(a) + len(b)), 6)))
    assert any(x.p_size > 5 for x in parts) and got(plans.QUERIES["dice_match_all"][0](spark, SF)) == sorted(want)


def test_titles_of_all_parts(spark, parts):
    want = [
        (x.p_partkey, y.p_partkey, 0 if x.p_partkey % 3 == 1 else 2)
        for x in parts for y in parts if x.p_partkey < y.p_partkey and x.p_name == y.p_name
    ]
    assert any(b % 2 for _, b, _ in want) and got(plans.QUERIES["title_keys_match_all"][0](spark, SF)) == sorted(want)


def test_dedupe_by_whole_texts(spark, tmp_path):
    same = "The same thirty characters at first, "
    rows = [(1, same + "a"), (2, same + "b"), (3, same.upper() + "A"), (4, ""), (5, None), (6, None), (7, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    groups = defaultdict(list)
    for i, t in rows:
        groups[None if t is None else hashlib.sha256(t.lower().encode()).hexdigest()].append(i)
    found = plans.QUERIES["dedupe_whole"][0](spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.key, r.n_rows) for r in found} == {(min(v), k, len(v)) for k, v in groups.items()}
