import numpy as np

import corpus_pipeline
from tessera.llm import langid, minhash, mixing, pii
from tessera.llm.lattice import pieces
from tessera.llm.tokenfile import public_vocabulary


def test_stages_by_hand(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = spark.createDataFrame([(9_000_001, None, None, None, None), (9_000_002, "", "en", "s", 0), (9_000_003, "12 !", "en", "s", 4)], docs.schema)
    docs.unionByName(extra).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_dedup", "pii_pseudonyms", "raked_mixing", "gumbel_segmentations"]

    results = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        before, now = now, spark.read.parquet(f"{tmp_path}/{name}")
        results[name] = (before, now)
        if name != "gumbel_segmentations":
            assert now.columns == docs.columns
    before, after = results["language_id"]
    gone = {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()}
    assert gone == {9_000_001, 9_000_002, 9_000_003}
    before, after = results["minhash_dedup"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in minhash.near_duplicates(before).where("kept").collect()}
    before, after = results["pii_pseudonyms"]
    assert {(r.doc_id, r.text) for r in after.collect()} == {(r.doc_id, r.text) for r in pii.report(before).collect()}
    before, after = results["raked_mixing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in mixing.mix(before).where("kept").collect()}
    before, after = results["gumbel_segmentations"]
    texts = {r.doc_id: r.text for r in before.collect()}
    v = pieces(public_vocabulary(corpus_pipeline.PIECES), 0.5)
    rows = after.collect()
    assert {r.doc_id for r in rows} == set(texts)
    assert all(v.decoded(np.frombuffer(r.ids, "<u4").tolist()) == texts[r.doc_id] for r in rows)
    again = {(r.doc_id, r.sample, bytes(r.ids)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert again == {(r.doc_id, r.sample, bytes(r.ids)) for r in rows}
    assert langid.UNDETERMINED not in {r.lang for r in results["language_id"][1].collect()}


def test_repeats_ties_and_empty_tables(spark, tmp_path):
    """Repeated ids are settled the same way in any order; an empty table goes through all stages."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(12)
    rows = docs.collect()
    twice = [(rows[0].doc_id, f"another text {i} of the same id with words enough", "en", "s", 0) for i in range(5)]
    made = [spark.createDataFrame([*rows, *order, *rows[:3]], docs.schema) for order in (twice, twice[::-1])]
    kept = [{(r.doc_id, r.text) for r in corpus_pipeline.remove_near_duplicates(spark, m.repartition(3), "").collect()} for m in made]
    assert kept[0] == kept[1] and len({d for d, _ in kept[0]}) == len(kept[0])
    now = spark.createDataFrame([], docs.schema)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, "").write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert now.count() == 0
