from pyspark.sql import functions as F

import corpus_pipeline as C
from packetlake.llm import jaccard, pii, quality
from tests.llm.test_llm import contamination, jaccard_components

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, state = docs.columns, {}
    for name, stage in C.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        docs = C.saved(stage(spark, docs, SF))
        if name != "pieces":
            assert docs.columns == columns
            state[name] = (before, {r["doc_id"]: r["text"] for r in docs.collect()})
    before, after = state["near_duplicates"]
    comp = jaccard_components(list(before.items()))
    assert set(after) == {c for _, c in comp.values()}
    before, after = state["decontaminate"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(after) == {d for d, (_, hit, *_) in contamination(list(before.items()), items).items() if not hit}
    before, after = state["pii"]
    assert set(before) == set(after) and not any(pii.base_spans(t) for t in after.values())
    assert {r["doc_id"] for r in docs.collect()} == set(after) and docs.where("NOT round_trip").count() == 0
    assert C.run(spark, SF).count() == docs.count()


def test_quality_stage_keeps_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in C.good(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    clean = {r["doc_id"] for r in labels.where("quality = 1").collect()}
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert len(clean & kept) > 0.99 * len(clean) and len(bad & kept) < 0.15 * len(bad)


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    assert jaccard.one_of_each(docs).count() == 0 and C.masked(spark, docs, SF).count() == 0 and C.clean_of_benchmark(spark, docs, SF).count() == 0


def test_odd_rows(spark):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names, through every stage."""
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "word " * 30_000, "en", "s", 5), (5, "call +1 (555) 123-4567 now", "en", None, 9), (5, "call +1 (555) 123-4567 now", "en", None, 9), (None, "no id here", "en", "s", 1), (7, "x" * 30_000, None, "s", None)]
    odd = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG").withColumn("block", F.lit("clash")).withColumn("score", F.lit("clash")).withColumn("ids", F.lit("clash"))
    same = lambda df: sorted(map(str, df.collect()))
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 2, 3, 5, 7)] + [(5, None), (None, 1)], "doc_id LONG, quality INT")
    good = quality.keep_good(odd, quality.learn(odd, labels))
    assert good.columns == odd.columns and set(same(good)) <= set(same(odd))
    assert C.near_duplicates(spark, odd, SF).count() == 6
    assert same(C.clean_of_benchmark(spark, odd, SF)) == same(odd)
    masked = C.masked(spark, odd, SF)
    assert masked.columns == odd.columns and [r["text"] for r in masked.where("doc_id = 5").collect()] == ["call [phone] now"] * 2 and masked.where("doc_id IS NULL").first()["text"] == "no id here"
    last = C.pieces(spark, odd, SF)
    assert last.count() == 7 and last.where("n_pieces = 0").count() == 2 and last.where("NOT round_trip").count() == 0
    none = odd.limit(0)
    model = quality.learn(odd, labels)
    assert [f.count() for f in (quality.keep_good(none, model), C.near_duplicates(spark, none, SF), C.clean_of_benchmark(spark, none, SF), C.masked(spark, none, SF), C.pieces(spark, none, SF))] == [0] * 5


def test_stages_bound_the_batches_of_workers(spark):
    """Rows of 40 kB go to Python in batches of a few megabytes, not of 10,000 rows; blocks are still dealt from large ones."""
    import pyarrow as pa

    from packetlake.llm import blocks

    long = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 8000).alias("text"))
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], ["n"]) for b in batches)
    for name, stage in C.STAGES:
        spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
        stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)
        assert max(r["n"] for r in long.mapInArrow(sizes, "n long").collect()) < 2 * C.BATCH_BYTES, name
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    small = [pa.RecordBatch.from_pydict({"block": [i % 2, 1], "id": [i, -i], "text": ["a", "b"]}) for i in range(50)]
    dealt = list(blocks._deal(iter(small)))
    assert [b.num_rows for b in dealt] == [2]
    assert sorted(x for r in dealt[0].column("rows").to_pylist() for x in pa.ipc.open_stream(r).read_all().column("id").to_pylist()) == sorted([*range(50), *(-i for i in range(50))])
