import os

import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline as C
from lodestone.llm import jaccard
from lodestone.llm.session import FILES_A_CORE, LEAST_FILES, bounded, discard, kept

from . import test_decontaminate, test_jaccard, test_packing, test_secrets


def mask(text):
    want, at = "", 0
    for s, _, e, _ in test_secrets.all_spans(text):
        if s > at or not want:
            want += text[at:s] + "[SECRET]"
        at = max(at, e)
    return want + text[at:]


def test_stages_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    odd = [("12 34 !!", "en"), (None, None), ("", "en"), ("password=abcdefghijkl and more words here", None)]
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = spark.createDataFrame([(900000 + i, t, k, "x", len(t or "")) for i, (t, k) in enumerate(odd)], real.schema)
    docs = real.unionByName(extra)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    texts = {i: t for i, t in texts.items() if t and any(c.isalpha() for c in t)}
    ids = sorted(texts)
    firsts = {ids[c] for _, _, c in test_jaccard.brute([texts[i] for i in ids])}
    ids = [i for i in ids if i in firsts]
    bad = {ids[r[0]] for r in test_decontaminate.brute([texts[i] for i in ids], items) if r[2]}
    ids = [i for i in ids if i not in bad]
    want = {i: mask(texts[i]) for i in ids}
    for name, stage in C.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == real.columns, name
        docs = spark.createDataFrame(out.collect(), real.schema)
    got = {r.doc_id: r.text for r in docs.collect()}
    assert got == want
    packed = C.STAGES[-1][1](spark, docs, sf_dir).collect()
    at = {i: k for k, i in enumerate(ids)}
    renumbered = [type("R", (), r.asDict() | {"doc_id": at[r.doc_id]}) for r in packed]
    test_packing.check(renumbered, [want[i] for i in ids], 2048)


def test_language_stage_rejects_by_distance(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = ["Все люди рождаются свободными и равными в своем достоинстве и правах", "xqzv wkjq zzxk vqpw jjkx qwzx vvkq xzjw qqkz"]
    extra = spark.createDataFrame([(900000 + i, t, None, "x", len(t)) for i, t in enumerate(odd)], real.schema)
    kept = C.identify_language(spark, real.unionByName(extra), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in real.collect())


def test_language_stage_without_labels(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(0, "some words", None, "x", 10), (1, "12 34", None, "x", 5), (2, None, None, "x", 0), (3, "né", None, "x", 2)]
    assert sorted(r.doc_id for r in C.identify_language(spark, spark.createDataFrame(rows, real.schema), "").collect()) == [0, 3]


def test_stages_on_odd_tables(spark):
    """Empty tables, repeated rows, null ids and other nulls, a long text, and a column whose name the operators use."""
    sf_dir = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20)
    odd = [(None, None, None, None, None), (None, "some words of english text here", None, None, None), (900_001, "", "en", "x", 0), (900_002, "the word " * 200_000, "en", "x", 1_800_000)]
    docs = real.unionByName(real).unionByName(spark.createDataFrame(odd, real.schema)).withColumn("label", F.lit(1))
    for name, stage in C.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).count() == 0, name
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        n = out.count()
        assert 0 < n <= docs.count() and (name != "jaccard_join" or out.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()), name
        assert name == "language_id" or out.where("doc_id is null").count() == 2, name
        assert name == "language_id" or out.where("doc_id = 900002").count() == 1, name
    name, stage = C.STAGES[-1]
    assert stage(spark, docs.limit(0), sf_dir).count() == 0
    packed = stage(spark, docs, sf_dir)
    assert packed.where("piece = 0").count() == docs.count()


def test_intermediate_tables_of_few_files(spark):
    """Hadoop starts a process for each local file it makes, a .crc file included, and the more there are, the larger the input."""
    out = kept(spark.range(0, 1000, 1, 200), few=True)
    names = os.listdir(out._lodestone_path.removeprefix("file:"))
    assert out.count() == 1000 and 0 < sum(n.endswith(".parquet") for n in names) <= 32 and not any(n.endswith(".crc") for n in names)
    discard(out)


def test_near_duplicates_leave_in_few_files_and_unsorted(spark, monkeypatch):
    """Stage 2's result had a file, for which Hadoop starts processes, for each shuffle partition, and whole texts were sorted for the join."""
    n = 600
    docs = spark.range(n).selectExpr("id as doc_id", "repeat('some words ', 50) as text", "'en' as lang")
    found = spark.range(n).selectExpr("id as doc", "cast(0 as long) as th", "named_struct('doc', id - id % 3, 'th', cast(0 as long)) as root")
    monkeypatch.setattr(jaccard, "linked", lambda *a, **k: found)
    settings = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        out = jaccard.deduplicated(docs)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert out.rdd.getNumPartitions() <= max(LEAST_FILES, FILES_A_CORE * spark.sparkContext.defaultParallelism)
        assert sorted(r.doc_id for r in out.collect()) == list(range(0, n, 3))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_batches_are_no_larger_than_the_parts_worked_on(spark):
    """Batches of 8 MB were held outside the JVM's heap, and by Python, which takes 2 MB at a time."""
    rows = bounded(spark).range(0, 64, 1, 1).selectExpr("id", "repeat('x', 500000) as text")
    largest = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.nbytes]}) for b in batches), "n long").agg(F.max("n")).first()[0]
    assert 500_000 < largest < 3_000_000
