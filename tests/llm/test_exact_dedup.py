from collections import Counter, defaultdict

from pyspark.sql import functions as F

from oddsmill.llm import exact_dedup


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def decide(spark, docs, tmp_path, **how):
    path = str(tmp_path / "docs")
    docs.repartition(3).write.parquet(path)
    return exact_dedup.deduplicate(spark, path, **how), path


def check(docs, out):
    groups = defaultdict(list)
    for r in docs.collect():
        groups[low(r.text)].append(r.doc_id)
    top = lambda ids: max((i for i in ids if i is not None), default=None)
    want = Counter((i, top(ids), len(ids)) for ids in groups.values() for i in ids)
    rows = out.collect()
    assert Counter((r.entry.doc_id, r.keep.doc_id, r.group_size) for r in rows) == want
    assert sum(r.kept for r in rows) == len(groups)


def test_groups_keep_the_largest_id_of_equal_texts(spark, odd, tmp_path):
    out, _ = decide(spark, odd, tmp_path)
    check(odd, out)


def test_colliding_digests_are_settled_by_the_bytes(spark, odd, tmp_path):
    out, _ = decide(spark, odd, tmp_path, digest=lambda body: F.unhex(F.substring(F.sha2(body, 256), 1, 1)))
    check(odd, out)


def test_large_groups_are_compared_in_slices(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact_dedup, "GROUP_SLICE", 7)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Same")).otherwise(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("text"))
    out, _ = decide(spark, docs, tmp_path)
    check(docs, out)


def test_state_goes_on_where_it_stopped(spark, odd, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    odd.repartition(2).write.parquet(path)
    exact_dedup.deduplicate(spark, path, state).count()
    more = spark.createDataFrame([(50, "X"), (51, "new")], "doc_id bigint, text string")
    more.coalesce(1).write.mode("append").parquet(path)
    check(odd.select("doc_id", "text").unionByName(more), exact_dedup.deduplicate(spark, path, state))


def test_empty_table(spark, no_documents, tmp_path):
    out, _ = decide(spark, no_documents, tmp_path)
    assert out.count() == 0
    assert exact_dedup.kept_documents(spark, no_documents).count() == 0


def test_stage_keeps_whole_rows(spark, odd):
    out = exact_dedup.kept_documents(spark, odd)
    assert out.columns == odd.columns
    assert sorted(low(r.text) for r in out.collect()) == sorted({low(r.text) for r in odd.collect()})
