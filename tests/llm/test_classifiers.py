import zlib

import numpy as np
import pytest

from oddsmill.llm import quality, registry, toxicity
from oddsmill.llm.tables import keyed_text

FOLDER = "/root/testdata/sf0.1"


def measured(spark, query, label):
    rows = query(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows)
    y, p = np.array([r[label] for r in held]), np.array([r.predicted for r in held])
    return (p[y == 1] == 1).mean(), (p[y == 0] == 0).mean()


def test_toxicity_on_held_out_rows(spark):
    found, clean = measured(spark, registry.op5_toxicity, "toxic")
    assert found > 0.85 and clean > 0.98  # about 330 toxic rows to learn from


def test_quality_on_held_out_rows(spark):
    good, bad = measured(spark, registry.op7_quality, "quality")
    assert good > 0.97 and bad > 0.9


LABELS = "doc_id bigint, quality int, toxic int, text string"


@pytest.mark.parametrize("rows", [[], [(1, 1, 0, "t")], [(1, 1, 1, "t"), (3, 0, 0, "t"), (None, 1, 1, "t"), (4, None, None, "t"), (1, 0, 0, "t")], [(900, 1, 1, "t")]])
def test_odd_labels_and_documents(spark, odd, no_documents, rows):
    labels = spark.createDataFrame(rows, LABELS)
    for docs in (odd, no_documents):
        model = toxicity.fit(keyed_text(docs), labels)
        out = toxicity.score_rows(docs, model)
        assert out.columns == [*docs.columns, "toxic_score"]
        assert out.count() == docs.count() and all(0 <= r.toxic_score <= 1 for r in out.collect())
        out = quality.score_documents(keyed_text(docs), quality.fit(keyed_text(docs), labels))
        assert out.count() == docs.count() and all(0 <= r.score <= 1 for r in out.collect())


def test_without_labels_nothing_is_toxic_and_all_is_good(spark, odd):
    labels = spark.createDataFrame([], LABELS)
    assert all(r.toxic_score < toxicity.THRESHOLD for r in toxicity.score_rows(odd, toxicity.fit(keyed_text(odd), labels)).collect())
    assert all(r.score >= quality.THRESHOLD for r in quality.score_documents(keyed_text(odd), quality.fit(keyed_text(odd), labels)).collect())


def test_buckets_match_a_plain_count():
    """n-grams do not cross texts, and presence counts once a text."""
    texts = ["Bad, WORD!", "", "bad word", "x"]
    slot = np.arange(toxicity.BUCKETS, dtype=np.int32)
    rows, slots = toxicity.present(texts, slot)
    alone = [set(toxicity.present([t], slot)[1].tolist()) for t in texts]
    joined = [set(slots[rows == i].tolist()) for i in range(len(texts))]
    assert alone == joined
    plain = toxicity.LETTER[np.frombuffer(b" " * 6 + b"bad word" + b" " * 6, np.uint8)].tobytes()
    grams = {plain[i : i + n] for n in toxicity.SIZES for i in range(len(plain) - n + 1)}
    assert len(joined[2]) <= len(grams) + 60


def test_pairs_recover_an_order():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, len(quality.NAMES)))
    y = (x[:, 0] + 0.1 * rng.normal(size=400) > 0.8).astype(int)
    model = quality.learn(x, y)
    score = quality.to_score(quality.basis(x, model.mean, model.scale) @ model.weight, model.cut, model.spread)
    assert (score >= quality.THRESHOLD).sum() == y.sum()
    assert ((score >= quality.THRESHOLD) == y).mean() > 0.95
