import hashlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from oddsmill.llm import decontaminate, near_copies, near_dedup, toxicity, trie_bpe
from oddsmill.llm.tables import keyed_text
from tests.llm.test_decontaminate import brute_leaks
from tests.llm.test_exact_dedup import low
from tests.llm.test_near_copies import brute_kept

FOLDER = "/root/testdata/sf0.001"


def stage(spark, k, docs, tmp_path, folder=FOLDER):
    path = str(tmp_path / f"stage{k}")
    corpus_pipeline.STAGES[k][1](spark, docs, folder).write.parquet(path)
    return spark.read.parquet(path)


def test_every_stage_matches_plain_python_and_run_is_their_chain(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    model = toxicity.fit(keyed_text(docs), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    kept = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    for k in range(4):
        docs = stage(spark, k, docs, tmp_path)
        assert docs.columns == columns
        if k == 0:
            kept = {i: r for i, r in kept.items() if model.score([r.text or ""])[0] < toxicity.THRESHOLD}
        elif k == 1:
            last = {low(r.text): i for i, r in sorted(kept.items())}
            kept = {i: kept[i] for i in last.values()}
        elif k == 2:
            kept = {i: kept[i] for i in brute_kept([(i, r.text) for i, r in kept.items()])}
        else:
            bad = {d for d, _ in brute_leaks(items, [(i, r.text, "") for i, r in kept.items()])}
            kept = {i: r for i, r in kept.items() if i not in bad}
        assert sorted(docs.collect()) == sorted(kept.values()), corpus_pipeline.STAGES[k][0]
    library = Tokenizer.from_file(trie_bpe.default_path())
    want = {i: library.encode(r.text or "", add_special_tokens=False).ids for i, r in kept.items()}
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id: bytes(r.ids) for r in got} == {i: np.array(v, "<u4").tobytes() for i, v in want.items()} and len(got) == len(want)
    assert all(r.decoded_sha256 == hashlib.sha256((kept[r.doc_id].text or "").encode()).hexdigest() and r.n_tokens == len(want[r.doc_id]) for r in got)


@pytest.mark.parametrize("empty", [False, True])
def test_odd_documents_pass_through_all_stages(spark, odd, no_documents, tmp_path, empty):
    docs = no_documents if empty else odd
    columns = docs.columns
    for k in range(len(corpus_pipeline.STAGES)):
        docs = stage(spark, k, docs, tmp_path)
        assert docs.columns == columns or k == 4
    left = sorted((r.doc_id for r in docs.collect()), key=str)
    # 1 and 2 are equal texts, 4, 3 and 9 have no words, 5 and 6 differ by a letter beyond A-Z, the tail of 7 and the rest are alone
    assert left == ([] if empty else sorted([2, 5, 6, 7, 8, 4, None], key=str)) or decontaminate.SIMILARITY != 0.8


def test_near_copies_are_found_by_simhash_and_by_similarity_and_both_connect(spark):
    """1 and 2 have one fingerprint, for they repeat most of their words, but share few of their distinct shingles; 3 shares most of
    them with 2. 5 and 6 share no link with the rest."""
    words = lambda tag, n: " ".join(f"{tag}{i}" for i in range(n))
    a, b, c = "one two three " * 2000 + words("p", 12), "one two three " * 2000 + words("q", 60), words("q", 60) + " one two three" * 2
    assert near_dedup.fingerprint(a) == near_dedup.fingerprint(b) and (near_dedup.fingerprint(b) ^ near_dedup.fingerprint(c)).bit_count() > 3
    rows = [(1, a), (2, b), (3, c), (5, words("r", 40)), (6, words("s", 40))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    share = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    sets = {i: near_copies.shingles(t) for i, t in rows}
    assert share(sets[1], sets[2]) < 0.8 <= share(sets[2], sets[3]) and share(sets[1], sets[3]) < 0.8
    kept = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 5, 6]


def test_workers_of_the_last_stage_idle_with_empty_caches(spark):
    from oddsmill.llm import workers

    bpe, cache = trie_bpe._worker(trie_bpe.default_path())

    def run(batches):
        cache.texts(["some words to be remembered"])
        assert cache.known and bpe.pairs
        yield from batches

    list(workers.emptied(run)(iter([])))
    assert not (cache.known or cache.older or bpe.words or bpe.pairs)
    docs = keyed_text(spark.read.parquet(f"{FOLDER}/documents.parquet"))
    rows = [sorted((r.key, bytes(r.ids)) for r in trie_bpe.encode_documents(docs, remember=keep).collect()) for keep in (True, False)]
    assert rows[0] == rows[1] and rows[0]
