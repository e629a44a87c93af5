import random

import pytest

import corpus_pipeline
from oddsmill.llm import near_copies


def grams(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """rows: distinct ids and texts; the smallest id of each component of pairs at 0.8 or more."""
    sets = [grams(t) for _, t in rows]
    name = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, all_of = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if (not all_of or both / all_of >= 0.8) and name[i] != name[j]:
                old, new = max(name[i], name[j]), min(name[i], name[j])
                name = [new if n == old else n for n in name]
    return sorted(min(rows[i][0] for i in range(len(rows)) if name[i] == n) for n in set(name))


def near_copied(seed, groups=12, size=12):
    rnd = random.Random(seed)
    out = []
    for _ in range(groups):
        words = [f"w{rnd.randrange(500)}" for _ in range(rnd.randrange(60, 160))]
        for _ in range(size):
            copy = list(words)
            for at in rnd.sample(range(len(copy)), rnd.randrange(0, 4)):
                copy[at] = f"edit{rnd.randrange(10**6)}"
            out.append(" ".join(copy))
            if rnd.random() < 0.3:
                words = copy  # chains: what is near a near copy need not be near the first
    rnd.shuffle(out)
    return list(enumerate([*out, "", " \t", "two words", "TWO words"]))


@pytest.mark.parametrize("group,size", [(2048, 8 << 20), (3, 8 << 20), (2048, 3_000)])
def test_pipeline_stage_matches_brute_force(spark, group, size, monkeypatch):
    """Also with groups so small, by number or by bytes, that buckets are dealt out in parts and strays are met again."""
    monkeypatch.setattr(near_copies, "GROUP", group)
    monkeypatch.setattr(near_copies, "GROUP_BYTES", size)
    rows = near_copied(1, 12, 12) if group > 100 and size > 10_000 else near_copied(2, 4, 8)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, node string")
    out = dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == brute_kept(rows)


def test_odd_and_empty_documents(spark, odd, no_documents):
    assert near_copies.kept_documents(no_documents).count() == 0
    assert sorted((r.doc_id for r in near_copies.kept_documents(odd).collect()), key=str) == [1, 3, 5, 6, 7, 8, None]
