import random

import numpy as np
import pytest
import xxhash

from oddsmill.llm import near_dedup


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """fps: (id, fingerprint) pairs; the smallest id reachable."""
    names = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            for j in range(i):
                if (fps[i][1] ^ fps[j][1]).bit_count() <= 3 and names[i] != names[j]:
                    names[i] = names[j] = min(names[i], names[j])
                    changed = True
    groups = {n: [fps[i][0] for i in range(len(fps)) if names[i] == n] for n in set(names)}
    return sorted(((i, min((x for x in g if x is not None), default=None)) for g in groups.values() for i in g), key=str)


def test_odd_documents_match_brute_force(spark, odd):
    rows = near_dedup.documents_components(odd).collect()
    want = [(r.doc_id, brute_fingerprint(r.text)) for r in odd.collect()]
    assert sorted((r.doc_id or -1, r.fingerprint) for r in rows) == sorted((i or -1, f"{f:016x}") for i, f in want)
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == brute_components(want)


def test_chunks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=500))
    monkeypatch.setattr(near_dedup, "CHUNK", 16)
    assert near_dedup.fingerprint(text) % 2**64 == brute_fingerprint(text)


@pytest.mark.parametrize("group", [2048, 8, 3])
def test_links_lose_no_component(spark, group, monkeypatch):
    """Dense clouds of fingerprints, also with groups so small that they are split over several levels."""
    monkeypatch.setattr(near_dedup, "GROUP", group)
    rnd = random.Random(group)
    fps = set()
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(25):
            y = x
            for b in rnd.sample(range(64), rnd.randrange(0, 5)):
                y ^= 1 << b
            fps.add(y)
    fps |= {rnd.getrandbits(64) for _ in range(50)}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = near_dedup.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"))
    from oddsmill.llm.components import connected_components

    found = {r.node: r.component for r in connected_components(links).collect()}
    got = sorted((f, found.get(f, f)) for f in signed)
    assert got == sorted(brute_components(list(zip(signed, [f % 2**64 for f in signed]))))


def test_masks_cover_every_three_bits():
    rnd = random.Random(3)
    for mask in [0, *near_dedup.block_masks(0)[:3]]:
        free = [i for i in range(64) if not mask >> i & 1]
        for _ in range(200):
            diff = sum(1 << b for b in rnd.sample(free, 3))
            assert any(not m & diff for m in near_dedup.block_masks(mask))


def test_empty_and_stage(spark, odd, no_documents):
    assert near_dedup.documents_components(no_documents).count() == 0
    assert near_dedup.kept_documents(no_documents).count() == 0
    out = near_dedup.kept_documents(odd)
    assert out.columns == odd.columns
    kept = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    names = {c for _, c in brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in odd.collect()])}
    assert kept == sorted(n for n in names if n is not None)
