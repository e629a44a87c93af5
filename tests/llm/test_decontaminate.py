import random

import numpy as np
import pytest

from oddsmill.llm import decontaminate as dc


def brute_align(a, b):
    best, table = (0, 0), [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            same = a[i - 1] == b[j - 1]
            up, left, diag = table[i - 1][j], table[i][j - 1], table[i - 1][j - 1]
            options = [(diag[0] + (2 if same else -1), diag[1] + same), (up[0] - 1, up[1]), (left[0] - 1, left[1])]
            top = max(options)
            table[i][j] = top if top >= (0, 0) else (0, 0)
            best = max(best, table[i][j])
    return best


def test_alignment_matches_the_plain_table():
    rnd = random.Random(4)
    for _ in range(150):
        a, b = [rnd.randrange(6) for _ in range(rnd.randrange(1, 20))], [rnd.randrange(6) for _ in range(rnd.randrange(0, 30))]
        score, matched, i, j = dc.align(np.array(a), np.array(b, np.int64))
        assert (score, matched) == brute_align(a, b)
        if score:
            back = dc.align(np.array(a[:i][::-1]), np.array(b[:j][::-1]))
            assert back[0] == score


WORDS = [f"w{i}" for i in range(400)]


def corpus(seed=1):
    rnd = random.Random(seed)
    items = [(i, " ".join(rnd.choices(WORDS, k=rnd.randrange(8, 40)))) for i in range(12)] + [(50, "tiny three words"), (51, ""), (52, None), (None, "an item that has no name at all here")]
    docs, planted = [], set()
    for d in range(60):
        words = rnd.choices(WORDS, k=rnd.randrange(20, 200))
        if d % 3 == 0:
            k = rnd.randrange(12)
            passage = items[k][1].split()
            if d % 2:  # edited: every ninth word, from the third on, is another one
                passage = [w if i % 9 != 2 else "changed" for i, w in enumerate(passage)]
            if d % 5 == 0:
                passage = [w.upper() + "," for w in passage]
            at = rnd.randrange(len(words))
            words[at:at] = passage
            if not d % 2 or len(passage) >= 9:
                planted.add((d, k))
        docs.append((d, " ".join(words), "x"))
    docs += [(100, "some Tiny, three; WORDS here", "x"), (101, None, "x"), (102, "", "x"), (None, items[0][1], "x"), (103, items[1][1], "x"), (103, items[1][1], "x")]
    planted |= {(100, 50), (None, 0), (103, 1)}
    return items, docs, planted


def brute_leaks(items, docs):
    out = set()
    for d, text, _ in docs:
        words = dc.plain_words(text)
        for k, item in items:
            want = dc.plain_words(item)
            n = min(5, len(want))
            grams = lambda t: {tuple(t[i : i + n]) for i in range(len(t) - n + 1)}  # noqa: B023, E731
            if want and grams(want) & grams(words) and brute_align(want, words)[1] >= 0.8 * len(want):
                out.add((d, k))
    return out


@pytest.mark.parametrize("block", [500_000, 60])
def test_leaks_match_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK_WORDS", block)
    items, docs, planted = corpus()
    got = dc.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string, item_id string").select("doc_id", "text"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks(items, docs) >= planted
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    by_id = {d: dc.plain_words(t) for d, t, _ in docs}
    names = {i: dc.plain_words(t) for i, t in items}
    for r in got:
        span = by_id[r.doc_id][r.start_word : r.end_word]
        assert len(set(span) & set(names[r.item_id])) >= 0.8 * len(set(names[r.item_id])) - 1 and r.item_words == len(names[r.item_id])


def test_stage_drops_only_leaks(spark):
    items, docs, _ = corpus(2)
    table = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    out = dc.clean_documents(table, spark.createDataFrame(items, "item_id bigint, text string"))
    bad = {d for d, _ in brute_leaks(items, docs)}
    assert out.columns == table.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(d for d, _, _ in docs if d not in bad)


def test_equally_edited_copies_are_found_however_many(spark):
    """Four words of 40 are changed in all of 150 copies, so the n-grams that survive are the frequent ones; single whole copies make none of the rest look absent."""
    item = [f"i{k}" for k in range(40)]
    copy = [w if i not in (6, 13, 20, 27) else f"other{i}" for i, w in enumerate(item)]
    docs = [(d, " ".join([f"a{d}", f"b{d}", *(copy if d < 150 else item if d == 150 else item[:7]), f"c{d}"])) for d in range(300)]
    items = [(1, " ".join(item))]
    got = dc.find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.matched_words, r.start_word, r.end_word) for r in got} == {(d, 36 if d < 150 else 40, 2, 42) for d in range(151)}


def test_a_copy_with_words_put_in_is_found_beside_stray_n_grams(spark):
    """The copy starts in one stretch of begins and ends in another, which a stray n-gram before it shifts."""
    item = [f"i{k}" for k in range(40)]
    text = [*item[25:30], *["x"] * 20, *item[:20], *["y"] * 30, *item[20:]]
    docs = [(1, " ".join(text), "")]
    got = dc.find_leaks(spark.createDataFrame([docs[0][:2]], "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute_leaks([(1, " ".join(item))], docs) == {(1, 1)}


def test_empty_tables(spark, odd, no_documents):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert dc.find_leaks(odd.select("doc_id", "text"), none).count() == 0
    some = spark.createDataFrame([(1, "the cat sat on the mat again")], "item_id bigint, text string")
    assert dc.find_leaks(no_documents.select("doc_id", "text"), some).count() == 0
    assert {r.doc_id for r in dc.find_leaks(odd.select("doc_id", "text"), some).collect()} == {1, 2}
