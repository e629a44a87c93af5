import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from oddsmill.llm import chunks, perfect_hash, token_shards, trie_bpe
from oddsmill.llm.tables import keyed_text

TEXTS = [
    "", " ", "  a  b ", "The cat's on the mat.\n\n  And it'll  stay,\tthere !!", " x  y   z", "a \x85b \x1cc", "É é ß 中文 字 🙂🙂 x", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>",
    "x" * 3000, "ab" * 1200 + " " + "ab" * 1201, "½ ²3 ٣ ⅷ_a-b", "\n \n a\n b", "don't DON'T 'S 's  's", " lead", "trail ", "a\r\n  b", "the " * 500,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(trie_bpe.default_path())


def packed(ids):
    return np.array(ids, "<u4").tobytes()


def samples():
    rnd = random.Random(2)
    letters = "abcdeéñ中 \n\t.,'1½<|>  "
    return TEXTS + ["".join(rnd.choices(letters, k=rnd.randrange(1, 60))) for _ in range(1500)]


def test_trie_encodes_as_the_library_does(library):
    _, cache = trie_bpe._worker(trie_bpe.default_path())
    texts = samples()
    bpe = trie_bpe._worker(trie_bpe.default_path())[0]
    for text, got in zip(texts, cache.texts(texts)):
        ids = library.encode(text, add_special_tokens=False).ids
        assert got == packed(ids), repr(text)
        assert bpe.decode(got) == library.decode(ids, skip_special_tokens=False) == text


def test_cuts_join_again_and_full_caches_change_nothing(library, monkeypatch):
    assert all(" ".join(chunks.cut(t)) == t for t in samples())
    monkeypatch.setattr(chunks, "REMEMBERED", 3)
    monkeypatch.setattr(trie_bpe, "REMEMBERED", 3)
    bpe = trie_bpe.TrieBpe(trie_bpe.default_path())
    cache = chunks.PieceCache(bpe.pieces)
    for at in range(0, 300, 50):
        part = samples()[at : at + 50]
        assert cache.texts(part) == [packed(library.encode(t, add_special_tokens=False).ids) for t in part]


def test_words_share_the_trie(library):
    bpe = trie_bpe._worker(trie_bpe.default_path())[0]
    words = ["a", "ab", "abc", "abd", "hello", "helloworld", "help", "Ġhelp", "z" * 2000]
    found = bpe.walk(words)
    assert found == {w: packed([library.token_to_id(t) for t in library.encode(w.replace("Ġ", " "), add_special_tokens=False).tokens]) for w in words}


def test_encode_and_decode_frames(spark, odd, no_documents, library):
    rows = trie_bpe.encode_documents(keyed_text(odd), decoded=True).collect()
    texts = sorted(r.text or "" for r in odd.collect())
    assert sorted(r.decoded for r in rows) == texts
    assert sorted(bytes(r.ids) for r in rows) == sorted(packed(library.encode(t, add_special_tokens=False).ids) for t in texts)
    assert sorted(r.text for r in trie_bpe.decode_ids(trie_bpe.encode_documents(keyed_text(odd))).collect()) == texts
    assert trie_bpe.encode_documents(keyed_text(no_documents)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_perfect_hash_is_minimal_and_knows_strangers(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(-(2**62), 2**62, n))
    index = perfect_hash.PerfectHash.build(keys)
    loaded = perfect_hash.PerfectHash.load(index.parts())
    assert sorted(loaded.slots(keys).tolist()) == list(range(len(keys)))
    assert (loaded.slots(rng.integers(2**62, 2**63 - 1, 1000)) == -1).all()


@pytest.mark.parametrize("shard_ids", [1, 40, 2_000_000])
def test_shards_round_trip(spark, odd, tmp_path, library, shard_ids):
    out = str(tmp_path / "shards")
    token_shards.write_shards(keyed_text(odd), out, partitions=3, shard_ids=shard_ids)
    got = sorted(token_shards.read_shards(spark, out, with_ids=True).collect(), key=lambda r: r.start)
    docs = sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=lambda d: (d[0] is not None, d[0] or 0))
    ids = [library.encode(t, add_special_tokens=False).ids + [0] for _, t in docs]
    starts = np.cumsum([0, *map(len, ids)])
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) for r in got] == [(d[0], int(s), len(i), zlib.crc32(packed(i)), packed(i)) for d, s, i in zip(docs, starts, ids)]
    found = token_shards.lookup(spark, out, [2, 5, 4, 77, -3]).collect()
    assert sorted((r.doc_id, r.start) for r in found) == sorted((r.doc_id, r.start) for r in got if r.doc_id in (2, 4, 5))
    assert {bytes(r.ids) for r in found} == {bytes(r.ids) for r in got if r.doc_id in (2, 4, 5)}


def test_no_shards(spark, no_documents, tmp_path):
    out = str(tmp_path / "none")
    token_shards.write_shards(keyed_text(no_documents), out)
    assert token_shards.read_shards(spark, out).count() == 0
    assert token_shards.lookup(spark, out, [1]).count() == 0


def test_a_cut_is_any_space_before_a_visible_letter():
    for text in samples():
        parts = chunks.cut(text)
        assert " ".join(parts) == text
        assert len(parts) == 1 + sum(c == " " and i + 1 < len(text) and not text[i + 1].isspace() for i, c in enumerate(text))


def test_work_per_word_is_small(monkeypatch):
    """Tokens that may end a prefix are found by its last four letters; merging looks each pair up once."""
    looked = []

    class Counted(dict):
        def get(self, key, default=None):
            looked.append(key)
            return dict.get(self, key, default)

    bpe = trie_bpe._worker(trie_bpe.default_path())[0]
    word = "\u0120internationalisation"
    monkeypatch.setattr(bpe, "whole", Counted(bpe.whole))
    bpe.walk([word])
    assert len(looked) <= 5 * len(word)
    looked.clear()
    monkeypatch.setattr(bpe, "merge", Counted(bpe.merge))
    bpe.merged(word)
    assert len(looked) <= 3 * len(word)


def test_shards_send_plain_words_straight_to_the_model_and_nothing_else():
    import random
    from array import array

    from tokenizers import Tokenizer

    from oddsmill.llm import token_shards

    path = token_shards.default_path()
    tok = Tokenizer.from_file(path)
    assert token_shards.takes_plain_words(tok)
    assert token_shards.plain_words(" sé.\nAnd") == [" sé", ".", "\n", "And"] and token_shards.plain_words(" $$a") == [" $$", "a"]
    assert [p for p in ("", " ", "a\n", " a\n\nb", "a b", "it's", "a1", "<|endoftext|>", "中", "a\tb", "é") if token_shards.plain_words(p) is not None] == []
    rng = random.Random(3)
    signs = [*"abcXYZéßªµǅʰɏɐ'.,!?$%&_<|>/\\^`~", " ", " ", " ", "\n", "\t", " ", "1", "²", "中", "é", "<|endoftext|>", "'s", "\x85"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(5_000)]
    want = [array("I", e.ids).tobytes() for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert token_shards._encoder(path)[0].texts(texts) == want


def test_a_tokenizer_with_added_letters_has_no_plain_words():
    from tokenizers import AddedToken, Tokenizer

    from oddsmill.llm import token_shards

    tok = Tokenizer.from_file(token_shards.default_path())
    tok.add_tokens([AddedToken("word", normalized=False)])
    assert not token_shards.takes_plain_words(tok)
