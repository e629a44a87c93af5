import hashlib
import random
import re

import pytest

from oddsmill.llm import fill_in_middle as fim
from oddsmill.llm.tables import keyed_text


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    a, b, c = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, sha(text), sha(text)
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<S>{c}<P>{a}<M>{b}" if form == "spm" else f"<P>{a}<S>{c}<M>{b}"
    return doc_id, len(units), form, len(a), len(b), sha(out), sha(text)


def digests(docs):
    rows = fim.restore_documents(fim.transform_documents(keyed_text(docs)))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


def test_odd_documents_match_plain_python(spark, odd):
    rows = sorted(map(tuple, digests(odd).collect()), key=str)
    assert rows == sorted((brute(r.doc_id, r.text) for r in odd.collect()), key=str)


def test_every_form_and_near_sentinels_match_plain_python(spark, monkeypatch):
    pieces = ["<P>", "<S>", "<M>", "<", ">", "<P", "S>", "<<", "é", "日本", "a", "word", " ", "\n", "\x00", "\U0001f600"]
    rng = random.Random(7)
    rows = [(i, "".join(rng.choices(pieces[rng.choice([0, 3, 5]) :], k=rng.randrange(30)))) for i in range(600)]
    found = digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert sorted(map(tuple, found)) == sorted(brute(*r) for r in rows)


@pytest.mark.parametrize("chunk", [1, 3, 64])
def test_chunks_change_nothing(monkeypatch, chunk):
    text = ("Aé日 bcd\U0001f600EF, gh" * 9).encode()
    want = [fim.transformed(text, i, "1") for i in range(20)]
    monkeypatch.setattr(fim, "CHUNK", chunk)
    assert [(t.pieces, row) for t, row in want] == [(t.pieces, row) for t, row in (fim.transformed(text, i, "1") for i in range(20))]


def test_pieces_are_descriptors_of_the_output(spark, odd):
    marks = b"".join(fim.SENTINELS)
    texts = {r.doc_id: (r.text or "").encode() for r in odd.collect()}
    for r in fim.transform_documents(keyed_text(odd)).collect():
        buffers = (texts[r.doc_id], marks)
        assert b"".join(buffers[p.buffer][p.start : p.start + p.length] for p in r.pieces) == r.output.encode()
        assert len(r.pieces) == (1 if r.form == "plain" else 6)


def test_restored_texts_and_kept_columns(spark, odd, no_documents):
    rows = fim.restore_documents(fim.transform_documents(keyed_text(odd)))
    assert sorted(((r.doc_id, r.text) for r in rows.collect()), key=str) == sorted(((r.doc_id, r.text or "") for r in odd.collect()), key=str)
    assert digests(no_documents).count() == 0


def test_cut_and_inverse_permutation():
    table = fim.PieceTable(b"abcdef")
    table.cut(4)
    table.cut(1)
    assert [bytes(p) for p in table.stream()] == [b"a", b"bcd", b"ef"]
    table.arrange((2, 0, 1))
    assert b"".join(table.stream()) == b"<S>ef<P>a<M>bcd"
    table.restore((2, 0, 1))
    assert b"".join(table.stream()) == b"abcdef"
    with pytest.raises(ValueError):
        table.cut(7)
