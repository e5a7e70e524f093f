import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tickloom.llm import piece_tokens
from tickloom.llm.piece_tokens import decode_pieces, encode_pieces, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def odd_texts(n=4000):
    rnd = random.Random(5)
    parts = ["a", "func", "incl", "unc", "prepare", "ques", "the", " ", " ", "  ", "   ", "\n", "\t", "é", "é", "́", "漢字", "ゼ", "123", "...", "\xa0", "　", "▁", "👍🏽", "ß", "‍", "\r\n", "\x00", "<s>", "</s>", "<unk>", "<0x41>", "﻿", "ing", "tion", "ll", "n", "c", "l", "i", "\U0010ffff"]
    letters = "abcdefghijklmnopqrstuvwxyz  "
    mixed = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    return mixed + ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 80))) for _ in range(n)]


@pytest.mark.parametrize("size, long", [(1 << 20, 1024), (40, 1024), (1 << 20, 3)])
def test_ids_and_texts_are_the_library_s(library, monkeypatch, size, long):
    """Whole slices, texts cut into pieces of 40 bytes, and words merged by the heap."""
    monkeypatch.setattr(piece_tokens, "SLICE", size)
    monkeypatch.setattr(piece_tokens, "LONG", long)
    model = pieces(MODEL)
    texts = [*odd_texts(), "", None, " " * 3000, "a" * 5000, "word " * 5000, "漢" * 3000, "x y" * 700, "\n" * 2500]
    for t, ids in zip(texts, model.column(pa.array(texts), model.end), strict=True):
        want = library.encode(t or "", add_eos=True)
        assert ids.tolist() == want, repr(t)
        assert model.decode(ids) == library.decode(want), repr(t)


def test_any_ids_are_decoded_as_the_library_does(library):
    rnd, model = random.Random(2), pieces(MODEL)
    for _ in range(3000):
        ids = [rnd.choice((rnd.randrange(3), rnd.randrange(3, 259), rnd.randrange(3, 259), rnd.randrange(32000), 28705, 259)) for _ in range(rnd.randint(0, 12))]
        assert model.decode(ids) == library.decode(ids), ids


def test_rows(spark, library):
    rows = [(1, "Hello  world", "x"), (1, "Hello  world", "x"), (None, "no id", "x"), (2, None, "x"), (3, "", "x"), (4, "long text ▁ " * 200_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = decode_pieces(encode_pieces(docs, MODEL), MODEL).collect()
    key = lambda i, ids, text: (str(i), hashlib.sha256(str((list(ids), text)).encode()).hexdigest())
    want = sorted(key(i, (x := library.encode(t or "", add_eos=True)), library.decode(x)) for i, t, _ in rows)
    assert sorted(key(r.doc_id, r.ids, r.decoded) for r in got) == want
    assert encode_pieces(docs.limit(0), MODEL).count() == 0
    gone = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [(r.doc_id, r.decoded) for r in decode_pieces(gone, MODEL).orderBy("doc_id").collect()] == [(1, None), (2, "")]
    assert encode_pieces(docs, MODEL, end=False).where("doc_id = 3").first().ids == []


def test_query(spark, library):
    from tickloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_eos=True)
        want.add((r.doc_id, len(ids), hexed(" ".join(map(str, ids))), hexed(library.decode(ids))))
    assert {tuple(r) for r in QUERIES["op11_sentencepiece"](spark, sf).collect()} == want
