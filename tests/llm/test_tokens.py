import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tickloom.llm.packing import pack, padded_length, sequences
from tickloom.llm.token_files import code, decode, read_token_files, write_token_files
from tickloom.llm.tokens import Encoder

BYTE, WORD = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def plain(path):
    t = Tokenizer.from_file(path)
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def odd_texts():
    rnd = random.Random(3)
    parts = ["a", "It's", "don't", " ", "  ", "\n", "\n\n", "\t", "é", "é", "́", "漢字", "123", "...", "\xa0", "　", "\x1c", "\x85", "<|endoftext|>", "İ", "ΟΔΟΣ", "👍🏽", "word", "ß", "‍", "\r\n", "\x0b"]
    latin = ["a", "It's", "École", "STRASSE", "ß,", "x.", "word", ",", ".", "...", "12", " ", " ", " ", "\n", "\n", "  ", "\t", "é", "ÿ", "Ā", "-", "_", "a.b", "<|endoftext|>", "µ", "ª"]
    return ["".join(rnd.choice(k) for _ in range(rnd.randint(0, 30))) for k in (parts, latin) for _ in range(3000)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_units_give_the_ids_of_the_whole_text(path):
    own, whole = Encoder(path), plain(path)
    for t in odd_texts():
        assert np.frombuffer(own.encode(t), "<u4").tolist() == whole(t), repr(t)


@pytest.mark.parametrize("size", [60, 1 << 20])
@pytest.mark.parametrize("path", [BYTE, WORD])
def test_columns_give_the_ids_of_whole_texts(path, size, monkeypatch):
    """Twice, so that the second pass reads the cache; 60 bytes cut most texts into pieces."""
    import tickloom.llm.tokens as m

    monkeypatch.setattr(m, "SLICE", size)
    own, whole, texts = Encoder(path), plain(path), [*odd_texts(), None, "", "<|endoftext|>", "a <|startoftext|> b", "word " * 500, "x" * 5000]
    for _ in range(2):
        for t, ids in zip(texts, own.column(pa.array(texts)), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == whole(t), repr(t)


def test_code_round_trip():
    rnd = np.random.default_rng(0)
    docs = [rnd.integers(0, 1 << rnd.integers(1, 32), n, dtype=np.uint32) for n in (0, 1, 2, 3, 4, 5, 1000)]
    for d in docs:
        control, data = code(d)
        assert (decode(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), len(d)) == d).all()


def table(spark):
    rows = [(i, t, "x") for i, t in enumerate(odd_texts()[2850:3150])] + [(900, None, None), (None, "null id", "x"), (5, "again", "x"), (901, "long text " * 30000, "x")]
    random.Random(1).shuffle(rows)
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    import tickloom.llm.token_files as m

    monkeypatch.setattr(m, "RANGE_BYTES", 200_000)
    monkeypatch.setattr(m, "FILE_IDS", 500)
    rows, df = table(spark)
    write_token_files(df, str(tmp_path / "t"), BYTE, 2)
    got = sorted(read_token_files(spark, str(tmp_path / "t")).collect(), key=lambda r: r.start)
    whole, at = plain(BYTE), 0
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda x: -1 if x is None else x)
    want = {}
    for d, t, _ in rows:
        want.setdefault(d, []).append(whole(t) + [2])
    for r in got:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert r.start == at and ids in want[r.doc_id] and r.n_tokens == len(ids)
        want[r.doc_id].remove(ids)
        at += r.n_tokens
    assert not any(want.values())


def test_token_files_of_nothing(spark, tmp_path):
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "t"), BYTE)
    assert read_token_files(spark, str(tmp_path / "t")).count() == 0


def test_packing_is_whole_and_gapless(spark):
    rows, df = table(spark)
    pieces = pack(df, WORD, 1, 64)
    got = pieces.collect()
    whole = plain(WORD)
    docs = {}
    for r in got:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sum(r.length for r in got) == sum(len(whole(t)) + 1 for _, t, _ in rows)
    for d, t, _ in rows:
        ids = whole(t) + [1]
        mine = sorted(docs[(d, len(ids))], key=lambda r: r.start)
        if d not in (None, 5):
            assert np.frombuffer(b"".join(r.ids for r in mine), "<u4").tolist() == ids
            assert [r.start for r in mine] == np.cumsum([0] + [r.length for r in mine])[:-1].tolist()
    at = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at.get(r.sequence_id, 0)
        at[r.sequence_id] = r.offset + r.length
    assert sorted(at) == list(range(len(at))) and all(at[k] == 64 for k in list(at)[:-1])
    seqs = sequences(pieces, 0, 64).collect()
    assert len(seqs) == len(at) and all(len(s.ids) == padded_length(s.n_tokens, 64) for s in seqs)
    assert pack(spark.createDataFrame([], "doc_id long, text string"), WORD).count() == 0
