import io
import zlib

import numpy as np
import pytest

from siftloom.llm import id_coder, token_files
from helpers import EDGE, docs, prose

P = pytest.importorskip("public_tokenizers")
PATH = P.path("byte_bpe_50k.json")

TEXTS = ["", " ", "a×b÷c ªº ²³ x̀", "ǅ Ɐ ß’s İi \x00 \x7f ~", "  ", "a", " a", "a b", "a  b", "a   b  ", " \n", "a \nb", "a\n b", "a \n b", "a\n\n  b\t c ", "x\x1cy z\x85 w  v", "don't I'll  we're", "<|endoftext|> b <|endoftext|>", "a <|endoftext|> b", "a  <|endoftext|>x", "é\U0001f600 \U0001f600é 123 4,5", "tab\t x", "end\n", "　a 　 b", "a  b", "\r\n x"]


def library(texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]


def test_words_encode_like_the_library():
    texts = TEXTS + prose(4, 60) + ["  ".join(prose(5, 5)), "\n".join(prose(6, 40))]
    t = token_files.WordTokenizer(PATH)
    assert [np.frombuffer(x, t.dtype).tolist() for x in t.encode(texts)] == library(texts)


@pytest.mark.parametrize("kind", ["none", "one", "same", "rising", "random", "words", "blocks"])
def test_coder_round_trip(kind, monkeypatch):
    monkeypatch.setattr(id_coder, "BLOCK", 256)
    r = np.random.default_rng(1)
    ids = {"none": [], "one": [7], "same": [50256] * 1000, "rising": range(2000), "random": r.integers(0, 50257, 3000), "words": r.zipf(1.3, 5000) % 900, "blocks": [3] * 512}[kind]
    ids = np.array(ids, dtype=np.int64)
    coded = id_coder.encode_blocks(ids, 50257)
    import struct

    blocks = [(*struct.unpack("<III", b[:12])[::2], b[12:]) for b in coded]
    assert np.concatenate(id_coder.decode_blocks(blocks, 50257)).tolist() == ids.tolist()
    if kind == "same":
        assert sum(map(len, coded)) < 200
    if kind == "blocks":  # each is decodable alone, and damage is found
        assert id_coder.decode_blocks(blocks[1:2], 50257)[0].tolist() == [3] * 256
        n, crc, body = blocks[0]
        with pytest.raises(ValueError):
            id_coder.decode_blocks([(n, crc ^ 1, body)], 50257)


def test_file_round_trip(monkeypatch):
    monkeypatch.setattr(id_coder, "BLOCK", 64)
    monkeypatch.setattr(id_coder, "LANES", 4)
    r = np.random.default_rng(2)
    rows = [(d, r.integers(0, 300, n).astype("<u2")) for d, n in [(None, 1), (3, 0), (3, 700), (9, 255), (10, 1), (11, 256), (2**60, 40)]]
    out = io.BytesIO()
    assert token_files.write_file(out, rows, 300) == (7, 1253)
    got = list(token_files.read_file(io.BytesIO(out.getvalue())))
    assert [(d, x.tolist()) for d, x in got] == [(d, x.tolist()) for d, x in rows]
    with pytest.raises(ValueError):
        list(token_files.read_file(io.BytesIO(out.getvalue()[:-3])))
    empty = io.BytesIO()
    token_files.write_file(empty, [], 300)
    assert list(token_files.read_file(io.BytesIO(empty.getvalue()))) == []


def test_documents(spark):
    rows = EDGE + [(500 - i, t) for i, t in enumerate(TEXTS + prose(7, 30))]
    got = token_files.token_files(docs(spark, rows), PATH).collect()
    want = sorted(((i, x + [0]) for (i, _), x in zip(rows, library([t or "" for _, t in rows]))), key=lambda r: (r[0] is not None, r[0] or 0))
    got.sort(key=lambda r: r.start)
    assert sorted((r.doc_id, r.ids) for r in got if r.doc_id is not None) == sorted((d, x) for d, x in want if d is not None)
    assert [r.doc_id for r in got] == [d for d, _ in want]
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens


def test_empty_table(spark):
    assert token_files.token_files(docs(spark, []), PATH).count() == 0
