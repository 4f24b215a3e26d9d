import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from tarnish.llm import bpe, queries

RANKS = bpe.read_ranks(queries.RANKS)
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
ENCODER = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
DECODER = bpe.Decoder(RANKS)


def same(text):
    ids = ENCODER.encode(text)
    assert ids == " ".join(map(str, LIBRARY.encode_ordinary(text)))
    assert DECODER.decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["", "a", "Hello world, it's 2024!", "  \n\n\t x", "日本語テキスト 한국어 😀😀", "é" * 200, "a" * 5000, "ab" * 3000,
                                  "\x1c\x85 ", "<|endoftext|>", "0123456789" * 50, "=" * 999, "а́‍"])
def test_like_the_library(text):
    same(text)


@given(st.text(max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text(text):
    same(text)


@given(st.text(alphabet="etaoin shrdlu'ETA.,01-\né", max_size=200))
@settings(max_examples=300, deadline=None)
def test_wordlike_text(text):
    same(text)


def test_multilingual_ranks():
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("multi", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = bpe.Encoder(ranks, public_tokenizers.PATTERN)
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzäöüßñçабвгд中文字 .,\n", k=rng.randint(1, 120)))
        assert encoder.encode(text) == " ".join(map(str, library.encode_ordinary(text)))


def test_machine_is_rebuilt_when_full(monkeypatch):
    monkeypatch.setattr(bpe, "MOVES", 50)
    monkeypatch.setattr(bpe, "PIECES", 10)
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choices("abcdefghij klm", k=80))
        assert encoder.encode(text) == " ".join(map(str, LIBRARY.encode_ordinary(text)))


def test_lookahead_is_bounded():
    machine = bpe.Transducer(RANKS)
    longest = max(map(len, RANKS))
    machine.encode(("the quick brown fox " * 40).replace(" ", "").encode())
    assert all(len(begun) <= longest and sum(1 for _ in held) <= longest for s in machine.states for _, begun, held in s)


def test_streaming_decoder_yields_whole_characters():
    ids = ENCODER.encode("héé 😀日本 x").split(" ")
    for chunk in DECODER.stream(iter(ids)):
        chunk.decode()
    broken = [str(RANKS[bytes([b])]) for b in (0xE6, 0x97, 0x41, 0xF0, 0x9F)]
    assert b"".join(DECODER.stream(iter(broken))) == bytes([0xE6, 0x97, 0x41, 0xF0, 0x9F])


def test_query(spark, folder):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = queries.op1_bpe(spark, folder).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_edge_rows(spark):
    rows = [(1, None, "a", 1), (None, "", "b", 2), (2, "x y", None, None), (2, "x y", None, None), (3, "lo ng " * 300000, "", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, IDS string, B_TEXT int")
    out = bpe.encode(docs, queries.RANKS, public_tokenizers.PATTERN)
    back = bpe.decode(out, queries.RANKS)
    assert out.columns == ["doc_id", "B_TEXT", "ids", "n_tokens"] and back.columns[-1] == "decoded"
    got = {(r.doc_id, r.B_TEXT): (r.n_tokens, bytes(r.decoded).decode()) for r in back.collect()}
    assert got[1, 1] == (0, "") and got[None, 2] == (0, "") and got[2, None] == (2, "x y") and got[3, 0][1] == "lo ng " * 300000
    assert bpe.encode(docs.limit(0), queries.RANKS, public_tokenizers.PATTERN).count() == 0


def test_no_collector_runs_over_what_a_worker_remembers():
    import gc

    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"text": ["a b", None]})
    found = bpe._encode(iter([rows]), queries.RANKS, public_tokenizers.PATTERN, "text", [])
    assert gc.isenabled() and next(found).num_rows == 2 and not gc.isenabled()
    assert list(found) == [] and gc.isenabled()


def test_a_full_machine_lets_go_of_its_rows(monkeypatch):
    machine = bpe.Transducer(RANKS)
    machine.encode(b"a" * 4000)
    old = list(machine.rows.values())
    monkeypatch.setattr(bpe, "MOVES", 0)
    machine.encode(b"xqzj" * 9)
    assert not any(old)


def test_the_last_byte_of_a_piece_makes_no_row():
    machine = bpe.Transducer(RANKS)
    assert machine.encode(b"qzx") == LIBRARY.encode_ordinary("qzx")
    assert [states for states in machine.states if len(states) > 1] and len(machine.rows) == 3
    rows = len(machine.rows)
    for last in range(256):
        piece = b"qz" + bytes([last])
        assert b"".join(machine.tokens[rank] for rank in machine.encode(piece)) == piece
    assert len(machine.rows) == rows
    assert machine.encode(b"qzxqzx") == LIBRARY.encode_ordinary("qzxqzx") and machine.encode(b"qzx") == LIBRARY.encode_ordinary("qzx")


def test_ends_count_towards_a_full_machine(monkeypatch):
    machine = bpe.Transducer(RANKS)
    machine.encode(b"qzx")
    made = machine.made
    machine.encode(b"qzv")
    assert made < machine.made < made + 1
    monkeypatch.setattr(bpe, "MOVES", made)
    machine.encode(b"qzw")
    assert machine.made <= made and len(machine.rows) == 3


def test_frequent_pieces_outlive_a_full_memory(monkeypatch):
    monkeypatch.setattr(bpe, "PIECES", 40 * (bpe.ENTRY + 20))
    encoder, made = bpe.Encoder(RANKS, public_tokenizers.PATTERN), []
    encode = encoder.known.transducer.encode
    monkeypatch.setattr(encoder.known.transducer, "encode", lambda piece: made.append(piece) or encode(piece))
    for i in range(400):
        text = f"frequent x{i}qz"
        assert encoder.encode(text) == " ".join(map(str, LIBRARY.encode_ordinary(text)))
        assert len(encoder.known) + len(encoder.known.older) <= 42
    assert made.count(b"frequent") == 1


def test_an_id_without_a_token_raises():
    for ids in ("5 999999", f"{RANKS[bytes([0xE6])]} 999999"):
        with pytest.raises(KeyError):
            DECODER.decode(ids)
