"""op1 and op6 against the libraries, and the parts they stand on."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from acreflow.llm import bpe, transducer

RANKS = P.path("byte_bpe_50k.tiktoken")


def texts(n=400, seed=3):
    r = random.Random(seed)
    letters = " \n\t'strevldm abcABC019é漢!#.,- \x1c\x85　\U0001f600"
    own = ["", "a" * 3000, "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "it's they'll 's ''re 'd", " \n\n x  ", "\x00\xff", "no\r\nway\x0b\x0c"]
    return own + ["".join(r.choice(letters) for _ in range(r.randint(0, 90))) for _ in range(n)]


def test_perfect_hash_is_minimal_and_finds_every_key():
    keys = [f"k{i}".encode() for i in range(5000)]
    h = bpe.PerfectHash(keys)
    assert sorted(h.key.tolist()) == list(range(5000))
    assert h.candidates(keys).tolist() == list(range(5000))


def test_ids_equal_the_librarys_and_round_trip():
    codec = bpe.codec_for(RANKS, P.PATTERN)
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for x in texts():
        ids = codec.encode(x)
        assert list(ids) == library.encode_ordinary(x)
        assert codec.decode(ids) == x.encode()


def test_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        bpe.BpeCodec({b"a": 0}, P.PATTERN)


def test_memo_overflow_changes_nothing():
    codec = bpe.BpeCodec(bpe.read_ranks(RANKS), P.PATTERN)
    many = texts(100)
    want = [list(codec.encode(x)) for x in many]
    codec.memo.most = 5
    codec.memo.clear()
    assert [list(codec.encode(x)) for x in many] == want


def test_operator_on_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, None, "a", "x"), (2, "", "b", "x"), (3, "hello world", "c", "x"), (3, "hello world", "c", "x"), (None, "z" * 50_000, "d", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens string")
    out = bpe.decode(bpe.encode(df, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert len(out) == 5
    by = {r.doc_id: r for r in out}
    assert by[1].n_tokens == 0 and bytes(by[1].ids) == b"" and bytes(by[2].decoded) == b""
    assert bytes(by[3].decoded) == b"hello world" and bytes(by[None].decoded) == b"z" * 50_000
    assert bpe.encode(df.limit(0), RANKS, P.PATTERN).count() == 0


def test_query_digests(spark, tmp_path):
    from acreflow.llm import q_bpe

    many = texts(60)
    spark.createDataFrame(list(enumerate(many)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    for r in q_bpe.op1_byte_bpe(spark, str(tmp_path)).collect():
        ids = library.encode_ordinary(many[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(many[r.doc_id].encode()).hexdigest()


def test_counts_equal_the_librarys():
    counter = transducer.read_tokenizer(P.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    many = texts(1500, 9)
    n_bytes, n_tokens = counter.counts(many)
    assert n_tokens.tolist() == [len(e.ids) for e in library.encode_batch(many, add_special_tokens=False)]
    assert n_bytes.tolist() == [len(x.encode()) for x in many]


def test_counts_after_the_transducer_is_emptied():
    counter = transducer.read_tokenizer(P.path("byte_bpe_50k.json"))
    many = texts(200, 4)
    want = counter.counts(many)[1].tolist()
    counter._transducer.most = 10
    assert counter.counts(many)[1].tolist() == want
    assert counter.counts([])[1].tolist() == []


@pytest.mark.parametrize("chunk", [1, 3, 7, 64])
def test_chunks_compose_to_the_sequential_run(chunk):
    points = np.frombuffer(" it's  a\n\n 12 x!!'s 　 y".encode("utf-32-le"), np.uint32)
    state, want = 0, []
    for s in transducer.symbols(points):
        want.append(bool(transducer._STARTS[state * 10 + s]))
        state = transducer._TO[state * 10 + s]
    assert transducer.starts(points, chunk).tolist() == want


def test_count_operator(spark):
    df = spark.createDataFrame([(1, None), (2, "two words"), (2, "two words")], "doc_id long, text string")
    rows = sorted(tuple(r) for r in transducer.count_tokens(df, P.path("byte_bpe_50k.json")).collect())
    assert rows == [(1, 0, 0), (2, 9, 2), (2, 9, 2)]
