import io
import random

import numpy as np
import public_tokenizers
import pytest

from corvane.llm import pieces, token_counts, token_files
from corvane.llm.common import Memo, scratch

WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "B", "é", "É", "é", "  ", " ", "\n", "\t", "\x1c", "'s", "'LL", "1", "23", "<|endoftext|>", "<|", "&&", "▁", "ß", "Σ", "ς", "日本", "\xa0", "　", "😀", "\r\n", "İ", "<s>", "the", "\x00"]


def noise(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_word_ids_equal_the_library():
    coder = token_files.WordEncoder(WORDS, pieces=50, words=50)
    texts = noise(3000) + ["word " * 50_000, "x" * 20_000]
    want = [np.asarray(e.ids, "<u4").tobytes() for e in coder.full.encode_batch(texts, add_special_tokens=False)]
    for at in range(0, len(texts), 100):
        assert coder.encode(texts[at : at + 100]) == want[at : at + 100]


def test_frames_are_read_one_by_one():
    sink = io.BytesIO()
    writer = token_files.FrameWriter(sink)
    data = {i * 3: np.arange(i, dtype="<u4") for i in range(40)}
    for k, v in data.items():
        writer.add(k, v.tobytes())
    writer.close()
    source = io.BytesIO(sink.getvalue())
    reader = token_files.FrameReader(source)
    assert reader.document(30).tolist() == list(range(10))
    with pytest.raises(KeyError):
        reader.document(31)
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.getvalue()), read_across_frames=True).read()
    assert whole == b"".join(v.tobytes() for v in data.values())
    # Damage to one frame is seen there and nowhere else.
    raw = bytearray(sink.getvalue())
    raw[int(reader.starts[10]) + 12] ^= 0xFF
    broken = token_files.FrameReader(io.BytesIO(bytes(raw)))
    with pytest.raises(Exception):
        broken.frame(10)
    assert broken.frame(11) == data[33].tobytes()


def test_token_files_round_trip(spark, docs_of):
    rows = [(5, "five words are in here"), (None, "no id"), (2, None), (2, "two"), (9, ""), (7, "long " * 5000)]
    out = scratch(spark, "t")
    files = token_files.write_token_files(docs_of(rows, "1 as start"), out, WORDS)
    got = token_files.read_token_files(spark, files).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 2, 2, 5, 7, 9]
    coder = token_files.WordEncoder(WORDS)
    want = [np.frombuffer(x, "<u4").tolist() + [2] for x in coder.encode(["no id", "", "two", "five words are in here", "long " * 5000, ""])]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == want
    assert [r.start for r in got] == np.cumsum([0] + [len(w) for w in want])[:-1].tolist()
    empty = docs_of([(1, "x")]).where("false")
    files = token_files.write_token_files(empty, scratch(spark, "t"), WORDS)
    assert files == [] and token_files.read_token_files(spark, files).count() == 0


def test_counts_equal_the_library():
    counter = token_counts.Counter(PIECES, limit=200)
    texts = noise(4000, 2) + ["  lead", "trail  ", " ", "\n", "a\n\n b", "word " * 30_000]
    want = [len(x) for x in counter.sp.encode(texts)]
    got = []
    for at in range(0, len(texts), 50):
        got += counter.count(texts[at : at + 50])
    assert got == want
    assert len(counter.whole) > 10_000


def test_other_tokenizers_get_whole_texts():
    """A tokenizer with other cuts is encoded as the library does, not by the cuts of the first one."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    coder, texts = token_files.WordEncoder(path), noise(200, 8) + ["Plain Words, with Capitals  and spaces\n"]
    want = Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)
    assert not coder.known and token_files.WordEncoder(WORDS).known
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [e.ids for e in want]


def test_proof():
    """The proof holds for one file: its settings are read, and another file's checksum is refused."""
    data = open(PIECES, "rb").read()
    assert token_counts.normalizer(data)[1] == b"identity" and token_counts.normalizer(data)[4] == 0
    proof = token_counts.prove(PIECES)
    with pytest.raises(ValueError):
        token_counts.Counter(PIECES, token_counts.Proof(proof.checksum + 1, proof.whole))


def test_proof_refuses_other_settings(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    for name, value in (("remove_extra_whitespaces", True), ("name", "nmt_nfkc"), ("add_dummy_prefix", False)):
        proto = pb.ModelProto()
        proto.ParseFromString(open(PIECES, "rb").read())
        setattr(proto.normalizer_spec, name, value)
        (tmp_path / name).write_bytes(proto.SerializeToString())
        with pytest.raises(ValueError):
            token_counts.prove(str(tmp_path / name))


def test_counts_table(docs_of):
    got = token_counts.count_tokens(docs_of([(1, None), (2, "a é"), (2, "a é"), (None, "x")], "7 as n_tokens"), PIECES, limit=2).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_bytes, r.over_limit) for r in got] == [(None, 1, False), (1, 0, False), (2, 4, False), (2, 4, False)]
    assert got[1].n_tokens == 0
    assert token_counts.count_tokens(docs_of([(1, "x")]).where("false"), PIECES).count() == 0


@pytest.fixture(scope="module")
def unigram():
    """The library itself, with the same pieces and scores as a unigram model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    coder = pieces.Pieces(PIECES)
    proto = pb.ModelProto()
    proto.ParseFromString(open(PIECES, "rb").read())
    proto.trainer_spec.model_type = 1
    for i, p in enumerate(proto.pieces):
        if i in coder.score_of:
            p.score = coder.score_of[i]
    return coder, sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def test_viterbi_equals_the_library(unigram):
    coder, library = unigram
    texts = noise(1500, 3) + ["internationalisation of tokenisers", "Thndorable theaanes; 'quoted' 12345", "x" * 300]
    got = [np.frombuffer(x, "<i4").tolist() for x in coder.encode(texts)]
    want = library.encode(texts)
    score = lambda ids: sum(coder.score_of.get(i, 0.0) for i in ids)
    for t, a, b in zip(texts, got, want, strict=True):
        assert a == b or abs(score(a) - score(b)) < 1e-3, t


def test_pieces_round_trip(docs_of, spark):
    coder = pieces.Pieces(PIECES, limit=300)
    texts = [t.replace("▁", "") for t in noise(1500, 4)] + ["", " ", "\n", "日本語 " * 1000]
    assert coder.decode(coder.encode(texts)) == texts
    table = pieces.encode_documents(docs_of([(1, "round trip"), (None, None), (1, "round trip"), (3, "a▁b")], "3 as ids"))
    got = table.orderBy("doc_id").collect()
    assert all(r.restored and r.n_tokens == len(r.ids) and r.exact == (r.doc_id != 3) for r in got)
    assert pieces.decode_documents(table, PIECES).where("doc_id = 3").first().text == "a b"
    assert pieces.encode_documents(docs_of([(1, "x")]).where("false")).count() == 0


def test_memos_of_other_uses_are_emptied():
    a, b, c = (Memo(lambda keys: [k * 2 for k in keys], 4, use) for use in ("one", "one", "two"))
    a.fill([1, 2])
    b.fill([3])
    assert a == {1: 2, 2: 4} and b == {3: 6}
    a.fill([5, 6, 7, 1])
    assert a == {5: 10, 6: 12, 7: 14, 1: 2}  # above the limit only those at hand
    c.fill([1])
    assert c == {1: 2} and not a and not b
