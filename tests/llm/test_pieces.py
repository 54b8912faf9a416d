"""SentencePiece encoding and decoding against the library, with all kinds of normalisation."""

import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as proto

from sievelight.llm import pieces

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = [*"ab  c\tde\n  é½ﬁＡ㎏中☃", "\U0001f600", "¨", "　", "é", "​", "▁", "hello", "hellox", "<u>", "\x00", "�", "́", " ́", "ｶﾞ", "한"]
VARIANTS = {
    "as it is": {}, "map, squeezed": {"rule": "nmt_nfkc", "remove_extra_whitespaces": True}, "map, folded": {"rule": "nmt_nfkc_cf"},
    "squeezed, no dummy": {"remove_extra_whitespaces": True, "add_dummy_prefix": False}, "mark behind": {"suffix": True},
    "symbols": {"rule": "nfkc", "remove_extra_whitespaces": True, "symbols": ["<u>", "hellox", "a b"]}, "no bytes": {"rule": "nmt_nfkc", "bytes": False},
    "no escapes": {"escape_whitespaces": False},
}


def _model(rule=None, suffix=False, symbols=(), bytes=True, **spec):
    with open(PATH, "rb") as f:
        m = proto.ModelProto.FromString(f.read())
    if rule:
        read = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec
        m.normalizer_spec.precompiled_charsmap = proto.NormalizerSpec.FromString(read() if callable(read) else read).precompiled_charsmap
    m.trainer_spec.treat_whitespace_as_suffix = suffix
    for i, s in enumerate(symbols):
        m.pieces[31_990 + i].piece, m.pieces[31_990 + i].type = s, 4
    if not bytes:
        m.trainer_spec.byte_fallback = False
        for p in m.pieces:
            if p.type == 6:
                p.type, p.piece = 1, "zz" + p.piece
    for k, v in spec.items():
        setattr(m.normalizer_spec, k, v)
    return m.SerializeToString()


@pytest.mark.parametrize("name", VARIANTS)
def test_ids_and_spans_are_the_library_s(name, monkeypatch):
    data = _model(**VARIANTS[name])
    theirs, ours, rnd = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Pieces(data), random.Random(3)
    monkeypatch.setattr(pieces, "CHUNK_BYTES", 8)  # so that short texts are cut into chunks too
    for _ in range(400):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(25)))
        ids, starts, ends = ours.encode(text.encode())
        assert ids.tolist() == theirs.encode(text, add_bos=True, add_eos=True), ascii(text)
        spans = [(p.begin, p.end) for p in theirs.encode(text, return_type="proto").pieces]
        assert list(zip(starts.tolist(), ends.tolist(), strict=True))[1:-1] == spans, ascii(text)
        assert ours.decode(ids) == theirs.decode(ids.tolist())


def test_bytes_that_are_no_characters_keep_their_places():
    with open(PATH, "rb") as f:
        ours = pieces.Pieces(f.read())
    ids, starts, ends = ours.encode(b"ab\xff\xfe cd\xe4")
    assert ours.decode(ids) == "ab�� cd�"
    assert starts[0] == 0 and ends[-1] == 8 and np.all(starts <= ends) and np.all(np.diff(ends) >= 0)


def test_query_is_the_library_s(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    t = pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    got = {r.doc_id: r for r in pieces.op11_pieces(spark, SF).collect()}
    assert len(got) == len(t)
    for row in t:
        text = row["text"] or ""
        ids = sp.encode(text, add_bos=True, add_eos=True)
        r = got[row["doc_id"]]
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(sp.decode(ids).encode()).hexdigest() and r.covered_bytes == len(text.encode())


def test_awkward_rows(spark):
    long = "word  déjà " * 200_000
    rows = [(1, None, "x"), (2, "", "y"), (3, long, None), (None, "a b", "z"), (4, "a b", "z"), (4, "a b", "z"), (5, " " * 300_000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    start = time.time()
    got = pieces.decode(pieces.encode(docs, PATH), PATH).collect()
    assert time.time() - start < 60 and len(got) == 7
    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in got:
        text = next(t for i, t, _ in rows if i == r.doc_id) or ""
        assert r.ids == sp.encode(text, add_bos=True, add_eos=True) and r.decoded == sp.decode(r.ids) and max(r.ends) == len(text.encode())
    assert pieces.decode(pieces.encode(docs.limit(0), PATH), PATH).count() == 0
    again = pieces.decode(spark.createDataFrame([(1, None), (2, bytearray())], "doc_id long, packed binary"), PATH)
    assert [r.decoded for r in again.orderBy("doc_id").collect()] == [None, ""]
