"""Encoding by pieces against the library itself."""

from hashlib import sha256

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from wayscope.llm import sentence_pieces
from wayscope.llm.queries import PIECES, tokenizer

MODEL = tokenizer(PIECES)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
OWN = sentence_pieces.Pieces(MODEL, most_stretches=50, most_pairs=200)  # small, so that what is kept is thrown out again and again
SEVERAL = sorted(p for p in OWN.id if len(p) > 1)


@settings(max_examples=500, deadline=None)
@given(st.text(max_size=40) | st.text(alphabet=" ▁\n\tabeinthé.,<0x>漢😀\0", max_size=40) | st.lists(st.sampled_from(SEVERAL), max_size=8).map("".join))
def test_same_ids_and_text_back(text):
    ids = OWN.encode(text)
    assert ids.tolist() == LIBRARY.encode(text)
    assert OWN.decode(ids) == LIBRARY.decode(ids.tolist()) and OWN.decimals(ids).decode() == ",".join(map(str, ids))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 300) | st.integers(0, 31999), max_size=9))
def test_decoding_any_ids(ids):
    assert OWN.decode(np.array(ids)) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["a" * 200_000, "thinger" * 30_000, " " * 5001, "\n" * 3000, "漢" * 50_000, "x y " * 600_000])
def test_long_texts(text):
    ids = OWN.encode(text)
    assert ids.tolist() == LIBRARY.encode(text) and OWN.decode(ids) == text


def test_places_that_fail_are_left_again():
    """A longest piece whose neighbours never fit is undone, however far back."""
    tried = 0
    for a, b in zip(SEVERAL[::37], SEVERAL[5::37], strict=False):
        text = (a + b)[1:] + a[:-1]
        tried += OWN.encode(text).tolist() == LIBRARY.encode(text)
    assert tried == len(list(zip(SEVERAL[::37], SEVERAL[5::37], strict=False)))


def test_tables(spark, docs, rows):
    want = {i: LIBRARY.encode(t or "") for i, t in rows}
    got = {r.doc_id: r for r in sentence_pieces.digest(docs.withColumnRenamed("digest", "ids_sha256"), MODEL).collect()}
    assert len(got) == len(rows)
    for i, ids in want.items():
        assert got[i].n_tokens == len(ids) and got[i].ids_sha256 == sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == sha256(LIBRARY.decode(ids).encode()).hexdigest()
    encoded = sentence_pieces.encode(docs, MODEL)
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    assert {r.doc_id: r.text for r in sentence_pieces.decode(encoded, MODEL).collect()} == {i: t or "" for i, t in rows}


def test_edges(spark):
    odd = spark.createDataFrame([("a", None, [5]), (None, "", None), ("a", "x", []), ("a", "x", [259, 306])], "doc_id string, text string, ids array<int>")
    assert sorted((r.doc_id or "", r.n_tokens) for r in sentence_pieces.digest(odd, MODEL).collect()) == [("", 0), ("a", 0), ("a", 1), ("a", 1)]
    assert len(sentence_pieces.decode(odd, MODEL).collect()) == 4 and sentence_pieces.digest(odd.limit(0), MODEL).count() == 0
    assert sentence_pieces.encode(odd.limit(0), MODEL).count() == sentence_pieces.decode(odd.limit(0), MODEL).count() == 0


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    with open(MODEL, "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = m.trainer_spec.UNIGRAM
    (tmp_path / "other.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError, match="not a merge-type model"):
        sentence_pieces.Pieces(str(tmp_path / "other.model"))
