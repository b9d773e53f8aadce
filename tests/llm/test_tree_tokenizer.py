import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from morbiscope.llm import tree_tokenizer as T

ODD = ["", " ", "   ", "\n\n a", "don't we'll 's", "<|endoftext|>", "é" * 50, "ก" * 3000, "x" * 5000, "a  b\t\tc \n", "\x85\x1c​", "😀 👩‍👩‍👧 test", " 　 ", "'", "''s"]


@pytest.fixture(scope="module")
def direct():
    return T.tokenizer().core.encode_ordinary


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list(" \n\t'sltdevrmaéก1２😀., \x1c")), max_size=300), st.integers(1, 40))
def test_tree_equals_direct(text, leaf):
    tok = T.tokenizer()
    small = object.__new__(T.TreeTokenizer)
    small.core, small.leaf, small.pieces = tok.core, leaf, tok.pieces
    ids = small.encode(text)
    assert ids == tok.core.encode_ordinary(text) and small.decode(ids) == text


def test_other_library_agrees():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{T.TOKENIZER_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in ODD:
        assert T.tokenizer().encode(text) == t.encode(text, add_special_tokens=False).ids


def test_frame(spark, direct):
    rows = [(i, t, 7) for i, t in enumerate([*ODD, None, "word " * 40000])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int")
    out = {r.doc_id: list(r.ids) for r in T.encode_documents(df).collect()}
    assert out == {i: direct(t) if t else [] for i, t, _ in rows}
    back = {r.doc_id: r.text for r in T.decode_documents(T.encode_documents(df)).collect()}
    assert back == {i: t or "" for i, t, _ in rows}
    assert T.encode_documents(df.limit(0)).count() == 0
