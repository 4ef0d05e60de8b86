import public_tokenizers
import pyarrow as pa
import sentencepiece
from conftest import ODD_TEXTS  # noqa: F401  (the folder's own fixtures)
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyloom.llm.common import code_points
from tallyloom.llm.token_counts import Transducer, compiled, token_counts

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def counted(texts, chunk=1024, transducer=None):
    return (transducer or compiled(MODEL, 120_000)).count(*code_points(pa.array(texts)), chunk).tolist()


def test_equals_the_library_on_odd_texts():
    texts = ["", " ", "  ", "\n", "a" * 5000, "ab" * 3000, " " * 3000, "the" * 2000, "日本語テスト" * 300, "\x00", "▁▁ ▁", "<s> <unk> <0x0A>", "http://" + "foo.bar/" * 900, "é ﬁ ½ 😀"]
    want = [len(x) for x in LIBRARY.encode(texts)]
    for chunk in (8, 64, 1024):  # small chunks: many hard cuts inside of words
        assert counted(texts, chunk) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="thereationsg \n.,ÄÖé日▁<>0", max_size=60), min_size=1, max_size=20))
def test_equals_the_library(texts):
    assert counted(texts, 8) == [len(x) for x in LIBRARY.encode(texts)]


def test_full_state_table_starts_anew():
    small = Transducer(compiled(MODEL, 120_000).pieces, max_states=50)
    texts = ["the quick brown fox jumps over the lazy dog", "und die anderen Wörter", "encore une phrase"]
    for _ in range(3):
        assert counted(texts, 64, small) == [len(x) for x in LIBRARY.encode(texts)]


def test_table(odd_docs):
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts(odd_docs, MODEL).collect()), key=str)
    want = [(i, len((t or "").encode()), len(LIBRARY.encode(t or ""))) for i, t in ODD_TEXTS]
    assert got == sorted([(i, b, n, n > 4096) for i, b, n in want], key=str)
    assert any(r[3] for r in got)
    assert token_counts(odd_docs.limit(0), MODEL).collect() == []
