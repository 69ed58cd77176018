import base64
import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from quillspark.operators import chunking as C, tokenizers as K


@pytest.fixture(scope="module")
def files():
    return pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def ranks(files):
    return K.rank_tokens(open(files.path("byte_bpe_50k.tiktoken"), "rb").read())


def toy(*tokens):
    """Ranks of all bytes and some tokens."""
    return b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate([bytes([b]) for b in range(256)] + list(tokens)))


TEXTS = ["", " ", "hello world's end", "straße élan 日本語のテキスト 🙂🙂", "a" * 3000, "x\n\n\n  y\t z ", "don't we'll 12345 !!! ???", "́́", "ab" * 700 + "é" * 50]


@pytest.mark.parametrize("text", TEXTS)
def test_ranks_give_the_librarys_tokens(files, ranks, text):
    tiktoken = pytest.importorskip("tiktoken")
    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(files.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=files.PATTERN, mergeable_ranks=table, special_tokens={})
    ids, spans = library.encode_ordinary(text), ranks(text)
    assert len(spans) == len(ids) and "".join(text[a:b] for a, b in spans) == text
    raw, at, want = text.encode(), 0, []
    for i in ids:
        at += len(library.decode_single_token_bytes(i))
        want.append(len(raw[:at].decode("utf-8", "ignore")))
    assert [b for _, b in spans] == want


def test_merges_go_by_rank():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"bc": 256, b"abc": 301, b"cd": 302, b"aa": 400}
    assert K.merged(b"abcd", ranks) == [3, 4] and K.merged(b"abd", ranks) == [2, 3] and K.merged(b"aaa", ranks) == [2, 3] and K.merged(b"aaaa", ranks) == [2, 4] and K.merged(b"abc", ranks) == [3]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é🙂\n.", max_size=300), st.integers(4, 25), st.integers(0, 10), st.booleans())
def test_no_chunk_is_over_its_budget(text, most, overlap, bounded):
    encode = K.rank_tokens(toy(b"ab", b"aba", " é".encode(), "🙂".encode()[:3], b" a", b"b\n", b"\n\n", b"\n\na"))
    for e in (encode, K.word_tokens):
        budget = C.ChunkBudget(most, min(overlap, most - 1), "tokens")
        got = C.window_chunks(text, e, budget, bounded)
        assert all(0 < len(e(c)) <= most or not e(c) for c in got)
        body = "\n\n".join(p.strip() for p in text.split("\n\n") if p.strip())
        at = 0
        for k, c in enumerate(got):  # each chunk is an end of what came before, and the next of the body
            start = next(s for s in range(max(0, at - len(c)), at + 1) if body.startswith(c, s) and s + len(c) > at)
            assert k or start == 0
            at = start + len(c)
        assert at == len(body)


def test_windows_break_at_paragraphs_and_repeat():
    text = "one two three\n\n  four five six \n\n\n\nseven eight"
    budget = C.ChunkBudget(7, 2, "tokens")
    assert C.window_chunks(text, K.word_tokens, budget) == ["one two three\n\nfour five six\n\nseven"] * 0 + ["one two three\n\nfour five six", "five six\n\nseven eight"]
    assert C.window_chunks("", K.word_tokens, budget) == C.window_chunks(" \n\n ", K.word_tokens, budget) == []
    with pytest.raises(ValueError, match="character"):
        C.window_chunks("🙂", K.rank_tokens(toy()), C.ChunkBudget(3, 0, "tokens"))
    # Beside the overlap a character of four tokens doesn't fit: the overlap gives way.
    assert all(len(K.rank_tokens(toy())(c)) <= 5 for c in C.window_chunks("ab🙂cd", K.rank_tokens(toy()), C.ChunkBudget(5, 3, "tokens")))


def test_artifacts_are_pinned(spark, files, tmp_path):
    data = toy(b"th", b"the", b" the")
    sha = hashlib.sha256(data).hexdigest()
    name = f"ranks@{sha}"
    with pytest.raises(ValueError, match="isn't there"):
        K.tokenizer_of(name, str(tmp_path))
    (tmp_path / f"{sha}.tiktoken").write_bytes(data + b"\n")
    with pytest.raises(ValueError, match="other bytes"):
        K.tokenizer_of(name, str(tmp_path))
    (tmp_path / f"{sha}.tiktoken").write_bytes(data)
    assert len(K.tokenizer_of(name, str(tmp_path))("the the")) == 2
    for odd in ("cl", "ranks@12", f"hf@{sha.upper()}", f"other@{sha}"):
        with pytest.raises(ValueError, match="no tokenizer"):
            K.tokenizer_of(odd, str(tmp_path))
    with pytest.raises(ValueError, match="every byte"):
        K.rank_tokens(b"YQ== 0")
    budget = C.ChunkBudget(20, 5, "tokens", name)
    assert C.ChunkBudget.parse(budget.identity) == budget
    df = spark.createDataFrame([(1, "the cat and the hat " * 30), (2, None), (3, "")], "doc_id long, text string")
    got = C.chunk_text(df, "doc_id", "text", budget, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == {1} and all(len(K.rank_tokens(data)(r.chunk_text)) <= 20 for r in got)
    raw = open(files.path("byte_bpe_50k.json"), "rb").read()
    sha = hashlib.sha256(raw).hexdigest()
    (tmp_path / f"{sha}.json").write_bytes(raw)
    own = K.tokenizer_of(f"hf@{sha}", str(tmp_path))
    for bounded in (False, True):
        chunks = C.window_chunks("the cat sat on the mat. " * 40 + "日本語 🙂" * 30, own, C.ChunkBudget(16, 4), bounded)
        assert len(chunks) > 10 and all(len(own(c)) <= 16 for c in chunks)
