import zlib

import numpy as np
import pytest

from quillspark.llm import pieces, token_store
from quillspark.llm.files import tokenizer_file as _tokenizer
from quillspark.session import new_table_path

LONG = "abc déf 日本 " * 3000
TEXTS = ["Hello  wörld 日本\n x", None, "", " ", "  a  b ", "😀x \t y▁z", LONG, LONG + "tail", "<|endoftext|> a<|startoftext|>b", "x" * 500, "Σίσυφος 'S don't\x1c q"]
ROWS = [(i, t, "q") for i, t in enumerate(TEXTS)] + [(None, "null id", "q"), (6, LONG, "q")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, keys string").repartition(3)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_store_round_trip(spark, docs, name):
    """The second file keeps case and white space, so its words can't be told apart."""
    from tokenizers import Tokenizer

    file = _tokenizer(name)
    assert token_store.is_separable(file) == (name == "word_bpe_49k.json")
    path = new_table_path(spark, "test")
    token_store.write_store(docs, path, file)
    got = {r.start: r for r in token_store.read_store(spark, path, file).collect()}
    ids = {r.start: np.frombuffer(bytes(r.ids), "<u2") for r in token_store.documents_ids(spark, path).collect()}
    t, at = Tokenizer.from_file(file), 0
    for doc_id, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0])):
        want = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        r = got[at]
        assert (r.id, r.n_tokens, r.ids_crc32) == (doc_id, len(want), zlib.crc32(want.tobytes()))
        assert (ids[at] == want).all()
        at += len(want)
    assert spark.read.parquet(f"{path}/chunks").count() < sum(r.n_chunks for r in got.values())


def test_chunks_follow_the_content():
    ids = np.random.default_rng(1).integers(0, 49_000, 5000).astype("<u2")
    whole = token_store.cuts(len(ids), token_store.marks(ids).tolist())
    assert whole[-1] == 5000 and all(b - a <= token_store.MOST_IDS for a, b in zip([0, *whole], whole)) and 8 < len(whole) < 40
    later = token_store.marks(np.concatenate([ids[:77], ids])) - 77
    assert token_store.cuts(len(ids), [m for m in later.tolist() if m > 0]) == whole
    assert token_store.cuts(3, []) == [3] and token_store.cuts(5000, []) == [4096, 5000]


def test_store_of_an_empty_table(spark, docs):
    path = new_table_path(spark, "test")
    token_store.write_store(docs.limit(0), path, _tokenizer("word_bpe_49k.json"))
    assert token_store.read_store(spark, path, _tokenizer("word_bpe_49k.json")).count() == 0


def test_whole_query_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    from quillspark.llm.queries import op8_token_store

    sf, t = "/root/testdata/sf0.001", Tokenizer.from_file(_tokenizer("word_bpe_49k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got, at = {r.doc_id: r for r in op8_token_store(spark, sf).collect()}, 0
    for i in sorted(texts):
        want = np.array([*t.encode(texts[i], add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)


def test_words_give_the_tokenizers_ids():
    import pyarrow as pa
    from hypothesis import given, settings, strategies as st
    from tokenizers import Tokenizer

    from quillspark.llm.texts import utf8

    file = _tokenizer("word_bpe_49k.json")
    whole, (cache, width) = Tokenizer.from_file(file), token_store._encoder(file)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text(alphabet="aBcé 'sT.,<|>1\n\u0301ΣSK", max_size=30), min_size=1, max_size=4))
    def check(texts):
        data, offsets = utf8(pa.array(texts))
        ids, bounds = token_store.encode_rows(data, offsets, 0, len(texts), cache, np.dtype(f"<u{width}"), 2)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]

    check()


def test_signs_behind_words_are_words_of_their_own():
    """A word is then remembered once, whatever follows it; ids are the tokenizer's."""
    import pyarrow as pa
    from hypothesis import given, settings, strategies as st

    from quillspark.llm.texts import Slice, utf8

    data, offsets = utf8(pa.array(["hello&&& hello!! x !! a<|> dé** b" + 10 * "#", "<|endoftext|>'' 's'"]))
    s = Slice(data, offsets, 0, 2)
    w = token_store._words(s)
    pieces_ = [data[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)]
    assert pieces_ == ["hello", "&&&", "hello", "!!", "x", "!!", "a<|>", "dé**", "b" + 10 * "#", "<|endoftext|>''", "'s", "'"] and w.per_row.tolist() == [9, 3]
    file = _tokenizer("word_bpe_49k.json")
    whole, (cache, width) = token_store._tokenizer(file), token_store._encoder(file)

    @settings(max_examples=200, deadline=None)
    @given(st.lists(st.text(alphabet="abé s't!&#$%*_-~`\\\"()<|>1 \n\u0301Σ", max_size=30), min_size=1, max_size=4))
    def check(texts):
        data, offsets = utf8(pa.array(texts))
        ids, bounds = token_store.encode_rows(data, offsets, 0, len(texts), cache, np.dtype(f"<u{width}"), 2)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]

    check()


def test_a_full_word_table_keeps_what_is_asked_for_again():
    from quillspark.llm.wordcache import WordTable

    asked = []

    def encode(words):
        asked.extend(words)
        return np.frombuffer(b"".join(words), np.uint8).astype("<u2"), np.array(list(map(len, words)))

    def look(table, words, hashes=None):
        data, sizes = np.frombuffer(b"".join(words), np.uint8), np.array(list(map(len, words)), np.int64)
        ends = np.cumsum(sizes)
        hashes = np.array([zlib.crc32(w) for w in words] if hashes is None else hashes, np.uint64)
        flat, begins, counts = table.of(data, ends - sizes, ends, hashes)
        assert [bytes(flat[a : a + n].astype(np.uint8)) for a, n in zip(begins, counts)] == words
        assert len(table) <= table.most
        new = asked[:]
        asked.clear()
        return new

    table, often = WordTable(encode, np.dtype("<u2"), 10, 8), [b"the", b"and"]
    assert look(table, often) == often and look(table, often) == []
    for i in range(30):  # words seen once: they never drive out the others
        once = [b"w%d" % (3 * i + k) for k in range(3)]
        assert look(table, often[:1] + once + often[1:]) == once
    assert look(table, [b"x" * 9]) == look(table, [b"x" * 9]) == [b"x" * 9]
    many = [b"m%d" % i for i in range(25)]  # more at once than there is room for
    assert look(table, many) == many and look(table, many[:10]) == []
    assert look(table, [b"one"], [7]) == [b"one"] and look(table, [b"two"], [7]) == [b"two"]  # a hash alone makes no word


def best_score(model, text):
    score = {p: s for (p, _, kind), s in zip(pieces.read_pieces(_tokenizer("piece_bpe_32k.model")), model.scores.tolist()) if kind in (1, 4)}
    text = "▁" + text.replace(" ", "▁")
    best = [0.0] + [-np.inf] * len(text)
    for i in range(len(text)):
        if text[i] not in score:
            best[i + 1] = max(best[i + 1], best[i] + model.unknown_score)
        for j in range(i + 1, min(len(text), i + 16) + 1):
            if text[i:j] in score:
                best[j] = max(best[j], best[i] + score[text[i:j]])
    return best[-1]


def own_score(model, known, ids):
    """Sum of a path's log scores: a character without a piece counts once, however many bytes it has."""
    own, at = 0.0, 0
    while at < len(ids):
        piece, _, kind = known[ids[at]]
        if kind == pieces.BYTE:
            lead = int(piece[1:-1], 16)
            own, at = own + model.unknown_score, at + (1 if lead < 128 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
        else:
            own, at = own + model.scores[ids[at]], at + 1
    return own


def test_pieces_are_a_best_path_and_decode_back(spark, docs):
    file = _tokenizer("piece_bpe_32k.model")
    model = pieces.PieceModel.load(file)
    known = pieces.read_pieces(file)
    encoded = pieces.encode_pieces(docs, file)
    for r in pieces.decode_pieces(encoded, file).collect():
        text = "null id" if r.doc_id is None else TEXTS[r.doc_id]
        assert r.text == (None if text is None else text.replace("▁", " "))
    for r in encoded.where("doc_id in (0, 4, 8, 9, 10)").collect():
        assert own_score(model, known, r.pieces) == pytest.approx(best_score(model, TEXTS[r.doc_id]), abs=1e-3)
    assert pieces.encode_pieces(docs.limit(0), file).count() == 0


def test_whole_query_takes_best_paths(spark):
    from quillspark.llm.queries import op10_pieces

    sf, file = "/root/testdata/sf0.001", _tokenizer("piece_bpe_32k.model")
    model, known = pieces.PieceModel.load(file), pieces.read_pieces(file)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op10_pieces(spark, sf).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        assert got[i].round_trip and got[i].n_pieces == len(model.encode(text))
        if len(text) < 600:
            assert own_score(model, known, model.encode(text)) == pytest.approx(best_score(model, text), abs=1e-3)


def test_ranks_become_log_probabilities():
    got = pieces.log_scores(np.array([-1.0, -3.0, -2.0, -1e9]))
    assert np.exp(got).sum() == pytest.approx(1) and (np.diff(got[[0, 2, 1, 3]]) < 0).all()
    assert (pieces.log_scores(np.array([-1.5, -2.25])) == [-1.5, -2.25]).all()


def test_long_and_short_stretches_agree():
    model = pieces.PieceModel.load(_tokenizer("piece_bpe_32k.model"))
    for word in ("the", "internationalization", "ünï日x", "a" * 40):
        path = model._one_path([model.codes.get(c, 0) for c in "▁" + word])
        assert model._ids("▁" + word, *path) == model.encode(word)
