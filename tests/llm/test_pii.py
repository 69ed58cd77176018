import re

import pytest
from hypothesis import given, settings, strategies as st

from quillspark.llm import pii
from tests.llm import brute

FULL = {
    0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    2: r"[0-9]([\x20-]?[0-9])+",
    3: r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == 1:
        return all(int(p) <= 255 for p in s.split("."))
    if kind == 2:
        return 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
    return kind == 0 or 9 <= len(digits) <= 15


def plain(text):
    return sorted((m.start(), k, m.end()) for k, p in FULL.items() for m in re.finditer(p, text) if valid(k, m[0]))


TEXTS = [
    None, "", "x@y.zz", "a@b@c.com d@e", "é x.y@mail.example.com, 1.2.3.4.5.6.7.8 999.1.1.1 0001.2.3.4", "4952935900253052 and 4952-9359-0025-3053",
    "+1 (017) 555-7713 x +49 30 1234567890123 +1", "a@b.com%x@y.z @ @@ a@b..c", "1 " * 5000, "9" * 3000, "call 555-123-4567 name [at] host [dot] org",
]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a.@+-% 0123459()é", max_size=60))
def test_base_spans_are_the_patterns_matches(text):
    assert pii.base_spans(text) == plain(text)


@pytest.mark.parametrize("text", TEXTS[1:])
def test_base_spans_of_odd_texts(text):
    assert pii.base_spans(text) == plain(text)


def test_query_digest_and_redaction(spark):
    rows = [(i, t, 7, "s") for i, t in enumerate(TEXTS)] + [(None, TEXTS[5], None, None), (5, TEXTS[5], 1, None)]
    rows += [(100 + i, f"tel +1 (01{i % 9}) 555-77{i:02d} thanks, order 20{i:02d}-11-{i:02d} 1234567 and {i}77-12 34567", 0, None) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string").repartition(3)
    model = pii.fit_pii(docs)
    assert all(0.5 <= t <= 1 for t in model.thresholds.values())
    for r in pii.pii_digest(pii.pii_spans(docs, model)).collect():
        text = (TEXTS[5] if r.doc_id is None else TEXTS[r.doc_id] if r.doc_id < 100 else rows[[x[0] for x in rows].index(r.doc_id)][1]) or ""
        assert r.base_sha256 == brute.digest(plain(text), pii.KINDS)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == j for _, k, _ in plain(text)) for j in range(4))
    out = {r.doc_id: r for r in pii.redact(docs, model, length_col="n_chars").collect()}
    assert out[2].text == "[EMAIL]" and out[2].n_chars == 7 and out[0].text is None and out[0].n_chars == 7
    assert "4952935900253052" not in out[5].text and out[1].text == ""
    assert pii.pii_spans(docs.limit(0), pii.fit_pii(docs.limit(0))).count() == 0


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("a.@+-% 0129()[]/ſıK٣é😀"), st.characters(exclude_categories=["Cs"])), max_size=60), st.sampled_from(["", "ſx [at] foo.com ", "ıd (at) x.com ", "K9[at]a.b ", "+1 415 555 0123 ", "a.b@mail.example.com "]))
def test_any_characters_are_described_and_taught(text, prefix):
    text = prefix + text
    for s, _, e in [*pii.candidates(text), *pii.base_spans(text)]:
        assert len(pii.features(text, s, e)) == len(pii.features("1", 0, 1))
    assert all(k in (4, 5) and y in (0, 1) for _, y, k in pii.examples(text))


def greedy(model, text):
    """Plain selection: base spans, then proposals by score, none of which overlaps what is there already."""
    import numpy as np

    out = [(s, k, e) for s, k, e in plain(text)]
    scored = [(-model.trees.score(np.array([pii.features(text, s, e)]))[0], (s, k, e)) for s, k, e in pii.candidates(text)]
    for z, (s, k, e) in sorted(scored):
        if -z >= model.thresholds.get(k, 2.0) and not any(a < e and s < b for a, _, b in out):
            out.append((s, k, e))
    return sorted(out)


def test_whole_query_against_plain_selection(spark):
    from quillspark.llm.queries import op7_pii

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    model = pii.fit_pii(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    got = {r.doc_id: r for r in op7_pii(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(docs)
    for d in docs:
        want = greedy(model, d.text or "") if model.trees else plain(d.text or "")
        assert got[d.doc_id].spans == ",".join(f"{pii.LABELS[k]}:{s}:{e}" for s, k, e in want)


def test_trees_learn_a_rule():
    import numpy as np

    x = np.random.default_rng(0).random((2000, 4))
    y = ((x[:, 1] > 0.5) & (x[:, 3] < 0.4)).astype(float)
    assert ((pii.BoostedTrees.fit(x, y).score(x) > 0.5) == y).mean() > 0.98


def test_forms_that_no_rule_validates_are_learnt(spark):
    # A corpus that has such spans, unverified, beside validated ones.
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    many = [(10_000 + i, f"thank you, mail name{chr(97 + i % 26)} [at] host{i % 7} [dot] org or call ({200 + i}) 555-{1000 + 7 * i} and {300 + i}-555-{2000 + 3 * i}") for i in range(300)]
    model = pii.fit_pii(docs.unionByName(spark.createDataFrame(many, "doc_id long, text string")))
    said = {
        "write to jane.doe [at] example [dot] org today": ("contact", "jane.doe [at] example [dot] org"), "mail bob(at)mail.example.com soon": ("contact", "bob(at)mail.example.com"),
        "or (555) 123-4567 by day": ("number", "(555) 123-4567"), "or 555-123-4567 by day": ("number", "555-123-4567"),
    }
    for text, want in said.items():
        assert [(pii.LABELS[k], text[s:e]) for s, k, e, _ in model.spans(text)] == [want]
    assert model.spans("He looked (at) home. Then he went.") == [] and model.spans("the row 1234567890123 of it") == []
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(many)], "doc_id long, text string")
    assert all(r.text == "thank you, mail [CONTACT] or call [NUMBER] and [NUMBER]" for r in pii.redact(docs, model).collect())


def test_copies_do_not_fill_the_sample(spark):
    rows = [(i, "the same copy of +1 (017) 555-7713 and a.b@mail.example.com") for i in range(3000)]
    rows += [(5000 + i, f"row {i} has {i * 7919 % 1000:03d} 4{i:03d}77 12345{i % 10}") for i in range(60)] + [(6000 + i, f"call +1 (2{i:02d}) 555-77{i:02d}") for i in range(40)]
    for most in (100, 400):
        model = pii.fit_pii(spark.createDataFrame(rows, "doc_id long, text string"), most_candidates=most)
        assert model.trees is not None and len(model.trees.trees) == pii.TREES
        assert abs(model.trees.start) < 1.5


def test_a_text_of_many_numbers_gives_few_candidates():
    text = " ".join(f"{i * 7919 % 999983:06d}-{i}" for i in range(20_000)) + " call +1 (2010) 555-7713"
    found = pii._few(pii.examples(text), 20)
    assert 20 < len(found) <= 40 and len({repr(x) for x in found}) == len(found) and sum(y for _, y, _ in found) > 0
    assert found == pii._few(reversed(list(pii.examples(text))), 20)


def test_every_document_teaches(spark, monkeypatch):
    # A kind that one document in a hundred has, beyond any bound on candidates; the thresholds are those of all of them.
    rows = [(i, f"row {i} has {i * 7919 % 1000:03d} 4{i:03d}77 12345{i % 10}") for i in range(1_500)] + [(6000 + i, f"call +1 (2{i:02d}) 555-77{i:02d}") for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    seen = []
    monkeypatch.setattr(pii.BoostedTrees, "grow", classmethod(lambda cls, edges, rate, counted: seen.append(counted(cls([], 0.0), pii.np.full(7, -1), pii.np.zeros(7, int), 0)) or cls([], 0.0)))
    pii.fit_pii(df)
    want = {(tuple(x), y, k, held) for _, t in rows for held in [pii.zlib.crc32(t.encode()) % 4 == 0] for x, y, k in pii.examples(t)}
    assert int(seen[0][0, 0, :, 2].sum()) == sum(not held for *_, held in want)


def test_parts_of_the_sums_give_the_same_trees():
    import numpy as np

    x = np.random.default_rng(1).integers(0, 9, (900, 5)).astype(float)
    y = (x[:, 1] + x[:, 2] > 7).astype(float)
    whole = pii.BoostedTrees.fit(x, y)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 33)[1:-1])) for c in x.T]
    code = pii.binned(x, edges)
    parts = [(code[i::7], y[i::7], np.ones(len(y[i::7]), int)) for i in range(7)]
    again = pii.BoostedTrees.grow(edges, y.mean(), lambda *at: sum(pii.sums_of(p, *at) for p in parts))
    assert all((a == b).all() for s, t in zip(whole.trees, again.trees) for a, b in zip(s, t))
    assert np.allclose(whole.score(x), 1 / (1 + np.exp(-whole.coded(code))))
