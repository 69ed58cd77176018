import re


import corpus_pipeline
from quillspark.llm import queries
from quillspark.llm.decontaminate import contaminations, keep_uncontaminated
from quillspark.llm.toxicity import fit_toxicity, score_toxicity
from tests.compare import connect

SF = "/root/testdata/sf0.001"


def test_each_stage_against_its_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, bench = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in score_toxicity(docs, fit_toxicity(docs, labels)).where("score >= 0.5").collect()}
    one = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert {r.doc_id for r in one.collect()} == set(text) - toxic and one.columns == docs.columns

    classes = connect(SF).execute(queries.ORACLE_SQL["op1_jaccard_join"]).fetchall()
    two = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert sorted(r.doc_id for r in two.collect()) == sorted({c[1] for c in classes}) and two.columns == docs.columns

    hit = {r.doc_id for r in contaminations(docs, bench).collect()}
    items = [" ".join(re.findall(r"\w+", r.text.lower())) for r in bench.collect()]
    assert hit >= {i for i, t in text.items() if any(b in " ".join(re.findall(r"\w+", t.lower())) for b in items)}
    assert {r.doc_id for r in keep_uncontaminated(docs, bench).collect()} == set(text) - hit

    four = {r.doc_id: r for r in corpus_pipeline.redact_personal_data(spark, docs, SF).collect()}
    assert set(four) == set(text) and all(r.n_chars == len(r.text) for r in four.values())
    assert not any("@mail" in r.text for r in four.values()) and any("[EMAIL]" in r.text for r in four.values())


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, SF)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard_join", "decontamination", "pii", "pieces"]
    assert got.columns == ["doc_id", "pieces", "n_pieces"] and 100 < got.count() < 200


def test_stages_on_empty_and_odd_tables(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, _key long, score double"
    odd = [(1, None, None, None, None, None, None, None), (None, "null id " * 9, None, "s", 5, "x", 1, 0.5), (2, "", "en", "s", 0, "x", 1, 0.5)]
    odd += [(3, "mail a.b@c.org now " * 3, "en", "s", 57, "x", 3, 0.1)] * 2 + [(4, "mail a.b@c.org now " * 3, "en", "s", 57, "x", 3, 0.1), (5, "y" * 200_000, "en", "s", 1, None, 1, 0.0)]
    odd += [(6, "ſx [at] foo.com, ıd (at) x.com and K9[at]a.b, +٤٩ 30 ١٢٣٤٥٦٧ \U0001f600", "en", "s", 1, None, 1, 0.0)]
    for rows, left in (([], []), (odd, [None, 1, 2, 3, 5, 6])):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = stage(spark, docs, SF)
            assert name == "pieces" or docs.columns == columns
        assert sorted((r.doc_id for r in docs.collect()), key=lambda i: (i is not None, i)) == left


def test_whole_run_against_plain_counterparts(spark):
    """Each stage by its slow version, on what the one before kept."""
    from quillspark.llm.decontaminate import Q, Index
    from quillspark.llm.files import tokenizer_file
    from quillspark.llm.pieces import PieceModel
    from quillspark.llm.pii import LABELS, fit_pii
    from tests.llm.test_jaccard import brute
    from tests.llm.test_models import plain_toxicity
    from tests.llm.test_pii import greedy
    from tests.llm.test_pii import plain as base
    from tests.llm.test_shards_decontamination import least_edits, plain

    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = fit_toxicity(docs, labels)
    rows = [(i, t) for i, t in rows if plain_toxicity(model, t) < 0.5]
    heads = {i for i, head, _ in brute(rows) if i == head}
    rows = [(i, t) for i, t in rows if i in heads]
    bench = {r.item_id: plain(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    budget = {i: max(0, min(int(0.08 * len(b)), (len(b) - Q) // Q)) for i, b in bench.items()}
    index = Index(list(bench.items()))
    maybe = {rows[m[0]][0]: index.ids[m[1]] for m in index.matches([t or "" for _, t in rows])}
    assert all(least_edits(bench[item], plain(dict(rows)[i])) <= budget[item] for i, item in maybe.items())
    assert not [i for i, t in rows if i not in maybe and any(f" {b} " in f" {plain(t or '')} " for b in bench.values())]
    rows = [(i, t) for i, t in rows if i not in maybe]
    pii, pieces = fit_pii(spark.createDataFrame(rows, "doc_id long, text string")), PieceModel.load(tokenizer_file("piece_bpe_32k.model"))

    def redacted(text):
        spans = greedy(pii, text) if pii.trees else base(text)
        out, last = "", 0
        for s, k, e in spans:
            out, last = (out + text[last:s] + f"[{LABELS[k].upper()}]" if s >= last else out), max(last, e)
        return out + text[last:]

    want = {i: pieces.encode(redacted(t)) for i, t in rows}
    assert {r.doc_id: r.pieces for r in corpus_pipeline.run(spark, SF).collect()} == want
