import json
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as X
from quillspark.functions.paths import glob_regex, selection
from quillspark.operators import chunking as C, metadata as M, search as S
from quillspark.streaming import ingest


def test_char_chunks_of_known_texts():
    assert C.char_chunks("0123456789", C.ChunkBudget(4, 1)) == ["0123", "3456", "6789"]
    assert C.char_chunks("x\n\n\n\n yz ", C.ChunkBudget(30, 5)) == ["x\n\nyz"] and C.char_chunks(" \n\n ") == []
    assert C.char_chunks("one two\n\nthree", C.ChunkBudget(9, 0)) == ["one two", "three"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", max_size=200), st.integers(1, 30), st.integers(0, 20))
def test_char_chunks_stay_in_budget_and_cover(text, most, overlap):
    got, (most, overlap) = C.char_chunks(text, C.ChunkBudget(most, overlap)), C.ChunkBudget(most, overlap).clamped
    assert all(0 < len(c) <= most for c in got)
    whole = "".join(c if k == 0 else c[min(overlap, len(got[k - 1])) :] for k, c in enumerate(got))
    strip = lambda s: "".join(s.split())
    assert strip(whole) == strip(text)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aé\n`x ", max_size=300))
def test_lines_and_segments_rejoin(text):
    chunks = C.line_chunks(text, 16, 3)
    assert "".join(c[2] for c in chunks) == text and all(len(c[2].encode()) <= 16 for c in chunks)
    parts = C.segments(text)
    assert "".join(p[1] + p[2] for p in parts) == text and [p[0] for p in parts] == [f"body:{k:06d}" for k in range(len(parts))]


def test_token_chunks_and_batches():
    text = " ".join(f"w{i}" for i in range(100))
    got = C.token_chunks(text, C.word_tokens, C.ChunkBudget(10, 3, "tokens"))
    assert all(len(c.split()) <= 10 for c in got) and got[0].split()[-3:] == got[1].split()[:3]
    assert C.greedy_batches([1, 1, 99, 1, 1], 2, 10) == [0, 0, 1, 2, 2]


CRATE = """use std::collections::BTreeMap;

/// A shelf of jars,
/// by label.
#[derive(Debug)]
pub struct Shelf {
    jars: BTreeMap<String, u32>,
}

impl Shelf {
    fn count(&self) -> usize { self.jars.len() }
}
const DEPTH: u32 = 4;
"""
MODULE = """import { open } from './door';
/** how wide */
export type Width = { cm: number };

@sealed
class Room {
  enter() { return open('{'); }
}
let rooms = [new Room()]
"""
PAGE = """import React from 'react';

const Row = (props) => { return <li>{props.name}</li>; };

export default function List() {
  return <ul><Row name="it's" /></ul>;
}
"""


def test_structural_chunks_begin_at_items():
    spans = lambda text, language: [c[:2] for c in C.structural_chunks(text, language)]
    assert spans(CRATE, "rust") == [(1, 2), (3, 9), (10, 12), (13, 13)]
    assert spans(MODULE, "typescript") == [(1, 1), (2, 4), (5, 8), (9, 9)]
    assert spans(PAGE, "tsx") == [(1, 2), (3, 4), (5, 7)]
    assert C.item_starts("mod a {", "rust") is None and spans("mod a {\n", "rust") == [(1, 1)] and spans("", "rust") == [] and spans("x\ny", "cobol") == [(1, 2)]
    large = "fn wide() {\n" + "".join(f"    call_{i}();\n" for i in range(70)) + "}\ntype T = u8;\n"
    got = C.structural_chunks(large, "rust", 400, 15)
    assert "".join(c[2] for c in got) == large and all(len(c[2]) <= 400 and c[1] - c[0] < 15 for c in got) and got[-1][:2] == (73, 73)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="a{}()[];#@/*\"'`=!\n \u2028\x0c", max_size=120), st.sampled_from(["rust", "typescript", "tsx", "sql"]))
def test_structural_chunks_rejoin(text, language):
    got = C.structural_chunks(text, language, 32, 4)
    assert "".join(c[2] for c in got) == text
    assert sorted({n for a, b, _ in got for n in range(a, b + 1)}) == list(range(1, len(C.lines_of(text)) + 1))


def test_bounded_token_chunks():
    text = " ".join(f"w{i}" for i in range(100))
    got = C.bounded_chunks(text, C.word_tokens, C.ChunkBudget(10, 3, "tokens_v2"))
    assert all(len(c.split()) <= 10 for c in got) and got[0].split()[-3:] == got[1].split()[:3] and got[-1].endswith("w99")
    twice = lambda t: C.word_tokens(t) * 2 if len(t) < 60 else C.word_tokens(t)  # noqa: E731  a text alone has more tokens than in its place
    assert [len(c.split()) for c in C.bounded_chunks(text, twice, C.ChunkBudget(8, 0))][0] == 4
    assert C.bounded_chunks("", C.word_tokens, C.ChunkBudget()) == []


def test_budget_identities():
    for budget in (C.ChunkBudget(), C.ChunkBudget(10, 3, "tokens"), C.ChunkBudget(10, 0, "tokens_v2", "o200k_base")):
        assert C.ChunkBudget.parse(budget.identity) == budget
    for wrong in ("", "chars:0:0", "chars:5:5", "tokens:5:1", "words:5:1", "chars:5:1:x"):
        with pytest.raises(ValueError):
            C.ChunkBudget.parse(wrong)


def test_file_tokenizer():
    public = pytest.importorskip("public_tokenizers")
    pytest.importorskip("tokenizers")
    text = "the cat sat on the mat. " * 40
    got = C.bounded_chunks(text, C.file_tokens(public.path("byte_bpe_50k.json")), C.ChunkBudget(16, 4, "tokens_v2"))
    assert len(got) > 1 and all(len(C.file_tokens(public.path("byte_bpe_50k.json"))(c)) <= 16 for c in got)


def test_languages_and_locales(spark):
    from quillspark.functions.locale import detect_locale
    from quillspark.functions.paths import language_of

    paths = {"a/Dockerfile": "dockerfile", "x.rs": "rust", "x.R": "r", "x.RS": "unknown", ".bashrc": "unknown", ".env": "dotenv", "a.b/c": "unknown", "m/CMakeLists.txt": "cmake", "": "unknown"}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r[0]: r[1] for r in df.select("path", language_of(F.col("path"))).collect()} == paths
    texts = {"the cat and the dog": "en", "le chat et les chiens": "fra", "der Hund und die Katze": "deu", "el perro y los gatos": "spa", "山上有一座小屋": "zh", "the le": None, "": None}
    df = spark.createDataFrame([(x,) for x in [*texts, None]], "text string")
    assert {r[0]: r[1] for r in df.select("text", detect_locale(F.col("text"))).collect()} == texts | {None: None}


def test_globs_and_selection(spark):
    rows = [("src/main.rs", 5), ("config.yml", 5), ("a/node_modules/x.rs", 5), ("k.pem", 1), ("Cargo.lock", 1), ("a.min.js", 1), ("b.png", 1), ("big.md", 10**8), ("docs/skip.md", 1), ("Cargo.toml", 1)]
    df = spark.createDataFrame(rows, "path string, size long")
    got = [r[0] for r in df.select(selection(F.col("path"), F.col("size"), ("docs/*",))).collect()]
    assert got == ["eligible", "not_included", "excluded_directory", "secret", "lockfile", "minified", "binary", "too_large", "excluded_by_user", "eligible"]
    more = {"a/target": "excluded_directory", ".env.local": "secret", "a/ID_RSA": "secret", "x.lock": "lockfile", "x.js.map": "source_map", "x.JSX": "eligible", "vendor/x.rs": "eligible"}
    got = spark.createDataFrame([(p,) for p in more], "path string").select("path", selection(F.col("path"), F.lit(1))).collect()
    assert {r[0]: r[1] for r in got} == more
    import re

    assert re.search(glob_regex("docs/**"), "docs/a/b") and re.search(glob_regex("/docs/**"), "docs") and not re.search(glob_regex(""), "a") and not re.search(glob_regex("x" * 600), "x" * 600)
    assert re.search(glob_regex("src/**/x?.rs"), "src/a/b/x1.rs") and not re.search(glob_regex("src/*.rs"), "src/a/b.rs") and re.search(glob_regex("*.md"), "a/b.md")


def test_normalizer(spark):
    df = spark.createDataFrame([("  two \t words\r\n\r\nand\u2003more  ", "~~\n== ==\nΔ 7\n...")], "a string, b string")
    assert tuple(df.select(X.normalize_body(F.col("a")), X.normalize_body(F.col("b"))).first()) == ("two words\n\nand more", "Δ 7")


def test_metadata_filters(spark):
    docs = spark.createDataFrame([(1, '{"score":10,"tags":["a","b"],"at":"2019-03-05T23:15:00-03:00","p":{"n":"north"}}'), (2, '{"score":null}'), (3, "{}")], "id long, metadata_json string")
    defs = [M.MetadataDef("score", "integer"), M.MetadataDef("tags", "keyword", True), M.MetadataDef("at", "datetime"), M.MetadataDef("p.n", "keyword"), M.MetadataDef("new", "keyword", state="building")]
    ids = lambda *f: [r.id for r in docs.where(M.compile_filters(list(f), defs)).orderBy("id").collect()]
    assert ids(M.MetadataFilter("score", "exists", False)) == [2, 3]
    assert ids(M.MetadataFilter("at", "eq", "2019-03-06T02:15:00Z")) == ids(M.MetadataFilter("p.n", "in", ["north", "x"])) == ids(M.MetadataFilter("tags", "contains", "b")) == [1]
    assert ids(M.MetadataFilter("score", "in", [])) == ids(M.MetadataFilter("score", "eq", "ten")) == [] and ids(M.MetadataFilter("score", "range", min=9, max=10)) == [1]
    for path in ("other", "new"):
        with pytest.raises(ValueError):
            ids(M.MetadataFilter(path, "exists"))


def test_pages_join_to_the_whole_order(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3, "ab"[i % 2]) for i in range(40)], "id long, q int, s string")
    for keys in ([("q", "desc"), ("s", "asc")], [("q", "asc")], []):
        want, got, after = [r.id for r in rows.orderBy(*M.typed_sort(keys, "id")).collect()], [], None
        while True:
            page = M.page(rows, keys, "id", 7, after).collect()
            got += [r.id for r in page[:7]]
            if len(page) <= 7:
                break
            cursor = M.encode_cursor({"k": keys}, [page[6][c] for c, _ in keys], page[6].id)
            after = M.decode_cursor({"k": keys}, cursor)
        assert got == want
    with pytest.raises(ValueError):
        M.decode_cursor({"k": 1}, M.encode_cursor({"k": 2}, [], 0))


def test_fusion_arithmetic(spark):
    cols = "document_id long, chunk_index int, title string, chunk_text string"
    vec = spark.createDataFrame([(1, 0, "Tide tables", "x", 1.0), (2, 0, "a", "b", 0.5), (4, 0, "Tide tables", "z", 0.5), (5, 1, "q", "old", 0.2)], cols + ", vector_score double")
    kw = [(1, 0, "Tide tables", "x", 2.37, "title_exact", "original", True), (3, 0, "The tide tables of May", "y", 3.0, "title_phrase", "original", True), (4, 0, "Tide tables", "z", 0.82, "chunk_phrase", "original", True)]
    kw += [(5, 1, "q2", "new", 0.35, "all_terms", "en", False), (5, 1, "q", "old", 1.0, "chunk_phrase", "original", True)]
    kw = spark.createDataFrame(kw, cols + ", keyword_score double, match_reason string, content_locale string, is_fallback boolean")
    got = {r.document_id: r for r in S.fuse(vec, kw, "tide TABLES").collect()}
    assert {i: r.score for i, r in got.items() if i < 4} == {1: 1.0, 2: 0.275, 3: pytest.approx(0.49)}
    assert {i: r.match_reason for i, r in got.items()} == {1: "semantic+title", 2: "semantic", 3: "title", 4: "semantic+keyword", 5: "semantic+keyword"}
    assert (got[5].content_locale, got[5].chunk_text, got[5].keyword_score, got[5].vector_score) == ("en", "new", 1.0, 0.2)


def test_candidate_windows():
    assert S.candidate_window(8) == (80, True) and S.candidate_window(100) == (101, True) and S.candidate_window(8, 120) == (120, True)
    assert S.candidate_window(8, filtered=True) == (640, True) and S.candidate_window(500, filtered=True) == (2000, True) and S.candidate_window(2000) == (2000, False)
    assert S.search_mode(True, True, "a", "a") == ("semantic", None) and S.search_mode(True, False, "a", "b")[1] == "not_vectorized" and S.search_mode(False, True, "a", "a")[1] == "not_configured"
    assert S.search_mode(True, True, "a", "b") == ("lexical", "identity_mismatch") and S.search_mode(True, True, "a", "a", failed=True) == ("lexical", "runtime")


def test_streaming_ingest_is_incremental_and_replays_safely(spark, tmp_path):
    schema = "doc_id long, text string"
    put = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    run = lambda: ingest.ingest(spark, f"{tmp_path}/in/*", schema, f"{tmp_path}/versions", f"{tmp_path}/checkpoint").awaitTermination()
    put("a", [(1, "one"), (2, "two")])
    run()
    put("b", [(1, "one"), (2, "two changed"), (3, "three")])
    run()
    run()
    assert sorted((r.doc_id, r.body) for r in ingest.current(spark, f"{tmp_path}/versions").collect()) == [(1, "one"), (2, "two changed"), (3, "three")]
    assert spark.read.parquet(f"{tmp_path}/versions").count() == 4


def test_sheet_sections_and_image_kinds(spark):
    from quillspark.operators import documents as X

    doc = '{"groups":[{"name":"sheet: Stock","children":[{"$ref":"#/tables/0"},{"$ref":"#/tables/9"}]},{"name":"Notes","children":[]}],"tables":[{"data":{"grid":[[{"text":"Jar"},{"text":"Count"}],[{"text":"plum"},{"text":"plum"},{"text":""},{"text":"3"}]]}}]}'
    got = X.sheet_sections(spark.createDataFrame([(1, doc)], "id long, j string"), "id", "j").collect()
    assert [(r.name, r.body) for r in got] == [("Stock", "Jar | Count\nplum | 3"), ("Notes", "")]
    heads = spark.createDataFrame([(bytes.fromhex("89504e470d0a1a0a00"),), (b"RIFF\x00\x00\x00\x00WEBPVP8 ",), (b"plain",)], "b binary")
    assert [r[0] for r in heads.select(X.image_kind(F.col("b"))).collect()] == ["png", "webp", None]


def test_converter_bodies(spark):
    from quillspark.operators import documents as X

    cell = lambda *x: [{"text": t} for t in x]
    ref = lambda *x: [{"$ref": r} for r in x]
    tables = [{"data": {"grid": [cell("a", " a ", "", "a", "b \u00a0 c"), cell("", " "), cell("d")]}}, {"data": {}}, {"data": {"grid": [cell("e")]}}]
    groups = [{"name": "x", "children": ref("#/tables/2", "#/texts/0", "#/tables/9")}, {"children": ref("#/tables/0", "#/tables/2")}, {"children": [{}, *ref("#/tables/0")]}, {"children": ref("#/tables/1")}]
    whole = {"body": {"children": ref("#/groups/1", "#/texts/0", "#/groups/3", "#/groups/2", "#/groups/8") + [{}] + ref("#/groups/0")}, "groups": groups, "tables": tables, "texts": cell("ignored")}
    docs = [whole, {**whole, "body": {"children": ref("#/texts/0", "#/groups/3")}}, {**whole, "groups": None}, {"groups": groups, "tables": tables}, {"body": {}, "groups": groups}, {}]
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(docs)] + [(6, "not json"), (7, None)], "id long, j string")
    got = {r.id: r.body for r in df.select("id", X.body_text(F.col("j")).alias("body")).collect()}
    assert got == {0: "a | b c\nd\n\ne\n\ne"} | dict.fromkeys(range(1, 8))


def test_trees_of_any_depth(spark):
    from quillspark.operators import trees as G

    n = 300
    chain = spark.createDataFrame([(i, i - 1 if i else None, f"n{i}") for i in range(n)] + [(1000, 999, "dangling")], "node long, parent long, name string")
    got = {(r.node, r.ancestor): r.depth for r in G.closure(chain).collect()}
    assert got == {(i, j): i - j for i in range(n) for j in range(i + 1)} | {(1000, 1000): 0, (1000, 999): 1}
    paths = {r.node: r.full_path for r in G.paths(chain).collect()}
    assert paths[3] == "n0/n1/n2/n3" and len(paths) == n
    with pytest.raises(ValueError):
        G.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "node long, parent long"))
    assert G.closure(spark.createDataFrame([], "node long, parent long")).count() == 0
    wide = spark.range(200_000).selectExpr("id AS node", "CASE WHEN id > 0 THEN (id - 1) DIV 1000 END AS parent")
    found = G.closure(wide)
    assert found.count() == found.groupBy("node").agg((F.max("depth") + 1).alias("n")).agg(F.sum("n")).first()[0]


def tasks_and_items(spark, tasks, items):
    t = spark.createDataFrame(tasks, "task_id long, queue long, kind string, status string, pause_state string, created_at timestamp, next_attempt_at timestamp, is_deleted boolean, total_count long")
    i = spark.createDataFrame(items, "task_id long, ordinal long, status string, attempts int, paused_attempts int, released_attempts int, waiting_reason string, dependency_key string, next_attempt_at timestamp, is_live boolean, failure_stage string")
    return t, i


def test_claims_and_gates(spark):
    from datetime import datetime

    from quillspark.operators import tasks as T

    day = lambda d: datetime(2019, 12, d)
    task = lambda i, q, kind="import", status="running", pause="unpaused", due=None, gone=False: (i, q, kind, status, pause, day(i % 28 + 1), due, gone, 3)
    item = lambda t, o, status="queued", used=0, paused=0, reason=None, key=None, due=None, live=False: (t, o, status, used, paused, 0, reason, key, due, live, None)
    later = datetime(2020, 2, 1)
    tasks = [task(i, 0) for i in range(1, 9)] + [task(9, 0, pause="paused"), task(10, 0, due=later), task(11, 0, gone=True), task(12, 0, status="failed")]
    items = [item(1, 1, "succeeded"), item(1, 2), item(1, 3), item(2, 1, "running"), item(2, 2), item(3, 1, used=5), item(4, 1, used=6, paused=2), item(5, 1, due=later)]
    items += [item(6, 1, "waiting", reason="docling"), item(7, 1, "waiting", reason="dependency", key="vector_rebuild_paused"), item(8, 1, "waiting", reason="dependency", key="other")]
    items += [item(i, 1) for i in (9, 10, 11, 12)]
    # queue 1: a live rebuild; 2: a due rebuild behind live ordinary work; 3: two due rebuilds; 4: a rebuild that isn't due
    tasks += [task(21, 1, T.REBUILD), task(22, 1), task(31, 2, T.REBUILD), task(32, 2), task(33, 2), task(41, 3, T.REBUILD), task(42, 3, T.REBUILD), task(43, 3), task(51, 4, T.REBUILD, due=later), task(52, 4)]
    items += [item(21, 1, "running", live=True), item(22, 1), item(31, 1), item(32, 1, "running", live=True), item(33, 1), item(41, 1), item(42, 1), item(43, 1), item(51, 1), item(52, 1)]
    got = {(r.task_id, r.ordinal, r.mode) for r in T.claimable(*tasks_and_items(spark, tasks, items), F.lit("2020-01-01").cast("timestamp")).collect()}
    assert got == {(1, 2, "normal"), (4, 1, "normal"), (8, 1, "normal"), (41, 1, "rebuild"), (52, 1, "normal")}


def test_projection_and_consistency(spark):
    from quillspark.operators import tasks as T

    task = lambda i, status, total: (i, 0, "import", status, "paused", None, None, i == 7, total)
    item = lambda t, o, status, stage=None: (t, o, status, 0, 0, 0, "why" if status == "waiting" else None, None, None, False, stage)
    tasks = [task(1, "running", 2), task(2, "running", 2), task(3, "cancelled", 2), task(4, "running", 2), task(5, "running", 3), task(6, "running", 4), task(7, "running", 1)]
    items = [item(1, 1, "succeeded"), item(1, 2, "succeeded"), item(2, 1, "failed"), item(2, 2, "failed", "parse"), item(3, 1, "succeeded"), item(4, 1, "cancelled"), item(4, 2, "cancelled")]
    items += [item(5, 2, "queued"), item(5, 1, "waiting"), item(5, 3, "succeeded"), item(6, 1, "succeeded"), item(7, 1, "queued")]
    t, i = tasks_and_items(spark, tasks, items)
    got = {r.task_id: r for r in T.project(t, i).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "succeeded", 2: "failed", 3: "cancelled", 4: "cancelled", 5: "waiting", 6: "queued", 7: "queued"}
    assert got[2].failure_stage == "parse" and got[5].current == 1 and got[5].waiting_reason == "why" and got[1].pause_state == "unpaused" and got[5].pause_state == "paused"
    stored = T.rollup(i.where("not (task_id = 5 and ordinal = 3) and task_id <> 6"))
    said = {(r.task_id, r.field, r.stored, r.actual) for r in T.consistency(t, stored, i).collect()}
    assert {x for x in said if x[0] == 5} == {(5, "n_items", 2, 3), (5, "n_succeeded", 0, 1)} and {x[0] for x in said} == {5, 6} and (6, "n_items", None, 1) in said


def test_free_names(spark):
    from quillspark.operators.generations import free_names

    new = [(1, "a", "x.txt"), (2, "a", "x.txt"), (3, "a", "x.txt"), (4, "a", "x (2).txt"), (5, "b", "x.txt"), (6, "a", ".env"), (7, "a", ".env"), (8, "a", "y.tar.gz"), (9, "a", "é"), (10, "a", "é")]
    taken = [("a", "x.txt"), ("a", "x (3).txt"), ("a", "y.tar.gz"), ("a", "y.tar (2).gz"), ("b", "z")]
    got = {r.id: r.free_name for r in free_names(spark.createDataFrame(new, "id long, folder string, name string"), spark.createDataFrame(taken, "folder string, name string")).collect()}
    assert got == {1: "x (4).txt", 2: "x (5).txt", 3: "x (6).txt", 4: "x (2).txt", 5: "x.txt", 6: ".env", 7: ".env (2)", 8: "y.tar (3).gz", 9: "é", 10: "é (2)"}


def test_quota_refuses_all_but_the_first(spark):
    from quillspark.operators.snapshots import within_quota

    rows = [("p", f"2020-01-0{d}", x, d) for d, x in enumerate([120.0, 1.0], 1)] + [("q", f"2020-0{1 + d // 4}-1{d}", x, d) for d, x in enumerate([60.0, 50.0, 40.0, 1.0, 5.0])]
    rows += [("all", "2020-01-01", 90.0, 1), ("all", "2020-02-01", 20.0, 2), ("all", "2020-03-01", 10.0, 3)]
    usage = spark.createDataFrame(rows, "provider string, day string, amount double, id long").withColumn("ts", F.to_timestamp("day")).drop("day")
    got = {(r.provider, r.id): r.accepted for r in within_quota(usage, 100.0, "provider", "ts", "amount", "id", F.col("provider") == "all").collect()}
    assert got == {("p", 1): True, ("p", 2): False, ("q", 0): True, ("q", 1): False, ("q", 2): True, ("q", 3): False, ("q", 4): True, ("all", 1): True, ("all", 2): False, ("all", 3): True}


def test_validators(spark):
    from quillspark.operators import access as A

    paths = {"a/b.rs": True, "": False, "/a": False, "a//b": False, "a/../b": False, "./a": False, "a/": False, "a\\b": False, "a\tb": False, "/".join("x" * 32): True, "/".join("x" * 33): False, "..a/b": True}
    refs = {"main": True, "feature/x-1": True, "a..b": False, "a/.b": False, "a.lock": False, "x.lock/y": False, "-a": False, "a b": False, "@": False, "a@{1}": False, "a/": False, "a.": False, "r" * 256: False}
    shas = {"a" * 40: True, "0" * 64: True, "A" * 40: False, "a" * 41: False, "": False}
    urls = {"https://host/a": True, "http://host/a": False, "https://u@host/": False, "https:///a": False, "HTTPS://h": True, "ftp://h": False}
    for rule, want in ((A.safe_path, paths), (A.safe_ref, refs), (A.safe_sha, shas), (A.importable_url, urls)):
        df = spark.createDataFrame([(x,) for x in want], "x string")
        assert {r.x: r.ok for r in df.select("x", rule(F.col("x")).alias("ok")).collect()} == want
