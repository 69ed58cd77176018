import hashlib
import hmac
import struct
import zlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions.signatures import hmac_sha256, signed
from quillspark.operators import chunking as C, images as I, tasks as T, trees as G


def png(width=3, height=4, *more):
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
    return I.PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + b"".join(chunk(*m) for m in more) + chunk(b"IDAT", b"xx") + chunk(b"acTL", b"late") + chunk(b"IEND", b"")


def jpeg(width=5, height=6, before=b"\xff\xe0\x00\x06JFIF\xff\xfe\x00\x08\xff\xc0\x00\x0bxx", marker=0xC2):
    return b"\xff\xd8" + before + b"\xff" + bytes([0xFF, marker]) + struct.pack(">HBHHB", 17, 8, height, width, 3) + b"\x00" * 9 + b"\xff\xda\x00\x02data\xff\xd9"


def webp(kind, body):
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(body)) + b"WEBP" + kind + struct.pack("<I", len(body)) + body


VP8X = lambda flags, w, h: webp(b"VP8X", bytes([flags, 0, 0, 0]) + (w - 1).to_bytes(3, "little") + (h - 1).to_bytes(3, "little"))
IMAGES = [
    ("a.png", "image/png", png(), ("png", 3, 4, False, "ok")), ("a.PNG", "", png(), ("png", 3, 4, False, "ok")), ("a", " IMAGE/PNG ", png(), ("png", 3, 4, False, "ok")),
    ("a.png", "", png(3, 4, (b"acTL", b"\0" * 8)), ("png", 3, 4, True, "animated")), ("a.png", "", png(3, 4, (b"tEXt", b"....acTL....")), ("png", 3, 4, False, "ok")),
    ("a.png", "", png()[:20], ("png", None, None, False, "bad_header")), ("a.png", "", png(0, 4), ("png", 0, 4, False, "no_pixels")), ("a.png", "", png(8193, 1), ("png", 8193, 1, False, "too_wide")),
    ("a.png", "", png(8192, 4097), ("png", 8192, 4097, False, "too_many_pixels")), ("a.png", "", png(8192, 4096), ("png", 8192, 4096, False, "ok")), ("a.jpeg", "", jpeg(), ("jpeg", 5, 6, False, "ok")),
    ("a.jpg", "image/jpeg", jpeg(7, 9, b""), ("jpeg", 7, 9, False, "ok")), ("a.jpg", "", jpeg(marker=0xC4), ("jpeg", None, None, False, "bad_header")), ("a.jpg", "", jpeg()[:14], ("jpeg", None, None, False, "bad_header")),
    ("a.webp", "", VP8X(0x10, 300, 70_000), ("webp", 300, 70_000, False, "too_wide")), ("a.webp", "", VP8X(0x12, 30, 40), ("webp", 30, 40, True, "animated")),
    ("a.webp", "", webp(b"VP8 ", b"\x00\x00\x00\x9d\x01\x2a" + struct.pack("<HH", 0x4000 | 11, 12)), ("webp", 11, 12, False, "ok")), ("a.webp", "", webp(b"VP8L", b"\x2f" + struct.pack("<I", 20 | 21 << 14)), ("webp", 21, 22, False, "ok")),
    ("a.webp", "", webp(b"VP8L", b"\x2f"), ("webp", None, None, False, "bad_header")), ("a.webp", "", VP8X(0, 9, 9) + b"ANIM", ("webp", 9, 9, True, "animated")), ("a.png", "", b"", (None, None, None, False, "empty")),
    ("a.png", "", None, (None, None, None, False, "empty")), ("a.gif", "", png(), ("png", 3, 4, False, "unsupported")), ("a.png", "image/gif", png(), ("png", 3, 4, False, "unsupported")), ("a.txt", None, png(), ("png", 3, 4, False, "unsupported")),
    (None, None, png(), ("png", 3, 4, False, "unsupported")), ("a.jpg", "image/png", png(), ("png", 3, 4, False, "disagree")), ("a.webp", "", png(), ("png", 3, 4, False, "other_kind")), ("a.png", "", b"plain", (None, None, None, False, "no_image")),
    ("a.png", "", png() + b"x" * 5000, ("png", 3, 4, False, "too_large")),
]


def test_image_headers_and_verdicts(spark):
    df = spark.createDataFrame([(i, n, m, d) for i, (n, m, d, _) in enumerate(IMAGES)], "id long, name string, kind string, verdict binary")
    got = {r[0]: tuple(r)[1:] for r in I.image_verdicts(df, "id", "verdict", "name", "kind", 4000).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(IMAGES)}
    assert I.image_verdicts(df.limit(0), "id", "verdict", "name", "kind").count() == 0


@pytest.mark.parametrize("key", [b"", b"k", b"\x00\xff" * 32, b"long" * 30])
def test_signatures(spark, key):
    bodies = [b"", b"x", "é\n".encode() * 100, bytes(range(256))]
    macs = [hmac.new(key, b, hashlib.sha256).hexdigest() for b in bodies]
    df = spark.createDataFrame([(b, m) for b, m in zip(bodies, macs)], "body binary, mac string")
    assert all(r[0] for r in df.select(hmac_sha256(F.col("body"), key) == F.col("mac")).collect())
    m = macs[1]
    cases = [
        (m, None, True), (m.upper(), None, True), (None, f"sha256={m}", True), (m, f"sha256={m}", True), (None, None, False), ("", f"sha256={m}", False), (m, "sha256=", False), (m[:-1], None, False), (m + "0", None, False),
        (macs[2], None, False), (m, f"sha256={macs[2]}", False), (None, m, False), (f"sha256={m}", None, False), (m + "\n", None, False), (None, f"sha1={m}", False), ("g" * 64, None, False),
    ]
    rows = spark.createDataFrame([(b"x", r, h, w) for r, h, w in cases] + [(None, m, None, False)], "body binary, raw string, hub string, want boolean")
    got = rows.select(signed(F.col("body"), key, F.col("raw"), F.col("hub")).alias("is"), "want").collect()
    assert [r["is"] for r in got] == [r.want for r in got]


def test_packing_in_order_and_by_key(spark):
    sizes = [1, 63_999, 1, 70_000, 5, *[100] * 70, 63_000, 1000, 1]
    rows = [(k, i, "é" * n, "x") for k in ("a", "b") for i, n in enumerate(sizes)] + [("c", 0, None, "x"), (None, 0, "y", "x"), (None, 1, "z", "x")]
    df = spark.createDataFrame(rows, "source string, place long, text string, batch_id string").repartition(5)
    got = C.plan_batches(df, ["source"], ["place"], "text").collect()
    want = C.greedy_batches(sizes, C.BATCH_ITEMS, C.BATCH_CHARS)
    assert {(r.source, r.place): r.batch_id for r in got} == {(k, i): b for k in ("a", "b") for i, b in enumerate(want)} | {("c", 0): 0, (None, 0): 0, (None, 1): 0}
    assert all(r.error is None for r in got) and "text" not in got[0].asDict()


def test_oversize_requests_are_errors(spark):
    import json

    texts = ["a", "x" * (C.REQUEST_BYTES - 2), "y" * (C.REQUEST_BYTES - 1), "b", '"\n\\\x01é/ ', None]
    got = {r.i: r for r in C.plan_batches(spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "k int, i int, t string"), ["k"], ["i"], "t", requests=True).collect()}
    assert [got[i].batch_id for i in range(6)] == [0, 1, None, 2, 2, 2] and [got[i].error for i in range(6)] == [None, None, "oversize", None, None, None]
    sized = spark.createDataFrame([(texts[4],)], "t string").select(F.octet_length(F.to_json(F.struct("t"))) - len('{"t":}')).first()[0]
    assert sized == len(json.dumps(texts[4], ensure_ascii=False).encode())


def test_many_chunks_of_one_source_pack(spark):
    rows = spark.range(300_000).select(F.lit("hot").alias("source"), "id", F.repeat(F.lit("w"), (F.col("id") % 3000).cast("int")).alias("text"))
    got = C.plan_batches(rows, ["source"], ["id"], "text").groupBy("batch_id").agg(F.count("*").alias("n"), F.sum(F.col("id") % 3000).alias("size"), F.min("id").alias("a"), F.max("id").alias("b"))
    assert got.where(f"n > {C.BATCH_ITEMS} or size > {C.BATCH_CHARS} or b - a + 1 <> n").count() == 0 and got.agg(F.sum("n")).first()[0] == 300_000


def test_a_deep_chain_and_its_roles(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    own = spark.createDataFrame([(10, 2), (50_000, 5), (50_000, 3), (99_000, 4), (777_777, 9)], "node long, role int")
    got = G.inherited_maximum(chain, own, "role").groupBy("role").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("n")).collect()
    assert {(r.role, r.a, r.b, r.n) for r in got} == {(2, 10, 49_999, 49_990), (5, 50_000, 99_999, 50_000)}
    ends = spark.createDataFrame([(99_999,), (5,), (777_777,)], "node long")
    up = G.ancestors(chain, ends).groupBy("node").agg(F.count("*").alias("n"), F.max("depth").alias("d"), F.min("ancestor").alias("a")).collect()
    assert {tuple(r) for r in up} == {(99_999, 100_000, 99_999, 0), (5, 6, 5, 0)}
    assert G.descendants(chain, spark.createDataFrame([(99_990,), (99_995,)], "node long")).count() == 10
    assert G.descendants(chain, spark.createDataFrame([(40_000,)], "node long")).count() == 60_000


def test_cycles_are_found_without_pairs(spark):
    rows = [(0, 1), (1, 0)] + [(i, i - 1) for i in range(2, 1500)] + [(9000 + i, 9000) for i in range(1, 50)] + [(9000, None)]
    edges = spark.createDataFrame(rows, "node long, parent long")
    for ask in (lambda: G.closure(edges), lambda: G.inherited_maximum(edges, edges.select("node", F.lit(1).alias("v")), "v"), lambda: G.depths(edges)):
        with pytest.raises(ValueError, match="cycle"):
            ask()
    assert G.descendants(edges, spark.createDataFrame([(9000,)], "node long")).count() == 50


def test_sums_paths_and_listings(spark):
    edges = spark.createDataFrame([(1, None, "r"), (2, 1, "a"), (3, 1, "b"), (4, 2, "c"), (5, 4, "d"), (8, 7, "lost"), (9, None, "s")], "node long, parent long, name string")
    files = spark.createDataFrame([(5, True), (5, False), (4, True), (3, False), (9, True)], "node long, is_open boolean")
    got = {r.node: (r.depth, r.n_children, r.n_files, r.n_open) for r in G.assembled(edges, files).collect()}
    assert got == {1: (0, 2, 4, 2), 2: (1, 1, 3, 2), 3: (1, 0, 1, 0), 4: (2, 1, 3, 2), 5: (3, 0, 2, 1), 8: (0, 0, 0, 0), 9: (0, 0, 1, 1)}
    assert {r.node: r.full_path for r in G.paths(edges).collect()} == {1: "r", 2: "r/a", 3: "r/b", 4: "r/a/c", 5: "r/a/c/d", 9: "s"}
    empty = edges.limit(0)
    assert G.assembled(empty, files).count() == G.paths(empty).count() == G.closure(empty).count() == 0


NOW, PAST, LATER = datetime(2024, 1, 10), datetime(2024, 1, 1), datetime(2024, 2, 1)
TASK = "task_id long, status string, pause_state string, is_deleted boolean, total_count long, stage string, waiting_reason string, dependency_key string, " + ", ".join(f"{s}_count long" for s in T.STATUSES) + ", lease_until timestamp, started_at timestamp"
ITEM = "task_id long, ordinal long, status string, stage string, waiting_reason string, dependency_key string, attempts int, paused_attempts int, released_attempts int, lease_until timestamp"


def test_verdicts_and_gauges_of_every_field(spark):
    def task(i, status, counts, stage=None, reason=None, key=None, total=None, lease=None, pause="unpaused", gone=False):
        return (i, status, pause, gone, sum(counts) if total is None else total, stage, reason, key, *counts, lease, datetime(2024, 1, i % 28 + 1))

    item = lambda t, o, status, stage=None, reason=None, key=None, used=0, lease=None: (t, o, status, stage, reason, key, used, 0, 0, lease)
    tasks = [
        task(1, "running", (0, 1, 0, 1, 0, 0), "embed", "", ""), task(2, "succeeded", (0, 1, 0, 0, 0, 0), "embed"), task(3, "queued", (1, 0, 0, 0, 0, 0), "entry"), task(4, "waiting", (0, 0, 1, 0, 0, 0), "embed", "other", "x"),
        task(5, "running", (0, 0, 0, 0, 0, 0), total=3), task(6, "failed", (9, 9, 9, 9, 9, 9), total=2), task(7, "running", (1, 0, 0, 0, 0, 0), gone=True), task(8, "waiting", (0, 0, 1, 0, 0, 0), "parse", "dependency", "k", lease=LATER),
        task(9, "running", (0, 1, 0, 0, 0, 0), "parse", lease=LATER), task(10, "queued", (1, 0, 0, 0, 0, 0), lease=LATER, pause="paused"),
    ]
    items = [
        item(1, 1, "succeeded", "old"), item(1, 2, "running", "embed", lease=LATER), item(2, 1, "running", "embed", lease=LATER), item(3, 1, "queued", "processing"), item(4, 1, "waiting", "embed", "dependency", "y", used=4), item(6, 1, "failed"), item(6, 2, "succeeded"),
        item(7, 1, "queued"), item(8, 1, "waiting", "parse", "dependency", "k"), item(9, 1, "running", "parse", lease=PAST), item(10, 1, "queued", used=5),
    ]
    found = T.facts(spark.createDataFrame(tasks, TASK), spark.createDataFrame(items, ITEM), F.lit(NOW))
    got = {r.task_id: r.mismatch_fields for r in T.verdicts(found).collect()}
    counts = [f"{s}_count" for s in T.STATUSES]
    assert got == {1: [], 2: ["status"], 3: [], 4: ["waiting_reason", "dependency_key"], 5: ["status", "total_count"], 6: counts, 8: [], 9: [], 10: []}
    g = T.gauges(found, F.lit(NOW)).first().asDict()
    assert g == {
        "tasks": 9, "active": 7, "waiting_for_dependency": 2, "running_without_item": 1, "live_items": 2, "orphaned_slots": 2, "nearly_exhausted": 2, "oldest_admitted": datetime(2024, 1, 9), "mismatched": 4,
    }
    none = T.facts(spark.createDataFrame([], TASK), spark.createDataFrame([], ITEM), F.lit(NOW))
    assert T.verdicts(none).count() == 0 and T.gauges(none, F.lit(NOW)).first().tasks == 0


def test_names_and_types_of_downloads(spark):
    from quillspark.operators import access as A

    cases = [
        (" a/b\\c.pdf ", "x; filename=y.txt", "https://h/p.md", "c.pdf"), ("  ", 'attachment; filename="y z.txt"; a=1', "https://h/p.md", "y z.txt"), (None, "filename='../up'", "https://h/p", "up"), (None, "inline", "https://h/d/p.md?x=/q", "p.md"),
        (None, None, "https://h/d/e//", "e"), (None, 'filename=""', "https://h/p.md", None), (None, None, "https://h", None), ("..", None, "https://h/p.md", None), (None, "filename=a/", "https://h/p.md", None), (None, None, None, None),
    ]
    df = spark.createDataFrame(cases, "r string, d string, u string, want string")
    got = df.select(A.remote_file_name(F.col("r"), F.col("d"), F.col("u")).alias("is"), "want").collect()
    assert [r["is"] for r in got] == [r.want for r in got]
    types = [("a.PDF", "application/pdf", True), ("a.pdf", "text/plain", False), ("a.md", "text/markdown", True), ("a.txt", "application/json", False), ("a.json", "application/json", True), ("a.json", "text/html", True), ("a.json", "application/pdf", False),
             ("README", "text/x", True), ("README", "image/png", False), ("a.exe", "text/plain", False), ("a.xlsx", A.DOCUMENT_MEDIA["xlsx"], True), ("a.docx", A.DOCUMENT_MEDIA["xlsx"], False), (None, "text/plain", False), ("a.txt", None, False)]
    got = spark.createDataFrame(types, "n string, m string, want boolean").select(A.media_fits(F.col("n"), F.col("m")).alias("is"), "want").collect()
    assert [r["is"] for r in got] == [r.want for r in got]
