import pytest

from quillspark.operators import chunking as C

TS = """import { a } from "x";

// nested templates and an apostrophe: don't
export const nested = `x ${ f({a:`}`}) } y ${ `{${`{`}` }`;

const braces = /[{]/g, more = s.replace(/\\}/, "}");

export function half(n: number): Map<string, Array<Record<string, number>>> {
  return n / 2 > 1 ? g(n) / 3 : /* a } */ /{+/.test(`$\\{`) as any;
}

class Box<T extends Map<string, Set<T>>> {
  re = /[/{]+/;
  get() { return `${this.re}{`; }
}
"""
STARTS = ["import", "// nested", "const braces", "export function", "class Box"]
TSX = """import React from "react";

export const View = () => <p className="a }" onClick={() => { go(`}`); }}>don't {"{"} stop {items.map(i => <Item key={i} {...rest} />)} {</p>;

function Page({ x }: Props) {
  return (
    <>
      It's {x < 3 ? <b>{"}"}</b> : null} a brace: &#123; and 'quotes
      <img src='}' />
    </>
  );
}

const small = a < b;
"""


@pytest.mark.parametrize("language", ["typescript", "tsx"])
def test_templates_and_regular_expressions_are_one_token(language):
    starts = C.item_starts(TS, language)
    assert [TS[a:].split("\n")[0][: len(w)] for a, w in zip(starts, STARTS, strict=True)] == STARTS
    chunks = C.structural_chunks(TS, language)
    assert "".join(c for _, _, c in chunks) == TS and len(chunks) == len(STARTS)


def test_elements_are_one_token():
    text = TSX.replace(" {</p>", "</p>")
    starts = C.item_starts(text, "tsx")
    assert [text[a:].split()[0] for a in starts] == ["import", "export", "function", "const"]
    assert "".join(c for _, _, c in C.structural_chunks(text, "tsx")) == text
    kinds = [(k, t) for k, t, _ in C.tokens("x = <a b={`}`}>it's {1}</a>; y = x < z;", "tsx")]
    assert ("string", "<a b={`}`}>it's {1}</a>") in kinds and ("other", "<") in kinds


@pytest.mark.parametrize("text", ["const a = `x ${ y", "const b = `", "f(<p>never closed", "const r = /[/", "return <T,>(x: T) => x;", "a = <b c=%d>", "x = ( }", "`${`${`"])
def test_odd_code_is_cut_by_lines_or_kept(text):
    for language in ("typescript", "tsx", "rust"):
        chunks = C.structural_chunks(text, language)
        assert "".join(c for _, _, c in chunks) == text


def test_divisions_are_no_regular_expressions():
    said = [(k, t) for k, t, _ in C.tokens("a / b / c; d = (e) / 2 / f[0] / g; return /x{/.y; n = /[/]/", "typescript")]
    assert [t for k, t in said if k == "string"] == ["/x{/", "/[/]/"]


def test_deep_and_broken_nesting_ends_quickly():
    for text in ("`${" * 3000, "<a>" * 3000, "`${" * 40 + "1" + "}`" * 40, "<a b=" * 2000 + ">", "x = <p>" + "{`" * 500):
        chunks = C.structural_chunks(text, "tsx")
        assert "".join(c for _, _, c in chunks) == text


def test_rows_of_a_large_batch_come_in_parts(spark):
    # Two thousand texts in one Arrow batch: a task gives out some OUT_CHARS characters at a time, not all at once.
    from pyspark.sql import functions as F

    from quillspark.operators import chunking as C

    text = ("word " * 200 + "\n\n") * 8
    docs = spark.range(2_000, numPartitions=1).select("id", F.when(F.col("id") % 100 != 7, F.concat(F.col("id").cast("string"), F.lit(" " + text))).alias("text"))
    seen = []
    frame = type("Frame", (), {"schema": docs.schema, "select": lambda self, *c: self, "withColumnRenamed": lambda self, *n: self, "mapInArrow": lambda self, run, schema: seen.append(run) or self})()
    C.chunk_code(frame, "id", "text")
    parts = list(seen[0](docs.toArrow().combine_chunks().to_batches()))
    assert len(parts) > 10 and max(sum(map(len, p.column(4).to_pylist())) for p in parts) <= C.OUT_CHARS + 4_096
    want = [(d.id, k, *r) for d in docs.collect() if d.text is not None for k, r in enumerate(C.line_chunks(d.text))]
    assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == want == [tuple(r) for r in C.chunk_code(docs, "id", "text").collect()]


def test_long_lines_are_cut_between_characters():
    from quillspark.operators.chunking import line_chunks

    line = "aé€😀" * 500
    for most in (4, 5, 7, 64, 4_096):
        want, piece = [], ""
        for c in line:
            if len((piece + c).encode()) > most:
                want.append((2, 2, piece))
                piece = ""
            piece += c
        assert line_chunks("x\n" + line, most) == [(1, 1, "x\n"), *want, (2, 2, piece)]
