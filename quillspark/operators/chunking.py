"""Chunkers, packers and segmenters: sequential state within one text, so they run row by row inside Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspark.operators.tokenizers import Encode, json_tokens, tokenizer_of, word_tokens

MOST_CODE_BYTES, MOST_CODE_LINES, MOST_CODE_CHUNKS = 4096, 200, 4096
MOST_SEGMENT_CHARS = 8000
BATCH_ITEMS, BATCH_CHARS = 32, 64_000
#: Characters of rows that a task collects before it gives them out.
OUT_CHARS = 1 << 20
REQUEST_ITEMS, REQUEST_BYTES = 32, 1 << 20


@dataclass(frozen=True)
class ChunkBudget:
    """Characters (or tokens, by a tokenizer's name) of a chunk, and how many it repeats of the one before."""

    most: int = 1200
    overlap: int = 200
    unit: str = "chars"
    tokenizer: str = "words"

    @property
    def clamped(self) -> tuple[int, int]:
        most = max(1, self.most)
        return most, max(0, min(self.overlap, most - 1))

    @property
    def identity(self) -> str:
        """What chunks made with this budget are pinned to."""
        return ":".join([self.unit, *[self.tokenizer] * (self.unit != "chars"), str(self.most), str(self.overlap)])

    @classmethod
    def parse(cls, identity: str) -> ChunkBudget:
        """The budget of an identity; anything else is an error."""
        m = re.fullmatch(r"(?:(chars)|(tokens|tokens_v2):([\w./@-]+)):([1-9][0-9]*):([0-9]+)", identity)
        if not m or int(m[5]) >= int(m[4]):
            raise ValueError(f"not a chunk budget: {identity!r}")
        return cls(int(m[4]), int(m[5]), m[1] or m[2], m[3] or "words")


def char_chunks(text: str, budget: ChunkBudget = ChunkBudget()) -> list[str]:
    """Paragraphs packed up to the budget; after a chunk the next begins with its last characters."""
    most, overlap = budget.clamped
    out: list[str] = []
    current, fresh = "", False  # fresh: current holds more than the overlap

    def emit() -> str:
        out.append(current)
        return current[max(0, len(current) - overlap) :] if overlap else ""

    for paragraph in filter(None, (p.strip() for p in text.split("\n\n"))):
        rest = paragraph
        if fresh and len(current) + 2 + len(rest) <= most:
            current += "\n\n" + rest
            continue
        if fresh:
            current = emit()
            rest = ("\n\n" if current else "") + rest
        while rest:
            room = most - len(current)
            current, rest, fresh = current + rest[:room], rest[room:], True
            if rest:
                current, fresh = emit(), False
    if fresh:
        out.append(current)
    return out


#: Bytes of text that a token of the budget may have in a window, and more; how often a content is shortened, and a repeated end halved.
WINDOW_BYTES, WINDOW_MORE, SHORTENINGS, HALVINGS = 8, 32, 4, 8


def _last_tokens(text: str, encode: Encode, most: int) -> str:
    """The end of a text that has at most so many tokens when encoded alone; empty if no cut tried does."""
    spans = encode(text) if text and most else []
    if len(spans) <= most:
        return text if most else ""
    take = most
    for _ in range(HALVINGS):
        if not take:
            break
        if len(encode(piece := text[spans[-take][0] :])) <= most:
            return piece
        take //= 2
    return ""


def _first_tokens(window: str, encode: Encode, most: int, bounded: bool) -> str | None:
    """The beginning of a window that has at most so many tokens when encoded alone: from ``most`` tokens on down one by one, or only the first of most, 3/4, 1/2, 1/4 of it and 1 that
    fits. None if there is none."""
    spans = encode(window)
    if len(spans) <= most:
        return window
    for take in dict.fromkeys((most, most * 3 // 4, most // 2, most // 4, 1) if bounded else range(most, 0, -1)):
        if take and (end := spans[take - 1][1]) and len(encode(window[:end])) <= most:
            return window[:end]
    return None


def window_chunks(text: str, encode: Encode, budget: ChunkBudget, bounded: bool = False) -> list[str]:
    """Chunks of at most ``most`` tokens each, encoded alone: the last ``overlap`` tokens of the content before, and the next content.

    Paragraphs are stripped, empty ones dropped. Content is the beginning of a window of WINDOW_BYTES bytes for each token of the budget, up to the last paragraph break in
    it if the window goes on. It is counted again with the overlap before it, and shortened by a token up to SHORTENINGS times. Where not even a character fits beside the overlap,
    the overlap gives way. An error if a character alone exceeds the budget, or shortening doesn't help. The contents join to the paragraphs.
    """
    most, overlap = budget.clamped
    body = "\n\n".join(filter(None, (p.strip() for p in text.split("\n\n"))))
    out, at, filled, repeated = [], 0, 0, ""
    while at < len(body):
        limit = max(1, most - len(encode(repeated)))
        room = WINDOW_BYTES * limit + WINDOW_MORE
        end = min(len(body), at + room)
        if len(body[at:end].encode()) > room:
            end = at + len(body[at:end].encode()[:room].decode("utf-8", "ignore"))
        if end < len(body) and body[end - 1 : end + 1] == "\n\n":
            end -= 1  # a break isn't parted
        filled = max(filled, end)
        window, steps = body[at:filled], 0
        while True:
            prefix = _first_tokens(window, encode, limit, bounded)
            if prefix is None:
                alone = len(encode(window[0]))
                if alone > most:
                    raise ValueError(f"the character {window[0]!r} has {alone} tokens, the budget is {most}")
                repeated = _last_tokens(repeated, encode, most - alone)
                limit = max(1, most - len(encode(repeated)))
            else:
                cut = len(prefix) if len(prefix) == len(window) else found if (found := prefix.rfind("\n\n")) > 0 else len(prefix)
                if len(encode(repeated + window[:cut])) <= most:
                    break
                limit = max(1, limit - 1)
            steps += 1
            if steps > SHORTENINGS:
                if not repeated:
                    raise ValueError(f"no chunk of {most} tokens can be cut")
                repeated, steps, limit = "", 0, most  # better no overlap than no chunk
        out.append(repeated + window[:cut])
        repeated = _last_tokens(window[:cut], encode, overlap)
        at += cut
    return out


def token_chunks(text: str, encode: Encode, budget: ChunkBudget) -> list[str]:
    return window_chunks(text, encode, budget)


def bounded_chunks(text: str, encode: Encode, budget: ChunkBudget) -> list[str]:
    return window_chunks(text, encode, budget, bounded=True)


@lru_cache(4)
def file_tokens(path: str) -> Encode:
    """The tokenizer of a JSON file of the tokenizers library; the file must be at that path on every executor."""
    return json_tokens(Path(path).read_bytes())


def lines_of(text: str) -> list[str]:
    """Lines with their newlines; no other character ends a line."""
    return re.findall(r"[^\n]*\n|[^\n]+", text)


def line_chunks(text: str, most_bytes: int = MOST_CODE_BYTES, most_lines: int = MOST_CODE_LINES) -> list[tuple[int, int, str]]:
    """(first line, last line, text), 1-based; the texts join to the source. A longer line is cut between characters."""
    out: list[tuple[int, int, str]] = []
    held, size, first = [], 0, 1
    for number, line in enumerate(lines_of(text), 1):
        n = len(line.encode())
        if held and (size + n > most_bytes or len(held) == most_lines):
            out.append((first, number - 1, "".join(held)))
            held, size = [], 0
        if n > most_bytes:
            raw, at = line.encode(), 0
            while len(raw) - at > most_bytes:
                end = at + most_bytes
                while end > at and raw[end] & 0xC0 == 0x80:
                    end -= 1
                if end == at:  # the character alone is longer
                    end = next((i for i in range(at + 1, len(raw)) if raw[i] & 0xC0 != 0x80), len(raw))
                out.append((number, number, raw[at:end].decode()))
                at = end
            piece = raw[at:].decode()
            if piece:
                out.append((number, number, piece))
            continue
        if not held:
            first = number
        held.append(line)
        size += n
    if held:
        out.append((first, first + len(held) - 1, "".join(held)))
    return out


_STRUCTURE = r"""(?P<comment>//[^\n]*|/\*.*?\*/|\A\#!(?!\[)[^\n]*)|(?P<string>%s"(?:[^"\\]|\\.)*"|%s)
|(?P<mark>\#!?(?=\[)|@[\w.$]+)|(?P<word>\w+)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<other>[^\s])"""
_SYNTAX = {
    "rust": re.compile(_STRUCTURE % (r"""b?r(?P<bars>\#*)".*?"(?P=bars)|""", r"""b?'(?:\\[^'\n]+|[^'\\\n])'"""), re.S | re.X),
    "typescript": re.compile(_STRUCTURE % ("", r"""'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`"""), re.S | re.X),
}
_SYNTAX["tsx"] = _SYNTAX["typescript"]
_PAIRS = {")": "(", "]": "[", "}": "{"}
#: Words of a head that make the item end with its braces; other items end with a semicolon, in TypeScript also before a line that
#: begins with one of these or of _HEADS.
_BODIED = frozenset("fn struct enum union trait impl mod macro_rules function class interface namespace".split())
_HEADS = _BODIED | frozenset("import export const let var type declare abstract async".split())


#: Words after which an operand comes, so that a slash begins a regular expression and a less-than sign an element.
_BEFORE_OPERAND = frozenset("return typeof case in of delete void throw new do else await yield default extends".split())
_PATTERN = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/\w*")
_TAG, _END_TAG = re.compile(r"<(?:[A-Za-z][\w.:-]*|(?=>))"), re.compile(r"</\s*[\w.:-]*\s*>")


class Unclosed(ValueError):
    """A template, a hole in one, or an element that the text doesn't close."""


def tokens(text: str, language: str, at: int = 0) -> Iterator[tuple[str, str, int]]:
    """Kind, text and place of the tokens from a place on. In TypeScript, a template with all that its ``${}`` hold, a regular expression and, in tsx, an element with all its
    children is one string each; their holes are read by the same rules, however deep."""
    pattern, before, word = _SYNTAX[language], "", ""  # the last token that is no comment
    if language == "rust":  # it has no modes
        for found in pattern.finditer(text, at):
            kind = found.lastgroup
            yield "string" if kind == "bars" else kind, found[0], found.start()
        return
    while found := pattern.search(text, at):
        begin, end = found.start(), None
        operand = before in ("", "open", "mark", "other") or before == "word" and word in _BEFORE_OPERAND
        c = text[begin]
        if c == "`":
            end = _template_end(text, begin, language)
        elif c == "/" and operand and text[begin + 1 : begin + 2] not in ("/", "*"):
            end = m.end() if (m := _PATTERN.match(text, begin)) else None
        elif c == "<" and operand and language == "tsx":
            end = _element_end(text, begin)
        if end is not None:
            kind, token = "string", text[begin:end]
        else:
            kind, token, end = found.lastgroup, found[0], found.end()
        yield kind, token, begin
        at = end
        if kind != "comment":
            before, word = kind, token


def _hole_end(text: str, at: int, language: str) -> int:
    """Behind the brace that closes the one before ``at``."""
    depth = 0
    for kind, token, begin in tokens(text, language, at):
        if kind == "open":
            depth += 1
        elif kind == "close":
            if not depth:
                if token != "}":
                    raise Unclosed
                return begin + 1
            depth -= 1
    raise Unclosed


def _template_end(text: str, at: int, language: str) -> int:
    i = at + 1
    while i < len(text):
        if text[i] == "`":
            return i + 1
        if text.startswith("${", i):
            i = _hole_end(text, i + 2, language)
        else:
            i += 2 if text[i] == "\\" else 1
    raise Unclosed


def _element_end(text: str, at: int) -> int | None:
    """Behind the element that begins here, its children included; None if it is none."""
    tag = _TAG.match(text, at)
    if not tag:
        return None
    i = tag.end()
    while i < len(text) and text[i] != ">":  # attributes
        if text.startswith("/>", i):
            return i + 2
        if text[i] == "{":
            i = _hole_end(text, i + 1, "tsx")
        elif text[i] in "\"'":
            i = text.find(text[i], i + 1) + 1
            if not i:
                raise Unclosed
        elif text[i].isspace() or text[i].isalnum() or text[i] in "_$.:=-":
            i += 1
        else:
            return None
    i += 1
    while i < len(text):  # children
        if end := _END_TAG.match(text, i):
            return end.end()
        if text[i] == "<":
            i = _element_end(text, i)
            if i is None:
                return None
        else:
            i = _hole_end(text, i + 1, "tsx") if text[i] == "{" else i + 1
    raise Unclosed


def _first_of_line(text: str, place: int) -> bool:
    return not text[text.rfind("\n", 0, place) + 1 : place].strip()


def item_starts(text: str, language: str) -> list[int] | None:
    """Where the lines of top-level items begin, the comments, attributes and decorators before an item included; the first is 0. None
    if brackets don't pair or there are too many items. Tokens are read in their modes (templates, regular expressions, elements); items are told by their heads and
    brackets, not by a whole grammar."""
    starts, stack = [0], []
    lead: int | None = None  # where comments and attributes that belong to the next item begin
    inside = mark = bodied = head = False
    seen, last = 0, ""
    for kind, token, place in tokens(text, language):
        if inside and not stack and language != "rust" and _first_of_line(text, place) and (token in _HEADS or kind == "mark") and last not in (",", "=", ":", "|", "&", "(", "."):
            inside = False
        if kind == "comment":
            if not stack and lead is None and (not inside or _first_of_line(text, place)):
                lead = place
            continue
        if not inside and not mark:
            if kind == "mark":
                lead, mark = place if lead is None else lead, True
                last = token
                continue
            begin = text.rfind("\n", 0, place if lead is None else lead) + 1
            if seen and begin > starts[-1]:
                starts.append(begin)
            seen, inside, bodied, head, lead = seen + 1, True, False, True, None
        elif mark and not stack and kind not in ("open", "close"):  # a decorator without arguments
            mark = False
            begin = text.rfind("\n", 0, lead) + 1
            if seen and begin > starts[-1]:
                starts.append(begin)
            seen, inside, bodied, head, lead = seen + 1, True, False, True, None
        elif inside:
            lead = None
        if head and not stack:
            bodied = bodied or token in _BODIED or (language == "rust" and token == "!")
            head = token not in ("{", "=", ";")
        if kind == "open":
            stack.append(token)
        elif kind == "close":
            if not stack or stack.pop() != _PAIRS[token]:
                return None
            if not stack and mark:
                mark = False
            elif not stack and token == "}" and bodied:
                inside = False
        elif token == ";" and not stack:
            inside = False
        last = token
    return starts if not stack and len(starts) <= MOST_CODE_CHUNKS else None


def structural_chunks(text: str, language: str, most_bytes: int = MOST_CODE_BYTES, most_lines: int = MOST_CODE_LINES) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of each top-level item, larger ones cut like line_chunks; other languages and texts whose brackets
    don't pair are cut by lines."""
    try:
        starts = item_starts(text, language) if text and language in _SYNTAX else None
    except (Unclosed, RecursionError):
        starts = None
    if starts is None:
        return line_chunks(text, most_bytes, most_lines)
    out, line = [], 1
    for a, b in zip(starts, [*starts[1:], len(text)]):
        own = text[a:b]
        n = len(lines_of(own))
        whole = n <= most_lines and len(own.encode()) <= most_bytes
        out += [(line, line + n - 1, own)] if whole else [(line + s - 1, line + e - 1, c) for s, e, c in line_chunks(own, most_bytes, most_lines)]
        line += n
    return out


def segments(body: str) -> list[tuple[str, str, str, bool]]:
    """(id, text, suffix, translatable): paragraphs are translatable; blank lines and fenced code aren't. text + suffix join to the body."""
    blocks: list[tuple[str, bool]] = []
    fenced = False
    for line in lines_of(body):
        fence = line.lstrip().startswith("```")
        translatable = not (fenced or fence) and bool(line.strip())
        fenced = fenced != fence
        if blocks and translatable and blocks[-1][1]:
            blocks[-1] = (blocks[-1][0] + line, True)
        else:
            blocks.append((line, translatable))
    out = []
    for text, translatable in blocks:
        core = text.rstrip("\n") if translatable else text
        suffix = text[len(core) :]
        parts = [core[i : i + MOST_SEGMENT_CHARS] for i in range(0, len(core), MOST_SEGMENT_CHARS)] or [""]
        out += [(f"body:{len(out) + k:06d}", p, suffix if k == len(parts) - 1 else "", translatable) for k, p in enumerate(parts)]
    return out


class Packer:
    """Batch numbers of one sequence of items after another; holds the open batch's counts alone."""

    def __init__(self, most_items: int, most_size: int):
        self.most_items, self.most_size = most_items, most_size
        self.begin()

    def begin(self) -> None:
        self.batch, self.items, self.total = 0, 0, 0

    def put(self, size: int) -> int:
        """The item's batch; one larger than a batch is alone."""
        if self.items and (self.items == self.most_items or self.total + size > self.most_size):
            self.batch, self.items, self.total = self.batch + 1, 0, 0
        self.items, self.total = self.items + 1, self.total + size
        return self.batch


def greedy_batches(sizes: Iterable[int], most_items: int, most_size: int) -> list[int]:
    packer = Packer(most_items, most_size)
    return list(map(packer.put, sizes))


def _per_row(df: DataFrame, id_col: str, text_col: str, schema: str, rows: Callable[[str], list[tuple]]) -> DataFrame:
    """Rows of each text. A task holds one text's rows and some OUT_CHARS characters of others', however many texts come at once."""
    kind = df.schema[id_col].dataType.simpleString()
    fields = [c.split() for c in schema.split(", ")]
    types = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            own, out, size = [], [], 0

            def made() -> pa.RecordBatch:
                places, numbers = zip(*own)
                columns = [pa.array([r[i] for r in out], types[t]) for i, (_, t) in enumerate(fields)]
                return pa.RecordBatch.from_arrays([keys.take(pa.array(places, pa.int64())), pa.array(numbers, pa.int32()), *columns], names=["id", "chunk_index", *(c for c, _ in fields)])

            for i in range(len(texts)):
                if (text := texts[i].as_py()) is None:
                    continue
                for k, r in enumerate(rows(text)):
                    own.append((i, k))
                    out.append(r)
                    size += 100 + sum(len(v) for v in r if isinstance(v, str))
                    if size > OUT_CHARS:
                        yield made()
                        own, out, size = [], [], 0
            if own:
                yield made()

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, chunk_index int, {schema}").withColumnRenamed("id", id_col)


def chunk_text(df: DataFrame, id_col: str, text_col: str, budget: ChunkBudget = ChunkBudget(), artifacts: str | None = None) -> DataFrame:
    """Chunks by characters, or by tokens (tokens_v2: by the bounded cut) of a tokenizer by its name, a pinned one's file being in the folder ``artifacts``, or of a
    tokenizer file by its path. A null text has none."""

    def cut(text: str) -> list[str]:
        if budget.unit == "chars":
            return char_chunks(text, budget)
        encode = file_tokens(budget.tokenizer) if "/" in budget.tokenizer else tokenizer_of(budget.tokenizer, artifacts)
        return (bounded_chunks if budget.unit == "tokens_v2" else token_chunks)(text, encode, budget)

    return _per_row(df, id_col, text_col, "chunk_text string", lambda t: [(c,) for c in cut(t)])


def chunk_code(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _per_row(df, id_col, text_col, "start_line int, end_line int, chunk_text string", line_chunks)


def chunk_structure(df: DataFrame, id_col: str, text_col: str, language: str) -> DataFrame:
    return _per_row(df, id_col, text_col, "start_line int, end_line int, chunk_text string", lambda t: structural_chunks(t, language))


def segment(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return _per_row(df, id_col, text_col, "segment_id string, segment_text string, suffix string, translatable boolean", segments)


def plan_batches(df: DataFrame, key: list[str], order: list[str], text_col: str, requests: bool = False) -> DataFrame:
    """batch_id of each row within its key: 32 rows and 64 000 characters at most, or for requests 32 and 1 MiB of JSON.

    Sizes are computed before the shuffle, so no text moves; a key's rows pass one task in order, which holds the open batch's counts alone. A request
    that no batch can take has no batch_id and the error "oversize", and the others are packed as if it weren't there; without
    ``requests`` it is alone. A null text has size 0 (as a request, 4).
    """
    text = F.col(text_col)
    as_json = F.octet_length(F.to_json(F.struct(F.coalesce(text, F.lit("")).alias("t")))) - len('{"t":}')
    size = (F.when(text.isNull(), 4).otherwise(as_json) if requests else F.coalesce(F.length(text), F.lit(0))).cast("long")
    most_items, most_size = (REQUEST_ITEMS, REQUEST_BYTES) if requests else (BATCH_ITEMS, BATCH_CHARS)
    kept = df.select(*dict.fromkeys([*key, *order]), size.alias("_size"))
    ordered = kept.repartition(*key).sortWithinPartitions(*key, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, own = Packer(most_items, most_size), object()
        for batch in batches:
            out = []
            for mine, n in zip(zip(*(batch.column(c).to_pylist() for c in key), strict=True), batch.column("_size").to_pylist(), strict=True):
                if mine != own:
                    own = mine
                    packer.begin()
                out.append(None if requests and n > most_size else packer.put(n))
            error = pa.array(["oversize" if b is None else None for b in out], pa.string())
            names = [c for c in batch.schema.names if c != "_size"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.int64()), error], names=[*names, "batch_id", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.drop("_size").schema) + ", batch_id long, error string"
    return ordered.mapInArrow(run, schema)
