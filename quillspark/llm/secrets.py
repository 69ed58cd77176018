"""Secret scan with DataFrame functions only: patterns, and sliding-window Shannon entropy per character class.

Three patterns give spans of kinds assign, access and hex. Beyond them, every run of CANDIDATE characters is a candidate. A
window of WINDOW characters slides over it. For each class (CLASSES: lower, upper, digit, symbol, and hex, which overlaps
them) the entropy of the window's characters of that class, log2(n) - sum(c * log2(c)) / n over their counts c, is kept by
incremental counts: a step takes one character out and one in. The counts are packed into a few integers, so a step costs
the same whatever the alphabet. The run is a secret (kind entropy) if some window is all hex digits with HEX_BITS of
entropy, or has MIXED_BITS over all its characters and reaches the limits of two classes at least; unless an allow-list
rule suppresses it. Candidates that overlap a pattern span are left to that span.

Positions come from split(): the pieces between matches and the matches themselves alternate, so running sums of their
lengths are the offsets, in code points. They are summed in blocks of the square root of their number, as arrays grow
by copying. The whole scan is one stage without a shuffle or Python. Logarithms are whole numbers of SCALE parts, so that
sums are exact whatever their order.

Defined results: a null text counts as empty; a text without secrets has no spans and the hash of the empty string.
Texts of any length are scanned whole. Repeated rows each get a row; other columns of df are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

# The patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
#: A run of the class that is long enough; equal to taking all runs and dropping the short ones.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")

WINDOW = 20
SCALE = 1 << 32
#: Classes in the order of their bits, and the least entropy and count in a window at which a class counts.
CLASSES = ("lower", "upper", "digit", "symbol", "hex")
LIMITS = {"lower": (2.0, 5), "upper": (2.0, 5), "digit": (1.5, 3), "symbol": (0.9, 2)}
#: Least entropy in bits a character of a window of hex digits, and of any other window as a whole.
HEX_BITS, MIXED_BITS = 3.0, 3.7
#: Allow-list: letters only, digits only, UUIDs, digests named as such, one character repeated, paths of words, placeholders.
ALLOWED = (
    r"^[A-Za-z]+$|^[0-9]+$|^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$|^(?:sha1|sha256|sha512|md5)-"
    r"|^(.)\1*$|^[/_-]*[A-Za-z]+(?:[/_-]+[A-Za-z]+)+[/_=-]*$|(?i:example|sample|placeholder|xxxx|changeme|dummy)"
)
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
#: Counts of a window in one integer, of BITS bits each.
BITS, PACKED = 5, 12
#: c * log2(c) in parts of SCALE, for every count a window can hold.
C_LOG_C = [0] + [round(c * math.log2(c) * SCALE) for c in range(1, WINDOW + 1)]

SPAN = "array<struct<start:bigint,stop:bigint,kind:int,value:string>>"


def classes_of(c: str) -> int:
    """Bits of the classes of a character of the alphabet."""
    one = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    return 1 << one | (16 if c in "0123456789abcdefABCDEF" else 0)


def _let(value: Column, f) -> Column:
    """f of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _in_blocks(items: Column, first: Column, size, step) -> Column:
    """What step(position, item) says of each item, position being first plus the sizes of the items before. In two levels of blocks."""
    n = F.size(items)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))

    def of_block(begin: Column, block: Column) -> Column:
        empty = F.struct(begin.alias("at"), F.slice(F.transform(items, lambda x: step(begin, x)), 1, 0).alias("out"))
        return F.aggregate(block, empty, lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.concat(acc["out"], F.array(step(acc["at"], x))).alias("out")), lambda acc: acc["out"])

    def of_blocks(width: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(n / width).cast("int") - 1), lambda k: F.slice(items, k * width + 1, width))
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0).cast("bigint"), lambda a, x: a + size(x)))
        start = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        begins = F.aggregate(sums, start, lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        return F.flatten(F.zip_with(begins, blocks, of_block))

    return _let(width, of_blocks)


def _spans(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """All leftmost non-overlapping matches as structs; value is the given group."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    between = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("bigint"))
    lengths = F.transform(whole, lambda x: F.length(x).cast("bigint"))
    zipped = F.arrays_zip(lengths.alias("size"), F.slice(between, F.lit(1), F.size(lengths)).alias("gap"), values.alias("value"))

    def one(at: Column, x: Column) -> Column:
        return F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("stop"), F.lit(kind).alias("kind"), x["value"].alias("value"))

    found = _let(zipped, lambda items: _in_blocks(items, F.lit(0).cast("bigint"), lambda x: x["gap"] + x["size"], one))
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def _by_code(f, kind: str) -> Column:
    """f(place, character) for each character of the alphabet, to be looked up by its ASCII code."""
    table = {ord(c): f(k, c) for k, c in enumerate(ALPHABET)}
    return F.array(*[F.lit(table.get(i)) for i in range(128)]).cast(f"array<{kind}>")


def is_random(value: Column) -> Column:
    """Whether some WINDOW-character window of value reaches the limits.

    The state holds the packed counts of the alphabet's characters, and each class's count n and sum s of c * log2(c) over the
    counts; a step moves one character in and one out. A class's entropy is log2(n) - s / n.
    """
    word, unit = _by_code(lambda k, c: k // PACKED, "int"), _by_code(lambda k, c: 1 << BITS * (k % PACKED), "bigint")
    shift, bits = _by_code(lambda k, c: BITS * (k % PACKED), "int"), _by_code(lambda k, c: [classes_of(c) >> j & 1 for j in range(len(CLASSES))], "array<bigint>")
    term = F.array(*[F.lit(x) for x in C_LOG_C]).cast("array<bigint>")
    zeros = lambda n: F.array_repeat(F.lit(0).cast("bigint"), n)
    described = F.transform(
        F.transform(F.split(value, ""), F.ascii),
        lambda c: F.struct(F.get(word, c).alias("word"), F.get(unit, c).alias("unit"), F.get(shift, c).alias("shift"), F.get(bits, c).alias("bits")),
    )
    nothing = F.array_repeat(F.lit(None).cast("struct<word:int,unit:bigint,shift:int,bits:array<bigint>>"), WINDOW)
    moves = _let(described, lambda d: F.arrays_zip(d.alias("new"), F.slice(F.concat(nothing, d), F.lit(1), F.size(d)).alias("old")))
    start = F.struct(zeros(-(-len(ALPHABET) // PACKED)).alias("counts"), zeros(len(CLASSES)).alias("n"), zeros(len(CLASSES)).alias("s"), F.lit(False).alias("ok"))

    def count(acc: Column, at: Column) -> Column:
        return F.call_function("shiftright", F.get(acc["counts"], at["word"]), at["shift"]).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def step(acc: Column, move: Column) -> Column:
        new, old = move["new"], move["old"]
        same = F.coalesce((new["word"] == old["word"]) & (new["shift"] == old["shift"]), F.lit(False)).cast("int")
        seen = F.struct((count(acc, new) - same).alias("new"), count(acc, old).alias("old"))  # the old one goes first

        def moved(k: Column) -> Column:
            gain, loss = F.get(term, k["new"] + 1) - F.get(term, k["new"]), F.get(term, k["old"] - 1) - F.get(term, k["old"])
            place = lambda at, j: F.when(j == at["word"], at["unit"]).otherwise(0)
            return F.struct(
                F.transform(acc["counts"], lambda x, j: x + place(new, j) - place(old, j)).alias("counts"),
                F.transform(acc["n"], lambda x, j: x + F.get(new["bits"], j) - F.coalesce(F.get(old["bits"], j), F.lit(0))).alias("n"),
                F.transform(acc["s"], lambda x, j: x + F.get(new["bits"], j) * gain + F.coalesce(F.get(old["bits"], j) * loss, F.lit(0))).alias("s"),
            )

        return _let(seen, lambda k: _let(moved(k), lambda m: F.struct(m["counts"].alias("counts"), m["n"].alias("n"), m["s"].alias("s"), (acc["ok"] | reached(m["n"], m["s"])).alias("ok"))))

    def reached(n: Column, s: Column) -> Column:
        of = lambda x, j: F.get(x, F.lit(j))
        whole = lambda x: of(x, 0) + of(x, 1) + of(x, 2) + of(x, 3)
        good = [
            ((of(n, j) >= least) & (F.get(term, of(n, j).cast("int")) - of(s, j) >= of(n, j) * round(limit * SCALE))).cast("int")
            for j, (limit, least) in ((CLASSES.index(c), x) for c, x in LIMITS.items())
        ]
        is_hex = (of(n, CLASSES.index("hex")) == WINDOW) & (C_LOG_C[WINDOW] - of(s, CLASSES.index("hex")) >= round(HEX_BITS * WINDOW * SCALE))
        is_mixed = (C_LOG_C[WINDOW] - whole(s) >= round(MIXED_BITS * WINDOW * SCALE)) & (sum(good[1:], good[0]) >= 2)
        return (whole(n) == WINDOW) & (is_hex | is_mixed)

    return F.aggregate(moves, start, step, lambda acc: acc["ok"])


def _grouped(spans: Column) -> Column:
    """Blocks of sorted spans, each with its least start and largest stop, so that few are looked into for an overlap."""
    n = F.size(spans)
    width = F.greatest(F.lit(1), F.ceil(F.sqrt(n.cast("double"))).cast("int"))
    blocks = _let(width, lambda w: F.transform(F.sequence(F.lit(0), F.ceil(n / w).cast("int") - 1), lambda k: F.slice(spans, k * w + 1, w)))
    summed = F.transform(
        blocks, lambda b: F.struct(F.array_min(F.transform(b, lambda x: x["start"])).alias("start"), F.array_max(F.transform(b, lambda x: x["stop"])).alias("stop"), b.alias("own"))
    )
    return F.when(n > 0, summed).otherwise(F.array().cast(f"array<struct<start:bigint,stop:bigint,own:{SPAN}>>"))


def secret_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans (array of start, stop, kind, value), ordered by start and then kind, for each row of df."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = F.concat(
        F.filter(_spans(text, ASSIGN, 0, 2), lambda s: F.length(s["value"]) >= ASSIGN_LEAST),
        _spans(text, ACCESS, 1),
        _spans(text, HEX, 2),
    )
    found = df.select(F.col(id_col).alias("id"), F.sort_array(base).alias("base"), _spans(text, CANDIDATE, 3).alias("candidate"))
    overlaps = lambda a, b: (a["start"] < b["stop"]) & (b["start"] < a["stop"])
    free = _let(
        _grouped(F.col("base")),
        lambda blocks: F.filter(
            F.filter(F.col("candidate"), lambda c: ~c["value"].rlike(ALLOWED)),
            lambda c: ~F.exists(blocks, lambda b: overlaps(b, c) & F.exists(b["own"], lambda x: overlaps(x, c))),
        ),
    )
    extra = F.when(F.size("candidate") > 0, F.filter(free, lambda c: is_random(c["value"]))).otherwise(F.array().cast(SPAN))
    ordered = F.sort_array(F.transform(F.concat(F.col("base"), extra), lambda s: F.struct(s["start"], s["kind"], s["stop"], s["value"])))
    spans = F.transform(
        ordered, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value"))
    )
    return found.select(F.col("id").alias(id_col), spans.alias("spans"))


def secret_digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of secret_spans' rows."""
    named = F.array(*[F.lit(k) for k in KINDS])
    said = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(named, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        id_col,
        *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)],
        F.sha2(said(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
        count(3).alias("n_entropy"),
    )
