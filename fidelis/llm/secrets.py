"""Secret scans in DataFrame functions only: pattern spans, and spans of high sliding-window entropy.

Pattern kinds are found leftmost and without overlap. Their places come from splitting the text at the
matches and summing lengths, so a text is scanned twice where it has a match and once where it has none. Sums
over a text's matches are taken by blocks of BLOCK, so that work grows with the matches and not with their square.

Candidate strings for the entropy kind are runs of CANDIDATE. A candidate's character class picks its
alphabet and threshold. A window of WINDOW characters slides over it: two of the alphabet's counts, held as
one digit each in a string, and the sum of c*log2(c) change with the letter that leaves and the one that enters;
the candidate counts if a window's entropy reaches the threshold. Long candidates are gone through by stretches
that overlap by a window. ALLOW patterns and spans of the other kinds suppress candidates.

No pattern has a repeated group, which the regex engine would follow by recursion, so text of any length is safe.

Offsets are code points, ends exclusive. Defined results: a null text is the empty one, with no spans;
repeated rows come back once for each row; an empty table gives none; other columns are kept by find_spans
and redact, and names that start with `__secret` are used inside and refused in the input.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns of the kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST = 6

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Class, its test, its alphabet, and the bits a window must reach; the first class that fits holds.
CLASSES = (
    ("hex", r"^[0-9A-Fa-f]+$", "0123456789abcdef", 3.0),
    ("alnum", r"^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 3.7),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-", 3.8),
)
#: Candidates that are no secrets: without a digit or without a letter, UUIDs, placeholders, dated names.
ALLOW = (
    r"^[^0-9]*$",
    r"^[^A-Za-z]*$",
    r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"(?i)example|placeholder|changeme|dummy|x{6}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}",
)
#: Paths and slugs of words with up to four digits at their ends are none either: they have all of the first
#: patterns and nothing of the last, which is a plus, more digits, a letter after a digit, or a part without letters
#: that isn't the last.
PATH_HAS = (r"^/?[A-Za-z]", r"[A-Za-z0-9][/_=-]")
PATH_LACKS = r"\+|[0-9]{5}|[0-9][A-Za-z]|[/_=-][0-9]{1,4}([_=-]|/.)"
MASK = "[REDACTED]"
#: Elements that are summed together, and characters of a stretch of text.
BLOCK, STRETCH = 64, 1024
_SPANS = "array<struct<s:bigint,k:int,e:bigint>>"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value taken once: a lambda's variable is held, an expression inside one is not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _stretches(text: Column) -> Column:
    """text in pieces of STRETCH characters."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0))


def running(values: Column, join: Callable[[Column, Column], Column], depth: int = 3) -> Column:
    """For each of an array's numbers, what join makes of it and all before it; values is a column or a lambda's variable.

    Blocks are joined within themselves, and what comes before each by the same on the blocks' totals.
    """

    def within(part: Column, first: Column) -> Column:
        start = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        step = lambda acc, x: _bind(join(acc["at"], x), lambda now: F.struct(now.alias("at"), F.array_append(acc["out"], now).alias("out")))
        return F.aggregate(part, start, step, lambda acc: acc["out"])

    zero = F.lit(0).cast("long")
    if not depth:
        return within(values, zero)
    part = lambda i: F.slice(values, i * BLOCK + 1, F.lit(BLOCK))
    numbers = F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))
    totals = F.transform(numbers, lambda i: F.aggregate(part(i), zero, lambda a, x: join(a, x)))
    long = _bind(totals, lambda t: _bind(running(t, join, depth - 1), lambda ends: F.flatten(F.transform(numbers, lambda i: within(part(i), F.coalesce(F.get(ends, i - 1), zero))))))
    return F.when(F.size(values) <= BLOCK, within(values, zero)).otherwise(long)


def _located(text: Column, pattern: str, extra: int | None = None) -> Column:
    """Array of (s, e, t, g) for each match: its place, its text, and the text of group `extra`."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit(extra)) if extra else F.array().cast("array<string>")
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("t"), group.alias("g"))

    def place(rows: Column) -> Column:
        steps = F.transform(rows, lambda x: (F.length(x["gap"]) + F.coalesce(F.length(x["t"]), F.lit(0))).cast("long"))
        ends = _bind(steps, lambda v: running(v, lambda a, b: a + b))
        return F.transform(
            F.filter(F.arrays_zip(ends.alias("e"), rows.alias("row")), lambda x: x["row"]["t"].isNotNull()),
            lambda x: F.struct((x["e"] - F.length(x["row"]["t"])).alias("s"), x["e"].alias("e"), x["row"]["t"].alias("t"), x["row"]["g"].alias("g")),
        )

    return _bind(rows, place)


def _spans(kind: str, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e")))


def window_entropy(text: Column, alphabet: str) -> Column:
    """Largest Shannon entropy, in bits, of WINDOW successive characters of text, by incremental counts.

    The counts are one string, a character for each letter of the alphabet, `0` and on.
    """
    chars = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(alphabet), c))
    weigh = lambda c: F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))
    count = lambda n, i: F.ascii(F.substring(n, i, F.lit(1))) - 48
    put = lambda n, i, c: F.overlay(n, F.char(c + 48), i)
    zero = F.struct(F.lit("0" * len(alphabet)).alias("n"), F.lit(0.0).alias("w"), F.lit(0).alias("seen"), F.lit(0.0).alias("most"))

    def step(acc: Column, x: Column) -> Column:
        def enter(was: Column) -> Column:
            c = count(was["n"], x["i"])
            return F.struct(put(was["n"], x["i"], c + 1).alias("n"), (was["w"] + weigh(c + 1) - weigh(c)).alias("w"))

        def leave() -> Column:
            c = count(acc["n"], x["o"])
            return F.struct(put(acc["n"], x["o"], c - 1).alias("n"), (acc["w"] + weigh(c - 1) - weigh(c)).alias("w"))

        before = F.when(x["o"] > 0, leave()).otherwise(F.struct(acc["n"].alias("n"), acc["w"].alias("w")))
        now = F.when(x["i"] == x["o"], F.struct(acc["n"].alias("n"), acc["w"].alias("w"))).otherwise(_bind(before, enter))
        bits = lambda w: F.when(acc["seen"] + 1 >= WINDOW, F.log2(F.lit(float(WINDOW))) - w / WINDOW).otherwise(F.lit(0.0))
        return _bind(now, lambda s: F.struct(s["n"].alias("n"), s["w"].alias("w"), (acc["seen"] + 1).alias("seen"), F.greatest(acc["most"], bits(s["w"])).alias("most")))

    def over(chars: Column) -> Column:
        gone = F.concat(F.array_repeat(F.lit(0), WINDOW), chars)
        steps = F.slice(F.arrays_zip(chars.alias("i"), gone.alias("o")), F.lit(1), F.size(chars))
        return F.aggregate(steps, zero, step, lambda acc: acc["most"])

    return _bind(chars, over)


def _reaches(word: Column, alphabet: str, least: float) -> Column:
    """Whether a window of the word reaches the entropy; stretches are tried one after another."""

    def tried(parts: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.size(parts) - 1)
        whole = lambda i: F.concat(F.get(parts, i), F.substring(F.coalesce(F.get(parts, i + 1), F.lit("")), 1, WINDOW - 1))
        return F.exists(numbers, lambda i: window_entropy(whole(i), alphabet) >= least)

    return _bind(_stretches(word), tried)


def allowed(word: Column) -> Column:
    """Whether a candidate is on the allow-list."""
    path = ~word.rlike(PATH_LACKS)
    for pattern in PATH_HAS:
        path = path & word.rlike(pattern)
    for pattern in ALLOW:
        path = path | word.rlike(pattern)
    return path


def _entropic(x: Column) -> Column:
    bits = F.lit(False)
    for name, test, alphabet, least in reversed(CLASSES):
        word = F.lower(x["t"]) if name == "hex" else x["t"]
        bits = F.when(x["t"].rlike(test), _reaches(word, alphabet, least)).otherwise(bits)
    return F.when(allowed(x["t"]), F.lit(False)).otherwise(bits)


def _meets(spans: Column, x: Column) -> Column:
    """Whether x shares a character with one of the spans, which are in order and apart: the last that starts before x's end decides."""
    start = F.struct(F.lit(0).alias("low"), F.size(spans).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["low"] + acc["high"]) / 2).cast("int")
        more = (acc["low"] < acc["high"]) & (F.get(spans, mid)["s"] < x["e"])
        return F.struct(F.when(more, mid + 1).otherwise(acc["low"]).alias("low"), F.when(more | (acc["low"] >= acc["high"]), acc["high"]).otherwise(mid).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"))
    return F.aggregate(steps, start, halve, lambda acc: F.coalesce(F.get(spans, acc["low"] - 1)["e"] > x["s"], F.lit(False)))


def find_spans(docs: DataFrame, to: str = "spans") -> DataFrame:
    """docs with an array of (s, k, e) in `to`: start, kind as listed, end; in that order."""
    if held := [c for c in docs.columns if c.lower().startswith("__secret")]:
        raise ValueError(f"columns {held} are used inside")
    text, none = F.col("__secret_text"), F.array().cast(_SPANS)
    docs = docs.withColumn("__secret_text", F.coalesce(F.col("text"), F.lit("")))
    named = F.filter(_located(text, ASSIGN, 2), lambda x: F.length(x["g"]) >= ASSIGN_LEAST)
    docs = docs.withColumns({
        "__secret_assign": F.when(text.rlike(ASSIGN), _spans("assign", named)).otherwise(none),
        "__secret_access": F.when(text.rlike(ACCESS), _spans("access", _located(text, ACCESS))).otherwise(none),
        "__secret_hex": F.when(text.rlike(HEX), _spans("hex", _located(text, HEX))).otherwise(none),
        "__secret_candidates": F.when(text.rlike(CANDIDATE), _located(text, CANDIDATE)),
    })
    # A candidate is a whole run of letters that hold those of the access and hex kinds, so it meets such a span if it has one.
    apart = lambda x: ~(x["t"].rlike(ACCESS) | x["t"].rlike(HEX)) & F.when(F.size("__secret_assign") > 0, ~_meets(F.col("__secret_assign"), x)).otherwise(F.lit(True))
    high = F.filter(F.filter("__secret_candidates", apart), _entropic)
    docs = docs.withColumn("__secret_high", F.when(F.size("__secret_candidates") > 0, _spans("entropy", high)).otherwise(none))
    docs = docs.withColumn(to, F.sort_array(F.concat("__secret_assign", "__secret_access", "__secret_hex", "__secret_high")))
    return docs.drop("__secret_text", "__secret_assign", "__secret_access", "__secret_hex", "__secret_candidates", "__secret_high")


def _named(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """Per document: numbers of spans of each base kind, the base spans' digest, all spans, and the number of entropy spans."""
    found = find_spans(docs.select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["k"] == KINDS.index(kind))).cast("long")
    base = F.filter("spans", lambda x: x["k"] < KINDS.index("entropy"))
    return found.select(
        "doc_id", *(n(kind).alias(f"n_{kind}") for kind in KINDS[:-1]), F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"), n(KINDS[-1]).alias(f"n_{KINDS[-1]}"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of `text` replaced by MASK, overlapping ones by one; n_chars, if present, follows.

    What stays is the stretch from the end of all spans so far to the next span; each is cut from the pieces it lies in.
    """
    found = find_spans(docs, "__secret_spans")
    text, spans = F.col("text"), F.col("__secret_spans")

    def between(parts: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / STRETCH).cast("int"), F.floor((b - 1) / STRETCH).cast("int")
        return F.substring(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), (a - first * STRETCH + 1).cast("int"), (b - a).cast("int"))

    def masked(parts: Column) -> Column:
        ends = _bind(F.transform(spans, lambda x: x["e"]), lambda v: running(v, F.greatest))
        marks = F.arrays_zip(F.concat(F.array(F.lit(0).cast("long")), ends).alias("a"), F.concat(F.transform(spans, lambda x: x["s"]), F.array(F.length(text).cast("long"))).alias("b"))
        # A mask stands before each stretch that stays; the first stretch has none.
        kept = lambda x, i: F.concat(F.when(i > 0, F.lit(MASK)).otherwise(F.lit("")), F.when(x["a"] < x["b"], between(parts, x["a"], x["b"])).otherwise(F.lit("")))
        return F.array_join(F.filter(F.transform(marks, lambda x, i: F.when(x["a"] <= x["b"], kept(x, i))), lambda p: p.isNotNull()), "")

    out = found.withColumn("text", F.when(F.size(spans) > 0, _bind(_stretches(text), masked)).otherwise(text)).drop("__secret_spans")
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
