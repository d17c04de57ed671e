"""Secrets in texts: fixed shapes, and runs of characters that only chance would write.

A run's encoding is inferred from its characters. Three tests ask whether it looks drawn at random
from that alphabet: chi-squared uniformity, runs above and below the alphabet's middle, and serial
correlation; Fisher's method joins them. A run that passes is a discovery if ordinary text would
hardly change its kind of character as often: the corpus's own rate of changes bounds that
probability (Chernoff), and Benjamini and Hochberg's procedure, by encoding and length, bounds the
share of false discoveries. Everything is DataFrame expressions; only counts by encoding, length
and probability are shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from patchwell.llm.common import written

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
#: A greedy run of 16 or more is what ``[0-9a-f]+`` finds, less its shorter matches.
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

DIGITS, SMALL = "0123456789", "abcdefghijklmnopqrstuvwxyz"
CAPITAL = SMALL.upper()


@dataclass(frozen=True)
class Encoding:
    """``alphabet`` is what runs are made of, in small letters if ``folded``."""

    name: str
    pattern: str
    alphabet: str
    folded: bool = False


#: The first that fits is a run's encoding.
ENCODINGS = (
    Encoding("decimal", r"\A[0-9]+\z", DIGITS),
    Encoding("hex", r"\A(?:[0-9a-f]+|[0-9A-F]+)\z", DIGITS + "abcdef", True),
    Encoding("base32", r"\A[A-Z2-7]+\z", CAPITAL + "234567"),
    Encoding("base36", r"\A(?:[0-9a-z]+|[0-9A-Z]+)\z", DIGITS + SMALL, True),
    Encoding("base62", r"\A[0-9A-Za-z]+\z", DIGITS + CAPITAL + SMALL),
    Encoding("base64", r"\A", CAPITAL + SMALL + DIGITS + "+/"),
)


@dataclass(frozen=True)
class Battery:
    """``least``: characters of a run; ``not_random``: joint probability below which the tests
    reject chance; ``false_share``: bound on the share of ordinary text among discoveries."""

    least: int = 20
    not_random: float = 0.001
    false_share: float = 0.01


#: Bins of a tenth of a power of ten, so that the procedure needs counts alone.
BINS, LAST_BIN = 10, 3000
#: Matches whose lengths are added up in one go.
BLOCK = 64
CHANGE = "[a-z](?=[A-Z0-9])|[A-Z](?=[a-z0-9])|[0-9](?=[A-Za-z])"
PAIR = "[A-Za-z0-9](?=[A-Za-z0-9])"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, x: a + x)


def _placed(found: Column, gaps: Column) -> Column:
    """Start, end and text of each match, from the texts between matches.

    Ends are running totals in two levels, so that a text with very many matches stays cheap."""

    def ends(steps: Column) -> Column:
        last = F.floor((F.size(found) - 1) / F.lit(BLOCK)).cast("int")
        blocks = F.transform(
            F.sequence(F.lit(0), last), lambda b: _total(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
        )
        return _let(blocks, lambda blocks: _let(before(blocks), lambda starts: place(steps, starts)))

    def before(blocks: Column) -> Column:
        return F.transform(blocks, lambda _, b: _total(F.slice(blocks, F.lit(1), b)))

    def place(steps: Column, starts: Column) -> Column:
        def one(said: Column, i: Column) -> Column:
            block = F.floor(i / F.lit(BLOCK)).cast("int")
            end = F.get(starts, block) + _total(F.slice(steps, block * BLOCK + 1, i - block * BLOCK + 1))
            return F.named_struct(F.lit("start"), end - F.length(said), F.lit("end"), end, F.lit("said"), said)

        return F.transform(found, one)

    steps = F.transform(found, lambda said, i: F.length(F.get(gaps, i)) + F.length(said))
    return _let(steps, ends)


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, said>>`` of the leftmost matches, none empty; code points."""
    none = F.array().cast("array<struct<start:int,end:int,said:string>>")
    return _let(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda found: F.when(
            F.size(found) > 0, _let(F.split(text, pattern, -1), lambda gaps: _placed(found, gaps))
        ).otherwise(none),
    )


def _spans(found: Column, kind: str) -> Column:
    return F.transform(
        found,
        lambda m: F.named_struct(
            F.lit("start"), m["start"], F.lit("kind"), F.lit(KINDS.index(kind)), F.lit("end"), m["end"]
        ),
    )


def base_spans(text: Column) -> list[Column]:
    """Spans of the three fixed kinds, failing matches dropped."""
    assigned = F.filter(matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["said"], ASSIGN, 2)) >= 12)
    access = F.filter(matches(text, ACCESS), lambda m: F.length(m["said"]) >= 18)
    return [_spans(assigned, "assign"), _spans(access, "access"), _spans(matches(text, HEX), "hex")]


# The tests


#: A known Chebyshev fit of the complementary error function, right to 2e-7 of itself.
ERFC = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0."""
    t = F.lit(1.0) / (F.lit(1.0) + x * 0.5)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def _two_sided(z: Column) -> Column:
    return _erfc(F.abs(z) / math.sqrt(2))


def _upper(z: Column) -> Column:
    half = 0.5 * _erfc(F.abs(z) / math.sqrt(2))
    return F.when(z >= 0, half).otherwise(1 - half)


def _uniformity(body: Column, n: Column, alphabet: Column) -> Column:
    """Chi-squared test of equal shares of all symbols; its cube root is nearly normal."""
    k = F.length(alphabet).cast("double")
    count = lambda c: (n - F.length(F.replace(body, c, F.lit("")))).cast("double")
    squares = F.aggregate(_characters(alphabet), F.lit(0.0), lambda a, c: a + count(c) * count(c))
    chi = F.greatest(squares * k / n - n, F.lit(0.0))
    return _let(
        2 / (9 * (k - 1)), lambda spread: _upper((F.cbrt(chi / (k - 1)) - (1 - spread)) / F.sqrt(spread))
    )


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _runs(body: Column, n: Column, alphabet: Column) -> Column:
    """Runs above and below the alphabet's middle, against their number in a random order."""
    half = F.floor(F.length(alphabet) / 2).cast("int")
    sides = F.concat(F.repeat(F.lit("L"), half), F.repeat(F.lit("H"), F.length(alphabet) - half))
    marks = F.call_function("translate", body, alphabet, sides)

    def tested(marks: Column) -> Column:
        low = F.length(F.replace(marks, F.lit("H"), F.lit(""))).cast("double")
        runs = F.length(F.regexp_replace(marks, "L+|H+", "x"))
        return _let(low * (n - low) * 2 / n, lambda m: F.when(m <= 1, 0.0).otherwise(
            _two_sided((runs - 1 - m) / F.sqrt(m * (m - 1) / (n - 1)))
        ))

    return _let(marks, tested)


def _serial(body: Column, n: Column, alphabet: Column) -> Column:
    """Correlation of neighbours' places in the alphabet; about normal with mean -1/n."""
    places = F.transform(_characters(body), lambda c: F.instr(alphabet, c).cast("double"))

    def tested(v: Column) -> Column:
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        return _let(_let(mean, lambda m: F.transform(v, lambda x: x - m)), correlated)

    def correlated(d: Column) -> Column:
        square = F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x)
        along = F.zip_with(F.slice(d, F.lit(1), n - 1), F.slice(d, F.lit(2), n - 1), lambda a, b: a * b)
        product = F.aggregate(along, F.lit(0.0), lambda a, x: a + x)
        return F.when(square <= 0, 0.0).otherwise(_two_sided((product / square + 1 / n) * F.sqrt(n)))

    return _let(places, tested)


def chance(body: Column, n: Column, alphabet: Column) -> Column:
    """Joint probability of the three tests if the run were drawn from the alphabet, by Fisher's
    method: the tail of a chi-squared distribution with six degrees of freedom."""
    tests = F.array(*[test(body, n, alphabet) for test in (_uniformity, _runs, _serial)])
    logs = F.aggregate(tests, F.lit(0.0), lambda a, p: a - F.log(F.greatest(p, F.lit(1e-300))))
    return _let(logs, lambda x: F.exp(-x) * (1 + x + x * x / 2))


def _candidate(m: Column) -> Column:
    def coded(body: Column) -> Column:
        code = F.lit(len(ENCODINGS) - 1)
        for i, e in reversed(list(enumerate(ENCODINGS[:-1]))):
            code = F.when(F.rlike(body, F.lit(e.pattern)), i).otherwise(code)
        return _let(code, lambda code: _let(_changes(body), lambda c: measured(body, code, c)))

    def measured(body: Column, code: Column, changes: Column) -> Column:
        plain = F.when(F.get(F.array(*[F.lit(e.folded) for e in ENCODINGS]), code), F.lower(body)).otherwise(
            F.translate(body, "-_", "+/")
        )
        alphabet = F.get(F.array(*[F.lit(e.alphabet) for e in ENCODINGS]), code)
        tested = _let(plain, lambda b: _let(alphabet, lambda a: chance(b, F.length(b), a)))
        return F.named_struct(
            F.lit("start"), m["start"], F.lit("end"), m["end"], F.lit("code"), code, F.lit("n"), F.length(body),
            F.lit("changes"), changes,
            # without a change of kind no run is a discovery, whatever the tests say
            F.lit("chance"), F.when(changes > 0, tested).otherwise(0.0),
        )

    return _let(F.regexp_replace(m["said"], r"=+\z", ""), coded)


def _changes(body: Column) -> Column:
    return F.regexp_count(F.translate(body, "+/_=-", ""), F.lit(CHANGE))


def candidates(text: Column, least: int) -> Column:
    """Runs outside of what the fixed kinds found, with what the tests and the procedure need."""
    known = ASSIGN[:-2] + "{12,})"
    found = matches(text, rf"{known}|AKIA[A-Z0-9]{{14,}}|[A-Za-z0-9+/_=-]{{{least},}}")
    seen = F.lit(rf"\A(?:{known}|AKIA[A-Z0-9]{{14,}}|[0-9a-f]+)\z")
    long = lambda m: F.length(F.regexp_replace(m["said"], r"=+\z", "")) >= least
    return F.transform(F.filter(found, lambda m: ~F.rlike(m["said"], seen) & long(m)), _candidate)


# The procedure


def _bin(n: Column, changes: Column, rate: float) -> Column:
    """Tenths of powers of ten by which ordinary text of this length falls short of so many changes
    (Chernoff's bound), rounded down."""
    pairs = (n - 1).cast("double")
    share = F.least(changes / pairs, F.lit(1.0))
    off = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    nats = F.when(share > rate, pairs * (share * F.log(share / rate) + off)).otherwise(0.0)
    return F.least(F.floor(nats / math.log(10) * BINS), F.lit(LAST_BIN)).cast("int")


def _band(n: Column) -> Column:
    return F.floor(F.log2(n)).cast("int")


def least_bins(runs: DataFrame, false_share: float) -> dict[tuple[int, int], int]:
    """The least bin of discoveries of each encoding and length band, where there are any.

    ``runs`` have ``code, band, bin``. A bin's largest probability stands for all in it, which
    keeps the bound. There are few encodings and bands (powers of two), and so few answers."""
    counts = runs.groupBy("code", "band", "bin").agg(F.count("*").alias("runs"))
    group = Window.partitionBy("code", "band")
    upward = group.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumns({"so_far": F.sum("runs").over(upward), "all": F.sum("runs").over(group)})
    good = F.pow(F.lit(10.0), -F.col("bin") / BINS) * F.col("all") <= F.col("so_far") * false_share
    found = ranked.where(good & (F.col("bin") > 0)).groupBy("code", "band").agg(F.min("bin").alias("bin"))
    return {(r["code"], r["band"]): r["bin"] for r in found.collect()}


def _listed(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    texts = F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(texts, ",")


def secrets(docs: DataFrame, battery: Battery = Battery()) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random`` for every row.

    Texts are read once; what is stored between the passes are positions and probabilities, no
    text. Null texts are empty and have no spans; null and repeated ids are rows like others; an
    empty table gives no rows; columns other than ``doc_id`` and ``text`` are ignored. ``spans``
    has those of the fixed kinds and, as ``random``, runs of other letters that are discoveries."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    base = dict(zip(KINDS, base_spans(F.col("text"))))
    rows = given.select(
        "doc_id",
        *[spans.alias(kind) for kind, spans in base.items()],
        candidates(F.col("text"), battery.least).alias("runs"),
        F.regexp_count("text", F.lit(CHANGE)).cast("long").alias("changes"),
        F.regexp_count("text", F.lit(PAIR)).cast("long").alias("pairs"),
    )
    rows = written(rows, "secrets")
    changes, pairs = rows.agg(F.sum("changes"), F.sum("pairs")).first()
    rate = min(max((changes or 0) / (pairs or 1), 1e-6), 0.5)
    each = rows.select(F.explode("runs").alias("r"))
    binned = each.select("r.code", _band(F.col("r.n")).alias("band"), _bin(F.col("r.n"), F.col("r.changes"), rate).alias("bin"))
    least = least_bins(binned, battery.false_share)
    never = F.lit(LAST_BIN + 1)
    if least:
        pairs_of = [F.lit(v) for (code, band), b in sorted(least.items()) for v in (code * 64 + band, b)]
        needed = F.create_map(*pairs_of)
        threshold = lambda r: F.coalesce(F.try_element_at(needed, r["code"] * 64 + _band(r["n"])), never)
    else:
        threshold = lambda r: never

    def discovered(r: Column) -> Column:
        return (r["chance"] >= battery.not_random) & (_bin(r["n"], r["changes"], rate) >= threshold(r))

    rows = rows.withColumn("random", _spans(F.filter("runs", discovered), "random"))
    fixed = F.array_sort(F.concat(*KINDS[:3]))
    return rows.select(
        "doc_id",
        *[F.size(kind).cast("long").alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(_listed(fixed), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat(*KINDS))).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
