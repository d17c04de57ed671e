"""The secret scan against a plain version."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import string

from pyspark.sql import functions as F

from patchwell.llm import secret_scan as s

B64 = string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"
ALPHABETS = {
    0: string.digits,
    1: string.digits + "abcdef",
    2: string.ascii_uppercase + "234567",
    3: string.digits + string.ascii_lowercase,
    4: string.digits + string.ascii_letters,
    5: B64,
}
KNOWN = re.compile(
    r"""(?ai:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{12,}|AKIA[A-Z0-9]{14,}|[A-Za-z0-9+/_=-]{20,}"""
)
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""")


def base(text: str) -> list[tuple]:
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return out


def code_of(body: str) -> int:
    for code, rx in enumerate(("[0-9]+", "[0-9a-f]+|[0-9A-F]+", "[A-Z2-7]+", "[0-9a-z]+|[0-9A-Z]+", "[0-9A-Za-z]+")):
        if re.fullmatch(rx, body):
            return code
    return 5


def chance(body: str, code: int) -> float:
    a = ALPHABETS[code]
    body = body.lower() if code in (1, 3) else body.replace("-", "+").replace("_", "/")
    n, k = len(body), len(a)
    two = lambda z: math.erfc(abs(z) / math.sqrt(2))
    chi = sum(c * c for c in collections.Counter(body).values()) * k / n - n
    spread = 2 / (9 * (k - 1))
    p1 = math.erfc(((max(chi, 0) / (k - 1)) ** (1 / 3) - (1 - spread)) / math.sqrt(spread) / math.sqrt(2)) / 2
    high = [a.index(c) >= k // 2 for c in body]
    m = 2 * sum(high) * (n - sum(high)) / n
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    p2 = 0 if m <= 1 else two((runs - 1 - m) / math.sqrt(m * (m - 1) / (n - 1)))
    v = [a.index(c) - sum(map(a.index, body)) / n for c in body]
    square = sum(x * x for x in v)
    p3 = 0 if square <= 0 else two((sum(x * y for x, y in zip(v, v[1:])) / square + 1 / n) * math.sqrt(n))
    x = -sum(math.log(max(p, 1e-300)) for p in (p1, p2, p3))
    return math.exp(-x) * (1 + x + x * x / 2)


def kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2


def changes(text: str) -> int:
    return sum(kind(x) != kind(y) for x, y in zip(text, text[1:]) if x.isascii() and y.isascii() and x.isalnum() and y.isalnum())


def plain(docs: list[tuple], level: float = 0.01) -> dict:
    found, total, pairs = collections.defaultdict(list), 0, 0
    for key, (_, text) in enumerate(docs):
        text = text or ""
        total += changes(text)
        pairs += sum(x.isascii() and y.isascii() and x.isalnum() and y.isalnum() for x, y in zip(text, text[1:]))
        for m in KNOWN.finditer(text):
            body = m[0].rstrip("=")
            assigned = ASSIGN.match(m[0])
            if (assigned and len(assigned[1]) >= 12) or re.fullmatch("AKIA[A-Z0-9]{14,}|[0-9a-f]+", m[0]) or len(body) < 20:
                continue
            found[code_of(body), int(math.log2(len(body)))].append((key, m.start(), m.end(), body))
    rate = min(max(total / (pairs or 1), 1e-6), 0.5)
    added = collections.defaultdict(list)
    for (code, _), runs in found.items():
        bins = []
        for _, _, _, body in runs:
            inner = re.sub(r"[+/_=-]", "", body)
            share = min(changes(inner) / (len(body) - 1), 1)
            off = (1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0
            nats = (len(body) - 1) * (share * math.log(share / rate) + off) if share > rate else 0
            bins.append(min(math.floor(nats / math.log(10) * 10), 3000))
        good = [b for b in bins if b > 0 and 10 ** (-b / 10) * len(bins) <= sum(x >= b for x in bins) * level]
        for (key, start, end, body), b in zip(runs, bins):
            if good and b >= min(good) and chance(body, code) >= 0.001:
                added[key].append((start, 3, end))
    said = lambda spans: ",".join(f"{s.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
    out = []
    for key, (doc, text) in enumerate(docs):
        spans = base(text or "")
        counts = [sum(k == j for _, k, _ in spans) for j in range(3)]
        out.append((doc, *counts, hashlib.sha256(said(spans).encode()).hexdigest(), said(spans + added[key]), len(added[key])))
    return sorted(out, key=repr)


def found(df) -> list[tuple]:
    return sorted((tuple(r) for r in s.secrets(df).collect()), key=repr)


def drawn(rng: random.Random, alphabet: str, n: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(n))


def prose(rng: random.Random, words: int) -> str:
    return " ".join(rng.choice(("the", "House", "of", "cards", "written", "in", "Paris", "2021", "again")) for _ in range(words))


def test_fixed_kinds_and_odd_rows(docs):
    short = "token=secret: abcdefghijkl TOKEN : 'short' Api_Key='a.b-c_d=e/f+ghij' passwd=" + "x" * 11
    rows = [
        (1, None), (2, ""), (None, "no id, password = hunter2hunter2"), (3, short),
        (4, "é " + "AKIA" + "A" * 14 + " AKIAAKIA AKIA" + "B" * 13 + " " + "0a" * 8 + "g" + "f" * 15),
        (5, "token" + " " * 3000 + "=" + " " * 3000 + "q" * 50_000 + " " + "ab12" * 9000),
        (6, "ſecret=abcdefghijklmnop Passwd='" + "Z9" * 9), (6, "token=" + "k" * 12), (6, "token=" + "k" * 12),
        (7, " ".join(["deadbeefdeadbeef", "or"] * 3000)),
    ]
    df = docs(rows).withColumns({c: F.lit(1) for c in ("assign", "runs", "random", "changes", "a b")})
    assert found(df) == plain(rows)


def test_random_runs_are_added_and_words_are_not(docs):
    rng = random.Random(5)
    rows = [(i, prose(rng, 300)) for i in range(30)]
    rows += [(100 + i, f"{prose(rng, 40)} {drawn(rng, B64, 40)} {prose(rng, 40)}") for i in range(20)]
    rows += [(200 + i, f"{prose(rng, 40)} {drawn(rng, '0123456789ABCDEF', 40)}") for i in range(20)]
    rows += [(300, "A-Heading-Of-Many-Title-Words-That-Goes-On-And-On"), (301, "1234567890" * 3), (302, "AaBbCcDdEeFfGgHhIiJjKkLlMm")]
    got = found(docs(rows))
    assert got == plain(rows)
    hits = {r[0]: r[-1] for r in got}
    assert sum(hits[100 + i] for i in range(20)) >= 19 and sum(hits[200 + i] for i in range(20)) >= 19
    assert not any(hits[i] for i in (*range(30), 300, 301, 302))


def test_false_discoveries_are_bounded(docs):
    """The procedure by itself: runs of ordinary text, whose changes come at the corpus's rate."""
    rng = random.Random(6)

    def ordinary(n: int) -> str:
        out = [rng.choice(string.ascii_lowercase)]
        while len(out) < n:
            change = rng.random() < 0.1
            same = string.ascii_lowercase if out[-1].islower() else string.digits
            other = string.digits if out[-1].islower() else string.ascii_lowercase
            out.append(rng.choice(other if change else same))
        return "".join(out)

    rows = [(i, " ".join(ordinary(30) for _ in range(20))) for i in range(100)]
    assert sum(r[-1] for r in found(docs(rows))) <= 20  # of 2,000 runs


def test_empty_table(docs):
    assert found(docs([])) == []


def test_whole_table(spark, frame):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert found(df) == plain([tuple(r) for r in df.select("doc_id", "text").collect()])


def test_no_python_in_the_plan(spark, frame):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = s.secrets(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
