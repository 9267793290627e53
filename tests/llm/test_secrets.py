import hashlib
import random
import re
from collections import Counter

from edges import ALL_IDS, ROWS, edge, empty, ids

from millrace.llm import secrets

KINDS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 20),
    ("hex", re.compile(r"[0-9a-f]+"), 24),
]


def brute(text):
    out = []
    for rank, (kind, pattern, least) in enumerate(KINDS):
        out += [(m.start(), rank, kind, m.end()) for m in pattern.finditer(text or "") if len(m[2] if kind == "assign" else m[0]) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(out)]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def texts():
    rng = random.Random(4)
    bits = ["secret=token:abcdef ", "AKIA" + "A1" * 9, "AKIAB", "é漢😀", "deadbeef" * 4, "deadbeef", 'api_key": "Zz/9+x-y"', "Token = x", "PASSWD:hunter22", " ", "\n", "token=token=abcdef", "x" * 50]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(150)]


def test_base_spans_are_those_of_a_plain_scan(spark):
    rows = [(k, t) for k, t in enumerate(texts())] + [(r[0], r[1]) for r in ROWS] + [(7, "password=abcdefg"), (7, "password=abcdefg")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.digests(df).collect())
    expected = Counter()
    for k, t in rows:
        spans = brute(t)
        n = Counter(s[0] for s in spans)
        expected[k, n["assign"], n["access"], n["hex"], hashlib.sha256(joined(spans).encode()).hexdigest()] += 1
    assert got == expected


KEY = "aB3/" * 10


def spans_of(spark, text):
    return secrets.digests(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first().spans


def test_weak_parts_need_their_complements_in_scope(spark):
    access, far, address = "AKIA" + "Z9" * 8, " ." * secrets.SCOPE, "https://host.example/x"
    assert spans_of(spark, f"{KEY} {address}") == ""
    assert spans_of(spark, f"{access} {KEY} {address}") == "access:0:20,key:21:61,endpoint:62:84"
    assert spans_of(spark, f"{access}{far}{KEY}") == "access:0:20"
    assert spans_of(spark, f"{access} {address}") == "access:0:20"
    gap = "." * (secrets.SCOPE - 2)
    assert "key" in spans_of(spark, f"{access} {gap} {KEY}") and "key" not in spans_of(spark, f"{access} {gap}. {KEY}")


def test_edge_rows(spark):
    rows = secrets.digests(edge(spark)).collect()
    assert ids(rows) == ALL_IDS and all(r.spans == "" for r in rows)
    assert secrets.digests(empty(spark)).count() == 0


def test_redaction_keeps_rows_and_the_rest_of_their_text(spark):
    cases = {1: (f"é AKIA{'Z9' * 8} {KEY}!", "é [access] [key]!"), 2: (None, None), 3: ("token=token=abcdef x", "[assign] x"), 4: ("clean", "clean")}
    df = spark.createDataFrame([(k, v[0], "e", k) for k, v in cases.items()] * 2, "doc_id bigint, text string, lang string, k1 int")
    out = secrets.redact(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(k, v[1]) for k, v in cases.items()] * 2)
    assert secrets.redact(edge(spark)).exceptAll(edge(spark)).count() == 0
