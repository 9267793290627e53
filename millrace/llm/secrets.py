"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds stand alone: `assign` (a named value), `access` (an access
identifier) and `hex` (a long hexadecimal run). Weak kinds, `key` (a long mixed
run of base64 letters) and `endpoint` (an address with a scheme), mean nothing
alone: an interval join within scopes of SCOPE code points keeps a `key` only
near an access identifier, and an `endpoint` only near both an access
identifier and a key or assigned value.

The join works on spans alone, bucketed by position, so texts are not shuffled.
Positions are code points, ends exclusive.

Defined cases: null texts are empty and have no spans; repeated rows each get
their result; rows of one id with different texts are told apart by the text;
long texts are scanned whole, in time linear in their length; null ids stay
null; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import spread, written

#: Parts of one credential are at most so many code points apart.
SCOPE = 400

# The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
BASE = ("assign", "access", "hex")

KEY = r"[A-Za-z0-9+/]{32,}={0,2}"
ENDPOINT = r"""(?:https?|ftp|wss?|amqps?|mysql|postgres|postgresql|redis|mongodb)://[^\x20\x09-\x0D"'<>]+"""
WEAK = ("key", "endpoint")


def _found(text: Column, pattern: str, good) -> Column:
    """array<struct<gap, len, ok>> of all matches; gap: code points since the last match ended.

    Bound by array(..) and transform, each regular expression runs once.
    """
    none = F.expr("cast(array() as array<struct<gap:int,len:int,ok:boolean>>)")

    def measured(both: Column) -> Column:
        return F.transform(both["m"], lambda m, i: F.struct(F.length(F.get(both["p"], i)).alias("gap"), F.length(m).alias("len"), good(m).alias("ok")))

    def with_gaps(matches: Column) -> Column:
        both = F.array(F.struct(matches.alias("m"), F.split(text, pattern, -1).alias("p")))
        return F.when(F.size(matches) > 0, F.transform(both, measured)[0]).otherwise(none)

    return F.transform(F.array(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), with_gaps)[0]


def _value_length(match: Column) -> Column:
    return F.length(F.regexp_extract(match, f"^{ASSIGN}$", 2))


def scan(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, k1, k2, and an array of matches by kind) of every row; k1, k2 stand for id and text."""
    rows = spread(df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")))
    t = F.col("text")
    rows = rows.select(
        "id",
        F.xxhash64("id", "text").alias("k1"),
        F.xxhash64(F.lit(1), "text", "id").alias("k2"),
        "text",
        _found(t, ASSIGN, lambda m: _value_length(m) >= LEAST["assign"]).alias("assign"),
        _found(t, ACCESS, lambda m: F.length(m) >= LEAST["access"]).alias("access"),
        # runs are maximal, so asking for the length drops the same ones
        _found(t, HEX.replace("+", f"{{{LEAST['hex']},}}"), lambda m: F.lit(True)).alias("hex"),
    )
    none = F.expr("cast(array() as array<struct<gap:int,len:int,ok:boolean>>)")
    strong = F.exists("access", lambda x: x["ok"])
    mixed = lambda m: m.rlike("[A-Z]") & m.rlike("[a-z]") & m.rlike("[0-9]")
    return rows.select(
        "id", "k1", "k2", *BASE,
        F.when(strong, _found(t, KEY, mixed)).otherwise(none).alias("key"),
        F.when(strong, _found(t, ENDPOINT, lambda m: F.lit(True))).otherwise(none).alias("endpoint"),
    )


def _positions(scanned: DataFrame) -> DataFrame:
    """(k1, k2, kind, start, end) of the matches that hold, from the gaps before them."""
    kinds = (*BASE, *WEAK)
    some = scanned.filter(reduce(lambda a, b: a | b, [F.size(k) > 0 for k in kinds])).dropDuplicates(["k1", "k2"])
    each = some.select("k1", "k2", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("found")) for k in kinds])).alias("x"))
    each = each.select("k1", "k2", "x.kind", F.posexplode("x.found").alias("i", "m"))
    before = W.partitionBy("k1", "k2", "kind").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    end = F.sum(F.col("m.gap").cast("long") + F.col("m.len")).over(before)
    placed = each.select("k1", "k2", "kind", "m.ok", end.alias("end"), F.col("m.len").alias("len"))
    return placed.filter("ok").select("k1", "k2", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def _near(parts: DataFrame, others: DataFrame) -> DataFrame:
    """The parts with one of the others in their scope: an interval join on buckets of positions."""
    by = lambda low, high: F.explode(F.sequence(F.floor(low / SCOPE), F.floor(high / SCOPE))).alias("bucket")
    a = parts.select("*", by(F.col("start") - SCOPE, F.col("end") + SCOPE))
    b = others.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), F.col("start").alias("from"), F.col("end").alias("to"), by(F.col("start"), F.col("end"))).withColumnRenamed("bucket", "at")
    meet = (a.k1 == b.o1) & (a.k2 == b.o2) & (a.bucket == b["at"]) & (F.greatest(b["from"] - a.end, a.start - b["to"]) <= SCOPE)
    return a.join(b, meet, "left_semi").drop("bucket").distinct()


def linked(placed: DataFrame) -> DataFrame:
    """Base spans, and the weak ones whose complementary parts are in their scope."""
    access, assign = placed.filter("kind = 'access'"), placed.filter("kind = 'assign'")
    base = placed.filter(F.col("kind").isin(*BASE))
    keys = _near(placed.filter("kind = 'key'"), access)
    endpoints = _near(_near(placed.filter("kind = 'endpoint'"), access), keys.unionByName(assign))
    return base.unionByName(keys).unionByName(endpoints)


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in (*BASE, *WEAK)]), kind)


def find_spans(scanned: DataFrame) -> DataFrame:
    """(k1, k2, spans array<struct<start, rank, kind, end>>) of texts with any, by start and kind."""
    span = F.struct("start", _rank(F.col("kind")).alias("rank"), "kind", "end")
    return linked(_positions(scanned)).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def digests(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) of every row."""
    scanned = written(scan(df, text, id_col), "secrets")  # texts are read once; what is left are positions
    rows = scanned.select("id", "k1", "k2").join(find_spans(scanned), ["k1", "k2"], "left")
    spans = F.coalesce("spans", F.expr("cast(array() as array<struct<start:bigint,rank:bigint,kind:string,end:bigint>>)"))
    base = F.filter(spans, lambda s: s["rank"] <= len(BASE))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return rows.select(F.col("id").alias(id_col), *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def redact(df: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """df with each span replaced by [kind]; of overlapping spans the first decides. Only rows with spans are joined."""
    hit, k1, k2 = "__hit", "__k1", "__k2"
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = df.withColumns({k1: F.xxhash64(id_col, whole), k2: F.xxhash64(F.lit(1), whole, F.col(id_col)), hit: whole.rlike(f"{ASSIGN}|{ACCESS}|(?-i:[0-9a-f]{{{LEAST['hex']},}})")})
    found = keyed.filter(hit)
    scanned = written(scan(found.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))), "secrets")
    spans = find_spans(scanned).select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias("__spans"))
    c = F.col(text)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<string>)").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.array(F.substring(c, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.concat(F.lit("["), s["kind"], F.lit("]")))
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], piece).alias("out")))

    cleaned = F.aggregate("__spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(c, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    done = found.join(spans, [k1, k2], "left").withColumn(text, F.when(F.col("__spans").isNull(), c).otherwise(cleaned))
    return keyed.filter(~F.col(hit)).select(df.columns).unionByName(done.select(df.columns))
