"""The queries on mathematics against their SQL, on a table of worked solutions made here: the given tables hold none."""

import random

import oracle
import pytest
from pyspark.sql import functions as F

from millrace.plans import catalog

ODD = [
    (10_001, None),
    (10_002, ""),
    (10_003, "no answer"),
    (10_004, r"\boxed{"),
    (10_005, "#### 12, then 5"),
    (10_006, "#### 1,2,3 and #### -1,234,567.50."),
    (10_007, r"\boxed{(1, 2)} and \boxed{1,2,3,4,5,6}"),
    (10_008, r"} stray } \boxed{x}"),
    (10_009, r"\boxed{a\boxed{b}c}"),
    (10_010, r"\boxed{1} \boxed{never {closes}"),
    (10_011, "####"),
    (10_012, "#### ,5"),
    (10_013, "#### 7,"),
    (None, r"\boxed{no id}"),
    (10_014, r"repeated \boxed{0}"),
    (10_014, r"repeated \boxed{0}"),
    (10_015, "long " * 20_000 + r"\boxed{\frac{1}{2}}"),
]


def solutions(n=2_000):
    rng = random.Random(17)
    for k in range(n):
        a, b = rng.randrange(10**5), rng.randrange(1, 500)
        steps = [rf"Let $x_{{{j}}} = {rng.randrange(99)}^{{2}} + \frac{{{a}}}{{{b}}}$." for j in range(rng.randrange(1, 9))]
        inner = rng.choice([f"{a:,}", rf"\frac{{{a}}}{{{b}}}", rf"\sqrt{{\frac{{{a}}}{{{b}}}}}", f"({a}, {b})", f"{a / b:.3f}"])
        ends = [rf"So \boxed{{{inner}}}", f"#### {a:,}", f"#### -{b}.5", f"Hence {a}", rf"\boxed{{{b}}} or rather \boxed{{{inner}}}."]
        yield k, " ".join([*steps, rng.choice(ends)])


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    """The given tables, with these documents in place of theirs."""
    out = tmp_path_factory.mktemp("maths")
    for t in oracle.TABLES:
        if t != "documents":
            (out / f"{t}.parquet").symlink_to(f"{data}/{t}.parquet")
    rows = spark.createDataFrame([*solutions(), *ODD], "doc_id bigint, text string")
    rows.withColumns({"lang": F.lit("en"), "source": F.lit("maths"), "n_chars": F.length("text").cast("long")}).write.parquet(str(out / "documents.parquet"))
    return str(out)


@pytest.mark.parametrize("name", ["math_answer", "math_density"])
def test_same_as_sql(spark, folder, name):
    df = catalog.QUERIES[name](spark, folder)
    assert oracle.differences(df, oracle.duck(folder), catalog.ORACLE_SQL[name]) == []
    assert df.count() == 2_000 + len(ODD)


def test_answers(spark, folder):
    got = {r.doc_id: r.answer for r in catalog.QUERIES["math_answer"](spark, folder).filter("doc_id > 10000").collect()}
    assert [got[k] for k in range(10_001, 10_016)] == [None, None, None, None, "12", "-1234567.50", "123456", "x", "b", "1", None, None, "7", "0", r"\frac{1}{2}"]
