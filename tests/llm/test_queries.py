"""The registered queries: names, columns, whole tables, SQL."""

import oracle
import pytest

from millrace.llm import queries

COLUMNS = {
    1: "doc_id held_out score predicted",
    2: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    3: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    4: "doc_id n_tokens ids_sha256 decoded_sha256",
    5: "doc_id size source_size target taken",
    6: "doc_id held_out score predicted",
    7: "page_id payload_bytes payload_digest record_type refers_to",
    8: "doc_id n_shingles component_id",
    9: "doc_id held_out lang_pred score",
    10: "doc_id n_assign n_access n_hex base_sha256 spans",
    11: "vec_id code error label_error codebooks_sha256",
    12: "doc_id n_shingles component_id kept",
    13: "vec_id component n deviation whitened explained identity_error",
}


def test_one_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES if name.startswith("op")) == list(range(1, 14))


@pytest.mark.parametrize("name", [name for name in queries.QUERIES if name.startswith("op")])
def test_whole_table(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert df.columns == COLUMNS[int(name[2:].split("_")[0])].split()
    n = int(name[2:].split("_")[0])
    source = {7: "pages", 11: "embeddings", 13: "embeddings"}.get(n, "documents")
    each = 4 if n == 13 else 1  # rows: one for each component
    assert df.count() == each * spark.read.parquet(f"{data}/{source}.parquet").count()


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_same_as_sql(spark, data, name):
    assert oracle.differences(queries.QUERIES[name](spark, data), oracle.duck(data), queries.ORACLE_SQL[name]) == []


def test_linked_parts_same_as_sql(spark, tmp_path):
    """The fixtures link nothing, so that spans of weak kinds are compared here, with texts that Java and other engines might read differently."""
    key, access = "Ab1" * 14, "AKIA" + "Z9" * 10
    texts = [
        f"{access} and {key}== at https://host/x?y, PassWord = 'abcdef12'",
        f"{key} alone, https://host",
        f"{access} {'x' * 401} {key}",
        f"{access} {'é' * 390} {key} {'é' * 300} redis://far {'-' * 500} redis://farther",
        f"api_key:{'a1' * 20} API_KEY='tooo' \u017fecret=abcdefgh to\u212aen=abcdefgh",
        "0123456789abcdef0123456789abcdef 0123456789abcdef",
        None,
        "",
    ]
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, *texts[:2]])], "doc_id bigint, text string")
    folder = str(tmp_path)
    df.write.parquet(f"{folder}/documents.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got = queries.op10_secrets(spark, folder)
    assert oracle.differences(got, con, queries.ORACLE_SQL["op10_secrets"]) == []
    assert {"key", "endpoint"} <= {x.split(":")[0] for r in got.collect() for x in r.spans.split(",")}


def test_mix_of_odd_sources_same_as_sql(spark, tmp_path):
    rows = [(k, "w " * (k * 37 % 90), [None, "a", "B", "é", "zz"][k % 5 if k % 3 else 1]) for k in range(700)] + [(None, "x y", "a"), (9_999, None, "a")]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").write.parquet(f"{folder}/documents.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    assert oracle.differences(queries.op5_mixing(spark, folder), con, queries.ORACLE_SQL["op5_mixing"]) == []
