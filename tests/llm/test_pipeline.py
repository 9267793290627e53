import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
import tiktoken
from edges import ROWS, edge, empty
from test_ngram_join import plain_components, plain_sets

from millrace.llm import bpe, mixing, secrets, toxicity
from millrace.llm.common import table


@pytest.fixture(scope="module")
def steps(spark, data, tmp_path_factory):
    """What each stage was given and gave, reread from Parquet."""
    docs, out = table(spark, data, "documents"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path_factory.mktemp('stage')}/{k}"
        stage(spark, docs, data).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns(spark, data, steps):
    columns = table(spark, data, "documents").columns
    assert [len(steps), *(after.columns for _, after in steps[:-1])] == [5, columns, columns, columns, columns]


def test_toxic_documents_go(spark, data, steps):
    docs, after = steps[0]
    rejected = {r.doc_id for r in toxicity.score(docs, toxicity.fit(docs, table(spark, data, "labels"))).collect() if r.score >= 0.5}
    assert rejected and {r.doc_id for r in after.collect()} == {r.doc_id for r in docs.collect()} - rejected


def test_one_of_each_group_stays(steps):
    docs, after = steps[1]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = plain_components(plain_sets(rows, 5), 80)
    assert {r.doc_id for r in after.collect()} == set(want.values())


def test_documents_without_id_stay_among_near_copies(spark, data):
    rows = [(1, "one two three four five six"), (2, "one two three four five six"), (None, "no id here"), (None, "no id here"), (None, "nor here"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    after = corpus_pipeline.drop_near_copies(spark, docs, data)
    assert Counter(map(tuple, after.collect())) == Counter([rows[0], rows[2], rows[4], rows[5]])


def test_no_secret_stays_and_no_document_goes(steps):
    docs, after = steps[2]
    assert docs.count() == after.count()
    assert {r.n_assign + r.n_access + r.n_hex for r in secrets.digests(after).collect()} == {0}
    before = {r.doc_id: r.text for r in docs.collect()}
    hit = {r.doc_id for r in secrets.digests(docs).collect() if r.spans}
    for r in after.collect():
        assert (r.text == before[r.doc_id]) == (r.doc_id not in hit) and r.n_chars == len(r.text)


def test_documents_come_as_the_mix_takes_them(steps):
    docs, after = steps[3]
    source, words, kept = {r.doc_id: r.source for r in docs.collect()}, defaultdict(int), Counter()
    shares = mixing.mix_documents(docs).collect()
    for r in after.collect():
        kept[r.doc_id] += 1
        words[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
    for r in shares:
        assert abs(kept[r.doc_id] - r.taken / max(r["size"], 1)) < 1
    target = {source[r.doc_id]: r.target for r in shares}
    assert sum(abs(words[s] - t) for s, t in target.items()) < 0.35 * sum(target.values())


def test_all_that_is_left_is_encoded(steps):
    docs, after = steps[4]
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: k for k, t in enumerate(bpe.read_ranks(path))}, special_tokens={})
    want = Counter()
    for r in docs.collect():
        t = plain.encode_ordinary(r.text)
        want[r.doc_id, len(t), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in t)).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += 1
    assert Counter(map(tuple, after.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect())) == want


def through(spark, docs, data, folder):
    """What every stage gives, each written and reread."""
    out = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, data).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_odd_rows_and_columns_through_all_stages(spark, data, tmp_path):
    docs = edge(spark)
    after = through(spark, docs, data, str(tmp_path))
    assert all(a.columns == docs.columns for a in after[:-1])
    kept = [Counter(r.doc_id for r in a.collect()) for a in after]
    assert kept[0].keys() == {r[0] for r in ROWS} and kept[0][5] == 2  # nothing rude in them
    assert kept[1] == Counter([1, 2, 3, 4, 6, 7, 8, None]) == kept[2]  # 5 is a copy of 1
    assert not {2, 3, 4} & kept[3].keys() and kept[3] == kept[4]
    assert {r.id for r in after[3].collect()} <= {"x"}


def test_empty_table_through_all_stages(spark, data, tmp_path):
    after = through(spark, empty(spark), data, str(tmp_path))
    assert [a.count() for a in after] == [0] * 5 and all(a.columns == empty(spark).columns for a in after[:-1])


def test_run_leaves_nothing_but_its_last_input(spark, data):
    from pathlib import Path

    from millrace.sources import scratch

    scratch.clean_up(spark)
    folder = Path(scratch.shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    rows = corpus_pipeline.run(spark, data).count()
    assert rows and len([p for p in set(folder.iterdir()) - before]) == 1
    scratch.clean_up(spark)
    assert set(folder.iterdir()) == before
