"""The pipeline against straightforward versions of its stages."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import duckdb
import pytest
from brute import contaminated, near_components

from shopgauge.llm import quality, queries
from shopgauge.llm.oracle import ORACLE
from shopgauge.llm.shared import shared_folder

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good]
    assert 0 < len(rows) < docs.count()
    groups = near_components(rows)
    rows = [(i, t) for i, t in rows if groups[i][1] == i]
    assert len(rows) < len(good)
    con = duckdb.connect()
    items = con.execute(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    bad = {d for d, _ in contaminated(rows, items)}
    left = [i for i, _ in rows if i not in bad]
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet' WHERE doc_id IN ({','.join(map(str, left))})")
    taken = {d: t // max(1, s) for d, s, t in con.execute(f"SELECT doc_id, size, taken FROM ({ORACLE['op4_fair_queue']})").fetchall()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in got) == Counter({d: n for d, n in taken.items() if n})
    by_shard = Counter(r.shard for r in got)
    assert max(by_shard.values()) - min(by_shard.values()) <= 1
    assert all(sorted(r.slot for r in got if r.shard == s) == list(range(n)) for s, n in by_shard.items())


def test_stages_on_awkward_rows(spark):
    """Nulls anywhere, empty texts, repeated rows, clashing columns; every stage keeps the columns of documents."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "a", 1, "s", "k"), (1, text, "en", "a", 1, "s", "k"), (2, text + " x", None, None, None, None, None),
            (None, text + " y z", None, "b", 2, "s", None), (3, None, "en", "a", 0, None, None), (4, "", "en", "a", 0, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string, kept string")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[1:]:
        out = stage(spark, docs, SF)
        if name != names[-1]:
            assert out.columns == docs.columns
        folder = shared_folder(spark)
        out.write.parquet(folder)
        docs = spark.read.schema(out.schema).parquet(folder)
        if name == names[1]:
            assert sorted((r.doc_id, r.text) for r in docs.where("length(text) > 0").collect()) == [(1, text)]
            assert docs.where("doc_id in (3, 4)").count() == 2
    assert docs.count() >= 1 and {"shard", "slot"} <= set(docs.columns)


@pytest.mark.parametrize("at", range(5))
def test_stages_on_an_empty_table(spark, at):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    out = corpus_pipeline.STAGES[at][1](spark, docs, SF)
    assert out.count() == 0 and (at == 4 or out.columns == COLUMNS)


def test_all_queries_are_registered():
    import __spark_entry__

    registered = __spark_entry__.queries()
    assert set(queries.QUERIES) | {"pipeline"} <= set(registered)
    assert [sum(q.startswith(f"op{n}_") for q in registered) for n in range(1, 11)] == [1] * 10
    assert set(ORACLE) <= set(queries.QUERIES)


def test_queries_agree_with_their_sql(spark):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name, statement in ORACLE.items():
        theirs = con.execute(statement)
        columns = sorted(d[0] for d in theirs.description)
        want = sorted(map(str, con.execute(f"SELECT {', '.join(columns)} FROM ({statement})").fetchall()))
        frame = queries.QUERIES[name](spark, SF)
        assert sorted(frame.columns) == columns
        assert sorted(str(tuple(r)) for r in frame.select(columns).collect()) == want, name
