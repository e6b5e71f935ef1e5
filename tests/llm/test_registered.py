"""The registered queries and the pipeline over odd tables and empty ones."""

import random

import duckdb
import pytest

import corpus_pipeline
from pairloom.llm import registry

TABLES = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, key string, h long, fingerprint string, score string, cluster string, n_tokens string",
    "pages": "page_id long, url string, html string, text string, n_chars string",
    "embeddings": "vec_id long, embedding array<float>, label int, cid string, h1 string, component string",
    "benchmark": "item_id long, text string, key string",
    "labels": "doc_id long, quality int, toxic int, text string, label string",
}


def rows_of():
    r = random.Random(51)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(200)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    docs = [(k, text(r.randint(0, 40)), r.choice(["en", None]), r.choice(["hot", "hot", None, "b"]), None, "x", k, "f", None, "c", "n") for k in range(90)]
    docs += [(None, t, None, None, None, None, None, None, None, None, None) for t in (None, "", "no id", "no id")]
    docs += [(5, t, "en", "hot", 1, None, None, None, None, None, None) for t in (None, "", "five", "five", docs[5][1])]
    docs += [(200, "long " + text(6) + " very" * 30_000, None, "hot", None, None, None, None, None, None, None)]
    return {
        "documents": docs,
        "pages": [(k, f"u{k}", f"<body><nav><a href=x>Home</a></nav><article><p>{text(30)}.</p></article>", "clash", "clash") for k in range(5)] + [(None, None, None, None, None), (1, "again", "", None, None), (7, "x", "<svg>" * 500, None, None)],
        "embeddings": [(k, [r.gauss(0, 1) for _ in range(8)], k % 2, "c", None, None) for k in range(20)] + [(None, [1.0] * 8, 0, None, None, None), (30, None, 1, None, None, None), (31, [], 1, None, None, None), (32, [1.0] * 8, None, None, None, None)] + [(33 + k, [1.0] * 8, 1, None, None, None) for k in range(5)],
        "benchmark": [(k, text(14), "k") for k in range(4)] + [(9, " ".join(docs[7][1].split()[:12]), None), (None, "no id here", None), (10, None, None), (11, "", None), (9, docs[8][1], None)],
        "labels": [(k, k % 2, (k // 2) % 2, "clash", None) for k in range(60)] + [(None, 1, 1, None, None), (3, None, None, None, None), (4, 0, 1, None, None), (999, 1, 0, None, None)],
    }


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    full, empty = (str(tmp_path_factory.mktemp(n)) for n in ("odd", "empty"))
    for name, rows in rows_of().items():
        spark.createDataFrame(rows, TABLES[name]).write.parquet(f"{full}/{name}.parquet")
        spark.createDataFrame([], TABLES[name]).write.parquet(f"{empty}/{name}.parquet")
    return full, empty


SOURCE = {"op2_main_text": "pages", "op5_vectors": "embeddings"}


@pytest.mark.parametrize("name", registry.QUERIES)
def test_odd_and_empty_tables(spark, folders, name):
    assert registry.QUERIES[name].__doc__
    full, empty = folders
    table = SOURCE.get(name, "documents")
    out = registry.QUERIES[name](spark, full)
    rows = out.collect()
    key = rows[0].__fields__[0]
    ids = [x[0] for x in rows_of()[table]]
    if name == "op4_packing":
        assert {r[key] for r in rows} == set(ids) and sum(r.piece == 0 for r in rows) == len(ids)
    else:
        assert sorted(map(str, (r[key] for r in rows))) == sorted(map(str, ids))
    nothing = registry.QUERIES[name](spark, empty)
    assert nothing.columns == out.columns and nothing.count() == 0


@pytest.mark.parametrize("name", registry.ORACLES)
def test_sql(spark, folders, name):
    full, _ = folders
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{full}/{t}.parquet/*.parquet')")
    want = con.execute(registry.ORACLES[name])
    cols = [x[0] for x in want.description]
    rows = registry.QUERIES[name](spark, full).select(*cols).collect()
    assert sorted(map(repr, (tuple(r) for r in rows))) == sorted(map(repr, want.fetchall()))


def test_pipeline_of_odd_and_empty_tables(spark, folders):
    full, empty = folders
    docs = spark.read.parquet(f"{full}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage.__doc__
        after = corpus_pipeline.saved_at(stage(spark, before, full))[0]
        assert after.columns == docs.columns and after.count() <= before.count(), name
        before = after
    last = corpus_pipeline.STAGES[-1][1](spark, before, full).collect()
    assert sorted(map(repr, last)) == sorted(map(repr, corpus_pipeline.run(spark, full).collect()))
    assert corpus_pipeline.run(spark, empty).count() == 0
