import os
import random
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def pipeline():
    import corpus_pipeline

    return corpus_pipeline


def test_stages_one_by_one(pipeline, spark, make, tmp_path):
    from test_duplicates import brute, norm

    from scorelake.llm import mixing, packing

    draw = random.Random(9)
    words = ["".join(draw.choices("abcdefghij", k=6)) for _ in range(2000)]
    texts = [" ".join(draw.choices(words, k=draw.randint(30, 90))) for _ in range(120)]
    texts += [texts[k] for k in range(10)] + [texts[k] + " tail" for k in range(10, 20)] + [texts[k].replace(" ", ". ", 3) + " moron." for k in range(20, 60)]
    rows = [(k, t, "en", draw.choice("abc")) for k, t in enumerate(texts)]
    toxic = {k for k, t in enumerate(texts) if "moron" in t}
    os.makedirs(tmp_path / "sf")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k in range(len(texts)) if k % 5], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "sf/labels.parquet"))
    docs = make(rows)
    docs.write.parquet(str(tmp_path / "sf/documents.parquet"))
    seen = [docs]
    for name, stage in pipeline.STAGES:
        out = stage(spark, seen[-1], str(tmp_path / "sf"))
        out.write.parquet(str(tmp_path / name))
        seen.append(spark.read.parquet(str(tmp_path / name)))
    ids = [sorted(r.doc_id for r in s.collect()) for s in seen]
    assert all(s.columns == docs.columns for s in seen[:-1])
    assert ids[1] == [k for k in range(len(texts)) if k not in toxic]
    first = {}
    for k in ids[1]:
        first.setdefault(norm(texts[k]), k)
    assert ids[2] == sorted(first.values())
    classes = brute({k: texts[k] for k in ids[2]})
    assert ids[3] == sorted({c for c, _ in classes.values()})
    copies = {r.doc_id: r.copies for r in mixing.mix(seen[3]).collect()}
    assert Counter(ids[4]) == +Counter(copies)
    assert len(ids[5]) == len(ids[4]) and packing.CAPACITY == 2048
    # the same by run()
    assert sorted(r.doc_id for r in pipeline.run(spark, str(tmp_path / "sf")).collect()) == ids[5]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_queries_of_operators_on_driver_tables(spark):
    import duckdb

    from scorelake.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    for t in ("documents", "labels", "pages", "benchmark"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, run in QUERIES.items():
        got = run(spark, SF).toPandas()
        assert len(got) >= (50 if "urls" in name else 200)
        if name in ORACLE_SQL:
            want = c.execute(ORACLE_SQL[name]).df()
            cols = sorted(want.columns)
            got = got.astype({c: "Int64" for c in cols if str(want[c].dtype) == "Int64"})  # whole numbers with nulls
            assert cols == sorted(got.columns) and sorted(map(tuple, got[cols].astype(str).values)) == sorted(map(tuple, want[cols].astype(str).values)), name
