"""Searches within a brand, a turn or a label on nulls, copies and vectors without direction, against their SQL."""

import duckdb
import pytest

from planloom.catalog import ORACLE_SQL, QUERIES


def tables(d):
    part = "select i as p_partkey, case when i % 9 <> 4 then 'b' || i % 2 end as p_brand, case when i % 5 <> 3 then i % 4 end as p_size, 'w' || i % 3 || ' x' as p_name, 't' || i % 2 as p_type from range(60) t(i)"
    rare = "select 1000 + 50 * i as p_partkey, 'rare' || i // 3 as p_brand, case when i % 3 <> 1 then 1 end as p_size, 'w x' as p_name, 't' as p_type from range(8) t(i)"
    talk = "select i::bigint as conv_id, i % 2 as turn, case when i % 7 <> 3 then 'r' || i % 3 end as role, case when i % 11 <> 5 then 'a b' || i % 4 || ' c' || i % 6 end as text from range(90) t(i)"
    vectors = "select i::bigint as vec_id, case when i % 13 <> 6 then i % 4 end as label, case when i % 10 = 8 then null when i % 15 = 5 then [0.0, 0.0, 0.0] else [i % 5 - 2.0, i % 7 - 3.0, 1.0] end::float[] as embedding from range(170) t(i)"
    few = "select 1000 + 20 * i::bigint, 9, case when i = 1 then [0.0, 0.0, 0.0] when i < 3 then [1.0, i, 1.0] end::float[] from range(4) t(i)"
    for name, sql in (("part", f"{part} union all {rare}"), ("conversations", talk), ("embeddings", f"{vectors} union all {few}")):
        duckdb.execute(f"copy ({sql}) to '{d}/{name}.parquet' (format parquet)")


@pytest.mark.parametrize("name", ["structured_topk", "memory_topk", "cosine_topk"])
def test_equals_sql(spark, tmp_path, name):
    tables(tmp_path)
    sql = ORACLE_SQL[name]
    for t in ("part", "conversations", "embeddings"):
        sql = sql.replace(f"from {t}", f"from '{tmp_path}/{t}.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    want = duckdb.execute(sql)
    names = [x[0] for x in want.description]
    assert sorted(map(tuple, got.select(*names).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_cosine_topk_meets_vectors_of_every_label(spark, tmp_path):
    rows = "(20, 1, [1.0, 0.0]), (21, 1, [0.0, 1.0]), (22, 2, [2.0, 0.1]), (23, null, [1.0, 0.0]), (40, null, [0.0, 3.0]), (41, 7, [0.0, 0.0])"
    duckdb.execute(f"copy (select i::bigint as vec_id, l as label, e::float[] as embedding from (values {rows}) t(i, l, e)) to '{tmp_path}/embeddings.parquet' (format parquet)")
    got = QUERIES["cosine_topk"](spark, str(tmp_path)).select("q", "rank", "doc", "score").orderBy("q", "rank").collect()
    assert [(r.q, r["rank"], r.doc) for r in got] == [(20, 1, 23), (20, 2, 22), (20, 3, 21), (40, 1, 21), (40, 2, 22), (40, 3, 20)]
    want = duckdb.execute(ORACLE_SQL["cosine_topk"].replace("from embeddings", f"from '{tmp_path}/embeddings.parquet'")).fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
