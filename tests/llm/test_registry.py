"""The queries that have SQL against DuckDB, also on a table with nulls, repeats and odd texts."""

import duckdb
import pytest
from fixtures import documents, table

from shoal.llm import registry


def same(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"create view {t} as select * from read_parquet(['{folder}/{t}.parquet', '{folder}/{t}.parquet/*.parquet'][{1 if folder.endswith('sf0.001') else 2}])")
    got, want = registry.QUERIES[name](spark, folder), con.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    plain = lambda rows: sorted(str([float(v) if isinstance(v, float) else v for v in r]) for r in rows)
    assert plain(got.select(order).collect()) == plain(want.select(*order).fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, tmp_path, name):
    same(spark, name, sf)
    table(spark, documents()).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    urls = [None, "", "none", "http://", "HTTPS://WWW.Example.Com/en/x?y", "http://a.example.com/en/", "http://example.com", "x://b.net/fr/#z", "http://net/es/", "http://notnet/es/", "http://b.net/es/", "http://b.net/es/"]
    spark.createDataFrame([(i if i % 5 else None, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    vectors = [[((i * 7 + j) % 11 - 5) / 8 + (0.003 if i % 4 else 0) for j in range(64)] for i in range(60)] + [None, [], [0.0] * 63, [float("nan")] * 64, [0.25] * 64, [0.25] * 64]
    spark.createDataFrame([(i if i != 9 else None, v, i % 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    same(spark, name, str(tmp_path))
