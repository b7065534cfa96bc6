"""The queries that SQL can express, against it, on tables with the odd rows too."""

import duckdb
import pyarrow as pa
import pytest

from bindery.llm import quality_rules, substring_dedup
from bindery.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


def sql_rows(sql, documents):
    con = duckdb.connect()
    con.register("documents", documents) if not isinstance(documents, str) else con.execute(f"CREATE VIEW documents AS SELECT * FROM '{documents}'")
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(row[k] for k in order) for row in r.fetchall()), key=repr)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert spark_rows(QUERIES[name](spark, SF)) == sql_rows(ORACLE_SQL[name], f"{SF}/documents.parquet")


def test_odd_rows_equal_sql(spark):
    long = " ".join(f"w{k % 211}" for k in range(900))
    rows = [(1, long), (2, "é\tñ # x\n\n \nx\nx"), (3, ""), (4, None), (5, "a b c d " * 60), (6, "  a  b"), (7, "x" + long[2:]), (7, long), (8, "a " * 70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})
    assert spark_rows(quality_rules.quality_rules(docs).drop("longest_repeat")) == sql_rows(quality_rules.oracle_sql(), table)
    done = substring_dedup.substring_dedup(docs).mapInArrow(substring_dedup._digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    assert spark_rows(done) == sql_rows(substring_dedup.oracle_sql(), table)
