"""A registered query beside its SQL."""

SMALL = "/root/testdata/sf0.001"


def compare(spark, name, sf_dir=SMALL):
    """A registered query's rows and its SQL's, both sorted, as (columns, rows)."""
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    ours = sorted((tuple(str(r[c]) for c in columns) for r in df.collect()))
    rel = con.sql(entry.oracle_sql()[name])
    at = [rel.columns.index(c) for c in columns]
    theirs = sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())
    assert sorted(rel.columns) == columns
    return ours, theirs
