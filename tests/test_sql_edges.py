"""Queries and their SQL on tables made to have the odd cases: zeros with a sign, recordings that end early."""

import duckdb

import __spark_entry__


def both(spark, tmp_path, name, table, rows, schema):
    """Rows of the query and of its SQL as text, so that -0.0 is not 0.0."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    df = __spark_entry__.queries()[name](spark, str(tmp_path))
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = con.sql(f"SELECT {columns} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    text = lambda rows: sorted(repr([list(v) if isinstance(v, (list, tuple)) else v for v in r]) for r in rows)
    return text(map(tuple, df.collect())), text(want)


EMBEDDINGS = "vec_id long, label long, embedding array<float>"


def test_small_negative_components_keep_their_sign(spark, tmp_path):
    vectors = [(i, i % 3, [-1e-7 if i % 2 else 1e-7, 1.0, -1.0 - i]) for i in range(6)]
    got, want = both(spark, tmp_path / "h1", "H1_l2_normalize", "embeddings", vectors, EMBEDDINGS)
    assert got == want and "-0.0" in str(want)
    got, want = both(spark, tmp_path / "h16", "H16_blend_centroid", "embeddings", vectors, EMBEDDINGS)
    assert got == want and "-0.0" in str(want)


def test_a_recording_that_ends_early_has_no_later_set(spark, tmp_path):
    vectors = [(i, i % 4, [float(i % 4 == k) + 0.3 * ((i * 7 + k) % 5) for k in range(4)]) for i in range(32)]  # the second recording has 7
    got, want = both(spark, tmp_path, "G1_participant_diff", "embeddings", vectors, EMBEDDINGS)
    assert got == want and len(want) == 2 and "None" in str(want)
