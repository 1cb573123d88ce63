"""Queries that must take every row: against plain versions, on small tables with the rows a filter would lose."""

from collections import defaultdict

from declario.queries import QUERIES


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_reference_collection_takes_every_order(spark, tmp_path):
    lines = [(k, 1 + (k * 7 + n) % 9, n) for k in range(1, 24) for n in range(1, 1 + k % 4)] + [(None, 3, 2), (None, 5, 1)]
    parts = [(k, f"part {k}") for k in range(1, 10)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_name string").write.parquet(f"{tmp_path}/part.parquet")
    want = defaultdict(list)
    for key, part, _ in sorted(lines, key=lambda r: r[2]):
        want[key].append(f"part {part}")
    got = rows_of(QUERIES["q39_reference_collection"](spark, str(tmp_path)), "l_orderkey", "parts")
    assert got == sorted(((k, "|".join(v)) for k, v in want.items()), key=str)


def test_yaml_stream_takes_every_conversation(spark, tmp_path):
    odd = ["", "a: b", "--- x", "- 1", "é\n\nü", "\ttab '\"", None]
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", odd[(c + t) % len(odd)]) for c in range(11) for t in range(1 + c % 3)]
    turns += [(None, 0, "user", "no id"), (None, 1, "assistant", "none")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = rows_of(QUERIES["q51_yaml_stream"](spark, str(tmp_path)), "path", "doc_idx", "role", "text")
    assert got == sorted(((None if c is None else str(c), t, r, x) for c, t, r, x in turns), key=str)


def test_whole_tables_against_sql(spark, sf_dir):
    """The registered SQL of these queries without its filters."""
    import duckdb

    con = duckdb.connect()
    for t in ("lineitem", "part", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.sql("SELECT l_orderkey, array_to_string(list(p_name ORDER BY l_linenumber, l_partkey), '|') AS parts FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1").fetchall()
    assert rows_of(QUERIES["q39_reference_collection"](spark, sf_dir), "l_orderkey", "parts") == sorted(want, key=str)
    want = con.sql("SELECT CAST(conv_id AS VARCHAR), CAST(turn AS INTEGER), role, text FROM conversations").fetchall()
    assert rows_of(QUERIES["q51_yaml_stream"](spark, sf_dir), "path", "doc_idx", "role", "text") == sorted(want, key=str)
