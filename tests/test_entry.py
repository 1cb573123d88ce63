import __spark_entry__ as e


def test_entry(spark):
    assert e.entry(spark).limit(1).count() == 1


def test_oracles_belong_to_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_queries_match_their_sql(spark, sf_dir):
    import duckdb

    from declario.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings labels conversations".split():
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")

    def rounded(v):
        return round(v, 6) if isinstance(v, float) else v

    for name in ("q01_ref_resolve_chain", "q09_set_difference_bag", "q16_consolidate_route", "q18_chunk_pattern", "q24_diff_score_pairs", "q29_json_roundtrip", "q35_positional_slice"):
        df = QUERIES[name](spark, sf_dir)
        cols = sorted(df.columns)
        got = sorted((tuple(rounded(r[c]) for c in cols) for r in df.collect()), key=str)
        r = con.execute(ORACLE_SQL[name])
        names = [d[0] for d in r.description]
        want = sorted((tuple(rounded(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=str)
        assert got == want, name
