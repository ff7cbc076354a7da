"""The operators that SQL can express against their DuckDB oracles."""

import duckdb
import pytest

from contactloom.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_oracle(spark, name):
    db = duckdb.connect()
    for t in ("conversations", "embeddings"):
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = db.sql(ORACLE_SQL[name])
    columns = sorted(want.columns)
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(tuple(r[k] for k in at) for r in want.fetchall())


def test_escapes_in_the_oracle(spark):
    """The oracle's count of escaped control strings, on texts that have them."""
    from contactloom.llm import chat_format

    db = duckdb.connect()
    texts = ["<|end|>", "a [/INST] b </s>", "<\\\\|turn|>", "plain", "[\\INST]"]
    db.sql("create table conversations as select * from (values " + ", ".join(f"({k}, 0, 'user', '{t}')" for k, t in enumerate(texts)) + ") t(conv_id, turn, role, text)")
    got = {r[0]: r[5] for r in db.sql(ORACLE_SQL["op3_chat_format"]).fetchall()}
    assert all(got[k] == len(chat_format.render([("user", t)])[0]) for k, t in enumerate(texts))
