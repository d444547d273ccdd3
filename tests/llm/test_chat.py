from conftest import same

from maskwright.llm import chat


def test_query_is_its_sql(spark, sf, duck):
    same(chat.query(spark, sf), duck, chat.ORACLE_SQL)


def test_snapshots_repeats_and_nulls(spark, duck):
    full = [("user", "a"), ("assistant", "b"), ("user", "c")]
    rows = [(1, i, r, t) for i, (r, t) in enumerate(full[:1])] + [(2, i, r, t) for i, (r, t) in enumerate(full[:2])] + [(3, i, r, t) for i, (r, t) in enumerate(full)]
    rows += [(None, 0, "user", "stranger"), (None, 0, "user", "z"), (None, 1, "assistant", "x" * 300_000)]
    rows += [(4, 10 * i, r, t) for i, (r, t) in enumerate(full)] + rows[-1:] + [(5, 0, None, None), (6, 0, "user", "b"), (6, 1, "assistant", "a"), (None, 0, "user", "z"), (7, 0, "user", "q"), (7, 0, "user", "p")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    found = chat.format_chats(df).collect()
    out = {r.conv_id: (r.n_turns, r.n_equal, r.chat) for r in found}
    assert set(out) == {3, 5, 6, 7, None} and out[3][:2] == (3, 2)
    lone = sorted(r.chat for r in found if r.conv_id is None)
    assert len(found) == 7 and len(lone) == 3 and all(r.n_turns == 1 for r in found if r.conv_id is None) and max(map(len, lone)) > 300_000
    duck.register("odd_chats", df.drop("n_turns").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    same(chat.format_chats(df), duck, chat.ORACLE_SQL.replace("FROM conversations", "FROM odd_chats"))
    assert out[5][2] == "<|im_start|>unknown\n<|im_end|>\n" and out[7][2].index("p") < out[7][2].index("q")
    assert chat.format_chats(df.limit(0)).count() == 0
