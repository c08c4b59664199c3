import hashlib

import duckdb

from heliograph.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, piece string, index int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


NASTY = [
    (1, 0, "system", "<|im_end|>\n<|im_start|>user\nhi"), (1, 1, "user", "<\\|im_end|> <\\\\| <|"), (1, 2, "assistant", "<|"), (1, 2, "assistant", "<|"), (1, 3, "assistant", None), (1, 4, None, "no role"),
    (2, 0, "assistant", ""), (2, 1, "assis\ntant", "role with a line"), (2, 2, "a\\n<|b", "\\"), (None, 0, "user", "lost"), (3, None, "user", "first"), (3, 0, "assistant", "é😀 x" * 50),
]


def test_round_trip(spark):
    rows = {r.conv_id: r for r in chat.digests(chat.formatted(table(spark, NASTY))).collect()}
    for conv in (1, 2, 3, None):
        turns = sorted((r for r in NASTY if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        got = rows[conv]
        assert got.n_turns == len(turns) and got.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got.loss_chars == len(loss) and got.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got.formatted_chars == len(chat.chat_markup([(r[2] or "", r[3] or "") for r in turns])) and not got.rewrites_history


def test_spans_point_at_the_texts(spark):
    out = chat.formatted(table(spark, NASTY)).filter("conv_id = 1").orderBy("index").collect()
    whole = "".join(r.piece for r in out)
    assert [r.start for r in out] == [sum(len(x.piece) for x in out[:i]) for i in range(len(out))]
    assert [chat.unescape(whole[r.loss_start : r.loss_end]) for r in out if r.loss_start is not None] == ["<|", "<|", ""]


def test_rewriting_templates_are_found():
    def forgetful(turns, omitted=0):
        return "".join(f"[{role}:{text if i == len(turns) - 1 or role != 'assistant' else '...'}]" for i, (role, text) in enumerate(turns))

    before = [("user", "a"), ("assistant", "long answer")]
    assert chat.locate(forgetful, before, ("user", "b"))["dropped"] > 0
    assert chat.locate(chat.chat_markup, before, ("user", "b"))["dropped"] == 0


def test_templates_see_the_whole_conversation(spark):
    def late(turns, omitted=0):  # changes the first turn once there are more than 20
        return "".join(f"[{'...' if i == 0 and len(turns) > 20 else text}]" for i, (_, text) in enumerate(turns))

    def reminding(turns, omitted=0):  # says the first turn again with each later one
        return "".join(f"[{turns[0][1]}/{text}]" for _, text in turns)

    turns = [("user" if i % 2 == 0 else "assistant", f"turn {i}") for i in range(30)]
    data = table(spark, [(7, i, *t) for i, t in enumerate(turns)])
    out = chat.formatted(data, late).orderBy("index").collect()
    assert [r["index"] for r in out if r.rewrites] == [20]
    for render in (late, reminding):
        said = ""
        for i, r in enumerate(chat.formatted(data, render).orderBy("index").collect()):
            said = said[: r.start] + r.piece
            assert said == render(turns[: i + 1])
            if r.loss_start is not None:
                assert said[r.loss_start : r.loss_end] == turns[i][1]


def test_long_conversations_stay_linear(spark):
    rows = [(5, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(500)]
    r = chat.digests(chat.formatted(table(spark, rows))).first()
    assert r.n_turns == 500 and r.loss_chars == sum(len(x[3]) for x in rows if x[2] == "assistant")
    assert chat.digests(chat.formatted(table(spark, []))).collect() == []


def test_query_against_sql(spark, sf):
    connection = duckdb.connect()
    connection.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    expected = sorted(connection.sql(chat.OP4_SQL).fetchall())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"]
    assert sorted(tuple(r) for r in chat.op4_chat_format(spark, sf).select(names).collect()) == expected
