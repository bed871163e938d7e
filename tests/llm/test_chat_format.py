import duckdb
import pandas as pd
import pytest

from shelfscope.llm.chat_format import format_chats
from shelfscope.llm.queries import SQL, quoting

ROWS = [
    (1, 0, "user", "Hello there.\n\nHow  are you?"), (1, 1, "assistant", "Fine."), (1, 2, "user", "On Monday bob wrote:\n> hello THERE.\nthanks"),
    (1, 3, "assistant", "> > Hello there.\n> thanks\nwelcome"), (1, 4, "user", "> nobody said\nhm"), (1, 5, "user", "> welcome\n> \n\nok"),
    (2, 0, "user", None), (2, 1, None, "x"), (2, 1, None, "x"), (None, 0, "user", "> x"), (3, None, "user", "a"), (3, 0, "user", "> a\nb"),
    (4, 0, "user", ""), (4, 1, "user", "> > deep\n>wide\n>\tx"), (4, 2, "a", ">deep"), (5, 0, "u", "q" * 30_000), (5, 1, "u", "> " + "q" * 30_000),
    (6, 0, "user", "first line\nsecond line"), (6, 1, "bot", "> first line\r\n> second line\r\nyes"), (6, 2, "user", "> yes\n> > second line\nwhy"), (6, 3, "bot", "someone wrote:\nno quote here"),
]


def plain(frame, columns):
    show = lambda x: None if pd.isna(x) else x if isinstance(x, str) else int(x)
    return sorted(str([show(x) for x in row]) for row in frame[columns].astype(object).to_numpy().tolist())


@pytest.mark.parametrize("hot_rows", [None, 2])
def test_matches_recursive_sql(corpus_session, hot_rows):
    messages = corpus_session.createDataFrame([(*r, 1) for r in ROWS], "conv_id long, turn long, role string, text string, position int")
    got = format_chats(messages, hot_rows).toPandas()
    connection = duckdb.connect()
    connection.register("conversations", messages.drop("position").toPandas().astype({"conv_id": "Int64", "turn": "Int64"}))
    want = connection.execute(SQL["op5_chat_format"]).df()
    assert plain(got, sorted(want.columns)) == plain(want, sorted(want.columns))


def test_replies_follow_what_they_answer(corpus_session):
    messages = corpus_session.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    chat = [r for r in format_chats(messages).filter("conv_id = 1").orderBy("position").collect()]
    assert [(r.turn, r.parent_turn, r.depth) for r in chat] == [(0, None, 0), (2, 0, 1), (3, 2, 2), (5, 3, 3), (1, None, 0), (4, None, 0)]
    assert [r.content for r in chat] == ["Hello there.\n\nHow  are you?", "thanks", "welcome", "ok", "Fine.", "hm"]
    assert chat[1].formatted == "<|user|>\nthanks\n<|end|>"


def test_long_chain_and_empty_table(corpus_session):
    chain = [(1, i, "u", f"> line {i - 1}\nline {i}") for i in range(40)]
    messages = corpus_session.createDataFrame(chain, "conv_id long, turn long, role string, text string")
    assert [r.depth for r in format_chats(messages).orderBy("turn").collect()] == list(range(40))
    assert format_chats(messages.limit(0)).collect() == []


def test_quoted_form_is_read_back(corpus_session):
    rows = [(1, t, f"r{t}", f"text of turn {t}\nand more") for t in range(6)] + [(1, 1, "again", None), (2, 0, None, None), (2, 1, "u", "alone"), (None, 1, "u", "x"), (3, None, "u", "y")]
    messages = corpus_session.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    asked = quoting(messages)
    text = {(r.conv_id, r.turn, r.role): r.text for r in asked.collect()}
    assert len(text) == len(rows) == asked.count()
    assert text[1, 2, "r2"] == "r1 wrote:\n> text of turn 1\n> and more\ntext of turn 2\nand more" and text[1, 1, "again"] == text[2, 0, None] == ""
    assert text[1, 5, "r5"].startswith("r3 wrote:\n> r1 wrote:\n> > text of turn 1\n> > and more\n> text of turn 3\n") and text[2, 1, "u"] == "alone" and text[3, None, "u"] == "y"
    got = {(r.conv_id, r.turn, r.role): r for r in format_chats(asked).collect()}
    assert {k[1:]: r.parent_turn for k, r in got.items() if k[0] == 1} == {(0, "r0"): None, (1, "r1"): None, (1, "again"): None, (2, "r2"): 1, (3, "r3"): 1, (4, "r4"): 3, (5, "r5"): 3}
    assert all(got[1, t, f"r{t}"].content == f"text of turn {t}\nand more" for t in range(6)) and got[1, 4, "r4"].depth == 2
    assert quoting(messages.limit(0)).collect() == []
