import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from flowloom.llm import chat
from flowloom.llm.queries import QUERIES, SQL

NASTY = st.lists(st.sampled_from(["\\", "#", "##", "###", "### ", "</turn>", "<", "/turn>", ":", ": ", "\n", "é", "x", "🙂"]), max_size=12).map("".join)


@given(st.lists(st.tuples(NASTY, NASTY), max_size=5))
def test_template_is_reversible(turns):
    text = "".join(chat.render(r, t)[0] for r, t in turns)
    assert list(chat.read_turns(text)) == turns
    for r, t in turns:
        whole, a, b = chat.render(r, t)
        assert chat.unescape(whole[a:b]) == t


def slow(turns):
    """Digest columns of one conversation's ordered (role, text) turns."""
    loss = "".join(t for r, t in turns if r == "assistant")
    text = "".join(f"{r}\n{t}\n" for r, t in turns)
    sizes, upto = 0, 0
    for i, (r, t) in enumerate(turns):
        upto += len(chat.render(r, t)[0])
        sizes += upto if r == "assistant" or i == len(turns) - 1 else 0
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(text), len(loss), sha(loss), sizes


def check(rows, turns):
    by = {}
    for c, n, r, t in turns:
        by.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    want = {c: slow([x[2:] for x in sorted(v)]) for c, v in by.items()}
    assert {r["conv_id"]: tuple(r)[1:] for r in rows} == want and len(rows) == len(want)


def test_edge_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", ""), (1, 1, "assistant", ""), (2, None, "assistant", "a </turn>"), (2, 3, None, "x" * 70000), (None, 0, "assistant", "\\### "), (3, 0, "system", "only"), (4, 2, "assistant", "second"), (4, 1, "ass: istant", "first")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, example string")
    examples = chat.format_conversations(df)
    check(chat.read_back(examples).collect(), rows)
    for r in examples.collect():
        if r["loss_start"] is not None:
            last = list(chat.read_turns(r["text"]))[-1]
            assert last == ("assistant", chat.unescape(r["text"][r["loss_start"] : r["loss_end"]]))
    assert examples.filter("loss_start IS NOT NULL").count() == 5
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []


def test_whole_table(spark, sf):
    turns = [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    probe = r"\### Assistant: </turn> ok"
    check(QUERIES["op4_chat_prefix_targets"](spark, sf).collect(), [*turns, (-7, 0, "user", probe), (-7, 1, "assistant", probe)])
    assert "op4_chat_prefix_targets" in SQL


def test_written_examples_are_read_back(spark, tmp_path):
    """Examples that were written, read again and spread over other partitions."""
    rows = [(c, n, "user" if n % 2 == 0 else "assistant", f"text {c} {n}") for c in range(9) for n in range(7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    chat.format_conversations(df).write.parquet(str(tmp_path / "chat"))
    again = spark.read.parquet(str(tmp_path / "chat")).repartition(5, "text")
    check(chat.read_back(again).collect(), rows)
    assert sorted(map(str, chat.read_back(again).collect())) == sorted(map(str, chat.read_back(chat.format_conversations(df), in_order=True).collect()))
    broken = again.filter("NOT (conv_id = 3 AND example = 1)").union(again.filter("conv_id = 4 AND example = 0").selectExpr("3L", "1", "text", "loss_start", "loss_end"))
    with pytest.raises(Exception, match="does not continue"):
        chat.read_back(broken).collect()
