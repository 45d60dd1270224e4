"""Templates that are not turn by turn, on conversations longer than a chunk."""

import pytest
from slotloom.llm import chat

N = 3 * chat.CHUNK + 4


def headed(turns):
    """Opens with a header, escapes nothing."""
    return "<begin>\n" + "".join(f"<{r}>{t}<end>\n" for r, t in turns)


def forgetful(turns):
    """Drops the texts of assistants over 40 turns back, thus rewriting what was put out in an earlier chunk."""
    return "".join(f"<{r}>{'...' if r == 'assistant' and i < len(turns) - 40 else t}<end>\n" for i, (r, t) in enumerate(turns))


def conversation(spark):
    turns = [(("user", "assistant")[i % 2], rf"t{i} \\ ### </turn> {'<end>' * (i % 3)}") for i in range(N)]
    return turns, spark.createDataFrame([(1, i, r, t) for i, (r, t) in enumerate(turns)], "conv_id long, turn long, role string, text string")


def test_header_once_and_texts_found(spark):
    turns, df = conversation(spark)
    (row,) = chat.format_chats(df, headed).collect()
    assert row.formatted == headed(turns) and all(s.kept for s in row.spans)
    assert [row.formatted[s.text_start : s.text_end] for s in row.spans] == [t for _, t in turns]


def test_rewriting_of_an_earlier_chunk(spark):
    turns, df = conversation(spark)
    (row,) = chat.format_chats(df, forgetful).collect()
    assert row.formatted == forgetful(turns) and [s.kept for s in row.spans] == [x for *_, x in chat.locate(turns, forgetful)[1]]
    assert not all(s.kept for s in row.spans)
    for i, s in enumerate(row.spans):
        gone = i % 2 and i < N - 40
        assert row.formatted[s.text_start : s.text_end] == ("" if gone else turns[i][1])


def test_wrongly_declared_template(spark):
    def other(turns):
        return headed(turns)

    other.turn_local = True
    with pytest.raises(Exception, match="turn-local"):
        chat.format_chats(conversation(spark)[1], other).collect()
