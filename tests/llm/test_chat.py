from bandloom.llm import chat

ROWS = [
    (1, 0, "user", "How do I bake good bread?\n\nI have flour and water."),
    (1, 1, "assistant", "On Monday user wrote:\n> How do I bake good bread?\nUse a hot oven and wait."),
    (1, 2, "user", "> I  have FLOUR and\n> water.\nIs salt needed as well?"),
    (1, 3, "assistant", "> > How do I bake good bread?\n> Use a hot oven and wait.\nYes, for one hour."),
    (1, 4, "user", "no quote at all"),
    (2, 0, "user", "> How do I bake good bread?\nQuoted from another conversation."),
    (2, 2, "user", "a turn is missing before this"),
    (3, 0, "user", None),
    (3, 1, "user", ""),
    (3, 1, "user", ""),
    (None, 1, "user", "> nobody\nno conversation"),
    (4, None, "user", "no turn"),
    (5, 0, "user", "x" * 50_000),
]
SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_links_threads_and_texts(spark):
    df = spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 AS depth", "'x' AS parent_turn", "'y' AS own").repartition(3)
    got = chat.conversations_without_quotes(df).collect()
    assert len(got) == len(ROWS)
    by = {(r.conv_id, r.turn): r for r in got}
    assert [by[1, t].parent_turn for t in range(5)] == [None, 0, 0, 1, 3]
    assert [by[1, t].depth for t in range(5)] == [0, 1, 1, 2, 3]
    assert {by[1, t].root_turn for t in range(5)} == {0}
    assert by[1, 1].text == "Use a hot oven and wait."
    assert by[1, 2].text == "Is salt needed as well?"
    assert (by[1, 3].text, by[1, 3].n_quoted_lines) == ("Yes, for one hour.", 2)
    assert (by[2, 0].parent_turn, by[2, 0].n_linked, by[2, 0].text) == (None, 0, "Quoted from another conversation.")
    assert (by[2, 2].parent_turn, by[2, 2].root_turn) == (None, 2)
    assert (by[3, 0].text, by[3, 1].parent_turn) == ("", 0)
    assert (by[None, 1].parent_turn, by[None, 1].text) == (None, "no conversation")
    assert (by[4, None].depth, by[4, None].root_turn) == (0, None)
    assert chat.conversations_without_quotes(df.limit(0)).count() == 0


def test_common_phrase_links_to_the_first(spark):
    rows = [(1, t, "u", "Thank you very much") for t in range(40)] + [(1, 40, "u", "> thank you very much\nwelcome")]
    got = {r.turn: r for r in chat.conversations_without_quotes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert (got[40].parent_turn, got[40].depth, got[39].depth) == (0, 1, 39)


def test_short_quotes_are_linked(spark):
    said = ["Shall we go there tomorrow?", "yes", "I have no idea what you mean", "> yes\nwhy?", "> 好\n> no\nfine"]
    got = {r.turn: r for r in chat.conversations_without_quotes(spark.createDataFrame([(1, t, "u", x) for t, x in enumerate(said)], SCHEMA)).collect()}
    assert (got[3].parent_turn, got[3].n_linked, got[3].text) == (1, 1, "why?")
    assert (got[4].parent_turn, got[4].n_linked, got[4].text) == (3, 0, "fine")


def test_levels():
    assert chat.quote_level("> > a") == (2, "a")
    assert chat.quote_level(">>a") == (2, "a")
    assert chat.quote_level("  > a") == (1, "a")
    assert chat.quote_level("a > b") == (0, "a > b")
    body, quoted, own, quotes = chat.parse("x > y\n\n\n\nend")
    assert (body, quoted, quotes) == ("x > y\n\n\n\nend", 0, [])
