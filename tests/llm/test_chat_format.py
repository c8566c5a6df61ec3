from folioflow.llm.chat_format import format_preferences, formatted_pairs, swapped_last_reply

S = "conv_id long, turn long, role string, text string"


def test_prefix_once_and_masks(spark):
    a = [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (1, 2, "user", "more"), (2, 0, "user", "x"), (3, 0, None, None), (3, 0, None, None)]
    b = [(1, 0, "user", "hi"), (1, 1, "assistant", "bad"), (2, 0, "user", "x"), (4, 5, "assistant", "alone")]
    got = {r.conv_id: r for r in format_preferences(spark.createDataFrame(a, S), spark.createDataFrame(b, S)).collect()}
    r = got[1]
    assert r.n_common == 1 and r.prompt == "<|user|>\nhi<|end|>\n"
    assert r.chosen == "<|assistant|>\ngood<|end|>\n<|user|>\nmore<|end|>\n"
    assert r.rejected == "<|assistant|>\nbad<|end|>\n"
    assert r.chosen_mask == [-14, 12, -9, -12] and sum(map(abs, r.chosen_mask)) == len(r.chosen)
    assert got[2].n_common == 1 and got[2].chosen == got[2].rejected == ""
    assert got[3].n_common == 0 and got[3].rejected == "" and got[3].chosen.count("<|end|>") == 2
    assert got[4].chosen == "" and got[4].prompt == ""


def test_empty(spark):
    assert formatted_pairs(spark.createDataFrame([], S)).collect() == []


def test_columns_of_the_helpers_names_and_null_keys(spark):
    rows = [(1, 0, "user", "q", "a", 1), (1, 1, "assistant", None, "b", 2), (2, 0, "assistant", "first", "c", 3), (2, 1, "assistant", "first", "c", 3), (None, 0, "assistant", "x", None, None)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, __last string, __other int")
    swapped = sorted(map(tuple, swapped_last_reply(table).collect()), key=str)
    assert swapped == sorted([(1, 0, "user", "q"), (1, 1, "assistant", "first"), (2, 0, "assistant", "first"), (2, 1, "assistant", "first"), (None, 0, "assistant", "x")], key=str)
    got = {r.conv_id: r for r in formatted_pairs(table).collect()}
    assert sorted(got) == [1, 2] and got[1].n_common == 1
    assert got[1].chosen == "<|assistant|>\n<|end|>\n" and got[1].rejected == "<|assistant|>\nfirst<|end|>\n"


def test_ties_repeated_rows_and_very_long_texts(spark):
    long = "word " * 300_000
    a = [(1, 0, "user", long), (1, 1, "assistant", "b"), (1, 1, "assistant", "a"), (1, 1, "assistant", "a")]
    b = [(1, 1, "assistant", "a"), (1, 0, "user", long), (1, 1, "assistant", "c"), (1, 1, "assistant", "a")]
    r = format_preferences(spark.createDataFrame(a, S), spark.createDataFrame(b, S)).collect()[0]
    assert r.n_common == 3 and len(r.prompt) > len(long)
    assert r.chosen == "<|assistant|>\nb<|end|>\n" and r.rejected == "<|assistant|>\nc<|end|>\n"
