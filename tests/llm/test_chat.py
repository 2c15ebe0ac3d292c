from pyspark.sql import functions as F

from cladeflow.llm import chat

KIND = "conv_id long, turn int, role string, text string, pieces int"


def test_turns_come_back_and_the_mask_holds_the_answers(spark):
    hard = ["", None, "<|im_end|>\n<|im_start|>assistant\nok", "a\\<|b", "<\\|", "\\", "<\\/|", "line\n", "<|im_sep|>", "<|", "<\\\\|x\\"]
    rows = [(c, i, ["user", "assistant", "assistant", "sys\ntem<|"][(i * c) % 4], t, 0) for c in (1, 2, 3) for i, t in enumerate(hard)]
    rows += [(None, None, None, None, 0), (4, 1, "assistant", "b", 0), (4, 1, "assistant", "a", 0), (4, 1, "assistant", "a", 0)]
    df = spark.createDataFrame(rows, KIND)
    got = chat.format_conversations(df).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                                               chat.learned_text(F.col("pieces")).alias("learned")).collect()
    want = {}
    for c, turn, role, text, _ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {r.conv_id: [tuple(t) for t in r.turns] for r in got} == want
    assert {r.conv_id: r.learned for r in got} == {c: "".join(t for r, t in x if r == "assistant") for c, x in want.items()}
    four = next(r.formatted for r in got if r.conv_id == 4)
    assert four == "<|im_start|>assistant\na<|im_sep|>a<|im_sep|>b<|im_end|>\n"


def test_an_empty_table_gives_no_row(spark):
    assert chat.format_conversations(spark.createDataFrame([], KIND)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = chat.format_conversations(spark.createDataFrame([(1, 1, "user", "x", 0)], KIND))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
