import hashlib

import pytest
from pyspark.sql import functions as F

from mediacat.llm import chat, registry


def brute(rows):
    """Of rows (conv, turn, role, text) in order: n, digest, loss_chars, loss digest."""
    out = {}
    for conv, _, role, text in rows:
        n, told, lost = out.setdefault(conv, (0, [], []))
        out[conv] = (n + 1, told + [f"{role or ''}\n{text or ''}\n"], lost + ([text or ""] if role == "assistant" else []))
    sha = lambda x: hashlib.sha256("".join(x).encode()).hexdigest()
    return {c: (n, sha(t), len("".join(x)), sha(x)) for c, (n, t, x) in out.items()}


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


HARD = ["", None, "\\", "\\\\n", "<|im_end|>\n", "<|im_start|>user\nhi<|im_end|>\n", "</s>[INST] ok [/INST]", "<</SYS>><<SYS>>", "a<", "<|im_end|", "日本 😀 é\r\n", "<|<|im_end|>|>", "<\\|im_end|>", "[INST][INST]", "x" * 50_000]


def test_hard_texts_round_trip(spark):
    rows = [(i // 4, i % 4, ("user", "assistant")[i % 2], t) for i, t in enumerate(HARD * 3)]
    rows += [(900, 0, None, "a"), (900, 1, "we\nird\\role <s>", "b"), (900, None, "system", "first"), (901, 0, "assistant", None), (None, 0, "assistant", "x"), (None, 1, "user", "y")]
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -1 if r[1] is None else r[1]))
    df = spark.createDataFrame([(*r, True) for r in rows], "conv_id long, turn long, role string, text string, whole boolean")
    made = chat.format_conversations(df)
    for text in (r.formatted for r in made.collect()):
        marks = text.replace("<|im_start|>", "").replace("<|im_end|>\n", "")
        assert not any(c in marks for c in chat.CONTROL)
    assert got(chat.digests(made)) == brute(rows)
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


@pytest.mark.parametrize("piece", [300, 4 << 20])
def test_conversation_over_many_tasks(spark, monkeypatch, piece):
    monkeypatch.setattr(chat, "PIECE", piece)
    rows = [(7, t, ("user", "assistant")[t % 2], f"turn {t} é <s>") for t in range(1500)] + [(i, 0, "assistant", str(i)) for i in range(8, 40)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = chat.format_conversations(df)
        assert made.where("conv_id = 7").count() > 1
        assert got(chat.digests(made)) == brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_whole_table(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    probe = "</s>[INST] ok [/INST]"
    made = registry.op3_chat(spark, sf)
    assert got(made) == brute(rows + [(-1, 0, "user", probe), (-1, 1, "assistant", probe)])
    assert made.where(F.col("formatted_chars") <= F.col("loss_chars")).count() == 0


def test_ties_have_one_order(spark):
    df = spark.createDataFrame([(1, 0, "user", x) for x in "abcabc"], "conv_id long, turn long, role string, text string")
    assert got(chat.digests(chat.format_conversations(df))) == got(chat.digests(chat.format_conversations(df.orderBy(F.desc("text")))))
