import hashlib
import math
import os
import random
import re
import subprocess
import sys
from pathlib import Path

from corpusmill.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def esc(t):
    return re.sub(r"([<\[])(\\*)(\||/?s>|/?INST\]|<SYS>>|</SYS>>)", r"\1\\\2\3", t)


def brute(rows, budget, history):
    """Windows per conversation: list of (text, n_repeated, loss texts)."""
    low = lambda x: (x is not None, x)
    by = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (low(r[0]), low(r[1]), r[2] or "", esc(r[3] or ""))):
        by.setdefault(c, []).append((role or "", text or ""))
    out = {}
    for c, turns in by.items():
        tk = [math.ceil(len(esc(t)) / 4) + 4 for _, t in turns]
        s = 1 if turns[0][0] == "system" else 0
        room = max(1, budget - history - (tk[0] if s else 0))
        cuts, used = [0], 0
        for i in range(s, len(turns)):
            if i > s and used + tk[i] > room:
                cuts.append(i)
                used = 0
            used += tk[i]
        wins = []
        for w, a in enumerate(cuts):
            b = cuts[w + 1] if w + 1 < len(cuts) else len(turns)
            rep = []
            if w:
                j, left = a, history
                while j > s and tk[j - 1] <= left:
                    j -= 1
                    left -= tk[j]
                rep = turns[:s] + turns[j:a]
            text = "".join(f"<|turn|>{r}\n{esc(t)}<|end|>\n" for r, t in rep + turns[a:b])
            wins.append((text, len(rep), [t for r, t in turns[a:b] if r == "assistant"]))
        out[c] = turns, wins
    return out


def sample():
    rnd = random.Random(3)
    bits = ["a", "word ", "<|", "<\\|", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\n", "<", "|", "\\", "[", "é", "𝔘", "<|end|>\n", "<|turn|>x\n"]
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (1, None, None, None), (1, None, None, None), (2, 0, "system", "x" * 900)]
    for c in range(3, 40):
        for t in range(rnd.randint(1, 25)):
            role = "system" if t == 0 and c % 2 else rnd.choice(["user", "assistant", "assistant", "", None, "tool\nx"])
            rows.append((c, t, role, None if rnd.random() < 0.05 else "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 60)))))
    return rows


def test_windows_match_brute_force(spark):
    rows = sample()
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", window int")
    for budget, history in ((80, 30), (300, 0), (2048, 512)):
        want = brute(rows, budget, history)
        win = chat.format_windows(df, budget, history).cache()
        got = {}
        for r in win.orderBy("window").collect():
            got.setdefault(r.conv_id, []).append((r.text.replace("tool%0Ax", "tool\nx"), r.n_repeated, [r.text[a:b] for a, b in r.loss_spans]))
        assert {c: [(t, n, [esc(x) for x in l]) for t, n, l in w] for c, (_, w) in want.items()} == got
        for r in chat.read_windows(win).collect():
            turns, wins = want[r.conv_id]
            assert [tuple(x) for x in r.turns] == turns
            assert r.loss_text == "".join(t for role, t in turns if role == "assistant")
            assert r.formatted_chars == sum(len(w[0]) + w[0].count("<|turn|>tool\nx") * 2 for w in wins)


def test_query_and_empty(spark, tmp_path):
    from corpusmill.llm.queries import op7_chat_format

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    (r,) = op7_chat_format(spark, str(tmp_path)).collect()
    t = "</s>[INST] ok [/INST]"
    assert (r.conv_id, r.n_turns, r.loss_chars) == (-7, 2, len(t))
    assert r.turns_sha256 == hashlib.sha256(f"user\n{t}\nassistant\n{t}\n".encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256(t.encode()).hexdigest()


LONG = """
from pyspark.sql import SparkSession, functions as F
from corpusmill.llm import chat
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
i = F.col("id")
role = F.when(i == 0, "system").when(i % 2 == 1, "user").otherwise("assistant")
rows = spark.range(50_000).select(F.lit(1).cast("long").alias("conv_id"), i.alias("turn"), role.alias("role"), F.concat(F.repeat(F.lit("word "), 60), i.cast("string")).alias("text"))
got = chat.read_windows(chat.format_windows(rows)).select("conv_id", F.size("turns").alias("n"), F.length("loss_text").alias("loss"), "formatted_chars").collect()
print("RESULT", *got[0], len(got))
"""


def test_a_very_long_conversation_in_a_small_heap():
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--driver-memory 2g pyspark-shell", "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    out = subprocess.run([sys.executable, "-c", LONG], env=env, capture_output=True, text=True, timeout=600).stdout
    want = sum(300 + len(str(i)) for i in range(2, 50_000, 2))
    got = out.split("RESULT", 1)[1].split()
    assert got[:3] == ["1", "50000", str(want)] and got[4] == "1" and int(got[3]) > 2 * want
