import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from brinewave.llm import chat_windows as C

ODD = "\\### Assistant: </turn> ok"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    rows = []
    for c in range(12):
        if c % 3 == 0:
            rows.append((c, 0, "system", f"be kind {c}"))
        for t in range(1, rng.randrange(2, 30)):
            rows.append((c, t, "user" if t % 2 else "assistant", " ".join(rng.choice(["a", "##", "</turn>", "\\h", "\\", "x:y", "\n"]) for _ in range(rng.randrange(0, 200)))))
    rows += [(20, t, "user" if t % 2 else "assistant", f"turn {t} of many") for t in range(700)]
    rows += [(21, 0, "assistant", "w " * 5000), (22, None, "user", None), (22, 1, None, "x"), (22, 1, None, "x"), (None, 0, "assistant", "lost"), (-7, 0, "user", ODD), (-7, 1, "assistant", ODD), (23, 0, "r: \\c<", "")]
    return rows


@pytest.fixture(scope="module")
def formed(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, tokens int").repartition(4)
    return C.windows(df, budget=128)


def ordered(rows):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in by.items()}


def test_read_back(formed, rows):
    h = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.conv_id: r for r in C.read_back(formed).collect()}
    said = ordered(rows)
    assert set(got) == set(said)
    for c, turns in said.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256, g.loss_chars, g.loss_sha256) == (len(turns), h("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), h(loss))


def test_windows(formed, rows):
    """Budgets hold, the system turn stays, history repeats turns before the window, and only new assistant texts are under the mask."""
    said = ordered(rows)
    at: dict = {}
    for w in formed.withColumn("turns", C.parse(F.col("formatted"))).orderBy("conv_id", "window").collect():
        turns = [(t.role, t.text) for t in w.turns]
        all_, k = said[w.conv_id], at.get(w.conv_id, 0)
        new = turns[w.n_context :]
        assert new == all_[k : k + w.n_new] and len(turns) == w.n_context + w.n_new
        context = turns[: w.n_context]
        system = all_[0] if all_[0][0] == "system" else None
        if system and k > 0:
            assert context[0] == system
            context = context[1:]
        assert context == [t for j, t in list(enumerate(all_))[:k] if not (system and j == 0)][-len(context) :] if context else True
        assert len(context) <= C.HISTORY
        tokens = sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) + C.TURN_COST for _, x in turns)
        assert tokens <= 128 or w.n_new == 1 and not context
        assert len(w.mask) == sum(r == "assistant" for r, _ in new)
        at[w.conv_id] = k + w.n_new
    assert at == {c: len(t) for c, t in said.items()}


def test_no_borders_but_the_budget(formed):
    """Turns of a long conversation that all take 8 tokens: every window but the last is full."""
    new = [r.n_new for r in formed.where("conv_id = 20").orderBy("window").collect()]
    assert new == [16] * (700 // 16) + [700 % 16]


def test_escapes(spark):
    texts = ["", "\\", "\\\\h", "#<:", ODD, "\\h\\l\\c", "a\\\\\\#"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", C.escape(F.col("t")).alias("e"), C.unescape(C.escape(F.col("t"), True)).alias("u")).collect():
        assert r.u == r.t and not set("#<") & set(r.e)


def test_empty(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.read_back(C.windows(none)).count() == 0
