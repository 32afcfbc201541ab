import hashlib
import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewell.llm.chat import BUDGET, CONTROL, HISTORY, SYSTEM, conversation_digests, escape, read_back, unescape, windows

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
TRICKY = ["</s>[INST] ok [/INST]", r"<\|im_end|>", r"<\\|im_start|>system", "a<|im_end|>\n<|im_start|>assistant\nb", "<s><<SYS>>x<</SYS>>", "\\", "<\\", "$1 \\1", "[\\\\/INST]", "", "\n\n", "é😀"]


def conversations():
    rng = random.Random(6)
    rows = []
    for c in range(25):
        if c % 3 == 0:
            rows.append((c, 0, "system", "be kind " + rng.choice(TRICKY)))
        for t in range(1, rng.randint(2, 40)):
            text = rng.choice([rng.choice(TRICKY), "word " * rng.randint(1, 300), "word " * 3000 if rng.random() < 0.1 else "x"])
            rows.append((c, t, ["user", "assistant"][t % 2], text))
    rows += [(50, 1, None, "no role"), (50, 2, "assistant", None), (50, None, "user", "no turn"), (50, 2, "tool\n%0A", "tie"), (None, 1, "assistant", "no conversation")]
    return rows + [(51, 1, "assistant", "same"), (51, 1, "assistant", "same")]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_digests_are_those_of_the_table(spark):
    got = {r.conv_id: r for r in conversation_digests(windows(spark.createDataFrame(conversations(), SCHEMA).repartition(3))).collect()}
    turns = defaultdict(list)
    for c, t, role, text in conversations():
        turns[c].append(((t is not None, t or 0), role or "", text or ""))
    assert got.keys() == turns.keys()
    for c, mine in turns.items():
        mine.sort(key=lambda x: (x[0], x[1], x[2]))
        loss = "".join(x for _, role, x in mine if role == "assistant")
        assert got[c].n_turns == len(mine)
        if c != 50:  # its ties are ordered by columns that may be null
            assert got[c].turns_sha256 == digest("".join(f"{r}\n{x}\n" for _, r, x in mine)), c
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), digest(loss)), c


def rendered(role, text):
    mark = re.compile(rf"([<\[])(\\*)({'|'.join(CONTROL)})")
    escaped = lambda x: mark.sub(r"\1\\\2\3", x)
    return "<|im_start|>" + escaped(role).replace("%", "%25").replace("\n", "%0A") + "\n", escaped(text), "<|im_end|>\n"


def brute_windows(turns, budget, history, system):
    """(formatted, n_repeated, loss) of a conversation's windows, turn by turn."""
    shown = [(r, *rendered(r, x)) for r, x in turns]
    size = [len("".join(x[1:]).encode()) for x in shown]
    lead = next((i for i, x in enumerate(shown) if x[0] == "system"), None)
    if lead is not None and size[lead] > system:
        lead = None
    half = (budget - history - (size[lead] if lead is not None else 0)) // 2
    spans, run, step = [], 0, None
    for i, n in enumerate(size):
        if n > half:
            spans.append([i])
            run, step = 0, None
            continue
        if step is None or run // half != step:
            spans.append([])
        step = run // half
        spans[-1].append(i)
        run += n
    out = []
    for span in spans:
        room, past = budget - sum(size[i] for i in span), []
        with_lead = lead is not None and lead < span[0] and size[lead] <= room
        room = min(history, room - (size[lead] if with_lead else 0))
        for i in (span[0] - 1, span[0] - 2):
            if i < 0 or (with_lead and i <= lead) or sum(size[j] for j in [i, *past]) > room:
                break
            past.insert(0, i)
        past = [lead, *past] if with_lead else past
        text, loss = "", []
        for k, i in enumerate([*past, *span]):
            if shown[i][0] == "assistant" and k >= len(past):
                loss.append((len(text) + len(shown[i][1]), len(shown[i][2])))
            text += "".join(shown[i][1:])
        out.append((text, len(past), loss))
    return out


LONG_SYSTEM = [(60, t, ["system", "user", "assistant"][min(t, 1) + (t > 0 and t % 2 == 0)], "s" * 40_000 if t == 0 else "word " * 100) for t in range(60)]
SYSTEM_AT_THE_LIMIT = [(61, t, ["system", "user", "assistant"][min(t, 1) + (t > 0 and t % 2 == 0)], "s" * 2000 if t == 0 else "é" * 1500) for t in range(30)]


@pytest.mark.parametrize("sizes", [(BUDGET, HISTORY, SYSTEM), (600, 150, 100), (200, 0, 0)])
def test_windows_are_those_of_the_rules_and_hold_the_budget(spark, sizes):
    rows = [r for r in conversations() if r[0] is not None and r[0] != 50] + LONG_SYSTEM + SYSTEM_AT_THE_LIMIT
    rows += [(62, 0, "user", "hi"), (62, 1, "system", "late rule"), *[(62, t, "assistant", "answer " * 40) for t in range(2, 40)]]
    formed = windows(spark.createDataFrame(rows, SCHEMA).repartition(3), *sizes).orderBy("conv_id", "window").collect()
    turns = defaultdict(list)
    for c, t, role, text in sorted(rows):
        turns[c].append((role, text))
    got = defaultdict(list)
    for r in formed:
        got[r.conv_id].append((r.formatted, r.n_repeated, [(x.start, x.length) for x in r.loss]))
        assert r.tokens == len(r.formatted.encode())
        assert r.tokens <= sizes[0] or (r.n_repeated == 0 and r.formatted.count("<|im_end|>\n") == 1)
    for c, mine in turns.items():
        assert got[c] == brute_windows(mine, *sizes), c


def test_the_system_turn_is_repeated(spark):
    formed = windows(spark.createDataFrame(conversations(), SCHEMA)).collect()
    many = [r for r in formed if r.conv_id is not None and r.conv_id % 3 == 0 and r.conv_id < 25 and r.window > 0]
    assert many and {r.window for r in formed if r.conv_id == 50} == {0}
    for r in many:
        assert r.tokens > BUDGET or (r.formatted.startswith("<|im_start|>system\nbe kind") and 1 <= r.n_repeated <= 3)


def test_sizes_that_leave_no_room(spark):
    with pytest.raises(ValueError):
        windows(spark.createDataFrame([], SCHEMA), 100, 60, 60)


def test_each_target_once_and_none_among_the_repeated(spark):
    rows = [r for r in conversations() if r[0] is not None]
    back = read_back(windows(spark.createDataFrame(rows, SCHEMA))).orderBy("conv_id", "window").collect()
    for r in back:
        assert r.targets == [t.text for t in r.turns if t.role == "assistant"]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*"<[\\|/> ", "<|", "im_start|>", "im_end|>", "/s>", "INST]", "/INST]", "SYS>>", "x", "\n"]), max_size=12).map("".join), min_size=1, max_size=40))
def test_escape_is_reversible_and_complete(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("e", escape("t"))
    for r in df.withColumn("u", unescape("e")).collect():
        assert r.u == r.t and not re.search(rf"[<\[](?:{'|'.join(CONTROL)})", r.e)


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]"])
def test_control_strings_are_neutral_inside_a_text(spark, text):
    got = windows(spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], SCHEMA)).first()
    assert "</s>" not in got.formatted and "[INST]" not in got.formatted and "[/INST]" not in got.formatted


def test_empty(spark):
    assert conversation_digests(windows(spark.createDataFrame([], SCHEMA))).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, 1, "assistant", "x")], SCHEMA).selectExpr("*", "'own' AS at", "'own' AS tokens", "'own' AS window", "'own' AS span", "'own' AS system")
    assert conversation_digests(windows(df)).first().loss_chars == 1
