import hashlib
import random

from pyspark.sql import functions as F

from psephos.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def conversation(rows):
    """{conv: digest row} by plain Python; rows sorted as the operator sorts them."""
    out = {}
    for c in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        loss = "".join(x for _, _, r, x in own if r == "assistant")
        out[c] = (len(own), sha("".join(f"{r}\n{x}\n" for _, _, r, x in own)), len(loss), sha(loss))
    return out


def rows():
    text = lambda i, n: " ".join(f"w{i}_{j}" for j in range(n))
    out = [(1, 0, "system", "be brief # <now>")] + [(1, i, "assistant" if i % 2 == 0 else "user", text(i, 37 * i % 90)) for i in range(1, 40)]
    out += [(2, 0, "user", r"\### Assistant: </turn> ok"), (2, 1, "assistant", "\\### assistant:  </turn>\n### user: \\\\# \\< x </turn>\n")]
    out += [(3, None, None, None), (3, 0, "assistant", None), (3, 0, "assistant", None), (3, 1, "assistant", ""), (3, 1, "a: b/ü +", " x ")]
    out += [(None, 0, "user", "no conversation id"), (None, 1, "assistant", "answer")]
    out += [(4, 0, "user", "ask"), (4, 1, "assistant", text(0, 3000)), (4, 2, "user", "more"), (4, 3, "assistant", "end")]
    return out + [(5, i, "user" if i % 2 else "assistant", text(i, 3)) for i in range(1200)]


def test_read_back_equals_the_turns(spark):
    df = spark.createDataFrame(rows(), SCHEMA).withColumns({c: F.lit("clash") for c in "tokens block at window kind n piece spans".split()})
    windows = chat.format_windows(df, 64, 32).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest_conversations(windows).collect()}
    assert got == conversation(rows())


def test_windows_keep_budget_system_and_history(spark):
    own = rows()
    windows = chat.format_windows(spark.createDataFrame(own, SCHEMA), 64, 32)
    system = len("be brief # <now>".split())
    by = {}
    for r in windows.collect():
        by.setdefault(r.conv_id, []).append(r)
        if r.conv_id == 1:
            assert r.n_tokens <= 96 and r.n_tokens >= system
            assert r.formatted.startswith("### system: be brief \\# \\<now> </turn>\n")
        assert r.over_budget == (r.n_tokens > 96)
    assert len(by[1]) > 5 and len(by[5]) > 50 and any(r.n_repeated > 1 for r in by[1])
    # a span is what stands in the text, and never in a repeated turn
    for r in by[1]:
        pieces = r.formatted.split(chat.TAIL)[:-1]
        assert len(pieces) == r.n_repeated + r.n_targets
        start = sum(len(p) + len(chat.TAIL) for p in pieces[: r.n_repeated])
        assert all(s.start >= start for s in r.spans)
        targets = [p.split(chat.SEP, 1)[1] for p in pieces[r.n_repeated :] if p.startswith("### assistant")]
        assert [r.formatted[s.start : s.start + s.length] for s in r.spans] == targets


def plain(turns, span, history):
    """Windows of one conversation by plain Python: [(history and system turns, targets)] as lists of numbers of turns."""
    tokens = [len(x.split()) for _, x in turns]
    at = [sum(tokens[:i]) for i in range(len(turns))]
    has = turns[0][0] == "system"
    system = tokens[0] if has else 0
    room = span if system <= history else max(1, span + history - system)
    parts = []  # [crosses, turns]
    for i, n in enumerate(tokens):
        cell = (max(at[i] + n, 1) - 1) // room
        key = (cell, at[i] >= cell * room)
        if not parts or parts[-1][0] != key:
            parts.append((key, []))
        parts[-1][1].append(i)
    held = [sum(tokens[i] for i in own) for _, own in parts]
    inner = [key[1] for key, _ in parts]
    back = [k > 0 and not inner[k] and inner[k - 1] and held[k - 1] + held[k] <= room for k in range(len(parts))]
    to = []
    for k in range(len(parts)):
        ahead = not inner[k] and k + 1 < len(parts) and inner[k + 1] and held[k] + held[k + 1] + (held[k + 2] if k + 2 < len(parts) and back[k + 2] else 0) <= room
        to.append(k - 1 if back[k] else k + 1 if ahead else k)
    out = []
    for w in sorted(set(to)):
        own = [i for k, (_, turns_of) in enumerate(parts) if to[k] == w for i in turns_of]
        allowed = max(0, min(history - system, span + history - system - sum(tokens[i] for i in own)))
        before = [i for i in range(own[0]) if not (has and i == 0) and at[own[0]] - at[i] <= allowed]
        out.append((([0] if has and own[0] else []) + before, own))
    return out


def test_windows_equal_plain_python(spark):
    rng = random.Random(3)
    own, want = [], {}
    for c in range(60):
        most = rng.choice([3, 20, 70, 150])
        turns = [("system", " ".join(["s"] * rng.choice([0, 3, 20, 40, 120])))] if c % 2 else []
        turns += [(rng.choice(["user", "assistant"]), " ".join(f"w{i}" for _ in range(rng.randrange(most)))) for i in range(rng.randrange(1, 40))]
        own += [(c, i, r, x) for i, (r, x) in enumerate(turns)]
        want[c] = [("".join(f"### {turns[i][0]}: {turns[i][1]} </turn>\n" for i in again + targets), len(again), len(targets)) for again, targets in plain(turns, 64, 32)]
        tokens = [len(x.split()) for _, x in turns]
        system = tokens[0] if c % 2 else 0
        for again, targets in plain(turns, 64, 32):
            n = sum(tokens[i] for i in again + targets)
            # over budget only by one turn, alone or with the system turn; turns without words stand anywhere
            assert n <= 96 or n == max(tokens[i] for i in targets) + (system if again else 0)
    got = {}
    for r in chat.format_windows(spark.createDataFrame(own, SCHEMA), 64, 32).orderBy("conv_id", "window").collect():
        got.setdefault(r.conv_id, []).append((r.formatted, r.n_repeated, r.n_targets))
        assert r.window == len(got[r.conv_id]) - 1
    assert got == want


def test_escape_is_reversible(spark):
    texts = ["\\", "\\\\", "\\#", "#\\", "<\\<", "$1 \\$2", "\\\\#<\n", "", "plain"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect()
    assert all(r.t == r.u for r in got)
    assert all(chat.TAIL not in r.e and "### " not in r.e for r in got)


def test_empty(spark):
    assert chat.digest_conversations(chat.format_windows(spark.createDataFrame([], SCHEMA))).count() == 0
