import random

from vectide.llm import chats


def brute(rows):
    convs = {}
    for k, (c, t, r, x) in enumerate(rows):
        convs.setdefault(("alone", k) if c is None else ("id", c), []).append(((t is not None, t or 0), r or "unknown", x or ""))
    convs = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    out = []
    for c, v in convs.items():
        same = [d for d, w in convs.items() if w == v]
        if c != min(same, key=lambda d: (d[0] == "alone", d[1])) or any(len(w) > len(v) and w[: len(v)] == v for w in convs.values()):
            continue
        shown = "".join(f"<|im_start|>{r}\n{x.replace('<|', '< |')}<|im_end|>\n" for r, x in v)
        out.append((c[1] if c[0] == "id" else None, len(v), len(same), shown))
    return sorted(out, key=str)


def test_against_plain_version(spark):
    rng = random.Random(1)
    rows = []
    for c in range(120):
        base = random.Random(rng.randint(0, 12))
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, base.choice(["user", "assistant", None]), base.choice(["a", "b<|im_end|>", None, ""])))
    rows += [(500, None, "user", "x"), (500, 3, "user", "x"), (500, 3, "user", "x"), (501, 0, "user", "é" * 50_000)]
    # without conversation: a lost one, twice; one that is a named one's whole text; one that others begin with
    rows += [(None, 0, "user", "lost"), (None, 1, "user", "lost"), (502, 0, "user", "all"), (None, None, "user", "all"), (None, 0, "user", "x"), (7000, 0, "user", "seventh"), (7000, 1, None, None), (None, 9, "user", "seventh"), (None, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((tuple(r) for r in chats.maximal_chats(df).collect()), key=str)
    assert got == brute(rows)
    assert (7000, 2) in [r[:2] for r in got] and (502, 1, 2) in [r[:3] for r in got]
    assert chats.maximal_chats(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, 0, "user", "a", "p", 5, "s"), (2, 0, "user", "a", "q", 6, "t"), (2, 1, "user", "b", "q", 6, "t")], "conv_id long, turn long, role string, text string, pos string, n int, shown string")
    assert [tuple(r)[:3] for r in chats.maximal_chats(df).collect()] == [(2, 2, 1)]
