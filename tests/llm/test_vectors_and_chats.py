import hashlib
import random

import numpy as np

from deltaweave.llm import chat, embdedup, topk

VECTORS = "vec_id long, embedding array<float>, label string, code int, dim string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if x is None else [None if v is None else float(v) for v in x], y, 1, "d") for i, x, y in rows], VECTORS).repartition(3)


ODD = [(1000, None, "a"), (1001, [1.0, None], "a"), (1002, [float("nan")] * 8, "a"), (1003, [float("inf")] * 8, "a"), (1004, [0.0] * 8, "a"), (1020, [], "a"), (1005, [1.0], "a"), (1040, [1.0, 2.0], "a")]


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, list(np.round(rng.standard_normal(8), 1)), "a") for i in range(300)] + [(300 + i, [0.5] * 8, "a") for i in range(40)] + ODD
    df = frame(spark, rows)
    out = topk.top_k(df, df.where("vec_id % 20 = 0"), k=7, block=64, query_block=8).collect()
    usable = [(i, np.floor(np.array(x, np.float32).astype(float) * 64)) for i, x, _ in rows if x is not None and all(v is not None and np.isfinite(v) for v in x)]
    expected = []
    for i, q in usable:
        if i % 20 == 0:
            scored = sorted((-int(q @ v), j) for j, v in usable if j != i and len(v) == len(q))[:7]
            expected += [(i, r, j, -s) for r, (s, j) in enumerate(scored, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == sorted(expected)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_huge_components(spark):
    df = frame(spark, [(0, [1e12, -1e12], "a"), (1, [1.0, 0.0], "a"), (2, [1e12, -1e12], "a")])
    out = {(r.vec_id): r.score for r in topk.top_k(df, df.where("vec_id = 0")).collect()}
    assert out[2] == (1 << 63) - 1 and out[1] == 64 * 64 * int(np.float32(1e12))


def brute_links(rows, threshold):
    ok = {}
    for i, x, y in rows:
        if x is not None and y is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x):
            v = np.array(x, np.float32).astype(float)
            ok[i] = (y, v / np.linalg.norm(v))
    links = {i: set() for i, _, _ in rows}
    for i, (a, u) in ok.items():
        for j, (b, v) in ok.items():
            if i < j and a == b and len(u) == len(v) and u @ v >= threshold:
                links[i].add(j)
                links[j].add(i)
    component = {}
    for i in sorted(links):
        if i not in component:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in component:
                    component[x] = i
                    todo += links[x]
    return {i: (len(links[i]), component[i]) for i in links}


def test_embedding_near_duplicates(spark):
    rng = np.random.default_rng(2)
    rows, at = [], 0
    for c in range(40):
        base = rng.standard_normal(64)
        for _ in range(6):
            rows.append((at, list(base + rng.standard_normal(64) * 0.12), "ab"[c % 2]))
            at += 1
    rows += [(500 + i, [1.0] * 64, "a") for i in range(30)] + [(600, [1.0] * 64, None), (601, [1.0] * 64, "b")] + ODD
    got = {r.vec_id: (r.n_links, r.component_id) for r in embdedup.near_duplicates(frame(spark, rows)).collect()}
    want = brute_links(rows, 0.93)
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.9 * sum(n for n, _ in want.values())
    assert got[500] == (29, 500) and got[600] == (0, 600) and got[1004] == (0, 1004)
    assert embdedup.near_duplicates(frame(spark, [])).count() == 0


def test_tables_find_every_pair_within_the_radius(spark, monkeypatch):
    for rows in (0, 100, 20_000, 1_000_000, 10**9):
        for bits in (1, 7, 16, 32, 63, 64):
            for radius in (0, 5, 11):
                chunks, width, off = embdedup.tables_of(rows, bits, radius)
                assert chunks * (off + 1) > radius and chunks * width >= bits and (chunks - 1) * width < 64
    assert embdedup.tables_of(10**6, 64, 11)[0] < embdedup.tables_of(10**3, 64, 11)[0]
    rng = np.random.default_rng(5)
    base = rng.standard_normal((30, 64))
    df = frame(spark, [(i, list(base[i % 30] + rng.standard_normal(64) * 0.15), "a") for i in range(120)])
    few = sorted(map(tuple, embdedup.near_duplicates(df).collect()))
    monkeypatch.setattr(embdedup, "tables_of", lambda rows, bits, radius: (4, 16, 2))
    assert sorted(map(tuple, embdedup.near_duplicates(df).collect())) == few and any(n for _, n, _, _ in few)


def digest(rows):
    turns, loss = hashlib.sha256(), "".join(t or "" for _, r, t in rows if r == "assistant")
    for _, role, text in rows:
        turns.update(f"{role or ''}\n{text or ''}\n".encode())
    return len(rows), turns.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_chat_windows(spark):
    rng = random.Random(3)
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nx", "\\", "\\\\<|", "<<SYS>> a <</SYS>>", "", None, "plain words " * 30]
    talks = {}
    for c in range(30):
        rows = [(0, "system", "be kind")] if c % 2 else []
        for i in range(rng.randrange(1, 40)):
            rows.append((len(rows), ("user", "assistant")[i % 2], rng.choice(nasty)))
        talks[c] = rows
    talks[99] = [(0, "us\ner", "x" * 9000), (1, None, "a"), (2, "assistant", "b")]
    df = spark.createDataFrame([(c, *r, "z") for c, rows in talks.items() for r in rows], "conv_id long, turn long, role string, text string, window string").repartition(4)
    windows = chat.format_chats(df, budget=200, history=40)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(windows).collect()}
    assert got == {c: digest(rows) for c, rows in talks.items()}
    for w in windows.collect():
        turns = list(chat.read_turns(w.text))
        fresh = turns[w.context :]
        assert fresh and (w.n_tokens <= 200 or len(fresh) == 1)
        if talks[w.conv_id][0][1] == "system" and w.window:
            assert turns[0][:2] == ("system", "be kind") and w.context >= 1
        assert all(fresh[0][2] <= s for s in w.loss_start)
    assert chat.read_back(chat.format_chats(df.limit(0))).count() == 0


def test_chat_budget_counts_marks_and_any_system_turn_stays(spark):
    talks = {1: [(i, ("user", "assistant")[i % 2], "ok") for i in range(900)], 2: [(i, "system" if i == 3 else "user", f"turn {i}") for i in range(120)]}
    df = spark.createDataFrame([(c, *r) for c, rows in talks.items() for r in rows], "conv_id long, turn long, role string, text string")
    made = chat.format_chats(df, budget=256, history=64)
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(made).collect()} == {c: digest(rows) for c, rows in talks.items()}
    windows = made.collect()
    for w, n in zip(windows, chat.count_tokens([w.text for w in windows]), strict=True):
        assert w.n_tokens == n <= 256
        if w.conv_id == 2 and w.window:
            assert next(chat.read_turns(w.text))[:2] == ("system", "turn 3")


def test_escape_is_reversible():
    rng = random.Random(4)
    for _ in range(2000):
        text = "".join(rng.choice(["<", "|", "\\", "</s>", "[INST]", "<|", "a", "\n", "<<SYS>>"]) for _ in range(rng.randrange(9)))
        escaped = chat.escape(text)
        assert chat.unescape(escaped) == text
        assert not any(c in escaped for c in chat.CONTROL)
