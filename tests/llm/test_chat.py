import hashlib
import random

from netloom.llm import chat

BUDGET = 60


def test_escapes_are_reversible():
    rng = random.Random(1)
    parts = [*chat.CONTROLS, "\\", "\n", " ", "x", "\\\\"]
    for _ in range(2000):
        turns = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 6))), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for _ in range(3)]
        assert chat.parse(chat.render(turns, 0)[0]) == turns


def _rows():
    rng = random.Random(2)
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (8, None, None, None), (8, 1, "assistant", ""), (8, 1, "assistant", "again"),
            (None, 0, "user", "x"), (9, 5, "assistant", "long " * 500), (9, 6, "assistant", "y")]
    for conv in range(100, 130):
        n = rng.choice([1, 3, 20, 700])
        system = rng.random() < 0.5
        for turn in range(n):
            role = "system" if system and turn == 0 else rng.choice(["user", "assistant"]) if turn % 50 else "system"
            rows.append((conv, turn, role if system or turn else "user", " ".join(["word"] * rng.randint(0, 12))))
    return rows


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, stretch long")


def test_windows_read_back(spark, vocab):
    rows = _rows()
    found = {r["conv_id"]: r for r in chat.read_back(chat.windows(_frame(spark, rows), *vocab, budget=BUDGET, history=2)).collect()}
    by_conv = {}
    for conv, turn, role, text in rows:
        by_conv.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert found.keys() == by_conv.keys()
    for conv, turns in by_conv.items():
        turns.sort()
        loss = "".join(t for _, role, t in turns if role == "assistant")
        r = found[conv]
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.windows(_frame(spark, []), *vocab).count() == 0


def test_windows_keep_system_history_and_budget(spark, vocab):
    rows = _rows()
    first = {}
    for conv, turn, role, text in rows:
        if conv is not None and (conv not in first or (turn or 0) < first[conv][0]):
            first[conv] = (turn or 0, role, text)
    for w in chat.windows(_frame(spark, rows), *vocab, budget=BUDGET, history=2).collect():
        turns = chat.parse(w["formatted"])
        if w["conv_id"] in first and first[w["conv_id"]][1] == "system":
            assert turns[0] == first[w["conv_id"]][1:]
        assert w["repeated"] <= 3 and len(turns) > w["repeated"]
        assert w["n_tokens"] <= BUDGET or len(turns) - w["repeated"] == 1
        assert len(w["loss"]) == sum(role == "assistant" for role, _ in turns[w["repeated"] :])


def test_windows_count_their_real_tokens(spark, vocab):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocab[0])
    rng = random.Random(8)
    parts = ["</s>[INST] ok [/INST]", " ", "\n", "\\", "word", "  x", "é", "<|endoftext|>", "<<SYS>>"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "a b <s>"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for c in range(20) for t in range(12)]
    rows += [(50, t, "assistant", "</s>[INST] ok [/INST]") for t in range(50)]
    found = chat.windows(_frame(spark, rows + _rows()), *vocab, budget=300, history=2).collect()
    for w in found:
        tokens = len(library.encode(w["formatted"], add_special_tokens=False).ids)
        assert w["n_tokens"] == tokens
        assert tokens <= 300 or len(chat.parse(w["formatted"])) - w["repeated"] == 1


def test_hot_keys_are_cut_into_pieces(spark, vocab):
    rows = [(None, None, "system", "be brief")] + [(None, None, "user", f"text {i:05d}") for i in range(3000)] + [(5, 7, "assistant", f"t{i:05d}") for i in range(2500)]
    rows += [(5, 256, "user", "next stretch"), (6, -1, "user", "a")] + [(6, -1, "user", f"b{i:05d}") for i in range(2000)] + [(6, 3, "assistant", "c")]
    found = chat.windows(_frame(spark, rows), *vocab, budget=10**9, history=2)
    sizes = [len(chat.parse(w["formatted"])) for w in found.collect()]
    assert max(sizes) <= chat.PIECE_ROWS + 3
    back = chat.read_back(found)
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan
    result = {r["conv_id"]: r for r in back.collect()}
    for conv in (None, 5, 6):
        turns = sorted((-1 if t is None else t, role, text) for c, t, role, text in rows if c == conv)
        assert result[conv]["n_turns"] == len(turns)
        assert result[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert result[conv]["loss_sha256"] == hashlib.sha256("".join(t for _, role, t in turns if role == "assistant").encode()).hexdigest()
    cut = [w for w in found.collect() if w["conv_id"] == 5 and w["stretch"] == 0]
    assert sorted(w["window"] for w in cut) == [0, 1, 2] and sorted(w["repeated"] for w in cut) == [0, 2, 2]
