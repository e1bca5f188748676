import hashlib
import json
import random

from frostline.llm import chat


def test_escaping_is_reversible():
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choice(["<", "|", "\\", ">", "im_start", "im_end", "\n", "x", "%0A", "%"]) for _ in range(rng.randrange(12)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        role = text.replace("x", "user")
        turns = [(role, text), ("assistant", text[::-1]), ("", "")]
        assert chat.read_back("".join(chat.template(*t)[0] for t in turns)) == turns


def test_layouts_become_the_same_turns():
    said = [("user", "hello"), ("assistant", "hi")]
    records = [
        {"messages": [{"role": "user", "content": "hello"}, {"role": "assistant", "content": "hi"}]},
        {"conversations": [{"from": "human", "value": "hello"}, {"from": "gpt", "value": "hi"}], "source": {"name": ["x"]}},
        {"prompt": "hello", "response": "hi"}, {"question": "hello", "answer": "hi"}, {"instruction": "hello", "output": "hi"},
        {"instruction": "hello", "input": "", "output": "hi", "id": 7},
    ]
    assert [chat.turns_of(json.dumps(r))[1] for r in records] == [said] * 6
    assert len({chat.turns_of(json.dumps(r))[0] for r in records}) == 6
    assert chat.turns_of(json.dumps({"instruction": "a", "input": "b", "output": None}))[1] == [("user", "a\n\nb"), ("assistant", "")]
    for bad in (None, "", "no json", "[1]", '{"prompt": "only"}', '{"messages": []}', '{"messages": 3}'):
        assert chat.turns_of(bad) == (None, [])


def test_fields_of_several_layouts():
    """The layout that takes most fields is selected; a system field is never lost."""
    said = [{"role": "user", "content": "hello"}, {"role": "assistant", "content": "hi"}]
    turns = [("user", "hello"), ("assistant", "hi")]
    assert chat.turns_of(json.dumps({"messages": said, "system": "s"})) == (chat.fingerprint(chat.LAYOUTS[0]["paths"]), [("system", "s"), *turns])
    assert chat.turns_of(json.dumps({"messages": said, "prompt": "x"}))[1] == turns
    assert chat.turns_of(json.dumps({"prompt": "p", "response": "r", "context": "c", "system": "s"}))[1] == [("system", "s"), ("user", "p"), ("assistant", "r")]
    assert chat.turns_of(json.dumps({"instruction": "i", "input": "n", "output": "o", "response": "r"}))[1] == [("user", "i\n\nn"), ("assistant", "o")]
    assert chat.turns_of(json.dumps({"question": "q", "answer": "a", "system": None}))[1] == [("system", ""), ("user", "q"), ("assistant", "a")]
    assert chat.turns_of(json.dumps({"prompt": "p", "system": "s", "input": "n"})) == (None, [])


def test_very_long_conversations_and_texts(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"{i} <|im_end|>") for i in range(20_000)] + [(2, 0, "assistant", "x<|" * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = {r.conv_id: r for r in chat.digests(chat.format_turns(chat.canonical_turns(df.selectExpr("*", "to_json(struct(role, text)) as record")))).collect()}
    assert found[1].n_turns == 20_000 and found[1].loss_chars == sum(len(r[3]) for r in rows[:20_000] if r[2] == "assistant")
    assert found[2].loss_sha256 == hashlib.sha256(("x<|" * 300_000).encode()).hexdigest()


def test_conversations(spark):
    rows = [(1, 0, "user", "a<|im_end|>"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, 2, None, "x"), (2, None, "assistant", "ü\n"), (2, 5, "assistant", "<\\|"), (None, 0, "user", "q")]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, part string, fingerprint long")
    records = df.selectExpr("*", "to_json(struct(role, text), map('ignoreNullFields', 'false')) as record")
    found = {r.conv_id: r for r in chat.digests(chat.format_turns(chat.canonical_turns(records))).collect()}
    want = {1: [("user", "a<|im_end|>"), ("assistant", ""), ("assistant", ""), ("", "x")], 2: [("assistant", "ü\n"), ("assistant", "<\\|")], None: [("user", "q")]}
    assert set(found) == set(want)
    for key, turns in want.items():
        r = found[key]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r.n_turns == len(turns) and r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars == sum(len(chat.template(a, b)[0]) for a, b in turns)


def test_unknown_records_keep_a_row_and_nothing_gives_nothing(spark):
    df = spark.createDataFrame([(1, 0, "{}"), (2, 0, None)], "conv_id long, turn long, record string")
    assert [(r.conv_id, r.fingerprint, r.text) for r in chat.canonical_turns(df).orderBy("conv_id").collect()] == [(1, None, None), (2, None, None)]
    assert chat.digests(chat.format_turns(chat.canonical_turns(df.where("false")))).collect() == []
