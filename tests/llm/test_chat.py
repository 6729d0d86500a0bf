import hashlib

import pytest
from odd_texts import ODD
from hypothesis import given, settings
from hypothesis import strategies as st

from fidelis.llm import chat
from fidelis.llm.queries import op8_chat_format

TURNS = "conv_id long, turn long, role string, text string, seq long, start long"


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def check(rows, turns):
    by = {}
    for conv, turn, role, text in sorted(turns, key=lambda t: (t[0], t[1], t[2] or "", t[3] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    assert {r.conv_id for r in rows} == set(by)
    for r in rows:
        own = by[r.conv_id]
        said = [t for role, t in own if role == "assistant"]
        assert (r.n_turns, r.turns_sha256) == (len(own), digest(f"{a}\n{t}\n" for a, t in own))
        assert (r.loss_chars, r.loss_sha256) == (sum(map(len, said)), digest(said))


def test_the_query_reads_back_all_turns(spark):
    at = "/root/testdata/sf0.001"
    turns = [tuple(r) for r in spark.read.parquet(f"{at}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    check(op8_chat_format(spark, at).collect(), [*turns, (-1, 0, "user", said), (-1, 1, "assistant", said)])


def test_odd_rows_read_back_from_storage_too(spark, tmp_path):
    turns = [(i % 2, i, ("user", "assistant", "system", None, "a|>b\\")[i % 5], t) for i, t in enumerate([*ODD, "\\", "<", "[", "x</s>", "<|turn:q|>", "<s>[INST] ", "\\l<|end|>"])]
    turns += [(7, 1, "assistant", "same"), (7, 1, "assistant", "same")]
    df = spark.createDataFrame([(*t, 1, 1) for t in turns], TURNS)
    made = chat.format_chats(df)
    check(chat.read_back(made, ordered=True).collect(), turns)
    made.write.parquet(str(tmp_path / "f"))
    check(chat.read_back(spark.read.parquet(str(tmp_path / "f"))).collect(), turns)
    assert chat.read_back(chat.format_chats(df.where("false"))).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["\\", "l", "b", "<", "s>", "/s>", "|", "[", "INST]", "/INST]", " ", "x", "turn:", "end|>", "\n", "é"])).map("".join))
def test_escapes_are_reversible_and_leave_no_control_string(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in ("<s>", "</s>", "<|", "|>", "[INST]", "[/INST]"))
    for role in ("user", "assistant", "tool"):
        assert [(r, t) for r, t, _ in chat.parse(chat.render(role, out)[0])] == [(role, text)]


def test_typed_parts_become_ordered_placeholders(spark):
    parts = [
        {"type": "text", "text": "see <|image:0|> "}, {"type": "image", "ref": "a.png", "width": 28, "height": 29}, {"type": "audio", "ref": "b.wav", "seconds": 1.5},
        {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "text", "text": " end"},
    ]
    full = [{k: p.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")} for p in parts]
    df = spark.createDataFrame([(1, 0, "user", None, full), (1, 1, "assistant", "fine", None), (1, 2, "user", None, [full[1]])], f"conv_id long, turn long, role string, text string, parts {chat.PARTS}")
    rows = sorted(chat.format_chats(df).collect(), key=lambda r: r.seq)
    whole = "".join(r.fragment for r in rows)
    found = [a for r in rows for a in r.attachments]
    assert [(a.ordinal, a.kind, a.ref, a.tokens) for a in found] == [(0, "image", "a.png", 2), (1, "audio", "b.wav", 38), (2, "document", "c.pdf", 768), (3, "image", "a.png", 2)]
    assert all(whole[a.at :].startswith(f"<|{a.kind}:{a.ordinal}|>") for a in found)
    mask = rows[1].masks[0]
    assert whole[mask.s : mask.e] == "fine" and "see \\l|image:0\\p> <|image:0|>" in whole


def test_unknown_parts_are_refused():
    with pytest.raises(ValueError):
        chat.Flatten().visit({"type": "video"})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["</s>", "[/INST] y", "<|end|>", "\\l", "a|>b", "[INST]", "x"])).map("".join), st.lists(st.integers(0, 30)), st.sampled_from(["user", "assistant", "tool"]))
def test_a_text_split_into_parts_anywhere_reads_back(text, cuts, role):
    edges = [0, *sorted(min(c, len(text)) for c in cuts), len(text)]
    visitor = chat.Flatten()
    for a, b in zip(edges, edges[1:], strict=False):
        visitor.visit({"type": "text", "text": text[a:b]})
    assert [(r, t) for r, t, _ in chat.parse(chat.render(role, visitor.close())[0])] == [(role, text)]


def test_control_strings_over_parts_are_one_turn(spark):
    keys = ("type", "text", "ref", "width", "height", "seconds", "pages")
    texts = lambda *xs: [dict.fromkeys(keys) | {"type": "text", "text": x} for x in xs]
    image = dict.fromkeys(keys) | {"type": "image", "ref": "a", "width": 1, "height": 1}
    rows = [(1, 0, "assistant", None, texts("<", "/s> x")), (2, 0, "user", None, texts("[", "/INST] y")), (3, 0, "user", None, [*texts("<"), image, *texts("|x", "|", ">")])]
    made = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {chat.PARTS}"))
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for conv, said in ((1, "assistant\n</s> x\n"), (2, "user\n[/INST] y\n"), (3, "user\n<<|image:0|>|x|>\n")):
        assert (got[conv].n_turns, got[conv].turns_sha256) == (1, digest([said]))
    assert (got[1].loss_chars, got[1].loss_sha256) == (6, digest(["</s> x"]))
