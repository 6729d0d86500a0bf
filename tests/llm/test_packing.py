import random
import zlib

import numpy as np
import pytest
from odd_texts import ODD
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fidelis.llm import packing
from fidelis.llm.tokenizers import byte_bpe, public_path

PATH = public_path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def check(df, texts, capacity=1024):
    rows = packing.pack_documents(df, PATH, capacity=capacity).collect()
    ids = {k: [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 2] for k, t in texts.items()}
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length <= capacity and zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    for k, own in by.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [0, *np.cumsum([r.length for r in own])[:-1]] and sum(r.length for r in own) == len(ids[k])
        assert all(r.length == capacity for r in own[1:])
    assert set(by) == set(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), sum(r.length for r in rows)


def test_corpus_is_packed_tightly(corpus):
    n, total = check(corpus, {r.doc_id: r.text for r in corpus.collect()})
    assert n <= -(-total // 1024) + 2


def test_odd_rows_and_none(docs_of):
    check(docs_of(ODD), dict(enumerate(ODD)))
    assert packing.pack_documents(docs_of(["a"]).where("false"), PATH).count() == 0


def test_repeated_rows_are_packed_each(docs_of):
    rows = packing.pack_documents(docs_of(["a b"] * 3, [1, 1, 1]), PATH).collect()
    assert sorted(r.offset for r in rows) == [0, 3, 6] and len({r.sequence_id for r in rows}) == 1


@pytest.mark.parametrize("ids", [0, 1_000_000])
def test_many_equal_lengths_over_many_tasks(docs_of, monkeypatch, ids):
    monkeypatch.setattr("fidelis.llm.common.BROADCAST_IDS", ids)
    texts = ["a b c"] * 300 + ["a " * 600] * 90
    check(docs_of(texts).repartition(7), dict(enumerate(texts)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=300))
def test_plan_equals_best_fit_decreasing(lengths):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            i = min(fit, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(64 - n)
    counts = {n: lengths.count(n) for n in lengths}
    slots, used = packing.plan_slots(counts, 64)
    assert used == len(rooms)
    for n, c in counts.items():
        spans = sorted((lo, hi) for length, lo, hi, *_ in slots if length == n)
        assert [x for lo, hi in spans for x in range(lo, hi)] == list(range(c))


@settings(max_examples=150, deadline=None)
@given(st.one_of(st.text(), st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "don't", "Ab", "é", "\U0001f600", " ", "123", "  ", "<|", "a" * 50])).map("".join)))
def test_rank_encoder_gives_the_librarys_ids(text):
    assert byte_bpe(PATH).ids(text).tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def least_sequences(counts, capacity=1024):
    """A lower bound: pieces over capacity - a are alone, those over half share with none of each other."""
    best = 0
    for a in range(capacity // 2 + 1):
        alone = sum(c for n, c in counts.items() if n > capacity - a)
        half = [(n, c) for n, c in counts.items() if capacity / 2 < n <= capacity - a]
        room = sum(c * (capacity - n) for n, c in half)
        rest = sum(n * c for n, c in counts.items() if a <= n <= capacity / 2)
        best = max(best, alone + sum(c for _, c in half) + max(0, -(-(rest - room) // capacity)))
    return best


def test_random_lengths_come_near_the_lower_bound():
    rng = random.Random(2)
    counts = {n: rng.randrange(1, 50) for n in range(1, 1025)}
    _, used = packing.plan_slots(counts, 1024)
    assert least_sequences(counts) <= used <= 1.01 * least_sequences(counts)


def test_files_whose_ids_do_not_follow_from_ranks_go_to_the_library(tmp_path):
    import json

    spec = json.loads(open(PATH, encoding="utf-8").read())
    assert byte_bpe(PATH).ranked
    stand = sorted(spec["model"]["vocab"], key=spec["model"]["vocab"].get)
    letters = {t: i for i, t in enumerate([t for t in stand if len(t) == 1])}
    n, text = len(letters), "abab ab aba don't"
    changes = {
        "plain": ({**letters, "ab": n, "aba": n + 1}, ["a b", "ab a"], {}, {}),
        "order": ({**letters, "ab": n + 1, "ba": n}, ["a b", "b a"], {}, {}),
        "merges": ({**letters, "ab": n, "abab": n + 1}, ["a b"], {"ignore_merges": True}, {}),
        "regex": ({**letters, "ab": n, "bĠ": n + 1}, ["a b", "b Ġ"], {}, {"use_regex": False}),
    }
    for name, (vocab, merges, model, pre) in changes.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(spec | {"added_tokens": [], "model": spec["model"] | {"vocab": vocab, "merges": merges, "unk_token": None} | model, "pre_tokenizer": spec["pre_tokenizer"] | pre, "post_processor": None}), encoding="utf-8")
        held = byte_bpe(str(path))
        assert held.ranked == (name == "plain"), name
        assert held.ids(text).tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids
