"""Tokenizers loaded once for each Python worker, from a path that is a parameter."""

from __future__ import annotations

import base64
import hashlib
import json
import os
from functools import lru_cache
from pathlib import Path

import numpy as np


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def version(path: str) -> str:
    """Digest of a tokenizer file and of how contents are keyed for it; a changed vocabulary is another version."""
    return hashlib.sha256(b"normal form\n" + Path(path).read_bytes()).hexdigest()


@lru_cache(maxsize=4)
def normal_form(path: str):
    """A function from texts to the form in which the file's library cuts them: equal forms have equal tokens.

    A .model file's normaliser is the first step of its encoding, and nothing later sees the text itself. A .json file's library
    looks for added tokens in the text before it normalises the rest, so there the text is the form.
    """
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: model.normalize(texts)
    return lambda texts: texts


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizers library's own reading of a file, without truncation or padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(path)
    held.no_truncation()
    held.no_padding()
    return held


class ByteBpe:
    """Ids of a byte-level BPE file of the tokenizers library.

    Where a file's merges are ranks over byte strings, the ids are those of the rank encoder, which runs several times
    faster; the split pattern is the one that the file's byte-level pre-tokenizer stands for. Special strings
    inside a text become their ids, as the library does by default. `ranked` says whether all that holds (see _ranked);
    if not, and for a text that the rank encoder refuses, the library itself is used. tests/llm hold both equal.
    """

    def __init__(self, path: str, pattern: str | None = None):
        import public_tokenizers
        import tiktoken

        self.path, spec = path, json.loads(Path(path).read_text(encoding="utf-8"))
        self.ranked = self._ranked(spec)
        if self.ranked:
            special = {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {self._bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
            self.encoder = tiktoken.Encoding("byte-bpe", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

    @staticmethod
    @lru_cache(maxsize=1)
    def _stand() -> dict[str, int]:
        """The printable stand-ins of byte-level BPE: printable Latin-1 for itself, the others from U+0100 on."""
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}

    def _bytes(self, token: str) -> bytes:
        stand = self._stand()
        return bytes(stand[c] for c in token)

    def _ranked(self, spec: dict) -> bool:
        """Whether ids follow from ranks: a plain byte-level file, all bytes in it, and every merge making the next id up."""
        pre, model = spec["pre_tokenizer"] or {}, spec["model"]
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return False
        if model["type"] != "BPE" or any(model.get(x) for x in ("dropout", "ignore_merges", "fuse_unk", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix")):
            return False
        if any(t[x] for t in spec["added_tokens"] for x in ("single_word", "lstrip", "rstrip")) or any(not t["special"] and t["normalized"] for t in spec["added_tokens"]):
            return False
        special, vocab = {t["content"] for t in spec["added_tokens"]}, model["vocab"]
        plain = {t: i for t, i in vocab.items() if t not in special}
        made = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        if any(c not in self._stand() for t in plain for c in t) or {t for t in plain if len(t) == 1} != set(self._stand()):
            return False
        ids = [vocab.get(t, -1) for t in made]
        return all(a < b for a, b in zip(ids, ids[1:], strict=False)) and min(ids, default=0) > max(plain[c] for c in self._stand()) and set(made) | set(self._stand()) == set(plain)

    def ids(self, text: str) -> np.ndarray:
        if self.ranked:
            try:
                return self.encoder.encode_to_numpy(text, allowed_special="all")
            except BaseException as e:  # the encoder's panics are no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return np.array(library(self.path).encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


@lru_cache(maxsize=4)
def counter(path: str):
    """A function from texts to token counts by the library that the file is for, without added tokens."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    return lambda texts: [len(x.ids) for x in library(path).encode_batch(texts, add_special_tokens=False)]


def sizes(path: str):
    """A function from texts, null as empty, to their numbers of tokens, by the fastest way that has the file's own ids."""
    if path.endswith(".json") and (held := byte_bpe(path)).ranked:
        return lambda texts: [len(held.ids(t)) if t else 0 for t in texts]
    count = counter(path)
    return lambda texts: count([t or "" for t in texts])
