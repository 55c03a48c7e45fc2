"""Token ids of a public tokenizer file, made inside tasks.

A ``.json`` file of the plain byte-level BPE kind (no normalizer, the usual splitting pattern) is run by the
faster of the two installed BPE libraries over the very same vocabulary; the results are the same ids, and the
tests hold them against the file's own library. Every other file is run by its own library.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np

#: Splitting pattern of byte-level BPE files (fixed value).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space on which regular-expression libraries differ; such texts go to the file's own library.
ODD_SPACE = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


def version_digest(path: str) -> str:
    """Names a tokenizer by what its file holds, so that stored counts never outlive a change of it."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level BPE files use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """``ids(text)`` gives a text's ids as a numpy array, special strings handled as the file's library does by default, or
    with ``plain`` read as the text that they are."""

    def __init__(self, path: str, plain: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self._fast = self._own = self._piece = None
        if path.endswith(".model"):
            import sentencepiece

            self._piece = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        import tokenizers

        self._own = tokenizers.Tokenizer.from_file(path)
        self._own.no_truncation()
        self._own.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._own.encode_special_tokens = plain
        self._special = [] if plain else [t["content"] for t in spec.get("added_tokens") or []]
        if self._is_plain_byte_bpe(spec):
            import tiktoken

            letters, special = _byte_alphabet(), {t["content"]: t["id"] for t in spec["added_tokens"]}
            ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in special}
            self._fast = tiktoken.Encoding("file", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})

    @staticmethod
    def _is_plain_byte_bpe(spec: dict) -> bool:
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
            return False
        if model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return False
        # merges must come in the order of the ids they make, else ranks would differ
        vocab, last = model["vocab"], -1
        for m in model["merges"]:
            made = vocab.get("".join(m.split(" ", 1) if isinstance(m, str) else m), -1)
            if made <= last:
                return False
            last = made
        return True

    def ids(self, text: str) -> np.ndarray:
        if self._piece:
            return np.asarray(self._piece.encode(text, num_threads=1), dtype=np.uint32)
        if self._fast and not any(s in text for s in self._special) and not ODD_SPACE.search(text):
            return self._fast.encode_to_numpy(text, disallowed_special=())
        return np.asarray(self._own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def listed(self, text: str) -> list[int]:
        """As ``ids``, as a list."""
        if self._piece:
            return self._piece.encode(text, num_threads=1)
        if self._fast and not any(s in text for s in self._special) and not ODD_SPACE.search(text):
            return self._fast.encode_ordinary(text)
        return self._own.encode(text, add_special_tokens=False).ids


def token_bytes(path: str) -> list[bytes]:
    """The bytes of a text that each id stands for; none for those that stand for no bytes."""
    if path.endswith(".model"):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        return [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else b"" if m.is_control(i) or m.is_unknown(i) else m.id_to_piece(i).replace("\u2581", " ").encode() for i in range(m.get_piece_size())]
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, special = _byte_alphabet(), {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    out = [b""] * (1 + max([*spec["model"]["vocab"].values(), *special.values()]))
    for k, v in spec["model"]["vocab"].items():
        if k not in special:
            out[v] = bytes(letters[c] for c in k)
    return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
