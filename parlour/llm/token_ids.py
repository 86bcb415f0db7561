"""Token ids of whole texts, as the public ``tokenizers`` file gives them without special tokens added.

A byte-level BPE whose ids follow the order of its merges is the same vocabulary by ranks, and ``tiktoken`` gives the
same ids from it at a fraction of the time. Any other tokenizer, and texts on which its pattern would backtrack far
(long runs of white space), are encoded by ``tokenizers`` itself."""

from __future__ import annotations

import json
import re
from typing import Iterable, Iterator

import numpy as np

# The words that byte-level BPE keeps apart (contractions, letters, numbers, other signs, white space).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_WIDE = re.compile(r"\s{200}")


def _byte_of() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others for
    characters from 256 on, in order."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


def ranks_of(spec: dict) -> dict[bytes, int] | None:
    """Bytes -> id of a byte-level BPE with nothing around it, if its ids follow the order of its merges; else none."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (model.get("type") == "BPE" and not spec.get("normalizer") and not spec.get("post_processor") and not spec.get("truncation")
             and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
             and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "ignore_merges"))
             and not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")))
    if not plain:
        return None
    byte, added = _byte_of(), {t["content"] for t in spec["added_tokens"]}
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:])) or any(set(t) - byte.keys() for t in model["vocab"] if t not in added):
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    # ranks know every pair that makes a token, merges only those listed
    return ranks if len(ranks) == len(made) + 256 and all(bytes([b]) in ranks for b in range(256)) else None


class TokenIds:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tok = Tokenizer.from_file(path)
        ranks = ranks_of(spec)
        self.fast = None
        if ranks:
            import tiktoken

            self.added = {t["content"] for t in spec["added_tokens"]}
            self.fast = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={t["content"]: t["id"] for t in spec["added_tokens"]})

    def encode(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; the string of an added token in a text gets that token's id."""
        for t in texts:
            if self.fast is None or _WIDE.search(t):
                yield np.array(self.tok.encode(t, add_special_tokens=False).ids, np.uint32)
            else:
                yield self.fast.encode_to_numpy(t, allowed_special=self.added, disallowed_special=())
