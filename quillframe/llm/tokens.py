"""Token ids by a public tokenizer file, one encoder per worker process."""

from __future__ import annotations

import functools
import json
from collections.abc import Callable

import numpy as np


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level BPE: printable Latin-1 bytes stand for themselves, the others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """text -> uint32 ids, equal to those of tokenizers without added special tokens.

    A plain byte-level BPE file (no normalizer, no prefix space) whose ids are its merge ranks runs in tiktoken, which
    gives the same ids in a quarter of the time; any other file runs in tokenizers itself.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    simple = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and model.get("type") == "BPE"
    simple = simple and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if simple:
        import public_tokenizers
        import tiktoken

        alphabet, special = byte_alphabet(), {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        ranks = {bytes(alphabet[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        names = set(special)
        return lambda text: np.asarray(fast.encode_to_numpy(text, allowed_special=names, disallowed_special=()), dtype=np.uint32)
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
