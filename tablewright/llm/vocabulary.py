"""Vocabularies of byte-level BPE files."""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import lru_cache


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where it is a visible Latin-1 character, else the next from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(0x100 + k): b for k, b in enumerate(rest)}


@dataclass(frozen=True)
class Vocabulary:
    """tokens: bytes of each id; merges: (left id << 20 | right id) -> (rank, id of the two together)."""

    tokens: dict[int, bytes]
    of_byte: tuple[int, ...]
    merges: dict[int, tuple[int, int]]
    special: dict[str, int]


def default_path() -> str:
    """Of the vocabulary that the registered queries use, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _refuse_unknown(d: dict) -> None:
    """These operators follow plain byte-level BPE; a file that asks for more would silently give other ids."""
    model, before = d["model"], d.get("pre_tokenizer") or {}
    asked = {
        "normalizer": d.get("normalizer"),
        "pre_tokenizer": before.get("type") != "ByteLevel" or before.get("add_prefix_space") or before.get("use_regex") is False,
        "special tokens that strip or match words": [x["content"] for x in d["added_tokens"] if x.get("lstrip") or x.get("rstrip") or x.get("single_word")],
        **{k: model.get(k) for k in ("ignore_merges", "dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")},
    }
    unknown = [k for k, v in asked.items() if v]
    if model.get("type", "BPE") != "BPE" or unknown:
        raise ValueError(f"not a plain byte-level BPE file: {', '.join(unknown) or model['type']}")


@lru_cache(2)
def load(path: str | None = None) -> Vocabulary:
    """The vocabulary of a byte-level BPE file without normalizer, prefixes, suffixes or stripping tokens; others raise ValueError."""
    with open(path or default_path(), encoding="utf-8") as f:
        d = json.load(f)
    _refuse_unknown(d)
    alphabet, vocab = byte_alphabet(), d["model"]["vocab"]
    merges = {}
    for rank, m in enumerate(d["model"]["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        merges.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
    special = {x["content"]: x["id"] for x in d["added_tokens"]}
    tokens = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items() if s not in special}
    single = {b: i for i, b in tokens.items() if len(b) == 1}
    tokens |= {i: s.encode() for s, i in special.items()}
    return Vocabulary(tokens, tuple(single[bytes([b])] for b in range(256)), merges, special)
