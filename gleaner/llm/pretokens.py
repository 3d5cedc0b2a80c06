"""How byte-level BPE vocabularies split text into words before merging, and what their files hold."""

from __future__ import annotations

import functools
import json
import re

import regex

#: The usual split of byte-level vocabularies.
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same split for text below U+0250, where all letters, numbers and spaces can be listed.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
NARROW = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WIDE = re.compile("[^\x00-ɏ]")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed vocabulary file is; looked up on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pretokens(text: str) -> list[str]:
    return PATTERN.findall(text) if _WIDE.search(text) else NARROW.findall(text)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def supported(file: dict) -> bool:
    """Whether a vocabulary file asks for what this module does: byte-level split without normalizing, plain merges."""
    split, model = file.get("pre_tokenizer") or {}, file["model"]
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    whole = not any(t.get(k) for t in file["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
    bytes_ = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    return file.get("normalizer") is None and bytes_ and model.get("type", "BPE") == "BPE" and plain and whole and (file.get("decoder") or {}).get("type") == "ByteLevel"


@functools.lru_cache(4)
def load(path: str) -> tuple[list[bytes], list[int], dict[int, int], list[int], dict[str, int]]:
    """Bytes by id, the id of each byte, rank by pair (left << 20 | right), id by rank, special ids by text."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    if not supported(file):
        raise ValueError(f"{path} splits or merges text in another way than byte-level vocabularies do")
    letters, vocab, special = byte_letters(), file["model"]["vocab"], {x["content"]: x["id"] for x in file["added_tokens"]}
    pieces = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for token, i in vocab.items():
        pieces[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
    for token, i in special.items():
        pieces[i] = token.encode()
    ids = {b: vocab[c] for c, b in letters.items()}
    ranks, merged = {}, []
    for rank, pair in enumerate(file["model"]["merges"]):
        left, right = pair.split(" ") if isinstance(pair, str) else pair
        ranks[vocab[left] << 20 | vocab[right]] = rank
        merged.append(vocab[left + right])
    return pieces, [ids[b] for b in range(256)], ranks, merged, special


def splitter(special: dict[str, int]) -> re.Pattern | None:
    """Cuts a text around the strings of special tokens, longest first."""
    return re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
