"""The byte-level vocabulary of a tokenizer file, with results equal to the tokenizers library's."""

from __future__ import annotations

import json
import os

import numpy as np
import regex

#: The pre-tokenizing pattern that the library's ByteLevel step applies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters whose class is the same in every Unicode version the libraries carry.
#: A text with any other goes to the tokenizers library whole.
_OTHER = regex.compile("[^\u0000-՗‐-‧‰-⁞₠-€←-⇿ぁ-ゖァ-ヺ一-龥가-힣]")


def _letters() -> dict[str, int]:
    """Character in a vocabulary file -> byte: printable bytes stand for themselves, the rest follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def read_vocabulary(path: str) -> str:
    """The file's content: a few MB at most, shipped to the tasks as a broadcast value."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _by_rank(said: dict) -> bool:
    """Whether the file is byte-level BPE whose merges are in order of the ids they make, cut by PATTERN."""
    model, cut, decoder = said["model"], said.get("pre_tokenizer") or {}, said.get("decoder") or {}
    plain = all(not model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or not plain or said.get("normalizer") or decoder.get("type") != "ByteLevel":
        return False
    if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
        return False
    pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    made = [model["vocab"].get(a + b, -1) for a, b in pairs]
    single = [i for w, i in model["vocab"].items() if len(w) == 1]
    simple = all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in said["added_tokens"])
    return simple and made == sorted(set(made)) and len(single) == 256 and max(single) < made[0]


class Vocabulary:
    """Token bytes, special strings and exact encoding for one tokenizer file.

    Where the file's merges follow its ids (see _by_rank), tiktoken's core
    encodes, with the same ids; the tokenizers library itself takes what is left
    and every text of another file.
    """

    def __init__(self, content: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.library.no_truncation()
        self.library.no_padding()
        said, letter = json.loads(content), _letters()
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        words = {w: i for w, i in said["model"]["vocab"].items() if w not in self.special and set(w) <= letter.keys()}
        self.ids = {bytes(letter[c] for c in w): i for w, i in words.items()}
        self.bytes = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.pieces = regex.compile(PATTERN)
        self.by_rank = _by_rank(said)
        own = {"mergeable_ranks": self.ids, "special_tokens": {}}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, **own) if self.by_rank else None
        self.uncut = tiktoken.Encoding("uncut", pat_str="(?s).+", **own) if self.by_rank else None

    def piece(self, raw: bytes) -> list[int]:
        """BPE of one short string as it is, not cut into words."""
        try:
            return self.uncut.encode_ordinary(raw.decode())
        except UnicodeDecodeError:  # a part of a character
            pass
        parts, none = [raw[k : k + 1] for k in range(len(raw))], len(self.ids) + len(self.special)
        while len(parts) > 1:
            rank, at = min((self.ids.get(a + b, none), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ids[p] for p in parts]

    def odd(self, text: str) -> bool:
        """Whether only the library itself should encode this text."""
        return not self.by_rank or (not text.isascii() and _OTHER.search(text) is not None)

    def parts(self, text: str) -> list[str]:
        """The text between and of special strings, in turn; special ones at odd places."""
        return self.split.split(text) if self.special and "<" in text else [text]

    def encode(self, text: str) -> np.ndarray:
        """Ids as the library gives them, without added tokens."""
        if self.odd(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        parts = self.parts(text)
        if len(parts) == 1:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        out = [
            np.array([self.special[p]], np.uint32) if k % 2 else self.fast.encode_to_numpy(p, disallowed_special=())
            for k, p in enumerate(parts)
        ]
        return np.concatenate(out)

    def words(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        if self.odd(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return self.pieces.findall(text)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids in UTF-8; bytes that are no text become U+FFFD, as in the library."""
        if not self.by_rank:
            return self.library.decode(ids.tolist(), skip_special_tokens=False).encode()
        raw = b"".join(map(self.bytes.__getitem__, ids.tolist()))
        return raw.decode("utf-8", "replace").encode()


_loaded: dict[int, tuple[str, Vocabulary]] = {}


def vocabulary(content: str) -> Vocabulary:
    """One Vocabulary a worker process and file."""
    key = hash(content)
    if key not in _loaded or _loaded[key][0] != content:
        _loaded[key] = (content, Vocabulary(content))
    return _loaded[key][1]
