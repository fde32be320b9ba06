"""Token ids of many texts under a byte-level BPE file, encoding each different word once.

Such a file splits a text before its merges, and never within " x" where x is no white space. Spaces
therefore cut a text into words whose ids do not depend on their neighbours, and a worker remembers the
ids of words it has met. The few texts in which the cut is not certain (runs of white space that hold a
space, the vocabulary's special strings) go to the `tokenizers` library whole.

The merges of new words are `tokenizers`' own work too, unless the caller names a rank file with the same
vocabulary: `tiktoken` then merges them several times faster. :func:`same_vocabulary` proves that the two
files agree before any work starts.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re

import numpy as np

# A space whose place after other white space, and before more of it, decides the split.
_UNSURE = re.compile(r"\s (?!\S)")
_KNOWN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""  # fixed value


def version_digest(path: str) -> str:
    """Version of a tokenizer: the library's version and the file's content."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(tokenizers.__version__.encode() + b"\n" + f.read()).hexdigest()


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, as letter -> byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def same_vocabulary(path: str, rank_path: str) -> bool:
    """Whether merging by the ranks gives the ids of the JSON file: same tokens, and merges in the order of ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], _byte_letters()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    tokens = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    return tokens == _ranks(rank_path) and merged == sorted(merged) and len(merged) + 256 == len(tokens)


class WordEncoder:
    """Ids of texts as packed little-endian 32-bit numbers; remembers at most twice ``words`` words."""

    def __init__(self, path: str, rank_path: str | None = None, words: int = 200_000):
        self.path, self.words, self.library, self.quick = path, words, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = spec.get("normalizer") is None and all(pre.get(k) == v for k, v in _KNOWN_SPLIT.items())
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        if rank_path and self.by_word:
            import tiktoken

            ranks = _ranks(rank_path)
            self.quick = tiktoken.Encoding("by-rank", pat_str=_SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})
            self.opens = np.zeros(max(ranks.values()) + 1, dtype=bool)
            self.opens[[i for token, i in ranks.items() if token[:1] == b" "]] = True
        self.recent: dict[str, bytes] = {}  # ids of " word" by word
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        if self.library is None:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, words: list[str]) -> list[bytes]:
        """Ids of each word with a space before it. In one text, tokens that begin with a space begin a word."""
        if self.quick is None:
            return self._whole([" " + w for w in words])
        ids = self.quick.encode_to_numpy(" " + " ".join(words)).astype("<u4")
        packed, bounds = ids.tobytes(), [*(np.flatnonzero(self.opens[ids]) * 4).tolist(), 4 * len(ids)]
        return [packed[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of words that are not among the recent ones."""
        if len(self.recent) > self.words:
            self.recent, self.older = {}, self.recent
        found = list(map(self.older.get, words))
        joined, at = [], []
        for i, w in enumerate(words):
            if found[i] is None:
                if not w or w[0].isspace():  # merges with what stands before it when joined
                    found[i] = self._alone(" " + w)
                else:
                    joined.append(w)
                    at.append(i)
        if joined:
            for i, ids in zip(at, self._merge(joined), strict=True):
                found[i] = ids
        self.recent.update(zip(words, found, strict=True))
        return found

    def _alone(self, text: str) -> bytes:
        return self.quick.encode_to_numpy(text).astype("<u4").tobytes() if self.quick else self._whole([text])[0]

    def packed(self, text: str) -> bytes:
        if not self.by_word or _UNSURE.search(text) or any(s in text for s in self.special):
            return self._whole([text])[0]
        head, *rest = text.split(" ")
        found = list(map(self.recent.get, rest))
        if None in found:
            at = [i for i, ids in enumerate(found) if ids is None]
            for i, ids in zip(at, self._learn([rest[i] for i in at]), strict=True):
                found[i] = ids
        return self._alone(head) + b"".join(found)

    def count(self, text: str) -> int:
        return len(self.packed(text)) // 4


_ENCODERS: dict[tuple, WordEncoder] = {}


def encoder(path: str, rank_path: str | None = None) -> WordEncoder:
    """One for each tokenizer and worker process."""
    if (path, rank_path) not in _ENCODERS:
        _ENCODERS[path, rank_path] = WordEncoder(path, rank_path)
    return _ENCODERS[path, rank_path]
