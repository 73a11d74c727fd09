"""A byte-level BPE vocabulary file, read on the driver, taken apart in a task and sent to workers.

Only the format of ``byte_bpe_50k.json`` is read: BPE over bytes, split by the
ByteLevel pattern, ids in merge order, special tokens matched before anything
else. Anything else is refused, so results are exact or there are none. The
file's size is fixed (about 50,000 entries), which bounds what is broadcast.
"""

from __future__ import annotations

import json
import os
import pickle
import re
from functools import lru_cache

#: The split pattern of the ByteLevel pre-tokenizer (a fixed value of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _later_characters(content: str) -> list[int]:
    """Characters that ``regex`` knows as letters or digits and the library, of an older Unicode, does not."""
    import regex
    from tokenizers import Tokenizer

    split = Tokenizer.from_str(content).pre_tokenizer.pre_tokenize_str
    letter, digit = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
    points = (chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000)
    return [ord(c) for c in points if letter.match(c) and len(split("a" + c)) > 1
            or digit.match(c) and len(split("1" + c)) > 1]


def _ranges(points: list[int]) -> str:
    """The inside of a character class."""
    runs: list[list[int]] = []
    for c in points:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The format's printable stand-in for each byte: itself where printable, else the next from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _content(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


class Vocabulary:
    """Byte strings by id and the special tokens; ``coder`` builds the encoder in the process that uses it."""

    def __init__(self, path: str, content: str | None = None) -> None:
        content = _content(path) if content is None else content
        spec = json.loads(content)
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True,
                                             "use_regex": True} or spec["normalizer"] or model["ignore_merges"]:
            raise ValueError(f"{path} is not a byte-level BPE vocabulary of the supported form")
        chars = _byte_of_char()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        words = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.ranks = {bytes(chars[c] for c in t): i for t, i in words.items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        in_order = [words[a + b] for a, b in merges]
        if in_order != sorted(in_order) or sorted(self.ranks.values()) != list(range(len(self.ranks))):
            raise ValueError(f"{path}: ids do not follow the merges' order")
        self.later = _later_characters(content)

    def whole_tokens(self) -> frozenset[str]:
        """Vocabulary strings proved to be one pre-token that encodes as one token wherever it stands alone."""
        coder = Coder(self)
        proved = set()
        for token, i in self.ranks.items():
            try:
                s = token.decode()
            except UnicodeDecodeError:
                continue
            if coder.pretokens(s) == [s] and coder.merge(token) == [i]:
                proved.add(s)
        return frozenset(proved)


class Coder:
    """Encoder and decoder of one vocabulary in one process."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import regex
        import tiktoken

        self.space = regex.compile(r"\s+")
        # The plain pattern is exact below the first character that the two Unicode versions class differently.
        self._plain = regex.compile(PATTERN)
        later = _ranges(vocabulary.later)
        self._high = re.compile(f"[^\x00-{chr(min(vocabulary.later, default=0x110000) - 1)}]")
        self._exact = regex.compile("(?V1)" + PATTERN.replace(r"[^\s\p{L}\p{N}]", f"[[^\\s\\p{{L}}\\p{{N}}]||[{later}]]")
                                    .replace(r"?\p{L}+", f"?[\\p{{L}}--[{later}]]+")
                                    .replace(r"?\p{N}+", f"?[\\p{{N}}--[{later}]]+")) if later else self._plain
        self.special = vocabulary.special
        self.special_split = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")")
        self._bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
        self.merge = self._bpe._encode_single_piece  # one pre-token's bytes or text to ids
        self.encode_ordinary = self._bpe.encode_ordinary
        self.bytes_of = [b""] * (1 + max([*vocabulary.ranks.values(), *vocabulary.special.values()]))
        for b, i in vocabulary.ranks.items():
            self.bytes_of[i] = b
        for s, i in vocabulary.special.items():
            self.bytes_of[i] = s.encode()

    def pretokens(self, text: str) -> list[str]:
        return (self._exact if self._high.search(text) else self._plain).findall(text)

    def spans(self, text: str):
        """(start, end) of each pre-token, one after the other."""
        return (m.span() for m in (self._exact if self._high.search(text) else self._plain).finditer(text))

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """(ordinary text, None) and (special string, its id) in order; special strings are found first."""
        if not any(s in text for s in self.special):
            return [(text, None)] if text else []
        return [(p, self.special.get(p)) for p in self.special_split.split(text) if p]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part, special in self.parts(text):
            if special is None:
                ids += self.encode_ordinary(part)
            else:
                ids.append(special)
        return ids

    def to_bytes(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(maxsize=4)
def load(path: str) -> Vocabulary:
    return Vocabulary(path)


_CODERS: dict[int, Coder] = {}


def coder_of(shared) -> Coder:
    """The coder of a broadcast vocabulary, built once per worker process."""
    if shared.id not in _CODERS:
        _CODERS.clear()
        _CODERS[shared.id] = Coder(shared.value)
    return _CODERS[shared.id]


def _packed(path: str, content: str) -> bytes | ValueError:
    try:
        return pickle.dumps(Vocabulary(path, content))
    except ValueError as refused:
        return refused


def share(spark, path: str | None):
    """Broadcast the vocabulary at ``path``, once in an application: the driver reads the file and passes on the pickled
    vocabulary that a task made of it, so its entries are never objects in the driver's memory."""
    path, context = path or default_path(), spark.sparkContext
    key = (context.applicationId, path, os.stat(path).st_mtime_ns)
    if key not in _SHARED:
        _SHARED.clear()
        packed = context.parallelize([_content(path)], 1).map(lambda x: _packed(path, x)).first()
        if isinstance(packed, ValueError):
            raise packed
        _SHARED[key] = _Shared(context.broadcast(packed))
    return _SHARED[key]


class _Shared:
    """A broadcast with an id that is the same in every process."""

    def __init__(self, broadcast) -> None:
        self.broadcast, self.id = broadcast, hash(broadcast._jbroadcast.id())

    def __reduce__(self):
        return _shared_again, (self.broadcast, self.id)

    @property
    def value(self) -> Vocabulary:
        return pickle.loads(self.broadcast.value)


_SHARED: dict[tuple, _Shared] = {}


def _shared_again(broadcast, i):
    again = _Shared.__new__(_Shared)
    again.broadcast, again.id = broadcast, i
    return again
