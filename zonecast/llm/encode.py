"""Token ids of whole texts, chunk by chunk through a cache.

The byte-level pattern always breaks before a space that follows or precedes a
non-space, so a text is cut there and each distinct chunk is encoded once; the
ids of a text are the joined ids of its chunks.  Texts in which a space stands
between two other white-space characters are encoded whole.

Ids are those that ``tokenizers`` gives for the vocabulary file as it is.  Its
added tokens stand for themselves: a text is cut at them first, and what lies
between is encoded by itself.  Where the file numbers merged tokens in the order of its merges, as the usual ones do, merging
the lowest id first is the same rule, and the chunks go through ``tiktoken``,
which needs a fraction of the time; else through ``tokenizers``.
"""

from __future__ import annotations

import json
import os
import re
from array import array

#: Distinct chunks kept in a worker, about 200 bytes each.
CACHE = 250_000
_NO_CUT = re.compile(r"\s \s")


def _byte_of() -> dict[str, int]:
    """The characters that stand for bytes in the file: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes to ids, None unless the ids of merged tokens rise in the order of the merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, byte = spec["model"], _byte_of()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    ids = [model["vocab"][m] for m in merged]
    if ids != sorted(set(ids)) or any(model["vocab"][c] >= ids[0] for c in byte):
        return None
    return {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in special}


def _added(spec: dict) -> dict[str, int] | None:
    """Added tokens and their ids; None if one takes the white space or the words around it into account."""
    tokens = spec.get("added_tokens", [])
    if any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in tokens):
        return None
    return {t["content"]: t["id"] for t in tokens if t["content"]}


class Encoder:
    """``ids(text)`` gives little-endian unsigned 32-bit ids as bytes."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.cache: dict[str, bytes] = {}
        with open(path, encoding="utf-8") as f:
            added = _added(json.load(f))
        ranks = merge_ranks(path) if added is not None else None
        self._whole = added is None
        self._added = {t: i.to_bytes(4, "little") for t, i in (added or {}).items()}
        # Of added tokens that begin at one place the longest is meant.
        self._cut = re.compile("|".join(map(re.escape, sorted(self._added, key=lambda t: -len(t))))) if added else None
        if ranks:
            import public_tokenizers
            import tiktoken

            coder = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            self._encode = lambda texts: [array("I", coder.encode_ordinary(t)).tobytes() for t in texts]
        else:
            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            self._encode = lambda texts: [
                array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)
            ]

    def ids(self, text: str) -> bytes:
        if self._whole:
            return self._encode([text])[0]
        if self._cut is None:
            return self._plain(text)
        out, at = [], 0
        for m in self._cut.finditer(text):
            out += [self._plain(text[at : m.start()]), self._added[m.group()]]
            at = m.end()
        return b"".join(out) + self._plain(text[at:]) if out else self._plain(text)

    def _plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if not text:
            return b""
        if _NO_CUT.search(text):
            return self._encode([text])[0]
        first, *rest = text.split(" ")
        head = self._encode([first])[0] if first else b""
        try:
            return head + b"".join(map(self.cache.__getitem__, rest))
        except KeyError:
            if len(self.cache) > CACHE:
                self.cache.clear()
            new = list({w for w in rest if w not in self.cache})
            self.cache.update(zip(new, self._encode([" " + w for w in new]), strict=True))
            return head + b"".join(map(self.cache.__getitem__, rest))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
