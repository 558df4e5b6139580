"""Token ids by the ``tokenizers`` library, with a bounded cache of chunks.

Byte-level BPE never merges across the start of a pre-token, and a single space or line feed
between two non-blank characters always starts one.  A text can therefore be cut there, each
chunk encoded alone and the ids joined.  Natural text repeats its chunks, so a worker encodes
each of them once and looks the rest up; the ids are those of encoding the whole text.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

#: Chunks kept by one Python worker; beyond it the cache starts afresh (about 120 MB when full).
CACHE_CHUNKS = 500_000
#: A chunk is kept from its second sight on; this many bits remember the first.
SEEN = 1 << 23
_PUNCTUATION = ".,;:!?|)]}"
#: White space other than space and line feed.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")

_encoders: dict[str, ChunkEncoder] = {}


def default_tokenizer() -> str:
    """Path of the public byte-level BPE vocabulary that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str) -> ChunkEncoder:
    """The worker's encoder for a vocabulary file, loaded once per Python worker."""
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _safe(text: str) -> bool:
    """Whether every space and line feed stands alone between other characters: no pre-token spans a cut there."""
    doubled = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
    return not (doubled or text[0] in " \n" or text[-1] in " \n" or _OTHER_SPACE.search(text))


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable ones as they are, others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class ChunkEncoder:
    """``encode_many(texts)``: little-endian uint32 ids as bytes; null and empty texts give no ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text in a document
        #: ids of a chunk with the space before it, or of a line feed and the chunk after it
        self.known: dict[str, bytes] = {}
        self.seen = bytearray(SEEN)
        self.feed = int(self._ids("\n")[0])
        self.feed_ids = np.array([self.feed], "<u4").tobytes()
        self.marks = {"": b""} | {m: self._ids(m).tobytes() for m in _PUNCTUATION}
        self.model, self.space = self.tokenizer.model.tokenize, _byte_letters()[32]
        # a space and letters are one pre-token of a byte-level tokenizer, so its model can be asked at once
        state = json.loads(self.tokenizer.to_str())
        before = state["pre_tokenizer"] or {}
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.letters = _byte_letters() if byte_level and not state["normalizer"] and state["model"]["type"] == "BPE" else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _word(self, lead: str, word: str) -> bytes:
        """Ids of letters after a space (``lead`` is its letter) or after nothing: one pre-token for the model."""
        mapped = word if word.isascii() else word.encode().decode("latin1").translate(self.letters)
        return array("I", [t.id for t in self.model(lead + mapped)]).tobytes()

    def _learn(self, wanted: set[str]) -> list[str]:
        """Put the chunks not known yet into ``known``; returns those that should not stay there.

        Letters, with a line feed before or punctuation after them, go to the model; the rest is encoded
        in one call, a line each, and cut at the line feeds.
        """
        known, seen, word, mark = self.known, self.seen, self._word, self.marks
        once, rest = [], []
        for c in wanted.difference(known):
            if self.letters is None:
                rest.append(c)
            elif c.isalpha():
                known[c] = word(self.space, c)
            else:
                # closing punctuation after a letter, and a line feed before one, are pre-tokens of their own
                fed, tail = c[0] == "\n", c[-1] if c[-1] in mark else ""
                core = c[fed : len(c) - len(tail)]
                if not core.isalpha():
                    rest.append(c)
                elif fed:
                    known[c] = self.feed_ids + word("", core) + mark[tail]
                else:
                    known[c] = (known.get(core) or word(self.space, core)) + mark[tail]
            bit = hash(c) % SEEN
            if not seen[bit]:
                seen[bit] = 1
                once.append(c)
        if rest:
            ids = self._ids("\n".join([c[1:] if c[0] == "\n" else " " + c for c in rest]))
            ends = np.append(np.flatnonzero(ids == self.feed), len(ids)).tolist()
            raw, start = ids.tobytes(), 0
            for c, end in zip(rest, ends, strict=True):
                known[c] = self.feed_ids + raw[4 * start : 4 * end] if c[0] == "\n" else raw[4 * start : 4 * end]
                start = end + 1
        return once

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text."""
        known = self.known
        if len(known) > CACHE_CHUNKS:
            known.clear()
        cut = [text.replace("\n", " \n").split(" ") if text and _safe(text) else None for text in texts]
        wanted: set[str] = set()
        for chunks in cut:
            if chunks:
                wanted.update(chunks[1:])
        once = self._learn(wanted)
        get = known.__getitem__
        out = []
        for text, chunks in zip(texts, cut, strict=True):
            if chunks is None:
                out.append(self._ids(text).tobytes() if text else b"")
            else:
                out.append(self._ids(chunks[0]).tobytes() + b"".join(map(get, chunks[1:])))
        for c in once:
            del known[c]
        return out
