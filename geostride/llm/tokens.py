"""Token ids of whole texts with a public tokenizer file; nothing is trained.

The tokenizer splits text into pieces (words, digits, runs of signs) and encodes each piece alone, so a worker keeps the
ids of the pieces that it has met and hands only new ones to the library. Texts with characters whose treatment is not
plainly the same (outside printable ASCII and the Latin-1 letters, or with the opening of a special token) go to the
library whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence

import numpy as np

#: Ids of so many distinct pieces are kept by a worker; then all go that the batch at hand doesn't hold.
CACHE = 200_000
SAFE = re.compile("[\\t\\n\\r\\x20-\\x7eÀ-ÖØ-öø-ÿ]*")
#: The split of the tokenizer's own file, for lower-cased safe text.
PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\s0-9a-zß-öø-ÿ]+")
#: The split of the tokenizer file for which the piece cache holds.
KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Texts to ids, as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        state = lambda part: "" if part is None else json.dumps(json.loads(part.__getstate__()), ensure_ascii=False)
        self.by_piece = KNOWN_SPLIT in state(self.tokenizer.pre_tokenizer).replace("\\\\", "\\") and "Lowercase" in state(self.tokenizer.normalizer)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.ids: dict[str, bytes] = {}

    def _pieces(self, pieces: list[str], together: int = 500) -> list[bytes]:
        """Ids of each piece: many are encoded as one text, parted again where a token ends its piece."""
        joined = [" ".join(pieces[k : k + together]) for k in range(0, len(pieces), together)]
        ids = np.concatenate([np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        raw, out, start = ids.tobytes(), [], 0
        for end in (np.flatnonzero(self.ends[ids]) + 1).tolist():
            out.append(raw[4 * start : 4 * end])
            start = end
        return out if len(out) == len(pieces) else self._whole(pieces)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        out: list[bytes | None] = [None] * len(texts)
        split: list[tuple[int, list[str]]] = []
        for k, text in enumerate(texts):
            text = text or ""
            if self.by_piece and SAFE.fullmatch(text) and "<|" not in text:
                split.append((k, PIECES.findall(text.lower())))
            else:
                out[k] = self._whole([text])[0]
        ids = self.ids
        met: set[str] = set()
        for _, pieces in split:
            met.update(pieces)
        new = [p for p in met if p not in ids]
        if len(ids) + len(new) > CACHE:
            # what this batch holds stays: the frequent pieces are among it
            ids = self.ids = {p: ids[p] for p in met if p in ids}
        if new:
            ids.update(zip(new, self._pieces(new), strict=True))
        for k, pieces in split:
            out[k] = b"".join(map(ids.__getitem__, pieces))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(texts: Sequence[str | None], most: int = 4_000_000):
    """Ranges of the batch that hold some `most` characters each, so that memory follows a slice, not the batch."""
    start, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield start, k + 1
            start, size = k + 1, 0
    if start < len(texts):
        yield start, len(texts)
