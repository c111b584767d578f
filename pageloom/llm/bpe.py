"""Fast exact encoding with a public tokenizer file.

The byte-level tokenizer first splits a text into pieces and merges bytes within
each piece only. A piece starts wherever a blank or line feed follows a character that
is not white space, so texts can be cut there and the parts encoded apart. Parts repeat
(they are mostly single words); each distinct part is encoded once per batch, and a
bounded cache of the worker process keeps it for later batches.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are split and encoded at once.
BATCH_BYTES = 12 << 20
#: Entries after which a worker's cache starts anew.
CACHE = 1_000_000
#: A blank or line feed after white space (or after what some library may take for it).
_SPACE = r"\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{180E}\x{2000}-\x{200D}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}"
_UNSAFE = f"[{_SPACE}][ \\n]"
_DOUBTFUL = "".join(map(chr, (0x180E, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)))
_SAFE = re.compile(rf"(?<=[^\s{_DOUBTFUL}])(?=[ \n])")
_MARKS = [chr(c) for c in (*range(1, 9), *range(14, 28), *range(0xE000, 0xE020))]

_ENCODERS: dict[str, "Encoder"] = {}


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}

    @staticmethod
    def of(path: str) -> "Encoder":
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]

    def _known(self, parts: list[str]) -> list[bytes]:
        """Ids of each distinct part as little-endian 32-bit integers."""
        missing = [p for p in parts if p not in self.cache]
        if len(self.cache) + len(missing) > CACHE:
            self.cache, missing = {}, parts
        for at in range(0, len(missing), 20_000):
            some = missing[at : at + 20_000]
            for part, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                self.cache[part] = array("I", e.ids).tobytes()
        return [self.cache[p] for p in parts]

    def encode(self, texts: pa.Array, want_ids: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
        """Number of ids of each text, and the ids of all texts in order."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        mark = next((m for m in _MARKS if not pc.any(pc.match_substring(texts, m)).as_py()), None)
        if mark is None:  # every mark occurs in these texts
            if len(texts) > 1:
                halves = [self.encode(x, want_ids) for x in (texts.slice(0, len(texts) // 2), texts.slice(len(texts) // 2))]
                return np.concatenate([h[0] for h in halves]), np.concatenate([h[1] for h in halves]) if want_ids else None
            split = pa.array([_SAFE.split(texts[0].as_py())], pa.large_list(pa.large_string()))
        else:
            marked = pc.replace_substring(pc.replace_substring(texts, " ", mark + " "), "\n", mark + "\n")
            unsafe = pc.match_substring_regex(texts, _UNSAFE)
            if pc.any(unsafe).as_py():
                own = pa.array([_SAFE.sub(mark, t) for t in texts.filter(unsafe).to_pylist()], pa.large_string())
                marked = pc.replace_with_mask(marked, unsafe, own)
            split = pc.split_pattern(marked, mark)
        offsets = split.offsets.to_numpy().astype(np.int64)
        coded = split.flatten().dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False)
        known = self._known(coded.dictionary.to_pylist())
        stops = np.cumsum(np.fromiter(map(len, known), np.int64, len(known))) >> 2
        ends = np.concatenate([[0], np.cumsum(np.diff(stops, prepend=0)[which])])
        counts = ends[offsets[1:]] - ends[offsets[:-1]]
        if not want_ids:
            return counts, None
        flat = np.frombuffer(b"".join(known), "<u4")
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], stops]), flat)
        return counts, lists.take(coded.indices).flatten().to_numpy()


def byte_batches(batch: pa.RecordBatch, column: str, limit: int = BATCH_BYTES):
    """Slices of about ``limit`` bytes of text each; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if i > at and held + n > limit:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(n)
    if at < len(sizes):
        yield batch.slice(at)
