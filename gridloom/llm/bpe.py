"""Byte-level BPE ids of whole batches of texts.

A text is cut into the tokenizer's pieces by numpy passes over character classes; only distinct
pieces are merged (same vocabulary as merge ranks), then their ids are laid out for all
occurrences at once. A text that holds a special token's string goes through the tokenizer itself.
"""

from __future__ import annotations

import base64
import json
import unicodedata
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa

from gridloom.llm.common import hash_spans, string_chunks

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
#: Distinct pieces that a worker remembers; beyond, it starts anew.
_REMEMBERED = 200_000


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = _LETTER
        elif kind == "N":
            table[cp] = _NUMBER
    # fixed values: the characters with Unicode's White_Space property
    for cp in [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]:
        table[cp] = _SPACE
    return table


def piece_starts(cps: np.ndarray, doc_start: np.ndarray) -> np.ndarray:
    """Character positions at which pieces begin. ``doc_start``: first character of each non-empty document."""
    n = len(cps)
    cls = _classes()[cps]
    first = np.zeros(n, bool)
    first[doc_start] = True
    last = np.zeros(n, bool)
    last[doc_start[1:] - 1] = True
    last[-1] = True
    space = cls == _SPACE
    prev_cls = np.empty(n, np.uint8)
    prev_cls[0] = 255
    prev_cls[1:] = cls[:-1]
    prev_cls[first] = 255
    blank = cps == 0x20
    after_blank = np.zeros(n, bool)
    after_blank[1:] = blank[:-1]
    after_blank[first] = False
    before_dark = np.zeros(n, bool)
    before_dark[:-1] = ~space[1:]
    before_dark[last] = False
    start = np.where(space, (prev_cls != _SPACE) | before_dark, (prev_cls != cls) & ~after_blank)
    # contractions: 's 't 'm 'd 're 've 'll where a piece begins at the apostrophe
    quote = np.flatnonzero((cps == 0x27) & start)
    if len(quote):
        ahead = np.concatenate([cps, np.zeros(3, cps.dtype)])
        end = np.searchsorted(doc_start, quote, "right")
        limit = np.append(doc_start, n)[end]
        a = np.where(quote + 1 < limit, ahead[quote + 1], 0)
        b = np.where(quote + 2 < limit, ahead[quote + 2], 0)
        two = np.isin(a, [ord(c) for c in "stmd"])
        three = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        # within a run of apostrophes only the first begins a piece, so only ' followed by letters counts
        for hit, width in ((quote[two], 2), (quote[three & ~two], 3)):
            start[hit + 1] = False
            after = hit + width
            inside = after < np.append(doc_start, n)[np.searchsorted(doc_start, hit, "right")]
            after = after[inside]
            # a letter, number or sign that follows the contraction begins a new piece; white space begins one anyway
            start[after[~space[after]]] = True
    return np.flatnonzero(start)


def _is_plain(file: dict) -> bool:
    """Whether a tokenizer's file says just what the passes here do: byte-level pieces, and merges within them."""
    model, cut = file["model"], file.get("pre_tokenizer") or {}
    other = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")
    byte_level = cut.get("type") == "ByteLevel" and not cut.get("add_prefix_space") and cut.get("use_regex", True)
    return model.get("type", "BPE") == "BPE" and byte_level and not file.get("normalizer") and not any(model.get(k) for k in other)


class PieceTokenizer:
    """``encode`` gives uint32 ids and offsets by text, equal to ``tokenizers`` with add_special_tokens=False.

    A file that asks for anything but plain byte-level BPE is left to the tokenizer itself.
    """

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.special = [t["content"].encode() for t in model.get("added_tokens", [])]
        self.plain = _is_plain(model)
        if not self.plain:
            return
        back = {v: k for k, v in _byte_alphabet().items()}
        special_ids = {t["id"] for t in model.get("added_tokens", [])}
        ranks = {bytes(back[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if i not in special_ids}
        import tiktoken

        self.merger = tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.known: dict[int, int] = {}
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 14, np.int64)
        self.used = 0

    @cached_property
    def tokenizer(self):
        """The tokenizer itself, which only some texts need."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _learn(self, hashes: np.ndarray, pieces: list[bytes]) -> None:
        core = self.merger.encode_ordinary  # the pattern takes a piece as a whole
        for h, piece in zip(hashes.tolist(), pieces, strict=True):
            got = core(piece.decode())
            k = len(self.known)
            if k + 2 > len(self.begin):
                self.begin = np.concatenate([self.begin, np.zeros(len(self.begin), np.int64)])
            if self.used + len(got) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(got)), np.uint32)])
            self.ids[self.used : self.used + len(got)] = got
            self.begin[k] = self.used
            self.used += len(got)
            self.begin[k + 1] = self.used
            self.known[h] = k

    def _chunk(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = int(offsets[-1])
        if not size:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        cps = np.frombuffer(buf.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        lead = np.flatnonzero((buf & 0xC0) != 0x80)
        doc_byte = np.unique(offsets[:-1][np.diff(offsets) > 0])
        start = lead[piece_starts(cps, np.searchsorted(lead, doc_byte))]
        length = np.diff(np.append(start, size))
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        codes, distinct = pd.factorize(hash_spans(padded, start, length))
        if len(self.known) > _REMEMBERED:
            self.known, self.used = {}, 0
        rows = np.array([self.known.get(h, -1) for h in distinct.tolist()], np.int64)
        if (new := np.flatnonzero(rows < 0)).size:
            where = np.empty(len(distinct), np.int64)
            where[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
            raw = buf.tobytes()
            spans = zip(start[where[new]].tolist(), length[where[new]].tolist(), strict=True)
            base = len(self.known)
            self._learn(distinct[new], [raw[s : s + n] for s, n in spans])
            rows[new] = np.arange(base, base + len(new))
        row = rows[codes]
        count = self.begin[row + 1] - self.begin[row]
        ends = np.cumsum(count)
        pick = np.repeat(self.begin[row] - (ends - count), count) + np.arange(int(ends[-1]))
        by_piece = np.concatenate([[0], ends])
        return self.ids[pick], by_piece[np.searchsorted(start, offsets)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids: list[np.ndarray] = []
        ends: list[np.ndarray] = [np.zeros(1, np.int64)]
        total = 0
        for _, _, buf, offsets in string_chunks(column):
            raw = buf.tobytes()
            if not self.plain:
                texts = [raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                parts = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
                got, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            elif any(s in raw for s in self.special):
                parts = []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                    if any(s in raw[a:b] for s in self.special):
                        parts.append(np.array(self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids, np.uint32))
                    else:
                        parts.append(self._chunk(buf[a:b], np.array([0, b - a], np.int64))[0])
                got, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            else:
                got, at = self._chunk(buf, offsets)
            ids.append(got)
            ends.append(at[1:] + total)
            total += len(got)
        return np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.concatenate(ends)


def _byte_alphabet() -> dict[int, str]:
    """Byte-level BPE's printable stand-ins: printable Latin-1 bytes stand for themselves, others move past 255."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(moved)) for b in range(256)}


@lru_cache(maxsize=2)
def tokenizer(path: str) -> PieceTokenizer:
    return PieceTokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))
