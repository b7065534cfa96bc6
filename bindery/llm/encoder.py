"""Exact and fast use of the public tokenizers.

Piece cache. The byte-level pattern cuts a text into pre-tokens, and merges stay inside them.
Letters, digits and other signs take at most one space, at their start, and a run of white
space gives its last character to what follows. So a single space before a character that is no
white space always begins a pre-token, and a single line feed between two such characters is a
pre-token of its own. A text cut at these places encodes to the concatenated ids of its
pieces, and the ids of a piece can be kept: pieces are the words of a text, with the
space or line feed before them. Texts with other white space are cut before single spaces
alone. Strings of added tokens are cut out first, as the library does it.

The pieces of a group of texts are found on their bytes. Equal ones are told by a hash and held
against each other byte for byte. Those that are Latin letters and then signs, or signs alone,
are merged together on arrays (byte_pairs.py); the others go to the library, and a text with one
that can't be a piece is cut before single spaces.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .byte_pairs import BytePairs
from .common import mixed

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

BYTE_BPE = "byte_bpe_50k.json"
_CUT = re.compile(r" (?=\S)")
#: Longer pieces are encoded each time.
_KEPT_CHARS = 64
#: Characters that are encoded together; longer texts are cut before spaces.
GROUP = 1 << 21
#: Signs after a word; up to the bound of kept characters they repeat much.
_MARKS = ".,;:!?*#$%&"
#: The first bytes of U+00C0 to U+023F, which are letters but for two signs.
_LATIN = range(0xC3, 0xC9)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(BYTE_BPE)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for
    themselves, the others from U+0100 on, in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class JsonEncoder:
    """ids as little-endian unsigned 32-bit integers. kept: bound of the cache's entries."""

    def __init__(self, path: str, kept: int = 200_000):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kept = kept
        self.added = {t.content: int(i).to_bytes(4, "little") for i, t in self.library.get_added_tokens_decoder().items()}
        plain = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in self.library.get_added_tokens_decoder().values())
        self.cuts = plain and self._byte_level()
        self._added = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.ids: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}
        feed = self.library.encode("\n", add_special_tokens=False).ids
        self.line_feed, self.feed = feed[0], feed[0].to_bytes(4, "little")
        self.cuts = self.cuts and len(feed) == 1
        self.pairs = self._pairs() if self.cuts else None
        kind = np.full(256, 2, np.int8)  # 0 letters, 1 marks, 2 others
        kind[[b for b in range(128) if chr(b).isalpha()] + [*range(0x80, 0xC0), *_LATIN]] = 0
        kind[list(_MARKS.encode())] = 1
        self._kind = kind

    def _byte_level(self) -> bool:
        import json

        d = json.loads(self.library.to_str())
        pre = d.get("pre_tokenizer") or {}
        return d.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True) and d["model"].get("dropout") is None

    def _pairs(self) -> BytePairs | None:
        """The merges of a plain byte-level model; None if it has rules of its own."""
        import json

        m = json.loads(self.library.to_str())["model"]
        if m.get("type") != "BPE" or any(m.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            return None
        ids, pairs = m["vocab"], [x if isinstance(x, list) else x.split(" ") for x in m["merges"]]
        letters = _byte_letters()
        if not all(x in ids for x in letters.values()):
            return None
        merges = np.array([(ids[a], ids[b], ids[a + b]) for a, b in pairs], np.int64).reshape(-1, 3)
        if len(np.unique(merges[:, :2], axis=0)) < len(merges):
            return None
        return BytePairs(np.array([ids[letters[b]] for b in range(256)]), merges, max(ids.values()) + 1)

    def _raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if not self.cuts:
            return [x if t else b"" for t, x in zip(texts, self._raw(texts))]
        out: list[bytes | None] = [None] * len(texts)
        parts: list[tuple[int, str]] = []  # the text, and what stands for a part: its separator and its pieces
        feeds = set()
        for k, t in enumerate(texts):
            if not t:
                out[k] = b""
            elif self._added is not None and any(x in t for x in self.added):
                out[k] = b"".join(self.added[x] if j % 2 else self.encode(x) for j, x in enumerate(self._added.split(t)))
            else:
                feed = t[-1] == "\n" and len(t) > 1 and not t[-2].isspace()
                if feed:
                    t = t[:-1]
                if "\n\n" in t or "\n " in t or " \n" in t or "  " in t or t[0].isspace() or t[-1].isspace():
                    out[k] = self._by_spaces(t) + self.feed * feed
                else:
                    if feed:
                        feeds.add(k)
                    parts += [(k, part) for part in _parts(t)]
        made: dict[int, list[bytes] | None] = {}
        for group in grouped(parts, lambda p: len(p[1]), GROUP):
            for (k, _), ids in zip(group, self._pieces([part for _, part in group])):
                if ids is None:
                    made[k] = None
                elif (held := made.setdefault(k, [])) is not None:
                    held.append(ids)
        for k, found in made.items():
            out[k] = self._by_spaces(texts[k]) if found is None else b"".join(found)[4:] + self.feed * (k in feeds)
        return out

    def _pieces(self, parts: list[str]) -> list[bytes | None]:
        """The ids of each part, which begins with a separator; None for one with what can't be a piece."""
        data = np.frombuffer("".join(parts).encode("utf-8", "surrogatepass"), np.uint8)
        edge = np.flatnonzero((data == 32) | (data == 10))
        start, end, fed = edge + 1, np.append(edge[1:], len(data)), data[edge] == 10
        which, first = _distinct(data, start, end, fed)
        ids, counts, odd = self._learnt(data, start[first], end[first], fed[first])
        offset = np.cumsum(counts) - counts
        n = counts[which]
        ends = np.cumsum(n)
        out = ids[np.repeat(offset[which] - (ends - n), n) + np.arange(int(ends[-1]))].tobytes()
        sizes = np.array([p.count(" ") + p.count("\n") for p in parts])
        last = np.cumsum(sizes)
        bad = np.add.reduceat(odd[which].astype(np.int64), last - sizes) > 0
        cut = np.concatenate(([0], ends[last - 1])) * 4
        return [None if b else out[x:y] for b, x, y in zip(bad.tolist(), cut.tolist(), cut[1:].tolist())]

    def _by_spaces(self, text: str) -> bytes:
        """Any text; pieces are cut before single spaces alone."""
        if not text:
            return b""
        pieces = _CUT.split(text)
        if len(self.odd) > self.kept // 8:
            self.odd = {}
        new = [p for p in set(pieces[1:]).difference(self.odd) if len(p) <= _KEPT_CHARS]
        if new:
            self.odd.update(zip(new, self._raw([" " + p for p in new])))
        odd = self.odd
        return self._raw([pieces[0]])[0] * bool(pieces[0]) + b"".join([odd[p] if p in odd else self._raw([" " + p])[0] for p in pieces[1:]])

    def _learnt(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, fed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct pieces in turn, how many each has, and which can't be pieces.

        Letters with the space before them, or without it after a line feed, are one pre-token and
        the marks behind them another; without letters the marks are one with the space."""
        kind = self._kind[data]
        signs = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        kind[signs] = 2
        sums = lambda x: np.concatenate((np.zeros(1, np.int32), np.cumsum(x, dtype=np.int32)))
        others, letters, turns = sums(kind == 2), sums(kind == 0), sums((kind[:-1] == 1) & (kind[1:] == 0))
        n_letters = letters[end] - letters[start]
        plain = (end - start <= _KEPT_CHARS) & (others[end] == others[start]) & (turns[end - 1] == turns[start])
        del others, letters, turns, kind
        if self.pairs is None:
            plain[:] = False
        at, n = np.flatnonzero(plain), len(start)
        counts, odd, found = np.zeros(n, np.int64), np.zeros(n, bool), []
        if len(at):
            middle = np.where(n_letters > 0, start + n_letters, end)[at]
            ids, each = self.pairs.encode(data, np.column_stack((np.where(fed, start, start - 1)[at], middle)).ravel(), np.column_stack((middle, end[at])).ravel())
            counts[at] = each.reshape(-1, 2).sum(axis=1) + fed[at]
        rest = np.flatnonzero(~plain).tolist()
        if rest:
            raw = data.tobytes()
            names = [raw[a - 1 : b].decode("utf-8", "surrogatepass") for a, b in zip(start[rest].tolist(), end[rest].tolist())]
            if len(self.ids) > self.kept:
                self.ids = {}
            new = []
            for k, p in zip(rest, names):
                if p[1:].isprintable() and len(p) <= _KEPT_CHARS:
                    if p not in self.ids:
                        new.append(p)
                else:
                    odd[k] = True
            self.ids.update(self._lines(new))
            found = [(k, self.ids[p]) for k, p in zip(rest, names) if not odd[k]]
            for k, x in found:
                counts[k] = len(x) // 4
        offset = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), "<u4")
        if len(at):
            out[offset[at[fed[at]]]] = self.line_feed
            mine = counts[at] - fed[at]
            out[np.repeat(offset[at] + fed[at] - (np.cumsum(mine) - mine), mine) + np.arange(len(ids))] = ids
        for k, x in found:
            out[offset[k] : offset[k] + counts[k]] = np.frombuffer(x, "<u4")
        return out, counts, odd

    def _lines(self, pieces: list[str]):
        """Each piece (with its separator) and its ids, encoded as lines of one text: a line feed
        after a printable piece is a pre-token of its own."""
        for k in range(0, len(pieces), 2000):
            part = pieces[k : k + 2000]
            text = "".join([p[p[0] == "\n" :] + "\n" for p in part])
            ids = np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, ends = ids.tobytes(), (np.flatnonzero(ids == self.line_feed) * 4).tolist()
            if len(ends) != len(part):
                raise ValueError("the tokenizer doesn't keep line feeds apart")
            a = 0
            for p, b in zip(part, ends):
                yield p, self.feed + raw[a:b] if p[0] == "\n" else raw[a:b]
                a = b + 4

    def starts(self, text: str) -> list[int]:
        """Where each token begins, in characters."""
        return [a for a, _ in self.library.encode(text, add_special_tokens=False).offsets]

    def count(self, text: str) -> int:
        return len(self.encode(text)) // 4


def _parts(text: str):
    """The text with its first separator, cut before spaces into parts of GROUP characters or a little more."""
    a = 0
    while a < len(text):
        b = text.find(" ", a + GROUP) if a + GROUP < len(text) else -1
        b = len(text) if b < 0 else b
        yield text[a:b] if a else "\n" + text[a:b]
        a = b


def _distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray, fed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each piece the number of its kind, and for each kind its first piece.

    Eight bytes at a time are mixed into a hash; then each piece is compared with its kind's first one."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eights = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(data) + 1,), (1,))
    size = end - start
    mask = np.array([(1 << 8 * k) - 1 for k in range(8)] + [2**64 - 1], np.uint64)
    lane = lambda some, j: eights[np.minimum(start[some] + j, len(data))] & mask[np.clip(size[some] - j, 0, 8)]
    h = mixed((size * 2 + fed).astype(np.uint64))
    live, j = np.arange(len(start)), 0
    while len(live):
        h[live] = mixed(h[live] + lane(live, j))
        j += 8
        live = live[size[live] > j]
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    same = first[which]
    if not ((size == size[same]) & (fed == fed[same])).all():
        raise ValueError("two pieces of one hash")
    live, j = np.flatnonzero(same != np.arange(len(start))), 0
    while len(live):
        if (lane(live, j) != lane(same[live], j)).any():
            raise ValueError("two pieces of one hash")
        j += 8
        live = live[size[live] > j]
    return which, first


class PieceEncoder:
    """A sentencepiece model, without begin or end ids."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)

    def encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, num_threads=1), dtype="<u4").tobytes() if text else b""

    def encode_all(self, texts: list[str]) -> list[bytes]:
        return [self.encode(t) for t in texts]

    def starts(self, text: str) -> list[int]:
        data = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum(data & 0xC0 != 0x80) - 1  # the library counts bytes
        return [int(char[min(p.begin, len(char) - 1)]) for p in self.library.encode(text, return_type="proto").pieces]

    def count(self, text: str) -> int:
        return len(self.library.encode(text, num_threads=1)) if text else 0


_encoders: dict[str, JsonEncoder | PieceEncoder] = {}


def grouped(items, size=len, most: int = GROUP):
    """Lists of consecutive items, of about most characters together."""
    group, held = [], 0
    for x in items:
        group.append(x)
        held += size(x)
        if held >= most:
            yield group
            group, held = [], 0
    if group:
        yield group


def encoded(enc, texts):
    """The ids of each text in turn; a null text has none."""
    for group in grouped((t or "" for t in texts)):
        yield from enc.encode_all(group)


def encoder(path: str):
    """The encoder of this process for a file; workers keep it from task to task."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path) if path.endswith(".model") else JsonEncoder(path)
    return _encoders[path]
