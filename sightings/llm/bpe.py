"""Token ids of whole texts with a tokenizer file, in bounded memory.

A text is cut before white space that follows something else. The byte-level pattern of such
tokenizers never joins the two sides of such a place, so the ids of the pieces, one after the
other, are the ids of the text. Nor does it join a letter or digit to signs that follow, but for
the apostrophe. New pieces go through the tokenizer many at once; a worker remembers those that
it meets first, among them all frequent ones, up to a number. Where a tokenizer does more than that (a normalizer, another
split), and where a text holds one of its added tokens, the text is encoded whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np

from sightings.llm import storage

#: Distinct pieces that a worker keeps.
KEPT_PIECES = 600_000
#: Characters of a text that are cut up at once.
SEGMENT = 1 << 20

_PIECE = re.compile(r"\s*\S+|\s+")
# Python counts these as white space, the tokenizers' pattern does not.
_ODD = "\x1c\x1d\x1e\x1f"
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"


class _Pieces(dict):
    """Numbers of pieces. A piece that is asked for and unknown gets one, and is noted as new.

    A piece stood after a space; one that begins with a line break stood at the start of a line,
    and one that begins with a space (which is not part of it) at the start of the text. Past
    the limit, pieces are known only until `forget`.
    """

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []
        self.passing: dict[str, int] = {}

    def __missing__(self, piece: str) -> int:
        n = self.passing.get(piece)
        if n is None:
            n = len(self) + len(self.passing)
            if self.passing or n >= KEPT_PIECES:
                self.passing[piece] = n
            else:
                self[piece] = n
            self.new.append(piece)
        return n

    def forget(self) -> None:
        self.passing.clear()


class _Ids:
    """Token ids by the number of a piece: one long array with starts and lengths."""

    def __init__(self) -> None:
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.starts, self.lengths = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def put(self, numbers: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> None:
        top = int(numbers.max(initial=-1)) + 1
        if top > len(self.starts):
            self.starts = np.resize(self.starts, 2 * top)
            self.lengths = np.resize(self.lengths, 2 * top)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.used + len(ids)))
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[numbers] = self.used + np.cumsum(lengths) - lengths
        self.lengths[numbers] = lengths
        self.used += len(ids)

    def get(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces one after the other, how many of each)."""
        n = self.lengths[numbers].astype(np.int64)
        ends = np.cumsum(n)
        at = np.repeat(self.starts[numbers] - ends + n, n)
        at += np.arange(len(at))
        return self.flat.take(at), n


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.in_pieces = (
            spec.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space")
            and split.get("use_regex", True)
        )
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        vocabulary = self.tokenizer.get_vocab()
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token)  # a character of the vocabulary is a byte
        self.known, self.ids, self.unsafe = _Pieces(), _Ids(), np.zeros(1 << 14, bool)
        self.settled = 0  # pieces that stay, as of the last run

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self) -> None:
        """Find the ids of the new pieces."""
        known = self.known
        plain: list[str] = []
        joined: list[tuple[int, int, int]] = []  # piece, its stem, the signs that end it
        k = 0
        while k < len(known.new):  # stems and signs are new pieces themselves
            p = known.new[k]
            k += 1
            if not p or p[-1].isspace() or p[1:2].isspace() and p[0].isspace():
                n = known[p]
                if n >= len(self.unsafe):
                    self.unsafe = np.concatenate([self.unsafe, np.zeros(n + 1, bool)])
                self.unsafe[n] = True
            elif p[-1] in _SIGNS and (stem := p.rstrip(_SIGNS)) and stem[-1].isalnum():
                joined.append((known[p], known[stem], known[" " + p[len(stem) :]]))
            else:
                plain.append(p)
        for k in range(0, len(plain), 4096):
            part = plain[k : k + 4096]
            strings = [p if p[0] == "\n" else "\n" + p[1:] if p[0] == " " else " " + p for p in part]
            e = self.tokenizer.encode_batch_fast(["".join(strings)], add_special_tokens=False)[0]
            ids = np.array(e.ids, np.uint32)
            ends = np.cumsum(self.widths[ids])
            want = np.cumsum(np.fromiter(map(len, map(str.encode, strings)), np.int64, len(part)))
            cuts = np.searchsorted(ends, want) + 1
            if (ends[cuts - 1] != want).any():
                raise ValueError("the tokenizer joins pieces that the cut keeps apart")
            # The line break that stood for the start of a text is left out again.
            first = np.concatenate([[0], cuts[:-1]])
            heads = np.fromiter((p[0] == " " for p in part), bool, len(part))
            if (self.widths[ids[first[heads]]] != 1).any():
                raise ValueError("the tokenizer joins a line break to what follows")
            lengths = np.diff(np.concatenate([[0], cuts])) - heads
            stay = np.ones(len(ids), bool)
            stay[first[heads]] = False
            numbers = np.fromiter(map(known.__getitem__, part), np.int64, len(part))
            self.ids.put(numbers, lengths, ids[stay])
        if joined:
            parts = np.array(joined, np.int64)
            ids, n = self.ids.get(parts[:, 1:].reshape(-1))
            self.ids.put(parts[:, 0], n.reshape(-1, 2).sum(axis=1), ids)
        known.new.clear()

    @staticmethod
    def _segments(text: str) -> Iterator[tuple[bool, str]]:
        """Parts of a text, and whether a space stood before each."""
        start, spaced = 0, False
        while len(text) - start > 2 * SEGMENT:
            at = text.find(" ", start + SEGMENT)
            while 0 <= at < len(text) - 1 and (text[at - 1].isspace() or text[at + 1].isspace()):
                at = text.find(" ", at + 1)
            if at < 0 or at == len(text) - 1:
                break
            yield spaced, text[start:at]
            start, spaced = at + 1, True
        yield spaced, text[start:]

    def _by_pattern(self, text: str) -> bytes:
        """The slower way, for white space of any kind."""
        pieces = _PIECE.findall(text)
        es = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return b"".join(np.array(e.ids, "<u4").tobytes() for e in es)

    def encode(self, text: str | None) -> bytes:
        """The ids of one text; null is empty."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of several texts; new pieces of all go through the tokenizer together."""
        jobs: list[tuple[int, bool, str, np.ndarray]] = []
        out: list[list[bytes]] = [[] for _ in texts]
        look = self.known.__getitem__
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.in_pieces or any(a in t for a in self.added) or any(c in t for c in _ODD):
                out[i].append(self._whole(t))
                continue
            for spaced, part in self._segments(t):
                pieces = part.replace("\n", " \n").split(" ")
                if not spaced:
                    pieces[0] = " " + pieces[0]
                jobs.append((i, spaced, part, np.fromiter(map(look, pieces), np.int32, len(pieces))))
                if len(part) > SEGMENT:
                    self._run(jobs, out)
                    jobs.clear()
        self._run(jobs, out)
        return [x[0] if len(x) == 1 else b"".join(x) for x in out]

    def _run(self, jobs: list, out: list) -> None:
        """The ids of segments from the numbers of their pieces."""
        if not jobs:
            return
        used = self.ids.used
        self._learn()
        top = len(self.known) + len(self.known.passing)
        if top > len(self.unsafe):
            self.unsafe = np.concatenate([self.unsafe, np.zeros(top, bool)])
        numbers = np.concatenate([n for _, _, _, n in jobs])
        ids, many = self.ids.get(np.where(self.unsafe[numbers], 0, numbers))
        data = memoryview(ids.astype("<u4", copy=False).tobytes())
        ends = np.cumsum(many)
        bounds = np.cumsum([len(n) for _, _, _, n in jobs])
        odd = np.add.reduceat(self.unsafe[numbers], bounds - [len(n) for _, _, _, n in jobs]) > 0
        start = 0
        for (i, spaced, part, _), stop, by_pattern in zip(jobs, (4 * ends[bounds - 1]).tolist(), odd):
            if by_pattern:
                out[i].append(self._by_pattern(" " + part if spaced else part))
            else:
                out[i].append(bytes(data[start:stop]))
            start = stop
        if self.known.passing:
            self.unsafe[len(self.known) :] = False
            self.known.forget()
            if self.settled == len(self.known):
                self.ids.used = used
        self.settled = len(self.known)


KIND = "encoders"


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The worker's encoder for a file; loaded once, until a step of another kind needs the memory."""
    encoders: dict[tuple, Encoder] = storage.kept(KIND)
    key = (path, special_as_text)
    if key not in encoders:
        encoders[key] = Encoder(path, special_as_text)
    return encoders[key]
