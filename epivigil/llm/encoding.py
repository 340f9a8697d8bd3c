"""Token ids of many texts: each distinct piece of text goes through the tokenizers library's model once.

A byte-pair tokenizer with a pattern splits a text into pieces before it merges anything, and no piece goes on past white space
(a leading space may belong to it). A text's ids are therefore those of its runs between white space, in order, and a run's ids
those of its pieces. This holds for texts of Latin letters, digits, punctuation and plain white space, which is checked character
by character; every other text, every text with a special string, and every tokenizer of another build is encoded whole by the
library.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Tabs, line ends and Latin characters up to U+024F; without control characters, NEL, no-break space, soft hyphen, raised digits,
# fractions and dotted I.
_UNUSUAL = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\xac\\xae-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u012f\\u0131-\\u024f]")
_SPACED = re.compile(r" ?[^ \t\n\r]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
_WIDE_SPACE = ("  ", " \n", "\n ", "\n\n", "\t", "\r")

# Fixed value: the split pattern of the byte-level pre-tokenizer, which its file does not repeat.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[int, str]:
    """Each character up to U+024F as the letters that stand for its UTF-8 bytes: printable ones for themselves, others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    letter = {b: chr(b) if b in own else chr(next(others)) for b in range(256)}
    return {c: x for c in range(0x250) if (x := "".join(letter[b] for b in chr(c).encode())) != chr(c)}


class _Places(dict):
    """Run -> its place in the store; an unknown run gets the next place and waits in ``new``."""

    def __init__(self):
        super().__init__()
        self.base, self.new = 0, []

    def __missing__(self, run):
        self[run] = at = self.base + len(self.new)
        self.new.append(run)
        return at


class Encoder:
    """Ids by the tokenizer in the file ``path``, without special tokens added; ``end_id`` follows each text.

    At most ``most`` runs and as many pieces are remembered; then the store starts anew.
    """

    def __init__(self, path: str, end_id: int, most: int = 500_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        self.specials = [t["content"] for t in conf["added_tokens"]]
        self.by_runs, self.spaced, self.lower, pattern = True, False, False, None
        pre, norm = conf["pre_tokenizer"] or {}, conf["normalizer"]
        parts = pre.get("pretokenizers", [pre])
        kinds = [p.get("type") for p in parts]
        if kinds == ["ByteLevel"] and parts[0]["use_regex"] and not parts[0]["add_prefix_space"] and norm is None:
            self.spaced, pattern = True, BYTE_LEVEL_PATTERN
        elif kinds == ["Split", "ByteLevel"] and not parts[1]["use_regex"] and not parts[1]["add_prefix_space"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"]:
            steps = [n["type"] for n in norm.get("normalizers", [norm])] if norm else []
            self.lower = "Lowercase" in steps
            pattern = parts[0]["pattern"].get("Regex")
            self.by_runs = pattern is not None and set(steps) <= {"NFC", "Replace", "Lowercase"}
        else:
            self.by_runs = False
        self.pieces_in = regex.compile(pattern).findall if self.by_runs else None
        self.letters = _byte_letters()
        self.end_id, self.most = end_id, most
        self.pieces: dict[str, list[int]] = {}
        self._start_anew()

    def _start_anew(self) -> None:
        self.places = _Places()
        self.ids, self.first, self.length = array("I"), array("q"), array("q")
        self._add([[self.end_id]])  # place 0

    def _add(self, lists) -> None:
        for x in lists:
            self.first.append(len(self.ids))
            self.length.append(len(x))
            self.ids.extend(x)
        self.places.base = len(self.first)

    def _run(self, run: str) -> list[int]:
        text = run.lower() if self.lower else run
        if text.isalpha() or text[0] == " " and text[1:].isalpha():
            return self._piece(text)
        out: list[int] = []
        for piece in self.pieces_in(text):
            out += self._piece(piece)
        return out

    def _piece(self, piece: str) -> list[int]:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self.pieces[piece] = [t.id for t in self.model.tokenize(piece.translate(self.letters))]
        return ids

    def _learn(self) -> None:
        if self.places.new:
            new, self.places.new = self.places.new, []
            self._add(map(self._run, new))

    @staticmethod
    def _parted(texts: list[str], mark: str) -> pa.Array:
        """``texts`` with ``mark`` between letters or digits and other characters, where pieces always end: fewer runs are distinct.

        An apostrophe may belong to the letters after it, so texts with one are left as they are.
        """
        whole = pa.array(texts, pa.large_string())
        cut = pc.replace_substring_regex(whole, r"([\pL\pN])([^\pL\pN\s])", rf"\1{mark}\2")
        cut = pc.replace_substring_regex(cut, r"([^\pL\pN\s])([\pL\pN])", rf"\1{mark}\2")
        return pc.if_else(pc.match_substring(whole, "'"), whole, cut)

    def _runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Places of the runs of plain texts, and how many runs each text has."""
        if self.spaced:  # a run begins at each space, and a line end is one; wider white space goes through the pattern
            wide = [i for i, t in enumerate(texts) if any(s in t for s in _WIDE_SPACE)]
            cut = [t.replace(" ", "\0 ").replace("\n", "\0\n\0") for t in texts]
            for i in wide:
                cut[i] = "\0".join(_SPACED.findall(texts[i]))
            lists = pc.split_pattern(self._parted(cut, "\0"), "\0")
        else:
            lists = pc.ascii_split_whitespace(self._parted(texts, " "))
        coded = lists.flatten().dictionary_encode()
        at = self.places.__getitem__
        known = np.fromiter((at(r) if r else -1 for r in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        return known[coded.indices.to_numpy()], pc.list_value_length(lists).to_numpy()

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of the texts in order, the end id after each; and how many each text has. None is an empty text."""
        if len(self.first) > self.most:
            self._start_anew()
        if len(self.pieces) > self.most:
            self.pieces = {}
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        plain = [self.by_runs and (not t or _UNUSUAL.search(t) is None and not any(s in t for s in self.specials)) for t in texts]
        runs, n_runs = self._runs([t or "" for t, p in zip(texts, plain) if p]) if any(plain) else (np.empty(0, np.int64), np.empty(0, np.int64))
        self._learn()
        count = np.zeros(len(texts), np.int64)
        count[np.array(plain, bool)] = n_runs
        others = [i for i, p in enumerate(plain) if not p]
        count[others] = 1
        upto = np.concatenate([[0], np.cumsum(count + 1)])  # a text's runs and the end id
        places = np.zeros(upto[-1], np.int64)
        if others:
            first = len(self.first)
            self._add(self.tokenizer.encode(texts[i], add_special_tokens=False).ids for i in others)
            places[upto[others]] = first + np.arange(len(others))
        mine = np.ones(upto[-1], bool)
        mine[upto[1:] - 1] = False
        mine[upto[others]] = False
        places[mine] = runs
        lengths = np.where(places < 0, 0, np.frombuffer(self.length, np.int64)[places])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        where = np.arange(ends[-1]) + np.repeat(np.frombuffer(self.first, np.int64)[places] - ends[:-1], lengths)
        return np.frombuffer(self.ids, np.uint32)[where], np.diff(ends[upto])


_KEPT: dict[tuple, Encoder] = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for each tokenizer in a worker process."""
    k = (path, end_id)
    if k not in _KEPT:
        _KEPT[k] = Encoder(*k)
    return _KEPT[k]


def forget() -> None:
    """Give back the encoders' memory: for operators that run in the same workers after a tokenizer's."""
    _KEPT.clear()
