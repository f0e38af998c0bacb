"""Encoding by a `tokenizers` file in batches, with repeated segments encoded once.

A text may be cut where no token can span and no rule looks across: before a
space that follows a non-blank character (byte-level vocabularies), or at any
ASCII blank (vocabularies that drop white space).  Texts are cut there, the
distinct segments are encoded in batches, and what the library gives for a
segment is kept in a store of bounded size.  A text in which a cut might not be
safe goes to the library as it is.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np

#: Characters that some rule may take for white space.
ANY_BLANK = r"\s\x1c-\x1f\x85᠎"
BLANK_BEFORE_SPACE = re.compile(f"[{ANY_BLANK}] ")
OTHER_BLANK = re.compile(f"[{ANY_BLANK}]")
SAFE_SPACE = re.compile(f"(?<=[^{ANY_BLANK}]) ")
ASCII_BLANK = re.compile(r"[ \t\n\x0b\x0c\r]")
CAPITAL_WITH_MARK = re.compile("[A-Z][̀-ͯ]")
STOPS = ".,;:!?"

#: Texts handled at once and the longest piece given to the library, in characters.
BATCH_CHARS = 1 << 20
PIECE_CHARS = 1 << 16


class Store:
    """Values by key in two generations: recent ones stay, the size is bounded."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def fill(self, keys: set, make: Callable[[list], dict]) -> dict:
        """A mapping that holds all of `keys`; `make` gives the values not yet known."""
        if len(self.young) + len(keys) > self.size:
            self.young, self.old = {}, self.young
        missing = []
        for key in keys.difference(self.young):
            value = self.old.get(key)
            if value is None:
                missing.append(key)
            else:
                self.young[key] = value
        if missing:
            self.young.update(make(missing))
        return self.young


class Segmented:
    """Token ids (little-endian unsigned 32-bit bytes) or token counts of whole texts."""

    def __init__(self, path: str, counts_only: bool, store_size: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.counts_only = counts_only
        self.none = 0 if counts_only else b""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = spec.get("added_tokens") or []
        self.specials = [t["content"] for t in added]
        before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        steps = [s.get("type") for s in before.get("pretokenizers", [])]
        plain = all(not t["lstrip"] and not t["rstrip"] and not OTHER_BLANK.search(t["content"]) for t in added)
        byte_level = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        splits = [s for s in before.get("pretokenizers", []) if s.get("type") == "Split"]
        norms = [s.get("type") for s in (norm or {}).get("normalizers", [])]
        if plain and norm is None and byte_level:
            self.cut, mark = "space", "Ġ"
        elif (plain and norms == ["NFC", "Replace", "Lowercase"] and steps == ["Split", "ByteLevel"]
              and splits[0].get("invert") and splits[0].get("behavior") == "Removed"):
            self.cut, mark = "blank", "</w>"
        else:
            self.cut, mark = "none", ""
        vocabulary = self.library.get_vocab()
        self.marked = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, number in vocabulary.items():
            if mark and (token.startswith(mark) if self.cut == "space" else token.endswith(mark)):
                self.marked[number] = True
        # Segments after a space, segments that start a text, and words between blanks.
        self.after, self.first = Store(store_size), Store(store_size // 8)

    # --- the library ---------------------------------------------------------

    def _value(self, ids) -> int | bytes:
        return len(ids) if self.counts_only else np.asarray(ids, "<u4").tobytes()

    def _library(self, texts: list[str]) -> list:
        return [self._value(e.ids) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(self, text: str):
        """One text by the library, in pieces cut at safe boundaries if it is long."""
        total, pieces = self.none, []
        for piece in self.pieces(text):
            pieces.append(piece)
            if len(pieces) == 16:
                total, pieces = sum(self._library(pieces), total) if self.counts_only else total + b"".join(self._library(pieces)), []
        rest = self._library(pieces) if pieces else []
        return sum(rest, total) if self.counts_only else total + b"".join(rest)

    def pieces(self, text: str) -> Iterator[str]:
        start, pattern = 0, {"space": SAFE_SPACE, "blank": ASCII_BLANK}.get(self.cut)
        while pattern and len(text) - start > PIECE_CHARS:
            found = pattern.search(text, start + PIECE_CHARS)
            if not found:
                break
            yield text[start:found.start()]
            start = found.start()
        yield text[start:]

    # --- segments ------------------------------------------------------------

    def _letters(self, words: list[str]) -> dict:
        """Words of letters only, many at a time: the marks of their tokens tell them apart."""
        out = {}
        for at in range(0, len(words), 512):
            some = words[at:at + 512]
            ids = np.asarray(self.library.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            marks = np.flatnonzero(self.marked[ids])
            if len(marks) != len(some):
                values = self._library([" " + w for w in some])
            else:
                cuts = (marks if self.cut == "space" else marks + 1).tolist()
                cuts = [*cuts, len(ids)] if self.cut == "space" else [0, *cuts]
                values = ([b - a for a, b in zip(cuts, cuts[1:])] if self.counts_only else
                          [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])])
            out.update(zip(some, values))
        return out

    def _stops(self, keys: list[str]) -> tuple[dict, list[str]]:
        """Keys that are a word and closing stops, by the core; and the other keys."""
        split, rest = {}, []
        for key in keys:
            core = key.rstrip(STOPS)
            if core != key and core and core[-1].lower().isalpha() and not OTHER_BLANK.search(core):
                split[key] = core
            else:
                rest.append(key)
        return split, rest

    def _make(self, keys: list[str], lead: str) -> dict:
        split, rest = self._stops(keys)
        cores = set(split.values()).difference(rest)
        letters, others = [], []
        for key in [*rest, *cores]:
            (letters if key.isalpha() and (lead or self.cut == "blank") else others).append(key)
        known = self._letters(letters)
        for at in range(0, len(others), 512):
            some = others[at:at + 512]
            known.update(zip(some, self._library([lead + w for w in some])))
        tails = sorted({key[len(core):] for key, core in split.items()})
        ends = dict(zip(tails, self._library(tails)))
        known.update({key: known[core] + ends[key[len(core):]] for key, core in split.items()})
        return known

    def _between_blanks(self, texts: list[str]) -> list:
        words = [(t.encode() if CAPITAL_WITH_MARK.search(t) else t.encode().lower()).split() for t in texts]
        known = self.after.fill(set().union(*words), lambda keys: {
            k.encode(): v for k, v in self._make([k.decode() for k in keys], "").items()})
        if self.counts_only:
            return [sum(map(known.__getitem__, w)) for w in words]
        return [b"".join(map(known.__getitem__, w)) for w in words]

    def _after_spaces(self, texts: list[str]) -> list:
        words = [t.split(" ") for t in texts]
        heads = [w[0] for w in words]
        first = self.first.fill(set(heads), lambda keys: self._make(keys, ""))
        heads = [first[h] for h in heads]
        rest = [w[1:] for w in words]
        known = self.after.fill(set().union(*rest), lambda keys: self._make(keys, " "))
        if self.counts_only:
            return [h + sum(map(known.__getitem__, w)) for h, w in zip(heads, rest)]
        return [h + b"".join(map(known.__getitem__, w)) for h, w in zip(heads, rest)]

    def encode(self, texts: list[str | None]) -> list:
        """The value of each text, null as empty; works through batches of bounded size."""
        out = [self.none] * len(texts)
        batch, size = [], 0
        for index, text in enumerate(texts):
            if not text:
                continue
            special = any(s in text for s in self.specials)
            if self.cut == "none" or special or (self.cut == "space" and BLANK_BEFORE_SPACE.search(text)):
                out[index] = self.whole(text)
                continue
            batch.append(index)
            size += len(text)
            if size >= BATCH_CHARS:
                self._batch(texts, batch, out)
                batch, size = [], 0
        self._batch(texts, batch, out)
        return out

    def _batch(self, texts: list, batch: list[int], out: list) -> None:
        if batch:
            some = [texts[i] for i in batch]
            values = self._after_spaces(some) if self.cut == "space" else self._between_blanks(some)
            for index, value in zip(batch, values):
                out[index] = value


@lru_cache(maxsize=2)
def segmented(path: str, counts_only: bool, store_size: int = 400_000) -> Segmented:
    """One per worker process, so that the store lasts over batches and tasks."""
    return Segmented(path, counts_only, store_size)
