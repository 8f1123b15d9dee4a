"""Byte-level pre-tokens: the pieces of a text that are encoded independently of each other.

A byte-level vocabulary splits a text by a fixed pattern and merges bytes only inside a
piece, so whatever is wanted of a text (its token count, its ids) is joined from its
pieces. Pieces repeat, and so do whole words with their punctuation, so both are looked
up in tables of the worker before anything is encoded.
"""

from __future__ import annotations

import json
import os
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable
from itertools import chain, islice

# The splitting pattern of byte-level vocabularies, its general form and the same for ASCII texts.
# White space is spelled out, since libraries differ on the separators 0x1C to 0x1F.
WIDE_SPACE = "\x85\xa0  -     　"
SPACE = rf"\t-\r {WIDE_SPACE}"
GENERAL = (
    rf"'(?:s|t|re|ve|m|ll|d)| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+"
    rf"|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
ASCII = (
    r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+"
    r"|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
)

#: Pieces and words that a worker keeps; once full, what else turns up is encoded each time, and so are longer ones.
PIECES = 1_000_000
WORDS = 400_000
LONGEST = 48


def load_tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark gives a task one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def plainly_spaced(text: str, wide: Callable) -> bool:
    """Every space stands alone between two characters that are not white space, and no other blanks but newlines."""
    return not (
        text[:1] in ("", " ") or text[-1] == " " or "  " in text or " \n" in text or "\n " in text
        or "\t" in text or "\r" in text or "\v" in text or "\f" in text
        or (not text.isascii() and wide(text))
    )


class PretokenTable:
    """Joined values of whole texts. ``value(ids)`` is kept for a piece, ``join(values)`` for a word.

    A space between two other characters always starts a piece, so a plainly spaced
    text can be looked up word by word. Frequent pieces never leave the table.
    """

    def __init__(self, path: str, value: Callable[[list[int]], object], join: Callable, frequent: dict | None = None):
        import regex

        self.tokenizer = load_tokenizer(path)
        self.value, self.join = value, join
        self.frequent = frequent or {}
        self.pieces: dict = dict(self.frequent)
        self.words: dict = {}
        self.general = regex.compile(GENERAL).findall
        self.ascii = re.compile(ASCII).findall
        self.wide = re.compile(f"[{WIDE_SPACE}]").search
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.special = {t["content"]: value([t["id"]]) for t in added}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def split(self, text: str) -> list[str]:
        """Pieces of a text without special strings."""
        return self.ascii(text) if text.isascii() else self.general(text)

    def encode(self, missing: Iterable[str], into: dict) -> None:
        """Values of pieces that the table does not hold."""
        todo = list(missing)
        for start in range(0, len(todo), 4096):
            part = todo[start : start + 4096]
            for p, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                into[p] = self.value(e.ids)

    def of_pieces(self, pieces: list[str]) -> list[str]:
        """Encode the pieces that the table does not hold; returns those it should not keep."""
        missing = set(pieces) - self.pieces.keys()
        self.encode(missing, self.pieces)
        if len(self.pieces) > PIECES + len(self.frequent):
            return list(missing)
        return [p for p in missing if len(p) > LONGEST]

    def of_texts(self, texts: list[str]) -> list:
        """Joined value of each text; special strings inside it count as the tokens they name."""
        split: list = []  # words of a plainly spaced text, or None
        heads: list[list[str]] = []  # pieces of the first word, or of the whole text
        special: dict[int, list] = {}
        for i, text in enumerate(texts):
            if self.cut is not None and self.cut.search(text):
                special[i] = self.cut.split(text)
                text = ""
            words = text.split(" ") if plainly_spaced(text, self.wide) else None
            split.append(words)
            heads.append(self.split(words[0] if words else text))
        # first words are left out: one that starts with a newline would run into the blank before it
        todo = list(set(chain.from_iterable(islice(w, 1, None) for w in split if w)) - self.words.keys())
        todo.sort(key=str.isascii)
        pieces: list[str] = []
        wide = bisect_left(todo, True, key=str.isascii)
        for part in (todo[:wide], todo[wide:]):
            if part:  # each word gives one piece that starts with the space before it, and perhaps more
                pieces += self.split(" " + " ".join(part))
        starts = [i for i, p in enumerate(pieces) if p[0] == " "]
        drop = self.of_pieces(pieces + list(chain.from_iterable(heads)))
        get, join = self.pieces.__getitem__, self.join
        values = list(map(get, pieces))
        self.words.update(
            (w, values[a] if z - a == 1 else join(values[a:z]))
            for w, a, z in zip(todo, starts, [*starts[1:], len(values)])
        )
        head = [join(map(get, h)) for h in heads]
        for p in drop:
            del self.pieces[p]
        get = self.words.__getitem__
        out = []
        for words, first in zip(split, head):
            if words is None or len(words) == 1:
                out.append(first)
            else:
                rest = iter(words)
                next(rest)
                out.append(join(chain((first,), map(get, rest))))
        for w in todo if len(self.words) > WORDS else [w for w in todo if len(w) > LONGEST]:
            del self.words[w]
        for i, parts in special.items():
            values = iter(self.of_texts([p for p in parts if p not in self.special]))
            out[i] = join([self.special[p] if p in self.special else next(values) for p in parts])
        return out

    def count_pieces(self, texts: Iterable[str]) -> Counter:
        """How often each piece occurs; words of plainly spaced texts are counted first and split once."""
        seen: Counter = Counter()
        words: Counter = Counter()
        for text in texts:
            for part in self.cut.split(text) if self.cut is not None else [text]:
                if part in self.special:
                    continue
                first, *rest = part.split(" ") if plainly_spaced(part, self.wide) else [part]
                seen.update(self.split(first))
                words.update(rest)
        for todo in ([w for w in words if not w.isascii()], [w for w in words if w.isascii()]):
            n = map(words.__getitem__, todo)
            times = 0
            for p in self.split(" " + " ".join(todo)) if todo else ():
                if p[0] == " ":
                    times = next(n)
                seen[p] += times
        return seen


def blocks(texts: Iterable[str], characters: int = 1 << 21):
    """Runs of texts of a bounded total length (one longer text alone)."""
    block: list[str] = []
    size = 0
    for t in texts:
        if block and size + len(t) > characters:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block
