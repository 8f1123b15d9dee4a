"""Exact merge-type encoding with a SentencePiece vocabulary, by backtracking, and decoding.

A sequence of tokens is the one that merging gives if and only if every two adjacent
tokens are compatible: merging their joined characters anew gives exactly these two.
So a text is encoded from the left with the longest token that fits (found by an
Aho-Corasick automaton); where no compatible token is left, the last one is taken back
for its next shorter one. A bit field of positions from which no encoding was found
keeps the search from running into them twice.

Characters that no piece of the vocabulary joins never end up in one token. Texts are
cut there first, so words repeat and a worker encodes each only once.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts, vocabulary, whole_texts, worker_table
from .pretokens import blocks

SPACE = "▁"
#: Chunks a worker keeps; once full, others are encoded each time they turn up. So are longer ones.
CHUNKS = 600_000
LONGEST = 48


class PieceModel:
    """Vocabulary of a merge-type model with byte fallback and no normalisation."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.text = [model.id_to_piece(i) for i in range(size)]
        self.plain = [t.replace(SPACE, " ") for t in self.text]
        byte = {i: int(self.text[i][3:5], 16) for i in range(size) if model.is_byte(i)}
        if len(byte) != 256:
            raise ValueError("a vocabulary with byte fallback is needed")
        self.byte_of = byte
        self.byte_id = {b: i for i, b in byte.items()}
        usable = [
            i for i in range(size)
            if i not in byte and not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
        ]
        self.id = {self.text[i]: i for i in usable}
        self.score = {self.text[i]: model.get_score(i) for i in usable}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("pieces that join two words are not supported")
        self.automaton = ahocorasick.Automaton()
        for piece in self.id:
            if len(piece) > 1 and piece.strip(SPACE):
                self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        self._compatible: dict[tuple[str, str], bool] = {}
        self._runs: dict[int, list[str]] = {}
        self.chunks = re.compile(self._pattern())

    def _pattern(self) -> str:
        """Chunks: blanks and what follows them, cut between characters that no piece joins."""
        group: dict[str, str] = {}

        def top(c: str) -> str:
            while group[c] != c:
                group[c] = group[group[c]]
                c = group[c]
            return c

        for piece in self.id:
            letters = piece.lstrip(SPACE)
            for c in letters:
                group.setdefault(c, c)
            for a, b in zip(letters, letters[1:]):
                group[top(a)] = top(b)
        classes: dict[str, list[str]] = {}
        for c in group:
            classes.setdefault(top(c), []).append(c)
        joined = sorted((cs for cs in classes.values() if len(cs) > 1), key=len, reverse=True)
        sets = [f" *[{re.escape(''.join(sorted(cs)))}]+" for cs in joined]
        return "|".join([*sets, " *[^ ]", " +"])

    def merge(self, text: str) -> list[str]:
        """Merge adjacent symbols, best score first and leftmost among equals, until none is left to merge."""
        part = list(text)
        if len(part) <= 16:  # a scan is quicker than a heap
            score = self.score.get
            while len(part) > 1:
                best, at = None, 0
                for i, joined in enumerate(map(str.__add__, part, part[1:])):
                    found = score(joined)
                    if found is not None and (best is None or found > best):
                        best, at = found, i
                if best is None:
                    break
                part[at : at + 2] = [part[at] + part[at + 1]]
            return part
        after = list(range(1, len(part) + 1))
        before = list(range(-1, len(part) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < len(part):
                joined = part[i] + part[after[i]]
                score = self.score.get(joined)
                if score is not None:
                    heapq.heappush(heap, (-score, i, joined))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, joined = heapq.heappop(heap)
            if not part[i] or after[i] >= len(part) or part[i] + part[after[i]] != joined:
                continue
            gone = after[i]
            part[i], part[gone] = joined, ""
            after[i] = after[gone]
            if after[i] < len(part):
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p]

    def compatible(self, left: str, right: str) -> bool:
        found = self._compatible.get((left, right))
        if found is None:
            if len(self._compatible) > CHUNKS:
                self._compatible.clear()
            found = self._compatible[left, right] = self.merge(left + right) == [left, right]
        return found

    def blanks(self, n: int) -> list[str]:
        """A run of blanks; their pieces share scores, so they are merged outright."""
        if n not in self._runs:
            if n > 1000:
                return self.merge(SPACE * n)
            self._runs[n] = self.merge(SPACE * n)
        return self._runs[n]

    def backtrack(self, text: str) -> list[str]:
        """Tokens of a text with at most one leading blank; single characters stand for themselves."""
        n = len(text)
        fits: list[list[str]] = [[c] for c in text]
        for end, piece in self.automaton.iter(text):  # by their ends, so each start gets them from short to long
            fits[end + 1 - len(piece)].append(piece)
        seen = self._compatible
        dead = 0  # bit field of positions without an encoding of the rest
        tokens: list[str] = []
        left: list[int] = []  # untried shorter candidates of each token
        at, tries = 0, len(fits[0]) if n else 0
        while at < n:
            while tries:
                tries -= 1
                piece = fits[at][tries]
                end = at + len(piece)
                if dead and dead >> end & 1:
                    continue
                if not tokens or seen.get((tokens[-1], piece)) or self.compatible(tokens[-1], piece):
                    tokens.append(piece)
                    left.append(tries)
                    at = end
                    tries = len(fits[at]) if at < n else 0
                    break
            else:
                if not tokens:
                    return self.merge(text)
                # the tokens before are the only compatible ones for these characters, so no other way leads on from here
                dead |= 1 << at
                at -= len(tokens.pop())
                tries = left.pop()
        return tokens

    def encode_chunk(self, chunk: str) -> list[int]:
        word = chunk.lstrip(" ")
        gap = len(chunk) - len(word)
        tokens: list[str] = []
        if word:
            tokens = self.backtrack((SPACE if gap else "") + word)
            if gap and tokens[0] == SPACE:
                tokens, gap = tokens[1:], gap + 1
            gap -= bool(gap)
        tokens = self.blanks(gap) + tokens if gap else tokens
        out = list(map(self.id.get, tokens))
        if None in out:
            out = []
            for t in tokens:
                i = self.id.get(t)
                out += (i,) if i is not None else (self.byte_id[b] for b in t.encode())
        return out

    def split(self, text: str) -> list[str]:
        """Chunks of a whole text with the blank that stands before every text."""
        return self.chunks.findall(" " + text.replace(SPACE, " ")) if text else []

    def decode(self, ids: list[int]) -> str:
        """Text of some ids, blanks kept; bytes that are no valid character become U+FFFD each."""
        if self.byte_of.keys().isdisjoint(ids):
            return "".join(map(self.plain.__getitem__, ids))
        out: list[str] = []
        held = bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held = bytearray()
            if i is not None:
                out.append(self.plain[i])
        return "".join(out)


class ChunkTable:
    """Chunk -> its ids as text, and its decoded text where that is another, kept by a worker from task to task."""

    def __init__(self, path: str):
        self.model = PieceModel(path)
        self.ids: dict[str, str] = {}
        self.texts: dict[str, str] = {}

    def of_texts(self, texts: list[str]) -> list[tuple[str, str]]:
        """(decimal ids joined by commas, decoded text) of each text."""
        lists = [self.model.split(t) for t in texts]
        todo = list(set(chain.from_iterable(lists)) - self.ids.keys())
        for chunk in todo:
            ids = self.model.encode_chunk(chunk)
            self.ids[chunk] = ",".join(map(str, ids))
            text = self.model.decode(ids)
            if text != chunk:
                self.texts[chunk] = text
        one, two = self.ids.__getitem__, self.texts.get
        out = [(",".join(map(one, chunks)), "".join(map(two, chunks, chunks) if self.texts else chunks)[1:]) for chunks in lists]
        for chunk in todo if len(self.ids) > CHUNKS else [c for c in todo if len(c) > LONGEST]:
            del self.ids[chunk]
            self.texts.pop(chunk, None)
        return out


def chunk_table(model: str) -> ChunkTable:
    return worker_table(("chunks", model), lambda: ChunkTable(vocabulary(model)))


def _mapped(df: DataFrame, schema: str, each: Callable[[str, str], tuple], model: str, text: str) -> DataFrame:
    def make():
        table = chunk_table(model)

        def work(batch: list[str]) -> list:
            rows = [each(ids, back) for block in blocks(batch) for ids, back in table.of_texts(block)]
            return [list(c) for c in zip(*rows)] if rows else [[] for _ in schema.split(",")]

        return work

    return map_texts(df, make, schema, text)


def encode_texts(
    df: DataFrame, model: str = "piece_bpe_32k.model", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, ids, decoded) of every whole text: its ids without begin or end, and the text they decode to.

    A null or empty text has no ids and decodes to an empty text. Keys pass through
    whatever they are; other columns are ignored; an empty table gives an empty result.
    """
    def each(ids: str, back: str) -> tuple:
        return np.array(ids.split(",") if ids else [], np.int32), back

    return _mapped(whole_texts(df, key, text), "ids array<int>, decoded string", each, model, text)


def encoding_digests(
    df: DataFrame, model: str = "piece_bpe_32k.model", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): digests of what ``encode_texts`` returns, for the same inputs."""
    def each(ids: str, back: str) -> tuple:
        return (
            ids.count(",") + 1 if ids else 0,
            hashlib.sha256(ids.encode()).hexdigest(),
            hashlib.sha256(back.encode()).hexdigest(),
        )

    return _mapped(
        whole_texts(df, key, text), "n_tokens long, ids_sha256 string, decoded_sha256 string", each, model, text
    )


def decode_ids(df: DataFrame, model: str = "piece_bpe_32k.model", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """The table with a column of the text that an array of ids stands for; null ids give null.

    Ids outside the vocabulary are an error.
    """
    def run(batches):
        import pyarrow as pa

        model_ = chunk_table(model).model
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            texts = pa.array([None if x is None else model_.decode(x)[1:] for x in lists], pa.string())
            yield batch.append_column(out, texts)

    return df.drop(out).mapInArrow(
        run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.drop(out).schema), f"`{out}` string"])
    )
