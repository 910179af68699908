"""BPE encoding and decoding in batched numpy merge rounds.

The distinct new words of a block of texts are encoded together: all their symbols lie in one flat array, every adjacent
pair's rank is found by binary search over the sorted pair keys, and each round merges, in every word at once, all
occurrences of that word's lowest-ranked pair. A word of more than ``LONG`` bytes would need a round for almost every rank it
holds, each over its whole length, so it takes its pairs from a queue instead. Words met often keep their result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RARE, blocks, frugal, starts_of_runs

#: Words whose ids a worker keeps, and UTF-8 bytes of these; UTF-8 bytes of text encoded together; bytes of a long word.
KEPT_WORDS, KEPT_BYTES, ENCODE_BYTES, LONG = 200_000, 8 << 20, 4 << 20, 1000


class WordBPE:
    """A vocabulary with word ends from a tokenizers file: NFC, white space to one space, lower case, split, bytes, merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        self.path, self.whole, self.classes, self.merges = path, None, {}, None
        self.end = model["end_of_word_suffix"] or ""
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")")
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.tokens = [""] * size
        for token, i in [*vocab.items(), *self.added.items()]:
            self.tokens[i] = token
        pairs = [(vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(model["merges"])]
        table = np.array(pairs, np.int64)
        key = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.into = key[order], table[order, 2], table[order, 3]
        # Printable bytes stand for themselves in such files, the others follow from 256 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        chars = [chr(b) if b in plain else chr(next(rest)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.final = np.array([vocab[c + self.end] for c in chars], np.int64)

    def words(self, text: str) -> list[str]:
        if RARE.search(text):
            library = self.library()
            text = library.normalizer.normalize_str(text)
            plain = RARE.sub(lambda m: self.like(m[0]), text)
            return [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # Letter by letter, as a final sigma has no form of its own there.
        return self.pattern.findall(text.replace("Σ", "σ").lower())

    def library(self):
        """The file in the tokenizers library, for what Unicode versions may class differently."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole

    def like(self, char: str) -> str:
        """A common character of the class that the file's own splitter gives a rare one."""
        if char not in self.classes:
            pieces = self.library().pre_tokenizer.pre_tokenize_str
            letter, other = len(pieces(f"a{char}")) == 1, len(pieces(f"!{char}")) == 1
            self.classes[char] = " " if not pieces(char) else "a" if letter else "!" if other else "1"
        return self.classes[char]

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word (none empty)."""
        raw = [w.encode() for w in words]
        short = self._merge_rounds([w for w in raw if len(w) <= LONG])
        by_round = iter(short)
        return [next(by_round) if len(w) <= LONG else self._merge_queue(w) for w in raw]

    def _merge_queue(self, raw: bytes) -> np.ndarray:
        """The ids of one long word: the lowest-ranked pair, and of equal ones the first, leaves a queue until none is left."""
        if self.merges is None:
            self.merges = dict(zip(self.key.tolist(), zip(self.rank.tolist(), self.into.tolist(), strict=True), strict=True))
        merges = self.merges
        joined = np.frombuffer(raw, np.uint8)
        start = self.inner[joined]
        start[-1] = self.final[joined[-1]]
        sym, n = start.tolist(), len(start)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def queued(i: int) -> int | None:
            found = merges.get(sym[i] << 32 | sym[after[i]]) if after[i] < n else None
            return None if found is None else found[0] << 32 | i

        queue = [x for i in range(n - 1) if (x := queued(i)) is not None]
        heapq.heapify(queue)
        while queue:
            top = heapq.heappop(queue)
            i = top & 0xFFFFFFFF
            if sym[i] < 0 or queued(i) != top:
                continue  # one of the two has been merged since
            j = after[i]
            sym[i], sym[j] = merges[sym[i] << 32 | sym[j]][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and (x := queued(k)) is not None:
                    heapq.heappush(queue, x)
        return np.array([x for x in sym if x >= 0], np.int64)

    def _merge_rounds(self, raw: list[bytes]) -> list[np.ndarray]:
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        joined = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(raw)), size)
        sym = self.inner[joined]
        last = np.cumsum(size) - 1
        sym[last] = self.final[joined[last]]
        none = len(self.key)
        rank_of = np.append(self.rank, np.iinfo(np.int64).max)
        into_of = np.append(self.into, -1)

        def look(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            want = left << 32 | right
            at = np.searchsorted(self.key, want)
            return np.where((at < none) & (self.key[np.minimum(at, none - 1)] == want), at, none)

        out: list[np.ndarray | None] = [None] * len(raw)
        while len(sym):
            found = np.full(len(sym), none)
            inside = np.flatnonzero(word[1:] == word[:-1])
            found[inside] = look(sym[inside], sym[inside + 1])
            rank = rank_of[found]
            first = starts_of_runs(word)
            length = np.diff(np.append(first, len(word)))
            low = np.minimum.reduceat(rank, first)
            over = low == rank_of[-1]
            if over.any():  # words without a pair left are done
                for f, n in zip(first[over].tolist(), length[over].tolist(), strict=True):
                    out[word[f]] = sym[f : f + n]
                stay = np.repeat(~over, length)
                sym, word, rank, found = sym[stay], word[stay], rank[stay], found[stay]
                low, length = low[~over], length[~over]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, length))
            # Of hits that follow each other, as in a run of one letter, every second one merges.
            run = np.flatnonzero(np.concatenate([[True], hit[1:] != hit[:-1] + 1]))
            place = np.arange(len(hit)) - np.repeat(run, np.diff(np.append(run, len(hit))))
            hit = hit[place % 2 == 0]
            sym[hit] = into_of[found[hit]]
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            sym, word = sym[keep], word[keep]
        return out


class Coder:
    """Ids and decoded strings of texts, with the results of frequent words kept."""

    def __init__(self, path: str):
        self.bpe = WordBPE(path)
        self.kept: dict[str, tuple[int, str, str]] = {}
        self.kept_bytes = 0

    def learn(self, words: list[str]) -> None:
        new = [w for w in dict.fromkeys(words) if w not in self.kept]
        if not new:
            return
        tokens = self.bpe.tokens
        for w, ids in zip(new, self.bpe.merge(new), strict=True):
            own = ids.tolist()
            self.kept[w] = (len(own), " ".join(map(str, own)), " ".join([tokens[i] for i in own]))
            self.kept_bytes += len(w)

    def encode(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text: the number of ids, the ids and their decoded string, both joined by one space."""
        b = self.bpe
        parts = [[p for p in b.split_added.split(t) if p] if "<" in t else [t] for t in texts]
        found = [[p if p in b.added else b.words(p) for p in own] for own in parts]
        if len(self.kept) > KEPT_WORDS or self.kept_bytes > KEPT_BYTES:
            self.kept.clear()
            self.kept_bytes = 0
        self.learn([w for own in found for ws in own if not isinstance(ws, str) for w in ws])
        out, kept = [], self.kept
        for own in found:
            got = []
            for ws in own:
                if isinstance(ws, str):
                    got.append((1, str(b.added[ws]), ws))
                else:
                    got += map(kept.__getitem__, ws)
            n, ids, text = zip(*got, strict=True) if got else ((), (), ())
            out.append((sum(n), " ".join(ids), " ".join(text)))
        return out


_CODERS: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>, decoded string) of every row; a null text counts as empty and has no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text", ENCODE_BYTES):
            got = coder(path).encode([(t or b"").decode() for t in texts])
            ids = [list(map(int, x[1].split())) for x in got]
            yield pa.record_batch({"doc_id": part.column(0).cast(pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array([x[2] for x in got], pa.string())})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row.

    A null text counts as empty: no ids and the digests of the empty string. Strings of added tokens in a text are those
    tokens. Decoding has no decoder in the file, so tokens are joined by one space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in blocks(batches, "text", ENCODE_BYTES):
            got = coder(path).encode([(t or b"").decode() for t in texts])
            sha = [[hashlib.sha256(x[k].encode()).hexdigest() for x in got] for k in (1, 2)]
            yield pa.record_batch({"doc_id": part.column(0).cast(pa.int64()), "n_tokens": pa.array([x[0] for x in got], pa.int64()), "ids_sha256": pa.array(sha[0]), "decoded_sha256": pa.array(sha[1])})

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(run), schema)
