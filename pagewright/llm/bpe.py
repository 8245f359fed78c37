"""Byte-level BPE with a pair occurrence index.

Texts are cut into words by the vocabulary's pattern. The words that a run of texts of a part of the table has for the
first time stand, each once, in one array of symbols, linked both ways. An index maps each mergeable pair to all its positions. Active ranks are applied in ascending
order, each at all its positions at once; a merge changes its neighbours, whose new pairs go to the lists of their ranks.
A rank's new pairs always rank higher, so one ascending pass ends with no pair left.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.workspace import ship

#: The pattern that the byte-level vocabulary was made with.
PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts of ASCII and the letters of Latin-1, where the standard library's classes agree and are faster.
PLAIN_PATTERN = r"'(?:s|t|re|ve|m|ll|d)| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9À-ÖØ-öø-ÿ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
BEYOND_PLAIN = r"[^\x00-\x1b\x20-\x7fÀ-ÖØ-öø-ÿ]"

#: Before the name of an added token; no pattern makes such a word.
ADDED = "\0added\0"

_full, _plain, _beyond = regex.compile(PATTERN), re.compile(PLAIN_PATTERN), re.compile(BEYOND_PLAIN)


def words_of(text: str) -> list[str]:
    """The words of a text; together they are the text."""
    return _full.findall(text) if _beyond.search(text) else _plain.findall(text)


def byte_symbols() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself if it is one, else one from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def bytes_of(texts: pa.StringArray | pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all entries, where each begins in them, with the end as the last) of a column without nulls."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


class Vocabulary:
    """Of a tokenizer.json with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, to_byte = spec["model"], byte_symbols()
        ids = model["vocab"]
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.size = max([*ids.values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in ids.items():
            self.bytes_of[i] = bytes(to_byte[c] for c in token) if all(c in to_byte for c in token) else token.encode()
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.symbol = np.zeros(256, dtype=np.int64)
        for c, b in to_byte.items():
            self.symbol[b] = ids[c]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        self.right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], dtype=np.int64)
        key = self.left * self.size + self.right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.blob = np.frombuffer(b"".join(self.bytes_of), dtype=np.uint8)
        self.width = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.begin = np.cumsum(self.width) - self.width

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs (a, b); -1 where they don't merge."""
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], -1)

    def encode_words(self, words: pa.BinaryArray | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, number of ids of each word), by the pair occurrence index."""
        if not isinstance(words, pa.Array):
            words = pa.array(words, pa.binary())
        data, starts = bytes_of(words)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        size, sym = np.diff(starts), self.symbol[data]
        n = len(sym)
        word = np.repeat(np.arange(len(words)), size)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = np.append(word[1:] != word[:-1], True) if n else np.zeros(0, bool)
        nxt[last] = -1
        first = np.append(True, last[:-1]) if n else last
        prv[first] = -1
        alive = np.ones(n, dtype=bool)

        # index: rank -> lists of positions of the pair's left symbol
        at = np.flatnonzero(~last)
        r = self.rank(sym[at], sym[at + 1])
        at, r = at[r >= 0], r[r >= 0]
        order = np.argsort(r, kind="stable")
        at, r = at[order], r[order]
        index: dict[int, list[np.ndarray]] = {}
        if len(r):
            cut = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
            index = {int(r[i]): [at[i:j]] for i, j in zip(cut, np.append(cut[1:], len(r)), strict=True)}
        active = list(index)
        heapq.heapify(active)

        while active:
            k = heapq.heappop(active)
            lists = index.pop(k)
            pos = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b, c = self.left[k], self.right[k], self.made[k]
            right = nxt[pos]
            pos = pos[alive[pos] & (sym[pos] == a) & (right >= 0) & (sym[right] == b)]
            if not len(pos):
                continue
            pos = np.unique(pos)
            if a == b:  # of overlapping pairs the leftmost goes first
                linked = np.append(False, nxt[pos[:-1]] == pos[1:])
                start = np.maximum.accumulate(np.where(linked, 0, np.arange(len(pos))))
                pos = pos[(np.arange(len(pos)) - start) % 2 == 0]
            right = nxt[pos]
            after = nxt[right]
            sym[pos] = c
            alive[right] = False
            nxt[pos] = after
            prv[after[after >= 0]] = pos[after >= 0]
            before = prv[pos]
            new = np.concatenate([before[before >= 0], pos[after >= 0]])
            ranks = self.rank(sym[new], sym[nxt[new]])
            new, ranks = new[ranks >= 0], ranks[ranks >= 0]
            if len(new) == 1:
                groups = [(int(ranks[0]), new)]
            elif len(new):
                order = np.argsort(ranks, kind="stable")
                new, ranks = new[order], ranks[order]
                cut = np.flatnonzero(np.append(True, ranks[1:] != ranks[:-1]))
                groups = [(int(ranks[i]), new[i:j]) for i, j in zip(cut, np.append(cut[1:], len(ranks)), strict=True)]
            else:
                groups = []
            for rank, places in groups:
                if rank in index:
                    index[rank].append(places)
                else:
                    index[rank] = [places]
                    heapq.heappush(active, rank)
        return sym[alive], np.bincount(word[alive], minlength=len(words))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for."""
        w = self.width[ids]
        ends = np.cumsum(w)
        if not len(ids):
            return b""
        at = np.arange(ends[-1]) + np.repeat(self.begin[ids] - (ends - w), w)
        return self.blob[at].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", errors="replace")


#: Classes of bytes for :func:`plain_words`: letter, digit, other, white space. In plain texts bytes from 0x80 on are letters'.
_CLASS = np.full(256, 2, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
_CLASS[48:58], _CLASS[[*range(9, 14), 32]] = 1, 3


def plain(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether each text (UTF-8 bytes from ``starts[i]`` to ``starts[i + 1]``) is one that ``PLAIN_PATTERN`` serves."""
    follows = np.append(False, data[:-1] == 0xC3)
    bad = (data >= 0xC4) | (data == 0xC2) | ((data >= 0x1C) & (data <= 0x1F)) | (follows & ((data == 0x97) | (data == 0xB7)))
    upto = np.append(0, np.cumsum(bad))
    return upto[starts[1:]] == upto[starts[:-1]]


def plain_words(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where words begin in plain texts that follow one another, with the end of all as the last entry.

    The same words as ``PLAIN_PATTERN`` finds: runs of one class of bytes, of which those that aren't white space take a
    space before them along; the last of several white spaces before a word stands alone if it isn't a space; the short
    endings after an apostrophe are words of their own.
    """
    n = len(data)
    if not n:
        return np.zeros(1, np.int64)
    kind = _CLASS[data]
    cut = np.append(True, kind[1:] != kind[:-1])
    first = np.zeros(n + 1, dtype=bool)  # of a text
    first[starts] = True
    cut |= first[:n]
    run = np.flatnonzero(cut)
    end = np.append(run[1:], n)
    what, last = kind[run], data[end - 1]
    ends_text = first[end] | (end == n)
    space = what == 3
    gives = space & ~ends_text & (last == 32)  # its last space goes with the word after it
    took = np.append(False, gives[:-1])
    begins = np.zeros(n + 1, dtype=bool)
    begins[run[~space & ~took]] = True
    begins[run[took] - 1] = True
    begins[run[space & ~(gives & (end - run == 1))]] = True
    begins[end[space & ~ends_text & ~gives] - 1] = True
    # apostrophes that stand alone, no space before them, and a run of letters after them
    after = np.append(what[1:], 3)
    mark = np.flatnonzero((what == 2) & (end - run == 1) & (data[run] == 39) & ~took & (after == 0) & ~ends_text)
    if len(mark):
        at = run[mark + 1]
        left = end[mark + 1] - at
        one, two = data[at], data[np.minimum(at + 1, n - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = (left > 1) & ((((one == 114) | (one == 118)) & (two == 101)) | ((one == 108) & (two == 108)))
        width = np.where(short, 1, np.where(long, 2, 0))
        at, left, width = at[width > 0], left[width > 0], width[width > 0]
        begins[at] = False
        begins[(at + width)[left > width]] = True
    begins[n] = True
    return np.flatnonzero(begins)


class Encoder:
    """Encodes texts word by word; remembers the ids of the words that it has met, up to ``remember`` of them and
    ``remember_bytes`` of their bytes. Words stay in Arrow arrays, no word is an object of its own."""

    def __init__(self, vocabulary: Vocabulary, remember: int = 1_000_000, encode_words=None, remember_bytes: int = 32 << 20):
        self.vocabulary, self.remember, self.remember_bytes = vocabulary, remember, remember_bytes
        self.encode_words = encode_words or vocabulary.encode_words
        self.added = {(ADDED + name).encode(): i for name, i in vocabulary.added.items()}
        self.forget()

    def forget(self) -> None:
        self.known = pa.array([], pa.binary())
        self.ids, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def batch(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text); null texts have none."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        if len(self.known) > self.remember or self.known.nbytes > self.remember_bytes:
            self.forget()
        data, starts = bytes_of(texts)
        easy = plain(data, starts)
        if self.added and (data == 60).any():
            easy &= ~pc.match_substring_regex(texts, "|".join(map(re.escape, self.vocabulary.added))).to_numpy(zero_copy_only=False)
        if easy.all():
            at, words = self._plain(data, starts)
        else:
            own, bounds = self._plain(*bytes_of(texts.filter(pa.array(easy))))
            parts, k = [], 0
            for text, e in zip(texts.to_pylist(), easy.tolist(), strict=True):
                if e:
                    parts.append(own[bounds[k] : bounds[k + 1]])
                    k += 1
                else:
                    parts.append(self._numbers(pa.array([w.encode() for w in self._words(text)], pa.binary())))
            words = np.append(0, np.cumsum([len(x) for x in parts]))
            at = np.concatenate(parts)
        count = self.count[at]
        upto = np.append(0, np.cumsum(count, dtype=np.int64))
        ids = self.ids[np.arange(upto[-1]) + np.repeat(self.start[at] - upto[:-1], count)]
        return ids, np.diff(upto[words])

    def _plain(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all words, where each text's begin in them, with the end as the last) of plain texts."""
        cut = plain_words(data, starts)
        words = pa.BinaryArray.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(data)])
        return self._numbers(words), np.searchsorted(cut, starts)

    def _words(self, text: str) -> list[str]:
        if not (self.vocabulary.splitter and "<" in text and self.vocabulary.splitter.search(text)):
            return words_of(text)
        words: list[str] = []
        for piece in self.vocabulary.splitter.split(text):
            if piece in self.vocabulary.added:
                words.append(ADDED + piece)
            else:
                words += words_of(piece)
        return words

    def _numbers(self, words: pa.BinaryArray) -> np.ndarray:
        """The number of each word; words that are new are encoded and remembered."""
        coded = words.dictionary_encode()
        number = pc.index_in(coded.dictionary, value_set=self.known)
        if number.null_count:
            new = coded.dictionary.filter(number.is_null())
            found = np.arange(len(self.known), len(self.known) + len(new), dtype=np.int32)
            self._learn(new)
            number = pc.replace_with_mask(number, number.is_null(), pa.array(found))
        return number.to_numpy()[coded.indices.to_numpy()]

    def _learn(self, new: pa.BinaryArray) -> None:
        fixed = np.array([self.added.get(w, -1) for w in new.to_pylist()]) if len(new) and self.added and pc.any(pc.starts_with(new, ADDED)).as_py() else np.full(len(new), -1)
        plain = fixed < 0
        ids, own = self.encode_words(new if plain.all() else new.filter(pa.array(plain)))
        if not plain.all():
            count = np.ones(len(new), np.int64)
            count[plain] = own
            all_ids = np.empty(count.sum(), np.int64)
            all_ids[(np.cumsum(count) - count)[~plain]] = fixed[~plain]
            all_ids[np.repeat(plain, count)] = ids
            ids, own = all_ids, count
        self.known = pa.concat_arrays([self.known, new])
        self.start = np.concatenate([self.start, (len(self.ids) + np.cumsum(own) - own).astype(np.int32)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.count = np.concatenate([self.count, own.astype(np.int32)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary, so that its words serve all tasks of the worker."""
    return Encoder(Vocabulary(path))


#: Texts are encoded in runs of about so many bytes, which bounds a task's memory whatever the batch.
RUN_BYTES = 4_000_000


def runs(batch: pa.RecordBatch, column: int = 1) -> Iterator[tuple[int, int, pa.Array]]:
    """(first row, end row, texts) of runs of rows."""
    texts, at = batch.column(column), 0
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    upto = np.append(0, np.cumsum(sizes, dtype=np.int64))
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + RUN_BYTES, side="right")) - 1)
        yield at, end, texts.slice(at, end - at)
        at = end
    pa.default_memory_pool().release_unused()  # a worker serves many tasks; what it keeps the executor lacks


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo, hi, texts in runs(batch):
                ids, count = enc.batch(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) for each row of ``docs(doc_id, text)``; null and empty texts have no ids.

    ``path`` names a byte-level tokenizer.json that the executors can open. Added tokens in a text become their ids.
    Rows that repeat and null doc_ids are kept; other columns are ignored; an empty table gives an empty table.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_encode(path), "doc_id long, ids array<int>")


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = encoder(path).vocabulary
        for batch in batches:
            texts = [None if not x.is_valid else vocabulary.decode(np.asarray(x.values.to_numpy(), dtype=np.int64)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return run


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for each row of ``tokens(doc_id, ids)``; null ids give a null text, no ids an empty one.

    Bytes that aren't UTF-8 become U+FFFD.
    """
    ship(tokens.sparkSession)
    return tokens.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(_decode(path), "doc_id long, text string")


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for lo, hi, texts in runs(batch):
                ids, count = enc.batch(texts)
                ids = ids.astype("<u4")
                ids_sha, text_sha, at = [], [], 0
                for n in count:
                    own, at = ids[at : at + n], at + n
                    ids_sha.append(hashlib.sha256(own.tobytes()).hexdigest())
                    text_sha.append(hashlib.sha256(enc.vocabulary.decode(own).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(count, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded and decoded again, with digests of both.

    The ids are digested as little-endian unsigned 32-bit integers. Rows as in :func:`encode`.
    """
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
