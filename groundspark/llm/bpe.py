"""Exact byte-level BPE over a transducer lexicon (operator 8), and the unit cache that operators 4 and 7 share.

A text is cut into units - letters, or a run of characters that aren't white
space, with at most one leading space, or white space - such that the tokenizer's own pattern never matches
across two units.  Each distinct unit is encoded once per worker.  For
operator 8 a unit is split by the pattern into words; words of the lexicon get
their ids from a minimal acyclic transducer that workers map into memory, and
unseen words are merged exactly, many at a time.

Defined results: null or empty text gives no ids, and decodes to ''.  The
special token's string inside a text becomes its single id, as the library
does.  Repeated rows are encoded alike.  Very long words are merged with a
heap, in n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The characters with the Unicode property White_Space.
SPACE = "\t-\r \x85\xa0  -     　"
#: Letters before white space or ASCII punctuation are a unit of their own: "word", "word," and "word." share it.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
UNIT = re.compile(rf" ?[{LETTERS}]+(?=[{SPACE}!-/:-@\[-`{{-~]|\Z)| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: A unit that is one word of the tokenizer's pattern.
ONE_WORD = re.compile(rf" ?[{LETTERS}]+")
#: Fixed pattern of the tokenizer (contractions, letters, numbers, others, white space).
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The lexicon: least count of a word, most words, most characters of a word; pieces that a worker counts at a time.
LEAST_COUNT, MOST_WORDS, MOST_CHARS, COUNTED = 4, 60_000, 64, 300_000
#: Longer words are merged one by one with a heap.
LOCKSTEP = 48
#: New units that the library encodes as one string.
JOINED = 64
NONE = np.int64(1 << 62)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves, the rest from 256 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and token bytes of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, ids = byte_letters(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(map(letters.__getitem__, token))
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for letter, b in letters.items():
            self.byte_id[b] = ids[letter]
        self.size = size
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        key = np.array([ids[a] * size + ids[b] for a, b in merges], np.int64)
        made = np.array([ids[a + b] for a, b in merges], np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made
        self.ranks = dict(zip(key.tolist(), range(len(key)), strict=True))
        self.splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        q = a * self.size + b
        at = np.searchsorted(self.key, q)
        at[at == len(self.key)] = 0
        return np.where(self.key[at] == q, self.rank[at], NONE)

    def merge_long(self, word: bytes) -> list[int]:
        """Lowest rank first, then leftmost, by a heap over a linked list."""
        sym = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n, ranks, size = len(sym), self.ranks, self.size
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []
        for i in range(n - 1):
            if (r := ranks.get(sym[i] * size + sym[i + 1])) is not None:
                heap.append((r, i, sym[i], sym[i + 1]))
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(sym[i] * size + sym[after[i]])) is not None:
                    heapq.heappush(heap, (r, i, sym[i], sym[after[i]]))
            if (k := before[i]) >= 0 and (r := ranks.get(sym[k] * size + sym[i])) is not None:
                heapq.heappush(heap, (r, k, sym[k], sym[i]))
        return [s for s in sym if s >= 0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one array, and how many each has; all words take their next merge in one step."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        long = np.flatnonzero(size > LOCKSTEP).tolist()
        done: list[tuple[np.ndarray, np.ndarray]] = [(np.array(x, np.int64), np.full(len(x), i, np.int64)) for i in long for x in [self.merge_long(words[i])]]
        short = np.flatnonzero((size > 0) & (size <= LOCKSTEP))
        sym = self.byte_id[np.frombuffer(b"".join([w for w in words if len(w) <= LOCKSTEP]), np.uint8)]
        own = np.repeat(short, size[short])
        at = np.arange(len(sym))

        def fresh(sym: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
            nxt = np.minimum(at + 1, len(sym) - 1)
            r = self.pair_ranks(sym[at], sym[nxt])
            return np.where((own[at] == own[nxt]) & (nxt > at), r, NONE)

        rank = fresh(sym, own, at) if len(sym) else sym
        while len(sym):
            starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            best = np.minimum.reduceat(np.where(rank < NONE, (rank << np.int64(32)) + np.arange(len(sym)), NONE), starts)
            more = best < NONE
            if not more.all():  # these words have no further merge
                stay = np.repeat(more, np.diff(np.r_[starts, len(sym)]))
                done.append((sym[~stay], own[~stay]))
                shift = np.cumsum(~stay)  # entries dropped up to each place
                best = best[more]
                best = best - shift[best & np.int64(0xFFFFFFFF)]
                sym, own, rank = sym[stay], own[stay], rank[stay]
                if not len(sym):
                    break
            at = best & np.int64(0xFFFFFFFF)
            sym[at] = self.made[best >> np.int64(32)]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # one entry goes after each earlier merge
            sym, own, rank = sym[keep], own[keep], rank[keep]
            rank[at] = fresh(sym, own, at)
            left = at[at > 0] - 1
            rank[left] = fresh(sym, own, left)
        if not done:
            return np.empty(0, np.int64), np.zeros(len(words), np.int64)
        ids, own = (np.concatenate(x) for x in zip(*done, strict=True))
        return ids[np.argsort(own, kind="stable")], np.bincount(own, minlength=len(words))


def gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """pool[begin : begin + size] of each entry, one after the other."""
    ends = np.cumsum(size)
    return pool[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)]


def sums(x: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups of x, with `count` entries each."""
    total = np.r_[0, np.cumsum(x)]
    ends = np.cumsum(count)
    return total[ends] - total[ends - count]


class Transducer:
    """A minimal acyclic automaton over bytes whose paths add up to a word's number; ids are stored by number.

    Built from sorted words with shared suffixes; kept as flat arrays in one
    block of bytes, so a worker maps the file and reads only what it touches.
    """

    @staticmethod
    def compile(words: list[bytes], ids: np.ndarray, size: np.ndarray) -> bytes:
        """words are distinct; word k has size[k] ids."""
        order = sorted(range(len(words)), key=words.__getitem__)
        ids, size, words = gather(ids, (np.cumsum(size) - size)[order], size[order]), size[order], [words[i] for i in order]
        register: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

        def freeze(node: list) -> int:
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path: list[list] = [[False, []]]  # nodes of the current word; each child is added when it is frozen
        last = b""
        for w in [*words, None]:
            keep = 0 if w is None else len(os.path.commonprefix([last, w]))
            while len(path) - 1 > keep:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], freeze(node)))
            if w is None:
                break
            path += [[False, []] for _ in w[keep:]]
            path[-1][0] = True
            last = w
        root = freeze(path[0])
        count = [0] * len(states)
        key, to, add = [], [], []
        for s, (final, arcs) in enumerate(states):  # children come first
            n = int(final)
            for b, t in arcs:
                key.append(s * 256 + b)
                to.append(t)
                add.append(n)
                n += count[t]
            count[s] = n
        arrays = [
            np.array(key, np.int64), np.array(to, np.int64), np.array(add, np.int64), np.array([f for f, _ in states], np.int64),
            np.r_[0, np.cumsum(size)].astype(np.int64), ids.astype(np.int64),
        ]
        head = np.array([root, *map(len, arrays)], np.int64)
        return head.tobytes() + b"".join(a.tobytes() for a in arrays)

    def __init__(self, blob: bytes):
        path = common.worker_file(blob)
        data = np.asarray(np.memmap(path, np.int64, "r"))
        os.unlink(path)  # the mapping stays
        self.root, at, got = int(data[0]), 7, []
        for n in data[1:7]:
            got.append(data[at : at + int(n)])
            at += int(n)
        self.key, self.to, self.add, self.final, self.offset, self.ids = got

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 if the lexicon lacks it; all words step through the automaton together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(size) - size
        state, total = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        at, step = np.flatnonzero(size > 0), 0
        state[size == 0] = -1
        while len(at) and len(self.key):
            q = state[at] * 256 + flat[begin[at] + step]
            k = np.searchsorted(self.key, q)
            k[k == len(self.key)] = 0
            hit = self.key[k] == q
            state[at[~hit]] = -1
            at, k = at[hit], k[hit]
            state[at] = self.to[k]
            total[at] += self.add[k]
            step += 1
            at = at[size[at] > step]
        ok = (state >= 0) & (self.final[np.maximum(state, 0)] == 1 if len(self.final) else False)
        return np.where(ok, total, -1)


class _Memo(dict):
    def __missing__(self, unit: str) -> int:
        n = self[unit] = len(self)
        self.new.append(unit)
        return n


class UnitEncoder:
    """Ids of texts by way of distinct units.  `encode` maps a list of units to all their ids and the number of each."""

    def __init__(self, encode, splitter: re.Pattern | None, special: dict[str, int], most: int = 400_000):
        self.encode, self.splitter, self.special, self.most = encode, splitter, special, most
        self._reset()

    def _reset(self) -> None:
        self.memo = _Memo()
        self.memo.new = []
        self.flat, self.size = np.empty(1 << 16, np.int32), np.empty(1 << 14, np.int32)
        self.begin, self.used, self.n = np.empty(1 << 14, np.int32), 0, 0
        self.hits = np.zeros(0, np.int64)

    def _trim(self) -> None:
        """Forget units met once, and so many more that at most half of `most` stay; results don't depend on it."""
        old, hits, flat, begin, size = self.memo, self.hits, self.flat, self.begin, self.size
        least = max(2, int(np.partition(hits, -(self.most // 2))[-(self.most // 2)]) + 1) if len(hits) > self.most // 2 else 2
        stay = np.flatnonzero(hits >= least)
        units = list(itertools.compress(old, (hits >= least).tolist()))
        n = size[stay].astype(np.int64)
        ids = gather(flat, begin[stay].astype(np.int64), n)
        self._reset()
        self.memo.update(zip(units, range(len(units)), strict=True))
        self._add(ids, n)
        self.hits = hits[stay] >> 1

    def _add(self, ids: np.ndarray, n: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while self.n + len(n) > len(self.size):
            self.size, self.begin = (np.concatenate([x, np.empty_like(x)]) for x in (self.size, self.begin))
        self.flat[self.used : self.used + len(ids)] = ids
        self.size[self.n : self.n + len(n)] = n
        self.begin[self.n : self.n + len(n)] = self.used + np.cumsum(n) - n
        self.used, self.n = self.used + len(ids), self.n + len(n)

    def texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each text."""
        if len(self.memo) > self.most:
            self._trim()
        index, per = [], np.empty(len(texts), np.int64)
        for k, text in enumerate(texts):
            units = UNIT.findall(text) if self.splitter is None or not self.splitter.search(text) else self._with_special(text)
            index.append(np.fromiter(map(self.memo.__getitem__, units), np.int64, len(units)))
            per[k] = len(units)
        if new := self.memo.new:
            if known := [i for i, u in enumerate(new) if u in self.special]:
                ids, n = self.encode([u for u in new if u not in self.special])
                begin = np.insert(np.cumsum(n) - n, [i - k for k, i in enumerate(known)], np.arange(len(known)) + len(ids))
                n = np.insert(n, [i - k for k, i in enumerate(known)], 1)
                ids = gather(np.r_[ids, [self.special[new[i]] for i in known]], begin, n)
            else:
                ids, n = self.encode(new)
            self._add(ids, n)
            self.memo.new = []
        at = np.concatenate(index) if index else np.empty(0, np.int64)
        hits = np.bincount(at, minlength=len(self.memo))
        hits[: len(self.hits)] += self.hits
        self.hits = hits
        size = self.size[at].astype(np.int64)
        return gather(self.flat, self.begin[at].astype(np.int64), size), sums(size, per)

    def _with_special(self, text: str) -> list[str]:
        out: list[str] = []
        for part in self.splitter.split(text):
            out += [part] if part in self.special else UNIT.findall(part)
        return out


def lexicon_encoder(vocabulary: Vocabulary, blob: bytes) -> UnitEncoder:
    """Words by the transducer, unseen words by merging."""
    lexicon = Transducer(blob)

    def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        words: list[str] = []
        per = np.ones(len(units), np.int64)
        for k, u in enumerate(units):
            if u.isalpha() or (u[0] == " " and u[1:].isalpha()):
                words.append(u)
            else:
                words += (ws := WORD.findall(u))
                per[k] = len(ws)
        raw = [w.encode() for w in words]
        number = lexicon.numbers(raw)
        seen, unseen = number >= 0, np.flatnonzero(number < 0)
        merged, n = vocabulary.merge([raw[i] for i in unseen.tolist()])
        begin, size = np.empty(len(raw), np.int64), np.empty(len(raw), np.int64)
        begin[unseen], size[unseen] = len(lexicon.ids) + np.cumsum(n) - n, n
        begin[seen], size[seen] = lexicon.offset[number[seen]], lexicon.offset[number[seen] + 1] - lexicon.offset[number[seen]]
        return gather(np.concatenate([lexicon.ids, merged]), begin, size), sums(size, per)

    return UnitEncoder(encode, vocabulary.splitter, vocabulary.special)


def library_encoder(path: str, vocabulary: Vocabulary) -> UnitEncoder:
    """Units by the tokenizers library (operators 4 and 7)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()

    mark = tok.encode("\n", add_special_tokens=False).ids[0]
    letter_of = {b: letter for letter, b in byte_letters().items()}
    to_letters, line_end = {b: ord(letter) for b, letter in letter_of.items()}, letter_of[10]

    def as_strings(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # Units that aren't white space have none but one leading space, so "\n" between two of them is a token of its own.
        plain = np.fromiter((not u.isspace() for u in units), bool, len(units))
        joined = [u for u in units if not u.isspace()]
        lines = ["\n".join(joined[i : i + JOINED]) for i in range(0, len(joined), JOINED)]
        alone = [u for u in units if u.isspace()]
        ids = [np.r_[np.array(e.ids, np.int64), mark] for e in tok.encode_batch_fast(lines, add_special_tokens=False)]
        flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
        at = np.flatnonzero(flat == mark)
        size = np.empty(len(units), np.int64)
        size[plain] = np.diff(np.r_[-1, at]) - 1
        lists = [e.ids for e in tok.encode_batch_fast(alone, add_special_tokens=False)]
        size[~plain] = list(map(len, lists))
        if not alone:
            return flat[flat != mark], size
        begin = np.empty(len(units), np.int64)
        pool = np.concatenate([flat, np.fromiter(itertools.chain.from_iterable(lists), np.int64)])
        begin[plain] = np.r_[0, at[:-1] + 1] if len(at) else 0
        begin[~plain] = len(flat) + np.cumsum(size[~plain]) - size[~plain]
        return gather(pool, begin, size), size

    def as_words(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        # One word of the pattern each: the library's model takes them without its search for words.
        words = "\n".join(units).encode().decode("latin-1").translate(to_letters).split(line_end)
        lists = [[t.id for t in tokens] for tokens in map(tok.model.tokenize, words)]
        size = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(size.sum())), size

    def encode(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        word = np.fromiter((ONE_WORD.fullmatch(u) is not None for u in units), bool, len(units))
        parts = [f(list(itertools.compress(units, which.tolist()))) for f, which in ((as_words, word), (as_strings, ~word)) if which.any()]
        if len(parts) == 1:
            return parts[0]
        (ids_w, n_w), (ids_s, n_s) = parts
        size, begin = np.empty(len(units), np.int64), np.empty(len(units), np.int64)
        size[word], size[~word] = n_w, n_s
        begin[word], begin[~word] = np.cumsum(n_w) - n_w, len(ids_w) + np.cumsum(n_s) - n_s
        return gather(np.concatenate([ids_w, ids_s]), begin, size), size

    return UnitEncoder(encode, vocabulary.splitter, vocabulary.special)


_KEPT: dict = {}


def kept_encoder(key: tuple, build) -> UnitEncoder:
    """One encoder for each worker process, so that later tasks find its units; the key tells tokenizer and lexicon."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the words of all documents' pieces between white space, each taken as it stands behind a space (words up to MOST_CHARS characters)."""

    def rows(pieces: Counter) -> pa.RecordBatch:
        count: Counter = Counter()
        for piece, n in pieces.items():
            for w in WORD.findall(" " + piece):
                if len(w) <= MOST_CHARS:
                    count[w] += n
        return pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], ["word", "n"])

    def run(batches):
        pieces: Counter = Counter()
        for batch in batches:
            for text in common.texts_of(batch):
                pieces.update(text.split())
                if len(pieces) > COUNTED:
                    yield rows(pieces)
                    pieces = Counter()
        yield rows(pieces)

    return common.documents(docs).select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, vocabulary: Vocabulary) -> bytes:
    """Transducer of the vocabulary's own words and of the words that are most frequent in all documents (words of equal counts together).

    It decides only which words are looked up instead of merged, never a
    result; MOST_WORDS bounds what reaches the driver and is sent to workers.
    """
    counts, _ = common.stored(word_counts(docs).where(F.col("n") >= LEAST_COUNT).withColumn("size", F.floor(F.log2("n") * 16).cast("int")), "words")
    # The least size of counts (sixteen to a doubling, a thousand at most) from which up there are no more words than MOST_WORDS / 2.
    least, total = 1 << 30, 0
    for r in sorted(counts.groupBy("size").count().collect(), reverse=True):
        total += r["count"]
        if total > MOST_WORDS // 2:
            break
        least = r["size"]
    words = sorted(r.word.encode() for r in counts.where(F.col("size") >= least).select("word").collect())  # at most MOST_WORDS / 2
    own = [b for b in vocabulary.bytes if b and len(b) <= 32][: MOST_WORDS // 2]
    words = list({w: 1 for w in words + own})
    return Transducer.compile(words, *vocabulary.merge(words))


def encode_decode(docs: DataFrame, tokenizer: str | None = None, keep_ids: bool = True) -> DataFrame:
    """doc_id, ids (if kept), decoded text (if kept), and their digests, per row."""
    path = tokenizer or default_tokenizer()
    built = build_lexicon(docs, Vocabulary(path))
    key, blob = hashlib.sha256(built).hexdigest(), docs.sparkSession.sparkContext.broadcast(built)  # at most MOST_WORDS words

    def run(batches):
        enc, tokens = kept_encoder((path, key), lambda: (lexicon_encoder(v := Vocabulary(path), blob.value), v.bytes))
        token = tokens.__getitem__
        for batch in batches:
            for part in common.chunks(batch):
                ids, n = enc.texts(common.texts_of(part))
                ids, ends = ids.astype("<i4"), np.cumsum(n)
                listed, raw = ids.tolist(), memoryview(ids.view(np.uint8))
                h1, h2, texts = [], [], []
                for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
                    text = b"".join(map(token, listed[a:b])).decode("utf-8", "replace")
                    h1.append(hashlib.sha256(raw[4 * a : 4 * b]).hexdigest())
                    h2.append(hashlib.sha256(text.encode()).hexdigest())
                    if keep_ids:
                        texts.append(text)
                cols = [part.column(0), pa.array(n, pa.int64()), pa.array(h1), pa.array(h2)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols += [pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids)), pa.array(texts, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(cols, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return common.documents(docs).mapInArrow(run, schema)


def op8_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(common.table(spark, sf_dir, "documents"), keep_ids=False)
