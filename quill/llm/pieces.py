"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text is cut at word starts (the vocabulary has no piece with a space mark
after another character, which is checked), and the words not seen before by
the task are encoded together: one flat array of symbols, in each round the
smallest pair rank of every word, all leftmost non-overlapping occurrences of
that pair merged at once, and the arrays compacted, until no pair remains.

Merging all occurrences at once equals the library's one-by-one order unless
the new symbol takes part in a pair that ranks as high as itself or higher;
for such pieces (found when the vocabulary is loaded) only the leftmost
occurrence is merged in a round.  Characters outside the vocabulary become
their UTF-8 bytes.

A word of more than ``WINDOW`` characters is encoded as overlapping windows,
which are words like the others (equal ones once), and put together where two
windows have a symbol end in common.  That is exact: merges go by rank, then
place, so what is between two ends that no merge crosses is encoded as if it
stood alone; hence a sequence in which every symbol and its neighbour, encoded
alone, stay these two is the only result.  Inside a window neighbours do; at the
seam the pair is encoded to see, and where no seam will do the windows grow.  So
the rounds are as many as a window needs, however long the word.

The model is a parameter: its bytes are read on the driver and shipped to the
tasks as a broadcast variable (a vocabulary, some hundred KB, whatever the
data).  A task's word memory is cleared at ``CACHE_WORDS`` entries.

Defined cases: null or empty text has no ids and decodes to the empty text;
rows are independent, so ties and repeated rows need no rule; an empty table
gives an empty result.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
CACHE_WORDS, CACHE_CHARS = 400_000, 48
CHUNK_CHARS = 1 << 21
NO_RANK = 1 << 40
WINDOW, OVERLAP, WINDOW_CHARS = 192, 64, 1 << 20
SEAMS_KEPT = 1 << 18
SEGMENTS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
SEED = np.uint64(0x9E3779B97F4A7C15)


class PieceModel:
    """Vocabulary of a BPE model with identity normalisation, a dummy prefix and byte fallback."""

    def __init__(self, model: bytes) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
        if (proto.trainer_spec.model_type != pb.TrainerSpec.BPE or norm.precompiled_charsmap
                or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not proto.trainer_spec.byte_fallback):
            raise ValueError("only BPE models with identity normalisation, dummy prefix and byte fallback are supported")
        self.pieces = [p.piece for p in proto.pieces]
        score = np.array([p.score for p in proto.pieces])
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        self.byte_ids = {i: int(p.piece[1:-1], 16) for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.id_of_byte = [i for i, _ in sorted(self.byte_ids.items(), key=lambda x: x[1])]
        # rank 0 is the best score; equal scores share a rank and go by position
        _, back = np.unique(-score, return_inverse=True)
        left, right, made = [], [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
        left, right, made = (np.array(x, np.int64) for x in (left, right, made))
        self.rank = back.astype(np.int64)
        self.texts = [p.replace(MARK, " ") for p in self.pieces]
        self.sizes = np.array([len(p) for p in self.pieces], np.int64)
        self.seams: dict[tuple[int, int], bool] = {}
        self.numbers = [str(i) for i in range(len(self.pieces))]
        self.one_by_one = np.zeros(len(self.pieces), bool)
        for side in (left, right):
            self.one_by_one[side[self.rank[made] <= self.rank[side]]] = True
        self._hash(left * len(self.pieces) + right, made)

    def _hash(self, keys: np.ndarray, made: np.ndarray) -> None:
        """Open-addressing table from pair key to the piece it makes."""
        bits = int(np.ceil(np.log2(max(2, len(keys))))) + 2
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys, self.made = np.full(size + 64, -1, np.int64), np.full(size + 64, -1, np.int64)
        at, todo = self._at(keys), np.arange(len(keys))
        while len(todo):
            spot, first = np.unique(at[todo], return_index=True)
            free = self.keys[spot] < 0
            win = todo[first[free]]
            self.keys[at[win]], self.made[at[win]] = keys[win], made[win]
            todo = np.setdiff1d(todo, win)
            at[todo] += 1

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * SEED) >> self.shift).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Piece made by each pair of symbols, -1 for none (negative symbols are unknown characters)."""
        keys = a * len(self.pieces) + b
        at = self._at(keys)
        got = self.keys[at]
        out = np.where(got == keys, self.made[at], -1)
        todo = np.flatnonzero((got != keys) & (got >= 0))
        while len(todo):
            at[todo] += 1
            got = self.keys[at[todo]]
            hit = got == keys[todo]
            out[todo[hit]] = self.made[at[todo[hit]]]
            todo = todo[~hit & (got >= 0)]
        out[(a < 0) | (b < 0)] = -1
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all words, one after the other, and where each word ends.

        Words carry their leading space marks; a negative symbol is -1 minus an unknown character.
        """
        long = [i for i, w in enumerate(words) if len(w) > WINDOW]
        if not long:
            return self._rounds(words)
        sym, ends = self._rounds([w for w in words if len(w) <= WINDOW])
        parts = iter(np.split(sym, ends[:-1]))
        done = dict(zip(long, self._windows([words[i] for i in long], WINDOW), strict=True))
        out = [done[i] if i in done else next(parts) for i in range(len(words))]
        return np.concatenate(out), np.cumsum([len(x) for x in out])

    def _encode_windows(self, texts: list[str], found: dict[str, tuple[np.ndarray, np.ndarray]], size: int) -> None:
        """Symbols and their ends of the texts not yet in ``found``."""
        todo = [x for x in dict.fromkeys(texts) if x not in found]
        per = max(1, WINDOW_CHARS // size)
        for i in range(0, len(todo), per):
            part = todo[i:i + per]
            sym, ends = self._rounds(part)
            for x, own in zip(part, np.split(sym, ends[:-1]), strict=True):
                found[x] = own, np.cumsum(np.where(own >= 0, self.sizes[np.maximum(own, 0)], 1))

    @staticmethod
    def _places(left: np.ndarray, right: np.ndarray, shift: int, middle: int) -> list[tuple[int, int]]:
        """(last symbol before, first symbol after) of the ends that two windows share, those next to ``middle`` first."""
        _, a, b = np.intersect1d(left, np.append(0, right[:-1]) + shift, assume_unique=True, return_indices=True)
        order = np.argsort(np.abs(left[a] - middle), kind="stable")
        return list(zip(a[order].tolist(), b[order].tolist(), strict=True))

    def _windows(self, words: list[str], size: int) -> list[np.ndarray]:
        """Symbols of each long word, from windows of ``size`` characters."""
        step = size - OVERLAP
        windows = [[w[a:a + size] for a in range(0, max(1, len(w) - OVERLAP), step)] for w in words]
        found: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self._encode_windows([x for own in windows for x in own], found, size)
        seams = [(k, i, self._places(found[own[i]][1], found[own[i + 1]][1], step, step + OVERLAP // 2))
                 for k, own in enumerate(windows) for i in range(len(own) - 1)]
        chosen = self._seams(seams, windows, found)
        return [self._joined(w, own, {i: c for (x, i), c in chosen.items() if x == k} if len(words) > 1 else
                             {i: c for (_, i), c in chosen.items()}, found, size)
                for k, (w, own) in enumerate(zip(words, windows, strict=True))]

    def _joined(self, word: str, windows: list[str], chosen: dict[int, tuple[int, int]],
                found: dict[str, tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
        """The windows' symbols put together at the chosen seams.

        Where two windows share no end (a run has its ends from its beginning on), windows that begin
        at an end of the one before lead on, until one meets the given windows again.
        """
        out, step = [], size - OVERLAP
        at, number, begin = 0, 0, 0  # start of the window, its number if it is a given one, first symbol not yet out
        text = windows[0]
        while True:
            sym, ends = found[text]
            if at + len(text) >= len(word):
                out.append(sym[begin:])
                return np.concatenate(out)
            if number is not None and (c := chosen.get(number)) and c[0] >= begin:
                out.append(sym[begin:c[0] + 1])
                number, begin, at = number + 1, c[1], at + step
                text = windows[number]
                continue
            if number is None:
                j = at // step + 1  # the next given window
                if j < len(windows):
                    places = self._places(ends, found[windows[j]][1], j * step - at, (j * step - at + len(text)) // 2)
                    places = [(a, b) for a, b in places[:4] if a >= begin]
                    self._judge([(int(sym[a]), int(found[windows[j]][0][b])) for a, b in places])
                    hit = next(((a, b) for a, b in places if self.seams[int(sym[a]), int(found[windows[j]][0][b])]), None)
                    if hit:
                        out.append(sym[begin:hit[0] + 1])
                        number, begin, at, text = j, hit[1], j * step, windows[j]
                        continue
            for a in range(int(np.searchsorted(ends, size - OVERLAP // 4, "right")) - 1, begin - 1, -1):
                new = word[at + int(ends[a]):at + int(ends[a]) + size]
                self._encode_windows([new], found, size)
                pair = int(sym[a]), int(found[new][0][0])
                self._judge([pair])
                if self.seams[pair]:
                    out.append(sym[begin:a + 1])
                    number, begin, at, text = None, 0, at + int(ends[a]), new
                    break
            else:  # no end leads on: larger windows
                return self._windows([word], 2 * size)[0] if len(word) > 2 * size else self._rounds([word])[0]

    def _seams(self, seams, windows, found) -> dict[tuple[int, int], tuple[int, int]]:
        """Of the seams (word, number of the window before, places) the first place whose two symbols stay two."""
        chosen: dict[tuple[int, int], tuple[int, int]] = {}
        at = 0
        while seams:
            seams = [s for s in seams if at < len(s[2])]
            pairs = [(int(found[windows[k][i]][0][places[at][0]]), int(found[windows[k][i + 1]][0][places[at][1]]))
                     for k, i, places in seams]
            self._judge(pairs)
            for (k, i, places), pair in zip(seams, pairs, strict=True):
                if self.seams[pair]:
                    chosen[k, i] = places[at]
            seams = [s for s, pair in zip(seams, pairs, strict=True) if not self.seams[pair]]
            at += 1
        return chosen

    def _judge(self, pairs: list[tuple[int, int]]) -> None:
        """Whether the texts of two symbols, encoded together, are these two symbols."""
        if len(self.seams) > SEAMS_KEPT:
            self.seams.clear()
        new = list({p for p in pairs if p not in self.seams})
        text = lambda s: self.pieces[s] if s >= 0 else chr(-1 - s)
        sym, ends = self._rounds([text(a) + text(b) for a, b in new])
        for pair, own in zip(new, np.split(sym, ends[:-1]) if new else [], strict=True):
            self.seams[pair] = own.tolist() == list(pair)

    def _rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """``encode_words`` by merge rounds over all words at once."""
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        distinct, back = np.unique(chars, return_inverse=True)
        known = np.array([self.ids.get(chr(c), -1 - c) for c in distinct.tolist()], np.int64)
        sym = known[back]
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        made = np.full(len(sym), -1, np.int64)
        made[:-1] = np.where(word[1:] == word[:-1], self.pair(sym[:-1], sym[1:]), -1)
        while len(sym):
            rank = np.where(made >= 0, self.rank[made], NO_RANK)
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            sizes = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            over = np.repeat(best == NO_RANK, sizes)
            if over.any():
                done.append((word[over], sym[over]))
                live = ~over
                sym, word, made, rank = sym[live], word[live], made[live], rank[live]
                if not len(sym):
                    break
                sizes, best = sizes[best != NO_RANK], best[best != NO_RANK]
            at = np.flatnonzero(rank == np.repeat(best, sizes))
            # leftmost non-overlapping: every second one of a run of neighbours
            run = np.concatenate(([True], (np.diff(at) != 1) | (word[at[1:]] != word[at[:-1]])))
            begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            first = np.concatenate(([True], word[at[1:]] != word[at[:-1]]))
            single = self.one_by_one[made[at]]
            if single.any():  # one such pair is enough to take the word's leftmost pair alone
                lone = np.zeros(len(first), bool)
                which = np.cumsum(first) - 1
                lone = np.bincount(which, weights=single)[which] > 0
            else:
                lone = single
            take = at[np.where(lone, first, (np.arange(len(at)) - begin) % 2 == 0)]
            sym[take] = made[take]
            keep = np.ones(len(sym), bool)
            keep[take + 1] = False
            fresh = np.zeros(len(sym), bool)
            fresh[take] = True
            sym, word, made, fresh = sym[keep], word[keep], made[keep], fresh[keep]
            # pairs that begin or end in a new symbol
            redo = fresh.copy()
            redo[:-1] |= fresh[1:]
            redo = np.flatnonzero(redo)
            inner = redo[redo + 1 < len(sym)]
            made[redo] = -1
            made[inner] = np.where(word[inner] == word[inner + 1], self.pair(sym[inner], sym[inner + 1]), -1)
        word = np.concatenate([x for x, _ in done]) if done else np.zeros(0, np.int64)
        sym = np.concatenate([x for _, x in done]) if done else np.zeros(0, np.int64)
        order = np.argsort(word, kind="stable")
        return sym[order], np.cumsum(np.bincount(word, minlength=len(words)))

    def entries(self, words: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each word: the number of its ids, its ids joined by commas, its decoded text."""
        sym, ends = self.encode_words(words)
        odd = {int(np.searchsorted(ends, i, "right")) for i in np.flatnonzero(sym < 0).tolist()}
        known = np.maximum(sym, 0).tolist()  # words with unknown characters go through their bytes
        numbers = [self.numbers[i] for i in known]
        texts = [self.texts[i] for i in known]
        a = 0
        for k, b in enumerate(ends.tolist()):
            if k in odd:
                ids = self._bytes(sym[a:b].tolist())
                yield len(ids), ",".join(map(str, ids)), self.surface(ids)
            else:
                yield b - a, ",".join(numbers[a:b]), "".join(texts[a:b])
            a = b

    def _bytes(self, sym: list[int]) -> list[int]:
        """Unknown characters as the ids of their UTF-8 bytes."""
        out: list[int] = []
        for s in sym:
            out += [s] if s >= 0 else [self.id_of_byte[b] for b in chr(-1 - s).encode("utf-8")]
        return out

    def surface(self, ids: list[int]) -> str:
        """Text of ids, space marks as spaces, byte pieces as UTF-8."""
        raw = b"".join(bytes([self.byte_ids[i]]) if i in self.byte_ids else self.pieces[i].encode() for i in ids)
        return raw.decode("utf-8", "replace").replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        """The library's ``decode``: without the space of the dummy prefix."""
        return self.surface(ids).removeprefix(" ")


class Encoder:
    """Encodes texts, remembering words as (ids joined by commas, decoded text).

    A line feed is in no piece, so it ends a word too.
    """

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        if any("\n" in p for p in model.ids):
            raise ValueError("a piece holds a line feed")
        self.feed = next((n, t) for _, n, t in model.entries(["\n"]))
        self.marked: dict[str, tuple[str, str]] = {}  # by the word without its mark
        self.as_is: dict[str, tuple[str, str]] = {}

    @staticmethod
    def split(text: str) -> list[tuple[list[str], list[str]]]:
        """Of each line: words as they are, then words that miss their one space mark."""
        out, first = [], True
        for line in text.split("\n"):
            if "  " in line or MARK in line or first and line[:1] == " ":
                line = line.replace(" ", MARK)
                out.append((SEGMENTS.findall(MARK + line if first else line), []))
            else:
                words = line.split(" ")
                if first:
                    out.append(([], words))
                else:
                    out.append((words[:1] if words[0] else [], words[1:]))
            first = False
        return out

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, ids joined by commas, decoded text."""
        if len(self.marked) + len(self.as_is) > CACHE_WORDS:
            self.marked.clear()
            self.as_is.clear()
        marked, as_is = self.marked, self.as_is
        split = [self.split(t) if t else [] for t in texts]
        new = {w for s in split for _, m in s for w in m if w not in marked}
        new_as_is = {w for s in split for a, _ in s for w in a if w not in as_is}
        todo = [*[MARK + w for w in new], *new_as_is]
        if todo:
            made = ((n, t) for _, n, t in self.model.entries(todo))
            marked.update(zip(new, made))  # noqa: B905  the rest goes to as_is
            as_is.update(zip(new_as_is, made, strict=True))
        by_mark, by_self, feed = marked.__getitem__, as_is.__getitem__, self.feed
        for s in split:
            found: list[tuple[str, str]] = []
            for k, (a, m) in enumerate(s):
                if k:
                    found.append(feed)
                found += map(by_self, a)
                found += map(by_mark, m)
            if not found:
                yield 0, "", ""
                continue
            ids, text = zip(*found, strict=True)
            joined = ",".join(ids)
            yield joined.count(",") + 1, joined, "".join(text).removeprefix(" ")
        for seen, words in ((marked, new), (as_is, new_as_is)):
            for w in words:
                if len(w) > CACHE_CHARS:
                    del seen[w]


def chunks(texts: list[str | None], most: int = CHUNK_CHARS) -> Iterator[list[str | None]]:
    """Consecutive runs of texts of about ``most`` characters; one text is never cut."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode_table(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(PieceModel(shared.value))
        gc.disable()  # the word memory holds no cycles, and scanning it again and again takes a third of the time
        try:
            yield from encoded(encoder, batches)
        finally:
            gc.enable()

    def encoded(encoder: Encoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in chunks(b.column(1).to_pylist()):
                n, ids, dec, flat = [], [], [], []
                for count, joined, text in encoder.texts(part):
                    n.append(count)
                    ids.append(hashlib.sha256(joined.encode()).hexdigest())
                    dec.append(hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())
                    if with_ids:
                        flat.append(np.fromstring(joined, np.int32, sep=",") if joined else np.zeros(0, np.int32))
                cols = [b.column(0).slice(at, len(part)), pa.array(n, pa.int64()), pa.array(ids), pa.array(dec)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    ends = np.cumsum([0, *map(len, flat)])
                    cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                                         pa.array(np.concatenate(flat) if flat else [], pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)
                at += len(part)

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
