"""SentencePiece encoding and decoding (BPE models with byte fallback) by vectorised merge rounds.

A text is cut before each run of blanks and around line breaks, where no piece of the model reaches across, and each different
word of a batch is encoded once. All words lie in one flat array of symbols. A round looks up the rank of every neighbouring
pair, takes the smallest rank of each word, merges its leftmost pair (all its pairs from left to right, where no
merge can make a better pair) in all words at the same time, and closes the gaps; words without a pair leave the array. What
is left is ids; characters without a piece become their UTF-8 bytes' pieces. Decoding joins the pieces' bytes and
takes the blank off that encoding puts first. A task keeps at most CACHE_WORDS words it has encoded.

Vocabulary and scores are read from the model file; nothing else of the library runs.

Defined cases: NULL counts as the empty text, which has no ids and decodes to the empty text; repeated ids are encoded per row; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firnline.llm.common import WordCache, column, map_batches

CACHE_WORDS = 1 << 19
#: Texts whose words are encoded together.
TEXTS = 512
BLANK = "▁"
_NO_PAIR = np.iinfo(np.int32).max


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Fields of a protocol-buffer message: (number, integer or bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield number, data[at : at + size]
            at += size


class Model:
    """Pieces of a model file, and the ranks of all pairs of symbols that make a piece."""

    NORMAL, BYTE = 1, 6

    def __init__(self, path: str):
        self.text, kinds, scores = [], [], []
        with open(path, "rb") as f:
            for number, value in _fields(f.read()):
                if number == 1:
                    piece = dict(_fields(value))
                    self.text.append(piece[1].decode())
                    scores.append(float(np.frombuffer(piece.get(2, b"\0\0\0\0"), dtype="<f4")[0]))
                    kinds.append(piece.get(3, self.NORMAL))
        self.of_byte = {int(t[1:-1], 16): i for i, (t, k) in enumerate(zip(self.text, kinds)) if k == self.BYTE}
        self.bytes = [
            bytes([int(t[1:-1], 16)]) if k == self.BYTE else t.replace(BLANK, " ").encode() if k == self.NORMAL else b"" for t, k in zip(self.text, kinds)
        ]
        self.id = {t: i for i, (t, k) in enumerate(zip(self.text, kinds)) if k == self.NORMAL}
        # Equal scores are one rank: there the place decides.
        rank = np.unique(-np.array(scores, dtype=np.float32), return_inverse=True)[1]
        pairs = [(self.id[t[:k]], self.id[t[k:]], i) for t, i in self.id.items() for k in range(1, len(t)) if t[:k] in self.id and t[k:] in self.id]
        left, right, whole = (np.array(c, dtype=np.int64) for c in zip(*pairs))
        order = np.argsort(left << 32 | right)
        self.key, self.whole = (left << 32 | right)[order], whole[order].astype(np.int32)
        self.rank = rank[self.whole].astype(np.int32)
        # A merge is safe to do at all places at once if every pair with its result is worse and no other piece has its rank.
        best = np.full(len(self.text), _NO_PAIR)
        np.minimum.at(best, left, rank[whole])
        np.minimum.at(best, right, rank[whole])
        shared = np.bincount(rank)[rank] > 1
        self.safe = (best > rank) & ~shared
        # Byte fallback of a character: its symbol is -1 - code point until the end.
        across = [t for t in self.id if BLANK in t.lstrip(BLANK) or "\n" in t]
        if across:
            raise ValueError(f"pieces reach across words: {across[:3]}")

    def symbols(self, word: str) -> list[int]:
        return [self.id.get(c, -1 - ord(c)) for c in word]

    def _pairs(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and pieces of the pairs that begin at these places of the array."""
        rank, whole = np.full(len(at), _NO_PAIR), np.zeros(len(at), dtype=np.int64)
        inner = np.flatnonzero(at + 1 < len(symbol))
        a = at[inner]
        ok = (word[a] == word[a + 1]) & (symbol[a] >= 0) & (symbol[a + 1] >= 0)
        inner, a = inner[ok], a[ok]
        key = symbol[a] << 32 | symbol[a + 1]
        found = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        met = self.key[found] == key
        rank[inner[met]], whole[inner[met]] = self.rank[found[met]], self.whole[found[met]]
        return rank, whole

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, all words at once."""
        known = {c: self.id.get(c, -1 - ord(c)) for c in set().union(*words)} if words else {}
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        symbol = np.fromiter((known[c] for w in words for c in w), dtype=np.int64, count=int(sizes.sum()))
        word = np.repeat(np.arange(len(words)), sizes)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, whole = self._pairs(symbol, word, np.arange(len(symbol)))
        while len(symbol):
            begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            least = np.repeat(np.minimum.reduceat(rank, begin), np.diff(np.append(begin, len(word))))
            active = least != _NO_PAIR
            if not active.all():
                done.append((word[~active], symbol[~active]))
                symbol, word, rank, whole, least = symbol[active], word[active], rank[active], whole[active], least[active]
                if not len(symbol):
                    break
            pick = np.flatnonzero(rank == least)
            piece = whole[pick]
            # Of pairs that overlap, every second one from the left; of an unsafe merge, the first of the word.
            run = np.concatenate([[True], (pick[1:] != pick[:-1] + 1) | (word[pick[1:]] != word[pick[:-1]])])
            place = np.arange(len(pick)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            first = np.concatenate([[True], word[pick[1:]] != word[pick[:-1]]])
            take = np.where(self.safe[piece], place % 2 == 0, first)
            # Whether a word's first pick is safe decides for the word.
            take &= self.safe[piece[first]][np.cumsum(first) - 1] | first
            merged = pick[take]
            symbol[merged] = piece[take]
            keep = np.ones(len(symbol), dtype=bool)
            keep[merged + 1] = False
            symbol, word, rank, whole = symbol[keep], word[keep], rank[keep], whole[keep]
            # Only pairs with a merged symbol have changed.
            at = np.cumsum(keep)[merged] - 1
            changed = np.unique(np.concatenate([at, at[at > 0] - 1]))
            rank[changed], whole[changed] = self._pairs(symbol, word, changed)
        word, symbol = (np.concatenate(c) if c else np.empty(0, dtype=np.int64) for c in (list(zip(*done)) or ([], [])))
        order = np.argsort(word, kind="stable")
        symbol = symbol[order].tolist()
        ends = np.cumsum(np.bincount(word, minlength=len(words))).tolist()
        out, lo = [], 0
        for hi in ends:
            mine = symbol[lo:hi]
            if mine and min(mine) < 0:
                mine = [i for s in mine for i in ([s] if s >= 0 else [self.of_byte[b] for b in chr(-1 - s).encode()])]
            out.append(mine)
            lo = hi
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids; bytes that are no UTF-8 become replacement characters, the blank put first by encoding goes."""
        text = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    return Model(path)


#: A line break, a run of blanks with the word after it, or blanks at the end.
_WORDS = re.compile(f"\n|{BLANK}*[^{BLANK}\n]+|{BLANK}+")


def cut(text: str) -> list[str]:
    """Words of a text, the leading blank added and blanks marked; together they are the text."""
    return _WORDS.findall(BLANK + text.replace(" ", BLANK)) if text else []


class Encoder:
    """Encodes texts word by word and remembers words: ids as decimal text, and decoded bytes."""

    def __init__(self, path: str):
        self.model = load(path)
        self.cache = WordCache(CACHE_WORDS, self._words)

    def _words(self, words: list[str]) -> list[tuple[str, bytes]]:
        return [(",".join(map(str, ids)), b"".join(map(self.model.bytes.__getitem__, ids))) for ids in self.model.encode_words(words)]

    def encode(self, texts: list[str]) -> list[tuple[str, bytes]]:
        """Decimal ids joined by commas, and the bytes that they decode to."""
        cuts = [cut(t) for t in texts]
        known = self.cache.of(set().union(*cuts))
        out = []
        for words in cuts:
            found = [known[w] for w in words]
            text = b"".join([t for _, t in found])
            out.append((",".join([i for i, _ in found]), text[1:] if text.startswith(b" ") else text))
        return out


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a Python worker, so that words stay known."""
    return Encoder(path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the ids of every text."""

    def work(batch: pa.RecordBatch):
        model = load(model_path)
        for lo in range(0, batch.num_rows, TEXTS):
            cuts = [cut(t or "") for t in column(batch, "text").slice(lo, TEXTS).to_pylist()]
            fresh = list(set().union(*cuts))
            ids = dict(zip(fresh, model.encode_words(fresh)))
            yield {"doc_id": column(batch, "doc_id").slice(lo, len(cuts)), "ids": [[i for w in c for i in ids[w]] for c in cuts]}

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def work(batch: pa.RecordBatch):
        model = load(model_path)
        yield {"doc_id": column(batch, "doc_id"), "text": [model.decode(i or []) for i in column(batch, "ids").to_pylist()]}

    return map_batches(encoded.select("doc_id", "ids"), work, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(model_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                found = encoder.encode([t or "" for t in column(batch, "text").slice(lo, TEXTS).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id").slice(lo, len(found)), pa.array([i.count(",") + 1 if i else 0 for i, _ in found], pa.int64()),
                     pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _ in found]), pa.array([hashlib.sha256(t).hexdigest() for _, t in found])],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
