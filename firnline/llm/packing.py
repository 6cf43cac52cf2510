"""Best-fit packing of token pieces into sequences after dominance reduction.

Documents become token ids and an end id; longer ones are cut into pieces of a full sequence, the rest is their last piece. The packing
problem depends only on how many pieces there are of each length, at most `capacity` numbers, so the plan is made on these
counts: where a set of up to three pieces provably dominates every other set with one of them (Martello and Toth), it is
fixed as a sequence, as often as its lengths allow, from the largest length to the smallest and over again until no such set is left; the pieces left are packed by best fit in order of decreasing length, equal sequences
together. The plan has rows (length, from rank, to rank, first sequence, offset). Pieces get their rank among those of their
length (counted by length and bucket, buckets numbered by hash) and find their row by it.

Defined cases: NULL counts as the empty text, whose one token is the end id; repeated ids are packed per row; an empty table gives an
empty result; other columns are ignored. Every token of every text is in exactly one sequence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firnline.llm.common import WordCache, column, crc, spread, stored

CAPACITY = 2048
END_ID = 0
CACHE_WORDS = 1 << 18
#: Pieces that are ranked in one bucket of a length, about.
BUCKET_ROWS = 200_000

# Characters of which the tokenizer's normal form is the lower case, so that a text can be looked up chunk by chunk between blanks.
# Texts with any other character, or with what might be a special token, go through the tokenizer as a whole.
_PLAIN = re.compile("[^\t\n\x0b\x0c\r -~À-ÖØ-öø-ÿ¡¿«»]|<\\|")
# Where the tokenizer's splitting rule cuts such a chunk, contractions aside: around digits, and between letters and marks.
_LETTERS = "a-zß-öø-ÿ"
_CUTS = re.compile(f"(?<=[{_LETTERS}])(?=[^\\s{_LETTERS}])|(?<=[^\\s{_LETTERS}])(?=[{_LETTERS}])|(?<=[0-9])(?=\\S)|(?<=\\S)(?=[0-9])")
# Marks side by side, which are one word, or an apostrophe.
_MARKS = re.compile(f"[^\\s{_LETTERS}0-9][^\\s{_LETTERS}0-9]|'")
#: Chunks that the tokenizer gets as one text, and texts that are worked on together.
CHUNKS = 2000
TEXTS = 512


class ChunkEncoder:
    """Little-endian 32-bit ids of texts; a chunk between blanks is encoded by the tokenizer once and remembered.

    New chunks go through the tokenizer's merges many at a time, their words already cut and in its byte alphabet: a word ends with a
    token that carries the end-of-word mark. Chunks with an apostrophe go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        mark = self.tokenizer.model.end_of_word_suffix
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(mark)]] = True
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: alphabet.pre_tokenize_str(chr(c))[0][0] for c in (*range(0x21, 0x7F), *range(0xA1, 0x100))}
        self.cache = WordCache(CACHE_WORDS, self._chunks)

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for lo in range(0, len(chunks), CHUNKS):
            some = chunks[lo : lo + CHUNKS]
            text = "\n".join(some)
            marked = [i for i, c in enumerate(some) if "'" in c] if "'" in text else []
            if marked:
                text = "\n".join(["" if "'" in c else c for c in some])
            text = _CUTS.sub(" ", text)
            # Words so far at the end of each chunk.
            codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
            upto = np.cumsum((codes == 10) | (codes == 32))[np.append(np.flatnonzero(codes == 10), len(codes) - 1)] + np.append(np.zeros(len(some) - 1, dtype=int), 1) if len(codes) else np.zeros(len(some), dtype=int)
            upto = upto - np.cumsum(np.isin(np.arange(len(some)), marked))
            [found] = self.words.encode_batch_fast([text.translate(self.letters)], add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4")
            ends = np.append(-1, np.flatnonzero(self.ends[ids]))
            if len(ends) - 1 != upto[-1]:
                out += self._whole(some)
                continue
            cuts = (4 * (ends[upto] + 1)).tolist()
            data = ids.tobytes()
            made = list(map(data.__getitem__, map(slice, [0, *cuts], cuts)))
            if marked:
                for i, ids_of in zip(marked, self._whole([some[i] for i in marked])):
                    made[i] = ids_of
            out += made
        return out

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Chunks of a text. Single marks are words of their own for the tokenizer: cut off, they leave fewer different chunks."""
        if not _MARKS.search(text):
            text = text.replace(",", " ,").replace(".", " .")
        return text.split()

    def encode(self, texts: list[str]) -> list[bytes]:
        plain = [None if _PLAIN.search(t) else self._cut(t.lower()) for t in texts]
        known = self.cache.of(set().union(*(c for c in plain if c is not None)))
        whole = iter(self._whole([t for t, c in zip(texts, plain) if c is None]))
        return [next(whole) if c is None else b"".join(map(known.__getitem__, c)) for c in plain]


@lru_cache(maxsize=1)
def _encoder(path: str) -> ChunkEncoder:
    """One for all tasks of a Python worker, so that words stay known."""
    return ChunkEncoder(path)


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32) of every piece of every text; row tells repeated ids apart."""
    end = np.array([end_id], dtype="<u4").tobytes()
    full = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                texts = [t or "" for t in column(batch, "text").slice(lo, TEXTS).to_pylist()]
                which, piece, length, sums = [], [], [], []
                for i, ids in enumerate(encoder.encode(texts), lo):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), full)):
                        part = ids[at : at + full]
                        which.append(i)
                        piece.append(k)
                        length.append(len(part) // 4)
                        sums.append(crc(part))
                take, piece = pa.array(which, pa.int64()), np.array(piece, dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [column(batch, "doc_id").take(take), column(batch, "row").take(take), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(length, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "row", "piece", "start", "length", "ids_crc32"],
                )

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, "doc_id long, row long, piece int, start long, length long, ids_crc32 long")


def _dominating(counts: dict[int, int], lengths: list[int], capacity: int, large: int) -> tuple[int, ...] | None:
    """A length with up to two more whose set dominates every set with that length, or None. lengths ascend."""
    left = dict(counts)
    left[large] -= 1
    space = capacity - large
    usable = [x for x in lengths if x <= space and left[x] > 0]
    if not usable:
        return (large,)
    best = usable[-1]
    # Smallest sums of two and of three pieces that could join.
    small: list[int] = []
    for x in usable:
        small += [x] * min(left[x], 3 - len(small))
        if len(small) >= 3:
            break
    # A single piece that fills the space stands for any pieces in it; or only one piece fits.
    if best == space or len(small) < 2 or small[0] + small[1] > space:
        return (large, best)
    if len(small) >= 3 and sum(small) <= space:
        return None
    # At most two pieces fit: pairs (larger, smaller) of which no other has both larger.
    pairs = []
    reach = len(usable) - 1
    for x in usable:
        while reach >= 0 and usable[reach] + x > space:
            reach -= 1
        k = reach
        if k >= 0 and usable[k] == x and left[x] < 2:
            k -= 1
        if k >= 0:
            pairs.append((max(x, usable[k]), min(x, usable[k])))
    most_sum = max(a + b for a, b in pairs)
    if best >= most_sum:
        return (large, best)
    a, b = max(pairs)
    if best <= a and all((x <= a and y <= b) or x + y <= a for x, y in pairs):
        return (large, a, b)
    return None


def reduce_instance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Sets that dominate all others with one of their pieces, and how often they are fixed; then the counts that are left.

    All lengths are gone through from the largest on, again and again until none has a dominating set: what is fixed makes room for more.
    """
    counts = {k: n for k, n in counts.items() if n}
    fixed, found_any = [], True
    while found_any:
        found_any = False
        for large in sorted(counts, reverse=True):
            while large in counts and (found := _dominating(counts, sorted(counts), capacity, large)):
                need = Counter(found)
                # The set dominates again as long as its pieces are there: taking pieces away only removes sets.
                times = min(counts[k] // n for k, n in need.items())
                fixed.append((found, times))
                found_any = True
                for k, n in need.items():
                    counts[k] -= n * times
                    if not counts[k]:
                        del counts[k]
    return fixed, counts


def fixed_pieces(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[int, int]:
    """How many pieces the reduction fixes, and how many there are."""
    fixed, _ = reduce_instance(counts, capacity)
    return sum(len(found) * times for found, times in fixed), sum(counts.values())


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit by decreasing length over counts: equal sequences as one ([(length, pieces)], number of sequences)."""
    groups: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for length in sorted(counts, reverse=True):
        n = counts[length]
        for space in sorted(s for s in groups if s >= length):
            # A sequence stays the fullest that fits until it takes no more pieces of this length.
            while n and groups.get(space):
                made, many = groups[space].pop()
                each = min(space // length, n)
                filled = min(many, n // each)
                if filled < many:
                    groups[space].append((made, many - filled))
                groups.setdefault(space - each * length, []).append((made + [(length, each)], filled))
                n -= each * filled
            if not n:
                break
        while n:
            each = min(capacity // length, n)
            filled = n // each
            groups.setdefault(capacity - each * length, []).append(([(length, each)], filled))
            n -= each * filled
    return [g for same in groups.values() for g in same]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, pieces of it in a sequence, offset of the first of them).

    At most a few rows per length and pattern, whatever the counts are.
    """
    fixed, left = reduce_instance(counts, capacity)
    patterns = [([(k, n) for k, n in sorted(Counter(found).items(), reverse=True)], times) for found, times in fixed]
    patterns += best_fit(left, capacity)
    rows, used, sequence = [], Counter(), 0
    for parts, times in patterns:
        offset = 0
        for length, each in parts:
            rows.append((length, used[length], used[length] + each * times, sequence, each, offset))
            used[length] += each * times
            offset += each * length
        sequence += times
    return rows


def ranked(cut: DataFrame) -> DataFrame:
    """cut with a rank from 0 among the pieces of equal length: counts by (length, bucket) summed up, then places in a bucket."""
    buckets = spread(cut, BUCKET_ROWS, cut.count())
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("row", "piece"), F.lit(buckets)))
    sizes = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("row", "piece")) - 1
    return cut.withColumn("inside", inside).join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    spark = docs.sparkSession
    cut = stored(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    # At most `capacity` rows.
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Rows by length as sorted arrays: a piece searches the last row that begins at or before its rank.
    by_length: dict[int, list] = {}
    for length, lo, hi, sequence, each, offset in plan(counts, capacity):
        by_length.setdefault(length, []).append((lo, sequence, each, offset))
    rows = spark.createDataFrame(
        [(k, [v[0] for v in sorted(vs)], [tuple(v) for v in sorted(vs)]) for k, vs in by_length.items()],
        "length long, begins array<long>, places array<struct<lo: long, sequence: long, each: long, offset: long>>",
    )
    # As many rows as there are lengths, at most `capacity`.
    placed = ranked(cut).join(F.broadcast(rows), "length")
    row = F.element_at("places", F.size(F.filter("begins", lambda b: b <= F.col("rank"))))
    placed = placed.withColumn("place", row).withColumn("at", F.col("rank") - F.col("place.lo"))
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("place.sequence") + F.floor(F.col("at") / F.col("place.each"))).cast("long").alias("sequence_id"),
        (F.col("place.offset") + F.col("at") % F.col("place.each") * F.col("length")).cast("long").alias("offset"),
    )
