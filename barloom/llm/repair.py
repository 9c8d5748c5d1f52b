"""Operator 10: token ids in a binary format with Re-Pair grammar compression.

Documents are dealt to shards by ranges of doc_id. In a shard, blocks of whole documents are compressed one by one:
repeated pairs of neighbouring ids are replaced by nonterminals until none is left, and the block stores the rules with
the length each expands to, the shortened sequence, and where each document begins in it. One document is decoded
without touching the others.

Block layout (little-endian): 4 bytes "RPB3"; six u32: bits per symbol, first nonterminal, rules R, documents D, symbols
S, bits per length; then in bits, each array filled up to a whole byte: left[R], right[R] (symbols), length[R]; first
symbol[D + 1] (u32), ids[D] (u32), doc_id[D] (i64, 0 for null); in bits again: null[D], sequence[S] (symbols).
"""

from __future__ import annotations

import bisect
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import prepare, table
from barloom.session import new_path

#: Ids in a block, unless one document has more; documents in a shard, at least: shards and what they hold both grow with the
#: square root of a table of more than its square.
BLOCK_IDS, SHARD_DOCS = 1 << 20, 4096
#: Text that goes through the tokenizer together, about.
TEXT_BYTES = 24 << 20
MAGIC = b"RPB3"


# --- grammar ---


def compress(seq: np.ndarray, last: np.ndarray, first: int, least: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sequence with repeated pairs replaced, where documents end in it, and the rules' left and right symbols.

    Rule k makes symbol first + k. last: which places of the sequence end a document; no pair reaches over one.

    Rounds go on until no pair occurs ``least`` times; of a pair's occurrences that overlap (a a a) every other one from
    the left counts. A round takes the pairs with a quarter of the most frequent one's occurrences or more; where two of
    them overlap, the more frequent one is replaced. One that is left with too few waits for the next round. The most
    frequent pair never waits, so every round replaces or finds that pairs overlap themselves too much for ever.

    Pairs that a round brings hold a symbol that it made, so they are sorted and counted once, among themselves, and lose
    occurrences from then on. A pair has its places in a slice of ``at``, from which those are passed over that no longer
    hold it. So a round's work is that of what it replaces, not of the whole sequence.
    """
    n = len(seq)
    sym, ends = np.zeros(n + 1, np.uint32), np.ones(n + 1, bool)
    sym[:n], ends[:n] = seq, last
    place = np.int32 if n < 1 << 30 else np.int64
    after, before = np.arange(1, n + 2, dtype=place), np.arange(-1, n, dtype=place)
    before[0] = n
    # Place n stands for what is before the first symbol and after the last; pair 0 for none that repeats.
    pair, rank, gone = np.zeros(n + 1, place), np.zeros(n + 1, np.int32), np.zeros(n + 1, bool)
    at = np.empty(3 * n, place)
    used, known = 0, 1
    count, start, long, a, b = np.zeros(1, place), np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint32), np.zeros(1, np.uint32)
    left, right = [], []
    made, low = 0, n.bit_length()

    def enter(begins: np.ndarray) -> None:
        """Count the pairs that begin at these places, none of which has been counted before."""
        nonlocal used, known, count, start, long, a, b
        wide = (first + made).bit_length()
        if 2 * wide + low <= 64:
            key = sym.take(begins).astype(np.uint64)
            key <<= np.uint64(wide)
            key |= sym.take(after.take(begins)).astype(np.uint64)
            key <<= np.uint64(low)
            key |= begins.view(np.uint64)
            key.sort()
            begins = (key & np.uint64((1 << low) - 1)).view(np.intp)
            key >>= np.uint64(low)
        else:
            begins = np.sort(begins)
            key = (sym[begins].astype(np.uint64) << np.uint64(32)) | sym[after[begins]]
            order = np.argsort(key, kind="stable")
            key, begins = key[order], begins[order]
        head = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        size = np.diff(np.r_[head, len(key)])
        often = size >= least
        number = np.zeros(len(head), place)
        number[often] = known + np.arange(np.count_nonzero(often))
        number = np.repeat(number, size)
        held = np.flatnonzero(number)
        begins = begins.take(held)
        pair[begins] = number.take(held)
        at[used : used + len(begins)] = begins
        head, size = head[often], size[often]
        while known + len(size) > len(count):
            count, start, long, a, b = (np.concatenate([x, np.zeros(max(len(x), 1 << 12), x.dtype)]) for x in (count, start, long, a, b))
        to = slice(known, known + len(size))
        count[to], long[to], start[to] = size, size, used + np.cumsum(size) - size
        one = at[start[to]]
        a[to], b[to] = sym[one], sym[after[one]]
        used, known = used + len(begins), known + len(size)

    enter(np.flatnonzero(~ends))
    while (top := int(count[:known].max())) >= least:
        take = np.flatnonzero(count[:known] >= max(least, top // 4))
        take = take[np.argsort(count[take], kind="stable")]
        here = at.take(spread(start[take], long[take]))
        nth = np.repeat(np.arange(1, len(take) + 1, dtype=np.int32), long[take])
        still = np.flatnonzero(pair.take(here) == np.repeat(take.astype(place), long[take]))
        here, nth = here.take(still), nth.take(still)
        twin = np.flatnonzero((a[take] == b[take])[nth - 1]) if (a[take] == b[take]).any() else ()
        if len(twin):
            run, k = here[twin], np.arange(len(twin))
            begins = np.r_[True, (run[1:] != after[run[:-1]]) | (nth[twin[1:]] != nth[twin[:-1]])]
            free = np.ones(len(here), bool)
            free[twin[(k - np.maximum.accumulate(np.where(begins, k, 0))) % 2 == 1]] = False
            here, nth = here[free], nth[free]
            size = np.bincount(nth, minlength=len(take) + 1)[1:]
            count[take[size < least]] = 0  # what is left of it overlaps
            # Ranks go by what can be replaced.
            by = np.empty(len(take), np.int32)
            order = np.argsort(size, kind="stable")
            by[order] = np.arange(1, len(take) + 1)
            take, nth = take[order], by[nth - 1]
        rank[here] = nth
        here = np.sort(here).astype(np.intp)  # neighbours are near in memory
        nth = rank.take(here)
        wins = np.flatnonzero((rank.take(before.take(here)) < nth) & (rank.take(after.take(here)) < nth))
        rank[here] = 0
        here, nth = here.take(wins), nth.take(wins)
        enough = np.bincount(nth, minlength=len(take) + 1) >= least
        enough[0] = False
        if not enough[1:].all():
            wins = enough[nth]
            here, nth = here[wins], nth[wins]
        new = np.flatnonzero(enough)
        if not len(new):
            continue
        name = np.zeros(len(enough), np.uint32)
        name[new] = first + made + np.arange(len(new))
        left.append(a[take[new - 1]].astype(np.int64))
        right.append(b[take[new - 1]].astype(np.int64))
        made += len(new)
        there = after.take(here).astype(np.intp)
        gone[there] = True
        side = before.take(here).astype(np.intp)
        lost = np.concatenate([here, there, side[~gone.take(side)]])
        count[:known] -= np.bincount(pair.take(lost), minlength=known).astype(place)
        pair[lost] = 0
        count[0] = 0
        beyond = after.take(there)
        sym[here], ends[here], after[here] = name.take(nth), ends.take(there), beyond
        before[beyond] = here
        side = before.take(here).astype(np.intp)
        rank[here] = 1
        begins = np.concatenate([here, side[rank.take(side) == 0]])
        rank[here] = 0
        enter(begins[~ends.take(begins)])
    none, stays = np.zeros(0, np.int64), ~gone[:n]
    return sym[:n][stays], ends[:n][stays], np.concatenate(left) if left else none, np.concatenate(right) if right else none


def sizes_and_depths(left: np.ndarray, right: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each rule stands for, and how deep its rules go."""
    need = np.maximum(left, right) - first
    n, stop = len(need), 0
    # After the rules are those of plain ids, which -1 reaches.
    size, depth = np.ones(n + 1, np.int64), np.zeros(n + 1, np.int64)
    while stop < n:  # as many rules as need none of one another
        at, stop, step = stop, stop + 1, 256
        while stop < n:
            hit = np.flatnonzero(need[stop : stop + step] >= at)
            if len(hit):
                stop += int(hit[0])
                break
            stop, step = min(stop + step, n), 2 * step
        a, b = np.maximum(left[at:stop] - first, -1), np.maximum(right[at:stop] - first, -1)
        size[at:stop], depth[at:stop] = size[a] + size[b], 1 + np.maximum(depth[a], depth[b])
    return size[:n], depth[:n]


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def expansions(left: np.ndarray, right: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all symbols one after the other, plain ids first; where each symbol's begin; how many they are."""
    size, depth = sizes_and_depths(left, right, first)
    size = np.r_[np.ones(first, np.int64), size]
    starts = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()), "<u4")
    flat[:first] = np.arange(first)
    for level in range(1, depth.max(initial=0) + 1):
        k = np.flatnonzero(depth == level)
        for child, begin in ((left[k], starts[first + k]), (right[k], starts[first + k] + size[left[k]])):
            flat[spread(begin, size[child])] = flat[spread(starts[child], size[child])]
    return flat, starts, size


def to_bits(values: np.ndarray, width: int) -> bytes:
    """Each value in so many bits, the lowest bit first."""
    bits = np.empty((len(values), width), np.uint8)
    for k in range(width):
        bits[:, k] = (values >> k) & 1
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def from_bits(data: np.ndarray, n: int, width: int) -> np.ndarray:
    bits = np.unpackbits(data, count=n * width, bitorder="little").reshape(n, width)
    out = np.zeros(n, np.int64)
    for k in range(width):
        out |= bits[:, k].astype(np.int64) << k
    return out


class Block:
    """A block's bytes, opened for reading."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a block of this format")
        width, self.first, r, d, s, long = struct.unpack_from("<6I", data, 4)
        at = 28

        def take(n: int, dtype: str) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, dtype, n, at)
            at += out.nbytes
            return out

        def take_bits(n: int, width: int) -> np.ndarray:
            return from_bits(take((n * width + 7) // 8, "u1"), n, width)

        self.left, self.right, self.length = take_bits(r, width), take_bits(r, width), take_bits(r, long)
        self.begin, self.n_ids = take(d + 1, "<u4"), take(d, "<u4")
        self.doc_id, self.null = take(d, "<i8"), take_bits(d, 1).astype(bool)
        self.seq = take_bits(s, width)
        self._table = None

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        if self._table is None:
            self._table = expansions(self.left, self.right, self.first)
        flat, starts, size = self._table
        return flat[spread(starts[seq], size[seq])]

    def ids(self, k: int) -> np.ndarray:
        """Ids of the k-th document of the block."""
        return self._expand(self.seq[self.begin[k] : self.begin[k + 1]])

    def all_ids(self) -> list[np.ndarray]:
        return np.split(self._expand(self.seq), np.cumsum(self.n_ids, dtype=np.int64)[:-1])


def pack(doc_ids: list[int | None], ids: list[np.ndarray], vocab: int) -> bytes:
    """A block of documents, none of which is without ids."""
    sizes = np.array([len(x) for x in ids], np.int64)
    ends = np.zeros(int(sizes.sum()), bool)
    ends[np.cumsum(sizes) - 1] = True
    seq, ends, left, right = compress(np.concatenate(ids), ends, vocab)
    length, _ = sizes_and_depths(left, right, vocab)
    width, long = (vocab + len(left) - 1).bit_length(), int(length.max(initial=1)).bit_length()
    begin = np.r_[0, np.flatnonzero(ends) + 1]
    head = struct.pack("<6I", width, vocab, len(left), len(ids), len(seq), long)
    docs = np.array([d or 0 for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids])
    body = [to_bits(left, width), to_bits(right, width), to_bits(length, long), begin.astype("<u4").tobytes(), sizes.astype("<u4").tobytes(), docs.tobytes(), to_bits(null, 1), to_bits(seq, width)]
    return b"".join([MAGIC, head, *body])


# --- tokens ---


class WordTokenizer:
    """The tokenizers library over units between blanks, each distinct one encoded once while it is remembered.

    The model drops white space and never encodes across it, so a text's ids are those of its units one after the other. A
    batch's units are told apart by Arrow; only distinct ones reach Python, and only unknown ones the library.
    """

    UNITS, CHARS, JOINED = 250_000, 48, 256

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.vocab = self.lib.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if self.vocab < 1 << 16 else "<u4"
        self.width = np.dtype(self.kind).itemsize
        self.closes = np.zeros(self.vocab, bool)
        for token, k in self.lib.get_vocab().items():
            self.closes[k] = token.endswith("</w>")
        #: Units met lately, and those met before that.
        self.new: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def forget(self) -> None:
        self.new, self.old = {"": b""}, {}

    def _each(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.lib.encode_batch_fast(units, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of units of letters only: encoded many to a text and parted where each one's last token ends."""
        groups = [words[k : k + self.JOINED] for k in range(0, len(words), self.JOINED)]
        out: list[bytes] = []
        for group, e in zip(groups, self.lib.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * self.width).tolist()
            if len(ends) != len(group):  # some letter became more than one
                out += self._each(group)
                continue
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip([0, *ends], ends)]
        return out

    def _learn(self, units: list[str]) -> None:
        """Have the ids of all units in ``new``."""
        new, old = self.new, self.old
        ask = []
        for w in units:
            if w not in new:
                ids = old.get(w)
                if ids is None:
                    ask.append(w)
                else:
                    new[w] = ids
        words = [w for w in ask if w.isalpha()]
        rest = [w for w in ask if not w.isalpha()]
        new.update(zip(words, self._words(words)))
        new.update(zip(rest, self._each(rest)))

    def encode_column(self, texts: pa.Array, end: int) -> pa.Array:
        """Ids of whole texts with the end id after each, as bytes; null counts as empty."""
        texts = texts.fill_null("")
        # The library looks for special tokens, and composes letters and accents, before it puts a text in lower case.
        special = np.flatnonzero(pc.match_substring_regex(texts, r"<\||[\x{0300}-\x{036f}]").to_numpy(zero_copy_only=False))
        # The model parts marks from a letter before them; a blank there leaves fewer distinct units.
        parted = pc.replace_substring_regex(pc.ascii_lower(texts), pattern=r"([a-z\x{df}-\x{f6}\x{f8}-\x{ff}])([.,;:!?#*$%&])", replacement=r"\1 \2")
        units = pc.ascii_split_whitespace(parted)
        flat = units.flatten().dictionary_encode()
        distinct = flat.dictionary.to_pylist()
        if len(self.new) > self.UNITS:
            self.old, self.new = self.new, {"": b""}
        self._learn(distinct)
        taken = pa.array(list(map(self.new.__getitem__, distinct)), pa.binary()).take(flat.indices)
        for w in distinct:
            if len(w) > self.CHARS:
                self.new.pop(w, None)
        first = units.offsets.to_numpy().astype(np.int64)
        at = np.frombuffer(taken.buffers()[1], np.int32)[: len(taken) + 1].astype(np.int64) if len(taken) else np.zeros(1, np.int64)
        cut = at[first - first[0]].tolist()
        raw = memoryview(taken.buffers()[2] or b"") if len(taken) else memoryview(b"")
        last = np.array([end], self.kind).tobytes()
        out = [b"".join((raw[a:b], last)) for a, b in zip(cut, cut[1:])]
        if len(special):
            for k, ids in zip(special.tolist(), self._each([texts[k].as_py() for k in special.tolist()])):
                out[k] = ids + last
        return pa.array(out, pa.binary())


_TOKENIZERS: dict[str, WordTokenizer] = {}


def load_tokenizer(path: str | None) -> WordTokenizer:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


# --- writing and reading ---

WRITTEN = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("block", T.IntegerType()),
        T.StructField("before", T.LongType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("data", T.BinaryType()),
    ]
)


def write_token_file(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", model: str | None = None, end: int = 2, shard_docs: int = SHARD_DOCS) -> None:
    """Encode whole texts and write them to ``path`` in ascending order of id_col.

    Each row of the file is a block: shard, block in the shard, ids before it in the shard, its ids, its bytes. The order
    of (shard, block) is that of the ids. A null text is empty: it has the end id alone. Null ids come first; rows with
    the same id come one after the other, in an order that only their token ids decide, and if they are many they take
    several shards. An empty table gives a file without blocks.
    """
    spark = df.sparkSession
    prepare(spark)
    n_docs, n_ids = df.agg(F.count(F.lit(1)), F.count(id_col)).first()
    shard_docs = max(shard_docs, math.isqrt(n_docs))
    shards = max(1, -(-n_ids // shard_docs))
    nulls = -(-(n_docs - n_ids) // shard_docs)
    cuts = [k / shards for k in range(1, shards)]
    # A bound that comes up several times is an id with so many shards of its own.
    bounds = sorted(int(x) for x in df.approxQuantile(id_col, cuts, 1 / (4 * shards))) if cuts and n_ids else []
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(model)
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            docs, ids = part.column(0).combine_chunks(), tok.encode_column(part.column(1).combine_chunks(), end)
            shard = []
            for k, d in enumerate(docs.to_pylist()):
                least, above = (-nulls, 0) if d is None else (bisect.bisect_left(bounds, d), bisect.bisect_right(bounds, d))
                spread = zlib.crc32(ids[k].as_buffer()) * (above - least) >> 32 if above - least > 1 else 0
                shard.append(nulls + least + spread)
            return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), docs, ids], names=["shard", "doc_id", "ids"])

        for b in batches:  # together as many as hold some text, so that distinct units are met once for all of it
            held.append(b)
            if sum(x.nbytes for x in held) >= TEXT_BYTES:
                yield flush()
        if held:
            yield flush()

    dealt = docs.mapInArrow(coded, "shard int, doc_id long, ids binary").repartitionById(nulls + shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "ids")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load_tokenizer(model)
        tok.forget()  # texts are done by now, and grammars need the room
        held: list = []
        size, shard, block, before = 0, None, 0, 0

        def flush():
            nonlocal held, size, block, before
            data = pack([d for d, _ in held], [x for _, x in held], tok.vocab)
            row = pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((shard, pa.int32()), (block, pa.int32()), (before, pa.int64()), (size, pa.int64()), (data, pa.binary()))], names=WRITTEN.names)
            before, block, held, size = before + size, block + 1, [], 0
            return row

        for b in batches:
            for s, d, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if s != shard:
                    if held:
                        yield flush()
                    shard, block, before = s, 0, 0
                ids = np.frombuffer(raw, tok.kind)
                if held and size + len(ids) > BLOCK_IDS:
                    yield flush()
                held.append((d, ids))
                size += len(ids)
        if held:
            yield flush()

    dealt.mapInArrow(blocks, WRITTEN).write.parquet(path)


def read_token_file(spark: SparkSession, path: str) -> DataFrame:
    """All documents of a token file: doc_id, start (ids of all documents before it), n_tokens, ids (u32 bytes)."""
    prepare(spark)
    stored = spark.read.schema(WRITTEN).parquet(path)
    # One number for each shard, thousands of documents: where it begins.
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    first, at = {}, 0
    for r in sorted(totals, key=lambda r: r["shard"]):
        first[r["shard"]] = at
        at += r["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, before, data in zip(*(b.column(c) for c in ("shard", "before", "data"))):
                shard, before, block = shard.as_py(), before.as_py(), Block(data.as_py())
                start = first[shard] + before + np.cumsum(block.n_ids, dtype=np.int64) - block.n_ids
                ids = block.all_ids()
                for k in range(0, len(ids), 256):
                    part = ids[k : k + 256]
                    docs = pa.array(block.doc_id[k : k + 256], mask=block.null[k : k + 256])
                    yield pa.RecordBatch.from_arrays(
                        [docs, pa.array(start[k : k + 256]), pa.array([len(x) for x in part], pa.int64()), pa.array([x.tobytes() for x in part], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"],
                    )

    return stored.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def op10_repair_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = new_path(spark, "barloom/token-file")
    write_token_file(docs, path)
    return read_token_file(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
