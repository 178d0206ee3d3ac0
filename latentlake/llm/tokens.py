"""Operator 8: token ids in training order, as fixed-stride binary shards.

Texts become token ids of a public byte-level vocabulary, each text ended by one separator, and the stream of all ids is cut into sequences of
equal length. A keyed Feistel permutation with cycle-walking gives every sequence a global slot; the slots of one shard are one partition, so
shard ``i`` holds slots ``i * rows .. i * rows + rows - 1`` at fixed offsets and a reader can resume at any slot by arithmetic alone.

Two passes tokenise the texts: one counts ids per input partition, the other deals out the sequences, so ids are shuffled once and never stored
besides the shards. Each partition packs its own texts, in its own order; only its last sequence is padded. The second pass checks
partition by partition that it saw the texts of the first.

Tokenising splits texts as the vocabulary's pattern does and looks every split up once per chunk; the splits themselves go through the
public encoder.

Defined cases: null and empty texts are a separator alone; a text may span many sequences; repeated rows are written again; an empty table
gives no shards and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import sys
import threading
import unicodedata
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parts_for, query, read, scratch_path, typed
from .kernels import U64, chunks, mix, spans_index, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
SEPARATOR = 50_256
SEQUENCE = 2_048
#: Sequences of a shard: 16 MB of two-byte ids.
SHARD_ROWS = 4_096
#: Bytes of sequences that go to a Python worker at once.
BATCH_BYTES = 1 << 20
#: Sequences read from a shard file at once.
SPAN_ROWS = 256
#: Splits and token ids that a worker remembers (about 16 MB in arrays).
CACHE, CACHE_IDS = 1 << 19, 1 << 20
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CONTRACTION = re.compile("'(?:[stmd]|re|ve|ll)")
_LOCK = threading.Lock()
_ENCODERS: dict = {}


class Encoder:
    """Token ids of texts; equal to the public encoder's, with the splitting done on whole chunks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("chunks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        # kinds of code points: 0 other, 1 letter, 2 number, 3 white space
        kinds = np.zeros(sys.maxunicode + 1, np.uint8)
        for c in range(sys.maxunicode + 1):
            g = unicodedata.category(chr(c))[0]
            kinds[c] = 1 if g == "L" else 2 if g == "N" else 0
        kinds[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 3
        self.kinds = kinds
        self._forget()

    def _forget(self) -> None:
        #: hashes of known splits in order; where the ids of each begin in ``flat``, and how many they are
        self.known, self.place, self.width, self.flat = np.zeros(0, U64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids = [self.core._encode_single_piece(x) for x in pieces]
        width = np.array([len(x) for x in ids], np.int32)
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int32, int(width.sum()))
        place = (len(self.flat) + np.cumsum(width) - width).astype(np.int32)
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known, self.place, self.width = (np.insert(old, at, new[order]) for old, new in ((self.known, hashes), (self.place, place), (self.width, width)))
        self.flat = np.concatenate([self.flat, flat])

    def _splits(self, points: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Starts of the splits of texts that begin at ``begins``: runs of one kind; the last white space before something else belongs to it if
        it is a plain space, and is a split of its own otherwise."""
        kind = self.kinds[points]
        start = np.ones(len(points) + 1, bool)
        start[1:-1] = kind[1:] != kind[:-1]
        start[begins] = True
        first = np.zeros(len(points) + 1, bool)
        first[begins] = True
        last = np.flatnonzero((kind[:-1] == 3) & (kind[1:] != 3) & ~first[1:-1])
        start[last] = True
        start[last[points[last] == 32] + 1] = False
        return np.flatnonzero(start[:-1])

    def _fast(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined, size = "".join(texts), np.array([len(t) for t in texts], np.int64)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.cumsum(size) - size
        at = self._splits(points, begins[size > 0])
        end = np.concatenate([at[1:], [len(points)]])
        place = (np.arange(len(points)) - np.repeat(at, end - at)).astype(U64)
        hashes = np.add.reduceat(mix(points.astype(U64) + (place << U64(32))), at)
        codes, unique = pd.factorize(hashes)
        where = np.empty(len(unique), np.int64)
        where[codes[::-1]] = np.arange(len(codes))[::-1]
        if len(self.known) > CACHE or len(self.flat) > CACHE_IDS:
            self._forget()
        near = np.minimum(np.searchsorted(self.known, unique), max(len(self.known) - 1, 0))
        new = np.flatnonzero(self.known[near] != unique) if len(self.known) else np.arange(len(unique))
        if len(new):
            first = where[new]
            self._learn(unique[new], [joined[a:b] for a, b in zip(at[first].tolist(), end[first].tolist(), strict=True)])
        row = np.searchsorted(self.known, unique)[codes]
        each = self.width[row].astype(np.int64)
        upto = np.concatenate([[0], np.cumsum(each)])
        edge = upto[np.searchsorted(at, np.concatenate([begins, [len(points)]]))]
        return self.flat[spans_index(self.place[row].astype(np.int64), each)], np.diff(edge)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each). Texts with contractions, which the pattern splits by rules of their own, go to the encoder whole."""
        slow = [i for i, t in enumerate(texts) if _CONTRACTION.search(t)]
        if not slow:
            return self._fast(texts) if any(texts) else (np.zeros(0, np.int32), np.zeros(len(texts), np.int64))
        skip = set(slow)
        ids, counts = self._fast([t for i, t in enumerate(texts) if i not in skip]) if any(t for i, t in enumerate(texts) if i not in skip) else (np.zeros(0, np.int32), np.zeros(len(texts) - len(skip), np.int64))
        ends, pieces, all_counts, k = np.cumsum(counts), [], [], 0
        for i, t in enumerate(texts):
            if i in skip:
                part = np.array(self.core.encode_ordinary(t), np.int32)
            else:
                part = ids[ends[k] - counts[k] : ends[k]]
                k += 1
            pieces.append(part)
            all_counts.append(len(part))
        return np.concatenate(pieces), np.array(all_counts, np.int64)


def encoder(path: str) -> Encoder:
    with _LOCK:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        return _ENCODERS[path]


class Feistel:
    """Keyed permutation of ``0 .. n - 1``: four balanced rounds on the least even number of bits, walked on while outside."""

    def __init__(self, n: int, key: int, rounds: int = 4):
        self.n, self.rounds = n, rounds
        self.half = max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.keys = mix(np.arange(rounds, dtype=U64) + mix(np.array([key % (1 << 64)], U64)))

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        bits, mask = U64(self.half), U64((1 << self.half) - 1)
        left, right = x >> bits, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        return (right << bits) | left

    def _walk(self, x, keys) -> np.ndarray:
        x = self._once(np.asarray(x, U64), keys)
        while True:
            out = np.flatnonzero(x >= U64(self.n))
            if not len(out):
                return x.astype(np.int64)
            x[out] = self._once(x[out], keys)

    def forward(self, x) -> np.ndarray:
        return self._walk(x, self.keys)

    def backward(self, y) -> np.ndarray:
        """Sequence of a slot: the rounds read the same in reverse because the halves end swapped."""
        return self._walk(y, self.keys[::-1])


def _digest(digest: int, texts: int, counts: np.ndarray) -> int:
    """Digest of the numbers of ids of the texts so far, however they are cut into batches."""
    place = np.arange(texts, texts + len(counts), dtype=U64)
    return (digest + int(mix(counts.astype(U64) + (place << U64(32))).sum(dtype=U64))) % (1 << 64)


def _counted(vocabulary: str):
    def work(batches):
        part, texts, ids, digest = TaskContext.get().partitionId(), 0, 0, 0
        for b in chunks(batches, "text"):
            rows = [t or "" for t in b.column("text").to_pylist()]
            _, counts = encoder(vocabulary).encode(rows)
            digest = _digest(digest, texts, counts)
            texts, ids = texts + len(rows), ids + int(counts.sum()) + len(rows)
        if texts:
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.int64()) for x in (part, texts, ids)), pa.array([str(digest)])], ["part", "texts", "ids", "digest"])

    return work


def _dealt(vocabulary: str, length: int, parts: dict, feistel: Feistel, separator: int):
    """Sequences of a partition with their slots: (slot, ids as bytes, number of ids that are not padding, first text, texts begun)."""
    names = ["slot", "ids", "used", "first_doc", "docs"]

    def work(batches):
        part = TaskContext.get().partitionId()
        ordinal, texts, total, digest = 0, 0, 0, 0
        held, owners = np.zeros(0, np.uint16), []  # ids not yet in a sequence; (offset in them, doc_id) of the texts that begin there

        def batch(block, last):
            nonlocal ordinal, held, owners
            n = len(block) // length
            slots = feistel.forward(np.arange(ordinal, ordinal + n) + parts[part][0])
            begun = np.array([o for o, _ in owners], np.int64)
            at = np.searchsorted(begun, np.arange(n + 1) * length)
            lead = [owners[i][1] if i < j else None for i, j in zip(at[:-1], at[1:], strict=True)]
            used = np.full(n, length)
            if last is not None:
                used[-1] = last
            flat = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.array(np.arange(n + 1, dtype=np.int32) * 2 * length).buffers()[1], pa.py_buffer(block.tobytes())])
            ordinal += n
            return pa.RecordBatch.from_arrays([pa.array(slots), flat, pa.array(used, pa.int32()), pa.array(lead, pa.int64()), pa.array(np.diff(at), pa.int32())], names)

        for b in chunks(batches, "text"):
            rows = [t or "" for t in b.column("text").to_pylist()]
            ids, counts = encoder(vocabulary).encode(rows)
            digest = _digest(digest, texts, counts)
            texts, total = texts + len(rows), total + int(counts.sum()) + len(rows)
            ends = np.cumsum(counts)
            stream = np.insert(ids, ends, separator).astype(np.uint16)
            begins = ends - counts + np.arange(len(counts))
            owners += [(len(held) + int(o), d) for o, d in zip(begins, b.column("doc_id").to_pylist(), strict=True)]
            held = np.concatenate([held, stream])
            whole = len(held) // length * length
            if whole:
                yield batch(held[:whole], None)
                held = held[whole:]
                owners = [(o - whole, d) for o, d in owners if o >= whole]
        if len(held):
            yield batch(np.concatenate([held, np.full(length - len(held), separator, np.uint16)]), len(held))
        if part in parts and (texts, total, str(digest)) != tuple(parts[part][1:]) or part not in parts and texts:
            raise RuntimeError(f"partition {part} changed between the passes")

    return work


def _shards(root: str, length: int, rows: int):
    """Writes each shard of a partition under a name of its own and then moves it, so a repeated task leaves one whole file."""

    def work(batches):
        import pyarrow.fs

        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        fs.create_dir(base, recursive=True)
        out, shard, done, name, at = None, None, [], None, 0

        def close():
            out.close()
            fs.move(name, f"{base}/shard-{shard:06d}.bin")

        for b in batches:
            slots = b.column("slot").to_numpy()
            content, offsets = text_bytes(b.column("ids"))  # no copy: a run of slots is a run of bytes
            edges = np.flatnonzero(np.diff(slots // rows)) + 1 if len(slots) else ()
            for i, j in itertools.pairwise([0, *edges, len(slots)]):
                if i < j and slots[i] // rows != shard:
                    if out is not None:
                        close()
                    shard, at = int(slots[i]) // rows, int(slots[i]) // rows * rows
                    name = f"{base}/.tmp-{shard:06d}-{uuid.uuid4().hex}"
                    out = fs.open_output_stream(name)
                if not (slots[i:j] == at + np.arange(j - i)).all():
                    raise RuntimeError(f"a slot of shard {shard} is missing")
                out.write(content[offsets[i] : offsets[j]])
                at += j - i
            # copies, as views would keep the ids of the whole batch in memory
            index = b.select(["slot", "used", "first_doc", "docs"])
            done.append(index.take(pa.array(np.arange(b.num_rows))))
        if out is not None:
            close()
        yield from done

    return work


@contextmanager
def _small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Sequences are wide rows: fewer of them go to Python at once while a job inside runs."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_shards(docs: DataFrame, root: str, vocabulary: str = VOCABULARY, length: int = SEQUENCE, rows: int = SHARD_ROWS, key: int = 20_24, separator: int = SEPARATOR) -> DataFrame:
    """Write the shards under ``root`` and return their index (slot, used, first_doc, docs), which is stored beside them.

    ``docs`` (doc_id, text) must give the same partitions when read twice, as files do; the job stops if it does not.
    """
    spark: SparkSession = docs.sparkSession
    rows_of = typed(docs, doc_id="long", text="string")
    found = rows_of.select("text").mapInArrow(_counted(vocabulary), "part long, texts long, ids long, digest string").collect()  # a row per input partition
    parts, n = {}, 0
    for r in sorted(found):
        parts[r["part"]] = (n, r["texts"], r["ids"], r["digest"])
        n += -(-r["ids"] // length)
    if not n:
        return spark.createDataFrame([], "slot long, used int, first_doc long, docs int")
    feistel = Feistel(n, key)
    dealt = rows_of.mapInArrow(_dealt(vocabulary, length, parts, feistel, separator), "slot long, ids binary, used int, first_doc long, docs int")
    shards = -(-n // rows)
    placed = dealt.repartitionById(shards, F.floor(F.col("slot") / rows).cast("int")).sortWithinPartitions("slot")
    with _small_batches(spark, max(1, BATCH_BYTES // (2 * length))):
        placed.mapInArrow(_shards(root, length, rows), "slot long, used int, first_doc long, docs int").write.parquet(f"{root}/_index")
    return spark.read.parquet(f"{root}/_index")


def read_shards(spark: SparkSession, root: str, n: int, length: int = SEQUENCE, rows: int = SHARD_ROWS) -> DataFrame:
    """(slot, shard, at, sha256) of the ``n`` sequences, read from the shard files by their stride, ``SPAN_ROWS`` at a time."""
    each, stride = min(SPAN_ROWS, rows), 2 * length
    shards, spans = -(-n // rows), -(-rows // each)

    def work(batches):
        import pyarrow.fs

        fs, base = pyarrow.fs.FileSystem.from_uri(root)
        for b in batches:
            for i in b.column("id").to_pylist():
                shard, begin = i // spans, i % spans * each
                count = min(each, rows - begin, n - shard * rows - begin)
                if count <= 0:
                    continue
                with fs.open_input_file(f"{base}/shard-{shard:06d}.bin") as f:
                    if f.size() != min(rows, n - shard * rows) * stride:
                        raise ValueError(f"shard {shard} does not hold the sequences meant")
                    f.seek(begin * stride)
                    held = memoryview(f.read(count * stride))
                at = begin + np.arange(count)
                sums = [hashlib.sha256(held[j * stride : (j + 1) * stride]).hexdigest() for j in range(count)]
                yield pa.RecordBatch.from_arrays([pa.array(shard * rows + at), pa.array(np.full(count, shard)), pa.array(at * stride), pa.array(sums)], ["slot", "shard", "at", "sha256"])

    parts = parts_for(spark, n * stride, 32 << 20)
    return spark.range(0, shards * spans, 1, parts).mapInArrow(work, "slot long, shard long, at long, sha256 string")


def read_from(root: str, slot: int, count: int, length: int = SEQUENCE, rows: int = SHARD_ROWS) -> np.ndarray:
    """``count`` sequences from ``slot`` on, by offset: what a resumed reader does."""
    import pyarrow.fs

    fs, base = pyarrow.fs.FileSystem.from_uri(root)
    out = []
    while len(out) < count:
        with fs.open_input_file(f"{base}/shard-{slot // rows:06d}.bin") as f:
            f.seek(slot % rows * 2 * length)
            take = min(count - len(out), rows - slot % rows)
            block = np.frombuffer(f.read(take * 2 * length), np.uint16).reshape(-1, length)
        if not len(block):
            break
        out += list(block)
        slot += len(block)
    return np.array(out)


def ordered_sequences(docs: DataFrame, root: str, **options) -> DataFrame:
    """Write, read back, and join the index to what the files hold: one row per sequence."""
    index = write_shards(docs, root, **options)
    kept = {k: v for k, v in options.items() if k in ("length", "rows")}
    return read_shards(docs.sparkSession, root, index.count(), **kept).join(index, "slot")


def shared_uri(path: str) -> str:
    """``path`` as a full URI, for readers outside Spark; without a scheme it is a path of the default file system, as Spark takes it."""
    spark = SparkSession.active()
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    full = of.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(of).toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


@query("op8_training_order")
def op8(spark, sf):
    return ordered_sequences(read(spark, sf, "documents"), shared_uri(scratch_path(spark, "shards")))
