"""Token ids as fixed-width bit-packed files.

File format (little-endian), one file image per shard:

    8 bytes  magic ``LSTOKEN1``
    u32      bits per id (the least that holds the vocabulary)
    u32      ids per block
    u64      number of ids
    u64      number of documents
    u64 *    offsets of the blocks in bytes from the start of the packed area
    u64 *    first id of each document within the shard, then the number of ids
    ...      the blocks: ids packed at the fixed width, low bits first

A block holds ``BLOCK`` ids, so it starts at a whole byte: any id is read by
its block's offset without unpacking others.

The shards are the rows of a table (payload: the file image), written by
Spark's committer to the shared folder: a lost executor's task is done again,
and any Spark reader opens them.  ``export`` writes them as files.

Documents are dealt by ranges of their id and sorted within a range, so shards
in order hold the documents in order.  Only one sum per range goes to the
driver, to place the ranges.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAGIC = b"LSTOKEN1"
BLOCK = 4096  # ids in a block; a multiple of 8
SHARD = 1 << 20  # ids in a shard, at least, but for the last of a range
END = 2
_HEAD = struct.Struct("<8sIIQQ")


def width(vocabulary: int) -> int:
    """The least bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids at a fixed width, low bits first."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for i in range(0, len(ids), 1 << 16):  # bounds the bit matrix
        part = ids[i : i + (1 << 16)].astype(np.uint64)
        each = (part[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        out.append(np.packbits(each.astype(np.uint8).ravel(), bitorder="little").tobytes())
    return b"".join(out)


def unpack(raw: bytes, bits: int, n: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    out = []
    for i in range(0, n, 1 << 16):
        k = min(n - i, 1 << 16)
        part = np.frombuffer(raw, np.uint8, (k * bits + 7) // 8, i * bits // 8)
        each = np.unpackbits(part, bitorder="little", count=k * bits).reshape(k, bits)
        out.append((each.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def to_file(ids: np.ndarray, starts: np.ndarray, bits: int) -> bytes:
    """A file image; ``starts``: the first id of each document, then the end."""
    blocks = [pack(ids[i : i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)])[:-1] if blocks else np.zeros(0)
    head = _HEAD.pack(MAGIC, bits, BLOCK, len(ids), len(starts) - 1)
    return b"".join([head, offsets.astype("<u8").tobytes(), np.asarray(starts).astype("<u8").tobytes(), *blocks])


class Reader:
    """Random access to a file image."""

    def __init__(self, raw: bytes):
        magic, self.bits, self.block, self.n_ids, self.n_docs = _HEAD.unpack_from(raw)
        if magic != MAGIC:
            raise ValueError("not a token file")
        n = -(-self.n_ids // self.block)
        self.raw = memoryview(raw)
        self.offsets = np.frombuffer(raw, "<u8", n, _HEAD.size)
        self.starts = np.frombuffer(raw, "<u8", self.n_docs + 1, _HEAD.size + 8 * n)
        self.at = _HEAD.size + 8 * n + 8 * (self.n_docs + 1)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids first .. last - 1; unpacks the blocks that hold them only."""
        if last <= first:
            return np.zeros(0, np.uint32)
        a, b = first // self.block, (last - 1) // self.block
        parts = []
        for k in range(a, b + 1):
            n = min(self.block, self.n_ids - k * self.block)
            parts.append(unpack(self.raw[self.at + int(self.offsets[k]) :], self.bits, n))
        return np.concatenate(parts)[first - a * self.block : last - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.starts[k]), int(self.starts[k + 1]))


class Encoder:
    """Byte-level BPE ids of whole texts by the tokenizers library.

    The library cuts a text into pre-tokens and encodes each by itself, so
    every different pre-token is encoded once and kept.  Texts of well-known
    characters are cut here, all bytes of a batch at once, and a pre-token is looked
    up once a batch; a text with any other character, or with one of the file's added
    tokens (the library cuts those out first), is encoded whole.  New pre-tokens
    are encoded many at a time with line feeds between them.
    """

    KEEP = 700_000  # pre-tokens: some 150 MB
    LINE = 198  # the id of a line feed
    PART = 1 << 24  # bytes that are cut at once, or one text
    _OTHER, _LETTER, _DIGIT, _MARK, _SPACE, _FEED = range(6)
    _CLASS = np.zeros(256, np.uint8)  # of a byte; letters are ASCII's and U+00C0 .. U+017F but for two signs
    for _bytes, _class in ((b"0123456789", _DIGIT), (b"!\"#$%&()*+,./:;<=>?@[]^_`{|}~\\-", _MARK), (b" ", _SPACE), (b"\n", _FEED), (bytes([*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]), _LETTER)):
        _CLASS[list(_bytes)] = _class

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.added = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.words: dict[bytes, int] = {}  # places in ``ends``
        self.ids, self.ends = np.zeros(1 << 16, "<u4"), np.zeros(1 << 14, np.int64)  # ids of all words; where those of a word end

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, words: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, used = len(self.words), int(self.ends[len(self.words) - 1]) if self.words else 0
        for name, need in (("ids", used + len(ids)), ("ends", n + len(words))):
            if need > len(getattr(self, name)):
                setattr(self, name, np.resize(getattr(self, name), 2 * need))
        self.ids[used : used + len(ids)] = ids
        self.ends[n : n + len(words)] = used + np.cumsum(lengths)
        self.words.update(zip(words, range(n, n + len(words)), strict=True))

    def _learn(self, words: list[bytes]) -> None:
        spaces = [w for w in words if not w.strip(b" \n")]
        if spaces:
            coded = self._plain([w.decode() for w in spaces])
            self._keep(spaces, np.frombuffer(b"".join(coded), "<u4"), np.array([len(c) // 4 for c in coded]))
        new = [w for w in words if w.strip(b" \n")]
        groups = [new[i : i + 200] for i in range(0, len(new), 200)]
        for group, e in zip(groups, self.model.encode_batch_fast([b"\n".join(g).decode() for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            feeds = ids == self.LINE
            self._keep(group, ids[~feeds], np.diff([-1, *np.flatnonzero(feeds).tolist(), len(ids)]) - 1)

    def _cut(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where the pre-tokens of texts of known characters start: ``" ?[letters]+"``,
        likewise digits and marks, and white space but for a space before those."""
        kind = self._CLASS[data]
        white = kind >= self._SPACE
        before = np.concatenate([[False], white[:-1]])
        after = np.concatenate([~white[1:], [False]])  # a byte of the same text that is not white
        after[ends[ends > 0] - 1] = False
        changed = np.concatenate([[True], kind[1:] != kind[:-1]])
        spaced = np.concatenate([[False], kind[:-1] == self._SPACE])
        starts = np.where(white, ~before | after, changed & ~spaced)
        starts[ends[ends < len(data)]] = True
        starts[:1] = True
        return np.flatnonzero(starts)

    def _known(self, raws: list[bytes]) -> list[bytes]:
        """The ids of texts of known characters."""
        raw, ends = b"".join(raws), np.cumsum([len(r) for r in raws])
        at = self._cut(np.frombuffer(raw, np.uint8), ends)
        offsets = np.append(at, len(raw)).astype(np.int32)
        cut = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        distinct = cut.dictionary
        own, marks = distinct.buffers()[2].to_pybytes(), np.frombuffer(distinct.buffers()[1], np.int32, len(distinct) + 1).tolist()
        words = [own[a:b] for a, b in zip(marks, marks[1:], strict=False)]
        if len(self.words) > self.KEEP:
            self._clear()
        found = list(map(self.words.get, words))
        if None in found:
            self._learn([w for w, k in zip(words, found, strict=True) if k is None])
            found = [self.words[w] if k is None else k for w, k in zip(words, found, strict=True)]
        place = np.array(found, np.int64)
        first = np.where(place > 0, self.ends[place - 1], 0)
        which = cut.indices.to_numpy()
        lengths = (self.ends[place] - first)[which]
        last = np.cumsum(lengths)
        ids = self.ids[np.repeat(first[which] - last + lengths, lengths) + np.arange(last[-1])].tobytes()
        stop = np.append(0, last)[np.searchsorted(at, ends)] * 4  # the pre-tokens before the end of each text
        return [ids[a:b] for a, b in zip([0, *stop.tolist()], stop.tolist(), strict=False)]

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian u32."""
        out: list[bytes] = [b""] * len(texts)
        plain, known, size = [], [], 0
        raws = [t.encode() for t in texts]

        def flush() -> None:
            nonlocal known, size
            for i, ids in zip(known, self._known([raws[i] for i in known]) if known else (), strict=True):
                out[i] = ids
            known, size = [], 0

        for i, raw in enumerate(raws):
            if any(x in texts[i] for x in self.added) or not self._is_known(raw):
                plain.append(i)
            elif raw:
                if known and size + len(raw) > self.PART:
                    flush()
                known.append(i)
                size += len(raw)
        flush()
        for i, ids in zip(plain, self._plain([texts[i] for i in plain]), strict=True):
            out[i] = ids
        return out

    _KNOWN = bytes(np.flatnonzero(_CLASS).astype(np.uint8))

    def _is_known(self, raw: bytes) -> bool:
        # Continuation bytes follow a lead byte, so those of other letters are found by theirs.
        return not raw.translate(None, self._KNOWN) and b"\xc3\x97" not in raw and b"\xc3\xb7" not in raw


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, so that its pieces serve later tasks too."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, tokenizer: str, vocabulary: int, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of shards: part, shard, before, n_ids, doc_ids, payload.

    Documents in ascending id (nulls first, equal ids by text), null text as
    empty: only the end id.  ``before``: the ids of the part before the shard.
    No rows, no shards.
    """
    bits = width(vocabulary)
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"), "text")
    counts = T.StructType.fromDDL("part int, shard int, before long, n_ids long").fields
    schema = T.StructType([*counts, T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("payload", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        out, part, encode = to_arrow_schema(schema), TaskContext.get().partitionId(), encoder(tokenizer)
        tail = np.array([end], "<u4").tobytes()
        ids, coded, shard, before, size = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, coded, shard, before, size
            flat = np.frombuffer(b"".join(coded), "<u4")
            starts = np.cumsum([0, *(len(c) // 4 for c in coded)])
            row = {"part": part, "shard": shard, "before": before, "n_ids": len(flat), "doc_ids": ids, "payload": to_file(flat, starts, bits)}
            ids, coded, shard, before, size = [], [], shard + 1, before + len(flat), 0
            return pa.RecordBatch.from_pylist([row], out)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                piece = batch.slice(i, 256)
                for own, c in zip(piece.column(0).to_pylist(), encode(piece.column(1).to_pylist()), strict=True):
                    ids.append(own)
                    coded.append(c + tail)
                    size += len(coded[-1]) // 4
                    if size >= SHARD:
                        yield flush()
        if ids:
            yield flush()

    return common.written(rows.mapInArrow(run, schema), "tokens")


def read(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, bits from the written files."""
    context = shards.sparkSession
    totals = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # a row per range of the sort
    starts, total = [], 0
    for part, n in totals:
        starts.append((part, total))
        total += n
    base = context.createDataFrame(starts, "part int, base long")
    rows = shards.join(base, "part").select((F.col("base") + F.col("before")).alias("start"), "doc_ids", "payload")
    id_type = shards.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), *T.StructType.fromDDL("start long, n_tokens long, ids_crc32 long, bits int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                first, doc_ids, raw = (batch.column(c)[i] for c in range(3))
                file = Reader(raw.as_buffer().to_pybytes())
                flat = file.ids(0, file.n_ids)
                at = file.starts.tolist()
                crc = [zlib.crc32(flat[a:b].astype("<u4").tobytes()) for a, b in zip(at, at[1:], strict=False)]
                values = [doc_ids.values, pa.array([first.as_py() + a for a in at[:-1]]), pa.array(np.diff(file.starts).astype(np.int64)), pa.array(crc, pa.int64()), pa.array([file.bits] * len(crc), pa.int32())]
                yield pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, out, strict=True)], schema=out)

    return rows.mapInArrow(run, schema)


def export(shards: DataFrame, folder: str) -> None:
    """The file images as files of one machine's folder, one shard at a time."""
    import os

    os.makedirs(folder, exist_ok=True)
    for r in shards.select("part", "shard", "payload").toLocalIterator():
        with open(f"{folder}/tokens-{r['part']:06d}-{r['shard']:06d}.bin", "wb") as f:
            f.write(r["payload"])


def public(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


VOCABULARY = 50257  # ids of byte_bpe_50k


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return read(write(docs, public(), VOCABULARY))
