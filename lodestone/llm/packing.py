"""Documents packed into sequences of equal capacity by bin completion.

A document's token ids and its end id are cut into pieces of at most ``CAPACITY``
ids; only longer documents are cut, and their first piece takes what is left over.
Pieces are packed by branch and bound over bin completions: the largest piece that is
not packed yet opens a bin, the undominated fillings of the room beside it are tried
from the fullest on, and a branch ends where its waste, or the bound on the bins
that the rest needs, cannot beat the best packing known.  Best-fit decreasing gives
the packing that a branch must beat: at the start for all pieces, later for what a
branch has left.

At scale: pieces are dealt by hash into groups of some ``GROUP`` pieces, each packed
in one task.  A group's few emptiest bins are unpacked and their pieces dealt into
fewer groups, until one group is left: so groups cost no bins of their own.  No group
grows with the input, nor with a key.  Only narrow rows are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import binary, common

CAPACITY, END = 2048, 0
GROUP = 8192  # pieces that a task packs at once: four full bins at least, whatever their sizes
CARRY = GROUP // 8  # pieces of a group's emptiest bins that are packed again with others'
WIDTH = 8  # fillings that are tried for one largest piece, the fullest
STEPS = 400  # sets that are looked at to find them
NODES = 4000  # bins that a search fills before it keeps the best packing so far


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """A lower bound on the bins for ``counts[s]`` pieces of each size s: for every
    threshold, pieces that cannot share a bin, and the small ones beyond their room."""
    if not counts.any():
        return 0
    size = np.arange(capacity + 1)
    n, total = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * size)])
    half = capacity // 2
    a = np.arange(half + 1)  # pieces below a are not counted
    alone = n[capacity + 1] - n[capacity - a + 1]
    wide, wide_sum = n[capacity - a + 1] - n[half + 1], total[capacity - a + 1] - total[half + 1]
    small = total[half + 1] - total[a]
    beyond = np.maximum(0, -(-(small - (wide * capacity - wide_sum)) // capacity))
    return int((alone + wide + beyond).max())


def best_fit(counts: np.ndarray, capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the sizes in each bin.  Bins are found by their free room."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}
    rooms = 0  # bit k: some bin has k left
    for size in np.flatnonzero(counts)[::-1].tolist():
        for _ in range(int(counts[size])):
            fits = rooms >> size
            if fits:
                room = size + (fits & -fits).bit_length() - 1
                at = free[room].pop()
                if not free[room]:
                    rooms &= ~(1 << room)
                bins[at].append(size)
            else:
                room, at = capacity, len(bins)
                bins.append([size])
            left = room - size
            if left:
                free.setdefault(left, []).append(at)
                rooms |= 1 << left
    return bins


def best_fit_bins(counts: np.ndarray, capacity: int) -> int:
    """The number of bins of ``best_fit``: all pieces of a size are placed at once, as each
    of the tightest bins takes what fits before the next one is tried."""
    free: dict[int, int] = {}
    rooms = bins = 0
    sizes = np.flatnonzero(counts)[::-1]
    for size, n in zip(sizes.tolist(), counts[sizes].tolist(), strict=True):
        while n:
            fits = rooms >> size
            room = size + (fits & -fits).bit_length() - 1 if fits else capacity
            each = room // size
            taken, each = (n // each, each) if n >= each else (1, n)
            if fits:
                taken = min(taken, free[room])
                free[room] -= taken
                if not free[room]:
                    rooms &= ~(1 << room)
            else:
                bins += taken
            n -= taken * each
            left = room - each * size
            if left:
                free[left] = free.get(left, 0) + taken
                rooms |= 1 << left
    return bins


def _dominated(filling: tuple, room: int, others: int) -> bool:
    """Whether a set of other pieces' sizes (bits of ``others``) could stand for some of
    the filling: one larger piece for up to three that sum to no more, still in the room."""
    slack = room - sum(filling)
    if slack:
        more = (1 << slack) - 1  # one piece for itself is no gain
        if (others >> 1) & more or any((others >> (s + 1)) & more for s in filling):
            return True
    more = (1 << (slack + 1)) - 1
    for n in (2, 3):
        for own in combinations(filling, n):
            t = sum(own)
            if (others >> t) & more and t not in filling:
                return True
    return False


@lru_cache(maxsize=4)
def _below(n: int) -> list[int]:
    """The bits below each number up to ``n``."""
    return [(1 << k) - 1 for k in range(n + 1)]


def fillings(counts: np.ndarray, room: int, width: int = WIDTH, steps: int = STEPS) -> list[tuple]:
    """Undominated fillings of ``room`` from pieces of the sizes counted, the fullest
    first, at most ``width``.  The last piece of a filling is the largest that fits."""
    there = counts[: room + 1] > 0
    there[0] = False
    sizes = np.flatnonzero(there)
    if not len(sizes):
        return [()]
    least = int(sizes[0])
    if sizes[-1] == room:  # a perfect fit with one piece dominates all
        return [(room,)]
    mask = int.from_bytes(np.packbits(there, bitorder="little").tobytes(), "little")
    have, below = counts[: room + 1].tolist(), _below(len(counts))
    found: dict[tuple, int] = {}
    # Depth first; of a set only the pieces that it has not been tried with yet are kept.
    todo, own, left, looked, perfect = [], (), room, 0, 0
    while True:
        looked += 1
        # Pieces are taken from the largest on; of the size taken last there must be one more.
        most = left if not own else min(left, own[-1] - int(own.count(own[-1]) >= have[own[-1]]))
        fits = mask & below[most + 1]
        if not fits:
            found[own] = left
        else:
            s = fits.bit_length() - 1
            found[(*own, s)] = left - s
            if left == s:
                perfect += 1
                if perfect >= width:
                    break
            if left > least:  # any piece that leaves room for another
                fits &= below[left - least + 1]
                if fits:
                    todo.append([own, left, fits])
        if not todo or looked >= steps:
            break
        own, left, fits = todo[-1]
        s = fits.bit_length() - 1
        fits ^= 1 << s
        if fits:
            todo[-1][2] = fits
        else:
            todo.pop()
        own, left = (*own, s), left - s
    out = []
    for _, _, own in sorted([(left, len(own), own) for own, left in found.items()]):
        others = mask
        for s in set(own):
            if own.count(s) >= have[s]:
                others &= ~(1 << s)
        if not _dominated(own, room, others):
            out.append(own)
            if len(out) >= width:
                break
    return out or [min(found, key=lambda x: (found[x], len(x), x))]


def complete(counts: np.ndarray, capacity: int, nodes: int = NODES) -> tuple[list[list[int]], bool]:
    """The sizes in each bin of the best packing found, and whether it is known to be
    the best there is (else the search ended after ``nodes`` bins)."""
    counts = counts.copy()
    best, least = best_fit(counts, capacity), least_bins(counts, capacity)
    total = int((counts * np.arange(capacity + 1)).sum())
    if len(best) <= least:
        return best, True

    def tries() -> Iterator[tuple]:
        largest = int(np.flatnonzero(counts)[-1])
        counts[largest] -= 1
        own = fillings(counts, capacity - largest)
        counts[largest] += 1
        return iter([(largest, *f) for f in own])

    stack: list[list] = [[tries(), None]]
    waste = used = 0
    cut = False
    while stack:
        frame = stack[-1]
        if frame[1] is not None:
            waste -= capacity - sum(frame[1])
            for s in frame[1]:
                counts[s] += 1
            frame[1] = None
        own = next(frame[0], None)
        if own is None or used >= nodes:
            cut = cut or used >= nodes
            stack.pop()
            continue
        used += 1
        frame[1] = own
        waste += capacity - sum(own)
        for s in own:
            counts[s] -= 1
        if waste > (len(best) - 1) * capacity - total:  # no packing with a bin less wastes so much
            continue
        if not counts.any():
            best = [list(f[1]) for f in stack]
        elif len(stack) + least_bins(counts, capacity) < len(best):
            if used % 64 == 1 or counts.sum() <= 256:
                if len(stack) + best_fit_bins(counts, capacity) < len(best):
                    best = [list(f[1]) for f in stack] + best_fit(counts, capacity)
            if len(stack) < len(best):
                stack.append([tries(), None])
        if len(best) <= least:
            return best, True
    return best, not cut


def pack(sizes: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; equal sizes take their places in order."""
    places, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order = np.argsort(sizes, kind="stable")
    starts = np.searchsorted(sizes[order], np.arange(capacity + 2))
    at = starts.copy()
    bins, _ = complete(np.diff(starts), capacity, nodes)
    for k, own in enumerate(bins):
        offset = 0
        for s in own:
            i = order[at[s]]
            at[s] += 1
            places[i], offsets[i] = k, offset
            offset += s
    return places, offsets


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(key, doc_id, piece, start, length, ids_crc32[, ids]) of each document's pieces;
    ``ids``: little-endian unsigned 32-bit, as binary.  ``key`` numbers the documents."""
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    fields = [*rows.schema.fields[:2], *T.StructType.fromDDL("piece int, start long, length long, ids_crc32 long" + ", ids binary" * ids).fields]
    schema = T.StructType(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, encode, tail = to_arrow_schema(schema), binary.encoder(tokenizer), np.array([end], "<u4").tobytes()
        for batch in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            source, found = [], []
            for i, coded in enumerate(encode(batch.column(2).to_pylist())):
                raw = coded + tail
                n = len(raw) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = raw[4 * a : 4 * b]
                    source.append(i)
                    found.append((k, a, b - a, zlib.crc32(part), part))
            columns = list(zip(*found, strict=True))[: len(out) - 2]
            own = [batch.column(c).take(pa.array(source, pa.int32())) for c in range(2)]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, f.type) for c, f in zip(columns, list(out)[2:], strict=True))], schema=out)

    return rows.mapInArrow(run, schema)


def _packer(names: list[str], schema: T.StructType, turn: int, last: bool, capacity: int, carry: int):
    """A function that packs one group of pieces."""

    def run(table: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        table = table.sort_by([("length", "descending"), ("key", "ascending"), ("piece", "ascending")])
        sizes = table["length"].to_numpy()
        place, offset = pack(sizes, capacity)
        filled = np.bincount(place, sizes).astype(np.int64)
        open_ = np.zeros(len(filled), bool)
        if not last:  # the emptiest bins, as many as hold ``carry`` pieces; one, if it holds no more than half
            order = np.argsort(filled, kind="stable")
            order = order[filled[order] < capacity]
            held = np.cumsum(np.bincount(place, minlength=len(filled))[order])
            open_[order[held <= carry]] = True
            open_[order[:1][held[:1] * 2 <= len(sizes)]] = True
        number = (turn << 57) + (int(table["__group"][0].as_py()) << 20)
        columns = [table[c] for c in names]
        return pa.Table.from_arrays([*columns, pa.array(place + number), pa.array(offset), pa.array(open_[place])], schema=to_arrow_schema(schema))

    return run


def packed(own: DataFrame, capacity: int = CAPACITY, group: int = GROUP, carry: int = CARRY) -> DataFrame:
    """``own`` (key, piece, length, ...) with sequence_id and offset."""
    left = common.written(own, "pieces")
    names, turn, done = own.columns, 0, []
    schema = T.StructType([*own.schema.fields, *T.StructType.fromDDL("sequence_id long, offset long, again boolean").fields])
    while True:
        groups = max(1, -(-left.count() // group))
        last = groups == 1
        dealt = left.withColumn("__group", F.pmod(F.xxhash64("key", "piece", F.lit(turn)), F.lit(groups)))
        found = common.written(dealt.groupBy("__group").applyInArrow(_packer(names, schema, turn, last, capacity, carry), schema), "packed")
        done.append(found.where("not again").drop("again"))
        if last:
            return reduce(DataFrame.unionByName, done)
        left, turn = found.where("again").select(*names), turn + 1


def sequences(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, **how) -> DataFrame:
    """The packed sequences: sequence_id, n_ids, ids (little-endian unsigned 32-bit) and
    pieces (doc_id, piece, start, offset, length) in place; odd cases as in ``query``."""
    found = packed(pieces(docs, tokenizer, capacity, ids=True, **how), capacity)
    each = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "start", "length", "ids")))  # a sequence: ``capacity`` ids at most
    rows = found.groupBy("sequence_id").agg(each.alias("each"))
    joined = F.aggregate("each", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", F.aggregate("each", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n_ids"), joined.alias("ids"), F.transform("each", lambda x: x.dropFields("ids")).alias("pieces"))


def query(spark, sf_dir: str) -> DataFrame:
    """All documents packed; a null or empty text is its end id, rows that repeat an id
    are documents of their own, an empty table gives an empty one."""
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    found = packed(pieces(docs, binary.public()))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
