"""Exact self-join of documents by the Jaccard similarity of their word n-grams, with signature trees.

1. Each text becomes its set of n-gram hashes (64 bits). Equal sets become one set. A sketch of hash counts, of bounded size,
   orders n-grams from rare to frequent.
2. Sets that may link share an n-gram among the rarest (prefix filter). A large set is cut by hash into parts of about
   the same size in every set of its size class, and two sets that link are as similar in at least one part; sets near
   the top of a class stand in the next class as well. So the sets compared are small whatever the documents' length.
3. Sets that share a prefix n-gram are compared in a signature tree: a node holds the OR of its members' bitmaps, their range of sizes
   and their most collisions, which bound the overlap of any pair below two nodes. Pairs of nodes that
   can't link are pruned. What is left connects sets to candidate clusters. For n-grams that the sketch doesn't show
   to be in few sets, the sets are reduced to cells of equal size and equal number of n-grams from this one on, in order. Two sets whose first shared
   n-gram is this one share no more than the smaller of these numbers, so cells are connected only where that can be enough: texts that share a
   page's frame and no more aren't candidates.
4. Each cluster's texts meet in blocks of bounded size. A tree over whole sets is traversed against itself, pairs already
   in one component are skipped, and the rest are compared exactly. In clusters of several blocks, the sets outside the
   largest component meet every other block.

No step emits the pairs of a group, and no bucket or candidate list is capped.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import KeyFilter, Scratch, connected_components, grouped, sum_slices, without_rows

_K, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bits and words of the bitmaps that travel with a part.
BITS = 512
#: Parts have this many n-grams to four times as many.
PART = 64
_EVEN = np.uint64(0xFFFFFFFFFFFFFFFE)
#: Low bits of an odd key: size (14), place (12), mark.
_CELL = np.uint64(27)
#: Sets below one leaf of a tree, and children of a node.
FAN = 16
SLICE = 1 << 14


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word n-grams; the whole sequence is one if it has fewer words."""
    tokens = text.encode().lower().split()
    n = len(tokens)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, n)
    k = min(words, n)
    acc = h[: n - k + 1] + np.uint64(k)
    for i in range(1, k):
        acc = acc * _K + h[i : n - k + 1 + i]
    return np.unique(_mix(acc))


def fingerprint(h: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(h.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


class Names:
    """64-bit names of sets: the first half of the fingerprint, but for the sets that another set would share it with."""

    def __init__(self, bits: int = 64):
        self.bits = bits
        self.other: dict[tuple[int, int], int] = {}

    def of(self, h: np.ndarray) -> tuple[int, int]:
        """Name and second half of the fingerprint."""
        sid, check = fingerprint(h)
        sid &= (1 << self.bits) - 1 if self.bits < 64 else -1
        while (sid, check) in self.other:
            sid = self.other[sid, check]
        return sid, check

    def part(self, pairs: list[tuple[int, int]]) -> None:
        """Gives each of these (name, check) a name of its own."""
        for sid, check in pairs:
            d = hashlib.blake2b(f"{sid} {check} {len(self.other)}".encode(), digest_size=8).digest()
            self.other[sid, check] = int.from_bytes(d, "little", signed=True)


def overlap_needed(nx, ny, percent: int):
    """Fewest shared n-grams with which sets of these sizes link: 100 I >= percent U."""
    return -(-percent * (nx + ny) // (100 + percent))


class Links:
    """Union-find; the smaller number is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


class SignatureTree:
    """Sets in order of size below nodes of OR-combined bitmaps (n x words of uint64) and size ranges."""

    def __init__(self, sizes: np.ndarray, bitmaps: np.ndarray, percent: int):
        self.percent, self.n = percent, sizes
        self.order = np.argsort(sizes, kind="stable")
        bits, size = bitmaps[self.order], sizes[self.order].astype(np.int64)
        extra = size - np.bitwise_count(bits).sum(1, dtype=np.int64)
        self.levels = [(bits, size, size, extra)]  # bitmaps, smallest and largest size, most n-grams without a bit of their own
        while len(self.levels[-1][1]) > 1:
            bits, low, high, extra = self.levels[-1]
            cut = np.arange(0, len(low), FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, cut, 0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(extra, cut)))

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For node pairs a[i], b[i] of one level: whether any two sets below can reach the overlap they need."""
        bits, low, high, extra = self.levels[level]
        top = np.minimum(np.bitwise_count(bits[a] & bits[b]).sum(1, dtype=np.int64) + np.minimum(extra[a], extra[b]), np.minimum(high[a], high[b]))
        apart = np.maximum(low[a], low[b]) * self.percent > 100 * np.minimum(high[a], high[b])
        return (top >= overlap_needed(low[a], low[b], self.percent)) & ~apart

    def traverse(self, links: Links, check) -> None:
        """Calls check(x, y) for the pairs that the bounds leave and joins those for which it is true. Pairs in one component are skipped."""
        top = len(self.levels) - 1
        stack = [(top, np.array([0]), np.array([0]))]
        order = self.order.tolist()
        one = self._single(links)
        seen = 0
        while stack:
            level, a, b = stack.pop()
            keep = self.may_link(level, a, b)
            if level:
                keep &= ~((one[level][a] >= 0) & (one[level][a] == one[level][b]))
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    if x < y:
                        x, y = order[x], order[y]
                        if links.find(x) != links.find(y) and (check is None or check(x, y)):
                            links.join(x, y)
                            seen += 1
                if seen >= 256:
                    one, seen = self._single(links), 0
                continue
            below = len(self.levels[level - 1][1])
            for k in range(0, len(a), 64):
                x = (a[k : k + 64, None, None] * FAN + np.arange(FAN)[None, :, None] + np.zeros((1, 1, FAN), np.int64)).ravel()
                y = (b[k : k + 64, None, None] * FAN + np.arange(FAN)[None, None, :] + np.zeros((1, FAN, 1), np.int64)).ravel()
                fits = (x < below) & (y < below) & (x <= y)
                stack.append((level - 1, x[fits], y[fits]))

    def _single(self, links: Links) -> list[np.ndarray]:
        """The component of each node all of whose sets are in one; else -1."""
        found = [np.array([links.find(int(x)) for x in self.order], np.int64)]
        for _ in self.levels[1:]:
            cut = np.arange(0, len(found[-1]), FAN)
            low, high = np.minimum.reduceat(found[-1], cut), np.maximum.reduceat(found[-1], cut)
            found.append(np.where(low == high, low, -1))
        return found


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Presence bitmap by the hashes' low bits."""
    flags = np.zeros(bits, np.uint8)
    flags[(hashes & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags).view(np.uint64)


def link_sets(sets: list[np.ndarray], percent: int, links: Links | None = None) -> Links:
    """Exact components of sorted sets. `links` may hold links known before; pairs among them are not compared."""
    n = len(sets)
    links = links or Links(n)
    if n < 2:
        return links
    sizes = np.array([len(s) for s in sets])
    bits = 1 << int(np.clip(np.ceil(np.log2(2 * max(np.median(sizes), 1))), 8, 13))
    tree = SignatureTree(sizes, np.stack([bitmap(s, bits) for s in sets]), percent)

    def check(x: int, y: int) -> bool:
        small, large = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
        at = np.searchsorted(large, small)
        at[at == len(large)] = 0
        shared = int((large[at] == small).sum())
        return shared >= overlap_needed(len(small), len(large), percent)

    # sets near each other in size are often copies: a first pass along the order makes whole nodes single components
    order = tree.order.tolist()
    for x, y in zip(order, order[1:], strict=False):
        if links.find(x) != links.find(y) and check(x, y):
            links.join(x, y)
    tree.traverse(links, check)
    return links


def _docs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")


_KINDS = {"doc": 0, "part": 1, "sketch": 2}
_SETS = pa.schema(
    [("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("check", pa.int64()), ("entity", pa.int64()), ("bitmap", pa.binary()), ("part", pa.int32()), ("slice", pa.int32()), ("counts", pa.binary()), ("kind", pa.int32())]
)


def _rows(kind: str, **columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    columns["kind"] = np.full(n, _KINDS[kind], np.int32)
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SETS], schema=_SETS)


def _sets(docs: DataFrame, words: int, percent: int, bits: int, names: Names) -> DataFrame:
    """In one pass: a row per document (doc_id, n, sid, check), a row per part of a set (entity, sid, n, bitmap), and each task's sketch in slices.

    Equal sets in one task give their parts once. Sets of one or two n-grams link to equal sets only and have no parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, part = np.zeros(1 << bits, np.int64), TaskContext.get().partitionId()
        shift, seen = np.uint64(64 - bits), set()
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                b = whole.slice(lo, 512)
                found = [shingles(t or "", words) for t in b.column(1).to_pylist()]
                own = (np.concatenate(found) >> shift).astype(np.int64)
                if len(own) * 8 < len(sketch):
                    at, c = np.unique(own, return_counts=True)
                    sketch[at] += c
                else:
                    sketch += np.bincount(own, minlength=len(sketch))
                prints = [names.of(h) for h in found]
                yield _rows("doc", doc_id=b.column(0).to_pylist(), n=[len(h) for h in found], sid=[p[0] for p in prints], check=[p[1] for p in prints])
                parts = []
                for h, (sid, _) in zip(found, prints, strict=True):
                    if len(h) > 2 and sid not in seen:
                        seen.add(sid)
                        parts += [(entity, sid, len(x), bitmap(x, BITS).tobytes()) for entity, _, x in set_parts(h, sid, percent)]
                if parts:
                    entity, sid, n, maps = zip(*parts, strict=True)
                    yield _rows("part", entity=entity, sid=sid, n=n, bitmap=maps)
        if sketch.any():
            cuts = sketch.astype("<u4").reshape(-1, min(SLICE, len(sketch)))
            yield _rows("sketch", part=np.full(len(cuts), part), slice=np.arange(len(cuts)), counts=[zlib.compress(c.tobytes(), 1) for c in cuts])

    return docs.mapInArrow(run, "doc_id long, n long, sid long, check long, entity long, bitmap binary, part int, slice int, counts binary, kind int")


def size_classes(n: int, percent: int) -> list[int]:
    """The classes in which a set of n n-grams stands: its own, and the next if larger sets there may link to it."""
    own = max(0, (n // PART).bit_length() - 1) // 2
    end = PART << (2 * own + 2)
    return [own, own + 1] if 100 * n >= percent * end else [own]


def set_parts(h: np.ndarray, sid: int, percent: int) -> Iterator[tuple[int, np.uint64, np.ndarray]]:
    """Entity number, a number for the class and part, and the hashes of each part in which the set is compared."""
    for c in size_classes(len(h), percent):
        g = 1 << (2 * c)
        if g == 1:
            split = [h]
        else:
            part = (h >> np.uint64(8)) & np.uint64(g - 1)
            order = np.argsort(part, kind="stable")
            split = np.split(h[order], np.searchsorted(part[order], np.arange(1, g, dtype=np.uint64)))
        seeds = _mix(np.arange(g, dtype=np.uint64) + np.uint64((c + 1) << 40))
        entities = _mix(seeds ^ np.uint64(sid & 0xFFFFFFFFFFFFFFFF)).view(np.int64)
        for k, own in enumerate(split):
            if len(own):
                yield int(entities[k]), seeds[k], own


def _prefixes(docs: DataFrame, words: int, percent: int, bits: int, levels, hot, names: Names) -> DataFrame:
    """Rows (key, entity) of the parts' prefixes. An even key is an n-gram in a class and part; an odd one that of an n-gram that may be in many sets.

    The low 27 bits of an odd key are its cell: the part's size, the n-gram's place in the part's order, and the mark. N-grams that agree in the
    other 37 bits are taken for one, which can only add candidates.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, is_hot, shift = levels.value, hot.value, np.uint64(64 - bits)
        seen: set[int] = set()
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                keys, entities, counts = [], [], []
                for text in whole.column(1).slice(lo, 512).to_pylist():
                    h = shingles(text or "", words)
                    if len(h) < 3 or (sid := names.of(h)[0]) in seen:
                        continue
                    seen.add(sid)
                    for entity, seed, own in set_parts(h, sid, percent):
                        at = (own >> shift).astype(np.int64)
                        take = len(own) - -(-percent * len(own) // 100) + 1
                        first = np.argsort(level[at].astype(np.uint64) << np.uint64(58) | own >> np.uint64(6), kind="stable")[:take]
                        if len(own) >= 1 << 14:
                            raise ValueError("a part of 256 n-grams in the mean has 16,384")
                        key = own[first] ^ seed
                        cell = np.uint64(len(own) << 13 | 1) | np.arange(take, dtype=np.uint64) << np.uint64(1)
                        keys.append(np.where(is_hot[at[first]], key >> _CELL << _CELL | cell, key & _EVEN))
                        entities.append(entity)
                        counts.append(take)
                if keys:
                    columns = [np.concatenate(keys).view(np.int64), np.repeat(np.array(entities), counts)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "entity"])

    return docs.mapInArrow(run, "key long, entity long")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows (hot, group, entity): of keys that several entities have.

    Keys with the same entities give one and the same group number, so that what is compared for one isn't compared again. Keys that
    may be in many sets keep their own number and all their rows, and are dealt out by entity.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, 0), np.int64)

        def chosen(a: np.ndarray) -> pa.RecordBatch:
            new = np.append(True, (a[0, 1:] != a[0, :-1]) | (a[1, 1:] != a[1, :-1]))  # equal sets of several tasks
            key, entity = a[:, new]
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(cut, append=len(key))
            number = np.add.reduceat(_mix(entity.view(np.uint64)), cut) ^ _mix(size.astype(np.uint64))
            keep = np.repeat(size > 1, size)
            return out(False, np.repeat(number.view(np.int64), size)[keep], entity[keep])

        def out(flag: bool, group: np.ndarray, entity: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(group), flag)), pa.array(group), pa.array(entity)], ["hot", "group", "entity"])

        for b in batches:
            if not b.num_rows:
                continue
            key, entity = (b.column(k).to_numpy() for k in range(2))
            hot = (key & 1).astype(bool)
            if hot.any():
                yield out(True, key[hot], entity[hot])
            a = np.concatenate([held, np.stack([key, entity])[:, ~hot]], 1)
            if not a.shape[1]:
                continue
            cut = int(np.searchsorted(a[0], a[0, -1], "left"))  # the last key may go on
            held = a[:, cut:]
            if cut:
                yield chosen(a[:, :cut])
        if held.shape[1]:
            yield chosen(held)

    dealt = F.when(F.col("key").bitwiseAND(1) == 1, F.xxhash64("key", "entity")).otherwise(F.col("key"))  # a hot key's rows go to all tasks
    return rows.repartition(dealt).sortWithinPartitions("key", "entity").mapInArrow(run, "hot boolean, group long, entity long")


def join_cells(n: np.ndarray, rest: np.ndarray, percent: int) -> np.ndarray:
    """Per cell (size, n-grams from the shared one on) the first cell of its component, or -1 where no set in it can link to another by this n-gram.

    Sets of two cells can link if the overlap that their sizes need is no more than either's rest; so can two sets of one cell.
    """
    sizes, of = np.unique(n, return_inverse=True)
    top = np.full(len(sizes), -1, np.int64)
    np.maximum.at(top, of, rest)
    need = overlap_needed(sizes[:, None], sizes[None, :], percent)
    fits = need <= np.minimum(top[:, None], top[None, :])
    least = np.where(fits, need, np.iinfo(np.int64).max).min(1)  # cells of this size with so much left link to some cell
    links = Links(len(sizes))
    for x, y in zip(*np.nonzero(np.triu(fits, 1)), strict=True):
        links.join(int(x), int(y))
    joined = rest >= least[of]
    root = np.array([links.find(k) for k in range(len(sizes))])[of]
    first = np.full(len(sizes), len(n), np.int64)
    np.minimum.at(first, root[joined], np.flatnonzero(joined))
    return np.where(joined, first[root], -1)


def _joined_cells(cells: DataFrame, percent: int) -> DataFrame:
    """Rows (group, root) from rows (group, entity) of odd keys: an entity of the component for each cell whose sets may link to others by the cell's n-gram.

    An n-gram has at most as many cells as there are sizes of parts times lengths of prefixes, however many sets have it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, table in grouped(batches, 1):
            group = table.column("group").to_numpy()
            n = group >> 13 & 0x3FFF
            first = join_cells(n, n - (group >> 1 & 0xFFF), percent)
            keep = first >= 0
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(group[keep]), pa.array(table.column("entity").to_numpy()[first[keep]])], ["group", "root"])

    own = cells.select(F.shiftright("group", int(_CELL)).alias("gram"), "group", "entity")
    return own.repartition("gram").sortWithinPartitions("gram", "group").mapInArrow(run, "group long, root long")


def _candidate_edges(rows: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) that connect the sets which a signature tree per group can't tell apart; rows (group, sid, n, bitmap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for _, table in grouped(batches, 1):
            sid = table.column("sid").to_numpy()
            n = table.column("n").to_numpy().astype(np.int64)
            bits = np.frombuffer(b"".join(table.column("bitmap").to_pylist()), np.uint64).reshape(len(n), -1)
            if len(n) == 2:
                shared = int(np.bitwise_count(bits[0] & bits[1]).sum()) + min(int(n[k]) - int(np.bitwise_count(bits[k]).sum()) for k in (0, 1))
                if min(shared, int(n.min())) >= overlap_needed(int(n[0]), int(n[1]), percent):
                    seen.add((int(sid[0]), int(sid[1])))
            else:
                links = Links(len(n))
                SignatureTree(n, bits, percent).traverse(links, None)
                seen.update((int(sid[k]), int(sid[r])) for k in range(len(n)) if (r := links.find(k)) != k)
            if len(seen) >= 1 << 18:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in seen], pa.int64()) for k in (0, 1)], ["a", "b"])
                seen.clear()
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in seen], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.repartition("group").sortWithinPartitions("group").select("group", "sid", "n", "bitmap").mapInArrow(run, "a long, b long")


def _link_blocks(rows: DataFrame, words: int, percent: int, names: Names) -> DataFrame:
    """Edges (a, b) to each set's component within its group; rows (cluster, block, other, sid, root, text), where root is a component known before or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []
        for _, table in grouped(batches, 3):
            place: dict[int, int] = {}
            sets, roots = [], []
            for sid, root, text in zip(*(table.column(c).to_pylist() for c in ("sid", "root", "text")), strict=True):
                if sid not in place:
                    h = shingles(text or "", words)
                    if names.of(h)[0] == sid:  # another row may repeat the id with another text
                        place[sid] = len(sets)
                        sets.append(h)
                        roots.append(root)
            links, first = Links(len(sets)), {}
            for k, root in enumerate(roots):
                if root is not None:
                    links.join(first.setdefault(root, k), k)
            known = [links.find(k) for k in range(len(sets))]
            link_sets(sets, percent, links)
            sids = list(place)
            for k, sid in enumerate(sids):
                if links.find(k) != k and links.find(k) != known[k]:
                    a.append(sid)
                    b.append(sids[links.find(k)])
            if len(a) >= 1 << 16:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
                a, b = [], []
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    own = ["cluster", "block", "other", "sid", "root", "text"]
    return rows.select(*own).repartition("cluster", "block", "other").sortWithinPartitions("cluster", "block", "other", "sid").mapInArrow(run, "a long, b long")


def jaccard_components(
    docs: DataFrame,
    words: int = 5,
    percent: int = 75,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_shingles: int = 2_000_000,
    block_sets: int = 1024,
    few: int = 4096,
    name_bits: int = 64,
) -> DataFrame:
    """doc_id, n_shingles, component_id: one row per input row.

    Two documents link when 100 * intersection >= percent * union of their word n-gram sets, A-Z lower-cased;
    component_id is the smallest doc_id that links lead to, the document's own included. A null or empty text, or one without
    words, has n_shingles 0 and its own doc_id as component. Rows with a null id keep a null component, unless they link to
    rows with one. Rows that repeat an id are documents of their own. An empty table gives no rows; other columns are not read.

    An n-gram is "in few sets" when its sketch count, which is never below its true count, is at most `few` or four times
    the mean, whichever is more; block_* bound what meets in one task. Hashes of n-grams have 64 bits and those of sets 128, of
    which `name_bits` name the set. Where two sets have one name, all but one get other names, at the price of one more pass.
    """
    scratch, plain = Scratch(docs.sparkSession, "jaccard"), _docs(docs, id_col, text_col)
    context = docs.sparkSession.sparkContext
    bits = int(np.clip(np.ceil(np.log2(4 * max(docs.count(), 1))), 14, 24))
    naming = Names(name_bits)
    for turn in itertools.count():
        all_rows = scratch.write(_sets(plain, words, percent, bits, naming), f"sets{turn}", "kind", compression="zstd")
        rows = all_rows.where("kind = 0").select("doc_id", "n", "sid", "check")
        names = rows.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.min("check").alias("low"), F.max("check").alias("high"))
        names = scratch.write(names, f"names{turn}")
        twice = names.where("low <> high").select("sid", "low")
        if twice.isEmpty():
            break
        # some n^2 / 2^65 names for n sets: a handful at 10^10
        naming.part(sorted(tuple(r) for r in rows.where("n > 0").join(twice, "sid").where("check <> low").select("sid", "check").distinct().collect()))
        scratch.drop(f"sets{turn}")
    counts = np.zeros(1 << bits, np.int64)
    for k, own in sum_slices(all_rows.where("kind = 2").select("part", "slice", "counts"), "<u4", True).items():
        counts[k * SLICE : k * SLICE + len(own)] = own
    level = np.log2(counts + 1).astype(np.uint8)
    is_hot = counts > max(few, 4 * int(counts.mean()))
    levels, hot = context.broadcast(level), context.broadcast(is_hot)  # at most 2^24 bytes each
    parts = all_rows.where("kind = 1").select("entity", "sid", "n", "bitmap")
    shared = scratch.write(_shared(_prefixes(plain, words, percent, bits, levels, hot, naming)), "shared", compression="zstd")
    dense = shared.where("hot").select("group", "entity")
    cells = _joined_cells(dense.groupBy("group").agg(F.min("entity").alias("entity")), percent)
    dense = scratch.write(dense.join(cells, "group").where("entity <> root").select("entity", "root").distinct(), "dense")
    groups = shared.where("not hot").select("group", "entity").distinct()
    wanted = shared.where("not hot").select("entity").union(dense.select("entity")).union(dense.select("root"))
    met = wanted.agg(F.approx_count_distinct("entity")).first()[0]
    parts = scratch.write(KeyFilter(wanted, "entity", met).apply(parts, "entity").dropDuplicates(["entity"]), "parts", compression="zstd")
    scratch.drop(f"sets{turn}/kind=1")
    scratch.drop(f"sets{turn}/kind=2")
    edges = _candidate_edges(groups.join(parts, "entity").select("group", "sid", "n", "bitmap"), percent)
    sids = parts.select("entity", F.col("sid").alias("a"))
    edges = edges.union(dense.join(sids, "entity").select("a", "root").join(parts.select(F.col("entity").alias("root"), F.col("sid").alias("b")), "root").select("a", "b"))
    clusters = connected_components(scratch, edges, "candidates")
    for done in ("shared", "dense", "parts"):
        scratch.drop(done)

    members = clusters.join(names, F.col("node") == F.col("sid")).select("sid", F.col("root").alias("cluster"), "rep", names["n"])
    size = members.groupBy("cluster").agg(F.ceil(F.greatest(F.sum("n") / block_shingles, F.count(F.lit(1)) / block_sets)).alias("blocks"))
    members = scratch.write(members.join(size, "cluster").withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks"))), "members")
    texts = KeyFilter(members, "rep", members.count()).apply(plain, "doc_id").withColumnRenamed("doc_id", "rep")
    placed = members.join(texts, "rep").select("cluster", "blocks", "block", "sid", "text")
    none = F.lit(None).cast("long").alias("root")
    links = scratch.write(_link_blocks(placed.select("cluster", "block", F.lit(0).alias("other"), "sid", none, "text"), words, percent, naming), "links")
    split = members.where("blocks > 1").select("cluster", "block", "blocks", "sid", "rep")
    if not split.isEmpty():
        links = links.union(scratch.write(_between_blocks(scratch, split, plain, connected_components(scratch, links, "within"), words, percent, naming), "between"))
    found = connected_components(scratch, links, "components")
    named = names.join(found, names["sid"] == found["node"], "left").select("sid", "rep", F.coalesce("root", "sid").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    final = scratch.write(named.join(least, "root").select("sid", "least"), "final")
    return rows.join(final, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def _between_blocks(scratch: Scratch, split: DataFrame, plain: DataFrame, within: DataFrame, words: int, percent: int, names: Names) -> DataFrame:
    """Links between the blocks of clusters of several blocks: the sets outside a cluster's largest component against each other block."""
    rooted = split.join(within, split["sid"] == within["node"], "left").select("cluster", "block", "blocks", "sid", "rep", F.coalesce("root", "sid").alias("root"))
    rooted = scratch.write(rooted, "rooted")
    per_root = rooted.groupBy("cluster", "root").agg(F.count(F.lit(1)).alias("members"))
    largest = per_root.groupBy("cluster").agg(F.max_by("root", F.struct("members", "root")).alias("main"))
    outside = rooted.join(largest, "cluster").where("root <> main").drop("main")
    asking = outside.select("cluster", F.col("block").alias("other")).distinct()
    # a block meets the outsiders of every other block: the pairs of blocks are those that the tree bounds can't settle alone
    inside = rooted.join(asking, "cluster").where("block <> other").select("cluster", "block", "other", "sid", "rep", "root")
    meets = F.expr("filter(sequence(0L, cast(blocks as long) - 1L), b -> b <> block)")
    guests = outside.select("cluster", F.explode(meets).alias("target"), F.col("block").alias("other"), "sid", "rep", "root")
    guests = guests.select("cluster", F.col("target").alias("block"), "other", "sid", "rep", "root")
    both = inside.union(guests)
    texts = KeyFilter(split, "rep", split.count()).apply(plain, "doc_id").withColumnRenamed("doc_id", "rep")
    return _link_blocks(both.join(texts, "rep").select("cluster", "block", "other", "sid", "root", "text"), words, percent, names)


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all its columns, with one document of each component: the one of smallest id. Rows with a null id stay."""
    found = Scratch(docs.sparkSession, "keep-one-of-each").write(jaccard_components(docs, words, percent, id_col, text_col), "found")
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias(id_col))
    dropped = found.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct().join(first, id_col, "left_anti")
    return without_rows(docs, Scratch(docs.sparkSession, "dropped").write(dropped, "ids"), id_col)


def op2_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import documents

    return jaccard_components(documents(spark, sf_dir))
