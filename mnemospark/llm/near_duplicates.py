"""Near-duplicate records with small edits (problem 1).

Similarity is the Jaccard index of the distinct words of two contents; ``threshold`` 0.6 by the data
statement.  Method: pigeonhole blocks that every pair in reach must share.  The words of a content, its
fingerprint, are put in one order for all contents, from the rarest on (document frequencies in a table
of ``FREQUENCY_BUCKETS`` hashed counters, which bounds its size; the order is the same everywhere, so a
shared counter costs time and no pair).  Contents of n and m words at Jaccard t share at least
k = t/(1+t)*(n+m) words, and their first l shared words lie, for every l <= k, among the first n-k+l words
of the one and the first m-k+l of the other.  Words fall into g slots by a hash.  With l = g*(d-1)+1 shared
words, some slot holds d of them: both contents therefore emit a block for the first d shared words of that
slot, when each emits all paths of d words of a slot among its first words.  A path ends early where its
words leave about ``COINCIDENCES`` accidental partners in the whole collection; a word that rare is a block
by itself, asked for in the first n-k+1 words alone, and no part of longer paths (were a rare word shared,
the first shared word would be rare too).  Slots keep the paths few: at 36 words and t = 0.6 about 28 blocks
a content where all paths of two words would be more than 100.  The depth d follows the number of contents,
the slots follow the size of the larger content; both contents of a pair know both numbers.

Members of a block are compared by size and by the distance of 132-bit parity sketches, which is at
most the Hamming distance of the sets, so nothing is lost here either; a second sketch of 128 bits sorts
out what looked close by chance, and then the Hamming distance of the full sets of 64-bit word codes is
verified.  Blocks of more than ``hot_block`` members are compared in a
grid of parts, each pair of parts by a task.  Blocks are made in ``rounds`` parts by their first word, one
part after another, which divides the disk that their shuffle takes.

Equal word sets (by a 128-bit digest) are one class before anything is joined: a content copied into a
third of all rows is one fingerprint.  Class membership is a table; pairs of row ids are expanded only
where asked for.

Defined results: rows with a null id or null content, and contents without any word, take part in no
pair; rows of one id are one row (with several contents, each counts); identical contents under
different ids are pairs; texts are processed whole.
"""

from __future__ import annotations

import functools
import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.operators.components import connected_components
from mnemospark.plans.staging import Staging

THRESHOLD = 0.6
FREQUENCY_BUCKETS = 1 << 20
COINCIDENCES = 256.0
HOT_BLOCK = 16384
ROUNDS = 2

#: Share of the contents that a common word is in, as far as the depth of the paths supposes.
COMMON = 0.025

#: Sizes from here on are kept as this one in a block row, and such contents are compared on their full sets only.
LONG = 0x7FFF

#: Bits of a block's column beside the block's own 43, which hold the last cells of the member's sketch.
SPARE = 20

#: Blocks above this are compared by matrices, smaller ones many at a time.
SMALL_BLOCK = 48

_WORD = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")


def words(text: str) -> set[str]:
    """Distinct words: runs of letters or digits in lower case, each Han character by itself."""
    return set(_WORD.findall(text.lower()))


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(texts: list[str | None], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word codes of all texts, one after another, and each text's number of words."""
    flat = array("Q")
    sizes = np.zeros(len(texts), dtype=np.int64)
    if len(known) > 200_000:
        known.clear()
    for i, text in enumerate(texts):
        if text:
            found = words(text)
            sizes[i] = len(found)
            try:
                flat.extend([known[w] for w in found])
            except KeyError:
                for w in found:
                    if w not in known:
                        known[w] = xxhash.xxh64_intdigest(w)
                flat.extend([known[w] for w in found])
    return np.frombuffer(flat, dtype=np.uint64) if flat else np.empty(0, dtype=np.uint64), sizes


def _segments(sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(sizes)), sizes)


def _word_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row_id, content) to (row_id, hash_a, hash_b, codes): sorted word codes and two hashes that name the set."""
    known: dict[str, int] = {}
    for batch in batches:
        flat, sizes = _codes(batch.column("content").to_pylist(), known)
        owner = _segments(sizes)
        flat = flat[np.lexsort((flat, owner))]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        names = []
        for seed in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_mix(flat + np.uint64(seed)), dtype=np.uint64)])
            total = sums[offsets[1:]] - sums[offsets[:-1]]
            names.append(pa.array(_mix(total ^ (sizes.astype(np.uint64) << np.uint64(40))).view(np.int64)))
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))
        out = pa.RecordBatch.from_arrays([batch.column("row_id"), *names, lists], names=["row_id", "hash_a", "hash_b", "codes"])
        yield out.filter(pa.array(sizes > 0))


def word_sets(rows: DataFrame) -> DataFrame:
    """(row_id, hash_a, hash_b, codes) of ``rows(row_id, content)``; rows without words are left out."""
    rows = rows.filter("row_id IS NOT NULL AND content IS NOT NULL")
    return rows.select("row_id", "content").mapInArrow(_word_sets, "row_id string, hash_a long, hash_b long, codes array<long>")


#: Sets that are worked on at once, and sets whose blocks are: both numbers are bits of sort keys.
SETS_AT_ONCE, BLOCKS_AT_ONCE = 1 << 13, 1 << 10


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(set ids, flat codes, sizes) of at most ``SETS_AT_ONCE`` sets."""
    for batch in batches:
        for lo in range(0, len(batch), SETS_AT_ONCE):
            part = batch.slice(lo, SETS_AT_ONCE)
            lists = part.column("codes")
            yield part.column("set_id").to_numpy(zero_copy_only=False), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _buckets(flat: np.ndarray) -> np.ndarray:
    return (flat % np.uint64(FREQUENCY_BUCKETS)).astype(np.int64)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per used counter, and the number of sets at counter -1."""
    n, counts = 0, np.zeros(FREQUENCY_BUCKETS, dtype=np.int64)
    for ids, flat, _ in _sets_of(batches):
        n += len(ids)
        counts += np.bincount(_buckets(flat), minlength=FREQUENCY_BUCKETS)
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], used]).astype(np.int32)), pa.array(np.concatenate([[n], counts[used]]))], names=["bucket", "n"])


def _sketch(code: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Three words a set: the parities of 132 cells that its words fall into; the second holds 48 and 15 bits of size (its last bit is free), the third ``SPARE``."""
    out = np.zeros((3, len(sizes)), dtype=np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    cell = _mix(code + np.uint64(0x51ED27)) % np.uint64(112 + SPARE)
    for j, (lo, hi) in enumerate([(0, 64), (64, 112), (112, 112 + SPARE)]):
        inside = (cell >= lo) & (cell < hi)
        bit = np.where(inside, np.uint64(1) << np.where(inside, cell - np.uint64(lo), np.uint64(0)), np.uint64(0))
        out[j] = np.bitwise_xor.reduceat(bit, starts)
    out[1] |= np.minimum(sizes, LONG).astype(np.uint64) << np.uint64(48)
    return out


def _second_sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set_id, codes) to (set_id, size, p, q): parities of 128 other cells."""
    for ids, flat, sizes in _sets_of(batches):
        starts = (np.cumsum(sizes) - sizes).astype(np.int64)
        cell = _mix(flat + np.uint64(0x7EC0DE)) & np.uint64(127)
        halves = [np.bitwise_xor.reduceat(np.where(cell >> np.uint64(6) == j, np.uint64(1) << (cell & np.uint64(63)), np.uint64(0)), starts).view(np.int64) for j in range(2)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, sizes, *halves)], names=["set_id", "size", "p", "q"])


def _shared_least(n: int, m: int, threshold: float) -> int:
    """Words that sets of n and m words share at least, if their Jaccard index reaches the threshold."""
    return max(1, math.ceil(threshold / (1 + threshold) * (n + m) - 1e-9))


def path_depth(total: float) -> int:
    """Words of a path: as many common ones as leave few accidental partners among ``total`` sets."""
    return max(2, math.ceil(math.log(max(total, 1.0) / 2048) / -math.log(COMMON)))


def _plans(depth: int, threshold: float, largest: int) -> list[tuple[int, int, int]]:
    """(least size, slots, depth): how pairs are found whose larger set has that size or more, by ascending size."""
    out: dict[int, tuple[int, int]] = {}
    for d in range(1, depth + 1):  # sets too small for slots: all paths of d words
        out[math.floor((d - 1) / threshold + 1e-9) + 1] = (1, d)
    slots = 2
    while True:  # powers of two: two words of a slot are in one slot of any fewer, so most blocks serve partners of both plans
        size = math.ceil(max(5.0 * slots, 1.05 * (slots * (depth - 1) + 1) / threshold))
        if size > largest:
            return [(n, *out[n]) for n in sorted(out)]
        out[size] = (slots, depth)
        slots *= 2


def _roles(n: int, plans: list[tuple[int, int, int]], threshold: float) -> list[tuple[int, int, int]]:
    """(slots, depth, least number of shared words) for a set of n words: as the larger of a pair, then for larger partners of another plan."""
    own = max(i for i, p in enumerate(plans) if p[0] <= n)
    out = [(plans[own][1], plans[own][2], max(1, math.ceil(threshold * n - 1e-9)))]
    for least, slots, depth in plans[own + 1 :]:
        if threshold * least <= n + 1e-9:
            out.append((slots, depth, _shared_least(least, n, threshold)))
    return out


def _paths(first: np.ndarray, length: np.ndarray, depth: np.ndarray, code: np.ndarray, weight: np.ndarray, need: float, mine) -> tuple[np.ndarray, np.ndarray]:
    """(segment, block) of every path of the words at ``first`` to ``first + length`` of each segment whose first word is ``mine``."""
    seg = np.arange(len(first))
    at = np.full(len(first), -1, dtype=np.int64)
    block = np.full(len(first), 0xABCDEF, dtype=np.uint64)
    info = np.zeros(len(first))
    segs, blocks = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.uint64)]
    level = 0
    while len(seg):
        level += 1
        more = np.maximum(length[seg] - at - 1, 0)
        parent = np.repeat(np.arange(len(seg)), more)
        at = at[parent] + 1 + np.arange(len(parent)) - np.repeat(np.cumsum(more) - more, more)
        if level == 1:
            own = mine(code[first[seg[parent]] + at])
            parent, at = parent[own], at[own]
        word = first[seg[parent]] + at
        block = _mix(block[parent] * np.uint64(3) + code[word])
        info, seg = info[parent] + weight[word], seg[parent]
        done = (info >= need) | (depth[seg] <= level)
        segs.append(seg[done])
        blocks.append(block[done])
        seg, at, block, info = seg[~done], at[~done], block[~done], info[~done]
    return np.concatenate(segs), np.concatenate(blocks)


def _blocks_of(n: np.ndarray, start: np.ndarray, slots: np.ndarray, depth: np.ndarray, least: np.ndarray, code: np.ndarray, weight: np.ndarray, need: float, mine) -> tuple[np.ndarray, np.ndarray]:
    """(which, block) of sets of n ordered words at ``start``, each in the role of its slots, depth and least number of shared words; the blocks whose first word is ``mine``."""
    end = np.minimum(n, n - least + slots * (depth - 1) + 1)
    which = np.repeat(np.arange(len(n)), end)
    place = np.arange(len(which)) - np.repeat(np.cumsum(end) - end, end)
    word = start[which] + place
    rare = weight[word] >= need
    alone = rare & (place < (n - least + 1)[which]) & mine(code[word])
    one = _mix(np.uint64(0xABCDEF * 3) + code[word[alone]])
    common = ~rare
    which_c, word_c = which[common], word[common]
    slot = _mix(code[word_c] + np.uint64(0x5107)) % slots[which_c].astype(np.uint64)
    order = np.lexsort((np.arange(len(slot)), slot, which_c))
    which_c, word_c, slot = which_c[order], word_c[order], slot[order]
    if not len(which_c):
        return which[alone], one
    head = np.flatnonzero(np.r_[True, (which_c[1:] != which_c[:-1]) | (slot[1:] != slot[:-1])])
    length = np.diff(np.r_[head, len(which_c)])
    seg, block = _paths(head, length, depth[which_c[head]], code[word_c], weight[word_c], need, mine)
    return np.r_[which[alone], which_c[head][seg]], np.r_[one, block]


_BLOCK_MASK = np.uint64((1 << 43) - 1)


def _block_rows(counts: np.ndarray, total: float, need: float, depth: int, threshold: float, part: int, parts: int):
    """Function from (set_id, codes) batches to block rows (block, set_id, sketch_a, sketch_b), of one part of all first words.

    The last bit of a sketch marks a guest: a block that the set has only for partners larger than itself,
    so that two guests need not be compared.
    """
    idf = np.maximum(np.log(max(total, 2.0) / np.maximum(counts, 1)), 0.05).astype(np.float32)
    rank = np.unique(counts, return_inverse=True)[1].astype(np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list[tuple[int, int, int]]] = {}
        plans = _plans(depth, threshold, 1 << 40)
        mine = lambda code: (code >> np.uint64(40)) % np.uint64(parts) == part
        for ids, flat, sizes in _sets_of(batches):
            first = np.cumsum(sizes) - sizes
            owner = _segments(sizes)
            code, bucket = _mix(flat + np.uint64(0x1234567)), _buckets(flat)
            sketch = _sketch(code, sizes)
            # by set, then frequency, then code: codes are in order, so the place in the set stands for the code
            key = np.sort(owner.astype(np.uint64) << np.uint64(51) | rank[bucket].astype(np.uint64) << np.uint64(30) | (np.arange(len(flat)) - first[owner]).astype(np.uint64))
            order = first[owner] + (key & np.uint64((1 << 30) - 1)).astype(np.int64)
            code, weight = code[order], idf[bucket[order]].astype(np.float64)
            which, roles, guest = [], [], []
            for i, n in enumerate(sizes.tolist()):
                mine_too = known.get(n)
                if mine_too is None:
                    mine_too = known[n] = _roles(n, plans, threshold)
                which += [i] * len(mine_too)
                roles += mine_too
                guest += range(len(mine_too))
            which, guest = np.array(which), np.array(guest) > 0
            slots, deep, least = np.array(roles, dtype=np.int64).reshape(-1, 3).T
            for lo in range(0, len(sizes), BLOCKS_AT_ONCE):
                own = slice(*np.searchsorted(which, [lo, lo + BLOCKS_AT_ONCE]))
                doc = which[own]
                role, block = _blocks_of(sizes[doc], first[doc], slots[own], deep[own], least[own], code, weight, need, mine)
                # of a set's equal blocks one that is no guest's comes first
                key = np.sort((doc[role] - lo).astype(np.uint64) << np.uint64(44) | (block & _BLOCK_MASK) << np.uint64(1) | guest[own][role])
                key = key[np.r_[True, key[1:] >> np.uint64(1) != key[:-1] >> np.uint64(1)][: len(key)]]
                doc = lo + (key >> np.uint64(44)).astype(np.int64)
                last = sketch[1, doc] | (key & np.uint64(1)) << np.uint64(63)
                found = (((key >> np.uint64(1)) & _BLOCK_MASK) << np.uint64(SPARE) | sketch[2, doc], ids[doc], sketch[0, doc], last)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in found], names=["block", "set_id", "sketch_a", "sketch_b"])

    return run


_BLOCK = "block long, set_id long, sketch_a long, sketch_b long"
_FOUND = "a long, b long, hot_block long, sketch_a long, sketch_b long"
_BITS = np.uint64((1 << 48) - 1)
_GUEST = np.uint64(1 << 63)


def _size(y: np.ndarray) -> np.ndarray:
    return ((y >> np.uint64(48)) & np.uint64(LONG)).astype(np.int32)


def _found(a: np.ndarray, b: np.ndarray | None, hot: tuple[np.ndarray, np.ndarray, np.ndarray] | None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    more = [none] * 3 if hot is None else [pa.array(hot[0]), pa.array(hot[1].view(np.int64)), pa.array(hot[2].view(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), *more], names=["a", "b", "hot_block", "sketch_a", "sketch_b"])


PAIRS_AT_ONCE = 400_000


def _once(held: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = (np.concatenate(z) for z in zip(*held))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
    return _found(a[keep], b[keep], None)


def _close_pairs(threshold: float, most: int | None):
    """Function from blocks in sorted order to (a, b, nulls) pairs that sketches allow, and (member, null, block, sketch) rows of blocks above ``most``.

    Of rows with a ``side`` above 0 only those of different sides are compared.
    """
    share = (1 - threshold) / (1 + threshold)

    def sweep(large: list[np.ndarray], small: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Pairs of an owner and a member that is not larger, of lists sorted by size."""
        n = _size(small[2])
        owners = (large[2] & _GUEST) == 0
        ids, x, y, e = (z[owners] for z in large)
        m = _size(y)
        y, bits, host = y & _BITS, small[2] & _BITS, (small[2] & _GUEST) == 0
        # in eight bits first: no bound is above the 112 cells, and two rounded halves lose at most one
        of_large, of_small = (np.minimum(share * z, 112).astype(np.uint8) for z in (m, n))
        of_small = of_small.view(np.int8) + np.int8(1)
        for lo in range(0, len(ids), 128):
            hi = min(lo + 128, len(ids))
            i, j = np.searchsorted(n, threshold * m[lo] - 1e-6), np.searchsorted(n, m[hi - 1], "right")
            if i >= j:
                continue
            differ = np.bitwise_count(x[lo:hi, None] ^ small[1][None, i:j])
            differ += np.bitwise_count(y[lo:hi, None] ^ bits[None, i:j])
            differ -= of_large[lo:hi, None]
            p, q = np.divmod(np.flatnonzero(differ.view(np.int8) <= of_small[None, i:j]), j - i)
            a, b, k, l = ids[lo:hi][p], small[0][i:j][q], m[lo:hi][p], n[i:j][q]
            apart = differ[p, q].view(np.int8) + of_large[lo:hi][p].astype(np.int64) + np.bitwise_count(e[lo:hi][p] ^ small[3][i:j][q])
            good = (a != b) & (l >= threshold * k - 1e-6) & ((apart <= share * (k + l) + 1e-3) | (k >= LONG))
            good &= (k != l) | (a < b) | ~host[i:j][q]  # of equal sizes one order is enough
            if good.any():
                yield _found(np.minimum(a[good], b[good]), np.maximum(a[good], b[good]), None)

    def pairs(block: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, side: np.ndarray, e: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        size = np.diff(np.r_[starts, len(block)])
        per = np.repeat(size, size)
        crowded = per > most if most else np.zeros(len(per), dtype=bool)
        if crowded.any():
            yield _found(ids[crowded], None, (block[crowded] << SPARE | e[crowded].view(np.int64), x[crowded], y[crowded]))
        for at, k in zip(starts, size):
            if k > SMALL_BLOCK and not crowded[at]:
                order = at + np.argsort(_size(y[at : at + k]), kind="stable")
                parts = [order] if side[at] == 0 else [order[side[order] == 1], order[side[order] == 2]]
                one, two = ([z[i] for z in (ids, x, y, e)] for i in (parts[0], parts[-1]))
                yield from sweep(one, two)
                if len(parts) > 1:
                    yield from sweep(two, one)
        keep = (per > 1) & (per <= SMALL_BLOCK) & ~crowded
        block, ids, x, y, side, e = (z[keep] for z in (block, ids, x, y, side, e))
        n, at, step = _size(y), np.arange(len(block)), 1
        while True:
            at = at[at < len(block) - step]
            at = at[block[at] == block[at + step]]
            if not len(at):
                return
            to = at + step
            differ = np.bitwise_count(x[at] ^ x[to]) + np.bitwise_count((y[at] ^ y[to]) & _BITS) + np.bitwise_count(e[at] ^ e[to])
            small, large = np.minimum(n[at], n[to]), np.maximum(n[at], n[to])
            close = ((differ <= share * (small + large) + 1e-3) | (large >= LONG)) & (small >= threshold * large - 1e-6)
            close &= (ids[at] != ids[to]) & ((y[at] & y[to] & _GUEST) == 0) & ((side[at] == 0) | (side[at] != side[to]))
            near, far = ids[at[close]], ids[to[close]]
            if len(near):
                yield _found(np.minimum(near, far), np.maximum(near, far), None)
            step += 1

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            side = now[4] if len(now) > 4 else np.zeros(len(now[0]), dtype=np.int32)
            now = [now[0] >> SPARE, now[1], now[2].view(np.uint64), now[3].view(np.uint64), side, (now[0] & ((1 << SPARE) - 1)).view(np.uint64)]
            if rest is not None:
                now = [np.concatenate(z) for z in zip(rest, now)]
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0
            if most and len(now[0]) - cut > 8 * most:  # the last block is hot whatever follows: pass on what is here
                last = slice(len(now[0]) - most - 1, None)  # enough stays to know it as hot
                gone = slice(cut, last.start)
                yield _found(now[1][gone], None, (now[0][gone] << SPARE | now[5][gone].view(np.int64), now[2][gone], now[3][gone]))
                rest = [z[last] for z in now]
            else:
                rest = [z[cut:] for z in now]
            yield from pairs(*[z[:cut] for z in now])
        if rest is not None and len(rest[0]):
            yield from pairs(*rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A pair that shares many blocks of the task is passed on once for every ``PAIRS_AT_ONCE`` rows."""
        held, n = [], 0
        for batch in swept(batches):
            if batch.column("b").null_count:
                yield batch
                continue
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            n += len(batch)
            if n > PAIRS_AT_ONCE:
                yield _once(held)
                held, n = [], 0
        if n:
            yield _once(held)

    return run


def _candidates(blocks: DataFrame, threshold: float, most: int | None) -> DataFrame:
    """Set ids a < b that share a block and have close sketches; or a member of a hot block, with its sketch."""
    placed = blocks.repartition(F.shiftright("block", SPARE)).sortWithinPartitions("block")
    return placed.mapInArrow(_close_pairs(threshold, most), _FOUND)


def _pairs_of(found: DataFrame) -> DataFrame:
    return found.filter("b IS NOT NULL").select("a", "b")


def similar_sets(sets: DataFrame, threshold: float = THRESHOLD, hot_block: int = HOT_BLOCK, rounds: int = ROUNDS) -> DataFrame:
    """(a, b, similarity), a < b: all pairs of different word sets ``sets(set_id, codes)`` at or above the threshold; each set once."""
    spark = sets.sparkSession
    stage = Staging(spark, "near-duplicates")
    counted = sets.mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    table = counted.toPandas()  # at most FREQUENCY_BUCKETS + 1 rows at any data size
    total = float(table.loc[table["bucket"] < 0, "n"].sum())
    table = table[table["bucket"] >= 0]
    counts = np.zeros(FREQUENCY_BUCKETS, dtype=np.int64)
    counts[table["bucket"].to_numpy(dtype=np.int64)] = table["n"].to_numpy(dtype=np.int64)
    need, depth = math.log(max(total / COINCIDENCES, 3.0)), path_depth(total)
    near = []
    for part in range(rounds):
        blocks = sets.mapInArrow(_block_rows(counts, total, need, depth, threshold, part, rounds), _BLOCK)
        found = stage.cut(_candidates(blocks, threshold, hot_block))
        near.append(_pairs_of(found))
        hot = found.filter("hot_block IS NOT NULL").select(F.col("hot_block").alias("block"), F.col("a").alias("set_id"), "sketch_a", "sketch_b")
        if not hot.isEmpty():
            near.append(_hot_pairs(hot.dropDuplicates(["block", "set_id"]), threshold, hot_block))
    # a second, independent sketch spares most pairs that merely look close the join with their word codes;
    # both sides grow with the data, so the joins are merges at every size
    sketch = sets.mapInArrow(_second_sketches, "set_id long, size long, p long, q long")
    of = lambda end: sketch.select(F.col("set_id").alias(end), *[F.col(c).alias(f"{c}_{end}") for c in ("size", "p", "q")])
    met = functools.reduce(DataFrame.unionByName, near).distinct().join(of("a").hint("merge"), "a").join(of("b").hint("merge"), "b")
    apart = F.bit_count(F.col("p_a").bitwiseXOR(F.col("p_b"))) + F.bit_count(F.col("q_a").bitwiseXOR(F.col("q_b")))
    share = (1 - threshold) / (1 + threshold)
    pairs = stage.cut(met.filter(apart <= share * (F.col("size_a") + F.col("size_b")) + 1e-3).select("a", "b"))
    # word codes travel for the sets of some pair only
    asked = pairs.select(F.explode(F.array("a", "b")).alias("set_id")).distinct()
    paired = stage.cut(sets.join(asked, "set_id", "left_semi"))
    left = paired.select(F.col("set_id").alias("a"), F.col("codes").alias("codes_a"))
    right = paired.select(F.col("set_id").alias("b"), F.col("codes").alias("codes_b"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", F.size(F.array_intersect("codes_a", "codes_b")).alias("common"), (F.size("codes_a") + F.size("codes_b")).alias("together"))
    # Hamming distance of the full fingerprints against its bound at the threshold
    distance = F.col("together") - 2 * F.col("common")
    bound = F.lit(share) * F.col("together")
    checked = both.filter(distance <= bound + 1e-9).select("a", "b", (F.col("common") / (F.col("together") - F.col("common"))).alias("similarity"))
    return stage.cut(checked)


def _hot_pairs(hot: DataFrame, threshold: float, hot_block: int) -> DataFrame:
    """Candidates within hot blocks ``hot(block, set_id, sketch_a, sketch_b)``: members are dealt to parts, and every two parts of a block meet in a cell."""
    hot = hot.withColumn("cells", F.col("block").bitwiseAND((1 << SPARE) - 1)).withColumn("block", F.shiftright("block", SPARE))
    parts = hot.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / hot_block).cast("int").alias("parts"))
    dealt = hot.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("block", "set_id"), "parts").cast("int"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = F.xxhash64("block", F.least("part", "other"), F.greatest("part", "other"))
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    return _pairs_of(_candidates(cells.select(F.shiftleft(block.bitwiseAND(int(_BLOCK_MASK)), SPARE).bitwiseOR(F.col("cells")).alias("block"), "set_id", "sketch_a", "sketch_b", side.cast("int").alias("side")), threshold, None))


def _prepared(rows: DataFrame, threshold: float, hot_block: int) -> tuple[DataFrame, DataFrame]:
    """(row_id, set_id) of all rows, and the pairs of sets; a set's id is the number of its first row."""
    stage = Staging(rows.sparkSession, "word-sets")
    named = stage.cut(word_sets(rows).withColumn("n", F.monotonically_increasing_id()))
    first = named.groupBy("hash_a", "hash_b").agg(F.min("n").alias("set_id"))
    copies = stage.cut(named.select("n", "hash_a", "hash_b").join(first.hint("merge"), ["hash_a", "hash_b"]).filter("n <> set_id").select("n", "set_id"))
    sets = stage.cut(named.select("n", "codes").join(copies.select("n"), "n", "left_anti").select(F.col("n").alias("set_id"), "codes"))
    member = stage.cut(named.select("n", "row_id").join(copies, "n", "left").select("row_id", F.coalesce("set_id", "n").alias("set_id")).distinct())
    stage.drop(named)
    return member, similar_sets(sets, threshold, hot_block)


def near_duplicate_pairs(rows: DataFrame, threshold: float = THRESHOLD, hot_block: int = HOT_BLOCK) -> DataFrame:
    """(row_id_a, row_id_b), a < b: all pairs of different ids of ``rows(row_id, content)`` at the threshold."""
    member, pairs = _prepared(rows, threshold, hot_block)
    left = member.select(F.col("row_id").alias("x"), F.col("set_id").alias("a"))
    right = member.select(F.col("row_id").alias("y"), F.col("set_id").alias("b"))
    across = pairs.select("a", "b").join(left, "a").join(right, "b").select("x", "y")
    # rows of equal sets: only the sets of several rows go into the join
    shared = member.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("set_id").alias("a"))
    within = left.join(shared, "a", "left_semi").join(right, F.col("a") == F.col("b")).filter("x < y").select("x", "y")
    out = across.unionByName(within).filter("x <> y").select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))
    return out.distinct()


def near_duplicate_classes(rows: DataFrame, threshold: float = THRESHOLD, hot_block: int = HOT_BLOCK) -> DataFrame:
    """(row_id, class_id, n_links): one row per row with words; class_id is the smallest id linked to it.

    n_links counts the row's links to different word sets and to copies of its own, without
    expanding copies into pairs.
    """
    member, pairs = _prepared(rows, threshold, hot_block)
    stage = Staging(rows.sparkSession, "near-classes")
    pairs = stage.cut(pairs.select("a", "b"))
    size = member.groupBy("set_id").agg(F.count(F.lit(1)).alias("copies"), F.min("row_id").alias("first_row"))
    linked = connected_components(pairs).select(F.col("node").alias("set_id"), "component")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partners = both.join(size.select(F.col("set_id").alias("b"), "copies"), "b").groupBy(F.col("a").alias("set_id")).agg(F.sum("copies").alias("partners"))
    sets = stage.cut(size.join(linked, "set_id", "left").join(partners, "set_id", "left").select("set_id", "copies", "first_row", F.coalesce("component", "set_id").alias("component"), F.coalesce("partners", F.lit(0)).alias("partners")))
    named = sets.groupBy("component").agg(F.min("first_row").alias("class_id"))
    per_set = sets.join(named, "component").select("set_id", "class_id", (F.col("copies") - 1 + F.col("partners")).alias("n_links"))
    return member.join(per_set, "set_id").groupBy("row_id").agg(F.min("class_id").alias("class_id"), F.sum("n_links").alias("n_links"))
