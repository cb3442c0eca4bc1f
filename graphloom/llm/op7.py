"""N-gram Jaccard join with count vectors and R-tree pages.

Documents are sets of distinct word shingles; two link when ``den * intersection >= num * union``.

1. Equal sets are one class from here on (128-bit set hash); copies are never compared.
2. Shingle hashes fall into groups. Two linked sets differ in few shingles; with one more group than that, by size class,
   some group holds the same shingles in both. Each set sends a signature of each group's shingles, so sets that can
   link meet at a signature. Signatures travel packed in buckets. They part the points before any tree is built.
3. Each set is also a point: how many of its shingles fall into each of four times as many groups as it has shingles, up to
   a power of two. The sum of coordinate minima bounds the intersection of two sets (the finer point is added up to the coarser one's
   groups); pairs whose bound is too low are dropped unseen.
4. At each signature the first set is held against the others (bound, then exact). What this links is one component.
   Where members still lie in different components, their points are packed into an R-tree: pages of near points with
   their largest coordinates; page pairs, then pairs, of different components are bounded, and all survivors verified. No
   link between components is missed, and no pair inside one is made. One signature in ``SCOUT`` is searched first, the others
   with the components that these make, so that sets which meet at many signatures are paired at few. Signatures with the
   same members are searched once; large ones are split into pairs of tiles that go to different tasks.
5. Links are counted inside components, where all of them lie: the sets of a component meet in tiles of bounded bytes, and
   products of their shingle matrices give all intersections. Counts leave a task, never pairs.

Defined results: null or empty text has the empty set and links with nothing; rows without an id get no component; rows
that share an id are one document in the graph; extra columns are ignored; an empty table gives an empty result.
Shingles are compared by 64-bit hash.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets, discard, materialize, steps, text_batches
from .components import connected
from .words import U, Words, grams, mix, place, whole

SHINGLE, NUM, DEN = 3, 90, 100
#: Coordinates of a point at least and at most, points of a page, bytes of points in a tile.
LEAST, MOST, PAGE, TILE = 64, 1 << 17, 64, 8 << 20
#: One group of signatures in so many is searched first.
SCOUT = 16
#: Coordinates for each shingle at least: with few shingles to a group, shingles that differ seldom meet.
FINE = 4
FULL, MANY = 255, 65535
#: Bytes of packed texts in a tile where links are counted, columns of a matrix at once, and the most sets of a tile.
LINK_BYTES, COLUMNS, LINK_SETS = 4 << 20, 2048, 2048
#: Size classes of sets grow by this factor.
GROWTH = 1.3
SETS = "doc_id long, n long, s1 long, s2 long, point binary"


# --- shingles ----------------------------------------------------------------------------------------------


def shingles(column: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each distinct shingle, by row; fewer than k words are one shingle."""
    w = Words(column, lower=True)
    h = w.hashes()
    got = grams(h, k)
    ok = whole(w.first, k)
    rows, out = [w.rows()[: len(got)][ok]], [got[ok]]
    for n in range(1, k):
        few = np.flatnonzero(w.counts == n)
        if len(few):
            rows.append(few)
            out.append(grams(h, n)[w.first[few]])
    row, value = np.concatenate(rows), np.concatenate(out)
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


def _sums(row, value, n_rows):
    """Size and 128-bit hash of each row's set."""
    at = np.searchsorted(row, np.arange(n_rows + 1))
    total = lambda x: np.diff(np.append(U(0), np.cumsum(x, dtype=U))[at])
    return np.diff(at), total(mix(value)), total(mix(value ^ U(0x5BD1E9955BD1E995))), at


def coordinates(n: np.ndarray) -> np.ndarray:
    """How many coordinates the point of a set of n shingles has: a power of two."""
    return np.clip(FINE * 2 ** np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), LEAST, MOST)


def points(row: np.ndarray, value: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The point of each set: counts of shingles by the upper bits of their hashes."""
    size = coordinates(n)
    first = np.cumsum(size) - size
    shift = (64 - np.log2(size).astype(np.int64))[row].astype(U)
    counts = np.bincount(first[row] + (value >> shift).astype(np.int64), minlength=int(size.sum())) if len(row) else np.zeros(int(size.sum()), np.int64)
    counts = np.minimum(counts, FULL).astype(np.uint8)
    return [counts[i : i + m].tobytes() for i, m in zip(first, size, strict=True)]


def folded(column: list[bytes], size: int) -> np.ndarray:
    """Points added up to ``size`` coordinates each."""
    out = np.empty((len(column), size), np.uint16)
    for i, p in enumerate(column):
        x = np.frombuffer(p, np.uint8)
        out[i] = x if len(x) == size else np.minimum(x.reshape(size, -1).sum(1), MANY)
    return out


def _unpacked(column: pa.Array) -> list[bytes]:
    undo = zstandard.ZstdDecompressor()
    return [undo.decompress(x) for x in column.to_pylist()]


def _sets(k: int):
    def run(batches):
        pack = zstandard.ZstdCompressor(level=1)  # most counts are 0 or 1: about a bit each
        for b in steps(batches):
            row, value = shingles(b.column("text"), k)
            n, s1, s2, _ = _sums(row, value, b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), pa.array([pack.compress(p) for p in points(row, value, n)], pa.binary())],
                ["doc_id", "n", "s1", "s2", "point"],
            )

    return run


# --- signatures ----------------------------------------------------------------------------------------------


def size_classes(n: np.ndarray, num: int, den: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each set the class of its size, and the next one if a larger partner may lie there; -1 where not."""
    k = np.floor(np.log(np.maximum(n, 1)) / np.log(GROWTH) + 1e-9).astype(np.int64)
    k += n >= np.ceil(GROWTH ** (k + 1))
    k -= n < np.ceil(GROWTH**k)
    above = np.ceil(GROWTH ** (k + 1)).astype(np.int64)
    return [k, np.where(den * n >= num * above, k + 1, -1)]


@lru_cache(4096)
def _split(k: int, num: int, den: int) -> tuple[int, int]:
    """Groups of a size class, and how many of them may be empty without being sent.

    A symmetric difference of d spoils at most d groups, so with d + 1 + e groups at least e + 1 agree. They can all be
    empty only in sets with more than e empty groups; only those send their empty groups too. e is picked so that sets of
    the class hardly ever have so many.
    """
    least, most = int(np.ceil(GROWTH**k)), int(np.ceil(GROWTH ** (k + 1))) - 1
    # intersection >= num (a + b) / (num + den), so the difference is at most (den - num) (a + b) / (num + den)
    d = (den - num) * 2 * most // (num + den)
    if not d:
        return 1, 0
    for e in range(1, d + 4):
        empty = (d + 1 + e) * np.exp(-least / (d + 1 + e))
        if empty + 5 * empty**0.5 + 1 <= e:
            break
    return d + 1 + e, e


def signatures(row, value, n, num, den) -> tuple[np.ndarray, np.ndarray]:
    """Row and signature of each group of each set; empty groups only of sets that have many of them."""
    rows, out = [], []
    for k in size_classes(n, num, den):
        many, spare = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for c in np.unique(k[n > 0]).tolist():
            if c >= 0 and (split := _split(c, num, den))[0] > 1:  # one group: only equal sets, and those are one class
                own = (k == c) & (n > 0)
                many[own], spare[own] = split
        first = np.cumsum(many) - many
        pick = many[row] > 0
        r, v = row[pick], value[pick]
        group = (((mix(v ^ U(0x1234567)) >> U(32)) * many[r].astype(U)) >> U(32)).astype(np.int64)
        total, held = np.zeros(int(many.sum()), U), np.zeros(int(many.sum()), bool)
        np.add.at(total, first[r] + group, mix(v ^ U(0x7F4A7C15)))
        held[first[r] + group] = True
        each = np.repeat(np.arange(len(n)), many)
        empty = many - np.bincount(each, weights=held, minlength=len(n)).astype(np.int64)
        sent = held | (empty > spare)[each]
        nth = np.arange(len(total)) - first[each]
        rows.append(each[sent])
        out.append(mix(total + mix((np.repeat(k, many) * 1_000_003 + nth).astype(U)))[sent])
    return np.concatenate(rows), np.concatenate(out)


def _signed(k: int, num: int, den: int, buckets: int):
    def run(batches):
        for b in steps(batches):
            row, value = shingles(b.column("text"), k)
            n, s1, _, _ = _sums(row, value, b.num_rows)
            first = np.zeros(b.num_rows, bool)
            first[np.unique(s1, return_index=True)[1]] = True  # copies in a batch send once
            keep = first[row]
            row, sig = signatures(row[keep], value[keep], np.where(first, n, 0), num, den)
            where = place(sig, buckets)
            order = np.argsort(where, kind="stable")
            where, sig, sid = where[order], sig[order].astype(np.uint32), s1[row[order]]
            cut = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else np.empty(0, np.int64)
            ends = np.append(cut[1:], len(where))[: len(cut)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(where[cut], pa.int32()), pa.array([sig[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary()), pa.array([sid[i:j].tobytes() for i, j in zip(cut, ends, strict=True)], pa.binary())],
                ["bucket", "sig", "sid"],
            )

    return run


def _shared(t: pa.Table) -> pa.Table:
    """Signatures that several sets have: (group, members)."""
    bucket = t.column("bucket")[0].as_py()
    sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32)
    sid = np.frombuffer(b"".join(t.column("sid").to_pylist()), np.int64)
    order = np.lexsort((sid, sig))
    sig, sid = sig[order], sid[order]
    keep = np.ones(len(sig), bool)
    keep[1:] = (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1])
    sig, sid = sig[keep], sid[keep]
    head = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    size = np.diff(np.append(head, len(sig)))
    many = size > 1
    member = np.repeat(many, size)
    group = np.repeat((np.int64(bucket) << 32) | sig[head].astype(np.int64), size)
    lead = np.repeat(sid[head], size)
    return pa.table({"gid": pa.array(group[member]), "lead": pa.array(lead[member]), "sid": pa.array(sid[member])})


# --- bounds, pages, verification --------------------------------------------------------------------------------


def enough(both, a, b, num, den):
    """Whether an intersection makes two sets of these sizes link."""
    return (num + den) * both >= num * (a + b)


def _full(column: list[bytes]) -> np.ndarray:
    """Points with a count that may be larger than a byte tells: their bound is no bound."""
    return np.array([FULL in p for p in column], bool)


def _minima(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.minimum(p, q).sum(-1, dtype=np.int32)


def _bounded(num: int, den: int):
    """Pairs whose summed coordinate minima allow a link."""

    def run(batches):
        for b in batches:
            p, q = _unpacked(b.column("pa")), _unpacked(b.column("pb"))
            na, nb = b.column("na").to_numpy(), b.column("nb").to_numpy()
            least = np.minimum([len(x) for x in p], [len(x) for x in q])
            ok = _full(p) | _full(q)
            for size in np.unique(least):
                every = np.flatnonzero((least == size) & ~ok)
                for i in range(0, len(every), step := max(1, (1 << 22) // int(size))):
                    some = every[i : i + step]
                    x, y = (folded([z[j] for j in some], int(size)) for z in (p, q))
                    ok[some] = enough(_minima(x, y).astype(np.int64), na[some], nb[some], num, den)
            yield b.filter(pa.array(ok))

    return run


def rtree_pairs(point: list[bytes], n: np.ndarray, comp: np.ndarray, tile: np.ndarray, num: int, den: int):
    """Pairs of different components whose bound allows a link; between two tiles if there are two.

    Points are packed into pages by size and leading coordinates (sort-tile-recursive); a page keeps its largest
    coordinates and sizes, which bound all its pairs with another page at once. Pages and pairs are bounded by coordinates
    added up to ``LEAST`` first, and what is left by more of them, at last by all.
    """
    if len(n) < 2:
        return np.empty((0, 2), np.int64)
    size = min(map(len, point))
    levels = [folded(point, s) for s in sorted({LEAST, max(LEAST, size // FINE), size})]
    coarse = levels[0].astype(np.int32)
    full = _full(point) | (coarse >= MANY).any(1)
    spread = np.argsort(-coarse.var(0), kind="stable")
    strip = max(1, int(np.ceil((len(n) / PAGE) ** 0.5)) * PAGE)
    order = np.argsort(n, kind="stable")
    order = np.concatenate([s[np.lexsort((coarse[s, spread[1]], coarse[s, spread[0]]))] for s in (order[i : i + strip] for i in range(0, len(order), strip))])
    pages = [order[i : i + PAGE] for i in range(0, len(order), PAGE)]
    top = np.stack([coarse[p].max(0) for p in pages])
    low, high = np.array([n[p].min() for p in pages]), np.array([n[p].max() for p in pages])
    spill = np.array([full[p].any() for p in pages])
    two = len(np.unique(tile)) > 1
    out = []
    for i, p in enumerate(pages):
        rest = np.arange(i, len(pages))
        bound = np.minimum(top[i], top[rest]).sum(1, dtype=np.int64)
        near = enough(bound, low[i], low[rest], num, den) & (den * high[i] >= num * low[rest]) & (den * high[rest] >= num * low[i])
        for j in rest[near | full[p].any() | spill[rest]]:
            q = pages[j]
            allowed = comp[p][:, None] != comp[q][None, :]
            if two:
                allowed &= tile[p][:, None] != tile[q][None, :]
            a, b = np.nonzero(allowed)
            if i == j:
                a, b = a[a < b], b[a < b]
            a, b = p[a], q[b]
            for x in levels:
                step, keep = max(1, (1 << 21) // x.shape[1]), np.empty(len(a), bool)
                for k in range(0, len(a), step):
                    c, d = a[k : k + step], b[k : k + step]
                    keep[k : k + step] = enough(_minima(x[c], x[d]).astype(np.int64), n[c], n[d], num, den) | full[c] | full[d]
                a, b = a[keep], b[keep]
            out.append(np.stack([a, b], 1))
    return np.concatenate(out) if out else np.empty((0, 2), np.int64)


def _searched(num: int, den: int):
    def run(t: pa.Table) -> pa.Table:
        sid = t.column("sid").to_numpy()
        pairs = rtree_pairs(_unpacked(t.column("point")), t.column("n").to_numpy(), t.column("comp").to_numpy(), t.column("own").to_numpy(), num, den)
        a, b = sid[pairs[:, 0]], sid[pairs[:, 1]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    return run


# --- links -------------------------------------------------------------------------------------------------------


def read_sets(blobs: list[bytes], k: int) -> list[np.ndarray]:
    """The shingle hashes of packed texts."""
    undo, out = zstandard.ZstdDecompressor(), []
    for i in range(0, len(blobs), 64):
        some = [undo.decompress(x).decode() for x in blobs[i : i + 64]]
        row, value = shingles(pa.array(some, pa.large_string()), k)
        at = np.searchsorted(row, np.arange(len(some) + 1))
        out += [value[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
    return out


def linked_copies(sets: list[np.ndarray], copies: np.ndarray, own: np.ndarray, num: int, den: int) -> np.ndarray:
    """For each set the copies of the others that it links with; only between two tiles if there are two.

    Shingles that one set alone has meet nothing; the others are columns of 0 and 1, whose products are intersections.
    """
    n = np.array([len(x) for x in sets])
    _, code, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n)
    shared = many[code] > 1
    row, code = row[shared], np.unique(code[shared], return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    tiles = np.unique(own)
    left = np.flatnonzero(own == tiles[0])
    right = left if len(tiles) == 1 else np.flatnonzero(own != tiles[0])
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, COLUMNS):
        i, j = np.searchsorted(code, (at, at + COLUMNS))
        m = np.zeros((len(sets), min(COLUMNS, int(code[-1]) + 1 - at)), np.float32)
        m[row[i:j], code[i:j] - at] = 1
        both += m[left] @ m[right].T
    total = np.zeros(len(sets), np.int64)
    for at in range(0, len(left), 256):
        some = left[at : at + 256]
        linked = enough(both[at : at + 256].astype(np.int64), n[some][:, None], n[right][None, :], num, den) & (some[:, None] != right[None, :])
        total[some] += linked @ copies[right]
        if len(tiles) > 1:
            total[right] += copies[some] @ linked
    return total


def _counted(k: int, num: int, den: int):
    """Copies that each set of a bucket links with, tile by tile of its components."""

    def run(t: pa.Table) -> pa.Table:
        sid, copies, own = (t.column(c).to_numpy() for c in ("sid", "n_copies", "own"))
        keys = np.stack([t.column(c).to_numpy() for c in ("root", "i", "j")])
        order = np.lexsort(keys)
        keys = keys[:, order]
        heads = np.flatnonzero(np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0)))
        blobs, total = t.column("blob").to_pylist(), np.zeros(len(sid), np.int64)
        for i, j in zip(heads, np.append(heads[1:], len(order)), strict=True):
            some = order[i:j]
            if len(some) > 1:
                total[some] = linked_copies(read_sets([blobs[x] for x in some.tolist()], k), copies[some], own[some], num, den)
        return pa.table({"sid": pa.array(sid), "linked": pa.array(total)})

    return run


def _blobs(k: int):
    """Texts that sets are read from again, packed, by set."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in steps(batches):
            row, value = shingles(b.column("text"), k)
            _, s1, _, _ = _sums(row, value, b.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(s1.view(np.int64)), pa.array([pack.compress(t.encode()) for t in b.column("text").to_pylist()], pa.binary())], ["sid", "blob"])

    return run


def _verified(k: int, num: int, den: int):
    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts, where, pick = [], {}, []
                for name, blob in (("a", "ta"), ("b", "tb")):
                    ids = part.column(name).to_pylist()
                    for j, s in enumerate(ids):
                        if s not in where:
                            where[s] = len(texts)
                            texts.append(part.column(blob)[j].as_py())
                    pick.append([where[s] for s in ids])
                sets = read_sets(texts, k)
                ok = [bool(enough(len(np.intersect1d(sets[x], sets[y], assume_unique=True)), len(sets[x]), len(sets[y]), num, den)) for x, y in zip(*pick, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("ra"), part.column("rb")], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, num: int = NUM, den: int = DEN, links: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies: one row per input row; n_links too with ``links``.

    component_id is the smallest id reachable by links; n_copies counts the documents with an equal set, n_links all other
    documents that this one links with, copies among them.
    """
    text_batches(docs.sparkSession)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sent = buckets(docs)
    sets = materialize(docs.mapInArrow(_sets(k), SETS), "op7-sets")
    named = sets.filter("n > 0 AND doc_id IS NOT NULL")
    # copies have equal points: any of them will do
    classes = materialize(named.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"), F.max("point").alias("point")), "op7-classes")
    signed = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_signed(k, num, den, sent), "bucket int, sig binary, sid binary")
    groups = materialize(signed.groupBy("bucket").applyInArrow(_shared, "gid long, lead long, sid long"), "op7-groups")

    at = classes.select(F.col("s1").alias("sid"), "rep", "n", "point")
    needed = groups.select("sid").distinct().join(at.select("sid", "rep").hint("merge"), "sid")
    needed = materialize(needed, "op7-needed")
    blobs = docs.join(needed.select(F.col("rep").alias("doc_id")).distinct().hint("merge"), "doc_id").select("text").mapInArrow(_blobs(k), "sid long, blob binary")
    # rows that share an id have other texts too
    blobs = materialize(blobs.join(needed.select("sid").hint("merge"), "sid", "left_semi").dropDuplicates(["sid"]), "op7-texts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        for s in "ab":
            pairs = pairs.join(blobs.select(F.col("sid").alias(s), F.col("blob").alias(f"t{s}")).hint("merge"), s)
        return materialize(pairs.select("a", "b", "ra", "rb", "ta", "tb").mapInArrow(_verified(k, num, den), "a long, b long"), name)

    star = groups.filter("lead <> sid").select(F.col("lead").alias("a"), F.col("sid").alias("b")).distinct()
    for s in "ab":
        star = star.join(at.select(F.col("sid").alias(s), F.col("rep").alias(f"r{s}"), F.col("n").alias(f"n{s}"), F.col("point").alias(f"p{s}")).hint("merge"), s)
    star = star.select("a", "b", "ra", "rb", "na", "nb", "pa", "pb")
    star = materialize(star.mapInArrow(_bounded(num, den), star.schema).select("a", "b", "ra", "rb"), "op7-near")
    stars = verified(star, "op7-stars")
    first = connected(stars)

    def searched(root: DataFrame, which: str) -> DataFrame:
        """Verified pairs of different components among the groups ``which``."""
        # groups whose members lie in several components, once for equal members; points join what is left of them
        comp = needed.join(root.withColumnRenamed("node", "rep").hint("merge"), "rep", "left").select("sid", "rep", F.coalesce("root", "rep").alias("comp"))
        member = materialize(groups.filter(which).select("gid", "sid").join(comp.select("sid", "comp").hint("merge"), "sid"), "op7-members")
        mixed = member.groupBy("gid").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("x"), F.max("comp").alias("y"), F.expr("bit_xor(xxhash64(sid))").alias("h"), F.expr("bit_xor(xxhash64(sid, 1))").alias("i"))
        # what is joined is written first: a join of two scans is split where a key is skewed
        mixed = materialize(mixed.filter("x < y").groupBy("m", "h", "i").agg(F.min("gid").alias("gid")).select("gid"), "op7-gids")
        left = materialize(member.join(mixed.hint("merge"), "gid", "left_semi"), "op7-mixed")
        discard(member, mixed)
        # a point unpacked has up to twice FINE coordinates a shingle
        weight = F.greatest(F.lit(LEAST), 2 * FINE * F.col("n"))
        tiles = left.join(at.select("sid", weight.alias("w")).hint("merge"), "sid").groupBy("gid").agg(F.ceil(F.sum("w") / TILE).cast("int").alias("tiles"))
        tiles = materialize(tiles, "op7-tiles")
        tiled = left.join(tiles.hint("merge"), "gid").withColumn("own", F.expr("CAST(pmod(xxhash64(sid), tiles) AS INT)")).withColumn("other", F.expr("explode(sequence(0, tiles - 1))"))
        # points come last, so that tiles of one group are dealt to different tasks and points move once
        tiled = tiled.join(at.select("sid", "n", "point").hint("merge"), "sid").select("gid", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sid", "n", "point", "comp", "own")
        found = materialize(tiled.groupBy("gid", "i", "j").applyInArrow(_searched(num, den), "a long, b long").distinct(), "op7-found")
        discard(left, tiles)
        pairs = found
        for s in "ab":
            pairs = pairs.join(needed.select(F.col("sid").alias(s), F.col("rep").alias(f"r{s}")).hint("merge"), s)
        out = verified(pairs, "op7-more")
        discard(found)
        return out

    # some groups first: what they link need not be searched in all the others that the same sets share
    scout = f"pmod(xxhash64(gid), {SCOUT}) = 0"
    some = searched(first, scout)
    starred = first.select(F.col("node").alias("a"), F.col("root").alias("b"))
    second = materialize(connected(starred.unionByName(some)), "op7-second")
    rest = searched(second, f"NOT {scout}")

    # rows that share an id are one document, whatever their texts
    again = named.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("doc_id")
    again = named.select("doc_id", "s1", "s2", "n").join(again.hint("merge"), "doc_id").join(classes.select("s1", "s2", "n", "rep").hint("merge"), ["s1", "s2", "n"])
    # what the components known so far are made of need not be joined up again
    edges = second.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest).unionByName(again.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    root = materialize(connected(edges).withColumnRenamed("node", "rep"), "op7-roots")
    told = classes.select("s1", "s2", "n", "rep", "n_copies").join(root.hint("merge"), "rep", "left").select("s1", "s2", "n", F.coalesce("root", "rep").alias("least"), "n_copies")
    extra = []
    if links:
        alone = stars.unionByName(some).unionByName(rest).filter("a = b").select(F.col("a").alias("rep"), F.col("a").alias("root"))
        told = told.join(_link_counts(root.unionByName(alone).groupBy("rep").agg(F.min("root").alias("root")), classes, blobs, k, num, den, sent).withColumnRenamed("sid", "s1").hint("merge"), "s1", "left")
        linked = F.coalesce("linked", F.lit(0)) + F.coalesce("n_copies", F.lit(1)) - 1
        extra = [F.when(F.col("doc_id").isNotNull(), linked).otherwise(0).cast("long").alias("n_links")]
    discard(groups, needed, blobs, stars, some, second, rest)
    rows = sets.drop("point").join(told.hint("merge"), ["s1", "s2", "n"], "left")
    own = F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"), F.coalesce("n_copies", F.lit(1).cast("long")).alias("n_copies"), *extra)


def _link_counts(root: DataFrame, classes: DataFrame, blobs: DataFrame, k: int, num: int, den: int, sent: int) -> DataFrame:
    """sid, linked: documents of other sets that a set links with, from the sets of its component.

    Components of one tile share buckets; larger ones go to a task for each pair of tiles.
    """
    sid = classes.select(F.col("s1").alias("sid"), "rep", "n_copies").join(root.hint("merge"), "rep").select("sid", "n_copies", "root")
    member = materialize(sid.join(blobs.select("sid", F.length("blob").alias("w")).hint("merge"), "sid"), "op7-linked")
    tiles = member.groupBy("root").agg(F.ceil(F.greatest(F.sum("w") / LINK_BYTES, F.count(F.lit(1)) / LINK_SETS)).cast("int").alias("tiles"))
    tiles = materialize(tiles, "op7-link-tiles")
    tiled = member.join(tiles.hint("merge"), "root").withColumn("own", F.expr("CAST(pmod(xxhash64(sid), tiles) AS INT)")).withColumn("other", F.expr("explode(sequence(0, tiles - 1))"))
    bucket = F.when(F.col("tiles") > 1, F.col("root")).otherwise(F.expr(f"pmod(xxhash64(root), {8 * sent})"))
    tiled = tiled.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "sid", "n_copies", "own", bucket.alias("bucket"), (F.col("tiles") > 1).alias("large"))
    tiled = tiled.join(blobs.hint("merge"), "sid")
    counted = tiled.groupBy("large", "bucket", "i", "j").applyInArrow(_counted(k, num, den), "sid long, linked long")
    return materialize(counted.groupBy("sid").agg(F.sum("linked").alias("linked")), "op7-counts")


def op7_jaccard_join(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return jaccard_components(table(spark, sf_dir, "documents"), links=True)
