"""Best-fit packing by a grouping genetic algorithm on islands.

Tokenising gives pieces of 1 to ``capacity`` tokens. How they pack depends only on how many pieces each
length has, a histogram of at most ``capacity`` numbers, so the plan stays small however many pieces
there are: a chromosome is a list of bin patterns (which lengths share a bin) with multiplicities.

Islands evolve the plan in parallel Spark tasks. Crossover injects whole well-filled bins of one parent,
takes away the other parent's bins that would use pieces twice, and best-fits the displaced pieces;
mutation empties the worst bins. After each epoch the elite of each island moves to the next. A plan at the
lower bound ``ceil(tokens / capacity)`` is optimal and ends the search.

The k-th piece of a length takes the k-th slot of that length in the plan. k comes from counts by
(partition, length) stored with the pieces, so no length, however frequent, meets in one task.

Defined results: null text is empty text, one piece that holds only the end token; every input row gives
its own pieces, also when ids repeat or are null; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import os
import pickle
import random
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, steps, text_batches

CAPACITY = 2048
#: Words whose ids a worker keeps, and the sum of their lengths.
CACHE_WORDS, CACHE_CHARS = 700_000, 12_000_000
#: Bytes of text whose words are listed at once.
STEP = 1 << 20
ISLANDS, EPOCHS, GENERATIONS, POPULATION = 4, 6, 5, 6
#: Fill from which on a bin is well-filled.
WELL = 0.98
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


# --- tokens -------------------------------------------------------------------------------------------


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each byte: itself if printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of texts as bytes.

    Pieces of the pre-tokeniser never span white space, so words are encoded once each. Words of plain or Latin-1
    letters are one piece and are their own normal form once lower-cased; they go straight to the BPE model. A full stop
    or comma after such a word is a piece of its own. All others go through the whole tokeniser.
    """

    PLAIN = re.compile("[a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        letters = _byte_letters()
        self.letters = {chr(b): letters[b] for b in range(256)}
        self.tails = {c: self._whole([c])[0] for c in ".,"}
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, bytes] = {"": b""}
        self.chars = 0

    def _whole(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, new: list[str]) -> None:
        known, plain, model, other = self.known, self.PLAIN.fullmatch, self.tokenizer.model, []
        for w in new:
            core, tail = (w[:-1], self.tails[w[-1]]) if w[-1] in ".," else (w, b"")
            low = core.lower()
            if not plain(low):
                other.append(w)
                continue
            got = known.get(low)
            if got is None:
                raw = low if low.isascii() else "".join(map(self.letters.__getitem__, low.encode().decode("latin-1")))
                got = known[low] = array("I", [t.id for t in model.tokenize(raw)]).tobytes()
            known[w] = got + tail
        for i in range(0, len(other), 4096):
            some = other[i : i + 4096]
            known.update(zip(some, self._whole(some), strict=True))
        self.chars += sum(map(len, new))

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_WORDS or self.chars > CACHE_CHARS:
            self._empty()
        known, split = self.known, []
        for t in texts:
            t = t.lower() if t.isascii() else t
            split.append(t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
        self._learn(list(set().union(*split) - known.keys()))
        get = known.__getitem__
        return [b"".join(map(get, words)) for words in split]


def _pieces(path: str, capacity: int, end: int):
    def run(batches):
        from pyspark import TaskContext

        part, seen, encoder = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), Encoder(path)
        last = np.array([end], "<u4").tobytes()
        for b in steps(batches, limit=STEP):
            out = [[] for _ in range(7)]
            docs = b.column("doc_id").to_pylist()
            for d, ids in zip(docs, encoder.ids([t or "" for t in b.column("text").to_pylist()]), strict=True):
                ids += last
                n = len(ids) // 4
                for k, at in enumerate(range(0, n, capacity)):
                    size = min(capacity, n - at)
                    for c, v in zip(out, (d, k, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), part, int(seen[size])), strict=True):
                        c.append(v)
                    seen[size] += 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "rank")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return run


# --- plans: lists of (pattern, times); a pattern is a tuple of lengths, longest first --------------------


def best_fit(counts: dict[int, int], capacity: int, rng: random.Random | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Fill bins with the longest piece left, then the longest that still fits; one entry for all bins that come out equal.

    With ``rng``, the first piece is now and then another one.
    """
    left, sizes, out = dict(counts), sorted(k for k, v in counts.items() if v), []
    while sizes:
        use: dict[int, int] = {}
        room, at = capacity, len(sizes) - 1
        if rng and rng.random() < 0.15:
            at = rng.randrange(len(sizes))
        while at >= 0:
            size = sizes[at]
            n = min(room // size, left[size] - use.get(size, 0))
            if n > 0:
                n = 1 if not use else n
                use[size] = use.get(size, 0) + n
                room -= n * size
                at = bisect.bisect_right(sizes, room) - 1
                while at >= 0 and left[sizes[at]] <= use.get(sizes[at], 0):
                    at -= 1
            else:
                at -= 1
        times = min(left[s] // n for s, n in use.items())
        out.append((tuple(s for s, n in sorted(use.items(), reverse=True) for _ in range(n)), times))
        for s, n in use.items():
            left[s] -= n * times
            if not left[s]:
                del sizes[bisect.bisect_left(sizes, s)]
    return out


def bins(plan) -> int:
    return sum(n for _, n in plan)


def fitness(plan, capacity: int) -> tuple:
    """Fewer bins first, then fuller ones (mean square of the fill)."""
    n = bins(plan)
    return (-n, sum(t * (sum(p) / capacity) ** 2 for p, t in plan) / max(1, n))


def _uses(pattern) -> dict[int, int]:
    use: dict[int, int] = {}
    for s in pattern:
        use[s] = use.get(s, 0) + 1
    return use


def fit_in(plan: list, left: dict[int, int], capacity: int) -> list:
    """A plan with pieces best-fitted into the room of its bins, longest first; ``left`` keeps those that fit nowhere."""
    rooms: dict[int, dict[tuple[int, ...], int]] = {}
    for pattern, times in plan:
        own = rooms.setdefault(capacity - sum(pattern), {})
        own[pattern] = own.get(pattern, 0) + times
    order = sorted(rooms)
    for size in sorted((s for s, n in left.items() if n), reverse=True):
        while left[size] and (at := bisect.bisect_left(order, size)) < len(order):
            room = order[at]
            pattern, times = next(iter(rooms[room].items()))
            # what a piece leaves is the tightest room for the next one of its length: a bin takes all that fit
            each = min(room // size, left[size])
            n = min(times, left[size] // each)
            if n == times:
                del rooms[room][pattern]
                if not rooms[room]:
                    del rooms[room], order[at]
            else:
                rooms[room][pattern] = times - n
            cut = bisect.bisect_left(pattern, -size, key=lambda s: -s)
            new = (*pattern[:cut], *[size] * each, *pattern[cut:])
            if room - each * size not in rooms:
                rooms[room - each * size] = {}
                bisect.insort(order, room - each * size)
            own = rooms[room - each * size]
            own[new] = own.get(new, 0) + n
            left[size] -= n * each
    return [(p, n) for room in order for p, n in rooms[room].items()]


def cross(a, b, counts: dict[int, int], capacity: int, rng: random.Random):
    """Whole well-filled bins of b go in; of a's bins as many stay as the pieces left allow; the displaced pieces are
    best-fitted into the room of the bins that stay, then into new ones."""
    left, out = dict(counts), []

    def put(pattern, times):
        use = _uses(pattern)
        times = min([times, *(left[s] // n for s, n in use.items())])
        if times > 0:
            out.append((pattern, times))
            for s, n in use.items():
                left[s] -= n * times
        return times

    full = sorted((x for x in b if sum(x[0]) >= WELL * capacity), key=lambda x: -sum(x[0]))
    for pattern, times in full:
        if rng.random() < 0.5:
            put(pattern, rng.randint(1, times))
    least = rng.choice((WELL, 0.9, 0.0))
    for pattern, times in sorted(a, key=lambda x: -sum(x[0])):
        if sum(pattern) >= least * capacity:
            put(pattern, times)
    out = fit_in(out, left, capacity)
    return out + best_fit({s: n for s, n in left.items() if n}, capacity, rng)


def mutate(a, counts: dict[int, int], capacity: int, rng: random.Random):
    """The emptiest bins and some others are emptied and their pieces best-fitted, in an order of chance."""
    left, out = dict(counts), []
    keep = rng.choice((0.5, 0.8, 0.95))
    for pattern, times in sorted(a, key=lambda x: -sum(x[0])):
        if sum(pattern) == capacity and rng.random() < keep or sum(pattern) >= WELL * capacity and rng.random() < keep / 2:
            out.append((pattern, times))
            for s, n in _uses(pattern).items():
                left[s] -= n * times
    return out + best_fit({s: n for s, n in left.items() if n}, capacity, rng)


def evolve(population, counts, capacity, seed, generations):
    rng = random.Random(seed)
    score = lambda p: fitness(p, capacity)
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    while len(population) < POPULATION:
        population.append(best_fit(counts, capacity, rng if population else None))
    for _ in range(generations):
        if bins(max(population, key=score)) <= least:
            break
        population.sort(key=score, reverse=True)
        young = []
        for _ in range(POPULATION // 2):
            a, b = rng.sample(population[: POPULATION // 2 + 1], 2)
            young += [cross(a, b, counts, capacity, rng), mutate(a, counts, capacity, rng)]
        population = sorted(population + young, key=score, reverse=True)[:POPULATION]
    return sorted(population, key=score, reverse=True)


def plan_bins(spark, counts: dict[int, int], capacity: int = CAPACITY):
    """The best plan of all islands. Islands are rows of a small DataFrame; only plans and elites travel."""
    if not counts:
        return []
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    state = [(i, pickle.dumps([])) for i in range(ISLANDS)]
    best = None
    for epoch in range(EPOCHS):

        def run(batches, epoch=epoch):
            for b in batches:
                for i, p in zip(b.column("island").to_pylist(), b.column("population").to_pylist(), strict=True):
                    got = evolve(pickle.loads(p), counts, capacity, 1000 * epoch + i, GENERATIONS)
                    yield pa.RecordBatch.from_pydict({"island": pa.array([i], pa.int32()), "population": pa.array([pickle.dumps(got)], pa.binary())})

        islands = spark.createDataFrame(state, "island int, population binary").repartition(ISLANDS)
        got = {r.island: pickle.loads(r.population) for r in islands.mapInArrow(run, "island int, population binary").collect()}
        elites = [got[i][0] for i in range(ISLANDS)]
        best = max([*elites, *([best] if best else [])], key=lambda p: fitness(p, capacity))
        # an optimum, or an epoch after the first that won nothing
        if bins(best) <= least or epoch and bins(best) == before:
            break
        before = bins(best)
        state = [(i, pickle.dumps([*got[i][: POPULATION - 1], elites[i - 1]])) for i in range(ISLANDS)]
    return best


def slots(plan):
    """For each length and pattern: first ordinal, first bin, pieces of the length in a bin, place of the first."""
    rows, seen, first = [], {}, 0
    for pattern, times in plan:
        at = 0
        for size, n in sorted(_uses(pattern).items(), reverse=True):
            rows.append((size, seen.get(size, 0), first, n, at))
            seen[size] = seen.get(size, 0) + n * times
            at += size * n
        first += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _assign(table):
    keys = (table[:, 0] << 48) + table[:, 1]

    def run(batches):
        for b in batches:
            length, ordinal = b.column("length").to_numpy(), b.column("ordinal").to_numpy()
            t = table[np.searchsorted(keys, (length << 48) + ordinal, side="right") - 1]
            nth = ordinal - t[:, 1]
            out = {k: b.column(k) for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            out |= {"sequence_id": pa.array(t[:, 2] + nth // t[:, 3]), "offset": pa.array(t[:, 4] + nth % t[:, 3] * length)}
            yield pa.RecordBatch.from_pydict(out)

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    spark = docs.sparkSession
    text_batches(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = materialize(docs.mapInArrow(_pieces(tokenizer, capacity, end), PIECES), "op2-pieces")
    by_part = materialize(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "op2-lengths")
    counts = {r.length: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    table = slots(plan_bins(spark, counts, capacity))
    before = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    placed = pieces.join(before.hint("merge"), ["part", "length"]).withColumn("ordinal", F.col("before") + F.col("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "ordinal").mapInArrow(_assign(table), schema)


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return pack(table(spark, sf_dir, "documents"))
