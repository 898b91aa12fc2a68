"""Pairs of word bags by blocks: rows meet block by block and a product of matrices bounds what each pair shares.

A row has a group, a number of words and features; rows of one group whose sizes allow the
threshold meet in cells of two blocks.  In a cell one product of matrices, or the bits in which
signatures differ, gives for all pairs at once a bound on the words that they share, so no pair
is a row before it passes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from copy import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.cut import Cutter, broadcast_if_small

#: Rows of a block, and of the two sides of a product.
BLOCK, TILE = 24_000, (2_048, 8_192)
#: Rows of a block of signatures, and of the two sides of a table of differences.
SIGNED, STRIP = 48_000, (64, 1_024)
#: Bits of a parity signature; words that are bits of their own; columns that the others are counted in.
PARITY, HOT, REST = 256, 512, 128
#: Most differences for which signatures folded to 64 and to 128 bits are compared; their chance differences soon leave more than that.
FOLDED = (21, 44)
#: Rows by whose words a balance is chosen.
KNOWN = 1_000


def flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The row and the word of each element of a list column without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def counted(row: np.ndarray, spot: np.ndarray, rows: int, width: int) -> np.ndarray:
    return np.bincount(row * width + spot, minlength=rows * width).reshape(rows, width)


def packed(bits: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.packbits(bits.astype(bool), axis=1)], pa.binary())


def balance(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Common words in order, and for each 1, 0 or -1, so that the sums over bags differ much where bags share little.

    Two bags differ in at least as many words as in their sums under any such numbers, so the
    choice, by the first rows in order of ``cls``, changes the work but no result.
    """
    bags = [np.asarray(r["words"], np.int64) for r in rows.orderBy("cls").select(F.slice("words", 1, PARITY).alias("words")).limit(KNOWN).collect()]
    if not bags:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words, n = np.unique(np.concatenate(bags), return_counts=True)
    known = np.sort(words[np.argsort(-n, kind="stable")[:HOT]])
    x = np.array([np.isin(known, b) for b in bags], np.float64)
    x -= x.mean(0)
    first = np.linalg.eigh(x.T @ x)[1][:, -1]
    return known, np.where(np.abs(first) > 0.2 * np.abs(first).mean(), np.sign(first), 0).astype(np.int64)


def parities(rows: DataFrame, known: np.ndarray, weight: np.ndarray, *keep: str) -> DataFrame:
    """``keep`` and n, sign, total of rows with words: for each bit whether an odd number of the words falls on it, and the sum of the words' weights, so two rows differ in no more bits than in words, and in no greater sum."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, word = flat(b.column("words"))
            bits = counted(row, (word % PARITY).astype(np.int64), b.num_rows, PARITY) & 1
            at = np.minimum(np.searchsorted(known, word), max(len(known) - 1, 0))
            value = np.where(known[at] == word, weight[at], 0) if len(known) else np.zeros(len(word))
            total = np.bincount(row, weights=value, minlength=b.num_rows).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.bincount(row, minlength=b.num_rows), pa.int32()), packed(bits), pa.array(total)], names=[*keep, "n", "sign", "total"])

    types = dict(rows.dtypes)
    return rows.select(*keep, "words").mapInArrow(sign, ", ".join(f"{c} {types[c]}" for c in keep) + ", n int, sign binary, total int")


def common(rows: DataFrame) -> list[int]:
    """The words of most rows, at most ``HOT``."""
    n = rows.select(F.explode("words").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r["w"] for r in n.orderBy(F.desc("n"), "w").limit(HOT).collect())


def marked(rows: DataFrame, hot: list[int], *keep: str) -> DataFrame:
    """``keep`` and n, hot, rest of rows with words: a bit for each of the common words, and the other words."""
    known = np.array(hot, np.int64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, word = flat(b.column("words"))
            at = np.minimum(np.searchsorted(known, word), max(len(known) - 1, 0))
            own = known[at] == word if len(known) else np.zeros(len(word), bool)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[~own], minlength=b.num_rows))])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in keep), pa.array(np.bincount(row, minlength=b.num_rows), pa.int32()), packed(counted(row[own], at[own], b.num_rows, HOT)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(word[~own], pa.int64()))],
                names=[*keep, "n", "hot", "rest"],
            )

    types = dict(rows.dtypes)
    return rows.select(*keep, "words").mapInArrow(mark, ", ".join(f"{c} {types[c]}" for c in keep) + ", n int, hot binary, rest array<long>")


def cells(cutter: Cutter, rows: DataFrame, threshold: float, steps: int, block: int | None = None) -> DataFrame:
    """Rows (key, g, n, …) copied to the cells where they meet the rows of their group whose size allows ``threshold``: cell and side, 0 or 1, are added; a block meets itself in a cell of side 0 only.

    Sizes are cut into bands, ``steps`` of which make up the ratio of the threshold, and a band into blocks; without steps all sizes are one band.
    """
    band = F.floor(F.log(F.col("n").cast("double")) * (steps / (1e-9 - math.log(threshold)))).cast("int") if steps else F.lit(0)
    r = rows.withColumn("band", band)
    parts = cutter.cut(r.groupBy("g", "band").agg(F.ceil(F.count(F.lit(1)) / (block or BLOCK)).cast("int").alias("parts")))
    r = r.join(broadcast_if_small(parts, 64), ["g", "band"]).withColumn("own", F.struct("band", F.pmod(F.xxhash64("key"), "parts").cast("int").alias("part"))).drop("parts")
    r = r.withColumn("other", F.explode(F.sequence(F.col("band") - steps, F.col("band") + steps)))
    met = r.join(broadcast_if_small(parts.select("g", F.col("band").alias("other"), F.col("parts").alias("others")), 64), ["g", "other"])
    met = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).withColumn("that", F.struct(F.col("other").alias("band"), "part"))
    return met.select(*rows.columns, F.struct("g", F.least("own", "that").alias("x"), F.greatest("own", "that").alias("y")).alias("cell"), (F.col("own") > F.col("that")).cast("int").alias("side"))


def tiles(x: np.ndarray, y: np.ndarray, nx: np.ndarray, ny: np.ndarray, weight: float, base: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows where the product of the features is at least base + weight * (nx + ny); each pair of one block with itself once."""
    one = lambda m: np.ones((m, 1), np.float32)
    x = np.hstack([x, (base + weight * nx)[:, None], one(len(x))]).astype(np.float32)
    y = np.hstack([y, -one(len(y)), -(weight * ny)[:, None]]).astype(np.float32)
    slack = -0.01 - 2e-6 * float(abs(weight)) * (float(nx.max(initial=0)) + float(ny.max(initial=0)))
    for i in range(0, len(x), TILE[0]):
        for j in range(i if same else 0, len(y), TILE[1]):
            d = x[i : i + TILE[0]] @ y[j : j + TILE[1]].T
            at = np.flatnonzero(d.ravel() >= slack)
            p, q = at // d.shape[1] + i, at % d.shape[1] + j
            if same:
                p, q = p[p < q], q[p < q]
            if len(p):
                yield p, q


def by_cell(met: DataFrame, take: Callable[[pa.Table, pa.Table | None], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``take`` of the two sides of each cell; the second is None where a block meets itself."""
    columns = [c for c in met.columns if c not in ("cell", "side")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            t = pa.concat_tables(parts)
            side = t.column("side").to_numpy()
            a, b = (t.filter(pa.array(side == k)).combine_chunks() for k in (0, 1))
            if len(a) and (len(b) or t.column("even")[0].as_py()):
                yield from take(a, b if len(b) else None)

        last, parts = None, []
        for batch in batches:
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi > lo:
                    if last is not None and cell[lo] != last:
                        yield from done(parts)
                        parts = []
                    last = cell[lo]
                    parts.append(pa.Table.from_batches([batch.slice(lo, hi - lo)]))
        if parts:
            yield from done(parts)

    m = met.select(*columns, F.to_json("cell").alias("cell"), "side", (F.col("cell.x") == F.col("cell.y")).alias("even"))
    tasks = max(16 * met.sparkSession.sparkContext.defaultParallelism, 48)
    return m.repartition(tasks, "cell").sortWithinPartitions("cell").mapInArrow(run, schema)


class Signed:
    """Rows with signatures in strips of like sums and sizes, their signatures also folded to 128 and 64 bits."""

    def __init__(self, sign: np.ndarray, n: np.ndarray, total: np.ndarray, strip: int) -> None:
        self.order = np.lexsort((n, total // 16))
        self.sign, self.n, self.total = sign[self.order], n[self.order].astype(np.int64), total[self.order].astype(np.int64)
        whole = [np.ascontiguousarray(self.sign[:, k]) for k in range(PARITY // 64)]
        half = [whole[0] ^ whole[2], whole[1] ^ whole[3]]
        self.folds = ([half[0] ^ half[1]], half, whole)
        self._strips(strip)

    def _strips(self, strip: int) -> None:
        self.strip, starts = strip, np.arange(0, len(self.n), strip)
        self.least, self.most, self.low, self.high = (f.reduceat(c, starts) for c in (self.n, self.total) for f in (np.minimum, np.maximum))

    def cut(self, strip: int) -> Signed:
        """The same rows in other strips."""
        other = copy(self)
        other._strips(strip)
        return other


def near(one: Signed, two: Signed | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows whose sizes, sums and signatures allow a Jaccard similarity of ``threshold``; each pair of one block with itself once.

    Strips whose sizes or sums lie too far apart are passed over; in the others all pairs are
    compared by folded signatures, which never differ in more bits, and what these leave by whole ones.
    """
    # two bags as similar as that differ in at most this share of the sum of their sizes
    differ = 1 - 2 * threshold / (1 + threshold)
    # sorted rows stay in their order, so of a block with itself both sides have one
    x, y = one, two or one.cut(STRIP[1])
    space = np.empty(STRIP, np.uint64), np.empty(STRIP, np.uint8), np.empty(STRIP, np.uint8), np.empty(STRIP, bool)
    for s in range(len(x.least)):
        most = np.floor(differ * (x.most[s] + y.most) + 1e-6).astype(np.int64)
        apart = np.maximum(x.low[s] - y.high, y.low - x.high[s])
        sized = (y.most >= threshold * x.least[s] - 1e-6) & (x.most[s] >= threshold * y.least - 1e-6)
        found = []
        i, i_end = s * x.strip, min((s + 1) * x.strip, len(x.n))
        for t in np.flatnonzero(sized & (apart <= most)):
            j, j_end = t * y.strip, min((t + 1) * y.strip, len(y.n))
            if two is None and j_end <= i:
                continue
            fold = int(np.searchsorted(FOLDED, most[t]))
            xor, bits, more, hit = (a[: i_end - i, : j_end - j] for a in space)
            for k, (u, v) in enumerate(zip(x.folds[fold], y.folds[fold], strict=True)):
                np.bitwise_xor(u[i:i_end, None], v[None, j:j_end], out=xor)
                np.bitwise_count(xor, out=more if k else bits)
                if k:
                    np.add(bits, more, out=bits)
            np.less_equal(bits, np.uint8(min(most[t], 255)), out=hit)
            at = np.flatnonzero(hit)
            if len(at):
                found.append((at // (j_end - j) + i, at % (j_end - j) + j))
        if found:
            p, q = (np.concatenate(c) for c in zip(*found, strict=True))
            if two is None:
                p, q = p[p < q], q[p < q]
            nx, ny = x.n[p], y.n[q]
            ok = np.bitwise_count(x.sign[p] ^ y.sign[q]).sum(1) <= differ * (nx + ny) + 1e-6
            ok &= np.minimum(nx, ny) >= threshold * np.maximum(nx, ny) - 1e-6
            if ok.any():
                yield x.order[p[ok]], y.order[q[ok]]


def parity_pairs(met: DataFrame, threshold: float) -> DataFrame:
    """(a, b), one way round, of rows (key, n, sign, total) whose signatures allow a Jaccard similarity of ``threshold``."""

    def take(a: pa.Table, b: pa.Table | None) -> Iterator[pa.RecordBatch]:
        def side(t: pa.Table, strip: int) -> Signed:
            sign = np.frombuffer(b"".join(t.column("sign").to_pylist()), np.uint64).reshape(-1, PARITY // 64)
            return Signed(sign, t.column("n").to_numpy(), t.column("total").to_numpy(), strip)

        kx, ky = (t.column("key").combine_chunks() for t in (a, b if b is not None else a))
        for p, q in near(side(a, STRIP[0]), None if b is None else side(b, STRIP[1]), threshold):
            yield pa.RecordBatch.from_arrays([kx.take(pa.array(p)), ky.take(pa.array(q))], names=["a", "b"])

    return by_cell(met, take, f"a {dict(met.dtypes)['key']}, b {dict(met.dtypes)['key']}")


class Exact:
    """The rows of one side of a cell: features, bits and other words."""

    def __init__(self, t: pa.Table) -> None:
        self.n = t.column("n").to_numpy().astype(np.int64)
        self.raw = np.frombuffer(b"".join(t.column("hot").to_pylist()), np.uint8).reshape(-1, HOT // 8)
        self.row, self.word = flat(t.column("rest"))
        sizes = np.bincount(self.row, minlength=len(self.n))
        self.start, self.size = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes

    def features(self, at: np.ndarray) -> np.ndarray:
        place = np.full(len(self.n), -1)
        place[at] = np.arange(len(at))
        mine = place[self.row] >= 0
        rest = counted(place[self.row[mine]], (self.word[mine] % REST).astype(np.int64), len(at), REST)
        return np.hstack([np.unpackbits(self.raw[at], axis=1), rest]).astype(np.float32)


def shared(one: Exact, two: Exact, p: np.ndarray, q: np.ndarray, index: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How many words the rows p of ``one`` and q of ``two`` share."""
    n = np.bitwise_count(one.raw[p] & two.raw[q]).sum(1).astype(np.int64)
    words, keys = index
    size = one.size[p]
    pair = np.repeat(np.arange(len(p)), size)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(one.start[p], size)
    number = np.searchsorted(words, one.word[at])
    key = q[pair] * (len(words) + 1) + number
    known = (number < len(words)) & (words[np.minimum(number, max(len(words) - 1, 0))] == one.word[at]) if len(words) else np.zeros(len(at), bool)
    found = known & (keys[np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))] == key) if len(keys) else known
    return n + np.bincount(pair[found], minlength=len(p))


def word_index(two: Exact) -> tuple[np.ndarray, np.ndarray]:
    words, number = np.unique(two.word, return_inverse=True)
    return words, np.sort(two.row * (len(words) + 1) + number)


#: (label, least score) of a link from an entry of one kind to one of another, or None.
Relation = tuple[str, float] | None


def exact_pairs(met: DataFrame, relation: Callable[[str, str], Relation], ends: bool = False, later: bool = False) -> DataFrame:
    """(from_id, to_id, relation, score) of the rows (key, kind, n, hot, rest) of one group that ``relation`` links at their Jaccard similarity.

    With ``ends`` only (id, relation, source) of linked rows, each once; with ``later`` only
    (id) of the row of a pair whose key is the greater, kinds aside.
    """

    def take(a: pa.Table, b: pa.Table | None) -> Iterator[pa.RecordBatch]:
        one = Exact(a)
        two = one if b is None else Exact(b)
        keys = [t.column("key").combine_chunks() for t in (a, b if b is not None else a)]
        kinds = [np.array([(not later and k) or "" for k in t.column("kind").to_pylist()], object) for t in (a, b if b is not None else a)]
        order = [k.to_numpy(zero_copy_only=False) for k in keys]
        index = word_index(two)
        features: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}
        seen: dict[tuple[int, str, bool], set] = {}
        for s, side in enumerate((one, two) if b is not None else (one,)):
            for kind in dict.fromkeys(kinds[s]):
                at = np.flatnonzero(kinds[s] == kind)
                features[s, kind] = at, side.features(at)
        for kx in dict.fromkeys(kinds[0]):
            for ky in dict.fromkeys(kinds[1]):
                ways = [(w, back) for w, back in ((relation(kx, ky), False), (relation(ky, kx), True)) if w]
                if not ways or b is None and kx > ky:
                    continue
                (at, x), (to, y) = features[0, kx], features[0 if b is None else 1, ky]
                low = min(w[1] for w, _ in ways)
                tau = low / (1 + low)
                for p, q in tiles(x, y, one.n[at], two.n[to], tau, 0.0, b is None and kx == ky):
                    for lo in range(0, len(p), 200_000):
                        i, j = at[p[lo : lo + 200_000]], to[q[lo : lo + 200_000]]
                        n = shared(one, two, i, j, index)
                        score = n / (one.n[i] + two.n[j] - n)
                        for (label, most), back in ways:
                            hit = score >= most
                            if later:
                                for s, rows, greater in ((0, i, order[0][i] > order[1][j]), (1, j, order[0][i] < order[1][j])):
                                    seen.setdefault((s, label, True), set()).update(np.unique(rows[hit & greater.astype(bool)]).tolist())
                            elif ends:
                                for s, rows, source in ((0, i, not back), (1, j, back)):
                                    seen.setdefault((s, label, source), set()).update(np.unique(rows[hit]).tolist())
                            elif hit.any():
                                left, right = keys[0].take(pa.array(i[hit])), keys[1].take(pa.array(j[hit]))
                                left, right = (right, left) if back else (left, right)
                                yield pa.RecordBatch.from_arrays([left, right, pa.array([label]).take(pa.array(np.zeros(hit.sum(), np.int64))), pa.array(score[hit])], names=["from_id", "to_id", "relation", "score"])
        for (s, label, source), rows in seen.items():
            if rows and later:
                yield pa.RecordBatch.from_arrays([keys[s].take(pa.array(sorted(rows)))], names=["id"])
            elif rows:
                yield pa.RecordBatch.from_arrays([keys[s].take(pa.array(sorted(rows))), pa.array([label] * len(rows)), pa.array([source] * len(rows))], names=["id", "relation", "source"])

    kind = dict(met.dtypes)["key"]
    if later:
        return by_cell(met, take, f"id {kind}").distinct()
    if ends:
        return by_cell(met, take, f"id {kind}, relation string, source boolean").distinct()
    return by_cell(met, take, f"from_id {kind}, to_id {kind}, relation string, score double")
