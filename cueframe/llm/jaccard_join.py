"""Near copies by exact Jaccard join over word shingles, with universe partition and one-deletion neighbourhoods.

Sizes fall in bands [lo, hi] with hi = lo / threshold, so a set's partners lie in its own band and the next. Two sets of
sizes that can reach the threshold differ in at most H shingles, H depending on the band only. The band hashes the
universe of shingles into H + 1 segments: by pigeonhole, linked sets agree in one segment, whose sum of hashes is a
signature. A set files its signatures under its own band, and again under the band below, where it is a partner only.

Cost decides between a segment and its one-deletion neighbourhood. An empty segment tells nothing and is never filed as
it is; a signature with more than REFINE sets that aren't joined yet isn't either. In place of such a signature v of
segment i its sets file, under v, segment i + 1 whole and with each of its shingles left out. That loses no link: of the
segments where two sets agree with skipped signatures, either the next one agrees too, and the pair meets there, or each
gives its unit of tolerance to a segment of its own, and the pigeonhole holds as before.

Rows that are shuffled hold a signature and the name of a set; sets themselves stay with their documents. Only sets in
candidate pairs, which parity sketches (whose distance never exceeds the true one) can't exclude, are taken from the
documents and compared. Groups of one signature never become all pairs of sets. First each set is compared with one
representative; links found so make components. Then only sets of one group in different components are compared by
sketch, in blocks; of what the sketches can't exclude, the nearest pairs that join a group (a spanning forest: fewer than
it has sets) are verified; components grow together. Of groups that are still open, the largest component meets the other
sets, and these each other; each set has its nearest verified, and groups that had more to verify come again. So the
components are those of all links. Of groups with the same sets one is compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueframe.llm.common import components, discard, id_text, may_meet, mix, read, slices, staged, without, words

REFINE = 48  # open sets with one signature from which its one-deletion form is cheaper: about 6 rows a set against pairs
EACH = 32  # nearest candidates that a set has verified in the second round; later rounds take 8 times as many
PAIR_WORDS = 1 << 21  # words of sketches compared at once
PAIRS = 1 << 19  # pairs of cells that are taken together
BLOCK = 512
U64 = np.uint64


# --- shingle sets ----------------------------------------------------------------------------------------------------


def shingle_sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted 64-bit shingles of each row, in one array, and the n + 1 offsets of the rows."""
    import xxhash

    index, distinct, per_row = words(text)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), U64, len(distinct))
    h = hashed[index] if len(index) else np.zeros(0, U64)
    ends = np.cumsum(per_row)
    n = np.where(per_row >= k, per_row - k + 1, np.minimum(per_row, 1))
    offsets = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(offsets[-1], U64)
    if len(h) >= k:
        acc = mix(h[: len(h) - k + 1] + U64(k))
        for j in range(1, k):
            acc = mix(acc * U64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
        row = np.repeat(np.arange(len(per_row)), per_row)[: len(acc)]
        fits = np.arange(len(acc)) + k <= ends[row]
        long = np.repeat(per_row >= k, n)
        out[long] = acc[fits]
    for i in np.flatnonzero((per_row > 0) & (per_row < k)):
        acc = np.array([per_row[i]], U64)
        for x in h[ends[i] - per_row[i] : ends[i]]:
            acc = mix(acc * U64(0x9E3779B97F4A7C15) + x)
        out[offsets[i]] = acc[0]
    first = np.zeros(len(out), bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        out[a:b].sort()
    first[offsets[:-1][n > 0]] = True
    first[1:] |= out[1:] != out[:-1]
    sizes = np.concatenate([[0], np.cumsum(first)])
    return out[first], sizes[offsets]


def nodes(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set; equal sets have one name. 0 for the empty set."""
    n = np.diff(offsets)
    out = np.zeros(len(n), U64)
    some = n > 0
    if some.any():
        out[some] = mix(np.add.reduceat(mix(sets ^ U64(0x5851F42D4C957F2D)), offsets[:-1][some]) + n[some].astype(U64))
    return out


# --- bands and segments ----------------------------------------------------------------------------------------------


@lru_cache(64)
def bands(num: int, den: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the bands up to size most: the highest size, the highest size of a partner, and the number of segments."""
    hi, lo = [], 1
    while lo <= most:
        hi.append(lo * den // num)
        lo = hi[-1] + 1
    hi = np.array(hi or [1])
    top = hi * den // num
    return hi, top, (hi + top) * (den - num) // (den + num) + 1


def _filed(n: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For role 0, then 1: role, which sets take part, their bands and numbers of segments."""
    hi, top, segments = bands(num, den, 1 << int(max(1, n.max(initial=1))).bit_length())
    own = np.searchsorted(hi, n)
    yield 0, n > 0, own, segments[own]
    low = np.maximum(own - 1, 0)
    yield 1, (n > 0) & (own > 0) & (n <= top[low]), low, segments[low]


def _sums(sets: np.ndarray, offsets: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sum of hashes in each segment of each set, the first segment of each set, and each shingle's segment."""
    base = np.cumsum(segments) - segments
    row = np.repeat(np.arange(len(segments)), np.diff(offsets))
    own = base[row] + ((mix(sets + U64(0x632BE59BD9B4E019)) >> U64(32)) * segments[row].astype(U64) >> U64(32)).astype(np.int64)
    c, size = _shares(sets), int(segments.sum())
    low = np.bincount(own, (c & U64(0xFFFFFFFF)).astype(float), size).astype(U64)  # exact below 2^53
    high = np.bincount(own, (c >> U64(32)).astype(float), size).astype(U64)
    return low + (high << U64(32)), base, own


def _shares(sets: np.ndarray) -> np.ndarray:
    return mix(sets ^ U64(0xD6E8FEB86659FD93))


def _pick(sets: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(offsets)
    return sets[np.repeat(which, n)], np.concatenate([[0], np.cumsum(n[which])])


def signatures(sets: np.ndarray, offsets: np.ndarray, num: int, den: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """role, row and signature of all segments of all sets, where an empty segment has its refined form."""
    for role, which, band, segments in _filed(np.diff(offsets), num, den):
        some, at = _pick(sets, offsets, which)
        own_rows, m = np.flatnonzero(which), segments[which]
        sums, base, own = _sums(some, at, m)
        row = np.repeat(own_rows, m)
        segment = np.arange(len(sums)) - np.repeat(base, m)
        sig = mix(sums ^ mix((band[row].astype(U64) << U64(32)) + segment.astype(U64)))
        empty = np.bincount(own, minlength=len(sums)) == 0
        yield role, row[~empty], sig[~empty]
        hot = np.flatnonzero(empty)
        after = np.where(segment[hot] + 1 < np.repeat(m, m)[hot], hot + 1, hot - segment[hot])
        yield role, row[hot], _finer(sums[after], sig[hot])
        before = np.full(len(sums), -1)
        before[after] = hot
        left_out = np.flatnonzero(before[own] >= 0)
        segment = own[left_out]
        yield role, row[segment], _finer(sums[segment] - _shares(some[left_out]), sig[before[segment]])


def _finer(sums: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Signatures of sums filed under skipped ones."""
    return mix(sums + mix(hot + U64(1)))


def refined(own: np.ndarray, role: int, hot: int, num: int, den: int) -> np.ndarray:
    """What a set files in place of its signature hot: the next segment, whole and with each shingle left out."""
    for r, which, band, segments in _filed(np.array([len(own)]), num, den):
        if r != role or not which[0]:
            continue
        if segments[0] == 1:
            return np.array([hot], U64)
        sums, _, segment = _sums(own, np.array([0, len(own)]), segments)
        sig = mix(sums ^ mix((U64(int(band[0])) << U64(32)) + np.arange(len(sums), dtype=U64)))
        at = np.flatnonzero(sig == U64(hot))
        if not len(at):  # a refined form already
            return np.array([hot], U64)
        j = (int(at[0]) + 1) % len(sums)
        return np.unique(_finer(np.concatenate([[sums[j]], sums[j] - _shares(own[segment == j])]), np.array([hot], U64)))
    return np.zeros(0, U64)


def sketch(own: np.ndarray) -> bytes:
    """Parities of the set in at least 2 bits a shingle; the bits in which two sets differ are no more than the shingles."""
    bits = 1 << max(6, (2 * len(own) - 1).bit_length())
    return np.packbits((np.bincount((mix(own + U64(0x2545F4914F6CDD1D)) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(bool), bitorder="little").tobytes()


def distances(sketches: list[bytes], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of bits in which the sketches of places i and j differ, the longer ones folded to the shorter ones."""
    size = np.fromiter(map(len, sketches), np.int64, len(sketches)) // 8
    place, table = np.zeros(len(sketches), np.int64), {}
    for w in np.unique(size).tolist():
        own = np.flatnonzero(size == w)
        place[own] = np.arange(len(own))
        table[w] = np.frombuffer(b"".join(sketches[x] for x in own), U64).reshape(-1, w)
    out, kind = np.zeros(len(i), np.int64), size[i] << 32 | size[j]
    for u in np.unique(kind).tolist():
        a, b = u >> 32, u & 0xFFFFFFFF
        which, least = np.flatnonzero(kind == u), min(a, b)
        for k in range(0, len(which), max(1, PAIR_WORDS // max(a, b))):
            part = which[k : k + max(1, PAIR_WORDS // max(a, b))]
            x, y = (np.bitwise_xor.reduce(table[w][place[of[part]]].reshape(len(part), -1, least), axis=1) for w, of in ((a, i), (b, j)))
            out[part] = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return out


# --- the join --------------------------------------------------------------------------------------------------------


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())


def _named(docs: DataFrame, k: int) -> DataFrame:
    """docs (doc_id, key, text) by set: doc_id, key, n, node and sketch, written as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, at = shingle_sets(batch.column("text"), k)
            marks = pa.array([sketch(sets[a:b]) if a < b else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "key": batch.column("key"), "n": np.diff(at), "node": _long(nodes(sets, at)), "sketch": marks})

    return staged(docs.mapInArrow(run, "doc_id bigint, key long, n long, node long, sketch binary"), "sets")


def _signed(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()  # a set files once per task, however many copies it has
        for batch in slices(batches):
            sets, at = shingle_sets(batch.column("text"), k)
            name = nodes(sets, at)
            new = np.zeros(len(name), bool)
            for i, x in enumerate(name.tolist()):
                if x not in met:
                    met.add(x)
                    new[i] = True
            sets, at = _pick(sets, at, new)
            name = name[new]
            for role, row, sig in signatures(sets, at, num, den):
                for a in range(0, len(sig), 100_000):
                    part = slice(a, a + 100_000)
                    yield pa.RecordBatch.from_pydict({"sig": _long(sig[part]), "node": _long(name[row[part]]), "role": pa.array(np.full(len(sig[part]), role), pa.int8())})

    return docs.select("text").mapInArrow(run, "sig long, node long, role byte")


def _shared(rows: DataFrame) -> DataFrame:
    """The rows whose signature has two sets at least, one of them in the band itself."""
    by = Window.partitionBy("sig")
    marked = rows.repartition("sig").withColumns({"_a": F.min("node").over(by), "_b": F.max("node").over(by), "_r": F.min("role").over(by)})
    return marked.where("_a <> _b and _r = 0").select("sig", "node", "role").distinct()


def _sets_of(docs: DataFrame, named: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, own), the sorted shingles, of the wanted nodes, from one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets, at = shingle_sets(batch.column("text"), k)
            name = nodes(sets, at)
            ok = np.flatnonzero(name.view(np.int64) == batch.column("node").to_numpy())
            own = pa.array([sets[at[i] : at[i + 1]].tobytes() for i in ok], pa.binary())
            yield pa.RecordBatch.from_pydict({"node": _long(name[ok]), "own": own})

    one = named.select("node", F.struct("doc_id", "key").alias("at")).join(wanted.select("node").distinct(), "node").groupBy("node").agg(F.min("at").alias("at"))
    one = staged(one.select("node", F.col("at.doc_id").alias("_id"), F.col("at.key").alias("_key")), "chosen")  # its size decides how it is joined
    rows = may_meet(docs, [F.col("doc_id"), F.col("key")], one, [F.col("_id"), F.col("_key")], "_may").where("_may")
    rows = rows.join(one, rows.doc_id.eqNullSafe(one._id) & (rows.key == one._key)).select("text", "node")
    out = staged(rows.mapInArrow(run, "node long, own binary").dropDuplicates(["node"]), "own-sets")
    discard(one)
    return out


def _verified(pairs: DataFrame, docs: DataFrame, named: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that reach the threshold, by their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                u, v = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(den * both >= num * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")})

    sets = _sets_of(docs, named, pairs.select(F.col("a").alias("node")).union(pairs.select("b")), k)
    one, two = sets.select(F.col("node").alias("a"), F.col("own").alias("x")), sets.select(F.col("node").alias("b"), F.col("own").alias("y"))
    links = staged(pairs.select("a", "b").join(one, "a").join(two, "b").mapInArrow(run, "a long, b long"), "links")
    discard(sets)
    return links


def _candidates(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and sketches don't exclude, written as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.arange(len(batch))
            far = distances(batch.column("s").to_pylist() + batch.column("t").to_pylist(), rows, rows + len(rows))
            ok = pa.array((den + num) * far <= (den - num) * (batch.column("n").to_numpy() + batch.column("m").to_numpy()))
            yield pa.RecordBatch.from_pydict({c: batch.column(c).filter(ok) for c in ("a", "b")})

    one, two = (sets.select(F.col("node").alias(a), F.col("n").alias(n), F.col("sketch").alias(s)) for a, n, s in (("a", "n", "s"), ("b", "m", "t")))
    near = pairs.join(one, "a").join(two, "b").where(den * F.least("n", "m") >= num * F.greatest("n", "m"))
    return staged(near.select("a", "b", "n", "m", "s", "t").mapInArrow(run, "a long, b long"), "candidates")


def _opened(groups: DataFrame, comps: DataFrame) -> DataFrame:
    """The rows of groups, with their components (node, comp), whose signature is shared by several components.

    _n counts the rows of a signature, _most those of its largest component, and major marks these.
    """
    by, own = Window.partitionBy("sig"), Window.partitionBy("sig", "comp")
    rows = groups.select("sig", "node", "role").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    rows = rows.repartition("sig").withColumns({"_n": F.count("*").over(by), "_c": F.struct(F.count("*").over(own).alias("n"), "comp")})
    rows = rows.withColumn("_m", F.max("_c").over(by)).where("_m.n < _n")
    return staged(rows.select("sig", "node", "role", "comp", "_n", F.col("_m.n").alias("_most"), (F.col("_m.comp") == F.col("comp")).alias("major")), "open-groups")


def _once(rows: DataFrame) -> DataFrame:
    """The rows without groups that have just the sets, and roles, of another one: copies often share many signatures."""
    names = [F.bit_xor(F.xxhash64(F.lit(i), "node", "role")).alias(f"_h{i}") for i in range(2)]
    kept = rows.groupBy("sig").agg(F.count("*").alias("_k"), *names).groupBy("_k", "_h0", "_h1").agg(F.min("sig").alias("sig"))
    return staged(rows.join(kept.select("sig"), "sig", "left_semi"), "open-groups")


def _cells(rows: DataFrame, across: bool) -> DataFrame:
    """rows with cell and block: pairs meet in a cell, of equal blocks only where they are -1.

    A group of up to BLOCK sets is one cell. In a larger one, across: the largest component's sets meet all others, and these
    each other, in blocks, so that rows grow with the sets outside of it; otherwise each set only meets those of its block.
    """
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    cell = lambda c, b: F.struct(F.lit(c).cast("int").alias("cell"), F.lit(b).cast("int").alias("block"))
    if across:
        many, few = blocks(F.col("_most")), blocks(F.col("_n") - F.col("_most"))
        own = place(few)
        major = F.transform(F.sequence(F.lit(0), few - 1), lambda j: cell(place(many) * few + j, 0))
        minor = F.transform(F.sequence(F.lit(0), many - 1), lambda i: cell(i * few + own, 1))
        others = F.transform(F.sequence(F.lit(0), few - 1), lambda j: cell(-1 - F.least(j, own) * few - F.greatest(j, own), F.when(j == own, -1).otherwise(own)))
        spread = F.when(F.col("major"), major).otherwise(F.concat(minor, others))
    else:
        spread = F.array(cell(place(blocks(F.col("_n"))), -1))
    spread = F.when(F.col("_n") <= BLOCK, F.array(cell(0, -1))).otherwise(spread)
    return rows.withColumn("at", F.explode(spread)).select("sig", "node", "role", "comp", "at.cell", "at.block")


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of edges between labels a and b, best first, those of the best spanning forest, at most one for each label."""
    labels, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    edges, kept, every = np.arange(len(a)), [np.zeros(0, np.int64)], np.arange(len(labels))
    while len(edges):
        best = np.full(len(labels), len(a))
        np.minimum.at(best, a[edges], edges)
        np.minimum.at(best, b[edges], edges)
        some = np.flatnonzero(best < len(a))
        kept.append(np.unique(best[some]))
        up = every.copy()
        up[some] = a[best[some]] + b[best[some]] - some
        up = np.where((up[up] == every) & (every < up), every, up)  # of two that choose each other one is the root
        while (up != up[up]).any():
            up = up[up]
        a, b = up[a], up[b]
        edges = edges[a[edges] != b[edges]]
    return np.concatenate(kept)


def _open_pairs(rows: DataFrame, sets: DataFrame, each: int, num: int, den: int) -> DataFrame:
    """Pairs of sets of one group, but of different components, that sizes and sketches don't exclude.

    each 0: of each group the nearest pairs that join what they can, so one for each row at most; large groups by blocks.
    Otherwise all groups whole, and of each set its nearest `each`. Rows (a, b, sig): a pair, or the signature of a group
    where a set has more of them.
    """
    rows = _cells(rows, across=each > 0).join(sets, "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in (part for run in whole_runs(batches, ("sig", "cell")) for part in bounded(run)):
            sig, cell, node, role, comp, block, n = (t[c].to_numpy() for c in ("sig", "cell", "node", "role", "comp", "block", "n"))
            new = np.append(True, (sig[1:] != sig[:-1]) | (cell[1:] != cell[:-1]))
            group = np.cumsum(new) - 1
            end = np.append(np.flatnonzero(new)[1:], len(sig))[group]
            one, two, i = [], [], np.arange(len(sig))
            for d in range(1, int(np.diff(np.append(np.flatnonzero(new), len(sig))).max())):
                i = i[i + d < end[i]]
                j = i + d
                ok = (comp[i] != comp[j]) & ((role[i] == 0) | (role[j] == 0)) & ((block[i] < 0) | (block[i] != block[j])) & (den * np.minimum(n[i], n[j]) >= num * np.maximum(n[i], n[j]))
                one.append(i[ok]), two.append(j[ok])
            i, j = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (one, two))
            if not len(i):
                continue
            far = distances(t["sketch"].to_pylist(), i, j)
            ok = (den + num) * far <= (den - num) * (n[i] + n[j])
            i, j, far = i[ok], j[ok], far[ok]
            if not len(i):
                continue
            if each:
                src, dst, far = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([far, far])
                order = np.lexsort((node[dst], far, src))
                src, dst = src[order], dst[order]
                first = np.flatnonzero(np.append(True, src[1:] != src[:-1]))
                nth = np.arange(len(src)) - np.repeat(first, np.diff(np.append(first, len(src))))
                more = np.unique(sig[src[nth >= each]])
                x, y = node[src[nth < each]], node[dst[nth < each]]
            else:
                x, y, more = np.minimum(node[i], node[j]), np.maximum(node[i], node[j]), sig[:0]
                order = np.lexsort((y, x, far))  # the same order in all groups, so that they choose the same pairs
                label = np.unique(np.stack([group, comp]), axis=1, return_inverse=True)[1].reshape(-1)
                order = order[forest(label[i[order]], label[j[order]])]
                x, y = x[order], y[order]
            pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
            none = pa.nulls(len(more), pa.int64())
            yield pa.RecordBatch.from_pydict({"a": pa.array(pairs[0]), "b": pa.array(pairs[1]), "sig": pa.nulls(pairs.shape[1], pa.int64())})
            if len(more):
                yield pa.RecordBatch.from_pydict({"a": none, "b": none, "sig": pa.array(more)})

    rows = rows.repartition("sig", "cell").sortWithinPartitions("sig", "cell")
    return staged(rows.mapInArrow(compare, "a long, b long, sig long").distinct(), "open-pairs")


def bounded(t: pa.Table) -> Iterator[pa.Table]:
    """Whole cells of a sorted table, together of about PAIRS pairs, or one cell of more."""
    sig, cell = t["sig"].to_numpy(), t["cell"].to_numpy()
    first = np.flatnonzero(np.append(True, (sig[1:] != sig[:-1]) | (cell[1:] != cell[:-1])))
    ends = np.append(first[1:], len(sig))
    pairs = np.cumsum((ends - first) * (ends - first - 1) // 2)
    at = 0
    while at < len(first):
        to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + PAIRS, "right")))
        yield t.slice(first[at], ends[to - 1] - first[at])
        at = to


def whole_runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """A sorted stream of batches, cut so that rows of equal keys stay together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        cols = [batch.column(k).to_numpy() for k in keys]
        other = np.zeros(len(batch), bool)
        for c in cols:
            other |= c != c[-1]
        cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
        if not cut and (len(held) < 2 or all(held[-2].column(k)[-1].as_py() == c[-1] for k, c in zip(keys, cols, strict=True))):
            continue
        yield pa.Table.from_batches([*held[:-1], batch.slice(0, cut)])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def runs_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The tables of equal keys in a sorted stream of batches."""
    for t in whole_runs(batches, keys):
        new = np.zeros(len(t), bool)
        new[:1] = True
        for k in keys:
            c = t[k].to_numpy()
            new[1:] |= c[1:] != c[:-1]
        at = np.append(np.flatnonzero(new), len(t)).tolist()
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield t.slice(a, b - a)


def _members(docs: DataFrame, k: int, num: int, den: int, refine: int) -> DataFrame:
    """(doc_id, key, n, comp) of each row of docs (doc_id, key, text); comp is null without links."""
    named = _named(docs, k)
    groups = staged(_shared(_signed(docs, k, num, den)), "groups")
    sets = staged(named.where("n > 0").join(groups.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]).select("node", "n", "sketch"), "sketches")

    # one comparison for each set: with the smallest set of the band among those it shares a signature with
    least = F.min(F.when(F.col("role") == 0, F.col("node"))).over(Window.partitionBy("sig"))
    stars = groups.withColumn("rep", least).where("rep <> node").groupBy("node").agg(F.min("rep").alias("rep"))
    near = _candidates(stars.select(F.col("rep").alias("a"), F.col("node").alias("b")), sets, num, den)
    links = _verified(near, docs, named, k, num, den)
    discard(near)

    comps = components(links)
    rows = _opened(groups, comps)
    discard(groups)
    crowded = rows.where(F.col("_n") > refine)
    if not crowded.isEmpty():

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for sig, node, role, own in zip(*(batch.column(c).to_pylist() for c in ("sig", "node", "role", "own")), strict=True):
                    new = refined(np.frombuffer(own, U64), role, sig % 2**64, num, den)
                    yield pa.RecordBatch.from_pydict({"sig": _long(new), "node": pa.array([node] * len(new), pa.int64()), "role": pa.array([role] * len(new), pa.int8())})

        own = _sets_of(docs, named, crowded, k)
        finer = crowded.select("sig", "node", "role").join(own, "node").mapInArrow(run, "sig long, node long, role byte")
        shared = staged(_shared(finer), "finer-groups")
        finer, whole = _opened(shared, comps), rows
        rows = _once(whole.where(F.col("_n") <= refine).unionByName(finer))
        discard(own, shared, finer, whole)
    else:
        whole, rows = rows, _once(rows)
        discard(whole)
    each = 0
    while True:
        found = _open_pairs(rows, sets, each, num, den)
        pairs = found.where("a is not null").select("a", "b")
        if each and pairs.isEmpty():
            break
        new, old = _verified(pairs, docs, named, k, num, den), links
        if grown := not new.isEmpty():
            links = staged(old.union(new), "links")
            comps = components(links)
            discard(old)
        discard(new)
        more = found.where("sig is not null").select("sig")
        if each and more.isEmpty():
            break
        left = rows.join(more, "sig", "left_semi") if each else rows
        if grown or each:
            left, done = _opened(left, comps) if grown else staged(left, "open-groups"), rows
            discard(done)
        discard(found)
        rows = left
        each = each * 8 or EACH  # nearest first; more at a time where these don't join
    return named.select("doc_id", "key", "n", "node").join(comps, "node", "left").select("doc_id", "key", "n", F.when(F.col("n") > 0, F.coalesce("comp", "node")).alias("comp"))


def _keyed(docs: DataFrame) -> DataFrame:
    return id_text(docs).select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("key"), "text")


def jaccard_groups(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, refine: int = REFINE) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of docs; two sets link at Jaccard similarity num / den or more.

    A text of fewer than k words is one shingle, the whole; a text without words, or null, has none, links with nothing
    and is its own component. component_id is the smallest doc_id that links lead to (a null one counts only where
    there is no other, and repeated rows are one set). Other columns of docs are not read. No rows give no rows.
    """
    rows = _members(_keyed(docs), k, num, den, refine)
    least_id = rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least"))
    joined = rows.join(least_id, "comp", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 8, den: int = 10, refine: int = REFINE) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their component: one row of each.

    It is the one with the smallest doc_id (a null one only where there is no other), of several texts with this id the
    one with the smallest hash, of repeated rows any. Rows without words all stay. No rows give no rows.
    """
    rows = _members(_keyed(docs), k, num, den, refine).where("comp is not null")
    by = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    rows = rows.groupBy("comp", "doc_id", "key").agg(F.count("*").alias("times")).withColumn("at", by)
    best = rows.groupBy("comp").agg(F.min("at").alias("best"), F.sum("times").alias("all")).where("all > 1")
    marks = rows.join(best, "comp").select("doc_id", "key", (F.col("at") == F.col("best")).alias("stays"), "times").where("not stays or times > 1")
    return without(docs, marks.select("doc_id", "key", "stays"), F.xxhash64(F.coalesce("text", F.lit(""))))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read(spark, sf_dir, "documents"), k=3, num=90, den=100)


#: Sets of shingles, all pairs that share one, and what links reach step by step.
OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 90 * (x.n + y.n - common)),
r(doc_id, c) AS (SELECT DISTINCT a, a FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(c) AS c FROM r GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""
