"""Near-duplicate documents: Chosen-path set similarity join on word shingles.

1. Each text becomes its set of shingle hashes, a 128-bit fingerprint of that set and minwise tokens. Texts
   with the same set are one class from here on.
2. Trees: a node of a tree holds the classes that agree on the tokens chosen on the way down. At every node a
   class follows ``picks`` tokens at positions drawn from the node's own hash, so classes of similarity s stay
   together somewhere below with probability q = 1 - (1 - s q) ** picks, whatever the depth; ``trees``
   independent trees bring that to the recall wanted. Nodes of at most ``leaf`` classes are compared
   exhaustively on byte sketches of their tokens; nodes that hardly shrink are dense and are linked to pivots;
   what the pivots leave, and the members of different pivots, are compared block by block.
3. The sketch links (a similarity well below the threshold) tie classes to groups, so that each class that has
   a candidate belongs to one group. Full sets are read again for those classes only, and links are confirmed
   by exact integer counts inside the groups. Only a spanning forest of the links leaves a task.

Caps: none on partners or candidates. A group of any size is split into blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgetide.llm import textkit
from edgetide.llm.components import components
from edgetide.llm.runtime import fits, lookup, prepare, stage, text_keys

TOKENS = 128
#: Sketch links are taken from this many standard deviations of the estimate below the threshold.
SLACK = 6.5
_U = np.uint64


def floor_of(num: int, den: int) -> int:
    """Agreeing tokens, of TOKENS, from which two sketches are candidates for similarity num/den."""
    s = num / den
    return max(1, int(np.floor(TOKENS * s - SLACK * np.sqrt(TOKENS * s * (1 - s)))))


def _fingerprint(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a = np.array([textkit.mix(s + _U(0x1234567)).sum(dtype=np.uint64) for s in sets], np.uint64)
    b = np.array([np.bitwise_xor.reduce(textkit.mix(s * _U(0x2545F4914F6CDD1D))) if len(s) else 0 for s in sets], np.uint64)
    return a.view(np.int64), b.view(np.int64)


def _profile(k: int, with_sets: bool):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = textkit.multipliers(TOKENS)
        for batch in batches:
            data, starts, ends = textkit.view(batch.column("text"))
            for lo, hi in portions(starts, ends):
                h, low, high = textkit.words(data, starts[lo:hi], ends[lo:hi])
                flat, at = textkit.shingles(h, low, high, k)
                sets = textkit.distinct(flat, at)
                a, b = _fingerprint(sets)
                n = pa.array([len(s) for s in sets], pa.int64())
                made = {"n_shingles": n, "fa": pa.array(a), "fb": pa.array(b)}
                if with_sets:
                    made["payload"] = pa.array([s.tobytes() for s in sets], pa.binary())
                else:
                    tokens = textkit.minhash(flat, at, factors)
                    parts = tokens.astype("<u4").view(np.uint8).reshape(len(tokens), TOKENS, 4)
                    made["sketch"] = pa.array([r.tobytes() for r in parts[:, :, 0]], pa.binary())
                    made["high"] = pa.array([r.tobytes() for r in parts[:, :, 1:]], pa.binary())
                rows = batch.slice(lo, hi - lo)
                kept = {c: rows.column(c) for c in rows.schema.names if c != "text"} | made
                yield pa.RecordBatch.from_arrays([*kept.values()], names=[*kept])

    return each


def portions(starts: np.ndarray, ends: np.ndarray, size: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes of text each; a longer text stands alone."""
    lo, n = 0, len(starts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + size, side="right")))
        yield lo, min(hi, n)
        lo = hi


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, keys of the text (t1, t2), n_shingles, fingerprint (fa, fb) and minwise tokens of every row: their low bytes
    (sketch) and the three bytes above (high)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(), "text")
    return rows.mapInArrow(_profile(k, False), "doc_id long, t1 long, t2 long, n_shingles long, fa long, fb long, sketch binary, high binary")


# --- trees -------------------------------------------------------------------------------------------------


def _positions(node: np.ndarray, pick: int) -> np.ndarray:
    return (textkit.mix(node + _U((pick + 1) * 0xD6E8FEB86659FD93 & (1 << 64) - 1)) % _U(TOKENS)).astype(np.int64)


def _picked(node: np.ndarray, picks: int) -> list[np.ndarray]:
    """The positions drawn from each node; those of one node differ."""
    taken = []
    for p in range(picks):
        at = _positions(node, p)
        for other in taken:
            at = np.where(at == other, (at + 1) % TOKENS, at)
        taken.append(at)
    return taken


def _children(node: np.ndarray, tokens: np.ndarray, picks: int) -> np.ndarray:
    """Node hashes below ``node`` of each row: rows x picks."""
    out = np.empty((len(node), picks), np.uint64)
    row = np.arange(len(node))
    for p, at in enumerate(_picked(node, picks)):
        out[:, p] = textkit.mix(textkit.mix(node + at.astype(np.uint64)) ^ (tokens[row, at].astype(np.uint64) * _U(0x9E3779B97F4A7C15)))
    return out


def _tops(trees: int, picks: int) -> list[np.uint64]:
    """The top node of every tree. While half of the positions suffice, no two trees draw the same one, so that a token on which
    two classes differ is not in the way of more than one."""
    out, taken, k = [], set(), 0
    while len(out) < trees:
        k += 1
        node = textkit.mix(np.array([k], np.uint64))
        at = {int(p[0]) for p in _picked(node, picks)}
        if taken.isdisjoint(at) or 2 * trees * picks > TOKENS:
            taken |= at
            out.append(node[0])
    return out


def _table(column: pa.Array, width: int = TOKENS) -> np.ndarray:
    """Rows of ``width`` bytes each."""
    data, starts, _ = textkit.view(column)
    n = len(starts)
    return np.frombuffer(data[int(starts[0]) : int(starts[0]) + n * width].tobytes(), np.uint8).reshape(n, width) if n else np.zeros((0, width), np.uint8)


def _tokens(batch: pa.RecordBatch) -> np.ndarray:
    low, high = _table(batch.column("sketch")), _table(batch.column("high"), 3 * TOKENS)
    return np.concatenate([low[:, :, None], high.reshape(len(low), TOKENS, 3)], axis=2).reshape(len(low), 4 * TOKENS).view("<u4")


def _roots(trees: int, picks: int):
    """The first two steps of every tree at once: of the many classes that share one token by chance, hardly any share two."""

    def each(batches):
        tops = _tops(trees, picks)
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, vid = _tokens(batch), batch.column("vid").to_numpy()
            for top in tops:
                node = np.full(len(vid), top)
                for first in _children(node, tokens, picks).T:
                    below = _children(np.ascontiguousarray(first), tokens, picks)
                    for p in range(picks):
                        yield pa.RecordBatch.from_arrays([pa.array(below[:, p].view(np.int64)), pa.array(vid)], names=["node", "vid"])

    return each


def _branch(picks: int):
    def each(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, vid = _tokens(batch), batch.column("vid").to_numpy()
            node = batch.column("node").to_numpy().view(np.uint64)
            size = batch.column("size").to_numpy()
            below = _children(node, tokens, picks)
            for p in range(picks):
                yield pa.RecordBatch.from_arrays([pa.array(below[:, p].view(np.int64)), pa.array(vid), pa.array(size)], names=["node", "vid", "above"])

    return each


def _gathered(leaf: int):
    """Rows sorted by node and vid to nodes of two members or more, with lists of at most ``leaf`` of them."""

    def each(batches):
        for batch in whole_groups(batches, "node"):
            node, vid, above = (batch.column(c).to_numpy() for c in ("node", "vid", "above"))
            first = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            size = np.diff(np.r_[first, len(node)])
            more = size > 1
            member, first, size = np.repeat(more, size), first[more], size[more]
            lists = -(-size // leaf)
            of = np.repeat(np.arange(len(size)), lists)
            nth, _ = textkit.runs(np.zeros(len(size), np.int64), lists)
            ends = np.cumsum(np.r_[0, np.minimum(leaf, size[of] - nth * leaf)])
            members = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(vid[member], pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(node[first][of]), pa.array(size[of], pa.int64()), pa.array(above[first][of]), members], names=["node", "size", "above", "members"])

    return each


def nodes_of(rows: DataFrame, leaf: int, share: int = 128, drawn: int = 24) -> DataFrame:
    """rows (node, vid, above), staged, to the nodes of two members or more: (node, size, above, members), where a node's members
    are lists of at most ``leaf`` in one row or several.

    The rows are shuffled once, whatever joins are broadcast. One row in ``share`` is looked at first: a node that shows
    ``drawn`` members there is counted where its rows are, and its members are never brought together.
    """
    shown = rows.where(F.pmod(F.xxhash64("vid", "node"), F.lit(share)) == 0).groupBy("node").agg(F.count(F.lit(1)).alias("shown"))
    crowds = stage(shown.where(F.col("shown") >= drawn).select("node"), "tree-crowds")
    crowded = not crowds.isEmpty()
    others = rows.join(lookup(crowds), "node", "left_anti") if crowded else rows
    others = others.select("node", "vid", "above").repartition("node").sortWithinPartitions("node", "vid")
    found = others.mapInArrow(_gathered(leaf), "node long, size long, above long, members array<long>")
    if crowded:
        sizes = rows.join(lookup(crowds), "node").groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.max("above").alias("above"))
        whole = rows.select("node", "vid").join(lookup(stage(sizes.where("size > 1"), "tree-sizes")), "node")
        found = found.unionByName(whole.select("node", "size", "above", F.array("vid").alias("members")))
    return stage(found, "tree-nodes")


# --- comparing the members of groups -----------------------------------------------------------------------


class Sketches:
    """Members compared by how many of their tokens agree in the low byte."""

    def __init__(self, least: int):
        self.least = least

    def read(self, column: pa.Array) -> np.ndarray:
        return _table(column)

    def pairs(self, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return (x[i] == x[j]).sum(axis=1) >= self.least

    def close(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row by row: linked? As close as the two ends of two links, at least?"""
        agree = (a == b).sum(axis=1)
        return agree >= self.least, agree >= 2 * self.least - TOKENS

    def matrix(self, x: np.ndarray, rows: slice, cols: slice) -> np.ndarray:
        a, b = x[rows], x[cols]
        agree = np.zeros((len(a), len(b)), np.uint8)
        for c in range(TOKENS):
            agree += a[:, c, None] == b[None, :, c]
        return agree >= self.least


class Sets:
    """Members compared exactly: den * intersection >= num * union."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def read(self, column: pa.Array) -> np.ndarray:
        data, starts, ends = textkit.view(column)
        out = np.empty(len(starts), object)
        for i, (a, b) in enumerate(zip(starts, ends)):
            out[i] = np.frombuffer(data[a:b].tobytes(), np.uint64)
        return out

    def enough(self, inter, a, b):
        return self.den * inter >= self.num * (a + b - inter)

    def pairs(self, x, i, j):
        n = np.array([len(np.intersect1d(x[a], x[b], assume_unique=True)) for a, b in zip(i, j)], np.int64)
        size = np.array([len(s) for s in x], np.int64)
        return self.enough(n, size[i], size[j])

    def close(self, a, b):
        """As for sketches; one minus the similarity is a metric, so over two links the differences add up at most."""
        n = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(a, b)], np.int64)
        either = np.array([len(x) + len(y) for x, y in zip(a, b)], np.int64) - n
        return self.den * n >= self.num * either, self.den * n >= (2 * self.num - self.den) * either

    def matrix(self, x, rows, cols, width: int = 4096):
        """Through 0/1 matrices over the shingles that both sides have, ``width`` columns at a time."""
        left, right = list(x[rows]), list(x[cols])
        size_l, size_r = np.array([len(s) for s in left], np.int64), np.array([len(s) for s in right], np.int64)
        inter = np.zeros((len(left), len(right)), np.float32)
        known_l, known_r = np.unique(np.concatenate(left)), np.unique(np.concatenate(right))
        shared = np.intersect1d(known_l, known_r, assume_unique=True)
        where_l = [np.searchsorted(shared, s[np.isin(s, shared, assume_unique=True)]) for s in left]
        where_r = [np.searchsorted(shared, s[np.isin(s, shared, assume_unique=True)]) for s in right]
        for at in range(0, len(shared), width):
            a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
            for m, where in ((a, where_l), (b, where_r)):
                for r, w in enumerate(where):
                    lo, hi = np.searchsorted(w, (at, at + width))
                    m[r, w[lo:hi] - at] = 1
            inter += a @ b.T
        return self.enough(inter.astype(np.int64), size_l[:, None], size_r[None, :])


def forest(linked: np.ndarray) -> np.ndarray:
    """Least member index reachable, for a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.RecordBatch]:
    """Batches sorted by ``key``, cut anew so that no group is split."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        if kept and kept[-1].column(key)[-1].as_py() == k[-1] and k[0] == k[-1]:
            kept.append(batch)
            continue
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        done = [*kept, batch.slice(0, cut)] if cut else kept
        if done:
            yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        kept = [batch.slice(cut)]
    if kept:
        yield pa.Table.from_batches(kept).combine_chunks().to_batches()[0]


EDGE = "a long, b long"


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], names=["a", "b"])


def _within(compare, key: str, tiny: int = 8):
    """Links inside groups that fit one task, as a spanning forest. Rows come sorted by ``key``."""

    def each(batches):
        for batch in whole_groups(batches, key):
            grp, vid = batch.column(key).to_numpy(), batch.column("vid").to_numpy()
            x = compare.read(batch.column("payload"))
            first = np.flatnonzero(np.r_[True, grp[1:] != grp[:-1]])
            size = np.diff(np.r_[first, len(grp)])
            of = np.repeat(size, size)
            row = np.arange(len(grp))
            for d in range(1, tiny):
                i = np.flatnonzero((of[:-d] <= tiny) & (grp[:-d] == grp[d:])) if d < len(grp) else row[:0]
                for p in range(0, len(i), 20_000):
                    q = i[p : p + 20_000]
                    good = q[compare.pairs(x, q, q + d)]
                    yield _edges(vid[good], vid[good + d])
            for s, n in zip(first[size > tiny], size[size > tiny]):
                label = forest(compare.matrix(x, slice(s, s + n), slice(s, s + n)))
                tied = np.flatnonzero(label != np.arange(n))
                yield _edges(vid[s + tied], vid[s + label[tied]])

    return each


def _star(compare):
    """Rows with a member's and a pivot's payload: is the member linked to the pivot, or near enough for a link to one that is?"""

    def each(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            linked, near = compare.close(compare.read(batch.column("payload")), compare.read(batch.column("pivot_payload")))
            made = {c: batch.column(c) for c in ("grp", "vid", "home", "s", "pivot")} | {"linked": pa.array(linked), "near": pa.array(near)}
            yield pa.RecordBatch.from_arrays([*made.values()], names=[*made])

    return each


def _across(compare):
    """Links between the block rows (role true) and the others of a cell, as star edges."""

    def each(batches):
        for batch in whole_groups(batches, "cell"):
            cell = batch.column("cell").to_numpy()
            first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            vid, role = batch.column("vid").to_numpy(), np.asarray(batch.column("block"))
            x = compare.read(batch.column("payload"))
            for s, e in zip(first, np.r_[first[1:], len(cell)]):
                own, other = s + np.flatnonzero(role[s:e]), s + np.flatnonzero(~role[s:e])
                if not len(own) or not len(other):
                    continue
                linked = compare.matrix(np.concatenate([x[own], x[other]]), slice(0, len(own)), slice(len(own), None))
                n = len(own)
                joint = np.zeros((n + len(other),) * 2, bool)
                joint[:n, n:] = linked
                joint[n:, :n] = linked.T
                label = forest(joint)
                ids = np.concatenate([vid[own], vid[other]])
                tied = np.flatnonzero(label != np.arange(len(ids)))
                yield _edges(ids[tied], ids[label[tied]])

    return each


def _met(members: DataFrame, pivots: DataFrame, payloads: DataFrame, compare) -> DataFrame:
    """members (grp, vid, home, s) beside the pivots (grp, s, pivot, pivot_payload) of their group."""
    side = F.broadcast(pivots) if fits(pivots, "pivot_payload", 2000) else pivots
    pairs = payloads.select("vid", "payload").join(lookup(members), "vid").join(side, ["grp", "s"])
    pairs = pairs.select("grp", "vid", "home", "s", "pivot", "payload", "pivot_payload")
    return stage(pairs.mapInArrow(_star(compare), "grp long, vid long, home int, s int, pivot long, linked boolean, near boolean"), "group-stars")


def _between_homes(rounds: list[DataFrame], pivots: list[DataFrame], payloads: DataFrame, compare, limit: int) -> list[DataFrame]:
    """Links that large groups have beside those to a member's own pivot; ``rounds`` holds the rows of each round."""
    seen, heads = rounds[0], pivots[0]
    for r, p in zip(rounds[1:], pivots[1:]):
        seen, heads = seen.unionByName(r), heads.unionByName(p)
    first = F.coalesce(F.max(F.when(F.col("linked"), F.col("s"))), F.lit(0))
    homes = stage(seen.groupBy("grp", "vid").agg(first.alias("was"), F.collect_set(F.when(F.col("near"), F.col("s"))).alias("near")), "group-homes")
    # a later home that makes no block of its own is given up: its members are compared like those without one
    held = homes.where("was > 0").groupBy("grp", "was").agg(F.count(F.lit(1)).alias("size")).where(f"was = 1 or size > {limit}")
    held = stage(held.select("grp", "was", F.col("was").alias("home")), "group-held")
    homes = homes.join(lookup(held), ["grp", "was"], "left").withColumn("home", F.coalesce("home", F.lit(0)))
    pair, edges = ["grp", "lo", "hi"], []
    later = held.where("home > 1").select("grp", F.col("home").alias("s"))
    if joins := not later.isEmpty():
        # members of a home have not met the pivots after it
        ask = stage(homes.where("was > 0").select("grp", "vid", "home", "was").join(lookup(later), "grp").where("was < s").drop("was"), "group-asked")
        met = _met(ask, stage(heads.join(lookup(later), ["grp", "s"], "left_semi"), "group-pivots"), payloads, compare)
        joined = met.where("linked and home > 0").groupBy("grp", F.col("home").alias("lo"), F.col("s").alias("hi"))
        joined = stage(joined.agg(F.min("vid").alias("a"), F.min("pivot").alias("b")), "group-joined")
        edges.append(joined.select("a", "b"))
        more = met.where("near").groupBy("grp", "vid").agg(F.collect_set("s").alias("more"))
        homes = homes.join(more, ["grp", "vid"], "left").withColumn("near", F.array_union("near", F.coalesce("more", F.array().cast("array<int>"))))
    # a member's own home is none of the others; each member is read once
    others = F.array_union(F.array(F.lit(0)), F.array_except("near", F.array("home")))
    kept = held.select("grp", F.col("home").alias("other"), F.lit(True).alias("kept"))
    sides = homes.select("grp", "vid", "home", F.explode(others).alias("other")).join(lookup(kept), ["grp", "other"], "left").where("other = 0 or kept")
    sides = sides.select("grp", "vid", F.least("home", "other").alias("lo"), F.greatest("home", "other").alias("hi"), (F.col("home") <= F.col("other")).alias("block"))
    if joins:
        sides = sides.join(lookup(joined.select(*pair)), pair, "left_anti")
    sides = stage(sides, "group-sides")
    # members without a home are both sides of their own comparison
    sides = sides.unionByName(sides.where("hi = 0").withColumn("block", F.lit(False)))
    number = lambda own: F.ceil(F.count(F.when(F.col("block") == F.lit(own), 1)) / limit).cast("int")
    grid = stage(sides.groupBy(*pair).agg(number(True).alias("blocks"), number(False).alias("chunks")).where("blocks > 0 and chunks > 0"), "group-grid")
    if not grid.isEmpty():
        placed = sides.join(lookup(grid), pair)
        spot = lambda n: F.pmod(F.xxhash64("vid"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = placed.where("block").withColumn("i", spot("blocks")).withColumn("j", every("chunks"))
        other = placed.where("not block").withColumn("j", spot("chunks")).withColumn("i", every("blocks"))
        cells = own.unionByName(other).where("hi > 0 or i <= j")
        cells = stage(cells.select(F.xxhash64(*pair, "i", "j").alias("cell"), "vid", "block"), "group-cells")
        cells = payloads.select("vid", "payload").join(lookup(cells), "vid")
        edges.append(stage(cells.repartition("cell").sortWithinPartitions("cell", "vid").select("cell", "vid", "block", "payload").mapInArrow(_across(compare), EDGE), "links-blocks"))
    return edges


def link_groups(members: DataFrame, payloads: DataFrame, compare, limit: int, stars: int = 3) -> DataFrame:
    """Links inside groups: members (grp, vid[, payload][, size]), payloads (vid, payload) to edges (a, b) that connect what links
    connect. ``size`` is the number of members of a group, two at least; where it isn't given, members are counted.

    Groups of at most ``limit`` are compared in one task each. A larger group is first tied to pivots, one after the
    other: the members that are linked to a pivot are at home with it, and the others meet the next one. Then members
    without a home are compared with each other and with those of every home, and the members of every two homes, save
    where one that is linked to both pivots joins them: in blocks of ``limit``, each pair of blocks a task of its own.
    Whoever is linked to a member of a home is near its pivot, so all others are left out of those blocks. Rows are never
    brought together by a large group's key.
    """
    sizes = known = members
    if "size" not in members.columns:
        sizes = stage(members.groupBy("grp").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "group-sizes")
        known = members.join(lookup(sizes), "grp")
    small = known.where(F.col("size") <= limit)
    if "payload" not in members.columns:
        small = small.join(payloads, "vid")
    small = small.select("grp", "vid", "payload").repartition("grp").sortWithinPartitions("grp", "vid")
    edges = [stage(small.mapInArrow(_within(compare, "grp"), EDGE), "links-small")]
    large = known.where(F.col("size") > limit).select("grp", "vid")
    if not sizes.where(F.col("size") > limit).isEmpty():
        rest = stage(large, "group-large")
        rounds, pivots = [], []
        for s in range(1, stars + 1):
            heads = stage(rest.groupBy("grp").agg(F.min("vid").alias("pivot")), "group-heads")
            if heads.isEmpty():
                break
            heads = payloads.select(F.col("vid").alias("pivot"), F.col("payload").alias("pivot_payload")).join(lookup(heads), "pivot")
            pivots.append(stage(heads.select("grp", F.lit(s).alias("s"), "pivot", "pivot_payload"), "group-pivots"))
            rounds.append(_met(rest.withColumns({"home": F.lit(0), "s": F.lit(s)}), pivots[-1], payloads, compare))
            edges.append(rounds[-1].where("linked and vid <> pivot").select(F.col("vid").alias("a"), F.col("pivot").alias("b")))
            rest = stage(rounds[-1].where("not linked").select("grp", "vid"), "group-rest")
        if len(rounds) > 1 or not rest.isEmpty():
            # a group that its first pivot takes whole is done
            left = stage(rounds[0].where("not linked").select("grp").distinct(), "group-left")
            rounds[0] = rounds[0].join(lookup(left), "grp", "left_semi")
            edges += _between_homes(rounds, pivots, payloads, compare, limit)
    out = edges[0]
    for e in edges[1:]:
        out = out.unionByName(e)
    return out


# --- the join ----------------------------------------------------------------------------------------------


def united(large: DataFrame) -> DataFrame:
    """Groups (grp, vid, size), staged, that have much in common made one: a crowd is in many nodes of all trees, in another part each
    time. Each group goes to that of its members that most groups have, and those of one member become one group, unless it
    had more pairs than they have in all. Whoever shared a group still does; no vid is twice in a group."""
    shared = stage(large.groupBy("vid").agg(F.count(F.lit(1)).alias("groups")).where("groups > 1"), "crowd-shared")
    if shared.isEmpty():
        return large
    heads = large.join(lookup(shared), "vid").groupBy("grp", "size").agg(F.max(F.struct("groups", "vid")).alias("most"))
    heads = stage(heads.select("grp", F.col("most.vid").alias("head"), F.pow("size", F.lit(2)).alias("pairs")), "crowd-heads")
    members = stage(large.join(lookup(heads.select("grp", "head")), "grp").select("head", "vid").distinct(), "crowd-members")
    sizes = members.groupBy("head").agg(F.count(F.lit(1)).alias("size"))
    before = heads.groupBy("head").agg(F.sum("pairs").alias("pairs"), F.count(F.lit(1)).alias("groups"))
    sizes = stage(sizes.join(before.where("groups > 1"), "head").where(F.pow("size", F.lit(2)) <= F.col("pairs")).select("head", "size"), "crowd-sizes")
    done = stage(heads.join(lookup(sizes), "head", "left_semi").select("grp"), "crowd-done")
    one = members.join(lookup(sizes), "head").select(F.col("head").alias("grp"), "vid", "size")
    return large.join(lookup(done), "grp", "left_anti").select("grp", "vid", "size").unionByName(one)


def tree_groups(classes: DataFrame, trees: int, picks: int, leaf: int, depth: int) -> DataFrame:
    """Chosen-path trees over classes (vid, sketch, high): (grp, vid, size) of the nodes where the trees end.

    A close pair is together in many nodes of many trees: of the nodes with the same members (at most ``leaf``) one stays, and
    larger ones are united.
    """
    tokens = classes.select("vid", "sketch", "high")
    rows = stage(tokens.mapInArrow(_roots(trees, picks), "node long, vid long"), "tree-roots").withColumn("above", F.lit(1 << 62))
    ended = None
    for level in range(depth):
        nodes = nodes_of(rows, leaf)
        # a node that keeps over half of the node above it is dense: going on down would not take it apart
        ends = (F.col("size") <= leaf) | ((F.col("size") * 2 > F.col("above")) if level else F.lit(False)) | F.lit(level == depth - 1)
        ended = nodes.where(ends) if ended is None else ended.unionByName(nodes.where(ends))
        if level == depth - 1 or nodes.where(~ends).isEmpty():
            break
        # few go deeper: their tokens are looked up, all others stay where they are
        deep = stage(nodes.where(~ends).select("node", F.explode("members").alias("vid"), "size"), "tree-deep")
        if not level:
            tokens = stage(tokens.join(lookup(stage(deep.select("vid").distinct(), "tree-below")), "vid", "left_semi"), "tree-tokens")
        deeper = tokens.join(lookup(deep), "vid").select("node", "vid", "size", "sketch", "high")
        rows = stage(deeper.mapInArrow(_branch(picks), "node long, vid long, above long"), "tree-level")
    whole = F.size("members") == F.col("size")
    once = ended.where(whole).groupBy("members").agg(F.min("node").alias("grp")).select("grp", F.size("members").cast("long").alias("size"), "members")
    parts = ended.where(~whole).select(F.col("node").alias("grp"), F.explode("members").alias("vid"), "size")
    once = once.select("grp", F.explode("members").alias("vid"), "size")
    return stage(once.unionByName(united(stage(parts, "tree-large"))), "tree-leaves")


def candidate_groups(classes: DataFrame, least: int, trees: int, picks: int, leaf: int, depth: int) -> DataFrame:
    """(vid, root) of the groups that sketch links make inside the nodes of the trees."""
    members = tree_groups(classes, trees, picks, leaf, depth)
    return stage(components(link_groups(members, classes.select("vid", F.col("sketch").alias("payload")), Sketches(least), leaf)), "candidate-groups")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, trees: int = 10, picks: int = 2, leaf: int = 512, depth: int = 12) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; more columns are ignored): doc_id, n_shingles, component_id, kept, t1, t2, first.

    Two texts are linked if the Jaccard similarity of their sets of ``words``-word shingles (A-Z lower-cased, split
    at space and bytes 9 to 13) is num/den or more; component_id is the smallest doc_id reachable. A text of fewer
    words has its whole sequence as one shingle; a null or empty text has none and is linked with nothing, so it
    stands alone under its own doc_id. Rows with the same set are always linked, also with the same doc_id. Rows
    whose doc_id is null have a component but never name one, unless no doc_id in it is known. t1 and t2 are a key of the
    text; ``first`` says whether a row is the first of its component by doc_id (null last), then that key, which is so for
    one row of every component, or for identical rows alone. An empty table gives an empty table. ``trees`` and ``picks``
    set the recall, together with SLACK: two texts of similarity 0.8 that nothing else joins are missed with probability
    1.8e-9, of 0.85 with 1.3e-9, by sums over how many of their TOKENS agree (four trees and 4.5 deviations: 6.5e-5 and 1.2e-5).
    """
    prepare(docs.sparkSession)
    seen = stage(profiles(docs, words), "profiles")
    key = ["fa", "fb", "n_shingles"]
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "t1", "t2")
    named = seen.where("n_shingles > 0").groupBy(*key).agg(F.min(place).alias("label"), F.count(F.lit(1)).alias("copies"), F.first("sketch").alias("sketch"), F.first("high").alias("high"))
    classes = stage(named.withColumn("vid", F.monotonically_increasing_id()), "classes")
    groups = candidate_groups(classes, floor_of(num, den), trees, picks, leaf, depth)
    sets = stage(_sets(docs, classes.select("vid", "label", "copies", *key), groups, words, seen), "sets")
    links = link_groups(sets, sets.select("vid", "payload"), Sets(num, den), leaf)
    tied = stage(components(links), "components").withColumnRenamed("id", "vid")
    tied = tied.join(classes.select("vid", *key, "label"), "vid")
    roots = tied.groupBy("root").agg(F.min("label").alias("head"))
    joined = tied.join(stage(roots, "roots"), "root").select(*key, "head")
    alone = classes.where("copies > 1").select("vid", *key, F.col("label").alias("head")).join(tied.select("vid"), "vid", "left_anti").drop("vid")
    named = stage(joined.unionByName(alone), "named")
    out = seen.select("doc_id", "t1", "t2", *key).join(lookup(named), key, "left")
    own = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    first = F.col("head").isNull() | F.col("head").eqNullSafe(place)
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.col("doc_id").eqNullSafe(own).alias("kept"), "t1", "t2", first.alias("first"))


def _sets(docs: DataFrame, classes: DataFrame, groups: DataFrame, words: int, seen: DataFrame) -> DataFrame:
    """Group and full shingle set of the classes that have a candidate, read again from one document of each.

    That document is met by its doc_id and the key of its text, so neither an id that repeats nor a text that does
    brings rows together; identical rows, if there are any, are made one.
    """
    need = stage(groups.withColumnRenamed("id", "vid").join(classes, "vid"), "needed")
    need = need.select(F.col("root").alias("grp"), "vid", "label", F.col("n_shingles").alias("n"), F.col("fa").alias("ga"), F.col("fb").alias("gb"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(), "text")
    same = F.col("doc_id").eqNullSafe(F.col("label.doc_id")) & (F.col("t1") == F.col("label.t1")) & (F.col("t2") == F.col("label.t2"))
    rows = rows.join(lookup(need), same)
    kept = "grp long, vid long, n long, ga long, gb long"
    full = rows.select("grp", "vid", "n", "ga", "gb", "text").mapInArrow(_profile(words, True), f"{kept}, n_shingles long, fa long, fb long, payload binary")
    full = full.where("n = n_shingles and fa = ga and fb = gb").select("grp", "vid", "payload")
    repeated = seen.groupBy("doc_id", "t1", "t2").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    return full if repeated.isEmpty() else full.dropDuplicates(["vid"])
