"""Line dedup: segment-partition edit-distance join of lines, in DataFrame functions only.

Equal lines are brought together by a 128-bit hash with map-side combining, so the join works on different lines.
Every line is split into ``edits`` + 1 segments. Two lines within ``edits`` of each other share one segment at least:
the index holds each line's segments under (length, segment number, text); a probe looks up the substrings of its own
text that a segment of a line of the same or a smaller length can be, by the length difference and by how far edits to
the left and to the right can shift it. Candidates are verified by banded bit-parallel edit distance: a machine
word holds the band of the dynamic programming matrix as vertical differences and slides along the diagonal.

Links tie lines to classes; of each class the first line, by doc_id and line number, stays. Native: no Python code
runs on the executors.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgetide.llm.components import components
from edgetide.llm.runtime import lookup, prepare, stage

#: Lines of fewer characters, after trimming, have exact copies only: edits in so short a line make another line.
LEAST = 40
EDITS = 2
#: One line in so many is looked at for keys that many lines share.
CROWD_SAMPLE = 8


def text_key() -> Column:
    """Tells rows with the same doc_id apart; equal for equal texts."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def lines_of(docs: DataFrame, all_lines: bool = False) -> DataFrame:
    """(doc_id, text_key, line_no, line): the trimmed lines that are not blank, or all; texts are split at newlines."""
    rows = docs.select("doc_id", text_key().alias("text_key"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    rows = rows.withColumn("line", F.trim("line", F.lit(" \t\r\x0b\x0c")))
    return rows if all_lines else rows.where(F.length("line") > 0)


def hashes() -> list[Column]:
    return [F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(7), F.col("line")).alias("h2")]


def place() -> Column:
    """Order of occurrences: by doc_id, unknown ids last, then text, then line number."""
    return F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_key", "line_no")


def segment_at(length: Column, count: int, k: Column) -> Column:
    """Start (from 0) of the k-th of ``count`` segments of a line; k = count gives its end."""
    return F.call_function("div", length * k, F.lit(count)).cast("int")


def part(start: Column, end: Column) -> Column:
    return F.substring("line", start + 1, end - start)


def shifts(edits: int, d: int, steps: int, at: int = 0, spent: int = 0) -> list[tuple[int, ...]]:
    """How far text between ``steps`` edited places can be moved when all of it costs ``edits`` and the end is moved by d."""
    if not steps:
        return [()] if at == d else []
    out = []
    for to in range(at - edits + spent, at + edits - spent + 1):
        out += [(to, *rest) for rest in shifts(edits, d, steps - 1, to, spent + abs(to - at))]
    return out


def keyed(lines: DataFrame, cases: list[tuple[int, int, int]], edits: int, *keep: Column) -> DataFrame:
    """``keep`` and a key for each case (d, k, s): the length less d, k, and what segment k of a line that much shorter
    has, read s characters further right.

    The cases are a constant array that is exploded before the keys are made: one short expression, not one a case, which
    would be more code than the JVM compiles. Four bytes a character let a segment be cut out without a scan.
    """
    array = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(k).alias("k"), F.lit(s).alias("s")) for d, k, s in cases])
    rows = lines.withColumn("wide", F.encode("line", "UTF-32")).select(*keep, "n", "wide", F.explode(array).alias("c"))
    n, k, s = F.col("n") - F.col("c.d"), F.col("c.k"), F.col("c.s")
    start, end = segment_at(n, edits + 1, k), segment_at(n, edits + 1, k + 1)
    text = F.substring("wide", (start + s) * 4 + 1, (end - start) * 4)
    return rows.select(*[c for c in rows.columns if c not in ("n", "wide", "c")], F.xxhash64(n, k, text).alias("key"))


def index_keys(lines: DataFrame, edits: int, *keep: Column) -> DataFrame:
    """Under one key for each segment: length, segment number, its text."""
    return keyed(lines, [(0, k, 0) for k in range(edits + 1)], edits, *keep)


def probe_keys(lines: DataFrame, edits: int, *keep: Column) -> DataFrame:
    """Substrings that segment k of a line shorter by d can be: the shift lies within k edits to its left and, seen from
    the other end, within ``edits`` - k to its right."""
    cases = [(d, k, s) for d in range(edits + 1) for k in range(edits + 1) for s in range(-edits, edits + 1) if abs(s) <= k and abs(s - d) <= edits - k]
    return keyed(lines, cases, edits, *keep)


def fine_keys(edits: int, segments: int, probe: bool) -> Column:
    """Structs (key, free, own): keys of all but ``edits`` of ``segments`` segments, which is what edits within those few
    leave alone; the numbers of those free segments, and hashes of what the line has there and how far that moves what follows.

    What lies between two free segments of the shorter line is moved in the longer one as ``shifts`` allows. The cases
    are a constant array that one expression runs over: as many expressions would be too much code.
    """
    cases = []
    for d in range(edits + 1) if probe else (0,):
        for free in combinations(range(segments), edits):
            for moved in shifts(edits, d, edits) if probe else [(0,) * edits]:
                cases.append(f"named_struct('d', {d}, 'free', array({', '.join(map(str, free))}), 'moved', array({', '.join(map(str, (0, *moved)))}))")

    def key(x: Column) -> Column:
        n = F.col("n") - x["d"]
        at = lambda k: segment_at(n, segments, k)
        moved = [F.get(x["moved"], i) for i in range(edits + 1)]
        starts = [F.lit(0)] + [at(F.get(x["free"], i) + 1) + moved[i + 1] for i in range(edits)]
        ends = [at(F.get(x["free"], i)) + moved[i] for i in range(edits)] + [F.col("n")]
        own = F.array(*[F.xxhash64(part(at(F.get(x["free"], i)) + moved[i], at(F.get(x["free"], i) + 1) + moved[i]), moved[i + 1] - moved[i]) for i in range(edits)])
        return F.struct(F.xxhash64(n, x["free"], *[part(a, b) for a, b in zip(starts, ends)]).alias("key"), x["free"].alias("free"), own.alias("own"))

    return F.transform(F.expr(f"array({', '.join(cases)})"), key)


def common_prefix(left: Column, right: Column, powers: int = 20) -> Column:
    """Length of the common prefix, by halving; lines of up to 2**powers characters."""

    def longer(p: Column, k: Column) -> Column:
        to = p + k
        return F.when((to <= F.least(F.length(left), F.length(right))) & (F.substring(left, p + 1, k) == F.substring(right, p + 1, k)), to).otherwise(p)

    return F.aggregate(F.array(*[F.lit(1 << i) for i in reversed(range(powers))]), F.lit(0), longer)


def edit_distance_within(left: Column, right: Column, edits: int) -> Column:
    """Is the edit distance of two strings of more than ``edits`` characters at most ``edits``? Banded and bit-parallel.

    Column j of the matrix is kept for rows j - edits to j + edits only, as bit vectors of positive and negative
    vertical differences in one long, whose bit i is row j - edits + i; from column to column the band moves one row
    down. The score follows the band's last diagonal to the last row, then that row. It never falls along the
    diagonal, so a pair whose score can't come down to ``edits`` any more is not looked at further.
    """
    c, width = edits, 2 * edits + 1
    full, one = F.lit((1 << width) - 1).cast("long"), F.lit(1).cast("long")

    def bit(x: Column, at: Column) -> Column:
        return F.call_function("shiftright", x, at).bitwiseAND(one) == 1

    def distance(pair: Column) -> Column:
        a, b, m, n = pair["a"], pair["b"], F.size(pair["a"]), F.size(pair["b"])

        def step(s: Column, j: Column) -> Column:
            ch = F.get(b, j - 1)
            eq = F.lit(0).cast("long")
            for i in range(width):
                eq = eq.bitwiseOR(F.when(F.get(a, j - (c + 1 - i)) == ch, F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
            return F.when(s["score"] > 2 * c + n - m, s).otherwise(bound(eq, lambda e: advance(s, j, e)))

        def advance(s: Column, j: Column, eq: Column) -> Column:
            vp, vn = s["vp"], s["vn"]
            d0 = (eq.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(eq).bitwiseOR(vn)
            return bound(d0, lambda d: slide(s, j, d))

        def slide(s: Column, j: Column, d0: Column) -> Column:
            vp, vn = s["vp"], s["vn"]
            hp = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(full)
            hn = d0.bitwiseAND(vp)
            past = j + c - m
            down = F.when(bit(d0, F.lit(width - 1)), 0).otherwise(1)
            at = (F.lit(width - 1) - past).cast("int")
            along = F.when(bit(hp, at), 1).when(bit(hn, at), -1).otherwise(0)
            moved = F.shiftrightunsigned(d0.bitwiseAND(full), 1)
            return F.struct(
                hn.bitwiseOR(F.bitwise_not(moved.bitwiseOR(hp)).bitwiseAND(full)).alias("vp"),
                moved.bitwiseAND(hp).alias("vn"),
                (s["score"] + F.when(past <= 0, down).otherwise(along)).cast("int").alias("score"),
            )

        start = F.struct(F.lit((1 << width) - (1 << c)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), F.lit(c).cast("int").alias("score"))
        upto = lambda last: F.aggregate(F.sequence(F.lit(1), last), start, step, lambda s: s["score"])
        # most pairs that fail do so in the first columns
        hopeless = upto(F.least(n, F.lit(8 * width // 2))) > 2 * c + n - m
        return F.when(F.abs(m - n) > c, False).when(hopeless, False).otherwise(upto(n) <= c)

    return bound(F.struct(F.split(left, "").alias("a"), F.split(right, "").alias("b")), distance)


def bound(value: Column, use) -> Column:
    """use(value) with ``value`` worked out once a row: an expression named in a lambda is else repeated in it."""
    return F.get(F.transform(F.array(value), use), 0)


def crowded(lines: DataFrame, edits: int) -> DataFrame:
    """(key) of index keys that many lines share, found on one line in CROWD_SAMPLE: what it misses is small."""
    some = lines.where(F.pmod("h1", F.lit(CROWD_SAMPLE)) == 0)
    return stage(index_keys(some, edits).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("key"), "line-crowds")


def verified(left: str, right: str, edits: int) -> Column:
    """Are the lines in two columns within ``edits`` of each other?

    What both begin with does not count; edits + 1 characters stay, as the band needs.
    """
    shared = F.least(common_prefix(F.col(left), F.col(right)), F.least(F.length(left), F.length(right)) - (edits + 1))
    tail = lambda x, p: F.substring(F.col(x), p + 1, F.length(x))
    return bound(shared, lambda p: edit_distance_within(tail(left, p), tail(right, p), edits))


def meetings(lines: DataFrame, edits: int) -> DataFrame:
    """lines (h1, n, line) to (h1, g1) that share a segment, and (null, g1) for lines that meet a crowded key.

    Keys that many lines share are left out of the index; only a mark stays in their place.
    """
    crowds = lookup(crowded(lines, edits))
    index = index_keys(lines, edits, F.col("h1")).join(crowds, "key", "left_anti")
    index = index.unionByName(crowds.select(F.lit(None).cast("long").alias("h1"), "key"))
    probe = probe_keys(lines, edits, F.col("h1").alias("g1"))
    other = F.col("h1").isNull() | (F.col("h1") != F.col("g1"))
    return stage(index.join(probe, "key").where(other).select("h1", "g1").distinct(), "line-meetings")


def links_in_crowds(lines: DataFrame, edits: int, segments: int) -> DataFrame:
    """lines (h1, h2, n, line) to the pairs (h1, h2, g1, g2) within ``edits``, by keys of all but ``edits`` of ``segments``
    segments. Variants of one text, which share a third of it, meet only if they agree but for small parts; they are
    verified where they meet, so no pair that fails leaves the join."""

    def fine(probe: bool) -> DataFrame:
        rows = lines.select(*[F.col(c).alias(c.replace("h", "g") if probe else c) for c in ("h1", "h2")], F.col("line").alias("right" if probe else "left"), F.explode(fine_keys(edits, segments, probe)).alias("k"))
        names = {"key": "key"} | ({"own": "right_own"} if probe else {"own": "left_own", "free": "free"})
        return rows.select(*[c for c in rows.columns if c != "k"], *[F.col(f"k.{c}").alias(name) for c, name in names.items()])

    # lines that differ in fewer segments than are free meet under many keys: only that counts whose unchanged free
    # segments are the lowest numbers left. A segment is unchanged if its text is the same and what follows it is moved
    # as far as what comes before it: only then can any other segment be free in its place.
    changed = F.zip_with("left_own", "right_own", lambda a, b: a != b)
    lowest = F.zip_with(F.zip_with(changed, "free", lambda c, f: F.when(c, -1).otherwise(f)), F.sequence(F.lit(0), F.lit(edits - 1)), lambda f, r: (f == -1) | (f == r))
    once = F.forall(lowest, lambda x: x) | F.forall(changed, lambda c: ~c)
    left, right = fine(False).alias("l"), fine(True).alias("r")
    # few keys carry most of the work, so they are dealt over a number of tasks of their own
    tasks = max(lines.sparkSession.sparkContext.defaultParallelism * 4, 64)
    met = left.repartition(tasks, "key").alias("l").join(right.repartition(tasks, "key").alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("h1") != F.col("g1")) & once & verified("left", "right", edits))
    swap = F.col("h1") > F.col("g1")
    return met.select(*[F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("h1", "g1"), ("h2", "g2"), ("g1", "h1"), ("g2", "h2"))])


def links(lines: DataFrame, edits: int, segments: int = 4) -> DataFrame:
    """lines (h1, h2, n, line), all different, to the pairs (h1, h2, g1, g2) within ``edits``, each once."""
    met = meetings(lines.select("h1", "n", "line"), edits)
    pairs = met.where("h1 is not null").select(F.least("h1", "g1").alias("h1"), F.greatest("h1", "g1").alias("g1")).distinct()
    crowd = met.where("h1 is null").select(F.col("g1").alias("h1"), F.lit(True).alias("crowded"))
    # the few lines that have something to compare, with their texts
    ends = pairs.select("h1").unionByName(pairs.select(F.col("g1").alias("h1"))).withColumn("crowded", F.lit(False)).unionByName(crowd)
    ends = stage(ends.groupBy("h1").agg(F.max("crowded").alias("crowded")), "line-ends")
    texts = stage(lines.join(lookup(ends), "h1"), "line-texts")
    both = pairs.join(texts.select("h1", "h2", F.col("line").alias("left")), "h1").join(texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("right")), "g1")
    found = both.where(verified("left", "right", edits)).select("h1", "h2", "g1", "g2")
    return found.unionByName(links_in_crowds(texts.where("crowded"), edits, segments)).distinct()


def classes(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """(h1, h2, n_links, first) of every line that has a copy or a link: ``first`` is the place of its class's first line."""
    rows = lines_of(docs).select(*hashes(), place().alias("first"), "line")
    different = rows.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("line").alias("line"))
    different = stage(different.withColumn("n", F.length("line")), "lines", codec="zstd")
    linked = stage(links(different.where(F.col("n") >= least).select("h1", "h2", "n", "line"), edits), "line-links")
    ends = linked.select("h1", "h2").unionByName(linked.select(F.col("g1").alias("h1"), F.col("g2").alias("h2")))
    degree = stage(ends.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_links")), "line-degrees")
    root = components(linked.select(F.col("h1").alias("a"), F.col("g1").alias("b")), one_task=0).select(F.col("id").alias("h1"), "root")
    some = different.select("h1", "h2", "first", "copies").join(lookup(degree), ["h1", "h2"], "left").where("copies > 1 or n_links > 0")
    some = stage(some.join(lookup(stage(root, "line-roots")), "h1", "left"), "line-classes")
    firsts = some.where("n_links > 0").groupBy("root").agg(F.min("first").alias("class_first"))
    own = some.join(lookup(stage(firsts, "line-firsts")), "root", "left")
    return stage(own.select("h1", "h2", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("n_links") > 0, F.col("class_first")).otherwise(F.col("first")).alias("first")), "line-table")


def dedup_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """One row per line that takes part: doc_id, line_no (from 0), class_doc_id, class_line_no, n_links, kept.

    docs (doc_id, text; more columns are ignored). Lines that are not blank take part; those of fewer than ``least``
    characters after trimming have exact copies only and no links. Equal lines, and lines that a chain of pairs within
    ``edits`` edits joins, are a class; its first line, by doc_id (null last), then text, then line number, is kept. n_links is the number of different texts within ``edits``. Rows with
    the same doc_id and text are one document: their lines get the same result. Null and empty texts have no
    lines; empty tables give empty tables.
    """
    prepare(docs.sparkSession)
    known = lookup(classes(docs, edits, least))
    rows = lines_of(docs).select("doc_id", "line_no", place().alias("here"), *hashes()).join(known, ["h1", "h2"], "left")
    at = F.coalesce("first", "here")
    return rows.select("doc_id", "line_no", at["doc_id"].alias("class_doc_id"), at["line_no"].alias("class_line_no"), F.coalesce("n_links", F.lit(0)).alias("n_links"), (at == F.col("here")).alias("kept"))


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """docs without the lines that dedup_lines does not keep; n_chars, if there, follows the text.

    A document that loses lines and has only whitespace left goes. All other rows stay as they are, nulls included.
    """
    prepare(docs.sparkSession)
    known = lookup(classes(docs, edits, least))
    rows = lines_of(docs, all_lines=True).select("doc_id", "text_key", "line_no", place().alias("here"), *hashes(), (F.length("line") > 0).alias("filled"))
    rows = rows.join(known, ["h1", "h2"], "left").withColumn("stays", ~F.col("filled") | F.col("first").isNull() | (F.col("first") == F.col("here")))
    flags = rows.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.collect_set(F.struct("line_no", "stays")).alias("f"), F.min("stays").alias("whole"))
    flags = flags.where(~F.col("whole")).select("d", "k", F.transform(F.array_sort("f"), lambda x: x["stays"]).alias("stays"))
    flags = stage(flags, "line-flags")
    # documents travel as one struct, so their columns may have any names; flags grow with the texts, so this side is
    # never broadcast by its row count
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("document")
    joined = docs.select(whole, F.col("doc_id").alias("id"), text_key().alias("key")).join(flags, F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    old = F.col("document")["text"]
    cleaned = F.array_join(F.filter(F.split(old, "\n"), lambda x, i: F.coalesce(F.get("stays", i), F.lit(True))), "\n")
    joined = joined.withColumn("new", F.when(F.col("stays").isNotNull(), cleaned).otherwise(old))
    joined = joined.where(F.col("stays").isNull() | F.col("new").rlike(r"[^\x20\x09-\x0D]"))
    out = []
    for c in docs.columns:
        value = F.col("document")[c]
        if c == "text":
            value = F.col("new")
        elif c == "n_chars":
            value = F.when(F.col("stays").isNotNull(), F.length("new").cast(docs.schema[c].dataType)).otherwise(value)
        out.append(value.alias(c))
    return joined.select(*out)
