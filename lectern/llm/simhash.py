"""Operator 10: near-duplicates by SimHash and tiled exact comparison.

Fingerprints that are equal are one, so copies cost nothing. Distinct fingerprints are
grouped into tiles by population counts. One differing bit changes one count by one; so
tiles whose counts differ by more than the radius hold no pair within it and are
skipped. What is left is compared in numpy, tile against tile, by exclusive-or and bit
counts: exact, with nothing dropped. A tile of more than BLOCK fingerprints is dealt
into blocks that are compared with each other, in strips of STRIP rows.

Two laws use this. `near_components` links 64-bit fingerprints of SHINGLE words that
differ in at most RADIUS bits; its tiles are the counts of a fingerprint's four quarters.
`without_near_copies` finds texts whose sets of five-word shingles have a Jaccard
similarity of NEAR or more: fingerprints of WIDE bits within WIDE_RADIUS are candidates,
tiled by size classes (similar sets have similar sizes) and by population counts, and
the sets of candidates are then compared exactly, so no link is wrong; near copies whose
fingerprints lie farther apart are missed (README says how many).

Defined results: null or wordless texts have fingerprint zero and link like any other;
fewer words than a shingle has make one shingle; rows with a null id take part, and a
component of such rows alone has a null component_id; of a component the row with the
smallest id stays, one without an id only where no other is there; texts of any length
are read whole; an empty table gives an empty result; other columns of the input are
ignored or passed through, whatever their names.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.arrow_io import append_columns
from lectern.operators.components import stars
from lectern.llm.grams import mixed
from lectern.scratch import forget, kept_only, numbered, without_rows, written

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Fingerprints in a block, and rows of a block that are compared at a time: STRIP * BLOCK counts are held.
BLOCK, STRIP = 4096, 128
#: Hashes whose bits are counted at a time; sums of that many bits fit in a byte.
SLICE = 255

WIDE_SHINGLE = 5
#: Texts with a similarity of 4 / 5 or more are near copies.
NEAR = (4, 5)
#: 64-bit words of a wide fingerprint, and how many of its bits may differ.
WIDE, WIDE_RADIUS = 4, 54
#: Shingles in a block of candidates that are compared exactly: two blocks are held at a time.
SHINGLES_A_BLOCK = 1 << 17
#: Set sizes at which a size class begins: sets in a ratio of NEAR or more are in the same class or the next.
CLASSES = [-(-NEAR[1] ** k // NEAR[0] ** k) for k in range(120)]


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included; those of a wordless text's one empty shingle."""
    words = (text or "").encode().lower().split()  # bytes: A-Z only, and ASCII white space only
    line = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, SEED)], np.uint64)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    return np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[size:])], np.uint64)


def majority(hashes: np.ndarray) -> np.ndarray:
    """64-bit words whose bits are 1 where over half of the rows of `hashes` (rows x words) have a 1."""
    rows = np.ascontiguousarray(hashes).astype("<u8", copy=False).view(np.uint8).reshape(len(hashes), -1)
    ones = np.zeros(8 * rows.shape[1], np.int64)
    for at in range(0, len(rows), SLICE):
        ones += np.unpackbits(rows[at : at + SLICE], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: str | None) -> int:
    """The SimHash of a text's word shingles as an unsigned 64-bit integer."""
    if not (text or "").encode().split():
        return 0
    return int(majority(shingle_hashes(text, SHINGLE)[:, None])[0])


def fingerprints(df: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of `df` (None: all) and `fp`, the fingerprint's 64 bits as a long."""
    added = T.StructType([T.StructField("fp", T.LongType())])

    def compute():
        return lambda texts: [pa.array(np.array([fingerprint(t) for t in texts.to_pylist()], np.uint64).view(np.int64), pa.int64())]

    return append_columns(df, text, keep, added, compute)


def forest(nodes: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The graph of links (i, j) between places in `nodes` reduced to one star for each component."""
    label = np.arange(len(nodes), dtype=np.int32)
    while len(i):
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, label[i], least)
        np.minimum.at(new, label[j], least)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    away = label != np.arange(len(nodes))
    return nodes[away], nodes[label[away]]


def near_places(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of fingerprints of `a` and `b` (rows x words) that differ in at most `radius` bits.

    Half of the words are compared for all pairs, the others only where those leave room.
    """
    half = max(1, a.shape[1] // 2)
    apart = sum(np.bitwise_count(a[:, None, k] ^ b[None, :, k]) for k in range(half))
    i, j = np.nonzero(apart <= radius)
    if half < a.shape[1]:
        rest = np.bitwise_count(a[i, half:] ^ b[j, half:]).sum(axis=1) + apart[i, j]
        i, j = i[rest <= radius], j[rest <= radius]
    return i, j


def joined(ids_a: np.ndarray, a: np.ndarray, ids_b: np.ndarray, b: np.ndarray, same: bool, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within the radius between two blocks (one block if `same`), reduced to stars strip by strip."""
    ids = ids_a if same else np.concatenate([ids_a, ids_b])
    found = [], []
    for at in range(0, len(a), STRIP):
        low = at if same else 0  # pairs before the strip have been met
        i, j = near_places(a[at : at + STRIP], b[low:], radius)
        own = i < j if same else np.ones(len(i), bool)
        i, j = i[own] + at, j[own] + (at if same else len(a))
        if len(i):
            places, at_places = np.unique(np.concatenate([i, j]), return_inverse=True)
            x, y = forest(places, at_places[: len(i)], at_places[len(i) :])
            found[0].append(x)
            found[1].append(y)
    if not found[0]:
        return ids[:0], ids[:0]
    return forest(ids, np.concatenate(found[0]), np.concatenate(found[1]))


def compared(prints: DataFrame, words: list[str], steps: list[tuple[int, bool]], radius: int) -> DataFrame:
    """Links (a, b) that connect exactly the ids whose fingerprints are within the radius, directly or by way of others.

    `prints` has columns id, the `words` of the fingerprint and tile; `steps` says which tiles meet: what is added to a
    tile's number, in one direction only, and whether that is the tile itself. A tile's fingerprints travel as blocks.
    """
    # One row for each tile: their number is bounded by the population counts and size classes there are.
    full = prints.groupBy("tile").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocks = (
        prints.join(F.broadcast(full), "tile")
        .groupBy("tile", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
        .agg(F.collect_list(F.struct("id", *words)).alias("of"))
        .select("tile", "block", F.col("of.id").alias("ids"), *(F.col(f"of.{w}").alias(w) for w in words))
    )
    blocks = written(blocks, "blocks")
    meet = F.array(*(F.struct(F.lit(s).alias("by"), F.lit(x).alias("same")) for s, x in steps))
    left = blocks.withColumn("step", F.explode(meet)).select(
        F.col("tile").alias("tile_a"), F.col("block").alias("block_a"), F.col("step.same").alias("same"),
        (F.col("tile") + F.col("step.by")).alias("tile"), F.struct("ids", *words).alias("a"),
    )
    right = blocks.select("tile", "block", F.struct("ids", *words).alias("b"))
    pairs = left.join(right, "tile").where(~F.col("same") | (F.col("block_a") <= F.col("block")))
    pairs = pairs.withColumn("same", F.col("same") & (F.col("block_a") == F.col("block")))
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = pairs.repartition(parts, "tile_a", "block_a", "tile", "block").select("a", "b", "same")

    def block_of(x: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
        ids = x["ids"].values.to_numpy()
        return ids, np.stack([x[w].values.to_numpy().view(np.uint64) for w in words], axis=1)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, same in zip(batch.column(0), batch.column(1), batch.column(2)):
                x, y = joined(*block_of(a), *block_of(b), same.as_py(), radius)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long")


def tile_steps() -> list[tuple[int, bool]]:
    """What to add to a tile's number, made of four counts, for each tile near enough, in one direction only; and whether it is the tile itself."""
    near = [d for d in product(range(-RADIUS, RADIUS + 1), repeat=4) if sum(map(abs, d)) <= RADIUS and d >= (0, 0, 0, 0)]
    return [(sum(x << 5 * i for i, x in enumerate(d)), not any(d)) for d in near]


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints (column fp) within the radius, directly or by way of others."""
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))) + RADIUS for i in range(4)]
    tile = sum((F.shiftleft(q.cast("int"), 5 * i) for i, q in enumerate(quarter)), F.lit(0))
    tiled = fps.select(F.col("fp").alias("id"), F.col("fp").alias("w0"), tile.cast("int").alias("tile"))
    return compared(tiled, ["w0"], tile_steps(), RADIUS)


def least_row() -> Column:
    """What orders rows: those with an id first, by id and place."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")


def near_components(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `df`: doc_id, fp, component_id (the smallest id reachable over links), kept (the one row of each component that has it) and row, its place in `df`."""
    plain = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = written(fingerprints(plain, keep=["doc_id", "row"]), "fingerprints")
    fps = written(rows.groupBy("fp").agg(F.min(least_row()).alias("least")), "distinct")
    hung = stars(links(fps.select("fp"))).withColumnRenamed("node", "fp")
    rooted = written(fps.join(hung, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = written(rooted.groupBy("root").agg(F.min("least").alias("first")), "components")
    named = rooted.join(least, "root").select("fp", "first")
    return rows.join(named, "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"), (F.col("row") == F.col("first.row")).alias("kept"), "row")


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of a text's five-word shingles, sorted."""
    return np.unique(shingle_hashes(text, WIDE_SHINGLE))


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of a set of hashes: WIDE words, each from a hash of its own."""
    with np.errstate(over="ignore"):
        return majority(np.stack([mixed(hashes + np.uint64(k + 1) * np.uint64(0x9E3779B97F4A7C15)) for k in range(WIDE)], axis=1))


def wide_prints(placed: DataFrame) -> DataFrame:
    """(doc_id, row, key, n, class, w0...) of each text of `placed`: a digest of its set, the set's size and size class, and the fingerprint's words."""
    kinds = [("key", T.BinaryType()), ("n", T.IntegerType()), ("class", T.IntegerType()), *((f"w{k}", T.LongType()) for k in range(WIDE))]

    def work(texts: pa.Array) -> list[pa.Array]:
        sets = [shingle_set(t) for t in texts.to_pylist()]
        prints = np.stack([wide_print(s) for s in sets]).view(np.int64) if sets else np.zeros((0, WIDE), np.int64)
        sizes = [len(s) for s in sets]
        return [
            pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(sizes, pa.int32()), pa.array([bisect(CLASSES, n) for n in sizes], pa.int32()),
            *(pa.array(np.ascontiguousarray(prints[:, k])) for k in range(WIDE)),
        ]

    return append_columns(placed, "text", ["doc_id", "row"], T.StructType([T.StructField(*x) for x in kinds]), lambda: work)


def wide_links(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b): links that connect the rows of `nodes` whose wide fingerprints are within the radius and whose sizes allow a similarity of NEAR."""
    words = [f"w{k}" for k in range(WIDE)]
    ones = sum(F.bit_count(w) for w in words)
    # Bands of counts: those that differ by more than the radius aren't in the same band or the next.
    band = F.floor(ones / (WIDE_RADIUS + 1)).cast("int") + 1
    tiled = nodes.select(F.col("row").alias("id"), *words, (F.col("class") * 16 + band).alias("tile"))
    return compared(tiled, words, [(0, True), (1, False), (15, False), (16, False), (17, False)], WIDE_RADIUS)


def near_enough(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, as sorted arrays, have a similarity of NEAR or more."""
    small, large = sorted((len(a), len(b)))
    if small * NEAR[1] < large * NEAR[0]:
        return False
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return shared * (NEAR[0] + NEAR[1]) >= (len(a) + len(b)) * NEAR[0]


def verified(ids: np.ndarray, prints: np.ndarray, sets: list[np.ndarray], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the links of sets with a similarity of NEAR or more; pairs that others connect already aren't compared.

    `first` marks members of a first block: where two blocks meet, only pairs between them are.
    """
    label = np.arange(len(ids))
    apart = bool((~first).any())
    for at in range(0, len(ids), STRIP):
        i, j = near_places(prints[at : at + STRIP], prints[at:], WIDE_RADIUS)
        for k in np.unique(i):
            own, others = k + at, j[i == k] + at
            others = others[(others > own) & ~(apart & (first[others] == first[own]))]
            others = others[label[others] != label[own]]
            while len(others):
                if near_enough(sets[own], sets[others[0]]):
                    label[label == label[others[0]]] = label[own]
                    others = others[label[others] != label[own]]
                else:
                    others = others[1:]
    away = label != np.arange(len(ids))
    return ids[away], ids[label[away]]


def exact_links(placed: DataFrame, nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links (a, b) between candidates whose sets have a similarity of NEAR or more.

    Candidates that hang together, (node, root) in `candidates`, meet in one group, or if they have many shingles in
    blocks that meet pair by pair, so what a task holds at a time is bounded. Each block brings its sets once for each
    block of its own group only.
    """
    members = candidates.select(F.col("node").alias("row"), "root").unionByName(candidates.select(F.col("root").alias("row"), "root").distinct())
    members = written(nodes.select("row", "n", *(f"w{k}" for k in range(WIDE))).join(members, "row"), "members")
    sizes = written(members.groupBy("root").agg(F.ceil(F.sum(F.col("n").cast("long")) / SHINGLES_A_BLOCK).alias("blocks")), "groups")
    own = F.pmod(F.xxhash64("row"), F.col("blocks"))
    dealt = members.join(sizes, "root").withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(
        "row", "root", *(f"w{k}" for k in range(WIDE)), "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q")
    )
    texts = placed.select("row", "text").join(dealt, "row")
    columns = ["root", "p", "q", "block", "row", *(f"w{k}" for k in range(WIDE))]
    texts = texts.repartition("root", "p", "q").sortWithinPartitions("root", "p", "q", "row").select(*columns, "text")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        key = None

        def links_of(group: list[tuple], p: int, q: int) -> pa.RecordBatch:
            ids, prints, sets, blocks = zip(*group)
            first = np.array(blocks) == p if p != q else np.ones(len(ids), bool)
            x, y = verified(np.array(ids, np.int64), np.stack(prints), list(sets), first)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

        for batch in batches:
            heads = np.stack([c.to_numpy() for c in batch.columns[: 5 + WIDE]], axis=1)
            for head, text in zip(heads, batch.column(5 + WIDE)):
                now = tuple(head[:3].tolist())
                if now != key and len(held) > 1:
                    yield links_of(held, *key[1:])
                if now != key:
                    held, key = [], now
                held.append((head[4], head[5:].view(np.uint64), shingle_set(text.as_py()), head[3]))
        if len(held) > 1:
            yield links_of(held, *key[1:])

    return texts.mapInArrow(verify, "a long, b long")


def near_copies(placed: DataFrame) -> DataFrame:
    """(row) of those rows of a stored table (doc_id, text, row) that go when one of each component of near copies stays."""
    prints = written(wide_prints(placed), "prints")
    words = [F.first(c).alias(c) for c in ("n", "class", *(f"w{k}" for k in range(WIDE)))]
    nodes = prints.groupBy("key").agg(F.min(least_row()).alias("least"), F.count("*").alias("copies"), *words)
    nodes = written(nodes.withColumn("row", F.col("least.row")), "nodes")
    candidates = stars(wide_links(nodes))
    hung = stars(exact_links(placed, nodes, candidates))
    forget(candidates)
    kin = hung.select(F.col("node").alias("row"), "root").unionByName(hung.select(F.col("root").alias("row"), "root").distinct())
    kin = written(nodes.select("row", "least").join(kin, "row"), "kin")
    first = written(kin.groupBy("root").agg(F.min("least").alias("first")), "first")
    related = kin.join(first, "root").where(F.col("row") != F.col("first.row")).select("row")
    shared = written(nodes.where("copies > 1").select("key", F.col("row").alias("stays")), "shared-sets")
    copies = prints.join(shared, "key").where(F.col("row") != F.col("stays")).select("row")
    return related.unionByName(copies)


def without_near_copies(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `df` that stay when one of each component of near copies does."""
    stored, row = numbered(df, "numbered")
    placed = stored.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(row).alias("row"))
    return without_rows(stored, row, kept_only("dropped", lambda: near_copies(placed)))
