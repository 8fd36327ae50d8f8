"""Operator 13: exact Jaccard self-join of word n-gram sets by PartEnum signatures.

Sets are put into size bands whose ends are in the ratio LIKE, so similar sets are in one
band or in neighbouring ones; a set gives signatures for its own band's tag and for the
next. Similar sets of a tag differ in at most k elements, k from the tag's largest size.
The domain of n-gram hashes is cut into n1 parts, each part into n2 cells. In one of the
parts at least, similar sets differ in at most k2 = (k + 1) / n1 - 1 elements, so in at
most k2 of its cells; of the subsets of n2 - k2 cells one at least holds the same elements
in both. A signature is a hash of such a subset's elements, of the part and the tag: two
sets within k differences share one, always. `shape` chooses n1, n2 and k2 with the fewest
signatures whose expected number of elements is large enough for the number of sets, so
that few unlike sets meet because a subset is empty in both.

Signatures travel as packed arrays, a blob for each batch of sets and each range of
signatures; of the sets in a batch that share one, a leader goes along and the others are
tied to it on the spot, and so are the leaders of batches to one of theirs. A set is
compared, whole, with the LEADERS that it shares most signatures with, and in large groups
with some drawn at random. Then, where sets with
a common signature are still in different components, all pairs across these are looked at
too, in numpy: sizes and parity counts (which never exceed the differences) leave few that
have to be compared. So components are exact, and a large group of near copies costs about LEADERS
comparisons for each of its sets.

Equal texts are one node, however many copies; of equal sets in a batch one stands for all.

Defined results: null, empty and wordless texts have no n-grams and link with nothing;
fewer words than SHINGLE make one; rows with a null id take part, and a component of such
rows alone has a null component_id; repeated rows and ties are copies like any other;
texts of any length are read whole; an empty table gives an empty result; other columns of
the input are ignored. N-grams are compared by their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import ceil, comb, log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.arrow import runs_of
from lectern.operators.components import stars
from lectern.llm.grams import mixed
from lectern.llm.simhash import shingle_hashes
from lectern.scratch import bucketed, forget, written

SHINGLE = 4
#: Sets with a similarity of LIKE hundredths or more are linked.
LIKE = 85
#: Signatures that are gathered in a batch, and that meet in a range, about.
BATCH, RANGE = 1 << 20, 1 << 21
#: Signatures for a byte of text, about, with the usual shapes; it only sets the number of ranges.
PER_BYTE = 0.15
#: Of about e**MEETING sets with any one tag, one may have an empty signature in a place.
MEETING = 6
#: 64-bit words of a set's parity.
PARITY = 8
#: A key with more members has them meet at random first.
FEW = 8
#: Members of a key in a block, those of them that are compared with a block at a time, and pairs that a task remembers.
BLOCK, STRIP, SEEN = 4096, 128, 200_000


def most_apart(total: int) -> int:
    """How many elements are in one of two similar sets only, at most, when their sizes have this sum or a smaller one."""
    return (100 - LIKE) * total // (100 + LIKE)


@lru_cache(maxsize=4096)
def bands(upto: int) -> list[int]:
    """The first sizes of bands up to and with that of `upto`."""
    first = [1]
    while first[-1] * 100 // LIKE + 1 <= upto:
        first.append(first[-1] * 100 // LIKE + 1)
    return first


@lru_cache(maxsize=4096)
def shape(least: int, k: int, wanted: float) -> tuple[int, int, int]:
    """(n1, n2, k2) for sets of `least` elements or more that differ in up to k, with the fewest signatures of `wanted` elements each, or else the fullest ones."""
    found = []
    for k2 in range(min(k, 7) + 1):
        n1 = ceil((k + 1) / (k2 + 1))
        for n2 in range(k2 + 1, k2 + 8):
            found.append((n1 * comb(n2, k2), -least / n1 * (n2 - k2) / n2, n1, n2, k2))
    enough = [x for x in found if -x[1] >= wanted]
    usual = [x for x in found if x[0] <= 4 * (k + 1)]
    return (min(enough) if enough else min(usual, key=lambda x: x[1]))[2:]


def set_of(text: str | None) -> np.ndarray:
    """The hashes of a text's distinct n-grams, sorted; none of a wordless one."""
    if not (text or "").encode().split():
        return np.zeros(0, np.uint64)
    return np.unique(shingle_hashes(text, SHINGLE))


def signatures(sets: list[np.ndarray], wanted: float) -> tuple[np.ndarray, np.ndarray]:
    """(signature, place in `sets`) of all signatures of all sets."""
    sizes = np.array([len(s) for s in sets], np.int64)
    first = bands(int(sizes.max(initial=1)))
    band = np.searchsorted(first, sizes, "right") - 1
    ends = [*first[1:], first[-1] * 100 // LIKE + 1]
    out = [], []
    for b in np.unique(band[sizes > 0]).tolist():
        own = np.flatnonzero((band == b) & (sizes > 0))
        flat = np.concatenate([sets[i] for i in own])
        of = np.repeat(np.arange(len(own)), sizes[own])
        for tag in (b, b + 1):
            largest = ends[tag] - 1 if tag < len(ends) else ends[-1] * 100 // LIKE
            k = most_apart(2 * largest)
            n1, n2, k2 = shape(first[max(0, tag - 1)], k, wanted)
            part = (flat >> np.uint64(40)) % np.uint64(n1)
            cell = (flat & np.uint64(0xFFFFFFFF)) % np.uint64(n2)
            cells = np.zeros(len(own) * n1 * n2, np.uint64)
            with np.errstate(over="ignore"):
                np.add.at(cells, ((of * n1 + part.astype(np.int64)) * n2 + cell.astype(np.int64)), mixed(flat))
                cells = cells.reshape(-1, n2)
                places = np.tile(np.arange(n1, dtype=np.uint64), len(own)) << np.uint64(16) | np.uint64(tag << 48)
                for s, subset in enumerate(combinations(range(n2), n2 - k2)):
                    total = cells[:, subset[0]].copy()
                    for j in subset[1:]:
                        total += cells[:, j]
                    out[0].append(mixed(total + mixed(places | np.uint64(s))))
                    out[1].append(np.repeat(own, n1))
    if not out[0]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out[0]), np.concatenate(out[1])


def tied(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, leader, other node) of nodes with equal keys, and where the leaders stand: each key has a leader drawn for it."""
    with np.errstate(over="ignore"):
        drawn = mixed(keys.astype(np.uint64) ^ mixed(nodes.astype(np.uint64)))
    order = np.lexsort((drawn, keys))
    keys, nodes = keys[order], nodes[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
    rest = ~new & (nodes != nodes[lead])
    return keys[rest], nodes[lead][rest], nodes[rest], order[new]


#: Leaders that each node is compared with at first, those that it shares most keys with.
LEADERS = 3

FIELDS = "range long, base long, keys binary, places binary, node long, n long, key long, first long"


def signed(nodes: DataFrame, ranges: int, wanted: float) -> DataFrame:
    """Rows of FIELDS for a table (node, text): blobs of signatures by range; node and n; key, first and node for ties within a batch."""
    schema = pa.schema([("range", pa.int64()), ("base", pa.int64()), ("keys", pa.binary()), ("places", pa.binary()), *((c, pa.int64()) for c in ("node", "n", "key", "first"))])

    def rows(count: int, /, **columns: list | np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema)

    def batch_of(ids: np.ndarray, sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        yield rows(len(ids), range=ids % ranges, node=ids, n=[len(s) for s in sets])
        # Of equal sets one gives signatures, the others are tied to it under a key of their own.
        kept: dict[bytes, int] = {}
        lead = [kept.setdefault(xxhash.xxh3_128_digest(s.tobytes()), i) if len(s) else i for i, s in enumerate(sets)]
        again = np.flatnonzero(np.array(lead) != np.arange(len(ids)))
        if len(again):
            yield rows(len(again), range=ids[again] % ranges, key=-1 - ids[again], first=ids[np.array(lead)[again]], node=ids[again])
            ids = np.delete(ids, again)
            sets = [s for i, s in enumerate(sets) if lead[i] == i]
        found, places = signatures(sets, wanted)
        # A key is its range, then 32 bits.
        keys = ((found % np.uint64(ranges)) << np.uint64(32) | found >> np.uint64(32)).view(np.int64)
        key, first, other, at = tied(keys, ids[places])
        if len(key):
            yield rows(len(key), range=key >> 32, key=key, first=first, node=other)
        keys, own = keys[at], ids[places[at]] - ids.min()
        cuts = np.searchsorted(keys, np.arange(ranges + 1) << 32)
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        low, own = keys.astype("<u4"), own.astype("<u4" if np.ptp(ids) < 2**32 else "<u8")
        blobs = [(low[cuts[r] : cuts[r + 1]].tobytes(), own[cuts[r] : cuts[r + 1]].tobytes()) for r in full]
        yield rows(len(full), range=full, base=np.full(len(full), ids.min()), keys=[x for x, _ in blobs], places=[x for _, x in blobs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sets, held = [], [], 0
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(node)
                sets.append(set_of(text.as_py()))
                held += len(sets[-1])
                if held >= BATCH:
                    yield from batch_of(np.array(ids, np.int64), sets)
                    ids, sets, held = [], [], 0
        if ids:
            yield from batch_of(np.array(ids, np.int64), sets)

    return nodes.select("node", "text").mapInArrow(run, FIELDS)


def met(blobs: DataFrame) -> DataFrame:
    """(node, n) of all nodes, and (key, first, node) of all ties, from rows of FIELDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "n", "key", "first"]
        for (number,), rows in runs_of(batches, 1):
            plain = rows.filter(rows.column("node").is_valid()).select(names)
            yield from plain.to_batches(max_chunksize=10_000)
            keys, nodes = [], []
            for base, low, places in zip(*(rows.column(c).to_pylist() for c in ("base", "keys", "places"))):
                if base is not None:
                    keys.append(np.frombuffer(low, "<u4"))
                    nodes.append(base + np.frombuffer(places, "<u4" if len(places) == len(low) else "<u8").astype(np.int64))
            if keys:
                key, first, other, _ = tied(np.concatenate(keys), np.concatenate(nodes))
                for at in range(0, len(key), 10_000):
                    part = slice(at, at + 10_000)
                    made = [pa.array(other[part]), pa.nulls(len(key[part]), pa.int64()), pa.array((number << 32) + key[part].astype(np.int64)), pa.array(first[part])]
                    yield pa.RecordBatch.from_arrays(made, names=names)

    dealt = blobs.repartition("range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, "node long, n long, key long, first long")


def parity(hashes: np.ndarray) -> np.ndarray:
    """For each of 64 * PARITY classes of hashes, one bit: whether the set has an odd number of them."""
    odd = np.bincount((hashes >> np.uint64(20) & np.uint64(64 * PARITY - 1)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def whole_sets(nodes: DataFrame) -> DataFrame:
    """(node, n, parity, hashes) for a table (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [set_of(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.list_(pa.int64())),
                    pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                ], names=["node", "n", "parity", "hashes"])

    return nodes.select("node", "text").mapInArrow(run, "node long, n long, parity array<bigint>, hashes array<bigint>")


def alike(shared: Column, total: Column) -> Column:
    return shared * (100 + LIKE) >= total * LIKE


def linked(pairs: DataFrame, sets: DataFrame, picked: bool = True) -> DataFrame:
    """The pairs (a, b) of nodes whose sets are similar; sets travel only where sizes and parities leave room.

    Both sides of the comparison are shuffled, so the sets that are wanted are `picked` out first, once for both, unless
    that is most of them.
    """
    small = [sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("parity").alias(f"p{x}")) for x in "ab"]
    total = F.col("na") + F.col("nb")
    apart = sum(F.bit_count(F.col("pa")[i].bitwiseXOR(F.col("pb")[i])) for i in range(PARITY))
    # As many as `apart` differ, so at most (total - apart) / 2 are shared.
    near = pairs.join(small[0], "a").join(small[1], "b").where(alike(F.least("na", "nb"), total) & alike((total - apart) / 2, total))
    near = near.select("a", "b", total.alias("total"))
    if picked:
        near = written(near, "near")
        wanted = near.select(F.col("a").alias("node")).unionByName(near.select(F.col("b").alias("node"))).distinct()
        sets = written(sets.select("node", "hashes").join(wanted, "node", "left_semi"), "picked")
    large = [sets.select(F.col("node").alias(x), F.col("hashes").alias(f"h{x}")) for x in "ab"]
    both = near.join(large[0], "a").join(large[1], "b")
    found = written(both.where(alike(F.size(F.array_intersect("ha", "hb")), F.col("total"))).select("a", "b"), "similar")
    if picked:
        forget(near, sets)
    return found


def near_parities(sizes: tuple[np.ndarray, np.ndarray], parities: tuple[np.ndarray, np.ndarray], roots: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of members of two blocks in different components whose sizes and parities don't tell them apart, in strips."""
    for at in range(0, len(sizes[0]), STRIP):
        strip = slice(at, at + STRIP)
        total = sizes[0][strip, None] + sizes[1][None, :]
        near = np.minimum(sizes[0][strip, None], sizes[1][None, :]) * (100 + LIKE) >= total * LIKE
        near &= roots[0][strip, None] != roots[1][None, :]
        apart = np.zeros(near.shape, np.uint16)
        for k in range(PARITY):
            apart += np.bitwise_count(parities[0][strip, None, k] ^ parities[1][None, :, k])
        # As many as `apart` differ, so at most (total - apart) / 2 are shared.
        near &= apart * np.int64(100 + LIKE) <= (100 - LIKE) * total
        i, j = np.nonzero(near)
        yield i + at, j


def untied(members: DataFrame, torn: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes with a common key in different components whose sets may be similar, by parities in numpy, block by block.

    `members` has key, node, root, n and parity, `torn` key, lead and m, the members there are. Keys with the same lead
    meet in one task, where pairs that came with an earlier key are left out as long as SEEN of them are held.
    """
    sized = members.join(torn.select("key", "lead", F.ceil(F.col("m") / BLOCK).alias("blocks")), "key")
    own = sized.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    own = own.select("lead", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "key", "block", "node", "root", "n", "parity")
    keys = ["lead", "p", "q", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen = None, set()
        for key, rows in runs_of(batches, len(keys)):
            if key[:3] != task or len(seen) > SEEN:
                task, seen = key[:3], set()
            block, node, root, n = (rows.column(c).to_numpy() for c in ("block", "node", "root", "n"))
            parity = rows.column("parity").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, PARITY)  # signed numbers count as their absolute values
            p, q = (np.flatnonzero(block == x) for x in key[1:3])
            for i, j in near_parities((n[p], n[q]), (parity[p], parity[q]), (root[p], root[q])):
                a, b = node[p[i]], node[q[j]]
                pairs = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist())) - seen
                if pairs:
                    seen |= pairs
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], names=["a", "b"])

    return own.repartition("lead", "p", "q").sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, named: DataFrame, ties: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the nodes with similar sets, from ties (key, first, node) between nodes with a common signature.

    `nodes` has node, digest and text, in buckets by digest, and is forgotten when the sets that have to be compared are
    there; `named` has node and digest.
    """
    met = ties.groupBy("node", "first").agg(F.count("*").alias("keys"))
    most = met.withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("keys"), "first"))).where(F.col("k") <= LEADERS)
    first = written(most.select(F.least("first", "node").alias("a"), F.greatest("first", "node").alias("b")).distinct(), "first-pairs")
    some = written(ties.select("node").unionByName(ties.select(F.col("first").alias("node"))).distinct(), "tied-nodes")
    # Texts lie in buckets by their digest, so only the digests of those that are wanted are shuffled.
    wanted = some.join(named, "node").select("digest")
    sets = written(whole_sets(nodes.join(wanted, "digest")), "sets")
    forget(nodes, some)
    roots = stars(linked(first, sets, picked=False))
    led = written(ties.select("key", F.col("first").alias("node")).distinct().unionByName(ties.select("key", "node")), "led")
    members, torn, used = torn_apart(led, roots)
    # In a large group each member meets another at random for each of its keys; most groups that hang together do so after that.
    drawn = Window.partitionBy("key").orderBy(F.xxhash64("key", "node"))
    crowded = members.join(torn.where(F.col("m") > FEW).select("key"), "key")
    chained = crowded.select("root", "node", F.lag("root").over(drawn).alias("other"), F.lag("node").over(drawn).alias("before")).where("root <> other")
    chained = chained.select(F.least("before", "node").alias("a"), F.greatest("before", "node").alias("b")).distinct()
    hung = roots.select(F.col("root").alias("a"), F.col("node").alias("b"))
    chained = written(chained.join(first, ["a", "b"], "left_anti"), "drawn-pairs")
    forget(used, torn)
    roots = stars(linked(chained, sets).unionByName(hung))
    members, torn, used = torn_apart(led, roots)
    looked = members.join(sets.select("node", "n", "parity"), "node")
    across = written(untied(looked, torn).distinct().join(first, ["a", "b"], "left_anti"), "pairs")
    forget(used, torn, led)
    found = linked(across, sets).unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))
    forget(sets)
    return found


def torn_apart(led: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, node, root) of members, and (key, lead, m) of keys whose members are in different components: the least root and their number; the table to forget with the latter."""
    members = written(led.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")).distinct(), "members")
    torn = members.groupBy("key").agg(F.min("root").alias("lead"), F.max("root").alias("last"), F.count("*").alias("m"))
    torn = written(torn.where("lead <> last").drop("last"), "torn")
    return members.join(torn.select("key"), "key", "left_semi"), torn, members


def similar_sets(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of `df`: doc_id, n_shingles and component_id (the smallest id reachable over links)."""
    words = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    keyed = words.select(F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), "doc_id", "text")
    copies = written(keyed.select("digest", "doc_id"), "digests")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("least")
    nodes = keyed.groupBy("digest").agg(least, F.first("text").alias("text"))
    nodes = bucketed(nodes.select(F.monotonically_increasing_id().alias("node"), "digest", "least", "text"), "nodes", "digest")
    named = written(nodes.select("node", "digest", "least"), "named-nodes")
    seen = nodes.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    ranges = max(1, round((seen[1] or 0) * PER_BYTE / RANGE))
    wanted = max(2.0, log(max(1, seen[0])) - MEETING)
    found = written(met(signed(nodes, ranges, wanted)), "ties")
    sizes, ties = found.where("n IS NOT NULL").select("node", "n"), found.where("n IS NULL").select("key", "first", "node")
    roots = stars(links(nodes, named, ties))
    placed = named.join(sizes, "node").join(roots, "node", "left")
    placed = written(placed.select("digest", "least", "n", F.coalesce("root", "node").alias("root")), "placed")
    least = written(placed.groupBy("root").agg(F.min("least").alias("least")), "least")
    named = placed.drop("least").join(least, "root").select("digest", "n", F.col("least.doc_id").alias("component_id"))
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return copies.join(named, "digest").select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


ORACLE_SIMILAR = f"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct([array_to_string(w[i:i + {SHINGLE - 1}], ' ') for i in range(1, greatest(len(w) - {SHINGLE - 1}, 1) + 1)]) END AS s
  FROM worded
), element AS (SELECT r, len(s) AS n, unnest(s) AS e FROM sets),
link AS (
  SELECT a.r AS a, b.r AS b FROM element a JOIN element b ON a.e = b.e AND a.r <> b.r
  GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= {LIKE} * (a.n + b.n - count(*))
), reach AS (
  SELECT r AS a, r AS b FROM sets UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(o.doc_id) AS component_id
FROM sets s JOIN reach ON s.r = reach.a JOIN sets o ON reach.b = o.r GROUP BY s.r, s.doc_id, s.s"""
