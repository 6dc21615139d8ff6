"""Near-duplicate documents by SimHash fingerprints and BK-trees.

Fingerprints within a Hamming radius of each other link; the components of the links are the near-duplicate groups.

* Equal fingerprints are one entry, so exact copies cost one row each, never a pair.
* Two fingerprints within radius r of 64 bits agree on at least one of r + 1 blocks of bits.  Every entry belongs to r + 1
  shards, one for each block and its value; shards share bins, and a bin that holds more than ``TREE_ENTRIES`` entries
  is split, so that no tree is larger whatever the data.
* Every part of a bin becomes a forest of BK-trees, one for each shard in it: the children of a node are keyed by their integer
  distance to it.  A probe at distance d from a node follows only the edges d - r .. d + r, level by level for a whole block
  of probes at once.
* The trees are broadcast if all of them together fit ``BROADCAST_BYTES``; beyond that the same join is shuffled by bin.
* A task emits a spanning forest of the links that it found, not the links: at most one row per entry.

Nulls: a null text has no words and the fingerprint zero, linked like any other; rows with a null id get a
fingerprint, and a null component.  Repeated rows are kept.  Extra columns are ignored by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from turfline.llm import by_value
from turfline.llm.buffers import byte_column, ranges
from turfline.llm.components import components, local_roots
from turfline.session import stage

by_value(__name__)

RADIUS = 4
SHINGLE_WORDS = 4
SEED = 42
#: Entries of one tree row at most (nearly: parts of a split bin are dealt by hash).
TREE_ENTRIES = 16_384
#: All tree rows together, as bytes, up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Probe-node visits at most in one block of probes.
VISITS = 2_000_000


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """SimHash of the word shingles of a text (repeats count), A-Z in lower case; zero without words."""
    split = text.lower().split()
    if not split:
        return 0
    joined = b" ".join(split)
    if len(split) <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, split), np.int64, len(split))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths).tolist()
    digest = xxhash.xxh64_intdigest
    n = len(split) - words + 1
    counts = np.zeros(64, np.int64)
    stops = ends[words - 1:].tolist()
    for low in range(0, n, 1 << 16):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[low:low + (1 << 16)], stops[low:low + (1 << 16)])], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in np.flatnonzero(counts * 2 > n).tolist())


def fingerprints(documents: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, bits long) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_column(batch.column(1))
            found = np.array([fingerprint(data[a:b].tobytes(), words) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], ["doc_id", "bits"])
    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, bits long")


def with_fingerprint(documents: DataFrame, name: str, words: int = SHINGLE_WORDS) -> DataFrame:
    """``documents`` with the column ``name``: the fingerprint as in ``near_duplicates``."""
    columns = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f"{fingerprint((t or '').encode(), words):016x}" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in columns), pa.array(found, pa.string())], [*columns, name])
    return documents.mapInArrow(run, StructType([*documents.schema.fields]).add(name, StringType()))


def build_forest(shard: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """BK-trees of all shards: (root entry of each shard number, edge keys parent * 65 + distance in order, edge children).

    Entries are numbers into ``bits``; the first entry of a shard is its root, and every level takes the first entry of
    each (parent, distance) group as that child and hands the others down to it.
    """
    names, first, of = np.unique(shard, return_index=True, return_inverse=True)
    rest = np.setdiff1d(np.arange(len(bits)), first)
    parent = first[of[rest]]
    keys, children = [], []
    while len(rest):
        key = parent * 65 + np.bitwise_count(bits[rest] ^ bits[parent])
        named, head, of_group = np.unique(key, return_index=True, return_inverse=True)
        keys.append(named)
        children.append(rest[head])
        stays = np.ones(len(rest), bool)
        stays[head] = False
        parent, rest = rest[head][of_group[stays]], rest[stays]
    key = np.concatenate(keys) if keys else np.zeros(0, np.int64)
    child = np.concatenate(children) if children else np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    return names, first, key[order], child[order]


def probe(forest, shard: np.ndarray, query: np.ndarray, bits: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query number, entry) of everything within the radius, in blocks; follows only the edges within the radius."""
    names, roots, keys, children = forest
    tree = np.searchsorted(names, shard)
    known = (tree < len(names)) & (names[np.minimum(tree, len(names) - 1)] == shard)
    queries = np.flatnonzero(known)
    tree = tree[queries]
    cost = _tree_sizes(roots, keys, children, len(bits))[tree]
    block = (np.cumsum(cost) - cost) // VISITS
    for number in np.unique(block):
        chosen = block == number
        who, node = queries[chosen], roots[tree[chosen]]
        while len(who):
            far = np.bitwise_count(query[who] ^ bits[node]).astype(np.int64)
            near = far <= radius
            if near.any():
                yield who[near], node[near]
            low = np.searchsorted(keys, node * 65 + np.maximum(far - radius, 0), side="left")
            high = np.searchsorted(keys, node * 65 + np.minimum(far + radius, 64), side="right")
            edge = ranges(low, high - low)
            who, node = np.repeat(who, high - low), children[edge]


def _tree_sizes(roots: np.ndarray, keys: np.ndarray, children: np.ndarray, n: int) -> np.ndarray:
    """Entries of each root's tree."""
    root = np.arange(n)
    root[children] = keys // 65
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return np.bincount(root, minlength=n)[roots]
        root = up


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 1 blocks that make up 64 bits."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def near_links(entries: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints ``bits`` within the radius."""
    spark = entries.sparkSession
    count = entries.count()
    bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count * (radius + 1) * 2 // TREE_ENTRIES))
    shard = F.explode(F.array(*[
        F.lit(i).cast("long") * F.lit(1 << 32) + F.shiftrightunsigned("bits", shift).bitwiseAND(F.lit((1 << width) - 1))
        for i, (shift, width) in enumerate(_blocks(radius))])).alias("shard")
    members = entries.select("bits", shard).withColumn("bin", F.pmod(F.xxhash64("shard"), F.lit(bins)))
    parts = members.groupBy("bin").agg(F.ceil(F.count("*") / TREE_ENTRIES).alias("parts"))
    members = members.join(parts, "bin").select("bin", F.pmod(F.xxhash64("bits"), "parts").alias("part"), "shard", "bits")

    def build(table: pa.Table) -> pa.Table:
        bits = table["bits"].to_numpy().view(np.uint64)
        shards = table["shard"].to_numpy()
        order = np.lexsort((bits, shards))
        bits, shards = bits[order], shards[order]
        names, roots, keys, children = build_forest(shards, bits)
        blobs = [x.tobytes() for x in (bits, shards, names, roots, keys, children)]
        return pa.table({"bin": table["bin"][:1], "part": table["part"][:1], **{n: pa.array([b], pa.binary()) for n, b in zip(FIELDS, blobs)}})

    trees = members.groupBy("bin", "part").applyInArrow(build, "bin long, part long, " + ", ".join(f"{f} binary" for f in FIELDS))
    trees = stage(trees, "bk-trees")
    probes = trees.select(F.col("bin"), F.col("part").alias("probe_part"), F.col("bits").alias("probe_bits"), F.col("shards").alias("probe_shards"))
    size = trees.agg(F.sum(sum(F.length(f) for f in FIELDS))).first()[0] or 0
    shipped = F.broadcast(trees) if size <= BROADCAST_BYTES else trees.hint("shuffle_merge")
    joined = probes.join(shipped, "bin").where("probe_part >= part").drop("bin", "part", "probe_part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)
                query, query_shards = get("probe_bits", np.uint64), get("probe_shards", np.int64)
                bits = get("bits", np.uint64)
                forest = tuple(get(f, np.int64) for f in FIELDS[2:])
                every, at = np.unique(np.concatenate([query, bits]), return_inverse=True)
                roots = np.arange(len(every))
                for who, node in probe(forest, query_shards, query, bits, radius):
                    roots = local_roots(len(every), at[who], at[len(query) + node], roots)
                tied = np.flatnonzero(roots != np.arange(len(every)))
                yield pa.RecordBatch.from_arrays([pa.array(every[x].view(np.int64)) for x in (tied, roots[tied])], ["a", "b"])

    return joined.mapInArrow(search, "a long, b long")


FIELDS = ("bits", "shards", "names", "roots", "keys", "children")


def near_duplicates(documents: DataFrame, radius: int = RADIUS, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id: smallest doc_id reachable by links, itself included)."""
    prints = stage(fingerprints(documents, words), "fingerprints")
    entries = stage(prints.where("doc_id IS NOT NULL").groupBy("bits").agg(F.min("doc_id").alias("first_id")), "entries")
    roots = components(near_links(entries.select("bits"), radius))
    linked = stage(entries.join(roots, F.col("bits") == F.col("node"), "left")
                   .select("bits", "first_id", F.coalesce("root", "bits").alias("root")), "linked")
    smallest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    groups = linked.join(smallest, "root").select("bits", "component_id")
    return prints.join(groups, "bits", "left").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
