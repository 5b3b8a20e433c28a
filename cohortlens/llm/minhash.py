"""Near-duplicate documents: universal hash minima with banding, verification, and connected components.

A document's set holds its distinct shingles of `width` words (A-Z lower-cased, split at ASCII white space); a text of fewer words
is one shingle, a text without words has an empty set and is linked with nothing. Two documents are linked if the
intersection of their sets is at least `percent` hundredths of the union.

1. Each set gives a digest, and `hashes` minima of universal hash functions (a * x + b, the upper half), of which each band of
   `rows` gives a key. Documents of equal digests are one class, represented by the smallest id: copies don't go further.
2. Representatives that share a band key are candidates. Each is paired with the smallest of its bucket: links in
   number of the documents, not of their pairs.
3. Pairs are confirmed on full sets, and confirmed links give components.
4. Buckets that still hold more than one component are compared block by block, by minima first and then by the sets with shingles
   cut to 32 bits. Only pairs of different components count, and a link found joins two for the rest of the block, so a block hands on
   links in number of its documents; these are confirmed like the others. So no pair that shares a bucket is left open.

With 32 bands of 4, a pair at 0.8 misses all buckets with probability 5e-8. Step 4 asks for an estimate from the minima of at least the
threshold less MARGIN, which a pair at 0.8 misses with less than 1e-9, and allows for as many chance matches among the cut shingles as their
numbers make likely, so a pair near the threshold never hides another one.

A null text is empty. A document without an id is never linked: its component is null and it is kept. Rows that share an id
count as one document with all their texts; each gives a row. Column names other than id and text are of no importance.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import columns_of, hashed_words, map_rows, maybe, roll, stage, texts_of
from .components import connected


@dataclass(frozen=True)
class Rules:
    width: int = 5
    percent: int = 80
    bands: int = 32
    rows: int = 4
    #: Representatives of a block in step 4, and shingles, about.
    block: int = 2048
    block_shingles: int = 1 << 20

    @property
    def hashes(self) -> int:
        return self.bands * self.rows


#: How far below the threshold the estimate from the minima may lie in step 4: seven standard deviations.
MARGIN = 0.25

#: What the contract of op1 asks for.
FOUR_WORDS = Rules(width=4)


def shingles(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    return np.unique(roll(hashed_words([data])[0], width))


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_117)
    return rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, np.uint64)


def minima(own: np.ndarray, rules: Rules) -> np.ndarray:
    """32-bit minima of a set; own: not empty."""
    a, b = _functions(rules.hashes)
    low = np.full(rules.hashes, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(own), 1024):
        part = own[start : start + 1024]
        low = np.minimum(low, (a[:, None] * part + b[:, None]).min(axis=1))
    return (low >> np.uint64(32)).astype("<u4")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sets (sorted, distinct) are linked."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def signatures(docs: DataFrame, rules: Rules) -> DataFrame:
    """(doc_id, n_shingles, digest, bands): digest and bands are null for empty sets. docs: doc_id, text."""
    size = 4 * rules.rows

    def run(batches):
        for batch in batches:
            n, digests, keys = [], [], []
            words, ends = hashed_words(texts_of(batch))
            for own in np.split(words, ends[:-1]):
                own = np.unique(roll(own, rules.width))
                n.append(len(own))
                if not len(own):
                    digests.append(None)
                    keys.append(None)
                    continue
                low = minima(own, rules).tobytes()
                digests.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                keys.append([xxhash.xxh3_64_intdigest(low[i * size : i * size + size], i) - (1 << 63) for i in range(rules.bands)])
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "digest", "bands"])

    return map_rows(docs, run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def _texts_of_nodes(nodes: DataFrame, docs: DataFrame) -> DataFrame:
    ids = stage(nodes.select(nodes[nodes.columns[0]].alias("id")).distinct(), "nodes")
    return maybe(docs, "doc_id", ids).where("maybe").drop("maybe").join(ids, F.col("doc_id") == F.col("id"), "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, rules: Rules) -> DataFrame:
    """Links (u, v) among pairs (u, v) of document ids, checked on the full sets of their texts.

    Only texts of documents in pairs are moved: once to gather them, then from that copy to their pairs.
    """
    texts = stage(_texts_of_nodes(pairs.select(F.explode(F.array("u", "v")).alias("id")), docs), "paired-texts")
    of = lambda node: texts.select(F.col("doc_id").alias(node), F.col("text").alias(f"text_{node}"))
    rows = pairs.join(of("v"), "v").join(of("u"), "u")

    def run(batches):
        sets: OrderedDict[bytes, np.ndarray] = OrderedDict()

        def set_of(data: bytes) -> np.ndarray:
            key = hashlib.blake2b(data, digest_size=16).digest()
            if key not in sets:
                if len(sets) >= 64:
                    sets.popitem(last=False)
                sets[key] = shingles(data, rules.width)
            return sets[key]

        for batch in batches:
            left, right = texts_of(batch, "text_u"), texts_of(batch, "text_v")
            ok = [similar(set_of(a), set_of(b), rules.percent) for a, b in zip(left, right, strict=True)]
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return map_rows(rows.select("u", "v", "text_u", "text_v"), run, "u long, v long")


def _sketches(nodes: DataFrame, docs: DataFrame, rules: Rules) -> DataFrame:
    """(node, size, minima, cut): what step 4 compares. An id with several texts has several rows."""

    def run(batches):
        for batch in batches:
            sets = [shingles(data, rules.width) for data in texts_of(batch)]
            some = [i for i, own in enumerate(sets) if len(own)]
            sets = [sets[i] for i in some]
            cols = [
                batch.column("doc_id").take(pa.array(some, pa.int64())),
                pa.array([len(x) for x in sets], pa.int64()),
                pa.array([minima(x, rules).tobytes() for x in sets], pa.binary()),
                pa.array([np.unique((x >> np.uint64(32)).astype("<u4")).tobytes() for x in sets], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["node", "size", "minima", "cut"])

    return map_rows(_texts_of_nodes(nodes, docs), run, "node long, size long, minima binary, cut binary")


def _compare_block(table: pa.Table, rules: Rules) -> tuple[list[int], list[int]]:
    """Links (u, v) between different components in a pair of blocks: those that join them, and those that may not hold.

    Sets are compared by 32 bits of a hash. By chance some x * y / 2^32 values of sets of x and y match, or fall together inside
    a set, so an intersection is known up to `slack`. A pair that could be a link is handed on; its components count as one,
    and pairs between them are left out from there on, only where it is a link in any case.
    """
    part, node, comp, size = (table[c].to_numpy() for c in ("own", "node", "component", "size"))
    low = np.frombuffer(b"".join(table["minima"].to_pylist()), "<u4").reshape(len(part), -1)
    cut = [np.frombuffer(x, "<u4") for x in table["cut"].to_pylist()]
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    left, right = np.flatnonzero(part == i), np.flatnonzero(part == j)
    close = (rules.percent / 100 - MARGIN) * rules.hashes
    names, comp = np.unique(comp, return_inverse=True)
    home = np.arange(len(names))  # component -> the one it has been joined to
    us, vs = [], []
    for x in left.tolist():
        ys = right[home[comp[right]] != home[comp[x]]]
        if i == j:
            ys = ys[ys > x]
        ys = ys[(100 * np.minimum(size[ys], size[x]) >= rules.percent * np.maximum(size[ys], size[x])) & ((low[ys] == low[x]).sum(axis=1) >= close)]
        for y in ys.tolist():
            a, b = home[comp[x]], home[comp[y]]
            if a == b:
                continue
            both = len(np.intersect1d(cut[x], cut[y], assume_unique=True))
            total = int(size[x] + size[y])
            chance = float(size[x]) * float(size[y]) / 2**32
            slack = 2 + int(chance + 6 * chance**0.5)
            if 100 * (both + slack) >= rules.percent * (total - both - slack):
                us.append(max(int(node[x]), int(node[y])))
                vs.append(min(int(node[x]), int(node[y])))
                if 100 * (both - slack) >= rules.percent * (total - both + slack):
                    home[home == a] = b
    return us, vs


def _open_links(buckets: DataFrame, docs: DataFrame, rules: Rules) -> DataFrame:
    """Candidate links (u, v) of different components that share a bucket. buckets: key, node, component, n_shingles."""
    mixed = buckets.groupBy("key").agg(
        F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")
    )
    blocks = F.ceil(F.greatest(F.col("n") / rules.block, F.col("shingles") / rules.block_shingles))
    mixed = mixed.where("a < b").select("key", blocks.alias("blocks"))
    rows = stage(buckets.join(mixed, "key").select("key", "node", "component", "blocks"), "mixed-buckets")
    sketches = stage(_sketches(rows.select("node"), docs, rules), "sketches")
    # A bucket of many blocks is spread over pairs of blocks, each of bounded size.
    spread = rows.withColumn("own", F.pmod(F.xxhash64("node"), "blocks")).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    )
    spread = spread.select("key", "node", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def compare(_, table):
        us, vs = _compare_block(table, rules)
        return pa.table({"u": pa.array(us, pa.int64()), "v": pa.array(vs, pa.int64())})

    found = spread.join(sketches, "node").groupBy("key", "i", "j").applyInArrow(compare, "u long, v long")
    return found.where("u <> v").distinct()


def _shared_ids(named: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (u, v) between the nodes of different texts under one id: such rows are one document. named: doc_id, digest."""
    several = named.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a < b").select("doc_id")
    texts = named.select("doc_id", "digest").join(stage(several, "ids-of-several-texts"), "doc_id", "left_semi").distinct()
    nodes = texts.join(classes, "digest").select("doc_id", "node").distinct()
    hubs = nodes.groupBy("doc_id").agg(F.min("node").alias("v"))
    return nodes.join(hubs, "doc_id").where("node <> v").select(F.col("node").alias("u"), "v").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per input row; kept where doc_id is the smallest of its component."""
    docs = columns_of(docs, id_col, text_col)
    signed = stage(signatures(docs, rules), "signatures")
    named = signed.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    classes = named.groupBy("digest").agg(F.min("doc_id").alias("node"))
    nodes = stage(named.join(classes, "digest").where("doc_id = node").select("node", "n_shingles", "bands"), "nodes")
    keyed = nodes.select(F.explode("bands").alias("key"), "node", "n_shingles")
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub")
    buckets = stage(keyed.join(hubs, "key"), "buckets")
    pairs = stage(buckets.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")).distinct(), "pairs")
    links = stage(confirmed(pairs, docs, rules), "links")
    labelled = buckets.drop("hub").join(connected(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = stage(confirmed(stage(_open_links(stage(labelled, "labelled"), docs, rules), "open-links"), docs, rules), "links")
    stars = connected(links.union(found).union(_shared_ids(named, classes)))
    member = classes.join(stars, "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    # Documents without a shingle, however many, don't take part in the join.
    rows = signed.where("digest IS NOT NULL").select("doc_id", "n_shingles", "digest").join(stage(member, "members"), "digest", "left")
    rows = rows.select("doc_id", "n_shingles", "component")
    rows = rows.union(signed.where("digest IS NULL").select("doc_id", "n_shingles", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return rows.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
