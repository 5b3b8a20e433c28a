"""Ranked lexical search by the Best Position Algorithm over impact lists, in shards of documents.

Terms are runs of ASCII letters, digits and non-ASCII characters, with A-Z in lower case. A term's weight w is floor(1000 * ln((2N+2) / (2df+1)));
a document of n terms has m = 25 + (75 * n * N) div L; its score sums w * ((10^9 * tf) div (1000 * tf + 8 * m)) over the item's terms,
repeats included. N documents have a term, L terms in all, df of them hold the term. A product of one term, document and repeat is its impact.

1. Items are dealt into blocks by a hash, as many as their text needs, and each block's terms are sent to the tasks: a block, not the benchmark,
   bounds what is broadcast. A stated set of items against all documents, block by block.
2. One pass over the texts of a block cuts the documents into shards and writes, for each shard, the postings of the block's terms: which document,
   how often. N, L and df are sums over shards.
3. A task reads a shard, turns its postings into impact lists (descending impact) and answers each item by the Best Position Algorithm: sorted
   accesses go down all lists of the item alike; each document met is looked up in the other lists (direct accesses), which gives its score
   and its positions there. The best position of a list is the end of the run of positions from the top that were all seen, by
   either access. No unseen document can score more than the sum of impacts at the best positions, so the item is done in this shard
   when that sum is strictly below its kth score, or when all lists are seen.
4. The shards' best are merged in two steps, first within groups of shards, so that no task sees all of an item's candidates.

Defined results: an item is an item_id, the terms of all its rows taken together; items without an id, without terms or without a hit give no row.
Documents without an id are left out, also of the counts. Rows that share an id are documents of their own. Null and empty texts
have no terms. Equal scores rank by the smaller doc_id. Terms whose weight is 0 score 0 and give no hit.
Columns other than ids and texts are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import columns_of, map_rows, stage, texts_of

TOP = 10
#: Bytes of item texts in a block of items (about): its distinct terms are what is broadcast.
BLOCK_BYTES = 1 << 22
#: A shard ends when it has so many documents or postings.
SHARD_DOCS, SHARD_POSTINGS = 1 << 15, 1 << 21
#: Positions read in each list before the first test of the threshold; doubled each time.
FIRST_STEP = 32
#: Groups of shards whose results are merged first.
MERGE_GROUPS = 1024

#: ASCII bytes that are no letters or digits become spaces, A-Z become a-z.
_TERMS = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()
_SHARD = "shard long, docs binary, lengths binary, terms binary, df binary, doc_at binary, tf binary, n_docs long, n_terms long"
_FOUND = "item_id long, doc_id long, score long, merge int"


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_TERMS).split()


def _ints(data: bytes, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(data, kind)


class _Shard:
    """Postings of the documents of a shard while they are gathered."""

    def __init__(self):
        self.docs, self.lengths, self.terms, self.at, self.tf = [], [], [], [], []

    def add(self, doc_id: int, n: int, codes: list[int], tf: list[int]) -> None:
        self.terms += codes
        self.tf += tf
        self.at += [len(self.docs)] * len(codes)
        self.docs.append(doc_id)
        self.lengths.append(n)

    def full(self) -> bool:
        return len(self.docs) >= SHARD_DOCS or len(self.terms) >= SHARD_POSTINGS

    def batch(self, number: int) -> pa.RecordBatch:
        """Postings in order of terms, documents ascending within a term."""
        codes = np.array(self.terms, np.int64)
        order = np.argsort(codes, kind="stable")
        terms, df = np.unique(codes, return_counts=True)
        row = [
            number,
            np.array(self.docs, "<i8").tobytes(),
            np.array(self.lengths, "<i8").tobytes(),
            terms.astype("<i8").tobytes(),
            df.astype("<i8").tobytes(),
            np.array(self.at, "<i4")[order].tobytes(),
            np.array(self.tf, "<i8")[order].tobytes(),
            len(self.docs),
            sum(self.lengths),
        ]
        return pa.RecordBatch.from_pylist([dict(zip([x.split()[0] for x in _SHARD.split(", ")], row))], schema=_SHARD_ARROW)


_SHARD_ARROW = pa.schema(
    [(n, pa.binary() if kind == "binary" else pa.int64()) for n, kind in (x.split() for x in _SHARD.split(", "))]
)


def write_shards(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """One row a shard. Documents without any term are in no shard; those without a term of the vocabulary count by their length."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def gather(batches):
        from pyspark import TaskContext

        code = shared.value
        number, shard = TaskContext.get().partitionId() << 32, _Shard()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                found = terms_of(text)
                if not found:
                    continue
                count = Counter(found)
                own = [(code[t], count[t]) for t in code.keys() & count.keys()] if len(count) > len(code) else [(code[t], c) for t, c in count.items() if t in code]
                shard.add(doc_id, len(found), [c for c, _ in own], [c for _, c in own])
                if shard.full():
                    yield shard.batch(number)
                    number, shard = number + 1, _Shard()
        if shard.docs:
            yield shard.batch(number)

    return stage(map_rows(docs.where("doc_id IS NOT NULL"), gather, _SHARD), "search-shards")


def statistics(shards: DataFrame) -> tuple[int, int, dict[int, int]]:
    """N, L and the document frequency of each term of the vocabulary."""
    totals = shards.agg(F.sum("n_docs").alias("n"), F.sum(F.col("n_terms").cast("decimal(38,0)")).alias("l")).first()

    def spread(batches):
        for batch in batches:
            of: Counter = Counter()
            for terms, df in zip(batch.column("terms").to_pylist(), batch.column("df").to_pylist()):
                of.update(dict(zip(_ints(terms).tolist(), _ints(df).tolist())))
            yield pa.RecordBatch.from_arrays([pa.array(list(of), pa.int64()), pa.array(list(of.values()), pa.int64())], ["term", "df"])

    df = map_rows(shards.select("terms", "df"), spread, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    return totals["n"] or 0, int(totals["l"] or 0), dict(zip(df["term"].to_pylist(), df["df"].to_pylist()))


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class ImpactList:
    """One term's postings in a shard: in order of documents for direct accesses, in order of impacts for sorted ones."""

    def __init__(self, docs: np.ndarray, impacts: np.ndarray):
        self.docs, self.impacts = docs, impacts
        self.order = np.argsort(-impacts, kind="stable")
        self.position = np.empty(len(docs), np.int64)
        self.position[self.order] = np.arange(len(docs))

    def direct(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted documents are in the list, and where in document order."""
        at = np.searchsorted(self.docs, wanted)
        at[at == len(self.docs)] = 0
        hit = np.flatnonzero(self.docs[at] == wanted)
        return hit, at[hit]


def best_positions(lists: list[tuple[ImpactList, int]], n_docs: int, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The k best documents of a shard for an item given as (list, repeats) pairs.

    Returns documents (numbers within the shard), their scores, and the depth of sorted access that was needed.
    """
    met = np.zeros(n_docs, bool)
    seen = [np.zeros(len(x.docs), bool) for x, _ in lists]
    best = [0] * len(lists)  # positions from the top that were all seen
    docs, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    depth, step, longest = 0, FIRST_STEP, max((len(x.docs) for x, _ in lists), default=0)
    while depth < longest:
        # Sorted accesses, equally deep in all lists.
        fresh = np.unique(np.concatenate([x.docs[x.order[depth : depth + step]] for x, _ in lists]))
        depth, step = depth + step, 2 * step
        fresh = fresh[~met[fresh]]
        met[fresh] = True
        # Direct accesses: scores and positions of the new documents in all lists.
        total = np.zeros(len(fresh), np.int64)
        bound = 0
        for i, (x, repeats) in enumerate(lists):
            if len(fresh):
                hit, at = x.direct(fresh)
                total[hit] += repeats * x.impacts[at]
                seen[i][x.position[at]] = True
            run = seen[i][best[i] :]
            gap = int(run.argmin()) if len(run) else 0
            best[i] += gap if len(run) and not run[gap] else len(run)
            if best[i] < len(x.docs):
                # Every position down to `depth` was read, so there is one at least.
                bound += repeats * int(x.impacts[x.order[best[i] - 1]])
        docs, scores = np.concatenate([docs, fresh]), np.concatenate([scores, total])
        top = np.lexsort((ids[docs], -scores))[:k]
        docs, scores = docs[top], scores[top]
        if len(docs) == k and bound < scores[-1]:
            break
    some = scores > 0
    return docs[some], scores[some], depth


def answer(row: dict, items: list[tuple[int, dict[int, int]]], n_docs: int, n_terms: int, weights: dict[int, int], k: int):
    """(item_id, doc_id, score) of the best of one shard, for each item."""
    ids, lengths = _ints(row["docs"]), _ints(row["lengths"]).tolist()
    # Python integers: the product of lengths and counts can leave 64 bits.
    m = np.array([25 + 75 * n * n_docs // n_terms for n in lengths], np.int64)
    terms, df = _ints(row["terms"]), _ints(row["df"])
    ends = np.cumsum(df)
    where = {t: (e - c, e) for t, c, e in zip(terms.tolist(), df.tolist(), ends.tolist()) if weights[t] > 0}
    doc_at, tf = _ints(row["doc_at"], "<i4").astype(np.int64), _ints(row["tf"])
    made: dict[int, ImpactList] = {}

    def list_of(term: int) -> ImpactList:
        if term not in made:
            a, b = where[term]
            made[term] = ImpactList(doc_at[a:b], weights[term] * ((1_000_000_000 * tf[a:b]) // (1000 * tf[a:b] + 8 * m[doc_at[a:b]])))
        return made[term]

    for item_id, own in items:
        lists = [(list_of(t), repeats) for t, repeats in own.items() if t in where]
        if lists:
            docs, scores, _ = best_positions(lists, len(ids), ids, k)
            yield from zip([item_id] * len(docs), ids[docs].tolist(), scores.tolist())


def _search_block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    """Best of each group of shards for the items of one block."""
    spark = docs.sparkSession
    own: dict[int, Counter] = {}
    for r in block.toLocalIterator():
        own.setdefault(r["item_id"], Counter()).update(terms_of((r["text"] or "").encode()))
    code = {t: i for i, t in enumerate(sorted({t for c in own.values() for t in c}))}
    items = [(i, {code[t]: n for t, n in c.items()}) for i, c in sorted(own.items()) if c]
    shards = write_shards(docs, code)
    n_docs, n_terms, df = statistics(shards)
    weights = {t: weight(n_docs, n) for t, n in df.items()}
    shared = spark.sparkContext.broadcast((items, weights))

    def run(batches):
        items, weights = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                found = list(answer(row, items, n_docs, n_terms, weights, k))
                merge = row["shard"] % 1_000_003 % MERGE_GROUPS
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([x[j] for x in found], pa.int64()) for j in range(3)), pa.array([merge] * len(found), pa.int32())],
                    ["item_id", "doc_id", "score", "merge"],
                )

    return _best(map_rows(shards, run, _FOUND), k, "item_id", "merge").drop("rank")


def _best(rows: DataFrame, k: int, *groups: str) -> DataFrame:
    """The k best rows of each group: a ranked window, which Spark limits before the shuffle, too."""
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = TOP,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item with a score above 0."""
    texts = columns_of(docs, id_col, text_col)
    queries = items.select(items[item_col].cast("long").alias("item_id"), items[item_text_col].cast("string").alias("text")).where("item_id IS NOT NULL")
    size = queries.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    # Rows of one item fall into one block.
    n_blocks = 1 + size // BLOCK_BYTES
    found = None
    for b in range(n_blocks):
        part = stage(_search_block(texts, queries.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b), k), "search-best")
        found = part if found is None else found.unionByName(part)
    return _best(found, k, "item_id").select("item_id", "rank", "doc_id", "score")
