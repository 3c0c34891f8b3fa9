"""Similarity join on word-shingle sets by multiple-global-order filtering.

Sets link when their Jaccard similarity is at least percent/100 (whole numbers on both sides).
Under any total order of the tokens, two sets that link share a token among the first
p = n - ceil(t n) + 1 of each. Several orders are used, all with the tokens of a single document first:
by document frequency (which keeps common passages out of the prefixes), and two by keyed hash.
A pair is verified only if the prefixes meet under every order.

1. Documents with equal sets form a class (128-bit digest of the set). One pass.
2. An inverted index in packed form: each batch of documents sends its tokens, sorted, delta-coded
   and cut by hash range, to 2^b buckets; a bucket counts how many hold each token and returns those
   of two or more to their batch. Only these can be shared, so what a class gets back is all that
   verification needs. A class with p or more tokens of its own can't link and ends here.
   Very frequent tokens are found in the first pass (each ``BATCH_TOKENS`` tokens report those that
   ``OFTEN`` sets or more hold) and never leave their batch, so a passage in a third of all texts meets in no
   task. There are at most ``HOT_TOKENS`` of them, as each makes up that share of all tokens.
3. Classes that meet in the frequency prefix form candidate clusters (connected components).
   Each cluster is joined exactly in one task by all three prefix indexes; a cluster over
   ``cluster_tokens``, or over a sixteenth of all, is cut into blocks, so no task holds an unbounded group
   or most of the work: each block is joined with itself and the first, then all sets outside of the largest component with all blocks. A task gives a
   spanning forest of the links it found, as components need no more: pairs already connected aren't
   verified again.
4. Components over the links, then the least doc_id of each.

Nothing is capped: a common token only counts as a late one in the order. Null and wordless texts have
empty sets and link with nothing, not with each other. Verification compares the shingles' hashes
(54 to 64 bits, see ``_pack``), not their words. Repeated rows and repeated doc_ids are each
reported; a component's id is its least doc_id. Rows without doc_id take part but name no component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.common import free_name, free_shuffles, ident, saved, tidy
from vectide.llm.graph import components
from vectide.llm.shingles import mix64, set_digest, shingle_sets

BATCH_TOKENS = 1_000_000
BATCH_CLASSES = 60_000
BUCKET_TOKENS = 1_000_000
CLUSTER_TOKENS = 2_000_000
#: Clusters are dealt over so many tasks at least; one above a task's share, and above SHARE_TOKENS, is cut like one above CLUSTER_TOKENS.
BINS = 16
SHARE_TOKENS = 50_000
#: A token that so many sets of one batch hold is reported; from so many in all, and that share of all tokens, it is a frequent one.
OFTEN = 32
HOT_POSTINGS = 4096
HOT_TOKENS = 100_000
#: Seeds of the hash orders.
ORDERS = (11, 23)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (-(-percent * n // 100)) + 1


def _planes(sorted_values: np.ndarray) -> bytes:
    """48-bit values in ascending order as differences, byte by byte, so that the high bytes compress."""
    return np.diff(sorted_values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def _values(planes: bytes) -> np.ndarray:
    wide = np.zeros((len(planes) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(planes, np.uint8).reshape(6, -1).T
    return np.cumsum(wide.view(np.uint64).ravel(), dtype=np.uint64)


def _rank(held: np.ndarray) -> np.ndarray:
    return np.minimum(255, 8 * np.log2(held)).astype(np.uint8)


class _Tally:
    """Tokens that many of the sets added since the last report hold; equal sets count once."""

    def __init__(self, often: int):
        self.often, self.seen, self.sets, self.held = often, set(), [], 0

    def add(self, cls: bytes, tokens: np.ndarray) -> None:
        if cls not in self.seen:
            self.seen.add(cls)
            self.sets.append(tokens)
            self.held += len(tokens)

    def report(self) -> list[tuple[int, int]] | None:
        flat = np.concatenate(self.sets) if self.sets else np.empty(0, np.uint64)
        self.seen.clear()
        self.sets.clear()
        self.held = 0
        flat.sort()
        before = flat[: max(0, len(flat) - self.often + 1)]
        token = np.unique(before[before == flat[self.often - 1 :]])
        held = np.searchsorted(flat, token, "right") - np.searchsorted(flat, token, "left")
        return list(zip(token.view(np.int64).tolist(), held.tolist(), strict=True)) or None


_OFTEN = pa.list_(pa.struct([("token", pa.int64()), ("held", pa.int64())]))


def set_sizes(docs: DataFrame, words: int) -> DataFrame:
    """docs: text and other columns. Returns the others, n (set size), cls (digest; null for an empty set), and often: in one
    row for each BATCH_TOKENS tokens, those that many of these sets hold, and how many do."""
    kept = [c for c in docs.columns if c != "text"]
    kinds = ", ".join(f"{c} {k}" for c, k in docs.dtypes if c != "text")
    often = OFTEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = _Tally(often)
        last = None  # held back, as its last row takes the last report

        def batch() -> pa.RecordBatch:
            others, n, cls, found = last
            return pa.RecordBatch.from_arrays([*others, pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(found, _OFTEN)], [*kept, "n", "cls", "often"])

        for b in batches:
            if not b.num_rows:
                continue
            if last:
                yield batch()
            n, cls, found = [], [], []
            for s in shingle_sets(b.column("text"), words):
                n.append(len(s))
                cls.append(set_digest(s) if len(s) else None)
                if len(s):
                    tally.add(cls[-1], s)
                found.append(tally.report() if tally.held >= BATCH_TOKENS else None)
            last = [b.column(c) for c in kept], n, cls, found
        if last:
            if tally.held:
                last[3][-1] = tally.report()
            yield batch()
        tidy()

    return docs.mapInArrow(run, f"{kinds}, n long, cls binary, often array<struct<token: long, held: long>>")


def frequent(sizes: DataFrame, total: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent tokens in the form that buckets and batches use, ascending, and their ranks: HOT_TOKENS at most, as they make up 1 / HOT_TOKENS of total each."""
    held = sizes.filter("often is not null").select(F.explode("often").alias("x")).groupBy("x.token").agg(F.sum("x.held").alias("held"))
    rows = held.filter(F.col("held") >= max(HOT_POSTINGS, math.ceil(total / HOT_TOKENS))).toArrow()
    token = rows.column("token").to_numpy().astype(np.int64).view(np.uint64) >> np.uint64(16 - bits)
    order = np.argsort(token, kind="stable")
    token, first = np.unique(token[order], return_index=True)
    count = rows.column("held").to_numpy().astype(np.int64)[order]
    return token, _rank(np.maximum.reduceat(count, first)) if len(first) else np.empty(0, np.uint8)


_PACKED = pa.schema([("key", pa.int64()), ("batch", pa.int64()), ("tokens", pa.binary()), ("owner", pa.binary()), ("rank", pa.binary())])
_PACKED_DDL = "key long, batch long, tokens binary, owner binary, rank binary"


def _pack(docs: DataFrame, words: int, bits: int, hot: np.ndarray) -> DataFrame:
    """Each batch's tokens by bucket (key >= 0), and its classes with their set sizes (key < 0); in a row beside those its frequent tokens, by their places in hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[bytes, int] = {}
        sets: list[np.ndarray] = []
        held = made = 0
        part = TaskContext.get().partitionId()

        def flush() -> pa.RecordBatch:
            batch = (part << 24) + made
            sizes = np.array([len(s) for s in sets], np.int64)
            tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.uint16), sizes)
            sets.clear()
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order]
            del order
            tokens >>= np.uint64(16 - bits)
            rows = [(-1 - batch, batch, b"".join(classes), sizes.tobytes(), None)]
            if len(hot):
                at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
                often = hot[at] == tokens
                rows += [(-1 - batch, batch, at[often].astype(np.uint32).tobytes(), owner[often].tobytes(), b"")]
                tokens, owner = tokens[~often], owner[~often]
                del at, often
            bucket, low = (tokens >> np.uint64(48)).astype(np.int64), tokens & np.uint64((1 << 48) - 1)
            del tokens
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            rows += [(int(bucket[a]), batch, _planes(low[a:z]), owner[a:z].tobytes(), None) for a, z in zip(cuts[:-1], cuts[1:], strict=True) if z > a]
            classes.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), _PACKED, strict=True)], schema=_PACKED)

        for b in batches:
            for s in shingle_sets(b.column("text"), words):
                if not len(s) or (cls := set_digest(s)) in classes:
                    continue
                classes[cls] = len(sets)
                sets.append(s)
                held += len(s)
                if held >= BATCH_TOKENS or len(sets) >= BATCH_CLASSES:
                    yield flush()
                    held, made = 0, made + 1
        if sets:
            yield flush()
        tidy()

    return docs.select("text").mapInArrow(run, _PACKED_DDL)


def _tidied(run):  # noqa: ANN001, ANN202
    def wrapped(group: pa.Table) -> pa.Table:
        out = run(group)
        del group
        tidy()
        return out

    return wrapped


def _count(group: pa.Table) -> pa.Table:
    """Of one bucket: the tokens that two or more sets hold, with a rank by frequency, as a row for each batch."""
    if group.column("key")[0].as_py() < 0:
        return group
    rows = group.to_pylist()
    rows.sort(key=lambda r: r["batch"])
    per = [_values(r["tokens"]) for r in rows]
    tokens = np.concatenate(per)
    source = np.repeat(np.arange(len(rows)), [len(x) for x in per])
    owner = np.concatenate([np.frombuffer(r["owner"], np.uint16) for r in rows])
    order = np.argsort(tokens, kind="stable")
    tokens, source, owner = tokens[order], source[order], owner[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(tokens)) + 1, [len(tokens)]])
    held = np.diff(cuts)
    rank = np.repeat(_rank(held), held)
    keep = np.repeat(held > 1, held)
    tokens, source, owner, rank = tokens[keep], source[keep], owner[keep], rank[keep]
    order = np.argsort(source, kind="stable")
    tokens, owner, rank = tokens[order], owner[order], rank[order]
    cuts = np.searchsorted(source[order], np.arange(len(rows) + 1))
    out = [(r["key"], r["batch"], _planes(tokens[a:z]), owner[a:z].tobytes(), rank[a:z].tobytes()) for r, a, z in zip(rows, cuts[:-1], cuts[1:], strict=True) if z > a]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [()] * 5, _PACKED, strict=True)], schema=_PACKED)


_CANDIDATE = pa.schema([("cls", pa.binary()), ("n", pa.int64()), ("prefix", pa.list_(pa.int64())), ("tokens", pa.binary())])


def _gather(percent: int, hot: np.ndarray, hot_rank: np.ndarray):
    def run(group: pa.Table) -> pa.Table:
        """Of one batch: the classes that can link, with their shared tokens and what of the frequency prefix those make up."""
        rows = group.to_pylist()
        names = next(r for r in rows if r["rank"] is None)
        own = [np.frombuffer(r["tokens"], np.uint32) for r in rows if r["key"] < 0 and r is not names]
        frequent_owner = [np.frombuffer(r["owner"], np.uint16) for r in rows if r["key"] < 0 and r is not names]
        rows = [r for r in rows if r["key"] >= 0]
        sizes = np.frombuffer(names["owner"], np.int64)
        if not rows and not sum(map(len, own)):
            return _CANDIDATE.empty_table()
        tokens = np.concatenate([(np.uint64(r["key"]) << np.uint64(48)) | _values(r["tokens"]) for r in rows] + [hot[x] for x in own])
        owner = np.concatenate([np.frombuffer(r["owner"], np.uint16) for r in rows] + frequent_owner).astype(np.int64)
        rank = np.concatenate([np.frombuffer(r["rank"], np.uint8) for r in rows] + [hot_rank[x] for x in own])
        shared = np.bincount(owner, minlength=len(sizes))
        need = prefix_length(sizes, percent) - (sizes - shared)
        order = np.lexsort((tokens, rank, owner))
        tokens, ends = tokens[order], np.cumsum(shared)
        out = []
        for k in np.flatnonzero(need > 0):
            own = tokens[ends[k] - shared[k] : ends[k]]
            out.append((names["tokens"][16 * k : 16 * k + 16], int(sizes[k]), own[: need[k]].astype(np.int64), np.sort(own).tobytes()))
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True) if out else [()] * 4, _CANDIDATE, strict=True)], schema=_CANDIDATE)

    return run


class _Cluster:
    """Sets of one candidate cluster, indexed by their prefixes under each order."""

    def __init__(self, names: list[bytes], sizes: list[int], prefix: list[np.ndarray], tokens: list[np.ndarray], percent: int):
        self.names, self.tokens, self.percent = names, tokens, percent
        self.sizes = np.array(sizes, np.int64)
        self.prefixes = [prefix]
        with np.errstate(over="ignore"):
            for seed in ORDERS:
                self.prefixes.append([t[np.argsort(mix64(t + np.uint64(seed)))[: len(p)]] for t, p in zip(tokens, prefix, strict=True)])
        self.indexes = []
        for lists in self.prefixes:
            flat, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            order = np.argsort(flat, kind="stable")
            self.indexes.append((flat[order], owner[order]))

    def meeting(self, k: int) -> np.ndarray:
        """Sets whose prefix meets that of set k under every order and whose size allows a link."""
        n = self.sizes
        keep = (100 * np.minimum(n, n[k]) >= self.percent * np.maximum(n, n[k]))
        for lists, (flat, owner) in zip(self.prefixes, self.indexes, strict=True):
            lo, hi = np.searchsorted(flat, lists[k], "left"), np.searchsorted(flat, lists[k], "right")
            met = np.zeros(len(n), bool)
            for a, z in zip(lo, hi, strict=True):
                met[owner[a:z]] = True
            keep &= met
        return np.flatnonzero(keep)

    def linked(self, k: int, others: np.ndarray) -> np.ndarray:
        own = self.tokens[k]
        size = np.array([len(self.tokens[x]) for x in others])
        flat = np.concatenate([self.tokens[x] for x in others])
        at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
        both = np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size)[:-1]]))
        return others[100 * both >= self.percent * (self.sizes[k] + self.sizes[others] - both)]

    def forest(self, label: np.ndarray, side: np.ndarray | None) -> list[tuple[bytes, bytes]]:
        """Links that connect what all links connect. Sets of one label are connected already; with side, only sets of different sides are compared."""
        label, out = label.copy(), []
        for k in range(len(self.names)):
            if (label == label[0]).all():
                break
            others = self.meeting(k)
            others = others[label[others] != label[k]]
            if side is not None:
                others = others[side[others] != side[k]]
            if not len(others):
                continue
            for x in self.linked(k, others):
                if label[x] != label[k]:
                    out.append((self.names[k], self.names[x]))
                    label[label == label[x]] = label[k]
        return out


def _verify(percent: int):
    def run(group: pa.Table) -> pa.Table:
        rows: dict[bytes, dict[tuple[bytes, int], dict]] = {}
        for r in group.to_pylist():
            rows.setdefault(r["root"], {})[r["cls"], r["side"]] = r
        links = []
        for root in sorted(rows):
            some = [rows[root][c] for c in sorted(rows[root])]
            if len(some) < 2:
                continue
            label = np.unique([r["label"].hex() for r in some], return_inverse=True)[1]
            c = _Cluster([r["cls"] for r in some], [r["n"] for r in some], [np.array(r["prefix"], np.int64).astype(np.uint64) for r in some], [np.frombuffer(r["tokens"], np.uint64) for r in some], percent)
            links += c.forest(label, np.array([r["side"] for r in some]) if some[0]["cross"] else None)
        return pa.table({"a": pa.array([x[0] for x in links], pa.binary()), "b": pa.array([x[1] for x in links], pa.binary())})

    return run


def class_links(docs: DataFrame, sizes: DataFrame, total: int, words: int, percent: int, cluster_tokens: int) -> DataFrame | None:
    """Links (a, b) between classes, enough to connect all that are connected; None if there are no candidates."""
    spark = docs.sparkSession
    bits = min(16, max(6, math.ceil(math.log2(max(1, total) / BUCKET_TOKENS))))
    hot, hot_rank = frequent(sizes, total, bits)
    found = saved(_pack(docs, words, bits, hot).groupBy("key").applyInArrow(_tidied(_count), _PACKED_DDL).groupBy("batch").applyInArrow(_tidied(_gather(percent, hot, hot_rank)), "cls binary, n long, prefix array<long>, tokens binary"))
    free_shuffles(spark)
    postings = found.select("cls", F.explode("prefix").alias("token")).distinct()
    tokens = postings.groupBy("token").agg(F.min("cls").alias("first"), F.max("cls").alias("last")).filter("first <> last")
    edges = saved(postings.join(tokens, "token").filter("cls <> first").select(F.col("cls").alias("a"), F.col("first").alias("b")).distinct())
    free_shuffles(spark)  # what listeners still held at the first call is free by now
    if edges.isEmpty():
        return None
    roots = components(edges)
    member = found.select("cls", (F.octet_length("tokens") / 8).alias("size")).groupBy("cls").agg(F.first("size").alias("size"))
    weight = roots.join(member, F.col("node") == F.col("cls")).groupBy("root").agg(F.sum("size").alias("size"))
    weight = saved(weight)
    free_shuffles(spark)
    size = weight.agg(F.sum("size")).first()[0] or 0
    limit = min(cluster_tokens, max(SHARE_TOKENS, math.ceil(size / BINS)))
    bins = max(BINS, math.ceil(size / limit))
    weight = weight.withColumn("blocks", F.when(F.col("size") <= limit, 1).otherwise(2 * F.ceil(F.col("size") / limit)).cast("int"))
    where = roots.join(weight, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # A cluster of one block shares a task with others of its bin. Of a larger one, each block is joined with itself
    # and with the first block; what that leaves unconnected is joined with all blocks below.
    alone, first = F.struct(F.col("block").alias("i"), F.col("block").alias("j")), F.struct(F.lit(0).alias("i"), F.col("block").alias("j"))
    all_first = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.lit(0).alias("i"), x.alias("j")))
    pair = F.when(F.col("block") == 0, all_first).otherwise(F.array(alone, first))
    own = F.when(F.col("blocks") > 1, F.concat(F.lit("c"), F.hex("root"))).otherwise(F.concat(F.lit("b"), F.pmod(F.xxhash64("root"), F.lit(bins)).cast("string")))
    where = where.select(F.col("node").alias("cls"), "root", "block", "blocks", own.alias("own"))
    tasks = where.withColumn("at", F.explode(pair)).select("cls", "root", "own", "at.i", "at.j", F.col("block").alias("side"), (F.col("at.i") != F.col("at.j")).alias("cross"), F.col("cls").alias("label"))
    join = lambda rows: saved(found.join(rows, "cls").groupBy("own", "i", "j").applyInArrow(_tidied(_verify(percent)), "a binary, b binary").filter("a <> b"))
    links = join(tasks)
    large = where.filter("blocks > 1")
    if weight.filter("blocks > 1").isEmpty():
        return links
    return links.unionByName(join(_rest(large, links, member)))


def _rest(large: DataFrame, links: DataFrame, member: DataFrame) -> DataFrame:
    """Tasks for clusters of several blocks: sets outside of a cluster's largest component so far, against all its sets.

    Pairs inside that component are connected, so the work is that of the few, not the square of the many.
    """
    label = components(links).select(F.col("node").alias("of"), F.col("root").alias("label"))
    rows = large.join(label, F.col("cls") == F.col("of"), "left").withColumn("label", F.coalesce("label", "cls")).drop("of").join(member, "cls")
    most = rows.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("most"))
    rows = saved(rows.join(most, "root").withColumn("few", F.col("label") != F.col("most")))
    few = rows.filter("few").groupBy("root").agg(F.sum("size").alias("few_size"))
    per_block = rows.groupBy("root").agg((F.sum("size") / F.first("blocks")).alias("block_size"))
    few = few.join(per_block, "root").select("root", F.greatest(F.lit(1), F.ceil(F.col("few_size") / F.col("block_size"))).cast("int").alias("chunks"))
    rows = rows.join(few, "root")
    chunk = F.pmod(F.xxhash64("cls", F.lit(1)), F.col("chunks")).cast("int")
    columns = ["cls", "root", "own", "i", "j", "side", "cross", "label"]
    cross = F.lit(True).alias("cross")
    left = rows.filter("few").select("cls", "root", "own", chunk.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), F.lit(0).alias("side"), cross, "label")
    right = rows.select("cls", "root", "own", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side"), cross, "label")
    return left.select(*columns).unionByName(right.select(*columns))


def _joined(rows: DataFrame, words: int, percent: int, cluster_tokens: int) -> tuple[DataFrame, DataFrame]:
    """rows: doc_id, text and others. The saved set of each row (all but the text, n, cls), and of each class its component: cls, root, least (id; of equal sets)."""
    spark = rows.sparkSession
    sizes = saved(set_sizes(rows, words))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    least = sizes.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"))
    links = class_links(rows, sizes, total, words, percent, cluster_tokens) if total else None
    free_shuffles(spark)
    if links is None or links.isEmpty():
        return sizes, least.select("cls", F.col("cls").alias("root"), "least")
    roots = components(links)
    return sizes, least.join(roots, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("root", "cls").alias("root"), "least")


def ngram_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, cluster_tokens: int = CLUSTER_TOKENS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id."""
    rows = docs.select(F.col(ident(id_col)).alias("doc_id"), F.coalesce(F.col(ident(text_col)), F.lit("")).alias("text"))
    sizes, classes = _joined(rows, words, percent, cluster_tokens)
    lowest = classes.groupBy("root").agg(F.min("least").alias("lowest"))
    least = classes.join(lowest, "root").select(F.col("cls").alias("of"), "lowest")
    out = sizes.join(least, F.col("cls") == F.col("of"), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("lowest", "doc_id").alias("component_id"))


def deduplicated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each component, that of the least id (rows without id come last, ties go by text).

    A document is an id with a text: different texts under one id are told apart, and of rows equal in both
    one stays. Texts without words are in no component and all stay but for such repetitions.
    """
    one, two = free_name(docs, "key_one"), free_name(docs, "key_two")
    key = [F.col(ident(id_col)), F.col(ident(text_col))]
    keyed = docs.withColumn(one, F.xxhash64(*key)).withColumn(two, F.xxhash64(F.lit(2), *reversed(key)))
    rows = keyed.select(F.col(ident(id_col)).alias("doc_id"), F.coalesce(F.col(ident(text_col)), F.lit("")).alias("text"), F.col(one).alias("k1"), F.col(two).alias("k2"))
    sizes, classes = _joined(rows, words, percent, CLUSTER_TOKENS)
    # the least of each class first, so that a class of many copies meets in no task
    least = sizes.filter("cls is not null").groupBy("cls").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k1", "k2")).alias("x"))
    first = least.join(classes.select(F.col("cls").alias("of"), "root"), F.col("cls") == F.col("of")).groupBy("root").agg(F.min("x").alias("x"))
    kept = first.select("x.k1", "x.k2").unionByName(sizes.filter("cls is null").select("k1", "k2"))
    kept = saved(kept.select(F.col("k1").alias("kept_one"), F.col("k2").alias("kept_two")))
    repeated = sizes.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    if not repeated.isEmpty():  # partly made one before texts are shuffled
        keyed = keyed.dropDuplicates([one, two])
    return keyed.join(kept, (F.col(one) == F.col("kept_one")) & (F.col(two) == F.col("kept_two")), "left_semi").drop(one, two)
