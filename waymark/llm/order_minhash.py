"""Near copies by Order MinHash.

A text is the sequence of its words' k-shingles, each labelled with how often it came
before, so labelled shingles are unique.  A sketch draws, under each of several hash
functions, the few least labelled shingles and keeps them in the order of the text: two
texts share such a draw about as often as their shingles overlap *in the same order*.
Candidates are verified by alignment within a band: the longest chain of common labelled
shingles that rises in both texts and stays near the diagonal.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.graph import components
from waymark.llm.hilbert import running
from waymark.llm.store import keep
from waymark.llm.words import ALNUM, U, mix, pieces

DRAWS = 16
DRAWN = 5
#: Buckets up to this size compare all their texts with one another.
SMALL = 8
#: Shingles of the texts of a block, each text counting TEXT more; blocks of large buckets meet block by block.
BLOCK = 1 << 18
TEXT = 128
#: Texts of up to so many shingles have keys of fewer shingles too.
SHORT = 30
#: Texts of a batch that are sketched together.
SLICE = 512
#: Ids to broadcast at most: 8 MB.
BROADCAST_IDS = 1_000_000
_SEEDS = mix(np.arange(1, DRAWS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def _labelled(grams: np.ndarray) -> np.ndarray:
    """Shingle hashes, made unique by how often each came before."""
    order = np.argsort(grams, kind="stable")
    heads = np.r_[True, grams[order][1:] != grams[order][:-1]]
    if heads.all():
        return grams
    at = np.arange(len(grams))
    seen = np.empty(len(grams), U)
    seen[order] = at - np.maximum.accumulate(np.where(heads, at, 0))
    return np.where(seen > 0, mix(grams ^ (seen * U(0xA24BAED4963EE407))), grams)


def _draws(grams: np.ndarray) -> np.ndarray:
    """One key for each hash function: the DRAWN least shingles in the order of the text.  Short texts
    have keys of two shingles besides, as five of few seldom agree."""
    n, keys = len(grams), []
    for drawn in (DRAWN,) if n > SHORT else (DRAWN, 2):
        if n > drawn:
            h = grams * _SEEDS[:, None]
            h ^= h >> U(29)
            own = grams[np.sort(np.argpartition(h, drawn, axis=1)[:, :drawn], axis=1)]
            seeds = _SEEDS
        else:
            own, seeds = grams[None, :], _SEEDS[:1]
        key = seeds ^ U(drawn)
        for j in range(own.shape[1]):
            key = mix(key * U(3) ^ own[:, j])
        keys.append(key)
    return np.concatenate(keys)


def _each(column: pa.Array, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """For each text a digest of its words and its labelled shingles; under k words they are one shingle."""
    for p in pieces(column, ALNUM, lower=True):
        words = p.hashes()
        grams, _ = p.windows(words, k)
        for j in range(len(p.rows)):
            a, b = p.first[j], p.first[j + 1]
            if b == a:
                yield hashlib.blake2b(p.data[p.offsets[j] : p.offsets[j + 1]].tobytes(), digest_size=16, person=b"raw").digest(), np.zeros(0, U)
                continue
            own = grams[a : b - k + 1] if b - a >= k else np.array([int.from_bytes(hashlib.blake2b(words[a:b].tobytes(), digest_size=8).digest(), "little")], U)
            yield hashlib.blake2b(words[a:b].tobytes(), digest_size=16).digest(), _labelled(own)


def _id(digest: bytes) -> int:
    """A text's number, whatever the ids of its rows: half of its digest."""
    return int.from_bytes(digest[:8], "little", signed=True)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some texts at a time, so that what is held of their results does not follow Arrow's batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _sketch(k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            same, keys = [], []
            for digest, grams in _each(batch.column(1), k):
                same.append(digest)
                keys.append(_draws(grams).astype(np.int64).tolist() if len(grams) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array([_id(x) for x in same], pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "same", "id", "keys"])

    return sketch


def _shingles(k: int):
    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, blobs = [], []
            for digest, g in _each(batch.column(1), k):
                ids.append(_id(digest))
                blobs.append((g >> U(32)).astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(blobs, pa.binary())], names=["id", "grams"])

    return shingles


def alignment(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Likeness of two sequences of unique shingles: the longest chain that rises in both and
    stays within the band that ``least`` leaves, over all shingles of either; 0 if under least for sure."""
    la, lb = len(a), len(b)
    if min(la, lb) < least * max(la, lb) or not min(la, lb):
        return 0.0
    _, ia, ib = np.intersect1d(a, b, return_indices=True)
    if len(ia) < least * (la + lb - len(ia)):
        return 0.0
    band = (1 - least) / (1 + least) * (la + lb)
    near = np.abs(ia - ib) <= band
    ib = ib[near][np.argsort(ia[near])]
    if (np.diff(ib) > 0).all():
        chain = len(ib)
    else:
        tails: list[int] = []
        for x in ib.tolist():
            at = bisect_left(tails, x)
            tails[at : at + 1] = [x]
        chain = len(tails)
    return chain / (la + lb - chain)


def _verify(least: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            like = [alignment(np.frombuffer(x.as_buffer(), np.uint32), np.frombuffer(y.as_buffer(), np.uint32), least) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            good = pa.array([x >= least for x in like], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(like, pa.float64())], names=["a", "b", "likeness"]).filter(good)

    return verify


def _all_pairs(members: DataFrame) -> DataFrame:
    """Every pair of each small bucket."""
    small = members.filter(F.col("size") <= SMALL).select("bucket", "id")
    return small.select("bucket", F.col("id").alias("a")).join(small.select("bucket", F.col("id").alias("b")), "bucket").filter("a < b").select("a", "b")


def _groups(members: DataFrame) -> DataFrame:
    """(id, label) of the texts of large buckets: those that meet over large buckets are one group.
    Each text of such a bucket hangs on the bucket's least, which has a loop."""
    return components(members.filter(F.col("size") > SMALL).select(F.col("least").alias("a"), F.col("id").alias("b")), BROADCAST_IDS)


def _likenesses(x: np.ndarray, sizes: np.ndarray, table: tuple[np.ndarray, np.ndarray, np.ndarray], texts: list[np.ndarray], least: float) -> np.ndarray:
    """alignment() of x with each of the texts, whose distinct shingles lie in table: shingles in order, text and place of each."""
    grams, owner, place = table
    la, like = len(x), np.zeros(len(sizes))
    own, at = np.unique(x, return_index=True)
    lo, hi = np.searchsorted(grams, own), np.searchsorted(grams, own, "right")
    n = hi - lo
    to = np.arange(n.sum()) + np.repeat(lo - np.r_[0, np.cumsum(n)[:-1]], n)
    who, ib, ia = owner[to], place[to], np.repeat(at, n)
    common = np.bincount(who, minlength=len(sizes))
    able = (np.minimum(la, sizes) >= least * np.maximum(la, sizes)) & (common > 0) & (common >= least * (la + sizes - common))
    near = able[who] & (np.abs(ia - ib) <= (1 - least) / (1 + least) * (la + sizes[who]))
    who, ia, ib = who[near], ia[near], ib[near]
    order = np.lexsort((ia, who))
    who, ib = who[order], ib[order]
    chain = np.bincount(who, minlength=len(sizes))
    falls = np.unique(who[1:][(who[1:] == who[:-1]) & (np.diff(ib) <= 0)])
    like[able] = chain[able] / (la + sizes[able] - chain[able])
    for j in falls.tolist():
        like[j] = alignment(x, texts[j], least)
    return like


def _block_links(least: float):
    def block_links(group: pa.Table) -> pa.Table:
        """Two blocks, or one with itself: for each text how many of the others' it is linked with (id, id, n), and each text's least of its class here (least, id, 0)."""
        side = np.array(group.column("side").to_pylist(), np.int64)
        ids = np.array(group.column("id").to_pylist(), np.int64)
        texts = [np.frombuffer(g, np.uint32) for g in group.column("grams").to_pylist()]
        right = np.flatnonzero(side == side.max())
        left = right if side.min() == side.max() else np.flatnonzero(side == side.min())
        ys = [texts[j] for j in right.tolist()]
        sizes = np.array([len(y) for y in ys], np.int64)
        owner, place = np.repeat(np.arange(len(ys)), sizes), np.concatenate([np.arange(k) for k in sizes.tolist()])
        key = np.concatenate(ys).astype(U) << U(32) | owner.astype(U)
        # of equal shingles within a text the first counts, as in alignment()
        key, first = np.unique(key, return_index=True)
        table = (key >> U(32)).astype(np.uint32), owner[first], place[first]
        degree = np.zeros(len(ids), np.int64)
        root = list(range(len(ids)))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in left.tolist():
            found = right[_likenesses(texts[i], sizes, table, ys, least) >= least]
            found = found[found > i] if left is right else found
            degree[i] += len(found)
            degree[found] += 1
            for j in found.tolist():
                u, v = top(i), top(j)
                if u != v:
                    u, v = (u, v) if ids[u] < ids[v] else (v, u)
                    root[v] = u
        # each text with the least of its tree, whose links join all that these do
        tops = [(ids[top(i)], ids[i]) for i in np.flatnonzero(degree).tolist() if top(i) != i]
        a, b = ([t[k] for t in tops] for k in (0, 1))
        full = np.flatnonzero(degree)
        return pa.table([pa.array(np.r_[ids[full], np.array(a, np.int64)]), pa.array(np.r_[ids[full], np.array(b, np.int64)]), pa.array(np.r_[degree[full], np.zeros(len(a), np.int64)])], names=["a", "b", "n"])

    return block_links


def _within(grams: DataFrame, groups: DataFrame, least: float) -> DataFrame:
    """(a, b, n) of the groups: where a = b, n further texts are linked with a; else n is 0, and a and b are of one
    class.  Every pair of a group is looked at whose lengths allow a link: texts in order of length fall
    into blocks of a bounded size, and each two blocks near enough are a task's row group of their own."""
    size = F.octet_length("grams") / 4
    own = groups.join(grams, "id").select("label", "id", size.cast("long").alias("size"))
    placed = running(own, ["label", "size", "id"], F.col("size") + TEXT, "placed").withColumn("block", F.floor(F.col("_before") / BLOCK))
    placed = keep(placed.select("label", "id", "size", "block"), "blocks")
    ends = placed.groupBy("label", "block").agg(F.min("size").alias("lo"), F.max("size").alias("hi"))
    x, y = ends.select("label", F.col("block").alias("x"), "hi"), ends.select("label", F.col("block").alias("y"), "lo")
    meet = keep(x.join(y, "label").filter(f"x <= y and (x = y or hi >= {least}D * lo - 1e-9D)").select("label", "x", "y"), "meet")
    sides = meet.select("label", "x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    rows = placed.join(sides, ["label", "block"]).join(grams, "id")
    return rows.select("label", "x", "y", F.col("block").alias("side"), "id", "grams").groupBy("label", "x", "y").applyInArrow(_block_links(least), "a long, b long, n long")


def near_copies(docs: DataFrame, least: float = 0.8, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, class_id (the least id of its class), n_links (other texts that
    its text is linked with), and same, a digest of its words.

    Texts with the same words are one text, whatever their ids.  Two texts are linked if their alignment over
    k-word shingles is at least ``least``; classes are the components.  Null and empty texts are the same
    text; a text without words is like its exact copies only; ties take the least id; rows
    that share an id are one document, whose texts' classes are one (that adds no link).  Rows without an id get
    no class.  Columns of docs beside id and text are not looked at, whatever their names; long texts are compared whole.

    Each draw's equal keys make a bucket.  A bucket of up to SMALL texts compares every pair.  Texts
    that meet over larger buckets are a group, and every pair of a group is compared whose lengths allow
    a link (see _within), so links are counted in full there, also between texts that share no bucket.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sketches = keep(slim.mapInArrow(_sketch(k), "doc_id long, same binary, id long, keys array<long>"), "sketches")
    named = sketches.filter("doc_id is not null")
    texts = keep(named.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")), "texts")
    keyed = texts.filter("keys is not null").select("id", "doc_id", F.explode("keys").alias("bucket"))
    sizes = keyed.groupBy("bucket").agg(F.count("*").alias("size"), F.min("id").alias("least")).filter("size > 1")
    members = keep(keyed.join(sizes, "bucket"), "members")
    # texts of one id are one document's
    several = named.groupBy(F.col("doc_id").alias("own")).agg(F.min("id").alias("a"), F.max("id").alias("most")).filter("a < most").select("own", "a")
    links = keep(named.join(several, named.doc_id == several.own).select("a", F.col("id").alias("b"), F.lit(0).cast("long").alias("n")).filter("a <> b").distinct(), "one-id")
    ids = members.select("doc_id").distinct()
    n = ids.count()
    if n:
        ids = F.broadcast(ids) if n <= BROADCAST_IDS else ids
        grams = keep(slim.join(ids, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_shingles(k), "id long, grams binary").groupBy("id").agg(F.first("grams").alias("grams")), "grams")
        groups = keep(_groups(members), "groups")
        groups = F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups
        pairs = _all_pairs(members).distinct()
        for side in ("a", "b"):
            pairs = pairs.join(groups.select(F.col("id").alias(side), F.col("label").alias(f"g_{side}")), side, "left")
        # what is in one group is compared there
        pairs = keep(pairs.filter("g_a is null or g_b is null or g_a <> g_b").select("a", "b"), "pairs")
        x, y = (grams.withColumnRenamed("id", side).withColumnRenamed("grams", name) for side, name in (("a", "x"), ("b", "y")))
        single = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify(least), "a long, b long, likeness double").select("a", "b", F.lit(1).cast("long").alias("n"))
        links = keep(links.unionByName(single).unionByName(_within(grams, groups, least)), "links")
    labels = components(links.filter("a <> b"), BROADCAST_IDS)
    classes = labels.join(texts.select("id", "doc_id"), "id")
    least_id = classes.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    ends = links.select(F.col("a").alias("id"), "n").union(links.filter("a <> b").select("b", "n"))
    degree = ends.groupBy("id").agg(F.sum("n").alias("n_links"))
    found = keep(labels.join(least_id, "label").join(degree, "id").select("id", "class_id", "n_links"), "found")
    found = F.broadcast(found) if found.count() <= BROADCAST_IDS else found
    # a text without links is alone in its class
    alone = texts.select("id", F.col("doc_id").alias("first")).join(found, "id", "left").select("id", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    out = sketches.select("doc_id", "same", "id").join(alone, "id", "left")
    own = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.when(own, F.col("class_id")).alias("class_id"), F.when(own, F.col("n_links")).alias("n_links"), "same")
