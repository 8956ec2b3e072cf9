"""Repeated passages: words covered by a window that starts in an earlier document too.

Level-wise doubling.  The first level holds windows of half the asked length (and half a word more), and
of those only the ones whose hash is the least of all in some window of full length: equal full
windows choose equal ones, so none is lost.  Those that repeat are alone extended to the
full length, and full windows that repeat may be doubled further, level by level,
until no candidates survive (``longest_repeats``).

Rows are dealt to buckets of a bounded number of bytes.  A bucket's distinct windows are sent once, whatever the number of its
texts that hold them, to the part that their hash names, which tells the bucket which of them go on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.store import keep, partitions
from waymark.llm.words import SPACE_SPLIT, Piece, U, mix, pieces

#: Bytes of text in a bucket, on average: the least, and the most.  It grows with the square root of the input from FROM bytes on, as
#: what buckets and parts send one another is their number squared.  One long text is whole in its own bucket.
BUCKET, MOST, FROM = 8 << 20, 64 << 20, 50 << 30
#: Buckets of a small input, if there are as many partitions.
FEW = 16
_LEAST = np.iinfo(np.int64).min
#: A full window's second hash is independent of its first.
_SECOND = U(0xA24BAED4963EE407)
_SENT = "part int, bucket int, blob binary"
_TOLD = "bucket int, part int, level int, blob binary"


@dataclass
class Found:
    """Windows of one piece that go on: of each the row in the bucket, the place in the row and two hashes."""

    row: np.ndarray
    place: np.ndarray
    first: np.ndarray
    second: np.ndarray


def _half(length: int) -> int:
    return length // 2 + 1


def _least(grams: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width entries."""
    size = 1
    while 2 * size <= width:
        grams, size = np.minimum(grams[:-size], grams[size:]), 2 * size
    return grams if size == width else np.minimum(grams[: len(grams) - width + size], grams[width - size :])


def _anchors(p: Piece, words: np.ndarray, length: int) -> np.ndarray:
    """The first level's window of each full window."""
    half = _half(length)
    return _least(p.windows(words, half)[0], length - half + 1)


def _ids(table: pa.Table) -> np.ndarray:
    """Ids of a bucket's rows; the least long stands for null."""
    return np.array([_LEAST if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)


def _blobs(told: pa.Table, level: int) -> dict[int, bytes]:
    return {p: b for p, n, b in zip(*(told.column(c).to_pylist() for c in ("part", "level", "blob")), strict=True) if n == level}


def _extended(table: pa.Table, length: int, alive: np.ndarray | None) -> Iterator[tuple[Piece, Found | None]]:
    """Each piece of a bucket and its full windows that go on: those whose first level repeats (alive, sorted), or
    both of whose halves are among the row's places (alive: none)."""
    for p in pieces(table.column("text"), SPACE_SPLIT):
        words, good = p.hashes(), p.within(length)
        if good.any():
            if alive is None:
                good = good & _allowed(table.column("places"), p, length)
            else:
                own = _anchors(p, words, length)
                at = np.minimum(np.searchsorted(alive, own), max(0, len(alive) - 1))
                good = good & (alive[at] == own) if len(alive) else np.zeros(len(good), bool)
        at = np.flatnonzero(good)
        if not len(at):
            yield p, None
            continue
        doc = p.doc[at]
        yield p, Found(doc + p.rows.start, at - p.first[doc], p.windows(words, length)[0][at], p.windows(mix(words ^ _SECOND), length)[0][at])


def _allowed(places: pa.ChunkedArray, p: Piece, length: int) -> np.ndarray:
    """Windows of which both halves are among the places where half-length windows repeat."""
    n = len(p.starts) - length + 1
    open_ = np.zeros(len(p.starts), bool)
    for j, r in enumerate(p.rows):
        for b in places[r].as_py() or ():
            open_[p.first[j] + np.frombuffer(b, np.uint32).astype(np.int64)] = True
    return open_[:n] & open_[length // 2 :][:n]


@dataclass
class Distinct:
    """A bucket's distinct windows in the order of their hashes: hashes, least id, and whether another id has them too; and which of
    them each window is."""

    first: np.ndarray
    second: np.ndarray
    least: np.ndarray
    again: np.ndarray
    which: np.ndarray


def _distinct(first: np.ndarray, second: np.ndarray, ids: np.ndarray) -> Distinct:
    order = np.lexsort((ids, second, first))
    a, b, i = first[order], second[order], ids[order]
    heads = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    at = np.flatnonzero(heads)
    which = np.empty(len(a), np.int64)
    which[order] = np.cumsum(heads) - 1
    return Distinct(a[at], b[at], i[at], i[np.r_[at[1:], len(a)] - 1] > i[at] if len(at) else np.zeros(0, bool), which)


def _split(d: Distinct, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each part that has some: which of the distinct windows."""
    part = (d.first % U(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    for k in np.flatnonzero(np.diff(bounds)).tolist():
        yield k, order[bounds[k] : bounds[k + 1]]


def _send(bucket: int, d: Distinct, parts: int, ids: bool) -> pa.Table:
    out = [(k, bucket, len(at).to_bytes(8, "little") + d.first[at].tobytes() + (d.second[at].tobytes() + d.least[at].tobytes() if ids else b"") + np.packbits(d.again[at]).tobytes()) for k, at in _split(d, parts)]
    return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["part", "bucket", "blob"])


def _first_level(length: int, parts: int):
    def first_level(table: pa.Table) -> pa.Table:
        """The bucket's distinct first-level windows."""
        ids, grams, who = _ids(table), [], []
        for p in pieces(table.column("text"), SPACE_SPLIT):
            good = p.within(length)
            if good.any():
                own, doc = _anchors(p, p.hashes(), length)[good], p.doc[: len(good)][good]
                new = np.r_[True, (own[1:] != own[:-1]) | (doc[1:] != doc[:-1])]
                grams.append(own[new])
                who.append(ids[doc[new] + p.rows.start])
        grams, who = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((grams, U), (who, np.int64)))
        return _send(table.column("bucket")[0].as_py(), _distinct(grams, np.zeros(len(grams), U), who), parts, False)

    return first_level


def _survivors(sent: pa.Table) -> pa.Table:
    """Of one part's first-level windows those that more than one document has, told to each bucket that has them."""
    part, buckets, keys, again = sent.column("part")[0].as_py(), [], [], []
    for bucket, blob in zip(sent.column("bucket").to_pylist(), sent.column("blob").to_pylist(), strict=True):
        n = int.from_bytes(blob[:8], "little")
        buckets.append(np.full(n, bucket, np.int32))
        keys.append(np.frombuffer(blob, U, n, 8))
        again.append(np.unpackbits(np.frombuffer(blob, np.uint8, -1, 8 + 8 * n), count=n).astype(bool))
    bucket, key, again = (np.concatenate(x) for x in (buckets, keys, again))
    order = np.argsort(key, kind="stable")
    heads = np.r_[True, key[order][1:] != key[order][:-1]]
    group, at = np.cumsum(heads) - 1, np.flatnonzero(heads)
    good = (np.diff(np.r_[at, len(key)]) > 1) | (np.maximum.reduceat(again[order].astype(np.int8), at) > 0)
    go = order[good[group]]
    go = go[np.argsort(bucket[go], kind="stable")]
    cuts = np.flatnonzero(np.r_[True, bucket[go][1:] != bucket[go][:-1], True]) if len(go) else np.zeros(1, np.int64)
    out = [(int(bucket[go[a]]), part, 1, key[go[a:b]].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    return _told(out)


def _told(out: list[tuple]) -> pa.Table:
    return pa.table([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "part", "level", "blob"])


def _alive(told: pa.Table, within: bool) -> np.ndarray | None:
    return None if within else np.sort(np.concatenate([np.zeros(0, U), *[np.frombuffer(b, U) for b in _blobs(told, 1).values()]]))


def _of_bucket(table: pa.Table, length: int, alive: np.ndarray | None) -> tuple[list[tuple[Piece, Found | None]], Distinct]:
    got, ids = list(_extended(table, length, alive)), _ids(table)
    own = [f for _, f in got if f is not None]
    first, second = (np.concatenate([np.zeros(0, U), *[getattr(f, k) for f in own]]) for k in ("first", "second"))
    return got, _distinct(first, second, ids[np.concatenate([np.zeros(0, np.int64), *[f.row for f in own]])])


def _second_level(length: int, parts: int, within: bool):
    def second_level(table: pa.Table, told: pa.Table) -> pa.Table:
        """The bucket's distinct full windows whose first level repeats."""
        if not len(table):
            return _send(0, _distinct(np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)), parts, True)
        return _send(table.column("bucket")[0].as_py(), _of_bucket(table, length, _alive(told, within))[1], parts, True)

    return second_level


def _settle(sent: pa.Table) -> pa.Table:
    """Of one part's full windows, for each bucket, two bits for each in its order: whether an earlier document has it elsewhere, and
    whether more than one document has it at all."""
    part, buckets, sizes, cols = sent.column("part")[0].as_py(), sent.column("bucket").to_pylist(), [], []
    for blob in sent.column("blob").to_pylist():
        n = int.from_bytes(blob[:8], "little")
        sizes.append(n)
        cols.append([np.frombuffer(blob, U, n, 8), np.frombuffer(blob, U, n, 8 + 8 * n), np.frombuffer(blob, np.int64, n, 8 + 16 * n), np.unpackbits(np.frombuffer(blob, np.uint8, -1, 8 + 24 * n), count=n)])
    a, b, ids, again = (np.concatenate(x) for x in zip(*cols, strict=True))
    order = np.lexsort((ids, b, a))
    heads = np.r_[True, (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])]
    group, at = np.cumsum(heads) - 1, np.flatnonzero(heads)
    least, most = ids[order][at], ids[order][np.r_[at[1:], len(a)] - 1]
    late, many = np.zeros(len(a), bool), np.zeros(len(a), bool)
    late[order] = ids[order] > least[group]
    many[order] = ((most > least) | (np.maximum.reduceat(again[order], at) > 0))[group]
    ends = np.cumsum(sizes)
    return _told([(k, part, 2, np.packbits(np.r_[late[e - n : e], many[e - n : e]]).tobytes()) for k, n, e in zip(buckets, sizes, ends.tolist(), strict=True)])


def _repeated(table: pa.Table, told: pa.Table, length: int, parts: int, both: bool, within: bool) -> Iterator[tuple[Piece, Found | None, np.ndarray]]:
    """Each piece of a bucket, its full windows that went on, and which of them an earlier document has too (both: any other document)."""
    got, d = _of_bucket(table, length, _alive(told, within))
    bits = _blobs(told, 2)
    late, many = np.zeros(len(d.first), bool), np.zeros(len(d.first), bool)
    for k, at in _split(d, parts):
        own = np.unpackbits(np.frombuffer(bits[k], np.uint8), count=2 * len(at)).astype(bool)
        late[at], many[at] = own[: len(at)], own[len(at) :]
    ids, to = _ids(table), 0
    for p, f in got:
        n = 0 if f is None else len(f.row)
        which = d.which[to : to + n]
        to += n
        yield p, f, (many[which] if both else late[which] | (ids[f.row] > d.least[which])) if n else np.zeros(0, bool)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """doc_id, row_hash, text and bucket; and how many buckets there are."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_hash"), F.col(text_col).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).head()[0] or 0  # one number
    size = min(MOST, int(BUCKET * max(1.0, total / FROM) ** 0.5))
    n = max(min(FEW, partitions(docs.sparkSession)), -(-total // size))
    return slim.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(_LEAST)), "row_hash"), F.lit(n)).cast("int")), n


def _levels(rows: DataFrame, parts: int, length: int, within: bool) -> DataFrame:
    """(bucket, part, level, blob): what each bucket has to know of its windows."""
    if within:
        first = rows.sparkSession.createDataFrame([], _TOLD)
    else:
        first = rows.groupBy("bucket").applyInArrow(_first_level(length, parts), _SENT).groupBy("part").applyInArrow(_survivors, _TOLD)
    second = rows.groupBy("bucket").cogroup(first.groupBy("bucket")).applyInArrow(_second_level(length, parts, within), _SENT)
    return first.unionByName(second.groupBy("part").applyInArrow(_settle, _TOLD))


def repeated_windows(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text", both: bool = False, within: DataFrame | None = None) -> DataFrame:
    """doc_id, row_hash (of the text) and places (list of uint32 arrays): where
    windows of ``length`` words start that also start in a document with a smaller id (both:
    or with a larger one).  within: the places of half that length, the only ones to extend.

    A null id counts as smaller than any other (here the least long stands for it); null
    texts have no words.  Rows with the same id are one document."""
    rows, parts = _rows(docs, id_col, text_col)
    if within is not None:
        w = within.select(F.col("doc_id").alias("k_id"), F.col("row_hash").alias("k_hash"), "places")
        rows = rows.join(w, rows.doc_id.eqNullSafe(F.col("k_id")) & rows.row_hash.eqNullSafe(F.col("k_hash"))).select("doc_id", "row_hash", "text", "bucket", "places")

    extended = within is not None

    def found(table: pa.Table, told: pa.Table) -> pa.Table:
        places: dict[int, list[bytes]] = {}
        for _, f, hit in _repeated(table, told, length, parts, both, extended) if len(table) else ():
            if hit.any():
                for r in np.unique(f.row[hit]).tolist():
                    places.setdefault(r, []).append(f.place[hit & (f.row == r)].astype(np.uint32).tobytes())
        own = list(places)
        return pa.table([table.column("doc_id").take(pa.array(own, pa.int64())), table.column("row_hash").take(pa.array(own, pa.int64())), pa.array(list(places.values()), pa.list_(pa.binary()))], names=["doc_id", "row_hash", "places"])

    told = _levels(rows, parts, length, extended)
    # rows that share id and text have the same places
    return rows.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(found, "doc_id long, row_hash long, places array<binary>").dropDuplicates(["doc_id", "row_hash"])


def _kept(p: Piece, gone: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words of a piece that stay, joined by one space within each row; and where each row's start (and the last ends)."""
    data, mask = p.data.copy(), np.zeros(len(p.data) + 1, np.int32)
    stay = np.flatnonzero(~gone)
    mask[p.starts[stay]] += 1
    mask[p.ends[stay]] -= 1
    mask = np.cumsum(mask[:-1]) > 0
    # the byte after a word becomes the space, but for the last word that stays of a row
    doc = p.doc[stay]
    inner = stay[np.r_[doc[1:] == doc[:-1], False]] if len(stay) else stay
    mask[p.ends[inner]] = True
    data[p.ends[inner]] = 0x20
    return data[mask].tobytes(), np.r_[0, np.cumsum(mask)][p.offsets]


def cut_repeats(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per row of docs: id, n_words, n_removed, kept_sha256 and kept_text (the words that
    stay, joined by one space).  Other columns of docs are not looked at, whatever their names.  An empty table
    gives an empty table; repeated rows each give a row; a null text has no words; a null id comes before all others; of
    rows with one id, as of one text, none is earlier.

    Windows are compared by two 64-bit hashes of their words, each word's hash by two primes."""
    rows, parts = _rows(docs, id_col, text_col)

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        n_words, n_removed, digest, kept_text = [], [], [], []
        for p, f, hit in _repeated(table, told, length, parts, False, False) if len(table) else ():
            edge = np.zeros(len(p.starts) + length + 1, np.int32)
            if hit.any():
                at = p.first[f.row[hit] - p.rows.start] + f.place[hit]
                edge[at] += 1
                edge[at + length] -= 1
            gone = np.cumsum(edge)[: len(p.starts)] > 0
            joined, ends = _kept(p, gone)
            n_words += np.diff(p.first).tolist()
            n_removed += np.diff(np.r_[0, np.cumsum(gone)][p.first]).tolist()
            for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                digest.append(hashlib.sha256(joined[a:b]).hexdigest())
                if with_text:
                    kept_text.append(joined[a:b].decode())
        made = [table.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
        return pa.table(made + [pa.array(kept_text, pa.string())] * with_text, names=["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    out = rows.groupBy("bucket").cogroup(_levels(rows, parts, length, False).groupBy("bucket")).applyInArrow(cut, schema)
    return out.withColumnRenamed("doc_id", id_col)


def longest_repeats(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document with a repeated window: the longest of length, 2 length, 4 length, ... words that still repeats.

    A level extends only windows of which both halves repeated at the level before, and
    the levels end when no window is left."""
    level, within, found = length, None, None
    while True:
        hit = keep(repeated_windows(docs, level, id_col, text_col, both=True, within=within), f"level-{level}")
        if hit.isEmpty():
            break
        level_found = hit.select("doc_id", F.lit(level).alias("longest"))
        found = level_found if found is None else found.unionByName(level_found)
        level, within = 2 * level, hit
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, longest int")
    return found.groupBy("doc_id").agg(F.max("longest").alias("longest"))
