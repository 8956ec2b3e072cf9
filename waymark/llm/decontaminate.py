"""Benchmark questions in documents, also with other numbers, names or units.

Words become a template: numbers, names and units turn into typed placeholders, and what
they were into slots.  Windows of templates are joined by hash, and a match counts if its
slots are consistent: each value of the question stands for one value of the document.
Besides, windows of the lower-cased words themselves are joined, so short questions, and those
of names and numbers mostly, are found verbatim, whatever their capitals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.store import keep
from waymark.llm.words import ALNUM, LOWER, Piece, U, mix, pieces

WINDOW = 8
#: Words of a window that must not be placeholders.
PLAIN = 4
#: Bits for each window of the benchmark in the filter that documents' windows pass before they are joined, a power of two in all.
FILTER_BITS = 32
BROADCAST_ROWS = 50_000
# Units of measure.
UNITS = "m km cm mm mi mile miles ft foot feet inch inches yard yards kg g mg lb lbs ton tons tonne tonnes l ml litre litres liter liters s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years c f k percent usd eur gbp dollar dollars euro euros pound pounds cent cents mph kmh kb mb gb tb w kw v a hz khz mhz ghz".split()
NUM, NAME, UNIT = (U(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
#: Sets verbatim windows apart from templates.
AS_IS = U(0x4444444444444444)
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def _hash_words(words: list[str]) -> np.ndarray:
    return next(pieces(pa.array([" ".join(words)]), ALNUM)).hashes()


_UNITS = np.sort(_hash_words(UNITS))


def _templates(p: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Template words of a piece: hash, kind (0 plain, 1 number, 2 name, 3 unit), first and last of the words that each stands for.

    A number is a word of digits (with what joins it to the next, as in 3.5 or 1,000); a unit
    follows a number; a name starts with a capital within a sentence, and names side by side are one."""
    raw = p.data
    lower = Piece(p.rows, LOWER[raw], p.offsets, p.starts, p.ends, p.first)
    words, n, doc = lower.hashes(), len(p.starts), p.doc
    if not n:
        return words, np.zeros(0, np.int8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    digits = np.r_[0, np.cumsum(_DIGIT[raw])]
    number = digits[p.ends] - digits[p.starts] == p.ends - p.starts
    lead = raw[p.starts]
    second = raw[np.minimum(p.starts + 1, len(raw) - 1)]
    capital = ((lead >= 0x41) & (lead <= 0x5A)) | ((lead == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    stops = np.isin(raw, np.frombuffer(b".!?\n\r:;\"|", np.uint8))
    stops = np.r_[0, np.cumsum(stops)]
    same = np.r_[False, doc[1:] == doc[:-1]]
    between = np.zeros(n, np.int64)
    between[1:] = stops[p.starts[1:]] - stops[p.ends[:-1]]
    inside = same & (between == 0)
    kind = np.zeros(n, np.int8)
    kind[number] = 1
    kind[capital & inside & ~number] = 2
    place = np.minimum(np.searchsorted(_UNITS, words), len(_UNITS) - 1)
    after = np.r_[False, number[:-1]] & same
    kind[(_UNITS[place] == words) & after & ~number] = 3
    joined = np.zeros(n, bool)
    gap = np.r_[2, p.starts[1:] - p.ends[:-1]]
    joined[1:] = inside[1:] & (((kind[1:] == 2) & (kind[:-1] == 2)) | ((kind[1:] == 1) & (kind[:-1] == 1) & (gap[1:] == 1)))
    # 3.5: the point between digits ends no sentence
    dot = np.r_[False, (kind[1:] == 1) & (kind[:-1] == 1)] & same & (gap == 1)
    joined |= dot
    at = np.flatnonzero(~joined)
    last = np.r_[at[1:], n] - 1
    kind = kind[at]
    hashes = words[at].copy()
    for i, x in enumerate((NUM, NAME, UNIT)):
        hashes[kind == i + 1] = x
    return hashes, kind, at, last


def _windows(p: Piece, sizes: list[int], passes) -> Iterator[tuple[int, int, int, list[str]]]:
    """(row, place, hash, slots) of the windows that pass the filter, of the given sizes."""
    hashes, kind, at, last = _templates(p)
    if not len(hashes):
        return
    doc = p.doc[at]
    first = np.searchsorted(doc, np.arange(len(p.rows) + 1))
    own = Piece(p.rows, p.data, p.offsets, p.starts[at], p.ends[last], first)
    plain = np.r_[0, np.cumsum(kind == 0)]
    for size in sizes:
        grams, whole = own.windows(hashes, size)
        if not len(grams):
            continue
        n = len(grams)
        grams = mix(grams ^ U(size))
        whole &= plain[size:][:n] - plain[:-size][:n] >= min(PLAIN, size)
        at_, = np.nonzero(whole)
        for i in at_[passes(grams[at_])].tolist():
            slots = [f"{kind[j]}:{bytes(p.data[own.starts[j] : own.ends[j]]).decode(errors='replace').lower()}" for j in range(i, i + size) if kind[j]]
            yield int(doc[i]) + p.rows.start, i - int(first[doc[i]]), int(grams[i : i + 1].view(np.int64)[0]), slots


def _verbatim(p: Piece, sizes: list[int], passes) -> Iterator[tuple[int, int, int, list[str]]]:
    """The same of lower-cased words as they stand, without slots."""
    hashes, doc = Piece(p.rows, LOWER[p.data], p.offsets, p.starts, p.ends, p.first).hashes(), p.doc
    for size in sizes:
        grams, whole = p.windows(hashes, size)
        grams = mix(grams ^ U(size) ^ AS_IS)
        at, = np.nonzero(whole)
        for i in at[passes(grams[at])].tolist():
            yield int(doc[i]) + p.rows.start, i - int(p.first[doc[i]]), int(grams[i : i + 1].view(np.int64)[0]), []


def _bits(hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    return (hashes % U(size)).astype(np.int64), (mix(hashes) % U(size)).astype(np.int64)


_SHAPE = "{key} long, row_hash long, hash long, place int, n int, slots array<string>"


def _emit(key: str, window: int, shared):
    """Windows of each row; n is how many its row has (items) or 0.  Items' row_hash is the window's size, negative if verbatim.  shared: the filter and the sizes, or none for the items themselves."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, row_hash, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            if shared is None:
                for p in pieces(batch.column(2), ALNUM):
                    for j in range(len(p.rows)):
                        one = Piece(range(p.rows[j], p.rows[j] + 1), p.data, p.offsets[j : j + 2], p.starts[p.first[j] : p.first[j + 1]], p.ends[p.first[j] : p.first[j + 1]], np.array([0, p.first[j + 1] - p.first[j]]))
                        if size := min(window, len(one.starts)):
                            found = list(_verbatim(one, [size], lambda g: np.ones(len(g), bool)))
                            out += [(ids[r], -size, h, i, len(found), s) for r, i, h, s in found]
                        n = len(_templates(one)[0])
                        # an item's first word is a capital that says nothing; within a document's sentence it would be a name
                        skip = int(n > PLAIN)
                        size = min(window, n - skip)
                        if size >= PLAIN:
                            found = [x for x in _windows(one, [size], lambda g: np.ones(len(g), bool)) if x[1] >= skip]
                            out += [(ids[r], size, h, i, len(found), s) for r, i, h, s in found]
            else:
                bits, sizes = shared.value

                def passes(g: np.ndarray) -> np.ndarray:
                    a, b = _bits(g, 8 * len(bits))
                    return ((bits[a >> 3] >> (a & 7).astype(np.uint8)) & (bits[b >> 3] >> (b & 7).astype(np.uint8)) & 1).astype(bool)

                for p in pieces(batch.column(2), ALNUM):
                    for windows, own in ((_windows, [x for x in sizes if x > 0]), (_verbatim, [-x for x in sizes if x < 0])):
                        out += [(ids[r], row_hash[r], h, i, 0, s) for r, i, h, s in windows(p, own, passes)]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ((),) * 6, kinds, strict=True)], names=[key, "row_hash", "hash", "place", "n", "slots"])

    return emit


def _consistent(pairs: Column) -> Column:
    """Each value of the question stands for one value, and different names for different names."""
    names = F.filter(pairs, lambda x: x["i_slots"].startswith("2:"))
    one = lambda a, side: F.size(F.array_distinct(F.transform(a, lambda x: x[side]))) == F.size(a)
    return one(pairs, "i_slots") & one(names, "slots")


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document and item that it contains: doc_id, row_hash (of the text), item_id, coverage
    (share of the item's windows), n_slots, and verbatim (no slot differs).

    An item counts if at least ``least`` of its windows match with consistent slots, or as many of its
    verbatim windows (of its lower-cased words; an item of up to ``window`` words is one); coverage is the larger share.
    Template windows with under PLAIN plain words say too little, so items without others are found verbatim only.  Null and empty texts match nothing; long texts are searched whole; repeated rows give one
    result; a null doc_id is carried as null; ties of shifts go to the first; other columns are not looked at, whatever their names; an empty table or benchmark gives no rows."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.lit(0).cast("long").alias("row_hash"), F.col(item_text_col).alias("text"))
    wanted = keep(items.mapInArrow(_emit("item_id", window, None), _SHAPE.format(key="item_id")).withColumnRenamed("row_hash", "size"), "items")
    h = F.col("hash")
    sizes = sorted(r[0] for r in wanted.select("size").distinct().collect())
    own = wanted.select("hash").distinct().toArrow().column("hash").to_numpy().view(U)  # a number for each window of the benchmark
    size = 1 << max(16, int(FILTER_BITS * len(own)).bit_length())
    full = np.zeros(size, bool)
    for at in _bits(own, size):
        full[at] = True
    bits = np.packbits(full, bitorder="little")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_hash"), F.col(text_col).alias("text"))
    hits = slim.mapInArrow(_emit("doc_id", window, spark.sparkContext.broadcast((bits, sizes))), _SHAPE.format(key="doc_id")).drop("n")
    few = wanted.count() <= BROADCAST_ROWS
    w = wanted.select(h.alias("hash"), "item_id", (F.col("size") < 0).alias("as_is"), F.col("place").alias("i_place"), "n", F.col("slots").alias("i_slots"))
    found = hits.join(F.broadcast(w) if few else w, "hash").withColumn("shift", F.col("place") - F.col("i_place"))
    by = ["doc_id", "row_hash", "item_id"]
    pairs = lambda c: F.array_distinct(F.flatten(c))
    runs = found.groupBy(*by, "as_is", "n", "shift").agg(F.collect_set("i_place").alias("places"), pairs(F.collect_set(F.arrays_zip("i_slots", "slots"))).alias("pairs"))
    runs = runs.filter(_consistent(F.col("pairs")))
    whole = runs.groupBy(*by, "as_is", "n").agg(pairs(F.collect_list("pairs")).alias("pairs"), F.size(pairs(F.collect_list("places"))).alias("covered"), F.max_by(F.struct(F.size("places").alias("covered"), "pairs"), F.struct(F.size("places"), -F.col("shift"))).alias("best"))
    # shifts whose slots contradict one another do not add up: the best one counts
    add = _consistent(F.col("pairs"))
    whole = whole.select(*by, "as_is", "n", F.when(add, F.col("covered")).otherwise(F.col("best.covered")).alias("covered"), F.when(add, F.col("pairs")).otherwise(F.col("best.pairs")).alias("pairs"))
    whole = whole.select(*by, "as_is", "n", "covered", F.size("pairs").alias("n_slots"), F.forall("pairs", lambda x: x["i_slots"] == x["slots"]).alias("verbatim"))
    out = whole.withColumn("coverage", F.col("covered") / F.col("n")).filter(F.col("coverage") >= least)
    # slots are told by the templates, if these match
    slots, same = (F.max(F.when(~F.col("as_is"), F.col(c))) for c in ("n_slots", "verbatim"))
    out = out.groupBy(*by).agg(F.max("coverage").alias("coverage"), F.coalesce(slots, F.lit(0)).alias("n_slots"), F.coalesce(same, F.lit(True)).alias("verbatim"))
    return out.select(*by, F.round("coverage", 6).alias("coverage"), F.col("n_slots").cast("int").alias("n_slots"), "verbatim")
