"""N-gram Jaccard join by vertical partitioning (operator 2).

1. A fixed-size count sketch of all shingles gives one global order: rare
   shingles first, ties by hash. Every document is its shingles in this order.
2. Equal sets become one class (partial aggregation, so thousands of copies of
   one text meet as a few rows).
3. Of a set of n shingles the first n - alpha + l are its prefix, where alpha is
   the least overlap and l = n / 20 + 1: linked sets share at least l (of the
   smaller) shingles of their prefixes. A shingle shared by many classes yields
   a star to two of them, not all pairs.
4. Pivots cut the global order into fragments. For each candidate pair the
   overlap is counted in each fragment by itself and summed.
5. Classes that are still in different components although they share enough of
   their prefixes are then compared: pair by pair (length and positional bounds
   first) where both components are small, else the larger one in blocks against
   its outsiders. A link inside a component can't change any component.

Sets are identified by a 64-bit hash and their size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import connected_components, cut_lineage, mix, slices, span_hashes, utf8, word_spans
from shoplens.session import bound_batches

SKETCH_BITS = 20          # 4 MB of counts, whatever the corpus
BITMAP_BITS = 24          # 2 MB, whatever the corpus; where it is full, the joins behind it do all the work
BLOCKS = 64
MORE_HUBS = 4             # stars of the second round
LARGE = 64                # components from this size on are compared with outsiders in blocks
BLOCK = 512               # documents on either side of a block
SHINGLE_BYTES = 1 << 19   # text that is hashed at a time: about 50 bytes of memory for each
_SEP = np.zeros(256, bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_ABSENT = np.uint64(0xE7037ED1A0B428DB)


def shingle_hashes(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles and the offsets of each row in them.

    A row with fewer words, but not none, has the whole sequence as its one.
    """
    data, offs = utf8(column)
    data = _LOWER[data]
    starts, ends, row = word_spans(_SEP[data], offs)
    n_rows = len(offs) - 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(n_rows + 1, np.int64)
    words = span_hashes(data, starts, ends)
    count = np.bincount(row, minlength=n_rows)
    first = np.concatenate([[0], np.cumsum(count)])
    place = np.arange(len(words)) - first[row]
    left = count[row] - place
    keep = (left >= k) | ((place == 0) & (left < k))
    at = np.flatnonzero(keep)
    out = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = left[at] > j
        out += np.where(inside, words[np.minimum(at + j, len(words) - 1)], _ABSENT) * _PLACE[j]
    per = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    return mix(out), np.concatenate([[0], np.cumsum(per)])


def _sketch(texts: DataFrame, k: int) -> np.ndarray:
    """Counts of shingle hashes by their top SKETCH_BITS bits, over all rows."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for part in slices(batches, max_bytes=SHINGLE_BYTES):
            h, _ = shingle_hashes(part.column("text"), k)
            total += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=1 << SKETCH_BITS)
        if total.any():
            small = np.minimum(total, np.iinfo(np.int32).max).astype("<i4").reshape(BLOCKS, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()),
                 pa.array([TaskContext.get().partitionId() % 64] * BLOCKS, pa.int32()),
                 pa.array([x.tobytes() for x in small], pa.binary())], ["block", "salt", "counts"])

    def add(key, pdf):
        total = sum(np.frombuffer(x, "<i4").astype(np.int64) for x in pdf["counts"])
        pdf = pdf.iloc[:1].copy()
        pdf["counts"] = [np.minimum(total, np.iinfo(np.int32).max).astype("<i4").tobytes()]
        return pdf[["block", "salt", "counts"]]

    schema = "block int, salt int, counts binary"
    out = texts.mapInArrow(count, schema).groupBy("block", "salt").applyInPandas(add, schema)
    out = out.groupBy("block").applyInPandas(add, schema)
    total = np.zeros((BLOCKS, (1 << SKETCH_BITS) // BLOCKS), np.int64)
    for r in out.collect():  # BLOCKS rows, 4 MB in all
        total[r["block"]] = np.frombuffer(r["counts"], "<i4")
    return total.ravel()


def _classes_of_order(sketch: np.ndarray) -> np.ndarray:
    """0 (about the average or rarer) to 63 (very common) for each slot."""
    mean = max(float(sketch.mean()), 1.0)
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(4 * np.log2(np.maximum(sketch, 1) / mean)), 0, 63).astype(np.uint8)


def _pivots(sketch: np.ndarray, order: np.ndarray, fragments: int) -> np.ndarray:
    """Cuts of the global order that leave about equal counts in each fragment."""
    mass = np.bincount(order.astype(np.int64), weights=sketch, minlength=64)
    ends = np.concatenate([[0.0], np.cumsum(mass)])
    cuts = []
    for f in range(1, fragments):
        want = ends[-1] * f / fragments
        c = min(int(np.searchsorted(ends, want, "right")) - 1, 63)
        part = (want - ends[c]) / mass[c] if mass[c] else 0.0
        cuts.append((c << 58) + int(part * (1 << 58)))
    return np.array(cuts, np.uint64)


def ordered(h: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Distinct shingles as numbers that sort in the global order."""
    cls = order[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    out = np.sort((cls << np.uint64(58)) | (h & np.uint64((1 << 58) - 1)))
    return out[np.concatenate([[True], out[1:] != out[:-1]])] if len(out) else out


def _set_id(tokens: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        total = np.add.reduce(mix(tokens)) ^ mix(np.array([len(tokens)], np.uint64))[0]
    return int(np.int64(np.uint64(mix(np.array([total], np.uint64))[0]).view(np.int64)))


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offs = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    flat = np.concatenate(parts).astype(np.uint64).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(flat))


def _bitmap(slots: DataFrame) -> np.ndarray:
    """Bitmap of fixed size of the column ``slot``; it reaches the driver in packed blocks."""
    block = 1 << 12  # longs

    def packed(key, pdf):
        words = np.zeros(block, np.int64)
        words[pdf["w"].to_numpy(np.int64) % block] = pdf["b"].to_numpy(np.int64)
        return pd.DataFrame({"block": [key[0]], "words": [words.tobytes()]})

    words = slots.select(F.expr("slot div 64").alias("w"), F.expr("shiftleft(1L, int(slot % 64))").alias("b")) \
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    for r in words.groupBy(F.expr(f"w div {block}").alias("block")).applyInPandas(
            packed, "block long, words binary").collect():
        out[r["block"] * block:(r["block"] + 1) * block] = np.frombuffer(r["words"], np.int64)
    return out.view(np.uint64)


def _bits(keys: DataFrame, key: str) -> np.ndarray:
    """Bitmap of hashed keys: a pre-filter, never a decision."""
    return _bitmap(keys.select(F.pmod(F.xxhash64(key), F.lit(1 << BITMAP_BITS)).alias("slot")))


def _hit(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return ((bits[slots >> 6] >> (slots & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


def _token_slot(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens) >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, fragments: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs`` (doc_id, text).

    Two rows link when 100 * |A & B| >= percent * |A | B| over their distinct
    k-word shingles; ``component_id`` is the smallest doc_id reachable by links.
    Null or wordless texts have the empty set: n_shingles 0, linked with
    nothing, own id. Rows of equal sets link (repeated rows, too). A null
    doc_id is a row like others, smallest only among nulls. Other columns of
    any name are ignored. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    texts = docs.select("doc_id", "text")
    sketch = _sketch(texts.select("text"), k)
    order = _classes_of_order(sketch)
    pivots = _pivots(sketch, order, fragments)
    shared = spark.sparkContext.broadcast(order)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=SHINGLE_BYTES):
            h, offs = shingle_hashes(part.column("text"), k)
            sid, size, heads = [], [], []
            for lo, hi in zip(offs[:-1], offs[1:]):
                t = ordered(h[lo:hi], shared.value)
                n = len(t)
                sid.append(_set_id(t) if n else None)
                size.append(n)
                heads.append(t[:n - -(-percent * n // 100) + n // 20 + 1])
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(sid, pa.int64()), pa.array(size, pa.int64()),
                 _lists(heads)], ["doc_id", "sid", "n", "head"])

    rows = cut_lineage(texts.mapInArrow(prefixes, "doc_id long, sid long, n long, head array<long>"))
    classes = cut_lineage(rows.where("sid is not null").groupBy("sid", "n")
                          .agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")))
    links = _links(texts, rows, classes, k, percent, shared, pivots)
    parts = connected_components(links)
    named = classes.select("sid", "n", "rep").join(parts.withColumnRenamed("node", "sid"), "sid", "left") \
        .withColumn("component", F.coalesce("component", "sid"))
    small = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(small, "component").select("sid", "n", "component_id")
    return rows.select("doc_id", "sid", "n").join(named, ["sid", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _least(n: Column, percent: int) -> Column:
    """Least size of a set that can link with one of size n; also the least overlap of the two."""
    return F.ceil(n * percent / 100).cast("long")


def _need(n: Column, percent: int) -> Column:
    """Shingles that the prefixes share at least if the smaller set has size n."""
    return F.least(F.floor(n / 20) + 1, _least(n, percent))


def _prefix(n: Column, percent: int) -> Column:
    """Size of the prefix of a set of size n."""
    return F.least(n - _least(n, percent) + F.floor(n / 20) + 1, n)


def _need_of_pair(na: Column, nb: Column, percent: int) -> Column:
    """Shingles that the prefixes of linked sets of these very sizes share at least.

    What both sets hold up to the end of the prefix that ends first lies in both
    prefixes; behind it the overlap is at most the rest of that set.
    """
    behind = F.greatest(na - _prefix(na, percent), nb - _prefix(nb, percent))
    return F.greatest(F.ceil(percent * (na + nb) / (100 + percent)) - behind, F.lit(1))


def _close(na: Column, nb: Column, percent: int) -> Column:
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def _links(texts: DataFrame, docs: DataFrame, classes: DataFrame, k: int, percent: int, shared, pivots: np.ndarray) -> DataFrame:
    """Links between classes that give the right components (module text, 3 to 5)."""
    spark = texts.sparkSession
    copied = spark.sparkContext.broadcast(_bits(classes.where("c > 1"), "sid"))
    slot = F.pmod(F.xxhash64("sid"), F.lit(1 << BITMAP_BITS)).alias("slot")
    known = docs.where("sid is not null").select("sid", "n", "head", slot)

    def pick(batches: Iterator[pa.RecordBatch], wanted: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = _hit(copied.value, batch.column("slot").to_numpy())
            yield batch.filter(pa.array(hit if wanted else ~hit)).select(["sid", "n", "head"])

    # only the prefixes of classes with several documents are moved to leave one of each
    several = known.mapInArrow(lambda batches: pick(batches, True), "sid long, n long, head array<long>") \
        .groupBy("sid", "n").agg(F.max("head").alias("head"))

    def spread(bits):
        def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    part = batch.slice(at, 2000)
                    heads = part.column("head")
                    tokens = heads.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                    lens = heads.value_lengths().to_numpy(zero_copy_only=False)
                    row = np.repeat(np.arange(len(lens)), lens)
                    pos = np.arange(len(tokens)) - np.repeat(np.cumsum(lens) - lens, lens)
                    if bits is not None:
                        keep = _hit(bits.value, _token_slot(tokens))
                        tokens, row, pos = tokens[keep], row[keep], pos[keep]
                    sid, n = (part.column(c).to_numpy(zero_copy_only=False)[row] for c in ("sid", "n"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in ((tokens.view(np.int64), pa.int64()), (sid, pa.int64()),
                                                     (n, pa.int64()), (pos, pa.int32()))],
                        ["token", "sid", "n", "pos"])
        # single documents are picked and spread in one pass: a task with two passes holds two Python processes
        schema = "token long, sid long, n long, pos int"
        return known.mapInArrow(lambda batches: explode(pick(batches, False)), schema).union(several.mapInArrow(explode, schema))

    shared_tokens = cut_lineage(spread(None).select("token").groupBy("token").agg(F.count("*").alias("c"))
                                .where("c > 1").select("token"))

    def token_slots(batches):
        for batch in batches:
            slots = _token_slot(batch.column("token").to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64())], ["slot"])

    bits = spark.sparkContext.broadcast(_bitmap(shared_tokens.mapInArrow(token_slots, "slot long")))
    met = spread(bits).join(shared_tokens, "token")
    met = cut_lineage(met)
    copied.destroy()
    bits.destroy()
    enough = met.groupBy("sid", "n").agg(F.count("*").alias("c")) \
        .where(F.col("c") >= _need(_least(F.col("n"), percent), percent)).select("sid")
    rows = cut_lineage(met.join(enough, "sid"))

    def hub(salt: int) -> Column:
        return F.min(F.struct(F.xxhash64("sid", F.lit(salt)).alias("h"), "sid", "n")).alias(f"hub{salt}")

    hubs = cut_lineage(rows.groupBy("token").agg(hub(1), hub(2)))
    near = rows.join(hubs, "token")

    def pair(hub: str) -> DataFrame:
        h = F.col(hub)
        return near.where((h["sid"] != F.col("sid")) & _close(h["n"], F.col("n"), percent)) \
            .select(*_pairs(F.col("sid"), F.col("n"), h["sid"], h["n"])) \
            .groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))

    def frequent(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.col("c") >= _need(F.least("na", "nb"), percent)).select("a", "b", "na", "nb")

    stars = cut_lineage(frequent(pair("hub1").union(pair("hub2"))).distinct())
    segments = _segments(texts, classes, rows, k, shared, pivots)
    links = _verify(stars, segments, percent)

    def undecided(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Rows whose shingle is in several components, with the largest of them there; all members."""
        parts = connected_components(links).withColumnRenamed("node", "sid")
        members = cut_lineage(rows.select("token", "sid", "n", "pos").join(parts, "sid", "left")
                              .withColumn("part", F.coalesce("component", "sid")).drop("component"))
        sizes = members.groupBy("token", "part").agg(F.count("*").alias("c"))
        mixed = sizes.groupBy("token").agg(F.max(F.struct("c", "part")).alias("m"), F.count("*").alias("p")) \
            .where("p > 1").select("token", F.col("m.part").alias("major"))
        return cut_lineage(members.join(mixed, "token")), members

    # stars once more: what lies outside a shingle's largest component meets several of its members
    open_rows, _ = undecided(links)
    seeds = range(3, 3 + MORE_HUBS)
    inner = open_rows.where("part = major").groupBy("token").agg(*[hub(i) for i in seeds])
    outer = open_rows.where("part <> major").join(inner, "token") \
        .select("sid", "n", F.explode(F.array_distinct(F.array(*[f"hub{i}" for i in seeds]))).alias("h"))
    more = _pairs(F.col("sid"), F.col("n"), F.col("h.sid"), F.col("h.n"))
    more = frequent(outer.where(_close(F.col("n"), F.col("h.n"), percent)).select(*more)
                    .groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))) \
        .join(stars.select("a", "b"), ["a", "b"], "left_anti")
    more = cut_lineage(more)
    links = cut_lineage(links.union(_verify(more, segments, percent)))
    tried = stars.select("a", "b").union(more.select("a", "b"))
    open_rows, members = undecided(links)
    docs_in = cut_lineage(members.select("sid", "n", "part").distinct())
    sizes = docs_in.groupBy("part").agg(F.count("*").alias("size"))
    sized = cut_lineage(open_rows.drop("major").join(sizes, "part"))
    # small components: pairs of documents, met at the first shingle that both prefixes hold
    x, y = sized.where(F.col("size") < LARGE).alias("x"), sized.where(F.col("size") < LARGE).alias("y")
    reach = F.least("x.pos", "y.pos") + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos"))
    left = F.least(_prefix(F.col("x.n"), percent) - F.col("x.pos"), _prefix(F.col("y.n"), percent) - F.col("y.pos"))
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.part") != F.col("y.part"))
                  & (F.col("x.sid") < F.col("y.sid")) & _close(F.col("x.n"), F.col("y.n"), percent)
                  & ((100 + percent) * reach >= percent * (F.col("x.n") + F.col("y.n")))
                  & (left >= _need_of_pair(F.col("x.n"), F.col("y.n"), percent)))
    rest = cut_lineage(rest.select(*_pairs(F.col("x.sid"), F.col("x.n"), F.col("y.sid"), F.col("y.n"))).distinct()
                       .join(tried, ["a", "b"], "left_anti"))
    heads = cut_lineage(sized.where(F.col("size") < LARGE).groupBy("sid").agg(F.collect_list("token").alias("head")))
    rest = rest.join(heads.select(F.col("sid").alias("a"), F.col("head").alias("ha")), "a") \
        .join(heads.select(F.col("sid").alias("b"), F.col("head").alias("hb")), "b") \
        .where(F.size(F.array_intersect("ha", "hb")) >= _need_of_pair(F.col("na"), F.col("nb"), percent)) \
        .select("a", "b", "na", "nb")
    # large components: their members in blocks against all outsiders that share enough with any of them
    large = sized.where(F.col("size") >= LARGE).select("token", F.col("part").alias("to"), F.col("size").alias("room")).distinct()
    outside = sized.join(large, "token").where("part <> to and struct(size, part) < struct(room, to)") \
        .groupBy("sid", "n", "to", "room").agg(F.count("*").alias("c")) \
        .where(F.col("c") >= _need(_least(F.col("n"), percent), percent))
    return links.union(_verify(rest, segments, percent)).union(_blocks(outside, docs_in, segments, percent))


def _blocks(outside: DataFrame, members: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """A link from each of ``outside`` (sid, to, room) to a member of ``to`` in each block that has one.

    Both sides are dealt into blocks of about BLOCK documents, so no group grows
    with a component; only links leave a block, at most one for each outsider.
    """
    outside = cut_lineage(outside.select("sid", "to", "room"))
    sides = outside.groupBy("to", "room").agg(F.count("*").alias("c")) \
        .select("to", F.ceil(F.col("room") / BLOCK).alias("blocks"), F.ceil(F.col("c") / BLOCK).alias("sides"))
    whole = segments.groupBy("sid").agg(F.flatten(F.collect_list("part")).alias("tokens"))

    def dealt(df: DataFrame, own: str, other: str, prefix: str) -> DataFrame:
        rows = df.join(sides, "to").select(
            "to", "sid", F.pmod(F.xxhash64("sid"), F.col(f"{own}s")).alias(own),
            F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}s") - 1)).alias(other)).join(whole, "sid")
        return rows.select(*[F.col(c).alias(prefix + c) for c in ("sid", "tokens", "to", "block", "side")])

    left = dealt(outside, "side", "block", "x_")
    right = dealt(members.select("sid", F.col("part").alias("to")), "block", "side", "y_")

    def compare(xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(xs) and len(ys):
            ids, lens = ys["y_sid"].to_numpy(), np.array([len(t) for t in ys["y_tokens"]])
            flat, starts = np.concatenate(ys["y_tokens"].to_list()), np.cumsum(lens) - lens
            for sid, tokens in zip(xs["x_sid"], xs["x_tokens"]):
                shared = np.add.reduceat(np.isin(flat, tokens), starts, dtype=np.int64)
                ok = np.flatnonzero(100 * shared >= percent * (lens + len(tokens) - shared))
                if len(ok):
                    out.append((min(sid, ids[ok[0]]), max(sid, ids[ok[0]])))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    keys = ("to", "block", "side")
    return cut_lineage(left.groupBy(*[f"x_{c}" for c in keys]).cogroup(right.groupBy(*[f"y_{c}" for c in keys])).applyInPandas(compare, "a long, b long"))


def _pairs(sid: Column, n: Column, other: Column, size: Column) -> list[Column]:
    return [F.least(sid, other).alias("a"), F.greatest(sid, other).alias("b"),
            F.when(sid < other, n).otherwise(size).alias("na"), F.when(sid < other, size).otherwise(n).alias("nb")]


def _segments(texts: DataFrame, classes: DataFrame, rows: DataFrame, k: int, shared, pivots: np.ndarray) -> DataFrame:
    """(sid, fragment, part): shingles of every class in ``rows``, cut at the pivots."""
    spark = texts.sparkSession
    wanted = rows.select("sid").distinct()
    reps = classes.select("sid", "rep").join(wanted, "sid").select(F.coalesce("rep", F.lit(-1)).alias("rep"))
    bits = spark.sparkContext.broadcast(_bits(reps, "rep"))
    slot = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long"))),
                  F.lit(1 << BITMAP_BITS))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _hit(bits.value, batch.column("slot").to_numpy())
            for part in slices([batch.filter(pa.array(keep))], max_bytes=SHINGLE_BYTES):
                h, offs = shingle_hashes(part.column("text"), k)
                sid, frag, segs = [], [], []
                for lo, hi in zip(offs[:-1], offs[1:]):
                    t = ordered(h[lo:hi], shared.value)
                    if not len(t):
                        continue
                    s = _set_id(t)
                    for f, piece in enumerate(np.split(t, np.searchsorted(t, pivots))):
                        if len(piece):
                            sid.append(s)
                            frag.append(f)
                            segs.append(piece)
                if sid:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(sid, pa.int64()), pa.array(frag, pa.int32()), _lists(segs)], ["sid", "fragment", "part"])

    cut_rows = texts.select(slot.alias("slot"), "text").mapInArrow(cut, "sid long, fragment int, part array<long>")
    out = cut_lineage(cut_rows.join(wanted, "sid").groupBy("sid", "fragment").agg(F.max("part").alias("part")))
    bits.destroy()
    return out


def _verify(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """Pairs whose overlaps, counted in each fragment and summed, reach the threshold."""
    left = segments.select(F.col("sid").alias("a"), "fragment", F.col("part").alias("pa"))
    right = segments.select(F.col("sid").alias("b"), "fragment", F.col("part").alias("pb"))
    partial = pairs.join(left, "a").join(right, ["b", "fragment"]) \
        .select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).cast("long").alias("o"))
    total = partial.groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("o"))
    return cut_lineage(total.where(100 * F.col("o") >= percent * (F.col("na") + F.col("nb") - F.col("o")))
                       .select("a", "b"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_aggregate(ws[i:i + 3], 'string_agg', ' ') AS g
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * o.o >= 85 * (p.n + q.n - o.o)),
r AS (SELECT a AS doc_id, least(a, b) AS c FROM l UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.doc_id)
SELECT w.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, least(w.doc_id, coalesce(min(r.c), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id
"""
