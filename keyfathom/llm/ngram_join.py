"""Similarity join on word shingles by vertical partitioning, exact at any group size.

All shingles have one global order, the rare before the frequent.  It comes from a sketch of
counts over all documents, of fixed size, so the order costs no shuffle of shingles; any total
order gives right results, a good one gives short lists.  Two sets that are similar share one of
the first shingles of both, which yields candidates.  The order is cut into fragments; the overlap
of a candidate pair is counted in each fragment alone, from the two segments, and summed.

Equal sets are one vertex.  In a first round the members of each list of sets sharing a shingle are
compared with its leader, the set with the fewest rarer shingles, and in some lists with their
neighbours.  A second round compares all remaining pairs of a list that the first has not joined into
one component; so no link between components can be missed, and a large group of near copies costs
about as many pairs as it has members.  Pairs whose parity maps lie too far apart are not similar and
go without a count: first maps of one size, which long sets fill, then maps that grow with the set, an
eighth of a byte to a quarter for each shingle where the shingles themselves have eight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyfathom.llm.common import components, release, stage

#: Buckets of the sketch; their number does not depend on the data.
BUCKETS = 1 << 17
FRAGMENTS = 4
#: Bits of the filter that keeps sets without partners from being shuffled.
FILTER_BITS = 1 << 22
#: Bits of a set's small parity map: two maps differ in no more bits than the sets in elements.
PARITY_BITS = 512
#: Bits of the largest map of a set.
MOST_BITS = 1 << 24
#: Longer lists are passed on without a look at their pairs.
LOOKED_AT = 32
#: One list in so many also compares each member with the one before it.
NEIGHBOURS = 8
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; fewer words make one shingle, none an empty set."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, "u8")
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in found], "u8")
    size = min(words, len(hashed))
    count = len(hashed) - size + 1
    out = np.full(count, size, "u8")
    for k in range(size):
        out = (out ^ hashed[k:k + count]) * np.uint64(_MIX[k % 5])
        out ^= out >> np.uint64(29)
    return np.unique(out)


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles % np.uint64(BUCKETS)).astype("int64")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), 
                       F.col(text_col).cast("string").cast("binary").alias("text"))


def global_order(texts: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of each bucket, fragment of each bucket) in the order from rare to frequent.

    Counts cover every document.  At most BUCKETS numbers come to the driver.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        total = np.zeros(BUCKETS, "int64")
        for batch in batches:
            for text in batch.column(0):
                total += np.bincount(_bucket(shingle_set(text.as_py(), words)), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    found = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(
        F.sum("n").alias("n")).toPandas()
    total = np.zeros(BUCKETS, "int64")
    total[found["bucket"].to_numpy("int64")] = found["n"].to_numpy("int64")
    order = np.argsort(total, kind="stable")
    place = np.empty(BUCKETS, "int32")
    place[order] = np.arange(BUCKETS, dtype="int32")
    mass = np.cumsum(total[order])
    fragment = np.empty(BUCKETS, "int8")
    fragment[order] = np.minimum(FRAGMENTS - 1, (mass - total[order]) * FRAGMENTS // max(1, mass[-1]))
    return place, fragment


def _ordered(shingles: np.ndarray, place: np.ndarray) -> np.ndarray:
    return shingles[np.lexsort((shingles, place[_bucket(shingles)]))]


def _set_id(shingles: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).astype("int64"))


def _parity(shingles: np.ndarray) -> np.ndarray:
    """Bit k tells whether an odd number of shingles falls into cell k."""
    cells = np.bincount((shingles >> np.uint64(40)).astype("int64") % PARITY_BITS, minlength=PARITY_BITS) & 1
    return np.packbits(cells.astype("u1")).view("<i8")


def set_map(shingles: np.ndarray) -> bytes:
    """A parity map with as many cells as shingles or more: a power of two, so that maps of two sizes can be compared."""
    size = min(MOST_BITS, max(PARITY_BITS, 1 << max(0, len(shingles) - 1).bit_length()))
    cells = np.bincount((shingles >> np.uint64(40)).astype("int64") & size - 1, minlength=size) & 1
    return np.packbits(cells.astype("u1")).tobytes()


def map_distance(left: bytes, right: bytes) -> int:
    """Bits in which two maps differ, the larger folded to the size of the smaller: at most the elements they differ in."""
    a, b = sorted((np.frombuffer(left, "u8"), np.frombuffer(right, "u8")), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def set_prefixes(texts: DataFrame, place: np.ndarray, words: int, percent: int) -> DataFrame:
    """(doc_id, sid, n, parity, map, prefix): each set's id, size, parity maps and shingles a partner must share one of.

    A set met before in the same task has a null prefix: copies are thinned before any shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        met: set[int] = set()
        for batch in batches:
            sids, sizes, parities, maps, prefixes = [], [], [], [], []
            for doc, text in zip(*batch.columns, strict=True):
                shingles = shingle_set(text.as_py(), words)
                n, sid = len(shingles), _set_id(shingles)
                sids.append(sid)
                sizes.append(n)
                if sid in met or not n or not doc.is_valid:
                    parities.append(None)
                    maps.append(None)
                    prefixes.append(None)
                    continue
                if len(met) > 1_000_000:
                    met.clear()
                met.add(sid)
                parities.append(_parity(shingles))
                maps.append(set_map(shingles))
                prefixes.append(_ordered(shingles, place)[:n - (percent * n + 99) // 100 + 1].view("i8"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()),
                 pa.array(parities, pa.list_(pa.int64())), pa.array(maps, pa.binary()),
                 pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "sid", "n", "parity", "map", "prefix"])

    return texts.mapInArrow(run, "doc_id long, sid long, n int, parity array<long>, map binary, prefix array<long>")


SHARED = ("shingle long, pos int, n int, sid long, lead_pos int, lead_n int, lead_sid long, "
          "next_pos int, next_n int, next_sid long")


def _has_partner(run: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> np.ndarray:
    """Whether another row of the same run could be similar, by sizes and places; long runs all may."""
    found = np.zeros(len(run), bool)
    size = np.bincount(run)[run]
    for step in range(1, LOOKED_AT):
        i = np.flatnonzero((size[:-step] <= LOOKED_AT) & (run[:-step] == run[step:]))
        if not len(i):
            break
        j = i + step
        fits = ((np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
                & (np.minimum(n[i] - pos[i], n[j] - pos[j]) * (100 + percent) >= (n[i] + n[j]) * percent))
        found[i[fits]] = True
        found[j[fits]] = True
    return found | (size > LOOKED_AT)


def shared_lists(sets: DataFrame, percent: int) -> DataFrame:
    """Members of all lists with two sets or more, each with its list's leader and the member before it.

    Lists are sorted ranges of (shingle, pos, n, sid), so a long one is spread over tasks, each
    with a leader of its own.  Members that no other of their list could be similar to go; the lists
    at the ends of a batch are kept whole, since the rest of them is not in sight.
    """
    names = SHARED.replace(",", "").split()[::2]

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        def emit(rows: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c[keep], pa.int64() if i in (0, 3, 6, 9) else pa.int32()) for i, c in enumerate(rows)],
                names=names)

        last = None  # the row held back, with its leader and the one before it
        last_shared = True  # the first row of a task is kept
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.asarray(c) for c in batch.columns]
            if last is not None:
                rows = [np.concatenate([a, b]) for a, b in zip(last, rows)]
            copies = np.r_[False, (rows[0][1:] == rows[0][:-1]) & (rows[3][1:] == rows[3][:-1])]
            rows = [c[~copies] for c in rows]
            same = np.r_[False, rows[0][1:] == rows[0][:-1]]
            run = np.cumsum(~same) - 1
            heads = np.flatnonzero(~same)
            carried = rows[:4]
            for i in (1, 2, 3):
                first = carried[i][heads]
                if last is not None:
                    first[0] = last[i + 3][0]
                rows.append(first[run])
            for i in (1, 2, 3):
                before = np.where(same, np.r_[carried[i][:1], carried[i][:-1]], carried[i])
                if last is not None:
                    before[0] = last[i + 6][0]
                rows.append(before)
            keep = same | np.r_[same[1:], False]
            keep[0] |= last_shared
            last_shared = bool(keep[-1])
            whole = (run != 0) & (run != run[-1])
            keep &= ~whole | _has_partner(run, rows[2].astype("int64"), rows[1].astype("int64"), percent)
            if keep[:-1].any():
                yield emit(rows, np.r_[keep[:-1], False])
            last = [c[-1:] for c in rows]
        if last is not None:
            yield emit(last, np.ones(1, bool))

    lists = sets.where("prefix IS NOT NULL").select("sid", "n", F.posexplode("prefix").alias("pos", "shingle"))
    return (lists.select("shingle", "pos", "n", "sid").repartitionByRange("shingle", "pos", "n", "sid")
            .sortWithinPartitions("shingle", "pos", "n", "sid").mapInArrow(stream, SHARED))


def _filter_words(wanted: DataFrame) -> np.ndarray:
    """A bitmap of hashed document ids: at most FILTER_BITS / 64 numbers come to the driver."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    found = wanted.groupBy(F.shiftright(bit, 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(pmod(xxhash64(doc_id), 64) AS INT))")).alias("bits")).toPandas()
    words = np.zeros(FILTER_BITS // 64, "i8")
    words[found["word"].to_numpy("int64")] = found["bits"].to_numpy("i8")
    return words


def segments(texts: DataFrame, wanted: DataFrame, fragment: np.ndarray, words: int) -> DataFrame:
    """(sid, fragment, segment): the sorted shingles of each wanted set, apart by fragment.

    wanted: (doc_id, sid), one document per set.  Most other sets are passed over by a filter of
    fixed size, so nothing is shuffled here; the join with pairs leaves out what else came through.
    """
    bits = _filter_words(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            out: list[tuple] = []
            for text, mark in zip(*batch.columns, strict=True):
                mark = mark.as_py()
                if not bits[mark % FILTER_BITS >> 6] >> (mark & 63) & 1:
                    continue
                shingles = shingle_set(text.as_py(), words)
                sid, parts = _set_id(shingles), fragment[_bucket(shingles)]
                for f in np.unique(parts).tolist():
                    out.append((sid, f, shingles[parts == f].tobytes()))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)],
                names=["sid", "fragment", "segment"])

    marked = texts.where("doc_id IS NOT NULL").select("text", F.xxhash64("doc_id").alias("mark"))
    return marked.mapInArrow(run, "sid long, fragment int, segment binary")


def verified(pairs: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) that are similar: partial overlaps per fragment, summed per pair."""

    def overlap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            counts = [len(np.intersect1d(np.frombuffer(x.as_py(), "u8"), np.frombuffer(y.as_py(), "u8"), True))
                      for x, y in zip(batch.column(5), batch.column(6), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(counts, pa.int32())],
                                             names=["a", "b", "na", "nb", "fragment", "common"])

    left = parts.select(F.col("sid").alias("a"), "fragment", F.col("segment").alias("left_part"))
    right = parts.select(F.col("sid").alias("b"), "fragment", F.col("segment").alias("right_part"))
    # Merged at every size: neither side has a bound that would allow a broadcast.
    joined = pairs.hint("merge").join(left, "a").join(right.hint("merge"), ["b", "fragment"]).select(
        "a", "b", "na", "nb", "fragment", "left_part", "right_part")
    counted = joined.mapInArrow(overlap, "a long, b long, na int, nb int, fragment int, common int")
    # A set that came from two documents gives equal counts twice; the maximum is one of them.
    return (counted.groupBy("a", "b", "na", "nb", "fragment").agg(F.max("common").alias("common"))
            .groupBy("a", "b", "na", "nb").agg(F.sum("common").alias("common"))
            .where(F.col("common") * (100 + percent) >= (F.col("na") + F.col("nb")).cast("long") * percent)
            .select("a", "b"))


def _near_parity(n: str, m: str, left: str, right: str, percent: int):
    """False only for pairs that cannot be similar: their sets differ in too many elements."""
    apart = F.lit(0)
    for k in range(PARITY_BITS // 64):
        apart = apart + F.bit_count(F.get(left, F.lit(k)).bitwiseXOR(F.get(right, F.lit(k))))
    return apart.cast("long") * (100 + percent) <= (F.col(n) + F.col(m)).cast("long") * (100 - percent)


def near_maps(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, na, nb) without those whose maps, from known (sid, map), lie too far apart to be similar."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            sizes = batch.column(2).to_numpy().astype("int64") + batch.column(3).to_numpy()
            apart = np.array([map_distance(x.as_py(), y.as_py()) for x, y in zip(*batch.columns[4:], strict=True)], "int64")
            kept = pa.array(apart * (100 + percent) <= sizes * (100 - percent))
            yield batch.select(["a", "b", "na", "nb"]).filter(kept)

    left, right = (known.select(F.col("sid").alias(end), F.col("map").alias(f"map_{end}")).hint("merge") for end in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", "map_a", "map_b").mapInArrow(
        near, "a long, b long, na int, nb int")


def compared(pairs: DataFrame, sets: DataFrame, texts: DataFrame, fragment: np.ndarray, words: int, percent: int
             ) -> DataFrame:
    """The similar ones of the pairs; only sets that stand in a pair are cut into segments."""
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = stage(sets.where("doc_id IS NOT NULL").join(ends.hint("merge"), "sid", "left_semi").groupBy("sid").agg(
        F.min("doc_id").alias("doc_id")), "wanted-sets")
    return verified(pairs, stage(segments(texts, wanted, fragment, words), "segments"), percent)


def near_documents(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id): the smallest id reachable by links of similarity >= percent / 100.

    Null and empty texts have no shingles and link with nothing, nor do rows with a null id, whose
    component is null.
    Equal texts link; ties do not matter.  Other columns are not read.  An empty table gives no rows.
    Work is linear in the texts, plus the pairs of both rounds; four passes read the texts, since
    their sets are larger than the texts and are not stored.  Joins are merged at every size, as no
    side has a bound that would allow a broadcast.
    """
    texts = _texts(docs, id_col, text_col)
    place, fragment = global_order(texts, words)
    sets = stage(set_prefixes(texts, place, words, percent), "sets")
    lists = stage(shared_lists(sets, percent), "shared-lists")

    def fits(n: str, m: str, n_pos: str, m_pos: str):
        n, m, n_pos, m_pos = (F.col(c).cast("long") for c in (n, m, n_pos, m_pos))
        return ((F.least(n, m) * 100 >= F.greatest(n, m) * percent)
                & (F.least(n - n_pos, m - m_pos) * (100 + percent) >= (n + m) * percent))

    def partners(of: DataFrame, kind: str) -> DataFrame:
        return of.where(F.col("sid") != F.col(f"{kind}_sid")).where(fits("n", f"{kind}_n", "pos", f"{kind}_pos")).select(
            F.least("sid", f"{kind}_sid").alias("a"), F.greatest("sid", f"{kind}_sid").alias("b"))

    listed = lists.select("sid").distinct().hint("merge")
    known = stage(sets.where("prefix IS NOT NULL").join(listed, "sid", "left_semi").groupBy("sid").agg(
        F.first("n").alias("n"), F.first("parity").alias("parity"), F.first("map").alias("map")), "parities")
    first = partners(lists, "lead").unionByName(
        partners(lists.where(F.pmod("shingle", F.lit(NEIGHBOURS)) == 0), "next")).distinct()
    small = known.select("sid", "n", "parity")
    left, right = small.toDF("a", "na", "pa").hint("merge"), small.toDF("b", "nb", "pb").hint("merge")
    first = stage(first.join(left, "a").join(right, "b").where(
        _near_parity("na", "nb", "pa", "pb", percent)).select("a", "b", "na", "nb"), "first-candidates")
    tried = first.select("a", "b").hint("merge")
    first = stage(near_maps(first, known, percent), "first-pairs")
    links = stage(compared(first, sets, texts, fragment, words, percent), "first-links")
    roots = components(links, "first")

    members = lists.select("shingle", "sid", "n", "pos").join(
        roots.withColumnRenamed("id", "sid").hint("merge"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    members = stage(members, "members")
    mixed = members.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(
        "low < high").select("shingle")
    open_lists = members.join(mixed.hint("merge"), "shingle", "left_semi").join(
        known.select("sid", "parity").hint("merge"), "sid")
    x, y = open_lists.alias("x"), open_lists.alias("y")
    second = x.join(y.hint("merge"), (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.root") < F.col("y.root"))
                    & fits("x.n", "y.n", "x.pos", "y.pos")
                    & _near_parity("x.n", "y.n", "x.parity", "y.parity", percent)).select(
        F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"),
        F.when(F.col("x.sid") < F.col("y.sid"), F.col("x.n")).otherwise(F.col("y.n")).alias("na"),
        F.when(F.col("x.sid") < F.col("y.sid"), F.col("y.n")).otherwise(F.col("x.n")).alias("nb"))
    second = second.distinct().join(tried, ["a", "b"], "left_anti")
    second = stage(near_maps(second, known, percent), "second-pairs")
    links = links.unionByName(compared(second, sets, texts, fragment, words, percent))
    roots = components(links, "all")

    ends = roots.withColumnRenamed("id", "sid").hint("merge")
    rooted = sets.select("doc_id", "sid", "n").join(ends, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    rooted = stage(rooted, "rooted")
    least = rooted.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("least_id"))
    return rooted.join(least.hint("merge"), "root", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"),
        F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("least_id")).alias(
            "component_id"))
