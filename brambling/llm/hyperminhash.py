"""Near-duplicates by HyperMinHash: compressed registers, bands, and exact confirmation.

A document's shingle set keeps, for each of 512 buckets, the smallest hash as a 16-bit register: its
count of leading zeros and ten bits of mantissa.  Bands are keys over runs of registers (an empty
register borrows from a bucket that a fixed random order names, so short texts band as well as long
ones).  The number of bands leaves a pair at the threshold a chance below one in a million to share
none.

Pairs within a band are never all written.  Each band's members are compared, on full sets, with one
centre: the member that shares most bands with others.  What a member adds to and drops from its
centre is its difference.  Two members can only be linked to each other, and not both to the centre,
if their differences share more than half of the smaller one; so a join on the rarest elements of
differences (a prefix filter, exact) finds every such pair.  Those pairs are estimated from their
registers, corrected for chance agreement, and the rest is confirmed on full sets.  Components come
from alternating large-star and small-star steps.  Exact copies are one node from the start.

Defined results: null and word-less texts have an empty set and are linked with nothing, as are rows
with a null ``doc_id`` (component null, kept); repeated rows share one result; ties go to the
smallest ``doc_id``; an empty table gives no rows; other columns are ignored.  A ``doc_id`` names one
document: where it repeats with different texts, each row is judged by its own text, and a component
is named by the smallest ``doc_id`` that is the first of one of its texts.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_texts, prepare, require, tidily
from .shingles import mixed, shingle_sets

BUCKET_BITS = 9
BUCKETS = 1 << BUCKET_BITS
MANTISSA_BITS = 10
#: Registers in a band, and the chance that a pair at the threshold shares no band.
BAND_ROWS = 7
MISS = 1e-6
#: Standard deviations that an estimate may lie below the threshold.
MARGIN = 6.0
#: Ids that are broadcast at most, to pick documents without a shuffle of texts or registers.
BROADCAST_IDS = 1_000_000
#: Rows of one key that one task takes in a join that gives each of them a set, registers or a name.
KEY_ROWS = 1024
_EMPTY = np.uint16(0)
_PROBES = 24


def bands_for(percent: int) -> int:
    """Bands that a pair of just this similarity misses with a chance of at most MISS."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** BAND_ROWS))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 512 registers for each sorted set; 0 is an empty bucket."""
    out = np.zeros(len(sets) * BUCKETS, np.uint16)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    if len(flat):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = owner * BUCKETS + (flat >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        smallest = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        # 53 bits behind the bucket's are exact in a double, whose exponent counts the zeros.
        fraction, exponent = np.frexp(((flat[smallest] << np.uint64(BUCKET_BITS)) >> np.uint64(11)).astype(np.float64))
        mantissa = np.clip(((fraction - 0.5) * (2 << MANTISSA_BITS)).astype(np.int64), 0, (1 << MANTISSA_BITS) - 1)
        out[place[smallest]] = ((54 - exponent).astype(np.int64) << MANTISSA_BITS | mantissa).astype(np.uint16)
    return out.reshape(-1, BUCKETS)


@lru_cache(4)
def _orders(places: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place, a fixed random order of buckets, and each bucket's rank in it."""
    order = np.argsort(np.random.RandomState(11).rand(places, BUCKETS), axis=1)
    return order, np.argsort(order, axis=1)


def filled(rows: np.ndarray, places: int) -> np.ndarray:
    """``places`` registers a row, none empty unless all are."""
    order, rank = _orders(places)
    out = np.zeros((len(rows), places), np.uint16)
    out[:, : min(places, BUCKETS)] = rows[:, :places]
    for t in range(_PROBES):
        row, at = np.nonzero(out == _EMPTY)
        if not len(row):
            return out
        out[row, at] = rows[row, order[at, t]]
    row, at = np.nonzero(out == _EMPTY)
    for r in np.unique(row):
        full = np.flatnonzero(rows[r])
        if len(full):
            holes = at[row == r]
            out[r, holes] = rows[r, full[np.argmin(rank[holes][:, full], axis=1)]]
    return out


def band_keys(rows: np.ndarray, n_bands: int) -> np.ndarray:
    """A 64-bit key for each row and band."""
    parts = filled(rows, n_bands * BAND_ROWS).reshape(len(rows), n_bands, BAND_ROWS).astype(np.uint64)
    keys = np.broadcast_to(mixed(np.arange(n_bands, dtype=np.uint64) + np.uint64(1)), parts.shape[:2])
    for k in range(BAND_ROWS):
        keys = mixed(keys * np.uint64(3) + parts[:, :, k])
    return keys.view(np.int64)


@lru_cache(4096)
def chance_agreement(a: int, b: int) -> float:
    """Chance that registers of unrelated sets agree in one bucket; ``a``, ``b``: log sizes in steps."""
    zeros = np.arange(0, 40)[:, None]
    step = np.arange((1 << MANTISSA_BITS) // 16)[None, :] * 16  # sixteen cells have nearly one density
    low = 2.0 ** -(zeros + 1) * (1 + step / (1 << MANTISSA_BITS))
    width = 2.0 ** -(zeros + 1) / (1 << MANTISSA_BITS)
    total = 16 * np.ones_like(low)
    for size in (a, b):
        rate = math.exp(size / 4) / BUCKETS
        total *= np.exp(-rate * low) * -np.expm1(-rate * width) / -math.expm1(-rate)
    return float(total.sum())


def estimate(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int) -> tuple[float, int]:
    """(Jaccard similarity corrected for chance agreement, buckets it rests on)."""
    used = int(np.count_nonzero(a | b))
    if not used:
        return 0.0, 0
    agree = int(np.count_nonzero((a == b) & (a != _EMPTY)))
    p = chance_agreement(*sorted(round(4 * math.log(max(1, s))) for s in (size_a, size_b)))
    both = int(np.count_nonzero((a != _EMPTY) & (b != _EMPTY)))
    chance = p * max(0, both - agree) / max(1e-9, 1 - p)
    return max(0.0, (agree - chance) / used), used


def may_link(a: np.ndarray, b: np.ndarray, size_a: int, size_b: int, percent: int) -> bool:
    t = percent / 100
    similarity, used = estimate(a, b, size_a, size_b)
    return similarity >= t - MARGIN * math.sqrt(t * (1 - t) / max(1, used))


_SKETCHES = "doc_id long, n long, fp binary, registers binary"


def sketches(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Set size, fingerprint and registers of every row; sets that only copies can match have none."""
    # A set of n is linked with another set only if n / (n + 1) reaches the threshold.
    least = -(-percent // (100 - percent)) if percent < 100 else 1 << 62

    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets([t or "" for t in batch.column("text").to_pylist()], words)
        large = [i for i, s in enumerate(sets) if len(s) >= least]
        found: list[bytes | None] = [None] * len(sets)
        for i, row in zip(large, registers([sets[i] for i in large])):
            found[i] = row.tobytes()
        prints = [xxhash.xxh3_128_digest(s) if len(s) else None for s in sets]
        arrays = [pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), pa.array(found, pa.binary())]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "n", "fp", "registers"])

    return map_texts(require(docs, "doc_id", "text"), sketch, _SKETCHES)


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, BUCKETS)


def banded(reps: DataFrame, n_bands: int) -> DataFrame:
    """``key, id``: one row for each band of each representative."""

    def spread(batch: pa.RecordBatch):
        keys = band_keys(_rows_of(batch.column("registers")), n_bands)
        ids = np.repeat(batch.column("id").to_numpy(), n_bands)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(ids)], names=["key", "id"])

    return reps.select("id", "registers").mapInArrow(lambda batches: tidily(batches, spread), "key long, id long")


def centres(bands: DataFrame) -> DataFrame:
    """``centre, id, top``: comparisons to make, and the best centre of each member."""
    shared = bands.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    hits = checkpointed(bands.join(shared, "key"))
    degree = hits.groupBy("id").agg(F.sum("c").alias("degree"))
    best = hits.join(degree, "id").groupBy("key").agg(F.max(F.struct("degree", (-F.col("id")).alias("minus"))).alias("best"))
    pairs = hits.select("key", "id").join(best, "key").select("id", "best").distinct()
    tops = pairs.groupBy("id").agg(F.max("best").alias("top"))
    return pairs.join(tops, "id").filter(F.col("id") != -F.col("best.minus")).select((-F.col("best.minus")).alias("centre"), "id", (-F.col("top.minus")).alias("top"))


def _small(ids: DataFrame) -> DataFrame:
    """Ids to be broadcast if they are few enough; joined by a shuffle otherwise."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _hot(rows: DataFrame, key: str) -> DataFrame | None:
    """``key, parts_``: keys of more than KEY_ROWS rows, and the parts they are cut into; None if there are none."""
    large = rows.groupBy(key).agg(F.count("*").alias("c")).filter(F.col("c") > KEY_ROWS)
    hot = checkpointed(large.select(key, F.ceil(F.col("c") / KEY_ROWS).cast("int").alias("parts_")))
    return None if hot.isEmpty() else hot


def _looked_up(rows: DataFrame, table: DataFrame, key: str, hot: DataFrame | None, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with the one row of ``table`` for their key.

    A hot key's rows are dealt to its parts by a hash of ``by``, and its row of the table is copied for
    each part; so no task takes much more than KEY_ROWS rows of a key, and few rows are copied.
    """
    if hot is None:
        return rows.join(table, key, how)
    hot = _small(hot)
    dealt = rows.join(hot, key, "left").withColumn("part_", F.coalesce(F.pmod(F.xxhash64(*by), F.col("parts_")), F.lit(0)).cast("int"))
    copied = table.join(hot, key, "left").withColumn("part_", F.explode(F.sequence(F.lit(0), F.coalesce("parts_", F.lit(1)) - 1)))
    return dealt.drop("parts_").join(copied.drop("parts_"), [key, "part_"], how).drop("part_")


def full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """``id, hashes, fp``: the whole shingle sets of the given documents."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets([t or "" for t in batch.column("text").to_pylist()], words)
        arrays = [pa.array([f(s) for s in sets], pa.binary()) for f in (np.ndarray.tobytes, xxhash.xxh3_128_digest)]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["id", "hashes", "fp"])

    chosen = require(docs, "doc_id", "text").join(_small(ids).withColumnRenamed("id", "doc_id"), "doc_id", "left_semi")
    return map_texts(chosen, cut, "id long, hashes binary, fp binary")


def _several_texts(known: DataFrame) -> bool:
    """Whether any document has different sets."""
    mark = F.xxhash64("fp")
    each = known.filter("fp is not null and doc_id is not null").groupBy("doc_id").agg(F.min(mark).alias("low"), F.max(mark).alias("high"))
    return not each.filter("low != high").isEmpty()


def _by_node(rows: DataFrame, first: DataFrame) -> DataFrame:
    """One row for each node, from rows of its first document with its own set."""
    rest = [c for c in rows.columns if c not in ("id", "fp")]
    nodes = first.withColumnRenamed("owner", "id")
    return rows.join(nodes, ["id", "fp"]).groupBy("node").agg(F.any_value(F.struct(*rest)).alias("row_")).select(F.col("node").alias("id"), "row_.*")


def _named(found: DataFrame, first: DataFrame) -> DataFrame:
    """``node, component``: components of nodes, named by the smallest first document."""
    every = checkpointed(found.unionByName(found.select(F.col("component").alias("id"), "component").distinct()).withColumnRenamed("id", "node"))
    names = every.join(first, "node").groupBy("component").agg(F.min("owner").alias("name"))
    return every.join(names, "component").select("node", F.col("name").alias("component"))


def _one_text(rows: DataFrame, again: bool) -> DataFrame:
    """One row for each id, where rows repeat."""
    rest = [c for c in rows.columns if c not in ("id", "fp")]
    if not again:
        return rows.select("id", *rest)
    return rows.groupBy("id").agg(F.min_by(F.struct(*rest), "fp").alias("row_")).select("id", "row_.*")


Hot = dict[str, DataFrame | None]


def _both(pairs: DataFrame, table: DataFrame, a: str, b: str, hot: Hot, **columns: str) -> DataFrame:
    """Pairs with columns of both members' rows: ``columns`` says what each is called, before ``_a`` or ``_b``."""
    for key, side in ((a, "a"), (b, "b")):
        named = table.select(F.col("id").alias(key), *[F.col(c).alias(f"{name}_{side}") for c, name in columns.items()])
        pairs = _looked_up(pairs, named, key, hot.get(key), [a, b])
    return pairs


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def _row_by_row(batches, function, schema: pa.Schema):
    """Rows of a batch one at a time: two whole sets are all that is held."""

    def judged(batch: pa.RecordBatch):
        columns = [batch.column(i) for i in range(batch.num_columns)]
        rows = [r for i in range(batch.num_rows) if (r := function(dict(zip(batch.schema.names, (c[i].as_py() for c in columns)))))]
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return tidily(batches, judged)


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Members beside their centres: whether linked, both sizes, and the difference."""
    # A member has at most one centre for each band; a centre may have any number of members.
    hot = {"centre": _hot(pairs, "centre")}
    schema = pa.schema([("centre", pa.int64()), ("id", pa.int64()), ("top", pa.int64()), ("linked", pa.bool_()), ("n_centre", pa.int64()), ("n", pa.int64()), ("difference", pa.list_(pa.int64()))])

    def judge(r: dict) -> dict:
        x, y = (np.frombuffer(r[k], np.uint64) for k in ("set_a", "set_b"))
        gap = np.setxor1d(x, y, assume_unique=True).view(np.int64)
        return {"centre": r["centre"], "id": r["id"], "top": r["top"], "linked": _linked(x, y, percent), "n_centre": len(x), "n": len(y), "difference": gap}

    return _both(pairs, sets, "centre", "id", hot, hashes="set").mapInArrow(
        lambda batches: _row_by_row(batches, judge, schema),
        "centre long, id long, top long, linked boolean, n_centre long, n long, difference array<long>",
    )


def _overlap(d_a: Column, d_b: Column, n_a: Column, n_b: Column, tau: float) -> Column:
    """Least overlap of two differences whose sets are linked."""
    return F.ceil((d_a + d_b - tau * (n_a + n_b)) / 2 - 1e-9)


def member_pairs(stars: DataFrame, percent: int) -> DataFrame:
    """``a, b``: members that may be linked to each other though one isn't linked to their centre."""
    tau = (100 - percent) / (100 + percent)
    groups = stars.groupBy("centre").agg(F.count("*").alias("members"), F.count_if(~F.col("linked")).alias("loose")).filter("members > 1 and loose > 0")
    d = F.size("difference")
    # Any partner that isn't linked to the centre shares more than this many elements.
    least = F.floor(d / 2 + tau / 2 * (F.col("n_centre") - F.col("n")) - 1e-9) + 1
    own = stars.join(_small(checkpointed(groups.select("centre"))), "centre").withColumns({"d": d, "prefix": d - least + 1})
    spread = own.select("centre", "id", F.explode("difference").alias("h"))
    common = spread.groupBy("centre", "h").agg(F.count("*").alias("c")).filter("c > 1")
    # Elements of one member come first in its order; they are counted, never joined.
    ranked = spread.join(common, ["centre", "h"]).groupBy("centre", "id").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("ordered"))
    facts = own.select("centre", "id", "top", "linked", "n", "d", "prefix")
    placed = checkpointed(
        ranked.join(facts, ["centre", "id"])
        .select("centre", "id", "top", "linked", "n", "d", "prefix", (F.col("d") - F.size("ordered")).alias("single"), F.posexplode("ordered").alias("at", "e"))
        .select("centre", F.col("e.h").alias("h"), "id", "top", "linked", "n", "d", "prefix", (F.col("single") + F.col("at")).alias("at"))
    )
    left = placed.filter("at < prefix").select("centre", "h", *[F.col(c).alias(f"{c}_a") for c in ("id", "top", "linked", "n", "d", "at")])
    right = placed.filter("not linked").select("centre", "h", *[F.col(c).alias(f"{c}_b") for c in ("id", "top", "n", "d", "at")])
    o = _overlap(F.col("d_a"), F.col("d_b"), F.col("n_a"), F.col("n_b"), tau)
    joined = left.join(right, ["centre", "h"]).filter(
        (F.col("id_a") != F.col("id_b"))
        & (F.col("linked_a") | (F.col("id_a") < F.col("id_b")))
        # Members of one best centre are compared there alone.
        & ((F.col("top_a") != F.col("top_b")) | (F.col("top_a") == F.col("centre")))
        & (100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        # The first shared element leaves enough elements behind it in both.
        & (F.col("at_a") <= F.col("d_a") - o)
        & (F.col("at_b") <= F.col("d_b") - o)
    )
    return joined.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b")).distinct()


def estimated(pairs: DataFrame, reps: DataFrame, percent: int, hot: Hot) -> DataFrame:
    """Pairs whose corrected estimate reaches the threshold, less a margin."""

    def judged(batch: pa.RecordBatch):
        x, y = _rows_of(batch.column("r_a")), _rows_of(batch.column("r_b"))
        sizes = zip(batch.column("n_a").to_pylist(), batch.column("n_b").to_pylist())
        good = [may_link(p, q, m, n, percent) for p, q, (m, n) in zip(x, y, sizes)]
        yield batch.select(["a", "b"]).filter(pa.array(good))

    beside = _both(pairs, reps, "a", "b", hot, n="n", registers="r")
    return beside.mapInArrow(lambda batches: tidily(batches, judged), "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, hot: Hot) -> DataFrame:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def judge(r: dict) -> dict | None:
        x, y = (np.frombuffer(r[k], np.uint64) for k in ("set_a", "set_b"))
        return {"a": r["a"], "b": r["b"]} if _linked(x, y, percent) else None

    return _both(pairs, sets, "a", "b", hot, hashes="set").mapInArrow(lambda batches: _row_by_row(batches, judge, schema), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``id, component``: smallest id reachable, for every id in a link, by large and small stars."""
    edges = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct())
    seen = None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        seen = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        step = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = checkpointed(step.filter("u != v").distinct())


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: documents linked at ``percent`` Jaccard similarity or more."""
    prepare(docs.sparkSession)
    known = checkpointed(sketches(docs, words, percent))
    named = known.filter("fp is not null and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("owner"), F.count("*").alias("c"))
    # Every row with the first document of its set: copies are one node from here on.
    several = _several_texts(known)
    # A document has a node for each of its texts, where it has several.
    named = checkpointed(named.withColumn("node", F.monotonically_increasing_id() if several else F.col("owner")))
    first, key = named.drop("c"), "node" if several else "owner"
    large = checkpointed(named.filter(F.col("c") > KEY_ROWS).withColumn("parts_", F.ceil(F.col("c") / KEY_ROWS).cast("int")))
    copied = not large.isEmpty()
    own = [F.when(F.col("doc_id").isNotNull(), F.col(c)).alias(c) for c in (["owner", "node"] if several else ["owner"])]
    rows = known.select("doc_id", "n", "fp")
    wordy = _looked_up(rows.filter("fp is not null"), first, "fp", large.select("fp", "parts_") if copied else None, ["doc_id"], "left")
    wordless = rows.filter("fp is null").select("doc_id", "n", *[F.lit(None).cast("long").alias(c) for c in ("owner", "node")[: len(own)]])
    owned = checkpointed(wordy.select("doc_id", "n", *own).unionByName(wordless))
    sketched = known.filter("registers is not null and doc_id is not null").select(F.col("doc_id").alias("id"), "n", "registers", "fp")
    if several:
        reps = checkpointed(_by_node(sketched, first))
    else:
        copies = owned.filter("doc_id != owner").select(F.col("doc_id").alias("id")).distinct()
        again = not owned.filter("doc_id = owner").groupBy("doc_id").count().filter("count > 1").isEmpty()
        reps = _one_text(sketched.join(_small(copies), "id", "left_anti"), again)
    pairs = checkpointed(centres(banded(reps, bands_for(percent))))
    ids = checkpointed(pairs.select("id").unionByName(pairs.select(F.col("centre").alias("id"))).distinct())
    if several:
        owners = ids.join(first.withColumnRenamed("node", "id"), "id").select(F.col("owner").alias("id")).distinct()
        sets = checkpointed(_by_node(full_sets(docs, owners, words), first))
    else:
        sets = checkpointed(_one_text(full_sets(docs, ids, words), again))
    stars = checkpointed(compared(pairs, sets, percent))
    maybe = checkpointed(member_pairs(stars, percent))
    hot = {side: _hot(maybe, side) for side in ("a", "b")}
    others = estimated(maybe, reps, percent, hot)
    links = stars.filter("linked").select(F.col("centre").alias("a"), F.col("id").alias("b")).unionByName(confirmed(others, sets, percent, hot))
    found = components(links)
    found = _named(found, first) if several else found.withColumnRenamed("id", "owner")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "owner", "doc_id"))
    alone = owned.filter(F.col(key).isNull()).withColumn("component", F.lit(None).cast("long"))
    parts = large.select(key, "parts_") if copied else None
    together = _looked_up(owned.filter(F.col(key).isNotNull()), found, key, parts, ["doc_id"], "left").unionByName(alone)
    placed = together.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return placed.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, whole rows, with one of each group; repeated rows are one document.

    An id with different texts stays whole where any of its rows is kept.
    """
    found = checkpointed(near_duplicates(docs, words, percent)).filter("doc_id is not null").groupBy("doc_id")
    judged = checkpointed(found.agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")))
    kept = docs.join(_small(judged.filter("not kept").select("doc_id")), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    if judged.filter("kept and n > 1").isEmpty():
        return kept
    unnamed = kept.filter("doc_id is null")
    return kept.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(unnamed)


def op5(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)
