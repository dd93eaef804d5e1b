"""Near-duplicates by Circulant MinHash, banding and exact Jaccard verification.

Signatures: one permutation places a shingle on a circle of D slots; a second
one, circularly shifted by k, gives coordinate k. So a shingle's part in all
coordinates is one contiguous slice of the second permutation.

Links: documents with the same shingle set are one node. Nodes meet in band
buckets; each bucket tests its members against its smallest member (a star, not
all pairs) on full shingle sets. Buckets that then still span several
components are settled exactly: their nodes are joined on the rarest quarter of
their shingles (a prefix filter loses no pair at the threshold), across
components only. So a link is lost only if two linked nodes share no bucket:
under 6e-6 at similarity 0.75, and far less above.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import arrow_rows, cut, mix, shingles, small, steps, text_shingles, utf8_buffers, word_bounds, word_hashes

WIDTH, NUM, DEN = 5, 75, 100
BANDS, ROWS = 32, 4
CIRCLE = 1 << 20
#: Distinct sets that a task remembers so that it sends the bands of a set once.
SEEN = 1 << 19
#: Nodes that share a prefix shingle beyond which its join is split further.
HOT = 2000
#: Slots of the table of shingle counts that orders prefixes (a 2 MB broadcast).
SLOTS = 1 << 18

_tables: dict = {}


def _circulant(width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first permutation, the slices of the second one)."""
    if width not in _tables:
        rng = np.random.default_rng(20)
        place, value = rng.permutation(CIRCLE).astype(np.uint32), rng.permutation(CIRCLE).astype(np.uint32)
        _tables[width] = place, np.lib.stride_tricks.sliding_window_view(np.concatenate([value, value[:width]]), width)
    return _tables[width]


def signature(sets: np.ndarray, width: int = BANDS * ROWS) -> np.ndarray:
    """The ``width`` circulant minima of one set of 64-bit hashes."""
    place, slices = _circulant(width)
    at = place[(sets >> np.uint64(44)).astype(np.int64)]
    out = slices[at[:4096]].min(axis=0)
    for i in range(4096, len(at), 4096):
        out = np.minimum(out, slices[at[i : i + 4096]].min(axis=0))
    return out


def text_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    data, at = utf8_buffers(column)
    for i, j in steps(at):
        part, off = data[at[i] : at[j]], at[i : j + 1] - at[i]
        if j == i + 1:
            yield text_shingles(part, width)
        else:
            starts, ends, first = word_bounds(part, off)
            yield from shingles(word_hashes(part, starts, ends), first, width)


def set_id(s: np.ndarray) -> int:
    """A 63-bit name of a shingle set (0: the empty set)."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        h = mix(np.array([mix(s).sum(dtype=np.uint64) ^ (s * np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64) * np.uint64(3) ^ np.uint64(len(s))], np.uint64))
    return int(h[0] >> np.uint64(1)) or 1


def features(docs: DataFrame, width: int = WIDTH, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n, node, bands): set size, set name and band keys of each text.
    The bands are null for an empty set, a null identifier, and a set that the
    same task has seen before."""
    arrow_rows(docs.sparkSession)
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
    powers = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, rows + 1)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            ids = b.column(0)
            named = ids.is_valid().to_numpy(zero_copy_only=False)
            ns, nodes, keys, lens, none = [], [], [], [0], []
            for k, s in enumerate(text_sets(b.column(1), width)):
                node = set_id(s)
                ns.append(len(s))
                nodes.append(node)
                new = bool(node) and bool(named[k]) and node not in seen
                none.append(not new)
                if new:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(node)
                    keys.append(signature(s, bands * rows))
                lens.append(len(keys) * bands)
            if keys:
                with np.errstate(over="ignore"):
                    flat = mix((np.stack(keys).reshape(-1, bands, rows).astype(np.uint64) * powers).sum(axis=2, dtype=np.uint64) ^ salt).reshape(-1).view(np.int64)
            else:
                flat = np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(flat), mask=pa.array(none, pa.bool_()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), lists], ["doc_id", "n", "node", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, node long, bands array<long>")


def connected(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp): for every node of the edges (a, b) the smallest node that
    it reaches. Alternating large-star and small-star rounds on aggregates and
    joins alone; a round's edges are a cut table."""
    at = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), name)

    def star(e: DataFrame, large: bool) -> DataFrame:
        """Large: a node's larger neighbours go to its smallest neighbour.
        Small: its smaller neighbours and itself do."""
        both = e.select(F.col("b").alias("u"), F.col("a").alias("v"))
        if large:
            both = both.union(e.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = both.join(least, "u")
        moved = moved.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")) if large else moved.select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return moved.where("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        r = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    was = state(at)
    while was[0]:
        at = cut(star(star(at, True), False), name)
        now = state(at)
        if now == was:
            break
        was = now
    return at.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(at.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())


def verified(pairs: DataFrame, texts: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """Of the node pairs (a, b, ...) those whose full sets are similar."""
    extra = [c for c in pairs.columns if c not in ("a", "b")]
    kinds = dict(pairs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_set = None, None
        for batch in batches:
            b_ids = batch.column("b").to_pylist()
            keep = np.zeros(batch.num_rows, bool)
            for k, s in enumerate(text_sets(batch.column("ta"), width)):
                if b_ids[k] != last:
                    last, last_set = b_ids[k], next(text_sets(batch.column("tb").slice(k, 1), width))
                x, y = s, last_set
                if den * min(len(x), len(y)) < num * max(len(x), len(y)):
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = den * both >= num * (len(x) + len(y) - both)
            yield batch.select(["a", "b", *extra]).filter(pa.array(keep))

    a = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    joined = pairs.join(a, "a").join(b, "b").select("a", "b", *extra, "ta", "tb")
    return joined.mapInArrow(run, ", ".join(["a long", "b long", *(f"{c} {kinds[c]}" for c in extra)]))


def prefixes(texts: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN) -> DataFrame:
    """(shingle, node, comp, n, i): of every text the shingles among which two
    texts at the threshold must share one, rarest first by a bounded table of
    counts over these texts; i is the shingle's place in that order."""
    spark = texts.sparkSession

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        for b in batches:
            for s in text_sets(b.column(0), width):
                np.add.at(held, (s & np.uint64(SLOTS - 1)).astype(np.int64), 1)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at])], ["slot", "n"])

    table = texts.select("text").mapInArrow(counts, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
    often = np.zeros(SLOTS, np.int64)
    often[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(often)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = shared.value
        for b in batches:
            out, lens = [np.zeros(0, np.uint64)], []
            for s in text_sets(b.column("text"), width):
                n = len(s)
                s = s[np.lexsort([s, rank[(s & np.uint64(SLOTS - 1)).astype(np.int64)]])][: n - -(-num * n // den) + 1]
                out.append(s)
                lens.append((len(s), n))
            times = np.array([k for k, _ in lens], np.int64)
            of = pa.array(np.repeat(np.arange(len(lens)), times))
            place = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            sizes = np.array([n for _, n in lens], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out).view(np.int64)), b.column("node").take(of), b.column("comp").take(of), pa.array(np.repeat(sizes, times)), pa.array(place)],
                ["shingle", "node", "comp", "n", "i"],
            )

    return texts.select("node", "comp", "text").mapInArrow(run, "shingle long, node long, comp long, n long, i long")


def posting_sides(posts: DataFrame, num: int = NUM, den: int = DEN, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """The two sides of the prefix join, with band and salt (0 and 0 unless more
    than ``hot`` nodes share the shingle). A hot shingle's nodes meet only those
    of a size at which they can be similar (a band of sizes and the two beside
    it), and one side is dealt over tasks, so that none has all of its pairs."""
    often = cut(posts.groupBy("shingle").agg(F.count("*").alias("nodes")).where(F.col("nodes") > hot), "hot-shingles")
    posts = posts.join(small(often), "shingle", "left")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(1.001 * max(float(np.log(den / num)), 1e-6))).cast("long")
    ways = F.ceil(F.col("nodes") / hot).cast("int")
    cold = F.col("nodes").isNull()
    x = posts.withColumn("salt", F.when(cold, 0).otherwise(F.pmod(F.xxhash64("node"), ways).cast("int")))
    x = x.withColumn("band", F.explode(F.when(cold, F.array(F.lit(0).cast("long"))).otherwise(F.array(band - 1, band, band + 1))))
    y = posts.withColumn("band", F.when(cold, F.lit(0).cast("long")).otherwise(band))
    y = y.withColumn("salt", F.explode(F.when(cold, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), ways - 1))))
    return x, y


def near_dedup(docs: DataFrame, width: int = WIDTH, num: int = NUM, den: int = DEN, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    component_id: the smallest identifier that the document reaches over links
    (100 * intersection >= 75 * union of distinct word shingles). A text
    without words, and a null text, has no shingles and links with nothing. A
    row with a null identifier links with nothing, its component_id is null and
    it is kept. Rows that repeat an identifier are judged each by its own text.
    Other columns are not read; an empty table gives an empty one.
    """
    feats = cut(features(docs, width, bands, rows), "features")
    keyed = feats.where("bands is not null").select(F.explode("bands").alias("key"), "node")
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").select("key", "hub")
    members = cut(keyed.join(hubs, "key"), "members")
    # each met node's text, by the smallest document that holds it
    met = members.select("node").distinct()
    holders = feats.where("bands is not null").groupBy("node").agg(F.min("doc_id").alias("holder"))
    holders = cut(met.join(holders, "node"), "holders")
    named = docs.select(F.col("doc_id").cast("long").alias("holder"), F.col("text").cast("string").alias("text"))
    texts = cut(_own(named.join(small(holders), "holder").select("node", "text"), width), "texts")

    pairs = members.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    comps = cut(connected(verified(pairs, texts, width, num, den), "star"), "comps")

    # buckets that still span components
    led = members.join(small(comps), "node", "left").select("key", "node", F.coalesce("comp", "node").alias("comp"))
    led = cut(led, "led")
    open_ = led.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    rest = cut(led.join(open_, "key").select("node", "comp").distinct(), "rest")
    if rest.limit(1).count():
        posts = cut(prefixes(texts.join(small(rest), "node"), width, num, den), "prefixes")
        x, y = posting_sides(posts, num, den)
        x = x.select("shingle", "band", "salt", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("i").alias("ia"))
        y = y.select("shingle", "band", "salt", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("i").alias("ib"))
        # at the first shingle that two texts share, none before it is shared, so
        # what they share is at most what is left of either: a bound on similarity
        left = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib"))
        same = (x["shingle"] == y["shingle"]) & (x["band"] == y["band"]) & (x["salt"] == y["salt"])
        more = x.join(y, same & (F.col("ca") < F.col("cb")) & (F.lit(den) * left >= F.lit(num) * (F.col("na") + F.col("nb") - left)))
        more = cut(more.select("a", "b", "ca", "cb").distinct(), "across")
        found = verified(more, texts, width, num, den).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        joined = cut(connected(found, "across"), "joined").select(F.col("node").alias("comp"), F.col("comp").alias("to"))
        known = led.select("node", "comp").distinct()
        comps = cut(known.join(small(joined), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "comps")

    rooted = feats.join(small(comps), "node", "left").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("comp", "node")).alias("root"))
    rooted = cut(rooted, "rooted")
    least = rooted.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).where("k > 1").drop("k")
    # a table of its own, so that the join is not tied to the aggregate's
    # partitions and large groups can be broken up
    least = cut(least, "least")
    out = rooted.join(small(least), "root", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _own(texts: DataFrame, width: int) -> DataFrame:
    """Of (node, text) the rows whose text has that node's set, one per node: an
    identifier that several rows share brings in other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [set_id(s) == n for s, n in zip(text_sets(b.column("text"), width), b.column("node").to_pylist())]
            yield b.filter(pa.array(own, pa.bool_()))

    mine = texts.mapInArrow(run, "node long, text string")
    return mine.withColumn("i", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("text")))).where("i = 1").drop("i")


def dedup_pipeline(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the document with the
    smallest identifier (rows that repeat it stay all). Columns as in docs."""
    gone = cut(near_dedup(docs).where(~F.col("kept")).select(F.col("doc_id").alias("gone_")).distinct(), "gone")
    return docs.join(small(gone), docs["doc_id"] == F.col("gone_"), "left_anti")


ORACLE = """
with t as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) end) as x, len(w) as nw from t),
n as (select doc_id, len(x)::bigint as n, nw from s),
e as (select doc_id, unnest(x) as g from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.k >= 75 * (x.n + y.n - p.k) and (x.nw >= 5) = (y.nw >= 5)),
c as (
  with recursive r(a, b) using key (a) as (
    select doc_id, doc_id from n
    union
    select z.a, min(z.b) from (select l.b as a, r.b from r join l on r.a = l.a union all select l.a as a, r.b from r join l on r.a = l.b) z join recurring.r q on q.a = z.a where z.b < q.b group by z.a)
  select a, b from r)
select n.doc_id, n.n as n_shingles, c.b as component_id, n.doc_id = c.b as kept from n join c on c.a = n.doc_id
"""
