"""Language ID by Bayesian fusion of evidence.

The posterior of a language l given a record is proportional to

    prior(l | host) * P(text | l) ** tempered * P(declared | l) * P(suffix | l)

* text: hashed byte trigrams of the folded text, with probabilities counted
  over the whole corpus by declared language (grouped aggregation). Trigrams
  overlap, so the log likelihood is tempered: it counts as that of at most
  ``EVIDENCE`` independent trigrams. A background language with even
  probabilities stands for text of no known language.
* declared (a markup or column value) and suffix (last label of the address's
  host): how often each goes with a language, counted over all records by the
  language that the text alone says.
* prior: languages of the host's records, smoothed towards those of its site
  (the last two labels), and these towards the whole corpus.

A record's own verdict is left out of what its host, site, suffix and declared
value say about it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER, SEPARATOR, arrow_rows, cut, pieces, small, steps, utf8_buffers

#: Languages that need no support; others are read from the declared values.
LANGUAGES = ("de", "en", "es", "fr")
UNKNOWN = "und"
#: Codes that name no language: undetermined, several, none, not coded.
NO_LANGUAGE = (UNKNOWN, "mul", "zxx", "mis")
#: Records, and share of those that declare one, that a further language needs.
SUPPORT, SHARE = 20, 0.001
BUCKETS = 1 << 16
SMOOTH = 0.5
#: Independent trigrams that a text counts as at most, and per trigram it has.
EVIDENCE, TEMPER = 60.0, 0.33
#: Weight, in records, of what a host, a site and a declared value inherit.
INHERIT = 10.0
#: Posterior below which a record is rejected.
LEAST = 0.5


def trigrams(data: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first trigram of each text). White space, digits and ASCII
    punctuation count as one kind of separator, runs of which are one."""
    n = len(at) - 1
    flat = np.full(len(data) + 2 * n, 32, np.uint8)
    flat[np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, np.diff(at))] = _FOLD[data]
    keep = np.ones(len(flat), bool)
    gap = flat == 32
    keep[1:] = ~(gap[1:] & gap[:-1])
    edge = at + 2 * np.arange(n + 1)
    keep[edge[:-1][edge[:-1] < len(flat)]] = True
    kept = np.cumsum(keep)
    return _hashed(flat[keep], buckets), np.concatenate(([0], kept))[edge]


#: ASCII letters lower-cased, other ASCII a separator, bytes of longer
#: characters as they are.
_FOLD = LOWER.copy()
_FOLD[:128][~np.array([chr(c).isalpha() for c in range(128)])] = 32
_FOLD[SEPARATOR] = 32


def _spans(first: np.ndarray, n_ids: int) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of text i: a[i] to b[i]; none that spans two texts."""
    a = np.minimum(first[:-1], n_ids)
    return a, np.maximum(a, np.minimum(first[1:] - 2, n_ids))


def text_trigrams(data: np.ndarray, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """The trigrams of one text of any length, a piece at a time; each piece
    takes up the last two kept bytes of the one before."""
    held = np.full(1, 32, np.uint8)
    for lo, hi in pieces(len(data)):
        flat = np.concatenate([held, _FOLD[data[lo:hi]], np.full(int(hi == len(data)), 32, np.uint8)])
        gap = flat == 32
        flat = flat[~np.concatenate(([False], gap[1:] & gap[:-1]))]
        held = flat[-2:]
        yield _hashed(flat, buckets)


def _hashed(flat: np.ndarray, buckets: int) -> np.ndarray:
    flat = flat.astype(np.uint32)
    h = (flat[:-2] * np.uint32(2654435761)) ^ (flat[1:-1] * np.uint32(2246822519)) ^ (flat[2:] * np.uint32(3266489917))
    h ^= h >> np.uint32(15)
    return ((h * np.uint32(668265263)) >> np.uint32(16)).astype(np.int64) & (buckets - 1)


def language_of(value: Column) -> Column:
    """The language of a declared value: its part before - or _, lower-cased."""
    return F.lower(F.regexp_extract(F.coalesce(value.cast("string"), F.lit("")), r"^\s*([A-Za-z]+)", 1))


def trigram_counts(rows: DataFrame, languages: tuple[str, ...], buckets: int = BUCKETS) -> np.ndarray:
    """[languages, buckets] counts over all rows (declared, text). A task sends
    at most one row per language and bucket, and so does the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(languages), buckets), np.int64)
        for b in batches:
            which = np.array([languages.index(x) if x in languages else -1 for x in b.column(0).to_pylist()])
            data, at = utf8_buffers(b.column(1))
            for i, j in steps(at):
                if j == i + 1:
                    for ids in text_trigrams(data[at[i] : at[j]], buckets) if which[i] >= 0 else ():
                        held[which[i]] += np.bincount(ids, minlength=buckets)
                    continue
                ids, first = trigrams(data[at[i] : at[j]], at[i : j + 1] - at[i], buckets)
                x, y = _spans(first, len(ids))
                owner = np.full(len(ids), -1)
                lens = y - x
                where = np.repeat(x - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())
                owner[where] = np.repeat(which[i:j], lens)
                for k in range(len(languages)):
                    held[k] += np.bincount(ids[owner == k], minlength=buckets)
        k, at_ = np.nonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(at_.astype(np.int32)), pa.array(held[k, at_])], ["k", "bucket", "n"])

    sums = rows.select("declared", "text").mapInArrow(run, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((len(languages), buckets))
    out[sums.column("k").to_numpy(), sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def declared_languages(rows: DataFrame) -> tuple[str, ...]:
    """LANGUAGES and all others that enough rows declare, in alphabetic order;
    rows (declared: a language or the empty string). At most 1 / SHARE others."""
    each = cut(rows.where(~F.col("declared").isin("", *NO_LANGUAGE)).groupBy("declared").agg(F.count("*").alias("n")), "declared")
    total = each.agg(F.sum("n")).first()[0] or 0
    found = each.where(F.col("n") >= max(SUPPORT, SHARE * total)).collect()
    return tuple(sorted({*LANGUAGES, *(r["declared"] for r in found)}))


def identify(rows: DataFrame, languages: tuple[str, ...] | None = None, least: float = LEAST) -> DataFrame:
    """rows (text, declared, host, suffix, and any key columns) to key columns
    with lang_id, posterior, text_lang, accepted.

    languages: those of the declared values with enough support and LANGUAGES;
    given ones restrict the answer to them.
    declared, host and suffix may be null: then they say nothing, and the prior
    is that of the whole corpus. A null text, or one without a letter, has the
    language "und" and is not accepted; so has a text that suits no language
    better than the background. accepted: a language of ``languages`` with a
    posterior of at least ``least``. Of equal posteriors the first language in
    the given order counts. An empty table gives an empty one. Key columns must
    not be named like those above.
    """
    spark = rows.sparkSession
    arrow_rows(spark)
    keys = [c for c in rows.columns if c not in ("text", "declared", "host", "suffix")]
    rows = rows.withColumns({"declared": language_of(F.col("declared")), "text": F.coalesce(F.col("text").cast("string"), F.lit("")), "host": F.lower("host"), "suffix": F.lower("suffix")})
    languages = languages or declared_languages(rows)
    n = len(languages)
    counts = trigram_counts(rows, languages)
    p = (counts + SMOOTH) / (counts.sum(axis=1, keepdims=True) + SMOOTH * counts.shape[1])
    table = np.vstack([np.log(p), np.full((1, counts.shape[1]), -np.log(counts.shape[1]))]).astype(np.float32)
    shared = spark.sparkContext.broadcast(table)

    def likelihood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for b in batches:
            data, at = utf8_buffers(b.column("text"))
            out = np.zeros((b.num_rows, n + 1))
            has = np.zeros(b.num_rows, bool)
            for i, j in steps(at):
                if j == i + 1:
                    sums, k = np.zeros(n + 1), 0
                    for ids in text_trigrams(data[at[i] : at[j]]):
                        sums += logs[:, ids].sum(axis=1, dtype=np.float64)
                        k += len(ids)
                    has[i] = k > 0
                    out[i] = sums * (min(k * TEMPER, EVIDENCE) / max(k, 1))
                    continue
                ids, first = trigrams(data[at[i] : at[j]], at[i : j + 1] - at[i])
                x, y = _spans(first, len(ids))
                ok = y > x
                has[i:j] = ok
                if ok.any():
                    # sums between x and y of each text, one language at a time
                    cuts = np.stack([x[ok], y[ok]], axis=1).reshape(-1)
                    most = np.minimum((y - x)[ok] * TEMPER, EVIDENCE) / (y - x)[ok]
                    sums = np.stack([np.add.reduceat(np.append(row[ids], 0).astype(np.float64), cuts)[::2] for row in logs], axis=1)
                    out[np.arange(i, j)[ok]] = sums * most[:, None]
            flat = pa.array(out.reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * (n + 1)), flat)
            rest = b.select([*keys, "declared", "host", "suffix"])
            yield pa.RecordBatch.from_arrays([*rest.columns, lists, pa.array(has)], [*rest.schema.names, "ll", "has"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    scored = rows.select(*keys, "declared", "host", "suffix", "text").mapInArrow(likelihood, ", ".join([*(f"`{c}` {kinds[c]}" for c in (*keys, "declared", "host", "suffix")), "ll array<double>", "has boolean"]))
    names = F.array(*(F.lit(x) for x in (*languages, UNKNOWN)))
    best = F.when(F.col("has"), F.element_at(names, F.array_position("ll", F.array_max("ll")).cast("int"))).otherwise(F.lit(UNKNOWN))
    scored = cut(scored.withColumn("text_lang", best).withColumn("site", F.regexp_extract(F.coalesce("host", F.lit("")), r"([^.]*\.?[^.]*)$", 1)), "likelihoods")

    # what goes with which language, counted over all records by the text's own word
    known = scored.where(F.col("text_lang") != UNKNOWN)
    zero = {x: 0 for x in languages}
    corpus = zero | {r["text_lang"]: r["n"] for r in known.groupBy("text_lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    total = sum(corpus.values())
    base = {x: (corpus[x] + 1) / (total + n) for x in languages}

    def tallies(by: str) -> DataFrame:
        sums = [F.count(F.when(F.col("text_lang") == x, 1)).alias(f"{by}_{k}") for k, x in enumerate(languages)]
        return known.where(F.col(by).isNotNull() & (F.col(by) != "")).groupBy(by).agg(*sums)

    def joined(df: DataFrame, by: str) -> DataFrame:
        t = cut(tallies(by).withColumnRenamed(by, f"{by}__"), f"by-{by}")
        return df.join(small(t), F.col(by) == F.col(f"{by}__"), "left").drop(f"{by}__")

    df = scored
    for by in ("host", "site", "declared", "suffix"):
        df = joined(df, by)

    def others(by: str, k: int) -> Column:
        """Records of the value with language k, the record itself left out: a
        lone host says nothing about its only record."""
        own = F.col(by).isNotNull() & (F.col(by) != "") & (F.col("text_lang") == languages[k])
        return (F.coalesce(F.col(f"{by}_{k}"), F.lit(0)) - F.when(own, 1).otherwise(0)).cast("double")

    all_ = lambda by: sum((others(by, k) for k in range(n)), F.lit(0.0))
    logs = []
    for k, x in enumerate(languages):
        site = (others("site", k) + INHERIT * base[x]) / (all_("site") + INHERIT)
        prior = (others("host", k) + F.lit(INHERIT) * site) / (all_("host") + INHERIT)
        z = F.col("ll")[k] + F.log(prior)
        for by in ("declared", "suffix"):
            # P(value | l) over P(value): what the value adds to the prior
            lift = (others(by, k) + INHERIT * base[x]) / ((all_(by) + INHERIT) * base[x])
            z = z + F.when(F.col(by).isNotNull() & (F.col(by) != ""), F.log(lift)).otherwise(F.lit(0.0))
        logs.append(z)
    logs.append(F.col("ll")[n] + F.log(F.lit(1.0 / (total + n + 1))))
    df = df.withColumn("z", F.array(*logs)).withColumn("m", F.array_max("z"))
    spread = F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("m")))
    lang = F.when(F.col("has"), F.element_at(names, F.array_position("z", F.col("m")).cast("int"))).otherwise(F.lit(UNKNOWN))
    post = F.when(F.col("has"), F.lit(1.0) / spread).otherwise(F.lit(0.0))
    out = df.select(*keys, lang.alias("lang_id"), post.alias("posterior"), "text_lang")
    return out.withColumn("accepted", (F.col("lang_id") != UNKNOWN) & (F.col("posterior") >= least))


def source_host(source: Column) -> tuple[Column, Column]:
    """(host, suffix) of a source: that of an address, else the source itself,
    whose last label is a suffix where it has several."""
    s = F.lower(F.trim(source.cast("string")))
    host = F.regexp_extract(s, r"^(?:[a-z][\w+.-]*://(?:[^/@]*@)?)?([^/:?#\s]+)", 1)
    host = F.when(host != "", host).otherwise(F.nullif(s, F.lit("")))
    return host, F.nullif(F.regexp_extract(host, r"\.([a-z]{2,})\.?$", 1), F.lit(""))


def document_evidence(docs: DataFrame) -> DataFrame:
    """Documents as records: the source is the host (where it is an address, its
    host, and the suffix is evidence too), lang is the declared value."""
    host, suffix = source_host(F.col("source"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").alias("declared"), host.alias("host"), suffix.alias("suffix"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """Raw pages as records: the html element's lang is the declared value, host
    and suffix come from the address, and the text is the html without scripts,
    styles and tags."""
    html = F.coalesce(F.col("html"), F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), text.alias("text"), F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([\w-]+)""", 1).alias("declared"),
        F.when(host != "", host).alias("host"), F.when(host != "", F.regexp_extract(host, r"([^.]+)\.?$", 1)).alias("suffix"),
    )


def language_pipeline(docs: DataFrame) -> DataFrame:
    """The rows of docs whose language is accepted; columns as in docs. Rows
    are judged one by one, those that repeat an identifier too."""
    host, suffix = source_host(F.col("source"))
    keyed = docs.select(F.xxhash64(*(F.col(c) for c in ("doc_id", "text", "lang", "source"))).alias("row_key"), "text", F.col("lang").alias("declared"), host.alias("host"), suffix.alias("suffix"))
    gone = cut(identify(keyed).where(~F.col("accepted")).select(F.col("row_key").alias("gone_")).distinct(), "rejected")
    return docs.join(small(gone), F.xxhash64(*(docs[c] for c in ("doc_id", "text", "lang", "source"))) == F.col("gone_"), "left_anti")
