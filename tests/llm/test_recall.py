"""What the searches find, against brute force over all pairs and positions."""

import random
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, language, near_dedup


def vocabulary(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n)]


def test_near_duplicates_just_above_the_threshold(spark):
    """300 pairs of similarity 0.75 to 0.8 and 100 just below it."""
    rng = random.Random(61)
    words, rows, want = vocabulary(rng, 5000), [], {}
    for k in range(400):
        n = rng.randint(40, 200)
        a = [rng.choice(words) for _ in range(n + 4)]
        keep = -(-6 * n // 7) + rng.randint(0, n // 40) if k < 300 else 6 * n // 7 - 2 - rng.randint(0, 3)
        b = a[: keep + 4] + [rng.choice(words) for _ in range(n - keep)]
        x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a, b))
        linked = 100 * len(x & y) >= 75 * len(x | y)
        assert linked == (k < 300), (n, keep)
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k if linked else 2 * k + 1}
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_hot_shingles_meet_as_others_do(spark):
    """Bands of sizes and salts lose no pair that the plain join has."""
    rng = random.Random(62)
    rows = [(rng.choice([1, 1, 1, 2, 3]), node, node % 7, n, i) for node in range(300) for n in [rng.randint(1, 400)] for i in [rng.randint(0, n - 1)]]
    posts = spark.createDataFrame(rows, "shingle long, node long, comp long, n long, i long")
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2] and 100 * min(a[3], b[3]) >= 75 * max(a[3], b[3])}
    for hot in (1, 20, 10_000):
        x, y = near_dedup.posting_sides(posts, hot=hot)
        x, y = x.select("shingle", "band", "salt", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na")), y.select("shingle", "band", "salt", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"))
        got = [tuple(r) for r in x.join(y, ["shingle", "band", "salt"]).where("ca < cb and 100 * least(na, nb) >= 75 * greatest(na, nb)").select("a", "b").collect()]
        assert len(got) == len(set(got)) and set(got) == want


def leaks(rng, n_items, n_docs):
    words = vocabulary(rng, 3000)
    common = words[:30]
    say = lambda n: [rng.choice(common) if rng.random() < 0.5 else rng.choice(words) for _ in range(n)]
    items = [(k, f"{' '.join(say(rng.randint(10, 90)))}. {' '.join(say(5))}.") for k in range(n_items)]
    docs = []
    for k in range(n_docs):
        share, out = rng.uniform(0.55, 0.95), []
        for w in items[rng.randrange(n_items)][1].split():
            if rng.random() < share:
                out.append(w)
            elif rng.random() < 0.5:
                out += say(1)
        docs.append((k, " ".join(say(rng.randint(0, 100)) + out + say(rng.randint(0, 100)))))
    return items, docs


def brute_force(items, docs):
    def hashes(t):
        data, at = decontaminate.utf8_buffers(pa.array([t]))
        return decontaminate.words(data, at)[0]

    m, out = decontaminate, set()
    known = [(i, hashes(t), m._answer(t)) for i, t in items]
    for d, t in docs:
        h = hashes(t)
        for i, item, answer in known:
            bag, least = Counter(item.tolist()), m.PARAPHRASE * len(item)
            own = Counter(h.tolist())
            if sum(min(c, own[w]) for w, c in bag.items()) < least:
                continue
            for lo in range(-m.MARGIN, len(h)):
                span = h[max(0, lo - m.MARGIN) : lo + len(item) + m.MARGIN]
                if sum(bag[w] for w in bag.keys() & set(span.tolist())) >= least and m.is_leak(item, answer, span)[0]:
                    out.add((d, i))
                    break
    return out


def test_decontamination_against_all_positions(spark):
    """Items with 0.55 to 0.95 of their words left, others put in between: at
    least 0.98 of what a search of all positions finds, and nothing else; the
    same where the benchmark is searched in parts."""
    rng = random.Random(63)
    items, docs = leaks(rng, 40, 300)
    want = brute_force(items, docs)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (None, items[0][1]), (900, None), (901, "")], "item_id long, text string")
    for part in (decontaminate.PART, 15):
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(df, bench, part).collect()}
        assert got <= want and len(got) >= 0.98 * len(want) > 150
    parts = list(decontaminate.parts_of(bench, 15))
    assert len(parts) > 1 and sorted(i for ids, _ in parts for i in ids) == sorted([*range(40), 901])


# -- language by brute force -------------------------------------------------


def test_posterior_by_hand(spark):
    """Every evidence recomputed in plain Python from the operator's own
    likelihoods; a record is left out of its own tallies."""
    import math

    import numpy as np

    tongues = {"de": "der und nicht mit einer schön über wegen ich".split(), "en": "the and that with from which there ought thing".split()}
    rng = random.Random(64)
    rows = []
    for k in range(60):
        x = "de" if k % 3 else "en"
        rows.append((k, " ".join(rng.choice(tongues[x]) for _ in range(rng.randint(1, 9))), x if k % 4 else None, f"h{k % 5}.s{k % 2}.{x if k % 7 else 'com'}", x if k % 7 else "com"))
    rows += [(100, "der thing", "en", "alone.lonely.org", "org"), (101, "", "de", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string")
    langs = ("de", "en")
    got = {r["doc_id"]: r for r in language.identify(df, langs).collect()}

    keyed = df.withColumn("declared", language.language_of(F.col("declared")))
    counts = language.trigram_counts(keyed, langs)
    p = np.log((counts + language.SMOOTH) / (counts.sum(axis=1, keepdims=True) + language.SMOOTH * counts.shape[1])).astype(np.float32)
    ll = {}
    for k, text, *_ in rows:
        ids = np.concatenate(list(language.text_trigrams(np.frombuffer(text.encode(), np.uint8))))
        n = len(ids)
        ll[k] = [] if not n else [float(x) * min(n * language.TEMPER, language.EVIDENCE) / n for x in (*p[:, ids].sum(axis=1, dtype=np.float64), -n * math.log(counts.shape[1]))]
    said = {k: ([*langs, "und"][int(np.argmax(v))] if v else "und") for k, v in ll.items()}
    facts = {k: {"host": h, "site": ".".join(h.split(".")[-2:]) if h else "", "declared": d or "", "suffix": s} for k, _, d, h, s in rows}
    total = Counter(x for x in said.values() if x != "und")
    base = {x: (total[x] + 1) / (sum(total.values()) + 2) for x in langs}

    def others(k, by, x):
        v = facts[k][by]
        return sum(1 for j in facts if j != k and v and facts[j][by] == v and said[j] == x) if v else 0

    for k, v in ll.items():
        if not v:
            assert got[k]["lang_id"] == "und" and got[k]["posterior"] == 0
            continue
        z = []
        for n, x in enumerate(langs):
            every = lambda by: sum(others(k, by, y) for y in langs)
            site = (others(k, "site", x) + language.INHERIT * base[x]) / (every("site") + language.INHERIT)
            prior = (others(k, "host", x) + language.INHERIT * site) / (every("host") + language.INHERIT)
            s = v[n] + math.log(prior)
            for by in ("declared", "suffix"):
                if facts[k][by]:
                    s += math.log((others(k, by, x) + language.INHERIT * base[x]) / ((every(by) + language.INHERIT) * base[x]))
            z.append(s)
        z.append(v[2] + math.log(1 / (sum(total.values()) + 3)))
        best = max(z)
        assert got[k]["lang_id"] == [*langs, "und"][z.index(best)]
        assert abs(got[k]["posterior"] - 1 / sum(math.exp(y - best) for y in z)) < 1e-6


def test_sources_that_are_addresses(spark):
    df = spark.createDataFrame([(1, "a", "en", "https://www.Example.FR:80/x"), (2, "a", "en", "src3"), (3, "a", None, None), (4, "a", "", "blog.example.de"), (5, "a", "", "")], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: (r["host"], r["suffix"]) for r in language.document_evidence(df).collect()}
    assert got == {1: ("www.example.fr", "fr"), 2: ("src3", None), 3: (None, None), 4: ("blog.example.de", "de"), 5: (None, None)}
