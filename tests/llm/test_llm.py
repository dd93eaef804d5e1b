"""Each operator against a brute-force version, on rows with nulls, empty and
long texts, ties, repeated rows and columns with clashing names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import decontaminate, exact_dedup, language, mixing, near_dedup, quality, sharding, site_tree, token_store, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, key string, id long, rows long, shard int, target double, comp long"
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ru", "te") for b in ("n", "s", "v", "r") for c in ("ar", "el", "im", "ot", "u")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out, k = [], 0

    def add(text, source="s1", lang="en", doc_id=-1):
        nonlocal k
        out.append((k if doc_id == -1 else doc_id, text, lang, source))
        k += 1

    for s in ("s1", "s2", "s10", None, "é"):
        for _ in range(12):
            add(prose(rng, rng.randint(1, 80)), s)
    base = prose(rng, 60).split(" ")
    for j in range(12):  # near copies
        w = list(base)
        w[(5 * j) % 60] = "changed"
        add(" ".join(w), "s1")
    for _ in range(5):
        add("The SAME text, again and again here")
        add("the same TEXT, again and again here")
    for t in (None, None, "", "   \n\t", "word", "Word", "a b", "ÀÉ àé", "x" * 5000, prose(rng, 4000), "1 2 3 4", "퟿\U0001f600 ok", "a  b c   d"):
        add(t, None, None)
    add("null id one two three four five", doc_id=None)
    add("null id one two three four five", doc_id=None)
    add("repeated row with its id twice over", "s2")
    out.append(out[-1])
    out.append((out[-1][0], "another text under the same id as before", "en", "s2"))
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 0, 5, "k", 7, 3, 1, 1.0, 2) for r in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def by_row(df):
    return sorted(map(tuple, df.collect()), key=repr)


# -- exact copies ------------------------------------------------------------


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan", [2, 8])
def test_exact_dedup(docs, rows, keep, fan):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(fold(t), []).append(d)
    want = []
    for d, t, *_ in rows:
        g = groups[fold(t)]
        named = [x for x in g if x is not None]
        k = (max if keep == "largest" else min)(named) if named else None
        want.append((d, k, len(g), d == k, hashlib.sha256(fold(t).encode()).hexdigest()))
    assert by_row(exact_dedup.exact_dedup(docs, keep=keep, fan=fan)) == sorted(want, key=repr)


def test_tree_merge_over_many_partitions(spark):
    df = spark.range(2000).selectExpr("id as doc_id", "case when id % 3 = 0 then 'hot' else concat('t', id % 700) end as text").repartition(20)
    table = exact_dedup.cut(exact_dedup.digests(df), "t")
    out = exact_dedup.tree_merge(table, fan=2).collect()
    texts = {}
    for i in range(2000):
        texts.setdefault("hot" if i % 3 == 0 else f"t{i % 700}", []).append(i)
    assert sorted((r["keep"], r["rows"]) for r in out) == sorted((max(v), len(v)) for v in texts.values())


# -- near copies -------------------------------------------------------------


def shingle_set(t):
    w = [fold(x) for x in words(t)]
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def test_near_dedup(docs, rows):
    sets = [shingle_set(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 75 * len(a | b):
                root[top(i)] = top(j)
    want = []
    for k, (d, *_) in enumerate(rows):
        same = [rows[j][0] for j in range(len(rows)) if top(j) == top(k) and rows[j][0] is not None]
        c = None if d is None else (min(same) if sets[k] else d)
        want.append((d, len(sets[k]), c, d == c))
    assert by_row(near_dedup.near_dedup(docs)) == sorted(want, key=repr)


def test_near_dedup_settles_open_buckets(spark):
    """A chain: each links to the next only, so the smallest member's star is
    not enough."""
    rng = random.Random(3)
    w = [f"w{k}" for k in range(130)]
    chain = []
    for j in range(8):
        for k in rng.sample(range(130), 3) if j else []:
            w[k] = f"c{j}-{k}"
        chain.append(" ".join(w))
    df = spark.createDataFrame([(100 + k, t) for k, t in enumerate(chain)] + [(k, prose(rng, 50)) for k in range(30)], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_dedup(df).collect()}
    sets = [shingle_set(t) for t in chain]
    link = [100 * len(a & b) >= 75 * len(a | b) for a, b in zip(sets, sets[1:])]
    want, c = {100: 100}, 100
    for k, on in enumerate(link):
        c = c if on else 101 + k
        want[101 + k] = c
    assert {k: v for k, v in got.items() if k >= 100} == want


def test_signature_estimates_similarity():
    rng = np.random.default_rng(0)
    x = np.sort(rng.integers(0, 1 << 63, 400, dtype=np.uint64))
    y = np.sort(np.concatenate([x[:300], rng.integers(0, 1 << 63, 100, dtype=np.uint64)]))
    agree = (near_dedup.signature(x, 1024) == near_dedup.signature(y, 1024)).mean()
    assert abs(agree - 0.6) < 0.06


def test_connected(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 130)]
    got = {r["node"]: r["comp"] for r in near_dedup.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if any(k in e and e[0] != e[1] for e in edges)}


# -- sharding and mixing -----------------------------------------------------


def test_sharding(docs, rows):
    out = sharding.shard_documents(docs, shards=4, slots=64).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in out if r["doc_id"] is not None) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows if d is not None)
    for s in range(4):
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sum(r["shard"] == s for r in out)))
    assert len({(r["virtual_slot"], r["shard"]) for r in out}) == len({r["virtual_slot"] for r in out})


def test_slot_map_versions(spark, tmp_path):
    rng = random.Random(2)
    sizes = [rng.randint(1, 100) for _ in range(512)]
    a = sharding.SlotMap.balanced(sizes, 16)
    load = np.bincount(a.shard, sizes, 16)
    assert load.max() - load.min() <= max(sizes)
    b = a.rebalanced(sizes, 17)
    moved = [k for k in range(512) if a.shard[k] != b.shard[k]]
    assert b.version == 2 and moved and all(b.shard[k] == 16 for k in moved)
    load = np.bincount(b.shard, sizes, 17)
    assert load.max() - load.min() <= 0.2 * load.mean()
    for m in (a, b):
        m.save(spark, f"file://{tmp_path}/map")
    assert sharding.SlotMap.load(spark, f"file://{tmp_path}/map").shard == b.shard
    assert sharding.SlotMap.load(spark, f"file://{tmp_path}/map", 1).shard == a.shard
    with pytest.raises(ValueError):
        b.rebalanced(sizes, 3)


@pytest.mark.parametrize("operator", [sharding.shard_documents, sharding.shard_pipeline])
def test_shards_come_from_the_stored_map(spark, tmp_path, operator):
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('x', int(id % 50)) as text")

    def at(df):
        return {r["virtual_slot"]: r["shard"] for r in df.select("virtual_slot", "shard").collect()}

    import pathlib

    from marlstone.llm._common import shared_dir

    folder = pathlib.Path(shared_dir(spark).removeprefix("file://"), "marlstone")
    had = set(folder.glob("slot-map-*"))
    now = at(operator(docs, shards=4, slots=64))
    (new,) = set(folder.glob("slot-map-*")) - had
    a = sharding.SlotMap.load(spark, f"file://{new}")
    assert a.version == 1 and len(a.shard) == 64 and now.items() <= dict(enumerate(a.shard)).items()

    path = f"file://{tmp_path}/map"
    assert at(operator(docs, shards=4, slots=64, map_path=path)) == at(operator(docs, shards=4, slots=64, map_path=path)) == now
    assert sharding.SlotMap.load(spark, path).version == 1
    grown = at(operator(docs, shards=5, slots=64, map_path=path))
    b = sharding.SlotMap.load(spark, path)
    assert b.version == 2 and grown.items() <= dict(enumerate(b.shard)).items()
    assert 4 in b.shard and 2 * sum(x != y for x, y in zip(a.shard, b.shard)) < len(a.shard)
    assert sharding.SlotMap.load(spark, path, 1).shard == a.shard


def test_mixing(docs, rows):
    out = mixing.mix(docs).collect()
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, over = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[s] for s in over)) / sum(weight[s] for s in size if s not in over)
        new = {s for s in size if level * weight[s] > 2 * size[s]}
        if new == over:
            break
        over = new
    target = {s: min(2 * size[s], level * weight[s]) for s in size}
    assert sum(target.values()) == pytest.approx(total)
    source = {r[0]: r[3] for r in rows}
    taken = {}
    for r in out:
        s = None if r["doc_id"] is None else source[r["doc_id"]]
        if r["doc_id"] is not None:
            assert r["target"] == pytest.approx(target[s], abs=1e-5) and r["source_size"] == size[s]
        assert r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in ("s1", "s2", "s10", "é"):
        most = max(len(words(t)) for _, t, _, x in rows if x == s)
        assert abs(taken[s] - target[s]) <= most
    assert by_row(mixing.mix(docs)) == sorted(map(tuple, out), key=repr)


# -- tokens ------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    ids = np.random.default_rng(1).integers(0, 1 << 32, 1003, dtype=np.uint64).astype(np.uint32)
    assert np.array_equal(token_store.from_planes(token_store.to_planes(ids, kind), len(ids)), ids)


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_tokens(spark, docs, rows, tmp_path, kind):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    token_store.write_tokens(docs, f"file://{tmp_path}/t", path, chunk=256, kind=kind, files=3)
    out = sorted(token_store.read_tokens(spark, f"file://{tmp_path}/t").collect(), key=lambda r: r["start"])
    tok, at, want = Tokenizer.from_file(path), 0, []
    for d, t, *_ in sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1] or "")):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids)))
        at += len(ids)
    assert [tuple(r) for r in out] == want


def test_encoder_starts_afresh(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(token_store, "PIECES", 50)
    monkeypatch.setattr(token_store, "NEAR", 10)
    e = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 0)
    rng = random.Random(4)
    for _ in range(6):
        texts = [prose(rng, 40), "  odd  spaces ", "", "<|endoftext|> x", "tabs\tand\nlines \n here"]
        ids, lens = e.encode(texts)
        want = [i for t in texts for i in [*e.tok.encode(t, add_special_tokens=False).ids, 0]]
        assert ids.tolist() == want and lens.sum() == len(ids)


@pytest.mark.parametrize("most", [1, 5, 40])
def test_a_long_text_is_encoded_in_parts(most):
    import public_tokenizers

    e = token_store.Encoder(public_tokenizers.path("byte_bpe_50k.json"), 0)
    rng = random.Random(71)
    texts = ["", " ", "a", "  a  b ", " lead", "trail ", "a\u00a0 b c\t d \n e", "x" * 300, *("".join(rng.choice("ab .,'1é\n  ") for _ in range(rng.randint(0, 200))) for _ in range(60)), *(prose(rng, 60) for _ in range(5))]
    for t in texts:
        parts = token_store.parts_of(t, most)
        assert "".join(parts) == t and all(p[0] == " " for p in parts[1:])
        got = [i for k, p in enumerate(parts) for i in e.encode([p], k == 0, k == len(parts) - 1)[0].tolist()]
        assert got == [*e.tok.encode(t, add_special_tokens=False).ids, 0]


# -- language ----------------------------------------------------------------

TONGUES = {"en": "the and that with from which there ought thing".split(), "de": "der und nicht mit einer schön über wegen ich".split(), "es": "el que los con para señor niño muy esta".split(), "fr": "le les avec pour être où très une français".split()}


def test_language(spark):
    rng = random.Random(6)
    rows, truth = [], {}
    for k in range(400):
        lang = "de en es fr".split()[k % 4]
        declared = lang if rng.random() < 0.9 else rng.choice(["de", "en", None, "xx"])
        rows.append((k, " ".join(rng.choice(TONGUES[lang]) for _ in range(rng.randint(5, 60))), declared, f"host{k % 4}.{'com' if k % 3 else lang}", None))
        truth[k] = lang
    rows += [(1000, None, "en", "host1.com", "com"), (1001, "", None, None, None), (1002, "123 456 !!!", "de", "h", "de"), (1003, "ok", "fr-FR", "host3.com", "fr")]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string")
    got = {r["doc_id"]: r for r in language.identify(df).collect()}
    assert len(got) == len(rows)
    assert sum(got[k]["lang_id"] == truth[k] for k in truth) >= 395 and sum(got[k]["accepted"] for k in truth) >= 395
    assert all(got[k]["lang_id"] == "und" and not got[k]["accepted"] for k in (1000, 1001, 1002))
    assert language.identify(df.limit(0)).count() == 0


def test_evidence_outweighs_a_short_text(spark):
    """A text that says little takes the language of its host and declaration."""
    rows = [(k, " ".join(TONGUES["de"]), "de", "a.de", "de") for k in range(60)] + [(k, " ".join(TONGUES["fr"]), "fr", "b.fr", "fr") for k in range(60, 120)]
    rows += [(900, "en", "de", "a.de", "de"), (901, "en", "fr", "b.fr", "fr")]
    got = {r["doc_id"]: r["lang_id"] for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string")).collect()}
    assert got[900] == "de" and got[901] == "fr"


def test_page_evidence(spark):
    df = spark.createDataFrame([(1, "https://u@Www.Example.FR:80/x", '<html lang="fr-CA"><script>the</script><p>tr&egrave;s</p>'), (2, None, None)], "page_id long, url string, html string")
    a, b = language.page_evidence(df).orderBy("page_id").collect()
    assert (a["host"], a["suffix"], a["declared"]) == ("www.example.fr", "fr", "fr-CA") and "the" not in a["text"]
    assert (b["host"], b["suffix"], b["declared"]) == (None, None, "")


def test_languages_are_those_declared(spark):
    """A fifth language counts if enough records declare it, unless the caller
    restricts the languages; rare values and codes of no language do not."""
    tongues = TONGUES | {"it": "il che non sono della perché questo gli anche più".split()}
    rng = random.Random(20)
    truth = {k: ("de", "en", "es", "fr", "it")[k % 5] for k in range(400)}
    rows = [(k, " ".join(rng.choice(tongues[x]) for _ in range(30)), "qq" if k % 50 == 7 else "und" if k % 10 == 9 else x + "-XX", "src", None) for k, x in truth.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string")
    got = {r["doc_id"]: r for r in language.identify(df).collect()}
    assert {k: r["lang_id"] for k, r in got.items()} == truth and all(r["accepted"] for r in got.values())
    assert {r["lang_id"] for r in language.identify(df, ("de", "en")).collect()} <= {"de", "en", "und"}
    docs = df.selectExpr("doc_id", "text", "declared as lang", "host as source", "length(text) as n_chars")
    assert language.language_pipeline(docs).count() == 400


def test_an_op2_query_fuses_the_address(spark, tmp_path):
    """Pages whose text says little take the language of suffix, host or site."""
    from marlstone.llm import queries

    page = lambda k, url, text: (k, url, f"<html><p>{text}</p></html>")
    rows = [(k, f"http://h{k % 7}.a{k % 5}.{x}/", f'<html lang="{x}"><p>{" ".join(TONGUES[x])}</p></html>') for k in range(120) for x in (("de", "fr")[k % 2],)]
    rows += [page(900, "http://new.z.de/", "en"), page(901, "http://new.z.fr/", "en")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert [n for n in queries.QUERIES if n.startswith("op2_")] == ["op2_language_evidence", "op2_page_evidence"]
    got = {r["page_id"]: r["lang_id"] for r in queries.QUERIES["op2_page_evidence"](spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[900] == "de" and got[901] == "fr"


# -- classifiers -------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(700):
        good, toxic = rng.random() < 0.7, rng.random() < 0.3
        w = prose(rng, rng.randint(8, 120)).split(" ")
        if not good:
            w = [x.upper() + "!!" for x in w] if rng.random() < 0.5 else [x for x in w[:20] for _ in range(6)]
        if toxic:
            for _ in range(1 + len(w) // 30):
                w[rng.randrange(len(w))] = rng.choice(["idiotface", "moronic", "wretched"])
        docs.append((k, " ".join(w) + "."))
        labels.append((k, int(good), int(toxic)))
    docs += [(1000, None), (1001, ""), (None, "x y z"), (1002, "z" * 3000), (5, docs[5][1])]
    labels += [(3, None, None), (None, 1, 1), (7, 0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("operator", "label", "modulus", "rest", "threshold", "least"), [(quality.quality, 1, 3, 1, 0.5, 0.97), (toxicity.toxicity, 2, 4, 2, 0.3, 0.93)])
def test_classifier(labelled, operator, label, modulus, rest, threshold, least):
    docs, labels = labelled
    out = operator(docs, labels).collect()
    truth = {r[0]: r[label] for r in labels.collect() if r[0] not in (3, 7, None)}
    assert len(out) == docs.count()
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= threshold)
        assert r["held_out"] == (zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % modulus == rest)
    held = [r for r in out if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= least
    assert operator(docs, labels.limit(0)).count() == docs.count() and operator(docs.limit(0), labels).count() == 0


def test_unseen_misspelling():
    rng = random.Random(9)
    texts, y = [], []
    for k in range(300):
        w = prose(rng, 25).split(" ")
        if k % 2:
            w[rng.randrange(25)] = rng.choice(["worthless", "disgusting"])
        texts.append(" ".join(w))
        y.append(k % 2)
    m = toxicity.train(pa.array(texts), np.array(y, float), np.ones(300))
    clean, misspelt = m.score(pa.array([prose(rng, 25) for _ in range(20)])).mean(), m.score(pa.array([prose(rng, 12) + " worthles disgustting " + prose(rng, 12) for _ in range(20)])).mean()
    assert misspelt > clean + 0.3
    long_ = prose(rng, 3000)
    assert m.score(pa.array([long_ + " worthless " + prose(rng, 30)]))[0] > m.score(pa.array([long_]))[0]


def test_quality_reads_the_end_of_long_texts():
    rng = random.Random(10)
    texts = [prose(rng, 60) + "." for _ in range(150)] + [prose(rng, 40) + " %%% ### $$$ @@@" for _ in range(150)]
    net = quality.train(pa.array(texts), np.array([1.0] * 150 + [0.0] * 150), np.ones(300))
    long_ = ". ".join(prose(rng, 60) for _ in range(60))
    a, b = net.score(pa.array([long_ + ".", long_ + " %%% ### $$$ @@@"]))
    assert a > 0.5 > b


# -- pages -------------------------------------------------------------------


def test_pages(spark):
    rng = random.Random(11)
    rows, want = [], {}
    for k in range(60):
        title, ps = prose(rng, 4), [prose(rng, rng.randint(3, 30)) for _ in range(3)]
        html = f"""<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a="<p>no</p>";</script></head><body><header><p>Site</p></header><nav><ul><li>Home<li>About</ul></nav>
<div class="x17">Call us now: 555</div><div class="cookie-notice">We use cookies</div><article><h1>{title}</h1><p><b>{ps[0]}</b> &amp; more<br><p>{ps[1]}&nbsp;&eacute;<aside>see</aside><form><p>mail <input></form><p>{ps[2]}
<section id="comments"><p>first!</p></section></article><div id="sidebar"><p>side</p></div><footer>&copy; us</footer></body></html>"""
        rows.append((k, f"http://site{k % 2}.org/{k}", html, "clash", "t"))
        want[k] = "\n".join([title, f"{ps[0]} & more", f"{ps[1]} é", ps[2]])
    rows += [(100, None, None, "", ""), (101, "http://one.org", "plain <b>text</b> only", "", ""), (102, "bad url", "", "", ""), (103, "http://one.org", "<p>" * 3000 + "deep", "", "")]
    want |= {100: "", 101: "plain text only", 102: "", 103: "deep"}
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, path string")
    out = {r["page_id"]: r for r in site_tree.extract(df).collect()}
    assert {k: r["text"] for k, r in out.items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in out.values())
    assert site_tree.extract(df.limit(0)).count() == 0


def page_without_article(rng, k):
    return f"<html><body><div class='top'><p>Welcome to our shop</p></div><div class='text'><p>{prose(rng, 30)}</p><p>{prose(rng, 20)}</p></div><div class='end'><p>All rights belong to us</p></div></body></html>"


def test_style_tree_finds_what_repeats(spark, monkeypatch):
    """Without tell-tale names, only the entropy over the host's pages tells."""
    rng = random.Random(12)
    pages = [(k, f"http://shop.org/{k}", page_without_article(rng, k)) for k in range(30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    out = {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()}
    for k, _, html in pages:
        assert out[k] == "\n".join(re.findall(r"<p>(.*?)</p>", html)[1:3])
    monkeypatch.setattr(site_tree, "BROADCAST_ROWS", 0)
    assert {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()} == out


@pytest.mark.parametrize("tag", ["article", "div"])
def test_a_repeated_line_does_not_decide_for_its_host(spark, tag):
    rng = random.Random(16)
    pages = [("one.org", [prose(rng, 20) for _ in range(3)] + ["again and again"] * 100)]
    pages += [("many.org", [prose(rng, 20) for _ in range(4)] + ["the same line"] * (450 if k == 7 else 0)) for k in range(20)]
    df = spark.createDataFrame([(k, f"http://{h}/{k}", f"<body><{tag}>{''.join(f'<p>{x}</p>' for x in ps)}</{tag}></body>") for k, (h, ps) in enumerate(pages)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_tree.extract(df).collect()}
    assert got == {k: "\n".join(ps) for k, (_, ps) in enumerate(pages)}


@pytest.mark.parametrize("copies", [20, 1000])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_hosts_of_copies_keep_their_text(spark, copies, tag):
    """Exact copies, copies that differ in a script and a menu, and near copies."""
    rng = random.Random(17)
    title, ps = prose(rng, 3), [prose(rng, 20), prose(rng, 20), prose(rng, 20)]
    body = f"<{tag}><h1>{title}</h1>{''.join(f'<p>{x}</p>' for x in ps)}%s</{tag}>"
    html = {"same": lambda k: body % "", "track": lambda k: f"<script>track({k})</script><nav>{k}</nav>" + body % "", "near": lambda k: "<div class='top'>Our frame</div>" + body % f"<p>Visit {k}</p>"}
    rows = [(k * 3 + j, f"http://{h}.org/{k}", f"<body>{f(k)}</body>") for j, (h, f) in enumerate(html.items()) for k in range(copies)]
    got = {r["page_id"]: r["text"] for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k * 3 + j: "\n".join([title, *ps] + ([f"Visit {k}"] if j == 2 else [])) for j in range(3) for k in range(copies)}


@pytest.mark.parametrize("n", [2, 3, 5, 7])
def test_small_hosts_are_cleaned(spark, n):
    """Unnamed blocks that all pages of a host share go from two pages on, but a
    page and its print version keep what they share."""
    rng = random.Random(19)
    want = {k: [prose(rng, 20), prose(rng, 12)] for k in range(n)}
    rows = [(k, "http://small.org/", f"<body><div class='x{k}'>Call us now</div><p>{a}</p><p>{b}</p><div class='y'><p>All of it ours</p></div></body>") for k, (a, b) in want.items()]
    shared = [prose(rng, 20) for _ in range(4)]
    want |= {100 + k: [*shared, f"Version {k}"] for k in range(2)}
    rows += [(k, "http://print.org/", f"<body>{''.join(f'<p>{x}</p>' for x in want[k])}</body>") for k in (100, 101)]
    got = {r["page_id"]: r["text"] for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "\n".join(v) for k, v in want.items()}


def test_no_words_are_cut_out_of_sentences(spark):
    """Inline elements and headings from a small fixed set of texts."""
    rng = random.Random(18)
    want = {k: [f"Part {k % 3}", f"{prose(rng, 6)} {('very', 'much')[k % 2]} {prose(rng, 6)}", prose(rng, 5)] for k in range(400)}
    rows = [(k, "http://hot.org/", f"<body><h2>{h}</h2><p>{a.replace('very', '<b>very</b>').replace('much', '<em>much</em>')}</p><p>{b}</p></body>") for k, (h, a, b) in want.items()]
    got = {r["page_id"]: r["text"] for r in site_tree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: "\n".join(v) for k, v in want.items()}


# -- benchmark ---------------------------------------------------------------


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    common = vocabulary[:30]
    say = lambda n: " ".join(rng.choice(common) if rng.random() < 0.5 else rng.choice(vocabulary) for _ in range(n))
    items = [(k, f"{say(rng.randint(12, 45))}. {say(5)}.") for k in range(30)] + [(98, ""), (99, None)]
    docs, want = [], set()
    for k in range(300):
        t = say(rng.randint(0, 400))
        if k % 10 == 0:
            w = items[rng.randrange(30)][1].split(" ")
            if k % 20 == 0:
                for _ in range(len(w) // 10):
                    w[rng.randrange(len(w))] = rng.choice(common)
            t = f"{t} {' '.join(w).upper() if k % 30 == 0 else ' '.join(w)} {say(60)}"
            want.add(k)
        docs.append((k, t, "clash"))
    docs += [(1000, None, ""), (1001, "", ""), (None, items[3][1], "")]
    return spark.createDataFrame(docs, "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"), want


def test_decontamination(leaks):
    docs, items, want = leaks
    out = decontaminate.decontaminate(docs, items).collect()
    assert len(out) == docs.count()
    assert {r["doc_id"] for r in out if r["leaked"]} == want | {None}
    assert decontaminate.decontaminate(docs, items.limit(0)).where("leaked").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), items).count() == 0


def test_lcs():
    rng = random.Random(14)
    for _ in range(50):
        a, b = [rng.randint(0, 6) for _ in range(rng.randint(1, 30))], [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(np.array(a), np.array(b)) == t[-1][-1]


def test_latent_space_is_that_of_the_matrix():
    rng = np.random.default_rng(15)
    x = rng.standard_normal((400, 6)) @ np.diag([9, 7, 5, 4, 3, 2]) @ rng.standard_normal((6, 80)) + 0.01 * rng.standard_normal((400, 80))
    o = rng.standard_normal((80, decontaminate.SKETCH))
    v, s = decontaminate.latent(x.T @ (x @ o), o, 6)
    _, s0, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(s, s0[:6], rtol=1e-3) and np.allclose(np.abs((v * vt[:6].T).sum(axis=0)), 1, atol=1e-3)


# -- empty tables ------------------------------------------------------------


def test_empty_tables(none):
    import public_tokenizers

    for f in (exact_dedup.exact_dedup, near_dedup.near_dedup, sharding.shard_documents, mixing.mix, lambda d: token_store.token_digest(d, public_tokenizers.path("byte_bpe_50k.json")), lambda d: language.identify(language.document_evidence(d))):
        assert f(none).count() == 0


# -- pipeline ----------------------------------------------------------------


def test_pipeline(spark, leaks, tmp_path):
    import corpus_pipeline

    docs, items, want = leaks
    docs = docs.where("doc_id is not null").selectExpr("doc_id", "text", "'en' as lang", "concat('s', doc_id % 3) as source", "length(text) as n_chars")
    copies = docs.where("doc_id < 50 and n_chars > 200").selectExpr("doc_id + 5000 as doc_id", "concat(text, ' end') as text", "lang", "source", "n_chars")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.union(copies).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, f) in enumerate(corpus_pipeline.STAGES):
        out = f(spark, now, str(tmp_path))
        assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"] and (k == 4 or len(out.columns) == 5)
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"] for r in now.select("doc_id").collect()})
    assert not kept[0] & {1000, 1001} and len(kept[0]) == docs.union(copies).where("length(trim(text)) > 0").count()
    assert kept[1] == {d for d in kept[0] if d < 5000}
    assert kept[2] == kept[1] - want
    assert kept[3] <= kept[2] and kept[4] == kept[3]
    assert {r["shard"] for r in now.collect()} <= set(range(16))
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == kept[4]


def test_mixing_rows(docs):
    """The pipeline's rows are those that the mix counts."""
    want = {}
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + r["copies"]
    out = mixing.mix_pipeline(docs)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    repeated = {d for d in want if d is None or sum(r["doc_id"] == d for r in docs.select("doc_id").collect()) > 1}
    assert {d: n for d, n in want.items() if n and d not in repeated} == {d: n for d, n in got.items() if d not in repeated}
