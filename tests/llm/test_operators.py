"""The training-data operators against brute force, on small tables with nulls, empty and repeated rows and clashing columns."""

import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomstone.llm import decontamination, embedding_dedup, jaccard_join, language_id, mixing, queries, sharding, substring_dedup, token_counts, toxicity, warc
from loomstone.llm._runtime import components, keyed

DOC = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(4)


def prose(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4))) for _ in range(n))


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    df = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOC)
    for c in ("copy_no", "rate", "shard", "slot", "pos", "want", "component", "id", "token", "_n"):
        df = df.withColumn(c, F.lit(1))
    return df


ODD = [(1, None, "a"), (2, "", "a"), (3, "   \n\t", None), (4, "one", "a"), (4, "one", "a"), (None, "two words", "b"), (5, "Ünï cödé " * 3, "b"), (6, prose(4000, 1), "b"), (7, prose(4000, 1), "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [(1, "x", "a")]).where("false")


@pytest.fixture(scope="module")
def small(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}


# ---- 1 ----
def test_substring_dedup(spark, odd, empty):
    shared = prose(60, 9)
    docs = frame(spark, [(10, prose(200, 2) + " " + shared + " " + prose(50, 3), "a"), (11, prose(33, 5) + " " + shared, "a"), (12, prose(300, 6), "a"), (13, None, "a")])
    found = substring_dedup.spans(docs)
    assert {r["doc_id"] for r in found.collect()} == {10, 11}
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.remove(docs, found).collect()}
    assert cut[10] == docs.where("doc_id = 10").first()["text"] and cut[13] is None
    assert len(cut[11]) < 0.7 * len(docs.where("doc_id = 11").first()["text"])
    assert {r["doc_id"] for r in substring_dedup.spans(odd).collect()} == {6, 7}
    assert substring_dedup.spans(empty).count() == 0


def test_substring_dedup_tells_rows_apart(spark):
    """Rows without an id and rows that share one are documents of their own: a shared passage is found in each."""
    shared = prose(60, 9)
    text = {k: f"{prose(40, 20 + k)} {shared} {prose(30, 40 + k)}" for k in range(6)}
    rows = [(10, text[0], "a"), (11, text[1], "a"), (None, text[2], "a"), (None, text[3], "a"), (12, text[4], "a"), (12, text[4], "a"), (13, text[5], "a"), (13, prose(90, 60), "a")]
    docs = keyed(frame(spark, rows))
    found = substring_dedup.spans(docs)
    by = defaultdict(list)
    for r in found.collect():
        by[r["row_key"]].append(r)
    keys = {r["row_key"]: (r["doc_id"], r["text"]) for r in docs.collect()}
    assert set(by) == {k for k, (i, t) in keys.items() if t != rows[7][1]}
    for k, v in by.items():  # runs are whole: they hold most of the shared passage
        assert sum(r["end"] - r["start"] for r in v) >= 0.7 * len(shared) and all(r["doc_id"] == keys[k][0] for r in v)
    assert {r["first_doc_id"] for v in by.values() for r in v if shared[150:200] in keys[r["row_key"]][1][r["start"] : r["end"]]} == {None}
    cut = substring_dedup.remove(docs, found)
    left = [r["text"] for r in cut.collect()]
    # It stays in its first row and, as part of a run that is a first copy elsewhere, in the first of the rows with id 12.
    assert cut.columns == docs.columns and len(left) == 8 and sum(shared[150:200] in t for t in left) == 2
    assert rows[7][1] in left and sum(prose(40, 24)[100:150] in t for t in left) == 1
    pair = frame(spark, [(1, text[4], "a"), (1, text[4], "a")])
    alone = substring_dedup.spans(pair)
    assert sum(r["end"] - r["start"] for r in alone.collect()) == 2 * len(text[4])
    assert [r["text"] for r in substring_dedup.remove(pair, alone).collect()] == [text[4]] * 2


def test_chunks_cover_texts_and_resist_shifts(spark):
    text = prose(2000, 12)
    d = spark.createDataFrame([(1, text), (2, "An insertion. " + text)], "doc_id long, text string")
    rows = substring_dedup.chunks(d).collect()
    assert sum(r["length"] for r in rows if r["doc_id"] == 1) == len(text)
    one, two = ({(r["d1"], r["d2"]) for r in rows if r["doc_id"] == i} for i in (1, 2))
    assert len(one & two) >= 0.97 * len(one)


# ---- 2 ----
def test_sharding(spark, small, odd, empty):
    rows = sharding.manifest(small, 16).collect()
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    assert len(rows) == len(texts)
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        scores = [1 / -math.log((int(hashlib.md5(f"shard|{r['doc_id']}|{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) for i in range(17)]
        assert r["shard"] == int(np.argmax(scores[:16])) and r["grown_shard"] == int(np.argmax(scores))
        assert r["grown_shard"] in (r["shard"], 16)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sharding.manifest(odd, 4).count() == len(ODD) and sharding.manifest(empty, 4).count() == 0
    n = Counter(r["shard"] for r in sharding.assign(spark.range(4000).withColumnRenamed("id", "doc_id"), [1.0, 3.0]).collect())
    assert 0.7 < n[1] / 4000 < 0.8


# ---- 3 ----
def test_embedding_dedup(spark):
    r = np.random.default_rng(1)
    base = r.normal(size=(120, 16))
    vecs = [b + 0.05 * r.normal(size=16) * k for b in base for k in (0, 1, 1)] + [base[0] * 2] * 30
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    rows += [(900, None), (901, [0.0] * 16), (902, [1.0, None] + [0.0] * 14), (903, [float("nan")] * 16), (904, []), (905, [1.0, 2.0]), (906, [1.0, 2.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0)).withColumn("label", F.lit(1))
    got = {x["vec_id"]: x for x in embedding_dedup.links(df, cell=64, per_list=40).collect()}
    x = np.array(vecs, np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    assert sum(got[i]["n_links"] for i in range(len(vecs))) >= 0.95 * link.sum()
    assert all(got[i]["n_links"] <= link[i].sum() for i in range(len(vecs)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(900, 905))
    assert got[906]["component_id"] == 905 and got[905]["n_links"] == 1 and len(got) == len(rows)
    assert embedding_dedup.links(df.where("false")).count() == 0


def test_embedding_dedup_finds_links_across_many_lists(spark):
    """All links, counted at both ends, where a query has to probe far more than 16 lists."""
    r = np.random.default_rng(3)
    base = r.normal(size=(700, 24))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    vecs = np.concatenate([base] + [base + 0.4 * u / np.linalg.norm(u, axis=1, keepdims=True) for u in r.normal(size=(2, 700, 24))])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    x = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    link = x @ x.T >= 0.9
    np.fill_diagonal(link, False)
    want = components(spark.createDataFrame([(int(a), int(b)) for a, b in np.argwhere(link)], "a long, b long")).collect()
    want = {i: i for i in range(len(vecs))} | {v["id"]: v["component"] for v in want}
    for cell in (100, 8192):
        got = {v["vec_id"]: v for v in embedding_dedup.links(df, cell=cell, per_list=10).collect()}
        assert [got[i]["n_links"] for i in range(len(vecs))] == link.sum(1).tolist()
        assert {i: v["component_id"] for i, v in got.items()} == want


# ---- 4 ----
def brute_matches(docs, items, size):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: rx.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = defaultdict(set)
    for i, t in items:
        w = low(t)
        for j in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[j : j + size])].add(str(i))
    out = {}
    for k, (i, t) in enumerate(docs):
        w, hit, names = low(t), set(), set()
        for n in {len(x) for x in windows}:
            for j in range(len(w) - n + 1):
                if tuple(w[j : j + n]) in windows:
                    hit |= set(range(j, j + n))
                    names |= windows[tuple(w[j : j + n])]
        out[k] = (i, len(w), len(hit), len(names), decontamination.digest(list(names)), len(hit) > 0)
    return out


def test_decontamination(spark, small, sf, odd, empty):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [tuple(r) for r in bench.select("item_id", "text").collect()] + [(900, "One"), (901, None), (902, "cödé ünï"), (903, ""), (900, "One")]
    more = spark.createDataFrame(items, "item_id long, text string")
    docs = small.select("doc_id", "text").unionAll(odd.select("doc_id", "text"))
    rows = [tuple(r) for r in docs.collect()]
    want = sorted(map(repr, brute_matches(rows, items, 10).values()))
    for part in (1 << 20, 2000):  # in one pass, and in several over parts of the benchmark
        got = decontamination.report(decontamination.matches(docs, more, part_bytes=part)).collect()
        assert sorted(repr(tuple(r)[:6]) for r in got) == want
    assert any(r["contaminated"] for r in got) and all(r["n_near_items"] >= r["n_items"] for r in got)
    assert decontamination.matches(empty, more).count() == 0
    assert decontamination.report(decontamination.matches(odd, more.where("false"))).where("n_hit > 0").count() == 0


def test_decontamination_by_items_without_an_id(spark):
    items = spark.createDataFrame([(None, "alpha beta gamma"), (None, "delta epsilon"), (7, "alpha beta gamma")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x alpha beta gamma y delta epsilon"), (2, "delta epsilon"), (3, "zeta")], "doc_id long, text string")
    for part in (1 << 20, 20):
        got = decontamination.report(decontamination.matches(docs, items, part_bytes=part)).collect()
        assert {r["doc_id"]: (r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got} == {
            1: (5, 2, decontamination.digest(["7"]), True), 2: (2, 1, decontamination.digest([]), True), 3: (0, 0, decontamination.digest([]), False),
        }


def test_proximity(spark):
    item = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]
    docs = [(1, "x alpha beta gamma delta WORD epsilon zeta eta theta iota kappa y"), (2, "alpha beta gamma")]
    got = decontamination.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(item, "item_id long, text string"), slop=1)
    assert {r["doc_id"]: (r["n_hit"], list(r["near_items"])) for r in got.collect()} == {1: (0, ["1"]), 2: (0, [])}


# ---- 5 ----
def test_language_id(spark, sf, odd, empty):
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    model = language_id.train(docs)
    rows = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r["held_out"]]
    assert len(out) > 100 and all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) >= 0.97
    got = language_id.predict(odd, model).collect()
    assert len(got) == len(ODD) and {r["doc_id"]: r["lang_pred"] for r in got}[1] == "und"
    assert all(r["lang_pred"] == "und" and r["score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    nothing = language_id.train(docs.where("false"))
    assert {r["lang_pred"] for r in language_id.predict(odd, nothing).collect()} == {"und"}
    assert language_id.predict(empty, model).count() == 0


# ---- 6 ----
def test_toxicity(spark, odd, empty):
    bad = ["vilk" + s for s in ("an", "or", "esse", "ung", "iti", "olo", "ra", "em")]
    rows, labels = [], []
    for i in range(900):
        r = random.Random(i)
        words = prose(r.randint(10, 120), i).split()
        if i % 6 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(bad))
        rows.append((i, " ".join(words), "a"))
        labels.append((i, 1, int(i % 6 == 0)))
    docs = frame(spark, rows)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, lab)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(900) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in held) for i in range(900))
    assert sum(got[i]["predicted"] == int(i % 6 == 0) for i in held) / len(held) >= 0.95
    more = toxicity.score(odd, model).collect()
    assert len(more) == len(ODD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in more)
    assert toxicity.score(empty, model).count() == 0
    one = toxicity.fit(docs, lab.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(odd, one).collect()} == {0.0}


def test_gradients():
    """The network's analytic gradients agree with differences."""
    r = np.random.default_rng(2)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = r.normal(size=(30, toxicity.INPUTS))
    start, length, y = np.array([0, 5, 12]), np.array([4, 7, 6]), np.array([1.0, 0.0, 1.0])

    def loss():
        z = net.forward(x, start, length)[0]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = net.gradients(x, start, length, y)
    for k, v in net.p.items():
        i = tuple(0 for _ in v.shape)
        was = v[i]
        v[i] = was + 1e-3
        up = loss()
        v[i] = was - 1e-3
        down = loss()
        v[i] = was
        assert abs((up - down) / 2e-3 - g[k][i]) < 2e-3, k


# ---- 7 ----
def test_token_counts(spark, odd, empty):
    enc = token_counts.encoding(open(token_counts.VOCABULARY, "rb").read())
    n = np.array([len(enc.encode_ordinary(t or "")) for _, t, _ in ODD])
    table = token_counts.limits(token_counts.histogram(odd))
    for r in table.collect():
        L = r["n_tokens"]
        assert (r["n_docs"], r["docs_at_most"], r["tokens_at_most"]) == ((n == L).sum(), (n <= L).sum(), n[n <= L].sum())
        assert (r["docs_longer"], r["tokens_longer"], r["truncated_total"]) == ((n > L).sum(), n[n > L].sum(), np.minimum(n, L).sum())
    for r in token_counts.at_limits(table, [0, 1, 2, 7, 100, 10**6]).collect():
        assert r["truncated_total"] == np.minimum(n, r["context_limit"]).sum()
    got = {r["share"]: r["n_tokens"] for r in token_counts.quantiles(table, [0.5, 1.0]).collect()}
    assert got == {0.5: sorted(n)[math.ceil(0.5 * len(n)) - 1], 1.0: n.max()}
    assert token_counts.limits(token_counts.histogram(empty)).count() == 0


# ---- 8 ----
def brute_components(docs, k, num, den):
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("k,num,den", [(3, 90, 100), (5, 8, 10)])
def test_jaccard_join(spark, small, empty, k, num, den):
    near = []
    base = prose(300, 77).split()
    for i in range(60):  # a chain and a cloud of near copies: some link only through others
        w = list(base)
        for j in range(1 + i % 9):
            w[(7 * i + 31 * j) % 300] = f"edit{i}x{j}"
        near.append((5000 + i, " ".join(w), "a"))
    rows = near + [(6000, None, "a"), (6001, "", "a"), (6002, " ", "a"), (6003, "one two", "a"), (6004, "ONE  two", "a"), (6005, "three", "a")]
    docs = small.select("doc_id", "text").unionAll(frame(spark, rows).select("doc_id", "text")).withColumn("n", F.lit(1)).withColumn("token", F.lit(1))
    want = brute_components([tuple(r) for r in docs.select("doc_id", "text").collect()], k, num, den)
    for stars in (0, 1):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(docs, k, num, den, stars=stars).collect()}
        assert got == want
    assert jaccard_join.classes(empty, k, num, den).count() == 0


def test_jaccard_join_repeated_and_null_ids(spark, odd):
    got = jaccard_join.classes(odd, 3, 90, 100).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[7]["component_id"] == 6 and by[None]["component_id"] is None and by[1]["n_shingles"] == 0


# ---- 9 ----
def poisson(u, rate):
    k, p = 0, math.exp(-rate)
    c = p
    while c <= u:
        k += 1
        p *= rate / k
        c += p
    return k


def test_mixing(spark, small, odd, empty):
    size = defaultdict(int)
    docs = small.collect()
    for r in docs:
        size[r["source"]] += len(r["text"].encode()) + 1
    total = sum(size.values())
    want = {}
    for r in docs:
        u = (int(hashlib.md5(f"mix|{r['doc_id']}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        if n := poisson(u, total / len(size) / size[r["source"]]):
            want[r["doc_id"]] = n
    got = mixing.mix(small).groupBy("doc_id").agg(F.count("*").alias("n"), F.countDistinct("copy_no").alias("c")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == want and all(r["n"] == r["c"] for r in got)
    one = mixing.mix(small, weights={"src0": 1.0}, epochs=0.5)
    assert {r["source"] for r in one.select("source").distinct().collect()} == {"src0"}
    assert mixing.mix(odd, epochs=50.0).where("source IS NULL").count() > 0
    assert mixing.mix(empty).count() == 0
    large = mixing.rates(small, epochs=2000.0).first()
    assert large["rate"] > 500 and abs(large["cdf"][-1] - 1) < 1e-9


# ---- 10 ----
def test_warc(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77:1>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "http://a/1", "<p>one</p>"), (2, None, fake), (3, "http://a b\r\n/3", "x" + fake * 3 + "WARC/1.1\r\n"), (9, "u", "same"), (4, "u", "same"), (5, "u", "same"), (6, "u", None), (7, "u", ""), (None, "u", "same"), (8, "u", "é\r\n\r\n"), (8, "u", "é\r\n\r\n")]
    pages = spark.createDataFrame(rows * 1, "page_id long, url string, html string").withColumn("uid", F.lit(1)).withColumn("bytes", F.lit(1)).repartition(3)
    got = sorted(map(repr, (tuple(r) for r in warc.round_trip(pages).collect())))
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", 10**9), i)
    want, taken = [], set()
    for i, _, h in rows:
        raw = (h or "").encode()
        resp = i == first[h or ""] and (h or "") not in taken
        taken |= {h or ""} if resp else set()
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if resp else "revisit", None if resp else first[h or ""]))
    assert got == sorted(map(repr, want))
    assert warc.round_trip(pages.where("false")).count() == 0
    assert {r["record_type"] for r in warc.round_trip(pages, least=100).collect()} == {"response"}


def test_warc_broken_chain(spark, tmp_path):
    (tmp_path / "part-0.txt").write_bytes(b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\ntrailing")
    with pytest.raises(ValueError, match="broken chain"):
        warc.read(spark, str(tmp_path))


# ---- the queries and the pipeline ----
def test_every_query_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {k for k in names if re.match(r"op\d+_", k)} == set(queries.queries()) and len(queries.queries()) == 13 and "pipeline" in names


def test_pipeline(spark, sf, tmp_path):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in C.STAGES[:3]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name.replace(" ", "_")))
        kept = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        assert 0 < kept.count() <= docs.count()
        assert kept.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0
        docs = kept
    left = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 8, 10)
    assert all(v[1] == k for k, v in left.items())
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    assert not any(v[-1] for v in brute_matches([(r["doc_id"], r["text"]) for r in docs.collect()], bench, 10).values())
    mixed = C.STAGES[3][1](spark, docs, sf)
    assert mixed.columns == docs.columns
    assert set(C.STAGES[4][1](spark, mixed, sf).select("shard").distinct().toPandas()["shard"]) <= set(range(16))


def test_pipeline_stages_on_odd_rows(spark, sf):
    import corpus_pipeline as C

    docs = spark.createDataFrame([(i, t, None, s, None) for i, t, s in ODD], DOC)
    for name, stage in C.STAGES:
        for d in (docs, docs.where("false")):
            stage(spark, d, sf).count()


def test_pipeline_decides_by_row(spark, sf):
    """Rows without an id or with a shared one are judged by their own text, and only that."""
    import corpus_pipeline as C

    item = next(t for (t,) in spark.read.parquet(f"{sf}/benchmark.parquet").select("text").collect() if t and len(t.split()) > 12)
    a, b, c, d = (prose(40, 70 + k) for k in range(4))

    def stage(k, rows):
        docs = spark.createDataFrame([(i, t, "en", s, None) for i, t, s in rows], DOC)
        return sorted(((r["doc_id"], r["text"]) for r in C.STAGES[k][1](spark, docs, sf).collect()), key=repr)

    leaks = [(None, a, "a"), (None, f"{b} {item}", "a"), (1, b, "a"), (1, f"{c} {item}", "a"), (2, d, "a")]
    assert stage(2, leaks) == sorted([(None, a), (1, b), (2, d)], key=repr)
    near = [(None, a, "a"), (None, a, "a"), (None, b, "a"), (7, b, "a"), (3, c, "a"), (3, d, "a"), (4, d, "a"), (5, None, "a"), (5, "", "a")]
    assert stage(1, near) == sorted([(None, a), (7, b), (3, c), (3, d), (5, None), (5, "")], key=repr)
    many = [(None if k % 2 else 9, f"{a} {k}", "a") for k in range(200)]
    mixed = {t for _, t in stage(3, many)}
    assert all(40 <= sum(f"{a} {k}" in mixed for k in range(z, 200, 2)) <= 85 for z in (0, 1))


def test_pipeline_rejects_toxic_rows_alone(spark, sf, monkeypatch):
    import corpus_pipeline as C

    monkeypatch.setattr(toxicity, "fit", lambda docs, labels: None)
    monkeypatch.setattr(toxicity, "score", lambda docs, model: docs.select("doc_id", F.col("text").contains("vilk").cast("int").alias("predicted")))
    rows = [(None, "clean"), (None, "vilk one"), (1, "clean too"), (1, "vilk two"), (2, "vilk three"), (3, None)]
    out = C.reject_toxic(spark, spark.createDataFrame([(i, t, "en", "a", None) for i, t in rows], DOC), sf).collect()
    assert sorted((repr(r["doc_id"]), r["text"]) for r in out if r["text"]) == [("1", "clean too"), ("None", "clean")] and len(out) == 3


# ---- single faults, by value ----
def brute_spans(rows, bits=5, least=16, most=128, run=96):
    """Substring dedup by the letter: the gear hash of each place anew, cuts one by one, digests of bytes."""
    g = [int(x) for x in substring_dedup._GEAR]
    chunks = []
    for row, text in enumerate(rows):
        b = (text or "").encode()
        ends, last = [], None
        for i in range(31, len(b)):
            h = sum(g[b[i - k]] << k for k in range(32)) % 2**32
            if h >> (32 - bits) == 0:
                if last is None or i + 1 - last >= least:
                    ends.append(i + 1)
                last = i + 1
        ends = sorted({*ends, len(b)} - {0})
        full, at = [], 0
        for e in ends:
            full += [at + k * most for k in range(1, (e - at - 1) // most + 1)] + [e]
            at = e
        cut = sorted({next(j for j in range(e, len(b) + 1) if j == len(b) or b[j] & 0xC0 != 0x80) for e in full})
        chunks += [(row, a, z, b[a:z]) for a, z in zip([0, *cut], cut)]
    where = defaultdict(set)
    for row, _, _, x in chunks:
        where[x].add(row)
    out = []
    for row, a, z, x in chunks:
        if len(where[x]) > 1:
            if out and out[-1][0] == row and out[-1][2] == a:
                out[-1][2] = z
            else:
                out.append([row, a, z])
    return sorted((r, a, z) for r, a, z in out if z - a >= run)


def test_substring_dedup_against_brute_force(spark):
    r = random.Random(8)
    shared = [prose(60, 900), "Ünï cödé ÿ " * 20, "данные и слова " * 15, "x" * 700]
    rows = [None, "", "short"]
    for i in range(24):
        parts = [prose(r.randint(5, 60), 500 + i)] + r.sample(shared, r.randint(0, 3)) + ["ж" * r.randint(0, 30)]
        rows.append(" ".join(parts))
    rows += [rows[5], rows[5]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = sorted((x["doc_id"], x["start"], x["end"]) for x in substring_dedup.spans(docs).collect())
    assert got == brute_spans(rows) and len(got) > 20


def test_substring_dedup_removes_whole_characters(spark):
    text = " ".join(f"слово{i} и ещё одно" for i in range(60))
    docs = keyed(spark.createDataFrame([(i, f"{prose(9, i)} {text} {prose(9, 50 + i)}") for i in range(8)], "doc_id long, text string"))
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in substring_dedup.remove(docs, substring_dedup.spans(docs)).collect():
        raw, was = r["text"], before[r["doc_id"]]
        assert "\ufffd" not in raw and (raw == was or len(raw) < len(was) - 500)
        words = set(was.split())
        assert sum(w not in words for w in raw.split()) <= 2  # only where a cut joins two halves


def test_sharding_splits_one_key(spark):
    rows = [(None, "same", "a")] * 300 + [(7, "other", "a")] * 300
    got = sharding.manifest(frame(spark, rows), 4).collect()
    assert len(got) == 600
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_embedding_dedup_of_extreme_vectors(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 1e200]), (2, [2e-200, 2e-200]), (3, [5e-324, 0.0]), (4, [0.0, 1e308]), (5, [1e308, 0.0]), (6, [float("inf"), 1.0]), (7, [0.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 0), 3: (1, 3), 4: (0, 4), 5: (1, 3), 6: (0, 6), 7: (0, 7)}


def test_language_id_against_brute_force(spark, small):
    """The score of a text is that of its kernel with each landmark, summed up one by one."""
    model = language_id.train(small, per_language=40, landmarks=24)
    docs = small.where("doc_id % 40 = 1").collect()
    got = {r["doc_id"]: r for r in language_id.predict(small.where("doc_id % 40 = 1"), model).collect()}
    for d in docs:
        own = language_id.presence([d["text"]], model.dims)[0]
        if not any(c.isalpha() for c in d["text"]):
            assert got[d["doc_id"]]["lang_pred"] == "und"
            continue
        on = np.flatnonzero(own)
        k = [sum(float(model.z[i, j]) for i in on) / math.sqrt(len(on)) for j in range(model.z.shape[1])]
        f = [sum(k[j] * float(model.w[j, c]) for j in range(len(k))) + float(model.b[c]) for c in range(len(model.langs))]
        assert got[d["doc_id"]]["lang_pred"] == model.langs[int(np.argmax(f))] and abs(got[d["doc_id"]]["score"] - min(1, max(0, (max(f) + 1) / 2))) < 1e-3
    many = spark.createDataFrame([(i, "a b") for i in range(3000)], "doc_id long, text string")
    assert language_id.predict(many, model).select("lang_pred", "score").distinct().count() == 1


def test_toxicity_learns_what_tables_cannot_say():
    """Two words, each as often toxic as not, whose order alone tells: embeddings learn it, evidence alone does not."""
    r, texts, y = random.Random(3), [], []
    for i in range(3000):
        q = random.Random(i)
        w = ["".join(q.choice("bcdfglmnprst") + q.choice("aeiou") for _ in range(q.randint(1, 2))) for _ in range(14)]
        k = r.randrange(0, 12)
        w[k:k] = ["kova", "zhul"] if i % 2 else ["zhul", "kova"]
        texts.append(" ".join(w))
        y.append(i % 2)
    y = np.array(y)

    def right(slow):
        model = toxicity.train(texts[:2000], y[:2000], rate=0.02, slow=slow, patience=12)
        joined = "".join(texts[2000:]).encode()
        offs = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts[2000:]])])
        return ((model.score(np.frombuffer(joined, np.uint8), offs) >= 0.5) == y[2000:]).mean()

    assert right(1.0) > 0.85 and right(0.0) < 0.65


def test_token_counts_of_white_space(spark):
    with open(token_counts.VOCABULARY, "rb") as f:
        enc = token_counts.encoding(f.read())
    was, token_counts.RUN = token_counts.RUN, 3
    try:
        r = random.Random(1)
        for _ in range(2000):
            t = "".join(r.choice(["a", " ", "  ", "   ", "\n", "\t", "1", ",", "\u2003", "\xa0", "é", "'s", "    \n   "]) for _ in range(r.randint(0, 14)))
            assert token_counts.count(enc, t) == len(enc.encode_ordinary(t)), repr(t)
    finally:
        token_counts.RUN = was
    long = spark.createDataFrame([(1, " " * 5_000_000), (2, "\n" * 1_000_000 + "a"), (3, "a" * 300_000)], "doc_id long, text string")
    assert token_counts.histogram(long).agg(F.sum("n_docs")).first()[0] == 3


def test_mixing_keeps_columns_of_any_name(spark, small):
    names = ("_cdf", "_rate", "_n", "_source", "_order", "u", "n", "low", "cdf", "doc", "place")
    docs = small
    for c in names:
        docs = docs.withColumn(c, F.concat(F.lit(c), F.col("doc_id").cast("string")))
    got = mixing.mix(docs)
    assert got.columns == [*docs.columns, "rate", "copy_no"]
    assert got.where(" OR ".join(f"`{c}` != concat('{c}', cast(doc_id AS string))" for c in names)).count() == 0
    assert got.count() == mixing.mix(small).count()


def test_mixing_at_high_rates(spark):
    docs = spark.createDataFrame([(i, "x" * 99, "rare" if i == 0 else "many") for i in range(200)], "doc_id long, text string, source string")
    want = 20_000 * 100 / 2 / 100 * 100 / 100  # half of 100 times the bytes, over 100 bytes
    n = mixing.mix(docs, epochs=100.0).where("source = 'rare'").count()
    assert abs(n - want) < 6 * math.sqrt(want)
    top = mixing.rates(docs, epochs=100.0).where("_source = '=rare'").first()
    assert top["low"] > 8000 and abs(top["cdf"][-1] - 1) < 1e-9 and top["cdf"][0] < 1e-12


def test_warc_rotates_by_bytes_and_reads_lone_revisits(spark, tmp_path):
    import os

    pages = spark.createDataFrame([(i, f"http://a/{i}", ("p%d " % i) * (20_000 if i >= 190 else 3)) for i in range(200)], "page_id long, url string, html string")
    warc.write(pages.coalesce(1), str(tmp_path / "a"), archive_bytes=100_000)
    sizes = [os.path.getsize(tmp_path / "a" / f) for f in os.listdir(tmp_path / "a") if f.startswith("part")]
    assert max(sizes) < warc.SPREAD * 100_000 and len(warc.read(spark, str(tmp_path / "a")).collect()) == 200
    os.mkdir(tmp_path / "b")
    head = "WARC/1.1\r\nWARC-Type: revisit\r\nWARC-Record-ID: <urn:page:5:00>\r\nWARC-Payload-Digest: sha1:ABC\r\nWARC-Refers-To: <urn:page:2>\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    (tmp_path / "b" / "x.warc").write_bytes(head.encode())
    assert [tuple(r) for r in warc.read(spark, str(tmp_path / "b")).collect()] == [(5, None, "ABC", "revisit", 2)]


def test_words_that_a_polynomial_would_confuse():
    """Thue-Morse words and their complements collide under any polynomial hash modulo 2**64."""
    from loomstone.llm import _text

    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    raw = f"{a} {b} {a[:24]} {b[:24]} {a.upper()}".encode()
    data = np.frombuffer(raw, np.uint8)
    s, e, _ = _text.words(data, np.array([0, len(raw)]), _text.word_bytes("alnum"))
    h = _text.range_hashes(data, s, e).tolist()
    assert h[0] == h[4] and len(set(h)) == 4


def test_jaccard_join_splits_hot_tokens(spark, monkeypatch):
    """Tokens, leaders, pairs and stars beyond the bound of one task, and tokens with more classes than a cell."""
    from loomstone.llm import _runtime

    monkeypatch.setattr(_runtime, "HOT_ROWS", 20)
    monkeypatch.setattr(_runtime, "HOT_SHARE", 50)
    monkeypatch.setattr(jaccard_join, "CELL", 16)
    monkeypatch.setattr(jaccard_join, "STEP", 64)
    base = prose(120, 5).split()
    rows = [(i, " ".join([*base[:60], f"own{i}", *base[60:], f"end{i}"]), "a") for i in range(90)]
    rows += [(100 + i, " ".join([*base[:40], *prose(80, 300 + i).split()]), "a") for i in range(40)]
    docs = frame(spark, rows).select("doc_id", "text")
    want = brute_components([tuple(r) for r in docs.collect()], 3, 90, 100)
    assert len({c for _, c in want.values()}) > 40
    for stars in (0, 1):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.classes(docs, 3, 90, 100, stars=stars).collect()}
        assert got == want


def test_spread_join(spark, monkeypatch):
    from loomstone.llm import _runtime

    monkeypatch.setattr(_runtime, "HOT_ROWS", 3)
    many = spark.createDataFrame([(0, i) for i in range(50)] + [(k, k) for k in range(1, 20)], "k long, v long")
    one = spark.createDataFrame([(k, -k) for k in range(15)], "k long, w long")
    hot = _runtime.hot_keys(many.groupBy("k").agg(F.count("*").alias("n")), "k", "n", many.count())
    assert [r["k"] for r in hot.collect()] == [0]
    assert sorted(map(tuple, _runtime.spread_join(many, one, "k", hot, "v").collect())) == sorted(map(tuple, many.join(one, "k").collect()))
