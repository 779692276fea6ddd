import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from docloom.llm import decontam, jaccard, kernels, lang_id, line_dedup, mixing, phrase_dedup, pii, quality_knn, rules, token_count
from tests.llm import brute

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows():
    return brute.documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], brute.SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark, rows):
    items = [(1, " ".join(rows[8][1].split(" ")[2:16])), (20, rows[11][1].upper()), (3, "two WORDS"), (4, ""), (5, None), (None, rows[9][1]), (20, rows[12][1])]
    return spark.createDataFrame([(*x, "row") for x in items], "item_id long, text string, row string"), items


def same(df, columns, expected):
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(expected)


def test_kernels_split_like_the_patterns(rows):
    import pyarrow as pa

    column = pa.array([r[1] for r in rows])
    for table, low, pattern in ((kernels.PLAIN_WORD, False, brute.WORD), (kernels.ALNUM_WORD, True, brute.CONTENT)):
        got = []
        for w in kernels.words(column, table, low):
            for r in range(w.last - w.first):
                got.append([w.data[w.start[i] : w.end[i]].tobytes().decode() for i in range(w.rows[r], w.rows[r + 1])])
        assert got == [pattern.findall(brute.lower(r[1]) if low else r[1] or "") for r in rows]


def test_language(spark, docs, empty):
    en, fr = "the cat sat on the mat with those other things", "le chat était sur la chaise avec les élèves"
    data = [(i, (en if i % 2 else fr) + f" {i}", "en" if i % 2 else "fr") for i in range(60)] + [(100, None, "en"), (101, "", None), (102, "123 ?", "fr"), (None, en, "xx"), (103, en * 40_000, None)]
    got = {r["doc_id"]: r for r in lang_id.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(data)
    assert all(got[i]["lang_pred"] == ("en" if i % 2 else "fr") and 0 <= got[i]["score"] <= 1 for i in range(60))
    assert [got[i]["lang_pred"] for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "en"]
    assert lang_id.identify(docs).count() == docs.count()
    assert lang_id.identify(empty).count() == 0


@pytest.mark.parametrize("text", ["Éla b’c d ef 12 ghi\n" * 50, "  a" * 100, "", "x", "   ", "ab" * 64, " " * 64 + "ab " + " " * 63])
def test_language_counts_do_not_depend_on_chunks(monkeypatch, text):
    row, bucket, n, _ = lang_id._short_counts([text], 4096)
    whole = np.bincount(bucket, weights=n, minlength=4096)
    for chunk in (1, 2, 3, 64):
        monkeypatch.setattr(lang_id, "CHUNK", chunk)
        assert (lang_id._long_counts(text, 4096) == whole).all()


def test_language_against_brute_force(docs, rows, monkeypatch):
    """Naive Bayes of the n-gram strings themselves, in buckets; blocks of one or two languages give the same."""
    def counts(text):
        c = "".join(x.lower() if x.isalpha() and len(x.lower()) == 1 else x if x.isalpha() else " " for x in text or "")
        c = re.sub(" +", " ", f" {c} ")
        grams = [[ord(x) for x in c[i - k : i]] for i in range(1, len(c) + 1) for k in (1, 2, 3) if i >= k]
        out = Counter()
        for g in grams:
            codes = np.array(g, dtype=np.uint32)
            r, h = lang_id._grams(codes, np.zeros(len(g), np.int64), lang_id.BUCKETS, np.arange(len(g)) < len(g) - 1)
            out[int(h[len(g) - 1])] += 1
        return out if c.strip() else None

    data = [r for r in rows if len(r[1] or "") < 2000]
    sums, n_docs = defaultdict(Counter), Counter()
    for d, t, lang, *_ in data:
        if d is not None and lang is not None and zlib.crc32(str(d).encode()) % 4 != 2 and (c := counts(t)):
            sums[lang].update(c)
            n_docs[lang] += 1
    want = []
    for d, t, *_ in data:
        c, best = counts(t), {}
        for lang in sorted(sums):
            total = sum(sums[lang].values()) + lang_id.BUCKETS
            best[lang] = np.log(n_docs[lang] / sum(n_docs.values())) + sum(n * np.log((sums[lang][b] + 1) / total) for b, n in (c or {}).items())
        top = max(best, key=best.get)
        want.append((d, d is not None and zlib.crc32(str(d).encode()) % 4 == 2, top if c else "und", round(1 / sum(np.exp(v - best[top]) for v in best.values()), 6) if c else 0.0))
    small = docs.where("text is null or length(text) < 2000")
    for block in (256, 1):
        monkeypatch.setattr(lang_id, "LANGS", block)
        got = Counter((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 6)) for r in lang_id.identify(small).collect())
        assert got == Counter(want)


def test_mixing(docs, rows, empty):
    got = mixing.digest(docs).collect()
    source = {r[0]: r[3] for r in rows}
    sizes = Counter()
    for _, t, _, s, *_ in rows:
        sizes[s] += len(brute.WORD.findall(t or ""))
    want = brute.targets(dict(sizes))
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["taken"] <= 3 * r["size"]
        assert len(r["shards"]) * r["size"] >= r["taken"] > (len(r["shards"]) - 1) * r["size"] or not r["taken"]
        taken[s] += r["taken"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 3 for s in want)
    assert Counter(map(str, got)) == Counter(map(str, mixing.digest(docs).collect()))
    assert mixing.digest(empty).count() == 0
    assert sum(r["words"] for r in mixing.draws(mixing.mix(docs)).collect()) == sum(taken.values())


def _md5(*parts):
    return int(hashlib.md5("|".join(["docloom", *[str(p) if p is not None else "null" for p in parts]]).encode()).hexdigest()[:15], 16)


@pytest.mark.parametrize("pools", [1024, 2])
def test_shards_against_brute_force(spark, docs, rows, monkeypatch, pools):
    """Blocks, permutations and the dealing to shards recomputed row by row; the quotas are those of the tree."""
    monkeypatch.setattr(mixing, "POOLS", pools)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 300)
    size = lambda t: len(brute.WORD.findall(t or ""))
    by_source = defaultdict(list)
    for d, t, _, s, *_ in rows:
        by_source[s].append((d, size(t)))
    want = brute.targets({s: sum(n for _, n in x) for s, x in by_source.items()})
    names = sorted((s for s in by_source if s is not None)) + [None]
    plan, k = {}, []
    for rank, s in enumerate(names):
        total = sum(n for _, n in by_source[s])
        passes, rest = divmod(int(want[s] + 0.5), total)
        n = max(1, -(-total // 300))
        key = "null" if s is None else "=" + s
        words = Counter()
        for d, z in by_source[s]:
            words[_md5("doc", d) % n] += z
        held = {_md5("doc", d) % n for d, _ in by_source[s]}
        order = sorted(held, key=lambda b: (_md5("block", key, b), b))
        before, draws = 0, {}
        for at, b in enumerate(order):
            draws[b] = (at, passes + (max(0, min(words[b], rest - before)) > 0))
            before += words[b]
        plan[s] = (n, len(order), draws)
        k.append((rank, sum(x for _, x in draws.values())))
    ends = {r["rank"]: r["ends"] for r in mixing.quotas(spark.createDataFrame(k, "rank long, k long")).collect()}
    assert all(ends[rank][-1] == x and len(ends[rank]) == mixing.SHARDS for rank, x in k)
    per_shard = [sum((e[i] - (e[i - 1] if i else 0)) for e in ends.values()) for i in range(mixing.SHARDS)]
    assert max(per_shard) - min(per_shard) <= 1
    taken = Counter()
    got = mixing.digest(docs).collect()
    source = {r[0]: r[3] for r in rows}
    for r in got:
        s = source[r["doc_id"]]
        n, blocks, draws = plan[s]
        at, many = draws[_md5("doc", r["doc_id"]) % n]
        shards = [sum(e <= p * blocks + at for e in ends[names.index(s)]) for p in range(many)]
        assert r["shards"] == shards[: len(r["shards"])] and len(r["shards"]) >= (many - 1 if r["size"] else 0)
        assert r["places"] == [_md5("local", x, i, r["doc_id"]) for i, x in enumerate(r["shards"])]
        taken[s] += r["taken"]
    drawn = mixing.draws(mixing.mix(docs)).select("shard", "place", "words").collect()
    assert len(drawn) == sum(len(r["shards"]) for r in got)
    assert [r[:2] for r in drawn] == sorted(r[:2] for r in drawn)


def test_splitting_tree_keeps_quotas(spark):
    counts = [1000, 1, 0, 333, 5]
    df = spark.createDataFrame([(0, counts)], "pool int, counts array<long>").withColumn("rooms", mixing.even_rooms(F.col("counts"), 7))
    leaves = mixing.splitting_tree(df, 7).collect()
    by_stratum, by_shard = Counter(), Counter()
    for r in leaves:
        assert r["quota"] >= 0
        by_stratum[r["stratum"]] += r["quota"]
        by_shard[r["shard"]] += r["quota"]
    assert [by_stratum[i] for i in range(5)] == counts
    assert max(by_shard.values()) - min(by_shard.values()) <= 1
    assert all(abs(r["quota"] - 1000 / 7) < 60 for r in leaves if r["stratum"] == 0)


def test_mixing_many_sources(spark):
    n = 3000
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.concat(F.lit("host"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("source"))
    want = brute.targets({f"host{i:05}": 4 for i in range(n)})
    got = mixing.digest(df).collect()
    assert len(got) == n and all(r["target"] == pytest.approx(want[f"host{r['doc_id']:05}"]) and abs(r["taken"] - r["target"]) <= 1 for r in got)
    by_shard = Counter(x for r in got for x in r["shards"])
    assert max(by_shard.values()) - min(by_shard.values()) <= 1


def test_quality(spark, docs, empty):
    good, bad = "Some plain words stand here in order, and they end", "some*** plain$$$ words%%% stand### here&&& in*** order"
    data = [(i, (bad if i % 3 == 0 else good) + f" {i}") for i in range(120)] + [(200, None), (201, ""), (202, good * 20_000), (None, good)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(120)] + [(None, 1, 0), (5, None, 0), (999, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality_knn.classify(spark.createDataFrame(data, "doc_id long, text string"), labels).collect()}
    assert len(got) == len(data) and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["predicted"] == int(i % 3 > 0) for i in range(120)) and got[202]["predicted"] == 1 and got[200]["score"] == got[201]["score"] == 0
    assert quality_knn.classify(docs, labels.limit(0)).where("score = 0.5").count() == docs.count()
    assert quality_knn.classify(empty, labels).count() == 0


def test_quality_against_brute_force(spark, docs, rows):
    """Term counts word by word, a full SVD, all cosines and votes in plain loops."""
    import pyarrow as pa

    def hashed(words):
        return next(kernels.words(pa.array([" ".join(words)]))).hash if words else np.zeros(0, np.uint64)

    def counts(text):
        words = brute.WORD.findall(text or "")
        h, out = hashed(words), Counter()
        shift = 64 - (quality_knn.BUCKETS.bit_length() - 1)
        put = lambda x: out.update([int(kernels.mix(np.array([x], np.uint64))[0]) >> shift])
        for i, w in enumerate(words):
            put(h[i])
            if i:
                put(kernels.windows(h[i - 1 : i + 1], 2)[0])
            ending = 0
            for k in range(1, 4):
                raw = w.encode()
                ending = (ending * 257 + (raw[-k] if k <= len(raw) else 0)) % (1 << 64)
            put(kernels.mix(np.array([ending ^ 0xE7D1], np.uint64))[0])
            for k in (1, 2, 3):
                if i >= k and words[i - k] == w:
                    put(kernels.mix(np.array([0xB0B0 + k], np.uint64))[0])
        return out

    data = [r for r in rows if r[0] is not None]
    labels = [(r[0], int(len(r[1] or "") % 3 > 0)) for r in data if r[0] % 2 == 0]
    held = {r[0] for r in data if zlib.crc32(str(r[0]).encode()) % 5 == 0}
    bank = [(counts(t), float(dict(labels)[d])) for d, t, *_ in data if d in dict(labels) and d not in held and brute.WORD.search(t or "")]
    n = len(bank)
    idf = {b: np.log((1 + n) / (1 + sum(b in c for c, _ in bank))) + 1 for b in range(quality_knn.BUCKETS)}

    def vector(c):
        x = np.zeros(quality_knn.BUCKETS)
        for b, k in c.items():
            x[b] = np.log1p(k) * idf[b]
        return x

    matrix = np.array([vector(c) / np.linalg.norm(vector(c)) for c, _ in bank])
    axes = np.linalg.svd(matrix, full_matrices=False)[2][: quality_knn.RANK].T
    unit = lambda x: x / max(np.linalg.norm(x), 1e-12)
    latent = np.array([unit(vector(c) @ axes) for c, _ in bank])
    want = {}
    for d, t, *_ in data:
        c = counts(t)
        near = sorted(((float(unit(vector(c) @ axes) @ z), y) for z, (_, y) in zip(latent, bank, strict=True)), reverse=True)
        near = [(max(a, 1e-6), y) for a, y in near if a >= near[quality_knn.NEIGHBOURS - 1][0] - 1e-6]
        want.setdefault((d, t), sum(a * y for a, y in near) / sum(a for a, _ in near) if c else 0.0)
    got = quality_knn.classify(docs.where("doc_id is not null"), spark.createDataFrame(labels, "doc_id long, quality int")).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert len(got) == len(data)
    assert all(r["held_out"] == (r["doc_id"] in held) and r["score"] == pytest.approx(want[r["doc_id"], r["text"]], abs=2e-3) for r in got)


def _one_each(rows):
    """(id, text) of the row that stays of each group."""
    out = []
    for g in brute.groups(rows):
        out += [rows[i][:2] for i in g] if not brute.shingles(rows[g[0]][1]) else []
        if brute.shingles(rows[g[0]][1]):
            least = min((rows[i][0] is None, rows[i][0] or 0) for i in g)
            out.append({rows[i][:2] for i in g if (rows[i][0] is None, rows[i][0] or 0) == least})
    return out


def _same_representatives(got, rows):
    """Each group leaves one of its candidates, and no other row stays."""
    want = _one_each(rows)
    plain = Counter(x for x in want if isinstance(x, tuple))
    left = Counter(tuple(r[c] for c in ("doc_id", "text")) for r in got)
    assert sum(left.values()) == len(want)
    left -= plain
    for candidates in (x for x in want if isinstance(x, set)):
        match = [c for c in candidates if left[c]]
        assert len(match) == 1
        left[match[0]] -= 1


@pytest.mark.parametrize(("hot", "block"), [(48, 768), (3, 768), (3, 2)])
def test_jaccard(docs, rows, empty, monkeypatch, hot, block):
    monkeypatch.setattr(jaccard, "HOT", hot)
    monkeypatch.setattr(jaccard, "ROWS", block)
    want = brute.components(rows)
    same(jaccard.link(docs).where("doc_id is not null"), ("doc_id", "n_shingles", "component_id"), [(r[0], len(brute.shingles(r[1])), want[r[0]]) for r in rows if r[0] is not None])
    assert jaccard.link(empty).count() == 0
    _same_representatives(jaccard.representatives(docs).collect(), rows)


def test_jaccard_rows_that_share_an_id(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(30)) for c in "abcde"}
    plain = [(3, text["b"]), (5, text["b"]), (5, text["a"]), (7, text["a"]), (7, text["a"]), (None, text["c"]), (None, text["c"]), (9, text["c"]), (None, text["d"]), (None, text["d"]), (9, None), (4, ""), (4, text["e"]), (3, text["e"])]
    df = spark.createDataFrame(plain, "doc_id long, text string")
    got = Counter((r[0], r[1], r[2]) for r in jaccard.link(df).collect())
    want = brute.components(plain)
    assert {k: v for k, v in got.items() if k[0] is not None} == Counter((d, len(brute.shingles(t)), want[d]) for d, t in plain if d is not None)
    assert got[(None, 26, None)] == 2 and got[(None, 26, 9)] == 2
    left = jaccard.representatives(df).collect()
    _same_representatives(left, plain)
    assert {(3, text["b"]), (5, text["a"])} <= {(r[0], r[1]) for r in left}


def test_jaccard_chain_of_near_copies(spark):
    words = [f"w{i}" for i in range(80)]
    data = []
    for i in range(60):
        words[i] = f"new{i}"
        data.append((1000 - i, " ".join(words)))
    got = jaccard.link(spark.createDataFrame(data, "doc_id long, text string")).select("component_id").distinct().collect()
    assert [r[0] for r in got] == [941]


def test_rules(docs, rows, empty):
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same(rules.digest(docs), names, [(r[0], *brute.rules(r[1])) for r in rows])
    assert rules.digest(empty).count() == 0
    assert set(rules.clean(docs).columns) == set(docs.columns)


def test_host_verdict(spark):
    good = "these are ten plain words that no rule rejects at all {}"
    data = [(i, good.format(i) if i % 10 else "bad", "fine") for i in range(200)] + [(1000 + i, good.format(i) if i % 10 == 0 else "bad", "spam") for i in range(200)]
    got = rules.digest(spark.createDataFrame(data, "doc_id long, text string, source string")).where("not base_failed").groupBy("kept").count().collect()
    assert {r[0]: r[1] for r in got} == {True: 180, False: 20}


def test_decontamination(docs, rows, benchmark, empty, monkeypatch):
    items, plain = benchmark
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = [(r[0], *brute.decontaminated(r[1], plain)) for r in rows]
    same(decontam.hits(docs, items), names, want)
    monkeypatch.setattr(decontam, "TERMS", 3)
    same(decontam.hits(docs, items), names, want)
    assert decontam.hits(docs, items.limit(0)).where("contaminated").count() == 0
    assert decontam.hits(empty, items).count() == 0
    clean = decontam.clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in want)


def test_proximity(spark):
    data = [(1, "alpha beta x gamma delta"), (2, "alpha q q q q q q delta beta gamma"), (3, "alpha beta gamma delta"), (4, "Beta alpha gamma delta"), (None, "zz alpha beta gamma x delta"), (5, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    item = spark.createDataFrame([(7, "alpha beta gamma delta")], "item_id long, text string")
    got = Counter((r["doc_id"], r["exact"]) for r in decontam.find_matches(docs, item)[1].collect())
    assert got == Counter({(3, True): 1, **{(d, False): 1 for d, t in data if _near(t, "alpha beta gamma delta", data)}}) and (1, False) in got
    counts = {r["doc_id"]: (r["n_items"], r["n_near_items"]) for r in decontam.hits(docs, item).collect()}
    assert counts[3] == (1, 1) and counts[1] == (0, 1) and counts[2] == counts[5] == (0, 0)


def _near(text, window, data):
    words, terms = brute.CONTENT.findall(brute.lower(text)), window.split(" ")
    total = Counter(w for _, t in data for w in brute.CONTENT.findall(brute.lower(t)))
    rare = min(range(len(terms)), key=lambda o: (total[terms[o]], o))
    starts = [p - rare for p, w in enumerate(words) if w == terms[rare]]
    fits = lambda s, d: all(any(0 <= s + o + e < len(words) and words[s + o + e] == t for e in range(-d, d + 1)) for o, t in enumerate(terms))
    return any(fits(s, 1) and not fits(s, 0) for s in starts)


def test_personal_data(docs, rows, empty):
    same(pii.digest(docs), ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"), [(r[0], *brute.personal(r[1])) for r in rows])
    assert pii.digest(empty).count() == 0
    clean = pii.sanitize(docs)
    assert clean.columns == docs.columns
    assert clean.where("text like '%@host-%'").count() == 0 and clean.where("text like '%<email>%'").count() > 0
    assert clean.where("text is null").count() == docs.where("text is null").count()


@pytest.mark.parametrize("text", ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.1", "4111111111111111", "4111 1111 1111 1112", "+1 23-45.67(89)0", "+12345678 +123456789", "😀 x@y.zz 😀 1.1.1.1", "@a.b x@ y@z", "0001.002.3.4", "a@b.c" * 2000, "1." * 5000, "9" * 3000, "x" * 50_000 + "@"])
def test_personal_data_edges(spark, text):
    same(pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")), ("n_email", "n_ip", "n_card", "n_phone", "base_sha256"), [brute.personal(text)])


@pytest.mark.parametrize("limit", [0.85, 0.6])
def test_terms_against_brute_force(docs, rows, monkeypatch, limit):
    monkeypatch.setattr(pii, "MIN_DISCLOSURE", limit)
    instead = brute.telling(rows, least=limit)
    assert limit > 0.8 or len(set(instead.values())) > 2
    want = Counter((d, ",".join(f"{a}:{b}:{x}" for a, b, x in brute.term_spans(t, instead))) for d, t, *_ in rows)
    got = pii.digest(docs).collect()
    assert Counter((r["doc_id"], r["actions"]) for r in got) == want
    assert all([":".join(x.split(":")[:2]) for x in r["actions"].split(",")] == [x[5:] for x in r["spans"].split(",") if x.startswith("term:")] or not r["actions"] for r in got)


def test_very_many_entities_in_one_text(spark):
    import time

    n = 100_000
    text = " ".join(f"u{i}@mail{i}.org name{i % 50}" for i in range(n))
    began = time.time()
    got = pii.digest(spark.createDataFrame([(1, text), (2, "plain")], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["n_email"] for r in got} == {1: n, 2: 0}
    assert time.time() - began < 60


def test_running_sums(spark):
    for n in (0, 1, 255, 256, 257, 70_000):
        got = spark.range(1).select(pii.running(F.expr(f"transform(slice(sequence(0, {n}), 1, {n}), x -> cast(x % 7 as int))")).alias("x")).first()[0]
        assert got == np.cumsum(np.arange(n) % 7).tolist()


def test_telling_terms(spark):
    data = [(i, f"please contact user{i}@mail{i}.org soon about topic number {i}") for i in range(40)] + [(100 + i, f"nothing about this soon topic number {i}") for i in range(200)]
    got = pii.digest(spark.createDataFrame(data, "doc_id long, text string")).collect()
    by_id = {r["doc_id"]: r for r in got}
    text = data[3][1]
    at = text.index("contact")
    assert f"term:{at}:{at + 7}" in by_id[3]["spans"] and f"term:{text.index('about')}" not in by_id[3]["spans"]
    assert all(by_id[100 + i]["spans"] == "" for i in range(200))


def _marked(df):
    """The texts of the term spans by doc_id."""
    out = {}
    for d, text, spans in [(r["doc_id"], r["text"], r["spans"]) for r in pii.digest(df).join(df, "doc_id").collect()]:
        cut = [s.split(":") for s in spans.split(",") if s.startswith("term:")]
        out[d] = [text[int(a) : int(b)] for _, a, b in cut]
    return out


def test_terms_that_tell_one_entity(spark):
    plain = [(1000 + i, f"day {i} was plain and long and at the end of it came rain") for i in range(200)]
    named = [(i, f"day {i} was long and Kowalczyk at one@mail.org the end") for i in range(8)]
    copies = [(100 + i, "copied Zebrafish near other@mail.org and the end") for i in range(30)]
    got = _marked(spark.createDataFrame(plain + named + copies, "doc_id long, text string"))
    assert all(got[i] == ["Kowalczyk"] for i in range(8))
    assert not any(got[i] for i in got if i >= 100)


def test_telling_terms_far_from_entities(spark):
    plain = [(1000 + i, f"day {i} was plain and long and at the end of it came rain") for i in range(200)]
    named = [(i, f"day {i} was long and Kowalczyk at one@mail.org the end" + (" rain" * 20 + " Kowalczyk" if i == 0 else "")) for i in range(12)]
    far = [(500, "KOWALCZYK was long at the end"), (501, "KOWALCZYK was long at the end"), (502, None)]
    df = spark.createDataFrame(plain + named + far, "doc_id long, text string")
    got = _marked(df)
    assert got[0] == ["Kowalczyk", "Kowalczyk"] and got[1] == ["Kowalczyk"]
    assert got[500] == got[501] == ["KOWALCZYK"] and got[502] == []
    assert not any(got[i] for i in got if i >= 1000)
    assert pii.sanitize(df).where("lower(text) like '%kowalczyk%'").count() == 0


def test_line_dedup(docs, rows, empty):
    want = brute.boilerplate(rows, 0.1, 3)
    got = line_dedup.drop_lines(docs, ratio=0.1, min_pages=3).select("row.doc_id", "clean_text")
    same(got, ("doc_id", "clean_text"), [(r[0], t) for r, t in zip(rows, want, strict=True)])
    assert any(r[1] != t for r, t in zip(rows, want, strict=True))
    assert line_dedup.digest(empty).count() == 0
    clean = line_dedup.clean(docs)
    assert clean.columns == docs.columns and clean.where(F.length("text") != F.col("n_chars")).count() == 0


@pytest.mark.parametrize(("shard", "chunk", "hot"), [(20_000, 1_000_000, 2000), (5, 300, 3)])
def test_substring_dedup(docs, rows, empty, monkeypatch, shard, chunk, hot):
    for name, value in (("SHARD_PHRASES", shard), ("CHUNK_WORDS", chunk), ("HOT", hot)):
        monkeypatch.setattr(phrase_dedup, name, value)
    same(phrase_dedup.digest(docs), ("doc_id", "n_words", "n_removed", "kept_sha256"), [(r[0], *x) for r, x in zip(rows, brute.substrings(rows), strict=True)])
    assert phrase_dedup.digest(empty).count() == 0


def test_token_counts(docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = [(r[0], len((r[1] or "").encode()), len(t.encode(r[1] or "", add_special_tokens=False))) for r in rows]
    same(token_count.count_tokens(docs, TOKENIZER), ("doc_id", "n_bytes", "n_tokens"), want)
    same(token_count.count_tokens(docs, TOKENIZER, chunk=700, overlap=64), ("doc_id", "n_bytes", "n_tokens"), want)
    assert token_count.count_tokens(empty, TOKENIZER).count() == 0


@pytest.mark.parametrize("text", ["", " ", "a  b", "x <|endoftext|> y", "don't we'll '  x", "a\u0085 b c", "　 a", " \n\n x", "é 12 ½ ２ b", "   " * 900 + "x" * 900, "<|endoftext|>" * 200, "漢字かな" * 600, "!" * 3000])
def test_token_counts_edges(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    want = len(t.encode(text, add_special_tokens=False))
    assert token_count._Memo(t).count([text, text]) == [want, want]
    assert token_count.spliced_count(t, text, 600, 32) == want


def test_pipeline_against_brute_force(spark, docs, rows, benchmark, tmp_path, monkeypatch):
    import corpus_pipeline

    items, plain = benchmark
    docs.drop("size").write.parquet(f"{tmp_path}/documents.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [r for r in rows if not brute.rules(r[1])[-1]]
    texts = brute.boilerplate(left, line_dedup.RATIO, line_dedup.MIN_PAGES)
    left = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(left, texts, strict=True)]
    left = [left[min(g, key=lambda i: (left[i][0] is None, left[i][0] or 0))] for g in brute.groups(left)]
    left = [r for r in left if not brute.decontaminated(r[1], plain)[-1]]
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_id = defaultdict(int)
    for r in got:
        by_id[r["source"]] += r["taken"]
    ids = {(r[0], r[1]) for r in left}
    assert {(r["doc_id"], r["text"]) for r in got} <= ids
    sizes = Counter()
    for _, t, _, s, _ in left:
        sizes[s] += len(brute.WORD.findall(t))
    want = brute.targets(dict(sizes))
    assert all(abs(by_id[s] - want[s]) <= 2 for s in want)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard", "decontamination", "mixing"]
