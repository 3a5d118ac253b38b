"""Each operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns; and against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.llm import components, decontaminate, exactdedup, jaccardjoin, langid, learning, linededup, pieces, quality, registry, scratch, secrets, sharding, textbytes, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, more=""):
    return spark.createDataFrame(rows, SCHEMA + more)


def odd(spark):
    """Null ids, null and empty texts, a repeated row, a long text, a clashing extra column."""
    long = "word " * 3000
    rows = [(1, "Some plain text.", "en", "a", 1, "x"), (1, "Some plain text.", "en", "a", 1, "x"), (2, None, None, None, None, None), (3, "", "en", None, 0, "y"), (None, "no id here", "en", "b", 2, "z"), (5, long, "en", "c", 3, "w"), (6, "!!! ???", "fr", "d", 4, "v"), (7, "Ünïcode \U0001f600 日本 text", "fr", "d", 5, "u")]
    return frame(spark, rows, ", score string")


def lower(x):
    return re.sub("[A-Z]", lambda m: m[0].lower(), x or "")


# --- bytes


@pytest.mark.parametrize("spaces", [True, False])
def test_words_equal_regex(spaces, monkeypatch):
    pattern = re.compile(r"[^\x20\x09-\x0D]+" if spaces else r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    rng = random.Random(3)
    for block in (1 << 20, 7, 16):
        monkeypatch.setattr(textbytes, "BLOCK", block)
        for _ in range(40):
            text = "".join(rng.choice("aAb 1\t\n.é日_") for _ in range(rng.randrange(60)))
            data = np.frombuffer(text.encode(), np.uint8)
            s, e, h = textbytes.words(data, textbytes.classes(spaces))
            got = [bytes(data[a:b]).decode() for a, b in zip(s, e)]
            want = pattern.findall(text if spaces else lower(text))
            assert [lower(g) for g in got] == [lower(w) for w in want]
            by = {}
            for g, x in zip(got, h.tolist()):
                assert by.setdefault(lower(g), x) == x
            assert len(set(by.values())) == len(by)


# --- 1 secrets


def base_spans(x):
    assign = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
    s = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(x) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    s += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(s))


def test_secrets(spark):
    texts = [
        "password=hunter22", "TOKEN : 'abcdef", "token:token:abcdefgh", "api_key==abcdef", "apikey = ab.cd-ef", "AKIA" + "A1" * 8, "AKIAAKIA" + "Z" * 12, "AKIA" + "a" * 20, "deadbeef" * 3, "deadbeef" * 2, "x\U0001f600 secret=\"abcdef0123456789abcdef0123\" y",
        "passwd:abcdef passwd:abc passwd:abcdefg", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "Z" * 36, None, "", "no secret here", "SECRET=ABCDEF" * 3, "paſſword=abcdefgh", "toKen=abcdefgh",
    ]
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, "token=abcdefg", None, None, None), (0, texts[0], None, None, None)])
    rows = secrets.digest(secrets.scan(docs)).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        text = "token=abcdefg" if r.doc_id is None else texts[r.doc_id] or ""
        want = base_spans(text)
        assert r.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (text, want, r.spans)
        assert set(filter(None, want.split(","))) <= set(r.spans.split(","))
    assert [r.spans for r in rows if r.doc_id == 12] == ["private_key:0:31"]
    assert [r.spans for r in rows if r.doc_id == 13] == ["code_host:0:40"]
    assert secrets.digest(secrets.scan(docs.limit(0))).count() == 0


def test_trigram_queries():
    assert secrets.trigram_query(r"abc[0-9]+defg") == [[["abc"]], [["def", "efg"]]]
    assert secrets.trigram_query(r"(abc|xyz)d?") == [[["abc"], ["xyz"]]]
    assert secrets.trigram_query(r"[0-9a-f]+") == []
    for pattern, text in ((r"key(\dabc)", "key1abc"), (r"key(.abc|xyz)", "key-abc"), (r"key(\dabc)?end", "key1abcend"), (r"(\dabc){2}", "1abc2abc")):
        assert re.search(pattern, text) and all(any(all(g in text for g in clause) for clause in clauses) for clauses in secrets.trigram_query(pattern))
    assert [["key"]] in secrets.trigram_query(r"key(\dabc)") and [["abc"]] in secrets.trigram_query(r"key(\dabc)")
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.pattern)
        samples = {"assign": ["password=abcdef", "API_KEY:abcdef"], "access": ["AKIA" + "A" * 16], "private_key": ["-----BEGIN PRIVATE KEY-----"]}
        for text in samples.get(rule.kind, []):
            assert re.search(rule.pattern, text)
            assert all(any(all(g in text.lower() for g in clause) for clause in clauses) for clauses in query)


def test_secrets_by_shuffle(spark, small, monkeypatch):
    docs = scratch.documents(spark, small)
    key = lambda df: sorted((r.doc_id, r.spans) for r in secrets.digest(secrets.scan(df)).collect())
    want = key(docs)
    monkeypatch.setattr(scratch, "BROADCAST_ROWS", 1)
    assert key(docs) == want


# --- 2, 4, 9 classifiers


def test_language(spark, small):
    docs = scratch.documents(spark, small)
    got = langid.query(spark, small).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.98
    assert got.score.between(0, 1).all()
    assert {r.doc_id: bool(zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in langid.query(spark, small).limit(50).collect()} == {r.doc_id: r.held_out for r in langid.query(spark, small).limit(50).collect()}


def test_language_odd(spark):
    model = langid.fit(frame(spark, [(i, t, lang, None, None) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 5)]))
    rows = langid.predict(odd(spark), model).collect()
    assert len(rows) == 8
    assert {r.lang_pred for r in rows if r.doc_id in (2, 3, 6)} == {"und"}
    assert {r.lang_pred for r in rows if r.doc_id not in (2, 3, 6)} <= {"en", "fr"}
    empty = langid.fit(odd(spark).limit(0))
    assert {r.lang_pred for r in langid.predict(odd(spark), empty).collect()} == {"und"}
    assert langid.predict(odd(spark).limit(0), model).count() == 0
    far = langid.predict(frame(spark, [(1, "zzzz qqqq xxxx", None, None, None)]), model).first()
    assert far.rejected and far.lang_pred in ("en", "fr")


def test_quality(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = quality.query(spark, small).join(labels, "doc_id").where("held_out").toPandas()
    assert (got[got.quality == 0].predicted == 0).mean() > 0.8
    assert (got[got.quality == 1].predicted == 1).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_quality_parts(spark):
    rng = np.random.default_rng(1)
    x = lambda mean, n: np.concatenate([rng.normal(mean, 1, (n, 2)), np.zeros((n, quality.DIMS - 2))], axis=1).astype(np.float16)
    pos, unl = x(3, 600), np.concatenate([x(3, 840), x(-3, 360)])
    prior = quality.estimate_prior(pos, unl)
    assert abs(prior - 0.7) < 0.08
    w, b = quality.descend(pos, unl, prior)
    assert ((x(3, 200) @ w + b) > 0).mean() > 0.97
    assert ((x(-3, 200) @ w + b) < 0).mean() > 0.97
    none = quality.fit(odd(spark).limit(0).select("text"), odd(spark).select("text"))
    assert {r.score for r in quality.predict(odd(spark), none).collect()} == {0.5}
    assert quality.predict(odd(spark).limit(0), none).count() == 0


def test_toxicity(spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    got = toxicity.query(spark, small).join(labels, "doc_id").toPandas()
    assert {r.doc_id for r in got[got.held_out].itertuples()} == {d for d in got.doc_id if zlib.crc32(str(d).encode()) % 4 == 2}
    clean = got[got.toxic == 0]
    assert (clean.predicted == 0).mean() > 0.97
    assert (got[(got.toxic == 1)].predicted == 1).mean() > 0.7


def test_toxicity_of_held_out_texts(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got[got.toxic == 1].predicted == 1).mean() >= 0.9
    assert got[got.predicted == 1].toxic.mean() >= 0.9


# brute force for the trained operators: plain Python with the fitted model


def folded_plain(text):
    fold = lambda c: (c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " "
    return re.sub(" +", " ", " " + "".join(map(fold, text)) + " ")


def bucket(gram, buckets):
    value = len(gram)
    for c in gram:
        value = (value * 0x100000001B3 + ord(c)) % (1 << 64)
    return int(textbytes.mix(np.array([value], np.uint64))[0]) % buckets


def plain_grams(text, orders, buckets):
    return [bucket(text[i : i + n], buckets) for n in orders for i in range(len(text) - n + 1)]


ODD_TEXTS = ["The quick  brown-fox 12 jumps.\nOver THE lazy dog\nOver THE lazy dog\n", "éÉ ß İ ǅ 日本 \U0001f600!!", "x", "1234 ,,", " a  b ", "word " * 40 + "end"]


def test_language_against_brute_force(spark):
    train = [("the cat sat on the mat", "en"), ("a dog and the fox", "en"), ("le chat est sur le tapis", "fr"), ("un chien et le renard", "fr")] * 4
    model = langid.fit(frame(spark, [(i, t, x, None, None) for i, (t, x) in enumerate(train)]))
    got = {r.doc_id: r for r in langid.predict(frame(spark, [(i, t, None, None, None) for i, t in enumerate(ODD_TEXTS)]), model).collect()}
    for i, text in enumerate(ODD_TEXTS):
        if not any(map(str.isalpha, text)):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        tf = collections.Counter(plain_grams(folded_plain(text), langid.ORDERS, langid.DIMS))
        v = {k: np.log1p(n) * model.idf[k] for k, n in tf.items()}
        norm = sum(x * x for x in v.values()) ** 0.5
        near = [sum(x / norm * c[k] for k, x in v.items()) for c in model.centroids]
        best = max(range(len(near)), key=lambda j: near[j])
        assert got[i].lang_pred == model.langs[best] and got[i].score == pytest.approx(min(1, max(0, near[best])), abs=1e-9)
        assert got[i].rejected == (1 - near[best] > model.radius[best])


def test_toxicity_against_brute_force(spark):
    rows = [(f"fine words here {i % 7}", 0) for i in range(60)] + [(f"you utter scumbag {i % 7}", 1) for i in range(30)] + [("neither", 3), ("unlabelled", None)]
    model = toxicity.fit(spark.createDataFrame(rows, "text string, label int"))
    texts = [*ODD_TEXTS, "an utter SCUMBAG!", "fine words"]
    got = {r.doc_id: r.score for r in toxicity.predict(frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)]), model).collect()}
    # the features and their ratios, by counting
    held = [(set(plain_grams(folded_plain(t), toxicity.ORDERS, toxicity.BUCKETS)), y) for t, y in rows if y in (0, 1)]
    for k in np.flatnonzero(model.weights).tolist():
        table = [[sum((k in s) == has and y == c for s, y in held) for has in (True, False)] for c in (1, 0)]
        total = sum(map(sum, table))
        g = 2 * sum(x * np.log(x * total / (sum(table[i]) * (table[0][j] + table[1][j]))) for i in (0, 1) for j in (0, 1) if (x := table[i][j]))
        assert g > toxicity.STRENGTH
    for i, text in enumerate(texts):
        z = model.bias + sum(float(model.weights[k]) for k in set(plain_grams(folded_plain(text), toxicity.ORDERS, toxicity.BUCKETS)))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-6)


def test_quality_against_brute_force(spark):
    rng = np.random.default_rng(3)
    model = quality.Model(rng.normal(0, 0.2, quality.DIMS), 0.1, 0.5)
    got = {r.doc_id: r.score for r in quality.predict(frame(spark, [(i, t, None, None, None) for i, t in enumerate(ODD_TEXTS)]), model).collect()}
    kind = lambda c: "a" if c.islower() else "A" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c if ord(c) < 128 else "\x01"
    for i, text in enumerate(ODD_TEXTS):
        tf = collections.Counter(plain_grams("".join(map(kind, text)), quality.ORDERS, quality.BUCKETS))
        x = np.zeros(quality.DIMS)
        for k, n in tf.items():
            x[k] = np.log1p(1000 * n / len(text)) / 4
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        n = max(1, len(w))
        seen, copied = set(), 0
        for line in text.split("\n"):
            copied += len(line.encode()) if line in seen else 0
            seen.add(line)
        measures = [sum(a == b for a, b in zip(w, w[1:])) / n, sum(a == b for a, b in zip(w, w[2:])) / n, copied / len(text.encode()), max(0.0, 0.5 - len(set(w)) / n), 1 / (1 + len(w))]
        x[quality.BUCKETS : -1] = [float(m > s) for m in measures for s in quality.STEPS]
        x[-1] = np.log1p(len(text)) / 10
        assert got[i] == pytest.approx(1 / (1 + np.exp(-(x @ model.weights + model.bias))), abs=1e-4)


def test_step_changes_nothing(monkeypatch):
    rng = random.Random(2)
    for _ in range(20):
        data = np.frombuffer("".join(rng.choice("aB é1.\n日\U0001f600") for _ in range(rng.randrange(300))).encode(), np.uint8)
        for step in (1, 7, 50):
            assert np.array_equal(langid.counts(data, step), langid.counts(data))
            assert np.array_equal(quality.features(data, step), quality.features(data))
            assert np.array_equal(toxicity.present(data, None, step), toxicity.present(data))
            assert learning.has_letter(data) == any(map(str.isalpha, data.tobytes().decode()))


def test_samples_are_bounded(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 7), (3, None), (4, 1)], "doc_id long, toxic int")
    docs = frame(spark, [(1, "same", None, None, None)] * 500 + [(2, f"text {i}", None, None, None) for i in range(400)] + [(3, "odd label", None, None, None)])
    got = learning.labelled(docs, labels, "toxic", 4, 9, 100).collect()
    assert sum(r.doc_id == 1 for r in got) <= 1 and not any(r.doc_id == 3 for r in got)
    assert 50 < len(got) < 160
    model = langid.fit(docs.withColumn("lang", F.lit("en")), each=50)
    assert set(model.langs) == {"en"}


def test_toxicity_keeps_weaker_features(spark):
    rng = random.Random(11)
    made = lambda: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(700))
    bad, good = made(), made()
    model = toxicity.fit(spark.createDataFrame([(bad, 1), (good, 0)] * 12, "text string, label int"))
    assert np.count_nonzero(model.weights) > 4000


def test_toxicity_odd(spark):
    rows = spark.createDataFrame([(f"fine words here {i % 7}", 0) for i in range(40)] + [(f"you utter scumbag {i % 7}", 1) for i in range(20)], "text string, label int")
    model = toxicity.fit(rows)
    texts = [(1, "an utter SCUMBAG!", None, None, None), (2, "fine words", None, None, None), (3, None, None, None, None)]
    got = {r.doc_id: r.predicted for r in toxicity.predict(frame(spark, texts), model).collect()}
    assert got[1] == 1 and got[2] == 0
    assert toxicity.predict(odd(spark), model).count() == 8
    one = toxicity.fit(rows.where("label = 0"))
    assert {r.predicted for r in toxicity.predict(odd(spark), one).collect()} == {0}


# --- 3 decontamination


def hits(text, bench, window=10):
    split = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(x))
    w, found, items = split(text), set(), set()
    for item, passage in bench:
        p = split(passage)
        for j in range(max(1, len(p) - window + 1) if p else 0):
            part = p[j : j + window]
            for i in range(len(w) - len(part) + 1):
                if w[i : i + len(part)] == part:
                    found.update(range(i, i + len(part)))
                    items.add(str(item))
    return len(w), len(found), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(found)


def test_decontamination(spark):
    rng = random.Random(5)
    word = lambda: rng.choice(["a", "b", "c", "dé", "e1"])
    bench = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 3, 9, 10, 11, 25, 40])] + [(3, "a b a b a b a b a b a b"), (None, "e1 e1 e1 e1 e1 e1 e1 e1 e1 e1"), (20, None)]
    docs = [(i, " ".join(rng.choice([word(), "zz", "A."]) for _ in range(rng.randrange(120)))) for i in range(40)]
    docs += [(100 + i, "zz " * i + (bench[6][1] if i % 2 else bench[7][1].upper()) + " yy" * (i % 3)) for i in range(12)] + [(200, None), (201, ""), (None, bench[5][1]), (100, "zz " * 0 + bench[7][1].upper())]
    frame_d = frame(spark, [(i, t, None, None, None) for i, t in docs])
    frame_b = spark.createDataFrame(bench, "item_id long, text string")
    named = [("" if i is None else i, t) for i, t in bench if t]
    for block, limit in ((1 << 20, 1 << 20), (200, 30)):
        got = decontaminate.scan(frame_d, frame_b, block_bytes=block, limit=limit).collect()
        assert len(got) == len(docs)
        by = collections.defaultdict(list)
        for r in got:
            by[r.doc_id].append((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated))
        for i, text in docs:
            assert hits(text, named) in by[i], (i, text)
    clean = decontaminate.decontaminate(frame_d, frame_b)
    assert clean.columns == frame_d.columns
    assert clean.count() == sum(not hits(t, named)[4] for _, t in docs)
    assert decontaminate.scan(frame_d, frame_b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.scan(frame_d.limit(0), frame_b).count() == 0


def test_longest_matches(spark):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(30)))], "item_id long, text string")
    text = "x y " + " ".join(f"w{i}" for i in range(5, 25)) + " z " + " ".join(f"W{i}" for i in range(11))
    row = decontaminate.scan(frame(spark, [(1, text, None, None, None)]), bench).first()
    assert [(m.item_id, m.item_word, m.doc_word, m.n_words) for m in row.matches] == [("1", 5, 2, 20), ("1", 0, 23, 11)]


def test_suffix_array():
    rng = np.random.default_rng(2)
    tests = decontaminate.Tests([("0", "a b c d e f g h")])
    for _ in range(30):
        numbers = rng.integers(0, 4, 60).astype(np.uint64)
        keys = tests.pack(np.append(numbers, np.uint64(0)))
        order = decontaminate.suffix_array(keys, tests.per, (1 << tests.bits) - 1, 61)

        def suffix(i):
            rest = numbers[i:].tolist()
            return rest[: rest.index(0)] if 0 in rest else rest

        assert [suffix(i) for i in order] == sorted(suffix(i) for i in range(60) if numbers[i])


# --- 5 sharding


def test_sharding(spark, small):
    names = sharding.shard_names(8)
    table = sharding.fill_table(names, 1009)
    counts = collections.Counter(table)
    assert max(counts.values()) - min(counts.values()) <= 1
    fewer = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 7)
    assert moved / 1009 < 0.12
    # brute force: turns written out one by one
    order = {i: [(sharding._hash(n + "/offset") % 101 + j * (sharding._hash(n + "/skip") % 100 + 1)) % 101 for j in range(101)] for i, n in enumerate(names)}
    want = [None] * 101
    turn = 0
    while None in want:
        i = turn % len(names)
        want[next(s for s in order[i] if want[s] is None)] = i
        turn += 1
    assert sharding.fill_table(names, 101) == want
    rows = sharding.query(spark, small).collect()
    assert len(rows) == 1000
    full = sharding.fill_table(sharding.shard_names())
    for r in rows[:200]:
        slot = int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:8], 16) % sharding.SLOTS
        assert (r.slot, r.shard_no, r.shard) == (slot, full[slot], f"shard-{full[slot]:04d}")
    got = sharding.assign_shards(odd(spark).withColumn("slot", F.lit("old")), "doc_id", names, 1009)
    assert got.count() == 8 and got.columns.count("slot") == 1
    assert sharding.assign_shards(odd(spark).limit(0), "doc_id", names, 1009).count() == 0
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sharding.fill_table(bad, 101)
    with pytest.raises(ValueError):
        sharding.fill_table(["a"], 100)


# --- 6 exact dedup


def test_fingerprints_compose():
    rng = np.random.default_rng(4)
    for _ in range(20):
        data = rng.integers(0, 256, rng.integers(0, 5000)).astype(np.uint8)
        cut = int(rng.integers(0, len(data) + 1))
        assert exactdedup.compose(exactdedup.text_hash(data[:cut]), exactdedup.text_hash(data[cut:]), len(data) - cut) == exactdedup.text_hash(data)
        want = tuple(int(sum((int(x) + 1) * pow(b, len(data) - 1 - i, exactdedup.PRIME) for i, x in enumerate(data)) % exactdedup.PRIME) for b in exactdedup.BASES)
        assert exactdedup.text_hash(data) == want


def copies(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return {(i, t or ""): (max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t in rows}


@pytest.mark.parametrize("huge", [1 << 24, 3])
def test_exact_dedup(spark, huge, monkeypatch):
    monkeypatch.setattr(exactdedup, "GROUP", 2)
    rows = [(i, f"text {i % 7}") for i in range(40)] + [(50, None), (51, ""), (52, "é"), (None, "text 3"), (3, "text 3"), (60, "é" * 4000), (61, "é" * 4000), (None, "alone"), (70, "twice"), (70, "twice"), (70, "other")]
    got = exactdedup.dedup(frame(spark, [(i, t, None, None, None) for i, t in rows]), huge).collect()
    assert len(got) == len(rows)
    want = copies(rows)
    sha = {hashlib.sha256((t or "").encode()).hexdigest(): t or "" for _, t in rows}
    kept = collections.Counter()
    for r in got:
        text = sha[r.text_sha256]
        assert (r.keep_id, r.group_size) == want[(r.doc_id, text)]
        kept[text] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_exact_dedup_of_colliding_fingerprints(spark, monkeypatch):
    rows = frame(spark, [(1, "aa", None, None, None), (2, "ab", None, None, None), (3, "ab", None, None, None)])
    real = exactdedup.fingerprints
    monkeypatch.setattr(exactdedup, "fingerprints", lambda *a, **b: real(*a, **b).withColumn("fingerprint", F.lit(7).cast("long")))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exactdedup.dedup(rows).collect()}
    assert got == {1: (1, 1, True), 2: (3, 2, False), 3: (3, 2, True)}


def test_drop_copies(spark):
    docs = frame(spark, [(1, "a", "en", "s", 1), (2, "a", "en", "s", 1), (3, "b", "en", "s", 1), (3, "b", "en", "s", 1), (4, None, None, None, None), (5, "", None, None, None), (3, "c", "en", "s", 1)])
    got = exactdedup.drop_copies(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect()) == [(2, "a"), (3, "b"), (3, "c"), (5, "")]
    assert exactdedup.drop_copies(docs.limit(0)).count() == 0


# --- 7 pieces


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary()


def drawn(texts, keys, samples, vocabulary):
    stretch = pieces.Stretch([np.frombuffer(t.encode(), np.uint8) for t in texts], keys, samples, vocabulary)
    return [pieces.sample(stretch.text(i, k), samples) for i, k in enumerate(keys)]


def lattice(text, v):
    s = "".join(map(chr, pieces.normalised([np.frombuffer(text.encode(), np.uint8)])[0].tolist()))
    table = {v.text[i].decode("utf-8", "replace"): (int(i), float(x)) for i, x in zip(v.id, v.score) if np.isfinite(x)}
    out = {}

    def walk(at, ids, log):
        if at == len(s):
            out[tuple(ids)] = log
            return
        hit = False
        for n in range(1, v.longest + 1):
            if (p := s[at : at + n]) in table and at + n <= len(s):
                hit = hit or n == 1
                walk(at + n, [*ids, table[p][0]], log + table[p][1])
        if not hit:
            walk(at + 1, [*ids, -ord(s[at]) - 1], log + v.unknown)

    walk(0, [], 0.0)
    z = np.logaddexp.reduce(list(out.values()))
    return {k: float(np.exp(x - z)) for k, x in out.items()}


def test_samples_follow_the_lattice(vocabulary):
    text, n = "the cat", 1500
    want = lattice(text, vocabulary)
    first, second = collections.Counter(), collections.Counter()
    for ids, log, score in drawn([text] * n, [int(k) for k in textbytes.mix(np.arange(n).astype(np.uint64))], 2, vocabulary):
        a, b = (tuple(x.tolist()) for x in ids)
        assert a != b
        assert np.exp(log[0]) == pytest.approx(want[a], abs=1e-3)
        assert (score <= 0).all()
        first[a] += 1
        second[b] += 1
    for k in sorted(want, key=want.get)[-4:]:
        assert first[k] / n == pytest.approx(want[k], abs=0.04)
        # the second of two draws without replacement
        assert second[k] / n == pytest.approx(sum(want[j] * want[k] / (1 - want[j]) for j in want if j != k), abs=0.04)


def test_samples_are_exhausted(vocabulary):
    text = "at"
    want = lattice(text, vocabulary)
    ids, log, score = drawn([text], [5], len(want) + 3, vocabulary)[0]
    found = [tuple(x.tolist()) for x in ids]
    assert len(set(found)) == len(found) >= 3
    assert sum(p for k, p in want.items() if k not in found) < 1e-12  # below rounding
    assert np.exp(log).sum() == pytest.approx(1, abs=1e-9)
    assert (score == 0).all()


def test_round_trip_and_batches(spark, vocabulary):
    texts = ["a \u2581 mark \u2581\u2581x\u2581", "plain words here", "tabs\tand\nnew  lines ", " lead", "日本語 é \U0001f600", "x" * 300, "a", " ", "mixed 日 words " * 50]
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r.samples for r in pieces.encode(docs).collect()}
    again = {r.doc_id: r.samples for r in pieces.encode(docs.repartition(5)).collect()}
    assert got == again
    for i, text in enumerate(texts):
        for s in got[i]:
            assert pieces.decode(np.array(s.ids, np.int32), vocabulary).decode() == text
        assert len({tuple(s.ids) for s in got[i]}) == len(got[i])
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert model.decode(got[1][0].ids) == texts[1]
    report = pieces.encoded(odd(spark)).collect()
    assert len(report) == 8 and all(r.round_trip and r.distinct for r in report)
    assert all(len(r.n_pieces) == len(r.ids_sha256) == len(r.log_p) == r.n_samples for r in report)
    assert {tuple(r.n_pieces) for r in report if r.doc_id in (2, 3)} == {(0,)}
    assert pieces.encoded(odd(spark).limit(0)).count() == 0


# --- 8 line dedup


def test_line_dedup(spark, monkeypatch):
    monkeypatch.setattr(linededup, "GROUP", 2)
    rng = random.Random(6)
    block = "\n".join(f"shared line {i}" for i in range(12))
    rows = [(i, "\n".join([f"own {i} {j}" for j in range(rng.randrange(5))] + [block] * (i % 3) + ["", f"end {i}"])) for i in range(20)] + [(30, None), (31, ""), (32, block), (32, block)]
    got = linededup.dedup_lines(frame(spark, [(i, t, None, None, None) for i, t in rows])).collect()
    assert len(got) == len(rows)
    want = without_repeated_pairs({(i, t or "") for i, t in rows})
    assert any(gone for _, gone in want.values())
    for r in got:
        assert (r.text, r.n_removed_lines) == want[r.doc_id]
    assert linededup.dedup_lines(odd(spark)).count() == 8
    assert linededup.dedup_lines(odd(spark).limit(0)).count() == 0


def without_repeated_pairs(rows):
    """Brute force: every two neighbouring lines that occurred before lose both lines."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = text.encode()
        spans = [m.span() for m in re.finditer(rb"[^\n]+", data)]
        gone = set()
        for n in range(len(spans) - 1):
            pair = data[spans[n][0] : spans[n + 1][1]]
            gone |= {n, n + 1} if pair in seen else set()
            seen.add(pair)
        cut = {k for n in gone for k in range(max(0, (spans[n - 1][1] if n and n - 1 in gone else spans[n][0] - 1)), spans[n][1])}
        out[i] = (bytes(c for k, c in enumerate(data) if k not in cut).decode(), len(gone))
    return out


def plain_line_dedup(rows, window, every):
    """Brute force of the method itself: repeated chunks grown by a line, on bytes instead of hashes."""
    texts, chunks, count = {}, {}, collections.Counter()
    for i, text in rows:
        data = text.encode()
        texts[i] = data, [m.span() for m in re.finditer(rb"[^\n]+", data)]
        first, last = linededup.chunks_of(textbytes.words(np.frombuffer(data, np.uint8), textbytes.LINE, textbytes.EXACT)[2], window, every)
        chunks[i] = list(zip(first.tolist(), last.tolist()))
    body = lambda i, a, b: tuple(texts[i][0][s:e] for s, e in texts[i][1][a : b + 1])
    for i, found in chunks.items():
        count.update(body(i, a, b) for a, b in found)
    seen, out = set(), {}
    for i in sorted(texts):
        data, spans = texts[i]
        stretches = set()
        for a, b in chunks[i]:
            if count[body(i, a, b)] > 1:
                stretches |= {x for x in ((a, b), (a - 1, b), (a, b + 1)) if x[0] >= 0 and x[1] < len(spans) and x[0] < x[1]}
        gone = set()
        for a, b in sorted(stretches, key=lambda x: (spans[x[0]][0], x)):
            said = data[spans[a][0] : spans[b][1]]
            if said in seen:
                gone.add((a, b))
            seen.add(said)
        keep = bytearray(b"\1" * len(data))
        for a, b in gone:
            low, high = max(0, spans[a][0] - 1), spans[b][1]
            keep[low:high] = bytes(high - low)
        out[i] = bytes(c for c, k in zip(data, keep) if k).decode(), len({n for a, b in gone for n in range(a, b + 1)})
    return out


def repeated_texts(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").where("text is not null").collect()]
    return rows + [(10**6 + i, f"own {i}\npassage of two {i // 2}\nlines {i // 2}\nend {i}") for i in range(200)]


@pytest.mark.parametrize("window,every", [(2, 64), (2, 3)])
def test_line_dedup_equals_its_method_by_brute_force(spark, small, window, every, monkeypatch):
    rows = repeated_texts(spark, small)
    monkeypatch.setattr(linededup, "CHUNKS", (window, every))
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in linededup.dedup_lines(frame(spark, [(i, t, None, None, None) for i, t in rows])).collect()}
    assert got == plain_line_dedup(rows, window, every)


def test_line_dedup_finds_repeated_pairs(spark, small):
    """Recall against every two neighbouring lines that occurred before, and nothing but these; passages of two lines are the hardest."""
    rows = repeated_texts(spark, small)
    got, want = plain_line_dedup(rows, *linededup.CHUNKS), without_repeated_pairs(rows)
    assert all(n <= want[i][1] for i, (_, n) in got.items())
    assert sum(n for _, n in got.values()) >= 0.98 * sum(n for _, n in want.values()) > 300
    of_two = [i for i in got if i >= 10**6]
    assert sum(got[i][1] for i in of_two) >= 0.95 * sum(want[i][1] for i in of_two)


def test_line_dedup_of_overlapping_stretches(spark):
    """Occurrences that share a line count as two; what is removed is judged by all occurrences."""
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in linededup.dedup_lines(frame(spark, [(1, "a\na\na", None, None, None), (2, "k\nl", None, None, None), (3, "x\nk\nl", None, None, None), (4, "x\nk", None, None, None)])).collect()}
    assert got == {1: ("a", 2), 2: ("k\nl", 0), 3: ("x", 2), 4: ("", 2)}


def test_line_dedup_of_both_forms_with_empty_lines(spark):
    forms = ["a line\n\nb line\nc line", "a line\nb line\n\nc line"]
    rows = [(i, f"own {i}\n{forms[i % 2]}") for i in range(8)]
    got = {r.doc_id: r.text for r in linededup.dedup_lines(frame(spark, [(i, t, None, None, None) for i, t in rows])).collect()}
    assert got == {i: t if i < 2 else f"own {i}" for i, t in rows}


@pytest.mark.parametrize("every", [2, 3, 64])
def test_boundaries_resist_shifts(every):
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 400).astype(np.uint64)

    def chunks(x):
        return {tuple(x[a : b + 1].tolist()) for a, b in zip(*linededup.chunks_of(x, 2, every))}

    a, b = chunks(hashes), chunks(np.insert(hashes, 50, np.uint64(7)))
    assert len(a - b) <= 3 and sum(map(len, a)) == 400
    if every == 2:
        assert 150 < len(a) < 250  # two lines on average


# --- 10 Jaccard join


def linked(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    links = {i: sum(bool(both) and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both) for j in sets if j != i for both in [len(sets[i] & sets[j])]) for i in sets}
    return {i: (len(sets[i]), find(i), links[i]) for i in sets}


@pytest.mark.parametrize(("k", "percent", "tokens"), [(4, 85, 1_000_000), (4, 85, 300), (5, 80, 1_000_000)])
def test_jaccard_join(spark, k, percent, tokens):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyz")
    seeds = [[word() for _ in range(rng.randrange(5, 80))] for _ in range(8)]
    rows = []
    for i in range(90):
        w = list(rng.choice(seeds))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
            w[rng.randrange(len(w))] = word()
        rows.append((i, (" " if i % 3 else "\n").join(w).upper() if i % 5 == 0 else " ".join(w)))
    rows += [(100, "one two"), (101, "One  two"), (102, "one"), (103, ""), (104, None), (105, "\t\n"), (106, "")]
    got = jaccardjoin.near_duplicates(frame(spark, [(i, t, None, None, None) for i, t in rows]), k, percent, tokens).collect()
    want = linked(rows, k, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in got} == want
    assert len({c for _, c, _ in want.values()}) < len(want)
    kept = jaccardjoin.drop_near_copies(frame(spark, [(i, t, None, None, None) for i, t in rows]), k, percent, tokens)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, (_, c, _) in want.items() if c == i)


def test_jaccard_odd(spark):
    got = jaccardjoin.near_duplicates(odd(spark), 4, 85).collect()
    assert len(got) == 8
    assert jaccardjoin.near_duplicates(odd(spark).limit(0), 4, 85).count() == 0
    kept = jaccardjoin.drop_near_copies(frame(spark, [(3, "a b c d e f g", "en", "s", 1), (2, "A b c d e f g", "en", "s", 1), (9, "other words in here", None, None, None)]))
    assert sorted(r.doc_id for r in kept.collect()) == [2, 9]


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, rng.randrange(101, 160)) for _ in range(30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(70)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_registry():
    names = registry.queries()
    assert [f"op{i}_" for i in range(1, 11)] == sorted((f"{n.split('_')[0]}_" for n in names), key=lambda x: int(x[2:-1]))
