"""Classifiers, quality rules, URL filter, tokenizer and pipeline."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import boosting, language, quality_rules, sentencepiece_codec, toxicity, url_filter
from tessera.llm.stats import COUNTS

DATA = "/root/testdata/sf0.01"
EDGES = [(5000, None), (5001, ""), (5002, " \n "), (5003, "1234 !!"), (None, "the and of"), (5004, "word " * 30_000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    more = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in EDGES], rows.schema)
    return rows.union(more).union(rows.limit(2)).withColumn("label", F.lit("x")).withColumn("score", F.lit(9)).withColumn("h", F.lit(0))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet").withColumn("text", F.lit("clash"))


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def auc(y, s):
    y, s = np.array(y), np.array(s)
    order = s.argsort(kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    n = y.sum()
    return (rank[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize(("module", "column", "folds", "hold", "least"), [(boosting, "quality", 5, 0, 0.97), (toxicity, "toxic", 4, 2, 0.7)])
def test_classifiers_on_held_out_documents(spark, docs, labels, module, column, folds, hold, least):
    got = module.classify(docs, labels).collect()
    assert len(got) == docs.count()
    known = {r.doc_id: r[column] for r in labels.collect()}
    assert all(r.held_out == (r.doc_id is not None and fold(r.doc_id, folds) == hold) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    out = [(known[r.doc_id], r.score) for r in got if r.held_out and r.doc_id in known]
    assert auc(*zip(*out)) >= least
    assert module.classify(docs.where("false"), labels).count() == 0
    assert module.classify(docs.limit(5), labels.where("false")).count() == 5


def test_held_out_labels_change_nothing(docs, labels):
    flipped = labels.withColumn("quality", F.when(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r.doc_id or -1, r.score) for r in boosting.classify(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_flat_trees_match_a_walk():
    r = np.random.default_rng(1)
    x = r.random((500, 15))
    y = ((x[:, 2] > 0.5) ^ (x[:, 4] > 0.3)).astype(float)
    f = boosting.fit(x, y, boosting.Boosting(trees=10))
    for row, got in zip(x[:40], f.score(x[:40])):
        raw = f.base
        for t in range(10):
            node = 0
            while node < f.feature.shape[1]:
                node = 2 * node + 1 + (row[f.feature[t, node]] > f.cut[t, node])
            raw += f.value[t, node - f.feature.shape[1]]
        assert got == pytest.approx(1 / (1 + np.exp(-raw)))
    assert ((f.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_ftrl_is_sparse():
    r = np.random.default_rng(2)
    docs = [np.unique(np.append(r.integers(100, 5000, 60), 7 if i % 3 == 0 else 8)) for i in range(600)]
    w = toxicity.fit(docs, np.array([i % 3 == 0 for i in range(600)], float), toxicity.Ftrl(bits=13))
    assert len(w.bucket) < 1500 and w.weight[w.bucket == 7][0] > 0.5
    assert not len(toxicity.fit([], np.zeros(0), toxicity.Ftrl(bits=13)).bucket)


def test_language(spark, docs):
    got = language.identify(docs).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    out = [r.lang_pred == truth[r.doc_id] for r in got if r.held_out and r.doc_id < 5000]
    assert np.mean(out) >= 0.97
    by = {r.doc_id: r for r in got}
    for i in (5000, 5001, 5002, 5003):
        assert (by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0.0, True)
    assert by[None].lang_pred == "en" and not by[None].held_out
    assert np.mean([r.rejected for r in got if r.doc_id is not None and r.doc_id < 5000]) <= 0.01
    assert language.identify(docs.where("false")).count() == 0
    unlabelled = language.identify(docs.withColumn("lang", F.lit(None).cast("string")).limit(3)).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_a_kept_text_goes_to_python_once(spark, monkeypatch):
    sent = []
    real = type(spark.range(0)).mapInArrow
    monkeypatch.setattr(type(spark.range(0)), "mapInArrow", lambda self, *a, **k: (sent.append(self.columns), real(self, *a, **k))[1])
    rows = [(1, "ab cd", "x"), (2, None, "y"), (None, "", "x"), (4, "12", None), (1, "cd é", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.Model(["x", "y"], np.random.default_rng(1).normal(size=(2 ** language.Language().bits, 2)))
    got = [tuple(r) for r in language.identify(docs, model=model, keep=("text", "lang")).select("doc_id", "text", "lang", "lang_pred", "score").collect()]
    assert len(sent[0]) == 4
    assert [r[:3] for r in got] == rows
    plain = language.identify(docs, model=model).collect()
    assert [r[3:] for r in got] == [(r.lang_pred, r.score) for r in plain]
    binary = language.identify(docs.withColumn("text", F.col("text").cast("binary")), model=model, keep=("text",)).collect()
    assert [None if r.text is None else bytes(r.text).decode() for r in binary] == [r[1] for r in rows]


def counted(text):
    """The base counts by plain Python."""
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(w) - 7):
        places.setdefault(tuple(w[i : i + 8]), []).append(i)
    again = {j for p in places.values() if len(p) > 1 for i in p for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again)


def test_quality_rules(spark, docs):
    got = quality_rules.judge(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == docs.count()
    for r in got:
        want = counted(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r.base_failed == failed and r.kept == (not failed and r.posterior >= 0.5)
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert np.mean([r.kept == (good[r.doc_id] == 1) for r in got if r.doc_id in good and not r.base_failed]) >= 0.97
    assert quality_rules.judge(docs.where("false")).count() == 0


def test_verdict_is_not_all_must_pass(spark):
    """On documents: one bad vote is outvoted, and abstentions lose without a bad vote."""
    rows = quality_rules.judge(spark.read.parquet(f"{DATA.replace('0.01', '0.1')}/documents.parquet")).where("NOT base_failed")
    power = [3**k for k in range(len(quality_rules.RULES))]
    bad = F.lit(False)
    for p in power:
        bad |= F.floor(F.col("pattern") / p) % 3 == quality_rules.BAD
    got = {(r.bad, r.kept): r["count"] for r in rows.groupBy(bad.alias("bad"), "kept").count().collect()}
    assert got[True, True] > 0 and got[False, False] > 0 and got[False, True] > got[True, False] > 0


def test_em_by_hand():
    """Against a plain loop over documents, and what it should find: rules that others bear out are trusted."""
    r = random.Random(3)
    docs = []
    for _ in range(600):
        good = r.random() < 0.8
        docs.append([r.choices((0, 1, 2), w)[0] for w in ((9, 1, 0.1) if good else (1, 3, 6), (8, 2, 0.3) if good else (2, 4, 4), (5, 3, 2), (7, 3, 0.2) if good else (1, 8, 1))])
    patterns = sorted(set(map(tuple, docs)))
    m = quality_rules.fit(np.array(patterns), np.array([float(docs.count(list(p))) for p in patterns]), rounds=20)
    share, votes = quality_rules.START_GOOD, [[list(c) for _ in range(4)] for c in quality_rules.START]

    def posterior(d):
        a, b = share, 1 - share
        for k, v in enumerate(d):
            a, b = a * votes[0][k][v], b * votes[1][k][v]
        return a / (a + b)

    for _ in range(20):
        p = [posterior(d) for d in docs]
        seen = [[[quality_rules.BELIEF * quality_rules.START[c][v] + sum((x if c == 0 else 1 - x) for x, d in zip(p, docs) if d[k] == v) for v in range(3)] for k in range(4)] for c in (0, 1)]
        votes = [[[x / sum(row) for x in row] for row in c] for c in seen]
        share = (sum(p) + quality_rules.BELIEF * quality_rules.START_GOOD) / (len(docs) + quality_rules.BELIEF)
    assert m.good == pytest.approx(share) and m.votes == pytest.approx(np.array(votes))
    assert m.posterior(np.array(patterns)) == pytest.approx(np.array([posterior(d) for d in patterns]))
    odds = np.log(m.votes[0] / m.votes[1])
    assert odds[0, 2] < odds[2, 2] - 1 and odds[3, 1] < -0.5
    one_bad, abstains = m.posterior(np.array([[0, 0, 2, 0], [1, 1, 1, 1]]))
    assert one_bad > 0.9 and abstains < 0.5
    assert quality_rules.fit(np.zeros((0, 4), int), np.zeros(0)).good == quality_rules.START_GOOD


def test_ftrl_by_hand(spark):
    """Weights and scores of a small corpus against dictionaries and words in plain Python."""
    p = toxicity.Ftrl(bits=18, passes=3, l1=0.5)
    r = random.Random(8)
    texts = [" ".join(r.choice(("bad", "Fine", "day", "so", "é!", "x-y")) for _ in range(r.randrange(0, 9))) for _ in range(60)]
    y = [float("bad" in t) for t in texts]
    import pyarrow as pa

    s = next(toxicity.slices(pa.array(texts)))
    row, key = toxicity._present(s, p)
    docs = [key[row == i] for i in range(60)]
    for t, d in zip(texts, docs):
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t))
        assert len(d) == len({(0, x) for x in w} | {(g, a, b) for g in (1, 2, 3) for a, b in zip(w, w[g:])})
    m = toxicity.fit(docs, np.array(y), p)
    share = (sum(y) + 0.5) / 61
    bias, z, n, zb, nb = np.log(share / (1 - share)), {}, {}, 0.0, 0.0
    weight = lambda k: 0.0 if abs(z.get(k, 0)) <= p.l1 else -(z[k] - np.sign(z[k]) * p.l1) / ((p.beta + n[k] ** 0.5) / p.alpha + p.l2)
    order = np.random.default_rng(2).permutation(60)
    shown = bias
    for _ in range(p.passes):
        for i in order:
            w = {k: weight(k) for k in docs[i].tolist()}
            shown = bias - zb / ((p.beta + nb**0.5) / p.alpha + p.l2)
            g = 1 / (1 + np.exp(-(sum(w.values()) + shown))) - y[i]
            for k, v in w.items():
                z[k] = z.get(k, 0) + g - ((n.get(k, 0) + g * g) ** 0.5 - n.get(k, 0) ** 0.5) / p.alpha * v
                n[k] = n.get(k, 0) + g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / p.alpha * (shown - bias)
            nb += g * g
    want = {k: weight(k) for k in z if weight(k)}
    assert dict(zip(m.bucket.tolist(), m.weight)) == pytest.approx(want) and m.bias == pytest.approx(shown)
    scored = m.score(60, *toxicity.buckets(next(toxicity.slices(pa.array(texts))), p), p.bits)
    assert scored == pytest.approx([1 / (1 + np.exp(-(m.bias + sum(want.get(k, 0) for k in d.tolist())))) for d in docs])


def test_rare_buckets_that_are_left_out_have_no_weight():
    r = np.random.default_rng(6)
    p = toxicity.Ftrl(bits=12)
    docs = [np.unique(r.integers(0, 4096, 30)) for _ in range(300)]
    y = (r.random(300) < 0.3).astype(float)
    count = np.bincount(np.concatenate(docs), minlength=4096)
    some = toxicity.fit([d[count[d] >= p.least] for d in docs], y, p)
    full = toxicity.fit(docs, y, p)
    assert p.least > 1 and (count == 1).any()
    assert full.bucket.tolist() == some.bucket.tolist() and full.weight == pytest.approx(some.weight)


def test_calibration_by_hand():
    """The line is where the likelihood of a grid is greatest; few documents leave the fit as it is."""
    r = np.random.default_rng(3)
    raw = r.normal(size=400)
    y = (r.random(400) < 1 / (1 + np.exp(-(2.5 * raw - 1)))).astype(float)
    a, b = toxicity.line(raw, y)
    loss = lambda a, b: np.log1p(np.exp(-(2 * y - 1) * (a * raw + b))).sum() + 0.0005 * (a - 1) ** 2
    assert loss(a, b) <= min(loss(x, z) for x in np.linspace(0.5, 5, 46) for z in np.linspace(-3, 3, 61)) + 1e-9
    docs, few = [np.array([i % 3]) for i in range(30)], np.array([float(i % 3 == 0) for i in range(30)])
    p = toxicity.Ftrl(bits=4, l1=0.1)
    plain, kept = toxicity.fit(docs, few, p, 16), toxicity.calibrated(docs, few, p, 16)
    assert plain.bias == kept.bias and (plain.weight == kept.weight).all()
    more = toxicity.calibrated(docs * 20, np.tile(few, 20), p, 16)
    assert more.weight[more.bucket == 0][0] > 0 and more.score(1, np.zeros(1, int), np.zeros(1, int), 4)[0] > 0.9


def test_first_split_by_hand():
    """The root of the first tree is the best of all cuts at the bins' edges."""
    r = np.random.default_rng(9)
    x = r.random((300, 15)).round(2)
    y = (x[:, 3] + 0.3 * r.random(300) > 0.7).astype(float)
    p = boosting.Boosting(trees=1, depth=1)
    f = boosting.fit(x, y, p)
    share = (y.sum() + 0.5) / 301
    g, h, best = share - y, share * (1 - share), None
    for j in range(15):
        for e in np.unique(np.quantile(x[:, j], np.linspace(0, 1, p.bins + 1)[1:-1])):
            a = x[:, j] <= e
            if min(a.sum(), (~a).sum()) * h >= p.least:
                gain = sum(g[k].sum() ** 2 / (k.sum() * h + p.penalty) for k in (a, ~a))
                best = max(best or (-1,), (gain, -j, e))
    assert (f.feature[0, 0], f.cut[0, 0]) == (-best[1], best[2])
    for leaf, k in enumerate((x[:, f.feature[0, 0]] <= f.cut[0, 0], x[:, f.feature[0, 0]] > f.cut[0, 0])):
        assert f.value[0, leaf] == pytest.approx(-p.rate * g[k].sum() / (k.sum() * h + p.penalty))


def test_language_scores_by_hand():
    """A document's scores are the mean over its subwords, listed in plain Python, of their class scores."""
    import pyarrow as pa

    p = language.Language(bits=8)
    m = language.Model(["a", "b", "c"], np.random.default_rng(5).normal(size=(256, 3)))
    texts = ["the und, 12 of", "", "é", "a  b", None, "x" * 50]
    slice_ = next(language.slices(language._text(pa.array(texts))))
    got = m.raw(slice_, p)
    mask = 2**64 - 1
    for t, row in zip(texts, got):
        raw = bytes(c if language.ALPHA[c] else 32 for c in (t or "").lower().encode())
        buckets = []
        for w in raw.split():
            one = next(language.slices(pa.array([w.decode()])))
            buckets.append(int(language.LANE.words(one.buf, np.array([0]), np.array([len(w)]))[0]) >> (64 - p.bits))
        for n in range(1, p.longest + 1):
            for i in range(len(raw) - n + 1):
                run = raw[i : i + n]
                if run == b" " or (n > 1 and run[:2] == b"  "):
                    continue
                code = n
                for c in run:
                    code = (code * 257 + c) & mask
                buckets.append((code * 0x9E3779B97F4A7C15 & mask) >> (64 - p.bits))
        assert row == pytest.approx(m.table[buckets].mean(0) if buckets else np.zeros(3))


def test_url_filter(spark):
    listed = spark.createDataFrame([("bad.org/",), ("x.com/a/b",), (None,), ("bad.org/",)], "key string")
    rules = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/")]
    cases = {
        "https://Sub.Bad.ORG:80/x?q#f": ("sub.bad.org:80", "/x", None, "block"), "http://notbad.org/": ("notbad.org", "/", None, "allow"), "http://x.com/a/b/": ("x.com", "/a/b/", None, "block"),
        "http://x.com/a/bc": ("x.com", "/a/bc", None, "allow"), "http://u.example.com/en/77": ("u.example.com", "/en/77", "example.com/en/7", "allow"), "http://u.example.com/en/8": ("u.example.com", "/en/8", "com/en/", "block"),
        "http://com/en/": ("com", "/en/", "com/en/", "block"), "http://a.net?/de/": ("a.net", "", None, "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"), "": ("", "", None, "allow"), "http://": ("", "", None, "allow"),
        "x://y://bad.org/": ("y:", "//bad.org/", None, "allow"),
    }
    pages = spark.createDataFrame([(i % 4, u, "clash", True) for i, u in enumerate([*cases, None])], "page_id int, url string, rule string, blocked boolean")
    got = url_filter.judge(pages, listed, rules).collect()
    assert len(got) == len(cases) + 1
    assert sorted(map(str, {(r.host, r.path, r.rule, r.verdict) for r in got})) == sorted(map(str, set(cases.values())))
    assert url_filter.judge(pages.where("false"), listed, rules).count() == 0
    assert url_filter.judge(pages, listed.where("false"), []).where("verdict = 'block'").count() == 0


def test_bloom_has_no_false_negatives(spark):
    table = url_filter.bloom(spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key")))
    hashes = lambda a, b: np.array([r.h for r in spark.range(a, b).select(F.xxhash64(F.concat(F.lit("k"), "id")).alias("h")).collect()], np.int64)
    assert url_filter.maybe(table, hashes(0, 5000)).all()
    assert url_filter.maybe(table, hashes(10_000, 20_000)).mean() < 0.02


def test_tokenizer_parity_and_round_trip(spark, docs):
    with open(sentencepiece_codec.MODEL_FILE, "rb") as f:
        model = f.read()
    r = random.Random(5)
    odd = ["", " ", "  a", "x" + " " * 40 + "y", "\n\t", "日本語 🎉 é", "<s> <0x41>", "A" * 1000, "\x00", *("".join(r.choice(" ab\n▁é日1") for _ in range(r.randrange(40))) for _ in range(300))]
    assert sentencepiece_codec.parity(model, odd + [x.text for x in docs.limit(200).collect() if x.text]) == []
    codec = sentencepiece_codec.load()
    tokens = sentencepiece_codec.encode(docs, codec)
    back = sentencepiece_codec.decode(tokens, codec)
    assert sorted((x.doc_id or -1, x.text) for x in back.collect()) == sorted((x.doc_id or -1, x.text or "") for x in docs.collect())
    digest = sentencepiece_codec.digest(docs, codec).collect()
    assert len(digest) == docs.count() and all(x.round_trip for x in digest)
    assert sentencepiece_codec.encode(docs.where("false"), codec).count() == 0


def test_unigram_parity():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    add = lambda p, s, t: m.pieces.add(piece=p, score=s, type=t)
    add("<unk>", 0, 2), add("<s>", 0, 3), add("</s>", 0, 3)
    for b in range(256):
        add(f"<0x{b:02X}>", 0, 6)
    for i, p in enumerate(("▁", "a", "b", "ab", "▁ab", "▁a", "ba", "aba", "▁b", "c")):
        add(p, -1.0 - 0.37 * i, 1)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, True, True
    r = random.Random(6)
    texts = ["".join(r.choice("abc é") for _ in range(r.randrange(1, 20))) for _ in range(200)]
    assert sentencepiece_codec.parity(m.SerializeToString(), texts) == []


def test_counts_are_named():
    assert set(boosting.COUNTS) == set(COUNTS)


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def shingled(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}


def test_stages_against_brute_force(spark, tmp_path):
    """Each stage on its own input: null and shared ids, repeated rows, null, empty and letterless texts."""
    import corpus_pipeline as P

    stage = dict(P.STAGES)
    r = random.Random(11)
    make = lambda n: " ".join(f"w{r.randrange(500)}" for _ in range(n))
    base, passage, item = make(80), make(30), make(20)
    edited = base.split()
    edited[40] = "changed"
    rows = [(i, make(60)) for i in range(1, 20)] + [
        (30, base), (31, " ".join(edited)), (32, base), (33, make(5) + " " + passage), (34, passage + " " + make(9)), (35, make(50) + " " + item + " " + make(5)), (36, None), (37, ""), (38, "12 !"),
        (40, make(40)), (40, make(41)), (41, passage), (41, make(12)), (None, make(30)), (None, make(31)), (None, make(32)), (None, None), (None, "34 ?"), (1, None), (30, base), (None, item + " zz"),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema).withColumn("root", F.lit(1)).withColumn("label", F.lit("x"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = lambda name, df=docs: sorted((str(x.doc_id), str(x.text)) for x in stage[name](spark, df, str(tmp_path)).collect())
    text = lambda some: sorted((str(i), str(t)) for i, t in some)

    lettered = [(i, t) for i, t in rows if re.search(r"[^\W\d_]", t or "")]
    assert out("language_id") == text(lettered)

    first = {}
    sets = {i: {} for i, _ in rows if i is not None}
    for i, t in rows:
        if i is not None:
            sets[i][t] = shingled(t)
    ids = sorted(sets)
    root = {i: i for i in ids}
    for i in ids:
        for j in ids:
            for a in sets[i].values():
                for b in sets[j].values():
                    if i < j and a and b and len(a & b) >= 0.8 * len(a | b):
                        root[j] = min(root[j], root[i])
    want = [(i, t) for i, t in dict.fromkeys(rows) if i is None or root[i] == i]
    assert root[31] == root[32] == 30 and out("near_duplicates") == text(want)

    seen = {}
    for i, t in rows:
        for k in range(len((t or "").split()) - 19):
            w = tuple(t.split()[k : k + 20])
            if i is not None:
                seen[w] = min(seen.get(w, i), i)
    want = []
    for i, t in rows:
        w, own = (t or "").split(), set()
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in own or (i is not None and seen[x] < i):
                gone[k : k + 20] = [True] * 20
            own.add(x)
        want.append((i, " ".join(x for x, g in zip(w, gone) if not g) if any(gone) else t))
    assert out("substring_dedup") == text(want) and want != rows

    grams = shingled(item)
    want = [(i, t) for i, t in rows if len(grams & shingled(t)) < 0.8 * len(grams)]
    assert out("decontamination") == text(want) and len(want) == len(rows) - 2

    got = stage["tokens"](spark, docs, "").collect()
    codec = sentencepiece_codec.load().tokenizer()
    assert sorted((str(x.doc_id), str(list(x.ids))) for x in got) == sorted((str(i), str(codec.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)

    for name, f in P.STAGES:
        empty = f(spark, docs.where("false"), str(tmp_path))
        assert empty.count() == 0 and (name == "tokens" or tuple(empty.columns) == COLUMNS)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as P

    rows = spark.read.parquet(f"{DATA}/documents.parquet")
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first()["text"]
    extra = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (9002, "the and of with " + item, "en", "s", 1), (9003, "12 34", "en", "s", 1)]
    docs = rows.union(spark.createDataFrame(extra, rows.schema)).union(rows.limit(3)).withColumn("root", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    current, sizes = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in P.STAGES:
        current = P.written(stage(spark, current, str(tmp_path)), name)
        sizes.append(current.count())
        if name != P.STAGES[-1][0]:
            assert tuple(current.columns) == P.COLUMNS
        ids = {r[0] for r in current.select("doc_id").collect()}
        assert (9002 in ids) == (name in ("language_id", "near_duplicates", "substring_dedup"))
        assert not ids & {9000, 9001, 9003}
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 800
    assert "ids" in current.columns and current.where("n_tokens <> size(ids)").count() == 0


def test_listed_domains_of_many_labels(spark):
    """A listed domain is found from any host below it, however deep either lies."""
    deep = ".".join("abcdefghijkl") + ".com"
    hosts = {1: "x.a.b.c.d.e.com", 2: "y.x.a.b.c.d.e.com", 3: "a.b.c.d.e.com", 4: "b.c.d.e.com", 5: f"q.{deep}", 6: "xa.b.c.d.e.com"}
    pages = spark.createDataFrame([(i, f"http://{h}/p/") for i, h in hosts.items()], "page_id long, url string")
    listed = spark.createDataFrame([("a.b.c.d.e.com/",), (f"{deep}/p",)], "key string")
    assert {r.page_id for r in url_filter.judge(pages, listed, []).where("verdict = 'block'").collect()} == {1, 2, 3, 5}
