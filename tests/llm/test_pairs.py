"""Near duplicates, substring dedup, decontamination and license scans against brute force."""

import hashlib
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, license_scan, licenses, near_dup, substring

SCHEMA = "doc_id long, text string, source string, a string, b string, id long, root long"


def frame(spark, rows):
    """Documents with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "s", "x", "y", 1, 2) for i, t in rows], SCHEMA)


def corpus(seed, n=60, words=80, vocabulary=400):
    """Random texts with exact copies, edited copies, shared passages and repeats."""
    r = random.Random(seed)
    make = lambda k: [f"w{r.randrange(vocabulary)}" for _ in range(k)]
    base, passage = make(words), make(30)
    out = []
    for i in range(n):
        kind = i % 6
        t = make(r.randrange(1, words))
        if kind == 1:
            t = list(base)
            for _ in range(r.randrange(0, 9)):
                t[r.randrange(len(t))] = f"e{r.randrange(10**6)}"
        elif kind == 2:
            t = t + passage + make(5)
        elif kind == 3:
            t = (make(25) * 2) + t
        elif kind == 4 and out:
            t = out[r.randrange(len(out))][1].split()
        out.append((i * 3 + 1, " ".join(t)))
    r.shuffle(out)
    return [*out, (1000, None), (1001, ""), (1002, " \n\t "), (1003, "one two"), (1004, "ONE two"), (1005, "single")]


def sets(rows, width):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        out[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    return out


def roots(s, percent):
    ids = sorted(s)
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in ids:
        for j in ids:
            both = len(s[i] & s[j])
            if i < j and s[i] and s[j] and 100 * both >= percent * (len(s[i]) + len(s[j]) - both):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("direct", [16, 2])
def test_near_duplicates(spark, direct):
    rows = corpus(1)
    got = near_dup.link(frame(spark, [*rows, rows[0], (None, "one two")]), near_dup.NearDup(width=4, direct=direct)).collect()
    want, s = roots(sets(rows, 4), 80), sets(rows, 4)
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and not r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(s[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_of_nothing(spark):
    assert near_dup.link(frame(spark, [])).count() == 0
    assert near_dup.keep_one(frame(spark, [(1, None), (2, "")])).count() == 2


def test_near_duplicates_sort_no_texts(spark):
    """The rows of the result reach it by one exchange of whole texts, unsorted; only rows that may repeat are compared by text."""
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "g h"), (2, "A b c d e f"), (3, "x y z"), (4, None), (4, None), (5, ""), (None, "q"), (None, "q"), (None, None), (None, None)]
    docs = frame(spark, rows)
    got = near_dup.keep_one(docs, once=True)
    want = [r for r in dict.fromkeys(rows) if r[0] != 2]
    assert sorted((str(r.doc_id), str(r.text)) for r in got.collect()) == sorted((str(i), str(t)) for i, t in want)
    assert near_dup.keep_one(docs).count() == len(rows) - 1
    plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("SortMergeJoin") == 0 and plan.count("ShuffledHashJoin") == 2
    lone = near_dup.keep_one(docs.where("doc_id IN (2, 3)"), once=True)
    lone.collect()
    final = lone._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("ShuffledHashJoin") == 1


def test_signing_takes_little_memory():
    """Hashing the words of a text takes some fifty bytes a byte of a slice, whatever the batch."""
    import tracemalloc

    import pyarrow as pa

    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(9999)}" for _ in range(400)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    assert sum(b.num_rows for b in near_dup._sign(near_dup.NearDup())(iter([batch]))) == len(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 25 << 20, most


def test_signatures_within_the_distance_share_a_bucket():
    import numpy as np
    import pyarrow as pa

    p, r = near_dup.NearDup(), np.random.default_rng(4)
    for _ in range(30):
        x = r.integers(0, 2**16, p.hashes, dtype=np.uint16)
        y = x.copy()
        y[r.choice(p.hashes, p.distance, replace=False)] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([x.tobytes(), y.tobytes()])], ["id", "sig"])
        out = next(near_dup._entries(p)([batch]))
        keys = [{k for k, i in zip(out.column(0).to_pylist(), out.column(1).to_pylist()) if i == d} for d in (1, 2)]
        assert keys[0] & keys[1]


def removed(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone[k : k + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 2, 5, 8])
def test_substring(spark, batches):
    rows = corpus(2)
    got = substring.dedup(frame(spark, [*rows, rows[0]]), batches=batches).collect()
    want = removed(rows)
    assert len(got) == len(rows) + 1
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
        assert (r.kept_text is None) == (r.n_removed == 0)


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_substring_index_is_compacted_and_reopened(spark, limit):
    rows = sorted(corpus(5, n=30), key=lambda r: r[0])
    params, want = substring.Substring(fanout=1, broadcast_rows=limit), removed(rows)
    index, docs = substring.FingerprintIndex(spark, params), frame(spark, rows)
    for low, high in ((0, 30), (31, 60), (61, 2000)):
        for r in index.add(docs.where(F.col("doc_id").between(low, high)), docs.where(F.col("doc_id") < low) if index.runs else None).collect():
            assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]
        assert len(index.runs) == 1
        here = index.path.removeprefix("file:")
        assert sum(n.startswith("run_") for n in os.listdir("/" + here.lstrip("/"))) == 1
        spark.sql(f"DROP TABLE tessera_{index.runs[0][0]}")  # as a new session would begin
        index = substring.FingerprintIndex(spark, params, index.path)
    with pytest.raises(ValueError):
        index.add(docs)


def test_substring_result_is_one_scan(spark):
    """The joins of all batches would else stand in one plan, which the driver plans and follows at once."""
    rows = corpus(24)
    plan = substring.dedup(frame(spark, rows), batches=4)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan.strip().splitlines()) == 1 and plan.startswith("Relation"), plan


def test_substring_of_shared_ids_and_long_texts(spark):
    """Rows of one doc_id lose what smaller ids have, each by its own words; a very long text and windows that begin alike."""
    passage = " ".join(f"p{i}" for i in range(25))
    long = " ".join(f"q{i % 997}x{i % 1009}" for i in range(40_000))
    rows = [(1, passage), (2, "a b c " + passage + " d"), (2, "z " + passage + " y x"), (3, "e f"), (4, long), (5, "g " + long), (6, "g " + passage[:-3] + "other")]
    got = {(r.doc_id, r.n_words): r for r in substring.dedup(frame(spark, rows), batches=3).collect()}
    assert [(k, got[k].n_removed, got[k].kept_text) for k in ((2, 29), (2, 28))] == [((2, 29), 25, "a b c d"), ((2, 28), 25, "z y x")]
    assert (got[4, 40_000].n_removed, got[5, 40_001].n_removed, got[5, 40_001].kept_text) == (0, 40_000, "g")
    assert got[6, 26].kept_text == "g other" and got[3, 2].n_removed == 0 and len(got) == len(rows)


def test_substring_of_nothing(spark):
    assert substring.dedup(frame(spark, [])).count() == 0
    got = substring.dedup(frame(spark, [(None, "a b"), (1, None)])).orderBy("n_words").collect()
    assert [(r.doc_id, r.n_words, r.n_removed) for r in got] == [(1, 0, 0), (None, 2, 0)]


def test_decontamination(spark):
    r = random.Random(3)
    word = lambda: f"v{r.randrange(300)}"
    items = [(k, " ".join(word() for _ in range(n))) for k, n in enumerate((4, 1, 6, 15, 40, 80))] + [(90, None), (91, ""), (92, "!!")]
    rows = []
    for i in range(40):
        t = [word() for _ in range(r.randrange(1, 120))]
        if i % 3 == 0:
            w = items[i % 6][1].split()
            if i % 2:
                w[len(w) // 2] = "Changed,"
            t[3:3] = w
        rows.append((i, " ".join(t).upper() if i % 4 == 0 else ". ".join(t)))
    rows += [(100, None), (101, ""), (None, items[3][1]), rows[3]]

    def shingles(t, k=5):
        w = re.findall(r"[^\W_]+", (t or "").lower())
        return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else set()

    want = set()
    for i, t in rows:
        for k, x in items:
            n = len(re.findall(r"[^\W_]+", (x or "").lower()))
            a = shingles(x, min(5, n)) if n else set()
            both = len(a & shingles(t, min(5, n))) if n else 0
            if i is not None and a and 100 * both >= 80 * len(a):
                want.add((i, k, len(a), both))
    bench = spark.createDataFrame([(*x, 1, True) for x in items], "item_id long, text string, h long, in_sketch boolean")
    for limit in (1_000_000, 0):
        got = {(x.doc_id, x.item_id, x.n_item, x.n_found) for x in decontaminate.search(frame(spark, rows), bench, broadcast_rows=limit).collect()}
        assert got == want and want
    assert decontaminate.search(frame(spark, []), bench).count() == 0
    assert decontaminate.search(frame(spark, rows), bench.where("false")).count() == 0
    assert decontaminate.clean(frame(spark, rows), bench).columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")


def shares(text, templates, percent=80):
    """Greatest share by template over all runs of twice its words that begin with one of them, in plain Python."""
    w, out = license_scan.split(text or ""), []
    for t in templates:
        words = license_scan.split(t.text)
        tokens, size, best = set(words), 2 * len(words), 0.0
        for i in range(len(w)):
            block = w[i : i + size]
            near = f" {' '.join(w[max(0, i - len(words)) : i + size + len(words)])} "
            if w[i] not in tokens or any(f" {f} " in near for f in t.excluding):
                continue
            share = len(tokens & set(block)) / len(tokens)
            if 100 * share >= percent - 1e-9 and all(f" {f} " in f" {' '.join(block)} " for f in t.telling):
                best = max(best, share)
        out.append(best)
    return out


def test_license_scan(spark):
    by = {}
    for t in license_scan.TEMPLATES:
        by.setdefault(t.label, t.text)
    mit, r = by["mit"].split(), random.Random(4)
    rows = [
        (1, "x Under the MIT License, under the mit license!"), (2, None), (3, ""), (4, "cc by nc cc by nc"), (7, "mit license under"), (8, "APACHE license version 2 and underthe mit license"), (1, "dup"),
        (10, "licensed under CC BY 4.0"), (11, "GNU General Public License version 2"), (12, "Apache License version 1 0"), (13, "released under the license"), (14, "rights reserved to all"),
        (15, by["apache-2"].replace("2.0", "1.1")), (16, "and the of to " * 10_000 + by["gpl-3"].upper()), (17, " ".join(mit[:60] + ["x"] * 120 + mit[60:])), (18, " ".join(mit[:60] + ["x"] * 400 + mit[60:])),
        (None, by["isc"]), *((100 + k, text) for k, text in enumerate(by.values())), *((200 + k, " ".join(w for w in t.text.split() if r.random() > 0.05 * (k % 5))) for k, t in enumerate(license_scan.TEMPLATES * 2)),
    ]
    got = license_scan.scan(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    one = {(x.doc_id, x.n_words): x for x in got}
    for i, text in rows:
        x = one[i, len(license_scan.split(text or ""))]
        want = shares(text if i != 16 else "and the of to " * 50 + by["gpl-3"], license_scan.TEMPLATES)
        assert set(x.labels.split(",")) - {""} == {t.label for t, s in zip(license_scan.TEMPLATES, want) if s} | set(x.base_labels.split(",")) - {""}
        assert x.score == pytest.approx(1.0 if x.n_base else max(want))
    x = one[1, 9]
    assert (x.n_base, x.first_word, x.last_word, x.base_labels, x.labels, x.score) == (2, 1, 5, "mit", "mit", 1.0)
    assert (one[2, 0].n_base, one[2, 0].first_word, one[2, 0].labels, one[2, 0].score) == (0, None, "", 0.0)
    assert (one[4, 6].n_base, one[4, 6].first_word, one[4, 6].last_word) == (2, 0, 3)
    for i in range(10, 16):
        assert [x.labels for x in got if x.doc_id == i] == [""]
    assert [x.labels for x in got if x.doc_id in (16, 17, 18, None)] == ["gpl-3", "mit", "", "isc"]
    assert license_scan.scan(frame(spark, [])).count() == 0
    assert license_scan.scan(frame(spark, rows[:3]), templates=()).count() == 3


#: Texts of neighbours and short lines, and their labels.
GOOD_NOT_EVIL = "The Software shall be used for Good, not Evil."
FOUR = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization."
BASE = licenses.TEMPLATES[0].text
NEIGHBOURS = {
    "MIT without conditions": (licenses.MIT_GRANT[: licenses.MIT_GRANT.index(", subject to")] + "." + licenses.MIT_DISCLAIMER, ""),
    "JSON": (licenses.MIT_GRANT + GOOD_NOT_EVIL + licenses.MIT_DISCLAIMER, ""),
    "JSON after other words": ("the copies of the rights to use " * 20 + licenses.MIT_GRANT + GOOD_NOT_EVIL + licenses.MIT_DISCLAIMER, ""),
    "0BSD": (next(t.text for t in licenses.TEMPLATES if t.label == "isc").replace("provided that the above copyright notice and this permission\n        notice appear in all copies", ""), ""),
    "BSD of four clauses": (licenses.BSD_CONDITIONS + FOUR + licenses.BSD_NAMES + licenses.BSD_DISCLAIMER, ""),
    "BSD of three clauses": (licenses.BSD_CONDITIONS + licenses.BSD_NAMES + licenses.BSD_DISCLAIMER, "bsd-3"),
    "BSD of two clauses": (licenses.BSD_CONDITIONS + licenses.BSD_DISCLAIMER, "bsd-2"),
    "MIT": (BASE, "mit"),
    "line of an identifier": ("// SPDX-License-Identifier: Apache-2.0\nint main", "apache-2"),
    "identifier of MIT": ("# SPDX-License-Identifier: MIT", "mit"),
    "identifier of its variant": ("# SPDX-License-Identifier: MIT-0", ""),
    "LGPL identifier": ("SPDX-License-Identifier: LGPL-3.0-or-later", "lgpl-3"),
    "GPL line": ("This work is licensed under the GNU General Public License, version 3.", "gpl-3"),
    "AGPL line": ("It is licensed under the GNU Affero General Public License version 3", "agpl-3"),
    "GPL named only": ("I like the GNU General Public License version 3", ""),
    "no license": ("licensed driver under the version 3 of the general public", ""),
}


def test_licenses_and_their_neighbours(spark):
    """Labels that only the join finds: no phrase of the base stands in these texts."""
    rows = [(i, text) for i, (text, _) in enumerate(NEIGHBOURS.values())]
    got = {r.doc_id: (r.labels, r.base_labels) for r in license_scan.scan(frame(spark, rows)).collect()}
    assert {name: got[i] for i, name in enumerate(NEIGHBOURS)} == {name: (label, "") for name, (_, label) in NEIGHBOURS.items()}


def test_recall_of_signatures():
    """Pairs at the threshold itself: the share whose signatures lie within the distance."""
    import numpy as np

    p, r, lost = near_dup.NearDup(), np.random.default_rng(12), 0
    for _ in range(100):
        n = 40 * int(r.integers(1, 6))
        key = r.integers(0, 2**63, n + n // 8, dtype=np.uint64)
        x, y = np.sort(key[:n]), np.sort(key[n // 8 :])
        x, y = np.sort(np.append(key[: n // 9], key[2 * (n // 9) :])), np.sort(key[n // 9 :])  # 0.8 or a little more or less
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both):
            continue
        a, b = (near_dup.signatures(z, np.array([0, len(z)]), p.hashes)[0] for z in (x, y))
        lost += int((a != b).sum() > p.distance)
    assert lost == 0


def test_near_duplicates_of_long_texts(spark):
    long = [f"u{i % 997}v{i % 1013}" for i in range(50_000)]
    edited = list(long)
    edited[::500] = ["e"] * 100
    got = near_dup.link(frame(spark, [(1, " ".join(long)), (2, " ".join(edited)), (3, " ".join(long[:9000]))])).collect()
    assert {r.doc_id: r.component_id for r in got} == {1: 1, 2: 1, 3: 3}


def test_decontamination_of_long_texts_and_rows(spark):
    item = " ".join(f"b{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = [(1, "w " * 60_000 + item), (1, "clean one"), (None, item), (None, "clean two"), (2, None), (3, "")]
    kept = decontaminate.clean(frame(spark, rows), bench).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("1", "clean one"), ("2", "None"), ("3", ""), ("None", "clean two")]
    assert decontaminate.clean(frame(spark, rows), bench.where("false")).count() == len(rows)


def test_sketch_selects_candidates(spark):
    """Of the documents that hold one shingle of an item each, only those with a sketch's hash are counted exactly."""
    w = [f"w{i}" for i in range(30)]
    index = decontaminate.item_index(spark.createDataFrame([(1, " ".join(w))], "item_id long, text string"))
    docs = spark.createDataFrame([(i, w[i : i + 5]) for i in range(26)], "doc_id long, words array<string>")
    assert index.count() == 26
    assert decontaminate.candidates(docs, index, [5]).count() == index.where("in_sketch").count() == 6
