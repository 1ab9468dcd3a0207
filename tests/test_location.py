"""Passages on pages against plain loops over characters."""

import random
import re

from tessera.operators import anchors


class Page:
    """Items of a page as running text without and with spaces, and as letters, each with the item of every character."""

    def __init__(self, items: list[str]):
        parts = [anchors.normal(x) for x in items]
        letters = [re.sub("[^a-z0-9]+", "", p) for p in parts]
        self.n = len(parts)
        self.forms = [self._run(parts, ""), self._run(parts, " "), self._run(letters, "")]

    @staticmethod
    def _run(parts: list[str], gap: str) -> tuple[str, list[int], list[int]]:
        owner, starts, at = [], [], 0
        for i, p in enumerate(parts):
            starts.append(at)
            own = [i] * len(p) + [-1] * (len(gap) if i < len(parts) - 1 else 0)
            owner += own
            at += len(own)
        return gap.join(parts), owner, starts

    def find(self, anchor: str, after: int = 0) -> tuple[int, int] | None:
        """First and last item of the first hit at or after item ``after``."""
        bare = re.sub("[^a-z0-9]+", "", anchors.normal(anchor))
        for (text, owner, starts), needle in zip(self.forms, (anchors.normal(anchor), anchors.normal(anchor), bare)):
            if needle is bare and len(anchors.normal(anchor)) < anchors.LEAST or len(needle) < anchors.LEAST:
                continue
            hit = text.find(needle, starts[after] if 0 < after < self.n else 0)
            if hit >= 0:
                own = [i for i in owner[hit : hit + len(needle)] if i >= 0]
                return own[0], own[-1]
        return None


def spans(pages: list[tuple[int, list[str]]], start: str, end: str, short: bool) -> list[tuple[int, int, int]]:
    """(page, first item, last item) of the passage between two anchors."""
    read = [(k, Page(items)) for k, items in pages]
    first = next(((k, p, m) for k, p in read if (m := p.find(start))), None)
    if first is None:
        return []
    k0, p0, m0 = first
    if short:
        return [(k0, *m0)]
    last = next(((k, m) for k, p in read if k >= k0 and (m := p.find(end, m0[1] if k == k0 else 0))), None)
    if last is None:
        return [(k0, m0[0], p0.n - 1)]
    k1, m1 = last
    if k1 == k0:
        return [(k0, m0[0], max(m0[1], m1[1]))]
    return [(k0, m0[0], p0.n - 1), *((k, 0, p.n - 1) for k, p in read if k0 < k < k1), (k1, 0, m1[1])]


def test_location_equals_the_loops(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdeé", k=r.randrange(1, 9))) + r.choice(["", "", ",", ".", "-"])
    items, passages = [], []
    for doc in range(12):
        pages = [(k, [r.choice(["", " ".join(word() for _ in range(r.randrange(1, 4)))]) if r.random() < 0.2 else word() for _ in range(r.randrange(1, 40))]) for k in range(1, 6)]
        items += [(doc, k, i, t) for k, page in pages for i, t in enumerate(page)]
        flat = [t for _, page in pages for t in page]
        for n in range(8):
            a = r.randrange(len(flat))
            part = flat[a : a + r.choice([4, 12, 40, 90])]
            text = r.choice([" ", "", "  "]).join(part)
            text = text.upper() if n % 4 == 1 else re.sub("[^a-zé]", "!", text) if n % 4 == 2 else text
            passages.append((doc * 10 + n, doc, text + ("z" * 200 if n == 7 else "")))
    passages += [(900, 3, None), (901, 3, "short"), (902, 99, "x" * 40)]
    r.shuffle(items)
    got = anchors.locate(spark.createDataFrame(items, "doc_id int, page int, item int, text string"), spark.createDataFrame(passages, "passage_id long, doc_id int, text string")).collect()
    cut = spark.createDataFrame(passages, "passage_id long, doc_id int, text string").where("length(trim(text)) >= 20")
    want = []
    for p in cut.select("passage_id", "doc_id", anchors.start_anchor(cut["text"]).alias("a"), anchors.end_anchor(cut["text"]).alias("b"), (anchors.F.length(anchors.F.trim("text")) <= anchors.MOST).alias("short")).collect():
        pages = {}
        for d, k, i, t in sorted(items):
            if d == p.doc_id:
                pages.setdefault(k, []).append(t)
        want += [(p.passage_id, *x) for x in spans(sorted(pages.items()), p.a, p.b, p.short)]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 25


def test_texts_of_pages_are_not_written(spark, monkeypatch):
    """Texts meet the passages where they were put together; what is written and shuffled on are numbers."""
    seen = []
    monkeypatch.setattr(anchors, "written", lambda df, name="step": (seen.append((name, df.columns)), df)[1])
    items = spark.createDataFrame([(1, 0, k, f"Word{k}\n of") for k in range(30)], "doc_id int, page int, item int, text string")
    passages = spark.createDataFrame([(5, 1, "".join(f"word{k} of" for k in range(4, 9))), (5, 1, "".join(f"word{k} of" for k in range(4, 9)))], "passage_id long, doc_id int, text string")
    assert [tuple(r) for r in anchors.locate(items, passages).collect()] == [(5, 0, 4, 8)]
    assert seen and not {c for _, columns in seen for c in columns} & {*anchors.FORMS, "parts", "end"}
