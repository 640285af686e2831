"""Deduplication operators against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from murkwatch.llm import exact, minhash, recompress, rindex


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_exact(docs, stored, nothing):
    def normal(text):
        return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")

    groups = {}
    for i, text in stored:
        groups.setdefault(normal(text), []).append(i)
    got = exact.groups(docs).collect()
    least = lambda ids: min(ids, key=lambda i: (i is not None, i or 0))  # noqa: E731  null sorts first
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter(
        (i, least(groups[normal(t)]), len(groups[normal(t)]), sha(normal(t).encode())) for i, t in stored)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(sha(t.encode()) for t in groups)
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns and Counter(normal(r.text) for r in kept.collect()) == Counter(list(groups))
    assert exact.groups(nothing).count() == 0 and exact.keep_first(nothing).count() == 0


def test_exact_group_over_many_ranges(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'same text' ELSE concat('text ', id) END AS text")
    got = exact.groups(rows.repartition(5)).where("group_size > 1").collect()
    assert len(got) == 1000 and {r.group_size for r in got} == {1000} and [r.doc_id for r in got if r.kept] == [0]


def test_exact_groups_amid_texts_of_one_head(spark):
    head = "a header that many texts of a hot source have in common: "
    rows = spark.range(6000).selectExpr("id AS doc_id", f"concat('{head}', CASE WHEN id % 2 = 0 THEN 'big' WHEN id % 6 = 1 THEN concat('small ', id % 60) ELSE sha2(string(id), 256) END) AS text")
    times = Counter(r.text for r in rows.collect())
    least = {r.text: r.doc_id for r in reversed(rows.orderBy("doc_id").collect())}
    by_id = {r.doc_id: r.text for r in rows.collect()}
    got = exact.groups(rows.repartition(5)).collect()
    assert len(got) == 6000
    assert all((r.keep_id, r.group_size, r.kept) == (least[t := by_id[r.doc_id]], times[t], r.doc_id == least[t]) for r in got)


def jaccard_components(rows, size, percent):
    sets = []
    for _, text in rows:
        words = [w.lower() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        sets.append({tuple(words[k:k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set()))
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return Counter((i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _) in enumerate(rows))


@pytest.mark.parametrize("size,percent", [(3, 85), (5, 80)])
def test_minhash(docs, stored, size, percent):
    got = minhash.components(docs, size, percent).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == jaccard_components(stored, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_minhash_empty_table_and_pipeline_form(nothing, docs):
    assert minhash.components(nothing).count() == 0
    assert minhash.keep_representatives(docs).columns == docs.columns


def test_minhash_of_a_large_group_of_near_copies(spark, monkeypatch):
    """Edits put pairs on both sides of the threshold; centres must join components without pairing the whole group."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    rows = [(k, " ".join(f"e{rng.randrange(10**6)}" if rng.random() < 0.006 * (k % 6) else w for w in base)) for k in range(300)]
    rows += [(1000 + k, " ".join(f"o{rng.randrange(400)}" for _ in range(60))) for k in range(40)]
    rounds, pairs = [], []
    centres, rest = minhash._with_centres, minhash._all_pairs
    monkeypatch.setattr(minhash, "_with_centres", lambda live, percent, n: rounds.append(n) or centres(live, percent, n))
    monkeypatch.setattr(minhash, "_all_pairs", lambda live, percent: pairs.append(rest(live, percent).count()) or rest(live, percent))
    got = minhash.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == jaccard_components(rows, 5, 80)
    assert rounds[:2] == [1, 4] and sum(pairs) < 300 * 299 / 2


def test_minhash_group_linked_through_others(spark):
    """A chain: each text is similar to the next one only, and all share buckets."""
    words = [f"w{k}" for k in range(400)]
    rows = [(k, " ".join(words[6 * k:6 * k + 100])) for k in range(25)] + [(90, " ".join(reversed(words)))]
    got = {r.doc_id: r.component_id for r in minhash.components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == {k: 0 for k in range(25)} | {90: 90}


def test_recompression(docs, stored, nothing):
    width = 35
    texts = [(t or "").encode().split() for _, t in stored]
    times = Counter(tuple(w[k:k + width]) for w in texts for k in range(len(w) - width + 1))
    want = Counter()
    for (i, _), w in zip(stored, texts):
        gone = {k + j for k in range(len(w) - width + 1) if times[tuple(w[k:k + width])] > 1 for j in range(width)}
        want[(i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))] += 1
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in recompress.remove_repeats(docs, width).collect()) == want
    assert recompress.remove_repeats(nothing).count() == 0


def test_equal_windows_have_equal_representatives():
    rng = np.random.default_rng(0)
    for _ in range(150):
        names = recompress.mixed(np.arange(1, int(rng.integers(2, 7)), dtype=np.uint64))
        width, sizes = int(rng.integers(3, 12)), rng.integers(0, 40, size=12)
        flat = np.concatenate([rng.integers(0, len(names), size=s) for s in sizes]).astype(int)
        symbol, low, high = recompress.representatives(names[flat], sizes, width)
        seen = {}
        for s, a, b in zip(symbol, low, high):
            for k in range(a, b + 1):
                assert seen.setdefault(tuple(flat[k:k + width]), s) == s
        assert (high - low + 1).sum() == np.maximum(sizes - width + 1, 0).sum()


def test_run_length_dedup(docs, stored, nothing):
    width, least = 50, {}
    order = lambda i: -(1 << 63) if i is None else i
    data = [(order(i), (t or "").encode()) for i, t in stored]
    for i, text in data:
        for k in range(len(text) - width + 1):
            key = text[k:k + width]
            least[key] = min(least.get(key, i), i)
    want = Counter()
    for (doc, _), (i, text) in zip(stored, data):
        gone = bytearray(len(text))
        for k in range(len(text) - width + 1):
            if least[text[k:k + width]] < i:
                gone[k:k + width] = b"\1" * width
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        want[(doc, len(text), sum(gone), spans, sha(bytes(c for c, g in zip(text, gone) if not g)))] += 1
    got = rindex.remove_earlier(docs, width).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert rindex.remove_earlier(nothing).count() == 0


def test_run_index_finds_the_least_document():
    rng = np.random.default_rng(3)
    width = 32
    for _ in range(30):
        base = bytes(rng.integers(97, 99, 300).tolist())
        contexts = list({base[a:a + int(rng.integers(10, 120))] for a in rng.integers(0, 200, 25)})
        docs = rng.integers(0, 9, len(contexts))
        least = {}
        for context, doc in zip(contexts, docs):
            for k in range(len(context) - width + 1):
                least[context[k:k + width]] = min(least.get(context[k:k + width], 99), doc)
        for context, found in zip(contexts, rindex.RunIndex(contexts, docs, width).least_documents(width)):
            assert found.tolist() == [least[context[k:k + width]] for k in range(len(context) - width + 1)]
