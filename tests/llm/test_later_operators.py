"""Language filters, prefix tries and periodic runs against brute force; labels that few tasks hold."""

import hashlib
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import pytest

from orogen.llm import languages, periodic, prefix_trie, toxicity
from orogen.llm.common import stored
from tests.llm.test_operators import prose

TONGUES = {"aa": "lorem ipsum dolor sit amet elit sed magna".split(), "bb": "größe über straße mädchen schön nicht zwölf".split(), "cc": "niño mañana corazón según día árbol".split()}


def tongue(rng, lang, n):
    return " ".join(rng.choice(TONGUES[lang]) for _ in range(n))


# ------------------------------------------------------------------ periodic runs

def runs_by_force(words, least, times):
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                s = words[i : i + length]
                if not any(s[p:] == s[:-p] for p in range(1, q)):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,times", [(24, 3), (6, 2), (4, 2)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least)
    for _ in range(600):
        k, n = rng.choice([1, 2, 3, 5, 20]), rng.randint(0, 90)
        words = [str(rng.randrange(k)) for _ in range(n)]
        if n > 5 and rng.random() < 0.7:
            unit = [str(rng.randrange(k)) for _ in range(rng.randint(1, 12))] * rng.randint(1, 2)
            a = rng.randrange(n)
            words[a : a + 1] = (unit * 9)[: rng.randint(1, 80)]
        assert periodic.runs_of(words, least, times) == runs_by_force(words, least, times)


def test_suffix_tree_nodes_are_the_repeated_branching_words():
    rng = random.Random(2)
    for _ in range(100):
        ids = np.array([rng.randrange(3) for _ in range(rng.randint(2, 30))])
        order, rank = periodic.suffix_array(ids)
        text = ids.tolist()
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:]) and rank[order].tolist() == list(range(len(text)))
        depth, leaves, children = periodic.suffix_tree(periodic.shared_lengths(text, order.tolist(), rank.tolist()))
        got = {tuple(text[order[a] : order[a] + d]): b - a + 1 for d, (a, b) in zip(depth, leaves, strict=True)}
        follow = defaultdict(lambda: (set(), [0]))
        for i in range(len(text)):
            for j in range(i, len(text) + 1):
                follow[tuple(text[i:j])][0].add(text[j] if j < len(text) else None)
                follow[tuple(text[i:j])][1][0] += 1
        want = {w: c[0] for w, (nexts, c) in follow.items() if len(nexts) > 1}
        want[()] = len(text)
        assert got == want


def test_periodic_query_columns(spark):
    rng = random.Random(5)
    unit = [f"w{i}" for i in range(9)]
    texts = {i: prose(rng, rng.randint(0, 200)) for i in range(60)} | {60: None, 61: "", 62: " \n ", 63: "a " * 30_000, 64: " ".join((unit * 4)[:33] + ["x"] + ["y"] * 24), 65: "\x1c  " * 24}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] + [(None, "b " * 24, "y"), (5, texts[5], "z")], "doc_id long, text string, start string").repartition(5)
    got = periodic.find(docs, loops=True).collect()
    assert len(got) == len(texts) + 2 and sum(r["doc_id"] == 5 for r in got) == 2 and periodic.find(docs.limit(0)).count() == 0
    by = {r["doc_id"]: r for r in got}
    nothing = hashlib.sha256(b"").hexdigest()
    assert [(by[i]["n_runs"], by[i]["start"], by[i]["runs_sha256"], by[i]["collapsed_sha256"]) for i in (60, 61, 62)] == [(0, None, nothing, nothing)] * 3
    assert (by[None]["start"], by[None]["length"], by[None]["period"]) == (0, 24, 1)
    for i, t in texts.items():
        words = (t or "").replace("\n", " ").split(" ")
        words = [w for w in words if w]
        h, n = crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        runs = runs_by_force(words, 24, 3) if n < 1000 else [(0, n, 1)]
        left = [w for k, w in enumerate(words) if not any(s + q <= k < s + length for s, length, q in runs)]
        assert by[i]["n_runs"] == len(runs) and by[i]["runs_sha256"] == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert by[i]["collapsed_sha256"] == hashlib.sha256(" ".join(left).encode()).hexdigest()
        if runs:
            best = max(runs, key=lambda r: (r[1] / r[2], -r[0]))
            assert (by[i]["start"], by[i]["length"], by[i]["period"], by[i]["exponent_milli"]) == (*best, 1000 * best[1] // best[2])


# ------------------------------------------------------------------ prefix tries

def nodes_by_force(paths):
    """Rows of the trie of {conv_id: turns}."""
    members, ends, said = defaultdict(list), defaultdict(list), {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
            said[tuple(path[:d])] = path[d - 1][1] if d else ""
        ends[tuple(path)].append(c)
    out = []
    for key, who in members.items():
        under = [k for k in members if k[: len(key)] == key]
        kids = [k for k in under if len(k) == len(key) + 1]
        leaves = [k for k in under if not any(x[: len(k)] == k and len(x) > len(k) for x in under)]
        saved = sum((len(members[k]) - 1) * len(said[k].split()) for k in under)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[key]))).encode()).hexdigest()
        out.append((min(who), len(key), min(members[key[:-1]]) if key else None, len(who), len(kids), len(leaves), saved, digest))
    return sorted(out, key=repr)


@pytest.mark.parametrize("partitions", [1, 7, 150])
def test_trie_equals_brute_force_over_any_number_of_ranges(spark, partitions):
    rng = random.Random(partitions)
    paths = {}
    for c in range(-3, 180):
        paths[c] = [("user", "hello there")] * (c % 3 > 0) if c < 80 else [("u", rng.choice("ab ")) for _ in range(rng.randint(0, 7))]
    paths[500] = [("u", "a")] * 300
    rows = [(c, i, r, t) for c, p in paths.items() for i, (r, t) in enumerate(p)]
    found = prefix_trie.turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    bare = spark.createDataFrame([(c, []) for c, p in paths.items() if not p], found.schema)
    got = prefix_trie.trie(found.unionByName(bare), partitions).collect()
    assert sorted(map(tuple, got), key=repr) == nodes_by_force(paths)


def test_merging_shares_what_it_says():
    rng = random.Random(4)
    records = [([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 6))], i, []) for i in range(500)]
    for k in (1, 2, 3, 8, 31):
        out = list(prefix_trie.merged([prefix_trie.sorted_run(records[i::k]) for i in range(k)]))
        assert [r[:2] for r, _ in out] == sorted(r[:2] for r in records)
        assert all(n == prefix_trie.common_length(a[0], b[0]) for (a, _), (b, n) in zip(out, out[1:], strict=False))


def test_rebuilt_conversations(spark):
    rows = [(c, t, "user" if t else None, f"{c} {t}") for c in range(0, 60, 1) if c != 20 for t in range(c % 5)]
    rows += [(0, None, "system", "first"), (7, 0, "user", None), (None, 0, "user", "nobody's"), (41, 0, "a", "tie"), (41, 0, "a", "tie")]
    table = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    got = {r["conv_id"]: [bytes(t["digest"]) for t in r["turns"]] for r in prefix_trie.shared_starts(prefix_trie.turns(table)).collect()}

    def own(c):
        said = [(-1 if t is None else t, hashlib.sha256(f"{len(r or '')}:{r or ''}:{x or ''}".encode()).digest()[:16]) for k, t, r, x in rows if k == c]
        return [d for _, d in sorted(said)]

    assert set(got) == {r[0] for r in rows if r[0] is not None}
    for c in got:
        h = crc32(str(c).encode()) % 4
        assert got[c] == own(c - c % 20)[:h] + own(c)[h:]
    assert prefix_trie.trie(prefix_trie.turns(table.limit(0))).count() == 0


# ------------------------------------------------------------------ languages

@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(8)
    rows = [(i, tongue(rng, lang, rng.randint(3, 40)), lang) for i, lang in enumerate(rng.choices(list(TONGUES), k=300))]
    rows += [(400, None, "aa"), (401, "", "bb"), (402, "12 3!", "bb"), (403, "漢字", None), (None, tongue(rng, "bb", 9), "bb"), (404, tongue(rng, "cc", 40_000), "cc"), rows[7]]
    return rows


def test_languages(spark, spoken):
    docs = stored(spark.createDataFrame([(*r, "x", "y") for r in spoken], "doc_id long, text string, lang string, score string, held_out string").repartition(6), "spoken")
    filters = languages.fit(docs)
    assert filters.languages == ["aa", "bb", "cc"]
    got = languages.identify(docs, filters).collect()
    assert len(got) == len(spoken)
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == lang for i, _, lang in spoken if i is not None and i < 300) and by[404]["lang_pred"] == "cc"
    assert [by[i]["lang_pred"] for i in (400, 401, 402)] == ["und"] * 3 and by[None]["lang_pred"] == "bb" and by[None]["held_out"] is False
    assert all(0 <= r["score"] <= 1 for r in got) and by[403]["score"] == 0 and by[403]["lang_pred"] == max(TONGUES, key=lambda x: filters.shares[filters.languages.index(x)])
    assert languages.identify(docs.limit(0), filters).count() == 0


def test_filters_forget_no_ngram_and_few_foreign_ones_pass(spark, spoken):
    docs = spark.createDataFrame(spoken, "doc_id long, text string, lang string")
    filters = languages.fit(docs, least=0.0, least_count=1, slots=1 << 16)
    train = [(t, lang) for i, t, lang in spoken if i is not None and t and lang and crc32(str(i).encode()) % 5]
    sets = defaultdict(set)
    for t, lang in train:
        sets[lang] |= set(languages.grams([t], filters.sizes)[0].tolist())
    every = np.array(sorted(set().union(*sets.values())), np.uint64)
    masks = filters.masks(every)[:, 0]
    for k, lang in enumerate(filters.languages):
        says = (masks >> np.uint64(k) & np.uint64(1)).astype(bool)
        holds = np.array([h in sets[lang] for h in every.tolist()])
        assert says[holds].all() and says[~holds].mean() < 0.05
    nothing = languages.fit(docs.where("lang is null"))
    assert {r["lang_pred"] for r in languages.identify(docs, nothing).collect()} == {"und"}


def test_ngrams_keep_within_words_and_texts():
    def named(text):
        return set(languages.grams([text], (3,))[0].tolist())

    h, owner = languages.grams(["Ab, cD", "", "é"], (3, 4))
    assert set(h[owner == 0].tolist()) == set(languages.grams(["ab  cd"], (3, 4))[0].tolist()) and not (owner == 1).any() and (owner == 2).sum() == 1
    assert named("ab cd") == named("ab") | named("cd") and len(named("ab")) == 2


# ------------------------------------------------------------------ labels that few tasks hold

@pytest.mark.parametrize("marked", [{0: 0, 1: 1, 2: 1, 3: 0}, {}, {0: 0, 1: 0}])
def test_toxicity_with_labels_in_one_of_eight_tasks(spark, tmp_path, marked):
    rng = random.Random(3)
    keep = [i for i in range(200) if crc32(str(i).encode()) % 5]
    labels = {keep[k]: y for k, y in marked.items()}
    rows = [(i, prose(rng, 40) + (" vile wretched scum" * 9 if labels.get(i) else "")) for i in range(200)]
    docs = stored(spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(8, "doc_id"), "sparse")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "4k")
    try:
        assert docs.rdd.getNumPartitions() >= 8
        model = toxicity.fit(docs, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
        got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
        assert len(got) == 200 and toxicity.keep_clean(docs, model).count() == 200 - sum(r["predicted"] for r in got.values())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    if not all(y in labels.values() for y in (0, 1)):
        assert len({r["score"] for r in got.values()}) == 1
