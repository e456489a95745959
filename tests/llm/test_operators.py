"""Corpus operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from orogen.llm import bpe, graph, licenses, line_dedup, ngram_join, packing, pii, quality, token_files, topk, toxicity

SCHEMA = "doc_id long, text string, kept string, n_lines int"
WORDS = "the of and lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    found = [(i, prose(rng, rng.randint(1, 80)), "x", 1) for i in range(40)]
    base = prose(rng, 200).split(" ")
    for i in range(40, 60):  # near copies
        own = list(base)
        own[rng.randrange(200)] = "changed%d" % i
        found.append((i, " ".join(own), "x", 1))
    found += [(60, None, None, None), (61, "", "x", 1), (62, " \n\t ", "x", 1), (63, "one", "x", 1), (64, "one", "x", 1), (65, prose(rng, 20_000), "x", 1)]
    found += [(66, "a\tb  c\r\n\nd é漢字 <|endoftext|> ends ", "x", 1), (67, "x" * 70_000, "x", 1), found[3], (None, "no id here at all", "x", 1)]
    return found


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def encoded(rows):
    t = bpe.load_tokenizer(bpe.default_tokenizer())
    return t, [t.encode(r[1] or "", add_special_tokens=False).ids for r in rows]


def same(got, want):
    return sorted(map(repr, got)) == sorted(map(repr, want))


def test_word_splits_never_change_tokens(encoded):
    t, _ = encoded
    rng, own = random.Random(1), bpe.WordEncoder(bpe.default_tokenizer(), limit=50)
    parts = ["a", "b", " ", "  ", "\n", "\n\n", "\t", "\r\n", ".", "!", "1", "é", "漢", "\x01", "\x1c", "\xa0", "<|endoftext|>", "'s", "😀", "\x85", " \n", "\x00"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert "".join(bpe.split_words(text)) == text
        assert own.encode(text).tolist() == t.encode(text, add_special_tokens=False).ids
    for _ in range(100):
        several = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 30))]
        assert [i.tolist() for i in own.encode_many(several, chars=40)] == [t.encode(x, add_special_tokens=False).ids for x in several]


def test_encode_decode(docs, rows, encoded, empty):
    t, ids = encoded
    got = bpe.encode_decode(docs, chunk_chars=20_000).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").toPandas()
    want = [(r[0], len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256(t.decode(i, skip_special_tokens=False).encode()).hexdigest()) for r, i in zip(rows, ids, strict=True)]
    assert same([(None if pd.isna(a) else int(a), *b) for a, *b in got.itertuples(index=False)], want)
    assert bpe.encode_decode(empty).count() == 0


def test_decode_joins_pieces(docs, rows):
    unique = docs.where("doc_id is not null and doc_id <> 3 and text <> ''")
    got = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(bpe.encode(unique)).collect()}
    assert got == {r[0]: r[1] for r in rows if r[0] not in (None, 3) and r[1]}


def test_token_files(docs, rows, encoded, empty):
    _, ids = encoded
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0))
    want, start = [], 0
    for k in order:
        own = np.array([*ids[k], 2], "<u4")
        want.append((rows[k][0], start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    assert same([tuple(r) for r in token_files.round_trip(docs).collect()], want)
    assert token_files.round_trip(empty).count() == 0


def test_repair_round_trip_and_slices():
    rng = np.random.default_rng(3)
    for first, top in ((50_257, 40), (50_257, 3), (200_000, 40)):
        ids = rng.integers(0, top, 5000)
        ids[1000:1500] = 2
        symbols, rules = token_files.repair(ids, first)
        assert len(symbols) < len(ids)
        assert (token_files.expand(symbols, rules, first) == ids).all()
        row = {"symbols": token_files._bytes(symbols), "rules": token_files._bytes(rules.ravel()), "expansions": token_files._bytes(token_files.expansions(rules, first)), "first_rule": first}
        for a, b in ((0, 5000), (17, 18), (900, 1600), (4999, 5000)):
            assert (token_files.slice_ids(row, a, b) == ids[a:b]).all()


def test_repair_ends_when_no_pair_is_frequent():
    rng = np.random.default_rng(4)
    copies = np.concatenate([np.tile(rng.integers(0, 5000, 400), 50), rng.integers(0, 30, 4000), np.zeros(3000, np.int64)])
    symbols, rules = token_files.repair(copies, 50_257)
    pairs = defaultdict(int)
    last = None
    for k, pair in enumerate(zip(symbols.tolist(), symbols[1:].tolist(), strict=False)):  # runs count every other place
        if pair[0] == pair[1] and last == (k - 1, pair):
            last = None
            continue
        last = (k, pair)
        pairs[pair] += 1
    assert max(pairs.values()) < 4 and len(symbols) < len(copies) / 5
    size = token_files.expansions(rules, 50_257)
    assert size.max() >= 400
    for sizes in (None, size):
        assert (token_files.expand(symbols, rules, 50_257, sizes) == copies).all()


def test_token_files_keep_every_doc_id(spark):
    least = -(2**63)
    frame = spark.createDataFrame([(least, "a b", "x", 1), (None, "c", "x", 1), (2**63 - 1, None, "x", 1)], SCHEMA)
    got = token_files.round_trip(frame).collect()
    assert {r["doc_id"] for r in got} == {least, None, 2**63 - 1}
    assert {r["doc_id"]: r["start"] for r in got}[None] == 0 and {r["doc_id"]: r["n_tokens"] for r in got}[2**63 - 1] == 1


def test_packing(docs, rows, encoded, empty):
    _, ids = encoded
    got = packing.pack(docs, block=16).toPandas()
    whole = {(r[0], tuple(i)): np.array([*i, 0], "<u4") for r, i in zip(rows, ids, strict=True)}
    total = sum(len(i) + 1 for i in ids)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["length"].sum() <= 2048
        assert s["offset"].tolist() == [0, *np.cumsum(s["length"])[:-1]]
    for (i, _), own in whole.items():
        mine = got[got["doc_id"].isna() if i is None else got["doc_id"] == i].drop_duplicates("piece").sort_values("piece")
        assert len(mine) == -(-len(own) // 2048)
        for p in mine.itertuples():
            assert p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
    assert got["length"].sum() == total
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_keeps_every_capacity(rule):
    lengths = np.random.default_rng(5).integers(1, 1000, 600)
    place, offset = packing.best_fit(lengths, 2048, 5, 1_500_000, (1.0, 0.5, 0.5), rule)
    for b in np.unique(place):
        own = lengths[place == b]
        assert own.sum() <= 2048 and len(own) <= 5 and (own**2).sum() <= 1_500_000
        assert sorted(offset[place == b].tolist()) == np.sort(np.cumsum([0, *own[np.argsort(offset[place == b])]])[:-1]).tolist()
    place, _ = packing.best_fit(lengths, 2048, 2048, 2048**2, rule=rule)
    assert place.max() + 1 <= -(-lengths.sum() // 2048) * 1.02 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
@pytest.mark.parametrize("weights", [(1.0, 0.0, 0.0), (1.0, 1.0, 1.0), (0.5, 2.0, 1.0)])
def test_best_fit_equals_its_definition(rule, weights):
    """Every item goes to the open bin of the best value among all that hold it in every dimension, ties to the oldest."""
    def plain(lengths, caps):
        bins, place = [], {}
        for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            need = (lengths[k], 1, lengths[k] ** 2)
            best = None
            for b, left in enumerate(bins):
                if left[0] > 0 and left[1] > 0 and all(x >= y for x, y in zip(left, need, strict=True)):
                    if rule == "norm":
                        value = sum(((x - y) * (w / c)) ** 2 for x, y, w, c in zip(left, need, weights, caps, strict=True))
                    else:
                        value = -sum(x * (w / c) * (y * (w / c)) for x, y, w, c in zip(left, need, weights, caps, strict=True))
                    if best is None or value < best[0] - 1e-15:
                        best = (value, b)
            if best is None:
                bins.append(list(caps))
                best = (0, len(bins) - 1)
            bins[best[1]] = [x - y for x, y in zip(bins[best[1]], need, strict=True)]
            place[k] = best[1]
        return [place[k] for k in range(len(lengths))]

    rng = np.random.default_rng(6)
    for caps in ((2048, 2048, 2048**2), (2048, 6, 1_500_000)):
        lengths = rng.integers(1, 1100, 250)
        assert packing.best_fit(lengths, caps[0], caps[1], caps[2], weights, rule)[0].tolist() == plain(lengths.tolist(), caps)
    bins = {w: packing.best_fit(np.array([1000, 600, 500, 400, 350, 90, 60, 30, 20, 10] * 4), 1024, 8, 1024**2, w)[0].tolist() for w in ((1.0, 0.0, 0.0), (0.1, 1.0, 1.0))}
    assert len(set(map(tuple, bins.values()))) == 2  # the weights choose the bins


def test_segments_are_the_maximal_ones():
    def brute(values):  # the definition: the best segment, the shortest of equals, then the same on either side
        if not len(values) or max(values) <= 0:
            return []
        sums = np.concatenate(([0], np.cumsum(values)))
        best = max(((sums[b] - sums[a], a - b, -a) for a in range(len(values)) for b in range(a + 1, len(values) + 1)), key=lambda t: (round(t[0], 9), t[1], t[2]))
        a, b = -best[2], -best[2] - best[1]
        return [*brute(values[:a]), (a, b, best[0]), *[(x + b, y + b, s) for x, y, s in brute(values[b:])]]

    rng = random.Random(2)
    for _ in range(300):
        n = rng.randint(1, 30)
        at = sorted(rng.sample(range(n), rng.randint(0, n)))
        value = [rng.choice([-2.3, -1.1, 0.7, 1.9, 3.1]) for _ in at]
        full = np.full(n, -0.25)
        for i, v in zip(at, value, strict=True):
            full[i] += v
        got = toxicity.segments(at, value, 0.25)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in brute(full.tolist())]


def test_toxicity_learns_and_leaves_held_out_alone(spark, empty):
    rng, rows, labels = random.Random(4), [], []
    for i in range(600):
        toxic, words = int(i % 5 == 0), prose(rng, 60).split(" ")
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(["vilefoo", "vilebar", "nastyqux"])
        rows.append((i, " ".join(words), "x", 1))
        labels.append((i, 1, toxic))
    docs = spark.createDataFrame([*rows, (9000, None, "x", 1), (9001, "", "x", 1)], SCHEMA)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == 602 and all(0 <= r["score"] <= 1 for r in got.values())
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    wrong = sum(got[i]["predicted"] != t for i, _, t in labels)
    assert wrong <= 6
    assert {r["doc_id"] for r in toxicity.keep_clean(docs, model).collect()} == {i for i, r in got.items() if not r["predicted"]}
    flipped = spark.createDataFrame([(i, q, 1 - t if got[i]["held_out"] else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    assert toxicity.fit(docs, flipped).scores == model.scores
    assert toxicity.fit(empty, table.limit(0)).scores == {}
    assert toxicity.score(empty, model).count() == 0


def brute_base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(s))) % 10 == 0
    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(digits(m[0])) <= 15],
    }


def test_base_spans_equal_the_patterns():
    rng = random.Random(9)
    parts = ["a@b.c", "@", ".", "1", "255", "256", "4111111111111111", " ", "-", "+1 (743) 555-3824", "x", "é", "%", "10.0.0.1", "00", "(", ")", "+4"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == brute_base(text), text
    pii.base_spans("1" * 200_000 + "a@" * 50_000 + "1." * 50_000)  # linear


def test_pii_field_adds_what_repeats(spark, docs, empty):
    text = "call +1 (743) 555-3824 now or 743 555 3824 later, mail jo@x.org; card 4111111111111111 4111111111111111 and 4111111111111111."
    own = spark.createDataFrame([*[(i, f"{text} {i}", "x", 1) for i in range(30)], (40, None, "x", 1), (41, "nothing 12 here", "x", 1)], SCHEMA)
    model = pii.fit(own)
    got = {r["doc_id"]: r for r in pii.find(own, model).collect()}
    assert got[3]["n_phone"] == 1 and got[3]["n_email"] == 1 and got[3]["n_card"] == 1
    spans = got[3]["spans"].split(",")
    assert any(text[int(s.split(":")[1]) : int(s.split(":")[2])] == "743 555 3824" for s in spans if s.startswith("phone"))
    assert sum(s.startswith("card") for s in spans) == 3
    assert got[40]["spans"] == "" == got[41]["spans"] and got[40]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.redact(own, model).collect()}
    assert clean[40] is None and clean[41] == "nothing 12 here" and "<PHONE>" in clean[3] and "555" not in clean[3]
    assert pii.find(empty, model).count() == 0
    assert pii.redact(docs, pii.fit(docs)).columns == docs.columns


@pytest.mark.parametrize("unrelated", [0, 5000])
def test_pii_repeats_are_found_at_any_size(spark, unrelated):
    rows = [(k, "call +1 (743) 555-3824" + " then some words 743 555 3824" * k, "x", 1) for k in (1, 2, 5, 50)]
    rows += [(1000 + k, " ".join(f"and {200 + n // 1000} {n % 1000:03} {n * 7 % 10000:04}," for n in range(k * 100, k * 100 + 100)), "x", 1) for k in range(unrelated // 100)]
    frame = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    model = pii.fit(frame)
    got = {r["doc_id"]: r["n_added"] for r in pii.find(frame, model).collect()}
    assert {i: n for i, n in got.items() if n} == {1: 1, 2: 2, 5: 5, 50: 50}
    if unrelated:
        again = pii.fit(frame.union(frame).union(frame))
        assert again.node["n10"] == pytest.approx(model.node["n10"])


def test_pii_messages_pass_until_they_settle():
    model = pii.Field({"a": [0.0, 0.0, -9, -9, -9.0], "b": [0.0, 3.0, -9, -9, -9.0]}, skip=9.0)
    units = [pii.Unit(100 * k, 100 * k + 9, "n1", "b" if k == 60 else "a") for k in range(61)]
    assert model.labels(units).tolist() == [1] * 61


def marginals(model, units):
    """Each unit's likeliest label by enumeration, and by how much it leads."""
    weight = (model.skip, model.similar, model.chain)
    node = np.array([model.node[u.shape] for u in units])
    for i, u in enumerate(units):
        if u.label is not None:
            node[i] = [0 if k == u.label + 1 else -60 for k in range(5)]
    total = np.zeros((len(units), 5))
    for labels in np.ndindex(*[5] * len(units)):
        e = sum(node[i, x] for i, x in enumerate(labels)) + sum(weight[kind] * (labels[i] == labels[k]) for i, k, kind in pii.edges_of(units))
        for i, x in enumerate(labels):
            total[i, x] += np.exp(e)
    total /= total.sum(1, keepdims=True)
    ordered = np.sort(total, 1)
    return total.argmax(1), ordered[:, -1] - ordered[:, -2]


def test_messages_agree_with_enumeration():
    rng = np.random.default_rng(8)
    loops = right = sure = 0
    for _ in range(60):
        model = pii.Field({s: rng.normal(0, 1, 5).tolist() for s in "abc"}, skip=rng.uniform(0.2, 1.5), similar=rng.uniform(0, 1), chain=rng.uniform(-0.3, 0.6))
        units, at = [], 0
        for k in range(6):
            at += int(rng.choice([10, 200]))
            units.append(pii.Unit(at, at + 5, "n" + rng.choice(["1234567", "91234567", "7654321"]), str(rng.choice(list("abc"))), 0 if k == 0 else None))
            at += 5
        loops += len({frozenset(e[:2]) for e in pii.edges_of(units)}) >= len(units)
        want, lead = marginals(model, units)
        got = model.labels(units)
        sure += (lead > 0.1).sum()
        right += (got == want)[lead > 0.1].sum()
    assert loops > 30 and right >= 0.97 * sure


def test_every_unit_keeps_its_chain_edge_and_similar_keys_are_joined():
    units = [pii.Unit(0, 12, "n7435553824", "n10+", 3), pii.Unit(20, 30, "n9", "n10"), pii.Unit(40, 50, "n7435553824", "n10"), pii.Unit(60, 70, "n2125553824", "n10"), pii.Unit(500, 510, "n7435553824", "n10")]
    assert set(pii.edges_of(units)) == {(0, 1, 2), (1, 2, 2), (0, 2, 0), (2, 3, 1), (2, 3, 2), (2, 4, 0), (0, 4, 0), (3, 4, 1)}


def test_edge_weights_are_trained():
    even = [0.0] * 5
    agree = [(even, y, f"0.{y}", 50.0) for y in range(5)]
    differ = [(even, y, f"2.{(y + 1) % 5}", 50.0) for y in range(5)]
    w = pii.weights_of([*agree, *differ], (1.0, 4.0, 0.0))
    assert w[0] > 4 and w[1] == 4.0 and w[2] < -2
    mixed = pii.weights_of([(even, 1, "0.1", 800.0), *[(even, y, "0.1", 50.0) for y in (0, 2, 3, 4)]], (0.0, 0.0, 0.0))
    assert mixed[0] == pytest.approx(np.log(16), abs=0.05)  # odds of 16 to 1 for each other label


OWN = {k: licenses.words_of(v) for k, v in licenses.TEMPLATES.items()}


def found_in(text):
    return [(name, line) for name, _, _, line, _ in licenses.scan_text(text, OWN, 0.75)]


def test_license_scan(spark, empty):
    mit = licenses.TEMPLATES["MIT"]
    rows = [(1, "intro words\nReleased under the MIT License.\nmore", "x", 1), (2, "before\n" + "\n".join(" ".join(mit.split()[k : k + 12]) for k in range(0, 90, 12)) + "\nafter it all", "x", 1), (3, "plain prose without any of it", "x", 1), (4, None, "x", 1)]
    rows += [(5, "Released under the MIT License.\nReleased under the MIT License.", "x", 1), (6, "", "x", 1), (None, "Licensed under CC BY 4.0.", "x", 1)]
    rows.append(rows[0])
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert same([(r["doc_id"], r["license"], r["first_line"]) for r in got], [(1, "MIT notice", 1)] * 2 + [(2, "MIT", 1), (5, "MIT notice", 0), (5, "MIT notice", 1), (None, "CC-BY-4.0 mark", 0)])
    assert next(r for r in got if r["doc_id"] == 2)["coverage"] > 0.9
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize("name", ["MIT notice", "BSD notice", "GPL-2.0 notice", "GPL-3.0 notice", "LGPL-3.0 notice", "AGPL-3.0 notice", "Apache-2.0 notice", *(f"CC-{k}-{v} {w}" for k in ("BY", "BY-SA", "BY-NC", "BY-NC-ND") for v in ("4.0", "3.0") for w in ("mark", "notice"))])
def test_licenses_are_told_apart(name):
    rng = random.Random(4)
    notice = licenses.TEMPLATES[name]
    assert found_in(notice) == [(name, 0)]
    assert found_in(f"{prose(rng, 40)} {notice} {prose(rng, 30)}\n{notice}") == [(name, 0), (name, 1)]
    assert found_in(" ".join([notice] * 6)) == [(name, 0)] * 6


def test_prose_and_unknown_licenses_give_nothing():
    rng = random.Random(5)
    assert not found_in(prose(rng, 3000)) and not found_in("the film was released under the name of an old license to its public")
    assert not found_in("Released under the Foo License.") and not found_in("Licensed under CC BY 2.0.")


def test_license_inside_long_lines():
    rng = random.Random(4)
    head = licenses.TEMPLATES["GPL-3.0 header"].split()
    text = " ".join(head[:20]) + "\nunrelated vendor banner stands between both halves here\n" + " ".join(head[20:])
    assert licenses.scan_text(text, OWN, 0.75) == [("GPL-3.0 header", 1.0, len(OWN["GPL-3.0 header"]), 0, 3)]
    for name in ("MIT whole", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "GPL-2.0", "CC0-1.0", "Unlicense", "ISC whole", "AGPL-3.0 header", "LGPL-2.1 header", "GPL-2.0 whole header"):
        got = licenses.scan_text(f"{prose(rng, 200)} {licenses.TEMPLATES[name]} {prose(rng, 200)}", OWN, 0.75)
        assert [(h[0], h[1] > 0.98) for h in got] == [(name, True)], name


def test_license_recall_on_changed_paragraphs():
    """Every twelfth word lost, changed or doubled: at least nine of ten planted texts are found, none under another name."""
    rng, hits, total = random.Random(6), 0, 0
    names = [n for n, w in OWN.items() if 20 <= len(w) <= 400]
    for name in names * 3:
        words = licenses.TEMPLATES[name].split()
        for k in rng.sample(range(len(words)), len(words) // 12):
            words[k] = rng.choice(["", "changed", f"{words[k]} {words[k]}"])
        got = found_in(f"{prose(rng, 50)}\n{' '.join(words)}\n{prose(rng, 50)}")
        total += 1
        hits += any(g == name for g, _ in got)
    assert hits >= 0.9 * total


def test_places_equal_those_without_a_bound():
    """All windows aligned, none left out by its words: the best place of a template is the same."""
    rng = random.Random(7)
    template = [f"t{k % 23}" for k in range(40)]
    for _ in range(40):
        text = [rng.choice(template) if rng.random() < 0.3 else rng.choice(WORDS) for _ in range(rng.randint(0, 150))]
        at = rng.randint(0, len(text))
        own = [w for w in template if rng.random() < 0.9]
        text[at:at] = own
        need, hop, size = 30, 40 // 16 + 1, 60
        every = [len(licenses.align(text[a : a + hop - 1 + size], template)) for a in range(0, max(1, len(text)), hop)]
        got = licenses.places(text, template, need)
        assert (got[0][0] if got else 0) == (max(every) if max(every) >= need else 0)


def test_alignment_matches_in_order():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ([rng.choice("abcdefgh") for _ in range(rng.randint(0, 12))] for _ in range(2))
        got = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in got)
        assert all(x < u and y < v for (x, y), (u, v) in zip(got, got[1:], strict=False))
    values = [rng.randint(0, 50) for _ in range(40)]
    best = [1] * 40
    for i in range(40):
        best[i] += max((best[j] for j in range(i) if values[j] < values[i]), default=0)
    assert len(licenses.longest_increasing(values)) == max(best)


def test_line_dedup(spark, docs, empty):
    rows = [(i, f"own {i}\n  SHARED line\t\nÉTÉ {i % 2}\n\n" + ("Late" if i < 4 else "x"), "x", 1) for i in range(12)] + [(50, None, "x", 1), (51, "", "x", 1), (52, "shared LINE\nshared line", "x", 1), (None, "shared line\nb", "x", 1)]
    rows.append(rows[0])
    own = spark.createDataFrame(rows, SCHEMA)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    rows += [(i, "repeated row\nrest", "x", 1) for i in (70, 70, 71, 71, 72, 73, 74, 75, 76, 77)] + [(i, "just enough\nrest", "x", 1) for i in range(80, 90)]
    own = spark.createDataFrame(rows, SCHEMA)
    held = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            held[key(x)].add(r[0])
    want = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not key(x) or len(held[key(x)]) < 10]
        want.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = [tuple(r) for r in line_dedup.dedup(own, 10).select("doc_id", "n_lines", "n_dropped", "kept").collect()]
    assert same(got, want)
    first = {r["doc_id"]: r["kept"] for r in line_dedup.dedup(own.where("doc_id is not null"), 2, first_stays=True).collect()}
    assert "SHARED" in first[0] and "SHARED" not in first[1]
    assert line_dedup.dedup(empty).count() == 0
    assert line_dedup.dedup(docs).count() == docs.count()


def test_line_dedup_plan_streams_sorted_ranges(spark, capsys):
    long = "\n".join(f"line {k}" for k in range(3000))
    own = spark.createDataFrame([(i, long + f"\nown {i}", "x", 1) for i in range(10)], SCHEMA)
    line_dedup.streamed(own).explain("formatted")
    plan = capsys.readouterr().out
    nodes = re.findall(r"[+]- [* ]*([A-Z][A-Za-z]+)", plan)
    at = nodes.index("Window")
    assert "Exchange" not in nodes[nodes.index("Exchange") + 1 : at] and nodes[at + 1] == "Sort" and "Exchange" in nodes[at + 2 : at + 4]
    assert re.search(r"rangepartitioning\(h1#\d+L? ASC NULLS FIRST, slot#", plan) and not re.search("EvalPython|InPandas|InArrow", plan)
    got = line_dedup.dedup(own, 10).collect()
    assert all((r["n_lines"], r["n_dropped"], r["kept"]) == (3001, 3000, f"own {r['doc_id']}") for r in got)
    stays = {r["doc_id"]: r["n_dropped"] for r in line_dedup.dedup(own, 10, first_stays=True).collect()}
    assert stays == {0: 0, **{i: 3000 for i in range(1, 10)}}
    bitmap = line_dedup.keep_bitmaps(own.select("doc_id", "text")).first()["words"]
    assert bitmap == dict.fromkeys(range(50), 0)  # 3000 lines go; the word of the last line would be full, so it is left out


def test_line_dedup_leaves_clashing_columns_alone(spark):
    names = ["r1", "r2", "words", "lines", "left", "h1", "slot", "before", "_row", "_words", "_kept"]
    rows = [(i, f"shared\nown {i}", *[f"{c} {i}" for c in names]) for i in range(12)]
    own = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in names))
    got = line_dedup.dedup(own).collect()
    assert all(r["kept"] == f"own {r['doc_id']}" and all(r[c] == f"{c} {r['doc_id']}" for c in names) for r in got) and len(got) == 12


def brute_components(rows):
    sets = {}
    for i, t, *_ in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = [i for i in sets if sets[i]]
    for k, a in enumerate(ids):
        for b in ids[:k]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


@pytest.mark.parametrize("small", [1024, 5])
def test_ngram_join(spark, rows, empty, small):
    rng = random.Random(11)
    own = [r for r in rows if r[0] is not None]
    base = [f"w{k}" for k in range(120)]
    for i in range(200, 260):  # a chain: neighbours link, far ones don't
        base[(i - 200) * 2 % 120] = f"n{i}"
        own.append((i, " ".join(base), "x", 1))
    for i in range(300, 330):  # a passage that many share
        own.append((i, " ".join([*[f"p{k}" for k in range(40)], *[f"q{rng.random()}" for _ in range(60)]]), "x", 1))
    want = brute_components(own)
    frame = spark.createDataFrame([*own, (None, "no id here at all", "x", 1)], SCHEMA)
    got = ngram_join.link(frame, small=small, block=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == want
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None]
    if small > 5:
        assert ngram_join.link(empty).count() == 0


def test_ngram_join_repeated_rows_stay_as_many(spark):
    words = [f"w{k}" for k in range(60)]
    one, two = " ".join(words), " ".join([*words[:-1], "other"])
    frame = spark.createDataFrame([(1, one, "x", 1), *[(2, two, "x", 1)] * 3], SCHEMA)
    for small in (1024, 1):
        assert sorted(tuple(r) for r in ngram_join.link(frame, small=small, block=1).collect()) == [(1, 56, 1), *[(2, 56, 1)] * 3]


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).astype("float32").tolist(), 1) for i in range(300)]
    rows += [(300, rows[0][1], 1), (301, None, 1), (302, [None] * 16, 1), (303, [float("nan")] * 16, 1), (304, [float("inf")] + [0.0] * 15, 1), (350, [0.0] * 16, 1)]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), query_block=3, row_block=40).collect()
    known = {i: np.floor(256 * np.array(v, "f4").astype(float)).astype(int) for i, v, _ in rows if i not in (301, 302, 303, 304)}
    want = []
    for q in known:
        if q % 50 == 0:
            best = sorted((-int(known[q] @ v), i) for i, v in known.items() if i != q)[:5]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert same([tuple(r) for r in got], want)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("scale", [0.001, 1.0])
def test_top_k_is_exact_for_large_components(spark, scale):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.integers(0, 2**20, 16) * 97.0 * scale + 1e5).tolist()) for i in range(120)]
    rows += [(200, []), (250, []), (251, [])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), query_block=3, row_block=40).collect()
    known = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = []
    for q in known:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(known[q], v, strict=True)), i) for i, v in known.items() if i != q and len(v) == len(known[q]))[:5]
            want += [(q, k + 1, i, min(-s, 2**63 - 1)) for k, (s, i) in enumerate(best)]
    assert min(w[3] for w in want if w[0] < 200) > 2**53 and same([tuple(r) for r in got], want)
    assert (max(w[3] for w in want) == 2**63 - 1) == (scale == 1.0)


def test_products_of_any_size():
    huge = np.array([[2**62, 2**62], [1, 1]])
    assert topk.products_of(huge, np.array([2, 3])).tolist() == [5 * 2**62, 5]


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = rng.integers(-200, 200, (50, 30)), rng.integers(-200, 200, (20, 30))
    a, b = topk.Levels(x), topk.Levels(q)
    for lx, lq in zip(a.levels, b.levels, strict=True):
        assert (lq @ lx.T + 1e-6 >= q @ x.T).all()


def test_quality_base_counts():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", " ", "  ", "\n", "#", "a b a b c", "é|"]) for _ in range(rng.randint(0, 60)))
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
        covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(5)}
        lines = text.split("\n")
        dup = sum(bool(x.strip(" \t\n\x0b\x0c\r")) and x in lines[:k] for k, x in enumerate(lines))
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))
        assert quality.base_counts(text) == want, text


def test_quality_verdict(spark, empty):
    rng = random.Random(8)
    good = [(i, prose(rng, 80), "x", 1) for i in range(200)]
    bad = [(i, " ".join(w + "$$$" for w in prose(rng, 80).split()), "x", 1) for i in range(200, 260)]
    docs = spark.createDataFrame([*good, *bad, (900, None, "x", 1), (901, "too short", "x", 1)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i in range(0, 260, 2)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judge(docs, labels).collect()}
    assert sum(got[i]["kept"] for i in range(200)) >= 198 and not any(got[i]["kept"] for i in range(200, 260))
    assert got[900]["base_failed"] and got[901]["base_failed"] and not got[900]["kept"]
    assert quality.judge(empty, labels).count() == 0
    alone = quality.judge(docs, labels.limit(0)).where("kept").count()
    assert alone == 260
