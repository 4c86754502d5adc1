"""The corpus operators against straightforward versions, on small and awkward documents."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from brute import base_spans, contaminated, crc, near_components, shingles, without_repeats, words

from shopgauge.llm import decontaminate, exactdup, graph, hilbert, katz, mixing, neardup, passages, pii, quality, queries, toxicity
from shopgauge.llm.shared import KEYS, shared_folder
from shopgauge.llm.words import pieces, text_bytes, word_hashes

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, words int, shard string, rows int, name string, finish string"


def prose(rng, n, letters="abcdefgh"):
    return " ".join("".join(rng.choices(letters, k=rng.randint(1, 4))) for _ in range(n))


def awkward_rows():
    """Copies, near copies, chains, shared passages, empty, null and very long texts."""
    rng = random.Random(3)
    base, shared = prose(rng, 60), prose(rng, 20)
    own = base.split()
    rows = [(1, base), (2, base), (3, base.upper()), (4, "\t" + base.replace(" ", "\n"))]
    for i in range(5, 15):  # each some words away from the one before
        own[rng.randrange(len(own))] = f"w{i}"
        rows.append((i, " ".join(own)))
    rows += [(20 + i, f"{prose(rng, 15)} {shared} {prose(rng, 15)}") for i in range(6)]
    rows += [(30, None), (31, ""), (32, " \t\n"), (33, "one"), (34, "one"), (35, "two words"), (36, "É é É")]
    rows += [(40, prose(rng, 30_000)), (41, "a " * 3000), (42, "a " * 2990), (43, "x" * 50_000)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, f"s{(i or 0) % 3}" if i != 33 else None, 1, "S", 2, "x", 3, "n", "f") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5)


@pytest.fixture(scope="module")
def given():
    con = duckdb.connect()
    return con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def test_word_hashes():
    rng = random.Random(1)
    for _ in range(200):
        texts = ["".join(rng.choices(["a", "B", "é", " ", "\n", "\x0b", "\x85", "x", ""], k=rng.choice([0, 1, 3, 20]))) for _ in range(rng.choice([1, 2, 7]))]
        found, of = word_hashes(*text_bytes(pa.array(texts, pa.large_string())))
        flat = [w for t in texts for w in words(t)]
        assert len(found) == len(flat) and len(set(zip(flat, found.tolist()))) == len(set(flat)) == len(set(found.tolist()))
        assert of.tolist() == np.cumsum([0] + [len(words(t)) for t in texts]).tolist()


def test_pieces_keep_every_row():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(9)), "text": ["x" * n for n in (0, 5, 9, 1, 0, 30, 2, 2, 2)]})
    assert [i for p in pieces([batch], 8) for i in p.column("doc_id").to_pylist()] == list(range(9))


# ---- personal data ----------------------------------------------------------------------

PRIVATE = [
    "a@b.c", "x a.b+c@host-1.example.org, y@z no@dot @x.y a@b.c@d.e", "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.003.4 1.2.3",
    "4111 1111 1111 1111 4111111111111112 5500-0000-0000-0004 4111  1111", "+1 (555) 123-4567 +12 +49.30.123456789012345", None, "", "é+1 555 123 4567é ü@x.de",
    "9" * 4000 + ".1.1.1", "a" * 5000, "+" + "1" * 40, "mail:joe@x.org;ip=10.0.0.1",
]


def test_base_spans():
    rng = random.Random(5)
    texts = [t or "" for t in PRIVATE] + ["".join(rng.choices("a1.@+- ()4", k=60)) for _ in range(3000)]
    for text in texts:
        assert [(pii.KINDS[k], b, e) for k, b, e in pii.base_spans(text)] == base_spans(text), text


def test_personal_data_query(spark):
    con = duckdb.connect()
    got = {r.doc_id: r for r in queries.op1_bootstrap(spark, SF).collect()}
    for i, text in con.execute(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall():
        spans = base_spans(text)
        listed = [f"{k}:{b}:{e}" for k, b, e in spans]
        assert got[i].base_sha256 == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in spans) for k in pii.KINDS]
        assert set(listed) <= set(got[i].spans.split(",")) or not listed


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"lorem ipsum the mailbox of user{i}@host{i}.example.org was full and tel: +1 555 {i:03d} 4567 rang") for i in range(40)]
    rows += [(100, "see the mailbox of anna_b#host was full"), (101, "model x100 in the year 1999 cost of 33 a"), (102, None), (103, ""),
             (104, "tel: 5551234 or"), (None, "a@b.c")] + [(200 + i, f"the top of hill {i}") for i in range(80)]
    found = {r.doc_id: r for r in pii.personal_data(frame(spark, rows)).collect()}
    assert [(s.kind, s.text) for s in found[100].more] == [("email", "anna_b#host")]
    assert [(s.kind, s.text) for s in found[104].more] == [("phone", "5551234")]
    assert not found[101].more and not found[102].base and not found[103].base and len(found[None].base) == 1
    assert all(not found[200 + i].more for i in range(80))
    assert pii.personal_data(frame(spark, rows).where("false")).count() == 0


def test_rare_patterns_are_kept_in_a_large_table(spark):
    """A pattern that a few of many seeds meet finds what stands in it, however many other seeds and copies there are."""
    rows = [(i, f"reach crew{i} quickly by clerk{i}@host{i}.example.org before noon") for i in range(4)]
    rows += [(10, "reach crew9 quickly by anna_b#host before noon")]
    rows += [(100 + i, f"from: user{i}@host{i}.example.org wrote this") for i in range(3000)]
    rows += [(9000 + i, "copied boilerplate of one@copied.example.org in all pages") for i in range(3000)]
    found = {r.doc_id: r for r in pii.personal_data(frame(spark, rows).repartition(4)).collect()}
    assert len(found) == len(rows) and [(s.kind, s.text) for s in found[10].more] == [("email", "anna_b#host")]
    assert sum(len(r.more) for r in found.values()) == 1


FORMS = [
    ("tel: 555 123 4567 or", "555 123 4567"), ("tel: (030) 123 456 or", "(030) 123 456"), ("tel: (030)123-456 or", "(030)123-456"), ("tel: (5551234), or", "5551234"),
    ("tel: 030 / 123 456. Or", "030 / 123 456"), ("tel: 555 123 at 12:30 we", "555 123"), ("tel: 5551234. 12 of", "5551234"), ("tel: 555 " + "123 " * 9 + "x", "555" + " 123" * 5),
    ("tel: 555 1234 10.0.0.1 is", "555 1234"), ("tel: 030 (123) 456 or", "030 (123) 456"), ("tel: 555 (12 of them)", "555"),
    ("mail to: anna(at)host.org or", "anna(at)host.org"), ("mail to: anna [at] host [dot] org or", "anna [at] host [dot] org"), ("mail to: anna at host dot org, or", "anna at host dot org"),
    ("mail to: <anna dot b at host dot org> or", "anna dot b at host dot org"), ("mail to: j\u00fcrgen(at)host.de. Or", "j\u00fcrgen(at)host.de"), ("mail to: anna@host (dot) org or", "anna@host (dot) org"),
    ("mail to: anna at host.org or", "anna at host.org"), ("tel: 5551234 at host.org", "5551234"), ("mail to: 12(at)host.org or", "12(at)host.org"),
    ("mail to: (anna_b#host), was", "anna_b#host"), ("mail to: nobody we know", None), ("tel: none", None),
]


def test_unseen_identifiers_of_several_words(spark):
    rows = [(i, f"one may mail to: user{i}@host{i}.example.org or call tel: +1 555 {i:03d} 4567 today") for i in range(99)]
    rows += [(1000 + i, text) for i, (text, _) in enumerate(FORMS)]
    rows += [(2000, "the first 12 34 rows looked at host.org and met (at) noon")]
    found = {r.doc_id: r for r in pii.personal_data(frame(spark, rows)).collect()}
    for i, (text, span) in enumerate(FORMS):
        kind = "phone" if text.startswith("tel") else "email"
        assert [(s.kind, s.text) for s in found[1000 + i].more] == ([(kind, span)] if span else []), text
        assert all(text[s.begin : s.end] == s.text for s in found[1000 + i].more)
    assert all(not r.more for i, r in found.items() if i < 1000 or i == 2000)


def test_occurrences_are_hashed_as_contexts_are():
    texts = ["A b\u00a0C", "", "\u00c9t\u00e9 x", "y", "", "b c"]
    flat = [t.lower().split() for t in texts]
    expected = [w for f in flat for w in f] + [" ".join(p) for f in flat for p in zip(f, f[1:])]
    assert pii._occurrences(texts).tolist() == pii._hashes(expected).tolist() and len(set(pii._hashes(expected).tolist())) == len(set(expected))


# ---- language model ---------------------------------------------------------------------


def katz_by_hand(docs):
    """doc -> (held out, tokens, known, N, base, score), and the worst error of a context's total probability."""
    texts = [(i, words(t) + [None]) for i, t in docs]
    single, pairs = Counter(), Counter()
    for i, own in texts:
        if crc(i) % 7 != 2:
            single.update(own)
            pairs.update(zip([0, *own], own))

    def counts(c):
        of = Counter(c.values())
        return katz.Counts(tuple(of[r] for r in range(1, katz.SMALL + 2)), len(c), sum(c.values()))

    u, p = counts(single), counts(pairs)
    d, n, v = p.discounts(), u.total, u.kinds
    share = {w: float(u.probability(np.array([c]))[0]) for w, c in single.items()}
    after, weight, worst = defaultdict(dict), {}, abs(sum(share.values()) + u.unseen() - 1)
    for (h, w), c in pairs.items():
        after[h][w] = c
    for h, f in after.items():
        total = sum(f.values())
        free = sum((1 - d[min(c, katz.SMALL + 1)]) * c for c in f.values())
        if free <= 0:
            total, free = total + 1, 1
        weight[h] = (total, free / total / (1 - sum(share[w] for w in f)))
        mass = sum(d[min(c, katz.SMALL + 1)] * c / total for c in f.values())
        worst = max(worst, abs(mass + weight[h][1] * (1 - sum(share[w] for w in f)) - 1))
    out = {}
    for i, own in texts:
        base = score = 0.0
        for h, w in zip([0, *own], own):
            base += math.log10((single[w] + 1) / (n + v + 1))
            c = pairs.get((h, w), 0)
            q = d[min(c, katz.SMALL + 1)] * c / weight[h][0] if c else (weight[h][1] if h in weight else 1) * share.get(w, u.unseen())
            score += math.log10(q)
        out[i] = (crc(i) % 7 == 2, len(own), sum(w in single for w in own), n, base, score)
    return out, worst


def same_scores(got, expected):
    assert len(got) == len(expected)
    for r in got:
        want = expected[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4]
        assert r.base_score == pytest.approx(want[4], rel=1e-9) and r.score == pytest.approx(want[5], rel=1e-7)


def test_katz(spark, docs, rows, given):
    expected, worst = katz_by_hand(rows)
    assert worst < 1e-9
    same_scores(katz.scores(docs).collect(), expected)
    expected, worst = katz_by_hand(given)
    assert worst < 1e-9
    same_scores(queries.op2_katz(spark, SF).collect(), expected)
    held = [w for w in expected.values() if w[0]]
    assert sum(w[5] for w in held) > sum(w[4] for w in held)


def test_katz_without_training(spark):
    held = next(i for i in range(100) if crc(i) % 7 == 2)
    (row,) = katz.scores(frame(spark, [(held, "some words")])).collect()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.score, row.base_score) == (3, 0, 0, 0, 0)
    assert katz.scores(frame(spark, [(1, "x")]).where("false")).count() == 0


def test_discounts_are_normalised():
    for of in ((90, 30, 15, 9, 6, 4), (5, 0, 0, 0, 0, 0), (0, 3, 0, 0, 0, 0), (10, 50, 1, 9, 0, 2)):
        total = sum(r * n for r, n in enumerate(of, 1))
        c = katz.Counts(of, sum(of), total)
        mass = sum(n * c.probability(np.array([r]))[0] for r, n in enumerate(of, 1))
        assert mass + c.unseen() == pytest.approx(1) and c.unseen() > 0


# ---- near and exact duplicates ----------------------------------------------------------


@pytest.mark.parametrize("settings", [neardup.Settings(), neardup.Settings(block=2)])
def test_near_duplicates(docs, rows, settings):
    expected = near_components(rows)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs, settings).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == expected
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_duplicates_of_a_large_group(spark):
    """Copies that are not all within reach of each other: only chains join them."""
    rng = random.Random(9)
    base = prose(rng, 80).split()
    rows = []
    for i in range(150):
        own = list(base)
        for at in rng.sample(range(80), rng.choice([0, 1, 2, 3, 3, 4])):
            own[at] = f"n{rng.randrange(10**6)}"
        rows.append((i, " ".join(own)))
    got = neardup.near_duplicates(frame(spark, rows).repartition(4), neardup.Settings(block=40)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == near_components(rows)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    text = prose(random.Random(1), 40)
    got = neardup.near_duplicates(frame(spark, [(None, text), (7, text + " end"), (7, text + " end"), (None, "other words here and there again"), (8, "")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [
        ("7", "7", True), ("7", "7", True), ("8", "8", True), ("None", "7", False), ("None", "None", True)]
    assert neardup.near_duplicates(frame(spark, [(1, "x")]).where("false")).count() == 0


def test_posterior_bounds():
    least = neardup.least_matches(neardup.Settings())
    assert list(least) == [32, 64, 96, 128] and least[128] > 60 and all(0 < m < 0.75 * n for n, m in least.items())


def test_components(spark):
    links = [(b"a", b"b"), (b"b", b"c"), (b"c", b"d"), (b"x", b"y"), (b"z", b"z"), *((b"m%d" % i, b"m%d" % (i + 1)) for i in range(20))]
    got = {bytes(r.node): bytes(r.root) for r in graph.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert got[b"d"] == b"a" and got[b"y"] == b"x" and b"z" not in got and {got[b"m%d" % i] for i in range(21)} == {b"m0"}


def test_exact_duplicates_and_the_persistent_index(spark, rows):
    folder = shared_folder(spark)
    first, second = frame(spark, rows[:10]), frame(spark, [*rows[8:12], (99, rows[0][1]), (None, "new text"), (None, None), (98, " ")])
    got = {r.doc_id: r for r in exactdup.deduplicate(first, exactdup.DigestIndex(spark, folder)).collect()}
    strip = {i: re.sub(r"[\x20\x09-\x0D]", "", t or "") for i, t in rows}
    assert all(r.text_sha256 == hashlib.sha256(strip[i].encode()).hexdigest() for i, r in got.items())
    assert {i for i, r in got.items() if r.keep_id == 4} == {1, 2, 4} and not got[1].kept and got[4].kept and got[1].group_size == 3
    again = exactdup.DigestIndex(spark, folder)
    digests = len({strip[i] for i, _ in rows[:10]})
    assert again.rows().count() == digests
    more = {r.doc_id: r for r in exactdup.deduplicate(second, again).collect()}
    assert not more[99].kept and more[99].keep_id == 4 and more[99].group_size == 4
    assert not more[rows[8][0]].kept and more[rows[11][0]].kept and more[98].kept and more[98].group_size == 2
    assert exactdup.DigestIndex(spark, folder).rows().count() == digests + 4
    assert exactdup.deduplicate(first.where("false"), again).count() == 0
    plan = first.select("doc_id")._sc._jvm.PythonSQLUtils.explainString
    joined = exactdup.groups_of(exactdup.digests(second)).join(again.rows().hint("merge"), "text_sha256", "left_anti")
    text = plan(joined._jdf.queryExecution(), "simple")
    assert "SortMergeJoin" in text and "Bucketed: true" in plan(joined._jdf.queryExecution(), "formatted")


# ---- mixing and sharding ----------------------------------------------------------------


def test_mixing(spark, docs, rows):
    got = mixing.mixed_words(docs).collect()
    size = {i: len((t or "").encode().split()) for i, t in rows}
    assert {r.doc_id: r["size"] for r in got} == size
    assert all(0 <= r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0 for r in got)
    sources = defaultdict(int)
    for i, _ in rows:
        sources["~" if i == 33 else f"s{i % 3}"] += size[i]
    total, weights = sum(size.values()), dict(zip(sorted(sources), (5, 2, 1, 5)))
    targets, open_ = {}, set(sources)
    while open_:
        level = (total - sum(targets.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if 3 * sources[s] < weights[s] * level}
        targets |= {s: 3 * sources[s] for s in full} if full else {s: weights[s] * level for s in open_}
        open_ -= full or open_
    for r in got:
        s = "~" if r.doc_id == 33 else f"s{r.doc_id % 3}"
        assert r.source_size == sources[s] and r.target == pytest.approx(targets[s])
    taken = defaultdict(int)
    for r in got:
        taken["~" if r.doc_id == 33 else f"s{r.doc_id % 3}"] += r.taken
    assert sum(taken.values()) <= total
    for s in sources:
        assert abs(taken[s] - targets[s]) <= max(size[i] for i, _ in rows if ("~" if i == 33 else f"s{i % 3}") == s)
    again = mixing.mixed_words(docs.repartition(3, "text")).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_mixing_repeated_rows_and_nothing(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "d e"), (2, None)]
    got = mixing.mixed_words(frame(spark, rows)).collect()
    assert len(got) == 4 and all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mixed_words(frame(spark, rows).where("false")).count() == 0
    assert [r.taken for r in mixing.mixed_words(frame(spark, [(1, ""), (2, None)])).collect()] == [0, 0]


def test_hilbert_curve_is_a_curve(spark):
    for dims, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        names = [f"c{i}" for i in range(dims)]
        grid = spark.range(side**dims).selectExpr(*(f"CAST(id DIV {side**i} % {side} AS INT) AS c{i}" for i in range(dims)))
        path = hilbert.with_curve(grid, names, "at", bits).orderBy("at").collect()
        assert [r["at"] for r in path] == list(range(side**dims))
        assert all(sum(abs(a[n] - b[n]) for n in names) == 1 for a, b in zip(path, path[1:]))


def test_sharding(spark, docs, rows):
    got = hilbert.shard(docs).collect()
    text = {i: (t or "").encode() for i, t in rows}
    assert {r.doc_id: (r["size"], r.text_crc32) for r in got} == {i: (len(t) + 8, zlib.crc32(t)) for i, t in text.items()}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in got)
    assert {r.law for r in got} == {"rows"} and {r.grown_shard for r in got} == {None}
    assert hilbert.shard(docs.where("false")).count() == 0
    few = hilbert.shard(frame(spark, [(1, "a"), (1, "a"), (None, None)])).collect()
    assert sorted(r.slot for r in few) == [0, 0, 0] and len({r.shard for r in few}) == 3


# ---- passages and benchmark -------------------------------------------------------------


def test_repeated_passages(spark, docs, rows, given):
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in passages.without_repeats(docs).collect()}
    assert got == without_repeats(rows) and any(v[1] for v in got.values())
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op6_automata(spark, SF).collect()}
    assert found == without_repeats(given)


def test_repeated_passages_random(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices("ab", k=rng.randint(0, 60)))) for i in range(60)] + [(None, "a " * 30)]
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in passages.without_repeats(frame(spark, rows).repartition(3)).collect()}
    assert got == without_repeats(rows)
    assert passages.without_repeats(frame(spark, rows).where("false")).count() == 0


def test_benchmark(spark, rows):
    rng = random.Random(8)
    items = [(i, prose(rng, n)) for i, n in enumerate((16, 25, 40, 59, 40, 3))] + [(90, None), (91, ""), (92, "a a a a a a a a")]
    docs = list(rows)
    for i, text in items[:5]:
        own = text.split()
        docs += [(200 + i, f"{prose(rng, 30)} {text.upper()} {prose(rng, 30)}"), (300 + i, text), (400 + i, " ".join(own[: len(own) * 3 // 4]))]
        for k in range(3):
            changed = list(own)
            changed[rng.randrange(len(own))] = "zz"
            if k:
                del changed[rng.randrange(len(own))]
            docs.append((500 + 10 * i + k, f"{prose(rng, 9)} {' '.join(changed)} {prose(rng, 9)}"))
    docs += [(600, items[5][1]), (601, None)]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(frame(spark, docs).repartition(4), table).collect()}
    expected = contaminated(docs, items)
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)
    assert decontaminate.contaminated(frame(spark, docs).where("false"), table).count() == 0
    assert decontaminate.contaminated(frame(spark, docs), table.where("false")).count() == 0


def test_short_items_inside_longer_documents(spark, tmp_path):
    items = [(1, "Yes"), (2, "forty two"), (3, "a b\tc"), (4, "one two three four"), (5, "a a"), (6, None), (7, ""), (8, "Forty TWO"), (9, "one two three four five six")]
    rows = [(1, "he said yes and yes"), (2, "it is Forty\n two , forty two"), (3, "a b c"), (4, "x a b c a b c y"), (5, "zero one two three four five"), (6, "a a a a"), (7, None), (8, ""),
            (9, "yesterday forty and two, a b"), (None, "yes"), (10, "x one two three four five six"), (11, "four two forty"), (11, "forty two"), (11, "forty two")]
    expected = []
    for d, text in set(rows):
        own = (text or "").lower().split()
        for i, item in items:
            asked = (item or "").lower().split()
            places = [p for p in range(len(own) - len(asked) + 1) if asked and own[p : p + len(asked)] == asked]
            expected += [(d, i, places[0], len(asked), 1.0)] if places else []
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, rows).repartition(3)
    for s in (decontaminate.Settings(), decontaminate.Settings(broadcast_bytes=0)):
        got = [tuple(r)[2:] for r in decontaminate.contaminated(docs, table, s).collect()]
        assert sorted(map(str, got)) == sorted(map(str, expected)) and len(expected) == 12
    table.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id for r in corpus_pipeline.without_benchmark(spark, docs, str(tmp_path)).collect()) == [7, 8, 9, 11]


def test_hamming_index_misses_nothing_within_the_radius():
    s = decontaminate.Settings()
    assert s.radius < s.blocks * (s.flips + 1) and len(decontaminate.near_values(s)) == 37
    with pytest.raises(ValueError):
        decontaminate.Settings(radius=48)


# ---- classifiers ------------------------------------------------------------------------


@pytest.mark.parametrize("name, column, least", [("op7_ftrl", "toxic", 0.85), ("op9_subword", "quality", 0.97)])
def test_classifiers(spark, name, column, least):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.QUERIES[name](spark, sf).collect()}
    labels = duckdb.connect().execute(f"SELECT doc_id, {column} FROM '{sf}/labels.parquet'").fetchall()
    held = [(got[i].score, y) for i, y in labels if got[i].held_out]
    ranks = sorted(held)
    ones = sum(y for _, y in held)
    area = (sum(k for k, (_, y) in enumerate(ranks, 1) if y) - ones * (ones + 1) / 2) / (ones * (len(held) - ones))
    assert area > least and all(0 <= r.score <= 1 for r in got.values())
    divisor, out, limit = (3, 1, 0.7) if column == "toxic" else (5, 0, 0.3)
    assert all(r.held_out == (crc(i) % divisor == out) and r.predicted == int(r.score >= limit) for i, r in got.items())


@pytest.mark.parametrize("module, column", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_on_awkward_rows(spark, docs, rows, module, column):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i, _ in rows] + [(1, None, None), (None, 1, 1), (1, 1, 1)], "doc_id long, quality int, toxic int")
    got = module.score(docs, module.fit(docs, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    empty = {r.score for r in got if r.doc_id in (30, 31, 32)}
    assert len(empty) <= 2 and {r.score for r in got if r.doc_id in (30, 31)} <= empty
    none = module.fit(docs, labels.where("false"))
    assert {r.score for r in module.score(docs, none).collect()} == {0.5}
    assert module.score(docs.where("false"), none).count() == 0
    assert len(KEYS) == 2 and shingles([]) == []
