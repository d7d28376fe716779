"""Each corpus operator against brute force on small tables: nulls, empty texts, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovekit.llm import components, decontaminate, jaccard_join, license_scan, line_dedup, lm_scoring, maxscore, piece_codec, pieces, private_data, token_counts, toxicity

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def near(text, edits):
    words = text.split(" ")
    for _ in range(edits):
        words[RNG.randrange(len(words))] = "edit" + str(RNG.randrange(10**6))
    return " ".join(words)


BASE = [prose(120) for _ in range(6)]
LINES = "\n".join(prose(15) for _ in range(6))
TEXTS = [
    *BASE,
    *[near(BASE[0], e) for e in (1, 1, 2, 3, 8, 20)],
    BASE[1],
    BASE[1].upper(),
    "",
    None,
    " \t\n ",
    "one two",
    "one two",
    prose(3000),
    prose(10) + "\n" + LINES + "\n" + prose(9),
    prose(12) + "\n\n" + LINES,
    LINES,
    "Licensed under the Apache License, Version 2.0.\nmail bob.smith@x.org or +1 (988) 555-2485, card 4111 1111 1111 1111, host 10.0.0.1",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "zz", i) for i, t in enumerate(TEXTS)] + [(None, BASE[2], "zz", -1), (3, BASE[3], "zz", -2), (7, "other text of a repeated id", "zz", -3)]
    return spark.createDataFrame(rows, "doc_id long, text string, node string, key long").cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


def words(t):
    return (t or "").encode().lower().split()


def shingles(t, k):
    w = words(t)
    return {tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)} if w else set()


def test_jaccard_join(docs, nothing):
    for k, percent in ((3, 90), (5, 80)):
        rows = [(r.doc_id, shingles(r.text, k)) for r in docs.collect()]
        parent = list(range(len(rows)))

        def root(x, parent=parent):
            while parent[x] != x:
                x = parent[x]
            return x

        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows[:i]):
                if a and b and 100 * len(a & b) >= percent * len(a | b):
                    parent[root(i)] = root(j)
        least = {}
        for i, (d, s) in enumerate(rows):
            if d is not None:
                least[root(i)] = min(d, least.get(root(i), d))
        want = Counter((d, len(s), least.get(root(i))) for i, (d, s) in enumerate(rows))
        for small_key in (16, 1):  # 1: nearly all pairs that are left meet by their differences
            got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(docs, k, percent, small_key=small_key).collect())
            assert got == want
    assert jaccard_join.near_duplicates(nothing).collect() == []


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 60), (7, 7), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**dict.fromkeys(range(1, 31), 1), 40: 40, 50: 40, 60: 40}


def test_fragment_keys_meet_for_every_link():
    rng = np.random.default_rng(2)
    starts = np.array(jaccard_join.size_classes(80, 1 << 20))
    for n in (1, 4, 5, 9, 20, 61, 200):
        for _ in range(30):
            x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop, add = rng.integers(0, n // 5 + 1), rng.integers(0, n // 5 + 1)
            y = np.unique(np.concatenate([rng.permutation(x)[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
            both = len(np.intersect1d(x, y))
            if len(y) and 100 * both >= 80 * (len(x) + len(y) - both):
                assert set(jaccard_join.fragment_keys(x, 80, starts)[0]) & set(jaccard_join.fragment_keys(y, 80, starts)[0])


def test_parity_sketch_is_a_lower_bound():
    draw = np.random.default_rng(5)
    for n in (1, 7, 60, 900):
        x = np.unique(draw.integers(0, 1 << 63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: n - n // 5], draw.integers(0, 1 << 63, n // 5, dtype=np.uint64)]))
        a, b = jaccard_join.parity_sketch(x), jaccard_join.parity_sketch(y)
        while len(a) != len(b):
            a, b = (a[: len(a) // 2] ^ a[len(a) // 2 :], b) if len(a) > len(b) else (a, b[: len(b) // 2] ^ b[len(b) // 2 :])
        assert int(np.bitwise_count((a ^ b).view(np.uint64)).sum()) <= len(np.setxor1d(x, y))
        assert not (jaccard_join.parity_sketch(x) ^ jaccard_join.parity_sketch(x)).any()


def test_nodes_of_many_large_keys_have_one_short_prefix(spark):
    """A node's rows don't grow with the keys and centres that it meets others in, and linked sets share one of them."""
    draw = np.random.default_rng(11)
    common = draw.integers(0, 1 << 62, 300)
    sets = [np.unique(np.concatenate([common, draw.integers(0, 1 << 62, 200)])) for _ in range(40)]
    sets.append(np.unique(np.concatenate([sets[0][:-20], draw.integers(0, 1 << 62, 20)])))
    rows = [(i, len(s), f, s[f::4].tolist()) for i, s in enumerate(sets) for f in range(4)]
    fragments = spark.createDataFrame(rows, "node long, n long, fragment int, shingles array<long>")
    nodes = spark.createDataFrame([(i, i, True) for i in range(len(sets))], "node long, component long, far boolean")
    prefixes = jaccard_join._prefixes(nodes, fragments, 80, 1000)
    assert {r.node: r["count"] for r in prefixes.groupBy("node").count().collect()} == {i: len(s) - -(-len(s) * 80 // 100) + 1 for i, s in enumerate(sets)}
    assert [tuple(r) for r in jaccard_join._meetings(prefixes, 80).collect()] == [(0, 40)]


def test_decontamination(spark, docs, nothing):
    items = spark.createDataFrame([(1, " ".join(BASE[4].split()[20:50])), (2, "one two"), (3, prose(30)), (4, None), (5, ""), (1, near(" ".join(BASE[5].split()[3:60]), 1))], "item_id long, text string")
    want = Counter()
    for r in docs.collect():
        for i in items.collect():
            k = min(5, len(words(i.text)))
            a = shingles(i.text, 5)
            b = shingles(r.text, k) if len(words(r.text)) >= max(k, 1) else set()
            if a and 100 * len(a & b) >= 80 * len(a):
                want[r.doc_id, i.item_id, len(a), len(a & b)] += 1
    for block in (16_000_000, 100):
        got = decontaminate.contained_items(docs, items, block_bytes=block).collect()
        assert Counter((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared) for r in got) == want
    assert decontaminate.contained_items(nothing, items).collect() == [] == decontaminate.contained_items(docs, items.limit(0)).collect()


def test_line_dedup(docs, nothing):
    got = {(r.doc_id, r.text, r.key): r for r in line_dedup.dedup_lines(docs).collect()}
    by_key = {r.key: r for r in got.values()}
    assert len(got) == docs.count()
    a, b, c = (by_key[i] for i in (20, 21, 22))
    assert a.n_removed_lines == 0 and b.n_removed_lines == 6 and b.removed_lines == "2-7" and c.text == ""
    assert by_key[12].n_removed_lines == 1 and by_key[-1].n_removed_lines == 1  # copies of texts 1 and 2, the latter without an id
    assert by_key[15].text is None and by_key[15].n_lines == 0 and by_key[17].n_removed_lines == 0
    assert line_dedup.dedup_lines(nothing).collect() == []
    with pytest.raises(ValueError):
        line_dedup.repeated_runs(docs, min_words=30)


def test_license_scan(docs, nothing):
    want = {(r.doc_id, name) for r in docs.collect() for name, t in license_scan.TEMPLATES if shingles(t, 5) and len(words(t)) >= 5 and 100 * len(shingles(t, 5) & shingles(r.text, 5)) >= 80 * len(shingles(t, 5))}
    assert want == {(23, "apache-2.0-line")}
    assert {(r.doc_id, r.license_id) for r in license_scan.license_matches(docs).collect()} == want
    assert license_scan.license_matches(nothing).collect() == []


def test_license_scan_finds_edited_long_notices(spark):
    rows = []
    for i, (name, t) in enumerate(license_scan.TEMPLATES):
        w = t.split()
        if len(w) > 25:
            w[len(w) // 2] = "changed"
            rows.append((i, prose(37 + i) + " " + " ".join(w) + " " + prose(50), name))
    found = {(r.doc_id, r.license_id) for r in license_scan.license_matches(spark.createDataFrame(rows, "doc_id long, text string, license_id string")).collect()}
    want = {(i, name) for i, t, name in rows if 100 * len(shingles(dict(license_scan.TEMPLATES)[name], 5) & shingles(t, 5)) >= 80 * len(shingles(dict(license_scan.TEMPLATES)[name], 5))}
    assert want and want <= found
    assert all(license_scan.bands_for(n, 80) >= 1 for n in range(1, 400))


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    out = []
    for kind, p in plain.items():
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")), "card": lambda d=d: 13 <= len(d) <= 19 and luhn(d), "phone": lambda d=d: 9 <= len(d) <= 15}
            if good[kind]():
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pretokens_of_any_length_are_merged_in_one_way():
    import sentencepiece

    table = token_counts.pair_table(pieces.model_path())
    library, words_of = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), pieces.vocabulary(pieces.model_path()).words
    draw = random.Random(7)
    texts = ["".join(draw.choice(letters) for _ in range(n)) for letters in ("ethaoni", "aab", "the", "xé漢 ab") for n in (1, 30, 255, 256, 257, 300, 3000, 30_000)]
    texts += ["the" * 3000, "a" * 30_000, "ab" * 777, "thethehe" * 300]
    assert [sum(table.counts(words_of(t))) for t in texts] == [len(library.encode(t)) for t in texts]
    assert 0 < table.calm.mean() < 1  # both kinds of ranks are met


def test_words_beside_a_span_are_counted_not_measured(spark):
    """One text that names an address six times beside one term, other words around: the term is found whatever its length and the white space before it."""
    for term, space in (("abcdefghijklmnopqrstuvwx", " "), ("abcdefgh" * 9, " "), ("abcdefgh" * 700, " "), ("shortterm", " " * 5000)):
        text = " ".join(f"w{i}x zz{'abcdefgh'[i]}qq {term}{space}joe@x.org yy{'abcdefgh'[i]}kk u{i}v" for i in range(6))
        rows = [(1, text), (2, "other words only " * 40)]
        got = {r.doc_id: r.spans for r in private_data.span_digests(private_data.private_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
        at = [i for i in range(len(text)) if text.startswith(term, i)]
        assert [s for s in got[1].split(",") if s.split(":")[0] in ("generalise", "remove") and int(s.split(":")[1]) in at and int(s.split(":")[2]) - int(s.split(":")[1]) == len(term)].__len__() == 6, (term[:20], got[1][:300])


def test_private_data(spark, docs, nothing):
    letters = "a.b@c-1 2+3()9 5_4%\n4242 4242424242424é𠮷"
    odd = ["a@b.c_foo@bar.com", "1.2.3.4.5.6.7.8 999.1.1.1 001.02.3.255", *("".join(RNG.choice(letters) for _ in range(RNG.randint(1, 80))) for _ in range(400))]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    want = Counter((r.doc_id, hashlib.sha256(",".join(base_spans(r.text)).encode()).hexdigest()) for r in table.collect())
    got = private_data.span_digests(private_data.private_data(table)).collect()
    assert Counter((r.doc_id, r.base_sha256) for r in got) == want
    assert private_data.private_data(nothing).collect() == []


def test_disclosing_terms(spark):
    rows = [(i, f"ask {prose(2)} Zanzibarov {prose(1)} joe@x.org {prose(400)}") for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marked = {r.doc_id: r.spans for r in private_data.span_digests(private_data.private_data(table)).collect()}
    at = rows[0][1].index("Zanzibarov")
    assert f"remove:{at}:{at + 10}" in marked[0].split(",")
    clean = private_data.sanitised(table).where("doc_id = 0").first().text
    assert "Zanzibarov" not in clean and "[EMAIL]" in clean and clean.endswith(rows[0][1][-200:])


def test_token_counts_and_codec(spark, docs, nothing):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    letters = "ab é\n\t▁ 0<x>日本𠮷ﬁ\x00.,--==''_  théing"
    odd = ["a  b ", "  ", "▁▁ x", "<s>a</s>", "<0x0A>", "=-" * 400, "日本語𠮷" * 90, " " * 300, *("".join(RNG.choice(letters) for _ in range(RNG.randint(1, 60))) for _ in range(500))]
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    rows = [(r.doc_id, r.text or "", library.encode(r.text or "")) for r in table.collect()]
    got = Counter(tuple(r) for r in token_counts.token_counts(table, limit=50).collect())
    assert got == Counter((d, len(t.encode()), len(i), len(i) > 50) for d, t, i in rows)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = Counter(tuple(r) for r in piece_codec.encode_digests(table).collect())
    assert got == Counter((d, len(i), sha(",".join(map(str, i))), sha(library.decode(i))) for d, _, i in rows)
    assert Counter((r.doc_id, tuple(r.ids)) for r in piece_codec.encode_documents(table).collect()) == Counter((d, tuple(i)) for d, _, i in rows)
    assert token_counts.token_counts(nothing).collect() == [] == piece_codec.encode_digests(nothing).collect()


def test_maxscore(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 12)]) for i in range(3000)]
    rows += [(3000, None), (3001, [None] * 12), (3002, [float("nan")] * 12), (None, [1.0] * 12), (3100, rows[5][1]), (3101, rows[5][1]), (3200, [0.5] * 3), (3300, [])]
    usable = [(i, np.floor(1024 * np.array([*v, *[0.0] * (12 - len(v))])).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = [(q, rank + 1, i, s) for q, x in usable if q % 100 == 0 for rank, (s, i) in enumerate(sorted(((int(x @ y), i) for i, y in usable if i != q), key=lambda z: (-z[0], z[1]))[:10])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1))
    assert sorted(map(tuple, maxscore.top_k(table).collect())) == sorted(want)
    assert maxscore.top_k(table.limit(0)).collect() == []
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="too large"):
        maxscore.top_k(huge)


def test_lm_scores(spark, docs, nothing):
    table = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, prose(200)) for i in range(120)], "doc_id long, text string"))
    rows = [(r.doc_id, words(r.text)) for r in table.collect()]
    held = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 7 == 2
    counts = Counter(w for d, ws in rows if not held(d) for w in [*ws, None])
    n, v = sum(counts.values()), len(counts)
    base = sorted((str(d), len(ws) + 1, sum(counts[w] > 0 for w in [*ws, None]), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*ws, None]), 6)) for d, ws in rows)
    got = lm_scoring.lm_scores(table, train_one_in=2).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == base
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm_scoring.lm_scores(nothing).collect() == []


def test_network_learns_and_is_a_distribution():
    from grovekit.llm.gated_network import Shape, Trainer, log_probabilities, start, text_scores

    shape = Shape(hidden=8, listed=2, members=4, tails=2)
    rng = np.random.default_rng(0)
    texts = [np.array([1 + (i % 5) for i in range(30)] + [0]) for _ in range(60)]
    p = start(shape, np.bincount(np.concatenate(texts), minlength=8), np.zeros(2))
    states = rng.normal(size=(1, 8)).astype(np.float32)
    total = sum(np.exp(log_probabilities(p, shape, states, np.array([t])))[0] for t in range(shape.inputs))
    assert total == pytest.approx(1, abs=1e-5)
    trainer = Trainer(p, shape)
    for _ in range(6):
        trainer.run(texts, streams=8)
    assert text_scores(trainer.p, shape, texts).mean() > 0.5 * text_scores(p, shape, texts).mean()
    one = [text_scores(p, shape, [t])[0] for t in texts[:3]]
    assert np.allclose(text_scores(p, shape, texts[:3], at_once=7), one, rtol=1e-4)


def test_network_gradients_equal_finite_differences():
    from grovekit.llm.gated_network import Shape, Trainer, start

    shape, rng = Shape(hidden=4, listed=2, members=3, tails=2), np.random.default_rng(1)
    p = {k: (v + rng.normal(0, 0.3, v.shape)).astype(np.float32) for k, v in start(shape, np.ones(6), np.ones(2)).items()}
    ids, targets, fresh = rng.integers(0, 8, (5, 7)), rng.integers(0, 8, (5, 7)), rng.random((5, 7)) < 0.2
    targets[rng.random((5, 7)) < 0.2] = -1

    def loss(p):  # in doubles, a token at a time
        p, total, h = {k: v.astype(float) for k, v in p.items()}, 0.0, 4
        state = np.zeros((7, h))
        for t in range(5):
            state[fresh[t]] = 0
            x = p["x"][ids[t]]
            gates = 1 / (1 + np.exp(-(x[:, : 2 * h] + state @ p["u"])))
            new = np.tanh(x[:, 2 * h :] + gates[:, h:] * (state @ p["n"]))
            state = new + gates[:, :h] * (state - new)
            for own, goal in zip(state, targets[t], strict=True):
                if goal >= 0:
                    c = goal // 3 if goal < 6 else goal - 4
                    for logits, at in [(own @ p["c"] + p["cb"], c), *([(own @ p["w"][c] + p["wb"][c], goal % 3)] if goal < 6 else [])]:
                        total -= logits[at] - np.log(np.exp(logits).sum())
        return total / (targets >= 0).sum()

    moves, trainer = {}, Trainer(p, shape)
    trainer._move = lambda name, gradient, rows=slice(None): moves.setdefault(name, np.zeros(p[name].shape)).__setitem__(rows, gradient)
    state = trainer.window(ids, targets, fresh, np.zeros((4, 7), np.float32))
    assert state.shape == (4, 7) and set(moves) == set(p)
    for name, gradient in moves.items():
        for at in np.ndindex(gradient.shape):
            up, down = ({k: v.astype(float) for k, v in p.items()} for _ in range(2))
            up[name][at] += 1e-4
            down[name][at] -= 1e-4
            assert gradient[at] == pytest.approx((loss(up) - loss(down)) / 2e-4, abs=2e-5)


def test_training_keeps_few_numbers_and_frees_its_shuffles(spark):
    from grovekit.llm.common import shuffles_freed
    from grovekit.llm.gated_network import Shape

    shape, listed = Shape(), [b"the", b"of"]
    other = shape.short + lm_scoring.ending_class(b"unknown", shape.tails)
    few = lm_scoring._Numbers(listed, shape, most=3)
    assert [few[w] for w in (b"unknown", b"known", b"the")] == [other, shape.short + lm_scoring.ending_class(b"known", shape.tails), 1] and len(few) == 3
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with shuffles_freed(spark):
        assert spark.conf.get(name) == "true"
    assert spark.conf.get(name, None) == before


def test_toxicity(spark, nothing):
    bad = ["vile", "nasty", "foul", "gross", "awful"]
    rows = [(i, prose(60) + (" " + " ".join(RNG.sample(bad, 3)) if i % 4 == 0 else "") + prose(20), int(i % 4 == 0)) for i in range(800)]
    table = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(5000, ""), (5001, None), (None, "vile")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (9, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity_scores(table, labels).collect()
    assert len(got) == 803 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.doc_id in truth and r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert toxicity.toxicity_scores(nothing, labels).collect() == []
    assert {r.predicted for r in toxicity.toxicity_scores(table, labels.limit(0)).collect()} == {0}


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{source}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, kept, source).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in kept.select("doc_id").collect()}
        if name != "piece_codec":
            assert after.columns == docs.columns
        kept = after
    assert 0 < kept.count() < docs.count()


def repeated_lines(rows, min_words=50):
    """doc_id -> lines of runs of ``min_words`` words that occur earlier; rows of (doc_id, text) with distinct ids, by brute force."""
    seen, out = set(), {}
    for d, text in sorted(rows):
        lines = [(i, x.strip()) for i, x in enumerate(text.split("\n")) if x.strip()]
        gone = set()
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(x.split()) for _, x in lines[a : b + 1]) >= min_words:
                    run = tuple(x for _, x in lines[a : b + 1])
                    if run in seen:
                        gone.update(range(lines[a][0], lines[b][0] + 1))
                    seen.add(run)
        out[d] = gone
    return out


def test_line_dedup_finds_runs_whose_parts_occur_earlier_elsewhere(spark):
    draw = random.Random(3)
    line = lambda n: " ".join(draw.choice(VOCABULARY) for _ in range(n))
    x, y = line(30), line(30)
    rows = [(1, x), (2, y), (3, x + "\n" + y), (4, x + "\n" + y)]
    pool = [line(draw.choice((3, 8, 15, 22, 30, 55))) for _ in range(12)]
    rows += [(10 + i, "\n".join(draw.choice(pool) if draw.random() < 0.9 else draw.choice(("", line(12))) for _ in range(draw.randint(1, 14)))) for i in range(150)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[3].n_removed_lines == 0 and got[4].text == "" and got[4].removed_lines == "0-1"
    want = repeated_lines(rows)
    for d, text in rows:
        lines = text.split("\n")
        gone = {i for r in filter(None, got[d].removed_lines.split(",")) for i in range(int(r.split("-")[0]), int(r.split("-")[1]) + 1)}
        assert {i for i in gone if lines[i].strip()} == {i for i in want[d] if lines[i].strip()} and want[d] <= gone
        assert got[d].text == "\n".join(x for i, x in enumerate(lines) if i not in gone)


def test_network_is_trained_on_every_training_document(spark, monkeypatch, tmp_path):
    rows = [(i, f"text{i} " + " ".join(VOCABULARY[i : i + 20])) for i in range(150)]
    learn, folder = lm_scoring._learn, str(tmp_path)

    def noting(*args):
        run = learn(*args)

        def noted(batches):
            import uuid

            def passed():
                for batch in batches:
                    with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                        f.write("\n".join(batch.column("text").to_pylist()))
                    yield batch

            yield from run(passed())

        return noted

    monkeypatch.setattr(lm_scoring, "_learn", noting)
    lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    read = Counter(t for f in tmp_path.iterdir() for t in f.read_text().split("\n") if t)
    assert read == Counter(t for d, t in rows if zlib.crc32(str(d).encode()) % 7 != 2)


def test_disclosing_terms_in_whole_documents(spark):
    draw = random.Random(8)
    text = lambda n: " ".join(draw.choice(VOCABULARY) for _ in range(n))
    rows = [(i, f"{text(60)} joe@x.org 𠮷 ann@y.org, {text(40)} (Zanzibarov) {text(60)}\nZanzibarov/Quillfeather's said {text(30)} x1-zanzibarov") for i in range(3)]
    rows += [(10 + i, text(150)) for i in range(60)] + [(100, "Zanzibarov alone"), (200, "onlyhere joe@x.org"), (201, "onlyhere joe@x.org")]
    spans = {r.doc_id: r.spans.split(",") for r in private_data.span_digests(private_data.private_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for i, t in rows[:3]:
        places = {m.group().lower(): [] for m in re.finditer("Zanzibarov|Quillfeather's", t)}
        for m in re.finditer("Zanzibarov|Quillfeather's", t):
            places[m.group().lower()].append(f"{m.start()}:{m.end()}")
        got = {x.split(":", 1)[1] for x in spans[i] if x.startswith(("remove", "generalise"))}
        assert len(places["zanzibarov"]) == 2 and {*places["zanzibarov"], *places["quillfeather's"]} <= got
    assert spans[100] == [""] and not any(x.startswith(("remove:0", "generalise:0")) for x in spans[200] + spans[201])


def test_stages_decide_by_row(spark, tmp_path):
    """Repeated and null ids are rows like others, equal rows stay once, an empty table stays empty, other columns are carried."""
    import corpus_pipeline

    source = "/root/testdata/sf0.001"
    a, b = prose(80), prose(90)
    rows = [(3, a, 1), (1, b, 2), (3, b, 3), (5, a, 4), (None, b, 5), (None, prose(70), 6), (8, None, 7), (8, "", 8), (9, a, 9), (9, a, 9)]
    table = spark.createDataFrame(rows, "doc_id long, text string, node long").withColumn("row", F.lit("x")).withColumn("n_lines", F.lit(0))
    kept = jaccard_join.distinct_documents(table)
    assert kept.columns == table.columns
    assert sorted(r.node for r in kept.collect()) == [1, 2, 6, 7, 8]
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, table.limit(0), source)
        assert none.collect() == [] and (name == "piece_codec" or none.columns == table.columns)
    items = spark.read.parquet(f"{source}/benchmark.parquet").limit(1).collect()[0]
    dirty = table.unionByName(spark.createDataFrame([(None, f"{a} {items.text} {b}", 100)], "doc_id long, text string, node long").withColumn("row", F.lit("x")).withColumn("n_lines", F.lit(0)))
    clean = decontaminate.clean_documents(dirty, spark.read.parquet(f"{source}/benchmark.parquet"))
    assert sorted(r.node for r in clean.collect()) == sorted(r[2] for r in rows)


def test_equal_halves_of_signatures_are_told_apart(spark, monkeypatch):
    """Sets that share the first half of a signature are still nodes of their own."""
    table = spark.createDataFrame([(1, BASE[0]), (2, BASE[1]), (3, BASE[2]), (4, BASE[0])], "doc_id long, text string")
    members, nodes, renamed = jaccard_join._members(table, 5)
    both = {r.doc_id: (r.node, r.check) for r in members.collect()}
    assert not renamed and both[1] == both[4] and nodes.count() == 3
    alike = jaccard_join.Renamed({(7, 1): 7, (7, 2): 99})
    assert alike[7, 1] == 7 and alike[7, 2] == 99 and alike[5, 3] == 5


def test_sketches_lose_no_contained_item():
    draw = random.Random(21)
    word = lambda: "w" + str(draw.randrange(10**6))
    found = total = 0
    for _ in range(300):
        item = [word() for _ in range(draw.choice((6, 20, 40, 90, 200)))]
        index = decontaminate.ItemIndex([(1, " ".join(item))], 5, 80)
        n = len(shingles(" ".join(item), 5))
        cut = max(0, int(0.2 * n) - 1)
        document = [word() for _ in range(50)] + item[cut:] + [word() for _ in range(400)]
        if 100 * len(shingles(" ".join(document), 5) & shingles(" ".join(item), 5)) >= 80 * n:
            hashed = decontaminate.WordHashes().of([w.encode() for w in document])
            total += 1
            found += bool(list(index.search([w.encode() for w in document], hashed)))
    assert total > 200 and found == total


def test_licence_bands_for_short_and_any_templates(spark):
    draw = random.Random(5)
    templates = [(f"t{i}", " ".join("v" + str(draw.randrange(10**6)) for _ in range(draw.choice((5, 7, 9, 10, 12, 30))))) for i in range(120)]
    for percent in (80, 60):
        rows = [(i, prose(draw.randint(0, 60)) + " " + t + " " + prose(40)) for i, (_, t) in enumerate(templates)]
        got = license_scan.license_matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(templates, "license_id string, text string"), percent=percent).collect()
        exact = {(r.doc_id, r.license_id): r for r in got}
        assert sum((i, name) in exact for i, (name, _) in enumerate(templates)) >= 119
        assert all(r.license_id == f"t{r.doc_id}" and r.n_shared <= r.n_template_shingles and r.containment == r.n_shared / r.n_template_shingles for r in got)


def test_label_model_finds_accuracies_and_discounts_copies():
    draw = np.random.default_rng(3)
    y = draw.random(6000) < 0.3
    rates = [(0.05, 0.7), (0.1, 0.6), (0.6, 0.1), (0.02, 0.4), (0.3, 0.3)]
    votes = np.stack([draw.random(6000) < np.where(y, b, a) for a, b in rates], axis=1).astype(np.float32)
    noisy = (draw.random(6000) < 0.2).astype(np.float32)
    votes = np.hstack([votes, np.stack([noisy] * 3, axis=1)])
    posterior, weight = toxicity.fit_label_model(votes, np.array([[0.1, 0.4], [0.1, 0.4], [0.4, 0.1], [0.1, 0.4], [0.2, 0.2], [0.2, 0.25], [0.2, 0.25], [0.2, 0.25]]), 0.3)
    assert (weight[-3:] < 0.4).all() and (weight[:5] > 0.6).all()
    assert ((posterior > 0.5) == y).mean() > 0.85


def test_codec_searches_a_word_once_for_many_texts(monkeypatch):
    """Words with marks and at line breaks are searched once each; small memories, slices and outside characters change nothing."""
    import sentencepiece

    library, draw = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), random.Random(9)
    words = ["titionsh", "ezciónlldota", "Ththst", "eintzöge", "日本𠮷x", "thinntth"]
    texts = ["".join(draw.choice(words) + draw.choice((" ", ". ", "\n", ".\n", "***\n\n")) for _ in range(40)) + "end" for _ in range(60)]
    odd = ["", None, "\n", "a\n b", " a", "a ", "a  b\nc", "▁a\nb", ".\n.", "... \n", "a\n", "𠮷", "日\n𠮷𠮷.", "e" * 300, "th" * 500 + "\n\n" + "the" * 300]
    odd += ["".join(draw.choice("theaoni.\n 𠮷é") for _ in range(draw.randint(1, 80))) for _ in range(300)]
    want = lambda t: (lambda i: (len(i), ",".join(map(str, i)), library.decode(i)))(library.encode(t or ""))
    got = lambda one, ts: [(n, i, d.decode("utf-8", "replace")) for n, i, d in one(ts)]
    codec, searched = piece_codec.Codec(pieces.vocabulary(pieces.model_path())), []
    search = codec.pieces
    codec.pieces = lambda word: searched.append(word) or search(word)
    one = piece_codec.Remembered(codec, 1000)
    assert got(one, texts[:30]) + got(one, texts[30:]) == list(map(want, texts))
    assert len(searched) == len(set(searched)) <= 2 * len(words) + 6
    assert got(one, odd) == list(map(want, odd))
    for name, small in (("PAIRS", 5), ("TEXT_BYTES", 30)):
        monkeypatch.setattr(piece_codec, name, small)
    assert got(piece_codec.Remembered(codec, 4), texts + odd) == list(map(want, texts + odd))


def test_words_of_many_texts_are_told_apart_at_once(spark, monkeypatch):
    """Splitting, classes and counts over whole arrays equal those a word at a time, whatever number of words is sent and however small the slices."""
    from grovekit.llm.common import split_words, words_of

    draw = random.Random(3)
    for _ in range(200):
        texts = [None if draw.random() < 0.1 else "".join(draw.choice("aBcÉ日𠮷 \t\n\x0b\x0c\r\x1c\x85\xa0Z") for _ in range(draw.randint(0, 12))) for _ in range(draw.randint(0, 9))]
        array, start = lm_scoring.pa.array(texts, lm_scoring.pa.string()), draw.randint(0, len(texts))
        edges, words = split_words(array.slice(start))
        flat = words.to_pylist()
        assert [flat[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)] == [words_of(t) for t in texts[start:]]
        assert lm_scoring.ending_classes(words, 64).tolist() == [lm_scoring.ending_class(w, 64) for w in flat]
        assert [len(x) for x in lm_scoring.slices(array, 5)] == [len(x) for x in lm_scoring.slices(array, 5) if len(x)] and sum(map(len, lm_scoring.slices(array, 5))) == len(texts)
    rows = [(i, " ".join(draw.choice(VOCABULARY[: 5 + i]) for _ in range(draw.randint(0, 30)))) for i in range(150)]
    table, sizes, frequent = spark.createDataFrame(rows, "doc_id long, text string"), [], lm_scoring._frequent

    def noting(*args):
        sizes.append(frequent(*args))
        return sizes[-1]

    monkeypatch.setattr(lm_scoring, "_frequent", noting)
    shape, results = lm_scoring.Shape(hidden=4, listed=2, members=3, tails=4), []
    for most in (0, 30, 1 << 17):
        monkeypatch.setattr(lm_scoring, "FREQUENT", most)
        results.append(sorted((r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 8), round(r.score, 6)) for r in lm_scoring.lm_scores(table, shape).collect()))
    assert results[0] == results[1] == results[2]
    assert [len(s) <= most + 5 for s, most in zip(sizes, (0, 30, 1 << 17), strict=True)] == [True] * 3 and len(sizes[0]) == 5 < len(sizes[1]) < len(sizes[2])
