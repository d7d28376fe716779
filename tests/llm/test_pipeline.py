"""The whole pipeline, as ``run`` applies it, against brute force on planted documents; what is toxic is taken from its operator, which has tests of its own."""

import hashlib
import itertools
import random

import pytest
import sentencepiece

from grovekit.llm import pieces, toxicity

RNG = random.Random(21)
WORDS = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(2, 7))) for _ in range(600)]
BAD = ["vile", "nasty", "foul", "gross", "awful"]


def prose(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def edited(text, n):
    words = text.split(" ")
    for _ in range(n):
        words[RNG.randrange(len(words))] = f"edit{RNG.randrange(10**6)}"
    return " ".join(words)


def shingles(text, k=5):
    words = text.lower().split()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def without_repeated_runs(rows, least=50):
    """Each text without the runs of lines of ``least`` words that an earlier one (or place) has."""
    seen, out = set(), []
    for key, text in rows:
        lines = (text or "").split("\n")
        full = [(i, x.strip()) for i, x in enumerate(lines) if x.strip()]
        gone = set()
        for a in range(len(full)):
            for b in range(a, len(full)):
                run = tuple(x for _, x in full[a : b + 1])
                if sum(len(x.split()) for x in run) >= least:
                    if run in seen:
                        gone.update(range(full[a][0], full[b][0] + 1))
                    seen.add(run)
        out.append((key, text if text is None or not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def expected(docs, toxic, benchmark):
    """``docs`` in order of their ids, and the texts that are toxic."""
    kept = without_repeated_runs([(d, t) for d, t in docs if t not in toxic])
    sets = [shingles(t or "") for _, t in kept]
    group = list(range(len(kept)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i, j in itertools.combinations(range(len(kept)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            group[max(find(i), find(j))] = min(find(i), find(j))
    alone = [kept[i] for i in range(len(kept)) if find(i) == i]  # rows are in order of their ids
    items = [shingles(t) for t in benchmark]
    clean = [(d, t) for d, t in alone if not any(100 * len(shingles(t or "") & i) >= 80 * len(i) for i in items)]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
    out = []
    for d, t in clean:
        ids = library.encode(t or "")
        out.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def planted():
    docs = {i: prose(RNG.randint(30, 120)) for i in range(300)}
    toxic = {i for i in docs if i % 6 == 0}
    for i in toxic:
        docs[i] += " " + " ".join(RNG.sample(BAD, 4)) + " " + prose(20)
    passage, item = prose(60), prose(40)
    docs |= {1001: docs[1], 1002: edited(docs[2] + " " + prose(200), 0), 1003: prose(10) + "\n" + passage + "\n" + prose(12), 1004: prose(9) + "\n" + passage + "\n" + prose(11), 1005: prose(30) + " " + item + " " + prose(30)}
    long = prose(300)
    docs |= {1010 + i: edited(long, i) for i in range(4)} | {1020: "", 1021: None, 1022: "one two", 1023: "one two", 1024: " \n\t "}
    return docs, toxic, [item, prose(25), prose(3)]


def written(spark, folder, docs, toxic, benchmark):
    rows = [(d, t, "zz", "here", len(t or "")) for d, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(d, 1, int(d in toxic)) for d in docs if d < 1000], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(benchmark)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def predicted(spark, folder):
    table = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    found = toxicity.toxicity_scores(table("documents"), table("labels")).where("predicted = 1").select("doc_id")
    return {r.text for r in table("documents").join(found, "doc_id", "left_semi").collect()}


def test_run_equals_brute_force(spark, planted, tmp_path):
    import corpus_pipeline

    docs, toxic, benchmark = planted
    written(spark, tmp_path, docs, toxic, benchmark)
    bad = predicted(spark, tmp_path)
    assert {docs[d] for d in toxic} <= bad and len(bad) <= 1.25 * len(toxic)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == expected(sorted(docs.items()), bad, benchmark)
    ids = {r.doc_id for r in got}
    assert not ids & toxic
    assert not ids & {1005, 1023} and {r.n_tokens for r in got if r.doc_id == 1001} <= {0}  # a copied line is cut out
    assert {1020, 1021, 1024} <= ids, {1020, 1021, 1024} - ids
    assert len(ids & {1010, 1011, 1012, 1013}) <= 1


def test_run_on_repeated_and_missing_ids_and_on_nothing(spark, planted, tmp_path):
    import corpus_pipeline

    docs, toxic, benchmark = planted
    written(spark, tmp_path / "a", docs, toxic, benchmark)
    more = [(None, prose(55)), (None, prose(60)), (7, prose(60)), (None, None), (7, docs[7])]
    rows = spark.createDataFrame([(d, t, "zz", "here", 0) for d, t in more], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.mode("append").parquet(str(tmp_path / "a" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    plain = expected(sorted(docs.items()), predicted(spark, tmp_path / "a"), benchmark)
    digests = lambda found: {tuple(r)[1:] for r in found if r[0] is not None and r[0] != 7}
    assert digests(got) == digests(plain)
    assert sum(r.doc_id is None for r in got) <= 3 and (None, 0) in {(r.doc_id, r.n_tokens) for r in got} and sum(r.doc_id == 7 for r in got) <= 2
    written(spark, tmp_path / "b", {}, set(), [])
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).collect() == []
