"""Deletes runs of lines that repeat an earlier run, found by winnowing (DataFrame operations only).

Blank lines are left aside. A line's gram is the shortest run of lines from it that has ``gram_words`` words; a line's
window is the grams that start within ``window_words`` words from it. From each window whose grams are all complete
the smallest gram hash is selected as a fingerprint, the last of equals. Window and grams depend on
nothing but the lines in them, and they lie within the next gram_words + window_words words (up to the end of the line
reached), so two texts that share a run of at least that many words share a selected fingerprint.

A passage is a shortest run of lines with ``min_words`` words from its first line on, or back from its last. Every line of a
run of ``min_words`` words lies in a passage within the run, and every passage holds a selected fingerprint of its own, so only
passages around fingerprints that occur more than once are listed. Each passage is then joined with its own first
occurrence (by doc_id, text hash and place; one row per passage, so a run with very many copies is no pair of all its
copies), and all occurrences but the first are deleted. So no run depends on which texts share parts of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import checkpointed, salted, text_key, whole_row

_LINES = "split(text, '\n', -1)"
#: Parts into which the rows of a hot fingerprint are dealt.
SALTS = 8
_TRIMMED = "trim(BOTH ' \t\r\f\x0b' FROM l)"


def _fingerprints(gram_words: int, window_words: int) -> tuple[str, str]:
    """SQL for the gram hashes of a row (arrays h and w: line hashes and words), and for the places selected."""
    gram = f"""aggregate(sequence(p + 1, least(p + {gram_words}, size(h))), named_struct('w', 0, 'g', 0L),
        (a, j) -> if(a.w >= {gram_words}, a, named_struct('w', a.w + element_at(w, j), 'g', xxhash64(a.g, element_at(h, j)))),
        a -> if(a.w >= {gram_words}, a.g, NULL))"""
    grams = f"transform(sequence(0, size(h) - 1), p -> {gram})"
    window = f"""aggregate(sequence(p + 1, least(p + {window_words}, size(g))), named_struct('w', 0, 'g', CAST(NULL AS BIGINT), 'at', -1, 'whole', true),
        (a, j) -> if(a.w >= {window_words}, a, named_struct('w', a.w + element_at(w, j),
            'g', if(a.g IS NULL OR element_at(g, j) <= a.g, element_at(g, j), a.g),
            'at', if(a.g IS NULL OR element_at(g, j) <= a.g, j - 1, a.at),
            'whole', a.whole AND element_at(g, j) IS NOT NULL)),
        a -> if(a.whole, a.at, NULL))"""
    return grams, f"array_distinct(filter(transform(sequence(0, size(g) - 1), p -> {window}), x -> x IS NOT NULL))"


def _passages(min_words: int) -> str:
    """SQL for the passages of a row that hold one of the places ``at`` (line numbers; array w as above): s * 2^32 + e, lines s to e.

    From a place, lines are added backwards while the ones before it have too few words; each is the first line of a passage that holds the place.
    The last lines of passages are found likewise. So the work goes with the number of places, not with the row's length.
    """
    room = f"""{{w}} < {min_words}"""
    first = f"""aggregate(sequence(p, greatest(p - {min_words}, 0), -1), named_struct('w', 0, 'o', CAST(array() AS array<int>)),
        (a, j) -> if({room.format(w='a.w')}, named_struct('w', a.w + if(j = 0, 0, element_at(w, j)), 'o', concat(a.o, array(j))), a), a -> a.o)"""
    last = f"""aggregate(sequence(p, least(p + {min_words}, size(w) - 1)), named_struct('w', 0, 'o', CAST(array() AS array<int>)),
        (a, j) -> if({room.format(w='a.w')}, named_struct('w', a.w + if(j + 1 = size(w), 0, element_at(w, j + 2)), 'o', concat(a.o, array(j))), a), a -> a.o)"""
    end = f"""aggregate(sequence(s + 1, least(s + {min_words}, size(w))), named_struct('w', 0, 'e', s),
        (a, j) -> if({room.format(w='a.w')}, named_struct('w', a.w + element_at(w, j), 'e', j - 1), a), a -> if({room.format(w='a.w')}, NULL, s * 4294967296L + a.e))"""
    start = f"""aggregate(sequence(e + 1, greatest(e + 2 - {min_words}, 1), -1), named_struct('w', 0, 's', e),
        (a, j) -> if({room.format(w='a.w')}, named_struct('w', a.w + element_at(w, j), 's', j - 1), a), a -> if({room.format(w='a.w')}, NULL, a.s * 4294967296L + e))"""
    return f"filter(array_distinct(flatten(transform(at, p -> concat(transform({first}, s -> {end}), transform({last}, e -> {start}))))), x -> x IS NOT NULL)"


def repeated_runs(docs: DataFrame, min_words: int = 50, gram_words: int = 20, window_words: int = 20) -> DataFrame:
    """doc_id, key (of the text), runs: the line ranges (from, to; 0-based, to inclusive) that repeat earlier ones, in order.

    Rows equal in doc_id and text are one text; only texts with such runs are returned.
    """
    if gram_words + window_words > min_words:
        raise ValueError("runs shorter than gram_words + window_words are not guaranteed to be found")
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL").select(
        "doc_id",
        text_key().alias("key"),
        F.expr(
            f"filter(transform({_LINES}, (l, i) -> named_struct('i', i, 'h', xxhash64({_TRIMMED}), 'w', if({_TRIMMED} = '', 0, size(split({_TRIMMED}, '[\\\\x20\\\\x09-\\\\x0D]+'))))), x -> x.w > 0)"
        ).alias("lines"),
    )
    held = checkpointed(lines.select("doc_id", "key", F.col("lines.i").alias("i"), F.col("lines.h").alias("h"), F.col("lines.w").alias("w")).dropDuplicates(["doc_id", "key"]))
    grams, selected = _fingerprints(gram_words, window_words)
    found = held.where("size(h) > 0").withColumn("g", F.expr(grams)).withColumn("at", F.expr(selected))
    prints = checkpointed(found.select("doc_id", "key", F.explode(F.expr("transform(at, p -> named_struct('p', p, 'g', element_at(g, p + 1)))")).alias("x")).select("doc_id", "key", "x.p", "x.g"))
    # A fingerprint or passage may be that of a third of all texts: its rows are dealt out by salt.
    repeated = prints.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    places = salted(prints, SALTS, F.col("key")).join(salted(repeated, SALTS), ["g", "salt"]).groupBy("doc_id", "key").agg(F.collect_set("p").alias("at")).withColumnsRenamed({"doc_id": "oid", "key": "okey"})
    around = held.join(places, F.expr("key = okey AND doc_id <=> oid"))
    content = "slice(h, CAST(x DIV 4294967296 AS INT) + 1, CAST(x % 4294967296 - x DIV 4294967296 AS INT) + 1)"
    line = "CAST({} AS INT)"
    passage = f"named_struct('s', {line.format('x DIV 4294967296')}, 'e', {line.format('x % 4294967296')}, 'from', element_at(i, {line.format('x DIV 4294967296')} + 1), 'to', element_at(i, {line.format('x % 4294967296')} + 1), 'g', xxhash64({content}), 'g2', hash({content}))"
    # Only passages leave the row, not its arrays: a text of very many lines is never copied for each.
    passages = checkpointed(around.select("doc_id", "key", F.explode(F.expr(f"transform({_passages(min_words)}, x -> {passage})")).alias("x")).select("doc_id", "key", "x.*"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "s")
    first = passages.groupBy("g", "g2").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1").select("g", "g2", "first")
    later = salted(passages, SALTS, F.col("key")).join(salted(first, SALTS), ["g", "g2", "salt"]).where("NOT (doc_id <=> first.doc_id AND key = first.key AND s = first.s)")
    # Passages that overlap or touch are one run.
    merged = """aggregate(x, CAST(array() AS array<struct<s:int,e:int,from:int,to:int>>), (a, y) -> if(size(a) = 0 OR y.s > element_at(a, -1).e + 1, concat(a, array(y)),
        concat(slice(a, 1, size(a) - 1), array(if(y.e > element_at(a, -1).e, named_struct('s', element_at(a, -1).s, 'e', y.e, 'from', element_at(a, -1).from, 'to', y.to), element_at(a, -1))))),
        a -> transform(a, y -> named_struct('from', y.from, 'to', y.to)))"""
    return later.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct("s", "e", "from", "to"))).alias("x")).select("doc_id", "key", F.expr(merged).alias("runs"))


def _cut(docs: DataFrame, min_words: int, gram_words: int, window_words: int) -> DataFrame:
    """row (all columns of ``docs``), left (the lines that stay, null if all do), n_lines, runs."""
    runs = repeated_runs(docs, min_words, gram_words, window_words).select(F.col("doc_id").alias("run_doc"), F.col("key").alias("run_key"), "runs")
    keyed = docs.select(whole_row(docs).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"))
    joined = keyed.join(runs.hint("shuffle_hash"), (F.col("text_key") == F.col("run_key")) & F.col("id").eqNullSafe(F.col("run_doc")), "left")
    # The stretches between the runs, from the lines as split once (the outer transform only names them).
    stretch = "flatten(zip_with(concat(array(0), transform(runs, r -> r.to + 1)), concat(transform(runs, r -> r.from), array(size(lines))), (a, b) -> slice(lines, a + 1, b - a)))"
    text = "split(CAST(row.text AS STRING), '\n', -1)"
    return joined.select("row", F.expr(f"if(runs IS NULL, NULL, element_at(transform(array({text}), lines -> {stretch}), 1))").alias("left"), F.expr(f"if(row.text IS NULL, 0, size({text}))").alias("n_lines"), "runs")


def dedup_lines(docs: DataFrame, min_words: int = 50, gram_words: int = 20, window_words: int = 20) -> DataFrame:
    """``docs`` with repeated runs of lines cut out of ``text``, and three columns more.

    n_lines, n_removed_lines, removed_lines ("from-to" of each deleted run, 0-based, comma-joined). Blank lines
    inside a deleted run go with it. The first occurrence by doc_id (null ids last), then by text hash and place,
    is kept. Rows equal in doc_id and text are one text: they get the same result, and don't delete each
    other. A null text stays null, with 0 lines; an empty text has one line, never deleted. Texts are taken whole, however many lines they
    have; a text may repeat itself. Other columns are passed on; columns with the names of the three are replaced.
    """
    done = _cut(docs, min_words, gram_words, window_words)
    new = {"n_lines", "n_removed_lines", "removed_lines"}
    text = F.when(F.col("left").isNull(), F.col("row.text")).otherwise(F.array_join("left", "\n"))
    return done.select(
        *[text.alias("text") if n == "text" else F.col("row").getField(n).alias(n) for n in docs.columns if n not in new],
        F.col("n_lines").cast("long").alias("n_lines"),
        F.when(F.col("left").isNull(), 0).otherwise(F.col("n_lines") - F.size("left")).cast("long").alias("n_removed_lines"),
        F.coalesce(F.expr("array_join(transform(runs, r -> concat(r.from, '-', r.to)), ',')"), F.lit("")).alias("removed_lines"),
    )


def without_repeated_lines(docs: DataFrame, length: str = "n_chars", min_words: int = 50, gram_words: int = 20, window_words: int = 20) -> DataFrame:
    """``docs`` with repeated runs of lines cut out of ``text``, and no column more; a column ``length``, if there is one, follows the text where it was cut."""
    done = _cut(docs, min_words, gram_words, window_words)
    text = F.when(F.col("left").isNull(), F.col("row.text")).otherwise(F.array_join("left", "\n"))
    cut = {"text": text}
    if length in docs.columns:
        cut[length] = F.when(F.col("left").isNull(), F.col("row").getField(length)).otherwise(F.length(F.array_join("left", "\n")).cast(docs.schema[length].dataType))
    return done.select(*[cut.get(n, F.col("row").getField(n)).alias(n) for n in docs.columns])
