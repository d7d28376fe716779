"""Personal data and the terms that reveal it (DataFrame operations only).

Four kinds are found by pattern, as ``KINDS`` lists them. The patterns are written so that they match where the plain ones
do in time linear in the text: a run of characters is entered at its start (or where the last match ended) and never given back.
``split`` gives the gaps between the matches of a pattern and ``regexp_extract_all`` the matches; the lengths of both, summed up,
are the positions.

On top comes information-theoretic sanitisation (in the line of Sanchez and Batet, 2013). Each distinct value is a protected
entity e with information content IC(e) = -log2 p(e). For a term t, pointwise mutual information from corpus
counts says how much t reveals of e: PMI(e; t) = log2(p(e, t) / (p(e) p(t))). The disclosure of e by t is PMI(e; t) / IC(e), at
most 1 (t occurs with e only). It is taken twice, and the higher one holds:

- over whole documents: shares are of all documents, and t goes with e if a document holds both, wherever. Pairs
  seen in one text only, copied or not, say nothing and are left, as are entities that every document holds (IC is 0);
- over words: shares are of all words, and t goes with e if it is among the ``reach`` words on either side of an occurrence. Pairs
  seen in one context only are left.

Terms that reach ``generalise_at`` are marked to be generalised, those that reach ``remove_at`` to be removed, at every occurrence in
every document that holds e. Words with a digit or @ have no terms.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovekit.llm.common import checkpointed

KINDS = ("email", "ip", "card", "phone")
MARKS = (*KINDS, "generalise", "remove")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match: a cheap test first.
HINTS = {"email": "contains(text, '@')", "ip": "text RLIKE '[0-9][.][0-9]'", "card": "text RLIKE '[0-9][\\\\x20-]?[0-9]'", "phone": "contains(text, '+')"}
VALID = {
    "email": "true",
    "ip": r"forall(split(x.m, '[.]'), p -> length(regexp_replace(p, '^0+', '')) <= 3 AND CAST(right(p, 3) AS INT) <= 255)",
    "card": "length(translate(x.m, ' -', '')) BETWEEN 13 AND 19 AND aggregate(sequence(1, length(translate(x.m, ' -', ''))), 0, (s, i) -> s + element_at(if(i % 2 = 1, array(0, 1, 2, 3, 4, 5, 6, 7, 8, 9), array(0, 2, 4, 6, 8, 1, 3, 5, 7, 9)), CAST(substring(translate(x.m, ' -', ''), length(translate(x.m, ' -', '')) - i + 1, 1) AS INT) + 1)) % 10 = 0",
    "phone": "length(regexp_replace(x.m, '[^0-9]', '')) BETWEEN 9 AND 15",
}
CHUNK = 64
#: Characters beside a span that are looked at for its words at first; where they hold too few words, the next number of them, and then all up to the next match.
CONTEXTS = (64, 4096)
TERM = r"\p{L}[\p{L}\x27-]*\p{L}"
#: A word with a digit or @.
BARRED = r"(?<![^\x20\x09-\x0D])(?=[^\x20\x09-\x0D0-9@]*+[0-9@])[^\x20\x09-\x0D]++"


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\") + "'"


def _running_ends(df: DataFrame, kinds) -> DataFrame:
    """From the arrays x_kind of struct(g, m, ...) the arrays e_kind: where each match ends. Sums in chunks, so long arrays stay cheap."""
    carried = [c for c in df.columns]
    step = df.select(*carried, *[F.expr(f"transform(x_{k}, x -> x.g + length(x.m))").alias(f"a_{k}") for k in kinds])
    totals = "transform(sequence(0, CAST((size(a_{k}) - 1) / {c} AS INT)), i -> aggregate(slice(a_{k}, i * {c} + 1, {c}), 0, (s, x) -> s + x))"
    offsets = "if(size(a_{k}) = 0, array(0), aggregate(" + totals + ", named_struct('t', 0, 'o', array(0)), (s, x) -> named_struct('t', s.t + x, 'o', concat(s.o, array(s.t + x))), s -> s.o))"
    step = step.select(*carried, *[f"a_{k}" for k in kinds], *[F.expr(offsets.format(k=k, c=CHUNK)).alias(f"o_{k}") for k in kinds])
    ends = "if(size(a_{k}) = 0, CAST(array() AS array<int>), flatten(transform(sequence(0, least(CAST((size(a_{k}) - 1) / {c} AS INT), size(o_{k}))), i -> aggregate(slice(a_{k}, i * {c} + 1, {c}), named_struct('t', element_at(o_{k}, i + 1), 'o', CAST(array() AS array<int>)), (s, x) -> named_struct('t', s.t + x, 'o', concat(s.o, array(s.t + x))), s -> s.o))))"
    return step.select(*carried, *[F.expr(ends.format(k=k, c=CHUNK)).alias(f"e_{k}") for k in kinds])


def base_spans(docs: DataFrame, reach: int = 4) -> DataFrame:
    """doc_id, key (of the text), spans: array of struct(kind, s, e, value, terms), in order of kind, then start; words.

    kind is the number in KINDS; s and e are code points, e exclusive; terms has the words near the span: struct(t, s, e).
    words has all terms of a text with spans in the same form, and is empty for other texts.
    """
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    some = text.select("doc_id", "text", *[F.expr(f"if({HINTS[k]}, regexp_extract_all(text, {_quoted(PATTERNS[k])}, 0), array())").alias(f"m_{k}") for k in KINDS])
    masked = f"array_join(zip_with(split(text, {_quoted(BARRED)}, -1), regexp_extract_all(text, {_quoted(BARRED)}, 0), (g, m) -> concat(g, repeat(' ', coalesce(length(m), 0)))), '')"
    cut = some.select("doc_id", F.xxhash64("text").alias("key"), *[f"m_{k}" for k in KINDS], *[F.expr(f"if(size(m_{k}) = 0, array(), split(text, {_quoted(PATTERNS[k])}, -1))").alias(f"g_{k}") for k in KINDS], F.expr(f"if({' + '.join(f'size(m_{k})' for k in KINDS)} = 0, '', {masked})").alias("masked"))
    piece = "transform(m_{k}, (m, i) -> named_struct('g', length(element_at(g_{k}, i + 1)), 'm', m, 'l', {left}, 'r', {right}, 'n', length(element_at(g_{k}, i + 2))))"

    def beside(side: str, k: str, place: int) -> str:
        """The part of a gap beside a span that holds ``reach`` whole words: a cut may go through one more."""
        gap, out = f"element_at(g_{k}, i + {place})", f"element_at(g_{k}, i + {place})"
        for c in reversed(CONTEXTS):
            out = f"if(length({gap}) <= {c} OR size(regexp_extract_all({side}({gap}, {c}), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)) > {reach}, {side}({gap}, {c}), {out})"
        return out

    pieces = cut.select("doc_id", "key", *[F.expr(piece.format(k=k, left=beside("right", k, 1), right=beside("left", k, 2))).alias(f"x_{k}") for k in KINDS], F.expr(f"filter(zip_with(split(masked, {_quoted(TERM)}, -1), regexp_extract_all(masked, {_quoted(TERM)}, 0), (g, m) -> named_struct('g', length(g), 'm', m)), x -> x.m IS NOT NULL)").alias("x_word"))
    ended = _running_ends(pieces, (*KINDS, "word"))
    spans = "filter(transform(x_{k}, (x, i) -> named_struct('kind', {n}, 'e', element_at(e_{k}, i + 1), 'm', x.m, 'l', x.l, 'lcut', x.g > length(x.l), 'r', x.r, 'rcut', x.n > length(x.r))), x -> {valid})"
    joined = ended.select("doc_id", "key", F.expr("concat(" + ", ".join(spans.format(k=k, n=n, valid=VALID[k]) for n, k in enumerate(KINDS)) + ")").alias("y"), F.expr("transform(x_word, (x, i) -> named_struct('t', lower(x.m), 's', element_at(e_word, i + 1) - length(x.m), 'e', element_at(e_word, i + 1)))").alias("words"))
    space, word = "[\\\\x20\\\\x09-\\\\x0D]", "[^\\\\x20\\\\x09-\\\\x0D]"
    near = joined.select(
        "doc_id",
        "key",
        F.expr(
            f"""transform(y, x -> named_struct('kind', x.kind, 's', x.e - length(x.m), 'e', x.e, 'value', if(x.kind = 0, lower(x.m), regexp_replace(x.m, '[^0-9.]', '')),
            'before', slice(reverse(if(x.lcut, slice(regexp_extract_all(x.l, '{word}+{space}*', 0), 2, 99), regexp_extract_all(x.l, '{word}+{space}*', 0))), 1, {reach}),
            'after', slice(if(x.rcut, slice(regexp_extract_all(x.r, '{space}*{word}+', 0), 1, greatest(0, size(regexp_extract_all(x.r, '{space}*{word}+', 0)) - 1)), regexp_extract_all(x.r, '{space}*{word}+', 0)), 1, {reach})))"""
        ).alias("y"),
        F.expr("if(size(y) = 0, slice(words, 1, 0), words)").alias("words"),
    )
    total = "aggregate(slice(x.{side}, 1, i + 1), 0, (s, p) -> s + length(p))"
    core = "regexp_extract(p, '\\\\p{L}[\\\\p{L}\\'-]*\\\\p{L}', 0)"
    before = f"transform(x.before, (p, i) -> named_struct('t', if(p RLIKE '[0-9@]', '', {core}), 'p', p, 'at', x.s - {total.format(side='before')}))"
    after = f"transform(x.after, (p, i) -> named_struct('t', if(p RLIKE '[0-9@]', '', {core}), 'p', p, 'at', x.e + {total.format(side='after')} - length(p)))"
    term = f"transform(filter(concat({before}, {after}), z -> z.t <> ''), z -> named_struct('t', lower(z.t), 's', z.at + instr(z.p, z.t) - 1, 'e', z.at + instr(z.p, z.t) - 1 + length(z.t)))"
    return near.select("doc_id", "key", F.expr(f"transform(y, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e, 'value', x.value, 'terms', {term}))").alias("spans"), "words")


def disclosing_terms(docs: DataFrame, base: DataFrame, generalise_at: float = 0.9, remove_at: float = 0.95) -> DataFrame:
    """doc_id, key, s, e, mark (4: generalise, 5: remove) of each occurrence of a term that reveals an entity of its document.

    ``base`` is the result of base_spans on ``docs``. Counts are taken over all documents.
    """
    spans = base.select("doc_id", "key", F.explode("spans").alias("x")).select("doc_id", "key", F.concat_ws(":", F.col("x.kind"), F.col("x.value")).alias("entity"), F.expr("x.terms").alias("terms"), F.xxhash64("x.terms.t").alias("context"))
    near = spans.select("entity", "context", F.explode("terms").alias("z")).select("entity", "context", "z.t")
    pairs = near.groupBy("entity", "t").agg(F.count("*").alias("n_et"), F.min("context").alias("lo"), F.max("context").alias("hi")).where("lo <> hi").select("entity", "t", "n_et")
    entities = spans.groupBy("entity").agg(F.count("*").alias("n_e"))
    words = docs.select(F.explode(F.expr("regexp_extract_all(lower(CAST(text AS STRING)), '\\\\p{L}[\\\\p{L}\\'-]*\\\\p{L}', 0)")).alias("t")).groupBy("t").agg(F.count("*").alias("n_t"))
    sizes = docs.agg(F.sum(F.size(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"))).cast("double").alias("n"), F.count("*").cast("double").alias("rows")).first()
    told = pairs.join(words, "t").join(entities, "entity").withColumn("total", F.lit(sizes["n"] or 1.0)).select("entity", "t", "n_et", "n_t", "n_e", "total")
    told = told.unionByName(_in_documents(docs, base, sizes["rows"], generalise_at))
    share = 1 - F.log2(F.greatest(F.col("n_t") / F.col("n_et"), F.lit(1.0))) / F.greatest(F.log2(F.col("total") / F.col("n_e")), F.lit(1e-9))
    marked = told.select("entity", "t", share.alias("disclosure")).where(F.col("disclosure") >= generalise_at).groupBy("entity", "t").agg(F.max("disclosure").alias("disclosure"))
    holders = spans.select(F.col("doc_id").alias("hid"), F.col("key").alias("hkey"), F.col("entity").alias("held")).distinct()
    places = base.select("doc_id", "key", F.explode("words").alias("z")).select("doc_id", "key", "z.t", "z.s", "z.e").join(marked, "t")
    return places.join(holders, F.expr("key = hkey AND doc_id <=> hid AND entity = held")).groupBy("doc_id", "key", "s", "e").agg(F.max(F.when(F.col("disclosure") >= remove_at, 5).otherwise(4)).alias("mark"))


def _in_documents(docs: DataFrame, base: DataFrame, rows: float, generalise_at: float) -> DataFrame:
    """entity, t, n_et, n_t, n_e, total in documents, of the pairs that can reach ``generalise_at``.

    As n_et is at most n_e, a term in more than n_e ** generalise_at * rows ** (1 - generalise_at) documents can't reach it for e;
    such terms, and entities and terms of one text only, are left out before a document's entities meet its terms.
    """
    copies = F.min("key").alias("lo"), F.max("key").alias("hi")
    holding = base.select("doc_id", "key", F.explode(F.expr("array_distinct(transform(spans, x -> concat_ws(':', x.kind, x.value)))")).alias("entity"))
    entities = holding.groupBy("entity").agg(F.count("*").alias("n_e"), *copies).where((F.expr("lo <> hi")) & (F.col("n_e") < rows)).select("entity", "n_e", (F.col("n_e") ** generalise_at * rows ** (1 - generalise_at) * (1 + 1e-9)).alias("most"))
    terms = docs.select(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"), F.explode(F.expr(f"array_distinct(transform(regexp_extract_all(regexp_replace(CAST(text AS STRING), {_quoted(BARRED)}, ' '), {_quoted(TERM)}, 0), t -> lower(t)))")).alias("t"))
    counts = terms.groupBy("t").agg(F.count("*").alias("n_t"), *copies).where("lo <> hi").select("t", "n_t")
    here = base.select("doc_id", "key", F.explode(F.expr("array_distinct(words.t)")).alias("t")).join(counts, "t")
    there = holding.distinct().join(entities, "entity").select(F.col("doc_id").alias("hid"), F.col("key").alias("hkey"), "entity", "n_e", "most")
    both = here.join(there, F.expr("key = hkey AND doc_id <=> hid AND n_t <= most"))
    pairs = both.groupBy("entity", "t").agg(F.count("*").alias("n_et"), F.first("n_t").alias("n_t"), F.first("n_e").alias("n_e"), *copies).where("lo <> hi")
    return pairs.select("entity", "t", "n_et", "n_t", "n_e", F.lit(rows).alias("total"))


def private_data(docs: DataFrame, reach: int = 4, generalise_at: float = 0.9, remove_at: float = 0.95) -> DataFrame:
    """One row per row of ``docs(doc_id, text, ...)``: doc_id, key (of the text), spans.

    spans is an array of struct(kind, s, e), kind the number in MARKS, in order of kind, then start; positions in code
    points, e exclusive. Terms (kinds 4 and 5) never touch base spans; a term that several entities mark has one span. A null
    or empty text has no spans. Rows equal in doc_id and text have equal results. Ids may be null; other columns are not read.
    """
    base = checkpointed(base_spans(docs, reach))
    found = disclosing_terms(docs, base, generalise_at, remove_at)
    extra = found.groupBy("doc_id", "key").agg(F.array_sort(F.collect_set(F.struct(F.col("mark").alias("kind"), "s", "e"))).alias("more"))
    extra = extra.withColumnRenamed("doc_id", "did").withColumnRenamed("key", "dkey")
    both = base.join(extra, F.expr("key = dkey AND doc_id <=> did"), "left")
    return both.select("doc_id", "key", F.expr("concat(transform(spans, x -> named_struct('kind', x.kind, 's', x.s, 'e', x.e)), coalesce(more, array()))").alias("spans"))


def span_digests(found: DataFrame) -> DataFrame:
    """From the result of private_data: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans ("kind:start:end", comma-joined)."""
    name = "element_at(array(" + ", ".join(f"'{m}'" for m in MARKS) + "), x.kind + 1)"
    text = "array_join(transform({}, x -> concat(" + name + ", ':', x.s, ':', x.e)), ',')"
    counts = [F.expr(f"size(filter(spans, x -> x.kind = {n}))").cast("long").alias(f"n_{k}") for n, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(text.format(f"filter(spans, x -> x.kind < {len(KINDS)})")), 256).alias("base_sha256"), F.expr(text.format("spans")).alias("spans"))


def sanitised(docs: DataFrame, reach: int = 4, generalise_at: float = 0.9, remove_at: float = 0.95) -> DataFrame:
    """``docs`` with ``text`` sanitised: spans become [EMAIL], [IP], [CARD], [PHONE] or [TERM]; removed terms leave nothing.

    A span that begins inside an earlier one is part of it. Null texts stay null; other columns are passed on.
    """
    found = private_data(docs, reach, generalise_at, remove_at).where("size(spans) > 0").dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias("_did"), F.col("key").alias("_dkey"), F.expr("array_sort(transform(spans, x -> named_struct('s', x.s, 'e', x.e, 'kind', x.kind)))").alias("_spans"))
    keyed = docs.withColumn("_tkey", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    both = keyed.join(found, F.expr("_tkey = _dkey AND CAST(doc_id AS BIGINT) <=> _did"), "left")
    mark = "element_at(array('[EMAIL]', '[IP]', '[CARD]', '[PHONE]', '[TERM]', ''), x.kind + 1)"
    built = f"aggregate(_spans, named_struct('at', 0, 'out', CAST(array() AS array<string>)), (a, x) -> if(x.s < a.at, named_struct('at', greatest(a.at, x.e), 'out', a.out), named_struct('at', x.e, 'out', concat(a.out, array(array_join(slice(_chars, a.at + 1, x.s - a.at), ''), {mark})))), a -> concat(array_join(a.out, ''), array_join(slice(_chars, a.at + 1, size(_chars)), '')))"
    lined = both.withColumn("_chars", F.expr("if(_spans IS NULL, NULL, split(text, ''))"))
    return lined.select(*[F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.expr(built)).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns])
