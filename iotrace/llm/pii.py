"""Personal data: base patterns, and terms that the corpus shows to reveal what they match. No Python runs on rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from iotrace.storage import materialize

#: Kinds in order with their patterns. ``\G`` and the look-behinds keep a scan from starting again
#: inside a run it has already read, and possessive repeats keep it from going back; matches are the same.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
_SPAN = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Matches whose places are added up together, and code points of the slices that texts are cut into.
_FOLD, _SLICE = 256, 1024


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it inside other lambdas."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _cut(slices: Column, start: Column, size: Column) -> Column:
    """``size`` code points from ``start`` of a text cut into ``slices``; only the slices concerned are read."""
    first, last = F.floor(start / _SLICE).cast("int"), F.floor((start + F.greatest(size, F.lit(1)) - 1) / _SLICE).cast("int")
    return F.substring(F.array_join(F.slice(slices, first + 1, last - first + 1), ""), start - first * _SLICE + 1, F.greatest(size, F.lit(0)))


def _slices(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_SLICE}}}"), F.lit(0))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(v, "[.]"), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.length(_digits(v)).between(12, 19) & F.call_function("luhn_check", _digits(v))
    if kind == "phone":
        return F.length(_digits(v)).between(9, 15)
    return F.lit(True)


def _spans(text: Column, kind: str) -> Column:
    """Valid matches of one kind with code-point positions, from the pieces between matches and the matches.

    Places are added up within runs of ``_FOLD`` matches and then over the runs, so that the time a text takes
    follows its length and matches, not their square.
    """
    may = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}[kind]
    pattern, k = F.lit(PATTERNS[kind]), KINDS.index(kind)
    hits = F.coalesce(F.when(may, F.regexp_extract_all(text, pattern, F.lit(0))), F.array().cast("array<string>"))
    none = F.array().cast(_SPAN)

    def step(s: Column, x: Column) -> Column:
        at = s["pos"] + F.length(x["gap"])
        end = at + F.length(x["hit"])
        span = F.struct(at.alias("start"), F.lit(k).alias("kind"), end.alias("end"), x["hit"].alias("value"))
        return F.struct(end.alias("pos"), F.when(_valid(kind, x["hit"]), F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

    def run(pairs: Column, i: Column) -> Column:
        start = F.struct(F.lit(0).alias("pos"), none.alias("out"))
        return F.aggregate(F.slice(pairs, i * _FOLD + 1, F.lit(_FOLD)), start, step)

    def runs(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _FOLD).cast("int")), lambda i: run(pairs, i))

    def offsets(folded: Column) -> Column:
        zero = F.array(F.lit(0))
        return F.aggregate(folded, zero, lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x["pos"])))

    def shifted(folded: Column, at: Column) -> Column:
        move = lambda o: lambda y: F.struct((y["start"] + o).alias("start"), y["kind"].alias("kind"), (y["end"] + o).alias("end"), y["value"].alias("value"))
        return F.flatten(F.transform(folded, lambda x, i: F.transform(x["out"], move(F.get(at, i)))))

    def listed(found: Column) -> Column:
        pairs = F.arrays_zip(F.slice(F.split(text, PATTERNS[kind], -1), 1, F.size(found)).alias("gap"), found.alias("hit"))
        placed = lambda p: _let(runs(p), lambda r: _let(offsets(r), lambda at: shifted(r, at)))
        return F.when(F.size(found) > 0, _let(pairs, placed)).otherwise(none)

    return _let(hits, listed)


def base_spans(text: Column) -> Column:
    """All valid matches as ``array<start, kind, end, value>`` by start, then kind; kind counts from 0 in ``KINDS``."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.concat(*[_spans(text, k) for k in KINDS]))


def terms(text: Column, min_letters: int = 2) -> Column:
    """Lower-cased runs of at least ``min_letters`` letters."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\P{L}+"), lambda w: F.length(w) >= min_letters)


def text_key(text: Column) -> Column:
    """What texts are matched by: their SHA-256; null texts are empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def _entities(x: Column) -> Column:
    """What a span names: its kind and value, the value without what spellings differ in; an address also its domain."""
    value = F.when(x["kind"] == 0, F.lower(x["value"])).when(x["kind"] == 1, x["value"]).otherwise(_digits(x["value"]))
    whole = F.array(F.concat(x["kind"].cast("string"), F.lit(":"), value))
    return F.when(x["kind"] == 0, F.concat(whole, F.array(F.concat(F.lit("0:@"), F.substring_index(value, "@", -1))))).otherwise(whole)


def _mentions(text: Column, spans: Column) -> Column:
    """For each span its entities and the text between it and its neighbours: all of the text, each piece twice at most."""

    def one(slices: Column) -> Callable[[Column, Column], Column]:
        def of(x: Column, i: Column) -> Column:
            last = F.when(i > 0, F.get(spans, i - 1)["end"]).otherwise(0)
            after = F.coalesce(F.get(spans, i + 1)["start"], F.length(text))
            return F.struct(
                _entities(x).alias("entities"),
                F.concat(_cut(slices, last, x["start"] - last), F.lit(" "), _cut(slices, x["end"], after - x["end"])).alias("around"),
            )

        return of

    return _let(_slices(text), lambda slices: F.transform(spans, one(slices)))


def _witness(text: Column) -> Column:
    """A name that most near copies of a text share: the least hash of its runs of five words."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    run = lambda w: F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(F.array_join(F.slice(w, i, F.lit(5)), " "))))
    return _let(words, run)


def disclosing_terms(
    docs: DataFrame,
    text_col: str = "text",
    min_texts: int = 4,
    min_disclosure: float = 0.9,
    min_share: float = 0.5,
    min_fresh: float = 0.5,
    max_broadcast: int = 50_000,
) -> DataFrame | None:
    """``(term, entity, together, texts, named, total, disclosure)`` of terms that reveal a protected entity, or None.

    An entity is the value of a base match or the domain of an address, which recurs where addresses do not. A term
    is near it if it stands, anywhere in the text, with no other match between them; so each word has four entities
    at most and the work follows the text. All counts are of
    different texts: ``together`` with e near t, ``texts`` with t, ``named`` with e, ``total`` of all. A term has
    PMI(t, e) = log p(e|t) / p(e) and discloses the share PMI / -log p(e) of the entity's information: 1 if every
    text with t names e. It counts from ``min_disclosure`` on, with e near t in at least ``min_share`` of t's
    texts and in at least ``min_texts`` of them that are no near copies of one another (``_witness``), which must
    be ``min_fresh`` of them, so that many copies of one passage are one witness.

    Entities in fewer than ``min_texts`` texts can have no such term and are left out first; texts with t are
    counted for terms with enough witnesses only, but over all texts.
    """
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    found = rows.select("key", base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0)
    mentions = materialize(found.select("key", F.explode(F.array_distinct(F.flatten(F.transform("spans", _entities)))).alias("entity")).distinct(), "mentions")
    named = materialize(mentions.groupBy("entity").agg(F.count("*").alias("named")).where(F.col("named") >= min_texts), "entities")
    n_entities = named.count()
    if not n_entities:
        return None
    common = _sized(named.select("entity"), n_entities, max_broadcast)
    keys = materialize(mentions.join(common, "entity", "left_semi").select("key").distinct(), "entity-keys")
    n_keys = keys.count()
    texts = rows.join(_sized(keys, n_keys, max_broadcast), "key", "left_semi").repartition(n_keys // 500 + 1, "key").dropDuplicates(["key"])
    # written, so that spans and witness are found once a text and not again for each word that a plan makes of it
    texts = materialize(texts.select("key", "text", base_spans(F.col("text")).alias("spans"), _witness(F.col("text")).alias("witness")), "entity-texts")
    near = texts.select("key", "witness", F.explode(_mentions(F.col("text"), F.col("spans"))).alias("m")).select("key", "witness", F.explode("m.entities").alias("entity"), "m.around")
    near = near.join(common, "entity", "left_semi")
    near = near.select("key", "entity", "witness", F.explode(F.array_distinct(terms(F.col("around")))).alias("term")).distinct()
    pairs = near.groupBy("entity", "term", "witness").agg(F.count("*").alias("n"))
    pairs = pairs.groupBy("entity", "term").agg(F.sum("n").alias("together"), F.count("*").alias("witnesses"))
    pairs = materialize(pairs.where((F.col("witnesses") >= min_texts) & (F.col("witnesses") >= min_fresh * F.col("together"))), "pairs")
    candidates = materialize(pairs.select("term").distinct(), "candidates")
    n_candidates = candidates.count()
    if not n_candidates:
        return None
    copies = materialize(rows.groupBy("key").count().where("count > 1").select("key"), "copies")
    some = _sized(copies, copies.count(), max_broadcast)

    def with_term(some_rows: DataFrame) -> DataFrame:
        each = some_rows.select("key", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
        return each.join(_sized(candidates, n_candidates, max_broadcast), "term", "left_semi")

    # only copies have to meet by text: the terms of other texts are added up where they are
    once = with_term(rows.join(some, "key", "left_anti")).groupBy("term").agg(F.count("*").alias("n"))
    again = with_term(rows.join(some, "key", "left_semi")).distinct().groupBy("term").agg(F.count("*").alias("n"))
    df = once.unionByName(again).groupBy("term").agg(F.sum("n").alias("texts"))
    total = rows.select("key").distinct().count()
    share = F.least(F.lit(1.0), F.col("together") / F.col("texts"))
    known = -F.log(F.least(F.lit(0.5), F.col("named") / F.lit(float(total))))
    judged = pairs.join(df, "term").join(named, "entity").withColumn("share", share)
    judged = judged.withColumn("total", F.lit(total).cast("bigint")).withColumn("disclosure", 1 + F.log("share") / known)
    judged = judged.where((F.col("disclosure") >= min_disclosure) & (F.col("share") >= min_share))
    out = materialize(judged.select("term", "entity", "together", "texts", "named", "total", "disclosure"), "disclosing-terms")
    return out if out.take(1) else None


def _sized(df: DataFrame, rows: int, most: int) -> DataFrame:
    """``df`` for a broadcast if its counted rows are at most ``most``, else for an ordinary join."""
    return F.broadcast(df) if rows <= most else df


def term_spans(docs: DataFrame, found: DataFrame, text_col: str = "text", max_broadcast: int = 50_000) -> DataFrame:
    """``(key, terms array<start, end, disclosure>)`` of each different text with one of the terms ``found(term, disclosure)``.

    Words travel with the key of their text; the texts that have a term are then read again, once.
    """
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", text_key(F.col("text")))
    n = found.count()
    words = rows.select("key", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    keys = materialize(words.join(_sized(found.select("term"), n, max_broadcast), "term", "left_semi").select("key").distinct(), "hit-keys")
    hit = rows.join(_sized(keys, keys.count(), max_broadcast), "key", "left_semi").dropDuplicates(["key"])
    pieces = hit.select("key", F.posexplode(F.regexp_extract_all("text", F.lit(r"\p{L}+|\P{L}+"), F.lit(0))).alias("i", "piece"))
    ends = F.expr("sum(length(piece)) over (partition by key order by i rows unbounded preceding)")
    placed = pieces.select("key", "piece", ends.cast("int").alias("end")).withColumn("start", F.col("end") - F.length("piece"))
    placed = placed.withColumn("term", F.lower("piece")).join(_sized(found, n, max_broadcast), "term")
    return placed.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms"))


def annotate(docs: DataFrame, text_col: str = "text", max_broadcast: int = 50_000, **options) -> DataFrame:
    """``docs`` with ``_base`` (base spans) and ``_terms`` (disclosing terms), both empty arrays where there are none.

    A null text is empty. Equal texts get equal spans, whatever their ids. Spans of terms that lie within a base
    span are left out.
    """
    out = docs.withColumn("_base", base_spans(F.col(text_col)))
    none = F.array().cast("array<struct<start:int,end:int,disclosure:double>>")
    found = disclosing_terms(docs, text_col, max_broadcast=max_broadcast, **options)
    if found is None:
        return out.withColumn("_terms", none)
    found = found.groupBy("term").agg(F.max("disclosure").alias("disclosure"))
    spans = materialize(term_spans(docs, found, text_col, max_broadcast), "term-spans")
    spans = spans.withColumnRenamed("key", "_key")
    spans = _sized(spans, spans.select(F.sum(F.size("terms"))).first()[0] or 0, max_broadcast)
    out = out.withColumn("_key", text_key(F.col(text_col))).join(spans.withColumnRenamed("terms", "_found"), "_key", "left")
    inside = lambda t: F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
    kept = F.filter(F.coalesce("_found", none), lambda t: ~inside(t))
    return out.withColumn("_terms", kept).drop("_key", "_found")


def _names(spans: Column) -> Column:
    kind = F.element_at(F.array(*[F.lit(k) for k in (*KINDS, TERM)]), spans["kind"] + 1)
    return F.concat_ws(":", kind, spans["start"].cast("string"), spans["end"].cast("string"))


def report(annotated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by kind, the digest of the base spans, and all spans as text."""
    base = F.transform("_base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    more = F.transform("_terms", lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), x["end"].alias("end")))
    text = lambda a: F.array_join(F.transform(a, _names), ",")
    of = lambda k: lambda x: x["kind"] == k
    counts = [F.size(F.filter("_base", of(k))).cast("bigint").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return annotated.select(
        F.col(id_col), *counts,
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.array_sort(F.concat(base, more))).alias("spans"),
        F.size("_terms").cast("bigint").alias("n_term"),
    )


def sanitize(docs: DataFrame, text_col: str = "text", remove_from: float = 0.98, **options) -> DataFrame:
    """``docs`` with base spans replaced by their kind in brackets; terms of a disclosure from ``remove_from`` on
    are removed, others become ``[TERM]``. Overlapping spans are replaced as one, by the first in order of start, then
    kind. Null stays null.
    """
    out = annotate(docs, text_col, **options)
    label = F.transform("_base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.concat(F.lit("["), F.upper(F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)), F.lit("]")).alias("say")))
    more = F.transform("_terms", lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("kind"), x["end"].alias("end"), F.when(x["disclosure"] >= remove_from, "").otherwise("[TERM]").alias("say")))
    out = out.withColumn("_all", F.array_sort(F.concat(label, more)))
    spans = F.transform("_all", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["say"].alias("say")))
    out = out.withColumn("_cut", _apart(spans))
    text, cut = F.col(text_col), F.col("_cut")

    def pieces(slices: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            last = F.when(i > 0, F.get(cut, i - 1)["end"]).otherwise(0)
            return F.concat(_cut(slices, last, x["start"] - last), x["say"])

        end = F.element_at(cut, -1)["end"]
        return F.array_join(F.concat(F.transform(cut, piece), F.array(_cut(slices, end, F.length(text) - end))), "")

    return out.withColumn(text_col, F.when(F.size("_cut") > 0, _let(_slices(text), pieces)).otherwise(text)).select(*docs.columns)


def _apart(spans: Column) -> Column:
    """Spans by start, overlapping ones made one that says what the first says.

    A span opens a new one if it starts where all before it have ended; the ends so far are found within runs of
    ``_FOLD`` spans and then over the runs.
    """
    top = lambda a: F.aggregate(a, F.lit(0), lambda s, x: F.greatest(s, x["end"]))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["reach"]
        seen = F.struct(x["start"].alias("start"), F.greatest(s["reach"], x["end"]).alias("end"), x["say"].alias("say"), fresh.alias("fresh"))
        return F.struct(F.greatest(s["reach"], x["end"]).alias("reach"), F.concat(s["out"], F.array(seen)).alias("out"))

    empty = F.array().cast("array<struct<start:int,end:int,say:string,fresh:boolean>>")

    def reached(runs: Column) -> Column:
        return F.aggregate(runs, F.array(F.lit(0)), lambda s, r: F.concat(s, F.array(F.greatest(F.element_at(s, -1), top(r)))))

    def marked(runs: Column) -> Column:
        fold = lambda at: F.flatten(F.transform(runs, lambda r, i: F.aggregate(r, F.struct(F.get(at, i).alias("reach"), empty.alias("out")), step, lambda s: s["out"])))
        return _let(reached(runs), fold)

    def joined(all_: Column) -> Column:
        placed = F.transform(all_, lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), x["say"].alias("say"), x["fresh"].alias("fresh")))
        heads = F.filter(placed, lambda x: x["fresh"])
        end = lambda h, k: F.get(all_, F.coalesce(F.get(h, k + 1)["i"], F.size(all_)) - 1)["end"]
        return _let(heads, lambda h: F.transform(h, lambda x, k: F.struct(x["start"].alias("start"), end(h, k).alias("end"), x["say"].alias("say"))))

    runs = lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / _FOLD).cast("int")), lambda i: F.slice(a, i * _FOLD + 1, F.lit(_FOLD)))
    none = F.array().cast("array<struct<start:int,end:int,say:string>>")
    return F.when(F.size(spans) > 0, _let(spans, lambda a: _let(runs(a), lambda r: _let(marked(r), joined)))).otherwise(none)
