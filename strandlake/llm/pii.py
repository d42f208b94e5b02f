"""Personal data: base patterns, and terms that disclose the found entities by corpus co-occurrence. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from strandlake.llm.runtime import written

# The kinds in their order, and their patterns. Each pattern matches what the plain one does (email
# [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, and so on), but in time and stack that do not grow with a run of its characters: a match starts at the start of such
# a run or where the last match ended, and loops are over single characters.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-](?:[A-Za-z0-9.-](?<!\.(?![A-Za-z0-9-])))*+",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[0-9 -](?<![ -](?![0-9])))++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = tuple(PATTERNS)
#: Texts' worth of the entity's overall share that are added to what a term's own texts say of it: rare entities and terms count, but not as certain.
SMOOTH = 0.5
#: A term discloses an entity if their pointwise mutual information reaches the entity's information content over ALPHA.
ALPHA = 1.1
TERM = r"[\p{L}\p{M}]+"
_BYTE_PART = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"


def _luhn(digits: Column) -> Column:
    """Whether a string of digits has a valid Luhn sum."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    card = F.length(digits).between(14, 19)
    return (
        F.when(kind == "ip", value.rlike(_BYTE_PART))
        .when(kind == "card", F.when(card, _luhn(digits)).otherwise(F.lit(False)))
        .when(kind == "phone", F.length(digits).between(10, 15))
        .otherwise(F.lit(True))
    )


def _located(found: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end, value of rows with keys, gaps (what lies between the matches) and hits; code points, end exclusive."""
    pairs = F.arrays_zip(F.slice("gaps", F.lit(1), F.size("hits")).alias("gap"), F.col("hits").alias("hit"))
    one = found.select(*keys, F.posexplode(pairs).alias("i", "p")).select(*keys, "i", F.length("p.gap").cast("long").alias("g"), F.col("p.hit").alias("value"))
    upto = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("value").cast("long")
    end = F.sum(F.col("g") + size).over(upto)
    return one.select(*keys, (end - size).alias("start"), end.alias("end"), "value")


def _as_long_as(n: int):
    return lambda x: F.length(x) >= n


def found_in(texts: DataFrame) -> DataFrame:
    """(k, text, x) of the texts (k, text) that may hold a base match, equal texts once; x: kind, gaps (lengths of what lies between the raw matches) and hits. Kinds whose raw matches are all too short are left out."""
    needs = {"email": F.contains("text", F.lit("@")), "phone": F.contains("text", F.lit("+")), "ip": F.contains("text", F.lit(".")), "card": F.lit(True)}
    least = {"email": 1, "ip": 7, "card": 14, "phone": 11}
    every = [F.when(needs[kind], F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias(kind) for kind, pattern in PATTERNS.items()]
    found = texts.select("k", "text", *every)
    lists = [F.struct(F.lit(kind).alias("kind"), F.when(F.exists(kind, _as_long_as(least[kind])), F.split("text", PATTERNS[kind], -1)).alias("gaps"), F.col(kind).alias("hits")) for kind in KINDS]
    found = found.select("k", "text", F.filter(F.array(*lists), lambda x: F.size(x["gaps"]) > 0).alias("x")).where(F.size("x") > 0)
    found = found.select("k", "text", F.transform("x", lambda x: F.struct(x["kind"].alias("kind"), F.transform(F.slice(x["gaps"], F.lit(1), F.size(x["hits"])), F.length).alias("gaps"), x["hits"].alias("hits"))).alias("x"))
    return found.groupBy("k").agg(F.first("text").alias("text"), F.first("x").alias("x"))


def base_spans(texts: DataFrame) -> DataFrame:
    """(k, kind, start, end, value) of all base matches in the texts (k, text); k is the text's md5, equal texts count once."""
    return placed_spans(found_in(texts))


def placed_spans(found: DataFrame) -> DataFrame:
    """(k, kind, start, end, value) of the base matches in what found_in returns."""
    found = found.select("k", F.explode("x").alias("x")).select("k", "x.*")
    pairs = F.arrays_zip(F.col("gaps").alias("gap"), F.col("hits").alias("hit"))
    one = found.select("k", "kind", F.posexplode(pairs).alias("i", "p")).select("k", "kind", "i", F.col("p.gap").cast("long").alias("g"), F.col("p.hit").alias("value"))
    upto = Window.partitionBy("k", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.length("value").cast("long")
    end = F.sum(F.col("g") + size).over(upto)
    placed = one.select("k", "kind", (end - size).alias("start"), end.alias("end"), "value")
    return placed.where(_valid(F.col("kind"), F.col("value")))


def disclosing(texts: DataFrame, spans: DataFrame, smooth: float = SMOOTH, alpha: float = ALPHA, some: DataFrame | None = None) -> DataFrame:
    """(k, term): terms of a text that disclose an entity in it.

    Entities are base matches (kind, value); entities and terms count once for each distinct text, and no count is too small. With n texts, an entity e in the share
    p = c(e) / n of them, a term t in c(t) and both in c(e, t), e's share of t's texts is q = (c(e, t) + smooth p) / (c(t) + smooth), and t discloses e if
    log(q / p) >= log(1 / p) / alpha. An entity in all texts has no information that a term could disclose.
    Terms are lower-cased runs of letters outside the base matches' values. All entities that only one text has tell the same of its terms, and are one there. some: those of the texts that hold
    entities, each once (k, text), if they are at hand. Terms of all texts are counted before they are shuffled.
    """
    held = written(spans.select("k", F.xxhash64("kind", F.lower("value")).alias("e")).distinct(), "pii-entities")
    if held.isEmpty():
        return spans.select("k", F.col("value").alias("term")).limit(0)
    n = texts.select("k").distinct().count()
    often = held.groupBy("e").agg(F.count("*").alias("ce")).where(F.col("ce") < n)
    bare = F.col("text")
    for pattern in PATTERNS.values():
        bare = F.regexp_replace(bare, pattern, " ")
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(TERM), F.lit(0)))
    share = F.col("ce") / F.lit(float(n))

    def tells(ct: Column) -> Column:
        return F.log((F.col("cet") + F.lit(smooth) * share) / (ct + F.lit(smooth)) / share) >= -F.log(share) / alpha

    named = F.when(F.col("ce") == 1, F.xxhash64("k", F.lit("alone"))).otherwise(F.col("e"))
    held = written(held.join(often, "e").select("k", named.alias("e"), "ce").distinct(), "pii-held")
    often = held.select("e", "ce").distinct()
    with_entity = held.select("k").distinct()
    if some is None:
        some = texts.join(with_entity, "k", "left_semi").groupBy("k").agg(F.first("text").alias("text"))
    near = written(some.join(with_entity, "k", "left_semi").select("k", F.explode(words(bare)).alias("term")), "pii-terms")
    held = held.select("k", "e")
    both = near.join(held, "k").groupBy("e", "term").agg(F.count("*").alias("cet")).join(often, "e")
    # c(t) >= c(e, t), so what fails even at c(t) = c(e, t) needs no count over the corpus.
    both = written(both.where(tells(F.col("cet"))), "pii-pairs")
    wanted = both.select("term").distinct()
    distinct_texts = texts.groupBy("k").agg(F.first("text").alias("text"))
    counts = distinct_texts.select(F.explode(words(bare)).alias("term")).groupBy("term").agg(F.count("*").alias("ct"))
    counts = counts.join(wanted, "term", "left_semi")
    pairs = both.join(counts, "term").where(tells(F.col("ct"))).select("e", "term")
    return near.join(held, "k").join(pairs, ["e", "term"], "left_semi").select("k", "term").distinct()


def term_spans(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(k, kind = term, start, end, value): where the terms (k, term) stand in the texts (k, text), each of them once."""
    found = texts.join(terms.select("k").distinct(), "k", "left_semi").select("k", F.split("text", TERM, -1).alias("gaps"), F.regexp_extract_all("text", F.lit(TERM), F.lit(0)).alias("hits"))
    placed = _located(found, ["k"]).withColumn("term", F.lower("value"))
    return placed.join(terms, ["k", "term"], "left_semi").select("k", F.lit("term").alias("kind"), "start", "end", "value")


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, k, text); a null text is an empty one."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("k"), text.alias("text"))


def all_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keyed rows and all spans (k, kind, start, end, value) of their texts. A term that overlaps a base match is left out."""
    rows = keyed(docs)
    found = written(found_in(rows), "pii-found")
    base = written(placed_spans(found), "pii-base")
    some = found.select("k", "text")
    terms = written(term_spans(some, written(disclosing(rows, base, some=some), "pii-disclosing")), "pii-term-spans")
    busy = base.select(F.col("k").alias("_k"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    free = terms.join(busy, (F.col("k") == F.col("_k")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_anti")
    return rows, base.unionByName(free)


def _is(kind: str):
    return lambda x: x == kind


def detect(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Base matches are the leftmost non-overlapping ones of each kind in the whole text, without those that fail their check; spans holds them and
    the disclosing terms, kind:start:end by start, then kind. Null texts are empty ones, repeated rows are rows, a null doc_id is reported as such; texts without spans
    get zeros, the hash of an empty string and an empty string. An empty table gives an empty result. Other columns are ignored.
    """
    rows, spans = all_spans(docs)
    rank = F.array_position(F.array(*[F.lit(k) for k in (*KINDS, "term")]), F.col("kind"))
    told = spans.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("r"), "end", "kind"))).alias("s"))  # one text's own
    written_as = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("s", lambda x: x["kind"] != "term")
    counts = [F.size(F.filter(F.col("s")["kind"], _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS]
    digest = written(told.select("k", *counts, F.sha2(written_as(base), 256).alias("base_sha256"), written_as(F.col("s")).alias("spans")), "pii-digest")
    out = rows.select("doc_id", "k").join(digest, "k", "left")
    none = F.sha2(F.lit(""), 256)
    return out.select("doc_id", *[F.coalesce(f"n_{kind}", F.lit(0).cast("long")).alias(f"n_{kind}") for kind in KINDS], F.coalesce("base_sha256", none).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, text with each base match generalised to its kind in brackets and each disclosing term removed; overlapping matches become the first one's kind.

    A null text is an empty one. Other columns are dropped, repeated rows are rows, an empty table gives an empty result.
    """
    rows, spans = all_spans(docs)
    before = F.max("end").over(Window.partitionBy("k").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1))
    group = F.sum(F.when(F.col("start") < F.col("before"), 0).otherwise(1)).over(Window.partitionBy("k").orderBy("start", "end", "kind"))
    merged = spans.withColumn("before", before).withColumn("g", group).groupBy("k", "g").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", "end", "kind")).alias("kind"))
    cuts = merged.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("s"))
    both = rows.join(cuts, "k", "left")
    part = lambda x, i: F.concat(
        F.substring(F.col("text"), (F.when(i == 0, 0).otherwise(F.col("s")[i - 1]["end"]) + 1).cast("int"), (x["start"] - F.when(i == 0, 0).otherwise(F.col("s")[i - 1]["end"])).cast("int")),
        F.when(x["kind"] == "term", "").otherwise(F.concat(F.lit("["), x["kind"], F.lit("]"))),
    )
    tail = F.substring(F.col("text"), (F.element_at("s", -1)["end"] + 1).cast("int"), F.length("text"))
    return both.select("doc_id", F.when(F.col("s").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.transform("s", part), ""), tail)).alias("text"))
