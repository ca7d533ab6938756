"""Personal data: patterns, and terms that disclose what the patterns found.

Base spans come from four patterns. Each protected value (an address, a number) is an entity. The words of the texts that hold an
entity, outside base spans, are its candidate terms; over the whole corpus, a term's pointwise mutual information with an entity is
compared to the entity's own information content, log2(N / n(e)), all counts being of whole texts. Terms that disclose at least SHARE
of it, in at least SUPPORT documents, are marked as spans wherever they stand in any text, and sanitise() puts a general word in their place or removes them. DataFrame functions alone are used:
matches come from regexp_extract_all and their places from the lengths of what split() leaves between them. A text's matches are
gone through in blocks of about the root of their number, as a fold copies what it has gathered for each of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readqc_spark.llm.common import cut, texts
from readqc_spark.llm.url_filter import BLOCKS, LANES, _lanes, bloom

KINDS = ("email", "ip", "card", "phone", "term")
#: Where a run begins, or where the match before ended: long runs without a match are then read once.
_LOCAL = r"A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: A whole run of digits with single separators, if it has 14 to 19 digits.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SUPPORT, SHARE = 3, 0.9
NAME = r"\p{L}[\p{L}\p{M}'\x2d]{2,}+"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value computed once however often use reads it, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_blocks(items: Column, step, join, use) -> Column:
    """An array of use(block, before, after) for blocks of items. step and join fold numbers from 0: before and after are the folds of
    all items before the block and through it."""

    def blocked(x: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(x).cast("double"))), F.lit(1)).cast("int")
        return let(size, lambda n: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(x) - 1, F.lit(0)) / n).cast("int")), lambda k: F.slice(x, k * n + 1, n)))

    def folded(blocks: Column) -> Column:
        ends = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), step))
        return let(ends, lambda e: F.transform(blocks, lambda b, k: use(b, F.aggregate(F.slice(e, F.lit(1), k), F.lit(0), join), F.aggregate(F.slice(e, F.lit(1), k + 1), F.lit(0), join))))

    return let(items, lambda x: let(blocked(x), folded))


def places(text: Column, pattern: str) -> Column:
    """start, end and value of the leftmost matches of pattern; code points, end exclusive."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.transform(gaps, lambda g: F.length(g)).alias("gap"), found.alias("value"))
    none = F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.coalesce(x["gap"], F.lit(0))
        end = start + F.length(x["value"])
        return F.when(x["value"].isNull(), acc).otherwise(F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))).alias("out")))

    def use(block: Column, before: Column, _: Column) -> Column:
        return F.aggregate(block, F.struct(before.alias("at"), none.alias("out")), step)["out"]

    return F.flatten(in_blocks(pairs, lambda a, x: a + F.coalesce(x["gap"], F.lit(0)) + F.coalesce(F.length(x["value"]), F.lit(0)), lambda a, b: a + b, use))


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.translate(value, " -", ""))
    doubled = F.transform(F.split(digits, ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.when(d.cast("int") > 4, 1).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _octets(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+(?=.)", "")) <= 3) & (F.right(p, F.lit(3)).cast("int") <= 255))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then by kind."""
    digits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", "")).between(10, 15)
    none = F.expr(f"cast(array() as {SPAN})")

    def of(rank: int, may: Column, pattern: str, valid) -> Column:
        good = places(text, pattern) if valid is None else F.filter(places(text, pattern), lambda s: valid(s["value"]))
        rows = F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(KINDS[rank]).alias("kind"), s["value"].alias("value")))
        return F.when(may, rows).otherwise(none)

    return F.array_sort(F.concat(of(0, F.contains(text, F.lit("@")), EMAIL, None), of(1, F.rlike(text, F.lit(r"[0-9]\.[0-9]")), IP, _octets), of(2, F.rlike(text, F.lit(CARD)), CARD, _luhn), of(3, F.contains(text, F.lit("+")), PHONE, digits)))


def _entities(spans: Column) -> Column:
    """The distinct protected values of spans, spellings brought together."""
    return F.array_distinct(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), F.when(s["kind"] == "email", F.lower(s["value"])).otherwise(F.regexp_replace(s["value"], "[^0-9.]", "")))))


def _replaced(text: Column, spans: Column, put: Callable[[Column, Column, Column], Column], whole: bool) -> Column:
    """text with put(span, its first and end) in place of spans (sorted by start). Where spans overlap, whole says whether the later
    one is left out, or else only what lies before the end of those before it."""

    def use(block: Column, before: Column, after: Column) -> Column:
        def cut_up(chunk: Column) -> Column:
            def step(a: Column, s: Column) -> Column:
                low, high = F.greatest(a["at"], s["start"]), F.greatest(a["at"], s["end"])
                kept = F.substring(chunk, a["at"] - before + 1, low - a["at"])
                out = F.struct(high.alias("at"), F.concat(a["out"], F.array(kept, put(s, low, high))).alias("out"))
                if not whole:
                    return out
                tail = F.struct(high.alias("at"), F.concat(a["out"], F.array(F.lit(""), F.lit(""))).alias("out"))
                return F.when(s["start"] < a["at"], tail).otherwise(out)

            begun = F.struct(before.alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
            return F.array_join(F.aggregate(block, begun, step)["out"], "")

        return let(F.substring(text, before + 1, after - before), cut_up)

    last = F.array_max(F.transform(spans, lambda s: s["end"]))
    done = F.array_join(in_blocks(spans, lambda a, s: F.greatest(a, s["end"]), lambda a, b: F.greatest(a, b), use), "")
    return F.when(F.size(spans) > 0, F.concat(done, F.substring(text, last + 1, F.length(text)))).otherwise(text)


def _blanked(text: Column, spans: Column) -> Column:
    """text with spaces in place of base spans: what is left stays where it is."""
    return _replaced(text, spans, lambda s, low, high: F.repeat(F.lit(" "), high - low), whole=False)


def cleaned(text: Column, spans: Column) -> Column:
    """text with a general word in place of each span: base kinds by [EMAIL] and so on, capitalised terms by [NAME]; other terms go.

    Of overlapping spans the one that starts first is named, and what the later one covers beyond it goes.
    """
    general = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(F.rlike(s["value"], F.lit(r"^\p{Lu}")), F.lit("[NAME]")).otherwise(F.lit(""))
    return _replaced(text, spans, lambda s, low, high: general(s), whole=True)


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(NAME), F.lit(0)), F.lower))


def _let(df: DataFrame, column: str, listed: DataFrame) -> DataFrame:
    """The rows of df that a filter of fixed size lets through: all whose column is in listed (url_key), and a few others."""
    names = df.columns
    let = df.withColumns({"block": F.pmod(F.xxhash64(column), F.lit(BLOCKS)).cast("int"), **{f"bit{k}": x for k, x in enumerate(_lanes(F.col(column)))}}).join(F.broadcast(bloom(listed)), "block")
    for k in range(LANES):
        let = let.filter(F.col(f"lane{k}").bitwiseAND(F.col(f"bit{k}")) == F.col(f"bit{k}"))
    return let.select(names)


def disclosing(near: DataFrame, docs: DataFrame, n: int, support: int = SUPPORT, share: float = SHARE, n_entity: DataFrame | None = None) -> DataFrame:
    """entity, term, n_both, pmi, content of the pairs whose information passes the threshold. near: row, entity, term, distinct.

    n_entity: entity, n_entity, where some rows of an entity have no term and so aren't in near.
    """
    if n_entity is None:
        n_entity = near.select("row", "entity").distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    n_near = cut(near.select("row", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_near")).filter(F.col("n_near") >= support))
    content = F.log2(F.lit(float(n)) / F.col("n_entity"))

    def pmi(n_term: Column) -> Column:
        return F.log2(F.col("n_both") * F.lit(float(n)) / (n_term * F.col("n_entity")))

    # As n_both is n_entity at most, a term of more texts than this can't pass for any entity; a tenth more, for rounding.
    top = n_entity.agg(F.max("n_entity")).first()[0] or 1
    most = 1.1 * top * (n / top) ** (1 - share) + 1 if share <= 1 else float(n)
    both = _let(near, "term", n_near.filter(F.col("n_near") <= most).select(F.col("term").alias("url_key")))
    both = both.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")).filter(F.col("n_both") >= support)
    # A term stands in at least as many texts as it stands in with entities, so what fails with that count needs no other.
    both = both.join(n_entity, "entity").join(n_near, "term").withColumn("content", content)
    both = cut(both.filter((F.col("content") > 0) & (pmi(F.greatest("n_near", "n_both")) >= share * F.col("content"))))
    # The words of all texts are counted, but only those that a filter of fixed size lets through are shuffled.
    n_term = _let(docs.select(F.explode(_words(F.col("text"))).alias("term")), "term", both.select(F.col("term").alias("url_key")).distinct()).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    counted = both.join(n_term, "term").withColumn("pmi", pmi(F.greatest("n_term", "n_both")))
    return counted.filter(F.col("pmi") >= share * F.col("content")).select("entity", "term", "n_both", "pmi", "content")


def _marked(text: DataFrame, rows: DataFrame, terms: DataFrame) -> DataFrame:
    """key, marked (spans, terms outside base spans among them) and marked_sha256 (of the cleaned text), for each text with such terms.

    text: key, text. rows: key, spans.
    """
    listed = terms.select(F.col("term").alias("url_key"))
    clear = text.withColumn("spans", base_spans(F.col("text"))).select("key", _blanked(F.col("text"), F.col("spans")).alias("text"))
    # Inner joins with distinct columns: the optimizer would put a semi join before the filter.
    hits = _let(clear.select("key", F.explode(_words(F.col("text"))).alias("term")), "term", listed).join(terms, "term")
    hits = cut(hits.groupBy("key").agg(F.collect_set("term").alias("told")))
    some = _let(text, "key", hits.select(F.col("key").alias("url_key"))).dropDuplicates(["key"])
    held = some.join(hits.join(rows.select("key", "spans").dropDuplicates(["key"]), "key"), "key")
    held = held.select("key", "told", "spans", "text", _blanked(F.col("text"), F.col("spans")).alias("clear"))
    span = lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("rank"), x["end"].alias("end"), F.lit("term").alias("kind"), x["value"].alias("value"))
    told = F.transform(F.filter(places(F.col("clear"), NAME), lambda x: F.array_contains("told", F.lower(x["value"]))), span)
    held = held.withColumn("terms", told).withColumn("all", F.array_sort(F.concat("spans", "terms")))
    return held.select("key", F.col("all").alias("marked"), F.sha2(cleaned(F.col("text"), F.col("all")), 256).alias("marked_sha256"))


def find_private(docs: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """doc_id, spans (start, rank, end, kind, value; sorted) and clean_sha256 (of the cleaned text) for each row of docs (doc_id, text).

    Base spans are as the patterns say; spans of kind term come from the corpus. A null text is empty. Repeated rows each get their
    row and each count as a document. Very long texts are read whole; the work grows with a text's length and the root of the number
    of its matches. An empty table gives an empty result; other columns, whatever their names, aren't looked at.
    """
    return _found(docs, support, share).select("doc_id", "spans", "clean_sha256")


def _key() -> Column:
    """A digest of doc_id and text, null ids told apart from others."""
    return F.unhex(F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.col("text")), 256))


def _found(docs: DataFrame, support: int, share: float) -> DataFrame:
    text = texts(docs)
    spanned = text.withColumn("spans", base_spans(F.col("text")))
    clear = spanned.withColumn("clear", _blanked(F.col("text"), F.col("spans")))
    rows = clear.select("doc_id", _key().alias("key"), "spans", F.sha2(cleaned(F.col("text"), F.col("spans")), 256).alias("clean"), F.when(F.size("spans") > 0, _entities(F.col("spans"))).alias("entities"), F.when(F.size("spans") > 0, _words(F.col("clear"))).alias("words"))
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    n = rows.count()
    owned = rows.filter(F.size("entities") > 0).select("row", F.explode("entities").alias("entity"))
    n_entity = cut(owned.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter(F.col("n_entity") >= support))
    # An entity of fewer texts than support has no term of so many: its words aren't paired.
    held = _let(owned, "entity", n_entity.select(F.col("entity").alias("url_key"))).join(n_entity, "entity").groupBy("row").agg(F.collect_set("entity").alias("entities"))
    near = cut(held.join(rows.select("row", "words"), "row")).select("row", "entities", F.explode("words").alias("term")).select("row", F.explode("entities").alias("entity"), "term")
    pairs = disclosing(near, clear.select(F.col("clear").alias("text")), max(n, 1), support, share, n_entity)
    marked = _marked(text.select(_key().alias("key"), "text"), rows, cut(pairs.select("term").distinct()))
    return rows.select("doc_id", "key", "spans", "clean").join(marked, "key", "left").select("doc_id", "key", F.coalesce("marked", "spans").alias("spans"), F.coalesce("marked_sha256", "clean").alias("clean_sha256"))


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The counts and strings of op5 from the result of find_private, and clean_sha256."""
    base = F.filter("spans", lambda s: s["kind"] != "term")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"), "clean_sha256")


def sanitise(docs: DataFrame, support: int = SUPPORT, share: float = SHARE) -> DataFrame:
    """doc_id and text, cleaned(), for each row of docs (doc_id, text), whatever their ids; null texts are empty. Other columns are left behind."""
    spans = _found(docs, support, share).filter(F.size("spans") > 0).select("key", F.col("spans").alias("found")).dropDuplicates(["key"])
    joined = texts(docs).withColumn("key", _key()).join(spans, "key", "left")
    return joined.select("doc_id", F.when(F.col("found").isNull(), F.col("text")).otherwise(cleaned(F.col("text"), F.col("found"))).alias("text"))
