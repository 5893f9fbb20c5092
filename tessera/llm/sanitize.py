"""Personal data: fixed patterns, and information-theoretic sanitisation of what else reveals them.

The patterns find e-mail addresses, IP addresses, card and phone numbers in whole texts. The found values are the
protected entities. A term (a run of letters and digits outside of base spans) co-occurs with an entity in a text if
it stands within REACH characters of it there. From the corpus one counts in how many distinct texts an entity stands,
in how many a term stands (near an entity or not), and in how many both co-occur; exact copies count once.

P(entity | term) is estimated with Jeffreys' half count, (both + P(entity) / 2) / (texts of the term + 1 / 2), so that
a single text is weak evidence. Its logarithm over P(entity), divided by the entity's own information, is the term's
disclosure: near 1 if the term all but names the entity, near 0 if it tells nothing. A term reveals an entity if it
makes it more likely than not (P(entity | term) > LIKELY) and its disclosure reaches a threshold: from REMOVE up it is
removed from all texts, with or without the entity, and from GENERALISE up it is generalised to its shape. So a rare
word far from any entity stays, and so does a word that stands as often without the entity as with it. An entity of
one text has terms that reveal it like others: those near it that stand in this text alone.

Only DataFrame functions are used. What is collected is bitmaps of BITMAP bits (of candidate terms' hashes, of the
hashes of texts to look at again): a term or text that shares a bit is looked at too and does no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

#: The kinds in order, and their patterns. Each is written so that a failing start fails at once: the
#: look-behind allows only the first place of a run, and possessive repeats do not give back.
MARK = "\x01"
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to be tried.
HINTS = {"email": "@", "phone": "+"}
BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

#: A term, of any length: short names and numbers of accounts or cases count too; the threshold decides.
TERM = r"[\p{L}\p{N}]+"
BETWEEN = r"[^\p{L}\p{N}]+"
REMOVE, GENERALISE, LIKELY = 0.9, 0.75, 0.5
REACH = 120  # characters on either side of an entity
BITMAP = 1 << 22

SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn test."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when((F.length(digits) - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$")
    if kind == "card":
        return luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def marked_spans(text: Column, pattern: Column | str, kind: str, order: int) -> Column:
    """Spans of all matches, in code points: matches are set between marks, and the pieces' lengths add up.

    The mark must not occur in the text.
    """
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(SPAN).alias("out"))

    def add(a: Column, piece: Column) -> Column:
        end = a["at"] + F.length(piece)
        span = F.struct(a["at"].alias("start"), F.lit(order).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), piece.alias("value"))
        return F.struct(end.alias("at"), (a["i"] + 1).alias("i"), F.when(a["i"] % 2 == 1, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.when(F.size(pieces) > 1, F.aggregate(pieces, start, add)["out"]).otherwise(F.array().cast(SPAN))


def term_spans(text: Column, drop: Column, hint: Column) -> Column:
    """Spans of the terms of a text that stand in the array drop (kind `term`) or hint; null arrays are empty."""
    pieces = F.split(F.regexp_replace(unmarked(text), TERM, f"{MARK}$0{MARK}"), MARK)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(SPAN).alias("out"))

    def add(a: Column, piece: Column) -> Column:
        end, order = a["at"] + F.length(piece), len(KINDS)
        kind = F.when(a["i"] % 2 == 1, F.when(F.array_contains(drop, piece), "term").when(F.array_contains(hint, piece), "hint"))
        span = F.struct(a["at"].alias("start"), F.when(kind == "term", order).otherwise(order + 1).alias("ord"), end.alias("end"), kind.alias("kind"), piece.alias("value"))
        return F.struct(end.alias("at"), (a["i"] + 1).alias("i"), F.when(kind.isNotNull(), F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    some = (F.coalesce(F.size(drop), F.lit(0)) > 0) | (F.coalesce(F.size(hint), F.lit(0)) > 0)
    return F.when(some, F.aggregate(pieces, start, add)["out"]).otherwise(F.array().cast(SPAN))


def unmarked(text: Column) -> Column:
    """The text without the mark, which no pattern knows; lengths stay."""
    return F.when(F.contains(text, F.lit(MARK)), F.translate(text, MARK, "\x02")).otherwise(text)


def base_spans(text: Column) -> Column:
    """All valid spans of the four kinds in a text (not null), by start and then kind."""

    def of_kind(kind: str) -> Column:
        spans = F.filter(marked_spans(unmarked(text), F.lit(PATTERNS[kind]), kind, KINDS.index(kind)), lambda s: valid(kind, s["value"]))
        return F.when(F.contains(text, F.lit(HINTS[kind])), spans).otherwise(F.array().cast(SPAN)) if kind in HINTS else spans

    return F.array_sort(F.concat(*map(of_kind, KINDS)))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(text: Column, base: Column) -> Column:
    """The text with spaces in place of its base spans; lengths stay."""
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["end"] + 1, F.greatest(s["start"] - a["end"], F.lit(0)))
        blank = F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0)))
        return F.struct(F.greatest(a["end"], s["end"]).alias("end"), F.concat(a["out"], F.array(gap, blank)).alias("out"))

    done = F.aggregate(base, zero, add)
    return F.concat(F.array_join(done["out"], ""), F.substring(text, done["end"] + 1, F.length(text)))


def entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], span["value"])


def near_terms(clear: Column, span: Column, reach: int = REACH) -> Column:
    """The distinct terms that lie whole within `reach` characters of a span of the text, whose masked form is clear."""
    first = F.greatest(span["start"] - reach, F.lit(0))
    before = F.substring(clear, first + 1, span["start"] - first)
    before = F.when(first > 0, F.regexp_replace(before, rf"^{TERM}", "")).otherwise(before)
    after = F.substring(clear, span["end"] + 1, F.lit(reach))
    after = F.when(F.length(clear) > span["end"] + reach, F.regexp_replace(after, rf"{TERM}$", "")).otherwise(after)
    return _terms(F.concat_ws(" ", before, after))


def _terms(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(text, BETWEEN)), lambda t: F.length(t) > 0)


def _bitmap(values: DataFrame) -> Column:
    """A literal array of longs with a bit for the hash of each value of the only column; at most BITMAP bits are collected."""
    bit = F.pmod(F.xxhash64(values.columns[0]), F.lit(BITMAP))
    words = values.select(F.shiftright(bit, 6).alias("w"), F.pmod(bit, F.lit(64)).cast("int").alias("b")).distinct()
    rows = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).collect()
    table = [0] * (BITMAP // 64)
    for r in rows:
        table[r.w] = r.bits
    return F.split(F.lit(",".join(map(str, table))), ",").cast("array<bigint>")


def _marked(table: Column, value: Column) -> Column:
    bit = F.pmod(F.xxhash64(value), F.lit(BITMAP))
    return F.getbit(F.element_at(table, (F.shiftright(bit, 6) + 1).cast("int")), F.pmod(bit, F.lit(64)).cast("int")) == 1


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def entity_terms(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """(h, entity, terms): for each distinct text of docs (h, t) and each of its entities, the terms near it."""
    found = docs.withColumn("base", base_spans(F.col("t"))).where(F.size("base") > 0).withColumn("clear", masked(F.col("t"), F.col("base")))
    near = F.transform("base", lambda s: F.struct(entity(s).alias("entity"), near_terms(F.col("clear"), s, reach).alias("terms")))
    once = found.select("h", near.alias("near")).dropDuplicates(["h"])
    rows = once.select("h", F.explode("near").alias("n")).select("h", "n.entity", "n.terms")
    return rows.groupBy("h", "entity").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))


def likelihood(both: Column, texts: Column, share: Column) -> Column:
    """P(entity | term) with Jeffreys' half count, which is shared out like the entity."""
    return (both + share / 2) / (texts + 0.5)


def candidates(near: DataFrame, n: int, likely: float = LIKELY) -> DataFrame:
    """(entity, term, df_entity, df_both) that can pass `likely`. A term stands in no fewer texts than those in which it
    is near some entity, which leaves out frequent words before the corpus is counted."""
    frequency = near.groupBy("entity").agg(F.count("*").alias("df_entity"))
    pairs = near.select("h", "entity", F.explode("terms").alias("term"))
    seen = pairs.select("h", "term").distinct().groupBy("term").agg(F.count("*").alias("df_near"))
    both = pairs.groupBy("entity", "term").agg(F.count("*").alias("df_both")).join(frequency, "entity").join(seen, "term")
    able = likelihood(F.col("df_both"), F.col("df_near"), F.col("df_entity") / n) > likely
    return both.where(able).select("entity", "term", "df_entity", "df_both")


def disclosure(able: DataFrame, where: DataFrame, n: int, likely: float = LIKELY) -> DataFrame:
    """(entity, term, likely, disclosure) of candidates. where: (h, term), the texts of each candidate term; n: the
    number of distinct texts."""
    texts = where.distinct().groupBy("term").agg(F.count("*").alias("df_term"))
    share = F.col("df_entity") / F.lit(float(max(n, 2)))
    known = able.join(texts, "term").withColumn("likely", likelihood(F.col("df_both"), F.col("df_term"), share)).where(F.col("likely") > likely)
    part = F.when(share < 1, F.log(F.col("likely") / share) / -F.log(share)).otherwise(F.lit(0.0))
    return known.select("entity", "term", "likely", part.alias("disclosure"))


def find_spans(docs: DataFrame, remove: float = REMOVE, generalise: float = GENERALISE, likely: float = LIKELY, reach: int = REACH, text: str = "text") -> DataFrame:
    """(row, t, base, spans): each row of docs as a struct, its text, its base spans and all spans.

    Spans of the method have the kinds `term` (removed) and `hint` (generalised); none overlaps a base span.
    Null texts are empty texts and have no spans; repeated rows all stay, and their text counts once; an
    empty table gives an empty result.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    t = F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t")
    h = text_hash(F.col("t")).alias("h")
    texts = docs.select(t).select("t", h)
    n = texts.select("h").distinct().count()
    near = stage(entity_terms(texts, reach), "near")
    able = stage(candidates(near, n, likely), "candidates")
    wanted, holders = _bitmap(able.select("term").distinct()), _bitmap(near.select("h"))
    # terms outside of base spans, in every text; only texts that may have entities are searched for spans again
    maybe = _marked(holders, F.col("h"))
    clear = F.when(maybe, masked(F.col("t"), base_spans(F.col("t")))).otherwise(F.col("t"))
    where = stage(texts.select("h", F.explode(F.filter(_terms(clear), lambda x: _marked(wanted, x))).alias("term")), "where")
    shown = disclosure(able, where, n, likely).where(F.col("disclosure") >= generalise).groupBy("term").agg(F.max("disclosure").alias("d"))
    drop, hint = F.when(F.col("d") >= remove, F.col("term")), F.when(F.col("d") < remove, F.col("term"))
    flagged = stage(where.distinct().join(shown, "term").groupBy("h").agg(F.sort_array(F.collect_list(drop)).alias("drop"), F.sort_array(F.collect_list(hint)).alias("hint")), "flagged")

    again = maybe | _marked(_bitmap(flagged.select("h")), F.col("h"))
    none = F.array().cast(SPAN)
    rows = docs.select(row, t).select("row", "t", h)
    plain = rows.where(~again).select("row", "t", none.alias("base"), none.alias("spans"))
    joined = rows.where(again).join(flagged, "h", "left").withColumn("base", base_spans(F.col("t")))
    more = term_spans(F.col("t"), F.col("drop"), F.col("hint"))
    apart = F.filter(more, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return plain.unionByName(joined.select("row", "t", "base", F.array_sort(F.concat("base", apart)).alias("spans")))


def shape(value: Column) -> Column:
    """The generalised form of a term: [number] if it holds a digit, else its letters' kinds."""
    named = F.when(value.rlike(r"^\p{Lu}"), "[Name]").otherwise("[word]")
    return F.when(value.rlike(r"\p{N}"), "[number]").otherwise(named)


def sanitised(text: Column, spans: Column) -> Column:
    """The text with its spans replaced: base spans by their kind, terms by [term], hints by their shape.

    Of spans that overlap, what lies before the end of an earlier one is not shown again.
    """
    zero = F.struct(F.lit(0).alias("end"), F.array().cast("array<string>").alias("out"))

    def add(a: Column, s: Column) -> Column:
        gap = F.substring(text, a["end"] + 1, F.greatest(s["start"] - a["end"], F.lit(0)))
        tag = F.when(s["kind"] == "hint", shape(s["value"])).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        return F.struct(F.greatest(a["end"], s["end"]).alias("end"), F.concat(a["out"], F.array(gap, tag)).alias("out"))

    done = F.aggregate(spans, zero, add)
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(done["out"], ""), F.substring(text, done["end"] + 1, F.length(text))))


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row of docs."""
    rows = find_spans(docs.select(key, text), text=text, **options)

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = map(count, KINDS)
    return rows.select(F.col(f"row.{key}").alias(key), *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """docs with sanitised texts; texts without spans, null ones included, stay as they are."""
    rows = find_spans(docs, text=text, **options)
    new = F.when(F.size("spans") == 0, F.col(f"row.`{text}`")).otherwise(sanitised(F.col("t"), F.col("spans")))
    return rows.select(*[(new if c == text else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


